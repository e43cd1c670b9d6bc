"""tidewater: Spark-native analytics over ordered series (bars, ticks, events)."""

__version__ = "0.1.0"

"""Stands in for an indicator library."""


def midpoint(high, low, length=1):
    return ((high + low) / 2).rolling(length).mean()


def bands(close, width=2.0):
    return {"up": close + width, "down": close - width}


def unrelated(x):
    return x

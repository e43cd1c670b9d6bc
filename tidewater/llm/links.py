"""Connected components of link tables, by contraction; nothing but tables in the shared folder between rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.storage import written

_EDGES = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars around the smallest node of each tree: no more rows than came in."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    stars = [(x, root(x)) for x in [*up]]
    stars = [s for s in stars if s[0] != s[1]]
    for k in range(0, len(stars), 100_000):
        yield pa.RecordBatch.from_pydict({"a": [s[0] for s in stars[k : k + 100_000]], "b": [s[1] for s in stars[k : k + 100_000]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a long, b long); root is the component's smallest node.

    Each round every node takes its smallest neighbour, or itself, as parent, and parents' parents; the links
    between different parents are the next round's. Null ends are ignored. Rounds grow with the logarithm of the
    longest path."""
    links = links.where("a != b").select("a", "b")
    links = written(links.distinct().mapInArrow(_forest, _EDGES), "links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = written(nodes.withColumn("root", F.col("node")), "labels")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("p")).select("u", F.least("u", "p").alias("p"))
        parent = written(parent, "parents")
        above = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = written(parent.join(above, "p").select("u", F.col("q").alias("p")), "grandparents")
        labels = labels.join(parent.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = written(labels, "labels")
        ends = links.join(parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        ends = ends.where("pa != pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
        links = written(ends.mapInArrow(_forest, _EDGES), "links")
    return labels

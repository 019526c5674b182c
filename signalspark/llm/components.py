"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.llm.shared import landed


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars around their smallest nodes: no node has two, or one on either side."""
    ends = links.select(F.col("hi").alias("node"), "lo").unionAll(links.select("lo", F.lit(None).cast("bigint")))
    seen = ends.groupBy("node").agg(
        F.min("lo").alias("least"), F.max("lo").alias("most"), F.count("*").alias("n"), F.count("lo").alias("above")
    )
    return seen.where("least <> most OR (above > 0 AND above < n)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Large and small stars in turn: every node hands its larger neighbours, then its smaller ones, to
    its smallest neighbour, until only stars are left. No neighbourhood is ever held as a whole; a node
    with very many links is summed up before the shuffle and its join can be split.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links = landed(links.distinct(), "links")
    while not _settled(links):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        both = both.unionAll(links.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = landed(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = landed(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)


def bitmap(numbers: DataFrame, bits: int = 1 << 23) -> bytes:
    """A filter over 64-bit numbers (column ``x``): the bit of every number is set.

    It has a fixed size whatever the table's; where the table is large it lets more pass, so it may
    only be used to leave out work, not to decide.
    """
    import numpy as np

    places = numbers.select(F.pmod(F.col("x"), F.lit(bits)).cast("int").alias("place"))
    words = places.groupBy(F.expr("shiftright(place, 5)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, place & 31))").alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return out.tobytes()


class Bitmap:
    """Look-ups in what ``bitmap`` made."""

    def __init__(self, data: bytes):
        import numpy as np

        self.words = np.frombuffer(data, np.uint32)
        self.bits = len(self.words) * 32

    def __call__(self, numbers):
        """numbers: int64 array."""
        import numpy as np

        place = np.mod(numbers, self.bits)
        return (self.words[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1

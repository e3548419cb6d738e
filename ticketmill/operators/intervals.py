"""Points in intervals, met at dyadic nodes of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 3_600  # seconds of the finest node
# Points of a node that one tile holds; a node with more is cut into tiles.
TILE = 20_000


def cell(seconds: Column) -> Column:
    return F.floor(seconds / CELL).cast("long")


def cover(lo: Column, hi: Column, levels: int) -> Column:
    """The canonical nodes ``(level, node)`` of the cells from ``lo`` to ``hi``: at most two per level.

    They lie side by side and fill the interval; a node of level ``k`` is
    ``2 ** k`` cells wide.
    """
    node = "array<struct<level:int,node:bigint>>"
    start = F.struct(lo.alias("l"), (hi + 1).alias("r"), F.array().cast(node).alias("nodes"))

    def step(state: Column, level: Column) -> Column:
        l, r = state["l"], state["r"]
        some = l < r
        low = F.when(some & (l.bitwiseAND(F.lit(1)) == 1), l)
        after = F.coalesce(low + 1, l)
        high = F.when((after < r) & (r.bitwiseAND(F.lit(1)) == 1), r - 1)
        ends = F.filter(F.array(low, high), lambda x: x.isNotNull())
        made = F.transform(ends, lambda x: F.struct(level.cast("int").alias("level"), x.cast("long").alias("node")))
        return F.struct(
            F.shiftright(after, 1).alias("l"), F.shiftright(F.coalesce(high, r), 1).alias("r"),
            F.concat(state["nodes"], made).alias("nodes"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step)["nodes"]


def above(at: Column, levels: int) -> Column:
    """All nodes that hold a cell, one per level."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels)),
        lambda k: F.struct(k.cast("int").alias("level"), F.floor(at / F.pow(F.lit(2.0), k)).cast("long").alias("node")),
    )


def stab(
    points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, tile: int = TILE,
) -> DataFrame:
    """All pairs of a point and an interval with ``lo <= at <= hi`` (timestamps), each once.

    An interval becomes its canonical nodes, a point the nodes above it. The
    nodes of an interval lie side by side, so a pair meets at one node alone. A
    node with very many points is cut into tiles, to each of which its intervals
    are sent. Rows with a null end or point have no pair. Column names of the two
    sides must differ.
    """
    start, end = cell(F.unix_seconds(lo)), cell(F.unix_seconds(hi))
    intervals = intervals.where(F.col(lo) <= F.col(hi))
    longest = intervals.agg(F.max(end - start)).first()[0]
    levels = (longest or 0).bit_length() + 1
    nodes = intervals.withColumn("_node", F.explode(cover(start, end, levels)))
    rows = points.where(F.col(at).isNotNull()).withColumn("_node", F.explode(above(cell(F.unix_seconds(at)), levels)))
    # only nodes that an interval has; then the points of each
    rows = rows.join(nodes.select("_node").distinct(), "_node", "left_semi")
    crowded = rows.groupBy("_node").agg(F.count("*").alias("_n")).where(F.col("_n") > tile).select(
        "_node", F.ceil(F.col("_n") / tile).cast("int").alias("_tiles")
    )
    spread = F.coalesce("_tiles", F.lit(1))
    hashed = F.xxhash64(*[name for name, kind in points.dtypes if "map<" not in kind])
    dealt = rows.join(crowded, "_node", "left").withColumn(
        "_tile", F.pmod(hashed, spread).cast("int")
    ).drop("_tiles")
    sent = nodes.join(crowded, "_node", "left").withColumn("_tile", F.explode(F.sequence(F.lit(0), spread - 1))).drop("_tiles")
    found = dealt.join(sent, ["_node", "_tile"]).where(F.col(at).between(F.col(lo), F.col(hi)))
    return found.drop("_node", "_tile")

"""Sketches that merge: distinct counts, frequent items and frequency estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, bits: int = 14) -> DataFrame:
    """A HyperLogLog sketch of each key: kept per window, merged over any span."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates from merged sketches, without the rows they came from."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def standard_error(bits: int = 14) -> float:
    return 1.04 / (2**bits) ** 0.5


def frequent(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values and their estimated counts, by one mergeable aggregate."""
    return rows.selectExpr(f"approx_top_k({value}, {k}) AS top").select(F.inline("top")).select(F.col("item").alias(value), F.col("count").alias("estimate"))


def count_min(rows: DataFrame, keys: list[str], value: str, depth: int = 4, width: int = 1024) -> DataFrame:
    """Cells (keys, d, bucket, n) of a count-min sketch as a table: adding is a group-by, and merging a sum."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.struct(d.alias("d"), F.pmod(F.xxhash64(d, F.col(value)), F.lit(width)).cast("int").alias("bucket")))
    return rows.select(*keys, F.inline(cells)).groupBy(*keys, "d", "bucket").agg(F.count("*").alias("n"))


def estimated(cells: DataFrame, items: DataFrame, keys: list[str], value: str, depth: int = 4, width: int = 1024) -> DataFrame:
    """An upper estimate of each item's count from the sketch: the least of its cells."""
    asked = items.select(*keys, value, F.inline(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.struct(d.alias("d"), F.pmod(F.xxhash64(d, F.col(value)), F.lit(width)).cast("int").alias("bucket")))))
    return asked.join(cells, [*keys, "d", "bucket"]).groupBy(*keys, value).agg(F.min("n").alias("estimate"))


def rotated(cells: DataFrame, window: str, step: int = 1) -> DataFrame:
    """Cells of each window with those of the window before it: what a pair of sketches that take turns holds.

    A cell counts for its own window and the next, so merging is one sum; windows that have no cells of their own are none.
    """
    keys = [c for c in cells.columns if c not in (window, "n")]
    both = cells.withColumn(window, F.explode(F.array(F.col(window), F.col(window) + step)))
    return both.groupBy(window, *keys).agg(F.sum("n").alias("n")).join(cells.select(window).distinct(), window, "left_semi")


def rotated_distinct(sketches: DataFrame, window: str, step: int = 1) -> DataFrame:
    """window, distinct: estimates from the sketches of each window and the one before it."""
    both = sketches.select(F.explode(F.array(F.col(window), F.col(window) + step)).alias(window), "sketch")
    return merged_distinct(both, [window]).join(sketches.select(window).distinct(), window, "left_semi")


def heavy_hitters(cells: DataFrame, items: DataFrame, keys: list[str], value: str, share: float, depth: int = 4, width: int = 1024) -> DataFrame:
    """keys, item, estimate, total of items whose estimate is at least ``share`` of the sketch's total: no heavy one is missed."""
    totals = cells.filter("d = 0").groupBy(*keys).agg(F.sum("n").alias("total"))
    return estimated(cells, items, keys, value, depth, width).join(totals, keys).filter(F.col("estimate") >= share * F.col("total"))


def excess(width: int) -> float:
    """The share of a sketch's total that an estimate exceeds with a chance of at most e^-depth."""
    return 2.718281828459045 / width

"""Staged admission: ordered stages, each of which sees only the packets that every stage before it let through.

Stages without memory are one expression.  A stage with memory (a rate, a count of connections, flows) first has the
packets that are left written as a table, and works on those alone, so a packet that was dropped early uses up
nothing later.  No key's packets are ordered in one task: a limit needs only the first few of a key, which each task
cuts for itself, and what comes after the last of them is over it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.sources.lineage import written


@dataclass(frozen=True)
class Check:
    """Drops packets that meet a condition."""

    reason: str
    when: Column


@dataclass(frozen=True)
class Bypass:
    """Lets packets that meet a condition through all later stages."""

    when: Column


@dataclass(frozen=True)
class Limit:
    """Drops the packets of a key that come after its first ``most``, of those that the stage applies to."""

    reason: str | Column
    when: Column
    keys: tuple[str, ...]
    most: int


@dataclass(frozen=True)
class Known:
    """Drops packets whose key no opening packet came before; opening packets are let through."""

    reason: str
    when: Column
    opens: Column
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Repeats:
    """Drops packets that come after the ``most``-th repeat of a key: a packet with the values of the one before it."""

    reason: str
    when: Column
    keys: tuple[str, ...]
    same: tuple[str, ...]
    most: int


Stage = Check | Bypass | Limit | Known | Repeats


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _drop(rows: DataFrame, hit: Column, reason: str | Column) -> DataFrame:
    said = F.lit(reason) if isinstance(reason, str) else reason
    return rows.withColumn("_reason", F.when(hit & F.col("_alive"), said).otherwise(F.col("_reason"))).withColumn("_alive", F.col("_alive") & ~hit)


def _beside(rows: DataFrame, marks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``marks`` (a row per key, with _mark) joined to rows; a null key has marks like any other."""
    names = [f"_key_{k}" for k in keys]
    side = marks.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_mark")
    return rows.join(side, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]), "left").drop(*names)


def _stateful(rows: DataFrame, stage: Limit | Known | Repeats, place: Column) -> DataFrame:
    here = rows.withColumn("_place", place)
    left = here.filter(F.col("_alive") & _true(stage.when))
    if isinstance(stage, Known):
        marks = here.filter(F.col("_alive") & _true(stage.opens)).groupBy(*stage.keys).agg(F.min("_place").alias("_mark"))
        over = _true(stage.when) & ~_true(stage.opens) & _true(F.col("_mark").isNull() | (F.col("_place") < F.col("_mark")))
    else:
        if isinstance(stage, Repeats):
            before = Window.partitionBy(*stage.keys).orderBy("_place")
            left = left.withColumn("_same", reduce(lambda a, b: a & b, [F.lag(c).over(before) == F.col(c) for c in stage.same])).filter("_same")
        nth = F.row_number().over(Window.partitionBy(*stage.keys).orderBy("_place"))
        # Spark cuts each task's rows of a key before they are shuffled
        marks = left.select(*stage.keys, "_place").withColumn("_n", nth).filter(F.col("_n") <= stage.most).filter(F.col("_n") == stage.most).select(*stage.keys, F.col("_place").alias("_mark"))
        over = _true(stage.when) & _true(F.col("_place") > F.col("_mark"))
    return _drop(_beside(here, marks, stage.keys), over, stage.reason).drop("_place", "_mark")


def admitted(packets: DataFrame, stages: list[Stage], order: tuple[str, ...], keep: list[str]) -> DataFrame:
    """``keep`` and drop_reason (null: let through) of every packet: the first stage that drops it wins.

    ``order`` (time, then something unique) says which of a key's packets come first.  A condition that is null does not
    hold.  Each stage with memory is a table, written while the plan is built.
    """
    place = F.struct(*order)
    rows = packets.withColumns({"_alive": F.lit(True), "_reason": F.lit(None).cast("string")})
    for stage in stages:
        if isinstance(stage, Check):
            rows = _drop(rows, _true(stage.when), stage.reason)
        elif isinstance(stage, Bypass):
            rows = rows.withColumn("_alive", F.col("_alive") & ~_true(stage.when))
        else:
            rows = _stateful(written(rows), stage, place)
    return rows.select(*keep, F.col("_reason").alias("drop_reason"))


#: Reasons by kind; what is not named is volume.
KINDS = {"source": ("blacklist", "geo", "reputation"), "content": ("not_protected", "proto_blocked", "port_filter", "signature", "policy", "spoofed", "tcp_abuse", "validation")}


def category(reason: Column) -> Column:
    out = F.when(reason.isNull(), "passed")
    for kind, names in KINDS.items():
        out = out.when(reason.isin(*names), kind)
    return out.otherwise("volume")

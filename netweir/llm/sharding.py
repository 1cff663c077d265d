"""Sharding by sampled splitters (DataFrame functions only).

Records get a range key.  A size-weighted sample of keys gives quantile splitters, many to a shard; every
splitter is also a range of its own, so a key that fills several quantiles stands alone.  Exact sizes of
the ranges then decide which shard takes which range, and overfull ranges are subdivided.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_key, uniform


def sampled_splitters(df: DataFrame, key: str, size: str, ident: str, total: int, ranges: int, per_range: int = 16) -> list[int]:
    """Size-weighted quantiles of ``key``: at most ``ranges - 1`` distinct values in order.

    A record is drawn with probability ``min(1, size * ranges * per_range / total)``, decided by its own
    values; at most about ``2 * ranges * per_range`` records are ever drawn, at any input size.
    """
    if not total:
        return []
    rate = ranges * per_range / total
    drawn = df.filter(uniform(ident, key, seed=10) < F.col(size) * F.lit(rate)).select(key, F.greatest(F.lit(1.0), F.col(size) * rate).alias("_w"))
    rows = sorted((r[0], r[1]) for r in drawn.collect())
    step, seen, out = sum(w for _, w in rows) / ranges, 0.0, []
    for k, w in rows:
        before, seen = seen, seen + w
        if step and int(before / step) != int(seen / step) and int(seen / step) < ranges:
            out.append(k)
    return sorted(set(out))


def range_id(key: Column, splitters: list[int]) -> Column:
    """2i for keys between splitter i-1 and i, 2i+1 for a key equal to splitter i; two short array scans."""
    if not splitters:
        return F.lit(0)
    width = max(1, math.isqrt(len(splitters)))
    text = lambda xs: "array(" + ", ".join(f"{x}L" if x > -(2**63) else "(-9223372036854775807L - 1L)" for x in xs) + ")"
    heads = F.expr(text(splitters[::width]))
    block = F.size(F.filter(heads, lambda s: s < key))
    start = F.greatest(block - 1, F.lit(0)) * width
    below = start + F.size(F.filter(F.slice(F.expr(text(splitters)), start + 1, width), lambda s: s < key))
    return (below * 2 + F.when(F.get(F.expr(text(splitters)), below) == key, 1).otherwise(0)).cast("int")


def cut_ranges(stats: list[tuple[int, int]], shards: int, pieces: int) -> dict[int, int]:
    """How many units each range is cut into, from exact bytes.

    Ranges above two mean pieces are subdivided by key; one that is a single key stays whole up to a
    shard's share and is cut by record beyond it.
    """
    share = sum(b for _, b in stats) / shards
    return {r: 1 if b <= (share if r % 2 else 2 * share / pieces) else math.ceil(b / (share / pieces)) for r, b in stats}


def place_units(units: list[tuple[tuple, int]], shards: int) -> dict[tuple, int]:
    """The shard of every unit ((range, piece), bytes).

    Heavy units, and single keys that are more than a hundredth of a shard, go to the least loaded shard, largest first;
    the others fill the shards in key order.
    """
    share = sum(b for _, b in units) / shards
    heavy = {u for u, b in units if b > share / (128 if u[0] % 2 else 16)}
    load, out = [0] * shards, {}
    for u, b in sorted((u for u in units if u[0] in heavy), key=lambda u: (-u[1], u[0])):
        out[u] = min(range(shards), key=lambda i: (load[i], i))
        load[out[u]] += b
    # filled against running quotas, so that what one shard lacks does not pile up in the last
    room, filled, s = max(0.0, share - load[0]), 0.0, 0
    for u, b in sorted(u for u in units if u[0] not in heavy):
        while s < shards - 1 and filled + b / 2 > room:
            s += 1
            room += max(0.0, share - load[s])
        filled += b
        out[u] = s
    return out


def shard_by_bytes(df: DataFrame, shards: int = 16, pieces: int = 64, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``df`` with size, law, shard and slot: equal bytes per shard, copies of a text together.

    size is the text's UTF-8 bytes plus 1 (null text: 1).  Records are range-partitioned by a hash of the
    text, so equal texts are neighbours; they stay in one shard unless one text alone outweighs a shard.
    slot numbers a shard's records from 0 without gaps, in range order; a range with many rows is numbered by
    several tasks, dealt by a hash of the record.  Null ids sort first; an empty table gives an empty result; columns of ``df`` named
    size, law, shard or slot are replaced, and those of any other name kept, as a row travels as one value.  The driver
    sees one total, a bounded sample and at most ``2 * shards * pieces`` range sums.
    """
    ours = ("size", "law", "shard", "slot")
    row = F.struct(*[c for c in df.columns if c not in ours]).alias("_doc")
    base = df.select(row, F.col(ident).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), text_key(text).alias("_key"))
    return shard_keyed(base, shards, pieces, "_id").select("_doc.*", *ours)


def shard_keyed(base: DataFrame, shards: int, pieces: int, ident: str) -> DataFrame:
    """As ``shard_by_bytes`` for records that carry ``size`` and the range key ``_key``."""
    total = base.agg(F.sum("size")).first()[0] or 0
    splitters = sampled_splitters(base, "_key", "size", ident, total, shards * pieces)
    ranged = base.withColumn("_range", range_id(F.col("_key"), splitters))
    sums = [tuple(r) for r in ranged.groupBy("_range").agg(F.sum("size"), F.count("*")).collect()]
    cuts = cut_ranges([(r, b) for r, b, _ in sums], shards, pieces)
    # rows are numbered in tasks of about this many, whatever one key has
    rows = max(1, sum(n for _, _, n in sums) // (shards * pieces))
    spark = base.sparkSession
    # both small tables have at most a few thousand rows, by the number of splitters
    cut = spark.createDataFrame([(r, cuts[r], -(-n // (rows * cuts[r]))) for r, _, n in sums], "_range int, _n int, _tasks int")
    by = lambda seed, own, n: F.pmod(F.when(own, F.xxhash64(F.lit(seed), ident, "_key")).otherwise(F.xxhash64(F.lit(seed), "_key")), F.col(n)).cast("int")
    unit = ["_range", "_piece", "_task"]
    dealt = ranged.join(F.broadcast(cut), "_range").withColumns({"_piece": by(7, F.col("_range") % 2 == 1, "_n"), "_task": by(9, F.lit(True), "_tasks")}).drop("_n", "_tasks")
    counts = {tuple(r[:3]): (r[3], r[4]) for r in dealt.groupBy(*unit).agg(F.sum("size"), F.count("*")).collect()}
    whole: dict[tuple, int] = {}
    for (r, p, _), (b, _) in counts.items():
        whole[r, p] = whole.get((r, p), 0) + b
    placed, used, at = place_units(list(whole.items()), shards), [0] * shards, []
    for key in sorted(counts):
        s = placed[key[:2]]
        at.append((*key, s, used[s]))
        used[s] += counts[key][1]
    offsets = spark.createDataFrame(at, "_range int, _piece int, _task int, shard int, _at long")
    w = Window.partitionBy(*unit).orderBy("_key", ident)
    numbered = dealt.withColumn("_row", F.row_number().over(w)).join(F.broadcast(offsets), unit)
    return numbered.withColumns({"law": F.lit("bytes"), "slot": F.col("_at") + F.col("_row") - 1}).drop("_range", "_piece", "_task", "_row", "_at")


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of ``shard_by_bytes``: no text travels, only its size, checksum and key."""
    text = F.coalesce("text", F.lit(""))
    light = durable(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key().alias("_key")))
    out = shard_keyed(light, shards, 64, "doc_id")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Mixing sources to target weights (DataFrame functions only).

Each source's documents are laid end to end and packed into blocks of a fixed number of words.  Output
shards draw how many blocks they take from every source; the slots drawn are mapped through a
pseudorandom permutation of the source's block numbers, and blocks are joined by number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, uniform

BLOCK = 64
#: Output shards, a power of two.
SHARDS = 64
#: Rows of a source that one task lays out.
ROWS = 8192
#: Draws of more slots are taken from the normal limit.
EXACT = 1 << 20
#: Runs of slots that one row stands for before it is expanded.
RUN = 8192
WEIGHTS = (5, 2, 1)
#: No source, block or document is taken more often than this.
REPEAT = 3


def permuted(i: Column, n: Column, *salt: Column | str) -> Column:
    """The place of ``i`` in a pseudorandom permutation of 0..n-1 that ``salt`` selects.

    The largest square m*m <= n is stirred by four unbalanced rounds on (i div m, i mod m), each of which
    adds a hash of one half to the other and so can be undone; before, between and after, everything is rotated,
    so that the last few numbers take part.
    """
    # lambdas name what is used more than once; spelled out, the expression would double with every round
    m = F.greatest(F.floor(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    named = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def stir(x: Column, turn: Column) -> Column:
        shifted = F.pmod(x + F.pmod(F.xxhash64(turn, *salt), n), n)

        def halves(y: Column) -> Column:
            hi = F.pmod(F.floor(y / m).cast("long") + F.pmod(F.xxhash64(turn + 50, y % m, *salt), m), m)
            return named(hi, lambda h: h * m + F.pmod(y % m + F.pmod(F.xxhash64(turn + 90, h, *salt), m), m))

        return named(shifted, lambda y: F.when(y < m * m, halves(y)).otherwise(y))

    return F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), i.cast("long"), stir)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of one row per source: sources in code point order, null last, weigh
    5, 2, 1, repeating, and share all words; a target stops at three times its source's size and the
    excess is shared again by weight until none is above.

    Sources stop in the order of cap over weight, so the common level is found by one running sum.  The table
    has a row per source, which one task orders.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_rank", F.row_number().over(w) - 1)
    s = s.withColumns({"_w": F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int")), "_cap": F.col("source_size") * float(REPEAT)})
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    up = Window.orderBy("_ratio", "_rank")
    every = Window.partitionBy()
    s = s.withColumns({"_below": F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_left": F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)), "_total": F.sum("source_size").over(every).cast("double")})
    # the level if this source and all after it are below their caps; the first that holds is the common one
    s = s.withColumn("_level", (F.col("_total") - F.col("_below")) / F.col("_left"))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(every)["_level"])
    return s.withColumn("target", F.least(F.col("_cap"), F.col("_level") * F.col("_w"))).select("source", "source_size", F.coalesce("target", "_cap").alias("target"))


def laid_out(docs: DataFrame) -> DataFrame:
    """Rows with ``start``, the words of the source before the document, in a pseudorandom order.

    A source is cut by a hash into as many buckets as its rows need, bucket totals are summed along the source, and
    rows within a bucket, so that no source is ordered by one task.
    """
    # a row per source: Spark's own size check decides how it is joined
    wide = docs.groupBy("source").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_buckets"))
    b = docs.alias("d").join(wide.alias("w"), F.col("d.source").eqNullSafe(F.col("w.source"))).select("d.*", "_buckets")
    b = b.withColumns({"_h": F.xxhash64("doc_id", "_key"), "_b": F.pmod(F.xxhash64(F.lit(3), "doc_id", "_key"), F.col("_buckets")).cast("int")}).drop("_buckets")
    sums = b.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("_b")) - F.col("_sum")).drop("_sum")
    inner = Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    run = b.withColumn("_run", F.sum("size").over(inner) - F.col("size"))
    joined = run.alias("r").join(before.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r._b") == F.col("t._b")))
    return joined.select("r.*", (F.col("_before") + F.col("_run")).alias("start")).drop("_h", "_b", "_run")


def halved(n: Column, *salt: Column | str) -> Column:
    """A binomial draw of ``n`` fair coins that ``salt`` decides: the bits of hashes are the coins; beyond ``EXACT``, the normal limit."""
    full = F.floor(n / 64).cast("int")
    coin = lambda i: F.xxhash64(i, *salt)
    whole = F.aggregate(F.filter(F.sequence(F.lit(0), full), lambda i: i < full), F.lit(0).cast("long"), lambda acc, i: acc + F.bit_count(coin(i)))
    rest = F.bit_count(F.when(n % 64 > 0, F.call_function("shiftrightunsigned", coin(F.lit(-1)), (F.lit(64) - n % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    bell = F.sqrt(-2 * F.log(1 - uniform(*salt, seed=1))) * F.cos(2 * math.pi * uniform(*salt, seed=2))
    wide = F.greatest(F.lit(0), F.least(n, F.round(n / 2 + bell * F.sqrt(n) / 2))).cast("long")
    return F.when(n <= EXACT, whole + rest).otherwise(wide)


def shard_counts(due: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``due`` (source, _n, _due) as (source, _n, shard, _count): multinomial counts of each source over the shards.

    Each source's due slots are split in two by a binomial draw, and again down to single shards: given the sums of
    the sources, shards draw their counts at the target weights, and sources meet their targets to a slot.
    """
    if shards & shards - 1:
        raise ValueError("shards must be a power of two")
    out = due.select("source", "_n", F.lit(0).alias("shard"), F.col("_due").alias("_count"))
    for level in range(shards.bit_length() - 1):
        low = out.withColumn("_low", halved(F.col("_count"), F.lit(level), "shard", "source"))
        side = lambda bit, n: F.struct((F.col("shard") * 2 + bit).alias("shard"), n.alias("_count"))
        out = low.select("source", "_n", F.inline(F.array(side(0, F.col("_low")), side(1, F.col("_count") - F.col("_low"))))).filter("_count > 0")
    return out


def drawn_slots(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """source, shard, slot, block: the whole plan, a row for each block that an output shard takes.

    A source of n blocks is due ``round(n * target / size)`` slots.  The shards' multinomial counts of a source are
    numbered along it; slot i takes block ``permutation(i mod n)``, so a block comes again only after all others have.
    """
    # few rows are expanded to many: a fixed number of partitions keeps Spark from merging them before that
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.ceil(F.col("source_size") / block).cast("long")
    due = targets.filter("source_size > 0").withColumn("_n", n).withColumn("_due", F.least(F.col("_n") * REPEAT, F.floor(F.col("_n") * F.col("target") / F.col("source_size") + 0.5).cast("long"))).filter("_due > 0")
    counts = durable(shard_counts(due, shards))
    numbered = counts.withColumn("_from", F.sum("_count").over(Window.partitionBy("source").orderBy("shard")) - F.col("_count"))
    parts = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / RUN))).alias("_run")).repartition(tasks, "source", "shard", "_run")
    slots = parts.select("source", "shard", "_n", F.explode(F.sequence(F.col("_from") + F.col("_run") * RUN, F.col("_from") + F.least(F.col("_count"), (F.col("_run") + 1) * RUN) - 1)).alias("slot"))
    # the rank of a source's block by hash would need its blocks ordered in one task; arithmetic does not
    return slots.select("source", "shard", "slot", permuted(F.col("slot") % F.col("_n"), F.col("_n"), F.col("source")).alias("block"))


def _planned(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents with sizes, targets of sources, documents laid out, and how often each block of a source is drawn."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = durable(docs.select("doc_id", "source", F.xxhash64("text").alias("_key"), words.alias("size")))
    targets = durable(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))))
    drawn = drawn_slots(targets, block).groupBy("source", "block").agg(F.count("*").alias("_draws"))
    return base, targets, laid_out(base.filter("size > 0")), drawn


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, _key, size, source_size, target, taken for every document.

    A null text has size 0; a source null in the table is a source of its own.  taken counts the words of a
    document in all blocks drawn, repeats included, so it never exceeds three times the size; size 0 takes 0.
    Equal rows are laid out one after the other and counted each.  An empty table gives an empty result.
    """
    base, targets, placed, drawn = _planned(docs, block)
    overlaps = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))).withColumn("_words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block))
    # sizes estimated before slots are expanded say nothing of the rows after: both sides are shuffled by block
    hit = overlaps.alias("o").join(drawn.hint("merge").alias("d"), F.col("o.source").eqNullSafe(F.col("d.source")) & (F.col("o.block") == F.col("d.block")), "left")
    taken = hit.groupBy("o.source", "o.start", "o.doc_id", "o._key", "o.size").agg(F.coalesce(F.sum(F.col("_words") * F.col("_draws")), F.lit(0)).cast("long").alias("taken")).drop("start")
    full = taken.unionByName(base.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    # a row per source: small in practice, and joined by Spark's own size check
    return full.alias("f").join(targets.alias("t"), F.col("f.source").eqNullSafe(F.col("t.source"))).select("f.doc_id", "f._key", "f.size", "t.source_size", "t.target", "f.taken")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` as the mix takes them: whole, once for each time that the block a document begins in is drawn.

    Rows without words begin in no block and are not taken.  Equal rows share their draws.  Columns of any name are kept.
    """
    _, _, placed, drawn = _planned(docs.select("doc_id", "source", "text"), block)
    begins = placed.withColumn("block", F.floor(F.col("start") / block))
    hit = begins.alias("o").join(drawn.hint("merge").alias("d"), F.col("o.source").eqNullSafe(F.col("d.source")) & (F.col("o.block") == F.col("d.block")), "left")
    plan = hit.groupBy("o.doc_id", "o._key").agg((F.coalesce(F.sum("_draws"), F.lit(0)) / F.count("*")).alias("_times")).filter("_times > 0").select(F.struct("doc_id", "_key", "_times").alias("_plan"))
    row = F.struct(*docs.columns).alias("_doc")
    both = docs.select(row, F.xxhash64("text").alias("_at")).join(plan.hint("shuffle_hash"), F.col("_doc.doc_id").eqNullSafe(F.col("_plan.doc_id")) & (F.col("_at") == F.col("_plan._key")))
    copies = F.floor(F.col("_plan._times") + uniform("_plan.doc_id", "_plan._key", seed=4)).cast("int")
    return both.withColumn("_copies", copies).filter("_copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")

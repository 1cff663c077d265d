"""Rules as data: policies and signatures of masks, prefixes and ranges, matched by tuple-space search.

A rule is filed under its most telling fields, at most KEYED of those it sets; rules filed under the same fields, with
the same prefix lengths, widths and masks, have one shape.  A packet has one key for each shape, and all of them meet
the rules by one equi-join; the whole of a rule is checked on the few rules that share a key.  The first rule by
priority wins over all shapes.  Rules are tried in bands by priority, each some eight times as large as all before it;
only packets that no rule of a band matched go on to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.sources.lineage import written

#: A rule's fields, most telling first.  Columns that a table lacks match anything, as null does.
PREFIXES = {"src": 32, "dst": 32}
RANGES = ("dst_port", "src_port", "length", "ttl")
BUCKETED = RANGES[:3]
ORDER = ("src", "dst", *BUCKETED[:2], "flags", "length", "proto")
KEYED = 2
#: Ranges are keys by the finest buckets, of 2^level values, of which they span at most SPAN.
LEVELS, SPAN = (4, 8, 12), 4
TCP = 6
#: About how many rules the first band has, by how much bands grow, and the most parts that rules are cut into by priority.
BAND, GROWTH, PARTS = 1024, 8, 1024
#: Rows of a band that every task may hold; larger bands are joined like any table.
HELD = 100_000
#: Shapes, for each of which a packet has a key.
MOST_SHAPES = 512


def live(rules: DataFrame, now: Column) -> DataFrame:
    """Rules that are enabled and do not expire, or not yet."""
    ok = F.lit(True)
    if "enabled" in rules.columns:
        ok = F.coalesce("enabled", F.lit(True))
    if "expires_at" in rules.columns:
        ok = ok & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return rules.filter(ok)


def _bits(rules: DataFrame, field: str) -> Column:
    """The prefix length of a rule's address: all bits where none is given."""
    bits = PREFIXES[field]
    return F.coalesce(F.col(f"{field}_len"), F.lit(bits)) if f"{field}_len" in rules.columns else F.lit(bits)


def _filed(rules: DataFrame) -> dict[str, tuple[Column, Column]]:
    """For each field that can be a key: whether a rule sets it, and the (shape, key) pairs that stand for its condition.

    A shape is 1 for an equality, the number of bits of a prefix, the level of a range's buckets, or a mask of flags.
    """
    have = set(rules.columns)
    pair = lambda shape, key: F.struct(shape.cast("long").alias("shape"), key.cast("long").alias("key"))
    out: dict[str, tuple[Column, Column]] = {}
    for f, bits in PREFIXES.items():
        if f in have:
            n = _bits(rules, f)
            out[f] = F.col(f).isNotNull() & (n > 0), F.array(pair(n, F.floor(F.col(f) / F.pow(F.lit(2), bits - n))))
    for f in BUCKETED:
        if f"{f}_lo" in have:
            lo, hi = (F.col(f"{f}_{end}").cast("long") for end in ("lo", "hi"))
            spans = lambda n: F.shiftright(hi, n) - F.shiftright(lo, n)
            level = F.coalesce(*[F.when((hi >= lo) & (spans(n) < SPAN), F.lit(n)) for n in LEVELS])
            first, last = (F.call_function("shiftright", c, level) for c in (lo, hi))
            out[f] = level.isNotNull(), F.transform(F.sequence(first, last), lambda b: pair(level, b))  # noqa: B023
    if {"flags_mask", "proto"} <= have:
        # to packets that are not TCP such a rule means the same without flags, so only rules for TCP are filed by them
        out["flags"] = F.coalesce((F.col("flags_mask") != 0) & (F.col("proto") == TCP), F.lit(False)), F.array(pair(F.col("flags_mask"), F.col("flags_value").bitwiseAND(F.col("flags_mask"))))
    if "proto" in have:
        out["proto"] = F.col("proto").isNotNull(), F.array(pair(F.lit(1), F.col("proto")))
    return {f: out[f] for f in ORDER if f in out}


def _key(fields: list[str], shape: tuple[int, ...]) -> str:
    """SQL of what a packet has where rules of this shape have their key: there are many shapes, so all are one expression."""
    if not fields:
        return "0L"
    parts = []
    for f, n in zip(fields, shape, strict=True):
        if f == "flags" and n:
            parts.append(f"CASE WHEN proto = {TCP} THEN CAST(flags AS BIGINT) & {n}L END")
        elif n:
            parts.append(f"shiftright(CAST({f} AS BIGINT), {n if f in BUCKETED else PREFIXES[f] - n if f in PREFIXES else 0})")
    return f"xxhash64({', '.join([f'xxhash64({", ".join(f"{n}L" for n in shape)})', *parts])})"


def _holds(rule: Column, names: set[str]) -> Column:
    """Whether all of a rule holds for a packet; a field the packet lacks holds for no rule that sets it."""
    tests = []
    for f in RANGES:
        if f"{f}_lo" in names:
            tests += [rule[f"{f}_lo"].isNull() | (F.col(f) >= rule[f"{f}_lo"]), rule[f"{f}_hi"].isNull() | (F.col(f) <= rule[f"{f}_hi"])]
    if "flags_mask" in names:
        tests.append(rule["flags_mask"].isNull() | (F.col("proto") != TCP) | (F.col("flags").bitwiseAND(rule["flags_mask"].cast("int")) == rule["flags_value"].bitwiseAND(rule["flags_mask"])))
    if "proto" in names:
        tests.append(rule["proto"].isNull() | (F.col("proto") == rule["proto"]))
    # dearest last: a prefix is mostly part of the key already
    for f, bits in PREFIXES.items():
        if f in names:
            cut = lambda c: F.call_function("shiftright", c.cast("long"), (bits - rule[f"{f}_len"]).cast("int"))  # noqa: B023, E731
            tests.append(rule[f].isNull() | (cut(F.col(f)) == cut(rule[f])))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def _ranked(rules: DataFrame) -> DataFrame:
    """``rules`` with _rank, their order by (priority, rule_id), and _band, which grows with it; written once."""
    parts = min(max(-(-rules.count() // BAND), 1), PARTS)
    dealt = rules.repartitionByRange(parts, "priority", "rule_id").withColumn("_part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("priority", "rule_id", "action"))
    band = F.when(F.col("_part") > 0, F.floor(F.log(float(GROWTH), "_part")) + 1).otherwise(0).cast("int")
    return written(written(dealt).withColumns({"_rank": F.col("_part") * F.lit(1 << 32) + nth, "_band": band}).drop("_part"))


def first_match(packets: DataFrame, rules: DataFrame, default: str = "ALLOW") -> DataFrame:
    """``packets`` with rule_id and action of the first rule by (priority, rule_id) that matches, or null and ``default``.

    ``rules`` has rule_id, priority, action and any of: proto; src, dst with src_len, dst_len (prefixes of addresses);
    <field>_lo and <field>_hi of dst_port, src_port, length and ttl; flags_mask and flags_value (for TCP alone).
    A field that is null matches anything.  While the plan is built, packets and rules by key are written as tables and
    bands are tried in turn, until all packets are matched or no band is left.
    """
    spark = packets.sparkSession
    ranked = _ranked(rules.withColumns({"priority": F.col("priority").cast("long"), "rule_id": F.col("rule_id").cast("long"), **{f"{f}_len": _bits(rules, f) for f in PREFIXES if f in rules.columns}}))
    filed = _filed(ranked)
    fields = list(filed)
    set_before = [reduce(lambda a, b: a + b, [filed[g][0].cast("int") for g in fields[:i]], F.lit(0)) for i in range(len(fields))]
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("shape"), F.lit(0).cast("long").alias("key")))
    rest = [c for c in [*PREFIXES, *[f"{f}_len" for f in PREFIXES], *[f"{f}_{end}" for f in RANGES for end in ("lo", "hi")], "flags_mask", "flags_value", "proto"] if c in ranked.columns]
    rule = F.struct(F.lit(True).alias("is_rule"), *[F.col(c).cast("long").alias(c) for c in rest])
    # of rules that ask for the same, the first is the only one that can win
    table = ranked.select("_rank", "_band", rule.alias("_rule"), *[F.when(filed[f][0] & (before < KEYED), filed[f][1]).otherwise(nothing).alias(f"_{f}") for f, before in zip(fields, set_before, strict=True)])
    table = table.groupBy("_rule", *[f"_{f}" for f in fields]).agg(F.min("_rank").alias("_rank"), F.min("_band").alias("_band"))
    for f in fields:
        table = table.withColumn(f"_{f}", F.explode(f"_{f}"))
    # a key is a hash of its parts; who shares one by chance is found out when the whole rule is checked
    parts = F.filter(F.array(*[F.col(f"_{f}") for f in fields]), lambda x: x["shape"] != 0) if fields else None
    whole = F.xxhash64(F.xxhash64(*[F.col(f"_{f}.shape") for f in fields]), *[F.get(parts, F.lit(i))["key"] for i in range(KEYED)]) if fields else F.lit(0).cast("long")
    keyed = written(table.select("_rank", "_band", "_rule", whole.alias("_key"), *[F.col(f"_{f}.shape").alias(f"_{f}_shape") for f in fields]))
    shapes: dict[int, set[tuple]] = {}
    rows: dict[int, int] = {}
    for *shape, band, n in keyed.groupBy(*[f"_{f}_shape" for f in fields], "_band").count().limit(MOST_SHAPES * 32).collect():
        shapes.setdefault(band, set()).add(tuple(shape))
        rows[band] = rows.get(band, 0) + n
    if len(set().union(*shapes.values())) > MOST_SHAPES:
        raise ValueError(f"rules have more than {MOST_SHAPES} shapes")

    # inputs of few files are few tasks
    all_ = written(packets.repartition(4 * spark.sparkContext.defaultParallelism).withColumn("_at", F.monotonically_increasing_id()))
    asked = [c for c in (*PREFIXES, *RANGES, "flags", "proto") if c in packets.columns]
    left = all_.select("_at", *asked)
    found = []
    for band in sorted(rows):
        if found:
            left = written(left.join(found[-1].hint("merge"), "_at", "left_anti"))
            if left.isEmpty():
                break
        side = keyed.filter(F.col("_band") == band).select("_key", "_rule", "_rank")
        keys = left.withColumn("_key", F.expr(f"explode(array({', '.join(_key(fields, s) for s in sorted(shapes[band]))}))"))
        # keys are many for each packet, which Spark does not count when it looks for a side to broadcast
        met = keys.join(F.broadcast(side) if rows[band] <= HELD else side.hint("merge"), "_key").filter(_holds(F.col("_rule"), set(rest)))
        found.append(written(met.groupBy("_at").agg(F.min("_rank").alias("_rank"))))
    own = [F.col(c) for c in packets.columns]
    if not found:
        return all_.select(*own, F.lit(None).cast("long").alias("rule_id"), F.lit(default).alias("action"))
    best = reduce(DataFrame.unionByName, found)
    # few of many rules win, and some win most packets
    winners = written(best.select("_rank").distinct().join(ranked.select("_rank", "rule_id", "action").hint("merge"), "_rank"))
    won = best.join(F.broadcast(winners) if winners.count() <= HELD else winners.hint("merge"), "_rank")
    out = all_.drop("rule_id", "action").join(won.hint("merge"), "_at", "left")
    return out.select(*own, "rule_id", F.coalesce("action", F.lit(default)).alias("action"))

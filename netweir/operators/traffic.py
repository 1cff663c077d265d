"""Traffic, attack and service statistics: the aggregations behind reports and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.traffic import cases
from netweir.sources.lineage import written

from .recursions import streamed


def deltas(counters: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``delta`` of a cumulative counter per key: 0 for the first row, after a reset and from a zero."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return counters.withColumn("delta", F.when((prev > 0) & (F.col(value) >= prev), F.col(value) - prev).otherwise(0))


def summary(rollups: DataFrame, seconds: int = 60) -> DataFrame:
    """One row over roll-ups: peaks, means, totals, drops and availability."""
    n = F.count("*")
    return rollups.agg(
        F.max("rx_pps").alias("peak_pps"),
        F.round(F.avg("rx_pps"), 6).alias("avg_pps"),
        F.max("rx_bps").alias("peak_bps"),
        F.sum(F.col("rx_pps") * seconds).alias("total_packets"),
        F.sum("dropped_pps").alias("total_dropped"),
        n.alias("samples"),
        F.count_if("anomaly_active").alias("anomaly_samples"),
        F.round(F.when(n > 0, 100.0 * (n - F.count_if("anomaly_active")) / n).otherwise(100.0), 6).alias("availability"),
    )


def history(rollups: DataFrame, bucket: str = "6 hours") -> DataFrame:
    """Epoch-aligned buckets: whole means of rates, sums of drops, any and worst of anomalies, last host count."""
    return rollups.groupBy(F.window("ts", bucket)["start"].alias("bucket")).agg(
        F.floor(F.avg("rx_pps")).alias("rx_pps"),
        F.floor(F.avg("rx_bps")).alias("rx_bps"),
        F.sum("dropped_pps").alias("dropped"),
        F.bool_or("anomaly_active").alias("anomaly_active"),
        F.max("anomaly_level").alias("anomaly_level"),
        F.max_by("protected_ip_count", "ts").alias("protected_ip_count"),
    )


def anchored_history(rollups: DataFrame, seconds: int) -> DataFrame:
    """Buckets that begin at a row rather than at the clock: each starts at the first row past the one before.

    One series is one ordered pass with a number for its state, over a row per roll-up.
    """
    rows = rollups.select(F.lit(0).alias("series"), F.unix_timestamp("ts").alias("s"), "rx_pps", "dropped_pps", F.unix_timestamp("ts").alias("_s"))

    def step(start: int, x: int, d: int, s: int) -> tuple:
        start = s if start < 0 or s >= start + seconds else start
        return start, (start,)

    marked = streamed(rows, ["series"], ["s"], lambda: -1, step, ["rx_pps", "dropped_pps"], "start long")
    return marked.groupBy("start").agg(F.floor(F.sum("rx_pps") / F.count("*")).alias("rx_pps"), F.sum("dropped_pps").alias("dropped"), F.count("*").alias("rows")).select(F.timestamp_seconds("start").alias("bucket"), "rx_pps", "dropped", "rows")


def attack_stats(attacks: DataFrame) -> DataFrame:
    """Counts in all, by type and by severity in one pass of grouping sets."""
    g = attacks.groupingSets([[], ["attack_type"], ["severity"]], "attack_type", "severity")
    return g.agg(
        F.count("*").alias("n"),
        F.count_if("is_active").alias("active"),
        F.count_if("is_mitigated").alias("mitigated"),
        F.round(F.avg(F.when(F.col("mitigation_ms") != 0, F.col("mitigation_ms"))), 6).alias("mean_mitigation_ms"),
    )


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """key, value, n for each of several keys at once."""
    g = rows.groupingSets([[k] for k in keys], *keys)
    name = cases(*[(F.grouping(k) == 0, k) for k in keys])
    return g.agg(name.alias("key"), F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k).cast("string")) for k in keys]).alias("value"), F.count("*").alias("n")).select("key", "value", "n")


def protocol_breakdown(features: DataFrame) -> DataFrame:
    """Packets by protocol, their share, and bytes at a typical size each."""
    # fixed values: protocol, typical bytes of a packet
    sizes = (("tcp", 500), ("udp", 300), ("icmp", 64), ("other", 200))
    sums = features.agg(*[F.sum(F.floor(F.col("packets") * F.col(f"{p}_ratio") + 1e-9)).alias(p) for p, _ in sizes])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(p).alias("protocol"), F.col(p).alias("packets"), (F.col(p) * b).alias("bytes"), sum((F.col(q) for q, _ in sizes), F.lit(0)).alias("_all")) for p, b in sizes])))
    return rows.select("protocol", "packets", "bytes", F.round(F.when(F.col("_all") > 0, F.col("packets") * 100.0 / F.col("_all")).otherwise(0.0), 1).alias("percent"))


def drop_reasons(rollups: DataFrame, reasons: list[str]) -> DataFrame:
    """reason, dropped, percent, largest first."""
    sums = rollups.agg(*[F.sum(c).alias(c) for c in reasons]).unpivot([], reasons, "reason", "dropped")
    total = F.sum("dropped").over(Window.partitionBy())
    return sums.withColumn("percent", F.round(F.when(total > 0, F.col("dropped") * 100.0 / total).otherwise(0.0), 2))


def compared(rows: DataFrame, when: Column, values: list[str]) -> DataFrame:
    """metric, now, before, change in percent (0 if there was nothing before) between the two sides of ``when``."""
    both = rows.agg(*[F.coalesce(F.sum(F.when(side, F.col(v))), F.lit(0)).cast("double").alias(f"{v}_{n}") for v in values for n, side in (("now", when), ("before", ~when))])
    out = both.select(F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"{v}_now").alias("now"), F.col(f"{v}_before").alias("before")) for v in values])))
    return out.withColumn("change", F.round(F.when(F.col("before") != 0, (F.col("now") - F.col("before")) / F.col("before") * 100).otherwise(0.0), 2))


def sla(rollups: DataFrame, least: float = 99.9) -> DataFrame:
    """Availability, mean drop share and whether the agreement is kept, per day."""
    n = F.count("*")
    up = 100.0 * F.count_if(F.col("anomaly_level") < 4) / n
    return rollups.groupBy(F.to_date("ts").alias("day")).agg(
        F.round(up, 4).alias("availability"),
        F.round(F.sum("dropped_pps") * 100.0 / F.greatest(F.sum("rx_pps"), F.lit(1)), 4).alias("drop_percent"),
        (up >= least).alias("met"),
        F.max("rx_pps").alias("peak_pps"),
        F.max_by(F.date_format("ts", "HH"), F.struct("rx_pps", F.negative(F.unix_timestamp("ts")))).alias("peak_hour"),
    )


def top(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows; Spark keeps n per partition before it merges."""
    return rows.orderBy(*order).limit(n)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def top_per(rows: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def shared(rows: DataFrame, item: str, tenant: str, least: int) -> DataFrame:
    """Items that at least ``least`` tenants have, with their tenants and rows."""
    return rows.groupBy(item).agg(F.count_distinct(tenant).alias("tenants"), F.count("*").alias("n")).filter(F.col("tenants") >= least)


def correlated(rows: DataFrame, tenant: str, bucket: Column) -> DataFrame:
    """Pearson correlation of two tenants' counts over buckets that either of them has.

    Sums over tenants' pairs, not rows: counts are made first.  Buckets that only one of a pair has count as 0
    for the other, which the closed form takes in through each tenant's own sums.
    """
    c = rows.groupBy(F.col(tenant).alias("t"), bucket.alias("b")).agg(F.count("*").alias("x"))
    n = c.select("b").distinct().count()
    own = c.groupBy("t").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    met = c.alias("a").join(c.alias("b"), (F.col("a.b") == F.col("b.b")) & (F.col("a.t") < F.col("b.t"))).groupBy(F.col("a.t").alias("t1"), F.col("b.t").alias("t2")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("p"))
    j = met.join(own.select(F.col("t").alias("t1"), F.col("s").alias("s1"), F.col("q").alias("q1")), "t1").join(own.select(F.col("t").alias("t2"), F.col("s").alias("s2"), F.col("q").alias("q2")), "t2")
    cov = F.col("p") * n - F.col("s1") * F.col("s2")
    var = lambda i: F.col(f"q{i}") * n - F.col(f"s{i}") * F.col(f"s{i}")
    return j.select("t1", "t2", (F.round(F.when((var(1) > 0) & (var(2) > 0), cov / F.sqrt(var(1).cast("double") * var(2))).otherwise(0.0), 6) + 0.0).alias("correlation"))


def histogram_percentile(rows: DataFrame, value: Column, bounds: list[float], share: float) -> DataFrame:
    """The upper bound of the bucket in which ``share`` of the rows is reached; values over all bounds share the last."""
    n = len(bounds)
    bucket = F.least(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value)), F.lit(n - 1))
    counts = rows.groupBy(bucket.alias("_b")).count()
    w = Window.orderBy("_b")  # a row per bucket
    run = counts.withColumns({"_run": F.sum("count").over(w), "_all": F.sum("count").over(Window.partitionBy())})
    return run.filter(F.col("_run") >= F.col("_all") * share).agg(F.element_at(F.array(*map(F.lit, bounds)), F.min("_b") + 1).alias("percentile"))


#: Ranges of values that a key's distinct values are cut into for exact quantiles.
PARTS = 64


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and, by name, the exact quantiles (interpolated) of ``value`` at ``shares``; for few keys of any number of rows.

    Distinct values are counted, then cut into ranges of about equal numbers of them.  Only the ranges that hold a wanted
    rank are ordered, each by itself, so no task and no buffer holds a key's values.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counts = written(counted)
    edges = counts.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), F.lit(10 * PARTS)).alias("_edges"))
    # a row for each key
    binned = counts.join(F.broadcast(written(edges)), keys).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    w = Window.partitionBy(*keys)
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_own")).withColumns({"_upto": F.sum("_own").over(w.orderBy("_bin")), "_all": F.sum("_own").over(w)})
    at = {name: (F.col("_all") - 1) * F.lit(float(share)) for name, share in shares.items()}
    ranks = [r(p) for p in at.values() for r in (F.floor, F.ceil)]
    held = F.lit(False)
    for r in ranks:
        held = held | ((F.col("_upto") > r) & (F.col("_upto") - F.col("_own") <= r))
    wanted = bins.filter(held).select(*keys, "_bin", (F.col("_upto") - F.col("_own")).alias("_before"), "_all")
    run = binned.join(F.broadcast(wanted), [*keys, "_bin"]).withColumn("_end", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v")))
    least = lambda r: F.min(F.when(F.col("_end") > r, F.col("_v")))
    found = run.groupBy(*keys, "_all").agg(*[least(r(p)).alias(f"_{side}{name}") for name, p in at.items() for side, r in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda name, p: F.when(F.col(f"_lo{name}") == F.col(f"_hi{name}"), F.col(f"_lo{name}")).otherwise((F.ceil(p) - p) * F.col(f"_lo{name}") + (p - F.floor(p)) * F.col(f"_hi{name}"))
    return found.select(*keys, *[between(name, p).alias(name) for name, p in at.items()])

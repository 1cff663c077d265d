"""The default detection path: features routed to methods and weighted, combined per window; and fast windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recursions import WARM, cusum_decayed, ewma_baseline, streamed

# fixed values: feature, method, weight, threshold, whether falls count too
ROUTES = (
    ("packets", "cusum", 1.0, 0.0, False),
    ("bytes", "cusum", 1.0, 0.0, False),
    ("syn", "zscore", 1.0, 0.0, False),
    ("ack", "zscore", 0.3, 0.0, False),
    ("tcp_share", "divergence", 0.5, 0.0, False),
    ("udp_share", "divergence", 0.5, 0.0, False),
    ("icmp_share", "divergence", 0.5, 0.0, False),
    ("other_share", "divergence", 0.5, 0.0, False),
    ("bytes_per_packet", "zscore", 0.8, 0.0, True),
    ("sources", "log", 1.0, 0.0, True),
    ("ports", "log", 0.8, 0.0, True),
    ("max_flow_percent", "threshold", 0.8, 15.0, False),
    ("fragment_ratio", "zscore", 1.0, 0.0, False),
    ("ttl_mean", "zscore", 0.6, 0.0, True),
)
LEAST_WEIGHT = 0.1


def routed(windows: DataFrame, keys: list[str], order: str, alpha: float = 0.15) -> DataFrame:
    """keys, order, feature, method, weight, z, alarm, term: every feature of every window scored by its method.

    Features that ``ROUTES`` names and ``windows`` lacks are left out.  Counts of distinct things are learned and scored as
    ln(1 + x); a threshold's excess is in tens above the decision's 3; shares have no z but a divergence term; sums of
    deviations run for volumes only.
    """
    routes = [r for r in ROUTES if r[0] in windows.columns]
    table = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(m).alias("method"), F.lit(w).alias("weight"), F.lit(t).alias("least"), F.lit(b).alias("both"), F.col(f).cast("double").alias("raw")) for f, m, w, t, b in routes])
    long = windows.select(*keys, order, F.inline(table)).withColumn("x", F.when(F.col("method") == "log", F.log1p("raw")).otherwise(F.col("raw")))
    by = [*keys, "feature"]
    base = ewma_baseline(long.select(*by, order, "x"), by, order, "x", alpha).drop("x")
    b = long.join(base, [*by, order])
    sd = F.sqrt("var")
    z = F.when(F.col("method") == "threshold", F.when(F.col("raw") > F.col("least"), (F.col("raw") - F.col("least")) / 10 + 3.0).otherwise(0.0))
    z = z.when(F.col("method") == "divergence", 0.0).when(F.col("method") == "log", F.when((F.col("n") >= WARM) & (sd >= 1e-10), (F.col("x") - F.col("mean")) / sd).otherwise(0.0)).otherwise(F.col("z"))
    b = b.withColumn("z", z).withColumn("z", F.when(F.col("both"), F.abs("z")).otherwise(F.col("z")))
    sums = cusum_decayed(b.filter("method = 'cusum'"), by, order, F.col("z"), 0.5, 5.0).select(*by, order, (F.col("alarm") > 0).alias("alarm"))
    p, q = F.greatest(F.col("mean"), F.lit(1e-10)), F.greatest(F.col("x"), F.lit(1e-10))
    term = (p * F.log(2 * p / (p + q)) + q * F.log(2 * q / (p + q))) / 2 / F.log(F.lit(2.0))
    out = b.join(sums, [*by, order], "left")
    return out.select(*by, order, "method", "weight", "z", F.coalesce("alarm", F.lit(False)).alias("alarm"), F.when(F.col("method") == "divergence", term).otherwise(0.0).alias("term"), "n")


def combined(scores: DataFrame, keys: list[str], order: str, threshold: float = 3.0, divergence: float = 0.15) -> DataFrame:
    """One row per window of ``routed``: score, triggered (features, each counted once, and the mix), by_z, by_cusum,
    by_mix and primary, the feature of the largest weighted z or ``protocol_mix`` if that adds more."""
    w = F.abs("z") * F.greatest(F.col("weight"), F.lit(LEAST_WEIGHT))
    g = scores.withColumn("_w", F.when(F.col("n") >= WARM, w).otherwise(0.0)).withColumn("_a", F.col("alarm") & (F.col("n") >= WARM))
    g = g.groupBy(*keys, order).agg(
        F.max("_w").alias("_top"),
        F.max_by("feature", F.struct(F.round("_w", 6), "feature")).alias("_name"),
        F.count_if(F.col("_w") >= threshold).alias("by_z"),
        F.count_if("_a").alias("by_cusum"),
        F.count_if(F.col("_a") & (F.col("_w") < threshold)).alias("_more"),
        F.sum(F.when(F.col("n") >= WARM, F.col("term")).otherwise(0.0)).alias("_mix"),
    )
    mix = F.when(F.col("_mix") >= divergence, F.col("_mix") * threshold * 3).otherwise(0.0)
    return g.select(
        *keys,
        order,
        (F.col("_top") + mix + F.col("by_cusum") * threshold * 0.5).alias("score"),
        (F.col("by_z") + F.col("_more") + (F.col("_mix") >= divergence).cast("int")).alias("triggered"),
        "by_z",
        "by_cusum",
        (F.col("_mix") >= divergence).alias("by_mix"),
        F.when(mix > F.col("_top"), "protocol_mix").when(F.col("_top") > 0, F.col("_name")).alias("primary"),
    )


def quiet_skipped(decisions: DataFrame, packets: Column, least: float) -> DataFrame:
    """Windows of under ``least`` packets decide nothing, though baselines have learned from them."""
    low = packets < least
    return decisions.withColumns({"score": F.when(low, 0.0).otherwise(F.col("score")), "triggered": F.when(low, 0).otherwise(F.col("triggered")), "skipped": low})


def fast_spikes(samples: DataFrame, keys: list[str], order: str, least_rate: float = 10000.0, least_syn: float = 5000.0, times: float = 1.5, scale: int = 10, confirm: int = 2, warm: int = 30, percentile: int = 95, factor: float = 3.0) -> DataFrame:
    """keys, order, rate, average, rate_spike, syn_spike, flow_spike, streak and confirmed of short windows.

    ``samples`` has packets, syn and new_flows of every window, idle ones included; ``scale`` windows make a second.  In
    the first ``warm`` windows only rates over twice the least ones are spikes, and never confirm.  After them, a rate over
    ``factor`` times the warm-up's percentile (at least the least rate; for SYNs half of it) is one, and so is one over
    ``times`` its moving average (SYNs 1.5 and flows 2 times that), which the window itself has already moved.
    """
    rate = lambda c: (F.col(c) * scale).cast("double")
    s = samples.select(*keys, order, rate("packets").alias("rate"), rate("syn").alias("syn"), rate("new_flows").alias("flow"))
    ordered = Window.partitionBy(*keys).orderBy(order)
    first = s.withColumn("_i", F.row_number().over(ordered)).filter(F.col("_i") <= warm)
    at = lambda c: F.get(F.sort_array(F.collect_list(c)), F.lit(min(warm * percentile // 100, warm - 1)))
    cuts = first.groupBy(*keys).agg(F.greatest(F.floor(at("rate") * factor), F.lit(least_rate)).cast("double").alias("_rate_cut"), F.greatest(F.floor(at("syn") * factor), F.lit(least_syn / 2)).cast("double").alias("_syn_cut"))

    def step(state: tuple, x: float, syn: float, flow: float, rate_cut: float | None, syn_cut: float | None, *_) -> tuple:
        i, a, b, c, streak = state
        a, b, c = (x, syn, flow) if not i else (0.3 * x + 0.7 * a, 0.3 * syn + 0.7 * b, 0.3 * flow + 0.7 * c)
        i += 1
        if i < warm:
            hits = (x > 2 * least_rate, syn > 2 * least_syn, False)
            return (i, a, b, c, 0), (a, *hits, 0, False)
        hits = ((a > 100 and x > a * times) or x > rate_cut, syn > syn_cut or (b > 10 and syn > b * times * 1.5), c > 10 and flow > c * times * 2)
        streak = streak + 1 if any(hits) else 0
        return (i, a, b, c, streak), (a, *hits, streak, streak >= confirm)

    rows = s.join(cuts, keys, "left").select(*keys, order, "rate", "syn", "flow", "_rate_cut", "_syn_cut")
    return streamed(rows, keys, [order], lambda: (0, 0.0, 0.0, 0.0, 0), step, [*keys, order, "rate"], "average double, rate_spike boolean, syn_spike boolean, flow_spike boolean, streak long, confirmed boolean")


def attack_levels(windows: DataFrame, keys: list[str], order: str, least_peak: float = 1000.0, persist: int = 1, cool: int = 30, steps: int = 30) -> DataFrame:
    """keys, order, active, level, cooling and peak of each closed window (value, detected, level), a window its unit of time.

    An attack opens after ``persist`` detections in a row and stays while windows are detected or traffic is half its peak.
    Traffic under 30 % of a peak over ``least_peak`` in the third low window, or a window that is neither, begins ``cool`` windows
    of cooling (three times as many from the third attack within 300 windows), in which nothing reopens it.  A higher level
    counts at once; a lower one takes one level off after ``steps`` windows, half as many without detection, a quarter of
    ``cool`` (two at least) while cooling.
    """
    fade = max(cool // 4, 2)

    def lowered(level: int, cycles: int, after: int) -> tuple[int, int]:
        return (level - 1, 0) if cycles + 1 >= after and level > 1 else (level, cycles + 1)

    def step(state: tuple, value: float, detected: bool, worst: int, t: int) -> tuple:
        active, level, left, cycles, low, peak, streak, recent, since = state
        if since is None or t - since > 300:
            recent, since = 0, t
        cooling, high, dropped = active and left > 0, False, False
        if active and not cooling:
            if value > peak:
                peak, low = value, 0
            if peak > least_peak:
                high = value >= 0.5 * peak
                low = 0 if high else low + 1
                dropped = value < 0.3 * peak and low >= 3
                left = cool if dropped else left
        streak = streak + 1 if detected else 0
        holds = (detected or high) and not cooling and not dropped
        if holds and not active and streak >= persist:
            active, level, left, cycles, low, peak, recent = True, worst, 0, 0, 0, value, recent + 1
        elif holds and active:
            left = 0
            if detected and worst > level:
                level, cycles = worst, 0
            elif detected and worst == level:
                cycles += 1
            else:
                level, cycles = lowered(level, cycles, steps if detected else steps // 2)
        elif active and left <= 0:
            left = cool * 3 if recent >= 3 else cool
            level, cycles = (level - 1, 0) if level > 1 else (level, cycles)
        elif active:
            left -= 1
            level, cycles = lowered(level, cycles, fade)
            if left <= 0:
                active, level = False, 0
        return (active, level, left, cycles, low, peak, streak, recent, since), (active, level, left, peak)

    rows = windows.select(*keys, order, F.col("value").cast("double").alias("value"), "detected", F.col("level").alias("_worst"), F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("_t"))
    return streamed(rows, keys, [order], lambda: (False, 0, 0, 0, 0, 0.0, 0, 0, None), step, [*keys, order], "active boolean, level long, cooling long, peak double")

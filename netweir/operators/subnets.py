"""Evaluation of protected subnets: two levels of baselines, a threshold for each subnet, victims and bystanders apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.traffic import wilson

VOLUMES = ("packets", "bytes", "sources")
#: The quantile and bounds of thresholds, and the threshold that all subnets share in the second pass.
QUANTILE, LOW, HIGH, FIXED = 0.97, 4.0, 20.0, 4.0
#: Shares of benign windows that fit and calibrate.
FIT, CALIBRATE = 0.6, 0.8


def subnet_series(packets: DataFrame, subnet: str, host: str, window: str, source: str = "src", size: str = "length") -> tuple[DataFrame, DataFrame]:
    """Windows of subnets, whose sources are the union over all hosts, and windows of hosts (packets alone)."""
    wide = packets.groupBy(subnet, window).agg(F.count("*").alias("packets"), F.sum(size).alias("bytes"), F.count_distinct(source).alias("sources"))
    return wide, packets.groupBy(subnet, host, window).agg(F.count("*").alias("packets"))


def parted(windows: DataFrame, subnet: str, window: str, attack: str) -> DataFrame:
    """part: a subnet's benign windows in order are fit, calib and test; attack windows are test."""
    benign = Window.partitionBy(subnet, attack)
    i, n = F.row_number().over(benign.orderBy(window)), F.count("*").over(benign)
    part = F.when(F.col(attack), "test").when(i <= F.floor(n * FIT + 1e-9), "fit").when(i <= F.floor(n * CALIBRATE + 1e-9), "calib").otherwise("test")
    return windows.withColumn("part", part)


def _deviation(rows: DataFrame, keys: list[str], values: tuple[str, ...]) -> DataFrame:
    """z_<value> (of whole numbers) against the mean and deviation of the key's fit rows, the deviation at least 1; null without any.

    Sums are whole numbers too, so a score that is just at a threshold does not depend on the order of rows.
    """
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    fit = lambda x: F.sum(F.when(F.col("part") == "fit", x))
    stats = rows.groupBy(*keys).agg(F.count_if(F.col("part") == "fit").alias("_n"), *[x for c in values for x in (fit(whole(c)).alias(f"_x_{c}"), fit(whole(c) * whole(c)).alias(f"_xx_{c}"))])
    n = F.col("_n").cast("decimal(10,0)")
    # n times the deviation; decimals are added up in full
    spread = lambda c: F.sqrt((n * F.col(f"_xx_{c}") - F.col(f"_x_{c}") * F.col(f"_x_{c}")).cast("double"))
    z = lambda c: (n * whole(c) - F.col(f"_x_{c}")).cast("double") / F.greatest(spread(c), n.cast("double"))
    return rows.join(stats, keys).select(*rows.columns, *[F.when(F.col("_n") > 0, z(c)).alias(f"z_{c}") for c in values])


def scores(wide: DataFrame, hosts: DataFrame, subnet: str, host: str, window: str) -> DataFrame:
    """``wide`` (with part) and the score of each window: the most that the subnet's volumes, or one host's packets, deviate.

    A host has a baseline of its own over its subnet's fit windows; hosts unseen there have none.
    """
    own = hosts.join(wide.select(subnet, window, "part"), [subnet, window])
    worst = _deviation(own, [subnet, host], ("packets",)).groupBy(subnet, window).agg(F.max("z_packets").alias("_host"))
    z = _deviation(wide, [subnet], VOLUMES).join(worst, [subnet, window], "left")
    return z.withColumn("score", F.greatest(*[F.abs(f"z_{c}") for c in VOLUMES], F.col("_host"))).drop("_host", *[f"z_{c}" for c in VOLUMES])


def judged(scored: DataFrame, subnet: str, attack: str, least_attacks: int, least_benign: int) -> DataFrame:
    """For each subnet its role, threshold, counts of test windows and hits, with its own and with the fixed threshold.

    A subnet with at least ``least_attacks`` attack windows is a victim, one without any and with ``least_benign`` test windows
    uninvolved; others are ``other``.  The threshold is the quantile of calibration scores, up to the next half, within bounds.
    """
    cut = scored.groupBy(subnet).agg(F.percentile(F.when(F.col("part") == "calib", F.col("score")), F.lit(QUANTILE)).alias("_q"))
    theta = F.least(F.greatest(F.ceil(F.coalesce("_q", F.lit(LOW)) * 2) / 2, F.lit(LOW)), F.lit(HIGH))
    test = scored.filter(F.col("part") == "test").join(cut.select(subnet, theta.alias("theta")), subnet)
    a, hit, fixed = F.col(attack), F.col("score") >= F.col("theta"), F.col("score") >= FIXED
    out = test.groupBy(subnet, "theta").agg(F.count_if(a).alias("attacks"), F.count_if(~a).alias("benign"), F.count_if(a & hit).alias("tp"), F.count_if(~a & hit).alias("fp"), F.count_if(a & fixed).alias("tp_fixed"), F.count_if(~a & fixed).alias("fp_fixed"))
    role = F.when(F.col("attacks") >= least_attacks, "victim").when((F.col("attacks") == 0) & (F.col("benign") >= least_benign), "uninvolved").otherwise("other")
    return out.withColumn("role", role)


def summary(subnets: DataFrame) -> DataFrame:
    """Over all victims the detection rate, over all uninvolved subnets the false rate, in percent with 95 % intervals."""
    rate = lambda role, hits, of: F.struct(F.lit(role).alias("role"), F.count_if(F.col("role") == role).alias("subnets"), F.coalesce(F.sum(F.when(F.col("role") == role, F.col(hits))), F.lit(0)).alias("k"), F.coalesce(F.sum(F.when(F.col("role") == role, F.col(of))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("role") == role, F.col(f"{hits}_fixed"))), F.lit(0)).alias("k_fixed"))
    both = subnets.agg(F.array(rate("victim", "tp", "attacks"), rate("uninvolved", "fp", "benign")).alias("r")).select(F.inline("r"))
    low, high = wilson(F.col("k"), F.col("n"))
    percent = lambda c: F.when(F.col("n") > 0, 100.0 * c)
    return both.select("role", "subnets", "k", "n", percent(F.col("k") / F.col("n")).alias("rate"), percent(low).alias("low"), percent(high).alias("high"), percent(F.col("k_fixed") / F.col("n")).alias("rate_fixed"))


def targeted(label: Column, subnet: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(label.isNotNull() & subnet.between(lo, hi), F.lit(False))

"""Statistics that judge detectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.traffic import erfc, wilson

from .recursions import islands, running


def auc(rows: DataFrame, keys: list[str], score: str, attack: str) -> DataFrame:
    """Area under the ROC curve by average ranks, from counts per distinct score: rows of one score are one."""
    c = rows.groupBy(*keys, score).agg(F.count("*").alias("n"), F.count_if(attack).alias("pos"))
    ranked = running(c, keys, score, ["n"]).withColumn("rank", F.col("upto_n") - F.col("n") + (F.col("n") + 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return out.select(*keys, F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auc"))


def at_false_positive_rate(rows: DataFrame, keys: list[str], index: str, score: str, attack: str, rate: float, gap: int = 30) -> DataFrame:
    """threshold at the benign quantile, detection rate above it in percent, and benign episodes per 1000 windows."""
    cut = rows.groupBy(*keys).agg(F.percentile(F.when(~F.col(attack), F.col(score)), F.lit(1 - rate)).alias("threshold"), F.count_if(~F.col(attack)).alias("benign"), F.count_if(attack).alias("attacks"))
    over = rows.join(cut, keys).withColumn("over", F.col(score) > F.col("threshold"))
    hits = over.groupBy(*keys).agg(F.count_if(F.col("over") & F.col(attack)).alias("hits"))
    flagged = islands(over.filter(F.col("over") & ~F.col(attack)), keys, index, gap).groupBy(*keys).agg(F.max("episode").alias("episodes"))
    out = cut.join(hits, keys).join(flagged, keys, "left")
    return out.select(*keys, "threshold", (100.0 * F.col("hits") / F.greatest("attacks", F.lit(1))).alias("detection"), (1000.0 * F.coalesce("episodes", F.lit(0)) / F.greatest("benign", F.lit(1))).alias("episodes_per_1000"))


def held_out_rates(rows: DataFrame, part: str, score: str, attack: str, rate: float) -> DataFrame:
    """Threshold from calibration rows, with the false positive and detection rates it has on test rows."""
    cut = rows.filter(F.col(part) == "calib").agg(F.percentile(score, F.lit(1 - rate)).alias("threshold")).first()[0]
    t = rows.filter(F.col(part) == "test")
    over = F.col(score) > F.lit(cut)
    share = lambda c: F.count_if(over & c) / F.greatest(F.count_if(c), F.lit(1))
    return t.agg(F.lit(cut).alias("threshold"), share(~F.col(attack)).alias("fpr"), share(F.col(attack)).alias("dr"))


def theta(rows: DataFrame, score: str, rate: float = 0.03, low: float = 4.0, high: float = 20.0) -> DataFrame:
    """The quantile of calibration scores, up to the next half, within bounds."""
    return rows.agg(F.least(F.greatest(F.ceil(F.percentile(score, F.lit(1 - rate)) * 2) / 2, F.lit(low)), F.lit(high)).alias("theta"))


def share_interval(rows: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.withColumns({"low": low, "high": high})


def mcnemar(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Both discordant counts and the corrected p-value; 1 without any."""
    g = rows.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    n = F.col("b") + F.col("c")
    x = F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2.0)) / F.greatest(n, F.lit(1))
    return g.withColumn("p", F.when(n == 0, 1.0).otherwise(F.greatest(erfc(F.sqrt(x / 2)), F.lit(5e-324))))


#: Shares of up to k draws, k from 0, of a Poisson distribution of mean 1.
POISSON = [float(x) for x in np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(8)])]


def cluster_bootstrap(clusters: DataFrame, ident: str, hits: str, n: str, draws: int = 500, seed: int = 7) -> DataFrame:
    """Percent rate with its 95 % interval, clusters drawn with replacement.

    Each cluster is drawn a Poisson number of times in each replicate, decided by an MD5 value: the bootstrap without a
    fixed number of draws, which needs no order or gathering of clusters, and which any engine repeats.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string"), F.col("draw").cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda s: s < u))
    reps = clusters.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_t", times)
    rates = reps.groupBy("draw").agg((100.0 * F.sum(F.col("_t") * F.col(hits)) / F.greatest(F.sum(F.col("_t") * F.col(n)), F.lit(1))).alias("rate"))
    point = clusters.agg((100.0 * F.sum(hits) / F.sum(n)).alias("rate")).first()[0]
    return rates.agg(F.lit(point).alias("rate"), F.percentile("rate", F.lit(0.025)).alias("low"), F.percentile("rate", F.lit(0.975)).alias("high"))


def holm(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Bonferroni and Holm adjusted p-values: the running maximum of p times the tests left."""
    w = Window.partitionBy().orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    i = F.row_number().over(w) - 1
    out = tests.withColumns({"bonferroni": F.least(F.col(p) * m, F.lit(1.0)), "_a": F.col(p) * (m - i)})
    return out.withColumn("holm", F.least(F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_a")


def leave_one_out(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """Each cluster's mean, and the mean of all other rows."""
    c = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy()
    return c.select(cluster, (F.col("s") / F.col("n")).alias("mean"), ((F.sum("s").over(every) - F.col("s")) / F.greatest(F.sum("n").over(every) - F.col("n"), F.lit(1))).alias("others"))


def tree_difference(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """path, change of two flattened result trees: added, removed, changed, or same within ``tolerance``."""
    j = a.select("path", F.col("value").alias("x"), F.lit(True).alias("_a")).join(b.select("path", F.col("value").alias("y"), F.lit(True).alias("_b")), "path", "full")
    return j.select("path", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.abs(F.col("x") - F.col("y")) <= tolerance * F.greatest(F.abs("x"), F.abs("y"), F.lit(1.0)), "same").otherwise("changed").alias("change"))

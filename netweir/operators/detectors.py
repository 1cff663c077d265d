"""Detectors, scorers and rules that combine them.

A matrix is long: a row per (idx, feature, x), train marks the rows a detector is fitted to.  Fits are
aggregates by feature, so any number of windows is one pass; only sums over pairs of features, and the
bounded samples that trees are grown on, come to the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.traffic import cases, clamp

from .recursions import ewma, streamed, tail_counts, tail_probability

SEED = 42


def long_form(wide: DataFrame, features: list[str], keep: tuple[str, ...] = ("idx", "train")) -> DataFrame:
    return wide.select(*keep, *features).unpivot(list(keep), features, "feature", "x")


def tail_scale(excess: Column, n: Column, fallback: Column) -> Column:
    """Scale of a generalized Pareto tail from the mean and variance of its excesses; few give the fallback."""
    m, v = F.avg(excess), F.var_pop(excess)
    return F.when(n > 2, F.greatest(0.5 * m * (m * m / (v + 1e-8) + 1), F.lit(0.01))).otherwise(F.greatest(fallback, F.lit(0.1)))


def peaks_over_threshold(matrix: DataFrame, q: float = 0.98) -> DataFrame:
    """idx, score of test rows: the largest excess over a feature's training quantile, in units of its tail."""
    t = matrix.filter("train")
    cut = t.groupBy("feature").agg(F.percentile("x", F.lit(q)).alias("cut"), F.stddev_pop("x").alias("sd"))
    over = t.join(cut, "feature").withColumn("over", F.when(F.col("x") > F.col("cut"), F.col("x") - F.col("cut")))
    fit = over.groupBy("feature").agg(F.first("cut").alias("cut"), tail_scale(F.col("over"), F.count("over"), F.first("sd")).alias("scale"))
    return matrix.filter("NOT train").join(fit, "feature").groupBy("idx").agg(F.greatest(F.lit(0.0), F.max((F.col("x") - F.col("cut")) / F.col("scale"))).alias("score"))


def drifting_peaks(matrix: DataFrame, q: float = 0.98, depth: int = 64) -> DataFrame:
    """idx, score: peaks over threshold of residuals from the mean of the last ``depth`` windows.

    In the test stream only windows without an alarm enter that mean, which no window frame expresses: each feature
    of a victim, if the matrix names one, is one ordered pass that holds ``depth`` values.
    """
    own = ["feature", "victim"] if "victim" in matrix.columns else ["feature"]
    w = Window.partitionBy(*own).orderBy("idx")
    t = matrix.filter("train").withColumn("res", F.col("x") - F.coalesce(F.avg("x").over(w.rowsBetween(-depth, -1)), F.col("x")))
    cut = t.groupBy("feature").agg(F.percentile("res", F.lit(q)).alias("cut"), F.stddev_pop("res").alias("sd"))
    over = t.join(cut, "feature").withColumn("over", F.when(F.col("res") > F.col("cut"), F.col("res") - F.col("cut")))
    fit = over.groupBy("feature").agg(F.first("cut").alias("cut"), tail_scale(F.col("over"), F.count("over"), F.first("sd")).alias("scale"))
    recent = matrix.filter("train").withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("idx")))).filter(F.col("_r") <= depth).drop("_r")

    def step(state: tuple, train: bool, x: float, cut_: float, scale: float) -> tuple:
        held, total = state
        excess = x - (total / len(held) if held else x) - cut_
        score = max(excess, 0.0) / scale
        if train or excess <= 0:  # an exceedance is not learned from
            total += x - (held.popleft() if len(held) >= depth else 0.0)
            held.append(x)
        return (held, total), (score,)

    joined = recent.unionByName(matrix.filter("NOT train")).join(fit, "feature").select(*own, (~F.col("train")).alias("_after"), "idx", "train", "x", "cut", "scale")
    scored = streamed(joined, own, ["_after", "idx"], lambda: (deque(), 0.0), step, ["_after", "idx"], "score double")
    return scored.filter("_after").groupBy("idx").agg(F.max("score").alias("score"))


def tail_scores(matrix: DataFrame, kind: str = "ecod") -> DataFrame:
    """idx, score of test rows: summed negative log tail shares under the training rows' distribution.

    By feature the larger of both tails and the tail on the side of the skew (ecod), or of their mean and that
    (copod).
    """
    sign = matrix.filter("train").groupBy("feature").agg(F.signum(F.skewness("x")).alias("sk"))
    p = tail_probability(matrix, ["feature"], "x", "train").filter("NOT train").join(sign, "feature")
    l, r = -F.log("left"), -F.log("right")
    skewed = cases((F.col("sk") > 0, r), (F.col("sk") < 0, l), otherwise=l + r)
    best = F.greatest(l, r, skewed) if kind == "ecod" else F.greatest(skewed, (l + r) / 2)
    return p.groupBy("idx").agg(F.sum(best).alias("score"))


def histogram_scores(matrix: DataFrame, bins: int = 10, floor: float = 0.1, out: float = 0.5) -> DataFrame:
    """idx, score: summed negative log densities of equal bins of the training rows.

    Up to ``out`` bins beyond the ends count as the end bin, and farther as the emptiest.
    """
    t = matrix.filter("train")
    span = t.groupBy("feature").agg(F.min("x").alias("lo"), ((F.max("x") - F.min("x")) / bins).alias("width"), F.count("*").alias("n")).withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(1.0))
    place = F.least(F.greatest(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = t.join(span, "feature").groupBy("feature", "width", "n", place.alias("bin")).agg(F.count("*").alias("c"))
    dense = counts.withColumn("s", -F.log2(F.col("c") / (F.col("n") * F.col("width")) + floor))
    worst = dense.groupBy("feature").agg(F.when(F.count("*") < bins, -F.log2(F.lit(floor))).otherwise(F.max("s")).alias("worst"))
    rows = matrix.filter("NOT train").join(span, "feature").join(worst, "feature").withColumn("bin", place)
    far = (F.col("x") < F.col("lo") - out * F.col("width")) | (F.col("x") > F.col("lo") + (bins + out) * F.col("width"))
    scored = rows.join(dense.select("feature", "bin", "s"), ["feature", "bin"], "left").withColumn("s", F.when(far, F.col("worst")).otherwise(F.coalesce("s", -F.log2(F.lit(floor)))))
    return scored.groupBy("idx").agg(F.sum("s").alias("score"))


def projections(features: int, cuts: int, seed: int = SEED) -> np.ndarray:
    """Random directions with about the square root of ``features`` entries that are not zero."""
    rng = np.random.default_rng(seed)
    out = np.zeros((cuts, features))
    for row in out:
        at = rng.choice(features, max(1, round(features**0.5)), replace=False)
        row[at] = rng.normal(size=len(at))
    return out


def loda_scores(wide: DataFrame, features: list[str], cuts: int = 20, bins: int = 10) -> DataFrame:
    """idx, score: mean negative log share of the histogram bins of random projections."""
    sums = [reduce(lambda a, b: a + b, [F.col(f) * float(w) for f, w in zip(features, row, strict=True) if w]) for row in projections(len(features), cuts)]
    p = wide.select("idx", "train", F.posexplode(F.array(*sums)).alias("feature", "x")).withColumn("feature", F.col("feature").cast("string"))
    t = p.filter("train")
    span = t.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
    inside = F.when(F.col("x") == F.col("hi"), bins - 1).otherwise(place).cast("int")
    counts = t.join(span, "feature").groupBy("feature", inside.alias("bin")).agg(F.count("*").alias("c"))
    rows = p.filter("NOT train").join(span, "feature").withColumn("bin", inside).join(counts, ["feature", "bin"], "left")
    return rows.groupBy("idx").agg(F.avg(-F.log(F.coalesce("c", F.lit(0)) / F.col("n") + 1e-12)).alias("score"))


def standardized(wide: DataFrame, features: list[str]) -> tuple[DataFrame, int]:
    """Features in training standard deviations from the training mean, by one aggregation, and the training rows."""
    stats = wide.filter("train").agg(F.count("*").alias("n"), *[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]).first()
    z = {f: (F.col(f) - float(stats[f]["m"] or 0)) / float(stats[f]["s"] if stats[f]["s"] and stats[f]["s"] >= 1e-9 else 1.0) for f in features}
    return wide.withColumns(z), stats["n"]


def subspace_scores(wide: DataFrame, features: list[str], k: int = 8, alpha: float = 0.5) -> DataFrame:
    """idx, score: the energy left outside the training rows' first components, as rank surprise, smoothed along each victim.

    The components come from sums of products of features, as many as features squared; with too few training
    rows for them the score is peaks over threshold.
    """
    z, n = standardized(wide, features)
    if n < 2 * len(features):
        return peaks_over_threshold(long_form(wide, features))
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = z.filter("train").agg(*[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(features),) * 2)
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"p{i}_{j}"]
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, : min(k, len(features))].T
    whole = reduce(lambda a, b: a + b, [F.col(f) * F.col(f) for f in features])
    inside = [reduce(lambda a, b: a + b, [F.col(f) * float(w) for f, w in zip(features, axis, strict=True)]) for axis in axes]
    q = z.select("idx", "victim", "train", (whole - reduce(lambda a, b: a + b, [c * c for c in inside])).alias("q"))
    # rows at least as far out, ties counted through a hair's breadth
    eased = q.withColumn("q", F.when(F.col("train"), F.col("q")).otherwise(F.col("q") - 1e-12 * F.greatest(F.lit(1.0), F.col("q"))))
    ranked = eased.join(tail_counts(eased, [], "q", "train"), "q")
    ge = F.col("_n") - F.col("_upto") + F.col("_same")
    surprise = ranked.withColumn("surprise", -F.log((ge + 1.0) / (n + 1.0))).filter("NOT train")
    return ewma(surprise, ["victim"], "idx", F.col("surprise"), alpha, "score").select("idx", "score")


def _scored(wide: DataFrame, features: list[str], score) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.asarray(b.column(i + 1), dtype=np.float64) for i in range(len(features))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(x), pa.float64())], names=["idx", "score"])

    return wide.filter("NOT train").select("idx", *features).mapInArrow(run, "idx long, score double")


def bounded_sample(wide: DataFrame, features: list[str], rows: int) -> np.ndarray:
    """At most ``rows`` training rows, by a hash of idx."""
    drawn = wide.filter("train").orderBy(F.xxhash64("idx"), "idx").limit(rows).select(*features).collect()
    return np.array([tuple(r) for r in drawn], dtype=np.float64).reshape(-1, len(features))


def harmonic(n: float) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grown(x: np.ndarray, trees: int, size: int, rng: np.random.Generator) -> list:
    """Isolation trees on samples of ``x``: a leaf is its depth, a node (column, cut, below, above)."""
    size = min(size, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(rows: np.ndarray, depth: int):
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or not len(spread):
            return depth + harmonic(len(rows))
        f = rng.choice(spread)
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        left = rows[:, f] < cut
        return f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

    return [grow(x[rng.choice(len(x), size, replace=False)], 0) for _ in range(trees)] if size else []


def walked(node, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth of each row's leaf, the sum of its distances from the cuts on the way, and their number."""
    if not isinstance(node, tuple):
        return np.full(len(rows), float(node)), np.zeros(len(rows)), np.zeros(len(rows))
    f, cut, low, high = node
    left = rows[:, f] < cut
    depth, far, cuts = (np.empty(len(rows)) for _ in range(3))
    for side, below in ((left, low), (~left, high)):
        depth[side], far[side], cuts[side] = walked(below, rows[side])
    return depth, far + np.abs(rows[:, f] - cut), cuts + 1


def isolation_forest(wide: DataFrame, features: list[str], trees: int = 100, size: int = 256, pool: int = 20_000, seed: int = SEED) -> DataFrame:
    """idx, score in 0..1: how few random cuts set a row apart; trees grow on samples of a bounded pool."""
    z, _ = standardized(wide, features)
    x = bounded_sample(z, features, pool)
    forest = grown(x, trees, size, np.random.default_rng(seed))
    norm = harmonic(min(size, len(x))) or 1.0
    return _scored(z, features, lambda rows: 2 ** (-np.mean([walked(t, rows)[0] for t in forest], axis=0) / norm) if forest else np.full(len(rows), 0.5))


def deep_isolation_forest(wide: DataFrame, features: list[str], nets: int = 50, trees: int = 6, size: int = 256, hidden: int = 64, width: int = 20, pool: int = 20_000, seed: int = SEED) -> DataFrame:
    """idx, score of 0 and more: isolation in what random networks make of a row.

    Each of ``nets`` untrained networks (tanh, two layers) gives a representation, whose scale is fixed on the pool, so a row's
    score never depends on the rows scored with it.  The score is 2^(-mean depth / expected depth), times the mean distance from
    the cuts on a row's paths.  Without training rows every score is 0.5.
    """
    z, _ = standardized(wide, features)
    x, rng = bounded_sample(z, features, pool), np.random.default_rng(seed)
    parts = []
    for _ in range(nets if len(x) else 0):
        first, second = rng.normal(0, len(features) ** -0.5, (len(features), hidden)), rng.normal(0, hidden**-0.5, (hidden, width))
        made = np.tanh(x @ first) @ second
        mean, sd = made.mean(axis=0), made.std(axis=0)
        sd[sd == 0] = 1.0
        parts.append((first, second, mean, sd, grown((made - mean) / sd, trees, size, rng)))
    norm = harmonic(min(size, len(x))) or 1.0

    def score(rows: np.ndarray) -> np.ndarray:
        if not parts:
            return np.full(len(rows), 0.5)
        depth, far = np.zeros(len(rows)), np.zeros(len(rows))
        for first, second, mean, sd, forest in parts:
            made = (np.tanh(rows @ first) @ second - mean) / sd
            for tree in forest:
                d, f, n = walked(tree, made)
                depth, far = depth + d, far + f / np.maximum(n, 1)
        n = len(parts) * trees
        return 2 ** (-depth / n / norm) * far / n

    return _scored(z, features, score)


def nearest_hyperspheres(wide: DataFrame, features: list[str], sets: int = 100, size: int = 16, pool: int = 20_000, seed: int = SEED) -> DataFrame:
    """idx, score in 0..1: isolation by the sphere of a sampled row against that of its nearest neighbour."""
    z, _ = standardized(wide, features)
    x, rng = bounded_sample(z, features, pool), np.random.default_rng(seed)
    spheres = []
    for _ in range(sets if len(x) > 1 else 0):
        c = x[rng.choice(len(x), min(size, len(x)), replace=False)]
        d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        near = d.argmin(axis=1)
        radius = d[np.arange(len(c)), near]
        spheres.append((c, radius, 1 - radius[near] / np.maximum(radius, 1e-12)))

    def score(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for c, radius, apart in spheres:
            d = np.sqrt(((rows[:, None] - c[None]) ** 2).sum(axis=2))
            inside = np.where(d <= radius, radius, np.inf)
            best = inside.argmin(axis=1)
            out += np.where(np.isfinite(inside.min(axis=1)), apart[best], 1.0)
        return out / max(1, len(spheres))

    return _scored(z, features, score)


def conformal(rows: DataFrame, score: str, calib: str, keys: list[str]) -> DataFrame:
    """p of each row: the share of calibration rows that score at least as high, counting itself."""
    at_least = F.col("_n") - F.col("_upto") + F.col("_same")
    t = rows.join(tail_counts(rows, keys, score, calib), [*keys, score])
    return t.withColumn("p", (1.0 + at_least) / (1.0 + F.col("_n"))).drop("_same", "_upto", "_n")


def acat(ps: list[Column], weight: float = 0.5) -> Column:
    """Cauchy combination of p-values; the mean is halved as the combination of a pair is."""
    p = [clamp(x, 1e-12, 1 - 1e-12) for x in ps]
    t = reduce(lambda a, b: a + b, [weight * F.tan((0.5 - x) * np.pi) for x in p]) / len(p)
    return clamp(0.5 - F.atan(t) / np.pi, 1e-12, 1 - 1e-12)


def step_up(long: DataFrame, keys: list[str], p: str, order: str, alpha: float) -> DataFrame:
    """Per group of p-values: rejected, the smallest level that rejects, and the channel with the smallest p."""
    w = Window.partitionBy(*keys).orderBy(p, order)
    ranked = long.withColumns({"_r": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy(*keys))})
    return ranked.groupBy(*keys).agg(F.min(F.col("_m") * F.col(p) / F.col("_r")).alias("alpha_star"), F.min_by(order, F.struct(F.col(p), F.col(order))).alias("channel")).withColumn("rejected", F.col("alpha_star") <= alpha)


def tier_vote(z: list[Column], theta: float = 4.0) -> dict[str, Column]:
    """Decision of the tiers' z-scores: two over theta, or one over a quarter more; with level and confidence."""
    over = [F.abs(x) >= theta for x in z]
    tiers = reduce(lambda a, b: a + b, [o.cast("int") for o in over])
    top = F.greatest(*[F.abs(x) for x in z])
    found = (tiers >= 2) | ((tiers == 1) & (top >= 1.25 * theta))
    severity = cases((~found, 0), (tiers >= 3, cases((top >= 12, 4), (top >= 9, 3), (top >= 6, 2), otherwise=1)), (tiers == 2, cases((top >= 15, 3), (top >= 10, 2), otherwise=1)), otherwise=cases((top >= 15, 2), otherwise=1))
    base = cases((tiers >= 3, 0.99), (tiers == 2, 0.90), otherwise=0.75)
    sure = F.least(base * F.least(1 + 0.1 * (top - theta) / theta, F.lit(1.5)), F.lit(1.0))
    return {"tiers": tiers, "max_z": top, "detected": found, "level": severity, "confidence": F.when(found, sure).otherwise(0.0)}


def attack_scores(v: dict[str, Column], z: dict[str, Column], compat_amp_bug: bool = False) -> dict[str, Column]:
    """Points for each kind of attack, 0 to 1, from engine-profile features (ratios in percent) and z-scores."""
    up = lambda x, full: F.least(x / full, F.lit(1.0))
    given = lambda *rules: F.least(reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0.0) for c, p in rules]), F.lit(1.0))
    size, per_source = v["bytes_per_packet"], v["packets"] / v["sources"]
    alike = F.least(z["bytes"], z["packets"]) / F.greatest(z["bytes"], z["packets"])
    mostly_udp = (v["udp"] > 60, 0.2 * v["udp"] / 100)
    out = {
        "syn_flood": given((z["syn"] > 3, 0.3 * up(z["syn"], 10)), ((v["syn_ack_ratio"] < 50) & (v["syn"] > 1000), 0.25 * (1 - v["syn_ack_ratio"] / 100)), (z["sources"] > 2, 0.2 * up(z["sources"], 8)), ((size > 0) & (size < 100), 0.15), (v["tcp"] > 80, 0.1)),
        "udp_flood": given(mostly_udp, (z["packets"] > 4, 0.25 * up(z["packets"], 10)), ((size > 0) & (size < 200), 0.2 * (1 - size / 200)), (z["sources"] > 3, 0.2 * up(z["sources"], 8)), (v["max_flow"] < 10, 0.15 * (1 - v["max_flow"] / 10))),
        "amplification": given(mostly_udp, (size > 500, 0.3 * up(size - 500, 1000)), ((z["bytes"] > 1.5 * z["packets"]) & (z["bytes"] > 3), 0.2), ((v["sources"] > 0) & (per_source > 100), 0.15 * up(per_source, 1000)), (v["max_flow"] > 20, 0.15 * v["max_flow"] / 100)),
        "icmp_flood": given((v["icmp"] > 30, 0.5 * v["icmp"] / 100), (z["icmp"] > 3, 0.3 * up(z["icmp"], 10)), (z["packets"] > 3, 0.2 * up(z["packets"], 10))),
        "slowloris": given((v["duration"] > 30000, 0.3 * up(v["duration"], 300000)), ((z["flows"] > z["packets"]) & (z["flows"] > 3), 0.25), ((v["per_flow"] > 0) & (v["per_flow"] < 10), 0.25 * (1 - v["per_flow"] / 10)), (v["tcp"] > 80, 0.1), ((z["flows"] > 2 * z["bytes"]) & (z["flows"] > 3), 0.1)),
        "volumetric": given((z["bytes"] > 4, 0.4 * up(z["bytes"], 12)), (z["packets"] > 4, 0.3 * up(z["packets"], 12)), ((z["bytes"] > 3) & (z["packets"] > 3) & (alike > 0.5), 0.2 * alike), ((v["tcp"] < 70) & (v["udp"] < 70), 0.1)),
        "ack_flood": F.when((z["ack"] > 4) & (v["tcp"] > 80), 0.5 * up(z["ack"], 10) + F.when(z["syn"] < 2, 0.3).otherwise(0.0)).otherwise(0.0),
        "rst_flood": F.when((z["rst"] > 4) & (v["rst_syn_ratio"] > 200), 0.5 * up(z["rst"], 10) + F.when(v["rst_syn_ratio"] > 500, 0.3).otherwise(0.0)).otherwise(0.0),
    }
    return out | {"amplification": out["udp_flood"], "udp_flood": 0.9 * out["udp_flood"]} if compat_amp_bug else out


def classified(scores: dict[str, Column]) -> Column:
    """struct(kind, score, confidence, vectors, top3): kinds by score, ties to the first listed."""
    order = list(scores)
    ranked = F.transform(F.array_sort(F.array(*[F.struct((-s).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(scores.items())])), lambda s: F.struct(s["kind"].alias("kind"), (-s["n"]).alias("score")))

    def verdict(r: Column) -> Column:
        first = F.get(r, F.lit(0))
        known = first["score"] >= 0.3
        more = F.size(F.filter(F.slice(r, 2, len(order) - 1), lambda s: (s["score"] >= 0.3) & (s["score"] >= 0.6 * first["score"])))
        return F.struct(
            F.when(known, first["kind"]).otherwise("unknown").alias("kind"),
            first["score"].alias("score"),
            cases((first["score"] >= 0.6, "high"), (first["score"] >= 0.4, "medium"), otherwise="low").alias("confidence"),
            (1 + more).alias("vectors"),
            F.array_join(F.transform(F.slice(r, 1, 3), lambda s: s["kind"]), ",").alias("top3"),
        )

    return F.get(F.transform(F.array(ranked), verdict), F.lit(0))


def ramps(rows: DataFrame, rate: float, cycles: int, columns: list[str]) -> DataFrame:
    """Each row ``cycles`` times, its volumes grown by ``rate`` a step."""
    factor = F.pow(F.lit(1 + rate), F.col("step"))
    return rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))).withColumns({c: F.col(c) * factor for c in columns})

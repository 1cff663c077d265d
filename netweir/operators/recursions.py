"""Ordered recursions over an entity's windows or packets: moving baselines, cumulative sums, islands, splits.

Where a recursion has a closed form, window functions compute it.  The rest are folds: rows are dealt by entity,
ordered within each task, and stream past a small state, so time is linear and memory does not grow with an entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WARM = 10


def streamed(rows: DataFrame, keys: list[str], order: list[str], begin: Callable[[], object], step: Callable, keep: list[str], outputs: str) -> DataFrame:
    """``keep`` and ``outputs`` (a schema) for every row of ``rows``, in one pass over the rows of each of ``keys`` by ``order``.

    ``begin()`` is the state before a key's first row; ``step(state, *others)`` gets the other columns of a row and
    returns the next state and the outputs.  A state outlives Arrow batches, and only one is held at a time.
    """
    others = [c for c in rows.columns if c not in keys and c not in order]
    names = [*keys, *order, *others]
    ordered = rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = rows.select(*keep).schema
    added = [part.rsplit(" ", 1) for part in outputs.split(", ")]
    for name, kind in added:
        schema = schema.add(name, kind)
    kinds = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            if not len(b):
                continue
            key = list(zip(*(b.column(i).to_pylist() for i in range(width)), strict=True))
            out = []
            for k, x in zip(key, zip(*(b.column(names.index(c)).to_pylist() for c in others), strict=True), strict=True):
                if k != last or state is None:
                    last, state = k, begin()
                state, left = step(state, *x)
                out.append(left)
            new = [pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*out, strict=True), added, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(names.index(c)) for c in keep], *new], names=[*keep, *[n for n, _ in added]])

    return ordered.mapInArrow(run, schema)


def fold(rows: DataFrame, keys: list[str], order: str, value: Column, begin: tuple, step: Callable, outputs: list[str]) -> DataFrame:
    """``keys``, ``order`` and the doubles ``outputs`` that ``step(state, x)`` leaves for every row, rows of one order by value.

    A null value leaves the state as it is and has null outputs.
    """
    width = len(outputs)

    def guarded(state: tuple, x: float | None) -> tuple:
        return (state, (None,) * width) if x is None else step(state, x)

    return streamed(rows.select(*keys, order, value.cast("double").alias("_x"), value.cast("double").alias("_by")), keys, [order, "_by"], lambda: begin, guarded, [*keys, order], ", ".join(f"{n} double" for n in outputs))


def ewma_baseline(rows: DataFrame, keys: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """mean, var and n before each window, and its z-score against them.

    The first value sets the mean; then m += alpha d and v = (1 - alpha)(v + alpha d d).  z is 0 before ``WARM`` values,
    its deviation at least 2 % of a mean over 50 and else 1, and it stops at 100 either way.
    """

    def step(state: tuple, x: float) -> tuple:
        m, v, k = state
        d = x - m
        return ((m + alpha * d, (1 - alpha) * (v + alpha * d * d), k + 1) if k else (x, 0.0, 1)), (m, v, float(k))

    states = fold(rows, keys, order, F.col(value), (0.0, 0.0, 0), step, ["mean", "var", "n"])
    out = rows.select(*keys, order, value).join(states, [*keys, order])
    floor = F.when(F.col("mean") > 50, 0.02 * F.col("mean")).otherwise(1.0)
    z = (F.col(value) - F.col("mean")) / F.greatest(F.sqrt("var"), floor)
    return out.withColumn("z", F.when(F.col("n") < WARM, 0.0).otherwise(F.least(F.greatest(z, F.lit(-100.0)), F.lit(100.0))))


def cusum(rows: DataFrame, keys: list[str], order: str, deviation: Column, slack: Column) -> DataFrame:
    """Both cumulative sums without decay or reset, by window functions: S = C - min(0, smallest C so far)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"_u": deviation - slack, "_d": -deviation - slack})
    out = out.withColumns({"_cu": F.sum("_u").over(w), "_cd": F.sum("_d").over(w)})
    return out.withColumns({"s_high": F.col("_cu") - F.least(F.lit(0.0), F.min("_cu").over(w)), "s_low": F.col("_cd") - F.least(F.lit(0.0), F.min("_cd").over(w))}).drop("_u", "_d", "_cu", "_cd")


def cusum_decayed(rows: DataFrame, keys: list[str], order: str, deviation: Column, k: float, h: float, decay: float = 0.99) -> DataFrame:
    """s_high, s_low and alarm with decay; both sums start again after an alarm."""

    def step(state: tuple, x: float) -> tuple:
        hi, lo = max(0.0, decay * state[0] + x - k), max(0.0, decay * state[1] - x - k)
        hit = max(hi, lo) > h
        return ((0.0, 0.0) if hit else (hi, lo)), (hi, lo, float(hit))

    return fold(rows, keys, order, deviation, (0.0, 0.0), step, ["s_high", "s_low", "alarm"])


def ewma(rows: DataFrame, keys: list[str], order: str, value: Column, alpha: float = 0.5, name: str = "ewma") -> DataFrame:
    """alpha x + (1 - alpha) previous, from 0."""

    def step(e: float, x: float) -> tuple:
        e = alpha * x + (1 - alpha) * e
        return e, (e,)

    return fold(rows, keys, order, value, 0.0, step, [name])


def innovations(rows: DataFrame, keys: list[str], order: str, value: str, train: Column, rate: float = 0.01) -> DataFrame:
    """gamma, the distance from the one-step forecast, and its score against the training windows' gammas.

    The first window has none.  The deviation is at least 2 % of the training level over 50 and else 1.
    """

    def step(state: tuple, x: float) -> tuple:
        (z,) = state
        return ((x,), (None,)) if z is None else ((rate * x + (1 - rate) * z,), (abs(x - z),))

    g = rows.withColumn("_t", train).join(fold(rows, keys, order, F.col(value), (None,), step, ["gamma"]), [*keys, order])
    w = Window.partitionBy(*keys)
    level = F.avg(F.when(F.col("_t"), F.abs(value))).over(w)
    sd = F.greatest(F.coalesce(F.stddev_samp(F.when(F.col("_t"), F.col("gamma"))).over(w), F.lit(0.0)), F.when(level > 50, 0.02 * level).otherwise(1.0))
    return g.withColumn("score", F.coalesce((F.col("gamma") - F.avg(F.when(F.col("_t"), F.col("gamma"))).over(w)) / sd, F.lit(0.0))).drop("_t")


def islands(rows: DataFrame, keys: list[str], index: str, gap: int) -> DataFrame:
    """Flagged rows with their episode: a new one after more than ``gap`` indexes without a flag."""
    w = Window.partitionBy(*keys).orderBy(index)
    new = F.coalesce(F.col(index) - F.lag(index).over(w) > gap, F.lit(True))
    return rows.withColumn("_n", new.cast("int")).withColumn("episode", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def runs(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """``run`` numbers maximal stretches of one value; ``length`` counts the rows of the stretch so far."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = rows.withColumn("_v", value)
    out = out.withColumn("_n", F.coalesce((F.lag("_v").over(w) != F.col("_v")).cast("int"), F.lit(1)))
    out = out.withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("length", F.row_number().over(Window.partitionBy(*keys, "run").orderBy(order))).drop("_v", "_n")


def causal_split(rows: DataFrame, keys: list[str], order: str, attack: str, cuts: tuple[float, ...] = (0.6,)) -> DataFrame:
    """part: fit and calib are the benign windows before the first attack, cut by their number; test follows it.

    With two cuts, the benign windows after the second also are test.  Entities without an attack have no test
    except by the second cut.
    """
    w = Window.partitionBy(*keys)
    out = rows.withColumn("_i", F.row_number().over(w.orderBy(order)))
    out = out.withColumn("_first", F.coalesce(F.min(F.when(F.col(attack), F.col("_i"))).over(w), F.count("*").over(w) + 1))
    n = F.col("_first") - 1
    part = F.when(F.col("_i") >= F.col("_first"), "test").when(F.col("_i") <= F.floor(n * cuts[0] + 1e-9), "fit")
    part = part.when(F.col("_i") <= F.floor(n * cuts[1] + 1e-9), "calib").otherwise("test") if len(cuts) > 1 else part.otherwise("calib")
    return out.withColumn("part", part).drop("_i", "_first")


def row_split(rows: DataFrame, keys: list[str], order: str, shares: tuple[float, float] = (0.6, 0.75)) -> DataFrame:
    """part by place alone: train, calib, test."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    return rows.withColumn("part", F.when(i <= F.floor(n * shares[0] + 1e-9), "train").when(i <= F.floor(n * shares[1] + 1e-9), "calib").otherwise("test"))


def running(counts: DataFrame, keys: list[str], value: str, columns: list[str], parts: int = 64) -> DataFrame:
    """``counts`` (a row per key and value) with ``upto_<column>``: each column summed over all values up to the row's.

    A key's values are cut at approximate quantiles, sums of parts are run along the parts, and values only within
    theirs, so a key with any number of values is never ordered by one task.
    """
    key = keys or ["_every"]
    rows = counts if keys else counts.withColumn("_every", F.lit(0))
    edges = rows.groupBy(*key).agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(2000)).alias("_edges"))
    cut = rows.join(edges, key).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    along = Window.partitionBy(*key).orderBy("_part")
    before = cut.groupBy(*key, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    before = before.select(*key, "_part", *[(F.sum(f"_sum_{c}").over(along) - F.col(f"_sum_{c}")).alias(f"_before_{c}") for c in columns])
    within = Window.partitionBy(*key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"_local_{c}": F.sum(c).over(within) for c in columns})
    out = local.join(before, [*key, "_part"]).withColumns({f"upto_{c}": F.col(f"_before_{c}") + F.col(f"_local_{c}") for c in columns})
    return out.drop("_part", "_every", *[f"_{n}_{c}" for c in columns for n in ("before", "local")])


def tail_counts(rows: DataFrame, keys: list[str], value: str, train: str) -> DataFrame:
    """keys, value, _same (training rows of that value), _upto (up to it) and _n (all): a row per distinct value."""
    c = rows.groupBy(*keys, value).agg(F.count_if(train).alias("_same"))
    upto = running(c, keys, value, ["_same"]).withColumnRenamed("upto__same", "_upto")
    if not keys:
        return upto.withColumn("_n", F.lit(rows.filter(train).count()))
    return upto.join(rows.groupBy(*keys).agg(F.count_if(train).alias("_n")), keys)


def tail_probability(rows: DataFrame, keys: list[str], value: str, train: str) -> DataFrame:
    """left and right tail shares of each row's value among the training rows, at least 1 / (n + 1)."""
    t = rows.join(tail_counts(rows, keys, value, train), [*keys, value])
    floor = 1 / (F.col("_n") + 1)
    share = lambda k: F.greatest(F.try_divide(k, F.col("_n")), floor)
    return t.withColumns({"left": share(F.col("_upto")), "right": share(F.col("_n") - F.col("_upto") + F.col("_same"))}).drop("_same", "_upto", "_n")


def adaptive_threshold(events: DataFrame, keys: list[str], order: str, duration: Column, start: float = 4.0, batch: int = 5) -> DataFrame:
    """theta after each attack event: every ``batch`` events, up a quarter if more were short (under 10 s) than long
    (30 s and more), down a quarter if fewer, within 4 and 10."""

    def step(state: tuple, x: float) -> tuple:
        theta, fp, tp, n = state
        fp, tp, n = fp + (x < 10), tp + (x >= 30), n + 1
        if n % batch == 0:
            theta, fp, tp = min(max(theta + 0.25 * ((fp > tp) - (fp < tp)), 4.0), 10.0), 0, 0
        return (theta, fp, tp, n), (theta,)

    return fold(events, keys, order, duration, (start, 0, 0, 0), step, ["theta"])


def score_walk(events: DataFrame, keys: list[str], order: str, change: Column, low: float = 0.0, high: float = 1000.0, start: float = 500.0) -> DataFrame:
    """A score that starts at ``start``, adds each change and is clamped after each."""

    def step(score: float, x: float) -> tuple:
        score = min(max(score + x, low), high)
        return score, (score,)

    return fold(events, keys, order, change, start, step, ["score"])


def spikes(rows: DataFrame, keys: list[str], order: str, value: Column, least: float = 1.0, times: float = 3.0) -> DataFrame:
    """baseline before each window (.9 old + .1 new) and spike: the value is ``times`` it, and it is over ``least``."""

    def step(b: float, x: float) -> tuple:
        return 0.9 * b + 0.1 * x, (b, float(b > least and x >= times * b))

    return fold(rows, keys, order, value, 0.0, step, ["baseline", "spike"])


def token_bucket(rows: DataFrame, keys: list[str], rate: float, burst: float) -> DataFrame:
    """admitted per packet of a (t seconds, cost) stream: tokens refill with time up to ``burst`` and are only taken
    by packets that fit."""

    def step(state: tuple, t: float, cost: float) -> tuple:
        tokens, before = state
        have = min(burst, tokens + rate * (t - (t if before is None else before)))
        ok = have >= cost
        return (have - cost if ok else have, t), (ok,)

    packets = rows.select(*keys, "t", "event_id", F.col("t").alias("_t"), "cost")
    return streamed(packets, keys, ["t", "event_id"], lambda: (burst, None), step, [*keys, "event_id"], "admitted boolean")

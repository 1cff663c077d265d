"""Paired comparison of detectors over scenarios: exact rank tests, clustered draws, joins and inputs that are proven."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.traffic import erfc
from netweir.sources.lineage import written

#: Pairs up to which the null distribution is counted; beyond, the normal limit with its correction for ties.
EXACT = 200
#: Draws that are made from one row.
RUN = 8192


def signed_ranks(pairs: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """keys and, for each test, ranks (twice the average rank of each |difference| that is not zero) and up (the sum of
    those of positive ones); a null difference is no pair."""
    d = pairs.filter(F.col(difference) != 0).select(*keys, F.abs(difference).alias("_a"), (F.col(difference) > 0).cast("int").alias("_up"))
    ties = d.groupBy(*keys, "_a").agg(F.count("*").alias("_n"), F.sum("_up").alias("_p"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_a")) - F.col("_n")
    ranked = ties.withColumn("_rank", (2 * before + F.col("_n") + 1).cast("long"))
    runs = F.array_sort(F.collect_list(F.struct("_rank", "_n")))
    return ranked.groupBy(*keys).agg(runs.alias("_runs"), F.sum(F.col("_rank") * F.col("_p")).alias("up"), F.sum("_n").alias("n"))


def null_counts(ranks: Column) -> Column:
    """Shares of sign assignments by the sum of the ranks with a plus: index s holds that of sum s.

    Ranks are taken one by one: each sum comes from the same sum without the rank and from the sum less the rank, half
    and half, so n ranks take n times the sums' number of steps, not 2^n.
    """
    total = F.aggregate(ranks, F.lit(0).cast("long"), lambda a, r: a + r)
    first = F.transform(F.sequence(F.lit(0).cast("long"), total), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    return F.aggregate(ranks, first, lambda acc, r: F.transform(acc, lambda x, s: 0.5 * x + 0.5 * F.coalesce(F.get(acc, (s - r).cast("int")), F.lit(0.0))))


def wilcoxon(pairs: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """keys, n (pairs that differ) and the two-sided signed-rank p-value; tests without a difference have n 0 and p 1.

    Exact, with average ranks for ties, for up to ``EXACT`` pairs.
    """
    tests = pairs.select(*keys).distinct()
    s = signed_ranks(pairs, keys, difference)
    ranks = F.flatten(F.transform("_runs", lambda x: F.array_repeat(x["_rank"], x["_n"].cast("int"))))
    named = s.withColumn("_ranks", F.when(F.col("n") <= EXACT, ranks))
    null = named.withColumn("_null", F.when(F.col("_ranks").isNotNull(), null_counts(F.col("_ranks"))))
    side = lambda keep: F.aggregate(F.filter(F.transform("_null", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: keep(x["i"])), F.lit(0.0), lambda a, x: a + x["p"])
    exact = 2 * F.least(side(lambda i: i <= F.col("up")), side(lambda i: i >= F.col("up")))
    n = F.col("n").cast("double")
    tied = F.aggregate("_runs", F.lit(0.0), lambda a, x: a + x["_n"] * x["_n"] * x["_n"] - x["_n"])
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48)
    limit = erfc(F.abs(F.col("up") / 2 - n * (n + 1) / 4) / sd / math.sqrt(2))
    p = F.when(F.col("n") <= EXACT, exact).otherwise(limit)
    return tests.join(null.select(*keys, "n", p.alias("p")), keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.least(F.coalesce("p", F.lit(1.0)), F.lit(1.0)).alias("p"))


def drawn_place(of: Column, *named: Column | str) -> Column:
    """A number from 0 to ``of`` - 1 that the MD5 of the names decides, so that any engine draws the same."""
    text = F.concat_ws(":", *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in named])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % of


def paired_bootstrap(clusters: DataFrame, ident: str, first: str, second: str, n: str, draws: int = 500, seed: int = 7) -> DataFrame:
    """The percent by which the second arm's rate is under the first's: point (NaN without hits), mean, 95 % interval and
    one-sided p.

    ``clusters`` has a row for each independent unit with both arms' hits and its size.  A replicate draws as many units as
    there are, with replacement, and both arms share its draws, so the interval is of their difference.  Units are
    written once, in ranges that are numbered side by side.  Draws are made in runs of ``RUN``, and are dealt by unit to
    meet it: Spark takes them for the one row they come from, and would send them all to every task.
    """
    units = written(clusters.select(ident, first, second, n).repartitionByRange(F.col(ident).asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    parts = units.groupBy("_part").agg(F.count("*").alias("_here")).withColumn("_before", F.sum("_here").over(Window.orderBy("_part")) - F.col("_here"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(ident).asc_nulls_last()))
    # a row for each range
    numbered = units.withColumn("_nth", nth).join(F.broadcast(parts), "_part").select((F.col("_before") + F.col("_nth") - 1).alias("_i"), first, second, n)
    count = units.agg(F.count("*").alias("_m")).filter("_m > 0")
    runs = count.select("_m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_rep")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(RUN).cast("long"))).alias("_from"))
    every = runs.repartition(4 * clusters.sparkSession.sparkContext.defaultParallelism)
    drawn = every.select("_rep", "_m", F.explode(F.sequence("_from", F.least(F.col("_from") + RUN, "_m") - 1)).alias("_j")).select("_rep", drawn_place(F.col("_m"), F.lit(seed), "_rep", "_j").alias("_i"))
    reps = drawn.join(numbered.hint("shuffle_hash"), "_i").groupBy("_rep").agg(*[F.sum(c).alias(c) for c in (first, second, n)]).filter(F.col(n) > 0)
    # rates of one replicate have one size, so their ratio is that of the hits
    cut = F.when(F.col(first) > 0, 100.0 * (F.col(first) - F.col(second)) / F.col(first)).when(F.col(first) == 0, float("nan"))
    ranked = reps.withColumn("_red", F.coalesce(F.nanvl(cut, F.lit(0.0)), F.lit(0.0))).withColumns({"_at": F.row_number().over(Window.partitionBy().orderBy("_red")) - 1, "_n": F.count("*").over(Window.partitionBy())})
    at = lambda q: F.max(F.when(F.col("_at") == F.floor(F.lit(q) * F.col("_n")), F.col("_red")))
    spread = ranked.agg(F.avg("_red").alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"), F.greatest(F.avg((F.col(second) >= F.col(first)).cast("int")), F.lit(1.0 / draws)).alias("p"))
    point = units.agg(F.sum(first).alias(first), F.sum(second).alias(second)).select(cut.alias("reduction"))
    # two tables of one row
    return point.join(F.broadcast(spread))


def matched_once(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join in which every left row has exactly one match; the running job fails where one has none or several."""
    values = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count("*").alias("_matches"), F.any_value(F.struct(*values)).alias("_right"))
    both = left.join(one, keys, "left")
    said = F.concat(F.lit("not exactly one match: "), F.to_json(F.struct(*keys)), F.lit(" has "), F.coalesce("_matches", F.lit(0)).cast("string"))
    # the check is part of a value that is used, so that no plan leaves it out
    sure = F.when(F.coalesce(F.col("_matches") == 1, F.lit(False)), F.col("_right")).otherwise(F.raise_error(said).cast(one.schema["_right"].dataType))
    return both.withColumn("_right", sure).select(*left.columns, *[F.col(f"_right.{v}").alias(v) for v in values])


def content_hash(rows: DataFrame) -> DataFrame:
    """n and hash of a table's content, whatever the order and number of its files: sums of hashes of rows, by columns in
    the order of their names."""
    cols = sorted(rows.columns)
    each = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cols]))
    part = lambda i: F.sum(F.conv(F.substring(each, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.md5(F.concat_ws(":", *[part(i).cast("string") for i in range(4)])), F.lit("")).alias("hash"))


def ledger(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n, hash of each input."""
    return reduce(DataFrame.unionByName, [content_hash(t).select(F.lit(name).alias("name"), "n", "hash") for name, t in sorted(tables.items())])


def proven(rows: DataFrame, inputs: dict[str, DataFrame], recorded: DataFrame) -> DataFrame:
    """``rows``, if every input's content is what the ledger ``recorded`` says; else the running job fails.

    Entries of either side without their like in the other must be none: they are gathered in one row, which rows are
    joined with and checked against.
    """
    now = ledger(inputs)
    keys = ["name", "n", "hash"]
    odd = now.join(recorded, keys, "left_anti").unionByName(recorded.select(*keys).join(now, keys, "left_anti")).agg(F.count("*").alias("_odd"), F.concat_ws(", ", F.array_sort(F.collect_set("name"))).alias("_names"))
    checked = rows.join(F.broadcast(odd))
    ok = F.when(F.col("_odd") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("inputs differ from the ledger: "), "_names")).cast("boolean"))
    return checked.filter(ok).drop("_odd", "_names")


def joint_filter(scenarios: DataFrame, cuts: list[float], name: str = "scenario", cluster: str = "victim", delta: str = "delta", clock: str = "clock") -> DataFrame:
    """For every cut of clock separability: how many scenarios the clock cannot tell (clean) and what is left of the difference there.

    cut, n, separated, mean, share (percent of all scenarios' mean), wins, losses, ties, p and informative pairs over
    scenarios, and the clusters, their p and informative pairs over cluster means.
    """
    scenarios = written(scenarios)
    rows = scenarios.withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    full = scenarios.agg(F.avg(delta).alias("_full"))
    clean = rows.filter(F.col(clock) < F.col("cut"))
    counts = rows.groupBy("cut").agg(F.count_if(F.col(clock) < F.col("cut")).alias("n"), F.count_if(F.col(clock) >= F.col("cut")).alias("separated"))
    d = F.col(delta)
    stats = clean.groupBy("cut").agg(F.avg(d).alias("mean"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    means = clean.groupBy("cut", cluster).agg(F.round(F.avg(d), 9).alias("_mean"))
    by_row = wilcoxon(clean, ["cut"], delta).withColumnsRenamed({"n": "informative"})
    by_cluster = wilcoxon(means, ["cut"], "_mean").withColumnsRenamed({"n": "cluster_informative", "p": "cluster_p"})
    clusters = means.groupBy("cut").agg(F.count("*").alias("clusters"))
    out = counts.join(F.broadcast(full))
    for side in (stats, by_row, clusters, by_cluster):
        out = out.join(side, "cut", "left")
    return out.select("cut", "n", "separated", "mean", (100.0 * F.col("mean") / F.col("_full")).alias("share"), "wins", "losses", "ties", "informative", "p", "clusters", "cluster_informative", "cluster_p")

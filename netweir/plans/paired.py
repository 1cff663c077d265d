"""Detectors compared over scenarios: rank tests, clustered draws, clock-clean strata with proven joins and inputs."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.operators import evaluation as ev
from netweir.operators import paired as op
from netweir.sources import tables

from .detectors import FEATURES
from .registry import query, r6
from .views_sql import PACKETS, VECTORS

DRAWS, SEED, CUTS = 200, 7, [0.62, 0.7, 0.95]
#: AUC of each arm (feature) over each scenario (a victim's windows), and what the order of windows alone gives.
AUCS = f"""{VECTORS}, sc AS (SELECT victim, idx, attack, feature, round(x, 1) AS s FROM (UNPIVOT vectors ON f0, f1, f2, f3, f4, f5, f6, f7 INTO NAME feature VALUE x)),
al AS (SELECT * FROM sc UNION ALL SELECT victim, idx, attack, 'clock', CAST(-idx AS DOUBLE) FROM vectors),
cc AS (SELECT feature, victim, s, count(*) AS n, count(*) FILTER (attack) AS pos FROM al GROUP BY ALL), kk AS (SELECT *, sum(n) OVER (PARTITION BY feature, victim ORDER BY s) - n + (n + 1) / 2 AS rank FROM cc),
aucs AS (SELECT feature, victim, round((sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 9) AS auc FROM kk GROUP BY ALL HAVING sum(pos) > 0 AND sum(n) > sum(pos))"""


def exact_sql(name: str, source: str, keys: str, value: str) -> str:
    """SQL of the exact test by every sign assignment, for as many pairs as a test here has."""
    on = f"USING ({keys})"
    return f"""{name}_z AS (SELECT {keys}, abs({value}) AS a, CAST({value} > 0 AS INT) AS up FROM {source} WHERE {value} <> 0),
{name}_r AS (SELECT *, 2 * (rank() OVER (PARTITION BY {keys} ORDER BY a) - 1) + count(*) OVER (PARTITION BY {keys}, a) + 1 AS rk, row_number() OVER (PARTITION BY {keys} ORDER BY a) - 1 AS bit FROM {name}_z),
{name}_t AS (SELECT {keys}, count(*) AS n, sum(rk * up) AS up FROM {name}_r GROUP BY {keys}),
{name}_m AS (SELECT {keys}, up, n, unnest(range(CAST(1 << n AS BIGINT))) AS mask FROM {name}_t),
{name}_s AS (SELECT {keys}, mask, any_value({name}_m.up) AS up, any_value(n) AS n, sum(rk * ((mask >> bit) & 1)) AS s FROM {name}_m JOIN {name}_r {on} GROUP BY {keys}, mask),
{name} AS (SELECT {keys}, any_value(n) AS n, least(1.0, 2 * least(count(*) FILTER (s <= up), count(*) FILTER (s >= up)) / count(*)) AS p FROM {name}_s GROUP BY {keys})"""


def aucs(spark, sf_dir) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    long = v.unpivot(["idx", "attack", "victim"], FEATURES, "feature", "x").select("feature", "victim", "attack", F.round("x", 1).alias("s"))
    clock = v.select(F.lit("clock").alias("feature"), "victim", "attack", (-F.col("idx")).cast("double").alias("s"))
    return ev.auc(long.unionByName(clock), ["feature", "victim"], "s", "attack").filter("auc IS NOT NULL").withColumn("auc", F.round("auc", 9))


def differences(a: DataFrame) -> DataFrame:
    """feature, victim, delta: every arm's AUC less the first's."""
    base = a.filter("feature = 'f0'").select("victim", F.col("auc").alias("base"))
    return a.filter("feature NOT IN ('f0', 'clock')").join(base, "victim").select("feature", "victim", F.round(F.col("auc") - F.col("base"), 9).alias("delta"))


DELTAS = "deltas AS (SELECT a.feature, a.victim, round(a.auc - b.auc, 9) AS delta FROM aucs a JOIN aucs b ON b.victim = a.victim AND b.feature = 'f0' WHERE a.feature NOT IN ('f0', 'clock'))"


@query(f"WITH {AUCS}, {DELTAS}, {exact_sql('w', 'deltas', 'feature', 'delta')} SELECT feature, coalesce(n, 0) AS n, round(coalesce(p, 1.0), 6) AS p, wins, round(mean, 6) AS mean FROM (SELECT feature, count(*) FILTER (delta > 0) AS wins, avg(delta) AS mean FROM deltas GROUP BY 1) LEFT JOIN w USING (feature)")
def signed_rank_tests(spark, sf_dir):
    """Each arm against the first over the victims: the exact signed-rank test of their AUCs."""
    d = differences(aucs(spark, sf_dir))
    stats = d.groupBy("feature").agg(F.count_if(F.col("delta") > 0).alias("wins"), F.avg("delta").alias("mean"))
    return op.wilcoxon(d, ["feature"], "delta").join(stats, "feature").select("feature", "n", r6("p"), "wins", r6("mean"))


@query(f"WITH {AUCS}, {DELTAS}, {exact_sql('w', 'deltas', 'feature', 'delta')}, q AS (SELECT feature, coalesce(p, 1.0) AS p FROM (SELECT DISTINCT feature FROM deltas) LEFT JOIN w USING (feature)), r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM q) SELECT feature, round(p, 6) AS p, round(least(p * m, 1), 6) AS bonferroni, round(least(max(p * (m - i + 1)) OVER (ORDER BY i), 1), 6) AS holm FROM r")
def adjusted_rank_tests(spark, sf_dir):
    """The same tests as one family."""
    d = differences(aucs(spark, sf_dir))
    return ev.holm(op.wilcoxon(d, ["feature"], "delta"), "feature", "p").select("feature", *map(r6, ("p", "bonferroni", "holm")))


ARMS = f"{PACKETS}, g AS (SELECT dst, count(*) FILTER (length > 900) AS one, count(*) FILTER (length > 900 AND ttl < 160) AS three, count(*) AS n FROM packets WHERE NOT attack GROUP BY 1)"


def arms(spark, sf_dir) -> DataFrame:
    p = tables.packets(spark, sf_dir).filter("NOT attack")
    return p.groupBy("dst").agg(F.count_if(F.expr("length > 900")).alias("one"), F.count_if(F.expr("length > 900 AND ttl < 160")).alias("three"), F.count("*").alias("n"))


@query(f"""
WITH {ARMS}, u AS (SELECT *, row_number() OVER (ORDER BY dst) - 1 AS i, count(*) OVER () AS m FROM g), k AS (SELECT DISTINCT m FROM u),
d AS (SELECT rep, CAST('0x' || md5('{SEED}:' || rep || ':' || j)[1:8] AS BIGINT) % m AS i FROM k, (SELECT unnest(range({DRAWS})) AS rep), LATERAL (SELECT unnest(range(m)) AS j)),
r AS (SELECT rep, sum(one) AS one, sum(three) AS three, sum(n) AS n FROM d JOIN u USING (i) GROUP BY rep), c AS (SELECT *, CASE WHEN one > 0 THEN 100.0 * (one - three) / one ELSE 0 END AS red FROM r WHERE n > 0), o AS (SELECT *, row_number() OVER (ORDER BY red) - 1 AS at FROM c)
SELECT round(any_value(z.red), 6) AS reduction, round(avg(o.red), 6) AS mean, round(max(o.red) FILTER (at = CAST(floor(0.025 * {DRAWS}) AS BIGINT)), 6) AS low, round(max(o.red) FILTER (at = CAST(floor(0.975 * {DRAWS}) AS BIGINT)), 6) AS high, round(greatest(avg(CAST(three >= one AS INT)), 1.0 / {DRAWS}), 6) AS p
FROM o, (SELECT 100.0 * (sum(one) - sum(three)) / sum(one) AS red FROM g) z
""".replace(" AS at ", " AS place ").replace("(at =", "(place ="))
def paired_reduction(spark, sf_dir):
    """How much fewer benign packets the second rule flags than the first, victims drawn together for both."""
    return op.paired_bootstrap(arms(spark, sf_dir), "dst", "one", "three", "n", DRAWS, SEED).select(*map(r6, ("reduction", "mean", "low", "high", "p")))


SCENARIOS = f"{AUCS}, {DELTAS}, sn AS (SELECT d.feature || '@' || d.victim AS scenario, d.victim, delta, round(abs(0.5 - c.auc) + 0.5, 9) AS clock FROM deltas d JOIN aucs c ON c.victim = d.victim AND c.feature = 'clock' WHERE d.feature = 'f1')"


def scenarios(spark, sf_dir) -> DataFrame:
    """The panel of scenarios, each with exactly one difference and one clock row, over inputs that a ledger proves."""
    a = aucs(spark, sf_dir)
    d = differences(a).filter("feature = 'f1'").select("victim", "delta")
    clock = a.filter("feature = 'clock'").select("victim", F.round(F.abs(0.5 - F.col("auc")) + 0.5, 9).alias("clock"))
    panel = op.matched_once(d.select("victim").distinct().select(F.concat(F.lit("f1@"), F.col("victim").cast("string")).alias("scenario"), "victim"), d, ["victim"])
    inputs = {"vectors": tables.vectors(spark, sf_dir)}
    return op.proven(op.matched_once(panel, clock, ["victim"]), inputs, op.ledger(inputs))


FAMILY = "sn, (SELECT unnest([0.62, 0.7, 0.95]) AS cut)"


@query(f"""
WITH {SCENARIOS}, cl AS (SELECT * FROM {FAMILY} WHERE clock < cut), mc AS (SELECT cut, victim, round(avg(delta), 9) AS md FROM cl GROUP BY ALL), {exact_sql('w', 'cl', 'cut', 'delta')}, {exact_sql('v', 'mc', 'cut', 'md')},
ct AS (SELECT cut, count(*) FILTER (clock < cut) AS n, count(*) FILTER (clock >= cut) AS separated FROM {FAMILY} GROUP BY 1), st AS (SELECT cut, avg(delta) AS mean, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties, count(DISTINCT victim) AS clusters FROM cl GROUP BY 1)
SELECT CAST(cut AS DOUBLE) AS cut, ct.n, separated, round(mean, 6) AS mean, round(100.0 * mean / (SELECT avg(delta) FROM sn), 4) AS share, wins, losses, ties, CASE WHEN mean IS NOT NULL THEN coalesce(w.n, 0) END AS informative, round(CASE WHEN mean IS NOT NULL THEN coalesce(w.p, 1) END, 6) AS p, clusters, CASE WHEN mean IS NOT NULL THEN coalesce(v.n, 0) END AS cluster_informative, round(CASE WHEN mean IS NOT NULL THEN coalesce(v.p, 1) END, 6) AS cluster_p
FROM ct LEFT JOIN st USING (cut) LEFT JOIN w USING (cut) LEFT JOIN v USING (cut)
""")
def clock_clean_strata(spark, sf_dir):
    """What is left of a detector's lead where the order of windows does not give attacks away."""
    out = op.joint_filter(scenarios(spark, sf_dir), CUTS)
    return out.select("cut", "n", "separated", r6("mean"), F.round("share", 4).alias("share"), "wins", "losses", "ties", "informative", r6("p"), "clusters", "cluster_informative", r6("cluster_p"))


def _hash_sql(columns: list[str], source: str) -> str:
    text = ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '~')" for c in sorted(columns))
    part = ", ".join(f"CAST(sum(CAST(CAST('0x' || h[{1 + 8 * i}:{8 + 8 * i}] AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))
    return f"SELECT count(*) AS n, md5(concat_ws(':', {part})) AS hash FROM (SELECT md5(concat_ws(chr(31), {text})) AS h FROM {source})"


HASHED = {"attacks": ["o_orderkey", "o_custkey", "o_orderstatus"], "targets": ["c_custkey", "c_nationkey", "c_name"], "nations": ["n_nationkey", "n_name", "n_regionkey"]}
SOURCES = {"attacks": "orders", "targets": "customer", "nations": "nation"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, * FROM ({_hash_sql(cols, SOURCES[name])})" for name, cols in HASHED.items()))
def input_ledger(spark, sf_dir):
    """Rows and content hashes of inputs, the same from any engine and in any order of rows."""
    inputs = {name: tables.table(spark, sf_dir, SOURCES[name]).select(*cols) for name, cols in HASHED.items()}
    return reduce(lambda a, b: a.unionByName(b), [op.ledger({k: v}) for k, v in inputs.items()])

"""Validation, protection, reports and upkeep: the smaller queries of daily operation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from netweir.functions.traffic import cases, clamp
from netweir.operators import evaluation, recursions
from netweir.operators import traffic as op
from netweir.operators.detectors import long_form, peaks_over_threshold
from netweir.sources import tables

from .detectors import FEATURES, POT, matrix
from .lookups import values
from .recursions import SERIES, SLOTS, ewma_sql, series, tiers
from .registry import query, r6
from .views_sql import ATTACKS, PACKETS, ROLLUPS

#: Attack codes and names, and spellings that mean one corpus.
ATTACK_NAMES = ((1, "SYN flood"), (2, "UDP flood"), (3, "UDP amplification"), (4, "ICMP flood"), (5, "Slowloris"), (6, "HTTP flood"))
PROTOCOL_NAMES = ((6, "TCP"), (17, "UDP"), (1, "ICMP"))
SPELLINGS = (("click", "web"), ("view", "web"), ("purchase", "shop"), ("signup", "shop"), ("error", "fault"))
AGENTS = (("googlebot", "search"), ("bingbot", "search"), ("curl", "tool"), ("python-requests", "tool"), ("sqlmap", "attack"), ("Mozilla", "browser"))


@query(f"""
WITH {PACKETS} SELECT event_id, CASE WHEN length < 20 THEN 'short' WHEN ttl = 0 THEN 'ttl' WHEN src = dst THEN 'land' WHEN proto IN (6, 17) AND (src_port = 0 OR dst_port = 0) THEN 'port' WHEN proto = 6 AND flags & 3 = 3 THEN 'flags' ELSE 'valid' END AS verdict FROM packets
""")
def packet_validation(spark, sf_dir):
    checks = cases((F.col("length") < 20, "short"), (F.col("ttl") == 0, "ttl"), (F.col("src") == F.col("dst"), "land"), (F.col("proto").isin(6, 17) & ((F.col("src_port") == 0) | (F.col("dst_port") == 0)), "port"), ((F.col("proto") == 6) & (F.col("flags").bitwiseAND(F.lit(3)) == 3), "flags"), otherwise="valid")
    return tables.packets(spark, sf_dir).select("event_id", checks.alias("verdict"))


@query(r"""
WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 80 WHEN 1 THEN 53 ELSE 123 END AS port, CASE WHEN page_id % 4 = 0 THEN 'GET ' || url || ' HTTP/1.1' ELSE url END AS payload FROM pages)
SELECT page_id, port, CASE port WHEN 80 THEN regexp_matches(payload, '^(GET|POST|HEAD|PUT|DELETE|OPTIONS) \S+ HTTP/1\.[01]') WHEN 53 THEN length(payload) BETWEEN 12 AND 512 ELSE length(payload) >= 48 END AS valid FROM p
""")
def payload_validation(spark, sf_dir):
    """Payloads that their port's protocol allows."""
    port = F.when(F.col("page_id") % 3 == 0, 80).when(F.col("page_id") % 3 == 1, 53).otherwise(123)
    payload = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1"))).otherwise(F.col("url"))
    p = tables.table(spark, sf_dir, "pages").select("page_id", port.alias("port"), payload.alias("payload"))
    n = F.length("payload")
    return p.select("page_id", "port", cases((F.col("port") == 80, F.col("payload").rlike(r"^(GET|POST|HEAD|PUT|DELETE|OPTIONS) \S+ HTTP/1\.[01]")), (F.col("port") == 53, n.between(12, 512)), otherwise=n >= 48).alias("valid"))


@query(f"WITH {PACKETS} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS nth FROM packets WHERE proto NOT IN (1, 6, 17)) WHERE nth > 2")
def other_protocol_drops(spark, sf_dir):
    """Packets of rare protocols beyond two an hour."""
    nth = F.row_number().over(Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id"))
    return tables.packets(spark, sf_dir).filter(~F.col("proto").isin(1, 6, 17)).withColumn("nth", nth).filter("nth > 2").select("event_id")


@query(f"WITH {PACKETS} SELECT event_id, coalesce(a.name, p.name, 'unknown') AS name FROM packets LEFT JOIN {values(ATTACK_NAMES, 'a(code, name)')} ON a.code = event_id % 9 LEFT JOIN {values(PROTOCOL_NAMES, 'p(proto, name)')} USING (proto)")
def attack_names(spark, sf_dir):
    """An attack's code as a name, else its protocol's."""
    table = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return tables.packets(spark, sf_dir).select("event_id", F.coalesce(table(ATTACK_NAMES)[(F.col("event_id") % 9).cast("int")], table(PROTOCOL_NAMES)[F.col("proto")], F.lit("unknown")).alias("name"))


@query(f"WITH {PACKETS} SELECT dst, count(*) AS packets FROM packets WHERE dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def protected_traffic(spark, sf_dir):
    protected = tables.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"))
    return tables.packets(spark, sf_dir).join(protected, "dst", "left_semi").groupBy("dst").agg(F.count("*").alias("packets"))


@query(f"WITH {PACKETS}, a AS (SELECT dst, count(*) FILTER (attack) AS bad, max(length) AS peak FROM packets GROUP BY 1), p AS (SELECT s_suppkey AS dst, coalesce(bad, 0) AS bad, peak FROM supplier LEFT JOIN a ON dst = s_suppkey) SELECT count(*) AS protected, count(*) FILTER (bad >= 3) AS anomalous, count(*) FILTER (bad < 3) AS healthy, max(bad) AS worst, max(peak) AS peak FROM p")
def protected_summary(spark, sf_dir):
    a = tables.packets(spark, sf_dir).groupBy("dst").agg(F.count_if("attack").alias("bad"), F.max("length").alias("peak"))
    p = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dst")).join(a, "dst", "left").fillna(0, ["bad"])
    return p.agg(F.count("*").alias("protected"), F.count_if(F.col("bad") >= 3).alias("anomalous"), F.count_if(F.col("bad") < 3).alias("healthy"), F.max("bad").alias("worst"), F.max("peak").alias("peak"))


@query("SELECT n_nationkey, n_name, count(c_custkey) AS members, string_agg(c_custkey, ',' ORDER BY c_custkey) FILTER (c_acctbal < -900) AS indebted FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def tenants_with_members(spark, sf_dir):
    """Each tenant with a list of its members in debt."""
    n, c = (tables.table(spark, sf_dir, t) for t in ("nation", "customer"))
    low = F.array_sort(F.collect_list(F.when(F.col("c_acctbal") < -900, F.col("c_custkey"))))
    text = F.array_join(F.transform(low, lambda k: k.cast("string")), ",")
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("members"), F.when(text != "", text).alias("indebted"))


@query(f"WITH v AS (SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN 'Googlebot/2.1' WHEN 1 THEN 'curl/8' WHEN 2 THEN 'sqlmap/1.7' WHEN 3 THEN 'python-requests/2' ELSE 'Mozilla/5.0' END AS agent FROM conversations) SELECT agent, CASE WHEN agent ILIKE '%googlebot%' OR agent ILIKE '%bingbot%' THEN 'search' WHEN agent ILIKE '%curl%' OR agent ILIKE '%python-requests%' THEN 'tool' WHEN agent ILIKE '%sqlmap%' THEN 'attack' WHEN agent ILIKE '%mozilla%' THEN 'browser' ELSE 'unknown' END AS kind, count(*) AS n FROM v GROUP BY 1, 2 ORDER BY n DESC, agent LIMIT 5")
def bot_traffic(spark, sf_dir):
    """User agents by the first name they contain, and the five most seen."""
    k = (F.col("conv_id") + F.col("turn")) % 7
    agent = F.when(k == 0, "Googlebot/2.1").when(k == 1, "curl/8").when(k == 2, "sqlmap/1.7").when(k == 3, "python-requests/2").otherwise("Mozilla/5.0")
    v = tables.table(spark, sf_dir, "conversations").select(agent.alias("agent"))
    kind = cases(*[(F.lower("agent").contains(name.lower()), label) for name, label in AGENTS], otherwise="unknown")
    return op.top(v.groupBy("agent").agg(F.count("*").alias("n")).select("agent", kind.alias("kind"), "n"), 5, [F.desc("n"), F.asc("agent")])


@query(f"""
WITH {ROLLUPS}, {ATTACKS}, t AS (SELECT max(rx_pps) AS peak, sum(dropped_pps) AS dropped, count(*) FILTER (anomaly_active) AS anomalies FROM rollups), a AS (SELECT count(*) AS n, count(*) FILTER (is_active) AS active, max(magnitude) AS worst FROM attacks)
SELECT 'traffic' AS section, 'peak_pps' AS metric, CAST(peak AS DOUBLE) AS value FROM t UNION ALL SELECT 'traffic', 'dropped', dropped FROM t UNION ALL SELECT 'traffic', 'anomalies', anomalies FROM t
UNION ALL SELECT 'attacks', 'total', n FROM a UNION ALL SELECT 'attacks', 'active', active FROM a UNION ALL SELECT 'attacks', 'worst', worst FROM a
""")
def executive_report(spark, sf_dir):
    """section, metric, value of a report."""
    t = tables.rollups(spark, sf_dir).agg(F.max("rx_pps").alias("peak_pps"), F.sum("dropped_pps").alias("dropped"), F.count_if("anomaly_active").alias("anomalies"))
    a = tables.attacks(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.max("magnitude").alias("worst"))
    rows = lambda d, s: d.select(*[F.col(c).cast("double").alias(c) for c in d.columns]).unpivot([], d.columns, "metric", "value").select(F.lit(s).alias("section"), "metric", "value")
    return rows(t, "traffic").unionByName(rows(a, "attacks"))


@query(f"WITH {PACKETS} SELECT src, round(100 - 100.0 * count(*) FILTER (attack) / count(*), 6) AS score FROM packets GROUP BY 1 HAVING 100 - 100.0 * count(*) FILTER (attack) / count(*) < 75 ORDER BY score, src LIMIT 20")
def worst_reputations(spark, sf_dir):
    s = tables.packets(spark, sf_dir).groupBy("src").agg((100 - 100.0 * F.count_if("attack") / F.count("*")).alias("score")).filter("score < 75")
    return op.top(s.select("src", r6("score")), 20, [F.asc("score"), F.asc("src")])


@query(f"WITH {PACKETS} SELECT src FROM packets WHERE proto = 6 EXCEPT SELECT src FROM packets WHERE attack AND length > 1000")
def benign_pool(spark, sf_dir):
    p = tables.packets(spark, sf_dir)
    return p.filter("proto = 6").select("src").subtract(p.filter("attack AND length > 1000").select("src"))


@query(f"WITH {PACKETS} SELECT corpus, count(*) AS n, sum(length) AS bytes FROM packets JOIN {values(SPELLINGS, 's(label, corpus)')} USING (label) GROUP BY 1")
def canonical_names(spark, sf_dir):
    """Counts by corpus, whatever its spelling."""
    s = spark.createDataFrame(SPELLINGS, "label string, corpus string")
    return tables.packets(spark, sf_dir).join(s, "label").groupBy("corpus").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query(f"WITH {ROLLUPS} SELECT epoch(ts)::BIGINT AS signature_id, CASE WHEN anomaly_level >= 4 THEN 'drop' ELSE 'rate_limit' END AS action, rx_pps * 2 AS threshold FROM rollups WHERE anomaly_level >= 2")
def generated_signatures(spark, sf_dir):
    """A signature for each anomaly of level two and more."""
    r = tables.rollups(spark, sf_dir).filter("anomaly_level >= 2")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts")
    return r.select(seconds.alias("signature_id"), F.when(F.col("anomaly_level") >= 4, "drop").otherwise("rate_limit").alias("action"), (F.col("rx_pps") * 2).alias("threshold"))


@query(f"""
WITH {SERIES}, r AS (SELECT label, w, n, sources, n / 4.0 AS ratio FROM series)
SELECT label, w, round(CASE WHEN ratio >= 1 THEN least(4 * log2(ratio + 1), 20) * CASE WHEN sources > 5 THEN 1.2 ELSE 1 END ELSE 0 END, 6) AS z FROM r
""")
def warm_up_emergency(spark, sf_dir):
    """A score before baselines are ready: the ratio to a fixed rate, logarithmic, more for many sources."""
    ratio = F.col("n") / 4.0
    z = F.when(ratio >= 1, F.least(4 * F.log2(ratio + 1), F.lit(20.0)) * F.when(F.col("sources") > 5, 1.2).otherwise(1.0)).otherwise(0.0)
    return series(spark, sf_dir).select("label", "w", F.round(z, 6).alias("z"))


@query(f"""
WITH RECURSIVE {SERIES}, {SLOTS}, {ewma_sql('', 0.15)}, u AS (SELECT label, w, z, row_number() OVER (PARTITION BY label ORDER BY abs(z) DESC, w) AS r FROM z)
SELECT label, w, round(z, 6) AS z, r AS rank FROM u WHERE r <= 8
""")
def triggered_windows(spark, sf_dir):
    """The eight windows of each label that deviate most."""
    t = tiers(spark, sf_dir).select("label", "w", F.col("z_immediate").alias("z"))
    return op.top_per(t, ["label"], 8, [F.desc(F.abs("z")), F.asc("w")]).select("label", "w", r6("z"), "rank")


@query(f"""
WITH RECURSIVE {SERIES}, f AS (SELECT label, w, i, CAST(bytes AS DOUBLE) AS m, 0 AS jumps, 0 AS frozen FROM series WHERE i = 1
    UNION ALL SELECT s.label, s.w, s.i, CASE WHEN f.frozen > 0 THEN f.m ELSE f.m + 0.3 * (s.bytes - f.m) END, CASE WHEN f.frozen > 0 THEN 0 WHEN s.bytes > 3 * f.m THEN f.jumps + 1 ELSE 0 END,
        CASE WHEN f.frozen > 0 THEN f.frozen - 1 WHEN s.bytes > 3 * f.m AND f.jumps + 1 >= 2 THEN 15 ELSE 0 END FROM f JOIN series s ON s.label = f.label AND s.i = f.i + 1)
SELECT label, w, round(m, 6) AS mean, frozen > 0 AS frozen FROM f
""")
def baseline_freeze(spark, sf_dir):
    """A mean that freezes for fifteen windows once two in a row are over three times it, and then recovers."""

    def step(state: tuple, x: float) -> tuple:
        mean, jumps, frozen = state
        if mean is None:
            mean = x
        elif frozen:
            jumps, frozen = 0, frozen - 1
        else:
            jumps = jumps + 1 if x > 3 * mean else 0
            mean, frozen = mean + 0.3 * (x - mean), 15 if jumps >= 2 else 0
        return (mean, jumps, frozen), (mean, float(frozen))

    out = recursions.fold(series(spark, sf_dir), ["label"], "w", F.col("bytes"), (None, 0, 0), step, ["mean", "frozen"])
    return out.select("label", "w", r6("mean"), (F.col("frozen") > 0).alias("frozen"))


@query(f"""
WITH RECURSIVE {SERIES}, g AS (SELECT label, w, i, n >= 6 AS open, CAST(n AS DOUBLE) AS n FROM series WHERE i = 1 UNION ALL SELECT s.label, s.w, s.i, CASE WHEN g.open THEN s.n >= 3 ELSE s.n >= 6 END, s.n FROM g JOIN series s ON s.label = g.label AND s.i = g.i + 1)
SELECT label, w, open FROM g
""".replace(", g AS (SELECT label, w, i, n >= 6", ", gate AS (SELECT label, w, i, n >= 6").replace("CASE WHEN g.open", "CASE WHEN gate.open").replace("FROM g JOIN series s ON s.label = g.label AND s.i = g.i + 1)\nSELECT label, w, open FROM g", "FROM gate JOIN series s ON s.label = gate.label AND s.i = gate.i + 1)\nSELECT label, w, open FROM gate"))
def hysteresis_gate(spark, sf_dir):
    """Opens at six and closes under three."""
    w = Window.partitionBy("label").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.when(F.col("n") >= 6, True).when(F.col("n") < 3, False)
    return series(spark, sf_dir).select("label", "w", F.coalesce(F.last(edge, ignorenulls=True).over(w), F.lit(False)).alias("open"))


@query(f"""
WITH RECURSIVE {SERIES}, d AS (SELECT *, (bytes - avg(bytes) OVER (PARTITION BY label)) / stddev_pop(bytes) OVER (PARTITION BY label) AS x FROM series),
c AS (SELECT label, i, greatest(0, x - 0.5) AS hi, greatest(0, -x - 0.5) AS lo FROM d WHERE i = 1 UNION ALL SELECT d.label, d.i, greatest(0, hi + x - 0.5), greatest(0, lo - x - 0.5) FROM c JOIN d ON d.label = c.label AND d.i = c.i + 1),
v AS (SELECT hi AS s FROM c UNION ALL SELECT lo FROM c)
SELECT least(greatest(ceil(quantile_cont(s, 0.99) * 2) / 2, 5), 50) AS h FROM v
""")
def cusum_calibration(spark, sf_dir):
    """The 99th percentile of both sums in deviations, up to the next half, from 5 to 50."""
    w = Window.partitionBy("label")
    d = series(spark, sf_dir).withColumn("x", (F.col("bytes") - F.avg("bytes").over(w)) / F.stddev_pop("bytes").over(w))
    sums = recursions.cusum(d, ["label"], "w", F.col("x"), F.lit(0.5)).select(F.explode(F.array("s_high", "s_low")).alias("s"))
    return sums.agg(clamp(F.ceil(F.percentile("s", F.lit(0.99)) * 2) / 2, 5.0, 50.0).alias("h"))


@query(f"""
WITH RECURSIVE {POT}, o AS (SELECT idx, victim, score, row_number() OVER (PARTITION BY victim ORDER BY idx) AS i FROM pot JOIN vectors USING (idx)), e AS (SELECT idx, victim, i, 0.5 * score AS s FROM o WHERE i = 1 UNION ALL SELECT o.idx, o.victim, o.i, 0.5 * o.score + 0.5 * e.s FROM e JOIN o ON o.victim = e.victim AND o.i = e.i + 1),
j AS (SELECT 'raw' AS arm, idx, round(score, 9) AS s FROM pot UNION ALL SELECT 'smoothed', idx, round(s, 9) FROM e), c AS (SELECT arm, s, count(*) AS n, count(*) FILTER (attack) AS pos FROM j JOIN vectors USING (idx) GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY arm ORDER BY s) - n + (n + 1) / 2 AS rank FROM c)
SELECT arm, round((sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auc FROM k GROUP BY arm
""")
def ewma_ablation(spark, sf_dir):
    """A detector's AUC with its scores as they are and smoothed along each victim's windows."""
    raw = peaks_over_threshold(long_form(matrix(spark, sf_dir), FEATURES)).join(tables.vectors(spark, sf_dir).select("idx", "victim"), "idx")
    smooth = recursions.ewma(raw, ["victim"], "idx", F.col("score"), 0.5, "score")
    both = raw.select("idx", "score", F.lit("raw").alias("arm")).unionByName(smooth.select("idx", "score", F.lit("smoothed").alias("arm")))
    judged = both.join(tables.vectors(spark, sf_dir).select("idx", "attack"), "idx").withColumn("score", F.round("score", 9))
    return evaluation.auc(judged, ["arm"], "score", "attack").select("arm", r6("auc"))

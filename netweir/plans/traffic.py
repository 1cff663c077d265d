"""Traffic, attack, tenant and report queries."""

from pyspark.sql import functions as F

from netweir.functions.traffic import cases, level
from netweir.operators import traffic as op
from netweir.operators.windows import window_features
from netweir.sources import tables

from .registry import query
from .views_sql import ATTACKS, FLOWS, PACKETS, ROLLUPS


@query(f"""
WITH {PACKETS}, c AS (SELECT dst, event_id, ts, sum(length) OVER (PARTITION BY dst ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 5000 AS counter FROM packets),
l AS (SELECT *, lag(counter) OVER (PARTITION BY dst ORDER BY ts, event_id) AS prev FROM c)
SELECT dst, event_id, counter, CASE WHEN prev > 0 AND counter >= prev THEN counter - prev ELSE 0 END AS delta FROM l
""")
def counter_deltas(spark, sf_dir):
    from pyspark.sql import Window

    p = tables.packets(spark, sf_dir)
    run = F.sum("length").over(Window.partitionBy("dst").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return op.deltas(p.select("dst", "event_id", "ts", (run % 5000).alias("counter")), "dst", ["ts", "event_id"], "counter").drop("ts")


@query(f"""
WITH {ROLLUPS} SELECT max(rx_pps) AS peak_pps, round(avg(rx_pps), 6) AS avg_pps, max(rx_bps) AS peak_bps, sum(rx_pps * 60) AS total_packets,
    sum(dropped_pps) AS total_dropped, count(*) AS samples, count(*) FILTER (anomaly_active) AS anomaly_samples,
    round(100.0 * count(*) FILTER (NOT anomaly_active) / count(*), 6) AS availability FROM rollups
""")
def traffic_summary(spark, sf_dir):
    return op.summary(tables.rollups(spark, sf_dir))


@query(f"""
WITH {ROLLUPS} SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS bucket, CAST(floor(avg(rx_pps)) AS BIGINT) AS rx_pps, CAST(floor(avg(rx_bps)) AS BIGINT) AS rx_bps,
    sum(dropped_pps) AS dropped, bool_or(anomaly_active) AS anomaly_active, max(anomaly_level) AS anomaly_level, max_by(protected_ip_count, ts) AS protected_ip_count
FROM rollups GROUP BY 1
""")
def traffic_history(spark, sf_dir):
    return op.history(tables.rollups(spark, sf_dir))


@query(f"""
WITH RECURSIVE {ROLLUPS}, n AS (SELECT epoch(ts) AS s, rx_pps, dropped_pps, row_number() OVER (ORDER BY ts) AS i FROM rollups),
a AS (SELECT i, s, s AS start FROM n WHERE i = 1 UNION ALL SELECT n.i, n.s, CASE WHEN n.s >= a.start + 36000 THEN n.s ELSE a.start END FROM a JOIN n ON n.i = a.i + 1)
SELECT make_timestamp(CAST(start * 1000000 AS BIGINT)) AS bucket, CAST(floor(sum(rx_pps) / count(*)) AS BIGINT) AS rx_pps, sum(dropped_pps) AS dropped, count(*) AS rows FROM a JOIN n USING (i) GROUP BY start
""")
def traffic_history_anchored(spark, sf_dir):
    return op.anchored_history(tables.rollups(spark, sf_dir), 36000)


@query(f"""
WITH {ATTACKS} SELECT attack_type, severity, count(*) AS n, count(*) FILTER (is_active) AS active, count(*) FILTER (is_mitigated) AS mitigated,
    round(avg(mitigation_ms) FILTER (mitigation_ms <> 0), 6) AS mean_mitigation_ms
FROM attacks GROUP BY GROUPING SETS ((), (attack_type), (severity))
""")
def attack_stats(spark, sf_dir):
    return op.attack_stats(tables.attacks(spark, sf_dir))


@query("""
SELECT 'o_orderstatus' AS key, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2
""")
def audit_stats(spark, sf_dir):
    return op.counts_by(tables.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_custkey")


@query(f"""
WITH {PACKETS}, f AS (SELECT dst, CAST(ts AS DATE) AS w, count(*) AS n, count(*) FILTER (proto = 6) AS tcp, count(*) FILTER (proto = 17) AS udp, count(*) FILTER (proto = 1) AS icmp FROM packets GROUP BY 1, 2),
s AS (SELECT sum(tcp) AS tcp, sum(udp) AS udp, sum(icmp) AS icmp, sum(n - tcp - udp - icmp) AS other, sum(n) AS n FROM f),
u AS (SELECT 'tcp' AS protocol, tcp AS packets, tcp * 500 AS bytes, n FROM s UNION ALL SELECT 'udp', udp, udp * 300, n FROM s UNION ALL SELECT 'icmp', icmp, icmp * 64, n FROM s UNION ALL SELECT 'other', other, other * 200, n FROM s)
SELECT protocol, packets, bytes, round(packets * 100.0 / n, 1) AS percent FROM u
""")
def protocol_breakdown(spark, sf_dir):
    return op.protocol_breakdown(window_features(tables.packets(spark, sf_dir)))


@query(f"""
WITH {ROLLUPS}, s AS (SELECT sum(dropped_pps) AS a, sum(drops_signature) AS b FROM rollups)
SELECT 'dropped_pps' AS reason, a AS dropped, round(a * 100.0 / (a + b), 2) AS percent FROM s UNION ALL SELECT 'drops_signature', b, round(b * 100.0 / (a + b), 2) FROM s
""")
def drop_reasons(spark, sf_dir):
    return op.drop_reasons(tables.rollups(spark, sf_dir), ["dropped_pps", "drops_signature"])


@query(f"""
WITH {ROLLUPS}, s AS (SELECT metric, CAST(coalesce(sum(v) FILTER (ts >= TIMESTAMP '2024-01-16'), 0) AS DOUBLE) AS now, CAST(coalesce(sum(v) FILTER (ts < TIMESTAMP '2024-01-16'), 0) AS DOUBLE) AS before
    FROM (SELECT ts, 'rx_pps' AS metric, rx_pps AS v FROM rollups UNION ALL SELECT ts, 'dropped_pps', dropped_pps FROM rollups) GROUP BY metric)
SELECT *, round(CASE WHEN before <> 0 THEN (now - before) / before * 100 ELSE 0 END, 2) AS change FROM s
""")
def period_comparison(spark, sf_dir):
    return op.compared(tables.rollups(spark, sf_dir), F.col("ts") >= F.lit("2024-01-16").cast("timestamp"), ["rx_pps", "dropped_pps"])


@query(f"""
WITH {ROLLUPS} SELECT CAST(ts AS DATE) AS day, round(100.0 * count(*) FILTER (anomaly_level < 4) / count(*), 4) AS availability,
    round(sum(dropped_pps) * 100.0 / greatest(sum(rx_pps), 1), 4) AS drop_percent, 100.0 * count(*) FILTER (anomaly_level < 4) / count(*) >= 99.9 AS met,
    max(rx_pps) AS peak_pps, arg_max(strftime(ts, '%H'), rx_pps * 100 - hour(ts)) AS peak_hour FROM rollups GROUP BY 1
""")
def sla_stats(spark, sf_dir):
    return op.sla(tables.rollups(spark, sf_dir))


@query(f"""
WITH {PACKETS}, s AS (SELECT src, count(*) AS packets, sum(length) AS bytes, count(*) FILTER (attack) AS bad FROM packets GROUP BY src)
SELECT src, packets, bytes, round(1 - least(bad / packets * 10 / 10, 1), 6) AS reputation FROM s ORDER BY packets DESC, src LIMIT 20
""")
def top_sources(spark, sf_dir):
    s = tables.packets(spark, sf_dir).groupBy("src").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.count_if("attack").alias("bad"))
    return op.top(s.select("src", "packets", "bytes", F.round(1 - F.least(F.col("bad") / F.col("packets"), F.lit(1.0)), 6).alias("reputation")), 20, [F.desc("packets"), F.asc("src")])


@query(f"""
WITH {PACKETS}, k AS (SELECT 'src' AS key, src AS id, count(*) AS packets, sum(length) AS bytes FROM packets GROUP BY src
    UNION ALL SELECT 'dst', dst, count(*), sum(length) FROM packets GROUP BY dst UNION ALL SELECT 'src_port', src_port, count(*), sum(length) FROM packets GROUP BY src_port
    UNION ALL SELECT 'dst_port', dst_port, count(*), sum(length) FROM packets GROUP BY dst_port)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY packets DESC, bytes DESC, id) AS rank FROM k) WHERE rank <= 10
""")
def heavy_hitters(spark, sf_dir):
    """The ten largest of four keys, counted in one pass."""
    keys = ("src", "dst", "src_port", "dst_port")
    p = tables.packets(spark, sf_dir)
    c = p.groupingSets([[k] for k in keys], *keys).agg(cases(*[(F.grouping(k) == 0, k) for k in keys]).alias("key"), F.coalesce(*[F.when(F.grouping(k) == 0, F.col(k)) for k in keys]).alias("id"), F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    return op.top_per(c.select("key", "id", "packets", "bytes"), ["key"], 10, [F.desc("packets"), F.desc("bytes"), F.asc("id")])


@query(f"""
WITH {PACKETS} SELECT w, dst, packets, bytes, rank FROM (SELECT CAST(ts AS DATE) AS w, dst, count(*) AS packets, sum(length) AS bytes, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY sum(length) DESC, dst) AS rank FROM packets GROUP BY 1, 2) WHERE rank <= 3
""")
def top_talkers_per_window(spark, sf_dir):
    g = tables.packets(spark, sf_dir).groupBy(F.to_date("ts").alias("w"), "dst").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    return op.top_per(g, ["w"], 3, [F.desc("bytes"), F.asc("dst")])


@query(f"""
WITH {ATTACKS} SELECT attack_id, target, attack_type, severity, started_at FROM attacks WHERE is_active AND severity IN ('1-URGENT', '2-HIGH') ORDER BY started_at DESC, attack_id LIMIT 25 OFFSET 25
""")
def attack_list_page(spark, sf_dir):
    a = tables.attacks(spark, sf_dir).filter(F.col("is_active") & F.col("severity").isin("1-URGENT", "2-HIGH"))
    return op.page(a.select("attack_id", "target", "attack_type", "severity", "started_at"), [F.desc("started_at"), F.asc("attack_id")], 2, 25)


@query(f"""
WITH {ATTACKS} SELECT attack_type, count(DISTINCT c_nationkey) AS tenants, count(*) AS n FROM attacks JOIN customer ON c_custkey = target GROUP BY 1 HAVING count(DISTINCT c_nationkey) >= 5
""")
def shared_signatures(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), "c_nationkey")
    return op.shared(tables.attacks(spark, sf_dir).join(c, "target"), "attack_type", "c_nationkey", 5)


@query(f"""
WITH {ATTACKS}, c AS (SELECT c_nationkey AS t, date_trunc('month', started_at) AS b, count(*) AS x FROM attacks JOIN customer ON c_custkey = target GROUP BY 1, 2),
g AS (SELECT t, b, coalesce(x, 0) AS x FROM (SELECT DISTINCT t FROM c) CROSS JOIN (SELECT DISTINCT b FROM c) LEFT JOIN c USING (t, b))
SELECT a.t AS t1, z.t AS t2, round(corr(a.x, z.x), 6) + 0.0 AS correlation FROM g a JOIN g z ON a.b = z.b AND a.t < z.t GROUP BY 1, 2
""")
def tenant_correlation(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), "c_nationkey")
    return op.correlated(tables.attacks(spark, sf_dir).join(c, "target"), "c_nationkey", F.date_trunc("month", "started_at"))


@query(f"""
WITH {FLOWS} SELECT CASE WHEN percent_ > 0 THEN percent_ END AS percentile FROM (SELECT min(ub) AS percent_ FROM (
    SELECT ub, sum(n) OVER (ORDER BY ub) AS run, sum(n) OVER () AS total FROM (SELECT CASE WHEN bytes <= 1000 THEN 1000.0 WHEN bytes <= 10000 THEN 10000.0 WHEN bytes <= 50000 THEN 50000.0 ELSE 100000.0 END AS ub, count(*) AS n FROM flows GROUP BY 1)) WHERE run >= total * 0.95)
""")
def histogram_percentile(spark, sf_dir):
    return op.histogram_percentile(tables.flows(spark, sf_dir), F.col("bytes"), [1000.0, 10000.0, 50000.0, 100000.0], 0.95)


@query(f"""
WITH {FLOWS} SELECT proto, round(quantile_cont(bytes, 0.5), 6) AS p50, round(quantile_cont(bytes, 0.95), 6) AS p95, round(min(bytes), 6) AS least, round(avg(bytes), 4) AS mean, round(stddev_pop(bytes), 4) AS sd,
    round(avg((bytes - m) ** 3) / pow(avg((bytes - m) ** 2), 1.5), 6) AS skew, mode_packets
FROM (SELECT *, avg(bytes) OVER (PARTITION BY proto) AS m FROM flows) JOIN (SELECT proto, packets AS mode_packets FROM (SELECT proto, packets, row_number() OVER (PARTITION BY proto ORDER BY count(*) DESC, packets) AS r FROM flows GROUP BY 1, 2) WHERE r = 1) USING (proto) GROUP BY proto, mode_packets
""")
def flow_moments(spark, sf_dir):
    f = tables.flows(spark, sf_dir)
    mode = f.groupBy("proto", "packets").count().groupBy("proto").agg(F.min_by("packets", F.struct(-F.col("count"), "packets")).alias("mode_packets"))
    stats = f.groupBy("proto").agg(F.round(F.min("bytes"), 6).alias("least"), F.round(F.avg("bytes"), 4).alias("mean"), F.round(F.stddev_pop("bytes"), 4).alias("sd"), F.round(F.skewness("bytes"), 6).alias("skew"))
    ranks = op.quantiles(f, ["proto"], "bytes", {"p50": 0.5, "p95": 0.95}).select("proto", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    return ranks.join(stats, "proto").join(mode, "proto")


@query(f"""
WITH {PACKETS}, s AS (SELECT src, round(100 - 100.0 * count(*) FILTER (attack) / count(*), 6) AS score FROM packets GROUP BY src)
SELECT CASE WHEN score >= 80 THEN 'trusted' WHEN score >= 60 THEN 'neutral' WHEN score >= 40 THEN 'suspicious' WHEN score >= 20 THEN 'poor' ELSE 'malicious' END AS category,
    CAST(least(floor(score / 20), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean FROM s GROUP BY 1, 2
""")
def reputation_stats(spark, sf_dir):
    s = tables.packets(spark, sf_dir).groupBy("src").agg(F.round(100 - 100.0 * F.count_if("attack") / F.count("*"), 6).alias("score"))
    name = level(F.col("score"), [(80, "trusted"), (60, "neutral"), (40, "suspicious"), (20, "poor")], "malicious")
    return s.groupBy(name.alias("category"), F.least(F.floor(F.col("score") / 20), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("""
SELECT n_name AS tenant, r_name AS organization, count(*) AS members, round(sum(c_acctbal), 2) AS balance, count(*) FILTER (c_acctbal < 0) AS over_quota
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def tenant_stats(spark, sf_dir):
    t = lambda n: tables.table(spark, sf_dir, n)
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup(F.col("r_name").alias("organization"), F.col("n_name").alias("tenant")).agg(F.count("*").alias("members"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count_if(F.col("c_acctbal") < 0).alias("over_quota"))


@query(f"""
WITH {ATTACKS}, m AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY started_at, attack_id) AS r FROM attacks)
SELECT target, attack_id, started_at FROM m WHERE r = 1 ORDER BY started_at, target LIMIT 50
""")
def first_targets(spark, sf_dir):
    """The first fifty distinct targets by time."""
    first = op.top_per(tables.attacks(spark, sf_dir), ["target"], 1, [F.asc("started_at"), F.asc("attack_id")])
    return op.top(first.select("target", "attack_id", "started_at"), 50, [F.asc("started_at"), F.asc("target")])


@query(f"""
WITH {ATTACKS}, {PACKETS}, a AS (SELECT 'attack' AS kind, attack_id AS id, started_at AS seen_at FROM attacks UNION ALL SELECT 'packet', event_id, ts FROM packets)
SELECT kind, id, seen_at FROM a WHERE seen_at >= TIMESTAMP '2024-01-01' ORDER BY seen_at, kind, id LIMIT 500
""")
def merged_stream(spark, sf_dir):
    a = tables.attacks(spark, sf_dir).select(F.lit("attack").alias("kind"), F.col("attack_id").alias("id"), F.col("started_at").alias("seen_at"))
    p = tables.packets(spark, sf_dir).select(F.lit("packet").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("seen_at"))
    return op.top(a.unionByName(p).filter(F.col("seen_at") >= F.lit("2024-01-01").cast("timestamp")), 500, [F.asc("seen_at"), F.asc("kind"), F.asc("id")])

"""Filter, policy, signature, verdict and lookup queries."""

from pyspark.sql import functions as F

from netweir.functions.traffic import ip_number, ip_text, network, swapped
from netweir.operators import filters, lookups
from netweir.sources import tables

from .registry import query
from .views_sql import ATTACKS, PACKETS

#: Fixed rows of small dimension tables, the same in Spark and SQL.
POLICIES = ((1, 10, 6, 0, "RATE_LIMIT"), (2, 20, 0, 7, "DROP"), (3, 5, 17, 3, "DROP"), (4, 30, 47, 0, "DROP"))
PREFIXES = ((8, 10 << 24, "ten"), (16, (10 << 24) + (3 << 16), "ten-three"), (24, (10 << 24) + (3 << 16) + (7 << 8), "office"), (12, (172 << 24) + (16 << 16), "private"))
RANGES = ((10 << 24, (10 << 24) + 200000, "AA"), ((10 << 24) + 200001, (10 << 24) + 262143, "BB"), ((10 << 24) + 300000, (11 << 24) + 5, "CC"))
FEEDS = (("alpha", "HTTPS://THTHER.example.org", "low"), ("beta", "https://thther.example.org", "low"), ("gamma", "https://thther.example.org", "medium"), ("alpha", "http://x.invalid", "critical"), ("beta", "http://therha.example.com", "critical"), ("gamma", "HTTP://therha.example.com", "low"))
ENTRIES = ((1, 5, "black", None), (2, 5, "white", None), (3, 9, "white", "2024-01-10 00:00:00"), (4, 11, "black", "2024-02-01 00:00:00"), (5, 30, "white", None), (6, 30, "black", "2020-01-01 00:00:00"))
SCHEDULE = (("2024-01-02 03:00:00", "2024-01-02 09:30:00", "dns"), ("2024-01-05 00:00:00", "2024-01-07 12:00:00", "syn"), ("2024-01-06 00:00:00", "2024-01-06 06:00:00", "ntp"))


def values(rows, names: str) -> str:
    lit = lambda v: "NULL" if v is None else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") {names}"


#: An address for every packet.
IP = "(10 << 24) + (src % 8) * 65536 + (event_id * 131) % 65536"


def addressed(spark, sf_dir):
    return tables.packets(spark, sf_dir).withColumn("ip", F.lit(10 << 24) + (F.col("src") % 8) * 65536 + (F.col("event_id") * 131) % 65536)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority ILIKE '%urgent%' AND o_totalprice >= 100000 AND o_orderstatus IN ('O', 'P') AND o_orderkey <> 1")
def filter_dsl(spark, sf_dir):
    rows = filters.where(tables.table(spark, sf_dir, "orders"), o_orderpriority__ilike="%urgent%", o_totalprice__gte=100000, o_orderstatus__in=["O", "P"], o_orderkey__ne=1, o_custkey=None, nothing__gt=3)
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {PACKETS} SELECT event_id, label, length, proto FROM packets WHERE label IN ('click', 'error') AND length > 100 AND regexp_matches(CAST(src_port AS VARCHAR), '^[1-4]') AND proto <> 47")
def policy_conditions(spark, sf_dir):
    p = tables.packets(spark, sf_dir)
    rules = [("label", "in", ["click", "error"]), ("length", "gt", 100), ("src_port", "matches", "[1-4]"), ("proto", "ne", 47)]
    return p.filter(filters.all_conditions(p, rules)).select("event_id", "label", "length", "proto")


SIGNATURE = f"""CASE WHEN proto = 17 AND src_port IN {filters.AMPLIFIERS} AND length >= 100 THEN 'amplification' WHEN proto = 6 AND flags = 0 THEN 'null_scan'
    WHEN proto = 6 AND flags & 41 = 41 THEN 'xmas_scan' WHEN proto = 6 AND flags & 3 = 3 THEN 'syn_fin' WHEN proto = 6 AND flags & 6 = 6 THEN 'syn_rst' WHEN ttl < 5 THEN 'low_ttl'
    WHEN proto = 6 AND flags & 18 = 2 AND length <= 60 THEN 'syn_scan' WHEN proto = 6 AND flags = 1 THEN 'fin_scan' WHEN proto = 17 AND length <= 28 THEN 'udp_scan'
    WHEN proto = 6 AND length IN (40, 60, 1200) THEN 'tool' WHEN proto = 47 THEN 'gre' END"""


@query(f"WITH {PACKETS} SELECT event_id, {SIGNATURE} AS signature FROM packets")
def signature_match(spark, sf_dir):
    return tables.packets(spark, sf_dir).select("event_id", filters.signature().alias("signature"))


@query(f"WITH {PACKETS} SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS epoch, src, count(DISTINCT dst_port) AS ports FROM packets GROUP BY 1, 2 HAVING count(DISTINCT dst_port) >= 2")
def scan_tracker(spark, sf_dir):
    return filters.scan_sources(tables.packets(spark, sf_dir), 2)


@query(f"""
WITH {PACKETS}, l AS (SELECT *, lag(length) OVER w AS prev, lag(src_port) OVER w AS prev_port FROM packets WHERE proto = 6 WINDOW w AS (PARTITION BY src, dst ORDER BY ts, event_id))
SELECT src, dst, count(*) AS segments, count(*) FILTER (length = prev) AS same_length, count(*) FILTER (abs(src_port - prev_port) > 30000) AS port_jumps, count(*) FILTER (length < 100) AS tiny,
    count(*) FILTER (length = prev) >= 1 OR count(*) FILTER (length < 100) >= 3 AS abusive FROM l GROUP BY src, dst
""")
def tcp_abuse(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("src", "dst").orderBy("ts", "event_id")
    l = tables.packets(spark, sf_dir).filter("proto = 6").withColumns({"prev": F.lag("length").over(w), "prev_port": F.lag("src_port").over(w)})
    same, tiny = F.count_if(F.col("length") == F.col("prev")), F.count_if(F.col("length") < 100)
    return l.groupBy("src", "dst").agg(F.count("*").alias("segments"), same.alias("same_length"), F.count_if(F.abs(F.col("src_port") - F.col("prev_port")) > 30000).alias("port_jumps"), tiny.alias("tiny"), ((same >= 1) | (tiny >= 3)).alias("abusive"))


@query(f"""
WITH {PACKETS}, f AS (SELECT event_id, ttl, (event_id * 512) % 65536 AS window_size, CASE event_id % 5 WHEN 0 THEN 1460 WHEN 1 THEN 0 WHEN 2 THEN 400 ELSE 1380 END AS mss FROM packets),
g AS (SELECT *, CASE WHEN ttl <= 32 THEN 32 WHEN ttl <= 64 THEN 64 WHEN ttl <= 128 THEN 128 ELSE 255 END AS t0 FROM f)
SELECT CASE WHEN mss = 0 THEN 'tool' WHEN window_size IN (512, 1024, 2048) AND mss < 536 THEN 'tool' WHEN window_size = 0 THEN 'anomaly' WHEN t0 = 64 AND mss = 1460 THEN 'unix' WHEN t0 = 64 THEN 'unix_tunnel'
    WHEN t0 = 128 AND window_size >= 8192 THEN 'windows' WHEN t0 = 128 THEN 'windows_old' WHEN t0 = 255 THEN 'network_device' ELSE 'unknown' END AS family, count(*) AS n FROM g GROUP BY 1
""")
def tcp_fingerprint(spark, sf_dir):
    p = tables.packets(spark, sf_dir).withColumns({"window_size": (F.col("event_id") * 512) % 65536, "mss": F.when(F.col("event_id") % 5 == 0, 1460).when(F.col("event_id") % 5 == 1, 0).when(F.col("event_id") % 5 == 2, 400).otherwise(1380)})
    return p.groupBy(filters.fingerprint(F.col("ttl"), F.col("window_size"), F.col("mss")).alias("family")).agg(F.count("*").alias("n"))


@query(f"""
WITH {PACKETS}, a AS (SELECT event_id, {IP} AS ip FROM packets), pre AS (SELECT * FROM {values(PREFIXES, "t(len, net, tag)")}),
m AS (SELECT event_id, net, len, tag, row_number() OVER (PARTITION BY event_id ORDER BY len DESC) AS r FROM a JOIN pre ON (ip >> (32 - len)) = (net >> (32 - len)))
SELECT event_id, ip, net, len, tag FROM a LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (event_id)
""")
def prefix_match(spark, sf_dir):
    pre = spark.createDataFrame(PREFIXES, "len int, net long, tag string")
    return lookups.longest_prefix(addressed(spark, sf_dir).select("event_id", "ip"), pre)


@query(f"""
WITH {PACKETS}, a AS (SELECT event_id, {IP} AS ip FROM packets), g AS (SELECT * FROM {values(RANGES, "t(first, last, tag)")})
SELECT event_id, ip, tag, CASE WHEN tag IS NULL THEN true ELSE tag IN ('BB', 'CC') END AS blocked FROM a LEFT JOIN g ON ip BETWEEN first AND last
""")
def geo_lookup(spark, sf_dir):
    g = spark.createDataFrame(RANGES, "first long, last long, tag string")
    out = lookups.in_ranges(addressed(spark, sf_dir).select("event_id", "ip"), g)
    return out.withColumn("blocked", lookups.geo_blocked(F.col("tag"), ["BB", "CC"], "deny", True))


@query(f"""
WITH {PACKETS}, e AS (SELECT * FROM {values(ENTRIES, "t(entry_id, src, list_type, expires_at)")}),
h AS (SELECT src, list_type, entry_id, row_number() OVER (PARTITION BY src ORDER BY list_type, entry_id) AS r FROM e WHERE expires_at IS NULL OR CAST(expires_at AS TIMESTAMP) > TIMESTAMP '2024-01-15')
SELECT event_id, p.src, list_type, entry_id FROM packets p LEFT JOIN (SELECT * FROM h WHERE r = 1) h ON h.src = p.src
""")
def list_check(spark, sf_dir):
    e = spark.createDataFrame(ENTRIES, "entry_id int, src long, list_type string, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    return lookups.list_hit(tables.packets(spark, sf_dir).select("event_id", "src"), e, F.lit("2024-01-15").cast("timestamp"))


@query(f"""
WITH {PACKETS}, a AS (SELECT event_id, src, {IP} AS ip FROM packets), pre AS (SELECT * FROM {values(PREFIXES[2:3], "t(len, net, tag)")}),
f AS (SELECT event_id, ip, ip % 13 = 0 OR EXISTS (SELECT 1 FROM pre WHERE (ip >> (32 - len)) = (net >> (32 - len))) AS w, ip % 7 = 0 AS b FROM a)
SELECT event_id, ip, CASE WHEN w THEN 'whitelisted' WHEN b THEN 'blacklisted' ELSE 'default' END AS verdict, w AND b AS conflict FROM f
""")
def list_verdict(spark, sf_dir):
    a = addressed(spark, sf_dir).select("event_id", "ip")
    ips = a.select("ip").distinct()
    return lookups.list_verdict(a, ips.filter("ip % 13 = 0"), ips.filter("ip % 7 = 0"), spark.createDataFrame(PREFIXES[2:3], "len int, net long, tag string"))


@query(f"""
WITH v AS (SELECT DISTINCT regexp_extract(url, '^([^/]*//[^/]*)', 1) AS value FROM pages), f AS (SELECT feed, lower(indicator) AS k, bool_or(severity = 'critical') AS worst FROM {values(FEEDS, "t(feed, indicator, severity)")} GROUP BY 1, 2)
SELECT value, count(feed) AS matches, CASE WHEN count(feed) >= 3 THEN 'critical' WHEN bool_or(worst) THEN 'high' WHEN count(feed) > 0 THEN 'medium' ELSE 'none' END AS threat FROM v LEFT JOIN f ON k = lower(value) GROUP BY value
""")
def indicator_check(spark, sf_dir):
    v = tables.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^([^/]*//[^/]*)", 1).alias("value")).distinct()
    return lookups.indicator_threat(v, spark.createDataFrame(FEEDS, "feed string, indicator string, severity string"))


@query(r"""
WITH v AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '//([^/]*)', 1) WHEN 2 THEN md5(url) WHEN 3 THEN sha256(url) WHEN 4 THEN '10.0.' || (page_id % 256) || '.1' ELSE 'a' || page_id || '@x.org' END AS value FROM pages)
SELECT page_id, CASE WHEN regexp_matches(value, '^\d{1,3}(\.\d{1,3}){3}$') THEN 'ip' WHEN regexp_matches(value, '^\d{1,3}(\.\d{1,3}){3}/\d{1,2}$') THEN 'cidr' WHEN regexp_matches(value, '^[a-fA-F0-9]{32}$') THEN 'md5' WHEN regexp_matches(value, '^[a-fA-F0-9]{64}$') THEN 'sha256'
    WHEN regexp_matches(value, '^https?://') THEN 'url' WHEN regexp_matches(value, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email' WHEN regexp_matches(value, '^([a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}$') THEN 'domain' ELSE 'unknown' END AS kind FROM v
""")
def indicator_types(spark, sf_dir):
    k = F.col("page_id") % 6
    value = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_extract("url", "//([^/]*)", 1)).when(k == 2, F.md5("url")).when(k == 3, F.sha2("url", 256)).when(k == 4, F.concat(F.lit("10.0."), (F.col("page_id") % 256).cast("string"), F.lit(".1"))).otherwise(F.concat(F.lit("a"), F.col("page_id").cast("string"), F.lit("@x.org")))
    return tables.table(spark, sf_dir, "pages").select("page_id", lookups.indicator_type(value).alias("kind"))


@query(f"""
WITH {PACKETS}, s AS (SELECT CAST(a AS TIMESTAMP) AS start, CAST(b AS TIMESTAMP) AS stop, c AS attack_label FROM {values(SCHEDULE, "t(a, b, c)")}),
m AS (SELECT event_id, attack_label, row_number() OVER (PARTITION BY event_id ORDER BY start, attack_label) AS r FROM packets JOIN s ON ts BETWEEN start AND stop)
SELECT event_id, ts, attack_label FROM packets LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (event_id)
""")
def schedule_labels(spark, sf_dir):
    s = spark.createDataFrame(SCHEDULE, "start string, stop string, attack_label string").withColumns({c: F.col(c).cast("timestamp") for c in ("start", "stop")})
    return lookups.by_schedule(tables.packets(spark, sf_dir).select("event_id", "ts"), s)


@query(f"""
WITH {PACKETS}, w AS (SELECT dst, hour(ts) AS hour_slot, (isodow(ts) - 1) * 24 + hour(ts) AS week_slot, length FROM packets), h AS (SELECT dst, hour_slot, avg(length) AS m FROM w GROUP BY ALL)
SELECT w.dst, w.week_slot, count(*) AS n, round(avg(length), 6) AS mean, round(avg(m), 6) AS hourly FROM w JOIN h USING (dst, hour_slot) GROUP BY 1, 2
""")
def baseline_slots(spark, sf_dir):
    w = tables.packets(spark, sf_dir).withColumns(lookups.slots(F.col("ts"))).select("dst", "hour_slot", "week_slot", "length")
    h = w.groupBy("dst", "hour_slot").agg(F.avg("length").alias("m"))
    return w.join(h, ["dst", "hour_slot"]).groupBy("dst", "week_slot").agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean"), F.round(F.avg("m"), 6).alias("hourly"))


@query(f"WITH {ATTACKS} SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT target FROM attacks WHERE is_active) AND c_custkey NOT IN (SELECT target FROM attacks WHERE is_mitigated)")
def exposed_targets(spark, sf_dir):
    a = tables.attacks(spark, sf_dir).withColumnRenamed("target", "c_custkey")
    c = tables.table(spark, sf_dir, "customer").select("c_custkey").distinct()
    return c.join(a.filter("is_active"), "c_custkey", "left_semi").join(a.filter("is_mitigated"), "c_custkey", "left_anti")


@query(f"WITH {ATTACKS} SELECT n_name, count(*) AS n, max(magnitude) AS worst FROM attacks JOIN customer ON c_custkey = target JOIN nation ON n_nationkey = c_nationkey WHERE is_active GROUP BY 1")
def tenant_attacks(spark, sf_dir):
    t = lambda n: tables.table(spark, sf_dir, n)
    a = tables.attacks(spark, sf_dir).filter("is_active")
    return a.join(t("customer"), F.col("target") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.max("magnitude").alias("worst"))


@query(f"""
WITH {PACKETS}, a AS (SELECT event_id, {IP} AS ip FROM packets)
SELECT event_id, (ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) AS text, ip AS again,
    ((ip & 255) << 24) + (((ip >> 8) & 255) << 16) + (((ip >> 16) & 255) << 8) + (ip >> 24) AS swapped, (ip >> 12) << 12 AS net FROM a
""")
def address_forms(spark, sf_dir):
    a = addressed(spark, sf_dir)
    return a.select("event_id", ip_text("ip").alias("text"), ip_number(ip_text("ip")).alias("again"), swapped("ip").alias("swapped"), network("ip", 20).alias("net"))


@query(f"WITH {PACKETS} SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, proto, count(*) AS n FROM packets GROUP BY ALL")
def bidirectional_flows(spark, sf_dir):
    return tables.packets(spark, sf_dir).groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "proto").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT vec_id, embedding[1] AS f1, 0.0 AS f2, CASE WHEN vec_id % 1000 = 0 THEN 1 ELSE 5 END AS f3, embedding[4] AS f4 FROM embeddings)
SELECT name, CAST(least AS DOUBLE) AS least, CAST(most AS DOUBLE) AS most FROM (SELECT 'f1' AS name, min(f1) AS least, max(f1) AS most FROM m UNION ALL SELECT 'f3', min(f3), max(f3) FROM m UNION ALL SELECT 'f4', min(f4), max(f4) FROM m)
""")
def active_features(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    m = e.select(F.get("embedding", F.lit(0)).alias("f1"), F.lit(0.0).alias("f2"), F.when(F.col("vec_id") % 1000 == 0, 1).otherwise(5).alias("f3"), F.get("embedding", F.lit(3)).alias("f4"))
    keep = filters.active_features(m, ["f4", "f1", "f2", "f3", "missing"])
    return m.agg(*[F.struct(F.min(f).cast("double").alias("least"), F.max(f).cast("double").alias("most")).alias(f) for f in keep]).select(F.inline(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f"{f}.least"), F.col(f"{f}.most")) for f in keep])))

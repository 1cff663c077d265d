"""Rules from tables, and the whole order of stages that decides on a packet."""

from pyspark.sql import functions as F

from netweir.operators import cascade as op
from netweir.operators import filters, lookups, rules
from netweir.sources import tables

from .lookups import IP, POLICIES, RANGES, SIGNATURE, addressed, values
from .registry import query
from .views_sql import PACKETS

NOW = "2024-01-15"
#: A rule for every part: prefixes, ranges, masks, some disabled and some expired.
RULES = f"""rules AS (SELECT p_partkey AS rule_id, (p_partkey * 7919) % 1000 AS priority, CASE p_partkey % 5 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'RATE_LIMIT' ELSE 'DROP' END AS action,
    CASE p_partkey % 6 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 END AS proto,
    CASE p_partkey % 4 WHEN 0 THEN (10::BIGINT << 24) + ((p_partkey % 8) << 16) WHEN 1 THEN (10::BIGINT << 24) + ((p_partkey % 8) << 16) + (((p_partkey * 37) % 256) << 8) END AS src, CASE p_partkey % 4 WHEN 0 THEN 16 WHEN 1 THEN 24 END AS src_len,
    CASE WHEN p_partkey % 7 = 0 THEN (p_partkey * 31) % 150 END AS dst,
    CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 13) % 100 END AS dst_port_lo, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 13) % 100 + p_partkey % 20 END AS dst_port_hi,
    CASE WHEN p_partkey % 3 = 1 THEN (p_partkey * 97) % 60000 END AS src_port_lo, CASE WHEN p_partkey % 3 = 1 THEN (p_partkey * 97) % 60000 + (p_partkey * 5) % 4096 END AS src_port_hi,
    CASE WHEN p_partkey % 2 = 1 THEN 300 END AS length_lo, CASE WHEN p_partkey % 2 = 1 THEN 300 + p_partkey % 400 END AS length_hi,
    CASE WHEN p_partkey % 9 = 4 THEN 64 END AS ttl_lo, CASE WHEN p_partkey % 9 = 4 THEN 128 END AS ttl_hi,
    CASE WHEN p_partkey % 10 = 3 THEN 18 WHEN p_partkey % 10 = 6 THEN 1 END AS flags_mask, CASE WHEN p_partkey % 10 = 3 THEN 2 WHEN p_partkey % 10 = 6 THEN 1 END AS flags_value,
    p_partkey % 13 <> 0 AS enabled, CASE WHEN p_partkey % 11 = 0 THEN TIMESTAMP '2024-01-01' WHEN p_partkey % 11 = 1 THEN TIMESTAMP '2024-06-01' END AS expires_at FROM part)"""


def rule_table(spark, sf_dir):
    k = F.col("p_partkey")
    when = lambda c, x: F.when(c, x if not isinstance(x, int) else F.lit(x))
    net = F.lit(10 << 24) + (k % 8) * 65536
    return tables.table(spark, sf_dir, "part").select(
        k.alias("rule_id"),
        ((k * 7919) % 1000).alias("priority"),
        F.when(k % 5 == 0, "ALLOW").when(k % 5 == 1, "RATE_LIMIT").otherwise("DROP").alias("action"),
        F.when(k % 6 == 0, 6).when(k % 6 == 1, 17).when(k % 6 == 2, 1).alias("proto"),
        F.when(k % 4 == 0, net).when(k % 4 == 1, net + ((k * 37) % 256) * 256).alias("src"),
        F.when(k % 4 == 0, 16).when(k % 4 == 1, 24).alias("src_len"),
        when(k % 7 == 0, (k * 31) % 150).alias("dst"),
        when(k % 3 == 0, (k * 13) % 100).alias("dst_port_lo"),
        when(k % 3 == 0, (k * 13) % 100 + k % 20).alias("dst_port_hi"),
        when(k % 3 == 1, (k * 97) % 60000).alias("src_port_lo"),
        when(k % 3 == 1, (k * 97) % 60000 + (k * 5) % 4096).alias("src_port_hi"),
        when(k % 2 == 1, 300).alias("length_lo"),
        when(k % 2 == 1, F.lit(300) + k % 400).alias("length_hi"),
        when(k % 9 == 4, 64).alias("ttl_lo"),
        when(k % 9 == 4, 128).alias("ttl_hi"),
        F.when(k % 10 == 3, 18).when(k % 10 == 6, 1).alias("flags_mask"),
        F.when(k % 10 == 3, 2).when(k % 10 == 6, 1).alias("flags_value"),
        (k % 13 != 0).alias("enabled"),
        F.when(k % 11 == 0, F.lit("2024-01-01").cast("timestamp")).when(k % 11 == 1, F.lit("2024-06-01").cast("timestamp")).alias("expires_at"),
    )


MATCHES = f"""a AS (SELECT *, {IP} AS ip FROM packets), live AS (SELECT * FROM rules WHERE enabled AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')),
m AS (SELECT event_id, rule_id, action, row_number() OVER (PARTITION BY event_id ORDER BY priority, rule_id) AS r FROM a p JOIN live r ON (r.proto IS NULL OR r.proto = p.proto) AND (r.src IS NULL OR (p.ip >> (32 - r.src_len)) = (r.src >> (32 - r.src_len))) AND (r.dst IS NULL OR r.dst = p.dst)
    AND (r.dst_port_lo IS NULL OR p.dst_port BETWEEN r.dst_port_lo AND r.dst_port_hi) AND (r.src_port_lo IS NULL OR p.src_port BETWEEN r.src_port_lo AND r.src_port_hi) AND (r.length_lo IS NULL OR p.length BETWEEN r.length_lo AND r.length_hi)
    AND (r.ttl_lo IS NULL OR p.ttl BETWEEN r.ttl_lo AND r.ttl_hi) AND (r.flags_mask IS NULL OR p.proto <> 6 OR p.flags & r.flags_mask = r.flags_value & r.flags_mask))"""


def matched(spark, sf_dir):
    p = addressed(spark, sf_dir).withColumnRenamed("src", "source").withColumnRenamed("ip", "src")
    return rules.first_match(p, rules.live(rule_table(spark, sf_dir), F.lit(NOW).cast("timestamp")))


@query(f"WITH {PACKETS}, {RULES}, {MATCHES} SELECT event_id, rule_id, coalesce(action, 'ALLOW') AS action FROM packets LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (event_id)")
def rule_matches(spark, sf_dir):
    """The first live rule of each packet, of thousands with prefixes, port and size ranges, flag masks and expiry."""
    return matched(spark, sf_dir).select("event_id", "rule_id", "action")


@query(f"WITH {PACKETS}, {RULES}, {MATCHES} SELECT rule_id, any_value(r.action) AS action, count(m.event_id) AS hits FROM live r LEFT JOIN (SELECT * FROM m WHERE r = 1) m USING (rule_id) GROUP BY 1")
def rule_hits(spark, sf_dir):
    """How many packets each live rule decided, rules without any included."""
    hits = matched(spark, sf_dir).filter("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("hits"))
    table = rules.live(rule_table(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("rule_id", "action")
    return table.join(hits, "rule_id", "left").select("rule_id", "action", F.coalesce("hits", F.lit(0)).alias("hits"))


@query(f"""
WITH {PACKETS}, pol AS (SELECT * FROM {values(POLICIES, "t(policy_id, priority, proto, dst_port, action)")}),
m AS (SELECT event_id, policy_id, action, row_number() OVER (PARTITION BY event_id ORDER BY priority, policy_id) AS r FROM packets p JOIN pol ON (pol.proto = 0 OR pol.proto = p.proto) AND (pol.dst_port = 0 OR pol.dst_port = p.dst_port))
SELECT event_id, p.proto, p.dst_port, policy_id, coalesce(action, 'ALLOW') AS action FROM packets p LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (event_id)
""")
def policy_lookup(spark, sf_dir):
    """Policies whose zero matches anything, as rules."""
    pol = spark.createDataFrame(POLICIES, "rule_id int, priority int, proto int, dst_port long, action string")
    any_ = lambda c: F.when(F.col(c) != 0, F.col(c))
    table = pol.select("rule_id", "priority", "action", any_("proto").alias("proto"), any_("dst_port").alias("dst_port_lo"), any_("dst_port").alias("dst_port_hi"))
    out = rules.first_match(tables.packets(spark, sf_dir), table)
    return out.select("event_id", "proto", "dst_port", F.col("rule_id").cast("int").alias("policy_id"), "action")


def _counted(name: str, before: str, when: str, keys: str, most: int, reason: str) -> str:
    """SQL of a limit: the n-th of those that are left."""
    return f"{name} AS (SELECT * EXCLUDE (nth), CASE WHEN alive AND ({when}) AND nth > {most} THEN {reason} ELSE reason END AS reason2, alive AND NOT (({when}) AND nth > {most}) AS alive2 FROM (SELECT *, CASE WHEN alive AND ({when}) THEN row_number() OVER (PARTITION BY alive AND ({when}), {keys} ORDER BY ts, event_id) END AS nth FROM {before})), {name}x AS (SELECT * EXCLUDE (reason, alive, reason2, alive2), reason2 AS reason, alive2 AS alive FROM {name})"


DAY = "CAST(ts AS DATE)"
KIND = "CASE WHEN flags & 18 = 2 THEN 'syn' WHEN flags & 4 = 4 THEN 'rst' WHEN flags & 1 = 1 THEN 'fin' WHEN flags & 16 = 16 THEN 'ack' ELSE 'other' END"
CASCADE = f"""rep AS (SELECT src, 100 - 100.0 * count(*) FILTER (attack) / count(*) AS score FROM packets GROUP BY src), geo AS (SELECT * FROM {values(RANGES, "t(first, last, tag)")}), decided AS (SELECT event_id, action FROM m WHERE r = 1),
q0 AS (SELECT p.*, {IP} AS ip, {SIGNATURE} AS sig, score, action, {KIND} AS kind FROM packets p JOIN rep USING (src) LEFT JOIN decided USING (event_id)),
q1 AS (SELECT q0.*, tag, CASE WHEN fragment AND proto = 47 THEN 'validation' WHEN dst % 29 = 0 THEN 'not_protected' WHEN proto = 47 AND dst % 5 = 0 THEN 'proto_blocked' WHEN proto IN (6, 17) AND dst % 3 = 0 AND dst_port > 60 THEN 'port_filter' END AS reason FROM q0 LEFT JOIN geo ON ip BETWEEN first AND last),
q2 AS (SELECT *, reason IS NULL AS alive FROM q1),
{_counted("q3", "q2", "proto = 1", f"dst, {DAY}", 1, "'proto_rate_limit'")},
q4 AS (SELECT * EXCLUDE (reason, alive), CASE WHEN alive AND src % 50 <> 1 THEN CASE WHEN src % 10 = 3 THEN 'blacklist' WHEN tag = 'BB' AND dst % 2 = 0 THEN 'geo' WHEN sig <> 'gre' THEN 'signature' WHEN action = 'DROP' AND dst % 4 = 1 THEN 'policy' WHEN score < 60 THEN 'reputation' END ELSE reason END AS reason, alive AND src % 50 <> 1 AND src % 10 <> 3 AND NOT coalesce(tag = 'BB' AND dst % 2 = 0, false) AND coalesce(sig, 'gre') = 'gre' AND NOT coalesce(action = 'DROP' AND dst % 4 = 1, false) AND score >= 60 AS alive FROM q3x),
q5 AS (SELECT * EXCLUDE (reason, alive), CASE WHEN bad THEN 'spoofed' ELSE reason END AS reason, alive AND NOT bad AS alive FROM (SELECT *, alive AND proto = 6 AND dst % 6 = 0 AND kind <> 'syn' AND coalesce(sum(CASE WHEN alive AND kind = 'syn' THEN 1 ELSE 0 END) OVER (PARTITION BY proto = 6, src % 7, dst ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS bad FROM (SELECT * REPLACE (CASE WHEN proto = 6 THEN kind ELSE 'none' END AS kind) FROM q4))),
{_counted("q6", "q5", "proto = 6", f"src % 20, kind, {DAY}", 2, "'flag_rate_' || kind")},
{_counted("q7", "q6x", "proto = 6 AND kind = 'syn'", f"src % 30, {DAY}", 1, "'syn_flood'")},
{_counted("q8", "q7x", "proto = 17", f"src % 40, {DAY}", 2, "'udp_rate'")},
{_counted("q9", "q8x", "true", f"dst % 30, {DAY}", 3, "'rate_limit'")},
q10 AS (SELECT *, CASE WHEN alive AND proto = 6 THEN lag(flags) OVER (PARTITION BY alive AND proto = 6, src % 25 ORDER BY ts, event_id) = flags END AS same FROM q9x),
q11 AS (SELECT *, sum(CAST(coalesce(same, false) AS INT)) OVER (PARTITION BY src % 25 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS repeats FROM q10),
verdict AS (SELECT event_id, CASE WHEN alive AND proto = 6 AND repeats >= 2 THEN 'tcp_abuse' ELSE reason END AS drop_reason FROM q11)"""


def staged(spark, sf_dir):
    p = tables.packets(spark, sf_dir)
    rep = p.groupBy("src").agg((100 - 100.0 * F.count_if("attack") / F.count("*")).alias("score"))
    flag = lambda bits, value: F.col("flags").bitwiseAND(bits) == value
    kind = F.when(F.col("proto") != 6, "none").when(flag(18, 2), "syn").when(flag(4, 4), "rst").when(flag(1, 1), "fin").when(flag(16, 16), "ack").otherwise("other")
    decided = matched(spark, sf_dir).select("event_id", "action")
    ranges = spark.createDataFrame(RANGES, "first long, last long, tag string")
    full = lookups.in_ranges(addressed(spark, sf_dir), ranges).join(rep, "src").join(decided, "event_id")
    full = full.withColumns({"sig": filters.signature(), "kind": kind, "day": F.to_date("ts"), **{f"s{n}": F.col("src") % n for n in (7, 20, 25, 30, 40)}, "d30": F.col("dst") % 30})
    e = F.expr
    stages = [
        op.Check("validation", e("fragment AND proto = 47")),
        op.Check("not_protected", e("dst % 29 = 0")),
        op.Check("proto_blocked", e("proto = 47 AND dst % 5 = 0")),
        op.Check("port_filter", e("proto IN (6, 17) AND dst % 3 = 0 AND dst_port > 60")),
        op.Limit("proto_rate_limit", e("proto = 1"), ("dst", "day"), 1),
        op.Bypass(e("src % 50 = 1")),
        op.Check("blacklist", e("src % 10 = 3")),
        op.Check("geo", e("tag = 'BB' AND dst % 2 = 0")),
        op.Check("signature", e("sig <> 'gre'")),
        op.Check("policy", e("action = 'DROP' AND dst % 4 = 1")),
        op.Check("reputation", e("score < 60")),
        op.Known("spoofed", e("proto = 6 AND dst % 6 = 0"), e("kind = 'syn'"), ("s7", "dst")),
        op.Limit(F.concat(F.lit("flag_rate_"), F.col("kind")), e("proto = 6"), ("s20", "kind", "day"), 2),
        op.Limit("syn_flood", e("kind = 'syn'"), ("s30", "day"), 1),
        op.Limit("udp_rate", e("proto = 17"), ("s40", "day"), 2),
        op.Limit("rate_limit", F.lit(True), ("d30", "day"), 3),
        op.Repeats("tcp_abuse", e("proto = 6"), ("s25",), ("flags",), 2),
    ]
    return op.admitted(full, stages, ("ts", "event_id"), ["event_id"])


CATEGORY = "CASE WHEN drop_reason IS NULL THEN 'passed' WHEN drop_reason IN ('blacklist', 'geo', 'reputation') THEN 'source' WHEN drop_reason IN ('not_protected', 'proto_blocked', 'port_filter', 'signature', 'policy', 'spoofed', 'tcp_abuse', 'validation') THEN 'content' ELSE 'volume' END"


@query(f"WITH {PACKETS}, {RULES}, {MATCHES}, {CASCADE} SELECT event_id, drop_reason, {CATEGORY} AS category FROM verdict")
def verdict_cascade(spark, sf_dir):
    """Every packet through all stages in order; what is dropped early counts for no later stage."""
    return staged(spark, sf_dir).withColumn("category", op.category(F.col("drop_reason")))


@query(f"WITH {PACKETS}, {RULES}, {MATCHES}, {CASCADE} SELECT {CATEGORY} AS category, coalesce(drop_reason, 'none') AS drop_reason, count(*) AS packets, sum(length) AS bytes FROM verdict JOIN packets USING (event_id) GROUP BY ALL")
def layer_statistics(spark, sf_dir):
    """Packets and bytes by what stopped them, as the first layer counts them."""
    v = staged(spark, sf_dir).join(tables.packets(spark, sf_dir).select("event_id", "length").hint("merge"), "event_id")
    return v.groupBy(op.category(F.col("drop_reason")).alias("category"), F.coalesce("drop_reason", F.lit("none")).alias("drop_reason")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))

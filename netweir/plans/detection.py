"""Queries of the default detection path, each with SQL written on its own."""

from pyspark.sql import functions as F

from netweir.operators import detection as op
from netweir.sources import tables

from .recursions import SERIES
from .registry import query, r6
from .views_sql import ATTACKS, PACKETS, ROLLUPS

#: Windows of four groups of hosts by twelve hours; on the 20th and 21st a flood sends every UDP packet nine times.
WINDOWS = f"""{PACKETS}, p AS (SELECT *, dst % 4 AS host, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') AS w, unnest(range(CASE WHEN proto = 17 AND day(ts) IN (20, 21) THEN 9 ELSE 1 END)) FROM packets),
fl AS (SELECT host, w, max(k) AS top FROM (SELECT host, w, count(*) AS k FROM p GROUP BY host, w, src, proto) GROUP BY 1, 2),
f AS (SELECT host, w, count(*) AS packets, sum(length) AS bytes, count(*) FILTER (flags & 2 = 2) AS syn, count(*) FILTER (flags & 16 = 16) AS ack, count(*) FILTER (proto = 6) / count(*) AS tcp_share, count(*) FILTER (proto = 17) / count(*) AS udp_share,
    count(*) FILTER (proto = 1) / count(*) AS icmp_share, count(*) FILTER (proto NOT IN (1, 6, 17)) / count(*) AS other_share, sum(length) / count(*) AS bytes_per_packet, count(DISTINCT src) AS sources, count(DISTINCT dst_port) AS ports,
    any_value(100.0 * top) / count(*) AS max_flow_percent, count(*) FILTER (fragment) / count(*) AS fragment_ratio, avg(ttl) AS ttl_mean FROM p JOIN fl USING (host, w) GROUP BY 1, 2)"""


def windows(spark, sf_dir):
    p = tables.packets(spark, sf_dir).withColumns({"host": F.col("dst") % 4, "w": F.window("ts", "12 hours")["start"]})
    flood = (F.col("proto") == 17) & F.dayofmonth("ts").isin(20, 21)
    p = p.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(flood, 9).otherwise(1))))
    top = p.groupBy("host", "w", "src", "proto").agg(F.count("*").alias("k")).groupBy("host", "w").agg(F.max("k").alias("top"))
    n = F.count("*")
    share = lambda c: F.count_if(c) / n
    f = p.groupBy("host", "w").agg(
        n.alias("packets"),
        F.sum("length").alias("bytes"),
        F.count_if(F.col("flags").bitwiseAND(2) == 2).alias("syn"),
        F.count_if(F.col("flags").bitwiseAND(16) == 16).alias("ack"),
        *[share(F.col("proto") == k).alias(f"{name}_share") for name, k in (("tcp", 6), ("udp", 17), ("icmp", 1))],
        share(~F.col("proto").isin(1, 6, 17)).alias("other_share"),
        (F.sum("length") / n).alias("bytes_per_packet"),
        F.count_distinct("src").alias("sources"),
        F.count_distinct("dst_port").alias("ports"),
        share("fragment").alias("fragment_ratio"),
        F.avg("ttl").alias("ttl_mean"),
    )
    return f.join(top, ["host", "w"]).withColumn("max_flow_percent", 100.0 * F.col("top") / F.col("packets")).drop("top")


NAMES = ", ".join(r[0] for r in op.ROUTES)
ROUTES = "(VALUES " + ", ".join(f"('{f}', '{m}', {w}, {t}, {b})" for f, m, w, t, b in op.ROUTES) + ") r(feature, method, weight, least, both_ways)"
ROUTED = f"""{WINDOWS}, long AS (UNPIVOT (SELECT host, w, {", ".join(f"CAST({r[0]} AS DOUBLE) AS {r[0]}" for r in op.ROUTES)} FROM f) ON {NAMES} INTO NAME feature VALUE raw),
s AS (SELECT long.*, method, weight, least, both_ways, CASE WHEN method = 'log' THEN ln(1 + raw) ELSE raw END AS x, row_number() OVER (PARTITION BY host, feature ORDER BY w) AS j FROM long JOIN {ROUTES} USING (feature)),
e AS (SELECT host, feature, j, x, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS var, x AS m, 0.0::DOUBLE AS v FROM s WHERE j = 1
    UNION ALL SELECT s.host, s.feature, s.j, s.x, e.m, e.v, e.m + 0.15 * (s.x - e.m), 0.85 * (e.v + 0.15 * (s.x - e.m) ** 2) FROM e JOIN s ON s.host = e.host AND s.feature = e.feature AND s.j = e.j + 1),
y AS (SELECT s.*, mean, CASE method WHEN 'threshold' THEN CASE WHEN raw > least THEN (raw - least) / 10 + 3 ELSE 0 END WHEN 'divergence' THEN 0 WHEN 'log' THEN CASE WHEN s.j > 10 AND sqrt(var) >= 1e-10 THEN (s.x - mean) / sqrt(var) ELSE 0 END
    ELSE CASE WHEN s.j > 10 THEN least(greatest((s.x - mean) / greatest(sqrt(var), CASE WHEN mean > 50 THEN 0.02 * mean ELSE 1 END), -100), 100) ELSE 0 END END AS zz FROM s JOIN e USING (host, feature, j)),
z AS (SELECT *, CASE WHEN both_ways THEN abs(zz) ELSE zz END AS z FROM y),
c AS (SELECT host, feature, j, greatest(0, z - 0.5) AS hi, greatest(0, -z - 0.5) AS lo FROM z WHERE method = 'cusum' AND j = 1
    UNION ALL SELECT z.host, z.feature, z.j, greatest(0, CASE WHEN greatest(hi, lo) > 5 THEN 0 ELSE 0.99 * hi END + z.z - 0.5), greatest(0, CASE WHEN greatest(hi, lo) > 5 THEN 0 ELSE 0.99 * lo END - z.z - 0.5) FROM c JOIN z ON z.host = c.host AND z.feature = c.feature AND z.j = c.j + 1),
scored AS (SELECT z.*, coalesce(greatest(hi, lo) > 5, false) AS alarm, CASE WHEN method = 'divergence' THEN (greatest(mean, 1e-10) * ln(2 * greatest(mean, 1e-10) / (greatest(mean, 1e-10) + greatest(x, 1e-10))) + greatest(x, 1e-10) * ln(2 * greatest(x, 1e-10) / (greatest(mean, 1e-10) + greatest(x, 1e-10)))) / 2 / ln(2) ELSE 0 END AS term FROM z LEFT JOIN c USING (host, feature, j)),
u AS (SELECT *, CASE WHEN j > 10 THEN abs(z) * greatest(weight, 0.1) ELSE 0 END AS wz FROM scored),
g AS (SELECT host, w, max(wz) AS top, arg_max(feature, (round(wz, 6), feature)) AS name, count(*) FILTER (wz >= 3) AS by_z, count(*) FILTER (alarm AND j > 10) AS by_cusum, count(*) FILTER (alarm AND j > 10 AND wz < 3) AS more, coalesce(sum(term) FILTER (j > 10), 0) AS mix FROM u GROUP BY 1, 2),
d AS (SELECT host, w, top + CASE WHEN mix >= 0.15 THEN mix * 9 ELSE 0 END + by_cusum * 1.5 AS score, by_z + more + CAST(mix >= 0.15 AS INT) AS triggered, by_z, by_cusum, mix >= 0.15 AS by_mix,
    CASE WHEN CASE WHEN mix >= 0.15 THEN mix * 9 ELSE 0 END > top THEN 'protocol_mix' WHEN top > 0 THEN name END AS "primary" FROM g)"""


@query(f"WITH RECURSIVE {ROUTED} SELECT host, w, feature, method, round(z, 6) + 0.0 AS z, alarm, round(term, 6) + 0.0 AS term FROM scored")
def routed_features(spark, sf_dir):
    """Every feature scored by the method that it is routed to."""
    s = op.routed(windows(spark, sf_dir), ["host"], "w")
    return s.select("host", "w", "feature", "method", (F.round("z", 6) + 0.0).alias("z"), "alarm", (F.round("term", 6) + 0.0).alias("term"))


@query(f'WITH RECURSIVE {ROUTED} SELECT host, w, round(score, 6) AS score, triggered, by_z, by_cusum, by_mix, "primary" FROM d')
def routed_detection(spark, sf_dir):
    """Windows with the score and the triggers that all methods give together."""
    return op.combined(op.routed(windows(spark, sf_dir), ["host"], "w"), ["host"], "w").withColumn("score", F.round("score", 6))


@query(f"WITH RECURSIVE {ROUTED} SELECT host, w, CASE WHEN packets < 40 THEN 0 ELSE round(score, 6) END AS score, CASE WHEN packets < 40 THEN 0 ELSE triggered END AS triggered, packets < 40 AS skipped FROM d JOIN f USING (host, w)")
def low_traffic_skipped(spark, sf_dir):
    """Quiet windows teach the baselines and decide nothing."""
    f = windows(spark, sf_dir)
    d = op.combined(op.routed(f, ["host"], "w"), ["host"], "w").join(f.select("host", "w", "packets"), ["host", "w"])
    return op.quiet_skipped(d, F.col("packets"), 40).select("host", "w", r6("score"), "triggered", "skipped")


@query(f"""
WITH RECURSIVE {SERIES}, x AS (SELECT label, w, i, n * CASE WHEN i % 90 IN (50, 51, 52) THEN 40 ELSE 1 END * 10.0::DOUBLE AS rate, bytes % 7 * 10.0::DOUBLE AS syn, CASE WHEN i % 70 = 60 THEN sources * 20 ELSE sources END * 10.0::DOUBLE AS flow FROM series),
c AS (SELECT label, greatest(floor(list_sort(list(rate))[29] * 3), 60) AS rate_cut, greatest(floor(list_sort(list(syn))[29] * 3), 50) AS syn_cut FROM x WHERE i <= 30 GROUP BY label),
e AS (SELECT label, i, rate AS a, syn AS b, flow AS c FROM x WHERE i = 1 UNION ALL SELECT x.label, x.i, 0.3 * rate + 0.7 * a, 0.3 * syn + 0.7 * b, 0.3 * flow + 0.7 * c FROM e JOIN x ON x.label = e.label AND x.i = e.i + 1),
hits AS (SELECT x.label, w, i, rate, a, CASE WHEN i < 30 THEN rate > 120 ELSE (a > 100 AND rate > 1.5 * a) OR rate > rate_cut END AS rate_spike, CASE WHEN i < 30 THEN syn > 200 ELSE syn > syn_cut OR (b > 10 AND syn > b * 1.5 * 1.5) END AS syn_spike,
    i >= 30 AND e.c > 10 AND flow > e.c * 1.5 * 2 AS flow_spike FROM x JOIN e USING (label, i) LEFT JOIN c ON c.label = x.label),
k AS (SELECT *, i >= 30 AND (rate_spike OR syn_spike OR flow_spike) AS hit, max(CASE WHEN i >= 30 AND (rate_spike OR syn_spike OR flow_spike) THEN 0 ELSE i END) OVER (PARTITION BY label ORDER BY i) AS clear FROM hits)
SELECT label, w, rate, round(a, 6) AS average, rate_spike, syn_spike, flow_spike, i - clear AS streak, i - clear >= 2 AS confirmed FROM k
""")
def fast_detection(spark, sf_dir):
    """Spikes of short windows; hours stand for tenths of a second, the finest windows that the table fills, with pulses
    of three windows and bursts of flows planted."""
    from .recursions import series

    s = series(spark, sf_dir).select("label", "w", (F.col("n") * F.when((F.col("i") % 90).isin(50, 51, 52), 40).otherwise(1)).alias("packets"), (F.col("bytes") % 7).alias("syn"), F.when(F.col("i") % 70 == 60, F.col("sources") * 20).otherwise(F.col("sources")).alias("new_flows"))
    return op.fast_spikes(s, ["label"], "w", least_rate=60.0, least_syn=100.0).withColumn("average", F.round("average", 6))


@query(f"WITH {ATTACKS}, t AS (SELECT max(started_at) AS now FROM attacks) SELECT attack_id, target, started_at, now AS ended_at, date_diff('second', started_at, now) AS seconds FROM attacks, t WHERE is_active AND date_diff('second', started_at, now) > 600")
def stale_attacks(spark, sf_dir):
    """Attacks that have been open for over ten minutes are closed at the newest time known."""
    a = tables.attacks(spark, sf_dir)
    now = a.agg(F.max("started_at").alias("now")).first()["now"]
    age = F.timestamp_diff("SECOND", "started_at", "ended_at")
    return a.filter("is_active").withColumn("ended_at", F.lit(now)).withColumn("seconds", age).filter("seconds > 600").select("attack_id", "target", "started_at", "ended_at", "seconds")


ENDED = ATTACKS + ", x AS (SELECT *, CASE WHEN NOT is_active THEN started_at + to_minutes(attack_id % 97) END AS ended_at FROM attacks)"


def ended(spark, sf_dir):
    """Attacks with the time of their end, which none that is active has."""
    minutes = F.make_dt_interval(mins=(F.col("attack_id") % 97).cast("int"))
    return tables.attacks(spark, sf_dir).withColumn("started_at", F.col("started_at").cast("timestamp_ntz")).withColumn("ended_at", F.when(~F.col("is_active"), F.col("started_at") + minutes))


@query(f"WITH {ENDED} SELECT attack_id, target, attack_type, severity, started_at, ended_at, coalesce(date_diff('second', started_at, ended_at), 0) AS seconds, magnitude, is_mitigated FROM x ORDER BY started_at DESC, attack_id LIMIT 20")
def incident_report(spark, sf_dir):
    """The twenty newest attacks in detail."""
    a = ended(spark, sf_dir).orderBy(F.desc("started_at"), "attack_id").limit(20)
    return a.select("attack_id", "target", "attack_type", "severity", "started_at", "ended_at", F.coalesce(F.timestamp_diff("SECOND", "started_at", "ended_at"), F.lit(0)).alias("seconds"), "magnitude", "is_mitigated")


@query(f"WITH {ENDED} SELECT started_at AS at, 'attack_detected' AS event, attack_id, severity, attack_type || ' attack targeting ' || target AS details FROM x UNION ALL SELECT ended_at, 'attack_mitigated', attack_id, severity, 'Mitigated after ' || date_diff('second', started_at, ended_at) || 's' FROM x WHERE ended_at IS NOT NULL")
def security_events(spark, sf_dir):
    """The time line of a security report: each attack's detection and end."""
    seen = F.struct(F.col("started_at").alias("at"), F.lit("attack_detected").alias("event"), F.concat("attack_type", F.lit(" attack targeting "), F.col("target").cast("string")).alias("details"))
    done = F.struct(F.col("ended_at").alias("at"), F.lit("attack_mitigated").alias("event"), F.concat(F.lit("Mitigated after "), F.timestamp_diff("SECOND", "started_at", "ended_at").cast("string"), F.lit("s")).alias("details"))
    return ended(spark, sf_dir).select("attack_id", "severity", F.inline(F.array(seen, done))).filter("at IS NOT NULL").select("at", "event", "attack_id", "severity", "details")


TOTALS = """t AS (SELECT count(*) AS samples, max(rx_pps) AS peak_pps, max(rx_bps) AS peak_bps, avg(rx_pps) AS avg_pps, avg(rx_bps) AS avg_bps, count(*) FILTER (anomaly_active) AS down, sum(dropped_pps) AS dropped, sum(drops_signature) AS signature FROM rollups),
a AS (SELECT count(*) AS total, count(*) FILTER (is_mitigated) AS mitigated, count(*) FILTER (is_active) AS active, coalesce(avg(mitigation_ms) FILTER (mitigation_ms <> 0), 0) AS mean_ms FROM attacks)"""


def totals(spark, sf_dir):
    """One row of traffic totals and one of attack totals."""
    t = tables.rollups(spark, sf_dir).agg(
        F.count("*").alias("samples"), F.max("rx_pps").alias("peak_pps"), F.max("rx_bps").alias("peak_bps"), F.avg("rx_pps").alias("avg_pps"), F.avg("rx_bps").alias("avg_bps"),
        F.count_if("anomaly_active").alias("down"), F.sum("dropped_pps").alias("dropped"), F.sum("drops_signature").alias("signature"),
    )
    ms = F.avg(F.when(F.col("mitigation_ms") != 0, F.col("mitigation_ms")))
    a = tables.attacks(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("is_mitigated").alias("mitigated"), F.count_if("is_active").alias("active"), F.coalesce(ms, F.lit(0.0)).alias("mean_ms"))
    return t, a


def metrics(row, **columns):
    """metric, value of a one-row table."""
    return row.select(*[F.round(c.cast("double"), 6).alias(n) for n, c in columns.items()]).unpivot([], list(columns), "metric", "value")


@query(f"WITH {ROLLUPS}, {ATTACKS}, {TOTALS} SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (UNPIVOT (SELECT CAST(peak_pps AS DOUBLE) AS peak_pps, CAST(peak_bps AS DOUBLE) AS peak_bps, avg_pps, avg_bps, CAST(samples AS DOUBLE) AS samples, CAST(dropped AS DOUBLE) AS dropped, CAST(signature AS DOUBLE) AS signature_drops FROM t) ON COLUMNS(*) INTO NAME metric VALUE value)")
def traffic_report(spark, sf_dir):
    """Peaks, means and drops of a traffic report."""
    t, _ = totals(spark, sf_dir)
    same = ("peak_pps", "peak_bps", "avg_pps", "avg_bps", "samples", "dropped")
    return metrics(t, **{c: F.col(c) for c in same}, signature_drops=F.col("signature"))


@query(f"""WITH {ROLLUPS}, {ATTACKS}, {TOTALS}, x AS (SELECT round(100.0 * (samples - down) / greatest(samples, 1), 3) AS availability, CAST(samples - down AS DOUBLE) AS up_samples, CAST(down AS DOUBLE) AS down_samples, round(mean_ms, 2) AS mean_mitigation_ms,
    round(100.0 * mitigated / greatest(total, 1), 2) AS effectiveness, 99.9::DOUBLE AS target, CAST(100.0 * (samples - down) / greatest(samples, 1) >= 99.9 AS DOUBLE) AS compliant FROM t, a)
SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM x) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def sla_report(spark, sf_dir):
    """Availability and mitigation of a service report."""
    t, a = totals(spark, sf_dir)
    up = 100.0 * (F.col("samples") - F.col("down")) / F.greatest("samples", F.lit(1))
    traffic = metrics(t, availability=F.round(up, 3), up_samples=F.col("samples") - F.col("down"), down_samples=F.col("down"), target=F.lit(99.9), compliant=up >= 99.9)
    return traffic.unionByName(metrics(a, mean_mitigation_ms=F.round("mean_ms", 2), effectiveness=F.round(100.0 * F.col("mitigated") / F.greatest("total", F.lit(1)), 2)))


@query(f"""
WITH {ROLLUPS}, {ATTACKS}, {TOTALS} SELECT 'drops' AS section, 'signature' AS metric, CAST(signature AS BIGINT) AS value FROM t UNION ALL SELECT 'drops', 'other', CAST(dropped - signature AS BIGINT) FROM t
UNION ALL SELECT 'type', attack_type, count(*) FROM attacks GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM attacks GROUP BY 2
""")
def security_report(spark, sf_dir):
    """Drops by reason, attacks by type and by severity."""
    t, _ = totals(spark, sf_dir)
    drops = t.select(F.col("signature"), (F.col("dropped") - F.col("signature")).alias("other")).unpivot([], ["signature", "other"], "metric", "value").select(F.lit("drops").alias("section"), "metric", "value")
    g = tables.attacks(spark, sf_dir).groupingSets([["attack_type"], ["severity"]], "attack_type", "severity").agg(F.count("*").alias("value"), F.grouping("attack_type").alias("by"))
    return drops.unionByName(g.select(F.when(F.col("by") == 0, "type").otherwise("severity").alias("section"), F.when(F.col("by") == 0, F.col("attack_type")).otherwise(F.col("severity")).alias("metric"), "value"))


@query(f"""
WITH RECURSIVE {SERIES}, x AS (SELECT label, w, i, n * CASE WHEN i % 90 BETWEEN 40 AND 75 THEN 40.0::DOUBLE ELSE 1.0::DOUBLE END AS v, i % 90 BETWEEN 40 AND 70 AND i % 4 <> 0 AS det, 1 + CASE WHEN i % 90 < 45 THEN 3 ELSE i % 2 END AS worst FROM series),
m AS (SELECT label, 0::BIGINT AS i, false AS act, 0::BIGINT AS lvl, 0::BIGINT AS cool, 0::BIGINT AS cyc, 0::BIGINT AS low, 0.0::DOUBLE AS peak, 0::BIGINT AS streak, 0::BIGINT AS recent, CAST(NULL AS BIGINT) AS since FROM (SELECT DISTINCT label FROM x)
UNION ALL SELECT label, i, CASE WHEN opens THEN true WHEN ends THEN false ELSE act END, CASE WHEN opens THEN worst WHEN ends THEN 0 WHEN stays AND det AND worst > lvl THEN worst WHEN lowers THEN lvl - 1 ELSE lvl END,
    CASE WHEN opens OR stays THEN 0 WHEN begins THEN CASE WHEN rec >= 3 THEN 90 ELSE 30 END WHEN ticks THEN cool1 - 1 ELSE cool1 END, CASE WHEN opens OR lowers OR (stays AND det AND worst > lvl) THEN 0 WHEN stays OR ticks THEN cyc + 1 ELSE cyc END,
    CASE WHEN opens THEN 0 ELSE low2 END, CASE WHEN opens THEN v ELSE peak1 END, streak1, rec + CAST(opens AS INT), since1
FROM (SELECT *, lvl > 1 AND (begins OR (ticks AND cyc + 1 >= 7) OR (stays AND det AND worst < lvl AND cyc + 1 >= 30) OR (stays AND NOT det AND cyc + 1 >= 15)) AS lowers, ticks AND cool1 - 1 <= 0 AS ends
FROM (SELECT *, holds AND NOT act AND streak1 >= 1 AS opens, holds AND act AS stays, NOT holds AND act AND cool1 <= 0 AS begins, NOT holds AND act AND cool1 > 0 AS ticks
FROM (SELECT *, (det OR high) AND NOT (act AND cool > 0) AND NOT dropped AS holds, CASE WHEN dropped THEN 30 ELSE cool END AS cool1
FROM (SELECT *, big AND v < 0.3 * peak1 AND low2 >= 3 AS dropped FROM (SELECT *, CASE WHEN NOT big THEN low1 WHEN high THEN 0 ELSE low1 + 1 END AS low2
FROM (SELECT *, track AND peak1 > 10 AS big, track AND peak1 > 10 AND v >= 0.5 * peak1 AS high FROM (SELECT *, CASE WHEN track AND v > peak THEN v ELSE peak END AS peak1, CASE WHEN track AND v > peak THEN 0 ELSE low END AS low1
FROM (SELECT m.* EXCLUDE (i), x.i, v, det, worst, act AND cool <= 0 AS track, CASE WHEN since IS NULL OR x.i - since > 300 THEN 0 ELSE recent END AS rec, CASE WHEN since IS NULL OR x.i - since > 300 THEN x.i ELSE since END AS since1,
    CASE WHEN det THEN streak + 1 ELSE 0 END AS streak1 FROM m JOIN x ON x.label = m.label AND x.i = m.i + 1)))))))))
SELECT label, w, act AS active, lvl AS level, cool AS cooling, peak FROM m JOIN x USING (label, i)
""")
def attack_levels(spark, sf_dir):
    """Levels, drops and cooling of attacks planted as floods of 36 windows that are half of the time detected."""
    from .recursions import series

    at = F.col("i") % 90
    s = series(spark, sf_dir).select("label", "w", (F.col("n") * F.when(at.between(40, 75), 40.0).otherwise(1.0)).alias("value"), (at.between(40, 70) & (F.col("i") % 4 != 0)).alias("detected"), (F.lit(1) + F.when(at < 45, 3).otherwise(F.col("i") % 2)).cast("long").alias("level"))
    return op.attack_levels(s, ["label"], "w", least_peak=10.0)

"""Window features, concentration, bursts and trailing statistics."""

from pyspark.sql import functions as F

from netweir.operators import windows as op
from netweir.sources import tables

from .registry import query, r6
from .views_sql import FLOWS, PACKETS

RATIOS = "tcp_ratio udp_ratio icmp_ratio other_ratio syn_ack_ratio rst_syn_ratio bytes_per_packet syn_tcp_ratio ack_tcp_ratio rst_tcp_ratio fin_tcp_ratio icmp_echo_ratio small_pkt_ratio fragment_ratio ttl_mean tcp_completion_rate src_ip_entropy src_port_entropy max_flow_fraction topk_flow_share avg_packets_per_flow dst_port_density".split()


@query(f"""
WITH {PACKETS}, p AS (SELECT *, CAST(ts AS DATE) AS w, flags & 18 AS sa FROM packets),
base AS (
    SELECT dst, w, count(*) AS packets, sum(length) AS bytes, count(DISTINCT (src, dst, src_port, dst_port, proto)) AS flows,
        count(*) FILTER (sa = 2) AS syn, count(*) FILTER (sa = 18) AS syn_ack, count(*) FILTER (flags & 16 = 16) AS ack,
        count(*) FILTER (flags & 4 = 4) AS rst, count(*) FILTER (flags & 1 = 1) AS fin, count(*) FILTER (proto = 6) AS tcp,
        count(*) FILTER (proto = 1) AS icmp, count(*) FILTER (proto = 17) AS udp,
        count(DISTINCT src) AS unique_src_ips, count(DISTINCT dst_port) AS unique_dst_ports, count(DISTINCT (src, proto)) AS unique_flows,
        count(*) FILTER (icmp_type = 8) AS echo, count(*) FILTER (length < 100) AS small, count(*) FILTER (fragment) AS frag,
        sum(ttl) AS ttls, bool_or(attack) AS is_attack
    FROM p GROUP BY dst, w),
es AS (SELECT dst, w, -sum(c / n * log2(c / n)) AS e FROM (SELECT dst, w, src, count(*) AS c, sum(count(*)) OVER (PARTITION BY dst, w) AS n FROM p GROUP BY dst, w, src) GROUP BY dst, w),
ep AS (SELECT dst, w, -sum(c / n * log2(c / n)) AS e FROM (SELECT dst, w, src_port, count(*) AS c, sum(count(*)) OVER (PARTITION BY dst, w) AS n FROM p GROUP BY dst, w, src_port) GROUP BY dst, w),
fl AS (SELECT dst, w, max(c) * 100.0 / max(n) AS mx, sum(c) FILTER (r <= 10) * 100.0 / max(n) AS top, count(*) FILTER (c > 0.05 * n) AS hh
       FROM (SELECT dst, w, c, sum(c) OVER (PARTITION BY dst, w) AS n, row_number() OVER (PARTITION BY dst, w ORDER BY c DESC, src, proto) AS r FROM (SELECT dst, w, src, proto, count(*) AS c FROM p GROUP BY ALL)) GROUP BY dst, w),
fresh AS (SELECT dst, w, count(*) AS k FROM (SELECT dst, src, min(w) AS w FROM p GROUP BY dst, src) GROUP BY dst, w)
SELECT dst, w, packets, bytes, flows, syn, syn_ack, ack, rst, fin, unique_src_ips, unique_dst_ports, unique_flows, is_attack, hh AS heavy_hitter_count,
    coalesce(k, 0) AS new_srcip_rate, round(tcp / packets, 6) AS tcp_ratio, round(udp / packets, 6) AS udp_ratio, round(icmp / packets, 6) AS icmp_ratio,
    round((packets - tcp - udp - icmp) / packets, 6) AS other_ratio, round(syn_ack / greatest(syn, 1), 6) AS syn_ack_ratio, round(rst / greatest(syn, 1), 6) AS rst_syn_ratio,
    round(bytes / packets, 6) AS bytes_per_packet, round(syn / greatest(tcp, 1), 6) AS syn_tcp_ratio, round(ack / greatest(tcp, 1), 6) AS ack_tcp_ratio,
    round(rst / greatest(tcp, 1), 6) AS rst_tcp_ratio, round(fin / greatest(tcp, 1), 6) AS fin_tcp_ratio, round(echo / greatest(icmp, 1), 6) AS icmp_echo_ratio,
    round(small / packets, 6) AS small_pkt_ratio, round(frag / packets, 6) AS fragment_ratio, round(ttls / packets, 6) AS ttl_mean, round(ack / greatest(syn, 1), 6) AS tcp_completion_rate,
    round(es.e, 6) + 0.0 AS src_ip_entropy, round(ep.e, 6) + 0.0 AS src_port_entropy, round(mx, 6) AS max_flow_fraction, round(top, 6) AS topk_flow_share,
    round(packets / flows, 6) AS avg_packets_per_flow, round(unique_dst_ports * 1000.0 / packets, 6) AS dst_port_density
FROM base JOIN es USING (dst, w) JOIN ep USING (dst, w) JOIN fl USING (dst, w) LEFT JOIN fresh USING (dst, w)
""")
def window_features(spark, sf_dir):
    out = op.window_features(tables.packets(spark, sf_dir))
    rounded = {c: F.round(c, 6) + 0.0 for c in RATIOS}
    return out.withColumns(rounded)


@query(f"""
WITH RECURSIVE {PACKETS}, d AS (SELECT dst, CAST(ts AS DATE) AS w, count(*) AS n FROM packets GROUP BY 1, 2),
dense AS (SELECT s.dst, s.w, coalesce(d.n, 0) AS n, row_number() OVER (PARTITION BY s.dst ORDER BY s.w) AS i
          FROM (SELECT dst, CAST(unnest(generate_series(min(w), max(w), INTERVAL 1 DAY)) AS DATE) AS w FROM d GROUP BY dst) s LEFT JOIN d ON d.dst = s.dst AND d.w = s.w),
f AS (SELECT dst, w, n, i, CAST(n AS DOUBLE) AS m FROM dense WHERE i = 1
      UNION ALL SELECT x.dst, x.w, x.n, x.i, CASE WHEN f.m < 1 THEN x.n ELSE f.m + 0.033 * (x.n - f.m) END FROM f JOIN dense x ON x.dst = f.dst AND x.i = f.i + 1)
SELECT dst, w, round(CASE WHEN m > 0 THEN 100 * n / m ELSE 0 END, 6) AS burst FROM f
""")
def burst_factor(spark, sf_dir):
    return op.burst_factors(tables.packets(spark, sf_dir)).select("dst", "w", r6("burst"))


@query(f"""
WITH {PACKETS}, c AS (SELECT dst, CAST(ts AS DATE) AS w, label, count(*) AS c FROM packets GROUP BY ALL)
SELECT dst, w, label, packets FROM (SELECT *, sum(c) OVER (PARTITION BY dst, w) AS packets, row_number() OVER (PARTITION BY dst, w ORDER BY c DESC, label) AS r FROM c) WHERE r = 1
""")
def modal_label(spark, sf_dir):
    return op.modal_label(tables.packets(spark, sf_dir))


@query(f"""
WITH {PACKETS}, s AS (SELECT dst, CAST(ts AS DATE) AS w, count(*) AS n FROM packets GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w) AS i FROM s)
SELECT dst, w, n, {", ".join(f"sum(n) OVER w{k} AS sum_{k}, round(avg(n) OVER w{k}, 6) AS mean_{k}, round(var_pop(n) OVER w{k}, 6) AS var_{k}, round(CASE WHEN count(*) OVER w{k} >= 3 AND round(coalesce(regr_r2(n, i) OVER w{k}, 0), 9) >= 0.5 AND var_pop(n) OVER w{k} > 1e-9 THEN regr_slope(n, i) OVER w{k} ELSE 0 END, 6) AS slope_{k}" for k in (3, 10))}
FROM i WINDOW w3 AS (PARTITION BY dst ORDER BY i ROWS 2 PRECEDING), w10 AS (PARTITION BY dst ORDER BY i ROWS 9 PRECEDING)
""")
def multi_window_stats(spark, sf_dir):
    s = tables.packets(spark, sf_dir).groupBy("dst", F.to_date("ts").alias("w")).agg(F.count("*").alias("n"))
    return op.multi_window(s).withColumns({f"{c}_{k}": F.round(f"{c}_{k}", 6) for c in ("mean", "var", "slope") for k in (3, 10)})


@query(f"""
WITH {FLOWS}, g AS (SELECT dst // 16 AS subnet, CAST(ts AS DATE) AS w, sum(packets) AS packets, round(sum(bytes), 2) AS bytes, count(DISTINCT src) AS sources, count(*) AS flows FROM flows GROUP BY 1, 2)
SELECT * FROM g WHERE subnet IN (SELECT subnet FROM g GROUP BY subnet HAVING count(DISTINCT w) >= 30)
""")
def subnet_windows(spark, sf_dir):
    """Windows of subnets with at least 30 of them; sources are counted once per subnet."""
    f = tables.flows(spark, sf_dir).withColumns({"subnet": F.floor(F.col("dst") / 16), "w": F.to_date("ts")})
    g = f.groupBy("subnet", "w").agg(F.sum("packets").alias("packets"), F.round(F.sum("bytes"), 2).alias("bytes"), F.count_distinct("src").alias("sources"), F.count("*").alias("flows"))
    return g.join(g.groupBy("subnet").agg(F.count_distinct("w").alias("n")).filter("n >= 30").select("subnet"), "subnet", "left_semi")


@query(f"""
WITH {FLOWS} SELECT dst, CAST(ts AS DATE) AS w, sum(packets) AS packets, round(sum(bytes), 2) AS bytes, count(DISTINCT src) AS sources,
    count(*) FILTER (proto = 'A') AS n_a, round(sum(packets) FILTER (state = 'O') / sum(packets), 6) AS dir_ratio
FROM flows GROUP BY 1, 2 HAVING sum(packets) >= 50
""")
def flow_windows(spark, sf_dir):
    f = tables.flows(spark, sf_dir)
    g = f.groupBy("dst", F.to_date("ts").alias("w")).agg(F.sum("packets").alias("packets"), F.round(F.sum("bytes"), 2).alias("bytes"), F.count_distinct("src").alias("sources"), F.count_if(F.col("proto") == "A").alias("n_a"), F.round(F.sum(F.when(F.col("state") == "O", F.col("packets"))) / F.sum("packets"), 6).alias("dir_ratio"))
    return g.filter("packets >= 50")


@query(f"""
WITH {PACKETS}, m AS (SELECT label, (event_id * 37) % 60000 AS ms, length FROM packets), s AS (SELECT label, ms // 100 AS slot, count(*) AS packets, sum(length) AS bytes FROM m GROUP BY ALL),
w AS (SELECT *, sum(packets) OVER n AS pps, sum(bytes) OVER n AS bps, coalesce(sum(packets) OVER b, 0) AS past FROM s WINDOW n AS (PARTITION BY label ORDER BY slot RANGE BETWEEN 9 PRECEDING AND CURRENT ROW), b AS (PARTITION BY label ORDER BY slot RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT label, CAST(slot AS BIGINT) AS slot, packets, CAST(bytes AS BIGINT) AS bytes, CAST(pps AS DOUBLE) AS pps, CAST(8 * bps AS DOUBLE) AS bps, round(CASE WHEN past >= 5 THEN packets * 10 / past END, 6) AS spike, coalesce(past >= 5 AND packets * 10 / past >= 3, false) AS alarm FROM w
""")
def sub_second_rates(spark, sf_dir):
    """Rates of the last ten tenths of a second and how far each tenth exceeds them, packets laid along one minute."""
    p = tables.packets(spark, sf_dir).select("label", ((F.col("event_id") * 37) % 60000).alias("ms"), "length")
    out = op.sliding_rates(p, ["label"], "ms", warm=5)
    return out.select("label", "slot", "packets", "bytes", "pps", "bps", F.round("spike", 6).alias("spike"), F.coalesce(F.col("spike") >= 3, F.lit(False)).alias("alarm"))

"""The same views for DuckDB, written on their own so that a slip in one shows."""

PACKETS = """
packets AS (
    SELECT event_id, ts, user_id AS dst, event_id % 211 AS src, (event_id * 7919) % 65536 AS src_port,
           coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) AS dst_port, proto,
           40 + (CAST(floor(value) AS BIGINT) * 3) % 1460 AS length,
           CASE WHEN proto = 6 THEN CAST((event_id * 37) % 64 AS INTEGER) ELSE 0 END AS flags,
           CAST(32 + event_id % 224 AS INTEGER) AS ttl, event_id % 40 = 0 AS fragment,
           CASE WHEN proto = 1 THEN CAST(event_id % 9 AS INTEGER) END AS icmp_type,
           event_type = 'error' AS attack, event_type AS label
    FROM (SELECT *, CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'purchase' THEN 17 WHEN 'signup' THEN 1 ELSE 47 END AS proto FROM events)
)"""
ATTACKS = """
attacks AS (
    SELECT o_orderkey AS attack_id, o_custkey AS target,
           (['syn_flood', 'udp_flood', 'icmp_flood', 'slowloris'])[o_orderkey % 4 + 1] AS attack_type,
           o_orderpriority AS severity, o_orderstatus = 'O' AS is_active, o_orderstatus = 'P' AS is_mitigated,
           o_totalprice AS magnitude, CASE WHEN o_orderstatus = 'P' THEN (o_orderkey % 7) * 100.0 END AS mitigation_ms,
           o_orderdate AS started_at
    FROM orders
)"""
ROLLUPS = (
    PACKETS
    + """,
rollups AS (
    SELECT date_trunc('hour', ts) AS ts, count(*) AS rx_pps, sum(length) AS rx_bps,
           count(*) FILTER (fragment) AS dropped_pps, count(*) FILTER (attack AND fragment) AS drops_signature,
           count(*) FILTER (attack) >= 5 AS anomaly_active,
           CAST(least(count(*) FILTER (attack), 4) AS INTEGER) AS anomaly_level, count(DISTINCT dst) AS protected_ip_count
    FROM packets GROUP BY 1
)"""
)
FLOWS = """
flows AS (
    SELECT l_shipdate AS ts, l_suppkey AS dst, l_partkey AS src, l_orderkey AS flow, l_linenumber AS part,
           l_quantity AS packets, l_extendedprice AS bytes, l_returnflag AS proto, l_linestatus AS state
    FROM lineitem
)"""
VECTORS = "vectors AS (SELECT vec_id AS idx, label >= 8 AS attack, vec_id % 13 AS victim, " + ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS f{j}" for j in range(8)) + " FROM embeddings)"

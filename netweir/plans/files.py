"""Sources and sinks as queries: a given table is written in a format, read back through its reader and compared with SQL."""

from pyspark.sql import functions as F

from netweir.functions.traffic import ip_text
from netweir.sources import captures, readers, sinks, tables
from netweir.sources.lineage import folder

from .registry import query
from .views_sql import FLOWS, PACKETS, ROLLUPS


def digits(c, n: int):
    """``n`` bytes of a number as hexadecimal digits, most significant first."""
    return F.lpad(F.hex(c.cast("long")), 2 * n, "0")


def frames(spark, sf_dir):
    """event_id and the hexadecimal digits of a captured frame of every packet: a third with a VLAN tag, a fifth IPv6."""
    p = tables.packets(spark, sf_dir)
    six, tag = F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 3 == 1, "81000007").otherwise("")
    proto = F.when(six & (F.col("proto") == 1), 58).otherwise(F.col("proto"))
    body = F.when(F.col("proto") == 6, F.concat(digits(F.col("src_port"), 2), digits(F.col("dst_port"), 2), F.lit("0000000000000000" + "50"), digits(F.col("flags"), 1), F.lit("000000000000"))).when(F.col("proto") == 17, F.concat(digits(F.col("src_port"), 2), digits(F.col("dst_port"), 2), F.lit("00080000"))).when(F.col("proto") == 1, F.concat(digits(F.col("icmp_type"), 1), F.lit("000000"))).otherwise("00000000")
    v4 = F.concat(F.lit("0800" + "4500"), digits(F.length(body) / 2 + 20, 2), F.lit("0001"), F.when(F.col("fragment"), "2000").otherwise("0000"), digits(F.col("ttl"), 1), digits(proto, 1), F.lit("0000"), F.lit("0a0000"), digits(F.col("src"), 1), F.lit("c0"), digits(F.col("dst"), 3), body)
    v6 = F.concat(F.lit("86dd" + "60000000"), digits(F.length(body) / 2, 2), digits(proto, 1), digits(F.col("ttl"), 1), F.lit("fd00" + "00" * 13), digits(F.col("src"), 1), F.lit("fd01" + "00" * 10), digits(F.col("dst"), 4), body)
    frame = F.concat(F.lit("00" * 12), tag, F.when(six, v6).otherwise(v4))
    return p.select("event_id", "length", frame.alias("frame"))


FRAMES_SQL = f"""WITH {PACKETS} SELECT CAST(event_id AS DOUBLE) AS ts, event_id % 5 = 0 AS six, CASE WHEN proto IN (6, 17) THEN CAST(src_port AS INTEGER) ELSE 0 END AS src_port, CASE WHEN proto IN (6, 17) THEN CAST(dst_port % 65536 AS INTEGER) ELSE 0 END AS dst_port,
    CAST(CASE WHEN proto = 1 AND event_id % 5 = 0 THEN 58 ELSE proto END AS INTEGER) AS proto, CAST(length AS INTEGER) AS length, flags, ttl, fragment AND event_id % 5 <> 0 AS fragment, icmp_type,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE '10.0.0.' || src END AS src FROM packets"""


def recaptured(spark, sf_dir, form: str):
    """The packets' frames written to capture files, as many as there are packets for, read again in ranges of 64 KB or more."""
    rows = frames(spark, sf_dir).select(F.col("event_id").cast("double").alias("ts"), F.col("length").cast("int").alias("length"), F.unhex("frame").alias("frame"))
    captures.write_captures(rows.repartitionByRange("ts").sortWithinPartitions("ts"), path := folder(spark), form)
    read, six = captures.captures(spark, path, 1 << 16), F.contains("src", F.lit(":"))
    return read.select("ts", six.alias("six"), "src_port", "dst_port", "proto", "length", "flags", "ttl", "fragment", "icmp_type", F.when(~six, F.col("src")).alias("src"))


@query(FRAMES_SQL)
def capture_scan(spark, sf_dir):
    return recaptured(spark, sf_dir, "classic")


@query(FRAMES_SQL)
def capture_block_scan(spark, sf_dir):
    return recaptured(spark, sf_dir, "blocks")


def filled(at: dict, width: int):
    """A line of ``width`` fields, those of ``at`` by position and zeros; zeros in a row are one literal."""
    pieces, zeros = [], []
    for k in range(width):
        if k not in at:
            zeros.append("0")
            continue
        pieces += [F.lit(",".join(zeros))] if zeros else []
        pieces.append(F.coalesce(at[k].cast("string"), F.lit("")))
        zeros = []
    return F.concat_ws(",", *pieces, *([F.lit(",".join(zeros))] if zeros else []))


@query(f"WITH {FLOWS} SELECT CAST(ts AS TIMESTAMP) AS ts, '10.0.' || (src % 250) || '.1' AS src, CAST(packets AS BIGINT) AS in_packets, CASE proto WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END AS proto_number, CAST(state = 'O' AS INTEGER) AS is_attack, count(*) AS n FROM flows GROUP BY ALL")
def flow_scan(spark, sf_dir):
    """Flow records written in the positional format, with a header and short lines, and read again."""
    f = tables.flows(spark, sf_dir)
    at = {1: F.year("ts"), 2: F.month("ts"), 3: F.dayofmonth("ts"), 14: F.concat(F.lit("10.0."), (F.col("src") % 250).cast("string"), F.lit(".1")), 15: F.lit("10.1.1.1"), 18: F.when(F.col("proto") == "A", "TCP").when(F.col("proto") == "N", "udp").otherwise("ICMP"), 27: F.col("packets").cast("long"), 84: (F.col("state") == "O").cast("int")}
    lines = f.select(filled(at, readers.FLOW_WIDTH).alias("value"))
    extra = spark.createDataFrame([("id," + ",".join(f"c{i}" for i in range(84)),), ("1,2,3",)], "value string")
    lines.unionByName(extra).write.text(path := folder(spark))
    r = readers.netflow(spark, path)
    return r.groupBy(F.col("ts").cast("timestamp_ntz").alias("ts"), "src", "in_packets", "proto_number", "is_attack").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey * 1000 AS first, s_suppkey * 1000 + 500 AS last, 'N' || s_nationkey AS tag FROM supplier")
def geo_scan(spark, sf_dir):
    """Ranges written as dotted CSV, with lines that are none, and read again as numbers."""
    s, n = tables.table(spark, sf_dir, "supplier"), F.col("s_suppkey") * 1000
    good = s.select(ip_text(n).alias("first"), ip_text(n + 500).alias("last"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("tag"))
    bad = spark.createDataFrame([("x", "y", "AA"), ("2.0.0.9", "2.0.0.1", "BB")], good.schema)
    good.unionByName(bad).write.csv(path := folder(spark))
    return readers.geo_ranges(spark, path)


@query("WITH l AS (SELECT s_suppkey, min(CASE WHEN s_suppkey % 6 = 0 THEN 'dns' ELSE 'syn' END) AS label FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1) SELECT l_orderkey, l_linenumber, coalesce(label, 'BENIGN') AS label FROM lineitem LEFT JOIN l ON s_suppkey = l_suppkey")
def labelled_flows(spark, sf_dir):
    """Flows with labels read from a CSV that names some keys twice."""
    s = tables.table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0")
    rows = s.select("s_suppkey", F.explode(F.when(F.col("s_suppkey") % 6 == 0, F.array(F.lit("syn"), F.lit("dns"))).otherwise(F.array(F.lit("syn")))).alias("label"))
    rows.write.csv(path := folder(spark))
    labels = spark.read.schema("l_suppkey long, label string").csv(path)
    return readers.with_labels(tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), labels, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "label")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS dst, CAST(l_quantity AS DOUBLE) AS packets, CAST(l_extendedprice AS DOUBLE) AS bytes, count(*) AS n FROM lineitem GROUP BY ALL")
def window_tree_scan(spark, sf_dir):
    """Windows of entities written as JSON trees, a file for some hundred windows, and read again."""
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("dst"), F.struct(F.col("l_quantity").cast("double").alias("packets"), F.col("l_extendedprice").cast("double").alias("bytes")).alias("row"), F.floor(F.col("l_orderkey") / 4000).alias("part"))
    each = rows.groupBy("part", "dst").agg(F.collect_list("row").alias("rows"))
    trees = each.groupBy("part").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("dst", "rows"))).alias("per_ip_windows"))).alias("value"), F.first("part").cast("string").alias("name"))
    trees.select("value", "name").write.partitionBy("name").text(path := folder(spark))
    return readers.window_tree(spark, path, ["packets", "bytes"]).groupBy("dst", "packets", "bytes").agg(F.count("*").alias("n"))


@query(f"WITH {ROLLUPS} SELECT ts, rx_pps, rx_bps FROM rollups WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
def rollup_sink(spark, sf_dir):
    """Roll-ups appended by day, pruned to eleven days and read again."""
    path, live = folder(spark), folder(spark)
    r = tables.rollups(spark, sf_dir)
    sinks.append_rollup(r.filter("rx_pps % 2 = 0"), path)
    sinks.append_rollup(r.filter("rx_pps % 2 = 1"), path)
    sinks.prune(spark, path, "2024-01-31", 11, live)
    return spark.read.parquet(live).select("ts", "rx_pps", "rx_bps")


@query(f"WITH {PACKETS}, h AS (SELECT src, count(*) AS packets, sum(length) AS bytes FROM packets GROUP BY 1) SELECT 'json' AS form, * FROM h UNION ALL SELECT 'csv', * FROM h")
def exported_sources(spark, sf_dir):
    """Counts of sources exported as JSON lines and as CSV, and read again."""
    h = tables.packets(spark, sf_dir).groupBy("src").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))
    sinks.export(h, one := folder(spark))
    sinks.export(h, two := folder(spark), "csv")
    kind = "src long, packets long, bytes long"
    return spark.read.schema(kind).json(one).select(F.lit("json").alias("form"), "*").unionByName(spark.read.schema(kind).option("header", True).csv(two).select(F.lit("csv").alias("form"), "*"))


@query(f"WITH {PACKETS} SELECT label, count(*) AS n, round(avg(length), 6) AS mean FROM packets GROUP BY 1")
def baselines_restored(spark, sf_dir):
    """Baselines written as documents by key, and read again."""
    b = tables.packets(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    sinks.snapshot_baselines(b, ["label"], path := folder(spark))
    return sinks.restored_baselines(spark, path, "n long, mean double").withColumn("mean", F.round("mean", 6))

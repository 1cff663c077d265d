"""Domain views of the given tables; the only place that knows how columns map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet records made of ``events``: ids spread over sources, ports, flags and TTLs."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    proto = F.when(F.col("event_type").isin("click", "view"), 6).when(F.col("event_type") == "purchase", 17).when(F.col("event_type") == "signup", 1).otherwise(47)
    return e.select(
        "event_id",
        "ts",
        F.col("user_id").alias("dst"),
        (i % 211).alias("src"),
        ((i * 7919) % 65536).alias("src_port"),
        F.coalesce(F.regexp_extract("props", "([0-9]+)", 1).cast("long"), F.lit(0)).alias("dst_port"),
        proto.alias("proto"),
        (40 + (F.floor("value").cast("long") * 3) % 1460).alias("length"),
        F.when(proto == 6, (i * 37) % 64).otherwise(0).cast("int").alias("flags"),
        (32 + i % 224).cast("int").alias("ttl"),
        (i % 40 == 0).alias("fragment"),
        F.when(proto == 1, i % 9).cast("int").alias("icmp_type"),
        (F.col("event_type") == "error").alias("attack"),
        F.col("event_type").alias("label"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records made of ``lineitem``, a day its finest time."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("ts"),
        F.col("l_suppkey").alias("dst"),
        F.col("l_partkey").alias("src"),
        F.col("l_orderkey").alias("flow"),
        F.col("l_linenumber").alias("part"),
        F.col("l_quantity").alias("packets"),
        F.col("l_extendedprice").alias("bytes"),
        F.col("l_returnflag").alias("proto"),
        F.col("l_linestatus").alias("state"),
    )


def attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack records made of ``orders``: a status F has ended, P is mitigated, O is active."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("attack_id"),
        F.col("o_custkey").alias("target"),
        F.element_at(F.array(*map(F.lit, ("syn_flood", "udp_flood", "icmp_flood", "slowloris"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("attack_type"),
        F.col("o_orderpriority").alias("severity"),
        (F.col("o_orderstatus") == "O").alias("is_active"),
        (F.col("o_orderstatus") == "P").alias("is_mitigated"),
        F.col("o_totalprice").alias("magnitude"),
        F.when(F.col("o_orderstatus") == "P", (F.col("o_orderkey") % 7) * 100.0).alias("mitigation_ms"),
        F.col("o_orderdate").alias("started_at"),
    )


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly traffic roll-ups of ``events``: what a minute table holds, at the grain the data have."""
    p = packets(spark, sf_dir)
    return p.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(
        F.count("*").alias("rx_pps"),
        F.sum("length").alias("rx_bps"),
        F.count_if("fragment").alias("dropped_pps"),
        F.count_if(F.col("attack") & F.col("fragment")).alias("drops_signature"),
        (F.count_if("attack") >= 5).alias("anomaly_active"),
        F.least(F.count_if("attack"), F.lit(4)).cast("int").alias("anomaly_level"),
        F.count_distinct("dst").alias("protected_ip_count"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector windows made of ``embeddings``: idx orders them, the first labels are benign, thirteen victims take turns."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), (F.col("label") >= 8).alias("attack"), (F.col("vec_id") % 13).alias("victim"), *[F.get("embedding", F.lit(j)).cast("double").alias(f"f{j}") for j in range(8)])


def named(cols: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in cols.items()]

"""Predicates: a filter DSL, policies, signatures and the ordered verdict of a packet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweir.functions.traffic import cases, flagged

OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
}


def where(rows: DataFrame, **conditions: object) -> DataFrame:
    """Rows that meet all of ``field__op=value``; a bare field means eq, None and unknown fields are skipped."""
    for name, value in conditions.items():
        field, _, op = name.partition("__")
        if value is not None and field in rows.columns and (op or "eq") in OPERATORS:
            rows = rows.filter(OPERATORS[op or "eq"](F.col(field), value))
    return rows


def condition(field: Column, op: str, value: object) -> Column:
    """A policy's condition: text for equality and parts, numbers for order; a null field never matches."""
    text, number = field.cast("string"), field.cast("double")
    out = {
        "eq": lambda: text == str(value),
        "ne": lambda: text != str(value),
        "gt": lambda: number > float(value),
        "lt": lambda: number < float(value),
        "ge": lambda: number >= float(value),
        "le": lambda: number <= float(value),
        "in": lambda: text.isin(*map(str, value)),
        "not_in": lambda: ~text.isin(*map(str, value)),
        "contains": lambda: text.contains(str(value)),
        "matches": lambda: text.rlike(f"^(?:{value})"),
    }.get(op, lambda: F.lit(False))()
    return F.coalesce(out, F.lit(False))


def all_conditions(rows: DataFrame, conditions: list[tuple[str, str, object]]) -> Column:
    """Whether every condition holds; none, or one on a missing field, never does."""
    tests = [condition(F.col(f), op, v) if f in rows.columns else F.lit(False) for f, op, v in conditions]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


#: UDP source ports that amplify.
AMPLIFIERS = (17, 19, 53, 69, 111, 123, 137, 161, 389, 520, 1900, 3283, 3702, 5060, 5353, 5683, 10001, 11211, 20800, 27015, 30718, 37810)
#: Packet sizes of attack tools.
TOOL_SIZES = (40, 60, 1200)
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32


def signature() -> Column:
    """The first signature that a packet matches, or null: amplification, then anomalies, scans and tools."""
    tcp = F.col("proto") == 6
    return cases(
        ((F.col("proto") == 17) & F.col("src_port").isin(*AMPLIFIERS) & (F.col("length") >= 100), "amplification"),
        (tcp & flagged("flags", 63, 0), "null_scan"),
        (tcp & flagged("flags", FIN | PSH | URG, FIN | PSH | URG), "xmas_scan"),
        (tcp & flagged("flags", SYN | FIN, SYN | FIN), "syn_fin"),
        (tcp & flagged("flags", SYN | RST, SYN | RST), "syn_rst"),
        (F.col("ttl") < 5, "low_ttl"),
        (tcp & flagged("flags", SYN | ACK, SYN) & (F.col("length") <= 60), "syn_scan"),
        (tcp & flagged("flags", 63, FIN), "fin_scan"),
        ((F.col("proto") == 17) & (F.col("length") <= 28), "udp_scan"),
        (tcp & F.col("length").isin(*TOOL_SIZES), "tool"),
        (F.col("proto") == 47, "gre"),
    )


def scan_sources(packets: DataFrame, least: int, epoch: str = "1 day") -> DataFrame:
    """Sources that touch at least ``least`` distinct ports of an epoch, with their ports."""
    return packets.groupBy(F.window("ts", epoch)["start"].alias("epoch"), "src").agg(F.count_distinct("dst_port").alias("ports")).filter(F.col("ports") >= least)


def active_features(train: DataFrame, features: list[str], spread: float = 1e-9, nonzero: float = 0.001) -> list[str]:
    """Features, sorted, that vary and are not almost always zero, by one aggregation; missing ones are inert."""
    have = [f for f in features if f in train.columns]
    if not have:
        return []
    row = train.agg(F.count("*").alias("n"), *[F.struct((F.max(f) - F.min(f)).alias("spread"), F.count_if(F.col(f) != 0).alias("nonzero")).alias(f) for f in have]).first()
    return sorted(f for f in have if row["n"] and row[f]["spread"] is not None and row[f]["spread"] >= spread and row[f]["nonzero"] / row["n"] >= nonzero)


def fingerprint(ttl: Column, window: Column, mss: Column) -> Column:
    """System family by initial TTL, window and segment size; tools first."""
    initial = cases((ttl <= 32, 32), (ttl <= 64, 64), (ttl <= 128, 128), otherwise=255)
    return cases(
        (mss == 0, "tool"),
        (window.isin(512, 1024, 2048) & (mss < 536), "tool"),
        (window == 0, "anomaly"),
        ((initial == 64) & (mss == 1460), "unix"),
        ((initial == 64), "unix_tunnel"),
        ((initial == 128) & (window >= 8192), "windows"),
        ((initial == 128), "windows_old"),
        ((initial == 255), "network_device"),
        otherwise="unknown",
    )

"""Readers of captures, flow and label files, geo ranges and window trees."""

from __future__ import annotations

import ipaddress
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET = "ts double, src string, dst string, src_port int, dst_port int, proto int, length int, flags int, ttl int, fragment boolean, icmp_type int"
#: The used columns of an 85-column flow record, by position.
FLOW_COLUMNS = {13: "duration double", 14: "src string", 15: "dst string", 16: "src_port int", 17: "dst_port int", 18: "proto string", 27: "in_packets long", 28: "in_bytes long", 29: "out_packets long", 30: "out_bytes long", 83: "attack_type string", 84: "is_attack int"}
FLOW_WIDTH = 85
PROTOCOLS = {"TCP": 6, "UDP": 17, "ICMP": 1, "ICMP6": 58}


def decoded(frame: bytes) -> tuple | None:
    """src, dst, src_port, dst_port, proto, flags, ttl, fragment and icmp_type of an Ethernet frame, whatever its VLAN tags.

    None for what is cut off or not IP.  Extension headers of IPv6 are skipped up to the transport.
    """
    kind = 12
    while frame[kind : kind + 2] in (b"\x81\x00", b"\x88\xa8"):
        kind += 4
    ip = frame[kind + 2 :]
    if frame[kind : kind + 2] == b"\x08\x00" and len(ip) >= 20 and ip[0] >> 4 == 4:
        part = struct.unpack_from(">H", ip, 6)[0]
        proto, ttl, fragment, first, rest = ip[9], ip[8], bool(part & 0x3FFF), not part & 0x1FFF, ip[(ip[0] & 15) * 4 :]
        ends = [".".join(map(str, ip[i : i + 4])) for i in (12, 16)]
    elif frame[kind : kind + 2] == b"\x86\xdd" and len(ip) >= 40 and ip[0] >> 4 == 6:
        proto, ttl, fragment, first, rest = ip[6], ip[7], False, True, ip[40:]
        while proto in (0, 43, 44, 60) and len(rest) >= 8:
            if proto == 44:
                part = struct.unpack_from(">H", rest, 2)[0]
                fragment, first = bool(part & 0xFFF9), not part & 0xFFF8
            proto, rest = rest[0], rest[8 if proto == 44 else 8 + rest[1] * 8 :]
            if not first:
                break
        ends = [str(ipaddress.IPv6Address(ip[i : i + 16])) for i in (8, 24)]
    else:
        return None
    sport = dport = flags = 0
    icmp = None
    if proto in (6, 17) and len(rest) >= 4 and first:
        sport, dport = struct.unpack_from(">HH", rest)
        flags = rest[13] if proto == 6 and len(rest) > 13 else 0
    elif proto in (1, 58) and rest and first:
        icmp = rest[0]
    return (*ends, sport, dport, proto, flags, ttl, fragment, icmp)


def netflow(spark: SparkSession, path: str) -> DataFrame:
    """Flow records of positional CSV files; header lines and rows of fewer columns are dropped."""
    # fields are a generator's output: every expression below would split the line anew, were they the split itself
    parts = F.col("parts")
    used = [F.get(parts, F.lit(i)).try_cast(c.split()[1]).alias(c.split()[0]) for i, c in FLOW_COLUMNS.items()]
    stamp = F.concat_ws(" ", F.concat_ws("-", F.get(parts, F.lit(1)), *[F.lpad(F.get(parts, F.lit(i)), 2, "0") for i in (2, 3)]), F.concat_ws(":", *[F.lpad(F.get(parts, F.lit(i)), 2, "0") for i in (4, 5, 6)]))
    lines = spark.read.text(path).select(F.explode(F.array(F.split("value", ",", -1))).alias("parts")).filter(F.size(parts) >= FLOW_WIDTH)
    # and so is the time, which the filter and the rows both ask for
    timed = lines.select(parts, F.explode(F.array(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")))).alias("ts"))
    rows = timed.select("ts", *used)
    return rows.filter("ts IS NOT NULL").withColumn("proto_number", F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv])[F.upper("proto")])


def geo_ranges(spark: SparkSession, path: str) -> DataFrame:
    """first, last, tag of a CSV of dotted ranges; rows that are none are dropped."""
    from netweir.functions.traffic import ip_number

    rows = spark.read.schema("first string, last string, tag string").csv(path)
    return rows.select(ip_number("first").alias("first"), ip_number("last").alias("last"), "tag").filter("first <= last")


def with_labels(flows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Flows with the label of their key, ``BENIGN`` without one; a key labelled twice takes the smaller label."""
    return flows.join(labels.groupBy(*keys).agg(F.min("label").alias("label")), keys, "left").withColumn("label", F.coalesce("label", F.lit("BENIGN")))


def window_tree(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """dst, features of JSON trees ``{"per_ip_windows": {dst: [row, ...]}}``, one document per file."""
    kind = f"struct<per_ip_windows:map<string,array<struct<{','.join(f'{f}:double' for f in features)}>>>>"
    tree = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("t"))
    return tree.select(F.explode("t.per_ip_windows").alias("dst", "rows")).select("dst", F.inline("rows"))

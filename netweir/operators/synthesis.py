"""Attacks made of benign windows: every kind changes several features of a row at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """Features that are multiplied, and features that are set."""

    times: dict[str, float] = field(default_factory=dict)
    to: dict[str, float] = field(default_factory=dict)


#: The eight perturbations.
KINDS = {
    "syn_flood": Kind({"packets_per_sec": 8, "bytes_per_sec": 4, "flow_duration_avg": 0.1, "unique_dst_ips": 6}, {"tcp_ratio": 0.94, "udp_ratio": 0.04, "dir_ratio": 0.85}),
    "udp_flood": Kind({"packets_per_sec": 9, "bytes_per_sec": 7}, {"tcp_ratio": 0.08, "udp_ratio": 0.90, "dir_ratio": 0.92}),
    "dns_amplification": Kind({"packets_per_sec": 2.5, "bytes_per_sec": 9, "flows_per_sec": 0.3}, {"tcp_ratio": 0.04, "udp_ratio": 0.96}),
    "ntp_amplification": Kind({"packets_per_sec": 3, "bytes_per_sec": 12, "flows_per_sec": 0.2}, {"tcp_ratio": 0.02, "udp_ratio": 0.98}),
    "slowloris": Kind({"packets_per_sec": 1.1, "bytes_per_sec": 1.05, "flows_per_sec": 4, "flow_duration_avg": 18, "dir_ratio": 0.9}),
    "fragment_flood": Kind({"packets_per_sec": 4, "bytes_per_sec": 1.5, "flows_per_sec": 0.8}, {"dir_ratio": 0.88}),
    "pulse_attack": Kind({"packets_per_sec": 22, "bytes_per_sec": 18, "flows_per_sec": 12}),
    "carpet_bomb": Kind({"packets_per_sec": 1.2, "flows_per_sec": 40, "unique_dst_ports": 80, "unique_dst_ips": 3}),
}
FEATURES = ("packets_per_sec", "bytes_per_sec", "flows_per_sec", "flow_duration_avg", "unique_dst_ips", "unique_dst_ports", "tcp_ratio", "udp_ratio", "dir_ratio")
EPS = 1e-10


def density(ports: Column, packets: Column) -> Column:
    """Destination ports for a thousand packets a second."""
    return ports * 1000.0 / (packets + EPS)


def changed(kind: Kind) -> dict[str, Column]:
    out = {f: F.lit(float(kind.to[f])) if f in kind.to else F.col(f) * float(kind.times.get(f, 1.0)) for f in FEATURES}
    return out | {"dst_port_density": density(out["unique_dst_ports"], out["packets_per_sec"])}


def synthesized(rows: DataFrame, kinds: dict[str, Kind] | None = None) -> DataFrame:
    """Every row of ``rows`` (with all ``FEATURES``) once as each kind of attack, with its kind and the port density anew.

    A missing value stays missing unless the kind sets it.  One pass, no join.
    """
    each = [F.struct(F.lit(name).alias("kind"), *[c.alias(f) for f, c in changed(k).items()]) for name, k in (kinds or KINDS).items()]
    return rows.select(*[c for c in rows.columns if c not in FEATURES and c != "dst_port_density"], F.inline(F.array(*each)))


def ramped(rows: DataFrame, rate: float, cycles: int, volumes: tuple[str, ...] = ("packets_per_sec", "bytes_per_sec", "flows_per_sec")) -> DataFrame:
    """Every row ``cycles`` times, its volumes grown by ``rate`` a step, with the port density anew."""
    steps = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    grown = steps.withColumns({c: F.col(c) * F.pow(F.lit(1 + rate), F.col("step")) for c in volumes})
    return grown.withColumn("dst_port_density", density(F.col("unique_dst_ports"), F.col("packets_per_sec")))

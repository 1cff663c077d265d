"""Per-(destination, window) features of packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.traffic import flagged, ratio

from .recursions import fold

SYN, ACK, FIN, RST = 0x02, 0x10, 0x01, 0x04
#: EWMA step of the burst factor.
BURST_ALPHA = 0.033


def entropy_of(packets: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Shannon entropy in bits of ``value`` within ``keys``: counts first, so no group is gathered."""
    counts = packets.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    # -sum(p log p) = log n - sum(c log c) / n
    return counts.groupBy(*keys).agg((F.log2(F.sum("_c").cast("double")) - F.sum(F.col("_c") * F.log2("_c")) / F.sum("_c")).alias(name))


def flow_shares(packets: DataFrame, keys: list[str], flow: list[str], top: int = 10) -> DataFrame:
    """Largest flow's share, the top flows' share (percent) and how many flows exceed 5 %."""
    counts = packets.groupBy(*keys, *flow).agg(F.count("*").alias("_c"))
    # a window under attack has most flows: its flows are ranked in parts, and then the parts' first; fewer than 20 flows exceed 5 %
    most = max(top, 20)
    part = F.pmod(F.xxhash64(*flow), F.lit(32)).alias("_part")
    first = counts.select(*keys, "_c", part).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.desc("_c")))).filter(F.col("_r") <= most)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    best = first.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_c"), asc=False), 1, most).alias("_best"))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return totals.join(best, keys).select(
        *keys,
        (F.get("_best", F.lit(0)) * 100.0 / F.col("_n")).alias("max_flow_fraction"),
        (add(F.slice("_best", 1, top)) * 100.0 / F.col("_n")).alias("topk_flow_share"),
        F.size(F.filter("_best", lambda c: c > 0.05 * F.col("_n"))).cast("long").alias("heavy_hitter_count"),
    )


def new_sources(packets: DataFrame, keys: list[str], window: str) -> DataFrame:
    """Sources that a destination sees for the first time ever in a window."""
    first = packets.groupBy("dst", "src").agg(F.min(window).alias(window))
    return first.groupBy("dst", window).agg(F.count("*").alias("new_srcip_rate"))


def window_features(packets: DataFrame, window: Column | None = None) -> DataFrame:
    """A row per (dst, w) with the packet, flag, protocol, diversity, concentration and size features.

    Counts are per window; ratios are 0 to 1.  Exact counts spill, so no set is capped.  Two-level counts are
    partially aggregated before each shuffle, and all parts share (dst, w) as their leading key.
    """
    p = packets.withColumn("w", window if window is not None else F.to_date("ts"))
    keys = ["dst", "w"]
    n = F.count("*")
    tcp = F.count_if(F.col("proto") == 6)
    syn, synack = F.count_if(flagged("flags", SYN | ACK, SYN)), F.count_if(flagged("flags", SYN | ACK, SYN | ACK))
    ack, rst, fin = (F.count_if(flagged("flags", b, b)) for b in (ACK, RST, FIN))
    icmp = F.count_if(F.col("proto") == 1)
    five = F.struct("src", "dst", "src_port", "dst_port", "proto")
    base = p.groupBy(*keys).agg(
        n.alias("packets"),
        F.sum("length").alias("bytes"),
        F.count_distinct(five).alias("flows"),
        syn.alias("syn"),
        synack.alias("syn_ack"),
        ack.alias("ack"),
        rst.alias("rst"),
        fin.alias("fin"),
        ratio(tcp, n).alias("tcp_ratio"),
        ratio(F.count_if(F.col("proto") == 17), n).alias("udp_ratio"),
        ratio(icmp, n).alias("icmp_ratio"),
        ratio(F.count_if(~F.col("proto").isin(1, 6, 17)), n).alias("other_ratio"),
        ratio(synack, syn).alias("syn_ack_ratio"),
        ratio(rst, syn).alias("rst_syn_ratio"),
        ratio(F.sum("length"), n).alias("bytes_per_packet"),
        F.count_distinct("src").alias("unique_src_ips"),
        F.count_distinct("dst_port").alias("unique_dst_ports"),
        F.count_distinct(F.struct("src", "proto")).alias("unique_flows"),
        ratio(syn, tcp).alias("syn_tcp_ratio"),
        ratio(ack, tcp).alias("ack_tcp_ratio"),
        ratio(rst, tcp).alias("rst_tcp_ratio"),
        ratio(fin, tcp).alias("fin_tcp_ratio"),
        ratio(F.count_if(F.col("icmp_type") == 8), icmp).alias("icmp_echo_ratio"),
        ratio(F.count_if(F.col("length") < 100), n).alias("small_pkt_ratio"),
        ratio(F.count_if("fragment"), n).alias("fragment_ratio"),
        ratio(F.sum("ttl"), n).alias("ttl_mean"),
        ratio(ack, syn).alias("tcp_completion_rate"),
        F.bool_or("attack").alias("is_attack"),
    )
    parts = [entropy_of(p, keys, "src", "src_ip_entropy"), entropy_of(p, keys, "src_port", "src_port_entropy"), flow_shares(p, keys, ["src", "proto"]), new_sources(p, keys, "w")]
    out = base
    for part in parts:
        out = out.join(part, keys, "left")
    return out.withColumns({"avg_packets_per_flow": ratio(F.col("packets"), F.col("flows")), "dst_port_density": F.col("unique_dst_ports") * 1000.0 / F.col("packets"), "new_srcip_rate": F.coalesce("new_srcip_rate", F.lit(0).cast("long"))})


def burst_factors(packets: DataFrame, window: Column | None = None, alpha: float = BURST_ALPHA) -> DataFrame:
    """dst, w, burst for every day between a destination's first and last; empty days are steps of 0.

    The factor is 100 x over its moving mean including x; a mean under 1 is seeded with x.

    A destination's days are one ordered fold; their number is the calendar's, not the packets'.
    """
    days = packets.groupBy("dst", (window if window is not None else F.to_date("ts")).alias("w")).agg(F.count("*").alias("n"))
    spans = days.groupBy("dst").agg(F.explode(F.sequence(F.min("w"), F.max("w"))).alias("w"))
    dense = spans.join(days, ["dst", "w"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def step(m: float, x: float) -> tuple:
        m = x if m < 1 else m + alpha * (x - m)
        return m, (100 * x / m if m > 0 else 0.0,)

    return fold(dense, ["dst"], "w", F.col("n"), 0.0, step, ["burst"])


def modal_label(packets: DataFrame, window: Column | None = None) -> DataFrame:
    """The most common label of each (dst, w), ties to the smaller label."""
    p = packets.withColumn("w", window if window is not None else F.to_date("ts"))
    c = p.groupBy("dst", "w", "label").count()
    return c.groupBy("dst", "w").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label"), F.sum("count").alias("packets"))


def multi_window(series: DataFrame, key: str = "dst", order: str = "w", value: str = "n", sizes: tuple[int, ...] = (3, 10)) -> DataFrame:
    """Trailing sums, means, population variances and slopes (0 unless R squared reaches one half) per window size."""
    out = series.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    x, y = F.col("_i").cast("double"), F.col(value).cast("double")
    for size in sizes:
        w = Window.partitionBy(key).orderBy("_i").rowsBetween(1 - size, 0)
        n = F.count("*").over(w)
        mx, my = F.avg(x).over(w), F.avg(y).over(w)
        sxy, sxx, syy = F.avg(x * y).over(w) - mx * my, F.avg(x * x).over(w) - mx * mx, F.avg(y * y).over(w) - my * my
        slope = F.when((sxx > 1e-9) & (syy > 1e-9) & (F.round(sxy * sxy / (sxx * syy), 9) >= 0.5), sxy / sxx).otherwise(0.0)
        out = out.withColumns({f"sum_{size}": F.sum(value).over(w), f"mean_{size}": my, f"var_{size}": F.greatest(syy, F.lit(0.0)), f"slope_{size}": F.when(n >= 3, slope).otherwise(0.0)})
    return out.drop("_i")


def sliding_rates(packets: DataFrame, keys: list[str], ms: str, size: str = "length", width: int = 100, slots: int = 10, warm: int = 1) -> DataFrame:
    """keys, slot, packets and bytes of every slot of ``width`` milliseconds with traffic, the rates of the ``slots`` up to it, and its spike.

    pps and bps are sums over the slots that end with this one, so idle slots count as none without being rows.  spike is the
    slot's packets over the mean slot of the ``slots`` before it, null where fewer than ``warm`` packets came in those.
    """
    s = packets.groupBy(*keys, F.floor(F.col(ms) / width).alias("slot")).agg(F.count("*").alias("packets"), F.sum(size).alias("bytes"))
    along = Window.partitionBy(*keys).orderBy("slot")
    now, before = along.rangeBetween(1 - slots, 0), along.rangeBetween(-slots, -1)
    past = F.coalesce(F.sum("packets").over(before), F.lit(0))
    seconds = width * slots / 1000
    out = s.withColumns({"pps": F.sum("packets").over(now) / seconds, "bps": 8 * F.sum("bytes").over(now) / seconds, "_past": past})
    return out.withColumn("spike", F.when(F.col("_past") >= warm, F.col("packets") * slots / F.col("_past"))).drop("_past")

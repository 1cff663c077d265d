"""Joins that look something up: lists, prefixes, ranges, indicators, schedules and baseline slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions.traffic import cases, network


def longest_prefix(rows: DataFrame, prefixes: DataFrame, ip: str = "ip", ident: str = "event_id") -> DataFrame:
    """Each row with the longest (net, len) that holds its address, null if none: an equi-join per length in use.

    Distinct addresses are cut to every length that occurs, at most 33, so no row is compared with all prefixes.
    """
    lengths = sorted(r[0] for r in prefixes.select("len").distinct().collect())
    cuts = F.array(*[F.struct(F.lit(n).alias("len"), network(F.col(ip), n).alias("net")) for n in lengths])
    if not lengths:
        return rows.withColumns({"net": F.lit(None).cast("long"), "len": F.lit(None).cast("int"), "tag": F.lit(None).cast("string")})
    tried = rows.select(ip).distinct().select(ip, F.inline(cuts))
    best = tried.join(prefixes, ["len", "net"]).groupBy(ip).agg(F.max(F.struct("len", "net", "tag")).alias("_b")).select(ip, "_b.net", "_b.len", "_b.tag")
    return rows.join(best, ip, "left")


def in_ranges(rows: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Each row with the range (first, last, tag) that holds its address, null if none; ranges do not overlap.

    An as-of join: addresses and range starts are ordered together, within the first 16 bits, and each address takes
    the last start before it.  A range over several of these is first cut at them.
    """
    size = 2**16
    octets = F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))
    cut = ranges.withColumn("_o", F.explode(octets)).select("_o", F.greatest("first", F.col("_o") * size).alias("_at"), F.least("last", (F.col("_o") + 1) * size - 1).alias("_end"), "tag", F.lit(None).cast("long").alias(ip))
    asked = rows.select(ip).distinct().select(F.floor(F.col(ip) / size).alias("_o"), F.col(ip).alias("_at"), F.lit(None).cast("long").alias("_end"), F.lit(None).cast("string").alias("tag"), ip)
    w = Window.partitionBy("_o").orderBy("_at", F.col(ip).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_end").isNotNull(), F.struct("_end", "tag")), ignorenulls=True).over(w)
    found = cut.unionByName(asked).withColumn("_hit", last).filter(F.col(ip).isNotNull()).select(ip, F.when(F.col(ip) <= F.col("_hit._end"), F.col("_hit.tag")).alias("tag"))
    # there may be as many addresses as rows
    return rows.join(found.hint("merge"), ip, "left")


def geo_blocked(country: Column, listed: list[str], mode: str, block_unknown: bool) -> Column:
    """Whether an address of ``country`` is blocked by an allow or a deny list; null is unknown."""
    hit = country.isin(*listed)
    return cases((country.isNull(), block_unknown), otherwise=~hit if mode == "allow" else hit)


def list_hit(rows: DataFrame, entries: DataFrame, now: Column, key: str = "src") -> DataFrame:
    """Each row with its first live list entry (black before white, then smallest id): live if it does not expire or not yet."""
    live = entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    first = live.groupBy(key).agg(F.min_by("list_type", F.struct("list_type", "entry_id")).alias("list_type"), F.min(F.struct("list_type", "entry_id"))["entry_id"].alias("entry_id"))
    return rows.join(first, key, "left")


def list_verdict(rows: DataFrame, white: DataFrame, black: DataFrame, prefixes: DataFrame, ip: str = "ip") -> DataFrame:
    """verdict and conflict: exact or prefix whitelist, then exact blacklist, then default; both is a conflict."""
    j = longest_prefix(rows, prefixes, ip).join(white.select(ip, F.lit(True).alias("_w")), ip, "left").join(black.select(ip, F.lit(True).alias("_b")), ip, "left")
    w, b = F.coalesce("_w", F.lit(False)) | F.col("len").isNotNull(), F.coalesce("_b", F.lit(False))
    return j.withColumns({"verdict": cases((w, "whitelisted"), (b, "blacklisted"), otherwise="default"), "conflict": w & b}).drop("_w", "_b", "net", "len", "tag")


def indicator_threat(values: DataFrame, feeds: DataFrame, value: str = "value") -> DataFrame:
    """value, matches, threat: feeds that list the value, whatever its case.

    Three feeds make a threat critical; below that it is high if a feed calls it critical, and medium else.
    """
    f = feeds.groupBy(F.lower("indicator").alias("_k"), "feed").agg(F.bool_or(F.col("severity") == "critical").alias("_worst"))
    hits = values.withColumn("_k", F.lower(value)).join(f, "_k", "left")
    n = F.count("feed")
    threat = cases((n >= 3, "critical"), ((n > 0) & F.bool_or("_worst"), "high"), (n > 0, "medium"), otherwise="none")
    return hits.groupBy(value).agg(n.alias("matches"), threat.alias("threat"))


def indicator_type(value: Column) -> Column:
    """What an indicator is, by the first pattern it matches whole."""
    return cases(
        (value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip"),
        (value.rlike(r"^\d{1,3}(\.\d{1,3}){3}/\d{1,2}$"), "cidr"),
        (value.rlike(r"^[a-fA-F0-9]{32}$"), "md5"),
        (value.rlike(r"^[a-fA-F0-9]{64}$"), "sha256"),
        (value.rlike(r"^https?://"), "url"),
        (value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email"),
        (value.rlike(r"^([a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}$"), "domain"),
        otherwise="unknown",
    )


def by_schedule(rows: DataFrame, schedule: DataFrame, ts: str = "ts", bucket: int = 86400) -> DataFrame:
    """Each row with the label of the first schedule entry [start, stop] that holds its time.

    Entries are cut into buckets of time and joined by them, so a row meets only what is near it.
    """
    b = lambda c: F.floor(F.unix_timestamp(c) / bucket)
    cut = schedule.withColumn("_b", F.explode(F.sequence(b("start"), b("stop"))))
    hit = rows.select("event_id", ts, b(ts).alias("_b")).join(cut, "_b").filter(F.col(ts).between(F.col("start"), F.col("stop"))).groupBy("event_id").agg(F.min_by("attack_label", F.struct("start", "attack_label")).alias("attack_label"))
    return rows.join(hit, "event_id", "left")


def slots(ts: Column) -> dict[str, Column]:
    """Hour of day, and hour of week with Monday's first hour as 0."""
    return {"hour_slot": F.hour(ts), "week_slot": F.weekday(ts) * 24 + F.hour(ts)}

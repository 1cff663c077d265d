"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every historical version of a path is addressed by its content.  Only (blob, rule version) pairs that the
ledger has not seen are scanned; findings belong to blobs and are joined back to all paths that ever held them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,version:int,rank:int,start:bigint,end:bigint>"


@dataclass(frozen=True)
class Rule:
    """One kind of secret: matches are leftmost and non-overlapping, then short ones are dropped."""

    kind: str
    pattern: str
    version: int = 1
    #: group whose length counts, and the least length
    group: int = 0
    least: int = 1
    base: bool = True


#: The kinds the contract lists, in its order, then what this method adds.  A run of one
#: character class that must have n characters is the same as the class repeated n times or more.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def running_sums(xs: Column) -> Column:
    """Sums of an array up to each of its numbers, by steps of 1, 2, 4, ..: n log n additions, whatever n."""
    steps = F.when(F.size(xs) > 1, F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.size(xs) - 0.5)).cast("int")), lambda e: F.pow(F.lit(2), e).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, xs, lambda acc, d: F.transform(acc, lambda x, i: x + F.when(i >= d, F.get(acc, i - d)).otherwise(0)))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<kind, version, rank, start, end>> of one rule in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so running sums of their lengths
    are the positions.  A text is first asked for any match, and read again only if it has one.
    """
    # what a lambda names is computed once: pieces and matches are zipped before anything walks over them
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    # what counts of a match is found in the match alone
    counted = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else F.length(m)
    found = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.struct(F.length(m).cast("long").alias("n"), (counted(m) >= rule.least).alias("ok")))
    zipped = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), found.alias("m"))
    # the last piece has no match after it
    steps = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), lambda x: F.struct((x["gap"] + x["m"]["n"]).alias("step"), x["m"]["n"].alias("n"), x["m"]["ok"].alias("ok")))
    ends = lambda xs: F.arrays_zip(xs.alias("m"), running_sums(F.transform(xs, lambda x: x["step"])).alias("end"))
    kept = lambda xs: F.filter(ends(xs), lambda x: x["m"]["ok"])
    span = lambda x: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rank).alias("rank"), (x["end"] - x["m"]["n"]).alias("start"), x["end"].alias("end"))
    return F.when(text.rlike(rule.pattern), F.flatten(F.transform(F.array(steps), lambda xs: F.transform(kept(xs), span)))).otherwise(no_spans())


def ledger_of(versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind, version: every pair that a scan of ``versions`` (with a ``blob``) covers."""
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    return versions.select("blob").distinct().select("blob", F.inline(pairs))


def addressed(history: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, text, blob for every version; a null text is an empty blob."""
    body = F.coalesce(F.col(text), F.lit(""))
    return history.select(F.col(path).alias("path"), body.alias("text"), F.sha2(body, 256).alias("blob"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans: findings of all pairs that ``ledger`` lacks, for blobs with at least one.

    One version stands for its blob: the smallest path.  The join is by blob and path, so copies of a hot
    blob stay spread out, and the side it hashes has only addresses.  Equal rows of one path are scanned twice and
    collapse by their equal results.
    """
    chosen = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        # a table without rows that planning does not see through: a literal would let the scan of texts move below the
        # join, to versions of blobs that another version stands for
        ledger = versions.sparkSession.range(1).filter("id > 0").select(F.col("id").cast("string").alias("blob"), F.lit("").alias("kind"), F.lit(0).alias("version"))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("_seen"))
    chosen = chosen.join(seen, "blob", "left")
    have = lambda r: F.coalesce(F.array_contains("_seen", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.lit(False))
    todo = chosen.filter(~_all(have(r) for r in rules))
    picked = versions.alias("v").join(todo.hint("shuffle_hash").alias("c"), (F.col("v.blob") == F.col("c.blob")) & F.col("v.path").eqNullSafe(F.col("c.path"))).select("v.blob", "v.text", "c._seen")
    spans = F.concat(*[F.when(~have(r), spans_of(F.col("text"), r, k)).otherwise(no_spans()) for k, r in enumerate(rules)])
    found = picked.select("blob", in_order(spans).alias("spans"))
    return found.filter(F.size("spans") > 0).dropDuplicates(["blob"])


def _all(xs) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x
    return out


def in_order(spans: Column) -> Column:
    """Spans by start, then by the place of their kind among the rules, then by end."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["end"].alias("to"), x.alias("span"))))
    return F.transform(keyed, lambda x: x["span"])


def scan(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The ledger and the findings after ``versions`` are scanned, from those before: one increment.

    ``ledger`` has (blob, kind, version) and ``findings`` (blob, spans) of all increments so far, of all versions of
    rules; only pairs that are new are scanned.  Findings of a blob are kept once, whatever paths hold it.
    """
    known = ledger_of(versions, rules)
    new = scan_unseen(versions, ledger, rules)
    if ledger is not None:
        known = known.unionByName(ledger).distinct()
    if findings is not None:
        new = new.unionByName(findings).groupBy("blob").agg(in_order(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return known, new


def on_paths(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, spans (null if none) for every version: findings of the rules' present versions joined back by content."""
    now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    present = findings.withColumn("spans", F.filter("spans", lambda x: F.array_contains(now, F.struct(x["kind"].alias("kind"), x["version"].alias("version"))))).filter(F.size("spans") > 0)
    return versions.select("path", "blob").join(present, "blob", "left")


def findings_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """One row per document with counts, the base spans' hash and all spans as text.

    Null and empty texts have no spans; equal texts share one scan; equal rows each get a row; an empty table
    gives an empty result.  With ``ledger`` and ``findings`` of earlier scans, only what they lack is scanned.
    """
    versions = addressed(docs, "doc_id")
    spans = F.coalesce("spans", no_spans())
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    names = [r.kind for r in rules if r.base]
    base = F.filter(spans, lambda s: s["kind"].isin(*names))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan(versions, ledger, findings, rules)[1]
    return on_paths(versions, found, rules).select(F.col("path").alias("doc_id"), *[count(k) for k in names], F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))

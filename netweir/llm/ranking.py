"""Ranked lexical search over a tiered index.

Postings of a term are laid in three tiers by impact, the highest first, and the index keeps for each term the most
that a posting below a tier can add (its residual bound).  The first tier of an item's heaviest terms finds candidates,
and the exact scores of the best give a threshold.  Terms whose residual bounds together stay under it cannot bring
a new document, and an item for which that holds of all its terms is proven.  The others fall through, tier by tier:
only their remaining terms are read below.  Last, documents that can still reach the threshold are scored exactly.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small

#: Postings of a term in the first tier, and in the first two.
FIRST, SECOND = 1_024, 32_768
#: Impacts are below a million; tiers are cut between steps of this size.
STEP = 4_096
#: Terms that are looked for while texts are read; beyond that the index takes all terms.
VOCABULARY = 500_000
TOP = 20
#: Terms of an item that find its first candidates, and how many of them for each place are scored exactly.
HEAVY, SEEDS = 12, 10
#: Bounds of terms left unread reach at most this share of the threshold, so that documents met in one or two light
#: terms fall short of it without a look at the rest.
SHARE = 0.7
#: Bytes that are in no term become spaces, A-Z become a-z.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c) in string.digits + string.ascii_lowercase else 0x20 for c in range(256))


@dataclass
class Index:
    """postings: tier, row, term, s (the impact without the term's weight); docs: row, doc; terms: term, df, w, the
    highest s and the residual bounds r0 and r1 of postings below the first and below the second tier; documents and
    terms counted in all."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def counted(batches: Iterator[pa.RecordBatch], wanted: frozenset[bytes] | None) -> Iterator[pa.RecordBatch]:
    """row, doc, n, term, tf: the (wanted) terms of each text with their counts, and a row without a term for each text."""
    for b in small(batches):
        sizes, ns, terms, tfs = [], [], [], []
        for text in b.column(2).to_pylist():
            words = text.encode().translate(FOLD).split() if text else []
            tf = Counter(words if wanted is None else filter(wanted.__contains__, words))
            sizes.append(len(tf) + 1)
            ns.append(len(words))
            terms += [None, *tf]
            tfs += [0, *tf.values()]
        again = pa.array(np.repeat(np.arange(len(b)), sizes))
        yield pa.RecordBatch.from_arrays([b.column(0).take(again), b.column(1).take(again), pa.array(ns, pa.int64()).take(again), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], names=["row", "doc", "n", "term", "tf"])


def term_counts(rows: DataFrame, ident: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """A table of ``counted``: rows are numbered as they are read, and keep their numbers as the table is written."""
    kind = rows.schema[ident].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("doc"), F.col("text"))
    return durable(numbered.mapInArrow(partial(counted, wanted=wanted), f"row long, doc {kind}, n long, term string, tf long"))


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * df + 1))).cast("long")


def impact(n_docs: int, n_terms: int) -> tuple[Column, Column]:
    """m of a document from n, and what a posting adds without the term's weight, from tf and ``_m``."""
    m = 75 + F.expr(f"(25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    return m, F.expr("(1000000000L * tf) div (1000 * tf + 12 * _m)")


def build(docs: DataFrame, ident: str = "doc_id", wanted: frozenset[bytes] | None = None, first: int = FIRST, second: int = SECOND) -> Index:
    """The tiered index of all ``docs``, of all terms or of the ``wanted`` ones.

    Null texts and texts without terms have no postings and are not counted.  A row is a document: equal rows are
    indexed each.  Tiers are cut by counts of impacts, so no term's postings are ordered in one task.
    """
    raw = term_counts(docs, ident, wanted)
    totals = raw.filter("term IS NULL AND n > 0").agg(F.count("*").alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    m, s = impact(totals["d"], totals["t"])
    scored = raw.filter("term IS NOT NULL").withColumn("_m", m).select("row", "term", s.alias("s"))
    df = durable(scored.groupBy("term").agg(F.count("*").alias("df"), F.max("s").alias("top")))
    long = df.filter(F.col("df") > first).select("term")
    steps = scored.join(long, "term").groupBy("term", F.expr(f"s div {STEP}").alias("step")).agg(F.count("*").alias("n"), F.max("s").alias("most"))
    # at most a million / STEP rows of a term
    run = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("step")))
    tiers = steps.withColumn("_run", run).withColumn("tier", F.when(F.col("_run") <= first, 0).when(F.col("_run") <= second, 1).otherwise(2))
    below = lambda k: F.coalesce(F.max(F.when(F.col("tier") > k, F.col("most"))), F.lit(0))
    least = lambda k: F.coalesce(F.min(F.when(F.col("tier") <= k, F.col("step"))), F.lit(1 << 30))
    cuts = durable(tiers.groupBy("term").agg(below(0).alias("r0"), below(1).alias("r1"), least(0).alias("_c0"), least(1).alias("_c1")))
    placed = scored.join(cuts.select("term", "_c0", "_c1"), "term", "left").withColumn("_step", F.expr(f"s div {STEP}"))
    tier = F.when(F.col("_c0").isNull() | (F.col("_step") >= F.col("_c0")), 0).when(F.col("_step") >= F.col("_c1"), 1).otherwise(2)
    postings = durable(placed.select("row", "term", "s", tier.alias("tier")), "tier")
    terms = df.join(cuts.select("term", "r0", "r1"), "term", "left").select("term", "df", "top", weight(totals["d"], F.col("df")).alias("w"), F.coalesce("r0", F.lit(0)).alias("r0"), F.coalesce("r1", F.lit(0)).alias("r1"))
    return Index(postings, raw.filter("term IS NULL").select("row", "doc"), terms, totals["d"], totals["t"])


def _best(scores: DataFrame, by: str, top: int, *ties: Column | str) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(by), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _hits(postings: DataFrame, state: DataFrame) -> DataFrame:
    """item, row and what each posting of a term adds, for the tiers that the term is read in."""
    asked = state.filter("read >= 0").select("item", "term", "weight", "bound", "read")
    return postings.join(asked, "term").filter(F.col("tier") <= F.col("read")).select("item", "row", (F.col("weight") * F.col("s")).alias("add"), "bound")


def _completed(pairs: DataFrame, state: DataFrame, postings: DataFrame) -> DataFrame:
    """``pairs`` (item, row, part) with the exact score: what tiers that were not read add, looked up by row and term."""
    left = state.filter("bound > 0").select("item", "term", "weight", "read")
    asked = pairs.select("item", "row").join(left, "item")
    more = asked.join(postings, ["term", "row"]).filter(F.col("tier") > F.col("read"))
    sums = more.groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("s")).alias("_more"))
    return pairs.join(sums, ["item", "row"], "left").withColumn("score", F.col("part") + F.coalesce("_more", F.lit(0))).drop("_more")


def _bounded(state: DataFrame) -> DataFrame:
    """The most that a posting of each term can add below the tiers it is read in (-1: none is read)."""
    s = F.when(F.col("read") < 0, F.col("top")).when(F.col("read") == 0, F.col("r0")).when(F.col("read") == 1, F.col("r1")).otherwise(0)
    return state.withColumn("bound", F.col("weight") * s)


def _fallen(state: DataFrame, tier: int) -> DataFrame:
    """``state`` after each item's terms that need ``tier`` are marked as read in it.

    An item's terms with the least bounds, as many as stay under its threshold in sum, may stay as they are: a document
    that is met in none of the tiers read cannot come in.  Without a threshold every term is read.  Terms that stayed
    in an earlier turn come first, and still do.
    """
    order = Window.partitionBy("item").orderBy("read", "bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    needed = (F.col("read") == tier - 1) & (F.col("bound") > 0) & (F.coalesce("theta", F.lit(-1)) * SHARE <= F.sum("bound").over(order))
    return _bounded(state.withColumn("_needed", needed).withColumn("read", F.when(F.col("_needed"), tier).otherwise(F.col("read"))).drop("_needed"))


def search(index: Index, items: DataFrame, ident: str = "item_id", top: int = TOP, heavy: int = HEAVY) -> DataFrame:
    """item_id, rank, doc_id, score and tiers (how many an item's terms were read in) of each item's best documents.

    Scores are sums over an item's terms with repeats; equal scores rank by ascending id, null ids last.  Items
    without terms that any document holds have no rows; a row of ``items`` is an item, so equal rows rank each.
    """
    asked = term_counts(items, ident).filter("term IS NOT NULL").select(F.col("row").alias("item"), F.col("doc").alias("_name"), "term", "tf")
    known = asked.join(index.terms.filter("w > 0"), "term").select("item", "_name", "term", (F.col("w") * F.col("tf")).alias("weight"), "top", "r0", "r1")
    # the heaviest terms find the first candidates
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("weight"), "term"))
    state = durable(_bounded(known.withColumn("read", F.when(nth <= heavy, 0).otherwise(-1))))
    first = durable(_best(_hits(index.postings.filter("tier = 0"), state).groupBy("item", "row").agg(F.sum("add").alias("part")), "part", top * SEEDS, "row").drop("rank"))
    # the exact score at place ``top`` of any so many documents is a threshold
    scores = _best(_completed(first, state, index.postings), "score", top)
    theta = scores.filter(F.col("rank") == top).select("item", F.col("score").alias("theta"))
    state = state.join(theta, "item", "left")
    for tier in (0, 1, 2):
        state = _fallen(state, tier)
    state = durable(state)
    # a term that was met adds what it adds, any other at most its bound
    slack = state.groupBy("item", "_name").agg(F.sum("bound").alias("_slack"), F.max("read").alias("_read"), F.max("theta").alias("theta"))
    found = _hits(index.postings, state).groupBy("item", "row").agg(F.sum("add").alias("part"), F.sum(F.col("add") - F.col("bound")).alias("_over"))
    able = found.join(slack, "item").filter(F.col("_over") + F.col("_slack") >= F.coalesce("theta", F.lit(0)))
    exact = _completed(durable(able.select("item", "_name", "row", "part", "_read")), state, index.postings).filter("score > 0")
    named = exact.join(index.docs, "row")
    best = _best(named, "score", top, F.asc_nulls_last("doc"), "row")
    return best.select(F.col("_name").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score", (F.col("_read") + 1).alias("tiers"))


def wanted_terms(items: DataFrame, ident: str = "item_id", most: int = VOCABULARY) -> frozenset[bytes] | None:
    """The items' terms, or None if there are more than ``most``."""
    rows = term_counts(items, ident).select("term").filter("term IS NOT NULL").distinct().limit(most + 1).collect()
    return None if len(rows) > most else frozenset(r[0].encode() for r in rows)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """``search`` for ``items`` over an index of all ``docs``, which keeps the terms that items hold."""
    return search(build(docs, wanted=wanted_terms(items), first=first, second=second), items, top=top)

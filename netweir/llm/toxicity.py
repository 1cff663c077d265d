"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is logistic in its words; a document's is the noisy-or of its sentences and of a leak, the
chance of a label without a sentence to explain it.  Sentences without a weighted word take no part, so long texts
do not become toxic by their length.  Weights are fitted to document labels through the noisy-or, so the sentences that
explain a label stand out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, small

#: The fit sees at most this many distinct labelled texts of either label, drawn by a hash of the text.
SAMPLE = 4_000
#: Words and beginnings of words the model may weigh: the most telling of the sample.
TERMS = 600
LEAST_DOCUMENTS = 4
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Beginnings let forms of one word, some of them unseen, share what is learned.
BEGINNINGS = (4, 6)


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans between full stops, question and exclamation marks and line ends that hold a word."""
    return [m.span() for m in SENTENCE.finditer(text) if WORD.search(m[0])]


class ToxicityModel:
    """Weights of terms, the intercept of a sentence, and the log odds of the leak."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """The sum over a word's terms; words met before are remembered, up to a bound."""
        w = self.known.get(word)
        if w is None:
            w = sum(self.weights.get(x, 0.0) for x in terms_of(word))
            if len(self.known) < 20_000:
                self.known[word] = w
        return w

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower()[:1] for c in text)
        out = []
        for s, e in sentences(low):
            known = [x for w in sorted(set(WORD.findall(low[s:e]))) if (x := self.weight(w))]
            out.append((s, e, float(1 / (1 + np.exp(-self.bias - sum(known)))) if known else 0.0))
        return out

    def document(self, text: str) -> tuple[float, int, float]:
        """Noisy-or of the leak and the sentences, their number, and the largest; a text without words has the leak."""
        low = text.lower()
        n, log_clean, worst = 0, -np.logaddexp(0, self.leak), -np.inf
        hit = {w: x for w in set(WORD.findall(low)) if (x := self.weight(w))}
        for m in SENTENCE.finditer(low):
            if not hit:
                n += bool(WORD.search(m[0]))
                continue
            words = set(WORD.findall(m[0]))
            n += bool(words)
            if found := words & hit.keys():
                z = self.bias + sum(hit[w] for w in sorted(found))
                log_clean -= np.logaddexp(0, z)
                worst = max(worst, z)
        return float(-np.expm1(log_clean)), n, float(1 / (1 + np.exp(-worst)))


def telling(ones: int, zeros: int) -> Column:
    """The likelihood ratio statistic of a term by ``in_ones`` and ``in_zeros``, negative for terms of clean texts."""
    k1, k0 = F.col("in_ones"), F.col("in_zeros")
    p = (k1 + k0) / (ones + zeros)
    half = lambda k, n: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)
    g = 2 * (half(k1, ones) + half(k0, zeros))
    return F.when(k1 * zeros > k0 * ones, g).otherwise(-g)


@dataclass
class Bags:
    """Labelled documents as sentences of term numbers: ``term[i]`` is in sentence ``of[i]``; sentence j is in document ``doc[j]`` ``times[j]`` times."""

    terms: list[str]
    labels: np.ndarray
    term: np.ndarray
    of: np.ndarray
    doc: np.ndarray
    times: np.ndarray


def bags(labelled: DataFrame, terms: int = TERMS) -> Bags:
    """Counts and encodes ``labelled`` (text, toxic 0/1) in tasks; numbers of at most ``terms`` terms reach the driver."""
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    none = np.zeros(0, np.int64)
    if ones in (0, n):
        return Bags([], np.repeat(int(ones > 0), n), none, none, none, none)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found, labels = [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {x for w in set(WORD.findall(text.lower())) for x in terms_of(w)}
                found += own
                labels += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())], names=["term", "toxic"])

    seen = labelled.select("text", "toxic").mapInArrow(count, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("in_ones"), F.sum(1 - F.col("toxic")).alias("in_zeros")).filter(F.col("in_ones") + F.col("in_zeros") >= LEAST_DOCUMENTS)
    chosen = [r["term"] for r in seen.orderBy(telling(ones, n - ones).desc(), "term").limit(terms).select("term").collect()]
    index = {w: i for i, w in enumerate(chosen)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for text in b.column(0).to_pylist():
                low, own = text.lower(), Counter()
                for s, e in sentences(low):
                    ids = tuple(sorted(index[x] for w in set(WORD.findall(low[s:e])) for x in terms_of(w) if x in index))
                    own[ids] += bool(ids)
                out.append([{"ids": list(ids), "n": k} for ids, k in sorted(own.items()) if k])
            kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, kind)], names=["toxic", "_h", "sentences"])

    rows = sorted(labelled.select("text", "toxic", "_h").mapInArrow(encode, "toxic int, _h long, sentences array<struct<ids:array<int>,n:int>>").collect(), key=lambda r: r["_h"])
    each = [(d, x["ids"], x["n"]) for d, r in enumerate(rows) for x in r["sentences"]]
    return Bags(chosen, np.array([r["toxic"] for r in rows], np.int64), np.array([i for _, ids, _ in each for i in ids], np.int64), np.repeat(np.arange(len(each)), [len(ids) for _, ids, _ in each]), np.array([d for d, _, _ in each], np.int64), np.array([k for _, _, k in each], np.int64))


def fit(data: Bags, rounds: int = 400, l1: float = 0.1, l2: float = 1e-4) -> ToxicityModel:
    """Gradient descent (Adam, all documents at once) on the log loss of the noisy-or; weights start at 0.

    Without both labels the model has no terms and the leak is the share of label 1.
    """
    y = data.labels.astype(float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, 0.0, float(np.log(share / (1 - share))))
    n = len(data.terms)
    w, b, c = np.zeros(n), -4.0, -4.0
    m, v = np.zeros(n + 2), np.zeros(n + 2)
    for r in range(1, rounds + 1):
        z = b + np.bincount(data.of, w[data.term], minlength=len(data.doc))
        log_clean = -np.bincount(data.doc, data.times * np.logaddexp(0, z), minlength=len(y)) - np.logaddexp(0, c)
        clean = np.exp(log_clean)
        # d loss / d log_clean
        g = (1 - y) * -1.0 + y * clean / np.maximum(1 - clean, 1e-9)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-c))
        gz = -g[data.doc] * p * data.times
        grad = np.append(np.bincount(data.term, gz[data.of], minlength=n) / len(y) + l2 * w, [gz.sum() / len(y), -g.sum() * p0 / len(y)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        w, b, c = w - step[:-2], b - step[-2], c - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * l1 / len(y) / (np.sqrt(v[:-2] / (1 - 0.999**r)) + 1e-8), 0)
    return ToxicityModel({t: float(x) for t, x in zip(data.terms, w, strict=True) if x}, float(b), float(c))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold (crc32 of doc_id as text, mod 5, is 0).

    Up to ``sample`` distinct texts of each label are drawn by a hash of the text.  A document labelled twice counts
    with its largest label; labels other than 0 and 1 count as none.
    """
    marked = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # only ids and hashes meet the labels; the texts drawn are then at most two samples
    light = docs.filter(F.col("text").isNotNull() & ~held_out()).select("doc_id", F.xxhash64("text").alias("_h"))
    hashes = durable(light.join(marked, "doc_id").groupBy("_h").agg(F.max("toxic").cast("int").alias("toxic")))
    drawn = hashes.filter("toxic = 1").orderBy("_h").limit(sample).unionByName(hashes.filter("toxic = 0").orderBy("_h").limit(sample))
    picked = docs.filter("text IS NOT NULL").select("text", F.xxhash64("text").alias("_h")).join(F.broadcast(drawn), "_h")
    return fit(bags(durable(picked.groupBy("_h").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))), terms))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with score, predicted, n_sentences and worst_sentence; columns of those names are replaced.

    Whole texts are read; null and empty texts have no sentence, so their score is the leak.  The model, at most ``TERMS``
    words, travels with the tasks.
    """
    ours = ("score", "predicted", "n_sentences", "worst_sentence")
    names = [c for c in docs.columns if c not in ours]
    schema = docs.select(*names).schema
    for c, kind in zip(ours, ("double", "integer", "long", "double"), strict=True):
        schema = schema.add(c, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = [model.document(x or "") for x in b.column(len(names)).to_pylist()]
            score = np.array([r[0] for r in rows], dtype=np.float64)
            new = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], *new], names=[*names, *ours])

    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(run, schema)


def offending(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points), sentence, score of every sentence that scores at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ids, rows = [], []
            for i, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for s, e, p in model.sentence_scores(t or ""):
                    if p >= least:
                        ids.append(i.as_py())
                        rows.append((s, e, t[s:e], p))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], names=["doc_id", "start", "end", "sentence", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, end long, sentence string, score double")


def score_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    light = scored(docs.select("doc_id", "text"), model)
    return light.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_sentences", "worst_sentence")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic.  A row travels as one value, so columns of any name are kept."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"))
    return scored(rows, train(docs, labels), "_doc.text").filter("predicted = 0").select("_doc.*")

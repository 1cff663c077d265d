"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage.

Items are the documents of the index and passages its queries.  A score is measured against the item's score for
itself, so one threshold serves items of all lengths.  Block-max WAND retrieves every item above it; a match
counts once the words of the question and of the answer are found in order.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, string_bytes
from .substrings import SLICE, Powers, word_hashes

K1, B = 1.2, 0.75
#: The least share of an item's own BM25 score.
THRESHOLD = 0.6
#: The least share of an item's words found in order, and of its question's and answer's words alone.
OVERLAP, PART_OVERLAP = 0.8, 0.5
#: Postings in a block.
BLOCK = 16
#: Runs of items whose bounds are checked for every passage before its postings are opened.
RUNS = 64
#: Items of one index; a longer benchmark is cut into several, each queried in turn.
ITEMS = 20_000
#: Indexes that travel together, so that texts are read once for all of them.
TOGETHER = 8
#: Shorter items have no index; they are found as exact runs of words.
LEAST_WORDS = 4
#: ASCII letters and digits and every byte of other scripts are word characters.
BLACK = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
LOW = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
SCHEMA = "item_id long, score double, question_overlap double, answer_overlap double, first_word int"
SENTENCE_END = re.compile(rb"[.!?]+[\s\"')\]]*")


def hashed(data: np.ndarray, off: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(LOW[data], off, powers, BLACK[data])


def question_and_answer(text: bytes) -> tuple[bytes, bytes]:
    """All sentences but the last, and the last; the only sentence is all question."""
    ends = [m.end() for m in SENTENCE_END.finditer(text) if m.end() < len(text.rstrip())]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, b"")


class Postings:
    """One term's items in order, its impacts, and the largest impact of each block."""

    __slots__ = ("items", "impacts", "most", "last", "peak")

    def __init__(self, items: list[int], impacts: list[float]):
        self.items, self.impacts = items, impacts
        self.most = [max(impacts[i : i + BLOCK]) for i in range(0, len(items), BLOCK)]
        self.last = [items[min(i + BLOCK, len(items)) - 1] for i in range(0, len(items), BLOCK)]
        self.peak = max(impacts)


class LeakIndex:
    """Items of at least ``LEAST_WORDS`` words, and beside the index the runs of words that shorter ones are."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_length: float):
        self.ids: list[int] = []
        self.words: list[list[int]] = []
        self.parts: list[int] = []
        self.short: dict[int, list[tuple[int, list[int]]]] = {}
        powers = Powers()
        split = [(ident, *(self._words(x, powers) for x in question_and_answer(text.encode()))) for ident, text in items]
        for ident, q, a in sorted(split, key=lambda x: (len(x[1]) + len(x[2]), x[0])):
            if len(q) + len(a) >= LEAST_WORDS:
                self.ids.append(ident)
                self.words.append(q + a)
                self.parts.append(len(q))
            elif q or a:
                self.short.setdefault(len(q + a), []).append((ident, q + a))
        self.vocabulary = np.array(sorted({w for ws in self.words for w in ws}), dtype=np.uint64)
        number = {int(h): i for i, h in enumerate(self.vocabulary.tolist())}
        self.words = [[number[w] for w in ws] for ws in self.words]
        self.shares: list[dict[int, float]] = []
        lists: dict[int, tuple[list[int], list[float]]] = {}
        for i, ws in enumerate(self.words):
            tf: dict[int, int] = {}
            for w in ws:
                tf[w] = tf.get(w, 0) + 1
            impact = {}
            for w, f in tf.items():
                n = df.get(int(self.vocabulary[w]), 1)
                impact[w] = np.log(1 + (n_items - n + 0.5) / (n + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean_length))
            own = sum(impact.values())
            self.shares.append({w: float(x / own) for w, x in impact.items()})
            for w, x in impact.items():
                items_of, impacts = lists.setdefault(w, ([], []))
                items_of.append(i)
                impacts.append(float(x / own))
        self.postings = [Postings(*lists[w]) for w in range(len(self.vocabulary))]
        self.peak = np.array([p.peak for p in self.postings])
        # peaks of runs of items, for bounds of many passages at once; items are in order of length, like by like
        run = max(4, -(-len(self.words) // RUNS))
        self.runs = np.zeros((len(self.vocabulary), -(-max(1, len(self.words)) // run)), np.float32)
        for w, p in enumerate(self.postings):
            np.maximum.at(self.runs[w], np.array(p.items) // run, np.array(p.impacts, np.float32))
        self.stride = max(map(len, self.words), default=1)
        # a table by leading bits finds a word's number; words that share them stand next to each other
        self.shift = np.uint64(64 - 16)
        top = (self.vocabulary >> self.shift).astype(np.int64)
        self.slot = np.searchsorted(top, np.arange(2**16 + 1)).astype(np.int32)
        self.depth = int(np.diff(self.slot).max()) if len(top) else 0

    @staticmethod
    def _words(text: bytes, powers: Powers) -> list[int]:
        data = np.frombuffer(text, np.uint8)
        return hashed(data, np.array([0, len(data)]), powers)[0].tolist() if len(data) else []

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of every word, -1 for words of no item."""
        out = np.full(len(h), -1, np.int32)
        top = (h >> self.shift).astype(np.int64)
        first, end = self.slot[top], self.slot[top + 1]
        for d in range(self.depth):
            at = np.flatnonzero(first + d < end)
            hit = self.vocabulary[first[at] + d] == h[at]
            out[at[hit]] = first[at[hit]] + d
        return out

    def candidates(self, numbers: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """(text, first word, last word + 1, terms) of passages whose terms' peaks could reach the threshold.

        Passages are twice as long as the longest item and begin that many words apart, so every item-long run lies in
        one.  Peaks are first summed over all places, then those of runs of items over distinct terms.
        """
        value = np.concatenate(([0.0], np.cumsum(np.where(numbers >= 0, self.peak[numbers], 0.0)))) if len(self.peak) else np.zeros(len(numbers) + 1)
        n = np.diff(first)
        many = np.maximum(-(-n // self.stride) - 1, (n > 0).astype(n.dtype))
        text = np.repeat(np.arange(len(n)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        begin = first[text] + nth * self.stride
        end = np.minimum(begin + 2 * self.stride, first[text + 1])
        out = []
        for p in np.flatnonzero(value[end] - value[begin] >= THRESHOLD).tolist():
            terms = np.unique(numbers[begin[p] : end[p]])
            terms = terms[terms >= 0]
            if self.runs[terms].sum(axis=0).max(initial=0) >= THRESHOLD - 1e-4:
                out.append((int(text[p]), int(begin[p]), int(end[p]), terms))
        return out

    def above(self, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item, score) of every item whose score reaches the threshold, by block-max WAND."""
        lists = [self.postings[t] for t in terms.tolist()]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        out = []

        def forward(c: int, item: int) -> None:
            at[c] = bisect_left(lists[c].items, item, at[c])

        while True:
            live = [c for c in live if at[c] < len(lists[c].items)]
            live.sort(key=lambda c: lists[c].items[at[c]])
            total, pivot = 0.0, -1
            for k, c in enumerate(live):
                total += lists[c].peak
                if total >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            blocks = [(c, bisect_left(lists[c].last, item, at[c] // BLOCK)) for c in live[: pivot + 1]]
            if sum(lists[c].most[b] for c, b in blocks if b < len(lists[c].most)) >= threshold - 1e-12:
                if lists[live[0]].items[at[live[0]]] == item:
                    here = live[: pivot + 1]
                    score = sum(lists[c].impacts[at[c]] for c in here)
                    if score >= threshold - 1e-12:
                        out.append((item, score))
                    for c in here:
                        at[c] += 1
                else:
                    for c in live[: pivot + 1]:
                        forward(c, item)
            else:
                after = min([lists[c].last[b] + 1 for c, b in blocks if b < len(lists[c].last)] + ([lists[live[pivot + 1]].items[at[live[pivot + 1]]]] if pivot + 1 < len(live) else []))
                for c in live[: pivot + 1]:
                    forward(c, max(after, item + 1) if after <= item else after)

    def overlaps(self, item: int, passage: list[int]) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's words that the passage has in order."""
        words, cut = self.words[item], self.parts[item]
        q, a = in_order(words[:cut], passage), in_order(words[cut:], passage)
        answer = len(words) - cut
        return in_order(words, passage) / len(words), q / cut if cut else 1.0, a / answer if answer else 1.0

    def verified(self, item: int, passage: np.ndarray) -> tuple[float, float, float, int] | None:
        """(score, overlaps, first word) of the best window of the passage that holds the item.

        Windows are twice as long as the item and begin half of it apart, so words that lie scattered over a
        longer passage are no match.
        """
        words = self.words[item]
        size, step, n = 2 * len(words), max(1, len(words) // 2), len(passage)
        own = np.concatenate(([0], np.cumsum(np.isin(passage, words))))
        begin = np.arange(0, max(0, n - size) + step, step)
        begin = begin[begin < n]
        end = np.minimum(begin + size, n)
        best = None
        for w in np.flatnonzero(own[end] - own[begin] >= OVERLAP * len(words) - 1e-9).tolist():
            window = passage[begin[w] : end[w]].tolist()
            whole, question, answer = self.overlaps(item, window)
            if whole >= OVERLAP and min(question, answer) >= PART_OVERLAP:
                score = sum(self.shares[item].get(t, 0.0) for t in set(window))
                if score >= THRESHOLD - 1e-12 and (best is None or (score, question, answer) > best[:3]):
                    best = (score, question, answer, int(begin[w]))
        return best

    def matches(self, numbers: np.ndarray, first: np.ndarray) -> dict[int, dict[int, tuple[float, float, float, int]]]:
        """For each text with any, its verified items: (score, overlaps, first word of the window), the best window of each."""
        found: dict[int, dict[int, tuple[float, float, float, int]]] = {}
        for text, begin, end, terms in self.candidates(numbers, first):
            for item, _ in self.above(terms):
                if best := self.verified(item, numbers[begin:end]):
                    own = found.setdefault(text, {})
                    new = (*best[:3], begin - int(first[text]) + best[3])
                    if self.ids[item] not in own or new[:3] > own[self.ids[item]][:3]:
                        own[self.ids[item]] = new
        return found

    def all_matches(self, h: np.ndarray, first: np.ndarray) -> dict[int, dict[int, tuple[float, float, float, int]]]:
        """``matches``, and the items under ``LEAST_WORDS`` words, found where all their words follow one another."""
        found = self.matches(self.numbers(h), first) if self.ids else {}
        for n, items in self.short.items():
            if len(h) < n:
                continue
            heads = np.flatnonzero(np.isin(h[: len(h) - n + 1], np.array([w[0] for _, w in items], np.uint64)))
            text = np.searchsorted(first, heads, "right") - 1
            inside = heads + n <= first[text + 1]
            heads, text = heads[inside], text[inside]
            for ident, words in items:
                hit = np.ones(len(heads), bool)
                for d, w in enumerate(words):
                    hit &= h[heads + d] == np.uint64(w)
                for t, at in zip(text[hit].tolist(), heads[hit].tolist(), strict=True):
                    found.setdefault(t, {}).setdefault(ident, (1.0, 1.0, 1.0, at - int(first[t])))
        return found


def in_order(words: list[int], passage: list[int]) -> int:
    """The length of the longest common subsequence, a bit for each word."""
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(words)) - 1
    v = full
    for w in passage:
        if u := v & masks.get(w, 0):
            v = (v + u | v - u) & full
    return len(words) - v.bit_count()


def indexes(benchmark: DataFrame, ident: str = "item_id", text: str = "text", items: int = ITEMS) -> list[LeakIndex]:
    """Indexes of all items with an id and a text; term and length statistics are of the whole benchmark.

    Each holds about ``items`` items at most, which bounds what the driver builds and the tasks receive.
    """
    rows = benchmark.select(F.col(ident).cast("long").alias("item"), F.col(text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            data, off = string_bytes(b.column(0))
            h, first = hashed(data, off, powers) if len(data) else (np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
            who = np.repeat(np.arange(len(off) - 1), np.diff(first))
            pair = np.unique(np.stack([who.astype(np.uint64), h]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(np.ones(pair.shape[1], np.int64)), pa.array(np.zeros(pair.shape[1], np.int64))], names=["term", "df", "words"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(off) - 1]), pa.array([len(h)], pa.int64())], names=["term", "df", "words"])

    stats = rows.select("text").mapInArrow(terms, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    total = stats.filter("term IS NULL").first()
    if total is None:
        return []
    n, mean = total["df"], max(1.0, total["words"] / total["df"])
    shards = -(-n // items)
    out = []
    for s in range(shards):
        own = rows.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == s)
        held = own.select("text").mapInArrow(terms, "term long, df long, words long").filter("term IS NOT NULL").select("term").distinct()
        df = {r["term"] % 2**64: r["df"] for r in stats.join(held, "term").select("term", "df").collect()}
        out.append(LeakIndex([(r["item"], r["text"]) for r in own.collect()], df, n, mean))
    return [x for x in out if x.ids or x.short]


def _slices(col: pa.Array, powers: Powers) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words before each row) of runs of rows of bounded text."""
    data, off = string_bytes(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
        part = data[off[at] : off[to]]
        if len(part):
            yield at, *hashed(part, off[at : to + 1] - off[at], powers)
        at = to


def _passes(docs: DataFrame, benchmark: DataFrame, items: int) -> Iterator[Broadcast]:
    """Broadcasts of up to ``TOGETHER`` indexes of ``items`` items each."""
    every = indexes(benchmark, items=items)
    for at in range(0, len(every), TOGETHER):
        yield docs.sparkSession.sparkContext.broadcast(every[at : at + TOGETHER])


def leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", items: int = ITEMS) -> DataFrame:
    """``ident``, item_id, score, question_overlap, answer_overlap, first_word of every verified match of every row.

    Each text is read whole, by one task and once for ``TOGETHER * items`` items, so nothing is shuffled.  Null and empty
    texts match nothing; equal rows each get rows; without items or documents the result is empty.
    """
    kind = docs.schema[ident].dataType.simpleString()
    out = None
    for sent in _passes(docs, benchmark, items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            powers = Powers()
            for b in batches:
                rows, found = [], []
                for at, h, first in _slices(b.column(1), powers):
                    for index in sent.value:
                        for text, items in index.all_matches(h, first).items():
                            for item, m in sorted(items.items()):
                                rows.append(at + text)
                                found.append((item, *m))
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()), strict=True)]], names=[ident, "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        part = docs.select(ident, "text").mapInArrow(run, f"{ident} {kind}, {SCHEMA}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.select(ident).filter("false").selectExpr(ident, *[f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in SCHEMA.split(", ")])
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """``docs`` without the rows that hold a verified test item."""
    for sent in _passes(docs, benchmark, items):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            powers = Powers()
            for b in small(batches):
                clean = np.ones(len(b), bool)
                for at, h, first in _slices(b.column(b.schema.get_field_index("text")), powers):
                    for index in sent.value:
                        for text in index.all_matches(h, first):
                            clean[at + text] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

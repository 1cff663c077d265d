"""Substring dedup with an FM-index per shard.

Windows of words are routed by their smallest hash of a few words, so equal windows meet in one shard, and only
stretches whose anchor occurs twice in the corpus travel.  A shard's distinct stretches are indexed; streaming them
through the index by backward search gives the windows that occur twice or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small, string_bytes
from .fmindex import FMIndex

WINDOW = 35
#: Words in an anchor.
GRAM = 6
#: Words in one index; a shard's stretches are indexed in turns, each with all stretches of its anchors.
INDEX_WORDS = 600_000
#: Anchors with more stretches than this, or with more words in them than an index has, copies included, are
#: counted window by window instead, so many rows at a time.
STRETCHES = 8_192
WINDOW_ROWS = 65_536
#: Anchors more common than this are chosen last, up to so many of the most common.  Any choice that only
#: depends on a window's words is right; this one keeps what surrounds a common line from meeting at that line.
COMMON, COMMON_KEPT = 256, 65_536
#: Bytes of text that are worked on at once.
SLICE = 1_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were ever needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            step = np.full(size, BASE, np.uint64)
            back = np.full(size, INVERSE, np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, off: np.ndarray, powers: Powers, black: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before every text): words are runs of ``black`` bytes, by default those that
    are not ASCII white space, and end with their text."""
    n = len(data)
    if black is None:
        black = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins, ends = black.copy(), black.copy()
    begins[1:] &= ~black[:-1] | edge[1:n]
    ends[:-1] &= ~black[1:] | edge[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return _mixed((total[e] - total[s]) * down[s]), np.searchsorted(s, off)


class Common:
    """A bounded set of anchors, with a bitmap that tells most others apart at once."""

    def __init__(self, anchors: list[int]):
        self.sorted = np.sort(np.array(anchors, dtype=np.int64).view(np.uint64))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self._low(self.sorted)] = True

    @staticmethod
    def _low(g: np.ndarray) -> np.ndarray:
        return (g & np.uint64((1 << 20) - 1)).astype(np.int64)

    def last(self, g: np.ndarray) -> np.ndarray:
        """Hashes halved, the common ones put above all others."""
        out = g >> np.uint64(1)
        if len(self.sorted):
            maybe = np.flatnonzero(self.bitmap[self._low(out)])
            at = np.minimum(np.searchsorted(self.sorted, out[maybe]), len(self.sorted) - 1)
            out[maybe[self.sorted[at] == out[maybe]]] |= np.uint64(1 << 63)
        return out


def stretches(h: np.ndarray, first: np.ndarray, window: int, gram: int, common: Common) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start word in it, words, anchor, times the anchor is in it) of runs of windows with one anchor."""
    none = np.zeros(0, np.int64)
    n = len(h)
    if n < window:
        return none, none, none, none, none
    g = h[: n - gram + 1].copy()
    for j in range(1, gram):
        g = g * np.uint64(BASE) + h[j : n - gram + 1 + j]
    g = grams = common.last(_mixed(g))
    span, size = window - gram + 1, 1
    while size * 2 <= span:
        g, size = np.minimum(g[:-size], g[size:]), size * 2
    if span > size:
        g = np.minimum(g[: len(g) - (span - size)], g[span - size :])
    # a window lies within one text
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = np.flatnonzero(of[: n - window + 1] == of[window - 1 :])
    if not len(ok):
        return none, none, none, none, none
    anchor, text = g[ok], of[ok]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    at = np.flatnonzero(new)
    words = np.diff(np.append(at, len(ok))) + window - 1
    # equal windows of one stretch have its anchor twice
    held = words - gram + 1
    begin = np.cumsum(held) - held
    same = grams[np.arange(held.sum()) + np.repeat(ok[at] - begin, held)] == np.repeat(anchor[at], held)
    return text[at], ok[at] - first[text[at]], words, anchor[at].view(np.int64), np.add.reduceat(same, begin, dtype=np.int64)


def _anchored(batches: Iterator[pa.RecordBatch], window: int, gram: int, common: Common) -> Iterator[pa.RecordBatch]:
    """key, anchor, start, words, times for every stretch of texts (id, text, key)."""
    powers = Powers()
    for b in batches:
        data, off = string_bytes(b.column(1))
        keys = np.asarray(b.column(2))
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1)
            part, where = data[off[at] : off[to]], off[at : to + 1] - off[at]
            if len(part):
                h, first = word_hashes(part, where, powers)
                text, start, words, anchor, times = stretches(h, first, window, gram, common)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at + text]), pa.array(anchor), pa.array(start.astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(times.astype(np.int32))], names=["key", "anchor", "start", "words", "times"])
            at = to


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, anchor, hot, start, stretch for texts (.., text, key, marks); words of a stretch are joined by one space."""
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())

    def rows(out: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["key", "anchor", "hot", "start", "stretch"])

    for b in small(batches):
        out: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for text, key, own in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            words = text.encode().split()
            for m in own:
                s = m["start"]
                body = b" ".join(words[s : s + m["words"]])
                for col, x in zip(out, (key, m["anchor"], m["hot"], s, body), strict=True):
                    col.append(x)
                size += len(body)
            if size > SLICE:
                yield rows(out)
                out, size = ([], [], [], [], []), 0
        yield rows(out)


def covered(flags: np.ndarray, window: int) -> list[dict[str, int]]:
    """Intervals of words that flagged windows cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > window)
    begin, end = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + window
    return [{"begin": int(x), "end": int(y)} for x, y in zip(begin, end, strict=True)]


def index_shard(pieces: list[bytes], counts: list[int], window: int) -> list[list[dict[str, int]]]:
    """Intervals to remove in each of distinct ``pieces``: windows in the index twice, or all if the piece is."""
    numbers: dict[bytes, int] = {b"": 0}
    text: list[int] = []
    lengths = []
    for p in pieces:
        words = p.split(b" ")
        text += [numbers.setdefault(w, len(numbers)) for w in words]
        text.append(0)
        lengths.append(len(words))
    symbols, size = np.array(text, np.int64), np.array(lengths, np.int64)
    starts = np.cumsum(size + 1) - size - 1
    single = np.flatnonzero(np.array(counts) == 1)
    out: list[list[dict[str, int]]] = [[{"begin": 0, "end": n}] for n in lengths]
    if len(single):
        index = FMIndex(symbols, window)
        for i, flags in zip(single.tolist(), index.repeated(starts[single], size[single], symbols), strict=True):
            out[i] = covered(flags, window)
    return out


def _indexed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """anchor, stretch, intervals for distinct stretches (anchor, stretch, n) that arrive anchor by anchor."""
    anchors: list[int] = []
    pieces: list[bytes] = []
    counts: list[int] = []
    size = 0

    def out(to: int) -> pa.RecordBatch:
        found = index_shard(pieces[:to], counts[:to], window)
        some = [i for i, x in enumerate(found) if x]
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([anchors[i] for i in some], pa.int64()), pa.array([pieces[i] for i in some], pa.binary()), pa.array([found[i] for i in some], kind)], names=["anchor", "stretch", "intervals"])

    for b in batches:
        for anchor, piece, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if size >= INDEX_WORDS and anchor != anchors[-1]:
                yield out(len(pieces))
                anchors, pieces, counts, size = [], [], [], 0
            anchors.append(anchor)
            pieces.append(piece)
            counts.append(n)
            size += piece.count(b" ") + 2
    if pieces:
        yield out(len(pieces))


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """s1, s2, n, begin, w1, w2 (the window's 128-bit hash) for every window of stretches (s1, s2, n, stretch)."""
    rows: list[int] = []
    begins: list[int] = []
    digests: list[bytes] = []

    def out(b: pa.RecordBatch) -> pa.RecordBatch:
        take = pa.array(rows, pa.int64())
        w = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        made = pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(3)], pa.array(begins, pa.int32()), pa.array(w[:, 0]), pa.array(w[:, 1])], names=["s1", "s2", "n", "begin", "w1", "w2"])
        rows.clear(), begins.clear(), digests.clear()
        return made

    for b in batches:
        for row in range(len(b)):
            words = b.column(3)[row].as_py().split(b" ")
            for i in range(len(words) - window + 1):
                rows.append(row)
                begins.append(i)
                digests.append(hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest())
                if len(rows) == WINDOW_ROWS:
                    yield out(b)
        yield out(b)


def repeated_intervals(texts: DataFrame, scan: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = STRETCHES, most_words: int = INDEX_WORDS) -> DataFrame:
    """key, intervals (begin, end in words) for texts (id, text, key) with a window that occurs twice or more.

    Texts with one key are the same text.  ``scan`` has the same rows before they were shuffled.  Counting happens before and while stretches are shuffled, so copies and
    common passages do not gather; an anchor with more than ``most`` stretches or ``most_words`` words is not indexed, but the windows of its
    distinct stretches are counted one by one, which is exact as well.
    """
    shape = "key long, anchor long, start int, words int, times int"
    first = scan.mapInArrow(lambda it: _anchored(it, window, gram, Common([])), shape).groupBy("anchor").count().filter(F.col("count") > COMMON)
    common = Common([r[0] for r in first.orderBy(F.desc("count"), "anchor").limit(COMMON_KEPT).select("anchor").collect()])
    marks = durable(texts.mapInArrow(lambda it: _anchored(it, window, gram, common), shape))
    # counts are summed before they are shuffled and joined back, so that a common anchor is no group of rows
    counts = marks.groupBy("anchor").agg(F.sum("times").alias("total"), ((F.count("*") > most) | (F.sum("words") > most_words)).alias("hot")).filter("total > 1").select("anchor", "hot")
    twice = marks.join(counts, "anchor")
    lists = twice.groupBy("key").agg(F.collect_set(F.struct("start", "words", "anchor", "hot")).alias("marks"))
    # all columns go through, so that every reader of ``texts`` shares one shuffle of them
    cut = texts.join(lists.hint("shuffle_hash"), "key").select(*texts.columns, "marks").mapInArrow(_cut, "key long, anchor long, hot boolean, start int, stretch binary")
    # hot is an aggregate, so that filters on it stay above the shuffle and both branches read one
    distinct = cut.groupBy("anchor", "stretch").agg(F.count("*").cast("int").alias("n"), F.max("hot").alias("hot"))
    name = [F.xxhash64("stretch").alias("s1"), F.xxhash64(F.lit(1), "stretch").alias("s2")]
    cold = distinct.filter("NOT hot").select("anchor", "stretch", "n").repartition("anchor").sortWithinPartitions("anchor")
    found = cold.mapInArrow(lambda it: _indexed(it, window), "anchor long, stretch binary, intervals array<struct<begin:int,end:int>>").select(*name, "intervals")
    each = distinct.filter("hot").select(*name, "n", "stretch").mapInArrow(lambda it: _windows(it, window), "s1 long, s2 long, n int, begin int, w1 long, w2 long")
    again = each.groupBy("w1", "w2").agg(F.sum("n").alias("_n")).filter("_n > 1").select("w1", "w2")
    counted = each.join(again, ["w1", "w2"], "left_semi").select("s1", "s2", F.array(F.struct("begin", (F.col("begin") + window).alias("end"))).alias("intervals"))
    spots = cut.select("key", "start", *name)
    shifted = F.transform("intervals", lambda x: F.struct((x["begin"] + F.col("start")).alias("begin"), (x["end"] + F.col("start")).alias("end")))
    hits = spots.join(found.unionByName(counted), ["s1", "s2"]).select("key", F.inline(shifted))
    return hits.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("intervals"))


def _kept(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        n_words, n_removed, texts = [], [], []
        for text, spans in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
            words = (text or "").encode().split()
            kept, at = [], 0
            for s, e in sorted((x["begin"], x["end"]) for x in spans or ()):
                if s > at:
                    kept += words[at:s]
                at = max(at, e)
            kept += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], names=[*names, "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, window: int = WINDOW, ident: str = "doc_id", most: int = STRETCHES, most_words: int = INDEX_WORDS, keep_text: bool = True) -> DataFrame:
    """``ident``, n_words, n_removed and the kept text (or its SHA-256) of every row of ``docs``.

    All windows that occur twice or more anywhere are judged on the input and every word they cover goes, in every
    place.  Null and empty texts have no words; texts shorter than a window keep all; equal rows repeat each other's
    windows and each get a row; an empty table gives an empty result.
    """
    base = docs.select(ident, "text", F.xxhash64(ident, "text").alias("key"))
    # both joins read this one shuffle of the texts
    placed = base.repartition("key")
    spans = repeated_intervals(placed, base, window, most=most, most_words=most_words)
    joined = placed.join(spans.hint("shuffle_hash"), "key", "left").select(ident, F.col("text").alias("_text"), F.col("intervals").alias("_spans"))
    kind = docs.schema[ident].dataType.simpleString()
    out = joined.mapInArrow(lambda it: _kept(it, [ident]), f"{ident} {kind}, n_words long, n_removed long, kept string")
    return out if keep_text else out.select(ident, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

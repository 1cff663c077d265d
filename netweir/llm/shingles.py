"""Near-duplicate texts: SimHash finds them, the exact similarity of their shingle sets decides.

Fingerprints within SimHash's distance are candidates first, and those whose sets are similar are groups.  What is similar
and further apart is found among the texts of unlike groups: two sets of a similarity of 0.8 share a shingle among the first
fifth of each, in any common order, so an index of those prefixes loses no pair.  Rare shingles come first; what a sample
says is common only decides the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import durable, small, string_bytes
from .components import star_components
from .simhash import shingle_hashes

#: A similarity of 4 / 5: 9 shared >= 4 (a + b), sizes within 4 / 5 of each other, prefixes of n // 5 + 1.
PART, WHOLE = 4, 5
#: One text in so many is asked for common shingles, and so many of those are known at most.
SAMPLE, COMMON = 16, 200_000
#: Texts of candidate pairs are picked by a broadcast of their numbers up to so many.
FEW = 1_000_000
#: Texts of one shingle that are compared with each other in one cell, and pairs that are compared at a time.
BLOCK, PAIRS = 2_000, 50_000


def normal(text: bytes) -> bytes:
    """Words, A-Z lower-cased, a blank between them."""
    return b" ".join(text.lower().split())


def parities(h: np.ndarray) -> bytes:
    """A bit for each of 2**k buckets of the hashes, k the least with twice as many as there are: whether it holds an odd number.

    Two sets differ in at least as many elements as their bits differ.
    """
    m = 64
    while m < 2 * len(h):
        m *= 2
    return np.packbits(np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


def halved(x: bytes) -> bytes:
    """Parities of half as many buckets, 64 at least: two sets differ in at least as many elements as these differ, too."""
    u = np.frombuffer(x, np.uint8)
    return x if len(u) <= 8 else (u[: len(u) // 2] ^ u[len(u) // 2 :]).tobytes()


def surely_apart(x: bytes, y: bytes, a: int, b: int) -> bool:
    """Whether the parities of sets of ``a`` and ``b`` elements exclude the similarity: 9 (a + b - 2 shared) <= a + b."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(u) != len(v):  # the larger one is folded
        u, v = (u, v) if len(u) < len(v) else (v, u)
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return (PART + WHOLE) * int(np.bitwise_count(u ^ v).sum()) > (WHOLE - PART) * (a + b)


def shingle_sets(docs: DataFrame, k: int, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, node (128 bits of the text's words), fingerprint, shingles (sorted hashes, 8 bytes each), parities, number of every row.

    Written once, as the numbers stand for the rows; texts do not travel.
    """
    kinds = docs.select(*keep).schema.add("node", "binary").add("fingerprint", "binary").add("shingles", "binary").add("parities", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            data, off = string_bytes(b.column(len(keep)))
            raw = data.tobytes()
            cols: list[list[bytes]] = [[], [], [], []]
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                words = normal(raw[s:e])
                h = shingle_hashes(words, k)
                own = np.unique(h)
                for col, x in zip(cols, (xxhash.xxh3_128_digest(words), simhash.majority(h).to_bytes(8, "big"), own.tobytes(), parities(own)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *[pa.array(x, pa.binary()) for x in cols]], names=kinds.names)

    return durable(docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, kinds).withColumn("number", F.monotonically_increasing_id()))


def distinct_texts(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, number, fingerprint of every distinct text, the least of its rows' numbers; number of every other row)."""
    texts = durable(sets.groupBy("node").agg(F.min("number").alias("number"), F.min("fingerprint").alias("fingerprint")))
    copies = sets.select("node", "number").join(texts.select("node", F.col("number").alias("_first")), "node").filter("number != _first").select("number")
    return texts, durable(copies)


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """a, b: texts (number, fingerprint) with one fingerprint, and first texts of fingerprints that SimHash links."""
    heads = durable(texts.groupBy("fingerprint").agg(F.min("number").alias("head")))
    same = texts.join(heads, "fingerprint").filter("number != head").select(F.col("head").alias("a"), F.col("number").alias("b"))
    for_side = lambda side: heads.withColumnsRenamed({"fingerprint": side, "head": f"_{side}"})
    linked = simhash.links(texts).join(for_side("a"), "a").join(for_side("b"), "b")
    return same.unionByName(linked.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that several texts of a sample have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))], names=["shingle"])

    some = sets.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("shingles")
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").count().filter("count > 2")
    known = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas()
    shingle = known["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], known["count"].to_numpy(np.int64)[order]


def prefixes(sets: DataFrame, copies: DataFrame) -> DataFrame:
    """shingle, number, size, place: the first fifth of every set and one more, rare shingles first; none of ``copies``."""
    sent = sets.sparkSession.sparkContext.broadcast(common_shingles(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for b in small(batches):
            found, rows, sizes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
            for i, raw in enumerate(b.column(1).to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                if not len(h):
                    continue
                often = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    often = np.where(known[at] == h, counts[at], 0)
                first = h[np.lexsort((h, often))[: len(h) * (WHOLE - PART) // WHOLE + 1]]
                found.append(first)
                rows.append(np.full(len(first), i))
                sizes += [len(h)] * len(first)
                places += range(len(first))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), b.column(2).take(pa.array(np.concatenate(rows))), pa.array(sizes, pa.int32()), pa.array(places, pa.int32())], names=["shingle", "number", "size", "place"])

    rows = sets.select("node", "shingles", "number").mapInArrow(run, "shingle long, number long, size int, place int")
    few = copies.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(copies) if few else copies, "number", "left_anti").select("shingle", "number", "size", "place")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, in order of shingles, whose shingle the row before or after has; only the last row waits for the next batch."""
    last, same = None, False
    for b in batches:
        if not len(b):
            continue
        if last is not None:
            b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        own = np.asarray(b.column(0))
        like = np.concatenate(([same], own[1:] == own[:-1]))
        yield b.slice(0, len(b) - 1).filter(pa.array((like[:-1] | like[1:]).astype(bool)))
        last, same = b.slice(len(b) - 1), bool(like[-1])
    if same:
        yield last


def _beside(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """a, b and, for each of ``columns`` of ``sets``, its value of a and of b."""
    named = pairs.select(F.col("a").alias("number")).union(pairs.select("b")).distinct()
    few = named.limit(FEW + 1).count() <= FEW
    asked = sets.select("number", *columns).join(F.broadcast(named) if few else named, "number", "left_semi")
    for side in "ab":
        pairs = pairs.join(asked.withColumnsRenamed({"number": side} | {c: f"{c}_{side}" for c in columns}), side)
    return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in "ab"])


def _filtered(rows: DataFrame, fits) -> DataFrame:
    """a, b of the rows (a, b, ..) whose other values ``fits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ok = [fits(*x) for x in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs whose sets have the similarity.

    Parities, a few bits for each shingle, exclude most other pairs; whole sets travel only for what is left.
    """

    def alike(x: bytes, y: bytes) -> bool:
        u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        return (PART + WHOLE) * len(np.intersect1d(u, v, assume_unique=True)) >= PART * (len(u) + len(v))

    sized = sets.withColumn("size", F.octet_length("shingles") / F.lit(8))
    maybe = durable(_filtered(_beside(durable(pairs), sized, "parities", "size"), lambda x, y, a, b: not surely_apart(x, y, a, b)))
    return _filtered(_beside(maybe, sets, "shingles"), alike)


def _ungrouped(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` of shingles that texts of several groups have, with the ``group`` that the pairs ``found`` put a text in."""
    roots = star_components(found).withColumnsRenamed({"node": "number", "root": "group"})
    grouped = rows.join(roots, "number", "left").withColumn("group", F.coalesce("group", "number"))
    several = grouped.groupBy("shingle").agg(F.min("group").alias("_lo"), F.max("group").alias("_hi")).filter("_lo < _hi").select("shingle")
    return durable(grouped.join(several, "shingle"))


def links(sets: DataFrame, texts: DataFrame, copies: DataFrame) -> DataFrame:
    """a, b: verified pairs that connect exactly what all pairs of the similarity connect.

    SimHash's candidates come first.  Then a shingle's texts are compared with one of them for each class of size; then every
    pair that may be similar and that those links leave unconnected is compared, so a group of n near copies makes few of its
    n² pairs.
    """
    found = durable(verified(fingerprint_pairs(texts), sets))
    shared = durable(prefixes(sets, copies).repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_repeated, "shingle long, number long, size int, place int"))
    rows = _ungrouped(shared, found)
    level = F.floor(F.log("size") / F.log(F.lit(WHOLE / PART)))
    near = lambda a, b: F.least(a, b) * WHOLE >= F.greatest(a, b) * PART
    leveled = rows.withColumn("level", level)
    heads = leveled.groupBy("shingle", "level").agg(F.min(F.struct(F.xxhash64("number").alias("h"), "number", "size", "group")).alias("head"))
    stars = leveled.join(heads, ["shingle", "level"]).filter((F.col("group") != F.col("head.group")) & near(F.col("size"), F.col("head.size")))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    found = found.unionByName(durable(verified(stars.select(*pair(F.col("number"), F.col("head.number"))).distinct(), sets)))
    rest = _ungrouped(rows.drop("group"), found)
    return found.unionByName(durable(verified(open_pairs(rest, sets).distinct(), sets)))


def open_pairs(rows: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: pairs of ``rows`` (shingle, number, size, place, group) with one shingle, of two groups, that may be similar.

    A shingle with more than ``block`` texts is cut into blocks, and every pair of blocks is a cell of its own.  Only rows
    that some row of their cell fits by size and place get parities, of half as many buckets, and are compared by them within
    tasks; so only what may be similar is a row.
    """

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(halved, b.column(1).to_pylist()), pa.binary())], names=["number", "parities"])

    many = rows.groupBy("shingle").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    mine = F.pmod(F.xxhash64("number"), F.col("_n")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j")))
    dealt = rows.join(many, "shingle").select("shingle", F.inline(cells), mine.alias("mine"), "number", "group", "size", "place")
    by_cell = lambda r: r.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    some = durable(by_cell(dealt).mapInArrow(_with_partner, dealt.schema))
    wide = some.join(sets.select("number", "parities").mapInArrow(half, "number long, parities binary"), "number")
    return by_cell(wide.select(*dealt.columns, "parities")).mapInArrow(_near, "a long, b long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole cells (shingle, i, j), together some ``BLOCK`` rows and more only for one cell, of rows that arrive cell by cell."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in small(batches, BLOCK):
        held.append(b)
        rows += len(b)
        if rows >= BLOCK:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = np.stack([np.asarray(t.column(i)) for i in range(3)], axis=1)
            change = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1))
            to = int(change[-1]) + 1 if len(change) else 0  # the last cell may go on in the next batch
            if to:
                yield t.slice(0, to)
            held, rows = [t.slice(to)], len(t) - to
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _fitting(t: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row) of one cell, of two groups, whose sizes and places leave the similarity possible; of some ``PAIRS`` at a time."""
    cell = np.stack([np.asarray(t.column(i)) for i in range(3)], axis=1)
    mine, _, group, size, place = (np.asarray(t.column(i)) for i in range(3, 8))
    n = len(t)
    last = np.append(np.flatnonzero((np.diff(cell, axis=0) != 0).any(axis=1)), n - 1)
    partners = np.repeat(last + 1, np.diff(np.append(-1, last))) - np.arange(n) - 1
    done, at = np.cumsum(partners), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        p = partners[at:to]
        x = np.repeat(np.arange(at, to), p)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(p) - p, p)
        low, high, both = np.minimum(size[x], size[y]), np.maximum(size[x], size[y]), size[x] + size[y]
        # the most that both share from their places on
        left = np.minimum(size[x] - place[x], size[y] - place[y])
        ok = (group[x] != group[y]) & (low * WHOLE >= high * PART) & (left * (PART + WHOLE) >= both * PART)
        ok &= (cell[x, 1] == cell[x, 2]) | (mine[x] != mine[y])
        yield x[ok], y[ok]
        at = to


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that fit another row of their cell."""
    for t in _cells(batches):
        keep = np.zeros(len(t), bool)
        for x, y in _fitting(t):
            keep[x] = keep[y] = True
        yield t.filter(pa.array(keep))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of fitting pairs that parities do not exclude; a pair may come again."""

    def out(found: set[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    for t in _cells(batches):
        number, size, bits = np.asarray(t.column(4)), np.asarray(t.column(6)), t.column(8).to_pylist()
        folded = np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64)) for x in bits], np.uint64)
        found: set[tuple[int, int]] = set()
        for x, y in _fitting(t):
            # the least that both differ by
            ok = (PART + WHOLE) * np.bitwise_count(folded[x] ^ folded[y]).astype(np.int64) <= (WHOLE - PART) * (size[x] + size[y])
            for u, v in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                pair = (min(number[u], number[v]), max(number[u], number[v]))
                if pair not in found and not surely_apart(bits[u], bits[v], int(size[u]), int(size[v])):
                    found.add(pair)
            if len(found) >= PAIRS:
                yield out(found)
                found = set()
        yield out(found)


def near_nodes(sets: DataFrame) -> DataFrame:
    """node, root (a number) for every text of ``sets`` that is similar to another."""
    texts, copies = distinct_texts(sets)
    roots = star_components(links(sets, texts, copies)).withColumnRenamed("node", "number")
    return texts.select("node", "number").join(roots, "number").select("node", "root")

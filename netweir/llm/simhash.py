"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints within the distance must agree on some segment up to a
few bits, so each one is filed under its segments' values and also looks up the values in a small Hamming
ball around them; every match is verified by the complete distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small, string_bytes
from .components import star_components

SEED = 42
#: (first bit, bits, radius): four differing bits over three segments leave one within its radius, as 2 + 2 + 1 > 4.
SEGMENTS_64 = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
DISTANCE_64 = 4
#: A bucket with more fingerprints than this, those that only look there included, is compared in pairs of blocks, each a group of its own.
BLOCK = 4096
PAIRS = 500_000


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of every run of ``k`` words, A-Z lower-cased; of all words if there are fewer; empty if none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255):
        counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def remix(h: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 bits from a hash; turn 0 is the hash itself."""
    if not turn:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * turn % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def with_fingerprints(docs: DataFrame, k: int = 4, words: int = 1, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``fingerprint``: 8 * ``words`` bytes, most significant first.

    Whole texts are read; a null text counts as empty and an empty one has all bits 0.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c != "fingerprint"]
    schema = docs.select(*names).schema.add("fingerprint", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            data, off = string_bytes(b.column(b.schema.get_field_index("_text")))
            raw, out = data.tobytes(), []
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                h = shingle_hashes(raw[s:e], k)
                out.append(b"".join(majority(remix(h, t)).to_bytes(8, "big") for t in range(words)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(out, pa.binary())], names=[*names, "fingerprint"])

    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(run, schema)


def _filed(batches: Iterator[pa.RecordBatch], segments) -> Iterator[pa.RecordBatch]:
    """bucket, kind (0: filed there, 1: looks there), fingerprint.

    Two values one bit apart meet once: the one that has the bit looks under the value without it.
    """
    for b in small(batches, 1000):
        col = b.column(0)
        n = len(col)
        if not n:
            continue
        fp = np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(n, -1)
        buckets, kinds, rows = [], [], []
        for number, (first, width, radius) in enumerate(segments):
            value = (fp[:, first // 64] >> np.uint64(first % 64)) & np.uint64((1 << width) - 1)
            tag = np.uint64(number << 32)
            buckets.append(value | tag)
            kinds.append(np.zeros(n, np.int8))
            rows.append(np.arange(n))
            for bit in range(width if radius else 0):
                one = np.uint64(1 << bit)
                has = np.flatnonzero(value & one)
                buckets.append((value[has] ^ one) | tag)
                kinds.append(np.ones(len(has), np.int8))
                rows.append(has)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets).view(np.int64)), pa.array(np.concatenate(kinds)), col.take(pa.array(np.concatenate(rows)))], names=["bucket", "kind", "fingerprint"])


def _stars(fp: np.ndarray, group: np.ndarray, kind: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) links that keep connected what verified pairs within the groups connect; rows sorted by group and kind.

    All pairs of a group with at least one member filed there are compared in blocks; a block's verified pairs are
    folded into labels at once, so what goes out is at most one link for each row.
    """
    n = len(fp)
    last = np.append(np.flatnonzero(np.diff(group)), n - 1)
    end = np.repeat(last + 1, np.diff(np.append(-1, last)))
    heads = np.flatnonzero(kind == 0)
    partners = end[heads] - heads - 1
    heads, partners = heads[partners > 0], partners[partners > 0]
    label = np.arange(n)
    done = np.cumsum(partners)
    at = 0
    while at < len(heads):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        h, p = heads[at:to], partners[at:to]
        a = np.repeat(h, p)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(p) - p, p)
        apart = np.bitwise_count(fp[a, 0] ^ fp[b, 0]).astype(np.int16)
        for w in range(1, fp.shape[1]):
            apart += np.bitwise_count(fp[a, w] ^ fp[b, w])
        ok = apart <= distance
        a, b = a[ok], b[ok]
        while len(a):
            la, lb = label[a], label[b]
            new = la != lb
            if not new.any():
                break
            a, b, la, lb = a[new], b[new], la[new], lb[new]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (jump := label[label] != label).any():
                label[jump] = label[label[jump]]
        at = to
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """a, b: fingerprints of verified links, for rows that arrive group by group."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def out(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, kind, fp = parts
        group = np.concatenate(([0], np.cumsum((np.diff(key, axis=0) != 0).any(axis=1)))) if len(key) else np.zeros(0, np.int64)
        x, y = _stars(fp, group, kind, distance) if len(key) else (group, group)
        raw = fp.tobytes()
        size = fp.shape[1] * 8
        cut = lambda i: pa.array([raw[j * size : (j + 1) * size] for j in i.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([cut(x), cut(y)], names=["a", "b"])

    for b in batches:
        if not len(b):
            continue
        key = np.stack([np.asarray(b.column(i), dtype=np.int64) for i in (0, 1, 2)], axis=1)
        fp = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(len(b), -1)
        held.append((key, np.asarray(b.column(3)), fp))
        rows += len(b)
        if rows >= 100_000:
            key, kind, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            change = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1))
            if len(change):  # the last group may go on in the next batch
                to = change[-1] + 1
                yield out((key[:to], kind[:to], fp[:to]))
                held, rows = [(key[to:], kind[to:], fp[to:])], len(key) - to
            else:
                held = [(key, kind, fp)]
    if held:
        yield out(tuple(np.concatenate(x) for x in zip(*held, strict=True)))


def links(fingerprints: DataFrame, segments=SEGMENTS_64, distance: int = DISTANCE_64, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct ``fingerprint`` values that connect exactly what all verified pairs connect.

    Buckets over ``block`` fingerprints are split by hash into blocks and every pair of blocks is a group of
    its own, so neither memory nor a task grows with a hot bucket; no pair is left out.
    """
    fps = fingerprints.select("fingerprint").distinct()
    rows = fps.mapInArrow(lambda it: _filed(it, segments), "bucket long, kind byte, fingerprint binary")
    held = rows.groupBy("bucket").agg(F.count_if(F.col("kind") == 0).alias("_f"), F.count_if(F.col("kind") == 1).alias("_l"))
    hot = durable(held.filter(F.col("_f") + F.col("_l") > block).select("bucket", F.ceil(F.col("_f") / block).cast("int").alias("_n"), F.ceil(F.col("_l") / block).cast("int").alias("_m")))
    few = hot.limit(10_001).count() <= 10_000
    spread = rows.join(F.broadcast(hot) if few else hot, "bucket", "left")
    # filed blocks meet each other (i <= j) and every block of lookups (-1 - m, j); where nothing is filed, lookups go
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("_n")).cast("int")
    look = -1 - F.pmod(F.xxhash64("fingerprint"), F.col("_m")).cast("int")
    each = lambda n, cell: F.transform(F.filter(F.sequence(F.lit(0), F.col(n)), lambda x: x < F.col(n)), cell)
    at = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    filed = F.concat(each("_n", lambda x: at(F.least(x, mine), F.greatest(x, mine))), each("_m", lambda x: at(-1 - x, mine)))
    cells = F.when(F.col("_n").isNull(), F.array(at(F.lit(0), F.lit(0)))).when(F.col("kind") == 0, filed).otherwise(each("_n", lambda x: at(look, x)))
    grouped = spread.select("bucket", F.inline(cells), "kind", "fingerprint").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "kind")
    return grouped.mapInArrow(lambda it: _linked(it, distance), "a binary, b binary")


def near_groups(docs: DataFrame, k: int = 4, words: int = 1, segments=SEGMENTS_64, distance: int = DISTANCE_64, ident: str = "doc_id") -> DataFrame:
    """``ident``, fingerprint, component_id (smallest id that links reach) for every row.

    Exact copies share a fingerprint, and only distinct ones are indexed.  Null ids never win unless
    a component has no other; equal rows each get a row; an empty table gives an empty result.
    """
    marked = durable(with_fingerprints(docs, k, words, keep=[ident]))
    roots = star_components(links(marked, segments, distance))
    least = marked.groupBy("fingerprint").agg(F.min(ident).alias("_id"))
    rooted = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    tops = rooted.groupBy("root").agg(F.min("_id").alias("component_id"))
    classes = rooted.join(tops, "root").select("fingerprint", "component_id")
    return marked.join(classes, "fingerprint").select(ident, "fingerprint", "component_id")


def groups_digest(docs: DataFrame) -> DataFrame:
    """The fingerprint as 16 hex digits, most significant first."""
    return near_groups(docs).select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, k: int = 5, ident: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id, then the smallest hash.

    Two texts are near duplicates if their sets of shingles of five words have a similarity of at least 0.8: fingerprints
    that SimHash links are looked at first, an exact check of the sets decides, and the same check finds what lies further
    apart.  Texts without a word are all alike and leave one row.  A row travels as one value, so columns of any name are kept.
    """
    from .shingles import near_nodes, shingle_sets

    sets = shingle_sets(docs.select(ident, "text").withColumn("_row", F.xxhash64(ident, "text")), k, [ident, "_row"])
    named = sets.select(ident, "_row", "node").join(near_nodes(sets), "node", "left").withColumn("_alone", F.when(F.col("root").isNull(), F.col("node")))
    chosen = named.groupBy("root", "_alone").agg(F.min(F.struct(F.col(ident).isNull().alias("_null"), F.col(ident).alias("_id"), F.col("_row"))).alias("_best")).select("_best._id", "_best._row")
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(ident).alias("_key"), F.xxhash64(ident, "text").alias("_row"))
    # one row key alone deals the rows, so that texts travel once for both steps; ids are compared where row keys are equal
    alike = (F.col("d._key") >= F.col("c._id")) & (F.col("d._key") <= F.col("c._id")) | F.col("d._key").isNull() & F.col("c._id").isNull()
    kept = keyed.alias("d").join(chosen.hint("shuffle_hash").alias("c"), (F.col("d._row") == F.col("c._row")) & alike, "left_semi")
    return kept.dropDuplicates(["_key", "_row"]).select("_doc.*")

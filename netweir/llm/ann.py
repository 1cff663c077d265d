"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small network learns to predict, from a
vector, in which parts its neighbours lie.  Every distinct vector is filed under its most probable part, and a query
is compared exactly with all vectors of its several most probable parts.  A part that stays too large is cut
again in the same way, so parts keep their size whatever the table has.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, uniform

#: A partition is learned from about this many distinct vectors of a part, drawn by a hash of the vector.
SAMPLE = 6_000
#: A part is cut into one for this many sampled vectors, at most ``PARTS``.
PER_PART = 32
PARTS = 32
#: Parts with more vectors are cut again.
LARGE = 8_000
DEPTH = 8
NEIGHBOURS = 10
#: Probes are the fewest that surely (by a one-sided bound) find this share of the held-out sample's neighbours.
RECALL = 0.95
#: Vectors and queries of one part are compared in blocks of about this many.
BLOCK = 16_000
#: So many routers travel with the tasks; more are joined to the rows of their parts.
ROUTERS = 64


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row of unit vectors ``x``."""
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 1024):
        sims = x[s : s + 1024] @ x.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
        out[s : s + 1024] = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12) -> np.ndarray:
    """A part for every node: as many edges as possible inside parts, no part above its share by ``slack``.

    Halves along principal directions give equal parts; then nodes move to the part of most of their neighbours,
    those that gain most first, while there is room.
    """
    n = len(x)
    part = np.zeros(n, np.int64)
    groups = [(np.arange(n), 0, parts)]
    while groups:
        rows, first, many = groups.pop()
        part[rows] = first
        if many > 1:
            centred = x[rows] - x[rows].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = rows[np.argsort(centred @ axis, kind="stable")]
            cut = len(rows) * (many // 2) // many
            groups += [(order[:cut], first, many // 2), (order[cut:], first + many // 2, many - many // 2)]
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    room = int(np.ceil(n / parts * (1 + slack)))
    for _ in range(rounds):
        votes = np.bincount(both[0] * parts + part[both[1]], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Two layers over a unit vector; ``probes`` parts are searched, and more while they ``held`` too few of the sample."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1
    held: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part): the most probable part of each row."""
        return np.arange(len(x)), self.logits(x).argmax(axis=1)

    def probe(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of the parts to search for ``k`` neighbours; vectors filed there are at least those of the sample."""
        order = np.argsort(-self.logits(x), axis=1, kind="stable")
        before = np.cumsum(self.held[order], axis=1) - self.held[order]
        i, j = np.nonzero((np.arange(self.parts)[None, :] < self.probes) | (before <= k))
        return i, order[i, j]


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, rounds: int = 300, seed: int = 1) -> Router:
    """Cross entropy between the network and each vector's distribution of neighbours over parts (Adam)."""
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], target.shape[1]
    w = [rng.normal(0, 1, (d, hidden)) / np.sqrt(d) * 2, np.zeros(hidden), rng.normal(0, 1, (hidden, p)) / np.sqrt(hidden), np.zeros(p)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for r in range(1, rounds + 1):
        h = np.maximum(x @ w[0] + w[1], 0)
        z = h @ w[2] + w[3]
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=1, keepdims=True)
        g = (q - target) / len(x)
        gh = (g @ w[2].T) * (h > 0)
        for i, grad in enumerate([x.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.999**r)) + 1e-9)
    return Router(*w)


def learn(sample: np.ndarray, most: int = PARTS) -> Router:
    """A router from distinct vectors of one length; how many parts it has, up to ``most``, depends on their number alone."""
    x = unit(sample)
    n = len(x)
    parts = min(n, most, max(2, n // PER_PART))
    k = min(NEIGHBOURS, n - 1)
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1, np.array([n]))
    graph = neighbour_graph(x, k)
    part = balanced_parts(x, graph, parts)
    target = np.bincount(np.repeat(np.arange(n), k) * parts + part[graph].ravel(), minlength=n * parts).reshape(n, parts) / k
    target = 0.7 * target + 0.3 * np.eye(parts)[part]
    # the number of probes comes from a network that has not seen the vectors it is asked for
    test = np.arange(n) % 8 == 0
    trial = train_router(x[~test], target[~test])
    logits = trial.logits(x)
    rank = np.empty((n, parts), np.int64)
    rank[np.arange(n)[:, None], np.argsort(-logits, axis=1, kind="stable")] = np.arange(parts)
    where = rank[np.flatnonzero(test)[:, None], logits.argmax(axis=1)[graph[test]]]
    sure = lambda p: (share := (where < p).mean()) - 1.64 * np.sqrt(max(share * (1 - share), 1e-3) / where.size) >= RECALL
    trial.probes = next((p for p in range(1, parts) if sure(p)), parts)
    trial.held = np.bincount(logits.argmax(axis=1), minlength=parts)
    return trial


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(table: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), h1, h2 (hashes of v): rows with an id and a vector that has a direction."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = table.select(F.col(ident).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    return out.filter(F.exists("v", lambda x: x != 0)).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def distinct_vectors(rows: DataFrame, k: int, every: int) -> DataFrame:
    """h1, h2, v, ids (the k + 1 smallest), asked (whether a query has it) for every distinct vector.

    More ids of one vector are never among k neighbours, as ties go to the smaller, so copies of a vector are
    aggregated before they are shuffled and searched once.
    """
    vectors = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max(F.col("vec_id") % every == 0).alias("asked"))
    w = Window.partitionBy("h1", "h2").orderBy("vec_id")
    first = rows.select("h1", "h2", "vec_id").distinct().withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= k + 1)
    return vectors.join(first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), ["h1", "h2"])


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def routers_of(index: DataFrame, sizes: DataFrame, sample: int) -> DataFrame:
    """part, router (pickled) for every part of ``sizes`` (part, n), each learned in a task from a bounded sample."""
    most = PARTS
    drawn = index.select("h1", "v", "part").join(sizes, "part").filter(uniform("h1", seed=6) * F.col("n") < sample).select("part", "h1", "v")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("h1")  # rows come in any order
        return pa.table({"part": group["part"][:1].cast(pa.string()), "router": pa.array([pickle.dumps(learn(_matrix(group["v"]), most))], pa.binary())})

    return durable(drawn.groupBy("part").applyInArrow(run, "part string, router binary"))


def descend(rows: DataFrame, routers: DataFrame, sizes: DataFrame, k: int | None = None) -> DataFrame:
    """``rows`` (.., v, part) moved to the parts below ``routers``' parts: to one, or with ``k`` to all that are probed."""
    names, schema = rows.columns, rows.schema

    def moved(t: pa.RecordBatch | pa.Table, router: Router, part: str) -> pa.RecordBatch | pa.Table:
        x = unit(_matrix(t.column(names.index("v"))))
        i, j = router.file(x) if k is None else router.probe(x, k)
        out = t.take(pa.array(i))
        at = names.index("part")
        return out.set_column(at, names[at], pa.array([f"{part}/{p}" for p in j.tolist()], pa.string()))

    if routers.count() <= ROUTERS:
        sent = rows.sparkSession.sparkContext.broadcast({r["part"]: pickle.loads(r["router"]) for r in routers.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for b in batches:
                own = np.array(b.column(names.index("part")).to_pylist(), object)
                for part in sorted(set(own.tolist())):
                    some = b.filter(pa.array(own == part))
                    yield moved(some, known[part], part) if part in known else some

        return rows.mapInArrow(run, schema)
    blocks = sizes.select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias("_n"))
    mine = rows.join(blocks, "part", "left").withColumn("_b", F.coalesce(F.pmod(F.xxhash64("h1"), F.col("_n")).cast("int"), F.lit(-1)))
    spread = routers.join(blocks, "part").select("part", "router", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(names)
        return moved(left.select(names), pickle.loads(right["router"][0].as_py()), left["part"][0].as_py())

    below = mine.filter("_b >= 0").select(*names, "_b").groupBy("part", "_b").cogroup(spread.groupBy("part", "_b")).applyInArrow(meet, schema)
    return below.unionByName(mine.filter("_b < 0").select(*names))


def build(vectors: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The levels of routers (with the sizes of the parts they cut) and the index: ``vectors`` with part.

    A part above all is the length of its vectors, as a cosine needs equal lengths.
    """
    index, levels = vectors.withColumn("part", F.size("v").cast("string")), []
    while len(levels) < DEPTH:
        sizes = durable(index.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > (LARGE if levels else 0)))
        if sizes.isEmpty():
            break
        routers = routers_of(index, sizes, sample)
        index = durable(descend(index, routers, sizes))
        levels.append((routers, sizes))
    return levels, index


def _best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, id, cosine) of the k best ids for each row of ``q``, ties to the smaller id; row i of ``c`` has ids first[i] to first[i + 1].

    The product of unit vectors only narrows the choice; what is kept is scored again from the vectors themselves,
    each pair by the same sum, so equal vectors tie.
    """
    cu, qu, c, q = unit(c), unit(q), scaled(c), scaled(q)
    cn, qn = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    out = []
    for s in range(0, len(q), 256):
        sims = qu[s : s + 256] @ cu.T
        at = max(0, sims.shape[1] - k)
        floor = np.partition(sims, at, axis=1)[:, at]
        i, j = np.nonzero(sims >= floor[:, None] - 1e-9)
        score = (q[s + i] * c[j]).sum(axis=1) / (qn[s + i] * cn[j])
        many = first[j + 1] - first[j]
        own = ids[np.arange(many.sum()) + np.repeat(first[j] - (np.cumsum(many) - many), many)]
        i, score = np.repeat(i, many), np.repeat(score, many)
        order = np.lexsort((own, -score, i))
        i, own, score = i[order], own[order], score[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((s + i[kept], own[kept], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each usable row whose id is divisible by ``every``.

    Only vectors of one length are compared.  Rows that share an id are one row to each other, and each query id has
    one result, of its best matches.  Vectors and queries of a part meet in bounded blocks; a query probes more parts
    where the most probable ones hold too few.  Without usable rows the result is empty.
    """
    rows = usable(table)
    vectors = durable(distinct_vectors(rows, k, every))
    levels, index = build(vectors)
    if not levels:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    routed = vectors.filter("asked").select("h1", "h2", "v", F.size("v").cast("string").alias("part"))
    for routers, sizes in levels:
        routed = descend(routed, routers, sizes, k)
    routed = durable(routed)
    per = lambda t: F.ceil(F.col(t) / BLOCK).cast("int")
    cells = index.groupBy("part").agg(F.count("*").alias("c")).join(routed.groupBy("part").agg(F.count("*").alias("q")), "part").select("part", per("c").alias("_nc"), per("q").alias("_nq"))
    mine = lambda n: F.pmod(F.xxhash64("h2"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(cells, "part").select("h1", "h2", "v", "part", spread("_nc").alias("cb"), mine("_nq").alias("qb"))
    right = index.join(cells, "part").select("ids", "v", "part", mine("_nc").alias("cb"), spread("_nq").alias("qb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = b["ids"].combine_chunks()
        first = np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths()))))
        i, own, score = _best(_matrix(a["v"]), _matrix(b["v"]), np.asarray(ids.flatten(), dtype=np.int64), first, k + 1)
        return pa.table({"h1": a["h1"].take(pa.array(i)), "h2": a["h2"].take(pa.array(i)), "vec_id": pa.array(own), "score": pa.array(score)})

    met = left.groupBy("part", "cb", "qb").cogroup(right.groupBy("part", "cb", "qb")).applyInArrow(meet, "h1 long, h2 long, vec_id long, score double")
    best = met.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id"))), 1, k + 1).alias("_best"))
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    others = F.slice(F.filter("_best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    found = queries.join(best, ["h1", "h2"]).groupBy("query_id").agg(F.collect_list(others).alias("_all"))
    # an id with several vectors has a list for each; of a neighbour in several, the nearest counts
    merged = F.array_sort(F.flatten("_all"))
    ranked = F.slice(F.filter(merged, lambda x, i: ~F.exists(F.slice(merged, 1, i), lambda y: y["vec_id"] == x["vec_id"])), 1, k)
    return found.select("query_id", F.posexplode(ranked).alias("_at", "_x")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), (-F.col("_x.away")).alias("score"))

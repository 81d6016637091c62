"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size. In each shard points enter the
graph in growing batches: a greedy beam search from the shard's central point proposes
neighbours, and pruning with relaxed distances keeps an edge only if no kept neighbour is
much nearer to its end. Queries stream past the graph of every shard, are answered by beam
search and ranked by exact double-precision cosines of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.llm.common import slices
from popgraph.plans.stage import stage

#: Vectors of a shard, about: a task holds their graph. Queries meet every shard, so fewer and larger ones are cheaper.
SHARD = 8192
#: Shard numbers that are broadcast; more are joined by a shuffle.
BROADCAST_SHARDS = 100_000
DEGREE = 32
BEAM = 64
RELAX = 1.2
_FAR = np.float32(9)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), nearest first, of the beam of every query; -1 where it has fewer."""
    n, width = len(q), min(beam, len(x))
    ids = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), _FAR, np.float32)
    open_ = np.zeros((n, width), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], dist[:, 0], open_[:, 0], seen[:, start] = start, 1 - q @ x[start], True, True
    live = np.arange(n)
    while len(live):
        d = np.where(open_[live], dist[live], _FAR)
        k = d.argmin(axis=1)
        more = open_[live, k]
        live, k = live[more], k[more]
        if not len(live):
            break
        open_[live, k] = False
        to = edges[ids[live, k]]
        fresh = (to >= 0) & ~seen[live[:, None], to]
        r, c = np.nonzero(fresh)
        seen[live[r], to[r, c]] = True
        away = np.full(to.shape, _FAR, np.float32)
        away[r, c] = 1 - np.einsum("ij,ij->i", x[to[r, c]], q[live[r]])
        all_d = np.concatenate([dist[live], away], axis=1)
        all_i = np.concatenate([ids[live], np.where(fresh, to, -1)], axis=1)
        all_o = np.concatenate([open_[live], fresh], axis=1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        rows = np.arange(len(live))[:, None]
        dist[live], ids[live], open_[live] = all_d[rows, best], all_i[rows, best], all_o[rows, best]
    order = np.argsort(dist, axis=1, kind="stable")
    rows = np.arange(n)[:, None]
    return ids[rows, order], dist[rows, order]


def robust_prune(x: np.ndarray, p: np.ndarray, ids: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For points ``p`` and candidate rows ``ids`` (-1: none), up to ``degree`` diverse neighbours."""
    there = (ids >= 0) & (ids != p[:, None])
    v = x[np.maximum(ids, 0)]
    d = np.where(there, 1 - np.einsum("bcd,bd->bc", v, x[p]), _FAR)
    between = 1 - v @ v.transpose(0, 2, 1)
    out = np.full((len(p), degree), -1, np.int64)
    rows = np.arange(len(p))
    for k in range(degree):
        j = d.argmin(axis=1)
        ok = d[rows, j] < _FAR
        if not ok.any():
            break
        out[ok, k] = ids[rows, j][ok]
        # distances are squared Euclidean ones of unit vectors, halved
        d = np.where(relax * relax * between[rows, j] <= d, _FAR, d)
        d[rows, j] = _FAR
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 0) -> tuple[np.ndarray, int]:
    """(edges [n, degree], starting point) for unit vectors."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int64)
    start = int((x @ x.mean(axis=0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    at, size = 1, 1
    while at < n:
        p = order[at : at + size]
        ids, _ = beam_search(x, edges, start, x[p], beam)
        edges[p] = robust_prune(x, p, ids, degree, relax)
        # edges back, and pruning where they do not fit
        src, slot = np.nonzero(edges[p] >= 0)
        ends, begins = edges[p][src, slot], p[src]
        by = np.argsort(ends, kind="stable")
        ends, begins = ends[by], begins[by]
        cuts = np.nonzero(np.diff(ends))[0] + 1
        full: list[tuple[int, np.ndarray]] = []
        for e, new in zip(ends[np.concatenate(([0], cuts))].tolist() if len(ends) else [], np.split(begins, cuts), strict=False):
            old = edges[e][edges[e] >= 0]
            new = new[~np.isin(new, old)]
            if len(old) + len(new) <= degree:
                edges[e, len(old) : len(old) + len(new)] = new
            else:
                every = np.concatenate([old, new])
                if len(every) > 3 * degree:
                    every = every[np.argpartition(1 - x[every] @ x[e], 3 * degree)[: 3 * degree]]
                full.append((e, every))
        for k in range(0, len(full), 256):
            part = full[k : k + 256]
            wide = np.full((len(part), 3 * degree), -1, np.int64)
            for i, (_, every) in enumerate(part):
                wide[i, : len(every)] = every
            who = np.array([e for e, _ in part])
            edges[who] = robust_prune(x, who, wide, degree, relax)
        at += size
        size = min(2 * size, 256, max(n // 8, 1))
    return edges, start


def _level(v: np.ndarray) -> np.ndarray:
    """Rows scaled to a largest component of one, so that squares neither vanish nor overflow."""
    v = v.astype(np.float64)
    return v / np.abs(v).max(axis=1, keepdims=True)


def _unit(v: np.ndarray) -> np.ndarray:
    v = _level(v)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _index(degree: int, beam: int, relax: float):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(pdf["vec"].to_numpy()))
        edges, start = build_graph(x, degree, beam, relax)
        return pdf.assign(node=np.arange(len(pdf)), first=np.arange(len(pdf)) == start, edges=list(edges))

    return build


INDEX = "dim int, shard int, vec array<double>, ids array<long>, node long, first boolean, edges array<long>"


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec as doubles) of the rows that take part: ids and vectors without nulls, finite, not zero."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where("vec_id is not null and vec is not null and size(vec) > 0").where(~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))


def build_index(vectors: DataFrame, per_vector: int, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> DataFrame:
    """A row per distinct vector with its shard, its edges and its ``per_vector`` smallest ids.

    ``vectors``: vec_id and vec as ``valid_vectors`` gives them. Searches that leave out
    one id and want k need the k + 1 smallest ids of a vector. A shard holds vectors of
    one length. Without vectors the index is empty.
    """
    lowest = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    few = vectors.distinct().withColumn("_r", lowest).where(F.col("_r") <= per_vector)
    nodes = stage(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-nodes")
    shards = max(-(-nodes.count() // shard), 1)
    dealt = nodes.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "vec", "ids")
    dealt = dealt.repartition(4 * shards, "dim", "shard")  # a task per shard, as far as hashes allow
    return stage(dealt.groupBy("dim", "shard").applyInPandas(_index(degree, beam, relax), INDEX), "ann-index")


class _Shard:
    """The graph of one shard, gathered from its rows in the order of nodes."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        dim = t.column("dim")[0].as_py()
        self.raw = _level(t.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim))
        self.norm = np.linalg.norm(self.raw, axis=1)
        self.x = (self.raw / self.norm[:, None]).astype(np.float32)
        self.edges = t.column("edges").combine_chunks().flatten().to_numpy().reshape(len(self.x), -1)
        self.start = int(np.argmax(t.column("first").to_numpy(zero_copy_only=False)))
        self.names = t.column("ids").to_pylist()

    def answer(self, names: list[int], q: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
        """(query_id, vec_id, score) of the k nearest found; of equal scores in the beam all are weighed by id."""
        q = _level(q)
        size = np.linalg.norm(q, axis=1)
        ids, _ = beam_search(self.x, self.edges, self.start, (q / size[:, None]).astype(np.float32), beam)
        out: list[tuple[int, int, float]] = []
        for row, name, v, n in zip(ids, names, q, size.tolist(), strict=True):
            row = row[row >= 0]
            score = (self.raw[row] @ v) / (self.norm[row] * n)
            # each of the k + 1 best nodes but the query's own gives at least one id
            least = np.sort(score)[-min(k + 1, len(score))]
            near = score >= least
            found = [(-s, i) for s, r in zip(score[near].tolist(), row[near].tolist(), strict=True) for i in self.names[r] if i != name]
            out += [(name, i, -s) for s, i in sorted(found)[:k]]
        return out


def _search(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, graph = None, [], None
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy() for c in ("dim", "shard", "kind")])
            cuts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part, (dim, shard, kind) = whole.slice(a, b - a), keys[:, a].tolist()
                if (dim, shard) != at:
                    at, parts, graph = (dim, shard), [], None
                if kind == 0:
                    parts.append(part)
                    continue
                graph = graph or _Shard(parts)
                for q in slices(part, 256):
                    found = graph.answer(q.column("id").to_pylist(), q.column("vec").flatten().to_numpy().reshape(-1, dim), k, beam)
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                            ["query_id", "vec_id", "score"],
                        )

    return run


def search(queries: DataFrame, index: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, its own id left out.

    ``queries``: vec_id and vec, one row an id. The index moves once: a task gathers the
    graph of a shard and then streams past it all queries, in batches. Ties go to the
    smaller id. Without queries or index rows the result is empty.
    """
    shards = index.select("dim", "shard").distinct()
    n = max(shards.count(), 1)
    asked = queries.select(F.size("vec").alias("dim"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "vec").join(F.broadcast(shards) if n <= BROADCAST_SHARDS else shards, "dim")
    held = index.select("dim", "shard", F.lit(0).alias("kind"), F.col("node").alias("id"), "vec", "ids", "edges", "first")
    both = held.unionByName(asked, allowMissingColumns=True).repartition(4 * n, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "id")
    found = both.mapInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``, by largest cosine.

    Candidates are all rows but the query's own id; ties go to the smaller id; vectors of
    another length are no candidates. Null, zero and non-finite vectors and null ids take
    no part; rows that repeat an id and vector count once; copies of a vector are one
    point with many ids. An id with several vectors is each of them as a candidate and
    the least of them, entry by entry, as a query. An empty table gives an empty result.
    Only the id and the vector are looked at.
    """
    vectors = valid_vectors(df, id_col, vec_col)
    index = build_index(vectors, k + 1, shard, beam=beam)
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = stage(asked.groupBy("vec_id").agg(F.min("vec").alias("vec")), "ann-queries")
    return search(queries, index, k, beam)

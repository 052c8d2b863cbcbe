"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt into shards of bounded size by a hash of their id. In a shard equal vectors become one
node. Nodes are inserted in batches: a greedy search from the shard's entry node proposes neighbours,
relaxed distance pruning keeps those that no kept neighbour is closer to by the factor ``alpha``, and
back edges are added and pruned likewise. Every query is searched by beam in every shard, a block of
them in lockstep; the found rows are scored exactly and the best k of all shards remain.

Nearness is the inner product. Graph and search work on vectors divided by the shard's largest component, with
one more component, sqrt(max norm^2 - norm^2), so that the largest inner product is the smallest Euclidean distance.

The index covers every row; it is a table, built once and written to the checkpoint folder. A shard holds
``shard_rows`` rows at most on average (fewer while that leaves fewer than ``TASKS`` shards), and the search task
reads its index rows once and then the queries as a stream, ``BLOCK`` at a time: no vector of the index is copied,
each query goes to every shard once, and a task holds one shard and one block. Equal vectors of a shard count as one
node, of which a query needs its k + 1 smallest ids at most.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
as queries or candidates, nor do rows with a null id or, in one table, of another length than the most
common; finite components of any size do (a score outside the range of doubles is infinite); ties go to the
smaller id; repeated rows are candidates of their own except those with the query's own id, and of a repeated query
id the least vector asks, once; fewer candidates than k give fewer rows; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textio

DEGREE, BEAM, WIDE, ALPHA = 32, 128, 4, 1.2
#: Rows of a shard, shards at least (of 1024 rows), queries searched in lockstep, marks of seen nodes at once.
SHARD_ROWS, TASKS, BLOCK, CELLS = 1 << 16, 8, 512, 1 << 23


def clean(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and vec (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_column).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(ok, F.lit(False)))


def lift(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors over their largest component, with the component that makes inner product order Euclidean order;
    the largest norm of the former."""
    x = x / np.abs(x).max()
    norm = (x * x).sum(1)
    rest = np.sqrt(np.maximum(norm.max() - norm, 0))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32), float(np.sqrt(norm.max()))


#: A place of a beam without a node: last in order, and not to be expanded.
_EMPTY = np.uint64(2**64 - 1)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of the beam of each query (rows), nearest first; -1 and inf where unused.

    graph: neighbours of each node, -1 where unused. Each round expands the ``wide`` nearest nodes that are
    not yet expanded of every query that has one, and measures only nodes that the query has not seen. A place of a
    beam is one number, of the distance's 32 bits (not negative, so in order), the node's 31 and one for expanded.
    """
    nq, n = len(queries), len(x)
    sq, qq = (x * x).sum(1), (queries * queries).sum(1)
    one, low = np.uint64(1), np.uint64(2**31 - 1)
    held = np.full((nq, beam), _EMPTY)
    seen = np.zeros(nq * (n + 1), bool)  # the last column stands for no node
    seen[n :: n + 1] = True

    def keys(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.uint64)
        for s in range(0, len(rows), 4096):  # what is gathered stays in the processor's cache
            r, i = rows[s : s + 4096], nodes[s : s + 4096]
            d = qq.take(r) + sq.take(i) - 2 * np.einsum("ij,ij->i", x.take(i, 0), queries.take(r, 0))
            out[s : s + 4096] = np.maximum(d, 0, dtype=np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | i.astype(np.uint64) << one
        return out

    held[:, 0] = keys(np.arange(nq), np.full(nq, entry))
    seen[entry :: n + 1] = True
    active = np.arange(nq)
    while True:
        open_ = (held[active] & one) == 0
        has = open_.any(1)
        active, open_ = active[has], open_[has]
        if not len(active):
            break
        near, of = [], []
        for _ in range(wide):  # beams are sorted by distance
            slot = open_.argmax(1)
            r = np.flatnonzero(open_[np.arange(len(active)), slot])
            slot, at = slot[r], active[r]
            open_[r, slot] = False
            near.append(graph[(held[at, slot] >> one & low).astype(np.int64)])
            of.append(at)
            held[at, slot] |= one
        near, of = np.concatenate(near), np.concatenate(of)
        place = ((of * (n + 1))[:, None] + np.where(near < 0, n, near)).reshape(-1)
        place = np.sort(place[~seen.take(place)])
        if not len(place):
            continue
        # Two expanded nodes may share a neighbour.
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        seen[place] = True
        rows, nodes = np.divmod(place, n + 1)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        size = np.diff([*first, len(rows)])
        at = rows[first]
        both = np.full((len(at), beam + int(size.max())), _EMPTY)
        both[:, :beam] = held[at]
        both[np.repeat(np.arange(len(at)), size), beam + np.arange(len(rows)) - np.repeat(first, size)] = keys(rows, nodes)
        both.sort(1)
        held[at] = both[:, :beam]
    unused = held == _EMPTY
    return np.where(unused, -1, held >> one & low).astype(np.int32), np.where(unused, np.float32(np.inf), (held >> np.uint64(32)).astype(np.uint32).view(np.float32))


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float, most: int = 96) -> np.ndarray:
    """Neighbours of each node out of the ``most`` nearest of its candidates (rows, -1: none): nearest first,
    dropping those that a kept one is nearer to by the factor alpha."""
    out = np.full((len(nodes), degree), -1, np.int32)
    for s in range(0, len(nodes), 128):
        out[s : s + 128] = _prune(x, nodes[s : s + 128], cand[s : s + 128], degree, alpha, most)
    return out


def _prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float, most: int) -> np.ndarray:
    cand = np.sort(np.where(cand == nodes[:, None], -1, cand), 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    sq = (x * x).sum(1)
    d = sq[cand] + sq[nodes][:, None] - 2 * np.matmul(x[cand], x[nodes][:, :, None])[:, :, 0]
    d[cand < 0] = np.inf
    order = np.argsort(d, 1, kind="stable")[:, :most]
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v, square = x[cand], sq[cand]
    apart = np.matmul(v, v.transpose(0, 2, 1))
    apart *= np.float32(-2)
    apart += square[:, :, None]
    apart += square[:, None, :]
    far = apart * np.float32(alpha * alpha) > d[:, None, :]
    alive = np.isfinite(d)
    out = np.full((len(nodes), degree), -1, np.int32)
    far[:, np.arange(cand.shape[1]), np.arange(cand.shape[1])] = False
    every = np.arange(len(nodes))
    for k in range(degree):
        pick = alive.argmax(1)
        some = alive[every, pick]
        if not some.any():
            break
        out[:, k] = np.where(some, cand[every, pick], -1)
        alive &= far[every, pick]
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = 64, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Graph (rows of neighbours) and entry node of one shard."""
    n, room = len(x), degree + degree // 2
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, room), -1, np.int32)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 16
    while at < n:
        batch = order[at : at + size]
        cand, _ = beam_search(x, graph, entry, x[batch], beam)
        if at < 96:  # a small graph: all of it is close
            cand = np.concatenate([cand, np.broadcast_to(order[:at], (len(batch), at))], 1).astype(np.int32)
        graph[batch, :degree] = robust_prune(x, batch, cand, degree, alpha)
        src, slot = np.nonzero(graph[batch] >= 0)
        to, back = graph[batch[src], slot], batch[src]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(count.max())), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = back
        joined = np.concatenate([graph[nodes], extra], 1)
        # Back edges may fill a node's room; it is pruned when they do not fit, and at the end.
        fits = (joined >= 0).sum(1) <= room
        packed = -np.sort(-joined[fits], 1)[:, :room]
        graph[nodes[fits]] = packed
        if (~fits).any():
            graph[nodes[~fits], :degree] = robust_prune(x, nodes[~fits], joined[~fits], degree, alpha)
            graph[nodes[~fits], degree:] = -1
        at += len(batch)
        size = max(16, min(256, 2 * size, CELLS // n))
    over = np.flatnonzero((graph >= 0).sum(1) > degree)
    if len(over):
        graph[over, :degree] = robust_prune(x, over, graph[over], degree, alpha)
    # What has room to spare stands in the first places: neighbours are packed or pruned, and both fill from the left.
    return np.ascontiguousarray(graph[:, :degree]), entry


def index_shard(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a shard sorted so that equal vectors stand together: ids, vectors, the node of each row, and for
    each row the neighbours of its node if it is the node's first, else none (-1)."""
    order = np.lexsort([ids, *x.T[::-1]])
    ids, x = ids[order], x[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
    distinct = x[new]
    graph, entry = build(lift(distinct)[0])
    neighbours = np.full((len(ids), graph.shape[1] + 1), -1, np.int32)
    neighbours[new, :-1] = graph
    neighbours[:, -1] = entry
    return ids, x, np.cumsum(new) - 1, neighbours


class Shard:
    """One shard's index rows, sorted by node and id, ready to be searched."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, node: np.ndarray, neighbours: np.ndarray):
        self.ids, self.x = ids, x
        self.first = np.searchsorted(node, np.arange(node[-1] + 1))
        self.size = np.diff([*self.first, len(x)])
        self.distinct, self.graph, self.entry = x[self.first], neighbours[self.first, :-1], int(neighbours[0, -1])
        self.lifted, self.top = lift(self.distinct)

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the best k rows found for each query, by exact double products."""
        # A query's scale does not change its order; at the largest norm it meets the lifted vectors best.
        scaled = q / np.abs(q).max(1)[:, None]
        scaled *= self.top / np.sqrt((scaled * scaled).sum(1))[:, None]
        found, _ = beam_search(self.lifted, self.graph, self.entry, np.concatenate([scaled, np.zeros((len(q), 1))], 1).astype(np.float32), beam)
        out_q, out_i, out_s = [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            for row, qid, vector in zip(found, qids, q, strict=True):
                nodes = row[row >= 0]
                take = nodes[np.argsort(-(self.distinct[nodes] @ vector), kind="stable")[: k + 1]]
                many = np.minimum(self.size[take], k + 1)
                rows = np.repeat(self.first[take] - np.cumsum(many) + many, many) + np.arange(many.sum())
                rows = rows[self.ids[rows] != qid]
                s = (self.x[rows] * vector).sum(1)  # one sum order for all rows, so that equal vectors have equal scores
                best = np.lexsort((self.ids[rows], -s))[:k]
                out_q.append(np.full(len(best), qid))
                out_i.append(self.ids[rows][best])
                out_s.append(s[best])
        return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def build_index(rows: DataFrame) -> DataFrame:
    """The index table of rows (shard, id, vec): adds each row's node and its neighbours and entry node."""

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ids, x, node, neighbours = index_shard(g["id"].to_numpy(), np.stack(g["vec"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"shard": key[0], "id": ids, "vec": list(x), "node": node, "neighbours": list(neighbours)})

    return rows.select("shard", "id", "vec").groupBy("shard").applyInPandas(one, "shard int, id long, vec array<double>, node int, neighbours array<int>")


def nearest(table: DataFrame, queries: DataFrame, k: int, id_column: str = "id", vector: str = "vec", shard_rows: int = SHARD_ROWS, tasks: int = TASKS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each id of queries (columns as in table; of
    repeated ids the least vector of the table's width asks)."""
    rows, asked = clean(table, id_column, vector), clean(queries, id_column, vector)
    shape = {r[0]: r[1] for r in rows.groupBy(F.size("vec")).count().collect()}
    if not shape:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(shape, key=lambda w: (shape[w], -w))
    n = shape[width]
    shards = max(1, min(tasks, -(-n // 1024)), -(-n // shard_rows))
    rows, asked = rows.where(F.size("vec") == width), asked.where(F.size("vec") == width).groupBy("id").agg(F.min("vec").alias("vec"))
    index = textio.cut(build_index(rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)).cast("int"))))
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "vec", F.lit(0).alias("node"), F.lit(None).cast("array<int>").alias("neighbours"))
    dealt = index.select("shard", F.lit(0).alias("kind"), "id", "vec", "node", "neighbours").unionByName(asks).repartition("shard").sortWithinPartitions("shard", "kind", "node", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        index_rows: list[tuple[np.ndarray, ...]] = []
        block: list[tuple[np.ndarray, np.ndarray]] = []
        now, held = None, 0

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal shard, held
            if shard is None and index_rows:
                shard = Shard(*(np.concatenate(z) for z in zip(*index_rows, strict=True)))
                index_rows.clear()
            if block and shard is not None:
                ids, q = (np.concatenate(z) for z in zip(*block, strict=True))
                # As many at a time as keep the marks of seen nodes within CELLS.
                step = max(1, min(BLOCK, CELLS // len(shard.distinct)))
                for s in range(0, len(ids), step):
                    found = shard.search(ids[s : s + step], q[s : s + step], k)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2])], ["query_id", "vec_id", "score"])
            block.clear()
            held = 0

        for batch in batches:
            of, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if a == b:
                    continue
                if of[a] != now:
                    yield from answers()
                    now, shard = of[a], None
                    index_rows.clear()
                part = batch.slice(a, b - a)
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                if kind[a] == 0:
                    index_rows.append((ids[a:b], x, part.column(4).to_numpy(zero_copy_only=False), part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)))
                else:
                    block.append((ids[a:b], x))
                    held += b - a
                    if held >= BLOCK:
                        yield from answers()
        yield from answers()

    found = textio.map_batches(dealt, run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """All candidates of each query, for tests and measured recall."""
    out = []
    for qid, v in zip(qids, q, strict=True):
        s = (x * v).sum(1)
        s[ids == qid] = -np.inf
        best = np.lexsort((ids, -s))[: min(k, int((ids != qid).sum()))]
        out += [(qid, r, ids[i], s[i]) for r, i in enumerate(best, 1)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])


def op10_graph_search(spark, sf_dir: str) -> DataFrame:
    table = textio.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(table, table.where(F.col("vec_id") % 20 == 0), 20, "vec_id", "embedding")


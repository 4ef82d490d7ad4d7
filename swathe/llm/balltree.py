"""Exact search for the largest inner products with ball trees (operator 12).

Every task cuts its rows into shards and builds a ball tree over each; shards are stored as rows. A query
takes nodes in the order of their upper bound q.centre + |q| radius, opens inner nodes, scores leaves, and
ends when the best bound left is below its current k-th score. That score is shared: a first pass scores
the most promising leaf of every shard, the k-th score over all shards is the start of the second pass,
and within a task it rises from shard to shard. Queries travel to the tasks in blocks of bounded size.

Scores are exact: vectors are integers, floor(1024 x). Rows left out are those of
``embeddings.whole_vectors``. A query's own row is no candidate, but another row that repeats its id is;
a repeated query row is answered as often as it occurs. Ties go to the smaller id, null ids last; a null
id asks nothing. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathe.llm.common import stored
from swathe.llm.embeddings import matrix, whole_vectors

SCALE = 1024
SHARD = 8192              # rows of a shard
LEAF = 64
QUERY_BLOCK = 8192        # queries that are broadcast at a time
SHARD_SCHEMA = ("ids array<long>, points binary, centres binary, radii binary, child array<int>, "
                "begin array<int>, past array<int>")
HIT_SCHEMA = "q long, query_id long, own boolean, vec_id long, score long"
EXACT = float(1 << 53)


class BallTree:
    """Points in tree order; node 0 is the root, an inner node's children are ``child`` and the next."""

    def __init__(self, points: np.ndarray, centres: np.ndarray, radii: np.ndarray, child: np.ndarray,
                 begin: np.ndarray, past: np.ndarray):
        self.points, self.centres, self.radii = points, centres, radii
        self.child, self.begin, self.past = child, begin, past
        self.sizes = np.sqrt((centres ** 2).sum(axis=1)) + radii

    @staticmethod
    def build(points: np.ndarray) -> tuple[BallTree, np.ndarray]:
        """The tree, and the order of its points. A node is halved at the median along the line between
        two points far from each other."""
        order = np.arange(len(points))
        spans, child, centres, radii = [(0, len(points))], [], [], []
        at = 0
        while at < len(spans):
            begin, past = spans[at]
            own = points[order[begin:past]].astype("float64")
            centre = own.mean(axis=0)
            far = ((own - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(np.sqrt(far.max()))
            if past - begin <= LEAF:
                child.append(-1)
            else:
                one = own[far.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                half = (past - begin) // 2
                order[begin:past] = order[begin:past][np.argpartition(own @ (other - one), half)]
                child.append(len(spans))
                spans += [(begin, begin + half), (begin + half, past)]
            at += 1
        begin, past = np.array(spans, "int32").T
        return BallTree(points[order], np.array(centres), np.array(radii), np.array(child, "int32"), begin, past), order

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bound of each query's scores in the node beside it, a little above what rounding can take."""
        reach = (queries * self.centres[nodes]).sum(axis=1) + norms * self.radii[nodes]
        return reach + 1e-9 * norms * self.sizes[nodes] + 1e-6


class Best:
    """The best ``k`` (query, score, id) of a block of queries, and every query's k-th score so far."""

    def __init__(self, known: np.ndarray, k: int):
        self.k, self.floor = k, known.copy()
        self.q = self.score = self.id = np.empty(0, "int64")
        self.null = np.empty(0, bool)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
        ids, null = np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[rank < self.k]
        self.q, self.score, self.id, self.null = q[rank < self.k], score[kept], ids[kept], null[kept]
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[order[last]])


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where these are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * points.shape[1]
    if most < EXACT:
        return (queries.astype("float64") @ points.T.astype("float64")).astype("int64")
    return queries.astype("int64") @ points.T.astype("int64")


def search(tree: BallTree, ids: np.ndarray, null: np.ndarray, queries: np.ndarray, best: Best,
           first_leaf_only: bool = False) -> int:
    """Add the tree's rows to ``best``; returns how many (query, leaf) pairs were scored."""
    asked = queries.astype("float64")
    norms = np.sqrt((asked ** 2).sum(axis=1))
    everyone = np.arange(len(queries))
    # Bounds of the nodes a query may still open; taken nodes and those not reached stand at minus infinity.
    front = np.full((len(queries), len(tree.radii)), -np.inf)
    front[:, 0] = tree.bounds(asked, norms, np.zeros(len(queries), "int64"))
    done = np.zeros(len(queries), bool)
    visited = 0
    while True:
        node = front.argmax(axis=1)
        bound = front[everyone, node]
        rows = np.flatnonzero((bound > -np.inf) & (bound >= best.floor) & ~done)
        if not len(rows):
            return visited
        node = node[rows]
        front[rows, node] = -np.inf
        inner = tree.child[node] >= 0
        for step in (0, 1):
            child = tree.child[node[inner]] + step
            to = rows[inner]
            front[to, child] = np.minimum(bound[to], tree.bounds(asked[to], norms[to], child))
        rows, node = rows[~inner], node[~inner]
        if not len(rows):
            continue
        visited += len(rows)
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        leaves, cuts = np.unique(node, return_index=True)
        who, what, how = [], [], []
        for leaf, own in zip(leaves, np.split(rows, cuts[1:]), strict=True):
            begin, past = tree.begin[leaf], tree.past[leaf]
            scores = products(queries[own], tree.points[begin:past])
            q, p = np.nonzero(scores >= best.floor[own][:, None])
            who.append(own[q])
            what.append(p + begin)
            how.append(scores[q, p])
        place = np.concatenate(what)
        best.add(np.concatenate(who), np.concatenate(how), ids[place], null[place])
        if first_leaf_only:
            done[rows] = True


# -- shards and blocks of queries --------------------------------------------------------

def _whole(column: pa.Array) -> np.ndarray:
    return np.floor(SCALE * matrix(column)).astype("int32")


def _shards(batches):
    held, rows = [], 0

    def close(batch: pa.Table) -> pa.RecordBatch:
        tree, order = BallTree.build(_whole(batch.column("vector").combine_chunks()))
        ids = batch.column("vec_id").combine_chunks().take(pa.array(order))
        lists = [pa.array([x], pa.list_(pa.int32())) for x in (tree.child, tree.begin, tree.past)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             *(pa.array([x.tobytes()]) for x in (tree.points, tree.centres, tree.radii)), *lists],
            ["ids", "points", "centres", "radii", "child", "begin", "past"])
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SHARD - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == SHARD:
                yield close(pa.Table.from_batches(held))
                held, rows = [], 0
    if rows:
        yield close(pa.Table.from_batches(held))


def _opened(batch: pa.RecordBatch, length: int):
    """(tree, ids, which ids are null) of every shard in a batch."""
    for i in range(batch.num_rows):
        at = lambda name, i=i: batch.column(name)[i]
        raw = lambda name, kind, at=at: np.frombuffer(at(name).as_py(), kind)
        number = lambda name, at=at: at(name).values.to_numpy()
        ids = at("ids").values
        tree = BallTree(raw("points", "int32").reshape(-1, length), raw("centres", "float64").reshape(-1, length),
                        raw("radii", "float64"), number("child"), number("begin"), number("past"))
        null = ids.is_null().to_numpy(zero_copy_only=False)
        yield tree, ids.fill_null(0).to_numpy(zero_copy_only=False), null


def _hits(shards: DataFrame, asked: pa.Table, known: np.ndarray, k: int, length: int, first_leaf_only: bool) -> DataFrame:
    """Every task's best rows for a block of queries, one of them possibly the query's own."""
    number, query_id = (asked.column(c).to_numpy() for c in ("q", "query_id"))
    whole = _whole(asked.column("vector").combine_chunks())
    shared = shards.sparkSession.sparkContext.broadcast((number, query_id, whole, known))

    def run(batches):
        number, query_id, queries, known = shared.value
        best = Best(known, k + 1)
        for batch in batches:
            for tree, ids, null in _opened(batch, length):
                search(tree, ids, null, queries, best, first_leaf_only)
        squares = (queries.astype("int64") ** 2).sum(axis=1)
        own = ~best.null & (best.id == query_id[best.q]) & (best.score == squares[best.q])
        yield pa.RecordBatch.from_arrays(
            [pa.array(number[best.q]), pa.array(query_id[best.q]), pa.array(own), pa.array(best.id, mask=best.null),
             pa.array(best.score)], ["q", "query_id", "own", "vec_id", "score"])
    return shards.mapInArrow(run, HIT_SCHEMA)


def _falling():
    return Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))


def top_k(table: DataFrame, every: int, k: int, column: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best other rows for each row whose id ``every`` divides."""
    rows, length = whole_vectors(table, column=column)
    shards = stored(rows.select("vec_id", "vector").mapInArrow(_shards, SHARD_SCHEMA), "shards")
    asked = stored(rows.where(F.col("vec_id") % every == 0).select(
        F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "vector"), "asked")
    blocks = -(-asked.count() // block)
    found = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow()
        if not part.num_rows:
            continue
        open_ = np.full(part.num_rows, -np.inf)
        probed = _hits(shards, part, open_, k, length, True)
        reached = probed.withColumn("rank", F.row_number().over(_falling())).where(F.col("rank") == k + 1)
        floors = dict(reached.select("q", "score").toPandas().itertuples(index=False, name=None))
        known = np.array([floors.get(q, -np.inf) for q in part.column("q").to_pylist()])
        hits = stored(_hits(shards, part, known, k, length, False), "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = table.sparkSession.createDataFrame([], HIT_SCHEMA)
    # Where several rows look like the query's own, they are equal in every column, so any of them may go.
    ranked = found.withColumn("rank", F.row_number().over(_falling())).withColumn(
        "self", F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("q")))
    others = ranked.where(~F.col("rank").eqNullSafe(F.col("self")))
    rank = F.col("rank") - F.coalesce((F.col("rank") > F.col("self")).cast("int"), F.lit(0))
    return others.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

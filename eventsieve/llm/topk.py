"""Exact top-k by inner product: ball-tree branch and bound in each shard.

Rows are dealt to the nearest of a bounded number of pivots, so that each cell is a
ball of its own, and crowded cells are cut into shards of bounded size. A shard's rows are
ordered by a ball tree, which is built once and written. For a query q and a ball of centre c and
radius r no row can score over q.c + |q| r. That bound orders the cells for each query,
and within a shard the nodes; what lies under the query's current k-th score is
never visited. Queries go to their best cells first; the k-th scores reached there decide
which of the other cells they are sent to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventsieve.plans.tables import materialize

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF_ROWS = 256
#: Cells at most: what is sent to every task is their centres and radii. Beyond it cells hold more shards.
PIVOTS = 1024
#: Cells that a query is sent to in the first round, and how much wider each further round is.
FIRST, GROWTH = 1, 8
_CHUNK = 1024
_EXACT = float(1 << 53)


def _halves(count: int, leaf: int):
    """The runs of rows of each level: halves, down to runs of `leaf` rows at most."""
    nodes = [(0, count)]
    while True:
        yield nodes
        if max(b - a for a, b in nodes) <= leaf:
            return
        # an empty half keeps the levels full: it becomes a copy of its sibling, never searched twice
        split = [(a, (a + b + 1) // 2, b) for a, b in nodes]
        nodes = [run for a, m, b in split for run in ((a, m), (m, b) if b > m else (a, m))]


class BallTree:
    """Nodes in levels; leaves are runs of the reordered rows."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.order, self.levels, away = np.arange(len(rows)), [], None
        for nodes in _halves(len(rows), leaf):
            if away is not None:
                for (a, b), apart in zip(self.leaves, away):
                    far = apart[np.argmax((apart * apart).sum(axis=1))]
                    self.order[a:b] = self.order[a:b][np.argsort(apart @ far, kind="stable")]
            centres = np.array([rows[self.order[a:b]].mean(axis=0) for a, b in nodes])
            away = [rows[self.order[a:b]] - c for (a, b), c in zip(nodes, centres)]
            self.levels.append((centres, np.array([np.sqrt((s * s).sum(axis=1)).max() for s in away])))
            self.leaves = nodes

    @classmethod
    def restored(cls, count: int, centres: np.ndarray, radii: np.ndarray, leaf: int = LEAF_ROWS) -> "BallTree":
        """The tree of rows that already stand in its order, from the nodes of all levels one after the other."""
        tree, at = cls.__new__(cls), 0
        tree.order, tree.levels = np.arange(count), []
        for nodes in _halves(count, leaf):
            tree.levels.append((centres[at : at + len(nodes)], radii[at : at + len(nodes)]))
            tree.leaves, at = nodes, at + len(nodes)
        return tree


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    largest = (np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    if largest < _EXACT:
        return queries @ rows.T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    found = whole(queries) @ whole(rows).T
    return np.clip(found, -(1 << 63), (1 << 63) - 1)


def _upper(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What no row of each ball can score over, for each query; a little above the rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((queries * queries).sum(axis=1))
        slack = 1e-9 * size[:, None] * (np.sqrt((centres * centres).sum(axis=1)) + radii)[None, :] + 1e-6
        return np.nan_to_num(queries @ centres.T + size[:, None] * radii[None, :] + slack, nan=np.inf, posinf=np.inf)


def search(ids, rows, query_ids, queries, bounds, k: int, tree: BallTree | None = None):
    """(query's place, row's place, score) of each query's best k rows that reach its bound."""
    tree = tree or BallTree(rows)
    upper = np.full((len(queries), 1), np.inf)
    for level, (centres, radii) in enumerate(tree.levels):
        if level:
            upper = np.repeat(upper, 2, axis=1)
        # pruned nodes stay below every bound, and so do all nodes under them
        upper = np.where(upper >= bounds[:, None], np.minimum(upper, _upper(queries, centres, radii)), -np.inf)
    seen = {}
    for i, leaf in enumerate(tree.leaves):
        if seen.setdefault(leaf, i) != i:
            upper[:, i] = -np.inf
    best = np.argsort(-upper, axis=1, kind="stable")
    bounds, at = bounds.copy(), np.arange(len(queries))
    found = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=object))
    for turn in range(len(tree.leaves)):
        leaf_of = best[:, turn]
        reach = upper[at, leaf_of]
        live = np.flatnonzero((reach >= bounds) & (reach > -np.inf))
        if not len(live):
            break
        parts = [found]
        for leaf in np.unique(leaf_of[live]):
            mine = live[leaf_of[live] == leaf]
            held = tree.order[slice(*tree.leaves[leaf])]
            scores = _products(queries[mine], rows[held])
            good = (scores >= bounds[mine][:, None]) & (ids[held][None, :] != query_ids[mine][:, None])
            q, r = np.nonzero(good)
            parts.append((mine[q], held[r], scores[q, r]))
        query, row, score = (np.concatenate([np.asarray(p[i]) for p in parts]) for i in range(3))
        if score.dtype == object and all(p[2].dtype != object for p in parts[1:]):
            score = score.astype(np.float64)
        order = np.lexsort((ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < k
        found = (query[kept], row[kept], score[kept])
        last = np.flatnonzero(np.arange(len(query)) - first == k - 1)
        bounds[query[last]] = np.maximum(bounds[query[last]], score[last].astype(np.float64))
    return found


def _best(pairs: DataFrame, k: int, query: str) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(row, id, vector) with floor(scale * x) for each component; row numbers the rows.

    Vectors that are null or hold a null or a component that is not finite take no part, nor do
    rows without an id.
    """
    x = table[vector_col].cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return table.where(x.isNotNull() & finite & table[id_col].isNotNull()).select(
        F.monotonically_increasing_id().alias("row"),
        table[id_col].cast("long").alias("id"),
        F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("double")).alias("vector"),
    )


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of lists, with 0 where they are shorter."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = column.flatten().to_numpy()
    return out


def _pivots(rows: DataFrame, count: int, width: int) -> np.ndarray:
    """Different vectors, `count` at most, among the rows with the least hashes: a bounded sample, whatever the table's size."""
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(4 * count).select("vector").collect()
    known = {tuple(r["vector"]): None for r in sample}
    return np.array([v + (0.0,) * (width - len(v)) for v in list(known)[:count]]).reshape(-1, width)


def top_k(
    table: DataFrame,
    queries,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row that queries selects.

    queries is a condition on the column id. score is the inner product of the
    vectors in whole numbers; the shorter of two vectors counts as padded with
    0; products beyond 64 bits stop at the largest long. Ties go to the
    smaller id. Every row is searched, repeated ids too: rows that share their id are the query's own, and together one
    query, whose scores are ranked together. Null vectors, vectors with a null or a component that is not finite, and
    rows without an id take no part. Fewer rows than k give all; an empty table gives an empty result; further
    columns are ignored.
    """
    rows = materialize(whole_vectors(table, id_col, vector_col, scale), "vectors")
    peak = F.array_max(F.transform("vector", F.abs))
    facts = rows.agg(
        F.count("id").alias("n"), F.count(F.when(queries, 1)).alias("q"), F.max(F.size("vector")).alias("width"), F.max(peak).alias("peak")
    ).first()
    if not facts["q"]:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).where("false")
    width, most = max(facts["width"], 1), facts["peak"] or 0.0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    pivots = _pivots(rows, min(PIVOTS, -(-facts["n"] // shard_rows)), width)
    context = table.sparkSession.sparkContext
    sent = context.broadcast(pivots)
    packed = lambda m: pa.array([r.tobytes() for r in m.astype(kind)], pa.binary())
    matrix = lambda c: np.frombuffer(b"".join(c.to_pylist()), dtype=kind).reshape(-1, width).astype(np.float64)

    def deal(batches):
        centres = sent.value
        half = (centres * centres).sum(axis=1) / 2
        for batch in batches:
            held = _padded(batch.column("vector"), width)
            with np.errstate(over="ignore", invalid="ignore"):
                cell = np.concatenate(
                    [np.argmin(half - held[i : i + _CHUNK] @ centres.T, axis=1) for i in range(0, len(held), _CHUNK)] or [np.empty(0, int)]
                )
                away = np.sqrt(((held - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), packed(held), pa.array(cell.astype(np.int32)), pa.array(away)],
                ["row", "id", "vector", "cell", "away"],
            )

    dealt = materialize(rows.mapInArrow(deal, "row long, id long, vector binary, cell int, away double"), "dealt")
    # one row a cell
    cells = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("row").alias("n"), F.max("away").alias("radius")).collect()}
    names = sorted(cells)
    pieces = np.array([-(-cells[c]["n"] // shard_rows) for c in names])
    routes = context.broadcast((names, pivots[names], np.array([cells[c]["radius"] for c in names]), pieces))
    piece = F.pmod(F.xxhash64("row"), F.element_at(F.array(*[F.lit(int(dict(zip(names, pieces)).get(c, 1))) for c in range(len(pivots))]), F.col("cell") + 1))

    def build(held: pa.Table) -> pa.Table:
        vectors = matrix(held["vector"])
        tree = BallTree(vectors)
        nodes = [np.concatenate(x) for x in zip(*tree.levels)]
        return pa.table(
            {
                "cell": held["cell"][:1], "piece": held["piece"][:1],
                "ids": pa.array([held["id"].to_numpy()[tree.order].astype("<i8").tobytes()]),
                "vectors": pa.array([vectors[tree.order].astype(kind).tobytes()]),
                "centres": pa.array([nodes[0].astype("<f8").tobytes()]), "radii": pa.array([nodes[1].astype("<f8").tobytes()]),
            }
        )

    index = materialize(
        dealt.select("cell", piece.cast("int").alias("piece"), "id", "vector")
        .groupBy("cell", "piece")
        .applyInArrow(build, "cell int, piece int, ids binary, vectors binary, centres binary, radii binary"),
        "balltrees",
    )
    asked = dealt.where(queries).select(F.col("row").alias("query"), F.col("id").alias("query_id"), "vector")

    def routed(first: int, upto: int):
        """Sends each query to the cells that stand from first to upto in the order of its bounds, and reach its k-th score."""

        def run(batches):
            names, centres, radii, pieces = routes.value
            for batch in batches:
                for i in range(0, batch.num_rows, _CHUNK):
                    part = batch.slice(i, _CHUNK)
                    upper = _upper(matrix(part.column("vector")), centres, radii)
                    bound = np.nan_to_num(part.column("bound").to_numpy(zero_copy_only=False), nan=-np.inf)
                    order = np.argsort(-upper, axis=1, kind="stable")[:, first:upto]
                    reach = np.take_along_axis(upper, order, axis=1) >= bound[:, None]
                    query, place = np.nonzero(reach)
                    cell = order[query, place]
                    each = np.repeat(np.arange(len(query)), pieces[cell])
                    number = np.arange(len(each)) - np.repeat(np.cumsum(pieces[cell]) - pieces[cell], pieces[cell])
                    columns = [part.column(c).take(pa.array(query[each])) for c in ("query", "query_id", "vector", "bound")]
                    columns += [pa.array(np.array(names, dtype=np.int32)[cell[each]]), pa.array(number.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vector", "bound", "cell", "piece"])

        return run

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        if not held.num_rows or not asking.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})
        read = lambda c, t: np.frombuffer(held[c][0].as_py(), dtype=t)
        ids, vectors = read("ids", "<i8"), read("vectors", kind).reshape(-1, width).astype(np.float64)
        tree = BallTree.restored(len(ids), read("centres", "<f8").reshape(-1, width), read("radii", "<f8"))
        bounds = np.nan_to_num(asking["bound"].to_numpy(), nan=-np.inf)
        query_ids, number = asking["query_id"].to_numpy(), asking["query"].to_numpy()
        query, row, score = search(ids, vectors, query_ids, matrix(asking["vector"]), bounds, k, tree)
        return pa.table(
            {"query": number[query], "query_id": query_ids[query], "vec_id": ids[row], "score": pa.array([int(s) for s in score], pa.int64())}
        )

    best, first, upto = None, 0, FIRST
    while first < len(names):
        if best is None:
            bounded = asked.withColumn("bound", F.lit(None).cast("double"))
        else:
            kth = best.where(F.col("rank") == k).select("query", F.col("score").cast("double").alias("bound"))
            bounded = asked.join(kth, "query", "left")
        schema = "query long, query_id long, vector binary, bound double, cell int, piece int"
        asking = bounded.mapInArrow(routed(first, upto), schema)
        asking = materialize(asking, "asking")
        # a shard travels once for each block of the queries that reach it, so once if they are few
        shards = asking.groupBy("cell", "piece").agg(F.ceil(F.count("query") / F.lit(block_queries)).alias("blocks"))
        shards = materialize(shards, "shards")
        asking = asking.join(shards, ["cell", "piece"]).withColumn("block", F.pmod(F.xxhash64("query"), "blocks")).drop("blocks")
        wanted = shards.select(F.col("cell").alias("to_cell"), F.col("piece").alias("to_piece"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to_block"))
        held = index.join(wanted, (F.col("cell") == F.col("to_cell")) & (F.col("piece") == F.col("to_piece")))
        found = (
            held.groupBy("to_cell", "to_piece", "to_block")
            .cogroup(asking.groupBy("cell", "piece", "block"))
            .applyInArrow(run, "query long, query_id long, vec_id long, score long")
        )
        if best is not None:
            found = best.drop("rank").union(found)
        best = materialize(_best(found, k, "query"), "topk")
        first, upto = upto, upto + GROWTH * upto
    return _best(best.drop("rank"), k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

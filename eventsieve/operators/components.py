"""Connected components of an undirected graph given as an edge table.

Each task first contracts the edges it holds: a run of them becomes the stars of its own components, which connect the same
nodes by fewer edges. What is left, if it is few, is contracted in one task; otherwise global rounds follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsieve.plans.tables import discard, materialize

#: With more edges than this, minima are written before they are joined.
SPLIT = 1 << 20
#: Edges that a task contracts at once, and the most that are left to a single task.
RUN = 1 << 18


def _stars(us: list, vs: list) -> tuple[list, list]:
    """(node, least node of its component) of every node of the edges that isn't the least itself."""
    above: dict = {}

    def root(x):
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for u, v in zip(us, vs):
        a, b = root(u), root(v)
        if a != b:
            above[max(a, b)] = min(a, b)
    return list(above), [root(x) for x in list(above)]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars, RUN edges at a time, so that memory is bounded whatever a task holds."""
    us, vs, kind = [], [], None

    def out():
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x in _stars(us, vs)], ["u", "v"])

    for batch in batches:
        kind = batch.schema.field("u").type
        for at in range(0, batch.num_rows, RUN):
            part = batch.slice(at, RUN)
            us += part.column("u").to_pylist()
            vs += part.column("v").to_pylist()
            if len(us) >= RUN:
                yield out()
                us, vs = [], []
    if us:
        yield out()


def _contracted(edges: DataFrame) -> DataFrame:
    types = {c: edges.schema[c].dataType.simpleString() for c in "uv"}
    return edges.mapInArrow(_contract, f"u {types['u']}, v {types['v']}")


def _state(edges: DataFrame):
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
    ).first()
    return row["n"], row["x"]


def _joinable(least: DataFrame, split: bool) -> DataFrame:
    """least as a table of its own: a join of plain tables can split a node that very many edges share, one with an aggregate can't."""
    return materialize(least, "least") if split else least


def _large_star(edges: DataFrame, split: bool) -> DataFrame:
    """Every larger neighbour of a node is hung on the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u")
        .join(_joinable(least, split), "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame, split: bool) -> DataFrame:
    """Every node and its smaller neighbours are hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _joinable(down.groupBy("u").agg(F.min("v").alias("m")), split)
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node.

    Each task contracts its own edges. If no more than RUN are left, one task ends the search. Otherwise
    large-star and small-star steps alternate, which end in O(log^2 n) rounds
    with a star around the least node of each component; more than max_rounds
    are an error. Each step is a pre-aggregated minimum and an equi-join. In large graphs
    the minima are written first, so that the edges of a node that has very many are split over tasks. Rows with a null
    end, and loops, are ignored; repeated edges count once. An empty table gives an empty result.
    """
    now = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
    )
    now = materialize(_contracted(now).distinct(), "edges")
    state = _state(now)
    if 0 < state[0] <= RUN:
        before, now = now, materialize(_contracted(now.coalesce(1)), "edges")
        discard(before)
        return _named(now)
    for _ in range(max_rounds if state[0] else 0):
        split = state[0] > SPLIT
        large = _large_star(now, split)
        before, now = now, materialize(_small_star(materialize(large, "stars") if split else large, split), "edges")
        discard(before)
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    """(node, component) of stars around the least nodes."""
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

import math
import random

from pyspark.sql import functions as F

from eventsieve.llm import queries, topk


def brute(rows, k):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(64 * x) for x in v]))
    scored = {}
    for q, own in whole:
        if q % 20 == 0:
            scored.setdefault(q, []).extend((-sum(a * b for a, b in zip(own, e)), i) for i, e in whole if i != q)
    return sorted((q, n, i, -s) for q, found in scored.items() for n, (s, i) in enumerate(sorted(found)[:k], 1))


def check(spark, rows, k=20, **sizes):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(table, F.col("id") % 20 == 0, k, **sizes)
    assert sorted(map(tuple, found.collect())) == brute(rows, k)


def vectors(n, dims, seed):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]


def test_matches_brute_force_over_many_shards_and_blocks(spark):
    rows = vectors(700, 8, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # ties
    check(spark, rows, shard_rows=90, block_queries=16)
    check(spark, rows, k=3, shard_rows=90, block_queries=1000)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0])]
    rows += [(5, [-1.0, 0.5]), (5, [-1.0, 0.5]), (6, [0.25]), (7, []), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (40, [3e9, -1e9])]
    check(spark, rows)
    check(spark, [], k=2)
    check(spark, [(0, [1.0])], k=2)


def test_repeated_ids_match_brute_force_and_sql(spark, tmp_path):
    import duckdb

    draw = random.Random(4)
    rows = [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [3.0, 3.0]), (2, [0.5, 0.5]), (20, [1.0, 0.0]), (20, [0.0, 2.0])]
    rows += [(draw.randrange(60), [draw.gauss(0, 1), draw.gauss(0, 1)]) for _ in range(200)]
    rows += [(draw.randrange(60), [0.5, -0.5]) for _ in range(100)]
    check(spark, rows[:5])
    check(spark, rows, shard_rows=16, block_queries=7)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op9_topk(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(db.execute(queries.OP9_SQL).fetchall())


def test_cells_far_below_the_kth_score_get_no_query(spark):
    """Clusters apart: after the first round most cells are pruned by their bound, and results stay exact."""
    draw = random.Random(6)
    rows = []
    for i in range(600):
        c = i % 6
        rows.append((i, [(50.0 if d == c else 0.0) + draw.gauss(0, 0.5) for d in range(6)]))
    rows += [(1000 + i, [0.0] * 5 + [60.0]) for i in range(300)]  # one vector in a third of the rows
    check(spark, rows, k=5, shard_rows=70, block_queries=9)


def test_tree_prunes_and_stays_exact():
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 200
    rows = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)))
    queries = rows[:50]
    ids = np.arange(4000)
    query, row, score = topk.search(ids, rows, ids[:50], queries, np.full(50, -np.inf), 5)
    exact = queries @ rows.T
    exact[np.arange(50), np.arange(50)] = -np.inf
    for q in range(50):
        best = sorted((-exact[q, i], i) for i in range(4000))[:5]
        assert [(-s, r) for s, r in zip(score[query == q], row[query == q])] == best


def test_a_written_tree_is_the_same_tree():
    import numpy as np

    rows = np.floor(np.random.default_rng(3).normal(size=(1000, 8)) * 50)
    tree = topk.BallTree(rows, leaf=64)
    centres, radii = (np.concatenate(x) for x in zip(*tree.levels))
    again = topk.BallTree.restored(1000, centres, radii, leaf=64)
    assert again.leaves == tree.leaves and all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(again.levels, tree.levels))
    for a, b in tree.leaves:
        centre, radius = rows[tree.order[a:b]].mean(axis=0), tree.levels[-1][1][tree.leaves.index((a, b))]
        assert np.sqrt(((rows[tree.order[a:b]] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9


def test_a_shard_that_few_queries_reach_travels_once(spark, monkeypatch):
    """Blocks are cut within a shard: one more is needed only where more queries reach it than a block holds."""
    kept = []
    plain = topk.materialize

    def keeping(df, label):
        out = plain(df, label)
        if label == "shards":
            kept.extend(r.blocks for r in out.collect())
        return out

    monkeypatch.setattr(topk, "materialize", keeping)
    rows = vectors(600, 6, 8)
    check(spark, rows, k=4, shard_rows=60, block_queries=30)
    assert kept and set(kept) == {1}  # 30 queries, a block's worth
    kept.clear()
    check(spark, rows, k=4, shard_rows=60, block_queries=7)
    assert max(kept) > 1 and max(kept) <= 5

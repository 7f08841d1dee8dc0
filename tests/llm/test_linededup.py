import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from eventsieve.llm import linededup, queries

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(linededup.UPPER, linededup.LOWER)


def brute(rows, least_chars=40, least_docs=5):
    """{(id, text): (n_lines, n_dropped, kept)} of (id, text) rows."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        drop = lambda line: len(key(line)) >= least_chars and len(holders[key(line)]) >= least_docs and max(holders[key(line)]) != i
        kept = [x for x in lines if not drop(x)]
        out[i, text] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.text): (r.n_lines, r.n_dropped, r.kept) for r in (
        linededup.without_frequent_lines(docs.withColumn("whole", F.col("text")), **options)
        .select("doc_id", F.col("whole").alias("text"), "n_lines", "n_dropped", F.col("text").alias("kept")).collect()
    )}


def test_brute_force(spark):
    draw = random.Random(3)
    pool = [f"{'É' if n % 3 else 'Plain'} line number {n} that is long enough for the rule to see" for n in range(12)]
    edges = ["x" * 39, "x" * 40, "é" * 40, "É" * 40, " " * 45, "", "short"]
    change = [lambda s: s, str.upper, lambda s: f"\t {s} \r", lambda s: f"\xa0{s}", lambda s: s.lower()]
    rows = [
        (i, "\n".join(draw.choice(change)(draw.choice(pool + edges)) for _ in range(draw.randint(0, 9))) + draw.choice(["", "\n", "\n\n"]))
        for i in range(60)
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, least_chars=1, least_docs=2) == brute(rows, 1, 2)
    assert any(n for _, n, _ in brute(rows).values())


def test_threshold_counts_documents_not_lines(spark):
    line = "a line of forty code points, or some more than that"
    four = [(i, f"{line}\n{line}\nown {i}") for i in range(4)]
    assert all(n == 0 for _, n, _ in found(spark, four).values())
    five = found(spark, [*four, (9, f"{line}\nx\n  {line.upper()}")])
    assert {k[0]: v[1:] for k, v in five.items()} == {**{i: (2, f"own {i}") for i in range(4)}, 9: (0, f"{line}\nx\n  {line.upper()}")}


def test_repeated_ids_are_one_document_and_rows_without_id_never_keep(spark):
    line = "a line of forty code points, or some more than that"
    rows = [(1, f"{line}\na"), (1, f"{line}\na"), (1, f"b\n{line}"), (2, line), (3, line), (4, line), (None, line), (None, f"{line}\n")]
    assert all(n == 0 for _, n, _ in found(spark, rows).values())
    docs = spark.createDataFrame([*rows, (5, line)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text, r.n_dropped) for r in linededup.without_frequent_lines(docs).collect())
    assert out == [(0, "", 1), (0, "", 1), (1, "a", 1), (1, "a", 1), (1, "b", 1), (2, "", 1), (3, "", 1), (4, "", 1), (5, line, 0)]


def test_long_text_and_crowded_line(spark):
    line = "the same opening line that very many documents begin with"
    rows = [(i, f"{line}\nown {i}") for i in range(3000)]
    rows.append((3000, "\n".join([line, "z"] * 20000)))
    rows.append((3001, line))
    out = found(spark, rows)
    assert out[rows[3000]] == (40000, 20000, "\n".join(["z"] * 20000)) and out[rows[3001]][1] == 0
    assert all(out[r][1:] == (1, f"own {r[0]}") for r in rows[:3000])


def test_awkward_rows_and_clashing_names(spark, awkward, empty):
    for name in ("n_lines", "id", "drop_row"):
        docs = awkward.withColumnRenamed("mark", name)
        out = linededup.without_frequent_lines(docs, least_chars=1, least_docs=2)
        assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(docs.columns) + 2
        assert out.count() == docs.count()
    by_id = {r.doc_id: r for r in linededup.without_frequent_lines(awkward, least_chars=1, least_docs=2).collect()}
    assert by_id[1].text == "" and by_id[1].n_dropped == 1 and by_id[2].n_dropped == 0
    assert (by_id[4].text, by_id[4].n_lines) == ("", 1) and len(by_id[5].text) > 500_000
    assert linededup.without_frequent_lines(empty).count() == 0


def test_query_equals_its_sql_without_python(spark):
    sf = "/root/testdata/sf0.001"
    mine = queries.op11_linededup(spark, sf)
    assert "Python" not in mine._jdf.queryExecution().toString() and "Arrow" not in mine._jdf.queryExecution().toString()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert {tuple(r) for r in mine.collect()} == set(con.execute(queries.OP11_SQL).fetchall())

"""The registered queries of these operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventsieve.llm import contamination, importance, kneserney, language, licences, linededup, mixing, quality, secretscan, simhash, topk, urlrules, vectorcodes
from eventsieve.llm.text import training_rows
from eventsieve.plans.tables import table


def _held_out(folds: int, fold: int):
    return F.coalesce(~training_rows("doc_id", folds, fold), F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(training_rows("doc_id", 5, 0)))
    return quality.scored(docs, model).select(
        "doc_id",
        _held_out(5, 0),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("mark", "source")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(training_rows("doc_id", 5, 0)), "doc_id", "text", "lang")
    return language.predicted(docs, model).select("doc_id", _held_out(5, 0), "lang_pred", "score", "rejected")


def op5_kneserney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneserney.fit(docs.where(training_rows("doc_id", 7, 2)))
    return kneserney.scored(docs, model).select(
        "doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files <source>/<lang>/<thousand>/<doc_id>.txt; each fiftieth is a licence file of <source>/<lang>."""
    docs = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    path = F.when(F.col("doc_id") % 50 == 0, F.concat_ws("/", folder, F.concat(F.lit("LICENSE."), "doc_id"))).otherwise(
        F.concat_ws("/", folder, F.expr("doc_id div 1000"), F.concat("doc_id", F.lit(".txt")))
    )
    return licences.licensed(docs.select("doc_id", "text", path.alias("path")))


URL_RULES = """
    SELECT * FROM VALUES
      ('com', '/', 'allow'),
      ('example.com', '/en/', 'block'),
      ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'),
      ('net', '/fr/', 'block')
    AS rules(host, path, verdict)
"""


def op7_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


OP7_SQL = r"""
    WITH rules(host, path, verdict) AS (VALUES
      ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    after AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    parsed AS (
      SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM after),
    fits AS (
      SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
        row_number() OVER (
          PARTITION BY p.page_id ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS n
      FROM parsed p LEFT JOIN rules r
        ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP9_SQL = """
    WITH v AS (
      SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e
      FROM embeddings
      WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id,
        list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    ranked AS (
      SELECT query_id, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
      FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents")))


def op11_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.without_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
    WITH lines AS (
      SELECT row, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
      FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
    keyed AS (
      SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM lines),
    frequent AS (
      SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    judged AS (
      SELECT k.*, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS dropped
      FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY row, doc_id
"""


def op12_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compressed(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return vectorcodes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256")
    )


def op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds one after the other, each as tables of what is nearest and of the next entries."""
    steps = [
        f"""kept AS (
          SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
          FROM embeddings
          WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
        cut AS MATERIALIZED (
          SELECT n, vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x
          FROM kept, (SELECT unnest(range({parts})) AS p)),
        book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c FROM cut WHERE n <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""near{i} AS MATERIALIZED (
          SELECT p, n, min([far, e]) AS best
          FROM (SELECT cut.p, n, e, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT AS far
            FROM cut JOIN book{i} AS b ON cut.p = b.p)
          GROUP BY p, n)"""
        )
        if i < rounds:
            steps.append(
                f"""mean{i} AS (
          SELECT p, e, list(m ORDER BY k) AS c
          FROM (SELECT p, e, k, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
            FROM (SELECT cut.p, best[2] AS e, unnest(x) AS y, unnest(range(len(x))) AS k
              FROM cut JOIN near{i} AS near ON cut.p = near.p AND cut.n = near.n)
            GROUP BY p, e, k)
          GROUP BY p, e),
        book{i + 1} AS MATERIALIZED (
          SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} AS b LEFT JOIN mean{i} AS m ON b.p = m.p AND b.e = m.e)"""
            )
    return f"""
        WITH {", ".join(steps)},
        coded AS (
          SELECT n, string_agg(format('{{:02x}}', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error
          FROM near{rounds} GROUP BY n),
        told AS (
          SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, k)) AS digest
          FROM (SELECT p, e, unnest(c) AS c, unnest(range(len(c))) AS k FROM book{rounds}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
        FROM kept JOIN coded USING (n), told
    """


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 of every different word and pair is worked out byte by byte from a table of 256 entries, made by its rule.
OP13_SQL = r"""
    WITH RECURSIVE bits(b, c, n) AS (
      SELECT b, b, 0 FROM (SELECT unnest(range(256)) AS b)
      UNION ALL
      SELECT b, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
    crc AS (SELECT list(c ORDER BY b) AS steps FROM bits WHERE n = 8),
    texts AS (
      SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
      UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
    read AS MATERIALIZED (
      SELECT side, row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM texts),
    features AS MATERIALIZED (
      SELECT side, row, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM read),
    different AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
    hashed AS MATERIALIZED (
      SELECT f, xor(4294967295, list_reduce(
          [4294967295] || [('0x' || substr(h, i, 2))::BIGINT FOR i IN range(1, len(h), 2)],
          lambda c, x: xor(c >> 8, steps[xor(c & 255, x) + 1]))) % 10000 AS bucket
      FROM different, crc),
    counted AS (
      SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t
      FROM features JOIN hashed USING (f) GROUP BY bucket),
    gained AS (
      SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
      FROM counted),
    weights AS (
      SELECT row, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
      FROM features JOIN hashed USING (f) JOIN gained USING (bucket) WHERE side = 'd' GROUP BY row),
    scored AS (
      SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
          / 4294967296)))::BIGINT AS score, len(w) >= 20 AS able
      FROM read LEFT JOIN weights USING (row) WHERE side = 'd'),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (WHERE able) OVER () AS n
      FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_mixing, op3_decontamination, op4_language, op5_kneserney, op6_licences, op7_urlrules, op8_simhash, op9_topk, op10_secrets, op11_linededup, op12_vectorcodes, op13_importance)}


def oracle_sql() -> dict[str, str]:
    return {"op7_urlrules": OP7_SQL, "op9_topk": OP9_SQL, "op11_linededup": OP11_SQL, "op12_vectorcodes": op12_sql(), "op13_importance": OP13_SQL}

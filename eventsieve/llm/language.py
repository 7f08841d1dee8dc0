"""Language identification by nearest centroid.

A text becomes a vector of its letter trigrams (over UTF-8 bytes, hashed),
weighted by log(1 + count) and inverse document frequency, of length 1. Each
language has several centroids, found by spherical k-means among its sample
rows. A text takes the language of the centroid with the greatest cosine, and
is rejected if even that one is farther away than texts of its length are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventsieve.llm.text import bounded, slices
from eventsieve.plans.tables import materialize

UNKNOWN = "und"
DIMENSIONS = 1 << 13
CENTROIDS = 4
#: Rows of each language that the centroids are fitted on: those with the least hash of their id.
SAMPLE = 1000
#: Languages at most, those with the most rows: the model then has 32 MB at most, whatever stands in the column.
LANGUAGES = 256
#: Ids of the sample that may be broadcast: some 10 MB. More are joined by a shuffle.
BROADCAST_IDS = 200_000
#: A text is rejected if its cosine is below this share of what its number of different trigrams lets expect.
REJECT_SHARE = 0.15
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_BLOCK = 1 << 21


def trigram_counts(text: bytes | None) -> np.ndarray:
    """How often each hashed trigram occurs in the lower-cased letters of the whole text."""
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    formed = (text or b"").decode("utf-8", "replace").lower().encode().translate(_LETTERS)
    formed = b" " + b" ".join(formed.split()) + b" "
    raw = np.frombuffer(formed, dtype=np.uint8)
    for at in range(0, max(len(raw) - 2, 0), _BLOCK):
        part = raw[at : at + _BLOCK + 2].astype(np.uint32)
        grams = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
        slots = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
        counts += np.bincount(slots, minlength=DIMENSIONS)
    return counts if len(formed) > 2 else np.zeros(DIMENSIONS, dtype=np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def _clustered(vectors: np.ndarray, most: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun from quantiles of the similarity to the mean, so that no outlier begins a cluster."""
    order = np.argsort(vectors @ vectors.sum(axis=0), kind="stable")
    centres = _unit(np.array([vectors[part].sum(axis=0) for part in np.array_split(order, min(most, len(order)))]))
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = [vectors[own == k].sum(axis=0) if (own == k).any() else c for k, c in enumerate(centres)]
        centres = _unit(np.array(sums))
    return centres


def _expected(grams) -> np.ndarray:
    """How the cosine of a text grows with its number of different trigrams, up to a factor."""
    grams = np.asarray(grams, dtype=np.float64)
    return np.sqrt(grams / (grams + 400.0))


class Model:
    """Centroids with the language and the usual closeness of each."""

    def __init__(self, langs: list[str], idf: np.ndarray, centres: np.ndarray, levels: np.ndarray):
        self.langs, self.idf, self.centres, self.levels = langs, idf, centres, levels

    def __call__(self, text: bytes | None) -> tuple[int, float, bool]:
        """(centroid, cosine, rejected)."""
        counts = trigram_counts(text)
        scores = self.centres @ _unit(np.log1p(counts) * self.idf).astype(np.float32)
        best = int(np.argmax(scores))
        score = float(min(max(scores[best], 0.0), 1.0))
        return best, score, score < REJECT_SHARE * self.levels[best] * float(_expected(np.count_nonzero(counts)))


def fit(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    sample: int = SAMPLE,
    centroids: int = CENTROIDS,
    languages: int = LANGUAGES,
) -> Model | None:
    """Centroids of the languages in docs, from at most `sample` rows of each; None without any row.

    Of more than `languages` values those with the most rows count (ties: the least). Rows without a language or a
    text are passed over, and so are texts without letters; of rows that share language and id one counts. Fitting moves `sample`
    rows a language; the driver receives the centroids only.
    """
    known = bounded(docs).where(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].cast("binary").alias("text")
    )
    # hashes are even, so twice the share leaves enough rows of each language and few to rank
    place = F.shiftrightunsigned(F.xxhash64("id"), 1) / float(1 << 63)
    sizes = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    sizes = F.broadcast(sizes.orderBy(F.desc("size"), "lang").limit(languages))
    near = known.select("id", "lang", place.alias("place")).join(sizes, "lang").where(
        F.col("place") * F.col("size") < 2.0 * sample
    ).select("id", "lang", "place").distinct()
    order = Window.partitionBy("lang").orderBy("place", "id")
    picked = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    picked = materialize(picked.select("id", "lang").distinct(), "picked")
    # at most `sample` ids a language: sent to all tasks if few, so that no text is shuffled
    few = F.broadcast(picked) if picked.count() <= BROADCAST_IDS else picked

    def count(batches):
        for batch in batches:
            for first, texts in slices(batch):
                found = [trigram_counts(t) for t in texts]
                places = [np.flatnonzero(c).astype(np.int32) for c in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(first, len(texts)) for c in ("id", "lang", "mark")),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array([c[p] for c, p in zip(found, places)], pa.list_(pa.int64())),
                    ],
                    ["id", "lang", "mark", "places", "counts"],
                )

    kind = known.schema["id"].dataType.simpleString()
    rows = materialize(
        known.join(few, ["id", "lang"], "left_semi")
        .select("id", "lang", F.xxhash64("text").alias("mark"), "text")
        .mapInArrow(count, f"id {kind}, lang string, mark long, places array<int>, counts array<long>")
        .where("size(places) > 0")
        .groupBy("lang", "id")
        .agg(F.min_by(F.struct("places", "counts"), "mark").alias("first"))
        .select("lang", "id", "first.places", "first.counts"),
        "trigrams",
    )
    size = rows.count()
    if not size:
        return None
    idf = np.full(DIMENSIONS, np.log(size + 1) + 1)
    for row in rows.select(F.explode("places").alias("place")).groupBy("place").count().collect():
        idf[row["place"]] = np.log((size + 1) / (row["count"] + 1)) + 1

    def cluster(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # the order in which rows arrive may differ between runs
        group = group.sort_values("id", key=lambda ids: ids.astype(str)).reset_index(drop=True)
        vectors = np.zeros((len(group), DIMENSIONS), dtype=np.float32)
        for i, (places, counts) in enumerate(zip(group["places"], group["counts"])):
            vectors[i, places] = np.log1p(counts) * idf[places]
        vectors = _unit(vectors)
        centres = _clustered(vectors, centroids)
        best = (vectors @ centres.T).max(axis=1)
        level = np.median(best / _expected([len(c) for c in group["counts"]]))
        return pd.DataFrame({"lang": key[0], "level": float(level), "centre": list(centres.astype(np.float32))})

    found = rows.groupBy("lang").applyInPandas(cluster, "lang string, level double, centre array<float>")
    found = sorted(found.collect(), key=lambda r: (r["lang"], r["centre"]))
    return Model(
        [r["lang"] for r in found],
        idf,
        np.array([r["centre"] for r in found], dtype=np.float32),
        np.array([r["level"] for r in found]),
    )


def predicted(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, mark, lang_pred, score, rejected) of every row of docs.

    lang_pred is a language of the model, or "und" for a text that is null or
    holds no letter, or if the model is None; score is the cosine of the nearest
    centroid, 0 to 1, and 0 for "und". rejected is true for "und" and for texts that
    are too far from every centroid. mark is a hash of the text. Whole texts
    count, whatever their length; rows come out as often as they go in; an empty
    table gives an empty result; further columns are ignored.
    """
    source = bounded(docs).select(
        docs[id_col].alias("id"),
        F.xxhash64(docs[text_col]).alias("mark"),
        F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        docs[text_col].cast("binary").alias("text"),
    )
    parts = model and (model.langs, model.idf, model.centres, model.levels)
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        judge = sent.value and Model(*sent.value)
        for batch in batches:
            letters = batch.column("letters").to_pylist()
            langs, scores, rejected = [], [], []
            for first, texts in slices(batch):
                for i, text in enumerate(texts, first):
                    if judge is None or not letters[i]:
                        found = (UNKNOWN, 0.0, True)
                    else:
                        best, score, far = judge(text)
                        found = (judge.langs[best], score, far)
                    for column, value in zip((langs, scores, rejected), found):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["id", "mark", "lang_pred", "score", "rejected"],
            )

    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(run, f"id {kind}, mark long, lang_pred string, score double, rejected boolean")
    return found.withColumnRenamed("id", id_col)


def without_rejected(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text the model does not reject, with their columns; see predicted().

    Texts that are null, empty or without a letter go, and without a model all. Repeated rows stay as often as they are there;
    an empty table gives an empty result; columns may have any name.
    """
    schema, flag = docs.schema, "letters"
    while flag in docs.columns:
        flag += "_"
    parts = model and (model.langs, model.idf, model.centres, model.levels)
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        judge = sent.value and Model(*sent.value)
        for batch in batches:
            letters, texts = batch.column(flag).to_pylist(), batch.column(text_col).cast(pa.binary())
            kept = [
                bool(judge is not None and has and not judge(text.as_py())[2]) for has, text in zip(letters, texts)
            ]
            yield batch.drop_columns([flag]).filter(pa.array(kept, pa.bool_()))

    marked = bounded(docs).withColumn(flag, F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, schema)

"""A corpus pipeline: each stage reads what the one before it wrote.

language drops documents that language ID rejects; near_duplicates keeps one of
each SimHash group; decontamination drops documents that hold benchmark text;
secrets redacts what the scan finds; mixing emits documents as often as
source weights ask (column copy numbers the emissions of a document).

In every stage an empty table gives an empty one, columns may have any name, and texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventsieve.llm import contamination, language, mixing, secretscan, simhash
from eventsieve.plans.tables import materialize, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language ID rejects: texts that are null, empty or without a letter, and texts far from all centroids.

    Without any row that names a language all rows go. Rows of equal text stay or go together; a null id or source changes nothing.
    """
    return language.without_rejected(docs, language.fit(docs, "doc_id", "text", "lang"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each group of linked fingerprints (rows without an id last).

    Of rows that repeat id and text one stays. Null and empty texts are one group.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts stay; without items all rows stay."""
    return contamination.without_tests(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows. All rows stay, null and empty texts as they are."""
    return secretscan.redacted(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each row as often as its source's target asks; copy numbers the emissions from 1.

    Null is a source of its own. Rows of equal id, text and source are emitted together as one; ties in size are ordered by id.
    """
    return mixing.emitted(docs)


STAGES = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", redact),
    ("mixing", mix),
]

#: Language ID and sampling are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

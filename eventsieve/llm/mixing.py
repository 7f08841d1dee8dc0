"""Mixing sources to target weights by systematic sampling.

Within its source the documents stand in order of size, the longest first. What a
document is expected to give is an even share: the words still to take for each word still to
come. These expected copies are summed up along the order, one random offset is added, and a
document is emitted once for each integer that its step crosses. As long
documents come first, what their whole copies take too much or too little is shared out
over all that follow, so the words taken stay near the target in sources of a few dozen documents,
too. Only the documents that hold more than 1 / LONG of their source's words can be that
uneven; they are fewer than LONG, and their steps are worked out one by one. All others of a source
have the same step.

The sum along the order runs without gathering a source in one task: rows are
dealt by ranges of (source, size, id), counted by range and source, and a row's place is
its range's offset plus its place within the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventsieve.llm.text import WORD
from eventsieve.plans.tables import materialize

MOST_COPIES = 3.0
#: Offsets are multiples of 1 / GRAINS, a power of two, so that whole steps stay whole.
GRAINS = 1 << 20
#: Documents with more than 1 / LONG of their source's words are sampled one by one.
LONG = 64


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, from 0, in code point order with null last.

    Sources are dealt by range, so that each range counts its own and only the
    count of each range is summed over ranges.
    """
    dealt = materialize(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn(
            "part", F.spark_partition_id()
        ),
        "sources",
    )
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return (
        dealt.withColumn("place", place)
        .join(before, "part")
        .withColumn("rank", F.col("before") + F.col("place") - 1)
        .drop("place", "before", "part")
    )


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size).

    The sources take the weights in turn, in code point order with null last,
    and share the sum of all sizes. A target stops at `most` times its
    source's size; what is over goes to the rest by weight until none is over.
    The level (words per weight) rises with each round; a round is one
    aggregate over the sources and returns one row.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    given = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(
        _ranked(sums)
        .withColumn("weight", given.cast("double"))
        .withColumn("cap", F.lit(most) * F.col("source_size")),
        "targets",
    )
    level, full = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).alias("open"),
            F.count(F.when(over, 1)).alias("full"),
        ).first()
        if row["total"] is None or row["full"] == full or not row["open"]:
            break
        full = row["full"]
        level = max(level, (row["total"] - row["capped"]) / row["open"])
    return ranked.select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"),
    )


def _long_copies(long: DataFrame, most: float, offset) -> DataFrame:
    """(source, copies, steps, rest): the copies of each source's longest documents, the sum of their steps, and the step of all others.

    long has (source, at, size, source_size, target, offset), fewer than LONG rows a source.
    """
    state = F.struct(
        F.lit(0.0).alias("steps"), F.col("target").alias("left"), F.col("source_size").cast("double").alias("words"),
        F.array().cast("array<int>").alias("copies"),
    )
    share = lambda left, words: F.least(F.greatest(left / words, F.lit(0.0)), F.lit(most))

    def take(s, doc):
        steps = s["steps"] + share(s["left"], s["words"])
        copies = (F.floor(steps + offset) - F.floor(s["steps"] + offset)).cast("int")
        return F.struct(
            steps.alias("steps"), (s["left"] - doc["size"] * copies).alias("left"), (s["words"] - doc["size"]).alias("words"),
            F.concat(s["copies"], F.array(copies)).alias("copies"),
        )

    grouped = long.groupBy("source", "source_size", "target").agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("docs"))
    taken = grouped.select("source", "source_size", "target", F.aggregate("docs", state, take).alias("s"))
    rest = F.when(F.col("s.words") > 0, share(F.col("s.left"), F.col("s.words"))).otherwise(share(F.col("target"), F.col("source_size")))
    return taken.select("source", "s.copies", "s.steps", rest.alias("rest"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most: float = MOST_COPIES,
    seed: int = 42,
) -> DataFrame:
    """(id, mark, source, size, source_size, target, taken, copies) of every row of docs.

    size counts the words of the whole text, 0 for null; taken is size times
    copies; mark is a hash of the text. Null sources are one source of their own.
    Ties in size are ordered by id, then by mark. Rows of equal source, id and text are interchangeable, so reruns agree. A source without words has
    target 0 and no copies; an empty table gives an empty result; further
    columns are ignored.
    """
    sized = docs.select(
        docs[id_col].alias("id"),
        F.xxhash64(docs[text_col]).alias("mark"),
        docs[source_col].alias("source"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("id"), F.col("mark")]
    # written first: dealing by range reads its input twice, once to find the bounds
    sized = materialize(sized, "sizes")
    dealt = materialize(
        sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix"
    )
    shares = targets(dealt, weights, most)
    cells = dealt.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("source").orderBy("part")
    cells = cells.select(
        "source", "part", (F.sum("n").over(along) - F.col("n")).alias("before")
    )
    known = cells.join(
        shares.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))
    ).drop("name")
    place = F.row_number().over(Window.partitionBy("part", "source").orderBy(F.col("size").desc(), "id", "mark"))
    placed = dealt.withColumn("place", place).alias("d").join(
        known.alias("k"),
        (F.col("d.part") == F.col("k.part")) & F.col("d.source").eqNullSafe(F.col("k.source")),
    )
    placed = materialize(
        placed.select("d.id", "mark", "d.source", "size", "source_size", "target", (F.col("before") + F.col("place")).alias("at")), "mix"
    )
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(GRAINS)) / F.lit(float(GRAINS))
    long = _long_copies(placed.where(F.col("size") * LONG > F.col("source_size")), most, offset)
    placed = placed.join(long.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")), "left")
    first = F.coalesce(F.size("copies"), F.lit(0))
    even = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda at: F.floor(F.coalesce("steps", F.lit(0.0)) + (at - first) * F.coalesce("rest", even) + offset)
    taken = F.when(F.col("at") <= first, F.get("copies", (F.col("at") - 1).cast("int"))).otherwise(
        (crossed(F.col("at")) - crossed(F.col("at") - 1)).cast("int")
    )
    return placed.select(
        F.col("id").alias(id_col),
        "mark",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * taken).alias("taken"),
        taken.alias("copies"),
    )


def emitted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, numbered from 1 in the column copy.

    If docs has a column copy, the number's name gets underscores until it is free. Null and empty texts have no words and
    are taken like others of their source; a source without words is left out. Rows of equal id, text and source
    are emitted as one row, as often as they are taken together. An empty table gives an empty result.
    """
    number = "copy"
    while number in docs.columns:
        number += "_"
    mixed = mix(docs, id_col, text_col, source_col, **options)
    taken = materialize(
        mixed.groupBy(F.col(id_col).alias("mix_id"), F.col("mark").alias("mix_mark"), F.col("source").alias("mix_source"))
        .agg(F.sum("copies").cast("int").alias("mix_copies"), F.count(F.lit(1)).alias("rows"))
        .where("mix_copies > 0"),
        "taken",
    )
    # repeated rows are emitted together: the second shuffle of texts is for tables that hold some
    rows = docs if taken.where("rows > 1").isEmpty() else docs.dropDuplicates([id_col, text_col, source_col])
    same = (
        rows[id_col].eqNullSafe(taken["mix_id"])
        & (F.xxhash64(rows[text_col]) == taken["mix_mark"])
        & rows[source_col].eqNullSafe(taken["mix_source"])
    )
    return rows.join(taken, same).select(
        *[rows[c] for c in rows.columns], F.explode(F.sequence(F.lit(1), taken["mix_copies"])).alias(number)
    )

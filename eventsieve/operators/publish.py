"""From similar articles to what gets published: clusters, primaries, repeats, issues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventsieve.functions.text import lead
from eventsieve.operators import membership, similarity
from eventsieve.operators.components import connected_components
from eventsieve.operators.spanning import linked_classes
from eventsieve.plans.tables import materialize, together


def cluster(
    prints: DataFrame,
    window_days: int | None = 7,
    threshold: float = similarity.THRESHOLD,
    context: DataFrame | None = None,
) -> DataFrame:
    """(id, component) of every fingerprint; component is the least id of its cluster.

    Clusters are single-link: a chain may span more days than the window. Articles
    without any word stay alone. context only adds to the word counts.
    """
    grouped = materialize(similarity.classes(prints), "classes")
    return _clustered(grouped, similarity.members(prints, grouped), window_days, threshold, context)


def _clustered(
    grouped: DataFrame,
    members: DataFrame,
    window_days: int | None = 7,
    threshold: float = similarity.THRESHOLD,
    context: DataFrame | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """cluster() of classes and their members(); counted are the day_counts() of the context, if it keeps them."""
    reached = linked_classes(grouped, window_days, threshold, context, counted)
    alone = F.when(F.col("own") >= threshold, F.col("class_id")).otherwise(F.col("id"))
    return members.join(reached, F.col("class_id") == F.col("node"), "left").select("id", F.coalesce("component", alone).alias("component"))


def ranked(items: DataFrame, rank: list[Column], pos: str = "pos") -> DataFrame:
    """Adds ord (1 for the primary) within each component: by rank, then by place in the input.

    Items are dealt by ranges of (component, rank, place), so that a crowded component is numbered in parts: an item's number
    is its place within its part and the size of the parts before it.
    """
    columns = items.columns
    dealt = items.repartitionByRange("component", *rank, pos).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ranked")
    cells = dealt.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("component").orderBy("part")
    cells = cells.select("component", "part", (F.sum("n").over(along) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("component", "part").orderBy(*rank, pos))
    return dealt.withColumn("place", place).join(cells, ["component", "part"]).select(*columns, (F.col("before") + F.col("place")).alias("ord"))


def primaries(items: DataFrame, rank: list[Column], pos: str = "pos") -> DataFrame:
    """One row per component: its primary, found as a minimum with map-side combine, not by sorting the group."""
    keys = [F.struct(*rank, F.col(pos))]
    columns = [c for c in items.columns if c != "component"]
    best = items.groupBy("component").agg(F.min_by(F.struct(*columns), keys[0]).alias("best"), F.count(F.lit(1)).alias("size"))
    return best.select("component", "size", "best.*")


def also_reported(items: DataFrame, rank: list[Column], value: str, pos: str = "pos") -> DataFrame:
    """(component, ord, value): all that stands behind the primaries, one row each, numbered from 2."""
    return ranked(items, rank, pos).where("ord > 1").select("component", "ord", value)


def split_repeats(items: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, repeats) of items with (component, id, ord): a component repeats if any member matches.

    ord is anything that orders the members: a number, or a struct of rank columns, which spares sorting the groups.

    fresh keeps the rows of the other components. repeats has (component, primary_id, old_id): the match of the
    first member that has one.
    """
    matched = items.select("component", "id", "ord").join(matches.select("id", "old_id"), "id")
    first = matched.groupBy("component").agg(F.min_by("old_id", "ord").alias("old_id"))
    heads = items.groupBy("component").agg(F.min_by("id", "ord").alias("primary_id"))
    return items.join(first, "component", "left_anti"), heads.join(first, "component")


def published_matches(prints: DataFrame, published: DataFrame, window_days: int = 10) -> DataFrame:
    """(id, old_id, score) of the fingerprints that have been published before; see best_published()."""
    grouped = materialize(similarity.classes(prints), "classes")
    return _matched(grouped, similarity.members(prints, grouped), published, window_days)


def _matched(
    grouped: DataFrame, members: DataFrame, published: DataFrame, window_days: int = 10, counted: DataFrame | None = None
) -> DataFrame:
    """published_matches() of classes and their members(); counted are the day_counts() of published, if it keeps them."""
    best = similarity.best_published(grouped, published, window_days, counted=counted)
    return members.join(best, "class_id").select("id", "old_id", "score")


def _marks(rows: DataFrame, id_col: str, text_col: str, link_col: str | None, late: bool) -> DataFrame:
    """(late, id, mark, h): a hash of the text, and the link, of each row; h is a short hash of the mark."""
    found = [F.sha2(rows[text_col].cast("binary"), 256)]
    if link_col:
        found.append(F.concat(F.lit("link "), rows[link_col]))
    listed = rows.select(F.lit(late).alias("late"), rows[id_col].alias("id"), F.explode(F.array(*found)).alias("mark"))
    return listed.where("mark is not null").withColumn("h", F.xxhash64("mark"))


def history_sketch(history: DataFrame, id_col: str, text_col: str, link_col: str | None = None, marks: int | None = None) -> DataFrame:
    """The membership sketch of all texts, and links, of a history; see exact_repeats().

    marks is the number that it is made for, by default that of the history. A history that grows keeps its sketch:
    membership.merged() adds that of new rows, made with the same number.
    """
    known = (2 if link_col else 1) * history.count() if marks is None else marks
    return membership.sketch(_marks(history, id_col, text_col, link_col, False), membership.bits_for(known))


def exact_repeats(
    items: DataFrame,
    id_col: str,
    text_col: str,
    link_col: str | None = None,
    history: DataFrame | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """(id, first_id) of rows whose text, or link, stood in a row with a smaller id or in the history.

    history has the same columns; its rows come before all others and are not returned. first_id is the first row that holds
    the text or the link. Null texts and links repeat nothing.

    Only marks that are likely repeats are shuffled whole, and only those rows of the history that likely hold one of them: bitmaps,
    broadcast, hold back the others. seen is the history_sketch() of the history where it is kept; without it the history is read once more to
    make it. A sketch must cover the whole history, else repeats are missed.
    """
    each = 2 if link_col else 1
    mine = _marks(items, id_col, text_col, link_col, True)
    old = None if history is None else _marks(history, id_col, text_col, link_col, False)
    size = seen.agg(F.max("size")).first()[0] if seen is not None else None
    bits = size or membership.bits_for(each * (items.count() + (0 if history is None or seen is not None else history.count())))
    twice = mine.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    likely = membership.sketch(twice, bits)
    if seen is not None:
        likely = membership.merged(likely, seen)
    elif old is not None:
        likely = membership.merged(likely, membership.sketch(old, bits))
    known = mine = materialize(membership.likely(mine, materialize(likely, "sketch"), bits), "likely")
    if old is not None:
        wanted = membership.bits_for(mine.count())
        known = mine.union(membership.likely(old, materialize(membership.sketch(mine, wanted), "sketch"), wanted))
    # written, so that the join stands alone and a text that repeats very often can be split
    first = materialize(known.groupBy("mark").agg(F.min(F.struct("late", "id")).alias("first")), "firsts")
    repeats = mine.join(first, "mark").where("not first.late or first.id <> id")
    return repeats.groupBy("id").agg(F.min("first").alias("first")).select("id", F.col("first.id").alias("first_id"))


# -- verdicts of an outside model


def verdict_groups(answer: Column, heads: Column) -> Column:
    """Groups of 0-based head numbers in an answer; empty if it can't be read.

    Reads from the first { to the last }, keeps lists, and in them whole numbers from 1 to heads.
    """
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    lists = F.coalesce(
        F.from_json(body, "groups array<array<string>>")["groups"], F.array().cast("array<array<string>>")
    )
    number = lambda t: F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))
    tidy = lambda g: F.array_sort(
        F.array_distinct(F.transform(F.filter(g, lambda t: number(t).between(1, heads)), lambda t: number(t) - 1))
    )
    return F.transform(F.filter(lists, lambda g: g.isNotNull()), tidy)


def merged_components(heads: DataFrame, head_prints: DataFrame, groups: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(component, merged): components joined where a verdict groups their heads and they share some words.

    heads has (n, component), n from 0 in input order, and head_prints the heads' fingerprints with id = n;
    groups has one column group, an array of n. A pair counts only if it scores the model floor; no date window holds. Without verdicts
    every component keeps its name.
    """
    grouped = materialize(similarity.classes(head_prints), "classes")
    classes_of = similarity.members(head_prints, grouped)
    told = groups.select(F.xxhash64("group").alias("g"), F.explode("group").alias("n")).distinct()
    told = materialize(told.join(classes_of, F.col("n") == F.col("id")).select("g", "n", "class_id"), "told")
    # heads of one class are alike in every word: a chain from the first is enough
    first = told.groupBy("g", "class_id").agg(F.min("n").alias("first"))
    alike = told.join(first, ["g", "class_id"]).where("n <> first")
    worded = grouped.where(F.size("body") > 0).select("class_id")
    alike = alike.join(worded, "class_id", "left_semi").select("n", F.col("first").alias("m"))
    edges = similarity.similar_within(first.select("g", "class_id"), grouped, similarity.MODEL_FLOOR, context)
    end = lambda c, n: first.select("g", F.col("class_id").alias(c), F.col("first").alias(n))
    pairs = edges.join(end("a_id", "n"), ["g", "a_id"]).join(end("b_id", "m"), ["g", "b_id"]).select("n", "m")
    named = heads.select("n", "component")
    ends = alike.union(pairs)
    ends = ends.join(named.withColumnRenamed("component", "u"), "n").join(
        named.select(F.col("n").alias("m"), F.col("component").alias("v")), "m"
    )
    reached = connected_components(ends, "u", "v").withColumnRenamed("component", "least")
    return heads.join(reached, F.col("component") == F.col("node"), "left").select(
        "component", F.coalesce("least", "component").alias("merged")
    )


def prompt_lines(heads: DataFrame, number: str, title: str, extract: str, day: str, *more: str) -> DataFrame:
    """(number, line) and the columns `more`: one numbered line per head, as a labelling batch shows it."""
    stamp = F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("no date"))
    line = F.format_string("%d. [%s] %s :: %s", F.col(number), stamp, F.coalesce(title, F.lit("")), lead(F.col(extract), 40))
    return heads.select(number, *more, line.alias("line"))


def pair_quality(clusters: DataFrame, label: Column) -> DataFrame:
    """(clustered, labelled, both, precision, recall): pairs in one component, of one label, and both.

    Pairs are counted from the sizes of the groups, not listed. Rows without a label are left out.
    """
    cells = clusters.select("component", label.alias("label")).where("label is not null").groupBy("component", "label").agg(
        F.count(F.lit(1)).alias("n")
    )
    count = lambda by: F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias(by)
    sums = [
        (cells.groupBy(*keys).agg(F.sum("n").alias("n")) if keys else cells).agg(count(name))
        for name, keys in (("clustered", ["component"]), ("labelled", ["label"]), ("both", []))
    ]
    # three tables of one row each
    joined = sums[0].withColumn("one", F.lit(1)).join(sums[1].withColumn("one", F.lit(1)), "one").join(sums[2].withColumn("one", F.lit(1)), "one")
    share = lambda of: F.when(F.col(of) > 0, F.col("both") / F.col(of))
    return joined.select("clustered", "labelled", "both", share("clustered").alias("precision"), share("labelled").alias("recall"))


def audit(clusters: DataFrame, label: Column) -> DataFrame:
    """(component, labels, size) of components whose members carry different labels."""
    return (
        clusters.groupBy("component")
        .agg(F.count_distinct(label).alias("labels"), F.count(F.lit(1)).alias("size"))
        .where("labels > 1")
    )


# -- issues


#: So many issues may add to the kept word counts until they are summed up.
COMPACT = 16


def assemble_issue(
    items: DataFrame,
    history: DataFrame | None,
    rank: list[Column],
    look_back_days: int | None = None,
    verdicts: Callable[[DataFrame], DataFrame] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """The primaries that one issue publishes, given fingerprints with pos and rank columns, and those published so far.

    look_back_days keeps history near the issue's first day: that filter is the state's time to live. verdicts, if given, gets
    the first item of each cluster (component, id, pos and fingerprint) and returns groups of their pos in a column group; see
    merged_components(). counted are the day_counts() of history, if they are kept; else its words are counted anew.

    What was published before is looked for item by item, so that search and the clusters don't need each other and run
    at the same time.
    """
    if history is not None and look_back_days is not None:
        since = items.agg(F.date_sub(F.min("day"), look_back_days)).first()[0]
        if since is not None:
            recent = F.col("day").isNull() | (F.col("day") >= F.lit(since))
            history, counted = history.where(recent), counted if counted is None else counted.where(recent)
    print_of = ("title", "body", "nums", "day")
    prints = items.select("id", *print_of)
    grouped = materialize(similarity.classes(prints), "classes")
    members = materialize(similarity.members(prints, grouped), "members")

    def clustered() -> DataFrame:
        found = _clustered(grouped, members, context=history, counted=counted).withColumnRenamed("id", "own")
        joined = materialize(items.join(found, F.col("id") == F.col("own")).drop("own"), "issue")
        if verdicts is None:
            return joined
        heads = joined.groupBy("component").agg(F.min_by(F.struct("id", "pos", *print_of), "pos").alias("head"))
        heads = materialize(heads.select("component", "head.*"), "heads")
        merged = merged_components(
            heads.select(F.col("pos").alias("n"), "component"), heads.select(F.col("pos").alias("id"), *print_of), verdicts(heads), history
        )
        return materialize(joined.join(merged, "component").drop("component").withColumnRenamed("merged", "component"), "merged")

    def matched() -> DataFrame | None:
        return None if history is None else materialize(_matched(grouped, members, history, counted=counted), "matches")

    joined, matches = together(items.sparkSession, clustered, matched)
    fresh = joined
    if matches is not None:
        ordered = joined.withColumn("ord", F.struct(*rank, F.col("pos")))
        fresh = split_repeats(ordered, matches)[0].drop("ord")
    return primaries(fresh, rank).drop("size").select(*joined.columns)


def publish_issues(
    items: DataFrame,
    issue: str,
    rank: list[Column],
    look_back_days: int | None = None,
    verdicts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All published primaries, issue by issue in ascending order.

    Each issue needs what those before it published, so issues run one after the other; the work within one is distributed. The
    history grows as written tables, and so do the counts of its words by day, which each issue adds its own to.
    """
    history = counted = None
    numbers = sorted(items.select(issue).where(F.col(issue).isNotNull()).distinct().collect())
    for done, (number,) in enumerate(numbers, 1):
        now = items.where(F.col(issue) == number)
        out = materialize(assemble_issue(now, history, rank, look_back_days, verdicts, counted), "published")
        history = out if history is None else history.unionByName(out)
        if done < len(numbers):
            more = materialize(similarity.day_counts(out), "counted")
            counted = more if counted is None else counted.unionByName(more)
            if done % COMPACT == 0:
                counted = materialize(counted.groupBy("day", "token").agg(F.sum("df").alias("df")), "counted")
    return history if history is not None else items.limit(0).withColumn("component", F.col("id"))

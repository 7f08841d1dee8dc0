"""Rarity-weighted similarity of short articles, as joins on words.

An article is a fingerprint: words of its title, words of title and lead
together (body), telling numbers, and a day. A word weighs
ln((n + 1) / (df + 1)) + 1. Two articles score the mean of the weighted Dice
overlaps of titles and of bodies, and 0.1 more if they share a number.

Articles with equal fingerprints form a class. Joins run between classes, so a
text that is reprinted a million times costs one row and no pairs of copies.
Within large groups candidates come from an equi-join on words, on each side only those words that
a pair over the threshold cannot avoid sharing: a rare word alone, a frequent one
together with one or two more, so that the pairs grow with the articles and not
with their square. Scores are then computed exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventsieve.functions.lexicon import DEFAULT, Lexicon
from eventsieve.functions.text import anchors, any_date, lead, words
from eventsieve.operators import cells
from eventsieve.plans.tables import materialize, spread, together

THRESHOLD = 0.34
MODEL_FLOOR = 0.12
NUMBER_BONUS = cells.BONUS
LEAD_WORDS = 30
DIGITS = cells.DIGITS
#: A word that more classes hold, or a pair of words that more are expected to hold, is joined on with a further word. Both
#: ways are exact.
FEW, FEW_EXPECTED = 64, 32
#: Classes of a group that are compared each with each.
MEMBERS = 64
#: So few pairs are compared by one task; see cells.py.
FEW_PAIRS = 1 << 23


def fingerprints(
    items: DataFrame,
    id_col: str,
    title: Column,
    extract: Column,
    when: Column,
    lexicon: Lexicon = DEFAULT,
    lead_words: int = LEAD_WORDS,
    nfkc: bool = True,
) -> DataFrame:
    """(id, title, body, nums, day) of every row; word lists are sorted, day may be null."""
    # only the lead of a text travels
    short = items.select(
        items[id_col].alias("id"), title.alias("head"), lead(extract, lead_words).alias("lead"), when.alias("when")
    )
    both = F.concat_ws(" ", F.coalesce("head", F.lit("")), "lead")
    read = spread(short).select(
        "id",
        F.sort_array(words(F.col("head"), lexicon, nfkc)).alias("title"),
        words(F.col("lead"), lexicon, nfkc).alias("rest"),
        F.sort_array(anchors(both, nfkc)).alias("nums"),
        any_date(F.col("when")).alias("day"),
    )
    return read.select("id", "title", F.sort_array(F.array_union("title", "rest")).alias("body"), "nums", "day")


def classes(prints: DataFrame) -> DataFrame:
    """(class_id, title, body, nums, day, size): equal fingerprints as one; class_id is the least id."""
    return prints.groupBy("title", "body", "nums", "day").agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size")
    )


def _tokens() -> Column:
    """The words of body, and a null that stands for the article itself."""
    return F.explode(F.concat(F.array(F.lit(None).cast("string")), "body")).alias("token")


def day_counts(prints: DataFrame) -> DataFrame:
    """(day, token, df): in how many of a day's articles a word stands; the null token counts the articles.

    What a growing history keeps of its words: counts of new articles are added to it, counts of old days left out.
    """
    return prints.select("day", _tokens()).groupBy("day", "token").agg(F.count(F.lit(1)).alias("df"))


def _numbered(tokens: DataFrame) -> tuple[int, DataFrame]:
    """(number of articles, (token, df, held, number)) from rows (token, df, held), written once.

    A number for each word is shorter than the word. All who compare words must read the same written numbers: worked out a second time
    they could differ, as rows arrive in another order.
    """
    sums = tokens.groupBy("token").agg(F.sum("df").alias("df"), F.sum("held").alias("held"))
    stored = materialize(sums.withColumn("number", F.monotonically_increasing_id()), "counts")
    n = stored.where("token is null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return n, stored.where("token is not null")


def weight(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def weighted(grouped: DataFrame, counts: DataFrame, columns: dict[str, Callable[[Column], Column]], least: int = 2) -> DataFrame:
    """Adds es and, for each name w of columns, title_w and body_w: the weights of all words of title and body.

    columns are the weights, as functions of df (0 for a word that was never counted). es lists the words that
    `least` classes or more hold, the others can't be shared: (w, held, code, in_title), w the first of the
    weights, heaviest first. code names the word and its df; as a word's df is the same everywhere, an intersection of
    codes carries its weights. counts are those of corpus().
    """
    df = F.coalesce("df", F.lit(0))
    told = (
        grouped.select("class_id", F.explode("body").alias("token"), "title")
        .join(counts, "token", "left")
        .select(
            "class_id",
            F.array_contains("title", F.col("token")).alias("in_title"),
            F.when(F.col("held") >= least, F.struct(df.alias("df"), "number")).alias("place"),
            "held",
            *[f(df).alias(k) for k, f in columns.items()],
        )
    )
    first = next(iter(columns))
    entry = F.struct(
        "place", F.col(first).alias("w"), "held", F.concat_ws(":", "place.number", "place.df").alias("code"), "in_title"
    )
    sums = [
        F.coalesce(F.sum(F.when(c, F.col(k))), F.lit(0.0)).alias(f"{f}_{k}")
        for f, c in (("title", F.col("in_title")), ("body", F.lit(True)))
        for k in columns
    ]
    listed = told.groupBy("class_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), entry))),
            lambda e: F.struct(*[e[c].alias(c) for c in ("w", "held", "code", "in_title")]),
        ).alias("es"),
        *sums,
    )
    names = [f"{f}_{k}" for f in ("title", "body") for k in columns]
    return grouped.join(listed, "class_id", "left").withColumns(
        {"es": F.coalesce("es", F.array().cast(listed.schema["es"].dataType)), **{c: F.coalesce(c, F.lit(0.0)) for c in names}}
    )


#: Words that a smaller share of the articles hold are heavy ones.
HEAVY_SHARE = 1 / 64
HEAVY = 1 - log(HEAVY_SHARE)
#: What a key row knows of its article; see _combinations().
KEY = "struct<key:long,title:float,body:float,got_t:float,got:float,last:float,bits:long,after:int,after_t:int>"
ENTRY = "struct<w:double,t:double,held:long,code:string,left:double,left_t:double,bits:long,after:int,after_t:int>"
_BIT = "shiftleft(1L, pmod(hash(e.code), 64))"


def _sketch(entries: str) -> str:
    """SQL of struct<top, heavy, n_heavy, light, n_light>: the heaviest weight, bitmaps and numbers of the heavy words and of the others."""
    parts = {"heavy": f"filter({entries}, e -> e.w >= {HEAVY})", "light": f"filter({entries}, e -> e.w < {HEAVY})"}
    both = [f"'{name}', aggregate({es}, 0L, (s, e) -> s | {_BIT}), 'n_{name}', size({es})" for name, es in parts.items()]
    return f"named_struct('top', float(coalesce(get({entries}, 0).w * (1 + 1e-6D), 0D)), {', '.join(both)})"


def _ladder(entries: str) -> str:
    """SQL of array<ENTRY>: each word with the weight from it on, in all and in the title, and bitmap and numbers of the words after it."""
    row = (
        "named_struct('w', e.w, 't', if(e.in_title, e.w, 0D), 'held', e.held, 'code', e.code, 'left', s.left + e.w,"
        " 'left_t', s.left_t + if(e.in_title, e.w, 0D), 'bits', s.bits, 'after', s.after, 'after_t', s.after_t)"
    )
    return f"""aggregate(reverse({entries}),
        named_struct('left', 0D, 'left_t', 0D, 'bits', 0L, 'after', 0, 'after_t', 0, 'out', cast(array() as array<{ENTRY}>)),
        (s, e) -> named_struct('left', s.left + e.w, 'left_t', s.left_t + if(e.in_title, e.w, 0D), 'bits', s.bits | {_BIT},
            'after', s.after + 1, 'after_t', s.after_t + int(e.in_title), 'out', concat(array({row}), s.out)),
        s -> s.out)"""


def _combinations(entries: str, need: str, n: int, kind: str, body_most: str | None = None) -> str:
    """SQL of array<KEY>: hashes of the words, pairs and triples by which an article meets all that share `need` of
    its weight with it; and what bounds the weight that is shared, if these are the first words that are.

    entries are heaviest first. Two articles whose shared words weigh enough for both meet on the first of these words, if
    few classes hold it; else on the first two, if few are to be expected to hold both; else on the first three. Where
    fewer are shared, they meet on all of them. Words are left out that come so late that what follows weighs too little.
    title and body are the most that can be shared; got_t and got the weight of the key's words, last that of its last; after and after_t
    count the words that follow, which weigh no more than last, and bits is a bitmap of them, one hashed bit a word.
    body_most is given for entries that are only those of the title.
    """
    # a little more than the bounds, as floats are rounded
    up = lambda x: f"float(({x}) * (1 + 1e-6D))"

    def made(*chosen: str) -> str:
        *before, last = chosen
        sum_of = lambda name, end: " + ".join([*(f"{e}.{name}" for e in before), f"{last}.{end}"])
        body, got = (sum_of("w", "left"), up(sum_of("w", "w"))) if body_most is None else ("body_most", "float('Infinity')")
        return f"""array(named_struct('key', xxhash64('{kind}', {", ".join(f"{e}.code" for e in chosen)}), 'title', {up(sum_of("t", "left_t"))},
            'body', {up(body)}, 'got_t', {up(sum_of("t", "t"))}, 'got', {got}, 'last', {up(f"{last}.w")},
            'bits', {last}.bits, 'after', {last}.after, 'after_t', {last}.after_t))"""

    alone = lambda got, *chosen: f"if({got} >= need, {made(*chosen)}, cast(array() as array<{KEY}>))"
    every = lambda es, got, e, i, f: f"flatten(transform(filter({es}, {e} -> {got}{e}.left >= need), ({e}, {i}) -> {f}))"
    rest = lambda es, i: f"slice({es}, {i} + 2, greatest(size({es}) - {i} - 1, 0))"
    three = every(rest(rest("rungs", "i"), "j"), "x.w + y.w + ", "z", "k", made("x", "y", "z"))
    pairs = f"if(x.held * y.held <= {FEW_EXPECTED * n}L, {made('x', 'y')}, concat({alone('x.w + y.w', 'x', 'y')}, {three}))"
    two = every(rest("rungs", "i"), "x.w + ", "y", "j", pairs)
    one = every("rungs", "", "x", "i", f"if(x.held <= {FEW}, {made('x')}, concat({alone('x.w', 'x')}, {two}))")
    # sums and need are looked up many times: each bound once by a transform over one element. No name may be that of a column that
    # an argument reads
    bound = f"flatten(transform(array({_ladder(entries)}), rungs -> flatten(transform(array({need}), need -> {one}))))"
    return bound if body_most is None else f"flatten(transform(array({body_most}), body_most -> {bound}))"


#: What of a key row bounds what a pair can share.
SKETCH = ("top", "heavy", "n_heavy", "light", "n_light")
BOUNDS = ("title_w", "body_w", "title", "body", "got_t", "got", "last", "bits", "after", "after_t", *SKETCH)


def keys(sets: DataFrame, threshold: float, n: int) -> DataFrame:
    """(class_id, day, least, key) and the columns BOUNDS: what to join on; see _combinations().

    A score of at least `threshold` needs a Dice of at least that for titles or for bodies, or 0.1 less if a
    number is shared, which then is part of the key. A Dice of t needs a shared weight of t / (2 - t) of the own one. least is
    what both Dice must sum up to.
    """
    if threshold <= NUMBER_BONUS:
        raise ValueError("a threshold of 0.1 or less would pair articles that share no word")

    def of(t: float) -> str:
        share = t / (2 - t) - 1e-9
        titles = _combinations("filter(es, e -> e.in_title)", f"title_w * {share}D", n, "title", "aggregate(es, 0D, (s, e) -> s + e.w)")
        return f"concat({titles}, {_combinations('es', f'body_w * {share}D', n, 'body')})"

    least = lambda t: f"float({2 * t - 1e-9}D)"
    low = threshold - NUMBER_BONUS
    plain = f"transform({of(threshold)}, k -> named_struct('over', k.key, 'least', {least(threshold)}, 'k', k))"
    numbered = f"""if(size(nums) > 0, flatten(transform(array({of(low)}), ks ->
        flatten(transform(nums, x -> transform(ks, k -> named_struct('over', xxhash64(x, k.key), 'least', {least(low)}, 'k', k)))))),
        cast(array() as array<struct<over:long,least:float,k:{KEY}>>))"""
    weights = [F.expr(f"float(greatest({c}, 1e-6D)) AS {c}") for c in ("title_w", "body_w")]
    rows = sets.select("class_id", "day", *weights, F.expr(f"{_sketch('es')} AS sketch"), F.expr(f"explode(concat({plain}, {numbered})) AS at"))
    bounds = [F.col(f"at.k.{c}").alias(c) for c in BOUNDS if c not in ("title_w", "body_w", *SKETCH)]
    of_titles = [F.expr(f"if(at.k.got = float('Infinity'), sketch.{c}, null) AS {c}") for c in SKETCH]
    # written once: they are read several times
    return materialize(rows.select("class_id", "day", "title_w", "body_w", "at.least", F.col("at.over").alias("key"), *bounds, *of_titles), "keys")


def most(a: str, b: str) -> str:
    """SQL of what both Dice of two key rows, whose columns begin with a and b, can sum up to.

    A bit that only one of two bitmaps has set stands for a word that isn't shared. Of the words after a key's own, which weigh
    `last` at most, that leaves k. Keys of titles say nothing of the other words: what bodies share is bounded by the bitmaps of
    heavy and light words, which weigh no more than `top` and HEAVY.
    """
    shared = lambda bits, count: f"least({a}{count} - bit_count({a}{bits} & ~{b}{bits}), {b}{count} - bit_count({b}{bits} & ~{a}{bits}))"
    low = lambda c: f"least({a}{c}, {b}{c})"
    k, last = shared("bits", "after"), f"greatest({a}last, {b}last)"
    # null for keys of bodies, which least() skips
    by_class = f"{shared('heavy', 'n_heavy')} * {low('top')} + {shared('light', 'n_light')} * float({HEAVY * (1 + 1e-6)})"
    title = f"least({a}title, {b}title, {low('got_t')} + least({k}, {a}after_t, {b}after_t) * {last})"
    body = f"least({a}body, {b}body, {low('got')} + {k} * {last}, {by_class})"
    # summed up in floats: a little more again
    return f"2 * (1 + 1e-5D) * ({title} / ({a}title_w + {b}title_w) + {body} / ({a}body_w + {b}body_w))"


def reach(a: str, b: str, least: str) -> Column:
    """Whether two key rows can reach what both Dice must sum up to."""
    return F.expr(f"{most(a, b)} >= {least}")


def near(
    a: DataFrame, b: DataFrame | None, window_days: int | None, by: tuple[str, ...] = (), threshold: float | None = None
) -> DataFrame:
    """Distinct (a_id, b_id) that share a key and whose days, where both are known, lie within the window.

    Pairs that can't reach their least sum by what they share at most are left out. Without b the pairs of a, a_id < b_id.
    `by` names further columns that must be equal. With a threshold, that of the keys, a column most is added: what the pair can score at most.
    """
    on = ["key", *by]
    own = b is None
    side = lambda df, p: df.select(F.col("class_id").alias(f"{p}_id"), F.col("day").alias(f"{p}_day"), *[F.col(c).alias(f"{p}_{c}") for c in BOUNDS], *on, *(["least"] if p == "a" else []))
    a, b = side(a, "a"), side(a if own else b, "b")
    reached = reach("a_", "b_", "least")
    least = F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")
    ids = least if own else (F.col("a_id"), F.col("b_id"))
    # keys with a number ask for less by the bonus, which the number then adds
    scores = [] if threshold is None else [F.expr(f"({most('a_', 'b_')} + {2 * threshold}D - least) / 2 AS most")]

    def different(pairs: list[DataFrame]) -> DataFrame:
        found = reduce(DataFrame.union, [x.where(reached).select(*ids, *scores) for x in pairs])
        return found.groupBy("a_id", "b_id").agg(F.max("most").alias("most")) if scores else found.distinct()

    if window_days is None:
        return different([a.join(b, on).where("a_id < b_id" if own else "true")])
    bucket = lambda c: F.floor(F.unix_date(c) / (window_days + 1)).cast("int")
    a_dated, b_dated = a.where("a_day is not null"), b.where("b_day is not null")
    # a row stays in its own stretch of days; the other side shows up in those around it, too
    home = a_dated.withColumn("bucket", bucket("a_day"))
    steps = (0, 1) if own else (-1, 0, 1)
    seen = b_dated.select("*", F.explode(F.array(*[F.lit(i) for i in steps])).alias("step"))
    seen = seen.withColumn("bucket", bucket("b_day") + F.col("step"))
    once = F.expr("step <> 0 or a_id < b_id") if own else F.lit(True)
    found = [home.join(seen, [*on, "bucket"]).where((F.abs(F.datediff("a_day", "b_day")) <= window_days) & once)]
    dayless = a.where("a_day is null")
    found.append(dayless.join(b, on).where("b_day is not null or a_id < b_id" if own else "true"))
    if not own:
        found.append(a_dated.join(b.where("b_day is null"), on))
    return different(found)


def _shared(codes: Column, weight_of: Callable[[Column], Column]) -> Column:
    """The weight of all words of an intersection of codes."""
    df = lambda e: F.split_part(e, F.lit(":"), F.lit(2)).cast("long")
    return F.aggregate(codes, F.lit(0.0), lambda s, e: s + weight_of(df(e)))


def _codes(in_title: bool) -> Column:
    es = F.filter("es", lambda e: e["in_title"]) if in_title else F.col("es")
    return F.transform(es, lambda e: e["code"])


def _bonus(a_nums: Column, b_nums: Column) -> Column:
    return F.when(F.coalesce(F.arrays_overlap(a_nums, b_nums), F.lit(False)), NUMBER_BONUS).otherwise(0.0)


def own_score(title: Column, body: Column, nums: Column) -> Column:
    """What two articles of one class score."""
    some = lambda c, x: F.when(F.size(c) > 0, x).otherwise(0.0)
    return some(title, 0.5) + some(body, 0.5) + some(nums, NUMBER_BONUS)


def corpus(grouped: DataFrame, context: DataFrame | None = None, counted: DataFrame | None = None) -> tuple[int, DataFrame]:
    """(number of articles, (token, df, held, number)) of the classes, and of the context's fingerprints, which only count.

    df counts articles, held classes. counted, if given, are the day_counts() of the context, which then isn't read.
    """
    tokens = grouped.select(_tokens(), F.col("size").alias("df"), F.lit(1).alias("held"))
    if counted is None and context is not None:
        counted = context.select(_tokens(), F.lit(1).cast("long").alias("df"))
    if counted is not None:
        tokens = tokens.unionByName(counted.select("token", "df", F.lit(0).alias("held")))
    return _numbered(tokens)


def weighted_classes(
    grouped: DataFrame, context: DataFrame | None = None, counted: DataFrame | None = None
) -> tuple[int, DataFrame]:
    """(number of articles, classes with their weights), written once; see corpus()."""
    n, counts = corpus(grouped, context, counted)
    return n, materialize(weighted(grouped, counts, {"w": lambda df: weight(F.lit(n), df)}), "weighted")


def scored(pairs: DataFrame, sets: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a_id, b_id, score) of the pairs (a_id, b_id) of classes that score the threshold or more."""
    side = lambda p: _told(sets).select(*[F.col(c).alias(f"{p}_{c}") for c in TOLD])
    return _scored(pairs.join(side("a"), "a_id").join(side("b"), "b_id"), n, threshold)


#: What of a class its scores are made of.
TOLD = ("id", "nums", "title_w", "body_w", "title", "body")


def _told(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("class_id").alias("id"), "nums", "title_w", "body_w", _codes(True).alias("title"), _codes(False).alias("body"))


def _scored(sides: DataFrame, n: int, threshold: float, *more: str) -> DataFrame:
    """(a_id, b_id, score) and the columns `more` of rows with both classes' TOLD, as a_ and b_, that score the threshold or more."""

    def dice(f: str) -> Column:
        a, b = F.col(f"a_{f}_w"), F.col(f"b_{f}_w")
        shared = _shared(F.array_intersect(f"a_{f}", f"b_{f}"), lambda df: weight(F.lit(n), df))
        return F.when((a == 0) | (b == 0), 0.0).otherwise(2 * shared / (a + b))

    score = (dice("title") + dice("body")) / 2 + _bonus(F.col("a_nums"), F.col("b_nums"))
    return sides.select(*more, "a_id", "b_id", F.round(score, DIGITS).alias("score")).where(F.col("score") >= threshold)


def similar_classes(
    grouped: DataFrame,
    window_days: int | None = 7,
    threshold: float = THRESHOLD,
    context: DataFrame | None = None,
) -> DataFrame:
    """(a_id, b_id, score), a_id < b_id: classes that score the threshold or more within the window.

    The days of a pair may differ by window_days at most if both are known; None sets no window. Articles are compared in blocks; see cells.py.
    """
    if threshold <= NUMBER_BONUS:
        raise ValueError("a threshold of 0.1 or less would pair articles that share no word")
    n, counts = corpus(grouped, context)
    rows = cells.packed(grouped, counts, {"w": lambda df: weight(F.lit(n), df)}, 2)
    return cells.pairs(rows, n, window_days, threshold, FEW_PAIRS)


def similar_within(told: DataFrame, grouped: DataFrame, threshold: float, context: DataFrame | None = None) -> DataFrame:
    """(g, a_id, b_id, score) of the classes of each group of told (g, class_id) that score the threshold or more.

    Pairs are looked for within the groups only, whatever the days: in groups of up to MEMBERS classes each with each, which takes no
    rows for keys; in larger ones by shared words.
    """
    n, sets = weighted_classes(grouped, context)
    told = materialize(told.select("g", "class_id").distinct(), "told")
    large = told.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEMBERS).select("g")
    one = _told(sets).select(F.col("id").alias("class_id"), F.struct(*TOLD).alias("one"))
    lists = told.join(large, "g", "left_anti").join(one, "class_id").groupBy("g").agg(F.collect_list("one").alias("all"))
    pairs = lists.select("g", "all", F.explode("all").alias("a")).select(
        "g", "a", F.explode(F.filter("all", lambda b: b["id"] > F.col("a.id"))).alias("b")
    )
    small = _scored(pairs.select("g", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in TOLD]), n, threshold, "g")
    if large.isEmpty():
        return small
    told = told.join(large, "g", "left_semi")
    held = keys(sets.join(told.select("class_id").distinct(), "class_id", "left_semi"), threshold, n)
    found = scored(near(held.join(told, "class_id"), None, None, ("g",)), sets, n, threshold)
    first, second = (told.select("g", F.col("class_id").alias(f"{p}_id")) for p in "ab")
    return small.union(found.join(first, "a_id").join(second, ["g", "b_id"]).select("g", "a_id", "b_id", "score"))


def members(prints: DataFrame, grouped: DataFrame) -> DataFrame:
    """(id, class_id, own) of every fingerprint; own is what two articles of the class score."""
    same = [prints[c].eqNullSafe(grouped[c]) for c in ("title", "body", "nums", "day")]
    return prints.join(grouped, same[0] & same[1] & same[2] & same[3]).select(
        "id", "class_id", own_score(prints["title"], prints["body"], prints["nums"]).alias("own")
    )


def best_published(
    grouped: DataFrame,
    published: DataFrame,
    window_days: int = 10,
    threshold: float = THRESHOLD,
    counted: DataFrame | None = None,
) -> DataFrame:
    """(class_id, old_id, score): for each class the best match among what was published before.

    published holds fingerprints with a column pos, their place in the list. Only
    matches of the threshold or more within the window count; of equal scores the later in the list wins.
    Words weigh by the published articles and the one article itself, so a
    word's weight depends on whether that article has it: w_in for its own words,
    w_out for the others. Sums of w_out are corrected by the shared words. counted, if given, are the day_counts() of
    published, so that its words aren't counted anew.
    """
    old = materialize(
        published.groupBy("title", "body", "nums", "day").agg(
            F.max_by("id", "pos").alias("class_id"), F.max("pos").alias("pos"), F.count(F.lit(1)).alias("size")
        ),
        "published",
    )
    # an upper bound of the classes that hold a word serves as well: both sides cut by the same number
    n, counts = corpus(old) if counted is None else _numbered(counted.select("token", "df", F.col("df").alias("held")))
    w_in, w_out = (lambda df: F.log(F.lit(n + 2) / (df + 2)) + 1), (lambda df: F.log(F.lit(n + 2) / (df + 1)) + 1)
    both = {"w": w_in, "o": w_out}

    side = lambda rows, *more: lambda: cells.packed(rows, counts, both, 1, *more)
    mine, theirs = together(grouped.sparkSession, side(grouped), side(old, "pos"))
    # an old article weighs at least its w_in, so bounds hold for its side too
    return cells.best(mine, theirs, n, window_days, threshold, FEW_PAIRS)

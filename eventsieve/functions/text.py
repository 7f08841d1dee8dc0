"""Text normalisation, words and numbers as Column functions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eventsieve.functions.lexicon import DEFAULT, NUMBER, TOKEN, Lexicon

QUOTES, PLAIN_QUOTES = "’‘“”", "''\"\""


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def fold(text: Column, nfkc: bool = True) -> Column:
    """NFKC, lower case, straight quotes; null becomes empty.

    NFKC is the one step without a built-in: only texts that are not ASCII are sent to Python for it. nfkc=False leaves it
    out, which keeps the whole expression in the JVM where inputs are known to be in that form.
    """
    text = F.coalesce(text, F.lit(""))
    if nfkc:
        text = F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    return F.translate(F.lower(text), QUOTES, PLAIN_QUOTES)


def _alternatives(pattern: str) -> list[str]:
    """The parts between the bars that lie in no group and no class."""
    parts, depth = [""], 0
    for token in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.S):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += token
    return parts


def _openings(pattern: str) -> list[str]:
    """Plain text that each alternative of a pattern begins with, so that a text without any of them has no match; empty if unknown."""
    found = []
    for part in _alternatives(pattern):
        opening = re.match(r"(?:\\b)?([a-z0-9 ]*)([?*{]?)", part)
        plain = opening[1][:-1] if opening[2] else opening[1]
        if not plain:
            return []
        found.append(plain)
    return found


def _at_bounds(pattern: str) -> str:
    r"""One boundary test for all alternatives instead of one for each, if every one begins and ends with \b."""
    parts = _alternatives(pattern)
    if not all(len(p) >= 4 and p.startswith(r"\b") and re.fullmatch(r"(?:\\.|[^\\])*\\b", p, re.S) for p in parts):
        return pattern
    return rf"\b(?:{'|'.join(p[2:-2] for p in parts)})\b"


def with_phrases(folded: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The lexicon's rewrites, one after the other, each over the whole text.

    Plain text is replaced as such, and a pattern is only run over texts that hold what one of its alternatives begins with.
    """

    def rewritten(pattern: str, replacement: str):
        if re.fullmatch(r"[\w ]+", pattern) and not re.search(r"[$\\]", replacement):
            return lambda t: F.replace(t, F.lit(pattern), F.lit(replacement))
        openings = _openings(pattern)
        pattern = _at_bounds(pattern)
        wide = "(?U)" if re.search(r"\\[bsw]", pattern) else ""
        replaced = lambda t: F.regexp_replace(t, wide + pattern, replacement)
        if not openings:
            return replaced
        held = lambda t: reduce(Column.__or__, [F.contains(t, F.lit(o)) for o in openings])
        return lambda t: F.when(held(t), replaced(t)).otherwise(t)

    # one element, so that each step's text is worked out once
    texts = F.array(folded)
    for pattern, replacement in lexicon.phrases:
        texts = F.transform(texts, rewritten(pattern, replacement))
    return texts[0]


def stem(word: Column, lexicon: Lexicon = DEFAULT) -> Column:
    cut = word
    for suffix, replacement in reversed(lexicon.suffixes):
        shorter = F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(replacement))
        cut = F.when((F.length(word) > len(suffix) + 3) & word.endswith(suffix), shorter).otherwise(cut)
    return cut


def words(text: Column, lexicon: Lexicon = DEFAULT, nfkc: bool = True) -> Column:
    """The distinct stemmed words of a text, in order of first appearance.

    Words have two or more Latin or Cyrillic letters; possessives and stop words go.
    """
    found = F.regexp_extract_all(with_phrases(fold(text, nfkc), lexicon), F.lit(TOKEN), F.lit(0))
    bare = F.transform(found, lambda w: F.btrim(F.replace(w, F.lit("'s"), F.lit("")), F.lit("'")))
    kept = F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(*lexicon.stop_words))
    return F.array_distinct(F.transform(kept, lambda w: stem(w, lexicon)))


def short_number(value: Column, digits: Column | None = None) -> Column:
    """A number with six significant digits and no trailing zeros, as C's %g writes it.

    digits, if given, is the text that value was read from, digits with or without a point between them.

    A seventh digit of exactly 5 rounds up here; C rounds by the binary value, which may lie just below.
    """
    raw = F.format_string("%.5e", value)
    mantissa, power = F.split_part(raw, F.lit("e"), F.lit(1)), F.split_part(raw, F.lit("e"), F.lit(2))
    exponent = power.cast("int")
    bare = lambda c: F.regexp_replace(c, r"(\.\d*?)0+$", "$1")
    tidy = lambda c: F.regexp_replace(bare(c), r"\.$", "")
    plain = tidy(raw.cast("decimal(38,10)").cast("string"))
    long = F.when((exponent >= -4) & (exponent < 6), plain).otherwise(F.concat(tidy(mantissa), F.lit("e"), power))
    if digits is None:
        return long
    # up to six digits stand as they are, which is cheaper than writing the number anew
    point = F.contains(digits, F.lit("."))
    short = F.when(point, F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))).otherwise(digits)
    short = F.ltrim(short, F.lit("0"))
    short = F.when((short == "") | F.startswith(short, F.lit(".")), F.concat(F.lit("0"), short)).otherwise(short)
    few = (F.length(digits) <= F.when(point, 7).otherwise(6)) & ((value >= 1e-4) | (value == 0))
    return F.when(few & (F.octet_length(digits) == F.length(digits)), short).otherwise(long)


def anchors(text: Column, nfkc: bool = True) -> Column:
    """The distinct telling numbers of a text: those with a unit or decimals that are no years."""
    bare = F.replace(fold(text, nfkc), F.lit(","), F.lit(""))
    found = F.regexp_extract_all(bare, F.lit(f"(?iU){NUMBER}"), F.lit(0))

    # the digits are read many times: cut out once
    parted = F.transform(found, lambda m: F.struct(m.alias("match"), F.regexp_extract(m, r"(?U)^(\d+(?:\.\d+)?)", 1).alias("digits")))

    def told(part: Column) -> Column:
        match, digits = part["match"], part["digits"]
        unit = F.substring(match, F.length(digits) + 1, F.length(match))
        number = digits.try_cast("double")
        whole = ~F.contains(digits, F.lit("."))
        dull = (whole & ~unit.rlike(r"(?U)\S")) | (whole & number.between(1900, 2100))
        return F.when(~dull & number.isNotNull(), short_number(number, digits))

    return F.array_distinct(F.filter(F.transform(parted, told), lambda n: n.isNotNull()))


def lead(text: Column, count: int) -> Column:
    """The first words of a text, split at white space and joined by single spaces."""
    # the start is read first, so that long texts are neither split nor copied
    start = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?U)^\s*+(?:\S++\s++){{0,{max(count - 1, 0)}}}+\S*+", 0)
    parts = F.filter(F.split(start, r"(?U)\s+"), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, count), " ")


def any_date(value: Column) -> Column:
    """A date from 2024-01-31, 31.01.2024 or 2024-01-31T10:00:00 with anything after; else null."""
    kind = value.cast("string")
    text = F.regexp_replace(kind, r"(?U)^\s+|\s+$", "")
    cut = F.when(F.contains(text, F.lit("T")), F.left(text, F.lit(19))).otherwise(F.left(text, F.lit(10)))
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"T", "yyyy-M-d'T'H:m:s"))
    read = [F.when(cut.rlike(shape), F.try_to_timestamp(cut, F.lit(form))).cast("date") for shape, form in forms]
    return F.coalesce(*read)


def ends_with_any(value: Column, endings: tuple[str, ...]) -> Column:
    return value.rlike(f"(?:{'|'.join(map(re.escape, endings))})$")

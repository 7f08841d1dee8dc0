"""Secrets found by one combined automaton.

All rules' mirrored regexes form one minimal automaton, which reads each text
once, byte by byte from its end: a state that accepts rule r says that a match
of r starts here. From those starts, taken left to right without overlap for
each rule, a forward automaton of the rule reads the longest match; a match
that fails the rule's exact check is dropped, as is everything inside it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventsieve.llm.automaton import Automaton, compile_rules
from eventsieve.llm.text import bounded, id_and_text, slices


@dataclass(frozen=True)
class Rule:
    """kind; the regex that finds it; what a whole match must be to stay."""

    kind: str
    find: str
    keep: str


BASE_RULES = (
    Rule(
        "assign",
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
        r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{16,}"),
    Rule(
        "jwt",
        r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
        r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    ),
    Rule(
        "url_login",
        r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+-]+@",
        r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+-]+@",
    ),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _dead(automaton: Automaton) -> int:
    """The state that no byte leaves and that accepts nothing."""
    stuck = (automaton.next == np.arange(len(automaton.next))[:, None]).all(axis=1)
    return int(np.argmax(stuck & (automaton.accepts == 0)))


class Scanner:
    """Finds the spans of all rules in a text; made on the driver, sent to tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.back = compile_rules([r.find for r in rules], backwards=True, anywhere=True)
        self.ahead = [compile_rules([r.find]) for r in rules]

    def open(self) -> "Scanner":
        """Lists index faster than arrays in a byte loop."""
        self.rows = self.back.next.tolist()
        self.begin, self.masks = self.back.start, self.back.accepts.tolist()
        self.first = int(np.argmax(self.back.accepts > 0))
        self.fore = [
            (a.kinds, a.next.tolist(), a.start, a.accepts.tolist(), _dead(a)) for a in self.ahead
        ]
        self.checks = [re.compile(r.keep.encode()) for r in self.rules]
        return self

    def __call__(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then rule."""
        rows, state, first, hits = self.rows, self.begin, self.first, []
        for at, kind in enumerate(text[::-1].translate(self.back.kinds), 1):
            state = rows[state][kind]
            if state >= first:
                hits.append((at, state))
        if not hits:
            return []
        found, size = [], len(text)
        hits.reverse()
        for rule, (kinds, table, begin, accepts, dead) in enumerate(self.fore):
            bit, free = 1 << rule, 0
            for at, state in hits:
                start = size - at
                if start < free or not self.masks[state] & bit:
                    continue
                now, end = begin, start
                for i in range(start, size):
                    now = table[now][kinds[text[i]]]
                    if accepts[now]:
                        end = i + 1
                    elif now == dead:
                        break
                free = end
                if self.checks[rule].fullmatch(text, start, end):
                    found.append((start, rule, end))
        return sorted(found)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(id, spans) of every row; spans hold (kind, start, end) in code points, end exclusive.

    Spans are ordered by start, then as the rules are listed. A null or empty text has
    none. Texts are read whole, whatever their length. Rows come out as often
    as they go in, with their ids, null ones too; an empty table gives an
    empty result; further columns are ignored.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def points(text: bytes, found: list) -> list[dict]:
        if not found:
            return []
        seen = np.cumsum(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80)
        before = lambda at: int(seen[at - 1]) if at else 0
        return [{"kind": kinds[r], "start": before(s), "end": before(e)} for s, r, e in found]

    def run(batches):
        scanner.open()
        for batch in batches:
            spans = [
                points(text, scanner(text)) if text else [] for _, texts in slices(batch) for text in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, span_type)], ["id", "spans"])

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, spans {SPAN}").withColumnRenamed("id", id_col)


def redacted(
    docs: DataFrame,
    text_col: str = "text",
    length_col: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    mark: str = "[SECRET]",
) -> DataFrame:
    """All rows and columns of docs, with each run of overlapping spans replaced by mark.

    length_col, if given, is set to the length in code points of a text that changed. Null texts stay null, empty ones empty.
    Rows come out as often as they go in, repeated ones alike; an empty table gives an empty result; columns may have any name.
    """
    scanner = Scanner(rules)

    def cut(text: bytes, found: list) -> bytes:
        out, at = [], 0
        for start, _, end in found:
            if start >= at:
                out += [text[at:start], mark.encode()]
            at = max(at, end)
        return b"".join([*out, text[at:]])

    def run(batches):
        scanner.open()
        for batch in batches:
            names = batch.schema.names
            texts, kind = batch.column(text_col), batch.schema.field(text_col).type
            lengths = batch.column(length_col).to_pylist() if length_col else None
            out = []
            for i, text in enumerate(texts.cast(pa.binary())):
                text = text.as_py()
                found = scanner(text) if text else []
                if found:
                    text = cut(text, found)
                    if lengths:
                        lengths[i] = len(text.decode("utf-8", "replace"))
                out.append(text)
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(out, pa.binary()).cast(kind)
            if lengths:
                at = names.index(length_col)
                columns[at] = pa.array(lengths, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return bounded(docs).mapInArrow(run, docs.schema)


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts of the base kinds, their checksum and all spans as text, for each row of scan()."""
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    kinds = [r.kind for r in base]
    joined = lambda spans: F.array_join(F.transform(spans, named), ",")
    return found.select(
        *[c for c in found.columns if c != "spans"],
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(joined(of(kinds)).cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )

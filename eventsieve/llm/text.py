"""Shared text conventions of these operators.

A word is a maximal run of bytes other than ASCII white space (0x20 and
0x09-0x0D); bytes.split() cuts exactly there. Lower-casing touches A-Z only,
as bytes.lower() does. Texts travel as Arrow binary, so bytes that are not valid UTF-8
never raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch: what a worker holds at once, however long the texts are.
BATCH_BYTES = 4 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """docs, with its session set to send rows to Python in batches of BATCH_BYTES at most.

    The setting must hold when a lazy result runs, so it stays.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns (id, text) whatever else the table holds; text as binary, null kept."""
    return bounded(docs).select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))


def training_rows(id_col: str, folds: int, fold: int):
    """True where crc32 of the id as text leaves another remainder than fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != fold


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """(first row, texts as bytes or None) in runs of about `most` bytes, to bound memory."""
    start, held, size = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        value = value.as_py()
        held.append(value)
        size += len(value or b"")
        if size >= most:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_BLOCK = 1 << 20
#: ASCII punctuation and control bytes become spaces, so that "word," and "WORD!!" meet.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: bytes | None) -> bytes:
    """Lower case (all scripts), with ASCII punctuation as spaces."""
    return (text or b"").decode("utf-8", "replace").lower().encode().translate(_PLAIN)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    known = _powers.known
    if len(known[0]) < size:
        for i, factor in enumerate((_FACTOR, _INVERSE)):
            steps = np.full(max(size, _BLOCK + 1), factor, dtype=np.uint64)
            steps[0] = 1
            known[i] = np.multiply.accumulate(steps)
    return known[0], known[1]


_powers.known = [np.empty(0, dtype=np.uint64)] * 2


def _hashed_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(block, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], raw != 32, [False]]).view(np.int8)))
    begin, end = edges[0::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return begin, scrambled((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def lower_words(text: bytes | None) -> bytes:
    """A-Z lower-cased, white space as spaces."""
    return (text or b"").lower().translate(_SPACES)


def hashed(texts: list, form=plain) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): 64-bit hashes of all words in a row, and where each text's words end.

    form turns a text into bytes whose words are split by spaces. Hashing runs
    in blocks that end at a space, so memory stays near 16 bytes a word however
    long a text is.
    """
    formed = [form(t) for t in texts]
    bounds = np.cumsum([len(t) + 1 for t in formed], dtype=np.int64)
    raw = b" ".join(formed)
    begins, hashes, at = [], [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > _BLOCK:
            end = raw.find(b" ", at + _BLOCK)
            end = len(raw) if end < 0 else end
        begin, found = _hashed_block(raw[at:end])
        begins.append(begin + at)
        hashes.append(found)
        at = end
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), bounds)

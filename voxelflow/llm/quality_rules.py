"""Quality rules: how much of a text lies in repeated n-grams and lines.

Rolling hashes of several n-gram lengths are built in numpy, one length from the one before; a
window whose hash occurs twice in the text marks all its words, and the characters of the marked
words are the coverage of that length.

Defined cases: a null text counts as empty and fails; a text without words fails; repeated rows
and ties get equal results, each row its own; columns beside doc_id and text are not read.
64-bit hashes stand for words and windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, table, text_words

#: n-gram length -> largest share of the text's word characters inside n-grams found twice.
MAX_NGRAM_SHARE = {5: 0.35, 8: 0.30, 10: 0.25}
MAX_LINE_SHARE = 0.30
MAX_SYMBOLS_PER_WORD = 0.3
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_SPACES = " \t\n\x0b\x0c\r"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MEASURES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "dup_line_share": pa.float64(), "dup_ngram_share": pa.float64(),
}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"
_memo = WordHashes()


def covered(hashes: np.ndarray, n: int, words: int) -> np.ndarray | None:
    """Which words lie in a window of ``n`` whose hash occurs twice or more; None if no word does."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return None
    twice = np.zeros(len(hashes) + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    steps = np.zeros(words + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(text: str | None, memo: WordHashes | None = None) -> tuple:
    """The values of SCHEMA for one text."""
    text, memo = text or "", _memo if memo is None else memo
    words = text_words(text)
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    dup_lines = dup_chars = 0
    if len(lines) != len(set(lines)):
        seen: set[str] = set()
        for x in lines:
            if x in seen:
                dup_lines, dup_chars = dup_lines + 1, dup_chars + len(x)
            seen.add(x)
    line_share = dup_chars / max(1, sum(map(len, lines)))
    repeat_words, shares = 0, {}
    if n > min(*MAX_NGRAM_SHARE, WINDOW):
        ids = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
        lengths, rolling = None, ids
        for size in range(2, max(*MAX_NGRAM_SHARE, WINDOW) + 1):
            if size >= n:
                break
            rolling = rolling[:-1] * _MULTIPLIER + (ids[size - 1 :] ^ (ids[size - 1 :] >> np.uint64(29)))
            if size not in MAX_NGRAM_SHARE and size != WINDOW:
                continue
            marked = covered(rolling, size, n)
            if marked is None:  # longer windows can't repeat either
                break
            if size == WINDOW:
                repeat_words = int(marked.sum())
            if size in MAX_NGRAM_SHARE:
                lengths = np.fromiter(map(len, words), np.int64, n) if lengths is None else lengths
                shares[size] = int(lengths[marked].sum()) / word_chars
    failed = n < MIN_WORDS or 100 * repeat_words > 30 * n
    bad = line_share > MAX_LINE_SHARE or symbols > MAX_SYMBOLS_PER_WORD * n or any(v > MAX_NGRAM_SHARE[k] for k, v in shares.items())
    return n, word_chars, symbols, dup_lines, repeat_words, failed, not (failed or bad), line_share, max(shares.values(), default=0.0)


def _measure_array(texts: pa.Array) -> pa.Array:
    rows = [measure(x.as_py()) for x in texts]
    columns = list(zip(*rows, strict=True)) or [()] * len(_MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _MEASURES.values(), strict=True)], names=list(_MEASURES))


def quality(text: str | Column = "text") -> Column:
    """The struct SCHEMA of a text column."""
    return F.arrow_udf(_measure_array, SCHEMA)(text)


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id and SCHEMA."""
    return docs.select("doc_id", quality("text").alias("_m")).select("doc_id", "_m.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is kept, with their own columns."""
    return docs.where(quality("text")["kept"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))

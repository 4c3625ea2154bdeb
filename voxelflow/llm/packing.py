"""Best-fit packing by a configuration linear program over the length histogram.

Only the histogram of piece lengths (as many rows as a sequence has tokens, whatever the corpus)
reaches the driver. The covering program "fewest sequences so that every length is packed as often
as it occurs" is solved by multiplicative weights: lengths have prices, a knapsack over the prices
finds the most valuable sequence around each length, the best of them are taken in whole numbers
(rounded down to the pieces there are), and lengths that a round used up faster grow cheaper in the
next, which solves the program for what is left. The few pieces that fill no sequence well are packed
best-fit decreasing, again on counts. Pieces then look up their places: the r-th piece of a length
has its place in the list of places for that length.

Defined cases: a null or empty text is the closing token alone; the tokenizer's added tokens in a
text are what the tokenizer makes of them; rows that repeat a doc_id are
separate documents; ties between equal lengths go by doc_id and piece; an empty table gives an
empty result; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table

LENGTH = 2048
END_ID = 0
#: How sharply weights answer, and settings of the program in the order they are tried: how much long pieces
#: are favoured, sequences taken in a round, and empty places that a sequence may have in turn.
STEP = 0.1
TRIES = [(0.3, 100, (0, 2, 8)), (0.3, 100, (0, 2)), (1.0, 100, (0, 2)), (0.1, 30, (0, 2)), (3.0, 30, (0, 2)), (0.0, 20, (0, 2)), (0.3, 50, (0, 1)), (0.1, 50, (0, 2, 16))]
CHUNK = 1000
#: Fixed value: how byte-level BPE splits a text before merging.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters are split alike by every version of Unicode.
_LATIN = re.compile("[\n -~¡-ɏ]*")
_loaded: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _merger(path: str):
    """The same vocabulary for tiktoken, which merges a single word several times as fast."""
    import json

    import tiktoken

    # byte-level vocabularies write a byte as a printable character, in this order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = {bytes(byte[c] for c in word): k for word, k in vocabulary.items() if all(c in byte for c in word)}
    ranks = {w: k for w, k in ranks.items() if w != b"<|endoftext|>"}
    return tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids as little-endian 32-bit bytes. Texts of Latin letters go through the faster merger of
    the same vocabulary, others and those that hold added tokens through the tokenizer itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.merger = _merger(path)
        probe = [" probing,", "Überprüfung's\n12", " été!!", "a  b   \n\n c", "I'll, we'd 'S x1234 --- "]
        if [self.merger.encode_ordinary(x) for x in probe] != [self.tokenizer.encode(x, add_special_tokens=False).ids for x in probe]:
            self.merger = None

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, one text after another."""
        for text in texts:
            if self.merger and _LATIN.fullmatch(text) and not self.special.search(text):
                yield array("I", self.merger.encode_ordinary(text)).tobytes()
            else:
                yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones but for the first."""
    first = n % length or length
    starts = [0, *range(first, n, length)]
    return [(s, (first if s == 0 else length)) for s in starts]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """PIECES of every document; row tells rows of one doc_id apart."""
    last = np.array([END_ID], "<u4").tobytes()

    def of(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoder.encode(texts), strict=True):
                ids += last
                for k, (s, n) in enumerate(cut(len(ids) // 4, length)):
                    for column, v in zip(out, (doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), row), strict=True):
                        column.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(of, PIECES)


def best_fill(price: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over the lengths (index of ``price``): for every room up to ``length`` the
    greatest total price, and a length to put first (0: leave one place empty)."""
    worth = np.flatnonzero(price > 0)
    gain, value = price[worth], np.zeros(length + 1)
    choice = np.zeros(length + 1, np.int64)
    fitting = np.searchsorted(worth, np.arange(length + 1), "right")
    for room in range(1, length + 1):
        n = fitting[room]
        if n:
            got = gain[:n] + value[room - worth[:n]]
            k = int(got.argmax())
            value[room], choice[room] = got[k], worth[k]
        if n == 0 or value[room - 1] > value[room]:
            value[room], choice[room] = value[room - 1], 0
    return value, choice


def configuration(first: int, choice: list[int], length: int) -> tuple[tuple[int, int], ...]:
    """The sequence of ``first`` and the best fill of the room beside it, as (length, times)."""
    found, room = {first: 1}, length - first
    while room > 0:
        k = choice[room]
        if k:
            found[k] = found.get(k, 0) + 1
        room -= k or 1
    return tuple(sorted(found.items(), reverse=True))


def rounds_of(left: np.ndarray, length: int, favour: float, batch: int, empty: tuple[int, ...], seed: int) -> list[tuple[dict[int, int], int]]:
    """The configuration program by multiplicative weights, in whole sequences. Each round prices the
    lengths, a knapsack over the prices finds the most valuable sequence around each, and from the
    longest on up to ``batch`` of these sequences are taken as often as pieces last. A price is the
    length's share of a sequence times its weight. Weights begin at 1 + favour * share, so that long
    pieces are placed first and short ones are kept to fill up, and fall by what a round used of the
    length. When no sequence has at most empty[k] places left, the program goes on with
    empty[k + 1]. Takes its pieces from ``left``."""
    share, rng = np.arange(length + 1) / length, np.random.default_rng(seed)
    weight, plan, level = 1 + favour * share, [], 0
    while left.any():
        price = np.where(left > 0, share * weight * (1 - 1e-3 * rng.random(length + 1)), 0.0)
        choice, before, taken = best_fill(price, length)[1].tolist(), left.copy(), 0
        for k in np.flatnonzero(left)[::-1].tolist():
            if taken == batch:
                break
            if left[k]:
                key = [(j, min(m, int(left[j]))) for j, m in configuration(k, choice, length) if left[j]]
                copies = min(int(left[j]) // m for j, m in key)
                if length - sum(j * m for j, m in key) <= empty[level]:
                    plan.append((dict(key), copies))
                    taken += 1
                    for j, m in key:
                        left[j] -= m * copies
        weight *= np.exp(-STEP * (before - left) / np.maximum(before, 1))
        if not taken:
            level += 1
            if level == len(empty):
                break
    return plan


def solve(counts: np.ndarray, length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Configurations {length: times} with whole numbers of sequences that pack ``counts`` exactly.
    counts[k]: pieces of length k."""
    return planned(counts, length)[0]


def planned(counts: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[dict[int, int], int]], int]:
    """``solve``, and how many of its entries come from the program. The program is solved with one
    setting of TRIES after another until the number of sequences is the least there can be, or
    one in 100,000 more; the fewest count. What a setting leaves (pieces that fill no sequence well) is packed best-fit."""
    full = [({length: 1}, int(counts[length]))] if counts[length] else []
    rest = counts.astype(np.int64).copy()
    rest[length] = 0
    bound, best, least = -(-int((rest * np.arange(length + 1)).sum()) // length), None, None
    for seed, (favour, batch, empty) in enumerate(TRIES):
        left = rest.copy()
        program = rounds_of(left, length, favour, batch, empty, seed)
        plan = program + best_fit(left, length)
        n = sum(copies for _, copies in plan)
        if least is None or n < least:
            best, least = (full + plan, len(full) + len(program)), n
        if least <= bound + bound // 100_000:
            break
    return best


def best_fit(counts: np.ndarray, length: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: groups of alike sequences are filled together."""
    groups: list[list] = []  # room, number, configuration
    for size in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[size])
        for g in sorted((g for g in groups if g[0] >= size), key=lambda g: g[0]):
            if not n:
                break
            times = min(g[0] // size, -(-n // g[1]))
            while times and n < g[1] * times and times > 1:
                times -= 1
            number = min(g[1], n // times)
            if number < g[1]:
                groups.append([g[0], g[1] - number, dict(g[2])])
            g[0], g[1], g[2][size] = g[0] - size * times, number, g[2].get(size, 0) + times
            n -= number * times
        each = length // size
        if n >= each:
            groups.append([length - each * size, n // each, {size: each}])
            n %= each
        if n:
            groups.append([length - n * size, 1, {size: n}])
    return [(g[2], g[1]) for g in groups if g[1]]


def places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Runs of places, by length and then first rank: ``key`` (length, rank), how many pieces of
    the length a sequence of the run has, the run's first sequence, the offset of its first piece."""
    runs, ranks, sequence = [], {}, 0
    for configuration, copies in plan:
        offset = 0
        for size, times in sorted(configuration.items(), reverse=True):
            rank = ranks.get(size, 0)
            runs.append((size, rank, times, sequence, offset))
            ranks[size] = rank + times * copies
            offset += size * times
        sequence += copies
    runs.sort()
    names = ("length", "rank", "times", "sequence", "offset")
    return {n: np.array([r[i] for r in runs], np.int64) for i, n in enumerate(names)}


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """PIECES with sequence_id and offset."""
    found = materialize(pieces(docs, tokenizer or default_tokenizer(), length), "pieces")
    per_length = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(length + 1, np.int64)
    for k, n in per_length.items():
        counts[k] = n
    runs = places(solve(counts, length))
    chunks = F.lit(np.maximum(1, -(-counts // CHUNK)).tolist())  # of each length
    found = found.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.get(chunks, F.col("length").cast("int"))))
    starts = found.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    starts = starts.select("length", "chunk", (F.sum("n").over(W.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "chunk").orderBy("doc_id", "row", "piece")) - 1
    ranked = found.withColumn("within", within).join(starts, ["length", "chunk"]).withColumn("rank", F.col("within") + F.col("before")).drop("within", "before", "chunk")
    names = ranked.columns

    def place(batches):
        first = runs["length"] << 40 | runs["rank"]
        for batch in batches:
            size, rank = (batch.column(names.index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            at = np.searchsorted(first, size << 40 | rank, "right") - 1
            r = rank - runs["rank"][at]
            sequence = runs["sequence"][at] + r // runs["times"][at]
            offset = runs["offset"][at] + r % runs["times"][at] * size
            kept = [batch.column(names.index(k)) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

"""Order-preserving packing: dynamic programming over cut places.

Documents stand in the order of doc_id and are cut into windows, one sequence each. A window may end
at the end of a document for nothing, at the end of a sentence for a small penalty, and inside a long
run without sentence ends for a larger one. A window of less than the full length is padded to it
unless its length is a power of two. The program chooses the windows with the least padding plus
penalties, and of those with equal costs the fewest windows:

    f(j) = penalty(j) + min( length - p(j) + min { f(i) + p(i) : p(j) - p(i) <= length },
                             min { f(i) : p(j) - p(i) a power of two } )

The inner minimum slides with j and is the head of a monotone queue, so a cut place costs a constant
number of steps. Sentence ends are found in token ids: a token that ends with a sentence mark before
one that begins with white space, or a token with a line break.

Tokens are made once and written with the documents' order; ranges of documents are sorted and dealt
out, also where one doc_id holds many rows, and a task streams its range in stretches of about
STRETCH tokens of whole documents, each with a program of its own. So memory is bounded by a stretch
and the longest document; the end of a stretch may be cut elsewhere too, so that little is padded there. Where ranges of rows
begin is drawn from a sample by Spark, so windows at their borders may differ between runs; every id
lies in one piece in any case.

Defined cases: a null or empty text is the closing token alone; the tokenizer's added tokens in a
text are what the tokenizer makes of them; rows that repeat a doc_id are separate documents, one
after another; a null doc_id comes first; an empty table gives an empty result; columns beside
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .packing import _encoder, default_tokenizer

LENGTH = 2048
END_ID = 1
#: Penalties in places of padding: after a sentence, elsewhere.
SENTENCE, ELSEWHERE = 4, 48
#: A run of tokens without sentence end longer than GAP may be cut every STEP tokens.
GAP, STEP = 192, 64
STRETCH = 1 << 19
RANGE_BYTES = 16 << 20
#: Costs are whole numbers of this unit, a window costs 1 besides.
_UNIT = 1 << 32
#: Sentence marks, and what may follow them within the sentence.
MARKS, CLOSING = ".!?。！？", "\"')]}»”’"
_tables: dict = {}


def sentence_tables(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By token id: ends with a sentence mark; begins with white space; may be cut after whatever
    follows (a line break, or a mark that no blank follows)."""
    if path not in _tables:
        tokenizer = _encoder(path).tokenizer
        n = tokenizer.get_vocab_size(with_added_tokens=True)
        words = [tokenizer.decode([k], skip_special_tokens=False) for k in range(n)]
        bare = [w.rstrip(CLOSING) for w in words]
        ends = np.array([b[-1:] in MARKS and b != "" for b in bare])
        begins = np.array([w[:1].isspace() for w in words])
        alone = np.array([w.endswith("\n") or (b[-1:] != "" and b[-1:] in MARKS[3:]) for w, b in zip(words, bare, strict=True)])
        _tables[path] = ends, begins, alone
    return _tables[path]


def cut_places(ids: np.ndarray, ends: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may begin or end in the ids of documents that end at ``ends``, with
    their penalties; both ascend from 0 to the last end."""
    stops, begins, alone = tables
    sentence = np.flatnonzero((stops[ids[:-1]] & begins[ids[1:]]) | alone[ids[:-1]]) + 1
    bounds = np.union1d(np.r_[0, ends], sentence)
    wide = np.flatnonzero(np.diff(bounds) > GAP)
    inside = [np.arange(bounds[k] + STEP, bounds[k + 1], STEP) for k in wide.tolist()]
    # the last tokens rarely fill a window: they may be cut into powers of two
    tail = len(ids) - np.arange(1, min(length, len(ids)))
    fee = np.full(len(ids) + 1, -1, np.int64)
    for more in (*inside, tail):
        fee[more] = ELSEWHERE
    fee[sentence] = SENTENCE
    fee[ends], fee[0] = 0, 0
    places = np.flatnonzero(fee >= 0)
    return places, fee[places]


def windows(places: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> tuple[list[int], int]:
    """The cheapest way through ascending ``places`` from the first to the last: indices of the
    places where windows begin and end, and their cost (padding and penalties). Neighbouring places
    stand no farther apart than ``length``."""
    n = len(places)
    to, since = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range((length - 1).bit_length()):  # a full window needs no padding anyway
        at = np.searchsorted(places, places - (1 << k))
        hit = np.flatnonzero(places[at] == places - (1 << k))
        to.append(hit)
        since.append(at[hit])
    to, since = np.concatenate(to), np.concatenate(since)
    order = np.argsort(to, kind="stable")
    to, since, t = [*to[order].tolist(), n], since[order].tolist(), 0
    p, fee = places.tolist(), (penalty.astype(np.int64) * _UNIT + 1).tolist()
    cost, level, back = [0] * n, [0] * n, [0] * n
    level[0], following = p[0] * _UNIT, to[0]
    queue, full = deque([0]), length * _UNIT
    for j in range(1, n):
        here = p[j]
        while p[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        here *= _UNIT
        best = level[i] + full - here
        while following == j:
            k = since[t]
            if cost[k] < best:
                best, i = cost[k], k
            t += 1
            following = to[t]
        cost[j] = best = best + fee[j]
        back[j] = i
        level[j] = high = best + here
        while queue and level[queue[-1]] >= high:
            queue.pop()
        queue.append(j)
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1], cost[-1] // _UNIT


def _tokens(tokenizer: str):
    end = np.array([END_ID], "<u4").tobytes()

    def of(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            found = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
            ids = [x + end for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array([_narrow(x) for x in ids], pa.binary())], names=["doc_id", "row", "ids"])

    return of


def _narrow(ids: bytes) -> bytes:
    """Ids in 2 bytes each where they fit, after a byte that says so."""
    x = np.frombuffer(ids, "<u4")
    return b"\2" + x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\4" + ids


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def stretch_pieces(docs: list[tuple[int | None, np.ndarray]], tables, length: int = LENGTH) -> list[tuple]:
    """Pieces (document, start, length, crc32, tokens of the document, window, offset, ids) of consecutive documents."""
    ends = np.cumsum([len(ids) for _, ids in docs])
    starts = [0, *ends[:-1].tolist()]
    places, fees = cut_places(np.concatenate([ids for _, ids in docs]), ends, tables, length)
    bounds = places[windows(places, fees, length)[0]].tolist()
    out, w = [], 0
    for (doc, ids), start in zip(docs, starts, strict=True):
        done, n = 0, len(ids)
        while done < n:
            while bounds[w + 1] <= start + done:
                w += 1
            m = min(n, bounds[w + 1] - start) - done
            data = ids[done : done + m].tobytes()
            out.append((doc, done, m, zlib.crc32(data), n, w, start + done - bounds[w], data))
            done += m
    return out


def _pack(tokenizer: str, length: int, stretch: int, with_ids: bool):
    def of(batches):
        from pyspark import TaskContext

        tables, first = sentence_tables(tokenizer), TaskContext.get().partitionId() << 40
        docs, held = [], 0

        def flush():
            nonlocal docs, held, first
            columns = list(zip(*stretch_pieces(docs, tables, length), strict=True))
            sequence = np.array(columns[5], np.int64) + first
            first = int(sequence[-1]) + 1
            docs, held = [], 0
            plain = [pa.array(c, pa.int64()) for c in columns[:5]]
            ids = pa.array(columns[7] if with_ids else [None] * len(sequence), pa.binary())
            return pa.RecordBatch.from_arrays([*plain, pa.array(sequence), pa.array(columns[6], pa.int64()), ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _wide(data)
                docs.append((doc, ids))
                held += len(ids)
                if held >= stretch:
                    yield flush()
        if docs:
            yield flush()

    return of


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, stretch: int = STRETCH, ids: bool = True) -> DataFrame:
    """PIECES: where each piece of each document lies, and its ids (little-endian, 4 bytes each)
    unless ``ids`` is false."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = materialize(numbered.mapInArrow(_tokens(tokenizer), "doc_id long, row long, ids binary"), "tokens")
    size = found.agg(F.sum(F.length("ids").cast("long"))).head()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    ordered = found.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    return ordered.select("doc_id", "ids").mapInArrow(_pack(tokenizer, length, stretch, ids), PIECES)


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), ids=False).drop("ids")

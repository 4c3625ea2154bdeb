"""Katz backoff language model (trigrams): Good-Turing discounts, exactly normalised backoff.

    P(w | h2 h1) = d3(c) c(h2 h1 w) / c(h2 h1)   for a triple of LEAST[2] or more occurrences
                 = alpha(h2 h1) P(w | h1)        else; alpha 1 after a pair with no such triple
    P(w | h1)    = d2(c) c(h1 w) / c(h1)         for a pair seen in training
                 = alpha(h1) P(w)                else; alpha 1 after an unseen word
    P(w)         = d1(c) c(w) / N, and what the discounts leave for the unknown word, one type
    alpha(h)     = (1 - sum of P(w | h)) / (1 - sum of P(w | shorter h)), sums over the seen w

Every level sums to 1 over the vocabulary and the unknown word. Triples seen once count as unseen,
as in Katz's paper, and their mass goes to the pairs. Counts up to CUT get Katz's Good-Turing
discounts, larger ones keep all but a thousandth, so every context leaves mass. Where Good-Turing
gives no ratio between 0 and 1 (no key of r or r + 1 occurrences, or rising numbers of them), the
absolute discount (r - D) / r takes its place, D = n1 / (n1 + 2 n2).

Texts become blocks of about BLOCK_TOKENS tokens (a longer text is a block of its own): sorted hashes of
the distinct words and each token's place among them. A block sends each distinct word, pair and
triple once, as packed sorted keys, to the partition of the count tables that owns it (a range of
key hashes); that sums the counts of all blocks and answers each block in the order of its keys. A
frequent key is one key of a block however often it occurs. A block sends at most as many rows as
it has distinct keys, so exchanges grow with the tokens. One block is named owner of each pair and
triple and adds it to the sums behind alpha; a second exchange totals these sums by context and
returns alpha for the contexts after which the block met unseen words. A token's log probability
is the sum of those of its levels, as each level down adds one alpha. Tables are never gathered.

64-bit hashes stand for words. Those of pairs and triples have as many bits, 64 at most, as leave
at most one key in a million that shares its hash (COLLIDING). Defined cases: null and empty texts are the end
token alone; a null doc_id is in training; repeated rows count as often as they occur; without
training documents every word is unknown and has probability 1; an empty table gives an empty
result; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, discard, materialize, table
from .packed import _restore, _squeeze
from .packed import pack as _pack
from .packed import slices as _slices
from .packed import unpack as _unpack

CUT = 5
KEPT = 0.999
#: Fewest occurrences of a stored word, pair and triple.
LEAST = (1, 1, 2)
BLOCK_TOKENS = 600_000
#: Keys that one partition of the count tables gets, about.
TABLE_KEYS = 1_000_000
#: Share of keys that may share a hash.
COLLIDING = 2.0**-20
_START, _END = np.uint64(1), np.uint64(2)
_WORDS, _PAIRS, _TRIPLES, _STATS = range(4)
_memo = WordHashes(150_000)


# Blocks -------------------------------------------------------------------------------------


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _squeezed(values: np.ndarray) -> bytes:
    """32-bit numbers by byte plane, compressed."""
    return _squeeze.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _restored(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_restore.decompress(data), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


BLOCKS = "p long, doc_id array<long>, held array<boolean>, sizes array<long>, n long, words binary, places binary"
_BLOCK_TYPES = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
_BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def _encode(limit: int):
    """Blocks of the documents (doc_id, held, text) of a partition."""

    def of(batches):
        first, k, docs, ids, n = TaskContext.get().partitionId() << 32, 0, [], [], 0
        end = np.array([_END])

        def block():
            words, at = np.unique(np.concatenate(ids), return_inverse=True)
            sizes = [len(x) + 1 for x in ids[::2]]
            row = (first + k, [d for d, _ in docs], [h for _, h in docs], sizes, len(at), _pack(words, True), _squeezed(at))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES, strict=True)], names=_BLOCK_NAMES)

        for batch in batches:
            for doc, held, text in zip(*batch.columns[:3], strict=True):
                words = (text.as_py() or b"").lower().split()
                if docs and n + len(words) > limit:
                    yield block()
                    k, docs, ids, n = k + 1, [], [], 0
                docs.append((doc.as_py(), held.as_py()))
                ids += (np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words)), end)
                n += len(words) + 1
        if docs:
            yield block()

    return of


class _Block:
    """The tokens of a block, their contexts, and its distinct words, pairs and triples."""

    def __init__(self, row: dict, bits: int):
        self.sizes = np.array(row["sizes"], np.int64)
        self.held = np.array(row["held"], bool)
        self.train = np.repeat(~self.held, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        words, at = _unpack(row["words"], True), _restored(row["places"], row["n"])
        w = words[at]
        self.h = self.after(w, _START)
        shift = np.uint64(64 - bits)
        pairs = pair_keys(self.h, w) >> shift << shift
        self.context = self.after(pairs, pair_keys(np.array([_START]), np.array([_START])) >> shift << shift)
        self.keys, self.at = [words], [at]
        for keys in (pairs, pair_keys(self.context, w) >> shift << shift):
            keys, at = np.unique(keys, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)

    def after(self, values: np.ndarray, at_start) -> np.ndarray:
        """For each token what ``values`` has for the token before it, ``at_start`` at starts."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = at_start
        return out

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums by document."""
        return np.add.reduceat(values, self.starts)


def _parts(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The table partitions that sorted keys belong to, and which keys."""
    at = _slices(keys, buckets)
    return [(int(b), slice(at[b], at[b + 1])) for b in np.flatnonzero(np.diff(at))]


def _rows(batch: pa.RecordBatch | pa.Table):
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


# First exchange: counts ---------------------------------------------------------------------


def _request(buckets: int, bits: int):
    names, types = ("b", "p", "kind", "keys", "counts"), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def of(batches):
        for batch in batches:
            for row in _rows(batch):
                block = _Block(row, bits)
                for kind in (_WORDS, _PAIRS, _TRIPLES):
                    out = tuple([] for _ in names)
                    at, n = block.at[kind], len(block.keys[kind])
                    counts = np.bincount(at[block.train], minlength=n) << 1 | (np.bincount(at[~block.train], minlength=n) > 0)
                    for b, s in _parts(block.keys[kind], buckets):
                        for column, v in zip(out, (b, row["p"], kind, _pack(block.keys[kind][s], True), _pack(counts[s])), strict=True):
                            column.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=list(names))

    return of


ANSWERS = "b long, p long, kind int, answer binary, stats array<long>"


def _answer(rows: pa.Table) -> pa.Table:
    """Sums the counts of one table partition and answers every block by key: (total, can another
    block need the backoff weight after it, owner?). After words only texts held out meet unseen ones."""
    out: dict[str, list] = {k: [] for k in ("b", "p", "kind", "answer", "stats")}
    b, kinds = rows.column("b")[0].as_py(), rows.column("kind").to_numpy()
    for kind in (_WORDS, _PAIRS, _TRIPLES):
        of = rows.take(pa.array(np.flatnonzero(kinds == kind)))
        if not of.num_rows:
            continue
        blocks = of.column("p").to_pylist()
        each = [_unpack(x.as_py(), True) for x in of.column("keys")]
        counts = np.concatenate([_unpack(x.as_py()) for x in of.column("counts")]).astype(np.int64)
        sizes = [len(k) for k in each]
        keys, at = np.unique(np.concatenate(each), return_inverse=True)
        counts, held = counts >> 1, np.bincount(at, counts & 1, len(keys)) > 0
        total = np.bincount(at, counts, len(keys)).astype(np.int64)
        owner, number = np.full(len(keys), -1, np.int32), np.repeat(np.arange(len(blocks), dtype=np.int32), sizes)
        given = np.flatnonzero(counts)
        owner[at[given]] = number[given]
        wanted = held if kind == _WORDS else np.bincount(at) > 1
        reply = (total[at] << 2 | wanted[at] << 1 | (owner[at] == number)).astype(np.uint64)
        for p, part in zip(blocks, np.split(reply, np.cumsum(sizes)[:-1]), strict=True):
            for c, v in zip(out.values(), (b, p, kind, _pack(part), None), strict=True):
                c.append(v)
        stats = [int(total.sum()), int((total > 0).sum()), *(int((total == r).sum()) for r in range(1, CUT + 2))]
        for c, v in zip(out.values(), (b, None, _STATS, None, [kind, *stats]), strict=True):
            c.append(v)
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})


# The model ----------------------------------------------------------------------------------


def discounts(n: list[int], least: int = 1) -> np.ndarray:
    """d(r) for r = 0..CUT + 1 (the last for all larger r); n: numbers of keys seen 1..CUT + 1 times.
    Counts below ``least`` are dropped: then Good-Turing's own ratios hold above it, without the
    correction that keeps the dropped mass for unseen keys."""
    a = least - 1
    spare = n[a] / (n[a] + 2 * n[a + 1]) if n[a] and n[a + 1] else 0.5
    tail = (CUT + 1) * n[CUT] / n[0] if n[0] and least == 1 else 0.0
    d = np.full(CUT + 2, KEPT)
    d[:least] = 0.0
    for r in range(least, CUT + 1):
        ratio = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if n[r - 1] and n[r] and tail < 1 else 0.0
        d[r] = ratio if 0 < ratio < 1 else (r - spare) / r
    return d


class Model:
    """What all blocks share: N, V and the discounts."""

    def __init__(self, stats: dict[int, list[int]]):
        none = [0] * (CUT + 3)
        kinds = [stats.get(kind, none) for kind in (_WORDS, _PAIRS, _TRIPLES)]
        words = kinds[0]
        self.n, self.v = words[0], words[1]
        self.discount = [discounts(k[2:], least) for k, least in zip(kinds, LEAST, strict=True)]
        seen = sum(d * r * k for r, d, k in zip(range(1, CUT + 1), self.discount[0][1:], words[2:], strict=False))
        many = self.n - sum(r * k for r, k in zip(range(1, CUT + 1), words[2:], strict=False))
        self.unknown = 1 - (seen + KEPT * many) / self.n if self.n else 1.0

    def mass(self, kind: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.discount[kind][np.minimum(c, CUT + 1)] * c

    def word(self, c: np.ndarray) -> np.ndarray:
        """P(w) by count."""
        return np.where(c > 0, self.mass(_WORDS, c) / max(1, self.n), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


# Second exchange: backoff weights, and scores -----------------------------------------------

#: kind _PAIRS, _TRIPLES: sums behind alpha and needed alphas of the contexts of pairs and triples; _WORDS: a block's documents.
_PARTS = "kind int, p long, b long, keys binary, sums binary, needed binary, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base_score array<double>, part array<double>, open2 array<long>, open3 array<long>, places2 binary, places3 binary"
_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
_PART_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), _LONGS, pa.list_(pa.bool_()), _LONGS, _LONGS, _DOUBLES, _DOUBLES, _LONGS, _LONGS, pa.binary(), pa.binary())
_PART_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


def _score_block(model: Model, buckets: int, bits: int):
    """Scores the documents of a block but for the backoff weights, which it asks for."""

    def of(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _PART_NAMES]
        for row in _rows(blocks):
            block = _Block(row, bits)
            replies = sorted(_rows(answers), key=lambda r: (r["kind"], r["b"]))
            found = [np.concatenate([_unpack(r["answer"]) for r in replies if r["kind"] == kind]).astype(np.int64) for kind in (_WORDS, _PAIRS, _TRIPLES)]
            c1, c2, c3 = counts = [x >> 2 for x in found]
            wanted = [(x & 2).astype(bool) for x in found]
            trained = c1[np.searchsorted(block.keys[_WORDS], _END)]  # each text has one end
            c_w, c_hw, c_t = c1[block.at[_WORDS]], c2[block.at[_PAIRS]], c3[block.at[_TRIPLES]]
            c_h, c_context = block.after(c_w, trained), block.after(c_hw, trained)
            seen2, seen3 = c_hw >= LEAST[1], c_t >= LEAST[2]
            p1 = model.word(c_w)
            p2 = np.where(seen2, model.mass(_PAIRS, c_hw) / np.maximum(c_h, 1), p1)
            part = np.log10(np.where(seen3, model.mass(_TRIPLES, c_t) / np.maximum(c_context, 1), p2))
            open2, open3 = ~seen3 & ~seen2 & (c_h >= LEAST[1]), ~seen3 & (c_context >= LEAST[2])
            need2, at2 = np.unique(block.h[open2], return_inverse=True)
            need3, at3 = np.unique(block.context[open3], return_inverse=True)
            doc = (_WORDS, row["p"], None, None, None, None, row["doc_id"], row["held"], block.sizes, block.total((c_w > 0).astype(np.int64)), block.total(model.base(c_w)), block.total(part), block.total(open2.astype(np.int64)), block.total(open3.astype(np.int64)), _squeezed(at2), _squeezed(at3))
            for column, v in zip(out, doc, strict=True):
                column.append(v)
            for kind, needed, contexts, of_context, lower in ((_PAIRS, need2, block.h, c_h, p1), (_TRIPLES, need3, block.context, c_context, p2)):
                own = np.flatnonzero((found[kind] & 1).astype(bool) & (counts[kind] >= LEAST[kind]))
                first = np.empty(len(block.keys[kind]), np.int64)
                first[block.at[kind]] = np.arange(len(block.h))  # a token of each key
                known = block.after(wanted[kind - 1][block.at[kind - 1]], True)[first[own]]
                own = own[known | np.isin(contexts[first[own]], needed)]
                mine = first[own]
                keys, at = np.unique(contexts[mine], return_inverse=True)
                sums = [np.bincount(at, x, len(keys)) for x in (model.mass(kind, counts[kind][own]) / of_context[mine], lower[mine])]
                held, asked = dict(_parts(keys, buckets)), dict(_parts(needed, buckets))
                for b in sorted(held.keys() | asked.keys()):
                    s, t = held.get(b, slice(0, 0)), asked.get(b, slice(0, 0))
                    packed = _pack(np.concatenate([x[s] for x in sums]))
                    for column, v in zip(out, (kind, row["p"], b, _pack(keys[s], True), packed, _pack(needed[t], True), *[None] * 10), strict=True):
                        column.append(v)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, _PART_TYPES, strict=True)], names=_PART_NAMES)

    return of


def _weigh(rows: pa.Table) -> pa.Table:
    """log10 alpha of the contexts that each block needs, from the sums of all blocks."""
    keys = [_unpack(x.as_py(), True) for x in rows.column("keys")]
    sums = [_unpack(x.as_py(), kind="<f8").reshape(2, -1) for x in rows.column("sums")]
    context, at = np.unique(np.concatenate(keys), return_inverse=True)
    higher, lower = (np.bincount(at, np.concatenate([s[i] for s in sums]), len(context)) for i in range(2))
    alpha = np.append(np.log10((1 - higher) / np.maximum(1 - lower, 1e-300)), 0.0)
    replies = []
    for x in rows.column("needed"):
        x = _unpack(x.as_py(), True)
        place = np.searchsorted(context, x)
        place[place < len(context)] = np.where(context[place[place < len(context)]] == x[place < len(context)], place[place < len(context)], len(context))
        replies.append(_pack(alpha[place]))
    return pa.table({"p": rows.column("p"), "b": rows.column("b"), "kind": rows.column("kind"), "alpha": pa.array(replies, pa.binary())})


def _finish(docs: pa.Table, weights: pa.Table) -> pa.Table:
    out: list[list] = [[] for _ in range(6)]
    replies = sorted(_rows(weights), key=lambda r: (r["kind"], r["b"]))
    for row in _rows(docs):
        score = np.array(row["part"], float)
        for kind, n, places in ((_PAIRS, row["open2"], row["places2"]), (_TRIPLES, row["open3"], row["places3"])):
            alpha = np.concatenate([np.empty(0), *(_unpack(r["alpha"], kind="<f8") for r in replies if r["kind"] == kind)])
            of_doc = np.repeat(np.arange(len(score)), n)
            score += np.bincount(of_doc, alpha[_restored(places, len(of_doc))], len(score))
        for column, v in zip(out, (row["doc_id"], row["held_out"], row["n_tokens"], row["n_known"], row["base_score"], score), strict=True):
            column.extend(v)
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, out, types, strict=True)})


def score(docs: DataFrame, held_out: Column | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    ``held_out``: which documents are not learned from; by default crc32(doc_id as text) mod 5 = 1."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)) if held_out is None else held_out
    texts = docs.select("doc_id", held.alias("held"), F.col("text").cast("binary").alias("text"))
    lie = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(texts.mapInArrow(_encode(block_tokens), BLOCKS), "blocks", "p", lie)
    tokens = blocks.agg(F.sum("n")).head()[0] or 0
    buckets = 1 << max(4, (tokens // TABLE_KEYS).bit_length())
    bits = min(64, 8 * -(-math.ceil(math.log2(max(1, tokens) / COLLIDING)) // 8))
    asked = blocks.mapInArrow(_request(buckets, bits), "b long, p long, kind int, keys binary, counts binary")
    answers = materialize(asked.groupBy("b").applyInArrow(_answer, ANSWERS), "answers")
    stats = answers.where(F.col("kind") == _STATS).select(F.col("stats")[0].alias("of"), F.posexplode("stats").alias("i", "v"))
    table_: dict[int, list[int]] = {}
    for r in stats.groupBy("of", "i").agg(F.sum("v").alias("v")).orderBy("of", "i").collect():
        if r["i"]:
            table_.setdefault(r["of"], []).append(r["v"])
    model = Model(table_)
    replies = answers.where(F.col("kind") < _STATS).select("p", "b", "kind", "answer")
    parts = materialize(blocks.groupBy("p").cogroup(replies.groupBy("p")).applyInArrow(_score_block(model, buckets, bits), _PARTS), "parts")
    discard(blocks, answers)
    weights = parts.where(F.col("kind") != _WORDS).select("p", "b", "kind", "keys", "sums", "needed")
    weights = weights.groupBy("b", "kind").applyInArrow(_weigh, "p long, b long, kind int, alpha binary")
    scored = parts.where(F.col("kind") == _WORDS).drop("kind", "b", "keys", "sums", "needed")
    scored = scored.groupBy("p").cogroup(weights.groupBy("p")).applyInArrow(_finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

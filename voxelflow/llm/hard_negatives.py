"""Hard-negative mining by product quantisation with stored residual norms.

Every vector is cut into sub-vectors of a few components; each is stored as the number of the nearest
of 256 code words (trained on a bounded sample of SAMPLE rows, the ones with the smallest hashes)
and the length of what the code word misses, rounded up to one byte. A row's score for an anchor then
lies within its lookup-table score plus or minus the sum, over the sub-vectors, of the anchor's length
times the missed length (Cauchy and Schwarz), whatever the sample was: the code decides how many rows
are recomputed, never which are found.

Two passes compare the anchors with all rows in blocks. The first finds each anchor's best rows of
the same label, its positives; each positive's score spans a window of scores, and the second finds
the best rows of other labels in each window. In both, the bounds leave the rows that can still be among
the best; these are recomputed in whole numbers. Blocks of rows are dealt into groups and stay there;
anchors come to every group, in blocks; each block of anchors carries its best rows from block to block
of a group, so only a few rows leave a group for each anchor, and a window over them keeps the best.
Every row is its own group key, so no label or id is a hot key.

Defined cases: rows with a null label, a null vector or null or non-finite components take no part;
vectors of different lengths are not compared; integers are
held at 2^27 in size, so that scores are exact 64-bit numbers; repeated rows are separate rows, so a
copy of an anchor is a positive; a null vec_id is no anchor and comes last in ties; an anchor
without another row of its label gives no rows; columns beside vec_id, embedding and label are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ball_kmeans import usable, whole
from .common import materialize, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LEAST, MOST = 50, 95  # a negative's score in percent of the positive's
#: Components of a sub-vector, code words of each, rows that train them (by the smallest hashes).
SUB, WORDS, SAMPLE = 2, 256, 16384
BLOCK, ANCHORS, GROUP_BLOCKS = 4096, 128, 64
_NO_ID = np.iinfo(np.int64).max  # after all ids


def train(sample: list[np.ndarray], rounds: int = 8) -> np.ndarray:
    """[sub-vector, word, component]: k-means in each sub-space, from the rows of the sample that reach it."""
    if not sample:
        return np.zeros((0, WORDS, SUB))
    lengths = np.array([len(x) for x in sample])
    padded = np.zeros((len(sample), -(-lengths.max() // SUB) * SUB))
    for k, x in enumerate(sample):
        padded[k, : len(x)] = x
    parts = padded.reshape(len(sample), -1, SUB)
    words = np.zeros((parts.shape[1], WORDS, SUB))
    for m in range(parts.shape[1]):
        x = parts[lengths > m * SUB, m]
        words[m] = x[np.linspace(0, len(x) - 1, WORDS).astype(int)]
        for _ in range(rounds):
            near = _nearest(x, words[m])
            n = np.bincount(near, minlength=WORDS)
            for c in range(SUB):
                words[m, :, c] = np.where(n > 0, np.bincount(near, x[:, c], WORDS) / np.maximum(n, 1), words[m, :, c])
    return words


def words_for(words: np.ndarray, d: int) -> np.ndarray:
    """The code words of vectors of length d; beyond the sample's lengths all words are zero."""
    parts = -(-d // SUB)
    return words[:parts] if parts <= len(words) else np.concatenate([words, np.zeros((parts - len(words), WORDS, SUB))])


def _parts(x: np.ndarray) -> np.ndarray:
    """[row, sub-vector, component]; a last short sub-vector is filled up with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB))).reshape(len(x), -1, SUB)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * (x @ words.T)).argmin(1)


def encode(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes [row, sub-vector], missed lengths as bytes, and the length of one byte step by
    sub-vector. A missed length is never more than its byte times the step."""
    parts = _parts(x.astype(np.float64))
    codes = np.stack([_nearest(parts[:, m], words[m]) for m in range(parts.shape[1])], 1)
    missed = np.sqrt(((parts - words[np.arange(parts.shape[1])[None, :], codes]) ** 2).sum(2))
    step = np.maximum(missed.max(0), 1e-300) / 254
    return codes.astype(np.uint8), np.ceil(missed / step + 1e-9).clip(0, 255).astype(np.uint8), step


ROWS = "block long, d int, kind string, vectors binary, codes binary, missed binary, step binary, ids binary, labels binary, rows binary"


def _row_blocks(words: np.ndarray, scale: int, size: int):
    """Blocks of rows of one length: ids, labels, vectors, codes and missed lengths."""

    def of(batches):
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                rows, book = np.flatnonzero(lengths == d), words_for(words, d)
                for start in range(0, len(rows), size):
                    some = batch.take(pa.array(rows[start : start + size]))
                    x = whole(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), scale)
                    codes, missed, step = encode(x, book)
                    kind = "<i2" if np.abs(x).max() < 1 << 15 else "<i4"
                    numbers = [_blob(some.column(k).to_numpy().astype("<i8")) for k in (2, 3)]
                    columns = [some.column(3).slice(0, 1), pa.array([d], pa.int32()), pa.array([kind]), _blob(x.astype(kind)), _blob(codes), _blob(missed), _blob(step), _blob(_ids(some.column(0))), *numbers]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])

    return of


ANCHOR_ROWS = "a_block long, a_d int, a_kind string, a_vectors binary, a_ids binary, a_labels binary, a_rows binary"


def _anchor_blocks(every: int, size: int):
    """The rows of row blocks whose id ``every`` divides, in blocks of their own."""

    def of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, rows = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "rows"))
                x = np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), -1)
                found = np.flatnonzero((ids % every == 0) & (ids != _NO_ID))
                for start in range(0, len(found), size):
                    at = found[start : start + size]
                    columns = [pa.array(rows[at[:1]]), pa.array([row["d"]], pa.int32()), pa.array([row["kind"]]), _blob(x[at]), _blob(ids[at]), _blob(labels[at]), _blob(rows[at])]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ANCHOR_ROWS.split(", ")])

    return of


def _blob(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype("<i8")


def _exact(x: np.ndarray, q: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of the pairs, in whole numbers."""
    out = np.empty(len(rows), np.int64)
    for start in range(0, len(rows), 1 << 15):
        s = slice(start, start + (1 << 15))
        out[s] = np.einsum("ij,ij->i", x[rows[s]], q[columns[s]])
    return out


def bounds(codes: np.ndarray, missed: np.ndarray, step: np.ndarray, words: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds [row, anchor] of the scores: lookup-table score minus and plus the
    missed lengths times the anchor's, with room for rounding."""
    parts = _parts(q.astype(np.float64))
    score = np.zeros((len(codes), len(q)))
    for m in range(parts.shape[1]):
        score += (words[m] @ parts[:, m].T)[codes[:, m]]
    lengths = np.sqrt((parts**2).sum(2))
    error = missed.astype(np.float64) @ (lengths * step).T
    error += 0.5 + 1e-9 * (np.abs(score) + error)
    return score - error, score + error


def _best(score: np.ndarray, ids: np.ndarray, key: np.ndarray, count: int) -> np.ndarray:
    """Indices of the ``count`` best rows of each key: by score, then the smaller id."""
    order = np.lexsort((ids, -score, key))
    k = key[order]
    first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    return order[np.arange(len(k)) - begin < count]


def _kth(values: np.ndarray, count: int) -> np.ndarray:
    """By column, the count-th largest value; -inf where there are fewer rows."""
    if len(values) < count:
        return np.full(values.shape[1], -np.inf)
    return np.partition(values, len(values) - count, axis=0)[len(values) - count]


class _Anchors:
    """A block of anchors with what it has found so far in a group: (slot, score, id). A slot is an
    anchor, or one of an anchor's windows: ``tops`` [anchor, window] are the positives' scores."""

    def __init__(self, row: dict, count: int, per: int):
        self.q = np.frombuffer(row["a_vectors"], row["a_kind"]).reshape(-1, row["a_d"]).astype(np.int64)
        self.anchors, self.labels, self.rows = (np.frombuffer(row[c], "<i8") for c in ("a_ids", "a_labels", "a_rows"))
        self.block, self.count, self.per = row["a_block"], count, per
        if "tops" in row:
            self.tops, place = np.full((len(self.q), per), _NO_ID), {r: k for k, r in enumerate(self.rows.tolist())}
            for x in row["tops"]:
                self.tops[place[x["row"]], x["slot"]] = x["score"]
        self.slots, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def keep(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        slots, scores, ids = np.r_[self.slots, slots], np.r_[self.scores, scores], np.r_[self.ids, ids]
        best = _best(scores, ids, slots, self.count)
        self.slots, self.scores, self.ids = slots[best], scores[best], ids[best]

    def floor(self, slots: np.ndarray) -> np.ndarray:
        """The score that a row must reach, by slot, from what is found so far."""
        n = np.bincount(self.slots, minlength=slots[-1] + 1 if len(slots) else 1)
        low = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(low, self.slots, self.scores)
        return np.where(n[slots] >= self.count, low[slots], -np.inf)

    def batch(self) -> pa.RecordBatch:
        at = self.slots // self.per
        columns = [pa.array(np.full(len(at), self.block)), pa.array(self.rows[at]), pa.array(self.anchors[at]), pa.array((self.slots % self.per).astype(np.int32)), pa.array(self.scores), pa.array(self.ids, mask=self.ids == _NO_ID)]
        return pa.RecordBatch.from_arrays(columns, names=["a_block", "row", "anchor_id", "slot", "score", "id"])


FOUND = "a_block long, row long, anchor_id long, slot int, score long, id long"


def _positives(a: _Anchors, x, label, ids, rows, part, words) -> None:
    for one in np.unique(a.labels):
        r, c = np.flatnonzero(label == one), np.flatnonzero(a.labels == one)
        if not len(r):
            continue
        low, high = bounds(*part(r), words, a.q[c])
        own = rows[r][:, None] == a.rows[c][None, :]
        low[own], high[own] = -np.inf, -np.inf
        need = np.maximum(_kth(low, a.count), a.floor(c))
        i, j = np.nonzero((high >= need[None, :]) & ~own)
        i, j = r[i], c[j]
        a.keep(j, _exact(x, a.q, i, j), ids[i])


def _negatives(a: _Anchors, x, label, ids, rows, part, words) -> None:
    low, high = bounds(*part(np.arange(len(x))), words, a.q)
    other = label[:, None] != a.labels[None, :]
    per = a.tops.shape[1]
    wanted, spans = np.zeros(other.shape, bool), []
    for k in range(per):
        top = a.tops[:, k]
        there = top != _NO_ID
        least, most = -((-LEAST * top) // 100), (MOST * top) // 100
        spans.append((there, least, most))
        sure = np.where(other & (low >= least) & (high <= most), low, -np.inf)
        need = np.maximum(_kth(sure, a.count), a.floor(np.arange(len(top)) * per + k))
        wanted |= other & (high >= np.maximum(need, least)) & (low <= most) & there
    i, j = np.nonzero(wanted)
    score = _exact(x, a.q, i, j)
    for k, (there, least, most) in enumerate(spans):
        fits = np.flatnonzero(there[j] & (score >= least[j]) & (score <= most[j]))
        a.keep(j[fits] * per + k, score[fits], ids[i[fits]])


def _compare(words: np.ndarray, count: int, per: int, find):
    """Blocks of anchors beside blocks of rows, one pair after another; what an anchor block found is
    carried while the next pair has the same one."""

    def of(batches):
        now, at = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if (row["a_block"], row["g"]) != at:
                    if now is not None and len(now.slots):
                        yield now.batch()
                    now, at = _Anchors(row, count, per), (row["a_block"], row["g"])
                x = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, row["d"]).astype(np.int64)
                codes, missed = (np.frombuffer(row[c], np.uint8).reshape(len(x), -1) for c in ("codes", "missed"))
                step = np.frombuffer(row["step"], "<f8")
                label, ids, rows = (np.frombuffer(row[c], "<i8") for c in ("labels", "ids", "rows"))
                find(now, x, label, ids, rows, lambda r, c=codes, m=missed, s=step: (c[r], m[r], s), words_for(words, row["d"]))
        if now is not None and len(now.slots):
            yield now.batch()

    return of


def _ranked(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The ``count`` best of what the groups found, with ``rank`` from 1."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows
    whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    kept = vectors.where(usable() & F.col("label").isNotNull()).select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    drawn = kept.select(F.col("embedding").cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(sample)
    words = train([whole(np.array([r["v"]]), scale)[0] for r in drawn.toLocalIterator()])
    rows = materialize(kept.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_row_blocks(words, scale, block), ROWS), "rows")
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // GROUP_BLOCKS))
    anchors = materialize(rows.select("d", "kind", "vectors", "ids", "labels", "rows").mapInArrow(_anchor_blocks(every, ANCHORS), ANCHOR_ROWS), "anchors")
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("block", "d"), F.lit(groups)).cast("int")).repartition(groups, "g").hint("merge")

    def compared(left: DataFrame, count: int, per: int, find) -> DataFrame:
        spread = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(groups, "g")
        pairs = spread.join(dealt, "g").where("a_d = d")
        return pairs.mapInArrow(_compare(words, count, per, find), FOUND)

    near = _ranked(compared(anchors, positives, 1, _positives), ["a_block", "row"], positives)
    near = materialize(near.select("a_block", "row", "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    tops = near.groupBy("a_block").agg(F.collect_list(F.struct("row", "slot", F.col("positive_score").alias("score"))).alias("tops"))  # ANCHORS times positives at most
    hard = _ranked(compared(anchors.join(tops, "a_block"), negatives, positives, _negatives), ["row", "slot"], negatives)
    hard = hard.select("row", "slot", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.drop("a_block").join(hard, ["row", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (given + 1) % 10).otherwise(given)
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


SQL = f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding)),
scored AS MATERIALIZED (SELECT a.r AS ar, b.r AS br, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
  CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.x) = len(b.x)),
pos AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id) AS k FROM scored WHERE same QUALIFY k <= {POSITIVES}),
neg AS (SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.k ORDER BY n.score DESC, n.other_id) AS INT) AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM pos p JOIN scored n ON n.ar = p.ar AND NOT n.same AND {LEAST} * p.score <= 100 * n.score AND 100 * n.score <= {MOST} * p.score)
SELECT * FROM neg WHERE rank <= {NEGATIVES}"""

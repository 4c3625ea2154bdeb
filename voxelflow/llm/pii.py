"""Personal data by weak supervision, in DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers. Looser patterns find
further candidates (numbers in national form, addresses spelt with "at" and "dot", card-like
digit groups); matches that fail their check (a part above 255, Luhn's sum, the number of digits)
are candidates with the pattern's vote against them, unless another candidate overlaps, so that
votes can be told apart. Labelers (pattern, gazetteer, context, border, length) vote -1, 0 or 1 on every
candidate. The votes and a few shape features make a signature, of which there are a bounded
number; signature counts over all documents are all that expectation-maximisation needs to
estimate each labeler's reliability, and all that the final classifier (logistic regression on
the posteriors) is fitted on. Candidates beyond the base spans are added where the classifier is
sure and they don't overlap a base span.

The base patterns are written so that Java's matcher neither recurses nor rescans a run of
characters: possessive loops, and starts only where a leftmost match can start. They find what
the plain patterns find.

Defined cases: null text counts as empty and has no spans; null doc_id stays null; repeated rows
get equal results; very long texts are read whole; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
#: Base patterns; see above for their form.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates.
LOOSE = {
    "email": r"(?i)(?<![\w.])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "card": r"(?<![0-9.+-])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9-])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20-])[0-9]{3}-[0-9]{4}(?![0-9-])",
}
#: A text without these characters has no candidate of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Words before a span that speak for its kind, endings of addresses, first digits of issued cards.
CUES = {
    "email": r"(?i)(e-?mail|contact|write|mailto|reach)\W*(\w+\W+){0,3}$",
    "ip": r"(?i)(\bip\b|addr|server|host|login|from)\W*(\w+\W+){0,3}$",
    "card": r"(?i)(card|visa|credit|payment|paid|master)\W*(\w+\W+){0,3}$",
    "phone": r"(?i)(phone|tel|call|mobile|fax|contact|reach)\W*(\w+\W+){0,3}$",
}
GAZETTEER = {
    "email": r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|255)",
    "card": r"^(4|5[1-5]|3[47]|6011|65|2[2-7])",
    "phone": r"^\(?(\+?1|\+[2-9][0-9]|[2-9][0-9]{2})",
}
#: Kinds whose matches may fail their check; these are candidates with the pattern's vote against.
FAILED = ("ip", "card", "phone")
VOTERS = ("pattern", "gazetteer", "context", "border", "length")
SHAPES = ("separated", "long")
SURE = 0.9
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_EMPTY = "cast(array() as array<struct<s:int,e:int,m:string>>)"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""

    def value(x: Column, i: Column) -> Column:
        d = x.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return n.between(12, 19) & F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _checked(kind: str, passed: bool):
    """Whether a span's match passes its kind's check, or whether it fails."""
    return lambda x: _valid(kind, x["m"]) if passed else ~_valid(kind, x["m"])


def _failing(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern that does not count is a candidate: numbers of a card's
    length, dotted groups and international numbers, all but runs too short for any of them."""
    n = F.length(_digits(m))
    return {"ip": F.lit(True), "card": n.between(12, 19), "phone": n >= 7}.get(kind, F.lit(False))


def _located(found: str, gaps: str, valid) -> Column:
    """Spans (s, e, m) of the matches ``found`` between ``gaps`` that ``valid`` accepts."""
    start = F.expr(f"named_struct('at', 0, 'i', 0, 'out', {_EMPTY})")

    def step(acc: Column, m: Column) -> Column:
        s = acc["at"] + F.length(F.get(F.col(gaps), acc["i"]))
        e = s + F.length(m)
        return F.struct(e.alias("at"), (acc["i"] + 1).alias("i"), F.when(valid(m), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), m.alias("m")))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(F.col(found), start, step, lambda acc: acc["out"])).otherwise(F.expr(_EMPTY))


def _scan(rows: DataFrame, text: Column, pattern: str, needs: str, out: str, valid) -> DataFrame:
    worth = F.lower(text).contains(needs) if needs.isalpha() else text.contains(needs) if needs else text.rlike("[0-9]")
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("_found", F.when(worth, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none))
    rows = rows.withColumn("_gaps", F.when(F.size("_found") > 0, F.split(text, pattern, -1)).otherwise(none))
    return rows.withColumn(out, _located("_found", "_gaps", valid)).drop("_found", "_gaps")


def _clear_of(column: str):
    """Whether a span overlaps none of ``column``."""
    return lambda x: ~F.exists(column, lambda y: (y["s"] < x["e"]) & (y["e"] > x["s"]))


def spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key column and, for each kind, base_<kind> and, where the kind has looser patterns,
    loose_<kind>: spans with their votes and shapes."""
    text = F.col("_t")
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("_t"))
    for kind in KINDS:
        rows = _scan(rows, text, BASE[kind], NEEDS[kind], f"base_{kind}", lambda m, k=kind: _valid(k, m) | _failing(k, m))
        if kind in FAILED:
            rows = rows.withColumn(f"failed_{kind}", F.filter(f"base_{kind}", _checked(kind, False))).withColumn(f"base_{kind}", F.filter(f"base_{kind}", _checked(kind, True)))
    for kind, pattern in LOOSE.items():
        rows = _scan(rows, text, pattern, {"email": "dot"}.get(kind, ""), f"loose_{kind}", lambda m: F.lit(True))
        rows = rows.withColumn(f"loose_{kind}", F.when(F.size(f"loose_{kind}") > 0, F.filter(f"loose_{kind}", _clear_of(f"base_{kind}"))).otherwise(F.col(f"loose_{kind}")))

    others = [*(f"base_{k}" for k in KINDS), *(f"loose_{k}" for k in LOOSE)]
    clear = lambda x: functools.reduce(operator.and_, [_clear_of(c)(x) for c in others])
    rows = rows.select("*", *[F.when(F.size(f"failed_{k}") > 0, F.filter(f"failed_{k}", clear)).otherwise(F.col(f"failed_{k}")).alias(f"_{k}") for k in FAILED])
    rows = rows.drop(*[f"failed_{k}" for k in FAILED]).withColumnsRenamed({f"_{k}": f"failed_{k}" for k in FAILED})

    def judged(kind: str, base: bool, failed: bool = False):
        def of(x: Column) -> Column:
            m, before, after = x["m"], F.substring(text, F.greatest(x["s"] - 39, F.lit(1)), F.least(x["s"], F.lit(40))), F.substring(text, x["e"] + 1, 1)
            vote = lambda yes, no=None: F.when(yes, 1).otherwise(0 if no is None else F.when(no, -1).otherwise(0))
            digits = F.length(_digits(m))
            size = {"email": F.length(m) <= 80, "ip": F.length(m) >= 7, "card": digits.isin(13, 15, 16), "phone": digits.between(10, 13)}[kind]
            pattern = F.lit(-1 if failed else 1 if base else 0) if kind != "card" or base or failed else vote(_luhn(_digits(m)), ~_luhn(_digits(m)))
            odd = F.substring(before, -1, 1).rlike(r"[\w.@/=-]") | after.rlike(r"[\w@/=-]")
            in_gazetteer = m.rlike(GAZETTEER[kind])
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), pattern.alias("pattern"), vote(in_gazetteer, ~in_gazetteer).alias("gazetteer"), vote(before.rlike(CUES[kind])).alias("context"), vote(~odd, odd).alias("border"), vote(size, ~size).alias("length"), m.rlike(r"[\x20()-]").cast("int").alias("separated"), (F.length(m) > 16).cast("int").alias("long"))

        return of

    out = [F.transform(f"base_{k}", judged(k, True)).alias(f"base_{k}") for k in KINDS]
    out += [F.transform(f"loose_{k}", judged(k, False)).alias(f"loose_{k}") for k in LOOSE]
    out += [F.transform(f"failed_{k}", judged(k, False, True)).alias(f"failed_{k}") for k in FAILED]
    return rows.select(key, *out)


def vote_counts(found: DataFrame) -> list:
    """A row for each signature: kind, base, votes, shapes, n. At most 2 * 4 * 3**5 * 4 rows."""
    groups = [(k, b) for b, kinds in (("base", KINDS), ("loose", LOOSE), ("failed", FAILED)) for k in kinds]

    def signature(kind: str, base: bool):
        return lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), *[x[v].alias(v) for v in (*VOTERS, *SHAPES)])

    each = F.concat(*[F.transform(f"{b}_{k}", signature(k, b == "base")) for k, b in groups])
    rows = found.select(F.explode(each).alias("x")).select("x.*")
    return rows.groupBy("kind", "base", *VOTERS, *SHAPES).agg(F.count("*").alias("n")).collect()


def reliabilities(votes: np.ndarray, n: np.ndarray, prior: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation on distinct vote rows (-1, 0, 1) with counts: each row's posterior
    of being personal data, and P(vote | class), indexed [class, voter, vote + 1]. ``prior``: the
    posteriors to start from. Counts are smoothed towards voters that are right more often than not."""
    given = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])[:, None, :] * np.ones((1, votes.shape[1], 1))
    post = prior.astype(float)
    for _ in range(rounds):
        share = (n @ post + 1.0) / (n.sum() + 2.0)
        likely = given.copy()
        for c, w in ((1, n * post), (0, n * (1 - post))):
            for v in range(3):
                likely[c, :, v] += w @ (votes == v - 1)
        likely /= likely.sum(2, keepdims=True)
        logs = [math.log(s) + sum(np.log(likely[c, j, votes[:, j] + 1]) for j in range(votes.shape[1])) for c, s in ((0, 1 - share), (1, share))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return post, likely


def classifier(features: np.ndarray, n: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression (Newton steps) of soft targets; the last weight is the constant."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - target)) + ridge * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return w


def fit(counts: list) -> dict[str, float]:
    """The classifier's weights by feature, the constant under ''."""
    names = [*(f"kind_{k}" for k in KINDS), *VOTERS, *SHAPES]
    if not counts:
        return dict.fromkeys([*names, ""], 0.0) | {"": -5.0}
    votes = np.array([[r[v] for v in VOTERS] for r in counts])
    n, base = np.array([float(r["n"]) for r in counts]), np.array([r["base"] for r in counts])
    post, _ = reliabilities(votes, n, np.where(base, 0.95, np.where(votes[:, VOTERS.index("pattern")] < 0, 0.05, 0.3)))
    shapes = np.array([[r["kind"] == k for k in KINDS] + [r[v] for v in (*VOTERS, *SHAPES)] for r in counts], float)
    return dict(zip([*names, ""], classifier(shapes, n, post).tolist(), strict=True))


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, base_<kind> (spans of the base rules) and added_<kind> (the method's)."""
    found = materialize(spans(docs), "spans")
    return judge(found, fit(vote_counts(found)))


def judge(found: DataFrame, weights: dict[str, float], key: str = "doc_id") -> DataFrame:
    """The key column, base_<kind> and added_<kind> of found spans."""

    def sure(kind: str):
        def of(x: Column) -> Column:
            z = F.lit(weights[""] + weights[f"kind_{kind}"])
            for v in (*VOTERS, *SHAPES):
                z = z + F.lit(weights[v]) * x[v]
            return z > math.log(SURE / (1 - SURE))

        return of

    plain = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    further = {k: [f"{g}_{k}" for g, kinds in (("loose", LOOSE), ("failed", FAILED)) if k in kinds] for k in KINDS}
    added = {k: F.concat(none, *[plain(F.filter(c, sure(k))) for c in further[k]]) for k in KINDS}
    return found.select(key, *[plain(F.col(f"base_{k}")).alias(f"base_{k}") for k in KINDS], *[added[k].alias(f"added_{k}") for k in KINDS])


def _listed(prefixes: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by start and then kind, comma-joined."""

    def ordered(i: int, kind: str):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("k"))

    each = [F.transform(f"{p}_{k}", ordered(i, k)) for p in prefixes for i, k in enumerate(KINDS)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_listed(("base",)), 256).alias("base_sha256"), _listed(("base", "added")).alias("spans"))


def mask_private(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by <KIND>; other columns stay. One pass counts
    the signatures, a second finds and replaces, so no text is shuffled."""
    weights = fit(vote_counts(spans(docs)))
    found = judge(spans(docs.select(F.struct("*").alias("_row"), "text"), "_row"), weights, "_row")

    def marked(kind: str):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind.upper()}>").alias("k"))

    each = [F.transform(f"{p}_{k}", marked(k)) for p in ("base", "added") for k in KINDS]
    found = found.select("_row", F.array_sort(F.concat(*each)).alias("_spans"))
    text = F.col("_row")["text"]
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<string>))")

    def step(acc: Column, x: Column) -> Column:  # spans of different kinds may overlap: the first to start wins
        whole = F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["k"])).alias("out"))
        return F.when(x["s"] >= acc["at"], whole).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    masked = F.aggregate("_spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    masked = F.when(F.size("_spans") > 0, masked).otherwise(text)
    return found.select(*[masked.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])

"""The ten operators and the pipeline's stages against brute force, with odd rows and empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from voxelflow.llm import chat, common, embeddings, html_text, katz, mixing, ordinal, packing, pii, quality_rules, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, k long, b long, size long"
LONG = " ".join(f"w{i % 977} x{i % 89}" for i in range(6000))
ODD = [
    (-1, None, None, None, None), (-2, "", "en", "a", 0), (-3, " \t\n", "en", "a", 3), (-4, "same words here now", "en", None, 19), (-4, "same words here now", "en", None, 19),
    (-5, LONG, "en", "b", len(LONG)), (None, "a row without id, mail me@x.org", "en", "a", 31), (-6, "É x y 😀 me@x.org 1.2.3.4 +1 (555) 010-9999 4111 1111 1111 1111", "en", "a", 60),
]


@pytest.fixture(scope="module")
def rows(spark):
    some = [tuple(r)[:5] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    return ODD + some


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, 7, 7, 7) for r in rows], DOCS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def roots(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        up[root(i)] = root(j)
    return [root(i) for i in range(n)]


def least(ids, groups):
    found = defaultdict(list)
    for i, g in zip(ids, groups, strict=True):
        if i is not None:
            found[g].append(i)
    return [min(found[g], default=None) for g in groups]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def order(x):
    return tuple((v is None, v) for v in x)


def test_simhash(docs, rows, nothing):
    def fingerprint(text):
        words = WORD.findall(lower(text))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = zip([r[0] for r in rows], [p - (1 << 64) if p >> 63 else p for p in prints], least([r[0] for r in rows], roots(len(rows), near)), strict=True)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_crowds(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 4)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 4), replace=False)) for b in base for _ in range(120)})
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    at = {p: i for i, p in enumerate(prints)}
    near = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 4]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 4 for u, v in links)
    pairs = lambda r: {frozenset(i for i in range(len(r)) if r[i] == x) for x in r}
    assert pairs(roots(len(prints), near)) == pairs(roots(len(prints), [(at[u], at[v]) for u, v in links]))


def test_simhash_masks_cover():
    """Every choice of four positions is dropped by some table, also where the positions' codes depend on each other."""
    masks = np.array(simhash.covering_masks(), np.int64).view(np.uint64)
    keeps = (masks[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(bool)  # [table, position]
    dropped = [sum(1 << t for t in range(len(masks)) if not keeps[t, i]) for i in range(64)]
    assert all(dropped[a] & dropped[b] & dropped[c] & dropped[d] for a, b, c, d in itertools.combinations(range(64), 4))


def test_simhash_dependent_positions(spark):
    """Differences at 11, 12 and 62, and at 30, 35, 56 and 11: two pairs of sf0.1 that met in no table."""
    prints = [-4944319249235111108, -332633230807725252, 8405823366839704545, 8477880994163626977]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert {frozenset(x) for x in links} == {frozenset(prints[:2]), frozenset(prints[2:])}


def test_simhash_spares_driver(spark, monkeypatch):
    """No table that grows with the documents goes through the driver, whatever the planner takes its size for."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(-(1 << 62), 1 << 62))
    prints = sorted({base ^ sum(1 << int(k) for k in rng.choice(62, 2, replace=False)) for _ in range(100)})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert len({x for link in links.collect() for x in link}) == len(prints)
    assert "Broadcast" not in plan(links)
    seen = []
    monkeypatch.setattr(common, "SMALL", 0, raising=False)
    monkeypatch.setattr(common, "materialize", lambda df, *a, f=common.materialize: (seen.append(plan(df)), f(df, *a))[1])
    monkeypatch.setattr(simhash, "materialize", lambda df, *a, f=simhash.materialize: (seen.append(plan(df)), f(df, *a))[1])
    monkeypatch.setattr(simhash, "simhash", lambda _: F.col("fp"))
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long"))
    assert {r.component_id for r in found.collect()} == {0}
    assert len(seen) > 6 and not any("Broadcast" in x for x in [*seen, plan(found)])


def good_turing(counts, least):
    """Discount by number of occurrences, as the docstring of the model states it."""
    n = Counter(counts)
    spare = n[least] / (n[least] + 2 * n[least + 1]) if n[least] and n[least + 1] else 0.5
    mu = 6 * n[6] / n[1] if least == 1 and n[1] else 0.0

    def d(r):
        if r < least or r > 5:
            return 0.0 if r < least else 0.999
        ratio = ((r + 1) / r * n[r + 1] / n[r] - mu) / (1 - mu) if n[r] and n[r + 1] and mu < 1 else -1
        return ratio if 0 < ratio < 1 else 1 - spare / r

    return d


@pytest.mark.parametrize("block_tokens", [katz.BLOCK_TOKENS, 900])
def test_katz(docs, rows, nothing, block_tokens):
    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1

    text = [[*WORD.findall(lower(r[1])), "</s>"] for r in rows]
    padded = [[("<s>", "<s>", *t)[i : i + 3] for i in range(len(t))] for t in text]
    train = [g for r, t in zip(rows, padded, strict=True) if not held(r[0]) for g in t]
    c1, c2, c3 = (Counter(g[k:] for g in train) for k in (2, 1, 0))
    n, v, starts = len(train), len(c1), sum(not held(r[0]) for r in rows)
    d1, d2, d3 = good_turing(c1.values(), 1), good_turing(c2.values(), 1), good_turing(c3.values(), 2)
    unknown = 1 - sum(d1(c) * c for c in c1.values()) / n
    after2, after3 = defaultdict(dict), defaultdict(dict)
    for g, c in c2.items():
        after2[g[:1]][g[1]] = d2(c) * c / (c1[g[:1]] if g[0] != "<s>" else starts)
    for g, c in c3.items():
        if c >= 2:
            after3[g[:2]][g[2]] = d3(c) * c / (c2[g[:2]] if g[1] != "<s>" else starts)

    def p1(w):
        return d1(c1[w,]) * c1[w,] / n if (w,) in c1 else unknown

    def p2(h, w):
        if w in after2.get(h, ()):
            return after2[h][w]
        if h not in after2:
            return p1(w)
        if h not in alpha2:
            alpha2[h] = (1 - sum(after2[h].values())) / (1 - sum(map(p1, after2[h])))
        return alpha2[h] * p1(w)

    def p3(h, w):
        if w in after3.get(h, ()):
            return after3[h][w]
        if h not in after3:
            return p2(h[1:], w)
        if h not in alpha3:
            alpha3[h] = (1 - sum(after3[h].values())) / (1 - sum(p2(h[1:], x) for x in after3[h]))
        return alpha3[h] * p2(h[1:], w)

    alpha2, alpha3 = {}, {}
    for h in list(after3)[:5]:
        assert sum(p3(h, w) for (w,) in c1) + p3(h, "no such word") == pytest.approx(1)
    want = {}
    for r, t in zip(rows, padded, strict=True):
        ws = [g[2] for g in t]
        want[r[0]] = (held(r[0]), len(t), sum((w,) in c1 for w in ws), n, sum(math.log10((c1[w,] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), sum(math.log10(p3(g[:2], g[2])) for g in t))
    got = katz.score(docs, block_tokens=block_tokens).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r["doc_id"]][:4]
        assert (r["base_score"], r["score"]) == pytest.approx(want[r["doc_id"]][4:], rel=1e-9)
    assert katz.score(nothing).count() == 0


def test_katz_discounts():
    """Katz's formula by hand, and the absolute discount where Good-Turing has no ratio."""
    d = katz.discounts([100, 40, 20, 12, 8, 5])
    assert d[1] == pytest.approx((2 * 40 / 100 - 0.3) / 0.7) and d[2] == pytest.approx((3 * 20 / 80 - 0.3) / 0.7) and d[6] == katz.KEPT
    assert katz.discounts([100, 0, 20, 30, 8, 5])[1] == pytest.approx(0.5)
    assert katz.discounts([100, 40, 60, 30, 8, 5], 2).tolist()[:3] == [0, 0, pytest.approx(1 - 40 / 160 / 2)]


def test_chat(spark):
    sf = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        sf.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    sf[-1] = [(x, "</s>[INST] ok [/INST]") for x in ("user", "assistant")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in chat.op3_chat(spark, SF).collect():
        turns = sf.pop(r["conv_id"])
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned))
    assert not sf


def test_chat_trees(spark):
    odd = "\\ <|user|> </s>\n[INST] <\\/s> \\\\"
    said = [(1, 1, None, "user", odd, 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, None, None, None), (1, 5, 6, "x", "cycle", 9.0), (1, 6, 5, "x", "cycle", 9.0), (2, 1, 99, "a||>", "", 0.0), (None, 1, None, "user", "z", 0.0)]
    trees = chat.format_trees(spark.createDataFrame(said, "tree long, node long, parent long, role string, text string, score double"), branches=2)
    got = {(r["tree"], r["rank"]): [tuple(x) for x in r["back"]] for r in trees.withColumn("back", chat.read_back(trees["formatted"])).collect()}
    assert got == {(1, 1): [("user", odd), ("assistant", "b"), ("", "")], (1, 2): [("user", odd), ("assistant", "a")], (2, 1): [("a||>", "")], (None, 1): [("user", "z")]}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text, kind):
    def good(m):
        digits = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return [m.span() for m in re.finditer(BASE[kind], text or "") if good(m[0])]


def test_pii(docs, rows, nothing, spark):
    hard = [(-20 - k, t, "en", "a", 0) for k, t in enumerate(["a@b.c_d@e.f a@b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.004", "+12 345 678 90+1 (2) ... 3", "4111-1111-1111-1111 4111 1111 1111 1112"])]
    more = docs.union(spark.createDataFrame([(*r, 7, 7, 7, 7) for r in hard], DOCS))
    want = Counter((i, *(tuple(base_spans(t, k)) for k in pii.KINDS)) for i, t, *_ in rows + hard)
    found = pii.find_private(more).collect()
    assert Counter((r["doc_id"], *(tuple((x["s"], x["e"]) for x in r[f"base_{k}"]) for k in pii.KINDS)) for r in found) == want
    for r in found:
        for k in pii.KINDS:
            assert not any(a["s"] < b["e"] and b["s"] < a["e"] for a in r[f"added_{k}"] for b in r[f"base_{k}"])
    assert pii.find_private(nothing).count() == 0
    masked = pii.mask_private(more)
    assert masked.columns == more.columns and masked.count() == more.count()
    assert not [r for r in masked.collect() if base_spans(r["text"], "email")]
    assert masked.where("doc_id = -6").head()["text"].endswith("y 😀 <EMAIL> <IP> +1 <PHONE> <CARD>")  # the base match of the phone has too many digits


def test_pii_capitals(spark):
    given = ["jane [at] acme [dot] com", "jane [AT] acme [DOT] com", "Jane (At) acme (Dot) com", "JANE (AT) ACME (DOT) CO (DOT) UK"]
    found = pii.spans(spark.createDataFrame([(k, t, "en", "a", 0, 7, 7, 7, 7) for k, t in enumerate(given)], DOCS)).collect()
    assert {r["doc_id"]: [(x["s"], x["e"]) for x in r["loose_email"]] for r in found} == {k: [(0, len(t))] for k, t in enumerate(given)}


def test_ordinal(spark, docs, rows, nothing):
    rng = np.random.default_rng(5)
    vocabulary = {0: ["spam", "buy", "cheap"], 1: ["rude", "awful", "nasty"], 2: ["calm", "clear", "kind"]}
    made = [(k, " ".join([*rng.choice(["the", "of", "and", "to", "in"], 12), *rng.choice(vocabulary[k % 3], 3)])) for k in range(600)]
    texts = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3) for k in range(400)] + [(0, 0), (10**6, 2), (5, None)], "doc_id long, grade int")
    got = ordinal.classify(texts, labels, 3).where("doc_id >= 400").collect()
    assert np.mean([r["kept"] == (r["doc_id"] % 3 == 2) for r in got]) > 0.97
    assert all(0 <= r["top_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    assert ordinal.classify(docs, labels.limit(0), 3).where("kept").count() == len(rows)
    assert ordinal.classify(nothing, labels, 3).count() == 0


def ordinal_objective(w, thresholds, rows, grades, decay):
    """Mean log likelihood of grades less the penalty, row by row."""
    total = 0.0
    for x, y in zip(rows, grades, strict=True):
        margin = sum(w[i] for i in x)
        below = [0.0, *(1 / (1 + math.exp(-(t - margin))) for t in thresholds), 1.0]  # P(grade < k)
        total += math.log(max(1e-12, below[y + 1] - below[y]))
    return total / len(rows) - decay / 2 * sum(v * v for v in w.values())


def test_ordinal_fit_against_a_reference():
    """The fit's likelihood against plain coordinate search from the fit and from nothing; thresholds ascend,
    and the scores are those of the formula."""
    rng = np.random.default_rng(7)
    grades = rng.integers(0, 3, 150)
    index = [np.unique(np.concatenate([rng.integers(0, 3, 1), rng.choice([5, 6], 1) if y == 0 else np.empty(0, int), np.array([7]) if y == 1 and rng.random() < 0.8 else np.empty(0, int)])).astype(np.int64) for y in grades]
    decay = 1e-2
    model = ordinal.fit(grades, index, 3, rounds=3000, decay=decay)
    used = ordinal.telling(grades, index, 3)
    assert {5, 6, 7} <= set(used.tolist()) and (np.diff(model.thresholds) >= 0).all()
    rows = [[i for i in x.tolist() if i in set(used.tolist())] for x in index]

    def searched(w, t, steps):
        best = ordinal_objective(w, t, rows, grades, decay)
        size = 0.5
        while size > 1e-3 and steps:
            better = False
            for k in [*w, "a", "b"]:
                for d in (size, -size):
                    w2, t2 = dict(w), list(t)
                    if isinstance(k, str):
                        t2["ab".index(k)] += d
                    else:
                        w2[k] += d
                    if t2[0] < t2[1] and (got := ordinal_objective(w2, t2, rows, grades, decay)) > best:
                        w, t, best, better = w2, t2, got, True
            steps -= 1
            size = size if better else size / 2
        return best

    fitted = {int(i): float(model.weights[i]) for i in used}
    mine = ordinal_objective(fitted, model.thresholds.tolist(), rows, grades, decay)
    assert mine >= searched(dict.fromkeys(fitted, 0.0), [-0.7, 0.7], 200) - 2e-3
    assert mine >= searched(fitted, model.thresholds.tolist(), 50) - 2e-3
    margin = np.array([sum(fitted.get(int(i), 0.0) for i in x) for x in index])
    tail = model.at_least(margin)
    assert np.allclose(tail, [[1 - 1 / (1 + math.exp(-(t - m))) for t in model.thresholds] for m in margin]) and (tail[:, 0] >= tail[:, 1]).all()


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((12, 64))
    v = np.concatenate([x + s * rng.standard_normal((12, 64)) for s in (0, 0, 0.2, 0.3, 0.35)]).astype(np.float32)
    table = [(k, y.tolist(), k % 3) for k, y in enumerate(v)] + [(100, None, 0), (101, [0.0] * 64, 0), (102, [float("nan")] * 64, 0), (103, [None] * 64, 0), (104, [1.0], 0), (105, [], 0)]
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    group = least(range(len(v)), roots(len(v), zip(*np.nonzero(near), strict=True)))
    want = {k: (int(near[k].sum()), group[k]) for k in range(len(v))} | {k: (0, k) for k in range(100, 106)}
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame).collect()} == want
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_embedding_tables():
    """Pairs just at the threshold meet as often as stated, however many tables there are."""
    rng, d = np.random.default_rng(2), 64
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 3000, d)))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for n in (500, 50_000, 10**6, 10**8):
        bits, tables = embeddings.table_sizes(n)
        turns = [embeddings.rotation(d, k).T for k in range(embeddings.rotations_for(bits, tables, d))]
        keys = [embeddings.table_keys([v @ r for r in turns], bits, tables) for v in (x, y)]
        assert (keys[0] == keys[1]).any(1).mean() >= 0.995


def test_html(spark):
    page = "<html><head><title>t</title><style>x</style></head><body><nav>Menu</nav><article><h1>Head &amp;\n line {0}</h1><p>Body <b>of</b> {0}.</p><div class='ad'>Buy</div></article><div id=comments><p>First!</p></div><footer>Foot</footer><script>var a='<p>';</script></body></html>"
    table = [(k, "http://h.x/1", page.format(k)) for k in range(5)] + [(10, None, None), (11, "http://h.x/1", ""), (12, "u", "<p>cut <b"), (12, "u", "<p>cut <b")]
    got = html_text.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()
    assert len(got) == len(table)
    for r in got:
        want = f"Head & line {r['page_id']} Body of {r['page_id']}." if r["page_id"] < 10 else {12: "cut"}.get(r["page_id"], "")
        assert (r["text"], r["n_chars"]) == (want, len(want))


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "x") for r in rows], "page_id long, url string, html string, p long, b long, text string")


def own(k, n=30):
    return " ".join(f"own{k}x{i}" for i in range(n))


def test_html_boilerplate(spark):
    """Unmarked repeats go from plain text, and from articles where a quarter of the host has them;
    quotations and copies of whole articles stay. Each page has another text without the evidence."""
    same, quote = " ".join(f"notice{k}" for k in range(40)), " ".join(f"quote{k}" for k in range(20))
    plain = [(k, "http://h.x/", f"<body><div>{same}</div><div>{own(k)}</div></body>") for k in range(6)]
    marked = [(10 + k, "http://m.x/", f"<article><p>{own(k, 60)}</p><div>{same}</div><p>{own(5, 20)}</p>{f'<p>{quote}</p>' if k < 2 else ''}</article>") for k in range(9)]
    copies = [(30 + k, "http://c.x/", f"<article><p>{own(99, 50)}</p></article><p>{k}</p>") for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, plain + marked + copies)).collect()}
    assert got == {k: own(k) for k in range(6)} | {10 + k: f"{own(k, 60)} {own(5, 20)}" + (f" {quote}" if k < 2 else "") for k in range(9)} | {30 + k: own(99, 50) for k in range(4)}
    assert html_text.extract(pages_of(spark, plain), block_chars=100).count() == 6
    assert {r["text"] for r in html_text.extract(pages_of(spark, plain), block_chars=100).collect()} == {own(k) for k in range(6)}
    for _, url, page in plain + marked:
        zones, texts = zip(*html_text.blocks(page), strict=True)
        assert same in html_text.main_text(url, list(zones), list(texts), np.empty(0, np.uint64), np.empty(0, np.uint64))
    assert html_text.extract(pages_of(spark, [])).count() == 0


def test_html_names(spark):
    """Names that hold a chrome word among others drop nothing, whole chrome names do."""
    kept = [
        "<article><h1>t</h1><section class='related-work'><p>w</p></section></article>", "<article><h1>t</h1><div class='share-price'>w</div></article>",
        "<body><div class='page-header'><h1>t</h1></div><p>w</p></body>", "<div id='header-wrapper'><article>t <div class='social-history'>w</div></article></div>",
        "<div class='layout no-sidebar'><main>t w</main></div>", "<article><header><h1>t</h1></header><div class='article-header'>w</div></article>",
    ]
    lost = ["<article>t w<div class='comments'>x</div></article>", "<article>t w</article><div class='cookie-banner'>x</div>", "<article>t w<div class='big ad'>x</div></article>", "<aside><article>x</article></aside><article>t w</article>", "<article>t w<ul class='comment-list'><li>x</ul></article>"]
    rows = [(k, f"http://n{k}.x/", page) for k, page in enumerate(kept + lost)]
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, rows)).collect()} == {k: "t w" for k in range(len(rows))}


def test_html_elements_and_hints(spark):
    """Names count on every element, hidden parts go, words that also name parts of an article are hints."""
    page = "<article><h1>t</h1><p>w</p>{}<p>end</p></article>"
    lost = ["<p class='advertisement'>Buy now</p>", "<ul><li class='comment'>reader says</li></ul>", "<div style='color:red; display: none'>x</div>", "<p hidden>x</p>", "<p class=ad>x<b>y</b>", "<div aria-hidden='true'><p>x</p></div>", "<ul><li class='ad'>x<li class='promo'>y</ul>", "<dl><dt id=cookie-notice>x<dd class=newsletter>y</dl>"]
    kept = {"<div class='alert'><p>Storm alert body</p></div>": "Storm alert body", "<section class='search'><p>Binary search halves the range.</p></section>": "Binary search halves the range.", "<ul><li class='ad'>x<li>y</ul>": "y", "<p class='ad'>x<p>y</p>": "y", "<p data-hidden='x'>y</p>": "y", "<p class='lead'>y</p>": "y"}
    rows = [(k, f"http://e{k}.x/", page.format(x)) for k, x in enumerate([*lost, *kept])]
    want = ["t w end"] * len(lost) + [f"t w {x} end" for x in kept.values()]
    assert [r["text"] for r in html_text.extract(pages_of(spark, rows)).orderBy("page_id").collect()] == want
    # the evidence decides about a hint: an alert on many pages of the host goes
    same = " ".join(f"storm{k}" for k in range(20))
    alerts = [(k, "http://a.x/", f"<article><p>{own(k)}</p><div class='alert'><p>{same if k < 5 else own(100 + k)}</p></div></article>") for k in range(8)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages_of(spark, alerts)).collect()}
    assert got == {k: own(k) if k < 5 else f"{own(k)} {own(100 + k)}" for k in range(8)}


def test_html_layout(spark):
    """Repeated pages count once wherever their rows lie; any cut into blocks gives the same texts."""
    same = " ".join(f"notice{k}" for k in range(40))
    plain = [(k, "http://h.x/", f"<body><div>{same}</div><div>{own(k)}</div></body>") for k in (0, 0, 0, 1, 2, 3, 4, 5)]
    alone = [(20, "http://one.x/", f"<body><div>{same}</div><div>{own(20)}</div></body>")] * 3
    want = sorted([(k, own(k)) for k, *_ in plain] + [(20, f"{same} {own(20)}")] * 3)
    for parts, chars in ((1, 10**7), (1, 10), (3, 10), (8, 10**7), (8, 500)):
        got = html_text.extract(pages_of(spark, plain + alone).repartition(parts), block_chars=chars).collect()
        assert sorted((r["page_id"], r["text"]) for r in got) == want


def test_pii_classifier_decides(spark):
    """Matches that fail their check are candidates and refused, well-supported looser ones are added."""
    good = [f"mail a{k}@b.com, login from 10.0.0.{k}, card 4111 1111 1111 1111, call +1 212 555 01{k:02}" for k in range(40)]
    bad = [f"order 9999 8888 7777 {6000 + k} of build 1.2.{k}.999 and +12 345{k:02} end" for k in range(40)]
    bad = [x for x in bad if not any(base_spans(x, k) for k in pii.KINDS)]
    assert len(bad) > 30
    loose = "phone (212) 555-0199 now"
    table = [(k, t, "en", "a", 0, 7, 7, 7, 7) for k, t in enumerate([*good, *bad, *[loose] * 20, None])]
    found = {r["doc_id"]: r for r in pii.find_private(spark.createDataFrame(table, DOCS)).collect()}
    added = {i: [(x["s"], x["e"]) for k in pii.KINDS for x in r[f"added_{k}"]] for i, r in found.items()}
    at = len(good) + len(bad)
    assert [added.pop(at + k) for k in range(20)] == [[(6, 20)]] * 20
    assert not any(added.values())


def test_html_repeats():
    """Covered tokens by all pairs of windows."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b"], 60)) for _ in range(5)]
    texts = [f"{x} {texts[0]} z{k}" for k, x in enumerate(texts)]
    keys = [html_text.suffixes("http://h/", [x])[0] for x in texts]
    tally = Counter(k for x in keys for k in set(x.tolist()))
    words = [x.split() for x in texts]
    windows = [[tuple(w[i : i + html_text.DEPTH]) for i in range(len(w) - html_text.DEPTH + 1)] for w in words]
    for w, x, ws in zip(words, keys, windows, strict=True):
        hit = [sum(v in o for o in windows) >= 2 for v in ws]
        want = [any(hit[max(0, i - html_text.DEPTH + 1) : i + 1]) for i in range(len(w))]
        assert html_text.covered(np.array([tally[k] for k in x.tolist()]), 2, len(w)).tolist() == want
    anchors, pairs = [html_text.suffixes("http://h/", [x])[2].tolist() for x in texts], {}
    assert all(len(x) == len(ws) for x, ws in zip(anchors, windows, strict=True))
    assert all(pairs.setdefault(v, y) == y for x, ws in zip(anchors, windows, strict=True) for v, y in zip(ws, x, strict=True))  # equal suffixes have one anchor
    long = [str(k) for k in range(5000)]
    assert len(set(html_text.suffixes(None, [" ".join(long)])[2].tolist())) < 0.3 * len(long)


def test_quality_rules(docs, rows, nothing):
    def base(text):
        words = WORD.findall(text or "")
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        twice = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice), len(words) < 20 or 100 * len(twice) > 30 * len(words)

    got = quality_rules.quality_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r["doc_id"], *base(t)) for r, t in zip(({"doc_id": x[0]} for x in rows), (x[1] for x in rows), strict=True))
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.quality_rules(nothing).count() == 0


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = Counter()
    for i, text, *_ in rows:
        ids[i, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    got = packing.pack(docs).collect()
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    want = Counter()
    for (i, x), n in ids.items():
        for k, (s, m) in enumerate(packing.cut(len(x))):
            want[i, k, s, m, zlib.crc32(np.array(x[s : s + m], "<u4").tobytes())] += n
    assert pieces == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 2048) * 1.02 + 1
    assert packing.pack(nothing).count() == 0


def test_packing_added_tokens(spark, tmp_path):
    """Texts that hold the tokenizer's added tokens, and white space around blanks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y  z", "a  b \n c\t d", "<|endoftext", "it's 12 été 漢字"]
    got = {r["doc_id"]: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (got[k]["length"], got[k]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


@pytest.mark.parametrize("n", [0, 1, 300, 20000])
def test_packing_program(n):
    """Every piece is packed once, nearly all by the program, in about as few sequences as there can be."""
    sizes = np.minimum(np.exp(np.random.default_rng(n).normal(5.7, 1.1, n)).astype(int) + 1, 2048)
    counts = np.bincount(sizes, minlength=2049)
    plan, from_program = packing.planned(counts)
    packed = Counter()
    for configuration, copies in plan:
        assert copies > 0 and sum(k * m for k, m in configuration.items()) <= 2048
        for k, m in configuration.items():
            packed[k] += m * copies
    assert packed == Counter(sizes.tolist())
    tokens = lambda p: sum(k * m * c for x, c in p for k, m in x.items())
    assert sum(c for _, c in plan) <= max(math.ceil(sizes.sum() / 2048), sum(c for _, c in packing.best_fit(counts, 2048)))
    if n >= 300:
        assert tokens(plan[:from_program]) > 0.75 * tokens(plan)


@pytest.mark.parametrize(("sf", "most"), [("sf0.001", 96), ("sf0.01", 481), ("sf0.1", 4936)])
def test_packing_given_lengths(sf, most):
    """The lengths of the given tables: as few sequences as there can be, over 90 % of the tokens from the program."""
    import pyarrow.parquet as pq

    encoder = packing.Encoder(packing.default_tokenizer())
    texts = [x or "" for x in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    counts = np.zeros(2049, np.int64)
    for ids in encoder.encode(texts):
        for _, n in packing.cut(len(ids) // 4 + 1):
            counts[n] += 1
    plan, program = packing.planned(counts)
    assert sum(c for _, c in plan) == most
    tokens = lambda p: sum(k * m * c for x, c in p for k, m in x.items())
    assert tokens(plan[:program]) > 0.9 * tokens(plan)


def test_packing_knapsack():
    """Against all sequences of a small length."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        price = np.where(rng.random(13) < 0.6, rng.random(13), 0)
        price[0] = 0
        best = [0.0] * 13
        for room in range(1, 13):
            best[room] = max([best[room - 1], *(best[room - k] + price[k] for k in range(1, room + 1) if price[k] > 0)])
        value, choice = packing.best_fill(price, 12)
        assert value == pytest.approx(best)
        assert sum(price[k] * m for k, m in packing.configuration(12, [0] * 13, 12)) == price[12]


def test_mixing(docs, rows, nothing):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    ranked = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight, open_, aim, rest = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ranked)}, set(ranked), {}, 1.5 * sum(size)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        aim |= {s: 2.0 * total[s] for s in over} or {s: weight[s] * level for s in open_}
        rest -= sum(2 * total[s] for s in over)
        open_ = open_ - over if over else set()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=order) == sorted(map(tuple, mixing.mix(docs).collect()), key=order)
    source, taken, largest = {r[0]: r[3] for r in rows}, Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == total[s] and r["target"] == pytest.approx(aim[s])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in ranked:
        assert abs(taken[s] - aim[s]) <= largest[s] / 2 + 1e-6
    assert mixing.mix(nothing).count() == 0


def test_pipeline(spark, docs, nothing):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "pii", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, SF).columns == nothing.columns
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF).columns == docs.columns


def test_pipeline_mixing(spark, docs):
    """Each row comes as often as the mix takes it; nulls, repeated ids and equal rows included."""
    rows = [(None, "a b c", "s"), (-1, "a b c", "s"), (1, "x y", "s"), (1, "x z", "s"), (2, "q", None), (2, "q", None), (3, None, "s"), (3, "", "t"), *((k, f"w{k} " * 9, "s") for k in range(10, 60))]
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, _copy int, n int")
    out = mixing.resample(frame)
    assert out.columns == frame.columns
    got, given = Counter(tuple(r)[:3] for r in out.collect()), Counter(rows)
    assert all(got[r] <= 2 * n for r, n in given.items()) and set(got) <= set(given)
    size = lambda c, s: sum(n * len(WORD.findall(r[1] or "")) for r, n in c.items() if r[2] == s)
    aims = {r["size"]: r["target"] for r in mixing.mix(frame).collect() if r["doc_id"] in (2, 10)}
    assert abs(size(got, "s") - aims[9]) <= 4.5 + 1e-6 and abs(size(got, None) - aims[1]) <= 0.5 + 1e-6


def test_pipeline_run(spark, tmp_path, rows):
    """Every stage against brute force on what its predecessor kept, and run() against the stages."""
    frame = spark.createDataFrame(rows[:120], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    stages, state = dict(corpus_pipeline.STAGES), frame
    flagged = {(r[0], r[1]) for r in rows[:120]}
    kept = stages["quality rules"](spark, state, str(tmp_path)).cache()
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame).collect() if r["doc_id"] is not None}
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {x for x in flagged if x[0] is not None and verdict[x[0]]} | {(r["doc_id"], r["text"]) for r in kept.where("doc_id is null").collect()}
    single = stages["near-dedup"](spark, kept, str(tmp_path)).cache()
    clean = stages["pii"](spark, single, str(tmp_path)).cache()
    assert clean.count() == single.count() and not [r for r in clean.collect() if base_spans(r["text"], "email")]
    mixed = stages["mixing"](spark, clean, str(tmp_path)).cache()
    packed = stages["packing"](spark, mixed, str(tmp_path))
    want = Counter((r["doc_id"], r["ids_crc32"], r["length"]) for r in packed.collect())
    assert Counter((r["doc_id"], r["ids_crc32"], r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    assert sum(n * x[2] for x, n in want.items()) == sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_embeddings_double(spark):
    """Double components keep their precision and range."""
    x = np.random.default_rng(3).standard_normal((4, 8))
    v = np.concatenate([x, x * 1e200, x * 1e-200, x + 1e-9])
    frame = spark.createDataFrame([(k, y.tolist()) for k, y in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame).collect()}
    assert got == {k: (3, k % 4) for k in range(16)}


def linked(v, threshold=0.9):
    unit = v.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("kind", ["ball", "chain", "two balls"])
def test_embeddings_dense(spark, monkeypatch, kind):
    """Crowded regions, in buckets of several blocks: within one ball, wider than a ball, two balls that touch."""
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "CROWD", 16)
    rng, d = np.random.default_rng(8), 32
    axes = np.linalg.qr(rng.standard_normal((d, d)))[0]
    noise = rng.standard_normal((600, d)) * 0.002
    if kind == "ball":
        v = axes[0] + noise
    elif kind == "chain":  # an arc of 80 degrees
        angle = rng.uniform(0, 1.4, 600)
        v = np.cos(angle)[:, None] * axes[0] + np.sin(angle)[:, None] * axes[1] + noise
    else:
        far = math.acos(0.9) * 0.98
        v = np.where(rng.random(600)[:, None] < 0.5, axes[0], math.cos(far) * axes[0] + math.sin(far) * axes[1]) + noise
    v = np.concatenate([v, v[:20], rng.standard_normal((50, d))])
    near = linked(v)
    group = least(range(len(v)), roots(len(v), zip(*np.nonzero(near), strict=True)))
    frame = spark.createDataFrame([(k, y.tolist()) for k, y in enumerate(v.astype(np.float32))], "vec_id long, embedding array<float>").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame).collect()}
    assert [got[k][1] for k in range(len(v))] == [group[k] for k in range(len(v))]
    counts = np.array([got[k][0] for k in range(len(v))])
    assert (counts <= near.sum(1)).all() and counts.sum() >= 0.998 * near.sum()


def test_embedding_estimates():
    """Unbiased, and within the bound."""
    rng, d = np.random.default_rng(9), 64
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 20000, d)))
    y = 0.8 * x + 0.6 * y
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    (code, _, a), (_, planes, b) = embeddings.codes(x), embeddings.codes(y)
    guess, error = embeddings.estimates(code, a[:, 0], planes, b, d)
    off = guess - (x * y).sum(1)
    assert abs(off.mean()) < 0.003 and (np.abs(off) <= error).mean() > 0.9995
    assert error.max() < 0.6 and code.shape == (20000, 1) and planes.shape == (20000, embeddings.PLANES, 1)


def test_embedding_pairs_of_runs():
    """Against a double loop; each pair of a block with itself once, of two blocks from left to right."""
    rng = np.random.default_rng(10)
    run = np.sort(rng.integers(0, 40, 200))
    ball, kind = rng.integers(0, 6, 200), rng.integers(0, 3, 200)
    left, right = kind != 1, kind != 2
    got = sorted((int(i), int(j)) for a, b in embeddings.run_pairs(run, left, right, ball, 50) for i, j in zip(a, b, strict=True))
    want = []
    for i in range(200):
        for j in range(i + 1, 200):
            if run[i] == run[j] and ball[i] != ball[j] and (left[i] and right[j] or left[j] and right[i]):
                want.append((i, j) if left[i] and right[j] else (j, i))
    assert got == sorted(want)

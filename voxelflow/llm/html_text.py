"""HTML extraction by a host suffix array.

A page is read into blocks of text, each in a zone: the article that the page marks, plain page
text, text whose class or id only hints at page furniture, or chrome: parts whose markup says menu, header,
footer, sidebar, notice, advert, form or comment. Scripts, styles and the like are not text. The
token streams of all pages of a host form one sequence. Its suffixes are sorted by host and first
DEPTH tokens, so equal passages become neighbours; a maximal run of tokens whose suffixes have neighbours on other distinct
pages is a repeat of DEPTH tokens or more. Every suffix takes part. Sorting is shared out: a suffix
goes, as a hash of host and first DEPTH tokens, to the table partition that owns the hash, packed
and sorted with the others of its block of pages; the partition answers its blocks with the number
of pages of each repeated one. To carry little, suffixes are asked for in two steps. A suffix's
anchor is the run of ANCHOR of its DEPTH tokens with the smallest hash; equal suffixes have the
same anchor, and a text has a fifth as many different anchors as tokens. Only suffixes whose anchor repeats on MIN_PAGES
pages of the host are asked for themselves: no repeat is missed. A passage common to half of a host is one key of each block, so no
host is hot. Blocks hold about BLOCK_CHARS characters (a longer page is a block of its own).

What becomes of a repeat depends on its zone:

* plain text and hinted blocks: repeats on MIN_PAGES distinct pages go, unique runs stay; a hinted
  block goes whole where more than half of it is repeated;
* inside a marked article: repeats on HOST_SHARE of the host's distinct pages, MIN_IN_ARTICLE at
  least, go where they stand in bare containers (unmarked notices); headings, paragraphs, list
  items and the like are the article's own and stay, repeated or not, as do other repeats;
* where COPY_SHARE of a page's main text is repeated, the page is a copy of others, and its text
  stays whole;
* chrome goes though it is unique.

Defined cases: null and empty html give empty text; pages of no or equal url are separate pages, a
null url is a host; equal pages of a host count once as evidence, wherever their rows lie; an article
inside a wrapper with a chrome name is an article; broken or cut markup is read as far as it goes;
columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import html as html_module
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table
from .packed import pack, slices, unpack

DEPTH = 16
#: Tokens of an anchor.
ANCHOR = 8
MIN_PAGES = 2
HOST_SHARE, MIN_IN_ARTICLE = 0.25, 3
COPY_SHARE = 0.9
BLOCK_CHARS = 8_000_000
#: Share of suffixes that may share a hash with another; it sets the length of the hashes.
COLLIDING = 2.0**-24
#: Keys that one partition of the suffix table gets, about.
TABLE_KEYS = 1_000_000
#: Zones.
CHROME, PLAIN, ARTICLE, HINTED, PROSE = range(5)
#: Elements by their part in HTML.
_SKIP = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "select", "textarea", "button", "head", "canvas", "audio", "video"}
_CHROME_TAGS = {"nav", "footer", "aside", "form", "header", "dialog", "menu"}
_CONTAINERS = _CHROME_TAGS | {"article", "main", "section", "div", "body", "ul", "ol", "dl", "table", "figure", "blockquote", "details", "fieldset"}
_INLINE = {"a", "b", "i", "u", "s", "em", "strong", "span", "small", "big", "sub", "sup", "code", "kbd", "samp", "var", "abbr", "cite", "q", "mark", "time", "font", "tt", "ins", "del", "label", "bdi", "bdo", "data", "dfn", "wbr", "img", "acronym"}
_PROSE_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption"}
_CHROME_WORDS = set(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer colophon sidebar aside widget widgets related recommended recommendations share sharing social "
    "comment comments reply replies respond disqus discussion newsletter subscribe subscription signup login search toolbar pagination pager skip copyright disclaimer".split()
)
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
#: Of these, words that also name parts of an article: alone they are a hint, and evidence decides.
_EITHER_WORDS = set("alert copyright disclaimer discussion header masthead notification promotion recommended replies reply respond search toolbar".split())
#: Parts of names that add nothing to a chrome word beside them.
_NEUTRAL_WORDS = set("area bar block body bottom box btn button buttons col column container cta form global group icon icons inner item items left link links list main panel primary right row section site text top widget wrap wrapper".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?([a-z]+)""", re.I)
_BODY = re.compile(r"""\bitemprop\s*=\s*["']?articleBody""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|\Z)|\baria-hidden\s*=\s*["']?true|\bstyle\s*=\s*(?:"[^"]*|'[^']*|[^\s>"']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
#: Elements whose end is understood where one of the same set begins.
_SIBLINGS = [{"li"}, {"dt", "dd"}, {"td", "th"}, {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre"}]


def _named(names: str, within: int) -> int:
    """What class and id names say: CHROME if a whole name is made of chrome and neutral words, HINTED
    if a name holds a chrome word among others or is made of words that also name parts of an article."""
    found = within
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        chrome = [w for w in words if w in _CHROME_WORDS]
        if chrome and all(w in _CHROME_WORDS or w in _NEUTRAL_WORDS for w in words):
            if not set(chrome) <= _EITHER_WORDS:
                return CHROME
            if not (within == ARTICLE and set(chrome) <= {"header", "masthead"}):
                found = HINTED
        elif chrome:
            found = HINTED
    return found


def _zone(tag: str, attributes: str, within: tuple[int, bool]) -> tuple[int, bool]:
    """The zone that an element opens inside zone ``within``, and whether its markup itself, not
    just a name, makes it chrome: then nothing inside is anything else."""
    zone, firm = within
    role = _ROLE.search(attributes)
    role_name = role.group(1).lower() if role else ""
    if firm or _HIDDEN.search(attributes) or role_name in _CHROME_ROLES or tag in _CHROME_TAGS and not (tag == "header" and zone == ARTICLE):
        return CHROME, True
    if tag in ("article", "main") or role_name in ("main", "article") or _BODY.search(attributes):
        return ARTICLE, False
    if zone == CHROME or tag == "body":
        return zone, False
    return _named(" ".join("".join(x) for x in _NAMES.findall(attributes)), zone), False


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks of text in order, white space made one space. PROSE is a
    marked article's text in headings, paragraphs and the like."""
    page = page or ""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, tuple[int, bool]]] = []
    zone, parts, at, prose = (PLAIN, False), [], 0, False

    def close():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append((PROSE if prose and zone[0] == ARTICLE else zone[0], text))

    while True:
        m = _TOKEN.search(page, at)
        parts.append(html_module.unescape(page[at : m.start() if m else len(page)]))
        if not m:
            break
        at, tag = m.end(), (m.group(2) or "").lower()
        if not tag or tag in _INLINE:
            continue
        close()
        prose = tag in _PROSE_TAGS and not m.group(1) or prose and tag == "br"
        if not m.group(1) and stack and tag not in ("br", "hr") and (stack[-1][0] == "p" or any(tag in x and stack[-1][0] in x for x in _SIBLINGS)):
            zone = stack.pop()[1]
        if tag in _PROSE_TAGS and tag not in _CONTAINERS:
            # such an element opens a zone only where its markup says so
            if not m.group(1):
                inner = _zone(tag, m.group(3), zone) if m.group(3).strip() else zone
                if inner != zone:
                    stack.append((tag, zone))
                    zone = inner
            elif stack and stack[-1][0] == tag:
                zone = stack.pop()[1]
            continue
        if tag in _SKIP:
            if not m.group(1) and not m.group(3).endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?" + ("|(?=<body\\b)" if tag == "head" else ""), re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag in _CONTAINERS:
            if not m.group(1):
                stack.append((tag, zone))
                zone = _zone(tag, m.group(3), zone)
            elif any(t == tag for t, _ in stack):
                while stack:
                    t, zone = stack.pop()
                    if t == tag:
                        break
    close()
    return found


def host(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def _token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each text has, and the hashes of all tokens. Tokens stand one space apart."""
    parts = pc.split_pattern(pa.array([x for x in texts if x], pa.large_string()), " ")
    sizes = np.zeros(len(texts), np.int64)
    sizes[[k for k, x in enumerate(texts) if x]] = np.diff(parts.offsets.to_numpy())
    coded = parts.flatten().dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return sizes, hashes[coded.indices.to_numpy()]


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = keys * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(31))


@dataclass
class Suffixes:
    """The suffixes of some pages, one page after another. Of each suffix: its key (host and first
    DEPTH tokens, hashed), the key of its anchor, the token it begins at, its page; of each token: its
    block of text, counted over all pages; of each page: where its tokens begin, and the end."""

    keys: np.ndarray
    anchors: np.ndarray
    start: np.ndarray
    page: np.ndarray
    block: np.ndarray
    begins: np.ndarray


def all_suffixes(urls: list[str | None], texts: list[list[str]], bits: int = 64) -> Suffixes:
    """Of all pages at once; keys are hashed to ``bits`` bits."""
    sizes, ids = _token_hashes([text for page in texts for text in page])
    of_page = np.repeat(np.arange(len(texts)), [len(page) for page in texts])
    begins = np.concatenate([[0], np.cumsum(np.bincount(of_page, sizes, len(texts)).astype(np.int64))])
    page = np.repeat(np.arange(len(texts)), np.diff(begins))
    hosts = np.array([xxhash.xxh64_intdigest(host(url), 9) for url in urls], np.uint64)
    m = max(0, len(ids) - ANCHOR + 1)
    start = np.flatnonzero(np.arange(len(ids)) + DEPTH <= begins[1:][page]) if len(ids) else np.zeros(0, np.int64)
    runs = hosts[page[:m]] if m else np.zeros(0, np.uint64)
    for k in range(ANCHOR if len(start) else 0):
        runs = _mixed(runs ^ ids[k : k + m])
    keys, anchors = runs[start], runs[start]
    for k in range(1, DEPTH - ANCHOR + 1):
        keys = _mixed(keys ^ ids[start + (ANCHOR + k - 1)])
        anchors = np.minimum(anchors, runs[start + k])
    shift = np.uint64(64 - bits)
    return Suffixes(keys >> shift << shift, _mixed(anchors) >> shift << shift, start, page[start], np.repeat(np.arange(len(sizes)), sizes), begins)


def suffixes(url: str | None, texts: list[str], bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of one page's suffixes in order, which block each of its tokens lies in, and the keys of
    the suffixes' anchors."""
    found = all_suffixes([url], [texts], bits)
    return found.keys, found.block, found.anchors


def host_key(url: str | None) -> np.uint64:
    """The key under which a host's distinct pages are counted."""
    return np.uint64(xxhash.xxh64_intdigest(host(url), 11))


PAGES = "p long, page_id array<long>, url array<string>, zones array<array<int>>, texts array<array<string>>, marks array<long>, tokens long"
_PAGE_TYPES = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.string())), pa.list_(pa.int64()), pa.int64())


def mark(url: str | None, texts: list[str]) -> int:
    """What equal pages of a host share."""
    return xxhash.xxh64_intdigest("\0".join([host(url), *texts]), 13) - (1 << 63)


def _read(limit: int):
    """Blocks of the pages (page_id, url, html) of a partition, read into zones and texts."""

    def of(batches):
        first, k, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            columns = [list(x) for x in zip(*held, strict=True)]
            tokens = sum(x.count(" ") + 1 for texts in columns[3] for x in texts)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((first + k, *columns, tokens), _PAGE_TYPES, strict=True)], names=[x.split()[0] for x in PAGES.split(", ")])

        for batch in batches:
            for page_id, url, page in zip(*batch.columns[:3], strict=True):
                found = blocks(page.as_py())
                size = sum(len(x) for _, x in found)
                if held and n + size > limit:
                    yield block()
                    k, held, n = k + 1, [], 0
                texts = [x for _, x in found]
                held.append((page_id.as_py(), url.as_py(), [z for z, _ in found], texts, mark(url.as_py(), texts)))
                n += size
        if held:
            yield block()

    return of


def _rows(batch: pa.RecordBatch | pa.Table):
    for k in range(batch.num_rows):
        yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _weights(row: dict) -> np.ndarray:
    """What a block's pages count as evidence: of equal pages of a host one in the whole table counts,
    the others ask without counting."""
    out = np.ones(len(row["url"]), np.int64)
    out[row["copies"] or []] = 0
    return out


def _with_copies(found: DataFrame) -> DataFrame:
    """The blocks with ``copies``, the places of pages that repeat a page of the table that counts already."""
    marks = found.select("p", F.posexplode("marks").alias("i", "mark"))
    repeated = marks.groupBy("mark").agg(F.count("*").alias("n"), F.min(F.struct("p", "i")).alias("first")).where("n > 1").select("mark", "first")
    rest = marks.join(repeated, "mark").where(F.struct("p", "i") != F.col("first"))
    copies = rest.groupBy("p").agg(F.collect_list("i").alias("copies"))  # as many as the block has pages at most
    return found.join(materialize(copies, "copies").hint("shuffle_hash"), "p", "left")


def _requests(p: int, keys: np.ndarray, page: np.ndarray, weights: np.ndarray, buckets: int) -> dict[str, pa.Array]:
    """A block's keys by table partition, each counted once a page by the page's weight."""
    order = np.lexsort((keys, page))
    keys, page = keys[order], page[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (page[1:] != page[:-1])
    keys, at = np.unique(keys[first], return_inverse=True)
    counts = np.bincount(at, weights[page[first]], len(keys))
    at = slices(keys, buckets)
    full = np.flatnonzero(np.diff(at)).tolist()
    data = [full, [p] * len(full), [pack(keys[at[b] : at[b + 1]], True) for b in full], [pack(counts[at[b] : at[b + 1]].astype(np.uint64)) for b in full]]
    return {n: pa.array(c, t) for n, c, t in zip(("b", "p", "keys", "counts"), data, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)}


def _ask_anchors(buckets: int, bits: int):
    def of(batches):
        for batch in batches:
            for row in _rows(batch):
                found = all_suffixes(row["url"], row["texts"], bits)
                yield pa.RecordBatch.from_pydict(_requests(row["p"], found.anchors, found.page, _weights(row), buckets))

    return of


def _answered(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a block that other pages share, sorted, and on how many pages each is."""
    keys, pages = (np.concatenate([np.empty(0, np.uint64), *(unpack(x.as_py(), kind) for x in answers.column(c))]) for c, kind in (("shared", True), ("pages", False)))
    order = np.argsort(keys)
    return keys[order], pages[order]


def _ask_suffixes(blocks: pa.Table, answers: pa.Table, buckets: int, bits: int) -> pa.Table:
    """Asks for the suffixes whose anchor other pages share, and for each page's host key."""
    shared, _ = _answered(answers)
    none = np.zeros(0, np.int64)
    out = [pa.table(_requests(0, none.astype(np.uint64), none, none, buckets))]
    for row in _rows(blocks):
        found = all_suffixes(row["url"], row["texts"], bits)
        hit = np.zeros(len(found.keys), bool)
        if len(shared):
            hit = shared[np.minimum(np.searchsorted(shared, found.anchors), len(shared) - 1)] == found.anchors
        hosts = np.array([host_key(u) for u in row["url"]], np.uint64)
        out.append(pa.table(_requests(row["p"], np.concatenate([found.keys[hit], hosts]), np.concatenate([found.page[hit], np.arange(len(hosts))]), _weights(row), buckets)))
    return pa.concat_tables(out)


def _neighbours(rows: pa.Table) -> pa.Table:
    """Sorts the suffixes of one table partition; answers each block with those of its keys that
    MIN_PAGES distinct pages share, and how many do."""
    keys = [unpack(x.as_py(), True) for x in rows.column("keys")]
    counts = [unpack(x.as_py()).astype(np.int64) for x in rows.column("counts")]
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(u)).astype(np.uint64)[at]
    shared = total >= MIN_PAGES
    ends = np.cumsum([len(k) for k in keys])
    out = [[pack(x, kind) for x, kind in ((k[shared[e - len(k) : e]], True), (total[e - len(k) : e][shared[e - len(k) : e]], False))] for k, e in zip(keys, ends, strict=True)]
    return pa.table({"p": rows.column("p"), "shared": pa.array([x for x, _ in out], pa.binary()), "pages": pa.array([x for _, x in out], pa.binary())})


def covered(pages: np.ndarray, least: float | np.ndarray, n: int, start: np.ndarray | None = None) -> np.ndarray:
    """Which of n tokens lie in suffix windows that ``least`` pages or more have. pages: for each
    suffix, how many pages have it; start: where it begins (one at each token if not given)."""
    edges = np.zeros(n + 1, np.int64)
    hit = np.flatnonzero(pages >= least)
    hit = hit if start is None else start[hit]
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + DEPTH, -1)
    return np.cumsum(edges)[:n] > 0


def main_texts(urls: list[str | None], zones: list[list[int]], texts: list[list[str]], shared: np.ndarray, pages: np.ndarray, bits: int = 64) -> list[str]:
    """The pages' main texts. ``shared``: sorted keys of passages that other pages have as well,
    ``pages``: on how many."""
    found = all_suffixes(urls, texts, bits)
    times, of_host = np.zeros(len(found.keys), np.int64), np.ones(len(urls), np.int64)
    if len(shared):
        place = lambda x: np.minimum(np.searchsorted(shared, x), len(shared) - 1)
        at = place(found.keys)
        times = np.where(shared[at] == found.keys, pages[at], 0).astype(np.int64)
        hosts = np.array([host_key(u) for u in urls], np.uint64)
        at = place(hosts)
        of_host = np.where(shared[at] == hosts, pages[at], 1).astype(np.int64)
    n = len(found.block)
    repeated = covered(times, MIN_PAGES, n, found.start)
    least = np.maximum(MIN_IN_ARTICLE, HOST_SHARE * of_host)
    common = covered(times, least[found.page], n, found.start)
    starts = np.searchsorted(found.block, np.arange(sum(map(len, texts)) + 1))
    so_far = np.concatenate([[0], np.cumsum(repeated)])
    out, first = [], 0
    for k, (zone, text) in enumerate(zip(zones, texts, strict=True)):
        at, first = starts[first : first + len(text) + 1], first + len(text)
        out.append(_main(np.array(zone, np.int64), text, at, so_far, repeated, common))
    return out


def _main(zone: np.ndarray, texts: list[str], at: np.ndarray, so_far: np.ndarray, repeated: np.ndarray, common: np.ndarray) -> str:
    """One page's main text. at: where its blocks' tokens begin, and the end; so_far: repeated tokens before each."""
    marked = bool(((zone == ARTICLE) | (zone == PROSE)).any())
    wanted = (zone == ARTICLE) | (zone == PROSE) if marked else zone == PLAIN
    many = so_far[at[1:]] - so_far[at[:-1]]
    size = np.diff(at)
    hinted = zone == HINTED
    wanted = np.where(hinted, many <= 0.5 * size, wanted)
    gone = common if marked else repeated
    whole = size[wanted].sum() and many[wanted].sum() >= COPY_SHARE * size[wanted].sum()
    out = []
    for k in np.flatnonzero(wanted):
        lost = gone[at[k] : at[k + 1]]
        if whole or zone[k] == PROSE or not lost.any():
            out.append(texts[k])
        else:
            out += [w for w, x in zip(texts[k].split(), lost, strict=True) if not x]
    return " ".join(out)


def main_text(url: str | None, zones: list[int], texts: list[str], shared: np.ndarray, pages: np.ndarray, bits: int = 64) -> str:
    """One page's main text; see ``main_texts``."""
    return main_texts([url], [zones], [texts], shared, pages, bits)[0]


def _extract(blocks: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    keys, pages = _answered(answers)
    ids, urls, texts = [], [], []
    for row in _rows(blocks):
        ids += row["page_id"]
        urls += row["url"]
        texts += main_texts(row["url"], row["zones"], row["texts"], keys, pages, bits)
    return pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})


def extract(pages: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    lie = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(pages.select("page_id", "url", "html").mapInArrow(_read(block_chars), PAGES), "pages", "p", lie)
    tokens = found.agg(F.sum("tokens")).head()[0] or 0
    buckets = 1 << max(4, (tokens // TABLE_KEYS).bit_length())
    bits = min(64, math.ceil(math.log2(max(1, tokens) / COLLIDING)))
    asked, answer = "b long, p long, keys binary, counts binary", "p long, shared binary, pages binary"
    held = _with_copies(found)
    anchors = held.mapInArrow(_ask_anchors(buckets, bits), asked)
    anchors = materialize(anchors.groupBy("b").applyInArrow(_neighbours, answer), "anchors")
    repeats = held.groupBy("p").cogroup(anchors.groupBy("p")).applyInArrow(lambda blocks, answers: _ask_suffixes(blocks, answers, buckets, bits), asked)
    answers = materialize(repeats.groupBy("b").applyInArrow(_neighbours, answer), "shared")
    discard(anchors)
    return found.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(lambda blocks, answers: _extract(blocks, answers, bits), "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

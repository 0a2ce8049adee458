"""Main-text extraction from HTML as a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score above zero and tags below, each kind of tag, told apart by its class and
role words, by how much more often labelled pages show it outside their content than inside.  One linear scan finds the contiguous
stretch of greatest sum: the content region.  An advert or a comment inside the region is an element whose words labelled pages
never show as content; for kinds that no labelled page has, a prior speaks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, sampled

#: Expected bound of the labelled pages that weights are learned from.
LABELLED_PAGES = 3_000
#: Weights of a log-odds unit of a tag that are tried on the labelled pages, and the bounds of a word's and a tag's weight.
UNITS, WORD_RANGE, TAG_RANGE = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0), (0.5, 3.0), (-200.0, -0.05)
#: Weights of tags that no labelled page shows: inline tags, links, blocks, and what stands around an article.
UNSEEN_INLINE, UNSEEN_LINK, UNSEEN_BLOCK, UNSEEN_FRAME = -0.05, -1.5, -0.1, -60.0
#: Words that the prior counts for and against an element of a kind that is rarely content, and the log odds under which an element is none.
PRIOR, UNWANTED = 20.0, -2.0

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe xmp select svg canvas object audio video datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table caption tbody td tfoot th thead tr ul".split()
)
FRAMES = frozenset("article main body html section".split())
#: Elements that are text up to their own closing tag, or to the end of the page.
UNPARSED = frozenset("script style noscript textarea title iframe xmp".split())
#: Tags that say nothing of what they hold, so that only their class, id and role words speak.
CONTAINERS = frozenset("div span p section table tbody tr td ul ol li dl dd center font".split())
#: Tags of a page whose quotes do not pair up, after which quotes are no longer looked at there.
UNPAIRED = 64
#: Tags, and words of a class, id or role, whose elements are rarely content; what labelled pages show outweighs them.
RARELY_CONTENT = frozenset(
    "nav footer aside form button dialog menu "
    ".ad .ads .advert .advertisement .adverts .advertising .adsense .sponsor .sponsored .promo .cookie .cookies .consent .gdpr "
    ".popup .modal .overlay .newsletter .subscribe .signup .login .sidebar .breadcrumb .breadcrumbs .menu .navbar .navigation .nav "
    ".footer .pagination .toolbar .banner .contentinfo .complementary .search .dialog .alertdialog .menubar "
    ".comment .comments .commentlist .respond .reply .replies .disqus".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_MARKED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"/(\d+)(?:[./?#]|$)")

Events = list[tuple[str, str, str]]


@dataclass
class Model:
    """Weights of tags and words, and content and other words of elements by feature."""

    tags: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    elements: dict[str, tuple[int, int]] = field(default_factory=dict)


def events(page: str) -> Events:
    """(kind, name, attributes or text): kind is open, close or text.  Comments and declarations are left out; of raw elements only the tags.

    Linear in the page: no tag is looked for after the last ``>``, a script or the like that is not closed runs to the end, and after
    UNPAIRED tags with quotes that do not pair up quotes mean nothing.
    """
    out, at, last, unpaired, endless = [], 0, page.rfind(">") + 1, 0, set()
    while True:
        m = (_TAG if unpaired < UNPAIRED else _PLAIN_TAG).search(page, at, last)
        if not m:
            break
        if m.start() > at:
            out.append(("text", "", page[at : m.start()]))
        at = m.end()
        if unpaired < UNPAIRED:
            unpaired += m[5] is not None
            closing, name, rest = (m[4], m[5], m[6]) if m[5] else (m[1], m[2], m[3])
        else:
            closing, name, rest = m[1], m[2], m[3]
        if not name:
            continue
        name, rest = name.lower(), rest or ""
        out.append(("close" if closing else "open", name, rest))
        if not closing and name in RAW and name not in endless and not rest.endswith("/"):
            end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at, last)
            if end:
                out.append(("close", name, ""))
                at = end.end()
            elif name in UNPARSED:
                return out
            else:
                endless.add(name)  # none of its kind is closed from here on
    rest = page[at:].split("<!--", 1)[0]
    if rest:
        out.append(("text", "", rest))
    return out


def features(name: str, rest: str) -> list[str]:
    """What tells kinds of a tag apart: its name, and the words of its class, id and role after a point."""
    if not rest:
        return [name]
    out = [name]
    for m in _MARKED.finditer(rest):
        out += [f".{w}" for w in _PARTS.findall((m[2] or m[3] or m[4] or "").lower())]
    return out + ([".hidden"] if _HIDDEN.search(rest) else [])


def default_weight(tag: str) -> float:
    name = tag.lstrip("/")
    if name == "a":
        return UNSEEN_LINK
    return UNSEEN_FRAME if name in FRAMES else UNSEEN_BLOCK if name in BLOCKS else UNSEEN_INLINE


def tag_weight(kind: str, name: str, rest: str, tags: dict[str, float]) -> float:
    if kind == "close":
        return tags[f"/{name}"] if f"/{name}" in tags else default_weight(name)
    known = [tags[f] for f in features(name, rest) if f in tags]
    return min(known) if known else default_weight(name)


def shunned(found: Events, counts: dict[str, tuple[int, int]]) -> np.ndarray:
    """How many elements around each event are of a kind that labelled pages show to be no content."""
    out = np.zeros(len(found) + 1, np.int64)
    for i, j in elements(found).items():
        if content_odds(*found[i][1:], counts, 0.0) < UNWANTED:
            out[i + 1] += 1
            out[j] -= 1
    return np.cumsum(out)


def region(found: Events, tags: dict[str, float], word: float, counts: dict[str, tuple[int, int]], kept_out: np.ndarray | None = None) -> tuple[int, int]:
    """Begin and end of the events of greatest sum; of equal sums the first, and of those the longest.

    Words of an element whose kind labelled pages show to be no content score below zero.
    """
    kept_out = shunned(found, counts) if kept_out is None else kept_out
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, name, text) in enumerate(found):
        total += score(kind, name, text, tags, word, bool(kept_out[i]))
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def score(kind: str, name: str, text: str, tags: dict[str, float], word: float, kept_out: bool) -> float:
    """What an event adds to a stretch."""
    return (-word if kept_out else word) * len(text.split()) if kind == "text" else tag_weight(kind, name, text, tags)


def elements(found: Events) -> dict[int, int]:
    """Where each element that is closed begins and ends."""
    ends: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    for i, (kind, name, _) in enumerate(found):
        if kind == "open":
            stacks.setdefault(name, []).append(i)
        elif kind == "close" and stacks.get(name):
            ends[stacks[name].pop()] = i
    return ends


def content_odds(name: str, rest: str, counts: dict[str, tuple[int, int]], prior: float = PRIOR) -> float:
    """The log odds that an element's words are content: the least that a class, id or role word gives that is known, else what its name gives.

    A container's name says nothing: paragraphs stand in divs on one page and adverts on another.
    """
    own, *words = features(name, rest)

    def odds(f: str) -> float | None:
        seen, against = f in counts, prior if f in RARELY_CONTENT or f == ".hidden" else 0.0
        content, other = counts.get(f, (0, 0))
        return float(np.log((content + 1) / (other + against + 1))) if seen or against else None

    known = [x for x in map(odds, words) if x is not None]
    if not known and own not in CONTAINERS:
        known = [odds(own) or 0.0]
    return min([0.0, *known])


def content(found: Events, begin: int, end: int, counts: dict[str, tuple[int, int]]) -> Events:
    """A region without the elements whose words are no content; one that has half of the region's words is, and one that is never closed stays."""
    words = np.cumsum([0] + [len(text.split()) if kind == "text" else 0 for kind, _, text in found])
    dropped = np.zeros(len(found) + 1, np.int64)
    for i, j in elements(found).items():
        here = words[max(min(j, end), begin)] - words[min(max(i, begin), end)]
        if here and 2 * here < words[end] - words[begin] and content_odds(*found[i][1:], counts) < UNWANTED:
            dropped[i + 1] += 1
            dropped[j] -= 1
    inside = np.cumsum(dropped)
    return [found[i] for i in range(begin, end) if not inside[i]]


def block_text(found: list[tuple[str, str, str]]) -> str:
    """Blocks joined by one space; inside a block tags join what they part, and white space is one space."""
    blocks, now = [], []
    for kind, name, text in found:
        if kind == "text":
            now.append(html.unescape(text))
        elif name in BLOCKS:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return " ".join(" ".join(b.split()) for b in blocks if not b.isspace() and b)


def extract(page: str, model: Model) -> str:
    found = events(page)
    begin, end = region(found, model.tags, model.word, model.elements)
    return block_text(content(found, begin, end, model.elements))


def labelled(page: str, text: str) -> tuple[Events, int, int, np.ndarray] | None:
    """(events, first and last event of the content, how many of each event's words are content) of a page that shows a text.

    A word is content if it and two neighbours stand so in the text.  None if hardly any does.
    """
    found = events(page)
    words = text.split()
    grams = set(zip(words, words[1:], words[2:]))
    places, seen = [], []
    for i, (kind, _, own) in enumerate(found):
        if kind == "text":
            for w in html.unescape(own).split():
                places.append(i)
                seen.append(w)
    hits = [k for k, g in enumerate(zip(seen, seen[1:], seen[2:])) if g in grams]
    if len(hits) < 3:
        return None
    here = {j for k in hits for j in (k, k + 1, k + 2)}
    per_event = np.zeros(len(found), np.int64)
    np.add.at(per_event, [places[j] for j in here], 1)
    return found, places[hits[0]], places[min(hits[-1] + 2, len(places) - 1)], per_event


def labelled_counts(page: str, text: str) -> Counter:
    """How often each tag and words stand inside (+) and outside (-) of the content; and by feature the words of elements that are content (c) and others (o).

    Words that are no content count against the outermost element that has no content.
    """
    shown = labelled(page, text)
    out: Counter = Counter()
    if shown is None:
        return out
    found, begin, end, per_event = shown
    for i, (kind, name, own) in enumerate(found):
        side = "+" if begin <= i <= end else "-"
        if kind == "text":
            out[f"{side} word"] += len(own.split())
        else:
            for f in features(name, own) if kind == "open" else [f"/{name}"]:
                out[side + f] += 1
    all_words = np.cumsum([0] + [len(own.split()) if kind == "text" else 0 for kind, _, own in found])
    inside = np.concatenate(([0], np.cumsum(per_event)))
    outer = -1
    for i, j in sorted(elements(found).items()):
        n, c = int(all_words[j] - all_words[i]), int(inside[j] - inside[i])
        if c:
            for f in features(*found[i][1:]):
                out[f"c{f}"] += c
        elif n and i > outer:
            outer = j
            for f in features(*found[i][1:]):
                out[f"o{f}"] += n
    return out


def agreements(page: str, text: str, tried: list[dict[str, float]], word: float, counts: dict[str, tuple[int, int]]) -> list[float]:
    """The F1 of the scan's region with the content, in words, by each of several weights of the tags; the page is read once."""
    shown = labelled(page, text)
    if shown is None:
        return [0.0] * len(tried)
    found, _, _, per_event = shown
    kept_out, words = shunned(found, counts), np.cumsum([0] + [len(own.split()) if kind == "text" else 0 for kind, _, own in found])
    inside, out = np.cumsum(np.append(0, per_event)), []
    for tags in tried:
        begin, end = region(found, tags, word, counts, kept_out)
        out.append(2 * float(inside[end] - inside[begin]) / max(1.0, float(words[end] - words[begin]) + float(inside[-1])))
    return out


def fit(pages: DataFrame, documents: DataFrame, labelled_pages: int = LABELLED_PAGES) -> Model:
    """A model from pages whose url names, by its last number, the document that they show.

    At most about ``labelled_pages`` pages, by the hash of their id, are looked at.  Of the UNITS the first wins with which the scan agrees best
    with these pages' content.  Without any the weights are the defaults.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_extract("url", _NUMBER.pattern, 1).alias("number"), F.col("html").alias("page")).where("number != '' and page is not null")
    rows = sampled(rows, "page_id", labelled_pages, rows.count(), 11)
    rows = cut(rows.select(F.expr("try_cast(number as long)").alias("doc_id"), "page"))
    wanted = rows.select("doc_id").distinct()
    shown = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("shown")).where("shown is not null").join(F.broadcast(wanted), "doc_id")
    both = cut(rows.join(shown, "doc_id").select("page", "shown"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update(labelled_counts(page, text))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["item", "n"])

    # kinds of tags and class words: a bounded number of pages has a bounded number of them
    counts = {r.item: r.n for r in both.mapInArrow(run, "item string, n long").groupBy("item").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return Model()

    def odds(item: str) -> float:
        return float(np.log((counts.get(f"+{item}", 0) + 1) / (counts.get(f"-{item}", 0) + 1)))

    word = float(np.clip(odds(" word"), *WORD_RANGE))
    log_odds = {item[1:]: odds(item[1:]) for item in sorted(counts) if item[0] in "+-" and item[1:] != " word"}
    kinds = {f: (counts.get(f"c{f}", 0), counts.get(f"o{f}", 0)) for f in sorted({item[1:] for item in counts if item[0] in "co"})}
    tried = [{t: float(np.clip(unit * x, *TAG_RANGE)) for t, x in log_odds.items()} for unit in UNITS]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [agreements(page, text, tried, word, kinds) for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.float64()) for k in range(len(UNITS))], names=names)

    names = [f"u{k}" for k in range(len(UNITS))]
    sums = both.mapInArrow(compare, ", ".join(f"{n} double" for n in names)).agg(*[F.round(F.avg(n), 6) for n in names]).first()
    best = max(range(len(UNITS)), key=lambda k: (sums[k], -k))
    return Model(tried[best], word, kinds)


def main_texts(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row, from the whole html; a null or wordless page has an empty text.

    Null ids and urls stay null, repeated rows repeat; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [extract(t or "", model) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(list(map(len, made)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

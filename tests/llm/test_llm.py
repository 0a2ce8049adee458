"""Each operator against a brute-force form on a small table with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, decontaminate, language_id, lines, main_text, passages, pieces, quality, simhash, spotsigs, toxicity
from tidemark.llm.common import share_limit, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, line string, key string, component string"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with every odd case; the extra columns have names that the operators use inside."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("al", "be", "cor", "du", "en", "fi") for b in ("tan", "ver", "lo", "mis", "ker", "pa")]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " ", "\n\n", "Stop!", *base, base[0], base[0].replace("altan", "zzz", 1), base[1] + " the end", "\n".join(base[:3]), "x" * 500, "naïve café – 東京 \U0001f600", base[2].upper(), "a " * 3000]
    rows = [(i, t, "en", "s", len(t or ""), i, "l", "k", "c") for i, t in enumerate(texts)]
    rows += [rows[6], (None, base[3], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def closure(nodes, linked):
    """Least node reachable of each node, by union-find over all pairs."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    pairs = {(a, b) for a, b in edges if a is not None}
    want = closure({x for p in pairs for x in p if p[0] != p[1]}, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# op1


def test_spotsigs_edits_and_order(spark, docs, nothing):
    got = spotsigs.edited_and_next(docs).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.encoded(spotsigs.signatures(t)), spotsigs.encoded(spotsigs.signatures(edited))))
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == order(want)
    for r in got:
        a, b = (set(re.findall("." * 8, x)) for x in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert spotsigs.edited_and_next(nothing).count() == 0
    assert spotsigs.fingerprints(nothing).count() == 0


def test_signatures_are_chains_after_anchors():
    rng = random.Random(2)
    anchors = sorted(spotsigs.ANCHORS)
    for n in (0, 1, 5, 40, 300):
        words = [rng.choice(anchors) if rng.random() < 0.3 else "".join(rng.choice("bcdfg") for _ in range(4)) for _ in range(n)]
        words[n // 2 : n // 2] = ["q" + c for c in "abcdefghijklmnopqrstuv"]  # a stretch without anchors
        chains, last = [], None
        for i, w in enumerate(words):
            if w in anchors:
                last = i
            content = [x for x in words[i:] if x not in anchors]
            since = sum(x not in anchors for x in words[(last if last is not None else 0) : i])
            if w in anchors:
                chains.append((w, *content[: spotsigs.CHAIN]))
            elif last is None or since >= spotsigs.GAP:
                chains.append(("", *content[: spotsigs.CHAIN]))
        times = Counter(chains)
        want = {xxhash.xxh32_intdigest(" ".join(c), k) for c, m in times.items() for k in range(m)}
        assert set(spotsigs.signatures(" ".join(words)).tolist()) == want


def test_spotsigs_near_duplicates(spark, docs, nothing):
    assert spotsigs.near_duplicates(nothing).count() == 0
    known = {r.doc_id: set(spotsigs.signatures(r.text or "").tolist()) for r in docs.collect() if r.doc_id is not None}
    alike = lambda a, b: known[a] == known[b] or (known[a] and known[b] and len(known[a] & known[b]) >= 0.8 * len(known[a] | known[b]))
    want = closure(known, alike)
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(docs.where("doc_id is not null")).collect()}
    assert got == want


def test_spotsigs_near_duplicates_on_the_documents(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    known = {r.doc_id: set(spotsigs.signatures(r.text).tolist()) for r in rows}
    want = closure(known, lambda a, b: 5 * len(known[a] & known[b]) >= 4 * len(known[a] | known[b]))
    assert {r.doc_id: r.component_id for r in spotsigs.near_duplicates(table(spark, SF, "documents")).collect()} == want


# op2


def language_model(spark, rows):
    """The arrays, and a brute-force probability function by language, of (lang, text) rows."""
    counts = language_id._counts(spark.createDataFrame([(a, b, False) for a, b in rows], "lang string, text string, aside boolean")).select("lang", "key", "n")
    langs = sorted({a for a, _ in rows})
    symbols = {a: [] for a in langs}
    for lang, text in rows:
        letters = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
        symbols[lang].append(("\0" * 3, letters + " " if letters else ""))

    def brute(lang):
        grams = [Counter() for _ in range(5)]
        for head, text in symbols[lang]:
            text = head + text.replace(" ", "\0")
            grams[4].update(text[i - 3 : i + 1] for i in range(3, len(text)))
        for k in (3, 2, 1):
            grams[k] = Counter(g[1:] for g in grams[k + 1])
        alphabet = len({g for x in langs for h, t in symbols[x] for g in (t.replace(" ", "\0"))})

        def p(gram):
            if not gram:
                return 1 / (alphabet + 1)
            own = grams[len(gram)]
            beside = [n for g, n in own.items() if g[:-1] == gram[:-1]]
            if not beside:
                return p(gram[1:])
            return max(own[gram] - language_id.DISCOUNT, 0) / sum(beside) + language_id.DISCOUNT * len(beside) / sum(beside) * p(gram[1:])

        return p

    return counts, langs, {x: brute(x) for x in langs}


def test_language_models_are_kneser_neys(spark):
    rng = random.Random(14)
    rows = [(lang, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(30))) for lang, letters in (("a", "abcde"), ("b", "bcdef"), ("a", "abxyz")) for _ in range(6)]
    counts, langs, brute = language_model(spark, rows)
    arrays = language_id._arrays(counts, langs, language_id.MODEL_CELLS)
    texts = [t for _, t in rows[::3]] + ["abc zzz", "fade"]
    for text in texts:
        keys = language_id.ngrams([text], language_id.letter_table())[0]
        got = language_id.log_probabilities(arrays, keys)
        for key, row in zip(keys.tolist(), got):
            gram = "".join(chr(key >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0))
            assert np.allclose(row, [np.log(brute[x](gram)) for x in langs], atol=1e-4)
    # with all n-grams and with 40 % of them the probabilities of a context sum to one in each language
    whole = sum(len(g[0]) for g in arrays["grams"])
    some = language_id._arrays(counts, langs, int(0.4 * whole * len(langs)))
    assert sum(len(g[0]) for g in some["grams"]) <= 0.4 * whole
    symbols = np.array([0, *sorted({ord(c) for _, t in rows for c in t if c.isalpha()}), 0x7A7A], np.uint64)
    for a in (arrays, some):
        for context in {int(k) >> 16 for t in texts for k in language_id.ngrams([t], language_id.letter_table())[0]}:
            sums = np.exp(language_id.log_probabilities(a, (np.uint64(context) << np.uint64(16)) | symbols)).sum(axis=0)
            assert np.allclose(sums, 1.0, atol=1e-4)
    small = language_id._arrays(counts, langs, 400)  # a pruned model still tells them apart
    assert sum(len(g[0]) for g in small["grams"]) <= 200
    h = language_id.cross_entropies(small, [t for _, t in rows], language_id.letter_table())
    full = language_id.cross_entropies(arrays, [t for _, t in rows], language_id.letter_table())
    wanted = np.array([langs.index(x) for x, _ in rows])
    assert (full.argmin(axis=1) == wanted).all() and (h.argmin(axis=1) == wanted).mean() >= 0.9


def test_samples_do_not_vanish():
    for n in (10**5, 10**9, 10**11, 10**14):
        limit = share_limit(4_000, n)
        assert 3_999 <= limit * n / 2**63 <= 4_001


def test_language_probabilities_sum_to_one():
    symbols = letters = language_id.letter_table()
    keys, count = language_id.ngrams(["abra kadabra", "", "!?", "bar"], letters)
    assert count.tolist() == [13, 0, 0, 4] and len(keys) == 17
    levels, (now, n) = [], np.unique(keys, return_counts=True)
    for k in (3, 2, 1, 0):
        owner, at = np.unique(now >> np.uint64(16), return_inverse=True)
        levels.append((now, n, np.bincount(at, n)[at]))
        now, n = np.unique(now & np.uint64((1 << 16 * k) - 1), return_counts=True)
    model = language_id.KneserNey(levels, alphabet=8)
    inventory = np.array([0, *map(ord, "abrkd")], np.uint64)
    for context in ("abr", "zzz", "kad"):
        head = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        total = model.probability(np.uint64(head) | inventory).sum()
        # three of the nine symbols that uniform mass is spread over stand for what was never seen
        rest = 3 * model.probability(np.array([head | 0x7A7A], np.uint64))[0]
        assert total + rest == pytest.approx(1.0)
    arrays = language_id.shared_arrays([model])
    every = np.concatenate((keys, keys ^ np.uint64(1), keys ^ np.uint64(5 << 48)))
    assert np.allclose(language_id.log_probabilities(arrays, every)[:, 0], np.log(model.probability(every)), atol=1e-5)
    assert symbols[ord("É")] == ord("é") and symbols[ord("7")] == 0


def test_language_accuracy_and_odd_rows(spark, docs, nothing):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(d, ~language_id.held_out())
    got = language_id.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.98
    odd = {(r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (None, "und")} <= odd and language_id.predict(docs, model).count() == docs.count()
    assert language_id.fit(nothing) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0


# op3


def test_pieces_are_those_of_the_library(spark, docs, nothing):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.read_model()
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "two  blanks ▁ here\ttab 12345 don't"), (901, "y" * 300 + " " + "ab" * 90)], "doc_id long, text string"))
    got = pieces.encode(both, model).select("doc_id", "ids", pieces.decode(F.col("ids"), model).alias("back")).collect()
    want = Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in both.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    texts = Counter((r.doc_id, (r.text or "").replace("▁", " ")) for r in both.collect())
    assert Counter((r.doc_id, r.back) for r in got) == texts
    assert pieces.encode(nothing, model).count() == 0


def test_viterbi_fold_is_the_best_path(spark):
    rng = random.Random(2)
    normal = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))).lstrip("▁") or "▁" for _ in range(40)} | {"▁", "a", "b"})
    normal = [p for p in normal if "▁" not in p[1:]]
    model = pieces.Pieces(pieces.UNIGRAM, [(p, i + 1, -rng.randint(1, 50) / 4) for i, p in enumerate(normal)], [-1] * 256, 0, [b""] + [p.encode() for p in normal])
    scores = {p: s for p, _, s in model.normal}
    words = sorted({"▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)}) + ["▁" + "abcab" * 20]
    got = {r.word: r.ids for r in pieces.segment(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}

    def best(word):
        table_, least = [(0.0, [])], min(scores.values()) - 10
        for e in range(1, len(word) + 1):
            table_.append(max((table_[s][0] + scores.get(word[s:e], least), table_[s][1] + [word[s:e]]) for s in range(e) if word[s:e] in scores or e - s == 1))
        return table_[-1][0]

    spelled = {i: p for p, i, _ in model.normal}
    for w in words:
        parts = pieces.best_path(w, scores, model.longest)
        assert "".join(parts) == w and sum(scores.get(p, min(scores.values()) - 10) for p in parts) == pytest.approx(best(w))
        ids = {p: i for i, p in spelled.items()}
        assert got[w] == [ids.get(p, 0) for p in parts]


@pytest.mark.parametrize("ordered", [True, False])
def test_merge_fold_is_best_first_merging(spark, ordered):
    rng = random.Random(11)
    found, pieces_ = ["a", "b", "c", "▁"], set()
    while len(pieces_) < 40:  # each piece is merged from earlier ones, as in training
        x, y = rng.choice(found), rng.choice(found)
        if "▁" not in y and len(x + y) < 9:
            pieces_.add(x + y)
            found.append(x + y)
    normal = ["a", "b", "▁", *dict.fromkeys(p for p in found if len(p) > 1)]
    rank = {p: i for i, p in enumerate(normal)} if ordered else {p: rng.randrange(30) for p in normal}
    model = pieces.Pieces(pieces.BPE, [(p, i + 1, -float(rank[p])) for i, p in enumerate(normal)], [-1] * 256, 0, [b""] + [p.encode() for p in normal])
    scores, ids = {p: s for p, _, s in model.normal}, {p: i for p, i, _ in model.normal}
    assert ordered or not pieces.in_rank_order(model)
    words = sorted({"▁" + "".join(rng.choice("aabbcd") for _ in range(rng.randint(0, 14))) for _ in range(150)} | set(normal))
    got = {r.word: r.ids for r in pieces.segment(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    assert got == {w: [ids.get(p, 0) for p in pieces.merged(w, scores)] for w in words}
    d = spark.createDataFrame([(i, " ".join(w.lstrip("▁") for w in words[i::7])) for i in range(7)], "doc_id long, text string")
    split = re.compile(model.word)
    want = {r.doc_id: [ids.get(p, 0) for w in split.findall("▁" + r.text.replace(" ", "▁")) for p in pieces.merged(w, scores)] for r in d.collect()}
    assert {r.doc_id: r.ids for r in pieces.encode(d, model).collect()} == want


def test_merging_with_a_heap_is_merging_by_hand():
    scores = {p: s for p, _, s in pieces.read_model().normal}
    for word in ("▁internationalisation", "aaaaaaaa", "▁Straßenbahn", "ba" * 30):
        assert pieces.merged_long(word, scores) == pieces.merged(word, scores)


# op4


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><p>yes\n  it <b>i</b>s</p>", "yes it is"),
        ("<html><body><nav><a href=/>Home</a></nav><header>Site</header><article><header><h1>T</h1></header><p>One.<p>Two<br>three</p><div class='ad'>Buy</div><p>Four</p></article><section id=comments><article class=comment><p>nice post</p></article></section><aside>side</aside><footer>&copy;</footer></body></html>", "T One. Two three Four"),
        ("<div id='cookie-notice'>We use cookies</div><div class='content with-sidebar'><h1>Head</h1><p>Body text here</p></div><form><label>Name</label></form>", "Head Body text here"),
        ("<!-- <p>hidden</p> --><p>a&nbsp;b</p><p", "a b <p"),
        ("<p>a</p><script>function go() { return 1 }", "a"),
        ("<p>a</p><svg><path d=1><p>an svg that is not closed</p>", "a an svg that is not closed"),
        ("<p>a</p><!-- never closed b", "a"),
        ("<p title='>'>a</p><p>it's <b id='x>b</b></p><p>c</p>", "a it's b c"),
        ("<nav>never closed <p>and so kept</p>", "never closed and so kept"),
    ],
)
def test_main_text_cases(page, text):
    assert main_text.extract(page or "", main_text.Model()) == text


def test_main_text_finds_the_articles(spark):
    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in main_text.main_texts(pages, main_text.fit(pages, table(spark, SF, "documents"))).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        assert got[r.page_id] == " ".join(b for b in blocks if b)
    none = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    assert main_text.main_texts(none, main_text.fit(none, table(spark, SF, "documents"))).collect()[0][2:] == ("", 0)
    assert main_text.main_texts(none.limit(0), main_text.Model()).count() == 0


def test_the_scan_finds_content_without_semantic_tags(spark):
    """Pages without article, nav or footer elements, in layouts that the prior does not know: weights and kinds are learned from others."""
    rng = random.Random(21)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(n))
    rows, shown = [], []
    for i in range(400):
        title, paragraphs = words(5), [words(rng.randint(20, 60)) for _ in range(rng.randint(2, 8))]
        links = "".join(f'<li><a href="/{k}">{words(1)}</a></li>' for k in range(8))
        inner = [f"<p>{p}</p>" for p in paragraphs]
        inner.insert(1, f'<div class="zork">{words(6)}</div>')
        body = f'<div class="topbox"><ul>{links}</ul></div><div class="quux">{words(9)}</div><div class="story"><h1>{title}</h1>{"".join(inner)}</div><div class="voices"><p>{words(12)}</p></div><div class="bottom">{words(6)}</div>'
        rows.append((i, f"http://x.example/{i}", f"<html><body>{body}</body></html>"))
        shown.append((i, " ".join([title, *paragraphs])))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    learned = pages.where("page_id < 200")
    model = main_text.fit(learned, spark.createDataFrame(shown, "doc_id long, text string"))
    clashing = pages.selectExpr("*", "'x' as text", "1 as n_chars", "2 as doc_id", "'y' as page")
    assert main_text.fit(clashing.where("page_id < 200"), spark.createDataFrame([(i, t, "z") for i, t in shown], "doc_id long, text string, page string")) == model
    got = {r.page_id: r.text for r in main_text.main_texts(clashing, model).collect()}
    assert sum(got[i] == t for i, t in shown if i >= 200) >= 198


def test_elements_of_unknown_classes_stay(spark):
    """A class word that no labelled page has, and plain containers, are no reason to drop what the region holds."""
    model = main_text.Model({"p": -0.1, "div": -0.2, "/p": -0.05, "/div": -0.05}, 1.0, {"div": (0, 5_000), "p": (900, 3), ".quux": (0, 400)})
    inner = "<p>" + "word " * 30 + "</p>"
    page = f'<div>{inner}<div class="zork"><p>an odd class</p></div><div><p>plain</p></div><div class="quux">buy</div>{inner}</div>'
    assert main_text.extract(page, model) == " ".join(["word"] * 30 + ["an odd class plain"] + ["word"] * 30)


def test_events_are_linear():
    import time

    for piece in ("<a ", "<a href='", "<a \"' ", "<!", "<!-- ", "</script ", "<script>", "<svg>", "<a '\">", "<a \"\" '>", "<p>"):
        page = piece * (1_000_000 // len(piece))
        for end in ("", ">", "'>"):
            began = time.perf_counter()
            main_text.events(page + end)
            assert time.perf_counter() - began < 4, piece


def test_region_is_the_best_of_all_stretches():
    rng = random.Random(31)
    tags = {"p": -1.5, "/p": -0.5, "b": -0.25, "/b": -0.25, ".ad": -3.0}
    for _ in range(60):
        page = "".join(rng.choice(["<p>", "</p>", "<b>", "</b>", "<i class=ad>", "one two ", "three ", "a b c d e "]) for _ in range(rng.randrange(14)))
        found = main_text.events(page)
        worth = [main_text.score(*e, tags, 1.0, False) for e in found]
        sums = {(i, j): sum(worth[i:j]) for i in range(len(found)) for j in range(i + 1, len(found) + 1)}
        begin, end = main_text.region(found, tags, 1.0, {})
        assert sum(worth[begin:end]) == pytest.approx(max([0.0, *sums.values()]))


def test_the_scan_decides_on_the_pages(spark):
    """With the prior gone, what labelled pages teach is enough."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    model = main_text.fit(pages.where("page_id % 2 = 0"), table(spark, "/root/testdata/sf0.01", "documents"))
    rows = pages.where("page_id % 2 = 1").collect()
    right = 0
    for r in rows:
        found = main_text.events(r.html)
        begin, end = main_text.region(found, model.tags, model.word, model.elements)
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        right += main_text.block_text(found[begin:end]) == main_text.block_text(main_text.events(inner))
    assert right >= 0.99 * len(rows)


# op5


def brute_simhash(text):
    parts = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or [" ".join(parts)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_simhash_classes(spark, docs, which):
    d = docs if which == "odd" else table(spark, SF, "documents")
    rows = [(r.doc_id, brute_simhash(r.text)) for r in d.collect()]
    prints = {f for _, f in rows}
    root = closure(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(d).collect())
    assert got == Counter((i, f, least.get(root[f])) for i, f in rows)


def test_simhash_links_of_close_bits(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for s in seeds for _ in range(25)})
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    got = {r.node % 2**64: r.component % 2**64 for r in components.connected_components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    want = closure(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups({p: got.get(p, p) for p in prints}) == groups(want)


def test_simhash_keeps_one_of_each_group(spark, docs, nothing):
    kept = simhash.keep_one(docs).collect()
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.where("doc_id is not null")).collect()}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for c in found.values()})
    assert simhash.keep_one(nothing).columns == nothing.columns and simhash.keep_one(nothing).count() == 0


# op6, op9


def area(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2) if len(pos) and len(neg) else 1.0


def test_word_vectors_and_pooling_by_the_definition(spark, docs):
    """Context sums, their centring, pooling and the network's slope against plain loops."""
    texts = [r.text or "" for r in docs.collect()]
    places, signs = quality.index_vectors()
    assert all(len(set(p)) == quality.NONZEROS for p in places[:500].tolist()) and not signs.sum(axis=1).any()
    slots, want = quality.Slots(), {}
    for t in texts:
        ids = slots.of(t).tolist()
        for i, a in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                v = want.setdefault(a, np.zeros(quality.DIMENSIONS))
                v[places[ids[j]]] += signs[ids[j]]
    vectors = {a: v / max(np.linalg.norm(v), 1e-12) for a, v in want.items()}
    mean = np.mean([v for a, v in vectors.items() if want[a].any()], axis=0)
    got = quality.word_vectors(docs.select("doc_id", F.coalesce("text", F.lit(""))))
    for a, v in vectors.items():
        assert got[a] == pytest.approx(v - (mean if want[a].any() else 0), abs=1e-5)
    ids = slots.of("the cat and the dog.")
    x = quality.pooled(ids, got)
    assert x[:-1] == pytest.approx(sum(got[i] for i in ids) / len(ids), abs=1e-6) and x[-1] == pytest.approx(len(set(ids.tolist())) / math.sqrt(len(ids)))
    assert not quality.pooled(ids[:0], got).any()
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = (np.tanh(x[:, 0] * 2) + x[:, 1] > 0).astype(float)
    net = quality.train(x, y)
    p = quality.probabilities(net, x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.9 and -np.mean(np.where(y == 1, np.log(p), np.log(1 - p))) < 0.3


def test_a_long_text_is_parted(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 50)
    ids = quality.Slots().of("a b c d e " * 40)
    places, signs = quality.index_vectors()
    want = sum(quality.context_sums(ids[i : i + 50], np.array([min(50, len(ids) - i)]), places, signs) for i in range(0, len(ids), 50)).reshape(quality.SLOTS, -1)
    assert {quality.Slots()[w] for w in "abcde"} == set(np.flatnonzero(want.any(axis=1)).tolist())


@pytest.mark.parametrize("operator, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_classifiers_on_held_out_labels(spark, docs, nothing, operator, label, least):
    sf = "/root/testdata/sf0.1"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = operator.fit(d, labels, ~operator.held_out())
    got = operator.scores(d, model).join(labels, "doc_id").where(operator.held_out()).toPandas()
    assert area(got.score.to_numpy(), got[label].to_numpy()) > least
    odd = operator.scores(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert operator.scores(nothing, model).count() == 0
    none = operator.fit(docs, labels.limit(0))
    assert len({r.score for r in operator.scores(docs, none).collect()}) == 1


def test_toxic_rows_aside_are_found(spark):
    """Held-out recall on the larger table: of the toxic rows those that hold a toxic word (87 of 97), hardly any other."""
    d, marks = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(d, marks, ~toxicity.held_out())
    aside = toxicity.scores(d, model).where(toxicity.held_out()).join(marks, "doc_id")
    found, toxic, wrong, others = aside.agg(*[F.count_if(F.expr(c)) for c in ("toxic = 1 and predicted = 1", "toxic = 1", "toxic = 0 and predicted = 1", "toxic = 0")]).first()
    assert found >= 0.88 * toxic and wrong <= 0.02 * others


def test_the_negative_risk_is_not_fitted_below_nothing():
    rng = np.random.default_rng(0)
    rows = [np.array([0] if i < 30 else [], np.int64) for i in range(40)] + [np.array([0] if i < 20 else [1], np.int64) for i in range(200)]
    weights, bias = toxicity.train(rows, np.arange(240) < 40, 2, 0.1)
    score = lambda z: 1 / (1 + np.exp(-z))
    assert score(bias + weights[0]) > 0.5 > score(bias + weights[1]) and rng is not None


# op7


def test_passages_cover_repeated_runs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(60)]
    texts = []
    for i in range(12):
        body = [word() for _ in range(150)]
        if i % 3 == 0:
            edited = [w if rng.random() > 0.04 else word() for w in shared]
            at = rng.randrange(100)
            body[at:at] = edited
        texts.append(" ".join(body))
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[1]), (51, None), (52, ""), (None, texts[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.source_id): r for r in passages.repeated_passages(d).collect()}
    assert set(got) == {(3, 0), (6, 0), (9, 0), (50, 1)}
    assert got[(50, 1)].end == len(texts[1]) and got[(50, 1)].identity == 1
    for key in ((3, 0), (6, 0), (9, 0)):
        r = got[key]
        assert 50 <= r.n_words <= 64 and r.identity >= 0.8
        assert len(set(texts[r.doc_id][r.start : r.end].split()) & set(shared)) >= 45
    assert passages.repeated_passages(d.limit(0)).count() == 0


def test_passages_are_found_beyond_the_first_document(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    run, other, third = fill(60), fill(60), fill(60)
    texts = {
        1: fill(50) + run[:30] + fill(50),
        5: fill(50) + run[30:] + fill(50),
        7: fill(50) + run + fill(50),
        9: fill(50) + run + fill(50),
        # the run's parts come first elsewhere in the source
        20: fill(20) + other[:25] + fill(30) + other[35:] + fill(30) + other + fill(20),
        21: fill(40) + other + fill(40),
    }
    for i in range(30):  # parts of a run in many documents, the whole in two
        at = rng.randrange(30)
        texts[30 + i] = fill(40) + third[at : at + 30] + fill(40)
    texts[70], texts[71] = fill(40) + third + fill(40), fill(40) + third + fill(40)
    got = passages.repeated_passages(spark.createDataFrame(list({i: " ".join(t) for i, t in texts.items()}.items()), "doc_id long, text string")).collect()
    covered = {i: set() for i in texts}
    for r in got:
        at = 0
        for k, w in enumerate(texts[r.doc_id]):
            if r.start <= at and at + len(w) <= r.end:
                covered[r.doc_id].add(k)
            at += len(w) + 1
    want = {i: set() for i in texts}
    for i, t in texts.items():  # brute force over all pairs: runs of MIN_WORDS words in common
        for n in range(len(t) - passages.MIN_WORDS + 1):
            x = t[n : n + passages.MIN_WORDS]
            if any(texts[j][m : m + passages.MIN_WORDS] == x for j in texts if j < i for m in range(len(texts[j]))):
                want[i] |= set(range(n, n + passages.MIN_WORDS))
    assert {i for i in want if want[i]} == {9, 21, 71}
    assert all(want[i] <= covered[i] for i in texts)
    assert {i for i in covered if covered[i]} == {9, 21, 71}


def words_covered(texts, found):
    covered = {i: set() for i in texts}
    for r in found:
        at = 0
        for k, w in enumerate(texts[r.doc_id]):
            if r.start <= at and at + len(w) <= r.end:
                covered[r.doc_id].add(k)
            at += len(w) + 1
    return covered


def test_passages_whose_parts_come_first_elsewhere(spark):
    """Two documents share a run; every part of it of up to 38 words comes first in some other document."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    texts, runs = {}, [fill(120) for _ in range(3)]
    for n, run in enumerate(runs):
        for size in (12, 25, 38):
            for at in range(0, 121 - size, 3):
                texts[1000 * n + 10 * at + size // 12] = fill(20) + run[at : at + size] + fill(20)
    for n, run in enumerate(runs):
        texts[9000 + n], texts[9100 + n], texts[9200 + n] = fill(30) + run + fill(30), fill(5) + run[:80] + fill(50), fill(33) + run[30:] + fill(4)
    d = spark.createDataFrame([(i, " ".join(t), 1, 2) for i, t in texts.items()], "doc_id long, text string, hash long, pos int")
    covered = words_covered(texts, passages.repeated_passages(d).collect())
    for n in range(3):
        assert len(covered[9100 + n] & set(range(5, 85))) >= 78 and len(covered[9200 + n] & set(range(33, 123))) >= 88
    assert not any(covered[i] for i in texts if i < 9000)


@pytest.mark.parametrize("rivals", [0, 6])
def test_recall_of_edited_passages(spark, rivals):
    """Passages of 60 words with each word replaced at a rate; before each one ``rivals`` documents that hold a phrase of 20 of its words."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    texts, planted, recall = {}, {}, {}
    for k, rate in enumerate((0.0, 0.03, 0.06, 0.1)):
        for n in range(60):
            run = fill(60)
            i = 1000 * k + 10 * n
            for r in range(rivals):
                at = min(40, 10 * r)
                texts[i - 10_000 * (r + 1)] = fill(25) + run[at : at + 20] + fill(25)
            texts[i] = fill(30) + run + fill(30)
            texts[i + 5] = fill(40) + [word() if rng.random() < rate else w for w in run] + fill(20)
            planted[i + 5] = rate
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    covered = words_covered(texts, passages.repeated_passages(d).collect())
    for i, rate in planted.items():
        recall.setdefault(rate, []).append(len(covered[i] & set(range(40, 100))) >= 40)
    assert [sum(x) / len(x) >= least for (_, x), least in zip(sorted(recall.items()), (1.0, 0.98, 0.95, 0.9))] == [True] * 4


def test_passages_whose_phrases_are_common(spark):
    """Each phrase of an edited passage comes first in more documents than are all tried; pairs of neighbouring seeds tell them apart."""
    rng = random.Random(29)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    run = fill(60)
    texts = {100 * r + k: fill(10) + run[at : at + 14] + fill(10) for r, at in enumerate(range(0, 50, 8)) for k in range(passages.FEW + 4)}
    texts[5000] = fill(20) + run + fill(20)
    texts[6000] = fill(30) + [w if i % 12 else "edited" for i, w in enumerate(run)] + fill(10)
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert any((r.doc_id, r.source_id) == (6000, 5000) and r.n_words >= 50 for r in found)


def test_every_holder_of_a_common_phrase_is_a_source(spark):
    """A passage whose only seeds are a phrase that more documents hold than are all tried, none of them but one with the passage around it."""
    rng = random.Random(31)
    fill = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    phrase, before, after = fill(14), fill(18), fill(18)
    edited = lambda words: [w if i % 5 != 4 else fill(1)[0] for i, w in enumerate(words)]
    around = lambda: edited(before[::-1])[::-1] + phrase + edited(after)
    texts = {k: fill(20) + phrase + fill(20) for k in range(passages.FEW + 14)}
    texts[15] = fill(30) + before + phrase + after + fill(30)
    texts |= {500: fill(9) + around() + fill(9), 501: fill(3) + around() + fill(40), 600: fill(50) + phrase + after[:5] + fill(50)}
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id) for r in found} == {(500, 15), (501, 15)} and all(r.n_words >= 44 for r in found)


def test_places_of_one_key_by_all_pairs():
    """The lookups of places of one key find the pairs that comparing all of them finds, up to later ones than a sure one."""
    rng = random.Random(37)
    n, size = 220, 9
    base = np.array([[rng.randrange(1, 9) for _ in range(passages.AROUND)] for _ in range(2)], np.uint32)
    words = np.stack([np.where(np.random.default_rng(k).random(base.shape) < rng.choice((0.05, 0.15, 0.9)), np.random.default_rng(k + n).integers(1, 900, base.shape), base) for k in range(n)]).astype(np.uint32)
    doc = np.arange(n) // 2
    asking = np.array([rng.random() < 0.7 for _ in range(n)])
    got = {tuple(x) for x in passages.alike_places(doc, asking, words, size).tolist()}
    want, sure_of = set(), {}
    for x in range(n):
        same = (words[x] == words[:x]) & (words[x] > 0)
        run = np.logical_and.accumulate(same, axis=2).sum(axis=2)  # the longer key that both are places of
        for y in range(x):
            if asking[x] and doc[y] < doc[x]:
                left, right = int(run[y, 0]), int(run[y, 1])
                rest = np.zeros((1, 2, passages.AROUND // 2), bool)
                for side, k in ((0, left), (1, right)):
                    part = same[y, side, k : k + passages.AROUND // 2]
                    rest[0, side, : len(part)] = part
                sure, maybe = passages._around_alike(rest, np.array([size + left + right]))
                if size + left + right >= passages.MIN_WORDS or maybe[0]:
                    want.add((doc[x], doc[y]))
                if size + left + right >= passages.MIN_WORDS or sure[0]:
                    sure_of[x] = min(sure_of.get(x, n), doc[y])
    assert got <= want and len(sure_of) > 50
    assert all((doc[x], y) in got for x, y in sure_of.items())


def test_repeats_inside_long_texts(spark):
    """A line over and over in two documents, and a word over and over: the chains stay few, what repeats is found."""
    line = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, "\n".join([line] * 3000)), (2, "\n".join([line] * 2500) + " and an end"), (3, "of " * 20_000), (4, "of " * 15_000 + "it"), (5, "İstanbul " + line), (6, "İstanbul İ " * 30 + "x"), (7, "İstanbul İ " * 30 + "y")]
    got = {}
    for r in sorted(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.n_words):
        got[r.doc_id] = r  # the longest of each
    assert {(i, r.source_id) for i, r in got.items()} == {(2, 1), (4, 3), (7, 6)}
    assert got[2].n_words > 2400 * 13 and got[4].n_words > 14_000
    assert rows[6][1][got[7].start : got[7].end].startswith("İstanbul") and got[7].end >= len("İstanbul İ " * 29)


def test_chains_have_the_best_score():
    rng = random.Random(4)
    for _ in range(30):
        points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(12)})
        pos, src = [p for p, _ in points], [q for _, q in points]
        best = [0.0] * len(points)
        for j in range(len(points)):
            gain = max((best[i] - passages.GAP_COST * (pos[j] - pos[i] + src[j] - src[i]) for i in range(j) if pos[i] < pos[j] and src[i] < src[j]), default=0.0)
            best[j] = passages.SEED_SCORE + max(0.0, gain)
        found = passages.chains(pos, src)
        for c in found:
            assert all(pos[a] < pos[b] and src[a] < src[b] for a, b in zip(c, c[1:]))
        if max(best) > passages.SEED_SCORE:
            c = found[0]
            score = passages.SEED_SCORE * len(c) - passages.GAP_COST * (pos[c[-1]] - pos[c[0]] + src[c[-1]] - src[c[0]])
            assert score == pytest.approx(max(best))


# op8


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(6)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 120))
        d = distance(p, t)
        found = decontaminate.myers(p, t, len(p))
        assert found[0] == d
        assert decontaminate.myers(p, t, d - 1) is None if d else True


def test_every_passage_within_the_budget_is_found(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(15))) for i in range(30)] + [(90, None), (91, "short"), (92, "")]
    rows = []
    for i, t in items[:30]:
        chars = list(t)
        for _ in range(int(len(t) * decontaminate.ERROR_RATE)):
            k = rng.randrange(len(chars))
            rng.choice([lambda: chars.__setitem__(k, "Q"), lambda: chars.insert(k, "W"), lambda: chars[k] == " " or chars.pop(k)])()
        rows.append((i, "before " + "".join(chars) + " after"))
    rows += [(100 + i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))) for i in range(10)] + [(200, None), (201, ""), (None, items[0][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(d, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.doc_id is not None) == [(i, i) for i in range(30)]
    assert [(r.item_id, r.distance) for r in got if r.doc_id is None] == [(0, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [*range(100, 110), 200, 201]
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.matches(d.limit(0), b).count() == 0
    assert decontaminate.clean(d, b.limit(0)).count() == d.count()
    blocks = list(decontaminate.benchmark_blocks(b, block_chars=500))
    assert len(blocks) > 3 and sorted(i for block in blocks for i, _ in block) == sorted(i for i, t in items if t is not None)


def test_short_items_match_as_whole_words(spark):
    d = spark.createDataFrame([(1, "How  far is\nThe Moon?", "x", 1), (2, "how far is the moonlight", "x", 1), (3, "far", "x", 1), (4, None, "x", 1), (5, "so: how far is the moon, really", "x", 1)], "doc_id long, text string, item_id string, start int")
    b = spark.createDataFrame([(7, "how far is the moon"), (8, "how far is the moon"), (9, " ")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.start, r.distance) for r in decontaminate.matches(d, b).collect()) == [(1, 7, 0, 0), (1, 8, 0, 0), (5, 7, 4, 0), (5, 8, 4, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [2, 3, 4]


# op10


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_line_decisions(spark, docs, which):
    d = docs if which == "odd" else table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in d.collect() if r.doc_id is not None}
    places = {}
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            if line.strip(lines.BLANK):
                places.setdefault(line, []).append((i, k))
    sets = {line: {line[i : i + 8] for i in range(max(1, len(line) - 7))} for line in places}
    inverted = {}
    for line, s in sets.items():
        for x in s:
            inverted.setdefault(x, set()).add(line)
    near = {line: {o for x in s for o in inverted[x]} for line, s in sets.items()}
    root = closure(places, lambda a, b: b in near[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    first = {}
    for line, at in places.items():
        first[root[line]] = min([*at, first.get(root[line], (10**9, 0))])
    want = {i: [] for i in texts}
    for line, at in places.items():
        for i, k in at:
            if (i, k) != first[root[line]]:
                want[i].append(k)
    got = {r.doc_id: r.removed for r in lines.decisions(d).collect()}
    assert got == {i: sorted(k) for i, k in want.items()}


def test_repetitive_lines_meet_across_the_limit(spark):
    rng = random.Random(3)
    once = "".join(rng.choice("abcdefgh ijkl") for _ in range(90))
    rows = [(1, once), (2, once + once), (3, "-" * 60), (4, "-" * 160), (5, ". " * 30), (6, ". " * 90), (7, once[::-1])]
    got = {r.doc_id: r.removed for r in lines.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [0], 5: [], 6: [0], 7: []}


def test_lines_of_white_space_stay(spark):
    rows = [(1, "first\r\n\r\nsecond\r\n\r\nthird"), (2, "x\n\t\ny\n\t\nz"), (3, " \n\x0b\n \n\x0c")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.removed for r in lines.decisions(d).collect()} == {1: [], 2: [], 3: []}
    assert {r.doc_id: r.text for r in lines.dedupe(d).collect()} == dict(rows)


def test_dedupe_writes_the_texts(spark, docs, nothing):
    removed = {r.doc_id: set(r.removed) for r in lines.decisions(docs).collect()}
    got = lines.dedupe(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    before = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got.collect():
        if r.doc_id is not None and before[r.doc_id] is not None:
            assert r.text == "\n".join(x for k, x in enumerate(before[r.doc_id].split("\n")) if k not in removed[r.doc_id])
            assert r.n_chars == len(r.text)
    assert lines.dedupe(nothing).count() == 0


def test_parts_of_a_large_group_all_meet(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(200))
    rows = [(i, base[: 10 + i] + chr(200 + i) + base[11 + i :]) for i in range(40)]
    monkeypatch.setattr(lines, "GROUP", 7)
    got = lines.similar_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 40 and len({r.component for r in got}) == 1


def test_versions_of_a_line_are_not_all_compared(monkeypatch):
    rng = random.Random(14)
    base = [rng.choice(("the", "of", "and", "tion")) + rng.choice("abcdefg") + rng.choice(("er", "ing", "st")) for _ in range(60)]
    found = {"ab", "the of", " ".join(base)}
    while len(found) < 700:
        i, j = sorted(rng.sample(range(61), 2))
        rate = rng.choice((0, 0.03, 0.2))
        found.add(" ".join(rng.choice(base) + "x" if rng.random() < rate else w for w in base[i:j]))
    found = sorted(found)
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in found]
    want = closure(range(len(found)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    value, count = lines.shingle_sets(found)
    read, marked = [], lines._marked
    monkeypatch.setattr(lines, "_marked", lambda *a: read.append(int(a[3].sum())) or marked(*a))
    links = set(lines.stars_of_similar(value, count))
    got = closure(range(len(found)), lambda a, b: (a, b) in links or (b, a) in links)
    assert got == want and len(set(want.values())) > 100
    assert sum(read) < 0.05 * len(found) * count.sum()  # a tenth or so of what comparing each with all not linked yet would read


def test_a_line_of_every_document_goes_once_a_task(spark):
    rows = [(i, f"the line that stands on every page of the site\nwords of page {i * 7919} alone and of no other {i}\n{'ab' if i % 2 else 'cd'}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        bands = lines._bands(d).groupBy("line_id").count().collect()
        hot = lines._texts_of(d, spark.createDataFrame([(r.line_id,) for r in bands], "node long")).groupBy("line").count().collect()
        removed = {r.doc_id: r.removed for r in lines.decisions(d).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r["count"] for r in bands) <= 3 * 2 * lines.BANDS and len(bands) == 603
    assert max(r["count"] for r in hot) <= 3 and len(hot) == 603
    assert removed[0] == [] and removed[1] == [0] and all(r[:1] == [0] and 2 in r for i, r in removed.items() if i > 1)

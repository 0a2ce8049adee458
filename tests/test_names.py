"""Names found in texts against a scan of every name at every place."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.plans.names import names_replaced

WORD = re.compile(r"[^\W_]+")


def scanned(text, names):
    """(start, size, name) by trying every name at every word, then from the left the longest."""
    own = [w.lower() for w in WORD.findall(text or "")]
    every = [(i, len(w), n) for n in names for w in [[x.lower() for x in WORD.findall(n)]] if w for i in range(len(own)) if own[i : i + len(w)] == w]
    chosen, end = [], 0
    for i, size, n in sorted(every, key=lambda h: (h[0], -h[1], h[2])):
        if i >= end:
            chosen.append((i, size, n))
            end = i + size
    return sorted(every), chosen


def rewritten(text, chosen):
    where = [m.span() for m in WORD.finditer(text)]
    for i, size, n in reversed(chosen):
        text = text[: where[i][0]] + f"<{n}>" + text[where[i + size - 1][1] :]
    return text


def test_names_equal_a_brute_scan(spark, monkeypatch):
    rng = random.Random(12)
    words = ["ring", "red", "bolt", "Straße", "東京", "the", "a", "of", "Ünal", "x1"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(25)} | {"the", "the the", "red-ring", "Nobody here", ""}
    texts = [None, "", " .,", "the", "The the THE", "a ring? red ring; RED-ring of tin", "東京 straße \U0001f600 Ünal."] + [rng.choice((" ", ", ", "\n")).join(rng.choice([*words, "zz"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    n = spark.createDataFrame([(x,) for x in [*names, None, "the"]], "name string")
    for sent in (scan.SENT_NAMES, 0):
        monkeypatch.setattr(scan, "SENT_NAMES", sent)
        found = scan.hits(t, "id", "text", n, "name")
        got = found.join(t, "id").select("id", "hits", scan.leftmost_longest(F.col("hits")).alias("chosen"), "text")
        got = {r.id: r for r in got.select("*", scan.replaced(F.col("text"), F.col("chosen"), lambda name: F.concat(F.lit("<"), name, F.lit(">"))).alias("new")).collect()}
        for i, text in enumerate(texts):
            every, chosen = scanned(text, names)
            assert (i in got) == bool(every)
            if every:
                assert sorted(tuple(h) for h in got[i].hits) == every and [tuple(h) for h in got[i].chosen] == chosen
                assert got[i].new == rewritten(text, chosen)
    assert scan.hits(t.limit(0), "id", "text", n, "name").count() == 0 and scan.hits(t, "id", "text", n.limit(0), "name").count() == 0


def test_candidates_grow_with_the_texts_and_not_with_the_names_of_a_word(spark):
    rng, words = random.Random(5), [f"w{i}" for i in range(20)]
    names = sorted({f"{a} {b}" for a in words for b in words})
    texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(4)]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert scan.phrases(t.select("id", scan.words(F.col("text")).alias("own")), [2]).count() == 4 * 49
    got = {r.id: [tuple(h) for h in r.hits] for r in scan.hits(t, "id", "text", spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()}
    assert got == {i: scanned(text, names)[0] for i, text in enumerate(texts)}


def test_what_every_task_gets_does_not_grow_with_the_names(spark, monkeypatch):
    rng, words = random.Random(6), [f"w{i}" for i in range(20)]
    names = sorted({f"{a} {b}" for a in words for b in words if rng.random() < 0.5} | {"w3 w4 w5", "w7"})
    texts = [" ".join(rng.choice([*words, "x", "y"]) for _ in range(50)) for _ in range(4)]
    monkeypatch.setattr(scan, "SENT_NAMES", 10)
    monkeypatch.setattr(scan, "MAP_BITS", 8)  # four rows of 64 bits: most phrases that are no name have a name's bit
    found = scan.hits(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", spark.createDataFrame([(n,) for n in names], "name string"), "name")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: [tuple(h) for h in r.hits] for r in found.collect()} == {i: scanned(text, names)[0] for i, text in enumerate(texts)}
    assert plan.count("BroadcastHashJoin [place") == 1 == plan.count("BroadcastHashJoin") and "SortMergeJoin [phrase" in plan


def test_documents_without_names_are_none(spark):
    rows = names_replaced(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert rows and all(r.n > 0 and r.text != docs[r.doc_id] and r.text.count("<") >= r.n for r in rows)
    assert all(" ".join(w.lower() for w in WORD.findall(docs[r.doc_id])[:2]) for r in rows)


def test_retrieval_with_small_blocks_and_by_join_is_the_same(spark, monkeypatch):
    from tidemark.operators import retrieval

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    corpus = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) or None, rng.choice(("x", "y", None))) for i in range(80)], "doc_id long, text string, scope string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(6)), rng.choice(("x", "y"))) for i in range(7)] + [(8, None, "x"), (9, "zzzz", None)], "query_id long, text string, scope string")

    def answer():
        near = sorted((r.query_id, r.doc_id, round(r.score, 5), r.place) for r in retrieval.retrieve(corpus, queries, 4).collect())
        return near, sorted((r.query_id, r.doc_id, round(r.score, 5), r.scope, r.place) for r in retrieval.scoped(corpus, queries, 2, 4).collect())

    whole = answer()
    assert len(whole[0]) == 28 and {s for *_, s, _ in whole[1]} == {"own", "all"}
    monkeypatch.setattr(retrieval, "CELLS", 300)
    assert answer() == whole
    monkeypatch.setattr(retrieval, "SENT_TERMS", 0)
    assert answer() == whole
    assert retrieval.retrieve(corpus, queries.limit(0), 4).count() == 0 and retrieval.retrieve(corpus.limit(0), queries, 4).count() == 0


def test_titles_that_name(spark):
    from tidemark.operators import scan

    rng = random.Random(4)
    word = lambda low, high: "".join(rng.choice("abcd커피") for _ in range(rng.randint(low, high)))
    names = [word(1, 7) for _ in range(150)] + ["", None, "abab", "zzzz", "aa", "커피"]
    titles = [word(0, 12) for _ in range(200)] + ["", None, "a", "ab", "abab"]
    titles += titles[:20]
    speaks = lambda n, t: n in t or (len(n) >= 4 and n[:2] in t and n[-2:] in t)
    want = {}
    for t in {t for t in titles if t}:
        found = sorted(n for n in {n for n in names if n} if speaks(n, t))
        if found:
            want[t] = (len(found), found[0])
    frame = lambda values, c: spark.createDataFrame([(v,) for v in values], f"{c} string")
    got = scan.titles_naming(frame(names, "name"), frame(titles, "title")).collect()
    assert len(got) == len(want) and {r.title: (r.n_names, r.first_name) for r in got} == want
    nothing = frame([], "name"), frame([], "title")
    assert scan.titles_naming(nothing[0], frame(titles, "title")).count() == 0 and scan.titles_naming(frame(names, "name"), nothing[1]).count() == 0


def test_amounts_are_read_back(spark):
    from tidemark.plans.matching import FORMS, amounts_read_back

    for r in amounts_read_back(spark, "/root/testdata/sf0.001").collect():
        assert (r.known, r.same) == ((r.n, r.n) if FORMS[r.form][1] else (0, 0))


def test_category_terms(spark):
    from tidemark.functions.expr import category_term

    rows = [("인생냉면", "한식", "외식", "냉면"), ("집밥", "치킨", "외식", "치킨"), ("집밥", " 한식 ", "외식", "한식"), ("집", "기타 외국식 음식점업종류", "음식", "음식"), (None, None, None, "외식"), ("", "", " 서비스 ", "서비스"), ("커", "커", "x", "한글자")]
    words = {"커": "한글자", "냉면": "냉면", "치킨": "치킨"}
    d = spark.createDataFrame(rows, "brand string, mid string, major string, want string")
    from pyspark.sql import functions as F

    assert all(r.term == r.want for r in d.withColumn("term", category_term(F.col("brand"), F.col("mid"), F.col("major"), words)).collect())

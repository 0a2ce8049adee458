"""Identifiers against the plain patterns, disclosure against counts by hand, and the query's plan."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, k1 string, entity string, term int, base string, start long"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LETTERS = r"[^\W\d_]"
TERM = re.compile(rf"(?<![\w@.%+-]){LETTERS}{{3,}}(?![\w@%+-]|\.(?:{LETTERS}|\d))")


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def passes(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 8 <= len(number) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m.group())]


def windows(text, kind):
    """(entity, text beside it) of each identifier of a kind, up to the matches next to it."""
    hits = list(re.finditer(PLAIN[kind], text))
    for i, m in enumerate(hits):
        left = text[hits[i - 1].end() if i else 0 : m.start()]
        right = text[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(text)]
        if len(left) > pii.WINDOW:
            left = re.sub(r"^[^\W_]+", "", left[-pii.WINDOW :])
        if len(right) > pii.WINDOW:
            right = re.sub(r"[^\W_]+$", "", right[: pii.WINDOW])
        if passes(kind, m.group()):
            value = m.group()
            yield f"{kind}:" + (value if kind == "ip" else value.lower() if kind == "email" else re.sub("[^0-9]", "", value)), left + "\n" + right


def by_hand(rows):
    """{text: spans} of the terms that disclose an identifier of the text."""
    both, held, spoken, texts = Counter(), Counter(), Counter(), {}
    for _, text in rows:
        pairs = {(e, t.lower()) for k in PLAIN for e, near in windows(text, k) for t in TERM.findall(near)}
        both.update(pairs)
        for p in pairs:
            texts.setdefault(p, set()).add(text)
        held.update({e for k in PLAIN for e, _ in windows(text, k)})
        spoken.update({t.lower() for t in TERM.findall(text)})
    told = {}
    for (e, t), n in both.items():
        information, left = math.log2(len(rows) / held[e]), math.log2(spoken[t] / n)
        if n >= pii.SUPPORT and len(texts[e, t]) > 1 and information > 0 and left <= pii.GENERALISE_BITS and information - left >= pii.SHARE * information:
            told[e, t] = "removed" if left <= pii.REMOVE_BITS else "generalised"
    out = {}
    for _, text in rows:
        own = {e for k in PLAIN for e, _ in windows(text, k)}
        spans = []
        for m in TERM.finditer(text):
            actions = {told[e, m.group().lower()] for e in own if (e, m.group().lower()) in told}
            if actions:
                spans.append((max(actions), m.start(), m.end()))
        out[text] = sorted(spans)
    return out


def digest(rows):
    told = by_hand(rows)
    for doc_id, text in rows:
        base = plain_spans(text)
        n = Counter(b[0] for b in base)
        one = [f"{k}:{b}:{e}" for k, b, e, _ in base]
        yield (doc_id, *(n[k] for k in PLAIN), hashlib.sha256(",".join(one).encode()).hexdigest(), ",".join(one + [f"{k}:{b}:{e}" for k, b, e in told[text]]), len(told[text]))


CASES = [
    None, "", " ", "no data here", "a@b.c", "a@b.c%d@e.f._x@y.z", "x@y", "@a.b", "joe@@b.c", "a@b.c.", "ä.b+c@mail-1.example.com, B@X.ORG",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 0.0.0.255", "00001.002.3.0255 1.2.3", "1.2.3.4a 12.34.56.78.9", "٣.1.1.1 1.1.1.1",
    "4539 1488 0343 6467", "4539-1488-0343-6467 4539148803436468", "4539  1488 0343 6467", "45391488034364670000 1", "6304000000000000000", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
    "+1 (487) 555-7209 is", "+49 30 1234567.", "+1()()()()2 +12345678901234567", "++1 234 5678 9", "+1 4539 1488 0343 6467", "\U0001f600 q@r.st \U0001f600 10.0.0.1 +44 20 7946 0958 \U0001f600",
]


def documents():
    rng = random.Random(8)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiouäé") for _ in range(3)) for _ in range(60)]
    rows = list(enumerate(CASES))
    mail = [f"person{i}@mail.example.org" for i in range(6)]
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            who = i // 3 % 6
            at = rng.randrange(len(text))
            text[at:at] = [["Zorbulon", "Quentel", "Vexamir", "Drosken", "Ulfinga", "Mordeca"][who] if rng.random() < 0.8 else "someone", mail[who] if rng.random() < 0.9 else "+49 30 1234567"]
        elif i % 7 == 0:
            text.append(rng.choice(["ZORBULON", "Quentel"]))
        rows.append((1000 + i, " ".join(text)))
    rows += [rows[-3], rows[60], (None, rows[60][1]), (None, None), (5, rows[28][1])]
    return rows


def test_disclosure_by_hand(spark):
    rows = documents()
    frame = spark.createDataFrame([(d, t, "k", "e", 1, "b", 2) for d, t in rows], SCHEMA).repartition(3)
    got = pii.digests(pii.personal_data(frame)).collect()
    want = list(digest([(d, t or "") for d, t in rows]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r[-1] for r in want) > 20 and any("generalised" in r[-2] for r in want) and any("removed" in r[-2] for r in want)
    assert pii.digests(pii.personal_data(spark.createDataFrame([], SCHEMA))).count() == 0
    clean = {r.doc_id: r.text for r in pii.sanitised(frame).collect()}
    assert clean[4] == "[EMAIL]" and clean[3] == "no data here" and clean[2] == " "
    assert clean[len(CASES) - 1] == "\U0001f600 [EMAIL] \U0001f600 [IP] [PHONE] \U0001f600"
    for doc_id, text in rows:
        if doc_id is not None and doc_id >= 1000:
            assert clean[doc_id].count("[EMAIL]") == text.count("@mail.example.org") and "@mail" not in clean[doc_id]


def test_terms_by_shuffle_are_the_same(spark, monkeypatch):
    frame = spark.createDataFrame(documents(), "doc_id long, text string")
    known = pii.written(pii.identified(frame))
    told = sorted(map(str, pii.disclosures(frame, known).collect()))
    monkeypatch.setattr(pii, "SENT_TERMS", 0)
    assert told and sorted(map(str, pii.disclosures(frame, known).collect())) == told


def test_long_texts(spark):
    long = ["x" * 300_000, "1" * 300_000, "a@" * 60_000, "+1 " * 60_000, "1.2." * 60_000, "a@b" + ".c" * 100_000, "1 " * 150_000, "+1" + "(" * 200_000, "me@x.org 10.0.0.1 " * 3_000]
    frame = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.identified(frame).collect()}
    assert [got[8].n_email, got[8].n_ip, got[4].n_ip, got[5].n_email] == [3_000, 3_000, 30_000, 1]
    assert [(b.start, b.end) for b in got[8].base] == [(m.start(), m.end()) for p in ("email", "ip") for m in re.finditer(PLAIN[p], long[8])]


def test_sums_before(spark):
    for n in (0, 1, 63, 64, 65, 5_000, 9_000):
        sizes = [random.Random(n).randrange(9) for _ in range(n)]
        (got,) = spark.createDataFrame([(sizes,)], "s array<int>").select(pii.before_each(F.col("s"))).first()
        assert got == [sum(sizes[:i]) for i in range(n)] if n < 100 else got[-1] == sum(sizes[:-1]) and got[4095] == sum(sizes[:4095])


def test_query_by_hand_and_plan(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = QUERIES["op11_disclosure"](spark, SF)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, digest(rows)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan

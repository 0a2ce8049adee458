"""Periodic runs against the definition, on words of small alphabets, and the operator on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import runs
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def by_definition(x, least_words, least_periods):
    """Every period's maximal stretches; those whose smallest period is another one are left out."""
    found, n = set(), len(x)
    for p in range(1, n // least_periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least_words, least_periods * p):
                s = x[i : i + length]
                if not any(s[q:] == s[: length - q] for q in range(1, p)):
                    found.add((i, length, p))
            i = j + 1 if j > i else i + 1
    return sorted(found)


def shapes(rng, n):
    fibonacci, other = [0], [0, 1]
    while len(other) < n:
        fibonacci, other = other, other + fibonacci
    nested, k = [0], 1
    while len(nested) < n:
        nested, k = nested * 3 + [k % 3], k + 1
    yield from (fibonacci[:n], nested[:n], nested[:n][::-1], [bin(i).count("1") & 1 for i in range(n)], [1] * n, [rng.randrange(2) for _ in range(n)])
    yield [(i & -i).bit_length() for i in range(1, n + 1)]


def test_runs_by_definition():
    rng = random.Random(3)
    cases = [[rng.randrange(k) for _ in range(rng.randrange(50))] for k in (1, 2, 2, 3, 4) for _ in range(250)]
    cases += [(x[: rng.randrange(1, 9)] * 20)[:45] + x[:3] for x in cases if len(x) > 9]
    cases += [x for n in (30, 100, 200) for x in shapes(rng, n)]
    for x in cases:
        assert runs.all_runs(x, 2, 2) == by_definition(x, 2, 2)
        for least in ((4, 3), (24, 3)):
            assert runs.all_runs(x, *least) == runs.runs([str(v) for v in x], *least) == by_definition(x, *least)


class Counted(int):
    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("n", [1_000, 8_000])
def test_words_are_compared_a_linear_number_of_times(n):
    for x in shapes(random.Random(4), n):
        for order in (x, [max(x) - v for v in x]):
            counted = [Counted(v) for v in order]
            Counted.seen = 0
            nss, agree = runs.next_smaller(counted)
            assert Counted.seen <= 2.2 * n
            Counted.seen = 0
            runs.left_extensions(counted, nss)
            assert Counted.seen <= 2 * n
            for i in random.Random(5).sample(range(len(x)), 12):
                assert order[i : i + agree[i]] == order[nss[i] : nss[i] + agree[i]]
                assert nss[i] == len(x) or order[nss[i] :] < order[i:]
                assert all(order[k : k + 300] >= order[i : i + 300] for k in range(i + 1, min(nss[i], i + 40)))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = by_definition(words, 24, 3)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    stay = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(stay.encode()).hexdigest())


def test_operator_on_odd_rows(spark):
    schema = "doc_id long, text string, runs string, start long, period long, collapsed int"
    chant = "a rose is " * 40
    given = [None, "", " \t\n", "one", " ", chant, chant + "thorn", "x " * 60, "the end " + "x y " * 12, "naïve \U0001f600 " * 30, "word " * 5000, "a\x0bb\x0cc " * 20]
    rows = [(i, t, "r", i, i, i) for i, t in enumerate(given * 6)] + [(None, chant, None, None, None, None), (None, None, None, None, None, None), (5, chant, "r", 1, 1, 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    found = runs.digests(runs.periodic_runs(runs.with_planted(docs))).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(expected(r[0], r[1])) for r in rows)
    assert found[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    plain = {r.doc_id: r for r in runs.periodic_runs(docs.where("doc_id < 12")).collect()}
    assert plain[6].collapsed == "a rose is thorn" and [tuple(r) for r in plain[6].runs] == [(0, 120, 3)]
    assert runs.digests(runs.periodic_runs(spark.createDataFrame([], schema))).count() == 0


def test_query_by_definition(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    short = {d: t for d, t in docs.items() if len(t or "") < 6_000}
    found = {r.doc_id: tuple(r) for r in QUERIES["op12_runs"](spark, SF).collect()}
    assert found.keys() == docs.keys()
    assert {d: found[d] for d in short} == {d: expected(d, t) for d, t in short.items()}
    assert sum(r[1] for r in found.values()) > 5

"""Periodic runs of words in linear time, without suffix structures or hashes (Ellert and Fischer).

Every maximal run has a Lyndon root that is the longest Lyndon word at its place, for the order of the words or for the
reverse one.  The longest Lyndon word at i ends where the next smaller suffix begins.  ``next_smaller`` finds these from left
to right: place i is compared with the chain of previous smaller suffixes, and how far two places agree is taken from what
is known before any word is looked at: from an earlier pair that the stretch matched last is a copy of, and from the two sides
of the triangle with the chain's place before.  Words are compared only beyond the furthest place reached, so that they are
compared a linear number of times.  ``left_extensions`` does the same for the way back.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts

#: A run counts from this length and this many periods on.
LEAST_WORDS, LEAST_PERIODS = 24, 3

_WORD = re.compile(r"[^\x20\x09-\x0D]+")

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def next_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """(nss, agree): where the next smaller suffix of each suffix begins (the empty one is the smallest), and how many words the two share."""
    n = len(x)
    nss, agree, pss, shared = [n] * n, [0] * n, [-1] * n, [0] * n
    reach = since = shift = 0  # x[since:reach] is x[since - shift:reach - shift], compared before
    for i in range(1, n):
        j, length, side = i - 1, 0, -1
        while j >= 0:
            exact = side >= 0 and side != length
            if exact:
                length = min(side, length)
            else:
                if i < reach and j >= since:
                    a, b = j - shift, i - shift
                    old = agree[a] if nss[a] == b else shared[b] if pss[b] == a else -1
                    if 0 <= old < reach - i:
                        length, exact = old, True
                    elif old >= 0 and length < reach - i:
                        length = reach - i
                if not exact:
                    k, back = i + length, j - i
                    while k < n and x[k] == x[k + back]:
                        k += 1
                    length = k - i
                    if k >= reach:
                        reach, since, shift = k, i, i - j
            if i + length < n and x[i + length] > x[j + length]:
                break
            nss[j], agree[j] = i, length
            side = shared[j]
            j = pss[j]
        pss[i], shared[i] = j, length if j >= 0 else 0
    return nss, agree


def left_extensions(x: list[int], nss: list[int]) -> list[int]:
    """How many words before each place agree with those before its next smaller suffix; 0 where that is the empty one.

    From right to left, with the stretch matched furthest to the left as the source of what is known.
    """
    n = len(x)
    left = [0] * n
    low, until, shift = n, 0, 0  # x[low:until] is x[low + shift:until + shift]
    for i in range(n - 1, -1, -1):
        k = nss[i]
        if k == n:
            continue
        length = 0
        if low < i and k <= until and nss[i + shift] == k + shift:
            old = left[i + shift]
            if old < i - low:
                left[i] = old
                continue
            length = i - low
        at, forth = i - 1 - length, k - i
        while at >= 0 and x[at] == x[at + forth]:
            at -= 1
        left[i] = i - 1 - at
        if at + 1 <= low:
            low, until, shift = at + 1, i, forth
    return left


def all_runs(x: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``least_periods`` (two or more) periods and ``least_words`` words, by start and period."""
    found, top = set(), max(x, default=0)
    for order in (x, [top - v for v in x]):
        nss, agree = next_smaller(order)
        left = left_extensions(order, nss)
        for i, end in enumerate(nss):
            period = end - i
            length = left[i] + period + agree[i]
            if length >= least_words and length >= least_periods * period:
                found.add((i - left[i], length, period))
    return sorted(found)


def stretches(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, rounds: int = 4) -> list[tuple[int, int]]:
    """Stretches outside of which no run of so many periods has a word.

    In such a run each word stands at least ``least_periods`` times, so that a rarer word parts the text; parted again a few
    times, by the counts inside the stretches.  Nor can such a word prolong a run, which would hold it then.
    """
    n = len(ids)
    part = np.zeros(n, np.int64)
    keep = np.ones(n, bool)
    for _ in range(rounds):
        at = np.flatnonzero(keep)
        if not len(at):
            return []
        _, inverse, times = np.unique(part[at] * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        rare = times[inverse] < least_periods
        keep[at[rare]] = False
        at = np.flatnonzero(keep)
        edge = np.flatnonzero(np.diff(at) > 1) + 1
        begins, ends = np.concatenate(([0], edge)).astype(np.int64), np.concatenate((edge, [len(at)])).astype(np.int64)
        short = ends - begins < least_words
        sizes = ends - begins
        part[at] = np.repeat(np.arange(len(begins)), sizes)
        keep[at[np.repeat(short, sizes)]] = False
        if not rare.any() and not short.any():
            break
    at = np.flatnonzero(keep)
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) > 1) + 1
    return [(int(s[0]), int(s[-1]) + 1) for s in np.split(at, edge)]


def runs(words: list, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words, by start and period."""
    if len(words) < least_words:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return [(begin + s, length, p) for begin, end in stretches(ids, least_words, least_periods) for s, length, p in all_runs(ids[begin:end].tolist(), least_words, least_periods)]


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equal ones the first, then that of the least period."""
    best = None
    for run in found:  # by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a stretch made periodic for the documents whose id says so; a null id counts as the text ''."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, runs, collapsed) for every row: array of (start, length, period) in words, and the text without the repeats, words joined by one blank.

    A null or empty text has no runs and the empty text; null ids and repeated rows keep their rows; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            lists, collapsed = [], []
            for text in batch.column(1).to_pylist():
                words = _WORD.findall(text)
                found = runs(words, least_words, least_periods)
                lists.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                collapsed.append(" ".join(w for w, stays in zip(words, kept(len(words), found)) if stays) if found else " ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind), pa.array(collapsed)], names=["doc_id", "runs", "collapsed"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the words of each text joined by one blank, those of ``planted`` documents with their periodic stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [" ".join(planted(_WORD.findall(t), d)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "text"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """The columns of ``RESULT`` from those of ``periodic_runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, own, collapsed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = [(r["start"], r["length"], r["period"]) for r in own]
                best = strongest(own)
                four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in own)
                rows.append((doc_id, len(own), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    return found.mapInArrow(run, RESULT)

"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is split into e + 1 pieces: any passage within e edits holds
one of them unchanged.  An automaton finds the exact piece hits in one scan of a text.  By the ring form of
the pigeonhole principle some exact piece is also followed by a piece with at most one edit, so a hit whose
next piece has more is dropped; what is left is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts

#: Edits allowed for each code point of an item.
ERROR_RATE = 0.1
#: Items with fewer code points than this match without an edit and as whole words only.
MIN_CHARS = 40
#: The items are sent to every task in blocks of about this many code points, whose automaton takes about 50 bytes each; each block costs one scan of the documents.
BLOCK_CHARS = 4_000_000

_SPACE = re.compile(r"\s+")


def normalised(text: str) -> str:
    """Lower case, runs of white space as one blank, trimmed."""
    return _SPACE.sub(" ", text.lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces of near-equal length with their offsets."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def within_one_edit(piece: str, window: str) -> bool:
    """Whether some prefix of ``window`` (one longer than the piece) is within one edit of ``piece``."""
    n = len(piece)
    k = 0
    while k < n and k < len(window) and piece[k] == window[k]:
        k += 1
    if k >= n - 1:
        return True
    return piece[k + 1 :] in (window[k + 1 : n], window[k : n - 1]) or piece[k:] == window[k + 1 : n + 1]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of the whole pattern in text within ``most`` edits.

    The leftmost end among the best.  Big integers serve as bit vectors of the pattern's length.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (most + 1, -1)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[1] >= 0 else None


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether a stretch neither begins nor ends inside a word."""
    cut_before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not cut_before and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def matcher(items: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS):
    """A function text -> [(item_id, start, end, distance)] in positions of the normalised text."""
    table, users, automaton = {}, {}, ahocorasick.Automaton()
    for item_id, text in items:
        text = normalised(text)
        if not text:
            continue
        errors = int(len(text) * error_rate) if len(text) >= min_chars else 0
        parts = pieces(text, errors)
        table[item_id, text] = errors
        for k, (at, piece) in enumerate(parts):
            following = parts[k + 1][1] if k < errors else ""
            users.setdefault(piece, []).append((item_id, text, at + len(piece), following))
    for piece, uses in users.items():
        automaton.add_word(piece, uses)
    if table:
        automaton.make_automaton()

    def find(raw: str) -> list[tuple[int, int, int, int]]:
        text = normalised(raw)
        spans: dict[tuple[int, str], list[tuple[int, int]]] = {}
        found = []
        for end, uses in automaton.iter(text) if table and text else ():
            for item_id, item, done, following in uses:
                if len(item) < min_chars:
                    if whole_words(text, end + 1 - len(item), end + 1):
                        found.append((item_id, end + 1 - len(item), end + 1, 0))
                    continue
                if following and not within_one_edit(following, text[end + 1 : end + 2 + len(following)]):
                    continue
                errors = table[item_id, item]
                # the item starts within its error budget of where this piece says
                start = end + 1 - done - errors
                stop = start + len(item) + 2 * errors
                known = spans.setdefault((item_id, item), [])
                if known and start <= known[-1][0] + 2 * errors:
                    known[-1] = (min(start, known[-1][0]), max(stop, known[-1][1]))
                else:
                    known.append((start, stop))
        for (item_id, item), windows in spans.items():
            errors = table[item_id, item]
            for start, stop in windows:
                start = max(0, start)
                best = myers(item, text[start:stop], errors)
                if best:
                    end = start + best[1]
                    # the start is the end of the reversed pattern in the reversed text
                    back = myers(item[::-1], text[max(0, end - len(item) - errors) : end][::-1], errors)
                    found.append((item_id, end - (back[1] if back else len(item)), end, best[0]))
        return sorted(set(found))

    return find


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks whose size was checked, one on the driver at a time; items with a null id or text are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield sorted((r.i, r.t) for r in block.collect())


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, distance): every stretch of a text within an item's error budget.

    Texts and items are compared in lower case with white space collapsed; start and end are positions in
    the text so normalised.  The budget is floor(error_rate * length); items shorter than ``min_chars`` are found without an
    edit and as whole words only, empty ones never.  A null or empty text has no match, a null doc_id keeps its rows, repeated rows repeat their
    matches, two items with one text both match.  An empty documents or benchmark table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())])

    def against(items: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = matcher(shared.value, error_rate, min_chars)
            for batch in batches:
                out = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in find(t)]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "start", "end", "distance"), r)) for r in out], schema=schema)

        return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, item_id long, start int, end int, distance int")

    return functools.reduce(DataFrame.unionByName, map(against, benchmark_blocks(benchmark)))


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns.

    A row is decided by its own text alone, in one scan without a shuffle.  Null and empty texts stay.
    """
    schema = docs.schema

    def without(kept: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def unmatched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = matcher(shared.value, error_rate, min_chars)
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                yield batch.filter(pa.array([not (t and find(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        return kept.mapInArrow(unmatched, schema)

    return functools.reduce(without, benchmark_blocks(benchmark), docs)

"""Line dedup: fuzzy lines by MinHash, exact Jaccard verification and distributed union-find.

A line is its shingles of ``SHINGLE`` code points (a shorter line: itself).  Bands of ``ROWS`` minima meet
in buckets; ``BANDS`` bands find a pair at Jaccard 0.8 with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.995.
Lines of up to ``LONG`` distinct shingles take one hash function a minimum, longer ones one permutation in bins; around
the limit lines carry both, so that no pair at the threshold falls between the two.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap_of, codepoints, cut, mixed, shuffle_width, spans, whole_groups
from tidemark.llm.components import connected_components

SHINGLE, ROWS, BANDS, LONG, SIMILARITY, SEED = 8, 4, 10, 100, 0.8, 42
#: Places of a sketch, and of how many those of two lines of a bucket may differ; white space that a blank line is made of.
PLACES, APART, BLANK = 24, 10, " \t\r\x0b\x0c"
#: Code points that are hashed at once, and lines of a coarse group that are compared in one task.
BLOCK, GROUP = 2_000_000, 20_000

#: Words of 64 bits of the parities of a set of shingles.
WORDS = 16
#: Lines a task remembers to have given, about 25 MB.
SENT = 1 << 18

_ODD = mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, band key, sketch) of every band of each line; lines hold no line feed.

    A sketch is two bits of each of the first PLACES minima.
    """
    k = ROWS * BANDS
    code = codepoints("\n".join(lines) + "\n").astype(np.uint64)
    end = np.flatnonzero(code == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    count = np.maximum(end - start - SHINGLE + 1, 1)
    # windows of eight by doubling; past a short line's end they would read on, so its tail is blanked
    inside = np.concatenate((code, np.zeros(SHINGLE, np.uint64)))
    short = np.flatnonzero(end - start < SHINGLE)
    h, prime = inside, 0x100000001B3
    for step in (1, 2, 4):
        h = h[:-step] * np.uint64(prime) + h[step:]
        prime = prime * prime % 2**64
    shift = np.concatenate(([0], np.cumsum(count)[:-1]))
    value = h[np.repeat(start - shift, count) + np.arange(count.sum())]
    value[shift[short]] = [xxhash.xxh64_intdigest(lines[i], SEED) for i in short]
    value = mixed(value)
    owner = np.repeat(np.arange(len(lines)), count)
    rows, keys, sketches = [], [], []

    def add(line: np.ndarray, low: np.ndarray, scheme: int) -> None:
        sketch = np.zeros(len(line), np.uint64)
        for r in range(PLACES):
            sketch |= (low[:, r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(62)) << np.uint64(2 * r)
        for band in range(BANDS):
            key = np.full(len(line), scheme * BANDS + band, np.uint64)
            for r in range(ROWS):
                key = mixed(key ^ (low[:, band * ROWS + r].astype(np.uint64) + np.uint64(r + 1)))
            rows.append(line)
            keys.append(key)
            sketches.append(sketch)

    # similarity bounds the ratio of distinct shingles, not of windows, which may repeat
    distinct, long = count.copy(), np.flatnonzero(count > LONG)
    if len(long):
        bits = np.uint64(len(long).bit_length())
        packed = np.repeat(np.arange(len(long), dtype=np.uint64), count[long]) << (np.uint64(64) - bits) | value[(count > LONG)[owner]] >> bits
        packed = np.sort(packed)
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
        distinct[long] = np.bincount((packed >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(long))
    few = np.flatnonzero(distinct <= LONG / SIMILARITY)
    if len(few):
        v = value[(distinct <= LONG / SIMILARITY)[owner]]
        at = np.concatenate(([0], np.cumsum(count[few])[:-1]))
        low = np.stack([np.minimum.reduceat((v * odd) >> np.uint64(32), at) for odd in _ODD], axis=1)
        add(few, low, 0)
    many = np.flatnonzero(distinct > LONG)
    if len(many):
        chosen = (distinct > LONG)[owner]
        v, line = value[chosen], np.repeat(np.arange(len(many)), count[many])
        low = np.full(len(many) * k, 1 << 32, np.int64)
        np.minimum.at(low, line * k + ((v >> np.uint64(40)) * np.uint64(k) >> np.uint64(24)).astype(np.int64), (v & np.uint64(0xFFFFFFFF)).astype(np.int64))
        low = low.reshape(-1, k)
        while (empty := low == 1 << 32).any():  # an empty bin takes the next one's minimum
            low = np.where(empty, np.roll(low, -1, axis=1), low)
        add(many, low, 1)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sketches)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches may be those of similar lines.

    At Jaccard 0.8 each of PLACES differs with probability 0.15, so that more than APART of them do once in 3,000 pairs.
    """
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)) <= APART


class Given:
    """The lines a task has given already.  A line that stands in most documents thus goes once a task into the shuffle, not once a batch.

    Beyond ``SENT`` lines others are not remembered and may be given again; what reads them takes repeats as one.
    """

    def __init__(self) -> None:
        self._ids: set[int] = set()

    def new(self, ids: np.ndarray) -> np.ndarray:
        """The places of ids that are not known to have been given, which they are from now on."""
        at = np.array([i for i, x in enumerate(ids.tolist()) if x not in self._ids], np.int64)
        self._ids.update(ids[at[: max(0, SENT - len(self._ids))]].tolist())
        return at


def _bands(docs: DataFrame) -> DataFrame:
    """(key, line_id, rest): each band key of each distinct line of a task, with the line's sketch and its number of times in the batch where the task met it.

    key holds 48 bits of the band key and 16 of the sketch, rest the sketch's other 32 and the number, up to 65535.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Given()

        def banded(block: list[str]) -> pa.RecordBatch:
            seen = Counter(x for t in block for x in t.split("\n") if x.strip(BLANK))
            lines = list(seen)
            ids = np.array([xxhash.xxh64_intdigest(x, SEED) for x in lines], np.uint64).view(np.int64)
            new = given.new(ids)
            if not len(new):
                return pa.RecordBatch.from_pylist([], schema=schema)
            times = np.minimum(np.fromiter(seen.values(), np.int64, len(lines))[new], 0xFFFF).astype(np.uint64)
            ids = ids[new]
            row, key, sketch = signatures([lines[i] for i in new])
            key = key >> np.uint64(16) << np.uint64(16) | sketch >> np.uint64(32)
            rest = (sketch & np.uint64(0xFFFFFFFF)) << np.uint64(16) | times[row]
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(rest.view(np.int64))], schema=schema)

        for batch in batches:
            block, size = [], 0
            for t in batch.column(0).to_pylist():
                block.append(t)
                size += len(t)
                if size >= BLOCK:
                    yield banded(block)
                    block, size = [], 0
            if block:
                yield banded(block)

    schema = pa.schema([("key", pa.int64()), ("line_id", pa.int64()), ("rest", pa.int64())])
    return docs.select("text").mapInArrow(run, "key long, line_id long, rest long")


def _clusters(sketch: np.ndarray) -> list[tuple[int, int]]:
    """Links of a bucket's lines by their sketches, as stars; compares only with what is not linked yet."""
    free, out = np.arange(len(sketch)), []
    while len(free):
        hub, free, todo = free[0], free[1:], [free[0]]
        while todo and len(free):
            x = todo.pop()
            near = alike(sketch[free], sketch[x])
            out += [(hub, i) for i in free[near]]
            todo += free[near].tolist()
            free = free[~near]
    return out


def _bucket_stars(bands: DataFrame) -> DataFrame:
    """(a, b): for buckets of several lines, each line beside the bucket's most frequent one, as far as tasks have counted it, if their sketches are alike, else beside another that is alike."""
    dealt = bands.repartition(shuffle_width(bands.sparkSession), F.shiftright("key", 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
        if held:  # a partition's packed numbers; sorting them here costs a tenth of sorting rows
            key, line, rest = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((line, key))
            key, line, rest = key[order].view(np.uint64), line[order], rest[order].view(np.uint64)
            sketch, n, key = (key & np.uint64(0xFFFF)) << np.uint64(32) | rest >> np.uint64(16), rest & np.uint64(0xFFFF), key >> np.uint64(16)
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1]))))
            n = np.add.reduceat(n.astype(np.int64), first)
            key, line, sketch = key[first], line[first], sketch[first]
            begin, end = spans(key)
            begin, end = begin[end - begin > 1], end[end - begin > 1]
            size = end - begin
            member = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            # the most frequent line of each bucket, of equal ones the one of the least id
            ranked = member[np.lexsort((member, -n[member], np.repeat(begin, size)))]
            hub = np.repeat(ranked[np.cumsum(size) - size], size)
            near = alike(sketch[hub], sketch[member])
            out = [np.stack((line[hub[near]], line[member[near]]), axis=1)]
            for s, e in zip(begin, end) if not near.all() else ():
                own = slice(np.searchsorted(member, s), np.searchsorted(member, e))
                if not near[own].all():
                    far = member[own]
                    out.append(np.array([(line[far[i]], line[far[j]]) for i, j in _clusters(sketch[far])], np.int64).reshape(-1, 2))
            found = np.concatenate(out)
            found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every line one after another, and how many each line has."""
    code, owner, value = [codepoints(x) for x in lines], [], []
    for size in sorted({min(len(c), SHINGLE) for c in code}):
        at = [i for i, c in enumerate(code) if min(len(c), SHINGLE) == size]
        flat = np.concatenate([code[i] for i in at]).astype(np.uint64)
        length = np.array([len(code[i]) for i in at])
        count = length - size + 1
        start = np.repeat(np.cumsum(length) - length - np.cumsum(count) + count, count) + np.arange(count.sum())
        h = np.full(count.sum(), size, np.uint64)
        for j in range(size):
            h = mixed(h ^ (flat[start + j] + np.uint64(1)))
        owner.append(np.repeat(np.array(at), count))
        value.append(h)
    # sorted as one number: 20 bits of the line, 44 of the hash
    packed = np.sort((np.concatenate(owner).astype(np.uint64) << np.uint64(44)) | (np.concatenate(value) >> np.uint64(20)))
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    return packed & np.uint64((1 << 44) - 1), np.bincount((packed >> np.uint64(44)).astype(np.int64), minlength=len(lines))


def stars_of_similar(value: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
    """Links of exact Jaccard >= SIMILARITY among shingle sets, as stars over line numbers.

    A line is compared with the lines that nothing is linked to yet, so a close group costs little more than one pass.  Of the others those go first
    that have too many or too few shingles, then those whose parities show that too few are common; neither drops a link.
    """
    if len(count) == 2:
        both = len(np.intersect1d(value[: count[0]], value[count[0] :], assume_unique=True))
        return [(0, 1)] if both >= SIMILARITY * (len(value) - both) - 1e-9 else []
    order = np.argsort(count, kind="stable")  # by size, so that lines of sizes too far apart are passed over together
    code, begin = np.unique(value, return_inverse=True)[1].astype(np.int32), np.cumsum(count) - count
    mark, bits = np.zeros(code.max() + 1, np.int32), _parities(value, count)[order]
    size, begin = count[order], begin[order]
    alive, links, todo = np.ones(len(order), bool), [], []
    left = len(order)
    while left:
        if not todo:  # the lines not linked yet begin anew with the first of them
            seed = int(np.argmax(alive))
            alive[seed], todo, left = False, [seed], left - 1
            continue
        x = todo.pop()
        low, high = np.searchsorted(size, SIMILARITY * size[x] - 1e-9), np.searchsorted(size, size[x] / SIMILARITY + 1e-9, "right")
        # of two sets' common shingles there are at most half of what their sizes leave over the parities that differ
        most = size[x] + size[low:high] - np.bitwise_count(bits[low:high] ^ bits[x]).sum(axis=1, dtype=np.int64)
        free = low + np.flatnonzero(alive[low:high] & (most * (1 + SIMILARITY) >= 2 * SIMILARITY * (size[x] + size[low:high]) - 1e-6))
        if not len(free):
            continue
        n, own = size[free], code[begin[x] : begin[x] + size[x]]
        mark[own] = 1
        both = _marked(mark, code, begin[free], n)
        mark[own] = 0
        found = free[both >= SIMILARITY * (size[x] + n - both) - 1e-9]
        links += [(int(order[seed]), int(order[i])) for i in found]
        alive[found] = False
        todo += found.tolist()
        left -= len(found)
        if left < len(order) // 2 and not todo:  # what is linked is left behind
            order, size, begin, bits = (a[alive] for a in (order, size, begin, bits))
            alive = np.ones(left, bool)
    return links


def _marked(mark: np.ndarray, code: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many shingles of each of some sets, at ``begin`` in code and n long, are marked."""
    start = np.cumsum(n) - n
    return np.add.reduceat(mark[code[np.repeat(begin - start, n) + np.arange(n.sum())]], start)


def _parities(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each set, of each of 64 * WORDS bits that shingles have, whether an odd number of its shingles has it."""
    odd = np.zeros(len(count) * 64 * WORDS, np.uint8)
    np.add.at(odd, np.repeat(np.arange(len(count)), count) * (64 * WORDS) + (value % np.uint64(64 * WORDS)).astype(np.int64), 1)
    return np.packbits(odd & 1).reshape(len(count), -1).view(np.uint64)


def _exploded(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line", F.lit(BLANK)) != "").withColumn("line_id", F.xxhash64("line"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line_id, line) of all wanted lines, with a few others and some repeats; lines that a bit map of fixed size rules out are not shuffled."""
    bits = bitmap_of(wanted, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Given()
        for batch in batches:
            lines = list({x for t in batch.column(0).to_pylist() for x in t.split("\n") if x.strip(BLANK)})
            ids = np.array([xxhash.xxh64_intdigest(x, SEED) for x in lines], np.uint64)
            hit = np.flatnonzero(bits.holds(ids))
            hit = hit[given.new(ids[hit])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit].view(np.int64)), pa.array([lines[i] for i in hit], pa.string())], names=["line_id", "line"])

    return docs.select("text").mapInArrow(run, "line_id long, line string")


def similar_lines(docs: DataFrame) -> DataFrame:
    """(node, component): the lines, by the hash of their text, that have a line alike.

    Lines of a bucket whose sketches are alike are first joined to coarse groups by ids alone; a line's text then travels once, to its coarse
    group, where exact Jaccard similarity decides.  A group of more than ``GROUP`` lines is dealt into parts, and every
    pair of parts is a group of its own: all lines meet, no task holds more than two parts.
    """
    coarse = cut(connected_components(_bucket_stars(_bands(docs))))
    parts = coarse.groupBy("component").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    several = parts.where("parts > 1")
    found = _texts_of(docs, coarse.select("node")).join(coarse.withColumnRenamed("node", "line_id"), "line_id")
    found = found.groupBy("line_id", "component").agg(F.min("line").alias("line")).join(several, "component", "left")
    part = F.pmod(F.xxhash64(F.col("line_id"), F.lit(1)), F.col("parts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda j: j != part)  # the part itself meets in each of these
    rank = F.transform(others, lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j))
    dealt = found.select("component", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(rank)).alias("part"), "line_id", "line")
    grouped = dealt.select(F.xxhash64("component", "part").alias("key"), "component", "line_id", "line")
    grouped = grouped.repartition(shuffle_width(docs.sparkSession), "key").sortWithinPartitions("key", "line_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, line_id, line in whole_groups(batches, 4):
            begin, end = spans(key)
            out = []
            for s, e in _blocks(begin, end, line):
                value, count = shingle_sets(list(line[s:e]))
                offset = np.concatenate(([0], np.cumsum(count)))
                inner = (begin >= s) & (begin < e)
                for x, y in zip(begin[inner] - s, end[inner] - s):
                    out += [(line_id[s + x + i], line_id[s + x + j]) for i, j in stars_of_similar(value[offset[x] : offset[y]], count[x:y])]
            found = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return connected_components(grouped.mapInArrow(run, "a long, b long"))


def _blocks(begin: np.ndarray, end: np.ndarray, line: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole groups with about BLOCK code points each, for hashing at once."""
    start, size = 0, 0
    for s, e in zip(begin, end):
        size += sum(map(len, line[s:e]))
        if size >= BLOCK or e - start >= 1 << 19:
            yield start, e
            start, size = e, 0
    if start < len(line):
        yield start, len(line)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, removed): for each document the numbers of its lines to remove, in order.

    Lines are what line feeds part, numbered from 0.  Of each class of lines (equal ones, and those linked by a
    Jaccard similarity of 0.8 or more) the first by (doc_id, line number) stays.  Blank lines, those of white space only, stay.  Rows with a null id take no part and are not returned.  Repeated rows with one id and
    text are one document.  A document without lines, or of null or empty text, has an empty array; an
    empty table gives no rows.
    """
    rows = docs.where(docs[id_col].isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = cut(_exploded(rows).select("doc_id", "line_no", "line_id"))
    first = found.groupBy("line_id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    named = first.join(similar_lines(rows).withColumnRenamed("node", "line_id"), "line_id", "left").withColumn("component", F.coalesce("component", "line_id"))
    keeper = named.groupBy("component").agg(F.min("first").alias("keep"))
    kept = named.join(keeper, "component").select("line_id", "keep")
    marked = found.join(kept, "line_id").select("doc_id", "line_no", (F.struct("doc_id", "line_no") != F.col("keep")).alias("extra"))
    per_doc = marked.where("extra").groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    ids = rows.select("doc_id").distinct()
    return ids.join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns and rows, its texts without the lines that ``decisions`` removes.

    A column n_chars is brought up to date.  A document whose lines all went stays with an empty text.
    """
    removed = cut(decisions(docs, id_col, text_col).where("size(removed) > 0").select(F.col("doc_id").alias("__id"), F.col("removed").alias("__removed")))
    joined = docs.join(removed, docs[id_col].cast("long") == removed["__id"], "left").select(*docs.columns, "__removed")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, last = batch.schema.get_field_index(text_col), batch.num_columns - 1
            columns, names = list(batch.columns[:last]), batch.schema.names[:last]
            new = []
            for t, gone in zip(columns[at].to_pylist(), batch.column(last).to_pylist()):
                if gone and t is not None:
                    gone = set(gone)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
                new.append(t)
            columns[at] = pa.array(new, columns[at].type)
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in new], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema)

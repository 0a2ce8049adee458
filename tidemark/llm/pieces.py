"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words between which no piece reaches.  The distinct words' substrings of bounded length are exploded and
equi-joined to the piece table; the edges of a word are grouped and folded by a higher-order aggregate.  For a
unigram model the fold is Viterbi's best path by the sum of scores.  For a BPE model, whose scores are merge ranks and not
log probabilities, the best path is not the model's segmentation: there the fold goes over the same lattice's edges in the order of
their ranks and takes each merge that is open.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_width, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Code points of text in one chunk, whose words are looked up together, and in one of its parts; and input partitions that one task reads.
CHUNK, PART, MERGED_PARTITIONS = 64_000_000, 8_000_000, 2
#: Words of a chunk's texts that are put together at once, and of its list of words that are spelled at once.
BLOCK, SLICE = 500_000, 50_000
#: A word of the native fold has at most this many code points, and a chunk as many words that are looked up: inner boundaries and number share one bigint.
BITS, NUMBERS = 40, 1 << 24
_LETTER = r"[^\W\d_]"


@dataclass
class Pieces:
    kind: int
    normal: list[tuple[str, int, float]]
    byte_ids: list[int]
    unknown: int
    texts: list[bytes]

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.normal)

    @property
    def word(self) -> str:
        """The pattern of a word: blanks and then letters or other signs, or all that holds no blank where a piece mixes the two."""
        mixed = re.compile(f"{_LETTER}(?!{_LETTER})[^{SPACE}]|(?!{_LETTER})[^{SPACE}]{_LETTER}")
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        if any(inner.search(p) for p, _, _ in self.normal):
            raise ValueError("a piece goes on after a blank; words cannot be cut there")
        if any(mixed.search(p) for p, _, _ in self.normal):
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return f"{SPACE}*{_LETTER}+|{SPACE}*(?:(?!{_LETTER})[^{SPACE}])+|{SPACE}+"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of one protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[i : i + size]
            i += size


def read_model(path: str = MODEL) -> Pieces:
    """The piece table of a model file: normal pieces, byte pieces, the unknown piece and the model's kind."""
    normal, byte_ids, raw, unknown, kind = [], [-1] * 256, [], 0, UNIGRAM
    with open(path, "rb") as f:
        data = f.read()
    for tag, value in _fields(data):
        if tag == 1:
            own = dict(_fields(value))
            piece, sort = own[1].decode(), own.get(3, 1)
            score, i = struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], len(raw)
            raw.append(b"")
            if sort == 6:
                byte_ids[int(piece[3:5], 16)] = i
                raw[i] = bytes([int(piece[3:5], 16)])
            elif sort in (1, 4):
                normal.append((piece, i, score))
                raw[i] = piece.replace(SPACE, " ").encode()
            elif sort == 2:
                unknown = i
        elif tag == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    return Pieces(kind, normal, byte_ids, unknown, raw)


def merged(word: str, scores: dict[str, float]) -> list[str]:
    """One word's BPE segmentation by plain best-first merging; serves words too long for the native fold."""
    parts = list(word)
    while True:
        open_ = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not open_:
            return parts
        i = min(open_)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def in_rank_order(pieces: Pieces) -> bool:
    """Whether best-first merging of every piece's own characters gives the piece, by merges in rising rank.

    What is merged inside a piece's span hangs on that span alone, so if this holds for all pieces it holds in every word: a merge
    never opens one of a better rank, and one pass over a word's edges by (rank, start) takes the merges that best-first merging takes.
    """
    rank = {p: -s for p, _, s in pieces.normal}
    for piece in rank:
        parts, last = list(piece), -np.inf
        while open_ := [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]:
            best, i = min(open_)
            if best < last:
                return False
            last = best
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if parts != [piece]:
            return False
    return True


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _start(edge: Column) -> Column:
    return F.shiftright(edge, 6).bitwiseAND(63).cast("int")


def _end(edge: Column) -> Column:
    return edge.bitwiseAND(63).cast("int")


def boundaries(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(*columns of words, bits): for distinct words of at most BITS code points the places where the model cuts them, as bits of a bigint.

    ``words`` has a column word, and others that are kept.  The lattice of each word is exploded, equi-joined, grouped and folded.
    An edge is one bigint: the rank of its score, its start and its end.
    """
    spark, keys = words.sparkSession, words.columns
    least = 1 if pieces.kind == UNIGRAM else 2
    scores = sorted({s for p, _, s in pieces.normal if len(p) >= least}, reverse=True)
    rank = {s: k for k, s in enumerate(scores)}
    table = F.broadcast(spark.createDataFrame([(p, rank[s]) for p, _, s in pieces.normal if len(p) >= least], "piece string, rank long"))  # a fixed vocabulary
    n = F.length("word")
    starts = words.select(*keys, F.explode(F.sequence(F.lit(0), F.greatest(n - least, F.lit(0)))).alias("start"))
    sizes = F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(pieces.longest), n - F.col("start"))))
    spans = starts.select(*keys, "start", F.explode(sizes).alias("size")).withColumn("piece", F.substr("word", F.col("start") + 1, F.col("size")))
    # the first span of each word is kept, known or not, so that no word is lost; for a best path every single character is
    kept = F.col("rank").isNotNull() | (F.col("size") == 1) | ((F.col("start") == 0) & (F.col("size") == least))
    known = F.when(F.col("size") == 1, F.coalesce("rank", F.lit(len(scores)))).otherwise(F.col("rank"))
    edges = spans.join(table, "piece", "left").where(kept).select(*keys, (F.shiftleft(known, 12) + F.col("start") * 64 + F.col("start") + F.col("size")).alias("edge"))
    lattice = edges.groupBy(*keys).agg(F.collect_list("edge").alias("edges"))
    if pieces.kind == UNIGRAM:
        fold = _best_path(n, [*scores, min(scores, default=0.0) - 10])
    else:
        fold = _merge_path(n, in_rank_order(pieces))
    return lattice.select(*keys, fold.alias("bits"))


def _best_path(n: Column, scores: list[float]) -> Column:
    """Viterbi: the boundaries of the path of greatest score; of equal ones the one whose last piece begins first."""
    table = F.from_json(F.lit(json.dumps(scores)), "array<double>")
    nodes = F.aggregate(
        F.sequence(F.lit(1), n),
        F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"))),
        lambda found, end: F.concat(
            found,
            F.array(
                F.array_max(
                    F.transform(
                        F.filter("edges", lambda e: _end(e) == end),
                        lambda e: F.struct((F.element_at(found, _start(e) + 1)["score"] + F.element_at(table, F.shiftright(e, 12).cast("int") + 1)).alias("score"), (-_start(e)).alias("back")),
                    )
                )
            ),
        ),
    )
    path = F.struct(n.alias("at"), _bit(n).alias("bits"), nodes.alias("nodes"))

    def back(state: Column, _: Column) -> Column:
        at = -F.element_at(state["nodes"], state["at"] + 1)["back"]
        return F.when(state["at"] == 0, state).otherwise(F.struct(at.alias("at"), state["bits"].bitwiseOR(_bit(at)).alias("bits"), state["nodes"].alias("nodes")))

    return F.aggregate(F.sequence(F.lit(1), n), path, back, lambda s: s["bits"])


def _merge_path(n: Column, once: bool) -> Column:
    """BPE: all boundaries are set; a merge that is open, whose two ends are set with one boundary between them, clears that one.

    Merges are taken by rank and then from the left: in one pass where ``in_rank_order`` holds, else the best open one n - 1 times.
    """
    merges = F.sort_array(F.filter("edges", lambda e: e.isNotNull()))
    every = (_bit(n) - 1) + _bit(n)

    def inner(bits: Column, edge: Column) -> Column:
        return bits.bitwiseAND(_bit(_end(edge)) - _bit(_start(edge) + 1))

    def is_open(bits: Column, edge: Column) -> Column:
        outer = _bit(_start(edge)) + _bit(_end(edge))
        return (bits.bitwiseAND(outer) == outer) & (F.bit_count(inner(bits, edge)) == 1)

    if once:
        return F.aggregate(merges, every, lambda bits, e: F.when(is_open(bits, e), bits - inner(bits, e)).otherwise(bits))
    state = F.struct(every.alias("bits"), merges.alias("merges"))

    def step(s: Column, _: Column) -> Column:
        best = F.get(F.filter(s["merges"], lambda e: is_open(s["bits"], e)), F.lit(0))
        return F.struct((s["bits"] - F.coalesce(inner(s["bits"], best), F.lit(0).cast("long"))).alias("bits"), s["merges"].alias("merges"))

    return F.aggregate(F.sequence(F.lit(1), n), state, step, lambda s: s["bits"])


class Spelled:
    """The ids of a word: cut at given boundaries, or segmented here where it is longer than BITS."""

    def __init__(self, pieces: Pieces):
        self.ids = {p: i for p, i, _ in pieces.normal}
        self.scores = {p: s for p, _, s in pieces.normal}
        self.byte_ids, self.unknown, self.kind, self.longest = pieces.byte_ids, pieces.unknown, pieces.kind, pieces.longest

    def of(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode()] if min(self.byte_ids) >= 0 else [self.unknown])]

    def cut(self, word: str, bits: int) -> list[int]:
        parts, at = [], 0
        bits >>= 1
        while bits:
            size = (bits & -bits).bit_length()
            parts.append(word[at : at + size])
            at += size
            bits >>= size
        try:
            return [self.ids[p] for p in parts]
        except KeyError:
            return self.of(parts)

    def alone(self, word: str, whole: bool) -> list[int]:
        return [self.ids[word]] if whole and word in self.ids else self.long(word)

    def long(self, word: str) -> list[int]:
        return self.of(merged_long(word, self.scores) if self.kind == BPE else best_path(word, self.scores, self.longest))


def segment(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) for distinct ``words``: the lattice of each word, folded by the model's own rule.

    Words of over BITS code points are segmented one at a time.  Null words are left out; an empty word has no ids.
    """
    words = words.select("word").where("word is not null")
    n, spelled = F.length("word"), Spelled(pieces)
    short = boundaries(words.where(n.between(1, BITS)), pieces)
    both = short.union(words.where((n == 0) | (n > BITS)).select("word", F.lit(None).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spelled.long(w) if b is None else spelled.cut(w, b) for w, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["word", "ids"])

    return both.mapInArrow(run, "word string, ids array<int>")


def best_path(word: str, scores: dict[str, float], longest: int) -> list[str]:
    """One word's Viterbi segmentation; an unknown character scores ten below the least piece."""
    least = min(scores.values(), default=0.0) - 10
    best, back = [0.0], [0]
    for end in range(1, len(word) + 1):
        options = [(best[s] + scores.get(word[s:end], least), -s) for s in range(max(0, end - longest), end) if word[s:end] in scores or end - s == 1]
        top = max(options)
        best.append(top[0])
        back.append(-top[1])
    parts, end = [], len(word)
    while end:
        parts.append(word[back[end] : end])
        end = back[end]
    return parts[::-1]


def merged_long(word: str, scores: dict[str, float]) -> list[str]:
    """The same as ``merged`` with a heap and linked neighbours, for words of any length."""
    part: list[str | None] = list(word)
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(part) and (both := part[i] + part[after[i]]) in scores:
            heapq.heappush(heap, (-scores[both], i, both))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if part[i] is not None else len(part)
        if j >= len(part) or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        after[i] = after[j]
        if after[j] < len(part):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in part if p is not None]


def _chunks(docs: DataFrame, pattern: str) -> DataFrame:
    """(chunk, words, data): parts of some documents each, as numbers into their chunk's own list of distinct words, both compressed.

    The first row of a chunk holds its words.  The chunk's name is the hash of its content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pack = re.compile(pattern), zstandard.ZstdCompressor(level=3)
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        ids, at, parts, size, whole = [], [], [], 0, 0

        def part() -> bytes:
            counts = np.fromiter(map(len, at), np.int64, len(at))
            head = _stream(pa.table({"doc_id": pa.chunked_array(ids), "count": counts}))
            # byte by byte of all numbers: the higher ones are nearly all zero
            planes = np.concatenate(at).astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes()
            return pack.compress(len(head).to_bytes(8, "little") + head + planes)

        def chunk() -> pa.RecordBatch:
            words = pack.compress(_stream(pa.table({"word": pa.array(number, pa.string())})))
            name = xxhash.xxh64(words)
            for p in parts:
                name.update(p)
            names = np.full(len(parts), np.array([name.intdigest()], np.uint64).view(np.int64)[0])
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([words] + [b""] * (len(parts) - 1), pa.binary()), pa.array(parts, pa.binary())], names=["chunk", "words", "data"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                ids.append(rows.column(0))
                for text in rows.column(1).to_pylist():
                    found = split.findall(SPACE + text.replace(" ", SPACE)) if text else []
                    at.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
                    size += len(text)
                if size >= PART:
                    parts.append(part())
                    ids, at, size, whole = [], [], 0, whole + size
                if whole >= CHUNK:
                    yield chunk()
                    number.clear()
                    parts, whole = [], 0
        if ids:
            parts.append(part())
        if parts:
            yield chunk()

    return docs.mapInArrow(run, "chunk long, words binary, data binary")


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _words_in(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all().column("word").combine_chunks()


def looked_up_words(words: pa.Array, whole: pa.Array) -> np.ndarray:
    """The places of a chunk's words that are looked up: all but whole pieces and long words, in the order of their texts.

    In that order neighbours share their beginnings and numbers rise, which a shuffle's compression takes out.
    """
    order = pc.sort_indices(words)
    asked = pc.and_(pc.less_equal(pc.utf8_length(words), BITS), pc.invert(pc.is_in(words, value_set=whole)))
    return order.filter(asked.take(order)).to_numpy()[:NUMBERS].astype(np.int64)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row: the model's piece ids of its whole text; ``_encoded`` tells how."""
    return _encoded(docs, pieces, id_col, text_col).select("doc_id", F.col("ids").cast("array<int>").alias("ids"))


def encode_and_decode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and the text decoded from the ids.

    The table is a subquery of one row.  As a literal, a megabyte of it would stand in every text that Spark makes of the plan, anew at each step
    of adaptive execution, in the driver's memory.
    """
    rows = _encoded(docs, pieces, id_col, text_col)
    table = rows.sparkSession.createDataFrame([(_bytes_of(pieces),)], "pieces array<string>").scalar()
    # a function with a body may not name a subquery, so a column does; used once, it is put where it is used, and no row holds the table
    rows = rows.withColumn("piece_table", table)
    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids"), _text(F.col("ids"), F.col("piece_table")).alias("decoded"))


def _encoded(docs: DataFrame, pieces: Pieces, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids) for every row, the ids as small numbers where they fit.

    As in the model's own normaliser a blank is put before the text and no white space is dropped; characters that are no
    piece are spelled by their bytes.  A null or empty text has no ids.  Null ids and repeated rows keep their rows; an empty table
    gives none.  Texts become numbers of words before their one shuffle; beside them travel only the distinct words of a chunk
    and, on the way back, their boundaries.
    """
    width = shuffle_width(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    # fewer and larger chunks have fewer words in all; no shuffle
    rows = rows.coalesce(max(1, -(-rows.rdd.getNumPartitions() // MERGED_PARTITIONS)))
    chunks = _chunks(rows, pieces.word).repartition(width, "chunk")
    # where pieces are merged from their own characters, a word that is a piece is found in the table at once
    whole = pa.array([p for p, _, _ in pieces.normal] if pieces.kind == BPE and in_rank_order(pieces) else [], pa.string())

    def words_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not (blob := blob.as_py()):
                    continue
                words = _words_in(blob)
                words = words.take(pa.array(looked_up_words(words, whole)))
                for begin in range(0, len(words), 10_000):
                    part = words.slice(begin, 10_000)
                    at = pa.array(np.arange(begin, begin + len(part), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), at, part], names=["chunk", "at", "word"])

    # all columns and no filter that the join would add: one exchange of chunks and one of words serve their two readers each
    used = chunks.mapInArrow(words_of_chunks, "chunk long, at int, word string").where("chunk is not null and at is not null and word is not null").repartition(width, "word")
    distinct = used.groupBy("word").agg(F.min("chunk").alias("first_chunk"), F.min("at").alias("first_at"))
    known = boundaries(distinct, pieces)
    inner = F.shiftright("bits", 1).bitwiseAND(_bit(F.length("word") - 1) - 1)
    packed = (F.shiftleft(F.col("at").cast("long"), BITS - 1) + inner).alias("packed")
    looked_up = used.join(known, "word").where("chunk >= first_chunk and at >= first_at").select("chunk", packed).repartition(width, "chunk")
    spelled = Spelled(pieces)
    narrow = len(pieces.texts) <= 1 << 15  # ids come from the tasks in as few bytes as they need
    kind = pa.int16() if narrow else pa.int32()

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        words = _words_in(next(b for x in left.column("words") if (b := x.as_py())))
        asked = looked_up_words(words, whole)
        bits = np.full(len(words), -1, np.int64)
        packed = right.column("packed").to_numpy()
        bits[asked[packed >> (BITS - 1)]] = packed & ((1 << (BITS - 1)) - 1)
        if (bits[asked] < 0).any():
            raise RuntimeError("a word of a chunk was not looked up")
        size, flat = np.zeros(len(words), np.int32), array("i")
        for begin in range(0, len(words), SLICE):
            for i, (w, b) in enumerate(zip(words.slice(begin, SLICE).to_pylist(), bits[begin : begin + SLICE].tolist()), begin):
                found = spelled.cut(w, (b << 1) | (1 << len(w))) if b >= 0 else spelled.alone(w, len(whole) > 0)
                size[i] = len(found)
                flat.extend(found)
        del words, bits
        flat = np.frombuffer(flat, np.int32).astype(kind.to_pandas_dtype()) if len(flat) else np.empty(0, kind.to_pandas_dtype())
        offset = np.cumsum(size, dtype=np.int64) - size
        out = []
        for data in left.column("data"):
            data = zstandard.decompress(data.as_py())
            cut = 8 + int.from_bytes(data[:8], "little")
            head = pa.ipc.open_stream(data[8:cut]).read_all()
            planes = np.frombuffer(data, np.uint8, offset=cut).reshape(4, -1)
            rows = np.concatenate(([0], np.cumsum(head.column("count").to_numpy())))
            ids = head.column("doc_id").combine_chunks()
            begin = 0
            while begin < len(ids):
                end = max(begin + 1, int(np.searchsorted(rows, rows[begin] + BLOCK, "right")) - 1)
                own = np.ascontiguousarray(planes[:, rows[begin] : rows[end]].T).view("<u4").ravel()
                ends = np.concatenate(([0], np.cumsum(size[own])))
                take = np.repeat(offset[own] - ends[:-1], size[own]) + np.arange(ends[-1])
                bounds = pa.array(ends[rows[begin : end + 1] - rows[begin]], pa.int32())
                out.append(pa.table([ids.slice(begin, end - begin), pa.ListArray.from_arrays(bounds, pa.array(flat[take]))], names=["doc_id", "ids"]))
                begin = end
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(kind))], names=["doc_id", "ids"])

    return chunks.groupBy("chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(assembled, f"doc_id long, ids array<{'smallint' if narrow else 'int'}>")


def decode(ids: Column, pieces: Pieces) -> Column:
    """The text of a column of ids: pieces' bytes joined, the blank put before the text taken off; null for null.

    Ids outside the table and control pieces give nothing.  The whole table stands in the plan's text; ``encode_and_decode`` spares that.
    """
    return _text(ids, F.from_json(F.lit(json.dumps(_bytes_of(pieces))), "array<string>"))


def _bytes_of(pieces: Pieces) -> list[str]:
    return [t.hex() for t in pieces.texts]


def _text(ids: Column, table: Column) -> Column:
    code = F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i + 1), F.lit(""))), "")
    return F.regexp_replace(F.decode(F.unhex(code), "UTF-8"), "^ ", "")

"""TF-IDF retrieval by postings, and tiered name search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import cut


#: Words that are weighed at once, and documents that share one table of frequencies.
WORDS, DOCUMENTS = 200_000, 2_000
#: Postings (a term of a document) that a task holds before it sends how many documents of a slot hold each term.
SENT_TERMS = 8_000_000
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one finaliser of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """The hashes of words, and the numbers and hashes of their runs, remembering some."""

    def __init__(self):
        self.word: dict[str, int] = {}
        self.runs: dict[str, np.ndarray] = {}
        self.number: dict[str, int] = {}
        self.run: list[int] = []

    def of(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        if len(self.word) > 3 * WORDS:
            self.__init__()
        for w in words:
            if w not in self.word:
                self.word[w] = xxhash.xxh64_intdigest(w.encode(), 1)
                self.runs[w] = np.array([self._numbered(t) for t in word_runs(w)], np.int64)
        return np.array([self.word[w] for w in words], np.uint64), [self.runs[w] for w in words]

    def _numbered(self, run: str) -> int:
        if run not in self.number:
            self.number[run] = len(self.run)
            self.run.append(xxhash.xxh64_intdigest(run.encode(), 2))
        return self.number[run]


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(first) + second * _PAIR)


def _terms_of(doc: np.ndarray, row: np.ndarray, code: np.ndarray, words: list[str], hashes: Hashes) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(half, document, kind, tf, hash of each kind), by document: the words, the pairs of neighbours of a row and the runs of words of some whole documents.

    Numbers of a document, its kinds and counts are packed, so that they are sorted as plain numbers.
    """
    word, runs = hashes.of(words)
    n = max(1, len(words))
    own, times = np.unique(doc * n + code, return_counts=True)
    beside = np.flatnonzero(row[1:] == row[:-1])
    pair, met = np.unique((doc[beside] * n + code[beside]) * n + code[beside + 1], return_counts=True)
    pairs = pair_hashes(word[pair // n % n], word[pair % n]) if len(pair) else np.empty(0, np.uint64)
    # the runs of each distinct word of each text, as often as the word comes there
    size = np.array([len(r) for r in runs], np.int64)
    flat, begin = np.concatenate([*runs, np.zeros(0, np.int64)]), np.cumsum(size) - size
    kind, of, width = own % n, own // n, max(1, len(hashes.run))
    m = size[kind]
    at = np.repeat(begin[kind] - np.cumsum(m) + m, m) + np.arange(m.sum())
    bits = np.int64(int(times.max(initial=1)).bit_length())
    packed = np.sort(((np.repeat(of, m) * width + flat[at]) << bits) | np.repeat(times, m))
    key = packed >> bits
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    tf = np.add.reduceat(packed & ((np.int64(1) << bits) - 1), first) if len(key) else np.empty(0, np.int64)
    key = key[first]
    return [(0, of, kind, times, word), (0, pair // (n * n), np.arange(len(pair)), met, pairs), (1, key // width, key % width, tf, np.array(hashes.run, np.uint64))]


def word_runs(word: str) -> tuple[str, ...]:
    """The runs of two to four characters of a word with a blank on either side, repeats included."""
    padded = f" {word} "
    return tuple(padded[i : i + size] for size in (2, 3, 4) for i in range(len(padded) - size + 1))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of rows (slot, id, scope, w), sorted by slot and id, blocks of whole documents of one slot, about WORDS words at once: (slot, ids, scopes, document, row, kind of each word, kinds)."""

    def block(rows: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        ids = t.column(1).to_pylist()
        new = np.array([True, *(x != y for x, y in zip(ids[1:], ids))])
        of = np.cumsum(new) - 1
        scope: list = [None] * int(of[-1] + 1)
        for i, x in zip(of, t.column(2).to_pylist()):
            scope[i] = x if scope[i] is None or (x is not None and x < scope[i]) else scope[i]
        word = t.column(3).flatten().dictionary_encode()
        row = np.repeat(np.arange(t.num_rows), np.diff(t.column(3).offsets.to_numpy()))
        return t.column(0)[0].as_py(), [ids[i] for i in np.flatnonzero(new)], scope, of[row], row, word.indices.to_numpy().astype(np.int64), word.dictionary.to_pylist()

    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        slot, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = batch.column(3).offsets.to_numpy()
        start = 0
        for i in range(batch.num_rows):
            if last is not None and (slot[i] != last[0] or (ids[i] != last[1] and n + at[i] - at[start] >= WORDS)):
                held.append(batch.slice(start, i - start))
                yield block([b for b in held if b.num_rows])
                held, n, start = [], 0, i
            last = slot[i], ids[i]
        held.append(batch.slice(start))
        n += at[batch.num_rows] - at[start]
    if last is not None:
        yield block([b for b in held if b.num_rows])


def _placed(corpus: DataFrame, slots: int) -> DataFrame:
    """(slot, id, scope, text): a document in one slot."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")
    return corpus.select(slot.alias("slot"), F.col("doc_id").cast("long").alias("id"), F.col("scope").cast("string").alias("scope"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _words() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")


def frequencies(corpus: DataFrame, asked: np.ndarray, groups: int, width: int) -> DataFrame:
    """(slot, term, df): for each slot the hashes of its terms that two documents or more hold, or that are ``asked`` (sorted), as arrays, and how many hold them; all terms are added up in ``groups``.

    A slot sends a term once, and not once a document; what is not told is held by one document.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, parts = Hashes(), None, []

        def sent() -> Iterator[pa.RecordBatch]:
            term, place = np.unique(np.concatenate(parts), return_counts=True)
            group = (term >> np.uint64(33)).astype(np.int64) * groups >> 31
            first = np.searchsorted(group, np.arange(groups + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups, dtype=np.int32)), pa.array(np.full(groups, now, np.int32)), pa.ListArray.from_arrays(pa.array(first), pa.array(term.view(np.int64))), pa.ListArray.from_arrays(pa.array(first), pa.array(place.astype(np.int32)))], names=["part", "slot", "term", "df"])

        for slot, _, _, doc, row, code, words in _documents(batches):
            if slot != now and parts:
                yield from sent()
                parts = []
            now = slot
            parts += [term[kind] for _, _, kind, _, term in _terms_of(doc, row, code, words, hashes)]
            if sum(map(len, parts)) > SENT_TERMS:
                yield from sent()
                parts = []
        if parts:
            yield from sent()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            slot = np.repeat([s for s, *_ in rows], [len(t) for _, t, _ in rows])
            term, code = np.unique(np.concatenate([t for _, t, _ in rows]), return_inverse=True)
            df = np.bincount(code, np.concatenate([n for *_, n in rows]), len(term)).astype(np.int32)
            keep = ((df >= 2) | np.isin(term.view(np.uint64), shared.value))[code]
            slot, code = slot[keep], code[keep]
            order = np.argsort(slot, kind="stable")
            slot, code = slot[order], code[order]
            own, first = np.unique(slot, return_index=True)
            at = pa.array(np.append(first, len(slot)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(term[code])), pa.ListArray.from_arrays(at, pa.array(df[code]))], names=["slot", "term", "df"])

        rows, now = [], None
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != now and rows:
                    yield from told(rows)
                    rows = []
                now = part
                rows.append((batch.column(1)[i].as_py(), batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()))
        if rows:
            yield from told(rows)

    shared = corpus.sparkSession.sparkContext.broadcast(asked)
    sent = corpus.mapInArrow(held, "part int, slot int, term array<long>, df array<int>").where("size(term) > 0")
    return sent.repartition(width, "part").sortWithinPartitions("part").mapInArrow(added, "slot int, term array<long>, df array<int>")


#: Cells (terms times queries) of the table of query weights that goes to every task, 64 MB; more queries are asked in blocks.
CELLS = 8_000_000


def nearest(corpus: DataFrame, queries: DataFrame, k: int, least: float = 0.02) -> DataFrame:
    """(query_id, doc_id, score, own): for each query at least the k nearest documents of its own scope and the k nearest of others, among some that are further.

    ``corpus`` has doc_id, text, scope; ``queries`` has query_id, text, scope; a document is ``own`` if the scopes are equal.  The score is the mean of a
    cosine over words and pairs and one over characters of words (those of three documents or more), so that inflected or misspelled words count too.  Weights are
    1 + ln(tf) times a smoothed idf.  Documents are placed by id in slots of about DOCUMENTS; a slot learns how many documents hold its terms (``frequencies``), and
    terms are told apart by 64-bit hashes.  The weights of the queries' terms, which are few, go to the documents in blocks of CELLS, and of each block of documents only
    the nearest come out, so that no term of a document is shuffled.
    """
    spark = corpus.sparkSession
    n_docs, width = corpus.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed(corpus, slots := max(width, -(-n_docs // DOCUMENTS)))
    asked = _asked(queries.select(F.col("query_id").alias("doc_id"), "text", "scope"))
    terms = np.unique(asked["term"].to_numpy(np.uint64))
    split = placed.repartition(width, "slot").sortWithinPartitions("slot", "id").select("slot", "id", "scope", _words())
    tables = cut(frequencies(split, terms, slots, width))
    asked = _of_length_one(asked, _frequencies_of(tables, terms), n_docs)
    own = dict(queries.select("query_id", F.col("scope").cast("string")).collect())
    none = {"text": F.lit(None).cast("string"), "id": F.lit(None).cast("long"), "scope": F.lit(None).cast("string"), "term": F.lit(None).cast("array<long>"), "df": F.lit(None).cast("array<int>")}
    columns = ["slot", "kind", "id", "scope", "text", "term", "df"]
    both = tables.withColumn("kind", F.lit(0)).withColumns({c: none[c] for c in ("id", "scope", "text")}).select(columns).union(placed.withColumn("kind", F.lit(1)).withColumns({c: none[c] for c in ("term", "df")}).select(columns))
    docs = both.repartition(width, "slot").sortWithinPartitions("slot", "kind", "id").select("slot", "id", "scope", _words(), "term", "df")
    ids, out = sorted(set(asked["query_id"])), None
    size = max(1, CELLS // max(1, asked["term"].nunique()))
    for begin in range(0, max(1, len(ids)), size):
        block = ids[begin : begin + size]
        part = _nearest_of(docs, asked[asked["query_id"].isin(block)], n_docs, block, [own.get(q) for q in block], k, least)
        out = part if out is None else out.union(part)
    return out


#: Documents that a term of each half must have to count: words and pairs, and characters.
MIN_DF = (1, 3)


def _asked(queries: DataFrame) -> pd.DataFrame:
    """(query_id, half, term, tf) of the queries, which are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for _, ids, _, doc, row, code, words in _documents(batches):
            for half, of, kind, tf, term in _terms_of(doc, row, code, words, hashes):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in of], pa.int64()), pa.array(np.full(len(of), half, np.int32)), pa.array(term[kind].view(np.int64)), pa.array(tf.astype(np.int64))], names=["query_id", "half", "term", "tf"])

    split = _placed(queries, 1).repartition(1, "slot").sortWithinPartitions("slot", "id").select("slot", "id", "scope", _words())
    found = split.mapInArrow(run, "query_id long, half int, term long, tf long").toPandas()
    return found.assign(term=found["term"].to_numpy(np.int64).view(np.uint64))


def _frequencies_of(tables: DataFrame, terms: np.ndarray) -> pd.Series:
    """How many documents hold each asked term, of those that one holds."""
    shared = tables.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, df = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            term, at = np.unique(term[keep := np.isin(term.view(np.uint64), shared.value)], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[keep][at])], names=["term", "df"])

    found = tables.select("term", "df").mapInArrow(run, "term long, df int").distinct().toPandas()
    return pd.Series(found["df"].to_numpy(np.int64), index=found["term"].to_numpy(np.int64).view(np.uint64))


def _idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((1 + n_docs) / (1 + df)) + 1


def _of_length_one(asked: pd.DataFrame, df: pd.Series, n_docs: int) -> pd.DataFrame:
    """(query_id, half, term, weight): weights of the queries' terms that enough documents hold."""
    x = asked.assign(df=df.reindex(asked["term"]).fillna(0).to_numpy(np.int64))
    x = x[x["df"].to_numpy() >= np.array(MIN_DF)[x["half"].to_numpy(int)]]
    x = x.assign(raw=(1 + np.log(x["tf"].to_numpy(float))) * _idf(x["df"].to_numpy(), n_docs))
    norm = np.sqrt((x["raw"] ** 2).groupby([x["query_id"], x["half"]]).transform("sum"))
    return x.assign(weight=x["raw"] / norm)[["query_id", "half", "term", "weight"]]


def _nearest_of(docs: DataFrame, asked: pd.DataFrame, n_docs: int, ids: list, scopes: list, k: int, least: float) -> DataFrame:
    """The nearest documents of each slot, from (slot, id, scope, w, term, df): a slot's table of frequencies comes before its documents."""
    tables = []
    for half in (0, 1):
        rows = asked[asked["half"] == half]
        used, row = np.unique(rows["term"].to_numpy(np.uint64), return_inverse=True)
        table = np.zeros((len(used), len(ids)))
        table[row, rows["query_id"].map({q: i for i, q in enumerate(ids)}).to_numpy(int)] = rows["weight"]
        tables.append((used, table))
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    scope_of = np.array([s is not None for s in scopes], bool), np.array(["" if s is None else s for s in scopes], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, told = Hashes(), {}

        def documents() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                listed = batch.column(4).is_valid()
                for slot, term, df in zip(*(batch.filter(listed).column(c) for c in (0, 4, 5))):
                    told.setdefault(slot.as_py(), []).append((term.values.to_numpy().view(np.uint64), df.values.to_numpy()))
                yield batch.filter(pc.invert(listed)).select([0, 1, 2, 3])

        def nearest_of(parts: list[tuple]) -> pa.RecordBatch:
            doc, scope, score = [i for ids, *_ in parts for i in ids], np.array([s for _, x, _ in parts for s in x], object), np.concatenate([x for *_, x in parts])
            inside = scope_of[0][None, :] & np.array([s is not None for s in scope], bool)[:, None] & (scope[:, None] == scope_of[1][None, :])
            rows = []
            for q in range(len(ids)):
                best = np.argsort(-score[:, q], kind="stable")  # documents of a slot come by id
                best = best[score[best, q] >= least]
                for side in (True, False):
                    rows += [(ids[q], doc[i], score[i, q], side) for i in best[inside[best, q] == side][:k]]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], names=["query_id", "doc_id", "score", "own"])

        now, known, many, parts = None, np.empty(0, np.uint64), np.empty(0, np.int32), []
        for slot, found, scope, doc, row, code, words in _documents(documents()):
            if slot != now:
                if parts:
                    yield nearest_of(parts)
                now, parts, lists = slot, [], told.pop(slot, [])
                known = np.concatenate([t for t, _ in lists] + [np.empty(0, np.uint64)])
                order = np.argsort(known)
                known, many = known[order], np.concatenate([n for _, n in lists] + [np.empty(0, np.int32)])[order]
            score = np.zeros((len(found), len(ids)))
            norm, kept = np.zeros((2, len(found))), []
            for half, of, kind, tf, term in _terms_of(doc, row, code, words, hashes):
                there = np.flatnonzero(np.bincount(kind, minlength=len(term))) if len(kind) < len(term) or half else np.arange(len(term))
                idf, place = np.zeros(len(term)), np.full(len(term), -1, np.int64)
                df = np.ones(len(there), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, term[there]), len(known) - 1)
                    df = np.where(known[at] == term[there], many[at], 1)
                idf[there] = _idf(df, n_docs) * (df >= MIN_DF[half])
                used, table = shared.value[half]
                if len(used):
                    at = np.minimum(np.searchsorted(used, term[there]), len(used) - 1)
                    place[there] = np.where((used[at] == term[there]) & (df >= MIN_DF[half]), at, -1)
                raw = (1 + np.log(tf)) * idf[kind]
                norm[half] += np.bincount(of, raw * raw, len(found))
                keep = np.flatnonzero(place[kind] >= 0)
                kept.append((half, of[keep], place[kind[keep]], raw[keep]))
            for half, of, place, raw in kept:
                used, table = shared.value[half]
                step = max(1, 2_000_000 // max(1, len(used)))
                for low in range(0, len(found), step) if len(of) else ():
                    s, e = np.searchsorted(of, (low, low + step))
                    own = np.zeros((min(step, len(found) - low), len(used)))
                    own[of[s:e] - low, place[s:e]] = raw[s:e] / np.sqrt(norm[half][of[s:e]])
                    score[low : low + step] += 0.5 * (own @ table)
            parts.append((found, scope, np.round(score, 6)))
        if parts:
            yield nearest_of(parts)

    return docs.mapInArrow(run, "query_id long, doc_id long, score double, own boolean")


def retrieve(corpus: DataFrame, queries: DataFrame, k: int, least: float = 0.02) -> DataFrame:
    """(query_id, doc_id, score, place): the k nearest documents of each query, ties by id."""
    found = nearest(corpus.withColumn("scope", F.lit(None).cast("string")), queries.withColumn("scope", F.lit(None).cast("string")), k, least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "doc_id", "score", "place")


def scoped(corpus: DataFrame, queries: DataFrame, inside: int, k: int, least: float = 0.02) -> DataFrame:
    """(query_id, doc_id, score, scope, place): at most ``inside`` hits of a query's own scope, then others up to ``k`` in all, each with the scope it came by; columns as in ``nearest``."""
    x = nearest(corpus, queries, max(inside, k), least)
    first = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "doc_id"))
    x = x.withColumn("scope", F.when(F.col("own") & (first <= inside), "own").otherwise("all"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("scope"), F.desc("score"), "doc_id"))
    return x.withColumn("place", place).where(F.col("place") <= k).select("query_id", "doc_id", "score", "scope", "place")


GRAM = 3


def tiered_search(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, name, tier) for distinct ``names`` (name) and ``wanted`` (wanted), the best tier of each only.

    Tier 0 is equal, 1 containing, 3 containing by the Hangul alone (two letters or more), 4 alike at both ends (two characters each, of four or more).  Every tier is an equi-join: a name that contains
    what is wanted holds its rarest gram, so the postings of one gram are read; what is shorter than a gram meets
    the names by itself.  Nulls and empty strings match nothing.
    """
    names, wanted = names.where("name != ''").select("name").distinct(), wanted.where("wanted != ''").select("wanted").distinct()

    def grams(c: str, size: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(size))))

    exact = wanted.join(names, F.col("wanted") == F.col("name")).select("wanted", "name", F.lit(0).alias("tier"))

    def containing(names: DataFrame, wanted: DataFrame) -> DataFrame:
        """(wanted, name) of distinct names that hold what is wanted."""
        postings = names.where(F.length("name") >= GRAM).select("name", F.explode(grams("name", GRAM)).alias("gram"))
        frequency = postings.groupBy("gram").agg(F.count("*").alias("n"))
        asked = wanted.where(F.length("wanted") >= GRAM).select("wanted", F.explode(grams("wanted", GRAM)).alias("gram"))
        rarest = asked.join(frequency, "gram", "left").groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
        holding = rarest.select("wanted", "g.gram").join(postings, "gram").where(F.col("name").contains(F.col("wanted")))
        short = names.select("name", F.explode(F.array_union(grams("name", 1), grams("name", 2))).alias("gram")).where(F.length("gram") < GRAM)
        return holding.select("wanted", "name").union(short.join(wanted, F.col("gram") == F.col("wanted")).select("wanted", "name"))

    holding = containing(names, wanted)
    hangul = lambda df, c: df.select(c, F.regexp_replace(c, "[^가-힣]", "").alias("key")).where(F.length("key") >= 2)
    n, w = hangul(names, "name"), hangul(wanted, "wanted")
    keys = containing(n.select(F.col("key").alias("name")).distinct(), w.select(F.col("key").alias("wanted")).distinct()).select(F.col("wanted").alias("wkey"), F.col("name").alias("nkey"))
    korean = keys.join(w, F.col("wkey") == F.col("key")).drop("key").join(n, F.col("nkey") == F.col("key")).select("wanted", "name", F.lit(3).alias("tier"))
    ends = lambda df, c: df.where(F.length(c) >= 4).withColumn("ends", F.concat(F.substring(c, 1, 2), F.right(c, F.lit(2))))
    alike = ends(wanted, "wanted").join(ends(names, "name"), "ends").select("wanted", "name", F.lit(4).alias("tier"))
    every = exact.union(holding.withColumn("tier", F.lit(1))).union(korean).union(alike).groupBy("wanted", "name").agg(F.min("tier").alias("tier"))
    best = every.groupBy("wanted").agg(F.min("tier").alias("tier"))
    return every.join(best, ["wanted", "tier"]).select("wanted", "name", "tier")

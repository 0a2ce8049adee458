"""SpotSigs document fingerprints.

A signature is an anchor (a common word) with the chain of content words that follows it; a fingerprint is the
sorted set of signature hashes.  Near-duplicate search partitions fingerprints by set length: at Jaccard
t sets of lengths m <= n can only be alike if m >= t * n, so a set meets its own partition and the next one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shuffle_width, spans, texts, whole_groups
from tidemark.llm.components import connected_components

#: Common words of English, German, French and Spanish after which chains begin.
ANCHORS = frozenset(
    "the of and to in is was a that for it on as with be by this are at from or an "
    "der die das und ist ein eine zu den von mit auf dem des für nicht sich auch im "
    "le la les et de des un une est du en que qui dans pour par sur au "
    "el los las y del que una por con para su lo al es".split()
)
#: Content words in a chain, and after how many of them without an anchor each one begins a chain.
CHAIN, GAP = 2, 12
SIMILARITY = 0.8
#: Stands for a null id, which comes last in descending order.
NO_ID = -(2**63)
#: Hex digits of a signature in a fingerprint.
DIGITS = 8

_WORD = re.compile(r"[^\W_]+")


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit signature hashes of a text.

    Repeats of a signature are told apart by their number, so that sets compare as multisets.  Where no anchor has come for ``GAP``
    content words, and before the first one, every content word begins a chain, so that texts with few anchors or in another language have signatures too.  A chain cut off by the end of the text counts as it is.
    A text without words is one signature, itself; an empty text has none.
    """
    words = _WORD.findall(text.lower())
    if not words:
        return np.array([xxhash.xxh32_intdigest(text.encode())] if text else [], np.uint32)
    content, spots, since = [], [], GAP
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
            since = 0
        else:
            if since >= GAP:
                spots.append(("", len(content)))
            since += 1
            content.append(w)
    found = Counter([" ".join((w, *content[i : i + CHAIN])) for w, i in spots])
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(s, k) for s, n in found.items() for k in range(n)], np.uint32))


def encoded(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two signature sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row; equal texts have equal fingerprints, an empty or null text has ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encoded(signatures(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def length_partition(size: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The number of a set's length partition: powers of 1 / similarity, so that alike sets are in the same or neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / -np.log(similarity) + 1e-9).astype(np.int64)


def linked(at: np.ndarray, up: np.ndarray, packed: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs that link the alike sets of one group: packed signatures, the group's signature being each set's ``at``-th in the common order.

    Sets of the partition below (``up``) meet each other in their own group.  Two sets are compared only if what follows the group's signature can suffice:
    in the group of the first signature that both have it does, if they are alike.
    """
    size = np.array([len(x) // 4 for x in packed])
    free = np.arange(len(size))

    def candidates(x: int, of: np.ndarray) -> np.ndarray:
        small, large = np.minimum(size[x], size[of]), np.maximum(size[x], size[of])
        least = np.ceil((small + large) * (similarity / (1 + similarity)) - 1e-9)
        return of[(small >= similarity * large) & (np.minimum(size[x] - at[x], size[of] - at[of]) >= least) & ~(up[x] & up[of])]

    if up.all() or (len(size) <= 64 and not any(len(candidates(x, free[x + 1 :])) for x in free)):
        return
    number = np.unique(np.frombuffer(b"".join(packed), ">u4"), return_inverse=True)[1]
    sets = np.split(number, np.cumsum(size)[:-1])
    mark = np.zeros(int(number.max()) + 1, np.int32)
    while len(free):
        seed, free = int(free[0]), free[1:]
        todo = [seed]
        while todo and len(free):
            x = todo.pop()
            near = candidates(x, free)
            if not len(near):
                continue
            mark[sets[x]] = 1
            both = np.add.reduceat(mark[np.concatenate([sets[j] for j in near])], np.cumsum(size[near]) - size[near])
            mark[sets[x]] = 0
            near = near[both / (size[x] + size[near] - both) >= similarity]
            yield from ((seed, int(j)) for j in near)
            todo += near.tolist()
            free = np.setdiff1d(free, near, assume_unique=True)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): classes of documents linked by a likeness of ``similarity`` or more.

    Equal fingerprints are one class from the start.  Candidates share a length partition (or neighbouring ones) and a signature of
    their prefix: of a set of n sorted signatures, rarest first, the first n - ceil(similarity * n) + 1; alike sets always share one.
    Inside a group a set is compared exactly with those not linked yet (see ``linked``), so a group of copies gives a star, not all pairs.  Empty texts form one class.  A null doc_id keeps its row with its class's id.
    """
    rows = cut(fingerprints(docs, id_col, text_col).select("doc_id", F.xxhash64("fingerprint").alias("fp"), "fingerprint"))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min("fingerprint").alias("fingerprint"))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                sets = [decoded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])), pa.array(np.concatenate(sets).astype(np.int64))], names=["fp", "sig"])

    exploded = classes.where("fingerprint != ''").select("fp", "fingerprint").mapInArrow(parted, "fp long, sig long")
    frequency = exploded.groupBy("sig").agg(F.count("*").alias("df"))
    ordered = exploded.join(frequency.where("df > 1"), "sig").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("order"))
    size = F.length("fingerprint") / DIGITS
    part = F.floor(F.log(size) / F.lit(-float(np.log(similarity))) + 1e-9)
    # with a set of its own partition or the one below a set shares at least its similarity; with one of the partition above, whose sets have a least length, more
    above = F.greatest(size, F.pow(F.lit(1 / similarity), part + 1) * (1 - 1e-6))
    own = size - F.ceil(size * similarity - 1e-9) + 1
    up = size - F.ceil((size + above) * (similarity / (1 + similarity)) - 1e-9) + 1
    roles = F.explode(F.array(F.struct(part.alias("part"), own.cast("int").alias("prefix"), F.lit(False).alias("up")), F.struct((part + 1).alias("part"), up.cast("int").alias("prefix"), F.lit(True).alias("up"))))
    # signatures of one document only come before all others and meet nothing: they use up the prefix
    keyed = ordered.join(classes, "fp").select("fp", "order", (size - F.size("order")).cast("int").alias("alone"), F.unhex("fingerprint").alias("set"), roles.alias("r")).where("r.prefix > alone")
    keyed = keyed.select("fp", "set", "alone", "r.part", "r.up", F.posexplode(F.slice("order", F.lit(1), F.col("r.prefix") - F.col("alone"))).alias("at", "o"))
    keyed = keyed.select(F.xxhash64("o.sig", "part").alias("key"), "fp", (F.col("alone") + F.col("at")).alias("at"), "up", "set").repartition(shuffle_width(docs.sparkSession), "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, at, up, packed in whole_groups(batches, 5):
            out = [(fp[s + x], fp[s + y]) for s, e in zip(*spans(key)) if e - s > 1 for x, y in linked(at[s:e], up[s:e], packed[s:e], similarity)]
            found = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    roots = connected_components(keyed.mapInArrow(run, "a long, b long")).withColumnRenamed("node", "fp")
    rooted = classes.select("fp", "least_id").join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = rooted.join(rooted.groupBy("component").agg(F.min("least_id").alias("component_id")), "component")
    return rows.select("doc_id", "fp").join(named.select("fp", "component_id"), "fp").select("doc_id", "component_id")


def in_descending_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, doc_id, text, halo): the rows in descending (doc_id, text), sorted within partitions, each bucket with the row after its last.

    Ids alone are range-partitioned first; from each range's bounds every row knows its bucket, so texts are shuffled once.  The row that begins
    a bucket is also sent, as halo, to the bucket before it; the very first one to the last.  A null id is ``NO_ID``, the least.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    ranged = rows.select("doc_id").repartitionByRange(shuffle_width(spark), F.desc("doc_id")).groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    ranges = sorted((r.high, r.low) for r in ranged.collect())[::-1]  # one row a partition
    if not ranges:
        return rows.select(F.lit(0).alias("bucket"), "doc_id", "text", F.lit(False).alias("halo"))
    lows = [low for _, low in ranges]
    bounds, steps = F.array(*[F.lit(x) for x in lows]), [1 << k for k in reversed(range(len(lows).bit_length()))]
    # how many buckets end above the id, by halving
    bucket = F.lit(0)
    for step in steps:
        bucket = bucket + F.when((bucket + step <= len(lows)) & (F.element_at(bounds, F.least(bucket + step, F.lit(len(lows)))) > F.col("doc_id")), step).otherwise(0)
    dealt = rows.withColumn("bucket", bucket).withColumn("halo", F.lit(False))
    heads = {high: (k - 1) % len(ranges) for k, (high, _) in enumerate(ranges)}
    head_rows = rows.where(F.col("doc_id").isin(list(heads))).groupBy("doc_id").agg(F.max("text").alias("text"))
    to = F.element_at(F.create_map(*[F.lit(x) for pair in heads.items() for x in pair]), F.col("doc_id"))
    halo = head_rows.withColumn("bucket", to).withColumn("halo", F.lit(True))
    both = dealt.select("bucket", "doc_id", "text", "halo").union(halo.select("bucket", "doc_id", "text", "halo"))
    return both.repartition(shuffle_width(spark), "bucket").sortWithinPartitions("bucket", "halo", F.desc("doc_id"), F.desc("text"))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited form of it, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    document's in descending (doc_id, text); the last document's next is the first.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next.  A null text is empty; rows with a null id come last in
    the order and keep it; repeated rows follow each other.  A single document is its own next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: bucket, doc_id, text, signatures

        def row(doc_id: int, text: str, own: np.ndarray, after: str, after_own: np.ndarray) -> tuple:
            n = len(text) // 3
            edited = text[: len(text) - n] + after[:n]
            changed = own if edited == text else signatures(edited)
            return None if doc_id == NO_ID else doc_id, len(text), sha256(edited.encode()).hexdigest(), encoded(own), encoded(changed), likeness(own, changed), likeness(own, after_own)

        for batch in batches:
            out = []
            for bucket, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = signatures(text)
                if held is not None and held[0] == bucket:
                    out.append(row(held[1], held[2], held[3], text, own))
                held = (bucket, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_order(docs, id_col, text_col).mapInArrow(run, schema)

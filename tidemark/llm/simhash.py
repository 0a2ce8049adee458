"""SimHash fingerprints and near-duplicate classes with pigeonring candidate filtering.

A fingerprint is cut into ``SEGMENTS`` consecutive segments on a ring.  Two fingerprints within
``TOLERANCE`` bits have a start segment from which every chain of l consecutive segments differs in at
most l * TOLERANCE / SEGMENTS bits.  With 3 bits over 4 segments that is: the first segment equal, the
first two together within one bit, three within two, four within three.  The first two conditions become an
equi-join key (segment, next segment with at most one bit set), the others are checked before the full
Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shuffle_width, spans, texts, whole_groups
from tidemark.llm.components import connected_components

SEGMENTS, WIDTH, TOLERANCE, WORDS, SEED = 4, 16, 3, 3, 42
#: Shingles of a text that are hashed at once.
BLOCK = 100_000


def text_fingerprint(data: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of one UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles with repeats."""
    parts = data.lower().split()
    if not parts:
        return 0
    n, digest = max(1, len(parts) - words + 1), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, BLOCK):  # a long text's hashes are added up in blocks
        own = parts[begin : min(begin + BLOCK, n) + words - 1]
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(own[k:] for k in range(words)))] if len(parts) >= words else [digest(b" ".join(parts), SEED)]
        ones += np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) for every row; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [text_fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            fps = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _chain_keys(fps: DataFrame) -> DataFrame:
    """(key, probe, fp): the exact chain key of every start segment, and those with one more bit set in the next segment.

    Of two fingerprints that differ in one bit there, exactly the one without the bit probes the other.
    """
    flips = F.array(*[F.lit(1 << b).cast("long") for b in range(WIDTH)])

    def segment(i: int) -> Column:
        return F.shiftrightunsigned("fp", WIDTH * (i % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)

    def keys_from(i: int) -> Column:
        exact = F.lit(i << (2 * WIDTH)).cast("long") + F.shiftleft(segment(i), WIDTH) + segment(i + 1)
        unset = F.filter(flips, lambda bit: segment(i + 1).bitwiseAND(bit) == 0)
        return F.concat(F.array(F.struct(exact.alias("key"), F.lit(False).alias("probe"))), F.transform(unset, lambda bit: F.struct((exact + bit).alias("key"), F.lit(True).alias("probe"))))

    keys = [keys_from(i) for i in range(SEGMENTS)]
    return fps.select("fp", F.explode(F.concat(*keys)).alias("k")).select("k.key", "k.probe", "fp")


def _stars_of_group(key: int, exact: np.ndarray, probes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside one chain-key group as stars; compares only with what is not linked yet.

    Pairs of probes are left out: they meet in the group of their own exact key.
    """
    start = key >> (2 * WIDTH)
    chain = sum(((1 << WIDTH) - 1) << (WIDTH * ((start + j) % SEGMENTS)) for j in range(SEGMENTS - 1))
    chain, budget = np.uint64(chain), TOLERANCE * (SEGMENTS - 1) // SEGMENTS
    free = [exact, probes]
    stars = []

    def near(x: np.uint64, side: int) -> np.ndarray:
        apart = free[side] ^ x
        hit = np.bitwise_count(apart & chain) <= budget
        hit[hit] = np.bitwise_count(apart[hit]) <= TOLERANCE
        found, free[side] = free[side][hit], free[side][~hit]
        return found

    while len(free[0]):
        seed, free[0] = free[0][0], free[0][1:]
        todo, members = [(seed, True)], []
        while todo:
            x, is_exact = todo.pop()
            linked = near(x, 0)
            members.append(linked)
            todo += [(y, True) for y in linked]
            if is_exact:
                linked = near(x, 1)
                members.append(linked)
                todo += [(y, False) for y in linked]
        found = np.concatenate(members)
        if len(found):
            stars.append((np.full(len(found), seed), found))
    return stars


def links(fps: DataFrame) -> DataFrame:
    """(a, b): star links between distinct fingerprints within TOLERANCE bits, complete up to connectivity.

    Groups stream through sorted partitions as 8-byte values, so none is collected whole by Spark, and
    a group of s members gives fewer than s links, never all pairs.
    """
    # spread first: every fingerprint gives dozens of keys
    keyed = _chain_keys(fps.repartition(shuffle_width(fps.sparkSession))).repartition(shuffle_width(fps.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, probe, fp in whole_groups(batches, 3):
            fp = fp.view(np.uint64)
            begin, end = spans(key)
            many = end - begin > 1
            out = []
            for s, e in zip(begin[many], end[many]):
                is_probe = probe[s:e]
                if not is_probe.all():
                    out += _stars_of_group(int(key[s]), fp[s:e][~is_probe], fp[s:e][is_probe])
            a, b = (np.concatenate([x[i] for x in out]) if out else np.empty(0, np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links of TOLERANCE bits or fewer, the row's own id
    included; equal fingerprints are one class, so groups of copies cost one row each.  Null or empty
    texts share fingerprint zero.  A null doc_id keeps its row and takes its class's id (null if the
    class has none).  Repeated rows give repeated rows; an empty table gives none.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = rooted.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group: that with the least id.

    Of several rows with that id the one with the least text stays.  Rows with a null id cannot be told
    apart and stay.
    """
    # checkpointed: the decisions are a few bytes a document, the texts are read again beside them
    keepers = cut(near_duplicates(docs.where(docs[id_col].isNotNull()), id_col, text_col).where("doc_id = component_id").groupBy("doc_id").count())
    kept = docs.join(keepers.where("count = 1").select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    repeated = docs.join(keepers.where("count > 1").select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    one = repeated.groupBy(id_col).agg(F.min(F.struct(text_col, *[c for c in docs.columns if c not in (id_col, text_col)])).alias("row"))
    one = one.select(*[F.col(id_col) if c == id_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return kept.select(*docs.columns).unionByName(one).unionByName(docs.where(docs[id_col].isNull()))

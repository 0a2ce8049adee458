"""Personal data, and the terms that give it away, by information-theoretic sanitisation.

Identifiers (mail and network addresses, card and telephone numbers) are found by pattern.  The corpus then tells how much a
term discloses of an identifier: with documents as events, I(c; t) = log2(p(c, t) / (p(c) p(t))) bits of the -log2 p(c) bits
that the identifier c holds.  Of a term that leaves less than GENERALISE_BITS of them, and discloses the share SHARE, each place
in the documents that hold the identifier is a span of its own: generalised to its shape, or removed if it leaves less than REMOVE_BITS.

Everything here is DataFrame functions.  Patterns are written with possessive repeats and bounded starts, which match the same
stretches as the plain ones, but in linear time and without a deep stack on texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts, written

#: Identifiers by kind, in the order of results, as patterns: leftmost, without overlap inside a kind.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What stands for them, and for terms, in sanitised texts.
MARKS = {kind: f"[{kind.upper()}]" for kind in PATTERNS} | {"removed": "[REMOVED]"}
#: A character that a text must have for a search of its kind.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A term: a word of three letters or more that is no part of an address or number.
TERM = r"(?<![\p{L}\p{M}\p{N}@._%+-])\p{L}[\p{L}\p{M}]{2,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
#: Code points on either side of an identifier in which a term stands beside it.
WINDOW = 64
#: Bits of an identifier that a term leaves at most to be generalised or removed, the share of its information that it discloses at least, and documents that the two must share.
GENERALISE_BITS, REMOVE_BITS, SHARE, SUPPORT = 1.0, 0.15, 0.5, 2
#: Candidate terms, or keys of texts, up to which they are sent to every task (about 100 MB); more are joined by shuffle.
SENT_TERMS = 1_000_000

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_STEP = 64
_BETWEEN = "\x01"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once a row, whatever ``then`` does with it."""
    return F.transform(F.array(value), then)[0]


def before_each(sizes: Column) -> Column:
    """The sum of the sizes before each element, by sums of 64 and of 4,096 of them: no array grows element by element."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocks(part: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(part) + _STEP - 1) / _STEP).cast("int")), lambda b: total(F.slice(part, b * _STEP + 1, _STEP)))

    def places(s: Column) -> Column:
        own, one, two = s["own"], s["one"], s["two"]

        def prefix(j: Column) -> Column:
            b, c = F.floor(j / _STEP).cast("int"), F.floor(j / (_STEP * _STEP)).cast("int")
            return total(F.slice(own, b * _STEP + 1, j % _STEP)) + total(F.slice(one, c * _STEP + 1, b % _STEP)) + total(F.slice(two, F.lit(1), c))

        return F.transform(own, lambda _, j: prefix(j))

    long = let(sizes.cast("array<bigint>"), lambda own: let(blocks(own), lambda one: let(F.struct(own.alias("own"), one.alias("one"), blocks(one).alias("two")), places)))
    return F.when(F.size(sizes) > 0, long).otherwise(F.array().cast("array<bigint>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Luhn's test of a string of digits."""

    def worth(i: Column) -> Column:
        digit = F.substring(number, i, F.lit(1)).cast("int")
        return F.when((F.length(number) - i) % 2 == 0, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def counts(kind: str, value: Column) -> Column:
    """Whether a match of its kind's pattern is an identifier."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), passes_luhn(digits(value))).otherwise(False)
    return n.between(8, 15)


def entity(kind: str, value: Column) -> Column:
    """An identifier's name: its kind, and its value in lower case or by its digits alone."""
    return F.concat(F.lit(f"{kind}:"), value if kind == "ip" else F.lower(value) if kind == "email" else digits(value))


def found(kind: str, text: Column) -> Column:
    """array<(start, end, value, before, after)> of the identifiers of a kind: code points, end exclusive; before and after are the WINDOW beside it, up to the next match, without words that are cut."""
    pattern = F.lit(PATTERNS[kind])

    def between(s: Column) -> Column:
        hits, gaps = s["hits"], s["gaps"]
        sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        return let(F.struct(hits.alias("hits"), gaps.alias("gaps"), before_each(sizes).alias("base")), spans)

    def spans(s: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            left, right = F.element_at(s["gaps"], i + 1), F.element_at(s["gaps"], i + 2)
            start = F.element_at(s["base"], i + 1) + F.length(left)
            before = F.when(F.length(left) > WINDOW, F.regexp_replace(F.right(left, F.lit(WINDOW)), r"^[\p{L}\p{M}\p{N}]+", "")).otherwise(left)
            after = F.when(F.length(right) > WINDOW, F.regexp_replace(F.left(right, F.lit(WINDOW)), r"[\p{L}\p{M}\p{N}]+$", "")).otherwise(right)
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), before.alias("before"), after.alias("after"), counts(kind, value).alias("counts"))

        return F.transform(s["hits"], span)

    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string,counts:boolean>>")
    found_there = let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, PATTERNS[kind], -1).alias("gaps")), between)
    wanted = text.contains(NEEDED[kind]) if NEEDED[kind] else F.lit(True)
    if kind != "email":
        wanted = wanted & text.rlike("[0-9]")
    return F.filter(F.when(wanted, found_there).otherwise(nothing), lambda m: m["counts"])


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n_email, n_ip, n_card, n_phone, base, entities, beside): the identifiers of every row's text.

    k1 and k2 name the text (128 bits of hash); base is array<(kind, start, end)> by kind, then start; entities are the distinct identifiers
    of the text; beside are its distinct pairs of an identifier and a term in its windows, with a control character between.
    """
    rows = texts(docs, id_col, text_col)
    rows = rows.select("doc_id", *_keys(), *[found(kind, F.col("text")).alias(kind) for kind in PATTERNS])

    def places(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    def beside(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(entity(kind, m["value"]).alias("entity"), F.concat(m["before"], F.lit("\n"), m["after"]).alias("near")))

    base, named = F.concat(*map(places, PATTERNS)), F.concat(*map(beside, PATTERNS))
    some = sum((F.size(kind) for kind in PATTERNS), F.lit(0)) > 0
    rows = rows.select("doc_id", "k1", "k2", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS], base.alias("base"), F.when(some, named).alias("named"))
    pairs = F.flatten(F.transform("named", lambda m: F.transform(terms(m["near"]), lambda t: F.concat(m["entity"], F.lit(_BETWEEN), t))))
    return rows.select(*[c for c in rows.columns if c != "named"], F.array_distinct(F.transform("named", lambda m: m["entity"])).alias("entities"), F.array_distinct(pairs).alias("beside"))


def _keys() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.xxhash64("text", F.length("text"), F.lit(7)).alias("k2")]


def terms(text: Column) -> Column:
    """The terms of a text, in lower case, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.lower(t))


def disclosures(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(entity, term, n_both, n_entity, n_term, information, left, action): what terms tell of the identifiers beside them, of ``docs`` and their ``identified`` rows.

    Counts are of documents: those with the term in a window of the identifier, with the identifier, with the term anywhere.  ``information`` is
    the identifier's -log2 p and ``left`` the bits of it that remain when the term is known.  Only pairs of SUPPORT documents with two different texts
    are told, and only those whose term discloses enough: action is 'generalised' or 'removed'.
    """
    pairs = known.select("k1", F.explode("beside").alias("pair"))
    both = pairs.groupBy("pair").agg(F.count("*").alias("n_both"), F.min("k1").alias("low"), F.max("k1").alias("high")).where(f"n_both >= {SUPPORT} and low != high")
    both = written(both.select(F.substring_index("pair", _BETWEEN, 1).alias("entity"), F.substring_index("pair", _BETWEEN, -1).alias("term"), "n_both"))
    held = known.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    candidates = both.select("term").distinct()
    spoken = texts(docs, id_col, text_col).select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    if candidates.count() <= SENT_TERMS:
        spoken = spoken.join(F.broadcast(candidates), "term")
    else:
        spoken = spoken.groupBy("term").agg(F.count("*").alias("n")).join(candidates, "term")
    n_term = spoken.groupBy("term").agg((F.sum("n") if "n" in spoken.columns else F.count("*")).alias("n_term"))
    n = F.lit(known.count()).cast("double")
    told = both.join(n_term, "term").join(held, "entity")
    information = F.log2(n / F.col("n_entity"))
    left = F.log2(F.col("n_term") / F.col("n_both"))
    told = told.select("entity", "term", "n_both", "n_entity", "n_term", information.alias("information"), left.alias("left"))
    disclosed = (F.col("information") > 0) & (F.col("left") <= GENERALISE_BITS) & (F.col("information") - F.col("left") >= SHARE * F.col("information"))
    return told.where(disclosed).withColumn("action", F.when(F.col("left") <= REMOVE_BITS, "removed").otherwise("generalised"))


def term_spans(docs: DataFrame, known: DataFrame, told: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, told): for each text that holds an identifier and a term which discloses it, array<(kind, start, end)> of all places of such terms, by kind and start.

    A text counts once whatever its copies; a term that discloses several of a text's identifiers is removed if it is for one of them.
    """
    key = ["k1", "k2"]
    # terms beside an identifier need not stand there in every text that holds it, so the text's own terms are asked
    holders = known.where(F.size("entities") > 0).select(*key, "entities").dropDuplicates(key)
    held = holders.select(*key, F.explode("entities").alias("entity"))
    named = held.join(told.select("entity").distinct(), "entity", "left_semi")
    asked = named.select(*key).distinct()
    # texts stay where they are while the keys of those that are asked for fit every task
    asked = F.broadcast(asked) if asked.count() <= SENT_TERMS else asked
    rows = texts(docs, id_col, text_col).select("text", *_keys()).join(asked, key, "left_semi").dropDuplicates(key)
    size = F.transform(F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0)), lambda t: F.length(t))
    gaps = F.transform(F.split("text", TERM, -1), lambda g: F.length(g))

    def placed(s: Column) -> Column:
        steps = F.zip_with(F.slice(s["gaps"], 1, F.size(s["size"])), s["size"], lambda g, n: g + n)
        end = F.zip_with(before_each(steps), steps, lambda before, step: before + step)
        return F.arrays_zip(s["term"].alias("term"), s["size"].alias("size"), end.alias("end"))

    words = rows.select(*key, F.explode(let(F.struct(terms(F.col("text")).alias("term"), size.alias("size"), gaps.alias("gaps")), placed)).alias("word")).select(*key, "word.*")
    wanted = words.join(told.select("entity", "term", "action"), "term").join(named, [*key, "entity"], "left_semi")
    spans = wanted.groupBy(*key, "end", "size").agg(F.max("action").alias("kind"))  # 'removed' comes after 'generalised'
    span = F.struct("kind", (F.col("end") - F.col("size")).cast("bigint").alias("start"), "end")
    return spans.groupBy(*key).agg(F.sort_array(F.collect_list(span)).alias("told"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, told) for every row: the spans of identifiers and of the terms that disclose them.

    Spans are (kind, start, end) in code points, end exclusive.  A null text is an empty one and has none; null ids and repeated rows keep
    their rows and count as documents each; an empty table gives none.
    """
    known = written(identified(docs, id_col, text_col))
    told = written(disclosures(docs, known, id_col, text_col))
    spans = term_spans(docs, known, told, id_col, text_col)
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return known.join(spans, ["k1", "k2"], "left").select("doc_id", *[f"n_{kind}" for kind in PATTERNS], "base", F.coalesce("told", nothing).alias("told"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found_rows: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms) of the rows of ``personal_data``."""
    base, told = listed(F.col("base")), listed(F.col("told"))
    every = F.concat_ws(",", F.when(F.size("base") > 0, base), F.when(F.size("told") > 0, told))
    return found_rows.select("doc_id", *[f"n_{kind}" for kind in PATTERNS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"), F.size("told").cast("long").alias("n_terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every row's text with a mark in place of each span; spans that overlap have one, that of the first.

    A term that is generalised becomes its shape: [Name] if it begins with a capital, [WORD] if all are, else [word].
    """
    rows = texts(docs, id_col, text_col).select("doc_id", "text", *_keys())
    known = written(identified(docs, id_col, text_col))
    told = written(disclosures(docs, known, id_col, text_col))
    spans = known.select("k1", "k2", "base").dropDuplicates(["k1", "k2"]).join(term_spans(docs, known, told, id_col, text_col), ["k1", "k2"], "left")
    spans = spans.select("k1", "k2", F.concat("base", F.coalesce("told", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))).alias("spans")).where(F.size("spans") > 0)
    place = F.array_sort(F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), i.alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = rows.join(spans, ["k1", "k2"], "left").withColumn("spans", F.when(F.col("spans").isNotNull(), place))

    def merged(s: Column) -> Column:
        # spans that overlap become one, of the kind of the first
        def join_on(done: Column, a: Column) -> Column:
            last = F.element_at(done, -1)
            longer = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], a["end"]).alias("end"), last["kind"].alias("kind"))
            return F.when(a["start"] >= last["end"], F.concat(done, F.array(a))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer)))

        return F.aggregate(F.slice(s, F.lit(2), F.size(s)), F.slice(s, 1, 1), join_on)

    def mark(s: Column) -> Column:
        word = F.substring(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        shape = F.when(word == F.upper(word), "[WORD]").when(F.left(word, F.lit(1)) == F.upper(F.left(word, F.lit(1))), "[Name]").otherwise("[word]")
        marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
        return F.when(s["kind"] == "generalised", shape).otherwise(marks[s["kind"]])

    def rebuilt(s: Column) -> Column:
        def piece(a: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"]).cast("int")
            return F.concat(F.substring(F.col("text"), begin + 1, a["start"].cast("int") - begin), mark(a))

        end = F.element_at(s, -1)["end"].cast("int")
        return F.concat(F.array_join(F.transform(s, piece), ""), F.substring(F.col("text"), end + 1, F.length("text")))

    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(let(merged(F.col("spans")), rebuilt)).alias("text"))

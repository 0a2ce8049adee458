"""Names from a table found in free text: an equi-join on all words of a name, the longest of the leftmost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import cut

WORD = r"[\p{L}\p{N}]+"
#: Names up to which they are sent to every task, about 2 MB; more are joined by shuffle, and only a bit map of fixed size goes to every task.
SENT_NAMES = 20_000
#: Bits of that map: at most 2^19 rows of 64 bits, about 25 MB, whatever the names.
MAP_BITS = 25


def words(text: Column) -> Column:
    """The words of a text, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def phrases(placed: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, start, size, phrase): the stretches of each size at every place of (id, own), in words from 0; as many rows as words for each size."""
    at = placed.where("size(own) > 0").select("id", "own", F.posexplode("own").alias("start", "word"))
    each = at.select("id", "own", "start", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).where("start + size <= size(own)")
    return each.select("id", "start", "size", F.array_join(F.slice("own", F.col("start") + 1, F.col("size")), " ").alias("phrase"))


def hits(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, name: str) -> DataFrame:
    """(id, hits): for each text that holds a name as whole words, array<(start, size, name)> of all places, in words from 0, overlaps and all.

    ``id_col`` names a text.  A name is met by all of its words at once: each place of a text gives one phrase for each number of words that names
    have, so that the rows grow with the texts and not with the names of a word.  Of many names a bit map of their phrases' hashes goes to the texts; the
    phrases that it lets through are few more than the hits, and these alone are shuffled.  What the driver and a task hold does not grow with the names.
    """
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("own", words(F.col("name"))).where("size(own) > 0")
    n = cut(n.select("name", F.size("own").alias("size"), F.array_join("own", " ").alias("phrase")))
    sizes = sorted(r.size_ for r in n.select(F.col("size").alias("size_")).distinct().collect()) or [1]  # how many words a name can have
    said = phrases(texts.select(F.col(id_col).alias("id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("own")), sizes)
    if n.count() <= SENT_NAMES:
        found = said.join(F.broadcast(n), ["phrase", "size"])
    else:
        found = _sifted(said, n).join(n.hint("merge"), ["phrase", "size"])
    return found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "size", "name"))).alias("hits"))


def _sifted(said: DataFrame, names: DataFrame) -> DataFrame:
    """``said`` without the phrases whose hash no name has in a map of MAP_BITS bits."""
    at = F.xxhash64("phrase").bitwiseAND((1 << MAP_BITS) - 1)
    place, bit = F.shiftright(at, 6), at.bitwiseAND(63).cast("int")
    bits = names.select(place.alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    placed = said.select("*", place.alias("place"), bit.alias("bit")).join(F.broadcast(bits), "place")
    return placed.where(F.call_function("shiftright", F.col("bits"), F.col("bit")).bitwiseAND(1) == 1).select(said.columns)


def leftmost_longest(found: Column) -> Column:
    """Of hits in the order of their starts those that stay when a text is read from the left and the longest name at a place is taken; of equally long ones the first by name."""
    best = F.array_sort(F.transform(found, lambda h: F.struct(h["start"].alias("start"), (-h["size"]).alias("less"), h["name"].alias("name"))))
    nothing = F.slice(best, 1, 0)
    end = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)["start"] - F.element_at(a, -1)["less"]).otherwise(0)
    kept = F.aggregate(best, nothing, lambda a, h: F.when(h["start"] >= end(a), F.concat(a, F.array(h))).otherwise(a))
    return F.transform(kept, lambda h: F.struct(h["start"].alias("start"), (-h["less"]).alias("size"), h["name"].alias("name")))


def replaced(text: Column, chosen: Column, mark: Column) -> Column:
    """The text with the words of each chosen hit, and what stands between them, given way to ``mark`` of its name; everything else stays as it is."""
    own, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)

    def between(s: Column) -> Column:
        def stretch(begin: Column, end: Column) -> Column:
            # gap, word, gap, word ... of the words from begin up to end, without the last gap
            count = end - begin
            parts = F.flatten(F.zip_with(F.slice(s["gaps"], begin + 1, count), F.slice(s["own"], begin + 1, count), lambda g, w: F.array(g, w)))
            return F.array_join(parts, "")

        def piece(h: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(s["hits"], i - 1)["start"] + F.get(s["hits"], i - 1)["size"])
            return F.concat(stretch(begin, h["start"]), F.element_at(s["gaps"], h["start"] + 1), F.element_at(s["marks"], i + 1))

        last = F.element_at(s["hits"], -1)["start"] + F.element_at(s["hits"], -1)["size"]
        return F.concat(F.array_join(F.transform(s["hits"], piece), ""), stretch(last, F.size(s["own"])), F.element_at(s["gaps"], -1))

    marks = F.transform(chosen, lambda h: mark if not callable(mark) else mark(h["name"]))
    whole = F.struct(own.alias("own"), gaps.alias("gaps"), chosen.alias("hits"), marks.alias("marks"))
    return F.when(F.size(chosen) > 0, F.transform(F.array(whole), between)[0]).otherwise(text)


def prefixes(text: Column, least: int, most: int) -> Column:
    """array<(text, size)> of the beginnings of a text."""
    top = F.least(F.length(text), F.lit(most))
    return F.when(top >= least, F.transform(F.sequence(F.lit(least), F.greatest(top, F.lit(least))), lambda k: F.struct(F.substring(text, F.lit(1), k).alias("text"), k.alias("size")))).otherwise(F.array().cast("array<struct<text:string,size:int>>"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def titles_naming(names: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, n_names, first_name): for each distinct ``title`` that speaks of a distinct ``name`` of ``names``, how many it speaks of and the least of them.

    Both are normal names.  A title speaks of a name that it holds, or of one of four letters or more whose first two and last two
    letters it holds.  The latter holds for all names of the same ends, so these are one class, found by the end that fewer
    titles have; names are not expanded.  Shorter names are found as the titles' own pieces.  Nulls and empty strings name nothing.
    """
    names, titles = names.where("name != ''").select("name").distinct(), titles.where("title != ''").select("title").distinct()

    def pieces(size: int) -> DataFrame:
        at = F.sequence(F.lit(1), F.length("title") - (size - 1))
        return titles.where(F.length("title") >= size).select("title", F.explode(F.array_distinct(F.transform(at, lambda i: F.substr("title", i, F.lit(size))))).alias("piece"))

    pairs = pieces(2)
    held = pairs.groupBy("piece").agg(F.count("*").alias("n"))
    ends = names.where(F.length("name") >= 4).groupBy(F.substring("name", 1, 2).alias("first"), F.right("name", F.lit(2)).alias("last")).agg(F.count("*").alias("names"), F.min("name").alias("least"))
    ends = ends.join(held.select(F.col("piece").alias("first"), F.col("n").alias("n_first")), "first").join(held.select(F.col("piece").alias("last"), F.col("n").alias("n_last")), "last")
    rarer = F.col("n_first") <= F.col("n_last")
    asked = ends.select(F.when(rarer, F.col("first")).otherwise(F.col("last")).alias("piece"), F.when(rarer, F.col("last")).otherwise(F.col("first")).alias("other"), "names", "least")
    found = pairs.join(asked, "piece").where(F.col("title").contains(F.col("other"))).select("title", "names", "least")
    for size in (1, 2, 3):
        short = names.where(F.length("name") == size).select(F.col("name").alias("piece"))
        found = found.union((pairs if size == 2 else pieces(size)).join(short, "piece").select("title", F.lit(1).cast("long"), F.col("piece")))
    return found.groupBy("title").agg(F.sum("names").alias("n_names"), F.min("least").alias("first_name"))

"""Loan books as delimited text: delimiter, header row, column roles, total rows, units, collateral and loss rates."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import collateral, money, unit_factor
from tidemark.sources.texts import fields, lines

#: Words of headers by the role of their column, in the order they are looked for (fixed values).
ROLES = {
    "brand": ("브랜드", "brand", "상호", "가맹본부"),
    "exposure": ("여신잔액", "대출잔액", "잔액", "exposure", "balance", "금액"),
    "collateral": ("담보", "보증", "collateral"),
    "lgd": ("lgd", "손실률", "회수율", "recovery"),
    "borrowers": ("차주수", "건수", "borrowers"),
}
#: Names of rows that add up others, without blanks and marks, and how further ones begin (fixed values).
TOTALS, TOTAL_STARTS = ("합계", "총계", "소계", "계", "합", "total", "subtotal", "sum", "grandtotal", "전체"), ("합계", "총계", "소계")
#: Loss rates by collateral (fixed values).
LGD = {"보증서": 0.10, "담보": 0.25, "신용": 0.45, "기타": 0.45, "미기재": 0.45}
HEAD = 40


def delimiter(rows: list[str]) -> str:
    """Of comma, tab, semicolon and bar the one that parts the rows into most columns in the median; comma for none."""
    return max([",", "\t", ";", "|"], key=lambda d: median([x.count(d) for x in rows[:HEAD]] or [0]))


def header_row(rows: list[list[str]], within: int = 15) -> int:
    """The first row that names a brand and an exposure column; 0 if none does."""
    named = lambda row, role: any(w in c.lower().replace(" ", "") for c in row for w in ROLES[role])
    return next((i for i, r in enumerate(rows[:within]) if named(r, "brand") and named(r, "exposure") and len([c for c in r if c.strip()]) >= 2), 0)


def layouts(rows: DataFrame, book: str, number: str, line: str) -> DataFrame:
    """(book, delimiter, header): for many books at once the delimiter of most columns in the median of the first lines, and the number of the header's line."""
    head = rows.where(F.col(number) <= HEAD)
    marks = [",", "\t", ";", "|"]
    counts = head.select(book, F.explode(F.array(*[F.struct(F.lit(-i).alias("first"), F.lit(d).alias("delimiter"), F.regexp_count(line, F.lit("[" + d + "]")).alias("n")) for i, d in enumerate(marks)])).alias("m")).select(book, "m.*")
    best = counts.groupBy(book, "first", "delimiter").agg(F.median("n").alias("n")).groupBy(book).agg(F.max(F.struct("n", "first", "delimiter"))["delimiter"].alias("delimiter"))
    plain = F.replace(F.lower(line), F.lit(" "), F.lit(""))
    holds = lambda role: F.coalesce(*[F.when(plain.contains(w), True) for w in ROLES[role]], F.lit(False))
    found = head.where((F.col(number) <= 15) & holds("brand") & holds("exposure")).groupBy(book).agg(F.min(number).alias("header"))
    return best.join(found, book, "left").select(book, "delimiter", "header")


def roles(header: list[str]) -> dict[str, int]:
    """The column of each role: the first word of the vocabulary that a header holds; a column has one role."""
    out: dict[str, int] = {}
    plain = [h.lower().replace(" ", "") for h in header]
    for role, words in ROLES.items():
        hit = next((i for w in words for i, h in enumerate(plain) if w in h and i not in out.values()), None)
        if hit is not None:
            out[role] = hit
    return out


def is_total(name: Column) -> Column:
    """Whether a row's name says that it adds up others."""
    plain = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    starts = [plain.startswith(w) for w in TOTAL_STARTS]
    return plain.isin(*TOTALS) | starts[0] | starts[1] | starts[2]


def loss_rate(value: Column, recovery: bool) -> Column:
    """A loss rate from a share or percentage, or one minus a recovery; outside 0 to 1 it is unknown."""
    v = F.when(value > 1, value / 100).otherwise(value)
    v = 1 - v if recovery else v
    return F.when(v.between(0, 1), F.round(v, 6))


def unit_of(median_amount: Column, median_each: Column, repeated: Column, decimals: Column) -> Column:
    """Millions that one unit is, from statistics of the amounts where no header says it: won, million or hundred million.

    ``median_each`` is an amount by borrower: loans of small firms lie between 3 and 3,000 millions.  ``repeated`` is the share of rows whose
    brand comes again, ``decimals`` that of amounts with decimals.  Thousands cannot be told from won by size.
    """
    fits = lambda factor: (median_each * factor).between(3.0, 3000.0)
    one = F.when(fits(1.0) & ~fits(100.0), 1.0).when(fits(100.0) & ~fits(1.0), 100.0)
    by_size = F.when(median_amount >= 1000, 1.0).when(repeated >= 0.3, 1.0).when(decimals >= 0.2, 100.0).when(median_amount < 100, 100.0).otherwise(1.0)
    return F.when(median_amount.isNull(), 1.0).when(median_amount >= 1e6, 1e-6).otherwise(F.coalesce(one, by_size))


def amount_statistics(rows: DataFrame, keys: list[str], brand: str, amount: str, borrowers: str) -> DataFrame:
    """(*keys, median_amount, median_each, repeated, decimals) of each book."""
    a, b = F.when(F.col(amount) > 0, F.col(amount)), F.col(borrowers)
    per_brand = rows.groupBy(*keys, brand).agg(F.count("*").alias("n")).groupBy(*keys).agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("repeated"))
    stats = rows.groupBy(*keys).agg(F.median(a).alias("median_amount"), F.median(F.when(b > 0, a / b)).alias("median_each"), F.avg((F.abs(a - F.round(a)) > 1e-9).cast("int")).alias("decimals"))
    return stats.join(per_brand, keys) if keys else stats.crossJoin(F.broadcast(per_brand))


def unit_of_values(book: DataFrame) -> float:
    """The unit of one book's ``exposure_raw``."""
    s = amount_statistics(book, [], "brand_input", "exposure_raw", "n_borrowers")
    return s.select(unit_of(*[F.col(c) for c in ("median_amount", "median_each", "repeated", "decimals")])).first()[0]


def read_book(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(brand_input, exposure_mkrw, collateral, lgd, n_borrowers) of a book; blank, total and amountless rows are left out.

    Only the first lines come to the driver, to find the delimiter and the header; the file itself is read by Spark.
    """
    every = lines(spark, path, encoding)
    first = [r.line for r in every.limit(HEAD).collect()]
    d = delimiter(first)
    at = header_row([x.split(d) for x in first])
    header = [h.strip().strip('"') for h in first[at].split(d)] if first else []
    role = roles(header)
    if "brand" not in role or "exposure" not in role:
        raise ValueError(f"no brand and exposure column among {header}")
    names = [f"c{i}" for i in range(len(header))]
    raw = every.where(F.trim("line") != "").select(fields(F.col("line"), names, d).alias("r")).select("r.*")
    col = lambda r: F.trim(F.col(names[role[r]])) if r in role else F.lit(None).cast("string")
    head = header[role["exposure"]]
    book = raw.where(F.coalesce(F.trim(names[role["exposure"]]), F.lit("")) != head).select(
        F.nullif(col("brand"), F.lit("")).alias("brand_input"), money(col("exposure")).alias("exposure_raw"), col("collateral").alias("collateral_raw"), money(col("lgd")).alias("lgd_input"), money(col("borrowers")).alias("n_borrowers")
    )
    book = book.where(F.col("brand_input").isNotNull() & ~is_total(F.col("brand_input")) & (F.col("exposure_raw") > 0))
    said = spark.range(1).select(unit_factor(F.lit(head))).first()[0]  # amounts are looked at only where the header says nothing
    factor = F.lit(unit_of_values(book) if said is None else said)
    kind = collateral(F.col("collateral_raw"))
    recovery = "lgd" in role and any(w in header[role["lgd"]].lower() for w in ("회수", "recovery"))
    default = F.element_at(F.create_map(*[F.lit(x) for kv in LGD.items() for x in kv]), F.col("collateral"))
    book = book.withColumn("collateral", kind)
    return book.select("brand_input", F.round(F.col("exposure_raw") * factor, 6).alias("exposure_mkrw"), "collateral", F.coalesce(loss_rate(F.col("lgd_input"), recovery), default).alias("lgd"), "n_borrowers")


def brand_rollup(book: DataFrame) -> DataFrame:
    """(brand_input, exposure_mkrw, lgd, n_borrowers, mix): rows of a brand added up, loss rates weighted by exposure, the collateral mix as text."""
    kinds = book.groupBy("brand_input", "collateral").agg(F.sum("exposure_mkrw").alias("e"), F.sum(F.col("exposure_mkrw") * F.col("lgd")).alias("l"), F.sum("n_borrowers").alias("b"))
    total = kinds.groupBy("brand_input").agg(F.sum("e").alias("exposure_mkrw"), F.sum("l").alias("loss"), F.sum("b").alias("n_borrowers"), F.array_sort(F.collect_list(F.struct((-F.col("e")).alias("e"), "collateral"))).alias("k"))
    mix = F.array_join(F.transform("k", lambda x: F.concat(x["collateral"], F.lit(" "), F.round(-x["e"] / F.col("exposure_mkrw") * 100).cast("int").cast("string"), F.lit("%"))), " · ")
    return total.select("brand_input", "exposure_mkrw", F.round(F.col("loss") / F.col("exposure_mkrw"), 6).alias("lgd"), "n_borrowers", mix.alias("mix"))

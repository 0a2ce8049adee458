"""Column expressions for cleaning and classifying raw values.  All give NULL, never NaN, for what cannot be read."""

from __future__ import annotations

from functools import reduce
from operator import or_

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the first nine digits of a business number (fixed values).
BUSINESS_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)


def number(col: Column) -> Column:
    """A double from text with thousands commas; NULL if it is none."""
    return F.regexp_replace(col.cast("string"), ",", "").try_cast("double")


def positive(col: Column) -> Column:
    """Values above zero; others are unknown."""
    return F.when(col > 0, col)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom where bottom is above zero."""
    return top / F.when(bottom > 0, bottom)


def growth(now: Column, before: Column) -> Column:
    return ratio(now, before) - 1


def normal_name(col: Column) -> Column:
    """Lower case, letters and digits only; what is left empty is NULL."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9가-힣]", ""), F.lit(""))


def digits(col: Column) -> Column:
    return F.regexp_replace(col.cast("string"), "[^0-9]", "")


def business_number(col: Column) -> Column:
    """Ten digits, left-padded; NULL for longer or empty input."""
    d = digits(col)
    return F.when(F.length(d).between(1, 10), F.lpad(d, 10, "0"))


def check_digit_ok(col: Column) -> Column:
    """Whether a ten-digit business number carries its check digit."""
    at = [F.substring(col, i + 1, 1).cast("int") for i in range(10)]
    total = sum((d * w for d, w in zip(at, BUSINESS_WEIGHTS)), F.lit(0)) + F.floor(at[8] * 5 / 10).cast("int")
    return (10 - total % 10) % 10 == at[9]


def masked_number(col: Column) -> Column:
    return F.concat(F.substring(col, 1, 3), F.lit("-**-***"), F.substring(col, 9, 2))


def money(col: Column) -> Column:
    """A number from text: commas, blanks, currency signs and a last 원, krw or % off; accounting parentheses and the signs △ ▲ − mean below zero.

    Text with anything else in it is no amount.
    """
    s = F.trim(col.cast("string"))
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    s = F.regexp_replace(F.regexp_replace(s, r"^[△▲−]", "-"), r"[,\s₩$]", "")
    s = F.regexp_replace(s, r"(?i)(원|krw|%)$", "")
    return F.when(s.rlike(r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


#: Words of a header by the millions that its unit is, in the order they are looked for (fixed values).
UNITS = ((("억", "ekw"), 100.0), (("백만", "mkrw", "million"), 1.0), (("천원",), 0.001), (("만원",), 0.01))


def unit_factor(header: Column) -> Column:
    """Factor to millions that a header names; NULL where it names none."""
    h = F.regexp_replace(F.lower(header), r"[^\p{L}\p{N}]", "")
    out = F
    for words, factor in UNITS:
        out = out.when(reduce(or_, [h.contains(w) for w in words]), factor)
    return out.when(h.endswith("원") | h.endswith("won") | h.contains("krw"), 0.000001)


def origination_year(col: Column, low: int = 2000, high: int = 2100) -> Column:
    """A year from YYYY, YYYYMMDD, dashed dates or spreadsheet serials, between ``low`` and ``high``."""
    d = digits(col)
    serial = d.try_cast("int")
    year = (
        F.when(F.length(d) == 4, serial)
        .when(F.length(d) >= 8, F.substring(d, 1, 4).try_cast("int"))
        .when((F.length(d) == 5) & serial.between(20000, 80000), F.year(F.date_add(F.to_date(F.lit("1899-12-30")), serial)))
    )
    return F.when(year.between(low, high), year)


def outcome(col: Column, dpd_threshold: int = 90) -> Column:
    """1 or 0 from a flag word or days past due; a blank is unknown."""
    s = F.lower(F.trim(col.cast("string")))
    days = number(s)
    return F.when(s.isin("y", "yes", "1", "default", "예", "연체"), 1).when(s.isin("n", "no", "0", "아니오"), 0).when(days >= dpd_threshold, 1).when(days.isNotNull(), 0)


def first_match(col: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule, in order, whose pattern is found."""
    out = F
    for name, pattern in rules:
        out = out.when(col.rlike(pattern), name)
    return out.otherwise(other)


#: Kinds of collateral by their words.  The order is the rule: 무담보 holds 담보 and 임차보증금 holds 보증 (fixed values).
COLLATERAL = [
    ("신용", "무담보|무보증|순수신용|unsecured"),
    ("담보", "보증금|전세"),
    ("보증서", "신보|기보|보증|guarantee"),
    ("담보", "부동산|저당|질권|예적금|담보|secured|mortgage|collateral"),
    ("신용", "신용|credit"),
]


def collateral(col: Column) -> Column:
    """보증서, 담보, 신용 or 기타 by the first rule that matches; 미기재 for a blank."""
    t = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"\s+", "")
    return F.when(t.isin("", "nan", "none", "-"), "미기재").otherwise(first_match(t, COLLATERAL, "기타"))


def nfkc(col: Column) -> Column:
    """Unicode's compatibility form."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return run(col)


#: Legal forms of corporations, taken off a name before its punctuation (fixed values).
LEGAL_FORMS = r"주식회사|㈜|\(주\)|유한회사|\(유\)|유한책임회사|합자회사|합명회사|농업회사법인|재단법인|사단법인|의료법인|학교법인"


def corporate_name(col: Column) -> Column:
    """Lower case without legal forms, then without punctuation; (주)앤하우스 becomes 앤하우스."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), LEGAL_FORMS, ""), r"[^\p{L}\p{N}]", "")


def hangul_only(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), "[^가-힣]", "")


def aliases(col: Column) -> Column:
    """The normal names of a whole name, of what is outside its parentheses and of each part inside; of two letters or more, sorted."""
    inside = F.regexp_extract_all(col, F.lit(r"[(（]([^)）]*)[)）]"), F.lit(1))
    all_names = F.concat(F.array(col, F.regexp_replace(col, r"[(（][^)）]*[)）]", " ")), inside)
    return F.array_sort(F.array_distinct(F.filter(F.transform(all_names, normal_name), lambda x: F.length(x) >= 2)))


def particle(word: Column, closed: str, open_: str) -> Column:
    """A word with the particle that its last syllable asks for: ``closed`` after a final consonant, else ``open_``."""
    code = F.ascii(F.substring(word, -1, 1))
    return F.concat(word, F.when(code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0), closed).otherwise(open_))


def title_names(brand: Column, title: Column) -> Column:
    """Whether a title speaks of a brand: holds its name, or, of four letters and more, its first two and last two."""
    ends = (F.length(brand) >= 4) & title.contains(F.substring(brand, 1, 2)) & title.contains(F.substring(brand, -2, 2))
    return F.coalesce((F.length(brand) > 0) & (title.contains(brand) | ends), F.lit(False))


def shown_percent(p: Column, cuts: list[float]) -> Column:
    """A percentage of one decimal that never rounds up across a grade's cut."""
    value, out = F.round(p * 100, 1), F
    for c in cuts:
        out = out.when((p < c) & (value >= c * 100), F.floor(p * 1000) / 10)
    return out.otherwise(value)


def clipped(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def graded(p: Column, cuts: list[float], names: list[str]) -> Column:
    """The name of the band that p falls in; a band holds its lower cut."""
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for c, name in zip(cuts, names):
        out = out.when(p < c, name)
    return out.otherwise(names[-1])


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a rate."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def amount_text(millions: Column) -> Column:
    """An amount in millions as text: hundred millions from a hundred up, with one decimal, else whole millions."""
    return F.when(F.abs(millions) >= 100, F.concat(F.format_number(millions / 100, 1), F.lit("억원"))).otherwise(F.concat(F.format_number(millions, 0), F.lit("백만원")))


def search_term(col: Column, longest: int = 40) -> Column:
    """A name without what stands in parentheses and without signs, at most ``longest`` characters; NULL if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(col, r"\([^)]*\)|\[[^\]]*\]", " "), r"[^\p{L}\p{N}]+", " ")
    return F.nullif(F.trim(F.substring(F.trim(bare), 1, longest)), F.lit(""))


def mail_time(col: Column) -> Column:
    """The time of a mail header's stamp, such as Tue, 01 Oct 2024 09:00:00 +0900; NULL for anything else."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(col, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})", 1), F.lit("")), F.lit("d MMM yyyy HH:mm:ss Z"))


def mail_date(col: Column, zone: str = "+09:00") -> Column:
    """The day of a mail header's stamp where the readers are."""
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(mail_time(col), F.current_timezone()), zone))


def ascii_names(names: list[str]) -> list[str]:
    """Column names of ASCII letters, digits and underscores: other characters by code point, a repeated name numbered from 2."""
    out: list[str] = []
    for n in names:
        plain = "".join(c if c.isascii() and (c.isalnum() or c == "_") else f"u{ord(c):04X}" for c in n)
        k, name = 2, plain
        while name in out:
            name, k = f"{plain}_{k}", k + 1
        out.append(name)
    return out


def replaced(col: Column, words: dict[str, str]) -> Column:
    """Every listed word replaced in one pass, at each place the longest; what was put in is not replaced again."""
    pattern = re.compile("|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))) or r"(?!)")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else pattern.sub(lambda m: words[m[0]], t))

    return run(col)


def category_term(brand: Column, mid: Column, major: Column, words: dict[str, str], longest: int = 10, other: str = "외식") -> Column:
    """What a brand is compared with: the first of ``words`` (of two letters or more) in its name, then one in its industry, then a short name of the industry itself, then the sector."""
    named = [F.when(brand.contains(k), F.lit(v)) for k, v in words.items() if len(k) >= 2] + [F.when(mid.contains(k), F.lit(v)) for k, v in words.items() if k]
    short = F.trim(F.coalesce(mid, F.lit("")))
    return F.coalesce(*named, F.when(F.length(short).between(1, longest), short), F.trim(F.coalesce(F.nullif(major, F.lit("")), F.lit(other))))

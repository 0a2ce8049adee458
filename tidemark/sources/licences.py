"""Licence records in CSV: aliases of columns, three date formats, the newest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.texts import fields, lines

#: Canonical column and the headers that stand for it (fixed values).
ALIASES = {
    "org_code": ("org_code", "개방자치단체코드", "OPN_ATMY_GRP_CD"),
    "mng_no": ("mng_no", "관리번호", "MNG_NO"),
    "name": ("name", "사업장명", "BPLC_NM"),
    "status_code": ("status_code", "영업상태코드", "SALS_STTS_CD"),
    "opened_on": ("opened_on", "인허가일자", "LCPMT_YMD"),
    "closed_on": ("closed_on", "폐업일자", "CLSBIZ_YMD"),
    "road_address": ("road_address", "도로명주소", "ROAD_NM_ADDR"),
    "data_updated_at": ("data_updated_at", "데이터갱신일자", "DAT_UPDT_PNT"),
}


def any_date(col: Column) -> Column:
    """A date from yyyyMMdd, yyyy-MM-dd or yyyy.MM.dd, with or without a time behind; NULL for anything else."""
    return F.try_to_date(F.substring(F.regexp_replace(col, "[^0-9]", ""), 1, 8), "yyyyMMdd")


def any_timestamp(col: Column) -> Column:
    d = F.rpad(F.substring(F.regexp_replace(col, "[^0-9]", ""), 1, 14), 14, "0")
    return F.when(F.length(F.regexp_replace(col, "[^0-9]", "")) >= 8, F.try_to_timestamp(d, F.lit("yyyyMMddHHmmss")))


def canonical(raw: DataFrame, service: Column) -> DataFrame:
    """Canonical columns of raw rows; a header that is missing gives NULL."""

    def pick(names: tuple[str, ...]) -> Column:
        own = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    out = raw.select(service.alias("service"), *[pick(n).alias(c) for c, n in ALIASES.items()])
    return out.withColumns({"opened_on": any_date(F.col("opened_on")), "closed_on": F.when(F.col("status_code") == "03", any_date(F.col("closed_on"))), "data_updated_at": any_timestamp(F.col("data_updated_at"))})


def service_of(file: Column, services: dict[str, str]) -> Column:
    """The service that a part of the file's name tells."""
    out = F
    for part, name in services.items():
        out = out.when(file.contains(part), name)
    return out.otherwise("unknown") if services else F.lit("unknown")


def newest(rows: DataFrame) -> DataFrame:
    """The row of latest update of each (service, org_code, mng_no); rows without a management number all stay."""
    w = Window.partitionBy("service", "org_code", "mng_no").orderBy(F.desc_nulls_last("data_updated_at"), F.desc(F.xxhash64(*rows.columns)))
    keyed = rows.where("mng_no is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return keyed.unionByName(rows.where("mng_no is null"))


def licences(spark: SparkSession, paths: str | list[str], services: dict[str, str], encoding: str = "UTF-8") -> DataFrame:
    """Licence records of CSV files of one layout and encoding (UTF-8 or CP949), the service named by a part of the file's name.

    A record is a line: fields may be quoted but hold no line feed.
    """
    every = lines(spark, paths, encoding)
    head = every.where(F.lower("line").rlike("관리번호|mng_no")).select("line").limit(1).collect()
    if not head:
        raise ValueError("no line names the management number's column")
    names = [h.strip().strip('"') for h in head[0].line.split(",")]
    raw = every.where((F.col("line") != head[0].line) & (F.trim("line") != "")).select("file", fields(F.col("line"), names, ",").alias("r")).select("file", "r.*")
    return newest(canonical(raw, service_of(F.col("file"), services)))

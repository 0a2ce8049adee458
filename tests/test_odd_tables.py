"""Queries against their SQL on tables that the given ones do not look like."""

import os

import pytest
from pyspark.sql import functions as F

import compare
from tidemark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder of the given tables, of which some are replaced."""

    def made(**replaced):
        for name in compare.TABLES:
            if name in replaced:
                replaced[name].write.parquet(f"{tmp_path}/{name}.parquet")
                os.rename(next(str(p) for p in (tmp_path / f"{name}.parquet").glob("*.parquet")), f"{tmp_path}/{name}.one")
                for p in (tmp_path / f"{name}.parquet").iterdir():
                    p.unlink()
                (tmp_path / f"{name}.parquet").rmdir()
                os.rename(f"{tmp_path}/{name}.one", f"{tmp_path}/{name}.parquet")
            else:
                os.symlink(f"{SF}/{name}.parquet", f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return made


def same(spark, name, sf_dir):
    found, columns, _ = compare.spark_rows(QUERIES[name](spark, sf_dir))
    wanted, wanted_columns, _ = compare.sql_rows(ORACLES[name], sf_dir)
    assert columns == wanted_columns and found == wanted
    return found


def test_words_end_at_letters_that_are_not_ascii(spark, tables):
    rows = [(i, 0, "user", t) for i, t in enumerate(["éder", "dieß", "_und", "und", "x of", "ofé", "oféof", "the2", None])]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    assert len(same(spark, "intent_classify", tables(conversations=c))) == 3


def test_aliases_past_five_digits(spark, tables):
    c = spark.range(1, 134_000).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(1.5).alias("c_acctbal"), F.lit("X").alias("c_mktsegment"))
    found = same(spark, "masked_frame", tables(customer=c.coalesce(1)))
    assert len(found) > 100_000


def test_fits_read_the_prepared_rows_and_not_the_tables(spark):
    from tidemark.plans.assessment import prepared

    x, n = prepared(spark, SF)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert n > 0 and "Exchange" not in plan and "parquet" not in plan
    assert {"features", "weight", "split", "label"} <= set(x.columns)


def test_links_are_made_once_and_no_pair_is_shuffled(spark, tables):
    rows = [(i * 50 if i < 8 else 700 * i + 50 * (i % 8) if i < 16 else i, " ".join(n), f"B{i % 2}") for i, n in enumerate([("a", "b"), ("b", "a"), ("a", "a"), ("a",), ("", "b", "c"), ("b", "", "x"), ("c", "d"), ("b", "a", "z")] * 4)] + [(9999, None, "B1"), (10000, "a b", None)]
    p = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").withColumns({"p_type": F.lit("T"), "p_size": F.lit(1), "p_retailprice": F.lit(1.0)})
    sf_dir = tables(part=p.coalesce(1))
    assert len(same(spark, "coverage_links", sf_dir)) > 20
    plan = QUERIES["coverage_links"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan

import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows

from areapanel.sources import csv_files, inferred, tables

COLUMNS = {
    "whole": ("1", None, "-7", " 12 "),
    "zip": ("00601", "60601", None, "1"),
    "price": ("12.50", ".5", "-3", "1000"),
    "tiny": ("0.000", "0", None, None),
    "big": ("9" * 30, "1", None, None),
    "huge": ("9" * 39, "1", None, None),
    "wide": ("1" * 30 + "." + "2" * 12, "1.5", None, None),
    "float": ("1e3", "2", "nan", "-inf"),
    "day": ("2020-02-29", "12/31/2020", None, "2021-01-01"),
    "wrong_day": ("2020-02-30", "2020-01-01", None, None),
    "time": ("2020-01-01T10:00:00", "2020-01-01", "02/01/2020", None),
    "flag": ("Yes", "f", None, "TRUE"),
    "mixed": ("1", "yes", None, None),
    "none": (None, None, None, None),
    "Empty": ("", None, None, None),
}
TYPES = {
    "whole": "bigint", "zip": "string", "price": "decimal(6,2)", "tiny": "decimal(3,3)", "big": "decimal(30,0)",
    "huge": "string", "wide": "double", "float": "double", "day": "date", "wrong_day": "string", "time": "timestamp",
    "flag": "boolean", "mixed": "string", "none": "string", "empty": "string",
}


@pytest.fixture
def text(spark):
    return spark.createDataFrame(list(zip(*COLUMNS.values())), ", ".join(f"{c} string" for c in COLUMNS))


def kinds(records):
    return {r["column"]: r["type"] for r in inferred.types(records).collect()}


def test_types(text):
    assert kinds(inferred.infer(text)) == TYPES
    assert kinds(inferred.infer(text.select("zip"), keep_leading_zeros=False)) == {"zip": "bigint"}
    assert kinds(inferred.infer(text.where("false").select("whole", "day"))) == {"whole": "string", "day": "string"}


def test_records_merge_to_those_of_all_rows(spark, text):
    """A load a row, joined, says what one pass over all rows says."""
    rows_ = [tuple(r) for r in text.collect()]
    loads = [inferred.infer(spark.createDataFrame([r], text.schema)) for r in rows_]
    together = loads[0]
    for load in loads[1:]:
        together = together.unionByName(load)
    assert rows(inferred.merged(together)) == rows(inferred.infer(text))
    assert rows(inferred.merged(inferred.merged(together))) == rows(inferred.infer(text))


def test_table_from_text(spark, text):
    inferred.table_from_text(text, "typed_text")
    assert {r["column"]: r["type"] for r in tables.describe_table(spark, "typed_text").collect()} == TYPES
    assert "typed_text" in tables.list_tables(spark)
    got = spark.table("typed_text").where("whole = 1").first()
    assert (got["price"], got["big"], got["day"], got["flag"]) == (Decimal("12.50"), Decimal("9" * 30), dt.date(2020, 2, 29), True)
    days = spark.table("typed_text").select("day").where("day IS NOT NULL")
    assert {r["day"] for r in days.collect()} == {dt.date(2020, 2, 29), dt.date(2020, 12, 31), dt.date(2021, 1, 1)}


def test_load_by_name(spark):
    inferred.create_table(spark, "by_name", {"a`b": "bigint", "price": "decimal(5,2)", "day": "date"})
    more = spark.createDataFrame([("7", "x", "1.5"), (None, "y", None)], "`A``B` string, other string, PRICE string")
    inferred.load_by_name(more, "by_name")
    assert rows(spark.table("by_name")) == [(7, Decimal("1.50"), None), (None, None, None)]
    for bad in ("1.505", "1000000", "x"):
        with pytest.raises(Exception, match="in column price"):
            inferred.load_by_name(spark.createDataFrame([(bad,)], "price string"), "by_name")
    assert spark.table("by_name").count() == 2
    with pytest.raises(ValueError, match="case"):
        inferred.infer(spark.createDataFrame([("1", "2")], "k string, j string").toDF("K", "k"))


def test_repeated_header_lines_are_no_rows(spark, tmp_path):
    """Files put together from others: every line equal to the file's header is one; the split does not matter."""
    (tmp_path / "a.csv").write_text("﻿k,v\n1,x\nk,v\n2,y\n")
    (tmp_path / "b.csv").write_text("V,K\nk,3\n")
    assert rows(csv_files.read_csv_by_name(spark, str(tmp_path)), "k", "v") == [("1", "x"), ("2", "y"), ("3", "k")]


def test_forms_of_numbers_are_tried_once_a_value(spark):
    values = ["-007.50", "+.5", "3.", "12", "-0", "0.05", "0012", "1e5", " 7 ", None]
    df = spark.createDataFrame([(v,) for v in values], "a string")
    for given, want in [(["-7.50", "+.5", "3.", " 12 ", None], (4, 6, 2, 2)), (["+0012", "5"], (2, 7, 2, 0)), (["1e5", "2"], (2, 4, 1, 0))]:
        found = inferred.infer(spark.createDataFrame([(v,) for v in given], "a string"), keep_leading_zeros=False).first()
        assert (found["n"], found["kinds"], found["before"], found["after"]) == want
    plan = inferred.infer(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(inferred.PLAIN_FORM) == 1

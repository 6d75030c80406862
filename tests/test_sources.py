import pytest
from conftest import plan_of, rows
from pyspark.sql import types as T

from areapanel.sources import contracts, csv_files, tables

LOAD = T.StructType(
    [
        T.StructField("ZIP_Code", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Value", T.DoubleType()),
    ]
)


def put(folder, **files):
    for name, text in files.items():
        (folder / name.replace("_dot_", ".")).write_text(text)
    return str(folder)


def test_load_by_name(spark, tmp_path):
    path = put(
        tmp_path,
        a_dot_csv="ZIP_Code,Year,Value\n00601, 2014 ,1.5\n00602,NULL,null\n",
        b_dot_csv="value,zip_code,YEAR,other\n 2.5 ,00603,2015,x\n,\"00604\",2016,\n",
        c_dot_csv="zip_code,value\n00605,7\n",
        d_dot_txt="ZIP_Code,Year,Value\n99999,2014,1\n",
    )
    assert rows(csv_files.read_csv_by_name(spark, path, LOAD)) == [
        ("00601", 2014, 1.5),
        ("00602", None, None),
        ("00603", 2015, 2.5),
        ("00604", 2016, None),
        ("00605", None, 7.0),
    ]


def test_names_that_need_encoding(spark, tmp_path):
    for i, name in enumerate(("part a.csv", "x[1].csv", "50%.csv", "ü+b.csv")):
        (tmp_path / name).write_text(f"ZIP_Code,Value\n{i},{i}.5\n" + ("bad\n" if name == "50%.csv" else ""))
    (tmp_path / "notes.txt").write_text('an open " quote\n')
    got = csv_files.read_csv_by_name(spark, str(tmp_path), LOAD)
    assert rows(got) == [("0", None, 0.5), ("1", None, 1.5), ("3", None, 3.5)]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = put(tmp_path, a_dot_csv='ZIP_Code,"Year",Value\r\n"a ""b""\nc",2014,1\r\nd,2015,"2"\n', b_dot_csv="value,zip_code\n3,e\n")
    got = csv_files.read_csv_by_name(spark, path, LOAD, multi_line=True)
    assert rows(got) == [('a "b"\nc', 2014, 1.0), ("d", 2015, 2.0), ("e", None, 3.0)]
    assert rows(csv_files.read_csv_by_name(spark, path, LOAD)) == [("e", None, 3.0)]
    with pytest.raises(Exception, match="bad row in"):
        csv_files.read_csv_by_name(spark, path, LOAD, skip_bad_files=False).collect()


def test_header_with_comma_in_quotes(spark, tmp_path):
    path = put(tmp_path, a_dot_csv='"a,b", c ,"d ""e"""\n1,2,3\n')
    headers = csv_files.header_columns(csv_files.file_headers(spark, path))
    assert rows(headers, "column") == [("a,b",), ("c",), ('d "e"',)]
    assert rows(csv_files.read_csv_by_name(spark, path)) == [("1", "2", "3")]


def test_load_reads_the_text_twice(spark, tmp_path):
    from areapanel.sources import csv_files as module

    path, seen = put(tmp_path, a_dot_csv="A,b\n1,2\n", b_dot_csv="b,A\n3,4\n", c_dot_csv="b\n4\n"), []
    original = module._records
    module._records = lambda *a: seen.append(a) or original(*a)
    try:
        csv_files.read_csv_by_name(spark, path)
    finally:
        module._records = original
    assert len(seen) == 2


def test_load_without_schema_takes_all_columns(spark, tmp_path):
    path = put(tmp_path, a_dot_csv="A,b\n1,2\n", b_dot_csv="B,C\n3,4\n")
    got = csv_files.read_csv_by_name(spark, path)
    assert rows(got, "a", "b", "c") == [("1", "2", None), (None, "3", "4")]


def test_bad_files_are_left_out_whole(spark, tmp_path):
    path = put(
        tmp_path,
        good_dot_csv="ZIP_Code,Year,Value\n1,2014,1\n2,2015,2\n",
        wide_dot_csv="ZIP_Code,Year,Value\n3,2014,1\n4,2014,1,9\n5,2014,1\n",
        short_dot_csv="ZIP_Code,Year,Value\n6,2014,1\n7,2014\n",
        typed_dot_csv="ZIP_Code,Year,Value\n8,2014,1\n9,2014,abc\n",
        turned_dot_csv="Year,Value,ZIP_Code\n2014,1,10\nx,1,11\n",
    )
    assert rows(csv_files.read_csv_by_name(spark, path, LOAD), "ZIP_Code") == [("1",), ("2",)]
    with pytest.raises(Exception, match="bad row in"):
        csv_files.read_csv_by_name(spark, path, LOAD, skip_bad_files=False).collect()
    bad = csv_files.bad_files(spark, f"{path}/[gstw]*.csv", ["ZIP_Code", "Year", "Value"], glob="[gsw]*.csv")
    assert {r["file"].rsplit("/", 1)[1]: r["bad_rows"] for r in bad.collect()} == {"wide.csv": 1, "short.csv": 1}


def test_no_file(spark, tmp_path):
    put(tmp_path, a_dot_txt="x\n")
    with pytest.raises(FileNotFoundError):
        csv_files.read_csv_by_name(spark, str(tmp_path), LOAD)


def test_string_scan_and_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("00601", 'say "a", b', None)], "ZIP string, text string, n int")
    csv_files.write_csv(df, str(tmp_path / "out"))
    csv_files.write_csv(df, str(tmp_path / "out"))
    back = csv_files.read_csv_strings(spark, str(tmp_path / "out"))
    assert [f.dataType.simpleString() for f in back.schema] == ["string"] * 3
    assert rows(back) == [("00601", 'say "a", b', None)]
    assert tables.list_files(back).count() == 1


def test_probe_types(spark):
    data = [
        ("1", "00601", "1.5", "2020-01-01", "2020-01-01 10:00:00", "true", "x", None, "1"),
        (None, "60601", "2", "2020-12-31", "2020-01-01", "false", "1", None, "2020-01-01"),
        ("-7", "1", "-1e3", "2021-01-01", "2020-01-01T10:00:00", "TRUE", None, None, "2"),
    ]
    names = ["int", "zip", "dbl", "day", "time", "flag", "mixed", "none", "odd"]
    df = spark.createDataFrame(data, ", ".join(f"{n} string" for n in names))
    assert dict(rows(csv_files.probe_types(df))) == {
        "int": "bigint",
        "zip": "string",
        "dbl": "double",
        "day": "date",
        "time": "timestamp",
        "flag": "boolean",
        "mixed": "string",
        "none": "string",
        "odd": "string",
    }
    assert dict(rows(csv_files.probe_types(df, keep_leading_zeros=False)))["zip"] == "bigint"
    typed = csv_files.with_probed_types(df.select("int", "day"))
    assert [f.dataType.simpleString() for f in typed.schema] == ["bigint", "date"]


def test_tables_and_views(spark):
    df = spark.createDataFrame([(1, "a")], "k int, s string")
    tables.save_table(df, "kept")
    tables.save_table(df.unionAll(df), "kept")
    tables.register_views({"seen": df})
    assert spark.table("kept").count() == 2
    assert {"kept", "seen"} <= set(tables.list_tables(spark))
    assert rows(tables.describe_table(spark, "kept")) == [("k", "int"), ("s", "string")]
    assert tables.peek(spark.range(100)).count() == 20
    spark.sql("DROP TABLE kept")


def frame(spark, *names):
    return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))


def test_contracts(spark):
    with pytest.raises(ValueError, match="events has no column Date, Latitude"):
        contracts.check_events(frame(spark, "ID", "Primary Type", "Longitude"))
    contracts.check_events(frame(spark, *contracts.EVENT_COLUMNS, "more"))
    with pytest.raises(ValueError, match="has no column ZIP"):
        contracts.check_areas(frame(spark, "zip", "the_geom"))
    with pytest.raises(ValueError, match="geom or shape"):
        contracts.check_areas(frame(spark, "ZIP"))
    contracts.check_areas(frame(spark, "ZIP", "SHAPE_x"))
    schema = "RegionName string, RegionType string, State string, City string"
    with pytest.raises(ValueError, match="RegionType"):
        contracts.check_values(spark.createDataFrame([("1", "msa", "IL", "x"), ("1", None, "IL", "x")], schema))
    late = spark.range(3000).selectExpr(
        "'1' as RegionName", "if(id = 2999, ' ZIP ', 'msa') as RegionType", "'' as State", "'' as City"
    )
    contracts.check_values(late)
    assert rows(contracts.value_report(late, "RegionType", "zip")) == [(3000, 1, True)]
    with pytest.raises(ValueError, match="empty"):
        contracts.require_rows(spark.range(0), "population")


def test_classify_sources(spark, tmp_path):
    path = put(
        tmp_path,
        events2_dot_csv='"ID",Date,Primary Type,Latitude,Longitude,x\n1,2,3,4,5,6\n',
        events1_dot_csv="Longitude, Latitude,Primary Type,Date,ID\n1,2,3,4,5\n",
        events0_dot_csv="ID,Date,Latitude,Longitude\n1,2,3,4\n",
        values_dot_csv="RegionName,RegionType,State,City\n",
        areas_dot_csv="The_GEOM,zip\n",
        upper_dot_csv="the_geom,ZIP\n",
        historical_zip_population_10yrs_dot_csv="zip,geom\n",
    )
    headers = csv_files.header_columns(csv_files.file_headers(spark, path))
    found = {r["kind"]: (r["file"].rsplit("/", 1)[1], r["score"]) for r in contracts.classify_sources(headers).collect()}
    assert found == {"crime": ("events1.csv", 5), "zillow": ("values.csv", 4), "boundary": ("areas.csv", 2)}
    without = contracts.classify_sources(headers.where("not endswith(file, '/values.csv')"))
    assert "zillow" not in {r["kind"] for r in without.collect()}


def test_string_scan_refuses_mixed_headers(spark, tmp_path):
    path = put(tmp_path, a_dot_csv="a,b\n1,2\n", b_dot_csv="b,a\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv_files.read_csv_strings(spark, path).collect()
    got = csv_files.read_csv_strings(spark, path + "/a.csv", ["a", "b"])
    assert rows(got.select("b")) == [("2",)]
    same = put(tmp_path, c_dot_csv="a,b\n5,6\n")
    assert rows(csv_files.read_csv_strings(spark, [same + "/a.csv", same + "/c.csv"]).select("b")) == [("2",), ("6",)]


def test_first_lines_and_bad_files_move_no_rows(spark, tmp_path):
    """First lines are found without sorting all lines, and files are left out without shuffling all rows."""
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"a,b\n{k},2\n3," + ("x\n" if k == 1 else "4\n"))
    assert "SortAggregate" not in plan_of(csv_files.file_headers(spark, str(tmp_path)))
    read = csv_files.read_csv_by_name(spark, str(tmp_path), spark.createDataFrame([], "a int, b int").schema)
    assert "SortMergeJoin" not in plan_of(read) and "Exchange hash" not in plan_of(read)
    assert rows(read) == [(0, 2), (2, 2), (3, 4), (3, 4)]

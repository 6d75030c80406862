import datetime as dt

import pytest
from conftest import rows

from areapanel.operators import reshape, validity
from areapanel.operators.dedupe import dedupe_by_key
from areapanel.plans import clean
from areapanel.sources import population

D = dt.date
EVENTS = "ID string, Date string, `Primary Type` string, Latitude string, Longitude string, Extra string"


def event(key, date="01/15/2020 10:00:00 AM", kind="THEFT", lat="41.8", lon="-87.7"):
    return (key, date, kind, lat, lon, "x")


def cleaned(spark, *events):
    return clean.clean_points(spark.createDataFrame(list(events), EVENTS))


def test_date_forms(spark):
    got = cleaned(
        spark,
        event("pm", "12/31/2020 11:59:59 PM"),
        event("lower", "03/01/2020 01:00:00 pm"),
        event("h24", "03/01/2020 23:00:00"),
        event("unpadded", "1/2/2020 1:00:00 AM"),
        event("iso", "2020-01-02 01:00:00"),
        event("month13", "13/02/2020 01:00:00 AM"),
        event("h13pm", "01/02/2020 13:00:00 PM"),
    )
    assert rows(got, "ID", "Month_Date", "Year") == [
        ("h24", D(2020, 3, 1), 2020),
        ("lower", D(2020, 3, 1), 2020),
        ("pm", D(2020, 12, 1), 2020),
    ]


def test_year_window_is_inclusive(spark):
    years = [2013, 2014, 2024, 2025]
    got = cleaned(spark, *[event(str(y), f"06/01/{y} 01:00:00 AM") for y in years])
    assert rows(got, "Year") == [(2014,), (2024,)]


def test_bounding_box_is_inclusive_on_all_sides(spark):
    inside = [("41.5", "-87.7"), ("42.1", "-87.7"), ("41.8", "-88.0"), ("41.8", "-87.5")]
    outside = [("41.4999", "-87.7"), ("42.1001", "-87.7"), ("41.8", "-88.0001"), ("41.8", "-87.4999")]
    got = cleaned(spark, *[event(f"{a},{b}", lat=a, lon=b) for a, b in inside + outside])
    assert rows(got, "ID") == sorted((f"{a},{b}",) for a, b in inside)


def test_incomplete_rows_are_dropped(spark):
    got = cleaned(
        spark,
        event("ok"),
        event("no date", date=None),
        event("no kind", kind=None),
        event("no lat", lat=None),
        event("no lon", lon=None),
        event("text", lat="abc"),
        event("nan", lat="NaN"),
    )
    assert rows(got, "ID", "x", "y") == [("ok", -87.7, 41.8)]


def test_categories_match_exactly(spark):
    kinds = ["BATTERY", "ASSAULT", "HOMICIDE", "ROBBERY", "CRIM SEXUAL ASSAULT", "KIDNAPPING", "SEX OFFENSE"]
    got = cleaned(spark, *[event(k, kind=k) for k in [*kinds, "battery", "THEFT"]])
    found = dict(rows(got, "ID", "Crime_Category"))
    assert {k for k, c in found.items() if c == "Violent"} == set(kinds)
    assert {found["battery"], found["THEFT"]} == {"Property"}


def test_one_row_per_id_chosen_by_value(spark):
    got = cleaned(
        spark,
        event("a", kind="THEFT", lat="41.9"),
        event("a", kind="ARSON", lat="41.8"),
        event("b"),
        event("b"),
        event("c", lat=None, kind="ARSON"),
        event("c", kind="THEFT"),
        event(None, kind="THEFT"),
        event(None, kind="BATTERY"),
        # the first row by date decides, even when it lies outside the year window
        event("d", date="01/01/2001 01:00:00 AM"),
        event("d", date="01/01/2020 01:00:00 AM"),
    )
    assert rows(got, "ID", "Crime_Category", "y") == sorted(
        [("a", "Property", 41.8), ("b", "Property", 41.8), ("c", "Property", 41.8), (None, "Violent", 41.8)],
        key=repr,
    )


def test_dedupe_combines_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(null as string) as k", "id as v")
    out = dedupe_by_key(df, ["k"], ["v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    assert rows(out) == [(None, 0)]


WIDE = ["RegionName", "RegionType", "State", "City", "2014-01-31", "02/28/2014", "2013-12-31", "2025-01-31", "2014-01-01"]


def wide(spark, *data):
    return spark.createDataFrame(list(data), ", ".join(f"`{c}` string" for c in WIDE))


def test_wide_series(spark):
    raw = wide(
        spark,
        ("60601", "zip", "IL", "Chicago", "10.5", "20", "1", "2", "11"),
        ("00602", "zip", "IL", "Chicago", "0", "-3", "1", "2", None),
        ("60603", "zip", "IL", "Chicago", "NaN", "abc", "1", "2", ""),
        ("60604", "zip", "IL", "chicago", "1", "1", "1", "1", "1"),
        ("60605", "zip", "WI", "Chicago", "1", "1", "1", "1", "1"),
        ("00606", "metro", "IL", "Chicago", None, "7", "1", "1", None),
    )
    got = clean.clean_wide_series(raw)
    assert rows(got) == [
        ("00606", D(2014, 2, 1), 7.0),
        ("60601", D(2014, 1, 1), 10.5),
        ("60601", D(2014, 1, 1), 11.0),
        ("60601", D(2014, 2, 1), 20.0),
    ]
    only_zip = clean.clean_wide_series(raw, region_type="ZIP")
    assert "00606" not in {r["ZIP_Code"] for r in only_zip.collect()}


def test_month_columns():
    names = ["RegionName", "2020-01-31", "01/31/2020", "2020-13-01", "a-b", "20th", "1/1/2020"]
    assert reshape.month_columns(names) == {"2020-01-31": D(2020, 1, 1), "01/31/2020": D(2020, 1, 1)}
    assert reshape.month_columns(names, (2021, 2022)) == {}
    with pytest.raises(ValueError, match="no month columns"):
        reshape.month_columns(["RegionName", "a-b"])


def test_series_without_month_in_window_is_empty(spark):
    raw = wide(spark, ("60601", "zip", "IL", "Chicago", "1", "1", "1", "1", "1"))
    assert clean.clean_wide_series(raw, years=(1990, 1991)).count() == 0
    assert clean.clean_wide_series(raw, years=(1990, 1991)).columns == ["ZIP_Code", "Month_Date", "ZHVI_Value"]


def test_union_and_measures(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2,)], "k int")
    assert rows(reshape.append_all([a, b])) == [(1, "x"), (2, None)]
    m = spark.createDataFrame([(1, 2.0, None)], "k int, p double, q double")
    long = reshape.measures_to_rows(m, ["k"], {"p": "P label", "q": "Q label"}, "name", "value")
    assert rows(long) == [(1, "P label", 2.0), (1, "Q label", None)]


def test_population(spark):
    head = '["NAME","B01003_001E","zip code tabulation area"]'
    docs = [
        (2014, f'[{head},["ZCTA5 00601","17126","99999"],["ZCTA5 00602",null,"1"],["ZCTA5 00603","-5","1"]]'),
        (2015, '[["zip code tabulation area","B01003_001E","NAME"],["00601","12.5","ZCTA5 00601"]]'),
        (2016, f'[{head},["ZCTA5 00601","N/A","1"],["ZCTA5 00601","0","1"],["ZCTA5 00601","NaN","1"],["x","12D","1"]]'),
        (2017, "<html>"),
        (2018, '[["NAME","other"],["ZCTA5 00601","5"]]'),
        (2019, "[]"),
        (2013, f'[{head},["ZCTA5 00601","1","1"]]'),
        (None, f'[{head},["ZCTA5 00601","1","1"]]'),
        (2020, f'[{head},["ZCTA5 00601"],["ZCTA5 00604","8","1","extra"]]'),
    ]
    responses = spark.createDataFrame(docs, "year int, body string")
    assert rows(population.load_population(responses)) == [
        ("00601", 2014, 17126.0),
        ("00601", 2015, 12.5),
        ("00604", 2020, 8.0),
    ]
    report = {r[0]: r[2] for r in population.response_report(responses).collect()}
    assert [y for y, usable in report.items() if y and not usable] and report[2017] == report[2018] == report[2019] == 0
    assert report[2014] == 1


def test_population_files(spark, tmp_path):
    (tmp_path / "acs_2014.json").write_text('[["NAME","B01003_001E"],\n["ZCTA5 00601","7"]]')
    (tmp_path / "acs_2015.json").write_text("not json")
    responses = population.read_responses(spark, str(tmp_path))
    assert rows(population.load_population(responses)) == [("00601", 2014, 7.0)]


def test_year_of_a_file_name(spark, tmp_path):
    body = '[["NAME","B01003_001E"],["ZCTA5 00601","7"]]'
    (tmp_path / "20250105_acs 2014.json").write_text(body)
    assert rows(population.load_population(population.read_responses(spark, str(tmp_path)))) == [("00601", 2014, 7.0)]
    (tmp_path / "old 1999.json").write_text(body)
    assert {r[0] for r in population.read_responses(spark, str(tmp_path)).collect()} == {1999, 2014}
    for name in ("acs.json", "2015 to 2016.json"):
        (tmp_path / name).write_text(body)
        with pytest.raises(Exception, match="no single year"):
            population.read_responses(spark, str(tmp_path)).collect()
        given = population.read_responses(spark, str(tmp_path), years_by_name={"acs.json": 2017, "2015 to 2016.json": 2016})
        assert {r[0] for r in given.collect()} >= {1999, 2014, 2017}


def test_population_lines_below_year_folders(spark, tmp_path):
    for year in (2014, 2015):
        folder = tmp_path / f"Year={year}"
        folder.mkdir()
        (folder / "part-2020.txt").write_text('[["NAME","B01003_001E"],["ZCTA5 1","7"]]\n<html>\n')
    responses = population.read_responses(spark, str(tmp_path), whole_files=False)
    assert rows(population.load_population(responses)) == [("1", 2014, 7.0), ("1", 2015, 7.0)]


def verdicts(spark, *texts, copies=1):
    data = [(str(i), t) for i, t in enumerate(texts) for _ in range(copies)]
    raw = spark.createDataFrame(data, "ZIP string, the_geom string")
    found = {str(i): [] for i in range(len(texts))}
    for r in validity.assess_polygons(raw, "ZIP", "the_geom").collect():
        found[r["ZIP_Code"]].append(r["reason"])
    assert all(len(v) == copies for v in found.values())
    return [found[str(i)][0] for i in range(len(texts))]


SQUARE = "(0 0, 10 0, 10 10, 0 10, 0 0)"


@pytest.mark.parametrize("copies", [1, 2, 3])
def test_equal_rows_are_judged_alike(spark, copies):
    hole = f"POLYGON ({SQUARE}, (2 2, 4 2, 4 4, 2 4, 2 2))"
    part_in_part = f"MULTIPOLYGON (({SQUARE}), ((2 2, 4 2, 4 4, 2 4, 2 2)))"
    assert verdicts(spark, hole, part_in_part, copies=copies) == [None, "rings badly nested"]


def test_numbers_of_any_length(spark):
    long = "0." + "1" * 61
    texts = [f"POLYGON (({a} 0, 10 0, 10 10, 0 10, {a} 0))" for a in (long, "1e-100", "-1" + "0" * 80, "1e400", "0x1")]
    assert verdicts(spark, *texts) == [None, None, None, "malformed text", "malformed text"]


def test_holes_that_cut_the_interior(spark):
    once = f"POLYGON ({SQUARE}, (0 5, 4 4, 4 6, 0 5))"
    twice = f"POLYGON ({SQUARE}, (0 5, 5 4, 10 5, 5 6, 0 5))"
    chain = f"POLYGON ({SQUARE}, (0 5, 3 4, 5 5, 3 6, 0 5), (5 5, 7 4, 10 5, 7 6, 5 5))"
    apart = f"POLYGON ({SQUARE}, (0 5, 3 4, 4 5, 3 6, 0 5), (5 5, 7 4, 10 5, 7 6, 5 5))"
    ring_of_holes = (
        f"POLYGON ({SQUARE}, (2 2, 8 2, 8 3, 2 3, 2 2), (2 3, 3 5, 2 7, 1 5, 2 3), (2 7, 8 7, 8 8, 2 8, 2 7), (8 7, 9 5, 8 3, 7 5, 8 7))"
    )
    same_point = f"POLYGON ({SQUARE}, (5 5, 3 4, 3 6, 5 5), (5 5, 7 4, 7 6, 5 5))"
    cut = "interior cut in two"
    assert verdicts(spark, once, twice, chain, apart, ring_of_holes, same_point) == [None, cut, cut, None, cut, None]


def test_many_islands(spark):
    boxes = [f"(({x} {y}, {x + 1} {y}, {x + 1} {y + 1}, {x} {y + 1}, {x} {y}))" for x in range(0, 80, 2) for y in range(0, 100, 2)]
    assert verdicts(spark, f"MULTIPOLYGON ({', '.join(boxes)})") == [None]

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import plan_of, rows

from areapanel.operators import checks, lags, panel
from areapanel.plans import views

D = dt.date
FINAL = (
    "ZIP_CODE string, Month_Date date, Year int, Property_Crime_Count bigint, Violent_Crime_Count bigint, "
    "ZHVI_Value double, Population double"
)


def final(spark, *data):
    full = [(z, m, m.year, pc, vc, v, p) for z, m, pc, vc, v, p in data]
    return spark.createDataFrame(full, FINAL)


@pytest.fixture(scope="module")
def sample(spark):
    return final(
        spark,
        ("1", D(2017, 1, 1), 10, 1, 100.0, 2000.0),
        ("1", D(2017, 2, 1), 20, 3, 150.0, 2000.0),
        ("1", D(2017, 4, 1), 30, 5, 0.0, 2000.0),  # March is missing
        ("1", D(2017, 5, 1), 40, 7, 90.0, 2000.0),
        ("2", D(2016, 12, 1), 5, 5, 500.0, 0.0),
        ("2", D(2024, 12, 1), 7, 6, -50.0, 0.0),
        ("3", D(2020, 8, 1), 2, 2, 10.0, 1000.0),
        ("60602", D(2021, 7, 1), 1, 1, 10.0, 1000.0),
        ("60602", D(2022, 7, 1), 1, 1, 10.0, 1000.0),
        ("60602", D(2017, 8, 1), 1, 1, 10.0, 1000.0),
        ("60602", D(2019, 8, 1), 1, 1, 10.0, 1000.0),
        ("60602", D(2020, 7, 1), 1, 1, 10.0, 1000.0),
        ("60602", D(2021, 8, 1), 1, 1, 20.0, 1000.0),
        ("60603", D(2021, 7, 1), 1, 1, 10.0, 1000.0),
    )


def test_averages_and_totals(sample):
    assert dict(rows(views.property_crime_distribution(sample)))["1"] == 25.0
    assert dict(rows(views.violent_crime_distribution(sample)))["1"] == 4.0
    totals = {r[0]: r[1:] for r in rows(views.investment_efficiency_property(sample))}
    assert totals["1"] == (100, 340.0) and totals["2"] == (12, 450.0)


def test_seasonality(sample):
    got = {r["month_num"]: r for r in views.crime_seasonality(sample).collect()}
    assert got[12]["avg_property_crime_count"] == 6.0 and got[12]["avg_zhvi_value"] == 225.0
    assert {m for m, r in got.items() if r["peak_season"]} == {7, 8}
    assert got[5]["peak_season"] is False


def test_lag_effect(sample):
    got = {r[0]: r[1:] for r in views.lag_effect_property_crime(sample).collect()}
    assert got[1] == (10, 100.0, None)
    assert got[2] == (20, 150.0, 0.5)
    assert got[4] == (30, 0.0, -1.0)
    assert got[5] == (40, 90.0, None)  # the value before is 0
    assert got[12][0] == 7  # December 2016 lies before the range, December 2024 is inside
    assert got[12][2] == -2.0  # against August, 50 in total; rows, not calendar months


def test_rate_base_and_appreciation(sample):
    base = {r[:3]: r for r in rows(views.crime_rate_base(sample))}
    assert sorted(k for k in base if k[0] in ("60602", "60603")) == [
        ("60602", 2020, 7), ("60602", 2021, 8), ("60603", 2021, 7),
    ]
    assert base[("1", 2017, 2)] == ("1", 2017, 2, 20, 2000.0, 150.0, 10.0)
    assert base[("2", 2016, 12)][-1] is None
    rate = {r[:3]: r[-1] for r in rows(views.crime_rate_appreciation(sample))}
    assert len(rate) == len(base)
    assert rate[("1", 2017, 1)] is None and rate[("1", 2017, 2)] == 0.5
    assert rate[("1", 2017, 4)] == -1.0 and rate[("1", 2017, 5)] is None
    assert rate[("2", 2024, 12)] == pytest.approx(-1.1)
    assert rate[("60602", 2021, 8)] == 1.0  # spans the excluded month


def test_slope_compare(sample):
    got = {(r[0], r[1]): r[2:] for r in views.slope_compare(sample).collect()}
    areas = {r[0] for r in sample.select("ZIP_CODE").collect()}
    assert len(got) == 2 * len(areas)
    crime, growth, people, hypothesis = got[("1", "Property Crime")]
    assert crime == pytest.approx(12.5) and people == 2000.0 and hypothesis == "H1"
    assert growth == pytest.approx((50.0 - 100.0) / 2)
    assert got[("1", "Violent Crime")][0] == pytest.approx(2.0)
    assert got[("3", "Violent Crime")][1] is None
    assert got[("2", "Violent Crime")][0] is None and got[("2", "Violent Crime")][2] == 0.0
    assert views.slope_table(sample).columns == [
        "ZIP_CODE", "CRIME_TYPE", "CRIME_RATE", "HOUSING_GROWTH_PCT", "AVG_POPULATION", "HYPOTHESIS",
    ]


def test_views_are_registered(spark, sample):
    assert len(views.create_views(sample)) == 8
    got = spark.sql("select count(*) from vw_crime_slope_compare_tableau").first()[0]
    assert got == 10


@pytest.mark.parametrize("group_rows", [lags.GROUP_ROWS, 7])
def test_average_growth_against_pandas(spark, group_rows):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame(
        {
            "ZIP_CODE": np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 30, n).astype(str)),
            "Month_Date": [D(2015 + int(m) // 12, int(m) % 12 + 1, 1) for m in rng.integers(0, 40, n)],
            "ZHVI_Value": np.where(
                rng.random(n) < 0.5, rng.choice([0.0, 1.0, 2.0, 5.0, 8.0, -3.0], n), rng.normal(0, 1, n) ** 9
            ),
            "w": rng.random(n),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "w"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "ZIP_CODE string, Month_Date date, ZHVI_Value double, w double")
    got = {r["ZIP_CODE"]: r for r in lags.average_growth(df, carried=["w"], group_rows=group_rows).collect()}
    ordered = pdf.sort_values(["ZIP_CODE", "Month_Date", "ZHVI_Value"])
    before = ordered.groupby("ZIP_CODE")["ZHVI_Value"].shift(1)
    ordered["g"] = (ordered["ZHVI_Value"] - before) / before.replace(0, np.nan) * 100
    for area, group in ordered.groupby("ZIP_CODE"):
        assert got[area]["growth"] == pytest.approx(group["g"].mean()), area
        assert got[area]["avg_w"] == pytest.approx(group["w"].mean())


def test_a_month_of_many_close_values_is_cut(spark):
    level = spark.range(50_000).selectExpr("'a' as ZIP_CODE", "date'2020-01-01' as Month_Date", "1000 + id * 1e-6 as ZHVI_Value")
    sliced = lags._sliced(level, ["ZIP_CODE", "Month_Date"], "ZHVI_Value", 10_000)
    sizes = [r["count"] for r in sliced.groupBy("slice").count().collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 500
    order = sliced.selectExpr("slice < lag(slice) over (order by ZHVI_Value) as falls").where("falls")
    assert order.isEmpty()
    few = lags._sliced(level, ["ZIP_CODE", "Month_Date"], "ZHVI_Value", 50_000)
    assert few.select("slice").distinct().count() == 1


def test_average_growth_with_missing_values(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 1), 1.0), ("a", D(2020, 2, 1), None), ("a", D(2020, 3, 1), 2.0), ("a", D(2020, 4, 1), 3.0),
         ("b", D(2020, 1, 1), None)],
        "ZIP_CODE string, Month_Date date, ZHVI_Value double",
    )
    assert rows(lags.average_growth(df)) == [("a", 50.0), ("b", None)]


COUNTS = "ZIP_Code string, Month_Date date, Year int, Violent_Crime_Count bigint, Property_Crime_Count bigint"


def test_merge_and_density(spark):
    counts = spark.createDataFrame(
        [("1", D(2020, 1, 1), 2020, 1, 2), ("1", D(2020, 2, 1), 2020, 3, 4), ("2", D(2020, 1, 1), 2020, 5, 6)], COUNTS
    )
    values = spark.createDataFrame(
        [("1", D(2020, 1, 1), 10.0), ("1", D(2020, 1, 1), 11.0), ("2", D(2020, 1, 1), 12.0), ("3", D(2020, 1, 1), 1.0)],
        "ZIP_Code string, Month_Date date, ZHVI_Value double",
    )
    merged = panel.merge_master(counts, values)
    assert merged.columns == ["ZIP_Code", "Month_Date", "Year", "Violent_Crime_Count", "Property_Crime_Count", "ZHVI_Value"]
    assert [r[-1] for r in rows(merged)] == [10.0, 11.0, 12.0]
    assert rows(panel.duplicate_keys(merged, panel.KEY)) == [("1", D(2020, 1, 1), 2)]
    people = spark.createDataFrame([("1", 2020, 3000.0), ("2", 2020, 0.0)], "ZIP_Code string, Year int, Population double")
    dense = rows(panel.merge_master(counts, values, people), "ZIP_Code", "Violent_Crime_Density_per_1k", "Property_Crime_Density_per_1k")
    assert dense == [("1", 0.3333, 0.6667), ("1", 0.3333, 0.6667), ("2", None, None)]


def test_build_final(spark):
    analytical = spark.createDataFrame(
        [("1", D(2014, 1, 1), 2014, 1, 2, 3.0), ("1", D(2013, 1, 1), 2013, 1, 2, 3.0), ("1", D(2014, 2, 1), 2014, None, 2, 3.0),
         ("1", D(2014, 3, 1), 2014, 1, 2, None), ("2", D(2014, 1, 1), 2014, 1, 2, 3.0), ("3", D(2014, 1, 1), 2014, 1, 2, 3.0)],
        COUNTS + ", ZHVI_Value double",
    )
    people = spark.createDataFrame(
        [("1", 2014, 9.0), ("1", 2013, 9.0), ("2", 2014, None), ("3", 2015, 9.0)],
        "ZIP_Code string, Year int, Population double",
    )
    got = panel.build_final(analytical, people)
    assert got.columns[0] == "ZIP_CODE"
    assert rows(got) == [("1", D(2014, 1, 1), 2014, 2, 1, 3.0, 9.0)]


def test_exclusion_table(spark, sample):
    cells = spark.createDataFrame([("1", 2017, 2), ("3", 2020, 7)], "ZIP_CODE string, Year int, Month int")
    left = panel.without_months(sample, cells)
    assert sample.count() - left.count() == 1
    assert rows(left.where("ZIP_CODE = '1'"), "Month_Date") == [(D(2017, m, 1),) for m in (1, 4, 5)]


def test_key_overlap_and_guards(spark):
    a = spark.createDataFrame(
        [("1", 2014), ("1", 2014), ("1", 2015), ("2", 2013), (None, 2014)], "ZIP_Code string, Year int"
    )
    p = spark.createDataFrame([("1", 2014), ("2", 2013), (None, 2014), ("9", 2014)], "ZIP_Code string, Year int")
    got = checks.key_overlap(a, p)
    assert rows(got) == [(3, 3, 1, 2013, 2015)]
    for bad in ("NestedLoop", "Cartesian"):
        assert bad not in plan_of(got)
    checks.guard_overlap(got.first())
    with pytest.raises(RuntimeError, match="no .area, year. pair"):
        checks.guard_overlap(checks.key_overlap(a, p.where("ZIP_Code = '9'")).first())


def test_year_guards(spark):
    years = spark.createDataFrame([(2014,), (2024,), (2024,)], "Year int")
    profile = checks.year_profile(years).first()
    assert tuple(profile) == (2014, 2024, 2, 3)
    checks.guard_years(profile)
    checks.guard_not_empty(profile)
    with pytest.raises(ValueError, match="window"):
        checks.guard_years(checks.year_profile(spark.createDataFrame([(2013,)], "Year int")).first())
    empty = checks.year_profile(years.where("Year = 1")).first()
    with pytest.raises(ValueError, match="window"):
        checks.guard_years(empty)
    with pytest.raises(ValueError, match="empty"):
        checks.guard_not_empty(empty)


def test_observed_counts(spark):
    df, seen = checks.observe_counts(spark.range(7), "seven")
    df, years = checks.observe_years(df.selectExpr("cast(2014 + id as int) as Year"), "years")
    assert df.where("Year > 2015").count() == 5
    assert seen.get["rows"] == 7 and years.get["max_year"] == 2020 and years.get["null_years"] == 0


def test_months_without_many_values_are_not_joined(spark):
    df = spark.createDataFrame([("a", D(2020, 1, k), float(k), 1.0) for k in range(1, 5)], "ZIP_CODE string, Month_Date date, ZHVI_Value double, w double")
    plan = plan_of(lags.average_growth(df, carried=["w"]))
    assert "Join" not in plan and "ObjectHashAggregate" not in plan

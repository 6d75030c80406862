import datetime as dt

import pytest
from conftest import rows

from areapanel.plans import pipeline, views
from areapanel.sources import csv_files, publish

D = dt.date


@pytest.fixture
def sources(tmp_path):
    events = ["ID,Date,Primary Type,Latitude,Longitude,Beat"]
    for i in range(24):
        kind = "BATTERY" if i % 3 == 0 else "THEFT"
        x = -87.7 + (0.02 if i % 2 else -0.02)
        events.append(f"{i},{i % 12 + 1:02d}/15/2020 10:00:00 AM,{kind},41.8,{x},7")
    events += ["0,01/15/2020 10:00:00 AM,BATTERY,41.8,-87.72,7", "x,01/15/2030 10:00:00 AM,THEFT,41.8,-87.72,7"]
    areas = [
        "the_geom,ZIP,NAME",
        '"MULTIPOLYGON (((-87.75 41.75, -87.7 41.75, -87.7 41.85, -87.75 41.85, -87.75 41.75)))",60601,w',
        '"POLYGON ((-87.7 41.75, -87.65 41.75, -87.65 41.85, -87.7 41.85, -87.7 41.75))",60602,e',
        '"POLYGON ((-87.7 41.75, -87.65 41.85, -87.65 41.75, -87.7 41.86, -87.7 41.75))",60603,bad',
    ]
    months = [f"2020-{m:02d}-28" for m in range(1, 13)]
    values = ["RegionID,RegionName,RegionType,State,City," + ",".join(months)]
    for zip_code in ("60601", "60602"):
        values.append(f"1,{zip_code},zip,IL,Chicago," + ",".join(str(100 + m) for m in range(12)))
    (tmp_path / "events.csv").write_text("\n".join(events))
    (tmp_path / "areas.csv").write_text("\n".join(areas))
    (tmp_path / "values.csv").write_text("\n".join(values))
    folder = tmp_path / "responses"
    folder.mkdir()
    head = '["NAME","B01003_001E","zip code tabulation area"]'
    (folder / "2020.json").write_text(f'[{head},["ZCTA5 60601","1000","60601"],["ZCTA5 60602","500","60602"]]')
    (folder / "2021.json").write_text("<html>")
    return tmp_path, pipeline.Paths(*[str(tmp_path / n) for n in ("events.csv", "areas.csv", "values.csv", "responses")])


def test_run(spark, sources):
    folder, paths = sources
    out = str(folder / "out")
    done = pipeline.run(spark, paths, out)
    assert done.counts == {"areas": 2, "events": 24, "values": 24, "counts": 12, "master": 12}
    assert rows(done.final, "ZIP_CODE", "Month_Date", "Violent_Crime_Count", "Property_Crime_Count", "Population")[:2] == [
        ("60601", D(2020, 1, 1), 2, 0, 1000.0),
        ("60601", D(2020, 11, 1), 0, 2, 1000.0),
    ]
    assert done.final.count() == 12
    back = spark.read.option("header", True).csv(f"{out}/analytical.csv")
    assert back.count() == 12
    assert spark.read.option("header", True).csv(f"{out}/population.csv").columns == ["ZIP_Code", "Year", "Population"]
    other = spark.newSession()
    assert other.table("slope_table").count() == 4 and other.table("final_table").count() == 12
    for name, build in views.VIEWS.items():
        assert not spark.catalog.getTable(name).isTemporary
        seen, expected = other.table(name), build(spark.table("final_table"))
        assert seen.columns == expected.columns and rows(seen) == rows(expected)


def test_nothing_is_published_when_the_result_is_empty(spark, sources):
    folder, paths = sources
    text = (folder / "values.csv").read_text()
    (folder / "values.csv").write_text(text.replace("60601", "1").replace("60602", "2"))
    with pytest.raises(ValueError, match="empty"):
        pipeline.run(spark, paths, str(folder / "out"))
    assert not (folder / "out").exists()


def test_missing_population_fails(spark, sources):
    folder, paths = sources
    (folder / "responses" / "2020.json").write_text("[]")
    with pytest.raises(ValueError, match="population"):
        pipeline.run(spark, paths, str(folder / "out"))


def test_population_of_other_years_fails(spark, sources):
    folder, paths = sources
    body = (folder / "responses" / "2020.json").read_text()
    (folder / "responses" / "2020.json").write_text("[]")
    (folder / "responses" / "2019.json").write_text(body)
    with pytest.raises(RuntimeError, match="pair"):
        pipeline.run(spark, paths, str(folder / "out"))
    assert not (folder / "out").exists()


def test_a_failing_guard_leaves_the_old_output(spark, sources):
    folder, paths = sources
    pipeline.run(spark, paths, str(folder / "out"))
    files = lambda: {p: p.read_bytes() for p in (folder / "out").rglob("*") if p.is_file()}
    before, table = files(), rows(spark.table("final_table"))
    body = (folder / "responses" / "2020.json").read_text()
    (folder / "responses" / "2020.json").write_text("[]")
    (folder / "responses" / "2019.json").write_text(body)
    with pytest.raises(RuntimeError, match="pair"):
        pipeline.run(spark, paths, str(folder / "out"))
    assert files() == before and rows(spark.table("final_table")) == table


STEPS = ("write_csv", "store_version", "define", "store_views", "swap", "move", "settle", "drop_versions")


class Killed(BaseException):
    pass


def publish_small(spark, out, n):
    """One version whose rows all tell its number."""
    final = spark.createDataFrame(
        [("60601", D(2020, m, 1), 2020, n, n, float(n + m), 1000.0) for m in (1, 2)],
        "ZIP_CODE string, Month_Date date, Year int, Property_Crime_Count long, Violent_Crime_Count long, ZHVI_Value double, Population double",
    )
    people = spark.createDataFrame([("60601", 2020, float(n))], "ZIP_Code string, Year int, Population double")
    pipeline.publish_run(spark, out, final, people, final, views.slope_table(final))


def seen(spark, out):
    """The versions that readers see: of the tables and views on them, and of the folders."""
    other = spark.newSession()
    stored = {
        other.table("final_table").first()["Property_Crime_Count"],
        int(other.table("vw_property_crime_distribution").first()[1]),
        *(int(r["crime_rate"]) for r in other.table("vw_crime_slope_compare_tableau").collect()),
        *(int(r["CRIME_RATE"]) for r in other.table("slope_table").collect()),
    }
    folders = {int(float(spark.read.option("header", True).csv(f"{out}/population.csv").first()["Population"])),
               int(spark.read.option("header", True).csv(f"{out}/analytical.csv").first()["Property_Crime_Count"])}
    return stored, folders


def test_a_killed_run_leaves_one_version(spark, tmp_path, monkeypatch):
    """A run that dies before or after any step leaves all tables and views old, or all new; the folders follow."""
    out, n = str(tmp_path / "out"), 1
    publish_small(spark, out, n)
    assert seen(spark, out) == ({1}, {1})
    for step in STEPS:
        for when in ("before", "after"):
            old, n = n, n + 1
            owner = csv_files if step == "write_csv" else views if step == "store_views" else publish
            plain, calls = getattr(owner, step), []

            def dying(*given, plain=plain, calls=calls, when=when, step=step):
                calls.append(1)
                last = len(calls) == (2 if step in ("write_csv", "store_version", "move", "settle") else 1)
                if when == "before" and last:
                    raise Killed
                result = plain(*given)
                if when == "after" and last:
                    raise Killed
                return result

            with monkeypatch.context() as patch:
                patch.setattr(owner, step, dying)
                with pytest.raises(Killed):
                    publish_small(spark, out, n)
            late = step in ("move", "settle", "drop_versions") or (step, when) == ("swap", "after")
            n = n if late else old
            publish.settle(spark, out, publish.current(spark, "final_table_version"))
            assert seen(spark, out) == ({n}, {n}), (step, when)
    publish_small(spark, out, n + 1)
    assert seen(spark, out) == ({n + 1}, {n + 1})
    left = {r[0].split("/")[0] for r in spark.sql("SHOW PARTITIONS final_table_versions").collect()}
    assert len(left) == 2 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["analytical.csv", "population.csv"]


def test_wrong_header_fails(spark, sources):
    folder, paths = sources
    (folder / "events.csv").write_text("ID,Date\n1,2\n")
    with pytest.raises(ValueError, match="events has no column Latitude, Longitude, Primary Type"):
        pipeline.run(spark, paths, str(folder / "out"))


def test_paths_below_a_root():
    paths = pipeline.Paths.under("gs://bucket/", areas="a.csv")
    assert paths.events == "gs://bucket/chicago_crime.csv"
    assert paths.values == "gs://bucket/chicago_zillow_home_values.csv"
    assert paths.areas == "gs://bucket/a.csv"

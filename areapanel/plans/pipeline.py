"""The whole run: sources to analytical table, final table and views.

Every event file is scanned once. Row counts and the year range are observed while the staging
write runs; guards look at them before anything is published.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from areapanel import settings
from areapanel.operators import checks, panel, spatial
from areapanel.plans import clean, views
from areapanel.session import new_stage, staged
from areapanel.sources import contracts, csv_files, population, publish

BOUNDS = (settings.LONGITUDES, settings.LATITUDES)


@dataclass(frozen=True)
class Paths:
    events: str
    areas: str
    values: str
    responses: str

    @classmethod
    def under(
        cls,
        root: str,
        events="chicago_crime.csv",
        values="chicago_zillow_home_values.csv",
        areas="chicago_zip_boundaries.csv",
        responses="population",
    ) -> "Paths":
        """Objects below one bucket or folder, by their usual names."""
        return cls(*[f"{root.rstrip('/')}/{name}" for name in (events, areas, values, responses)])


@dataclass
class Run:
    analytical: DataFrame
    final: DataFrame
    counts: dict = field(default_factory=dict)


def analytical_table(spark: SparkSession, events_raw, areas_raw, values_raw, years=settings.YEARS):
    """Check, clean, count, merge and guard; returns the staged table and the row counts."""
    contracts.check_events(events_raw)
    contracts.check_areas(areas_raw)
    contracts.check_values(values_raw)
    areas = staged(clean.clean_boundaries(areas_raw), "areas")
    seen = {}
    events, seen["events"] = checks.observe_counts(
        clean.clean_points(events_raw, years=years), "events"
    )
    values, seen["values"] = checks.observe_counts(
        clean.clean_wide_series(values_raw, years=years), "values"
    )
    counted = spatial.count_by_area(events, areas, bounds=BOUNDS)
    counted, seen["counts"] = checks.observe_counts(counted, "counts")
    master, profile = checks.observe_years(panel.merge_master(counted, values), "master")
    stage = new_stage(spark, "analytical")
    master.write.parquet(stage)
    years_seen = profile.get
    checks.guard_not_empty(years_seen, years)
    checks.guard_years(years_seen, years)
    counts = {name: seen_one.get["rows"] for name, seen_one in seen.items()}
    counts["areas"] = areas.count()
    counts["master"] = years_seen["rows"]
    return spark.read.schema(master.schema).parquet(stage), counts


def final_table(analytical: DataFrame, people: DataFrame, years=settings.YEARS) -> DataFrame:
    """Check that the keys overlap, then join the population onto the analytical table."""
    contracts.require_rows(people, "population")
    checks.guard_overlap(checks.key_overlap(analytical, people, years).first(), years)
    return panel.build_final(analytical, people, years)


def run(
    spark: SparkSession,
    paths: Paths,
    out: str,
    years=settings.YEARS,
    *,
    final_name="final_table",
    slope_name="slope_table",
    schema: str | None = None,
    whole_responses=True,
) -> Run:
    """Read the four sources and publish: two CSV folders below ``out``, two tables, eight views.

    Everything is computed and every guard has passed before the first output is touched. All outputs
    are written as a new version beside the old one and become current in one step, so a run that is
    killed leaves the old set or the new one; folders that it did not move are moved by the next run. Tables and views are
    stored in the session catalog (in ``schema`` if given), so other sessions of it see them by name.
    """
    analytical, counts = analytical_table(
        spark,
        csv_files.read_csv_strings(spark, paths.events),
        csv_files.read_csv_strings(spark, paths.areas),
        csv_files.read_csv_strings(spark, paths.values),
        years,
    )
    if whole_responses:
        people = population.load_population_rows(population.read_response_rows(spark, paths.responses), years)
    else:
        people = population.load_population(population.read_responses(spark, paths.responses, whole_files=False), years)
    people = staged(people, "people")
    final = staged(final_table(analytical, people, years), "final")
    slopes = staged(views.slope_table(final), "slopes")

    current = publish_run(spark, out, analytical, people, final, slopes, final_name, slope_name, schema)
    return Run(analytical, current, counts)


def publish_run(spark, out, analytical, people, final, slopes, final_name="final_table", slope_name="slope_table", schema=None):
    """Write everything as a new version, make it the current one, and remove all but the one before; returns the
    final table by its name."""
    named = {n: f"{schema}.{n}" if schema else n for n in (final_name, slope_name)}
    pointer = f"{named[final_name]}_version"
    old, version = publish.current(spark, pointer), publish.new_version()
    publish.settle(spark, out, old)
    csv_files.write_csv(analytical, publish.beside(f"{out}/analytical.csv", version))
    csv_files.write_csv(people, publish.beside(f"{out}/population.csv", version))
    publish.store_version(final, named[final_name], version, ["Year"])
    publish.store_version(slopes, named[slope_name], version)
    publish.define(spark, pointer, {named[final_name]: final.columns, named[slope_name]: slopes.columns})
    views.store_views(spark, named[final_name], named[slope_name], schema)
    publish.swap(spark, pointer, version)
    publish.settle(spark, out, version)
    publish.drop_versions(spark, named.values(), (old, version))
    return spark.table(named[final_name])

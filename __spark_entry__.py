"""

Every query runs over whole tables. ``areapanel.analogues`` says how areas, events, values and
population are derived from the star-schema tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapanel import analogues as an
from areapanel import settings
from areapanel.operators import checks, lags, panel, reshape, spatial
from areapanel.operators.dedupe import dedupe_by_key
from areapanel.plans import clean, pipeline, views
from areapanel.session import new_stage, spread
from areapanel.sources import contracts, csv_files, inferred, population, tables

#: What the corpus queries need; without any of it the other queries are registered alone.
_CORPUS_NEEDS = ("areapanel.llm", "areapanel.llm.queries", "corpus_pipeline", "public_tokenizers", "tokenizers")
try:
    import areapanel.llm.queries as corpus
except ModuleNotFoundError as missing:
    if missing.name not in _CORPUS_NEEDS:
        raise
    corpus = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _rounded(df: DataFrame, **digits) -> DataFrame:
    """Doubles that depend on the order of addition, cut to a fixed number of digits."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# --- cleaning -----------------------------------------------------------------------------


def q_clean_points(spark, sf):
    return clean.clean_points(an.raw_events(spark, sf))


def q_dedupe_by_key(spark, sf):
    rows = an.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return dedupe_by_key(rows, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey"])


def q_clean_boundaries(spark, sf):
    areas = clean.clean_boundaries(an.customer_areas(spark, sf))
    return areas.select(
        "ZIP_Code", F.size("edges").alias("n_edges"), "xmin", "ymin", "xmax", "ymax"
    )


def q_rejected_boundaries(spark, sf):
    return clean.rejected_boundaries(an.customer_areas(spark, sf))


def q_melt_values(spark, sf):
    return clean.clean_wide_series(an.wide_values(spark, sf))


def q_population_json(spark, sf):
    return population.load_population(an.responses(spark, sf))


def q_population_report(spark, sf):
    return population.response_report(an.responses(spark, sf))


# --- spatial ------------------------------------------------------------------------------


def q_spatial_assign(spark, sf):
    areas = an.cleaned_nation_areas(spark, sf)
    joined = spatial.assign_area(an.points(spark, sf), areas, bounds=an.BOUNDS)
    return joined.select("l_orderkey", "l_linenumber", "x", "y", "ZIP_Code")


def q_spatial_assign_shuffled(spark, sf):
    """The same join as if the areas were too many to broadcast: by cell, hot cells salted."""
    areas = an.cleaned_nation_areas(spark, sf)
    joined = spatial.assign_area(
        an.points(spark, sf), areas, bounds=an.BOUNDS, broadcast_bytes=0, hot_rows=8
    )
    return joined.select("l_orderkey", "l_linenumber", "x", "y", "ZIP_Code")


def q_category_counts(spark, sf):
    """Counts as if the areas were too many to broadcast: whole cells counted first, equal points of border cells."""
    areas = an.cleaned_nation_areas(spark, sf)
    return spatial.count_by_area(an.points(spark, sf), areas, bounds=an.BOUNDS, broadcast_bytes=0, hot_rows=8)


def q_spatial_exact(spark, sf):
    """Points on slanted sides between decimal corners, broadcast and shuffled: both plans must agree on every row.

    Both join the same cells. Rows are dealt out by point: a point's rows then lie together, which packs them closer.
    """
    areas = clean.clean_boundaries(an.slanted_triangles(spark, sf))
    points, columns = an.points_on_sides(spark, sf), ["l_orderkey", "l_linenumber", "ZIP_Code"]
    cells = spatial.measured_cells(areas)
    small = spatial.assign_area(points, areas, cells=cells)
    small = small.select(*columns, F.lit(1).alias("broadcast"), F.lit(0).alias("shuffled"))
    large = spatial.assign_area(points, areas, cells=cells, broadcast_bytes=0)
    large = large.select(*columns, F.lit(0).alias("broadcast"), F.lit(1).alias("shuffled"))
    return small.union(large).repartition("l_orderkey", "l_linenumber").groupBy(*columns).agg(F.sum("broadcast").alias("broadcast"), F.sum("shuffled").alias("shuffled"))


def q_events_to_panel(spark, sf):
    """Raw text events to counts per area and month."""
    areas = an.cleaned_nation_areas(spark, sf)
    events = clean.clean_points(an.raw_events(spark, sf))
    return spatial.count_by_area(events, areas, bounds=an.BOUNDS)


# --- panel --------------------------------------------------------------------------------


def q_merge_master(spark, sf):
    values = clean.clean_wide_series(an.wide_values(spark, sf))
    return panel.merge_master(an.counts(spark, sf), values)


def q_density(spark, sf):
    return panel.add_density(an.analytical(spark, sf), an.people(spark, sf))


def q_final_table(spark, sf):
    return an.final(spark, sf)


def q_whole_run(spark, sf):
    """The whole run on text sources: events, areas, wide values and landed JSON responses."""
    landed = new_stage(spark, "responses")
    an.responses(spark, sf).withColumnRenamed("body", "value").write.partitionBy("year").text(landed)
    people = population.load_population(population.read_responses(spark, landed, whole_files=False))
    analytical, _ = pipeline.analytical_table(
        spark, an.raw_events(spark, sf), an.nation_areas(spark, sf), an.wide_values(spark, sf)
    )
    return pipeline.final_table(analytical, people)


_RUNS = {}


def _run_from_files(spark, sf):
    """One run per session and folder on landed files; returns the run and its output folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        landed, out = new_stage(spark, "landed"), new_stage(spark, "published")
        csv_files.write_csv(an.raw_events(spark, sf), f"{landed}/events.csv")
        csv_files.write_csv(an.nation_areas(spark, sf), f"{landed}/areas.csv")
        csv_files.write_csv(an.wide_values(spark, sf), f"{landed}/values.csv")
        an.responses(spark, sf).withColumnRenamed("body", "value").write.partitionBy("year").text(f"{landed}/responses")
        paths = pipeline.Paths.under(landed, "events.csv", "values.csv", "areas.csv", "responses")
        # A schema of the run's own, whose tables lie in the working folder and go with it.
        schema = f"run_{out.rpartition('-')[2]}"
        spark.sql(f"CREATE SCHEMA {schema} LOCATION '{new_stage(spark, 'tables')}'")
        _RUNS[key] = pipeline.run(spark, paths, out, schema=schema, whole_responses=False), out, schema
    return _RUNS[key]


def _stored(spark, sf, name):
    """A stored table or view of the run, read by its SQL name from another session."""
    schema = _run_from_files(spark, sf)[2]
    return spark.newSession().sql(f"SELECT * FROM {schema}.{name}")


def q_run_from_files(spark, sf):
    """The final table that a run on CSV and JSON files stores."""
    return _run_from_files(spark, sf)[0].final


def q_run_csv_sinks(spark, sf):
    """The CSV folder with the analytical table, read back as text and typed."""
    text = csv_files.read_csv_strings(spark, f"{_run_from_files(spark, sf)[1]}/analytical.csv")
    kinds = {"Month_Date": "date", "Year": "int", "ZHVI_Value": "double"}
    kinds |= {f"{c}_Crime_Count": "bigint" for c in settings.CATEGORIES}
    return text.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def q_run_counts(spark, sf):
    """The row counts of the run."""
    counts = _run_from_files(spark, sf)[0].counts
    return spark.createDataFrame(sorted(counts.items()), "step string, rows long")


def q_run_population_csv(spark, sf):
    """The CSV folder with the population, read back as text and typed."""
    text = csv_files.read_csv_strings(spark, f"{_run_from_files(spark, sf)[1]}/population.csv")
    return text.select("ZIP_Code", F.col("Year").cast("int").alias("Year"), F.col("Population").cast("double").alias("Population"))


def q_run_stored_view(spark, sf):
    return _rounded(_stored(spark, sf, "vw_crime_seasonality"), avg_property_crime_count=6, avg_zhvi_value=4)


def q_run_stored_property_avg(spark, sf):
    return _rounded(_stored(spark, sf, "vw_property_crime_distribution"), avg_property_crime_count=6)


def q_run_stored_violent_avg(spark, sf):
    return _rounded(_stored(spark, sf, "vw_violent_crime_distribution"), avg_violent_crime_count=6)


def q_run_stored_totals(spark, sf):
    return _rounded(_stored(spark, sf, "vw_investment_efficiency_property"), total_zhvi_value=2)


def q_run_stored_lag_effect(spark, sf):
    return _rounded(_stored(spark, sf, "vw_lag_effect_property_crime"), total_zhvi_value=2, monthly_appreciation_rate=6)


def q_run_stored_rate_base(spark, sf):
    found = _stored(spark, sf, "vw_crime_rate_housing_appreciation_base")
    return _rounded(found, total_zhvi_value=2, property_crime_rate_per_1000=6)


def q_run_stored_appreciation(spark, sf):
    found = _stored(spark, sf, "vw_crime_rate_housing_appreciation")
    return _rounded(found, total_zhvi_value=2, property_crime_rate_per_1000=6, monthly_appreciation_rate=6)


def q_run_stored_slope_compare(spark, sf):
    found = _stored(spark, sf, "vw_crime_slope_compare_tableau")
    return _rounded(found, crime_rate=6, housing_growth_pct=6, avg_population=6)


def q_run_stored_slope_table(spark, sf):
    return _rounded(_stored(spark, sf, "slope_table"), CRIME_RATE=6, HOUSING_GROWTH_PCT=6, AVG_POPULATION=6)


def q_population_files(spark, sf):
    """Landed yearly documents whose names hold a load date and the year, each read by many tasks."""
    landed = an.land_yearly_documents(spark, sf, new_stage(spark, "population"))
    return population.load_population_rows(population.read_response_rows(spark, landed))


def q_key_overlap(spark, sf):
    late = an.people(spark, sf).where("Population > 1200")
    return checks.key_overlap(an.counts(spark, sf), late)


def q_year_profile(spark, sf):
    return checks.year_profile(an.analytical(spark, sf))


def q_duplicate_keys(spark, sf):
    return panel.duplicate_keys(an.raw_events(spark, sf), ["ID"])


# --- views --------------------------------------------------------------------------------


def q_view_property_avg(spark, sf):
    return _rounded(views.property_crime_distribution(an.final(spark, sf)), avg_property_crime_count=6)


def q_view_violent_avg(spark, sf):
    return _rounded(views.violent_crime_distribution(an.final(spark, sf)), avg_violent_crime_count=6)


def q_view_totals(spark, sf):
    return _rounded(views.investment_efficiency_property(an.final(spark, sf)), total_zhvi_value=2)


def q_view_seasonality(spark, sf):
    return _rounded(
        views.crime_seasonality(an.final(spark, sf)), avg_property_crime_count=6, avg_zhvi_value=4
    )


def q_view_lag_effect(spark, sf):
    return _rounded(
        views.lag_effect_property_crime(an.final(spark, sf)),
        total_zhvi_value=2,
        monthly_appreciation_rate=6,
    )


def q_view_rate_base(spark, sf):
    return _rounded(
        views.crime_rate_base(an.final(spark, sf)), total_zhvi_value=2, property_crime_rate_per_1000=6
    )


def q_view_appreciation(spark, sf):
    return _rounded(
        views.crime_rate_appreciation(an.final(spark, sf)),
        total_zhvi_value=2,
        property_crime_rate_per_1000=6,
        monthly_appreciation_rate=6,
    )


def q_view_slope_compare(spark, sf):
    return _rounded(
        views.slope_compare(an.final(spark, sf)), crime_rate=6, housing_growth_pct=6, avg_population=6
    )


def q_slope_table(spark, sf):
    return _rounded(
        views.slope_table(an.final(spark, sf)), CRIME_RATE=6, HOUSING_GROWTH_PCT=6, AVG_POPULATION=6
    )


def q_exclusion_list(spark, sf):
    """Months in which an area sold nothing at full price are taken out, as a table of cells."""
    lines = an.table(spark, sf, "lineitem")
    cells = (
        lines.groupBy(
            an.supplier_area().alias("ZIP_CODE"),
            F.year(F.expr(an.SHIPPED)).alias("Year"),
            F.month(F.expr(an.SHIPPED)).alias("Month"),
        )
        .agg(F.min("l_discount").alias("low"))
        .where("low > 0.02")
    )
    return panel.without_months(an.final(spark, sf), cells)


def q_average_growth(spark, sf):
    """Growth from order line to order line per part: many rows share a month."""
    lines = an.table(spark, sf, "lineitem").select(
        "l_partkey", F.trunc("l_shipdate", "month").alias("month"), F.col("l_quantity").alias("amount"), "l_tax"
    )
    grown = lags.average_growth(lines, "l_partkey", "month", "amount", ["l_tax"])
    return _rounded(grown, growth=6, avg_l_tax=6)


def q_union_measures(spark, sf):
    """Two cleaned sources appended by name, one without the last column."""
    suppliers = an.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")
    )
    customers = an.table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")
    )
    return reshape.append_all([customers, suppliers])


# --- sources ------------------------------------------------------------------------------


def q_source_contract(spark, sf):
    lines = an.table(spark, sf, "lineitem").select(
        F.concat(F.lit(" "), F.lower("l_returnflag"), F.lit("ip ")).alias("RegionType")
    )
    return contracts.value_report(lines, "RegionType", "nip")


def q_source_scores(spark, sf):
    return contracts.source_scores(an.header_rows(spark, sf))


def q_classify_sources(spark, sf):
    return contracts.classify_sources(an.header_rows(spark, sf))


def _line_text(spark, sf):
    """Order lines as text with padded values and several spellings of null."""
    flag = F.col("l_returnflag")
    return an.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("Order_Key"),
        F.col("l_linenumber").cast("string").alias("Line"),
        F.concat(F.lit("  "), F.col("l_quantity").cast("string"), F.lit(" ")).alias("Quantity"),
        F.when(flag == "A", "NULL").when(flag == "N", " null ").otherwise(" R, \"so\" ").alias("Flag"),
        "l_linestatus",
    )


def _write_lines(df, path, columns, *folders):
    """A task keeps a file open in each of few folders; else it would sort all its rows by folder first."""
    conf, writers = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(writers)
    conf.set(writers, "32")
    try:
        (
            df.select(*columns, *folders)
            .write.mode("append")
            .partitionBy(*folders)
            .option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    finally:
        conf.set(writers, before)


def q_csv_by_name(spark, sf):
    """Two groups of files in folders with odd names, the second with other column order and letter
    case, and a text file beside them."""
    path = new_stage(spark, "lines")
    odd = F.concat(F.lit("50% [of] a "), F.col("l_linestatus")).alias("folder")
    text = _line_text(spark, sf).withColumn("folder", odd)
    _write_lines(text.where("l_linestatus = 'F'"), path, ["Order_Key", "Line", "Quantity", "Flag"], "folder")
    turned = text.where("l_linestatus <> 'F'").select(
        F.col("Flag").alias("FLAG"), F.col("Quantity").alias("quantity"), F.col("Line").alias("LINE"),
        F.col("Order_Key").alias("order_key"), "folder",
    )
    _write_lines(turned, path, turned.columns[:-1], "folder")
    an.table(spark, sf, "region").select(F.lit('a " quote').alias("value")).write.mode("append").text(path)
    schema = "order_key bigint, line int, quantity double, flag string"
    return csv_files.read_csv_by_name(spark, f"{path}/*", _schema(spark, schema))


def q_csv_multi_line(spark, sf):
    """Order lines and customers with one quoted field on several lines, and files whose quote stays open, which
    are left out."""
    path = new_stage(spark, "notes")
    lines, customers = an.table(spark, sf, "lineitem"), an.table(spark, sf, "customer")
    breaks = F.when(F.col("l_quantity") > 25, '",\r\n\n"').otherwise(',\n"",')
    note = F.concat(F.lit('"'), "l_returnflag", breaks, "l_linestatus").alias("note")
    _write_lines(lines, path, [F.col("l_orderkey").alias("key"), note, F.col("l_linenumber").alias("line")])
    note = F.concat(F.lit('"'), "c_name", F.lit('",\n'), "c_mktsegment").alias("NOTE")
    _write_lines(customers, path, [note, F.lit(0).alias("LINE"), F.col("c_custkey").alias("Key")])
    lone = F.concat(F.lit('key,note\n1,"'), "r_name", F.lit("\n2,x")).alias("value")
    an.table(spark, sf, "region").select(lone, "r_name").write.mode("append").partitionBy("r_name").text(path)
    schema = _schema(spark, "key bigint, note string, line int")
    return csv_files.read_csv_by_name(spark, f"{path}/*", schema, glob="*", multi_line=True)


def q_csv_skip_bad_files(spark, sf):
    """Files of seventh lines hold a quantity that is no number and are left out whole."""
    path = new_stage(spark, "lines")
    quantity = F.when(F.col("l_linenumber") == 7, "oops").otherwise(F.col("l_quantity").cast("string"))
    lines = an.table(spark, sf, "lineitem").withColumn("quantity", quantity)
    lines = lines.withColumn("part", F.concat(F.lit("line "), F.col("l_linenumber")))
    _write_lines(lines, path, ["l_orderkey", "l_linenumber", "quantity"], "part")
    schema = _schema(spark, "l_orderkey bigint, l_linenumber int, quantity double")
    return csv_files.read_csv_by_name(spark, f"{path}/*", schema)


def q_csv_nulls(spark, sf):
    return csv_files.normalise_nulls(_line_text(spark, sf).drop("l_linestatus"))


def q_infer_types(spark, sf):
    lines = spread(an.table(spark, sf, "lineitem"))
    text = lines.select(
        *[F.col(c).cast("string").alias(c) for c in lines.columns],
        F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("padded"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        (F.col("l_returnflag") == "R").cast("string").alias("returned"),
    )
    return csv_files.probe_types(text)


def _inferred_table(spark, sf):
    """A table made from landed files of two column orders and date forms, by its name in a schema of its own."""
    path, schema = new_stage(spark, "typed"), f"typed_{uuid.uuid4().hex}"
    lines = an.table(spark, sf, "lineitem").withColumn("odd", F.col("l_linenumber") % 2)
    day = F.when(F.col("odd") == 1, F.date_format("l_shipdate", "MM/dd/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    text = lines.select(
        F.col("l_orderkey").alias("Order_Key"), F.col("l_linenumber").alias("Line"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("Zip"),
        F.concat(F.lit("1"), F.lpad(F.col("l_orderkey").cast("string"), 24, "0")).alias("Wide"), F.col("l_quantity").alias("Quantity"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("Tax"), day.alias("Shipped"), (F.col("l_returnflag") == "R").alias("Returned"), "odd",
    )
    _write_lines(text.where("odd = 0"), path, text.columns[:-1])
    _write_lines(text.where("odd = 1"), path, [F.col(c).alias(c.upper()) for c in reversed(text.columns[:-1])])
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{new_stage(spark, 'tables')}'")
    inferred.table_from_text(csv_files.read_csv_by_name(spark, path), f"{schema}.lines")
    return f"{schema}.lines"


def q_inferred_table(spark, sf):
    """A typed table created from text, loaded by name and read back."""
    lines = spark.table(_inferred_table(spark, sf))
    exact = {c: F.col(c).cast("double") for c in ("quantity", "tax")}
    return lines.withColumns(exact | {"wide": F.col("wide").cast("string")})


def q_inferred_columns(spark, sf):
    """The columns and types of that table as the catalog describes them."""
    return tables.describe_table(spark, _inferred_table(spark, sf))


def _schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def entry(spark: SparkSession) -> DataFrame:
    """Raw events to counts per area and month, then the average per area."""
    counts = q_events_to_panel(spark, SMOKE_DIR)
    return views.property_crime_distribution(counts.withColumnRenamed("ZIP_Code", "ZIP_CODE"))


def panel_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: call for name, call in globals().items() if name.startswith("q_")}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return panel_queries() | (corpus.queries() if corpus else {})


# --- SQL twins ----------------------------------------------------------------------------

_TYPES = "['BATTERY','THEFT','ASSAULT','BURGLARY','HOMICIDE','battery','ROBBERY']"
_VIOLENT = "('BATTERY','ASSAULT','HOMICIDE','ROBBERY','CRIM SEXUAL ASSAULT','KIDNAPPING','SEX OFFENSE')"
_SHIPPED = "(l_shipdate + INTERVAL 18 YEAR)"
_MONTH = f"CAST(date_trunc('month', {_SHIPPED}) AS DATE)"
_YEAR = f"CAST(year({_SHIPPED}) AS INTEGER)"
_ZIP = "CAST(60600 + l_suppkey AS VARCHAR)"
_CATEGORY = f"CASE WHEN {_TYPES}[l_linenumber] IN {_VIOLENT} THEN 'Violent' ELSE 'Property' END"

_EVENTS = f"""
texts AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id,
    CASE WHEN l_tax = 0 THEN strftime(t, '%Y-%m-%d')
         WHEN l_linestatus = 'F' THEN strftime(t, '%m/%d/%Y %I:%M:%S %p')
         ELSE strftime(t, '%m/%d/%Y %H:%M:%S') END AS date_text,
    CASE WHEN l_quantity <> 13 THEN {_TYPES}[l_linenumber] END AS kind,
    CASE WHEN l_discount = CAST(0.1 AS DOUBLE) OR l_discount = CAST(0.09 AS DOUBLE) THEN NULL
         ELSE 41.25::DOUBLE + (l_partkey * 61 % 1024)::DOUBLE / 1024 END AS lat,
    -88.125::DOUBLE + ((l_partkey * 37 + l_suppkey * 13 + l_orderkey * 7) % 768)::DOUBLE / 1024 AS lon
  FROM (SELECT *, {_SHIPPED} + to_minutes(CAST(l_quantity * 29 AS INTEGER)) AS t FROM lineitem)
),
kept AS (
  SELECT * FROM texts WHERE kind IS NOT NULL AND lat IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY date_text, kind, lat, lon) = 1
),
parsed AS (
  SELECT *, CAST(date_trunc('month', coalesce(try_strptime(date_text, '%m/%d/%Y %I:%M:%S %p'),
                                  try_strptime(date_text, '%m/%d/%Y %H:%M:%S'))) AS DATE) AS m
  FROM kept WHERE lat BETWEEN 41.5 AND 42.1 AND lon BETWEEN -88.0 AND -87.5
),
events_clean AS (
  SELECT id AS "ID", m AS "Month_Date", CAST(year(m) AS INTEGER) AS "Year",
    CASE WHEN kind IN {_VIOLENT} THEN 'Violent' ELSE 'Property' END AS "Crime_Category", lon AS x, lat AS y
  FROM parsed WHERE year(m) BETWEEN 2014 AND 2024
)"""

_AREAS = """
areas AS (
  SELECT CAST(60600 + n_nationkey AS VARCHAR) AS zip,
    -87.96875::DOUBLE + (n_nationkey % 5) * 0.09375::DOUBLE AS cx,
    41.5625::DOUBLE + (n_nationkey // 5) * 0.109375::DOUBLE AS cy FROM nation
)"""

_HIT = """((abs(p.x - a.cx) + abs(p.y - a.cy) BETWEEN 0.015625::DOUBLE AND 0.09375::DOUBLE)
  OR abs(p.x - (a.cx + 0.1875::DOUBLE)) + abs(p.y - a.cy) <= 0.03125::DOUBLE)"""

_POINTS = f"""
points AS (
  SELECT l_orderkey, l_linenumber, {_MONTH} AS "Month_Date", {_YEAR} AS "Year", {_CATEGORY} AS "Crime_Category",
    -88.0::DOUBLE + (((l_orderkey * 7 + l_linenumber) * 37 + l_partkey) % 513)::DOUBLE / 1024 AS x,
    41.5::DOUBLE + (((l_orderkey * 7 + l_linenumber) * 61 + l_suppkey) % 615)::DOUBLE / 1024 AS y
  FROM lineitem
)"""

_COUNT_COLUMNS = """
    CAST(sum(CASE WHEN "Crime_Category" = 'Violent' THEN 1 ELSE 0 END) AS BIGINT) AS "Violent_Crime_Count",
    CAST(sum(CASE WHEN "Crime_Category" = 'Property' THEN 1 ELSE 0 END) AS BIGINT) AS "Property_Crime_Count"
"""

_PANEL = f"""
counts AS (
  SELECT "ZIP_Code", "Month_Date", "Year", {_COUNT_COLUMNS}
  FROM (SELECT {_ZIP} AS "ZIP_Code", {_MONTH} AS "Month_Date", {_YEAR} AS "Year",
               {_CATEGORY} AS "Crime_Category" FROM lineitem)
  GROUP BY ALL
),
vals AS (
  SELECT {_ZIP} AS "ZIP_Code", {_MONTH} AS "Month_Date",
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS "ZHVI_Value", count(*) AS n,
    l_suppkey
  FROM lineitem GROUP BY ALL
),
people AS (
  SELECT {_ZIP} AS "ZIP_Code", {_YEAR} AS "Year",
    sum(CASE WHEN l_tax > CAST(0.01 AS DOUBLE) THEN l_quantity END) AS "Population"
  FROM lineitem GROUP BY ALL
),
analytical AS (
  SELECT c.*, v."ZHVI_Value" FROM counts c JOIN vals v USING ("ZIP_Code", "Month_Date")
),
final AS (
  SELECT a."ZIP_Code" AS zip, a."Month_Date" AS m, a."Year" AS y, a."Property_Crime_Count" AS pc,
    a."Violent_Crime_Count" AS vc, a."ZHVI_Value" AS z, p."Population" AS pop
  FROM analytical a JOIN people p ON a."ZIP_Code" = p."ZIP_Code" AND a."Year" = p."Year"
  WHERE a."Year" BETWEEN 2014 AND 2024 AND p."Population" IS NOT NULL
),
base AS (
  SELECT zip, CAST(year(m) AS INTEGER) AS y, CAST(month(m) AS INTEGER) AS mo, CAST(sum(pc) AS BIGINT) AS pc,
    sum(pop) AS pop, sum(z) AS z
  FROM final
  WHERE NOT (zip = '60602' AND ((month(m) = 7 AND year(m) IN (2021, 2022)) OR (month(m) = 8 AND year(m) IN (2017, 2019))))
  GROUP BY ALL
),
grown AS (
  SELECT zip, pop, vc / nullif(pop, 0) * 1000 AS vr, pc / nullif(pop, 0) * 1000 AS pr,
    (z - lag(z) OVER w) / nullif(lag(z) OVER w, 0) * 100 AS g
  FROM final WINDOW w AS (PARTITION BY zip ORDER BY m, z)
),
slopes AS (
  SELECT zip, avg(vr) AS vr, avg(pr) AS pr, avg(g) AS g, avg(pop) AS pop FROM grown GROUP BY zip
)"""

_SLOPE_ROWS = """
  SELECT zip AS "{z}", '{label}' AS "{t}", round({c}, 6) AS "{r}", round(g, 6) AS "{h}",
    round(pop, 6) AS "{p}", 'H1' AS "{y}" FROM slopes
"""


def _slopes(z, t, r, h, p, y):
    names = dict(z=z, t=t, r=r, h=h, p=p, y=y)
    violent = _SLOPE_ROWS.format(label="Violent Crime", c="vr", **names)
    other = _SLOPE_ROWS.format(label="Property Crime", c="pr", **names)
    return f"WITH {_PANEL} {violent} UNION ALL {other}"


_CUSTOMER_AREAS = """
shaped AS (
  SELECT CAST(c_custkey AS VARCHAR) AS zip,
    -88.0::DOUBLE + (c_custkey % 4096)::DOUBLE / 8192 AS cx,
    41.5::DOUBLE + ((c_custkey // 4096) % 4096)::DOUBLE / 8192 AS cy,
    CASE WHEN c_nationkey = 7 THEN 'not a polygon'
         WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'rings badly nested'
         WHEN c_mktsegment = 'MACHINERY' THEN 'edges cross'
         WHEN c_mktsegment = 'HOUSEHOLD' THEN 'ring not closed' END AS reason,
    c_mktsegment AS segment
  FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 5 = 0) WHERE c_nationkey <> 3
)"""

_RESPONSES = f"""
yearly AS (
  SELECT {_ZIP} AS zip, {_YEAR} AS y, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q
  FROM lineitem GROUP BY ALL
)"""

_RUN = f"""WITH {_EVENTS}, {_AREAS}, {_PANEL}, {_RESPONSES},
counted AS (
  SELECT a.zip AS "ZIP_Code", "Month_Date", "Year", {_COUNT_COLUMNS}
  FROM events_clean p JOIN areas a ON {_HIT} GROUP BY 1, 2, 3
),
run_values AS (
  SELECT v."ZIP_Code", v."Month_Date", v."ZHVI_Value" FROM vals v JOIN supplier s ON s.s_suppkey = v.l_suppkey
  WHERE v.n > 3 AND s_acctbal >= 0 AND s_nationkey <> 11 AND year("Month_Date") BETWEEN 2014 AND 2020 AND "ZHVI_Value" > 0
),
run_master AS (SELECT c.*, v."ZHVI_Value" FROM counted c JOIN run_values v USING ("ZIP_Code", "Month_Date")),
run_final AS (
  SELECT m."ZIP_Code" AS "ZIP_CODE", "Month_Date", "Year", "Property_Crime_Count", "Violent_Crime_Count", "ZHVI_Value",
    CAST(q AS DOUBLE) AS "Population"
  FROM run_master m JOIN yearly y ON y.zip = m."ZIP_Code" AND y.y = m."Year"
  WHERE y.n % 11 <> 0 AND y.n % 5 <> 0 AND y.n % 7 <> 0 AND q > 0
)"""

_HEADERS = """
headers AS (
  SELECT 'order-' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '.csv' AS file,
    ['ID','Date','Primary Type','Latitude','Longitude','zip','SHAPE_wkt'][l_linenumber] AS col FROM lineitem
),
scores AS (
  SELECT file,
    count(DISTINCT col) FILTER (col IN ('ID','Date','Primary Type','Latitude','Longitude')) AS crime,
    0 AS zillow,
    count(DISTINCT col) FILTER (col IN ('zip', 'SHAPE_wkt')) AS boundary
  FROM headers GROUP BY file
)"""

_LONG_SCORES = """
  SELECT file, 'crime' AS kind, CAST(crime AS INTEGER) AS score FROM scores
  UNION ALL SELECT file, 'zillow', CAST(zillow AS INTEGER) FROM scores
  UNION ALL SELECT file, 'boundary', CAST(boundary AS INTEGER) FROM scores
"""

_KIND_OF = {
    "bigint": "try_cast({c} AS BIGINT) IS NULL OR contains({c}, '.') OR regexp_matches({c}, '^[+-]?0[0-9]')",
    "double": "try_cast({c} AS DOUBLE) IS NULL OR regexp_matches({c}, '^[+-]?0[0-9]')",
    "date": "NOT regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') OR try_cast({c} AS DATE) IS NULL",
    "timestamp": "NOT regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR try_cast({c} AS TIMESTAMP) IS NULL",
    "boolean": "try_cast({c} AS BOOLEAN) IS NULL",
}


def _exact_sql():
    """Crossings counted in whole numbers: a double from 1 to 128 is a whole number of 2^-52."""
    units = lambda v: f"CAST(({v}) * 4503599627370496::DOUBLE AS HUGEINT)"
    at = [("x0", "y0"), ("x0 + 40 * dx", "y0 + 40 * dy"), ("x0 + 40 * dy", "y0 - 40 * dx")]
    side = "((x2 - x1) * (py - y1) - (px - x1) * (y2 - y1))"
    rings = " UNION ALL ".join(
        f"SELECT k, {', '.join(units(f'({v}) / 1000.0::DOUBLE') + f' AS {n}' for v, n in zip((*a, *b), ('ax', 'ay', 'ex', 'ey')))} FROM triangles"
        for a, b in zip(at, [*at[1:], at[0]])
    )
    turned = "CASE WHEN l_partkey % 2 = 0 THEN {} ELSE {} END"
    px = f"({turned.format('x0 + j * dy', 'x0 + j * dx')} + CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 3 - 1 ELSE 0 END) / 1000.0::DOUBLE"
    py = f"({turned.format('y0 - j * dx', 'y0 + j * dy')}) / 1000.0::DOUBLE"
    steps = "2000 + {0} * 7919 % 90000 AS x0, 2000 + {0} * 104729 % 90000 AS y0, 1 + {0} % 17 AS dx, 3 + {0} % 23 AS dy"
    return f"""
        WITH triangles AS (SELECT s_suppkey AS k, {steps.format("s_suppkey")} FROM supplier),
        lines AS (SELECT *, {steps.format("l_suppkey")}, (l_orderkey + l_linenumber) % 42 AS j FROM lineitem),
        spots AS (SELECT row_number() OVER () AS r, l_orderkey, l_linenumber, {units(px)} AS px, {units(py)} AS py FROM lines),
        sides AS (
          SELECT k, CASE WHEN up THEN ax ELSE ex END AS x1, CASE WHEN up THEN ay ELSE ey END AS y1,
            CASE WHEN up THEN ex ELSE ax END AS x2, CASE WHEN up THEN ey ELSE ay END AS y2
          FROM (SELECT *, ay < ey OR (ay = ey AND ax <= ex) AS up FROM ({rings}))
        ),
        boxes AS (SELECT k, min(least(x1, x2)) AS xl, max(greatest(x1, x2)) AS xh, min(y1) AS yl, max(y2) AS yh FROM sides GROUP BY k),
        near AS (SELECT s.*, k FROM spots s JOIN boxes ON px BETWEEN xl AND xh AND py BETWEEN yl AND yh),
        judged AS (
          SELECT l_orderkey, l_linenumber, n.k,
            bool_or(py BETWEEN y1 AND y2 AND {side} = 0 AND px BETWEEN least(x1, x2) AND greatest(x1, x2)) AS on_side,
            count(*) FILTER (py >= y1 AND py < y2 AND {side} > 0) % 2 = 1 AS inside
          FROM near n JOIN sides s ON s.k = n.k GROUP BY r, l_orderkey, l_linenumber, n.k
        )
        SELECT l_orderkey, l_linenumber, CAST(k AS VARCHAR) AS "ZIP_Code", CAST(count(*) AS BIGINT) AS broadcast,
          CAST(count(*) AS BIGINT) AS shuffled FROM judged WHERE on_side OR inside GROUP BY 1, 2, 3"""


def _probe_sql():
    plain = [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    texts = {c: f"CAST({c} AS VARCHAR)" for c in plain}
    texts["padded"] = "lpad(CAST(l_suppkey AS VARCHAR), 5, '0')"
    texts["day"] = "strftime(l_shipdate, '%Y-%m-%d')"
    texts["returned"] = "CAST(l_returnflag = 'R' AS VARCHAR)"
    rows = []
    for name, text in texts.items():
        cases = " ".join(
            f"WHEN count(*) FILTER (({text}) IS NOT NULL AND ({bad.format(c=text)})) = 0 THEN '{kind}'"
            for kind, bad in _KIND_OF.items()
        )
        rows.append(f"SELECT '{name}' AS \"column\", CASE {cases} ELSE 'string' END AS \"type\" FROM lineitem")
    return " UNION ALL ".join(rows)


def oracle_sql() -> dict[str, str]:
    return panel_sql() | (corpus.oracle_sql() if corpus else {})


#: Stored objects of the run and the queries whose SQL gives the same over the panel's own final table.
_STORED = {
    "run_stored_property_avg": "view_property_avg",
    "run_stored_violent_avg": "view_violent_avg",
    "run_stored_totals": "view_totals",
    "run_stored_lag_effect": "view_lag_effect",
    "run_stored_rate_base": "view_rate_base",
    "run_stored_appreciation": "view_appreciation",
    "run_stored_slope_compare": "view_slope_compare",
    "run_stored_slope_table": "slope_table",
}

_RUN_FINAL = """final AS (
  SELECT "ZIP_CODE" AS zip, "Month_Date" AS m, "Year" AS y, "Property_Crime_Count" AS pc, "Violent_Crime_Count" AS vc,
    "ZHVI_Value" AS z, "Population" AS pop FROM run_final
),"""


def panel_sql() -> dict[str, str]:
    found = _plain_sql()
    later = _PANEL[_PANEL.index("base AS (") :]
    for name, twin in _STORED.items():
        found[name] = f"{_RUN} SELECT * FROM (" + found[twin].replace(f"WITH {_PANEL}", f"WITH {_RUN_FINAL} {later}") + ")"
    return found


def _plain_sql() -> dict[str, str]:
    return {
        "clean_points": f"WITH {_EVENTS} SELECT * FROM events_clean",
        "dedupe_by_key": """
            SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey FROM lineitem
            QUALIFY row_number() OVER (
              PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1""",
        "clean_boundaries": f"""WITH {_CUSTOMER_AREAS}
            SELECT zip AS "ZIP_Code",
              CAST(CASE WHEN segment IN ('BUILDING', 'AUTOMOBILE') THEN 8 ELSE 4 END AS INTEGER) AS n_edges,
              cx - 0.0078125::DOUBLE AS xmin, cy - 0.0078125::DOUBLE AS ymin,
              CASE WHEN segment = 'AUTOMOBILE' THEN cx + 1 + 0.001953125::DOUBLE
                   ELSE cx + 0.0078125::DOUBLE END AS xmax,
              cy + 0.0078125::DOUBLE AS ymax
            FROM shaped WHERE reason IS NULL""",
        "rejected_boundaries": f"""WITH {_CUSTOMER_AREAS}
            SELECT zip AS "ZIP_Code", reason FROM shaped WHERE reason IS NOT NULL""",
        "melt_values": f"""WITH {_PANEL}
            SELECT v."ZIP_Code", v."Month_Date", v."ZHVI_Value"
            FROM vals v JOIN supplier s ON s.s_suppkey = v.l_suppkey
            WHERE n > 3 AND s_acctbal >= 0 AND s_nationkey <> 11 AND year("Month_Date") BETWEEN 2014 AND 2020
              AND "ZHVI_Value" > 0""",
        "population_json": f"""WITH {_RESPONSES}
            SELECT zip AS "ZIP_Code", y AS "Year", CAST(q AS DOUBLE) AS "Population" FROM yearly
            WHERE n % 11 <> 0 AND n % 5 <> 0 AND n % 7 <> 0 AND y BETWEEN 2014 AND 2024 AND q > 0""",
        "population_report": f"""WITH {_RESPONSES}
            SELECT y AS year, count(*) AS documents,
              count(*) FILTER (n % 11 <> 0) AS usable_documents FROM yearly GROUP BY y""",
        "spatial_assign": f"""WITH {_POINTS}, {_AREAS}
            SELECT p.l_orderkey, p.l_linenumber, p.x, p.y, a.zip AS "ZIP_Code"
            FROM points p JOIN areas a ON {_HIT}""",
        "spatial_assign_shuffled": f"""WITH {_POINTS}, {_AREAS}
            SELECT p.l_orderkey, p.l_linenumber, p.x, p.y, a.zip AS "ZIP_Code"
            FROM points p JOIN areas a ON {_HIT}""",
        "spatial_exact": _exact_sql(),
        "category_counts": f"""WITH {_POINTS}, {_AREAS}
            SELECT a.zip AS "ZIP_Code", "Month_Date", "Year", {_COUNT_COLUMNS}
            FROM points p JOIN areas a ON {_HIT} GROUP BY 1, 2, 3""",
        "events_to_panel": f"""WITH {_EVENTS}, {_AREAS}
            SELECT a.zip AS "ZIP_Code", "Month_Date", "Year", {_COUNT_COLUMNS}
            FROM events_clean p JOIN areas a ON {_HIT} GROUP BY 1, 2, 3""",
        "merge_master": f"""WITH {_PANEL}
            SELECT c."ZIP_Code", c."Month_Date", c."Year", "Violent_Crime_Count", "Property_Crime_Count", "ZHVI_Value"
            FROM counts c JOIN vals v ON c."ZIP_Code" = v."ZIP_Code" AND c."Month_Date" = v."Month_Date"
            JOIN supplier s ON s.s_suppkey = v.l_suppkey
            WHERE n > 3 AND s_acctbal >= 0 AND s_nationkey <> 11
              AND year(c."Month_Date") BETWEEN 2014 AND 2020 AND "ZHVI_Value" > 0""",
        "density": f"""WITH {_PANEL}
            SELECT a.*, p."Population",
              CASE WHEN p."Population" > 0 THEN round("Violent_Crime_Count" / p."Population" * 1000, 4) END
                AS "Violent_Crime_Density_per_1k",
              CASE WHEN p."Population" > 0 THEN round("Property_Crime_Count" / p."Population" * 1000, 4) END
                AS "Property_Crime_Density_per_1k"
            FROM analytical a LEFT JOIN people p ON a."ZIP_Code" = p."ZIP_Code" AND a."Year" = p."Year" """,
        "final_table": f"""WITH {_PANEL}
            SELECT zip AS "ZIP_CODE", m AS "Month_Date", y AS "Year", pc AS "Property_Crime_Count",
              vc AS "Violent_Crime_Count", z AS "ZHVI_Value", pop AS "Population" FROM final""",
        "whole_run": f"{_RUN} SELECT * FROM run_final",
        "run_from_files": f"{_RUN} SELECT * FROM run_final",
        "run_csv_sinks": f"{_RUN} SELECT * FROM run_master",
        "run_population_csv": f"""WITH {_RESPONSES}
            SELECT zip AS "ZIP_Code", y AS "Year", CAST(q AS DOUBLE) AS "Population" FROM yearly
            WHERE n % 11 <> 0 AND n % 5 <> 0 AND n % 7 <> 0 AND y BETWEEN 2014 AND 2024 AND q > 0""",
        "run_counts": f"""{_RUN}
            SELECT 'areas' AS step, (SELECT count(*) FROM nation) AS rows
            UNION ALL SELECT 'events', (SELECT count(*) FROM events_clean)
            UNION ALL SELECT 'values', (SELECT count(*) FROM run_values)
            UNION ALL SELECT 'counts', (SELECT count(*) FROM counted)
            UNION ALL SELECT 'master', (SELECT count(*) FROM run_master)""",
        "run_stored_view": f"""{_RUN}
            SELECT CAST(month("Month_Date") AS INTEGER) AS month_num,
              round(avg("Property_Crime_Count"), 6) AS avg_property_crime_count,
              round(avg("ZHVI_Value"), 4) AS avg_zhvi_value, month("Month_Date") BETWEEN 6 AND 8 AS peak_season
            FROM run_final GROUP BY 1, 4""",
        "population_files": f"""WITH {_RESPONSES}
            SELECT zip AS "ZIP_Code", y AS "Year", CAST(q AS DOUBLE) AS "Population" FROM yearly
            WHERE n % 5 <> 0 AND n % 7 <> 0 AND y BETWEEN 2014 AND 2024 AND q > 0""",
        "key_overlap": f"""WITH {_PANEL},
            a AS (SELECT DISTINCT "ZIP_Code", "Year" FROM counts WHERE "Year" BETWEEN 2014 AND 2024),
            p AS (SELECT DISTINCT "ZIP_Code", "Year" FROM people
                  WHERE "Population" > 1200 AND "Year" BETWEEN 2014 AND 2024)
            SELECT (SELECT count(*) FROM a) AS analytical_pairs,
              (SELECT count(*) FROM p) AS population_pairs,
              (SELECT count(*) FROM a JOIN p USING ("ZIP_Code", "Year")) AS overlapping_pairs,
              (SELECT min("Year") FROM counts) AS analytical_min_year,
              (SELECT max("Year") FROM counts) AS analytical_max_year""",
        "year_profile": f"""WITH {_PANEL}
            SELECT min("Year") AS min_year, max("Year") AS max_year, count(DISTINCT "Year") AS distinct_years,
              count(*) AS rows FROM analytical""",
        "duplicate_keys": """
            SELECT CAST(l_orderkey AS VARCHAR) AS "ID", count(*) AS n_rows FROM lineitem
            GROUP BY 1 HAVING count(*) > 1""",
        "view_property_avg": f"""WITH {_PANEL}
            SELECT zip AS zip_code, round(avg(pc), 6) AS avg_property_crime_count FROM final GROUP BY zip""",
        "view_violent_avg": f"""WITH {_PANEL}
            SELECT zip AS zip_code, round(avg(vc), 6) AS avg_violent_crime_count FROM final GROUP BY zip""",
        "view_totals": f"""WITH {_PANEL}
            SELECT zip AS zip_code, CAST(sum(pc) AS BIGINT) AS total_property_crime_count,
              round(sum(z), 2) AS total_zhvi_value FROM final GROUP BY zip""",
        "view_seasonality": f"""WITH {_PANEL}
            SELECT CAST(month(m) AS INTEGER) AS month_num, round(avg(pc), 6) AS avg_property_crime_count,
              round(avg(z), 4) AS avg_zhvi_value,
              CASE WHEN month(m) BETWEEN 6 AND 8 THEN TRUE ELSE FALSE END AS peak_season
            FROM final GROUP BY month(m)""",
        "view_lag_effect": f"""WITH {_PANEL},
            monthly AS (SELECT CAST(month(m) AS INTEGER) AS month_num, CAST(sum(pc) AS BIGINT) AS pc, sum(z) AS z
              FROM final WHERE m BETWEEN DATE '2017-01-01' AND DATE '2024-12-01' GROUP BY 1)
            SELECT month_num, pc AS total_property_crime_count, round(z, 2) AS total_zhvi_value,
              round((z - lag(z) OVER (ORDER BY month_num))
                / nullif(abs(lag(z) OVER (ORDER BY month_num)), 0), 6) AS monthly_appreciation_rate
            FROM monthly""",
        "view_rate_base": f"""WITH {_PANEL}
            SELECT zip AS zip_code, y AS year_num, mo AS month_num, pc AS total_property_crime_count,
              pop AS total_population, round(z, 2) AS total_zhvi_value,
              round(pc / nullif(pop / 1000.0, 0), 6) AS property_crime_rate_per_1000 FROM base""",
        "view_appreciation": f"""WITH {_PANEL}
            SELECT zip AS zip_code, y AS year_num, mo AS month_num, pc AS total_property_crime_count,
              pop AS total_population, round(z, 2) AS total_zhvi_value,
              round(pc / nullif(pop / 1000.0, 0), 6) AS property_crime_rate_per_1000,
              round((z - lag(z) OVER w) / nullif(abs(lag(z) OVER w), 0), 6) AS monthly_appreciation_rate
            FROM base WINDOW w AS (PARTITION BY zip ORDER BY y, mo)""",
        "view_slope_compare": _slopes(
            "ZIP_CODE", "crime_type", "crime_rate", "housing_growth_pct", "avg_population", "hypothesis"
        ),
        "slope_table": _slopes(
            "ZIP_CODE", "CRIME_TYPE", "CRIME_RATE", "HOUSING_GROWTH_PCT", "AVG_POPULATION", "HYPOTHESIS"
        ),
        "exclusion_list": f"""WITH {_PANEL},
            cells AS (SELECT {_ZIP} AS zip, {_YEAR} AS y, month({_SHIPPED}) AS mo FROM lineitem
              GROUP BY ALL HAVING min(l_discount) > CAST(0.02 AS DOUBLE))
            SELECT zip AS "ZIP_CODE", m AS "Month_Date", y AS "Year", pc AS "Property_Crime_Count",
              vc AS "Violent_Crime_Count", z AS "ZHVI_Value", pop AS "Population" FROM final f
            WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.zip = f.zip AND c.y = f.y AND c.mo = month(f.m))""",
        "average_growth": """
            WITH steps AS (
              SELECT l_partkey, l_tax, (l_quantity - lag(l_quantity) OVER w)
                / nullif(lag(l_quantity) OVER w, 0) * 100 AS g
              FROM lineitem
              WINDOW w AS (PARTITION BY l_partkey ORDER BY date_trunc('month', l_shipdate), l_quantity))
            SELECT l_partkey, round(avg(g), 6) AS growth, round(avg(l_tax), 6) AS avg_l_tax
            FROM steps GROUP BY l_partkey""",
        "union_measures": """
            SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
            UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
        "source_contract": """
            SELECT count(*) AS rows, count(*) FILTER (l_returnflag = 'N') AS matching_rows,
              bool_or(l_returnflag = 'N') AS accepted FROM lineitem""",
        "source_scores": f"WITH {_HEADERS} {_LONG_SCORES}",
        "classify_sources": f"""WITH {_HEADERS}, long AS ({_LONG_SCORES})
            SELECT kind, file, score FROM long
            QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, file) = 1
              AND score >= CASE kind WHEN 'crime' THEN 5 WHEN 'zillow' THEN 4 ELSE 2 END""",
        "csv_by_name": """
            SELECT l_orderkey AS order_key, l_linenumber AS line, l_quantity AS quantity,
              CASE WHEN l_returnflag = 'R' THEN 'R, "so"' END AS flag FROM lineitem""",
        "csv_multi_line": """
            SELECT l_orderkey AS key, '"' || l_returnflag || CASE WHEN l_quantity > 25
              THEN '",' || chr(13) || chr(10) || chr(10) || '"' ELSE ',' || chr(10) || '"",' END || l_linestatus AS note,
              l_linenumber AS line FROM lineitem
            UNION ALL
            SELECT c_custkey, '"' || c_name || '",' || chr(10) || c_mktsegment, 0 FROM customer""",
        "csv_skip_bad_files": """
            SELECT l_orderkey, l_linenumber, l_quantity AS quantity FROM lineitem WHERE l_linenumber <> 7""",
        "csv_nulls": """
            SELECT CAST(l_orderkey AS VARCHAR) AS "Order_Key", CAST(l_linenumber AS VARCHAR) AS "Line",
              CAST(l_quantity AS VARCHAR) AS "Quantity",
              CASE WHEN l_returnflag = 'R' THEN 'R, "so"' END AS "Flag" FROM lineitem""",
        "infer_types": _probe_sql(),
        "inferred_table": """
            SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS zip,
              '1' || lpad(CAST(l_orderkey AS VARCHAR), 24, '0') AS wide, CAST(l_quantity AS DOUBLE) AS quantity,
              CASE WHEN l_tax > 0.02 THEN CAST(l_tax AS DOUBLE) END AS tax, CAST(l_shipdate AS DATE) AS shipped,
              l_returnflag = 'R' AS returned
            FROM lineitem""",
        "inferred_columns": """
            WITH numbers AS (
              SELECT 'quantity' AS c, CAST(l_quantity AS VARCHAR) AS t FROM lineitem
              UNION ALL SELECT 'tax', CAST(l_tax AS VARCHAR) FROM lineitem WHERE l_tax > 0.02),
            digits AS (
              SELECT c, max(length(ltrim(split_part(t, '.', 1), '0'))) AS b, max(length(split_part(t, '.', 2))) AS a FROM numbers GROUP BY c)
            SELECT c AS "column", 'decimal(' || (b + a) || ',' || a || ')' AS "type" FROM digits
            UNION ALL VALUES ('order_key', 'bigint'), ('line', 'bigint'), ('zip', 'string'), ('wide', 'decimal(25,0)'),
              ('shipped', 'date'), ('returned', 'boolean')""",
    }

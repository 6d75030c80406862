"""Inputs of the library built from star-schema tables, whole tables each time.

Supplier = area, order line = event, ship date (18 years later) = event time, price = value.
Dirty rows come from column values (a discount of 0.1 is an unreadable latitude, and so on).
"""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areapanel import settings
from areapanel.functions import values as v
from areapanel.operators import panel
from areapanel.plans import clean
from areapanel.session import spread, staged

# One event type per line number.
LINE_TYPES = ("BATTERY", "THEFT", "ASSAULT", "BURGLARY", "HOMICIDE", "battery", "ROBBERY")
# One header name per line number.
LINE_COLUMNS = ("ID", "Date", "Primary Type", "Latitude", "Longitude", "zip", "SHAPE_wkt")
#: Steps along the slanted sides of ``slanted_triangles``.
STEPS = 40
SHIPPED = "l_shipdate + make_ym_interval(18, 0)"
BOUNDS = (settings.LONGITUDES, settings.LATITUDES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_line(names):
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber"))


def supplier_area():
    return (F.lit(60600) + F.col("l_suppkey")).cast("string")


def raw_events(spark, folder) -> DataFrame:
    """Events as text. Order keys repeat, so ids do."""
    time = F.expr(f"{SHIPPED} + make_dt_interval(0, 0, cast(l_quantity * 29 as int), 0)")
    date = (
        F.when(F.col("l_tax") == 0.0, F.date_format(time, "yyyy-MM-dd"))
        .when(F.col("l_linestatus") == "F", F.date_format(time, v.EVENT_FORMAT_12H))
        .otherwise(F.date_format(time, v.EVENT_FORMAT_24H))
    )
    latitude = 41.25 + F.col("l_partkey") * 61 % 1024 / 1024
    longitude = -88.125 + (F.col("l_partkey") * 37 + F.col("l_suppkey") * 13 + F.col("l_orderkey") * 7) % 768 / 1024
    return spread(table(spark, folder, "lineitem")).select(
        F.col("l_orderkey").cast("string").alias("ID"),
        date.alias("Date"),
        F.when(F.col("l_quantity") != 13, by_line(LINE_TYPES)).alias("Primary Type"),
        F.when(F.col("l_discount") == 0.1, "abc")
        .when(F.col("l_discount") != 0.09, latitude.cast("string"))
        .alias("Latitude"),
        longitude.cast("string").alias("Longitude"),
    )


def points(spark, folder) -> DataFrame:
    """One point per order line, ids unique, exact binary coordinates inside the window."""
    place = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    used = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return spread(table(spark, folder, "lineitem").select(used)).select(
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.trunc(F.expr(SHIPPED), "month").alias("Month_Date"),
        F.year(F.expr(SHIPPED)).alias("Year"),
        v.two_way_category(by_line(LINE_TYPES), settings.VIOLENT_TYPES, settings.CATEGORIES).alias(
            "Crime_Category"
        ),
        (-88.0 + (place * 37 + F.col("l_partkey")) % 513 / 1024).alias("x"),
        (41.5 + (place * 61 + F.col("l_suppkey")) % 615 / 1024).alias("y"),
    )


def _ring(*corners) -> F.Column:
    pairs = [F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in corners]
    return F.concat(F.lit("("), F.concat_ws(", ", *pairs), F.lit(")"))


def diamond(cx, cy, r):
    east, north, west, south = (cx + r, cy), (cx, cy + r), (cx - r, cy), (cx, cy - r)
    return _ring(east, north, west, south, east)


def nation_areas(spark, folder) -> DataFrame:
    """Raw areas: per nation a diamond with a diamond hole and a second, smaller diamond."""
    cx = -87.96875 + F.col("n_nationkey") % 5 * 0.09375
    cy = 41.5625 + F.floor(F.col("n_nationkey") / 5) * 0.109375
    text = F.concat(
        F.lit("MULTIPOLYGON (("),
        diamond(cx, cy, 0.09375),
        F.lit(", "),
        diamond(cx, cy, 0.015625),
        F.lit("), ("),
        diamond(cx + 0.1875, cy, 0.03125),
        F.lit("))"),
    )
    return table(spark, folder, "nation").select(
        (F.lit(60600) + F.col("n_nationkey")).cast("string").alias("ZIP"), text.alias("the_geom")
    )


def customer_areas(spark, folder) -> DataFrame:
    """Raw areas, one per customer: the market segment decides the shape, some shapes are faulty.

    Every fifth row comes twice, and furniture is written with 70 more digits.
    """
    cx = -88.0 + F.col("c_custkey") % 4096 / 8192
    cy = 41.5 + F.floor(F.col("c_custkey") / 4096) % 4096 / 8192
    r, small = 0.0078125, 0.001953125
    open_ring = _ring((cx + r, cy), (cx, cy + r), (cx - r, cy), (cx, cy - r))
    bow_tie = _ring((cx, cy), (cx + r, cy + r), (cx + r, cy), (cx, cy + r + r), (cx, cy))
    shapes = table(spark, folder, "customer").select(
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        "c_mktsegment",
        diamond(cx, cy, r).alias("outer"),
        diamond(cx, cy, small).alias("hole"),
        diamond(cx + 1, cy, small).alias("far"),
        open_ring.alias("open_ring"),
        bow_tie.alias("bow_tie"),
    )

    def polygon(*rings):
        return F.concat(F.lit("POLYGON ("), F.concat_ws(", ", *rings), F.lit(")"))

    segment = F.col("c_mktsegment")
    text = (
        F.when(F.col("c_nationkey") == 7, F.lit("POINT (1 1)"))
        .when((segment == "BUILDING") & (F.col("c_acctbal") < 0), polygon("outer", "far"))
        .when(segment == "BUILDING", polygon("outer", "hole"))
        .when(segment == "MACHINERY", polygon("bow_tie"))
        .when(segment == "HOUSEHOLD", polygon("open_ring"))
        .when(
            segment == "AUTOMOBILE",
            F.concat(F.lit("multipolygon(("), "outer", F.lit("),("), "far", F.lit("))")),
        )
        .when(segment == "FURNITURE", F.regexp_replace(polygon("outer"), r"(\.\d+)", f"$1{'0' * 70}"))
        .otherwise(polygon("outer"))
    )
    times = F.when(F.col("c_custkey") % 5 == 0, 2).otherwise(1)
    raw = shapes.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(
        F.col("c_custkey").cast("string").alias("ZIP"),
        F.lit("12.5").alias("SHAPE_AREA"),
        F.when(F.col("c_nationkey") != 3, text).alias("the_geom"),
    )
    return staged(raw, "raw-areas")


def price_sum():
    return F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))


def month_labels(spark, folder) -> dict[str, str]:
    """Wide column names by month, over all years of the table, in both accepted forms."""
    first, last = table(spark, folder, "lineitem").agg(
        F.min(F.year(F.expr(SHIPPED))), F.max(F.year(F.expr(SHIPPED)))
    ).first()
    months = [dt.date(y, m, 1) for y in range(first or 2014, (last or 2014) + 1) for m in range(1, 13)]
    return {d.isoformat(): d.isoformat() if d.month % 2 else d.strftime("%m/28/%Y") for d in months}


def wide_values(spark, folder) -> DataFrame:
    """One text column per month and one row per supplier; thin months hold bad text."""
    lines = F.count(F.lit(1))
    text = (
        F.when(lines == 1, "NaN")
        .when(lines == 2, F.concat(F.lit("-"), price_sum().cast("string")))
        .when(lines == 3, "n/a")
        .otherwise(price_sum().cast("string"))
    )
    labels = month_labels(spark, folder)
    monthly = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.trunc(F.expr(SHIPPED), "month").cast("string").alias("month"))
        .agg(text.alias("text"))
        .groupBy("l_suppkey")
        .pivot("month", list(labels))
        .agg(F.first("text"))
    )
    supplier = table(spark, folder, "supplier")
    here = F.col("s_acctbal") >= 0
    return monthly.join(supplier, monthly["l_suppkey"] == supplier["s_suppkey"]).select(
        supplier_area().alias("RegionName"),
        F.lit("zip").alias("RegionType"),
        F.when(here, "IL").otherwise("WI").alias("State"),
        F.when(F.col("s_nationkey") != 11, "Chicago").otherwise("chicago").alias("City"),
        *[F.col(month).alias(label) for month, label in labels.items()],
    )


def counts(spark, folder) -> DataFrame:
    """Order lines per supplier and month, by category."""
    lines = table(spark, folder, "lineitem")
    category = v.two_way_category(by_line(LINE_TYPES), settings.VIOLENT_TYPES, settings.CATEGORIES)
    return panel.aggregate_categories(
        lines.select(
            supplier_area().alias("ZIP_Code"),
            F.trunc(F.expr(SHIPPED), "month").alias("Month_Date"),
            F.year(F.expr(SHIPPED)).alias("Year"),
            category.alias("Crime_Category"),
        )
    )


def values(spark, folder) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(supplier_area().alias("ZIP_Code"), F.trunc(F.expr(SHIPPED), "month").alias("Month_Date"))
        .agg(price_sum().cast("double").alias("ZHVI_Value"))
    )


def people(spark, folder) -> DataFrame:
    """Lines without tax are nobody, so an area and year may have no one at all."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(supplier_area().alias("ZIP_Code"), F.year(F.expr(SHIPPED)).alias("Year"))
        .agg(F.sum(F.when(F.col("l_tax") > 0.01, F.col("l_quantity"))).alias("Population"))
    )


def analytical(spark, folder) -> DataFrame:
    return panel.merge_master(counts(spark, folder), values(spark, folder))


def final(spark, folder) -> DataFrame:
    return panel.build_final(analytical(spark, folder), people(spark, folder))


def _yearly_people(spark, folder) -> DataFrame:
    """Per area and year the cells of a response row: id, name, count as text (some are unreadable)."""
    yearly = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey"), F.year(F.expr(SHIPPED)).alias("year"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))
    )
    area = supplier_area()
    count = F.when(F.col("n") % 5 == 0, "N/A").when(F.col("n") % 7 != 0, F.col("q").cast("string"))
    name = F.concat(F.lit(settings.POPULATION_NAME_PREFIX), area)
    return yearly.select("year", "n", area.alias("area"), name.alias("name"), count.alias("count"))


def _head():
    return F.array(F.lit("NAME"), F.lit(settings.POPULATION_COLUMN), F.lit("zip code tabulation area"))


def responses(spark, folder) -> DataFrame:
    """(year, body): one JSON response per area and year; column order and dirt vary."""
    row = F.array("name", "count", "area")
    plain = F.array(_head(), row)
    turned = F.array(F.reverse(_head()), F.reverse(row))
    body = F.when(F.col("n") % 11 == 0, F.lit("<html>busy</html>")).otherwise(
        F.to_json(F.when(F.col("year") % 2 == 0, plain).otherwise(turned))
    )
    return _yearly_people(spark, folder).select("year", body.alias("body"))


def land_yearly_documents(spark, folder, path, areas=1 << 20) -> str:
    """Responses below ``path`` in files such as ``20250105 acs_2014 part 0.json``: per year one document for every
    ``areas`` numbers of areas, rows in order, written row by row.
    """
    rows = _yearly_people(spark, folder).withColumn("part", F.floor(F.col("area").cast("bigint") / areas))
    order = Window.partitionBy("year", "part").orderBy("area")
    row = F.to_json(F.array("name", "count", "area"))
    head = F.concat(F.lit("["), F.to_json(_head()), F.lit(",\n"))
    begin = F.when(F.lag("area").over(order).isNull(), head).otherwise("")
    end = F.when(F.lead("area").over(order).isNull(), "]").otherwise(",")
    lines = rows.select("year", "part", "area", F.concat(begin, row, end).alias("value"))
    lines = lines.sortWithinPartitions("year", "part", "area")
    lines.select("value", "year", "part").write.partitionBy("year", "part").text(f"{path}/parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(root, "landed"))
    for file in files.globStatus(hadoop.Path(root, "parts/year=*/part=*/part-*")):
        part = file.getPath().getParent()
        year = part.getParent().getName().rpartition("=")[2]
        files.rename(file.getPath(), hadoop.Path(root, f"landed/20250105 acs_{year} {part.getName().replace('=', ' ')}.json"))
    return f"{path}/landed"


def header_rows(spark, folder) -> DataFrame:
    """(file, column): every order is a file, its lines are header names."""
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("order-"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit(".csv")).alias("file"),
        by_line(LINE_COLUMNS).alias("column"),
    )


def cleaned_nation_areas(spark, folder) -> DataFrame:
    return staged(clean.clean_boundaries(nation_areas(spark, folder)), "areas")


def slanted_triangles(spark, folder) -> DataFrame:
    """One triangle per supplier whose corners are whole thousandths, so no corner but few is a binary fraction.

    Its first side runs ``STEPS`` steps of (1 + k % 17, 3 + k % 23) thousandths, its second is the first turned by a
    right angle.
    """
    k = F.col("s_suppkey")
    x, y, dx, dy = 2000 + k * 7919 % 90000, 2000 + k * 104729 % 90000, 1 + k % 17, 3 + k % 23
    at = lambda px, py: F.concat_ws(" ", (px / 1000.0).cast("string"), (py / 1000.0).cast("string"))
    corners = [at(x, y), at(x + STEPS * dx, y + STEPS * dy), at(x + STEPS * dy, y - STEPS * dx), at(x, y)]
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corners), F.lit("))"))
    return spread(table(spark, folder, "supplier")).select(k.cast("string").alias("ZIP"), wkt.alias("the_geom"))


def points_on_sides(spark, folder) -> DataFrame:
    """One point per order line on, or a thousandth beside, a slanted side of its supplier's triangle."""
    k, j, turned = F.col("l_suppkey"), (F.col("l_orderkey") + F.col("l_linenumber")) % (STEPS + 2), F.col("l_partkey") % 2 == 0
    x, y, dx, dy = 2000 + k * 7919 % 90000, 2000 + k * 104729 % 90000, 1 + k % 17, 3 + k % 23
    beside = F.when(F.col("l_partkey") % 5 == 0, F.col("l_partkey") % 3 - 1).otherwise(0)
    px = F.when(turned, x + j * dy).otherwise(x + j * dx) + beside
    py = F.when(turned, y - j * dx).otherwise(y + j * dy)
    return spread(table(spark, folder, "lineitem")).select(
        "l_orderkey", "l_linenumber", (px / 1000.0).alias("x"), (py / 1000.0).alias("y")
    )

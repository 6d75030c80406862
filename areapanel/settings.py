"""Default parameters. Every operator takes them as arguments; nothing reads them at run time."""

import datetime as dt

# The analysis window, the accepted coordinate range and the category list.
YEARS = (2014, 2024)
LATITUDES = (41.5, 42.1)
LONGITUDES = (-88.0, -87.5)
VIOLENT_TYPES = (
    "BATTERY",
    "ASSAULT",
    "HOMICIDE",
    "ROBBERY",
    "CRIM SEXUAL ASSAULT",
    "KIDNAPPING",
    "SEX OFFENSE",
)
CATEGORIES = ("Violent", "Property")
REGION = {"State": "IL", "City": "Chicago"}
PEAK_MONTHS = (6, 8)
LAG_RANGE = (dt.date(2017, 1, 1), dt.date(2024, 12, 1))
EXCLUDED_MONTHS = (
    ("60602", 2021, 7),
    ("60602", 2022, 7),
    ("60602", 2017, 8),
    ("60602", 2019, 8),
)
NULL_TOKENS = ("", "NULL", "null")
POPULATION_COLUMN = "B01003_001E"
POPULATION_NAME_PREFIX = "ZCTA5 "
HYPOTHESIS = "H1"
GEOMETRY_COLUMN = "the_geom"

# Own tuning values of the spatial join.
GRID = 200  # cells per coordinate unit
MAX_CELLS = 65_536  # per area; a larger area moves to a coarser grid
ALL_CELLS = 1 << 20  # of all areas together; beyond it cells follow edges
EDGE_CELLS = 64  # per edge of an area, then
BROADCAST_BYTES = 128 << 20
HOT_ROWS = 1_000_000  # points of a cell that go to one task of a shuffled join

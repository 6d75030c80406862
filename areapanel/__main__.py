"""``python -m areapanel <root> <out> [events] [values] [areas]``: run everything below one root."""

import sys

from areapanel.plans.pipeline import Paths, run
from areapanel.session import build_session


def main(args):
    if len(args) < 2:
        sys.exit(__doc__)
    root, out, *names = args
    given = dict(zip(("events", "values", "areas"), names))
    spark = build_session()
    try:
        for name, rows in run(spark, Paths.under(root, **given), out).counts.items():
            print(f"{name}: {rows} rows")
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])

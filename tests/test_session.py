"""The shared working folder."""

import os
import subprocess
import sys
import time
from pathlib import Path

from areapanel import session

SCRIPT = """
from areapanel.session import build_session, staged
spark = build_session("local[2]", "leftovers", **{"spark.ui.enabled": "false", "spark.checkpoint.dir": %r})
table = staged(spark.range(10), "ten")
assert table.count() == 10
"""


def test_nothing_is_left_behind(tmp_path):
    root = str(Path(session.__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", SCRIPT % str(tmp_path)], cwd=root, env=os.environ, capture_output=True, timeout=120)
    assert done.returncode == 0, done.stderr.decode()[-2000:]
    for _ in range(50):  # the JVM ends a little later than Python
        if not list(tmp_path.glob("areapanel-*")):
            break
        time.sleep(0.2)
    assert list(tmp_path.glob("areapanel-*")) == []


def test_release(spark):
    path = Path(session.new_stage(spark, "x")).parent
    session.staged(spark.range(3), "three").count()
    assert list(path.iterdir())
    kept = dict(session._OWNED)
    session._OWNED[spark.sparkContext.applicationId] = str(path) + "-other"
    Path(str(path) + "-other").mkdir()
    session.release(spark)
    assert not Path(str(path) + "-other").exists()
    session._OWNED.update(kept)
    assert list(path.iterdir())

"""Session defaults and the shared working folder."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "areapanel", **conf) -> SparkSession:
    """A session with the settings the library is written for; ``conf`` adds or overrides."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Recording the caller of every column expression costs more than building the plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local-mode session may go without the setting; it then gets a fresh temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="areapanel-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


_OWNED = {}


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the driver's JVM ends."""
    key = spark.sparkContext.applicationId
    if key not in _OWNED:
        path = f"{shared_folder(spark).rstrip('/')}/areapanel-{key}-{uuid.uuid4().hex[:8]}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _OWNED[key] = path
    return _OWNED[key]


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables now; frames that read them are of no use then."""
    path = _OWNED.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)


_STEPS = {}
_TARGET = []


@contextmanager
def step_folder(spark: SparkSession, chain: str):
    """Intermediate tables made inside go to a folder of their own, which the next step of the same
    ``chain`` deletes when it begins. For chains whose steps write their result before the next begins.
    """
    key = (spark.sparkContext.applicationId, chain)
    if key in _STEPS:
        _delete(spark, _STEPS.pop(key))
    _STEPS[key] = f"{run_folder(spark)}/{chain}-{uuid.uuid4().hex}"
    _TARGET.append(_STEPS[key])
    try:
        yield
    finally:
        _TARGET.pop()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_stage(spark: SparkSession, name: str) -> str:
    """A path for one intermediate table below the run's or the step's folder; never reused."""
    return f"{_TARGET[-1] if _TARGET else run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df, name: str, partition_by=()):
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives executor loss."""
    path = new_stage(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """Deal out a scan that has fewer splits than the cluster has cores (one small or unsplittable
    file). Larger scans are returned as they are, so they are never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

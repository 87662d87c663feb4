"""Lineage cuts and small, size-checked hand-overs between jobs."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT = {}
_MEMO = {}
_CUTS = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A session on ``local[...]`` runs in one process, so there a temporary folder may stand in, as in tests. On a
    cluster a folder of one machine would lose rows silently; a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_ROOT[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a cached block the files outlive lost executors, and unlike a raw checkpoint they stay
    columnar, so later jobs prune columns and push filters into them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/wordframe-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, key: tuple, build) -> DataFrame:
    """``cut(build())`` once per application and key, for tables that several queries read."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _MEMO:
        _MEMO[full] = cut(build())
    return _MEMO[full]


def remember(spark: SparkSession, key: tuple, build):
    """Keep a small driver-side result (moments, coefficients, selections) per application and key."""
    full = (spark.sparkContext.applicationId, "object", *key)
    if full not in _MEMO:
        _MEMO[full] = build()
    return _MEMO[full]


def forget() -> None:
    """Drop everything remembered, so that the next query starts from the tables; call it when a table changed."""
    _MEMO.clear()


def release(spark: SparkSession) -> int:
    """Delete the cuts that this application has written, on whatever file system they lie; results must be stored before."""
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    forget()
    return len(paths)

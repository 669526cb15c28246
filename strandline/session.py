"""Session defaults, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session to every operator."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandline")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return reach_workers(b.getOrCreate())


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers that see the same file system import this package; elsewhere ship it with ``--py-files``."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    # workers live as long as their executor: what a batch took is given back, not kept in pools
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Before costly Python work: deal the rows of an input of fewer blocks than cores to all cores.

    An input of as many blocks or more, which any large one is, stays where it was read: its rows are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    if run.executedPlan().nodeName() == "AdaptiveSparkPlan":  # adaptive execution cuts what a shuffle gives into parts of 64 MB
        small = int(run.optimizedPlan().stats().sizeInBytes()) < cores * (64 << 20)
    else:
        small = run.toRdd().getNumPartitions() < cores
    return df.repartition(cores) if small else df


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; only on one machine, where that is unset, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root[len("file://") :], ignore_errors=True)
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared scratch folder and read it back.

    The copy survives lost executors, is columnar and compressed, and is removed by :func:`release` or at exit.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/strandline/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def release(*dfs: DataFrame | None) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_strandline_path", None)
        if path in _written:
            _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    if path.startswith("file:"):
        shutil.rmtree(os.path.normpath(path[len("file:") :].replace("//", "/", 1)), ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(path, spark)
        except Exception:  # the JVM is already gone
            pass
    _written.clear()

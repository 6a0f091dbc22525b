"""Session helpers: one place for the configuration the library relies on."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the library depends on. A cluster session normally sets these in
# spark-defaults; `get_spark` only fills the ones that are missing.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed survivor tables are removed once no plan references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "dualspace") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("DUALSPACE_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session names none (local tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="dualspace-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = "4m"  # for kernels over rows of megabytes: a task holds a batch several times


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession, batch: str | None = None):
    """What is run inside gives its shuffle files back when it ends, not when the driver happens to collect its garbage.
    `batch`: bytes of a batch that goes to a Python worker."""
    conf = {_FREE_SHUFFLES: "true"} | ({} if batch is None else {_BATCH_BYTES: batch})
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there, so a lost executor
    costs a re-read. Unlike `checkpoint()`, which runs its plan twice, this runs it once
    and leaves columns that later plans can prune."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, keys: list[str], name: str) -> str:
    """Write `df` once, bucketed and sorted by `keys`, into the shared folder and return its name in the catalog: joins
    on all the keys read it where it lies. Drop the name after use (the files stay with the others there)."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"dualspace_{name}_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        (df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
         .option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").format("parquet").saveAsTable(name))
    return name


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the Python workers, once per application.

    Workers import the modules that hold the Arrow kernels. Where the package
    is only on the driver's path, Spark's file server hands it out as a zip."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="dualspace-pkg-")), "dualspace_pkg.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith((".py", ".txt", ".json"))):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("dualspace", os.path.relpath(full, root)))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)

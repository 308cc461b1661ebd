"""Session helpers: ship the package to executors, find the shared folder, cut lineage."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 2500
ARROW_BYTES = 8 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_HERE = os.path.dirname(os.path.abspath(__file__))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark's own Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Rows of texts are large: Arrow batches get ARROW_ROWS rows at most where the session has Spark's default of 10,000, and
    ARROW_BYTES at most where it has the default of 64 MB. This holds for the session from then on, since plans are run
    later than they are made; values that the caller has set stay.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(ARROW_ROWS))
    if spark.conf.get(_BYTES) in ("64MB", "67108864", "67108864b"):
        spark.conf.set(_BYTES, str(ARROW_BYTES))
    if getattr(sc, "_docquarry_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="docquarry-")
    target = os.path.join(folder, "docquarry_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(_HERE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("docquarry", os.path.relpath(full, _HERE)))
    sc.addPyFile(target)
    sc._docquarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset.

    Only a local master may leave it unset; executors on other machines couldn't see a folder of the driver's.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_docquarry_dir", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="docquarry-shared-")
            spark.sparkContext._docquarry_dir = root
    return root.rstrip("/")


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once to the shared folder and read it back; survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docquarry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    held = getattr(spark.sparkContext, "_docquarry_stashes", None)
    if held is None:
        held = spark.sparkContext._docquarry_stashes = []
    held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """The files that df reads, with their sizes and times: another fingerprint means other contents."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    said = []
    for name in sorted(df.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(name)
        status = p.getFileSystem(conf).getFileStatus(p)
        said.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha1("\n".join(said).encode()).hexdigest()


def stored(spark: SparkSession, key: str, make) -> DataFrame:
    """The table that make() gives, written to the shared folder once an application; later calls with the key read it."""
    held = getattr(spark.sparkContext, "_docquarry_stored", None)
    if held is None:
        held = spark.sparkContext._docquarry_stored = {}
    if key not in held:
        df = make()
        path = f"{shared_dir(spark)}/docquarry/{spark.sparkContext.applicationId}/stored-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        held[key] = path, df.schema
    path, schema = held[key]
    return spark.read.schema(schema).parquet(path)


def stash_mark(spark: SparkSession) -> int:
    """How many stashes there are; give it to sweep() to remove only later ones."""
    return len(getattr(spark.sparkContext, "_docquarry_stashes", []))


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Delete stashes once nothing will read them any more (after a final write)."""
    held = getattr(spark.sparkContext, "_docquarry_stashes", [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in held[since:]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del held[since:]


def spread(df: DataFrame) -> DataFrame:
    """df itself, or dealt out anew where it comes from fewer files than there are cores (one file may be one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

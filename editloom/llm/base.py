"""Session helpers: shipping this package to executors, and tables in the shared folder.

Lineage is cut with Parquet tables under ``spark.checkpoint.dir`` (never with local
checkpoints), so a lost executor costs a task, not the job.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows up to which Spark may broadcast a stored table.
BROADCAST = 8 << 20
_shipped: set[str] = set()
_own_root: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="loom-code-"), "editloom_llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder in (package, os.path.join(package, "llm")):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, top))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on one machine an own one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="spark-loom-"))
    return _own_root[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/loom/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row: int, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join: Spark may broadcast it where its rows (counted if not told), of about ``row`` bytes in memory, are few, and
    must merge it beyond. Spark goes by the size of a stored table's files, which is far below that of its rows, and below
    that of lists: their share of a table counts as one entry's, and what an explode makes of them as well."""
    return df.hint("merge") if (df.count() if rows is None else rows) * row > BROADCAST else df


def drop(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def width(spark: SparkSession) -> int:
    """Shuffle width for explicit partitionings: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows and bytes of one Arrow batch on its way to a Python worker: bounds a worker's memory.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
#: A class is heavy if it holds more than one row in so many; there are fewer heavy classes than this.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Sends the code to the workers, and lowers this session's Arrow batch limits to ours; a smaller limit of the user's stays."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(\d+)[bB]?", str(spark.conf.get(name)))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a temporary one of our own if the master is local, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they and the driver share")
        root = "file://" + tempfile.mkdtemp(prefix="opticframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Tables of each application that are not deleted yet.
_TABLES: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _TABLES[spark.sparkContext.applicationId].remove(path)


def saved(spark: SparkSession) -> list[str]:
    """Paths of the tables that operators have written and not deleted, the oldest first."""
    return list(_TABLES.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables that operators have written (by default all of this application): call it once their results are used up."""
    for path in saved(spark) if paths is None else paths:
        _delete(spark, path)


class Scratch:
    """Tables of one operator's run, written under the shared folder so that a lost executor costs no recomputation.

    A result that is not yet written reads them, so an operator leaves some behind: see ``release``.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.path, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:04d}"
        _TABLES.setdefault(self.spark.sparkContext.applicationId, []).append(path)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that ``save`` returned."""
        release(self.spark, [t.scratch_path for t in tables])


def attach(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with their class's columns, even where one class holds a large part of all rows.

    key: a binary (16 bytes) or long column of both, unique in classes.  Classes with more than
    total/HEAVY rows are fewer than HEAVY and so can be broadcast; their rows then go through the
    shuffled join of the rest under a hash of the row's number, which spreads them evenly, equal ones too (if
    it should meet a class, what the broadcast gave still holds).
    """
    cols = [c for c in classes.columns if c not in (key, size)]
    heavy = classes.where(F.col(size) * F.lit(HEAVY) > F.lit(total)).select(F.col(key), F.struct(*cols).alias("_heavy"))
    light = classes.where(F.col(size) * F.lit(HEAVY) <= F.lit(total)).select(F.col(key).alias("_key"), F.struct(*cols).alias("_light"))
    hashed = F.xxhash64(F.monotonically_increasing_id(), F.lit(7))
    spread = F.unhex(F.lpad(F.hex(hashed), 16, "0")) if rows.schema[key].dataType.typeName() == "binary" else hashed
    met = rows.withColumn("_spread", spread).join(F.broadcast(heavy), key, "left").withColumn("_key", F.when(F.col("_heavy").isNull(), F.col(key)).otherwise(F.col("_spread")))
    both = met.join(light, "_key", "left")
    return both.select(*rows.columns, *[F.coalesce(F.col(f"_heavy.{c}"), F.col(f"_light.{c}")).alias(c) for c in cols])


def crc32_of(col: Column) -> Column:
    """Unsigned CRC-32 of a column's text form."""
    return F.crc32(col.cast("string").cast("binary"))

"""What the operators share: the scratch folder, skew-safe look-ups and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A key with more than 1/HOT_PARTS of the rows is hot, so there are fewer than HOT_PARTS hot keys: they may be broadcast.
HOT_PARTS = 1024
#: Salts over which the rows of hot keys are dealt.
SALTS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input, through Spark's reader only; Arrow batches are kept small, as a text may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, in local mode only, a new one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: it cuts the lineage and survives lost executors."""
    return Scratch(df.sparkSession).written(df, name)


class Scratch:
    """Tables of one job in the shared folder; clear() removes them once what is made of them is written elsewhere."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/millrace/{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def other_columns(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but those that a result column of one of these names replaces, in whatever case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def own_name(*frames: DataFrame) -> str:
    """A beginning for internal columns that no column of the frames has."""
    name = "_m"
    while any(c.lower().startswith(name) for f in frames for c in f.columns):
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def lookup(rows: DataFrame, classes: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows left-joined with classes (unique on keys, which are never null); weight is a class's number of rows among total.

    Hot classes, fewer than HOT_PARTS by their weight, are broadcast; the rows that they serve are dealt over salts in
    the shuffled join, where they match nothing.
    """
    own = own_name(rows, classes)
    payload = [c for c in classes.columns if c not in keys]
    hot = classes.where(F.col(weight) * HOT_PARTS > total).select(*keys, *(F.col(c).alias(f"{own}hot_{c}") for c in payload), F.lit(True).alias(f"{own}hot"))
    cold = classes.where(F.col(weight) * HOT_PARTS <= total).select(*keys, *(F.col(c).alias(f"{own}{c}") for c in payload), F.lit(0).alias(f"{own}salt"))
    salt = F.when(F.col(f"{own}hot"), 1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    joined = rows.join(F.broadcast(hot), keys, "left").withColumn(f"{own}salt", salt).join(cold, [*keys, f"{own}salt"], "left")
    return joined.select(*rows.columns, *(F.when(F.col(f"{own}hot"), F.col(f"{own}hot_{c}")).otherwise(F.col(f"{own}{c}")).alias(c) for c in payload))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component_id) of every end a or b of an edge but the components' smallest ends, which have no row.

    Every node hooks to its smallest smaller neighbour, pointers are jumped to the roots and the edges are contracted,
    until none is left.  Nothing is gathered on the driver; each step is written to the shared folder.
    """
    written = scratch.written
    left = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        parent = written(left.groupBy("hi").agg(F.min("lo").alias("lo")), "parents")
        while True:
            up = parent.select(F.col("hi").alias("lo"), F.col("lo").alias("above"))
            jumped = written(parent.join(up, "lo", "left").select("hi", F.coalesce("above", "lo").alias("lo"), F.col("above").isNotNull().alias("moved")), "parents")
            parent = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        root = parent.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        if labels is None:
            labels = parent.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
        else:
            moved = labels.join(root, F.col("component_id") == F.col("node"), "left").select("id", F.coalesce("root", "component_id").alias("component_id"))
            labels = written(moved.union(root), "labels")
        for end in ("hi", "lo"):
            left = left.join(root, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("root", end)).drop("node", "root")
        left = written(left.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    return labels if labels is not None else left.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))

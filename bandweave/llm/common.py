"""What the corpus operators share: the folder for cut lineage, batch sizes for Python stages, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches end at this size, so that a batch of very long texts stays small.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and the session is local, a temporary folder of this machine stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="bandweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/bandweave-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are deleted when the block ends, except those that are kept because a result reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame) -> DataFrame:
        """As materialize, for this block only."""
        path = shared_dir(self.spark)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame) -> DataFrame:
        return materialize(df)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        jvm = self.spark._jvm
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Caps the bytes of an Arrow batch at BATCH_BYTES, from now on in this session: plans are run after the operator returns."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name, one like it that is no column of df (names compare without case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def connected_components(edges: DataFrame, max_rounds: int = 60, into: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of edges (u, v), both bigint; root is the smallest node reachable.

    Large-star and small-star rounds, until every node has one edge and that leads to a root: each is one grouped minimum
    and one join on the same key, so that a hub's rows can be split by the skew join, and nothing is collected. Self loops
    and repeats are allowed. The result is a table, of into if that is given.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        edges = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        for _ in range(max_rounds):
            again = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
            inner = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
            if again.unionByName(inner).isEmpty():
                break
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = scratch.table(large.where("u <> v").distinct())
            low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(low, "u")
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
            edges = scratch.table(small.where("u <> v").distinct())
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        roots = roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return materialize(roots) if into is None else into.table(roots)

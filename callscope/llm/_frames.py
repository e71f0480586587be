"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

import atexit
import gc
import os
import uuid

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master gets one of its own where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/spark-checkpoints-{os.getuid()}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame, release: bool = False) -> DataFrame:
    """Writes the rows in the shared folder and reads them back: cuts lineage and runs the work once.

    With release, what finished steps shuffled is let go, before and after: Spark deletes those files when the driver's collector finds
    their plan unused, which on a large driver heap would be long after the disks are full. For the steps that shuffle much.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if release:
        let_go(spark)  # of the step before, whose plan was still in use by Spark's listeners when it ended
    out = df.checkpoint(eager=True)
    if release:
        del df  # its plan holds the shuffles
        let_go(spark)
    return out


def let_go(spark: SparkSession) -> None:
    """Collects the garbage of the driver's Python and JVM: plans of finished steps, their generated classes and shuffled files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch() named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_when_written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back: as kept(), but columns can be read one by one.

    The folder goes when the driver's Python ends, as the rows may be read until then.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    atexit.register(_remove_at_end, spark, path)
    return spark.read.parquet(path)


def _remove_at_end(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have been stopped; a folder left behind does no harm
        return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def splittable(df: DataFrame, key: str) -> DataFrame:
    """The same rows, dealt by a hash of the key: a join on the key then shuffles them once more, so that Spark can split a hot key's partition.

    A grouped side would lend the join its own partitioning, which ties all rows of a key to one task.
    """
    return df.repartition(F.xxhash64(key))


def grouped(df: DataFrame, key: str) -> GroupedData:
    """groupBy(key) for the side of a join on the key that the other side's hot keys must be split from, as by splittable() but with a shuffle less.

    The key's hash is grouped by, too, so the rows are dealt by both, and a join on the key shuffles the groups (not the rows) once more.
    """
    return df.groupBy(key, F.xxhash64(key).alias(_free("dealt", df.columns)))


#: Bits of a sieve; its bitmap has a row for each 64 of them, 262,144 rows at most.
SIEVE_BITS = 1 << 24


def sieved(df: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among `ids`, rows whose key surely is not), so that only the first need a shuffle to meet them.

    Tells by a bitmap of hashes, broadcast and of bounded size whatever the number of ids: with n of them a share of at most
    n / SIEVE_BITS of the other rows is in the first part, too; with far more ids than bits nearly all are. Null keys are in the second part.
    """
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    word, bits, bit = (_free(name, df.columns) for name in ("sieve_word", "sieve_bits", "sieve_bit"))
    place = ids.select(F.shiftright(at, 6).alias(word), at.bitwiseAND(F.lit(63)).cast("int").alias(bit))
    words = F.broadcast(kept(place.groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias(bits))))
    met = df.withColumns({word: F.when(F.col(key).isNotNull(), F.shiftright(at, 6)), bit: at.bitwiseAND(F.lit(63)).cast("int")}).join(words, word, "left")
    may = F.coalesce(F.expr(f"(shiftrightunsigned({bits}, {bit}) & 1L) = 1L"), F.lit(False))
    return met.where(may).select(df.columns), met.where(~may).select(df.columns)


def _free(name: str, taken: list[str]) -> str:
    """The name, or the first longer one that no column has."""
    while name in taken:
        name += "_"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list with long ids: (id, component), component being the smallest id.

    Alternates the large-star and small-star steps until only stars are left: each replaces a node's links by links to the least
    node of its neighbourhood. Both are a grouped minimum (combined before the shuffle) and a join, which Spark can split at a
    hot node: the least of a star in the first step, in the second one whose id is the largest of its star. Nodes without an edge are not returned; self links are ignored.
    """
    now = kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _only_stars(now):
        # links go from the larger to the smaller node, so a node's least neighbour is among its own links or the node itself
        least = grouped(now, "u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))  # as many rows as links; repeats go below
        small = large.join(grouped(large, "u").agg(F.min("v").alias("m")).select("u", "m"), "u")
        nxt = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = kept(nxt.where("u <> v").distinct())
        del least, large, small, nxt
        let_go(now.sparkSession)  # a few plans a step, which would add up on the driver
    ends = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))
    return now.select(F.explode(ends).alias("e")).select("e.*").distinct()


def _only_stars(links: DataFrame) -> bool:
    """Whether each larger end of these different links is in one link only, and no smaller end is another link's larger one."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    odd = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups > 0 and least = 0")
    return odd.agg(F.count(F.lit(1))).first()[0] == 0

"""Session, shared scratch space and the skew helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Copies of the small side per key in a salted join.
SALTS = 8
#: A key is hot if it has more rows than this and than its share of all rows.
HOT_ROWS = 100_000
HOT_SHARE = 256


def local_session(name: str = "quillspark", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's session is used."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``.

    Only where the cluster names none (tests, a laptop) a temporary folder of
    this machine is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext.getCheckpointDir()
        named = known or "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets several branches
    read one result without computing it again.  The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for df in written:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quillspark/" in folder:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(conf).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def salted_join(big: DataFrame, unique: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join whose hot keys on the ``big`` side are spread over ``salts`` tasks.

    ``unique`` has one row per key and is copied ``salts`` times; ``spread`` is
    an expression over ``big`` (its row id, say) that parts the rows of one key.
    Nulls in ``on`` match nothing, as in any equi-join.
    """
    salt = "__salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = unique.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, salt], how).drop(salt)


#: Rows of a narrow table that are broadcast at most, after counting them.
BROADCAST_ROWS = 50_000


def counted_join(big: DataFrame, unique: DataFrame, on: list[str], spread: Column, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join with a table of one narrow row per key: broadcast if it counts at most ``most`` rows, else salted.

    ``unique`` is counted here, so it should be small or written.
    """
    if unique.limit(most + 1).count() <= most:
        return big.join(F.broadcast(unique), on, how)
    return salted_join(big, unique, on, spread, how)


def hot_keys(df: DataFrame, on: list[str], *, rows: int = HOT_ROWS) -> DataFrame:
    """The keys of more than ``rows`` rows and more than one in ``HOT_SHARE`` of all rows, nulls aside.

    At most ``HOT_SHARE`` rows whatever the data, so the result may be
    broadcast.  Costs a scan of the key columns, aggregated before it is shuffled.
    """
    n = df.count()
    least = max(rows, n // HOT_SHARE)
    if n <= least:  # no key can have more rows than all
        return df.select(*on).limit(0)
    counts = df.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > least).select(*on)


def skewed_join(big: DataFrame, unique: DataFrame, on: list[str], spread: Column, how: str = "inner", *, counted: DataFrame | None = None, rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Equi-join of which only the hot keys of ``big`` are salted, so that ``unique`` (one row per key) is not copied for the others.

    The keys are counted here, on ``counted`` or else on ``big``, which should be a written table.
    """
    hot = hot_keys(big if counted is None else counted, on, rows=rows)
    found = hot.collect()  # at most HOT_SHARE rows
    if not found:
        return big.join(unique, on, how)
    salt, flag = "__salt", "__hot"
    keys = F.broadcast(big.sparkSession.createDataFrame(found, hot.schema).withColumn(flag, F.lit(True)))
    left = big.join(keys, on, "left").withColumn(salt, F.when(F.col(flag), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop(flag)
    copies = F.when(F.col(flag), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = unique.join(keys, on, "left").withColumn(salt, F.explode(copies)).drop(flag)
    return left.join(right, [*on, salt], how).drop(salt)


def ranked(df: DataFrame, group: list[str], order: list[Column], as_name: str = "rank", name: str = "ranked") -> DataFrame:
    """1-based row number within each group, without ever holding a group in one task.

    Rows are range-partitioned by (group, order), so a hot group spreads over
    many tasks; each task numbers its own rows and adds the rows of its group
    that lie in earlier tasks.  ``order`` must be total for a fixed result.
    An empty ``group`` gives one global numbering.
    """
    part, local, ahead = "__part", "__local", "__ahead"
    keys = [F.col(c) for c in group]
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = materialize(
        df.repartitionByRange(n, *[k.asc_nulls_first() for k in keys], *order).withColumn(part, F.spark_partition_id()), name
    )
    local_w = Window.partitionBy(part, *group).orderBy(*order)
    # one row per (group, task): as many as there are groups and tasks together
    sizes = cut.groupBy(part, *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(ahead, F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    eq = F.col(f"l.{part}") == F.col(f"r.{part}")
    for c in group:
        eq = eq & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    numbered = cut.withColumn(local, F.row_number().over(local_w))
    out = numbered.alias("l").join(sizes.alias("r"), eq)
    return out.select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{local}") + F.col(f"r.{ahead}")).cast("bigint").alias(as_name))

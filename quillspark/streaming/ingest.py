"""Songs that keep arriving, ingested as they come.

A stream of song files goes through the same rules as the batch ingest: the
first row of a song_id stays, later ones are skipped, rejects are routed with
their reason.  Each batch keeps the first row of an id and leaves out the ids
that earlier batches wrote, however far apart in time they arrive: nothing is
dropped as late, and no id is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest, sections
from ..schemas import SONG

ARRIVING = T.StructType([*SONG.fields, T.StructField("ingested_at", T.TimestampType())])


def read_songs(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", max_files).parquet(path)


def first_songs(batch: DataFrame, epoch: int, root: str) -> DataFrame:
    """The first row of each song_id of a batch that no earlier batch under ``root`` has written."""
    first = ingest.ingest_songs(batch)
    if not epoch:
        return first
    # songs/ holds every id, rejected ones too; a batch that is made again doesn't see its own first attempt
    written = batch.sparkSession.read.parquet(f"{root}/songs").where(F.col("batch") < epoch).select(F.col("song_id").alias("known"))
    return first.join(written, F.col("song_id").eqNullSafe(F.col("known")), "left_anti")


def write_corpus(stream: DataFrame, root: str, strategy: str = "sections"):
    """Start the query that writes songs, chunks and rejects; each batch replaces its own folder, so a retry repeats nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = first_songs(batch, epoch, root).persist()
        flagged, chunks, rejects = ingest.preprocess(batch.drop("ingested_at"), strategy)
        for name, df in (("songs", flagged), ("chunks", chunks), ("rejects", rejects)):
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={epoch}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start()


def section_counts(stream: DataFrame, window: str = "1 day") -> DataFrame:
    """Chunks by arrival window and split, late rows included: the state is one count per window and split."""
    pieces = stream.select("ingested_at", F.explode(sections.by_sections(F.col("text_raw"))).alias("c"))
    return pieces.groupBy(F.window("ingested_at", window).alias("w"), F.col("c.split_by").alias("split_by")).agg(F.count(F.lit(1)).alias("n"))

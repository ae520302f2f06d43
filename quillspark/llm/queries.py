"""The pN_ queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import distinctive, near_duplicates, packing, ranking, repetition, sampling, sentences, splitting, tokens
from .oracles import ORACLES  # noqa: F401

#: Problem 5 in this project's data: three-word runs, half of the union, ten words.
SONGS_ALIKE = near_duplicates.Similarity(run=3, threshold=0.5, min_words=10, rows=5, bands=240, size=512)


def _repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(repetition.songs_and_chunks(table(spark, d, "songs"), table(spark, d, "chunks")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _repetition(spark, d).where("verdict = 'repetitive'").select("record_kind", "record_id")


def p1_repetition(spark: SparkSession, d: str) -> DataFrame:
    shares = [F.round(c, 9).alias(c) for c in ("repeated_share", "dup_line_share", "dup_paragraph_share")]
    rates = [F.round(c, 9).alias(c) for c in ("host_rate", "host_shrunk_rate")]
    return _repetition(spark, d).select("record_kind", "record_id", "n_words", "repeated_words", *shares, "fails_phrase", "host", "host_documents", "host_failures", *rates, "host_verdict", "verdict")


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    people = sampling.population(table(spark, d, "eval_queries"), table(spark, d, "songs"), table(spark, d, "chunks"))
    return sampling.matched_sample(people, table(spark, d, "sample_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].where(F.col("deficit") > 0).select("plan_id", "category")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def _closeness(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_hits(table(spark, d, "hits"), table(spark, d, "retrieval_configs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_songs(_closeness(spark, d))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.full_ranking(_closeness(spark, d)).withColumn("closeness", F.round("closeness", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks")).where("piece = 0").select("chunk_id", "cut_at")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_duplicates.similar_classes(table(spark, d, "songs"), "song_id", "text_raw", SONGS_ALIKE)
    return near_duplicates.expand_pairs(members, links).select(F.col("a").alias("song_id_a"), F.col("b").alias("song_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    songs = table(spark, d, "songs")
    members, links = near_duplicates.similar_classes(songs, "song_id", "text_raw", SONGS_ALIKE)
    members = near_duplicates.with_all_records(members, songs, "song_id")
    return near_duplicates.groups(members, links).withColumnRenamed("record_id", "song_id")


def _shared(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.shared_terms(table(spark, d, "eval_queries"), table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.rare_shared_terms(_shared(spark, d)).select("query_id", F.explode("terms").alias("term"))


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).select("query_id", "chunk_id", "term", "observed", "n_records", F.round("residual", 6).alias("residual"), F.round("idf", 6).alias("idf"))


def p6_shared(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.leak_summary(_shared(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(packing.pack(table(spark, d, "documents")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    report = packing.fill_report(packing.pack(table(spark, d, "documents")))
    return report.select("documents", "over_capacity", "broken", (F.col("fill") > 0.95).alias("well_filled"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    prose = table(spark, d, "documents").where(F.col("source").isin("liner_notes", "review", "annotation", "interview"))
    return sentences.sentence_units(prose).select("doc_id", "end_pos")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_repetition, p2_found, p2_report, p2_sample, p3_found, p3_ranking, p4_found, p4_pieces,
        p5_found, p5_groups, p6_found, p6_weights, p6_shared, p7_ids, p8_found, p8_containers, p8_fill, p9_found, p9_sentences,
    )
}

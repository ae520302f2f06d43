"""Repetition inside a single document, with host-level verdicts.

Method: each text is measured once (shares of repeated word places, lines and
paragraphs), rules fail or pass per document, failures are added up by host,
host failure rates are shrunk with a beta prior fitted to all hosts, and the
host verdict is joined back to every document of the host.  A document's
verdict is then its own ('repetitive') where its phrases fail, else that of
its host ('suspect' in a repetitive host), else 'ok'.

The text itself is never shuffled: it is measured where it is scanned, and
only a few numbers per document travel on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..runtime import counted_join, materialize, skewed_join

RUN = 4
MIN_WORDS = 8
MAX_SHARE = 0.5
HOST_LIMIT = 0.5

_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)\s*(?:\r\n|\r|\n)")
_MEASURES = T.StructType(
    [
        T.StructField("n_words", T.IntegerType()),
        T.StructField("repeated_words", T.IntegerType()),
        T.StructField("dup_line_share", T.DoubleType()),
        T.StructField("dup_paragraph_share", T.DoubleType()),
    ]
)


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    if "İ" in text:  # its lower case would bring in a mark and part the word
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def repeated_places(tokens: list[str], run: int = RUN) -> int:
    """Word places in a run of ``run`` words that also starts at an earlier place."""
    grams = list(zip(*(tokens[i:] for i in range(run))))
    if len(set(grams)) == len(grams):
        return 0
    seen: set[tuple[str, ...]] = set()
    count, covered = 0, 0  # places before ``covered`` are settled
    for i, gram in enumerate(grams):
        if gram in seen:
            count += i + run - max(i, covered)
            covered = i + run
        else:
            seen.add(gram)
    return count


def duplicate_share(parts: list[str]) -> float:
    """Share of characters in parts that were seen before in the same text."""
    kept = [p for p in (" ".join(x.split()).lower() for x in parts) if p]
    total = sum(map(len, kept))
    return 1 - sum(map(len, set(kept))) / total if total else 0.0


def measure(text: str | None) -> tuple[int, int, float, float]:
    if not text:
        return 0, 0, 0.0, 0.0
    w = words(text)
    return len(w), repeated_places(w), duplicate_share(text.splitlines()), duplicate_share(_PARAGRAPH.split(text))


@pandas_udf(_MEASURES)
def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=_MEASURES.names)


def document_measures(records: DataFrame, kind: str, record_id: str, text: str, host: str | None) -> DataFrame:
    """One row per row of ``records``: kind, id, host and the measures of its text."""
    measured = records.select(
        F.lit(kind).alias("record_kind"),
        F.col(record_id).cast("string").alias("record_id"),
        (F.col(host).cast("string") if host else F.lit(None).cast("string")).alias("host"),
        _measured(F.col(text)).alias("m"),
    )
    return measured.select("record_kind", "record_id", "host", "m.*")


def repetition(measures: DataFrame, *, min_words: int = MIN_WORDS, max_share: float = MAX_SHARE, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Rules per document, failure rates per host, verdicts joined back.

    Input: ``document_measures`` rows, of one or more kinds.  Repeated rows of
    a key count once (the row with the most words).  Output, one row per
    (record_kind, record_id): the measures, ``repeated_share`` (0 for texts of
    fewer than four words), ``fails_phrase``, ``fails_line``,
    ``fails_paragraph``, the host's document and failure counts, its raw and
    shrunk failure rate, ``host_verdict`` and the document's ``verdict``.  Null, empty and wordless texts
    have share 0 and fail nothing; a null host is a host of its own kind, '(none)'.
    """
    key = ["record_kind", "record_id"]
    rest = [c for c in measures.columns if c not in key]
    best = F.max(F.struct("n_words", "repeated_words", *[c for c in rest if c not in ("n_words", "repeated_words")]))
    docs = measures.groupBy(*key).agg(best.alias("m")).select(*key, "m.*")
    share = F.when(F.col("n_words") > 0, F.col("repeated_words") / F.col("n_words")).otherwise(F.lit(0.0))
    long_enough = F.col("n_words") >= min_words
    docs = (
        docs.withColumn("host", F.coalesce("host", F.lit("(none)")))
        .withColumn("repeated_share", share)
        # in whole numbers, so that exactly half is not more than half
        .withColumn("fails_phrase", long_enough & (F.col("repeated_words") > F.col("n_words") * F.lit(max_share)))
        .withColumn("fails_line", long_enough & (F.col("dup_line_share") > max_share))
        .withColumn("fails_paragraph", long_enough & (F.col("dup_paragraph_share") > max_share))
    )
    docs = materialize(docs, "repetition")
    failed = (F.col("fails_phrase") | F.col("fails_line") | F.col("fails_paragraph")).cast("int")
    hosts = docs.groupBy("record_kind", "host").agg(F.count(F.lit(1)).alias("host_documents"), F.sum(failed).alias("host_failures"))
    hosts = hosts.withColumn("host_rate", F.col("host_failures") / F.col("host_documents"))
    # method of moments over the hosts of a kind: one row per kind, so tiny
    moments = hosts.groupBy("record_kind").agg(
        (F.sum("host_failures") / F.sum("host_documents")).alias("mean"),
        F.var_pop("host_rate").alias("var"),
        F.avg(F.lit(1.0) / F.col("host_documents")).alias("inv_n"),
    )
    spread = F.col("mean") * (1 - F.col("mean"))
    between = F.greatest(F.col("var") - spread * F.col("inv_n"), F.lit(0.0))
    strength = F.when(between <= 0, F.lit(1e6)).otherwise(F.greatest(spread / between - 1, F.lit(1e-3)))
    prior = moments.select("record_kind", "mean", F.least(strength, F.lit(1e6)).alias("strength"))
    alpha = F.col("mean") * F.col("strength")
    hosts = (
        counted_join(hosts, prior, ["record_kind"], F.col("host"))  # one row per kind of record
        .withColumn("host_shrunk_rate", (F.col("host_failures") + alpha) / (F.col("host_documents") + F.col("strength")))
        .withColumn("host_verdict", F.when(F.col("host_shrunk_rate") > host_limit, F.lit("repetitive")).otherwise(F.lit("ok")))
        .drop("mean", "strength")
    )
    judged = skewed_join(docs, hosts, ["record_kind", "host"], F.col("record_id"))
    return judged.withColumn("verdict", F.when(F.col("fails_phrase"), "repetitive").when(F.col("host_verdict") == "repetitive", "suspect").otherwise("ok"))


def songs_and_chunks(songs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Measures of both tables; the host is the artist of a song and the song of a chunk."""
    of_songs = document_measures(songs.withColumn("__host", F.lower(F.trim("artist"))), "song", "song_id", "text_raw", "__host")
    return of_songs.unionByName(document_measures(chunks, "chunk", "chunk_id", "text", "song_id"))

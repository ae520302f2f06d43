"""Dense, lexical and hybrid retrieval of whole query sets.

Every retriever takes a table of queries and returns two tables: ranked hits
(query_id, song_id, score, best_chunk_id, rank) and the status of each query
(query_id, status, query_norm).  Chunk texts are joined only after the
ranking, to the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import NO_SIGNAL, norm
from ..runtime import counted_join, materialize, skewed_join
from . import blocks as bl
from . import fusion, knn
from . import postings as inv

OK, OUT_OF_VOCABULARY, EMPTY = "ok", "query_out_of_vocabulary", "empty_query"
DECIMALS = 6


def _status(blank: Column, known: Column) -> Column:
    return F.when(blank, EMPTY).when(known, OK).otherwise(OUT_OF_VOCABULARY)


def is_blank(query: Column) -> Column:
    """Null, empty or only white space."""
    return tx.strip(F.coalesce(query, F.lit(""))) == ""


def require_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with song_id of their chunk; a hit whose chunk is missing raises when it is read."""
    known = chunks.select("chunk_id", F.col("song_id").alias("__song"))
    joined = hits.join(known, "chunk_id", "left")
    checked = F.coalesce("__song", F.raise_error(F.concat(F.lit("index and chunks are out of sync: "), F.col("chunk_id"))).cast("string"))
    return joined.withColumn("song_id", checked).drop("__song")


def dense_sparse_search(queries: DataFrame, chunks: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """Dense retrieval with tf-idf vectors: top k chunks by cosine, then the best chunk of each song.

    The limit is on chunks, so there may be fewer than k songs.
    """
    best, norms = sparse_chunks(queries, chunks, k)
    return _songs_of(best, chunks), _statuses(queries, norms, NO_SIGNAL)


def sparse_chunks(queries: DataFrame, chunks: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score, rank) of the k chunks of highest tf-idf cosine, and (query_id, query_norm) of queries with a known term."""
    index = bl.index(chunks, "chunk_id", tx.tfidf_terms(F.col("text")))
    n_docs = bl.sizes(index)[0]
    terms = bl.frequencies(index)
    idf = materialize(terms.select("term", inv.smooth_idf(F.lit(n_docs), F.col("df")).alias("idf")), "idf")
    post = materialize(inv.postings(queries.where(~is_blank(F.col("query"))), "query_id", tx.tfidf_terms(F.col("query"))), "query_terms")
    known = materialize(idf.join(post.select("term").distinct(), "term", "left_semi"), "asked_idf")
    asked = counted_join(post, known, ["term"], F.col("query_id"), most=inv.BROADCAST_TERMS).withColumn("w", F.col("tf") * F.col("idf"))
    # a chunk's part of a product is its tf over its norm, so the idf of either side is on the query's
    norm_ = F.sqrt(F.sum(F.col("w") * F.col("w")))
    bags = asked.groupBy("query_id").agg((1 / norm_).alias("scale"), F.collect_list(F.struct("term", (F.col("w") * F.col("idf")).alias("w"))).alias("bag"))
    bags = materialize(bags, "query_vectors")
    scored = bl.top_documents(bags, "query_id", bl.with_norms(index, idf), n_docs, "chunk_id", k)
    best = materialize(fusion.top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k), "dense")
    return best, bags.select("query_id", F.lit(1.0).alias("query_norm"))


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 50, *, approximate: bool = False, index: tuple[DataFrame, knn.Lists] | None = None) -> tuple[DataFrame, DataFrame]:
    """Dense retrieval over given vectors: queries (query_id, embedding), vectors (chunk_id, song_id, embedding).

    Queries without signal never reach the index.  ``index`` (blocks, lists)
    of a built index is searched instead of all vectors; ``approximate``
    builds one for this search.
    """
    with_norm = queries.withColumn("query_norm", F.coalesce(norm(F.col("embedding")), F.lit(0.0)))
    asked = with_norm.where(F.col("query_norm") > NO_SIGNAL)
    if index is not None:
        best = knn.probe_top_k(asked, *index, k)
    elif approximate:
        best = knn.approximate_top_k(asked, vectors, k)
    else:
        best = knn.exact_top_k(asked, vectors, k)
    status = with_norm.select(F.col("query_id").cast("string").alias("query_id"), _status(F.col("embedding").isNull(), F.col("query_norm") > NO_SIGNAL).alias("status"), "query_norm")
    return _songs_of(best, vectors), status


def _songs_of(best: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk hits to ranked songs."""
    hits = require_chunks(best.withColumn("chunk_id", F.col("chunk_id").cast("string")), chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")))
    songs = fusion.best_chunk_per_song(hits)
    return fusion.top_k(songs, ["query_id"], [F.desc("score"), F.asc("song_id")], 2**31 - 1)


def _statuses(queries: DataFrame, norms: DataFrame, least: float) -> DataFrame:
    joined = queries.select("query_id", is_blank(F.col("query")).alias("blank")).join(norms, "query_id", "left").na.fill(0.0, ["query_norm"])
    return joined.select("query_id", _status(F.col("blank"), F.col("query_norm") > least).alias("status"), F.when(F.col("blank"), 0.0).otherwise(F.col("query_norm")).alias("query_norm"))


def fit_lexical(songs: DataFrame) -> inv.Bm25:
    """The BM25 index of whole songs, rejected ones too."""
    return inv.fit_bm25(songs, "song_id", tx.tokenize_words(F.coalesce("text_raw", F.lit(""))))


def lexical_search(queries: DataFrame, songs: DataFrame, chunks: DataFrame | None, k: int = 50, *, index: inv.Bm25 | None = None, on_missing_chunk: str = "null") -> tuple[DataFrame, DataFrame]:
    """BM25 over whole songs, then the best chunk of the songs that are left.

    All songs count, rejected ones too.  The best chunk is the one with the
    highest sum of idf of the query's tokens it holds, ties to the earlier
    position.  A song without chunks keeps its place with a null chunk, or
    raises with ``on_missing_chunk='error'``; without ``chunks`` all are null.
    query_norm is the number of query tokens the vocabulary knows, with
    repetition.  With ``index``, a written one, only the postings of asked
    terms are read and ``songs`` not at all.
    """
    bag = materialize(inv.query_bag(queries.where(~is_blank(F.col("query"))), "query_id", tx.tokenize_words(F.col("query"))), "bag")
    if index is not None:
        terms = inv.few_terms(bag)
        idf = inv.of_terms(index.idf, terms)
        if terms is None:
            idf = materialize(idf.join(bag.select("term").distinct(), "term", "left_semi"), "idf")
        model = inv.Bm25(inv.of_terms(index.postings, terms), idf, index.stats)
        scored = inv.bm25_scores(bag, "query_id", model, "song_id").withColumn("score", F.round("score", DECIMALS)).where("score > 0")
    else:
        table, n_docs, avgdl, idf = _lexical_blocks(songs, bag)
        known = counted_join(bag, idf.select("term", "idf"), ["term"], F.col("query_id"), most=inv.BROADCAST_TERMS)
        bags = known.groupBy("query_id").agg(F.lit(1.0).alias("scale"), F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w"))).alias("bag"))
        scored = bl.top_documents(bags, "query_id", table, n_docs, "song_id", k, avgdl, inv.K1, inv.B)
    best = materialize(fusion.top_k(scored, ["query_id"], [F.desc("score"), F.asc("song_id")], k), "lexical")
    if chunks is None:
        hits = best.withColumn("best_chunk_id", F.lit(None).cast("string"))
    else:
        hits = best.join(best_chunks(best, bag, idf, chunks), ["query_id", "song_id"], "left")
    if on_missing_chunk == "error":
        missing = F.raise_error(F.concat(F.lit("song without chunks: "), F.col("song_id"))).cast("string")
        hits = hits.withColumn("best_chunk_id", F.coalesce("best_chunk_id", missing))
    return hits.select("query_id", "song_id", "score", "best_chunk_id", "rank"), _lexical_statuses(queries, bag, idf)


def _lexical_blocks(songs: DataFrame, bag: DataFrame) -> tuple[DataFrame, int, float, DataFrame]:
    """Blocks of the songs' tokens, number of songs, their mean length, and (term, df, idf) of the terms of ``bag``."""
    table = bl.index(songs, "song_id", tx.tokenize_words(F.coalesce("text_raw", F.lit(""))))
    n_docs, total = bl.sizes(table)
    idf, _ = inv.bm25_idf(bl.frequencies(table), n_docs)
    asked = materialize(idf.join(bag.select("term").distinct(), "term", "left_semi"), "idf")
    return table, n_docs, total / n_docs if n_docs else 0.0, asked


def _lexical_statuses(queries: DataFrame, bag: DataFrame, idf: DataFrame) -> DataFrame:
    known = bag.join(idf, "term", "left_semi").groupBy("query_id").agg(F.sum("qtf").cast("double").alias("query_norm"))
    return _statuses(queries, known, 0.0)


def lexical_statuses(queries: DataFrame, songs: DataFrame) -> DataFrame:
    """The statuses of ``lexical_search``, which depend on the vocabulary alone."""
    bag = materialize(inv.query_bag(queries.where(~is_blank(F.col("query"))), "query_id", tx.tokenize_words(F.col("query"))), "bag")
    return _lexical_statuses(queries, bag, _lexical_blocks(songs, bag)[3])


def best_chunks(hits: DataFrame, bag: DataFrame, idf: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, song_id, best_chunk_id) for ranked songs; a chunk without any query token counts 0."""
    wanted = hits.select("query_id", "song_id")
    mine = chunks.select("chunk_id", "song_id", "position", "text").join(wanted.select("song_id").distinct(), "song_id", "left_semi")
    # a query's terms travel with its hits as one array, so that a chunk meets a query in one row
    mine = mine.repartition("song_id").select("chunk_id", "song_id", "position", F.array_distinct(tx.tokenize_words(F.col("text"))).alias("held"))
    known = counted_join(bag, idf.select("term", "idf"), ["term"], F.col("query_id"), most=inv.BROADCAST_TERMS)
    asked = known.groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w"))).alias("bag"))
    # a song that most queries find is a hot key
    pairs = skewed_join(wanted.join(asked, "query_id"), mine, ["song_id"], F.col("query_id"), counted=hits)
    gain = F.aggregate("bag", F.lit(0.0), lambda a, t: a + F.when(F.array_contains("held", t["term"]), t["w"]).otherwise(0.0))
    scored = pairs.select("query_id", "song_id", "chunk_id", "position", F.coalesce(gain, F.lit(0.0)).alias("gain"))
    best = F.min(F.struct((-F.round("gain", DECIMALS)).alias("neg"), F.col("position").alias("position"), F.col("chunk_id").alias("chunk_id"))).alias("m")
    return scored.groupBy("query_id", "song_id").agg(best).select("query_id", "song_id", F.col("m.chunk_id").alias("best_chunk_id"))


def hybrid(dense: tuple[DataFrame, DataFrame], lexical: tuple[DataFrame, DataFrame], rrf_k: int = fusion.RRF_K) -> tuple[DataFrame, DataFrame]:
    """Reciprocal-rank fusion of two retrievers' results; the union is not trimmed.

    The best chunk is the dense one where there is one.  Statuses: ok if any
    branch has hits; empty if both are; else out of vocabulary, also where
    both are ok without hits.  query_norm is the dense branch's.
    """
    (dh, ds), (lh, ls) = dense, lexical
    # each branch is used twice over; written once
    dh, lh = materialize(dh, "dense_hits"), materialize(lh, "lexical_hits")
    of = lambda df, arm: df.select("query_id", F.lit(arm).alias("arm"), "song_id", "rank", "best_chunk_id")
    lists = of(dh, "dense").unionByName(of(lh, "lexical"))
    chunk = F.coalesce(F.max(F.when(F.col("arm") == "dense", F.col("best_chunk_id"))), F.max("best_chunk_id")).alias("best_chunk_id")
    hits = fusion.reciprocal_rank_fusion(lists, k=rrf_k, more=[chunk])
    any_hit = lists.select("query_id").distinct().withColumn("hit", F.lit(True))
    both = ds.select("query_id", F.col("status").alias("d"), "query_norm").join(ls.select("query_id", F.col("status").alias("l")), "query_id").join(any_hit, "query_id", "left")
    status = F.when(F.col("hit"), OK).when((F.col("d") == EMPTY) & (F.col("l") == EMPTY), EMPTY).otherwise(OUT_OF_VOCABULARY)
    branches = F.create_map(F.lit("dense"), F.col("d"), F.lit("lexical"), F.col("l"))
    return hits.select("query_id", "song_id", "score", "best_chunk_id", "n_lists", "best_rank", "rank"), both.select("query_id", status.alias("status"), "query_norm", branches.alias("branch_statuses"))


def trim(hits: DataFrame, return_n: int = 10) -> DataFrame:
    """What a search shows: the first ``return_n`` hits of each query."""
    return hits.where(F.col("rank") <= return_n)


def show_hits(hits: DataFrame, songs: DataFrame, chunks: DataFrame | None, return_n: int = 10) -> DataFrame:
    """Display rows: artist, title and, of given ``chunks``, a snippet of the best one, joined last; a hit on a song that is not there raises when it is read."""
    shown = trim(hits, return_n)
    known = songs.select("song_id", "artist", "title", F.lit(True).alias("__known"))
    named = shown.join(known, "song_id", "left")
    missing = F.raise_error(F.concat(F.lit("no such song: "), F.col("song_id"))).cast("string")
    named = named.withColumn("song_id", F.when(F.col("__known"), F.col("song_id")).otherwise(missing))
    fields = ["query_id", "rank", "song_id", "artist", "title", F.round("score", 4).alias("score")]
    if chunks is None:
        return named.select(*fields)
    text = chunks.select(F.col("chunk_id").alias("best_chunk_id"), tx.snippet(F.col("text")).alias("snippet"))
    return named.join(text, "best_chunk_id", "left").select(*fields, "snippet")

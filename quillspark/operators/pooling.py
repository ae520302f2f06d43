"""Samples, judgement pools, themes and their queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ranked
from .ingest import seeded_order

MIN_FRAGMENT_CHARS = 80


def structural_songs(chunks: DataFrame) -> DataFrame:
    """Songs all of whose chunks were split in one way, and that without tags."""
    per_song = chunks.groupBy("song_id").agg(F.min("split_by").alias("lo"), F.max("split_by").alias("hi"), F.sum(F.col("split_by").isNull().cast("int")).alias("unknown"))
    return per_song.where((F.col("lo") == F.col("hi")) & (F.col("unknown") == 0) & F.col("lo").isin("none", "plain_label")).select("song_id")


def stratified_sample(pools: list[tuple[str, DataFrame, int]], key: str, seed: int) -> DataFrame:
    """(stratum, key): exactly n keys of each pool, no key in two strata.

    Pools are (name, table, n) and draw in the given order, the scarcest
    first; a key that an earlier pool drew is out of the later ones.  Raises
    where a pool has too few left.
    """
    taken: DataFrame | None = None
    for name, pool, n in pools:
        left = pool.select(key).distinct()
        if taken is not None:
            left = left.join(taken.select(key), key, "left_anti")
        drawn = left.orderBy(seeded_order(F.concat_ws(":", F.lit(name), F.col(key)), seed), F.col(key)).limit(n)
        drawn = drawn.select(F.lit(name).alias("stratum"), key)
        if (found := drawn.count()) < n:
            raise ValueError(f"stratum {name!r} has {found} of {n} songs")
        taken = drawn if taken is None else taken.unionByName(drawn)
    if taken is None:
        raise ValueError("no strata")
    return taken


def fragment_per_song(songs: DataFrame, chunks: DataFrame, seed: int, min_chars: int = MIN_FRAGMENT_CHARS) -> DataFrame:
    """(song_id, chunk_id, skipped): one random long enough chunk of each song, or why there is none."""
    fit = chunks.where(F.length("text") >= min_chars)
    pick = F.min(F.struct(seeded_order(F.col("chunk_id"), seed).alias("o"), F.col("chunk_id").alias("chunk_id"))).alias("m")
    picked = fit.groupBy("song_id").agg(pick).select("song_id", F.col("m.chunk_id").alias("chunk_id"))
    return songs.select("song_id").join(picked, "song_id", "left").withColumn("skipped", F.when(F.col("chunk_id").isNull(), "no_fragment"))


def batch_slice(df: DataFrame, order: list[Column], batch: int, size: int) -> DataFrame:
    """Rows of the given batch (from 0) in the given order."""
    numbered = ranked(df, [], order, "__n", "batches")
    return numbered.where(F.col("__n").between(batch * size + 1, (batch + 1) * size)).drop("__n")


def grouped(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows numbered in groups of ``size`` by key: group_no and place."""
    numbered = ranked(df, [], [F.col(key).asc()], "__n", "grouped")
    return numbered.withColumns({"group_no": F.floor((F.col("__n") - 1) / size), "place": F.pmod(F.col("__n") - 1, F.lit(size))}).drop("__n")


def missing_replies(wanted: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(replies.select(key).distinct(), key, "left_anti")


def pool(runs: DataFrame, depth: int = 5) -> DataFrame:
    """(query_id, song_id, best_rank, n_arms, found_by): the union of the arms' first songs.

    found_by lists {arm, rank}; there are as many as arms.
    """
    first = runs.where(F.col("rank") <= depth)
    found = F.sort_array(F.collect_list(F.struct("arm", "rank"))).alias("found_by")
    return first.groupBy("query_id", "song_id").agg(F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("n_arms"), found)


def pool_sizes(pooled: DataFrame) -> DataFrame:
    """One row: smallest, largest and mean pool."""
    n = pooled.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"), F.count(F.lit(1)).alias("n_pools"))


def display_order(pooled: DataFrame, warm_up: Column, seed: int) -> DataFrame:
    """The pool with ``shown_at``: warm-up queries by best rank, the others shuffled so that no arm shows."""
    shuffled = F.md5(F.concat_ws("‖", "query_id", "song_id", F.lit(str(seed))))
    key = F.when(warm_up, F.concat(F.lpad(F.col("best_rank").cast("string"), 12, "0"), F.col("song_id"))).otherwise(shuffled)
    w = Window.partitionBy("query_id").orderBy("__key", "song_id")
    return pooled.withColumn("__key", key).withColumn("shown_at", F.row_number().over(w)).drop("__key")


def blinded(pooled: DataFrame, fields: set[str]) -> DataFrame:
    """The pool as judges see it; raises if it holds a field that would tell where a song comes from."""
    extra = set(pooled.columns) - fields
    if extra:
        raise ValueError(f"a judge must not see {sorted(extra)}")
    return pooled


def usable_themes(themes: DataFrame) -> DataFrame:
    """Themes to pool: not thrown out, not marked unsure; themes nobody looked at stay in."""
    return themes.where(~F.col("keep").eqNullSafe(F.lit(False)) & ~F.col("mark").eqNullSafe(F.lit("unsure")))


def select_themes(themes: DataFrame, only: str) -> DataFrame:
    """'new' (no mark), 'flagged' (to be looked at again) or 'all'."""
    if only == "new":
        return themes.where("mark is null")
    if only == "flagged":
        return themes.where(F.coalesce("recheck", F.lit(False)))
    if only == "all":
        return themes
    raise ValueError(f"unknown selection {only!r}")


def stamp_recheck(themes: DataFrame) -> DataFrame:
    """Queue the unsure themes for a second look, keeping the first mark; nothing while a queue is open."""
    open_ = themes.agg(F.coalesce(F.max(F.coalesce("recheck", F.lit(False)).cast("int")), F.lit(0)).alias("__open"))
    unsure = (F.col("__open") == 0) & F.col("mark").eqNullSafe(F.lit("unsure"))
    both = themes.crossJoin(F.broadcast(open_))
    before = F.when(unsure, F.col("mark")).otherwise(F.col("mark_before_recheck"))
    recheck = F.when(unsure, F.lit(True)).otherwise(F.col("recheck"))
    return both.withColumns({"mark_before_recheck": before, "recheck": recheck}).drop("__open")


def keep_of_mark(mark: Column) -> Column:
    """yes and no decide, unsure and nothing do not."""
    return F.when(mark == "yes", True).when(mark == "no", False)


def undo_last(themes: DataFrame) -> DataFrame:
    """Themes without the latest mark."""
    last = themes.agg(F.max("mark_seq").alias("__last"))
    undone = F.col("mark_seq").eqNullSafe(F.col("__last")) & F.col("mark_seq").isNotNull()
    both = themes.crossJoin(F.broadcast(last))
    return both.withColumns({c: F.when(~undone, F.col(c)) for c in ("mark", "keep", "mark_seq")}).drop("__last")


def tier_tally(themes: DataFrame) -> DataFrame:
    """Per tier: kept and all themes."""
    return themes.groupBy("tier").agg(F.sum(F.col("keep").eqNullSafe(F.lit(True)).cast("bigint")).alias("n_kept"), F.count(F.lit(1)).alias("n_themes"))


#: Judgements that a kept theme has come to on average.
JUDGEMENTS_A_THEME = 23.5


def implied_judgements(themes: DataFrame) -> DataFrame:
    """One row: kept themes, and the judgements they will come to."""
    kept = F.coalesce(F.sum(F.col("keep").eqNullSafe(F.lit(True)).cast("bigint")), F.lit(0))
    return themes.agg(kept.alias("n_kept")).withColumn("n_judgements", F.round(F.col("n_kept") * JUDGEMENTS_A_THEME).cast("bigint"))


def pending(pooled: DataFrame, judged: DataFrame) -> DataFrame:
    """Pool rows nobody judged."""
    return pooled.join(judged.select("query_id", "song_id").distinct(), ["query_id", "song_id"], "left_anti")


def judgement_counts(judged: DataFrame) -> DataFrame:
    """Per grade; 'dont_know' where a judge could not say."""
    grade = F.when(F.col("dont_know"), "dont_know").otherwise(F.coalesce(F.col("grade").cast("string"), F.lit("(none)")))
    return judged.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"))


def first_examples(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)



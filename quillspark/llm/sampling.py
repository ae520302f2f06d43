"""A sample whose categories have given target shares.

Method: the acceptance probability of a category is its wanted count over its
observed count; rows are accepted independently (by a hash of plan and key)
with slight oversampling; counts are then corrected exactly, and what is
missing is reported.

No category is ever sorted in one task: the exact cut of a category is found
in a histogram of its accepted hashes (a fixed number of bins per category),
and only the rows of the bin on the cut are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, ranked

OVERSAMPLE = 1.1
SLACK = 50
BINS = 4096
_SPACE = float(2**52)
#: Rows of plans and categories that are broadcast at most; a larger configuration is joined by shuffles.
_PLANS = 50_000


def normal(category):
    """A value as it is compared: trimmed of blanks and tabs, in lower case."""
    return F.lower(F.regexp_replace(category.cast("string"), r"^[ \t]+|[ \t]+$", ""))


def population(eval_queries: DataFrame, songs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(dimension, record_id, category), one row per distinct key.

    Repeated rows of a key count once; of several values the largest that is
    not null holds.  A null key is no record.
    """

    def one(df: DataFrame, dimension: str, key: str, value: str) -> DataFrame:
        return (
            df.where(F.col(key).isNotNull())
            .groupBy(F.col(key).cast("string").alias("record_id"))
            .agg(F.max(normal(F.col(value))).alias("category"))
            .select(F.lit(dimension).alias("dimension"), "record_id", "category")
        )

    return (
        one(eval_queries, "stratum", "query_id", "stratum")
        .unionByName(one(songs, "is_translation", "song_id", "is_translation"))
        .unionByName(one(chunks, "split_by", "chunk_id", "split_by"))
    )


def wants(people: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per plan and category: total, available and wanted rows.

    Wanted is the larger of min_rows and share x fraction x total, rounded half
    up in decimals.  Nulls are in no category but in the total.  A dimension
    without any row has total 0.  Repeated target rows count once.
    """
    seen = people.groupBy("dimension", "category").agg(F.count(F.lit(1)).alias("available"))
    totals = seen.groupBy("dimension").agg(F.sum("available").alias("total"))
    plan = targets.select("plan_id", "dimension", normal(F.col("category")).alias("category"), "target_share", "min_rows", "sample_fraction")
    plan = plan.where(F.col("category").isNotNull()).dropDuplicates(["plan_id", "dimension", "category"])
    dec = lambda c, p, s: F.coalesce(F.col(c), F.lit(0)).cast(f"decimal({p},{s})")
    exact = dec("target_share", 10, 6) * dec("sample_fraction", 10, 6) * dec("total", 14, 0)
    return (
        plan.join(totals, "dimension", "left")
        .join(seen, ["dimension", "category"], "left")
        .na.fill(0, ["total", "available"])
        .withColumn("wanted", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), F.round(exact, 0).cast("bigint")))
    )


def _with_plans(rows: DataFrame, plans: DataFrame, on: tuple[str, ...] = ("dimension", "category"), how: str = "inner") -> DataFrame:
    """``rows`` with the plans of their category: broadcast after counting, as a category may hold most rows and several plans may ask for it."""
    few = plans.limit(_PLANS + 1).count() <= _PLANS
    return rows.join(F.broadcast(plans) if few else plans, list(on), how)


def matched_sample(people: DataFrame, targets: DataFrame, seed: int = 42, *, oversample: float = OVERSAMPLE, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    ``sample``: plan_id, dimension, category, record_id; exactly
    min(wanted, available) rows of each category of each plan.  ``report``:
    plan_id, dimension, category, total, available, wanted, taken, deficit.
    The same seed gives the same rows.  An empty population gives an empty
    sample and a report of nothing but deficits.
    """
    people = materialize(people, "population")
    # the plans are a configuration table: (plans x categories) rows, not data
    wanted = materialize(wants(people, targets), "wants")
    rate = F.col("wanted") / F.greatest(F.col("available"), F.lit(1)) * F.lit(oversample) + F.lit(SLACK) / F.greatest(F.col("available"), F.lit(1))
    plan = wanted.where((F.col("wanted") > 0) & (F.col("available") > 0)).select(
        "plan_id", "dimension", "category", "wanted", "available", F.least(rate, F.lit(1.0)).alias("accept")
    )
    # the same numbers in any engine: 52 bits of a digest
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("plan_id"), F.col("record_id")))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(_SPACE)
    drawn = _with_plans(people, plan).withColumn("u", u)
    group = ["plan_id", "dimension", "category"]

    def cut(rows: DataFrame) -> DataFrame:
        """Per category the bin on the cut, the rows in the bins before it, and all rows."""
        counts = rows.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("wanted").alias("wanted"))
        run = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(run))  # at most ``bins`` rows a category
        full = F.col("upto") <= F.col("wanted")
        return counts.groupBy(*group).agg(
            F.min(F.when(~full, F.col("bin"))).alias("edge_bin"),  # null: all are wanted
            F.coalesce(F.max(F.when(full, F.col("upto"))), F.lit(0)).alias("inside"),
            F.sum("n").alias("accepted"),
        )

    accepted = drawn.where(F.col("u") < F.col("accept")).withColumn("bin", F.floor(F.col("u") / F.col("accept") * bins).cast("int"))
    accepted = materialize(accepted, "accepted")
    cuts = cut(accepted)
    # a draw that came out short is made again without rejection; the hashes are the same, so the smallest are kept
    short = plan.join(cuts, group, "left").where(F.coalesce("accepted", F.lit(0)) < F.least("wanted", "available")).select(*group, F.lit(True).alias("again"))
    short = materialize(short, "short")
    if short.take(1):
        redo = _with_plans(drawn, short, group, "left_semi").withColumn("bin", F.floor(F.col("u") * bins).cast("int"))
        kept = _with_plans(accepted, short, group, "left_anti")
        accepted = materialize(kept.unionByName(redo), "accepted")
        cuts = cut(accepted)
    placed = _with_plans(accepted, materialize(cuts, "cuts"), group)
    whole = placed.where(F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")))
    edge = placed.where((F.col("bin") == F.col("edge_bin")) & (F.col("inside") < F.col("wanted")))
    columns = [*group, "record_id"]
    edge = ranked(edge.select(*columns, "u", "wanted", "inside"), group, [F.col("u").asc(), F.col("record_id").asc()], "place", "edge")
    sample = whole.select(*columns).unionByName(edge.where(F.col("place") <= F.col("wanted") - F.col("inside")).select(*columns))
    sample = materialize(sample, "sample")
    taken = sample.groupBy(*group).agg(F.count(F.lit(1)).alias("taken"))
    report = wanted.join(taken, group, "left").na.fill(0, ["taken"]).withColumn("deficit", F.greatest(F.col("wanted") - F.col("taken"), F.lit(0)))
    return sample, report.select(*group, "total", "available", "wanted", "taken", "deficit")

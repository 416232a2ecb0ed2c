"""Mixing sources to target weights by capped water-filling.

A budget of words is shared among sources by weight. A source may be repeated ``max_epochs`` times at most;
what a clamped source cannot take goes to the others by weight until no source is above its cap. With the
sources ordered by cap over weight the clamped ones come first, so the water level follows from running
sums over the sources and no loop is needed.

A source with target t and size s gives every document ``floor(t / s)`` whole repetitions. The rest of
its target is filled by documents in a seeded order; the one at which it is full gives only the words
still missing, the sole fractional repetition of its source. The order is found without a sort of a source:
a seeded hash deals its documents into buckets, bucket sums give each bucket's offset, and rows are only
ordered within a bucket.

Defined results: a null text has no words, and such a document is never taken; a null source is a source of its
own and comes last; equal rows are told apart only by their place, and the order of hash, id and size
decides; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which a source's documents are dealt for the seeded order.
BUCKETS = 1024
SEED = 17


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget_share: float, max_epochs: float) -> DataFrame:
    """``sources`` (mix_key, source, source_size, weight, rank_in_order) with ``target``: double.

    Runs over one row per source. The level is the one at which the shares of all unclamped sources and
    the caps of the clamped ones add up to the budget.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank_in_order")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(budget_share)))
        .withColumn("level", level)
        # the first source, in order of ratio, whose cap the level leaves unreached sets the level for all after it
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("water", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank_in_order", "level"))).over(every))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("water.level") * F.col("weight"), F.col("cap"))))
        .select("mix_key", "source", "source_size", "weight", "target")
    )


def plan_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    budget_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = SEED,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    keep: tuple[str, ...] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """How many words the mix takes of every row: mix_id, mix_source, size, source_size, target, taken and ``keep``.

    Sources in order of code point, null last, get the weights in turn. Words are counted once and the
    narrow result is written to the shared folder; texts are never shuffled unless ``keep`` names them.
    """
    narrow = docs.select(
        F.col(id_col).alias("mix_id"),
        F.col(source_col).alias("mix_source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("mix_key"),  # never null, so one exchange serves the window and the join
        word_count(F.col(text_col)).alias("size"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    )
    rows = materialize(
        narrow.withColumn("order", F.xxhash64(F.lit(seed), F.col("mix_id"), "size")).withColumn(
            "bucket", F.pmod(F.xxhash64("order", F.lit(seed)), F.lit(buckets)).cast("int")
        ),
        "mix-sizes",
    )
    sums = rows.groupBy("mix_key", "mix_source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = (
        sums.groupBy("mix_key", "mix_source")
        .agg(F.sum("bucket_size").alias("source_size"))
        .withColumn("rank_in_order", F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank_in_order") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumnRenamed("mix_source", "source")
    )
    targets = water_fill(per_source, budget_share, max_epochs)
    offsets = (
        sums.withColumn(
            "offset",
            F.coalesce(
                F.sum("bucket_size").over(Window.partitionBy("mix_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .join(targets, "mix_key")
        .select("mix_key", "bucket", "offset", "source_size", "target")
    )
    within = Window.partitionBy("mix_key", "bucket").orderBy("order", "mix_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    return (
        rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["mix_key", "bucket"])
        .withColumn("whole", whole.cast("long"))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), part - F.col("offset") - F.col("ahead"))))
        .select(
            "mix_id",
            "mix_source",
            "size",
            "source_size",
            "target",
            (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
            *[F.col(f"keep_{c}").alias(c) for c in keep],
        )
    )


def repeat_documents(planned: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The mix itself: whole repetitions as rows, a fractional one cut after the words it still gives.

    ``planned`` is :func:`plan_mix` with the text kept. At most one row of each source is cut.
    """
    size, taken = F.col("size"), F.col("taken")
    times = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    words = F.least(size, taken - (F.col("mix_turn") - 1) * size)
    out = (
        planned.filter(times > 0)
        .withColumn("mix_turn", F.explode(F.sequence(F.lit(1), times)))
        .withColumn("mix_words", words)
    )
    bare = F.regexp_replace(F.col(text_col), r"^[\x20\x09-\x0D]+", "")
    prefix = F.array_join(F.slice(F.split(bare, r"[\x20\x09-\x0D]+"), 1, F.col("mix_words").cast("int")), " ")
    text = F.when(F.col("mix_words") >= size, F.col(text_col)).otherwise(prefix)
    out = out.withColumn(text_col, text)
    if n_chars_col:
        out = out.withColumn(n_chars_col, F.when(F.col("mix_words") >= size, F.col(n_chars_col)).otherwise(F.char_length(text_col).cast("long")))
    return out

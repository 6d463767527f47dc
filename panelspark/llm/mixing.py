"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is to be taken `target / source size` times on average. The
whole part of that is allocated for certain; the fraction is the inclusion probability
of one more copy. Documents are ranked by (random odds) / (inclusion odds) and taken in
that order until the words that remain are filled, which gives a sample of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.llm.common import WORD, checkpoint

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bins of the rank axis in which words are summed before any rows are ordered.
BINS = 1 << 14
#: Times that documents are taken in rank order, each time leaving out those that are too long for what is left.
PASSES = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row per source: shares of the total by weight, none above `most` times its size.

    Sources in code-point order, null last, take the weights in turn. The excess of a
    capped source is shared again by weight: sources leave in the order of
    size / weight, so running sums give the final level in one pass over the sources.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    rows = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), weight.alias("weight"))
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, whole = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(W.currentRow, W.unboundedFollowing), W.partitionBy()
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("left", left).withColumn("open", F.sum("weight").over(after))
    rows = rows.withColumn("capped", most * F.col("source_size") * F.col("open") <= F.col("left") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "left", "open"))).over(whole)
    rows = rows.withColumn("level", level)
    target = F.when(F.col("capped"), F.col("source_size") * float(most)).otherwise(F.col("level.left") * F.col("weight").cast("double") / F.col("level.open"))
    return rows.select("source", "source_size", target.alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the key and the seed alone."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 48))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7, importance: str | None = None) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, copies, taken) per document.

    A document's size is its number of words (null text: 0). `importance` names an
    optional positive column that scales a document's inclusion odds within its source
    (null counts as 1); without it all documents of a source share one probability. A
    source takes its documents' whole copies, then one more copy of the documents that
    rank lowest, as far as the target reaches, and of the document that fits what is left best. Null
    sources form one source. Ties in rank (equal or null ids) are broken by doc_id and
    size; repeated rows are documents of their own. Documents without words, and an empty
    table, take nothing. Extra columns are ignored.

    A source of any size is handled: words are summed by rank bin first, and only
    the one bin per source in which the target falls is put in order, in each of PASSES rounds.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    scale = F.coalesce(F.col(importance).cast("double"), F.lit(1.0)) if importance else F.lit(1.0)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    slim = checkpoint(docs.select("doc_id", "source", size.alias("size"), uniform(key, seed).alias("u"), scale.alias("importance")))
    aims = checkpoint(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    state = _rank(_with_source(slim, aims)).withColumn("more", F.lit(False)).withColumn("goal", F.col("extra"))
    for _ in range(PASSES):
        state = checkpoint(_fill(checkpoint(state)))
    # What is left goes to the document whose size comes nearest to it.
    off = F.abs(F.col("goal") - F.col("size"))
    others = state.where(~F.col("more") & (F.col("size") > 0) & (off < F.col("goal")))
    filler = others.groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "size")).alias("filler"))
    placed = _with_source(state, checkpoint(filler))
    is_filler = F.coalesce(~F.col("more") & (F.col("rank") == F.col("filler.rank")) & F.col("doc_id").eqNullSafe(F.col("filler.doc_id")) & (F.col("size") == F.col("filler.size")), F.lit(False))
    # Of equal rows one is enough.
    chosen = placed.where(is_filler).withColumn("nth", F.row_number().over(W.partitionBy("source").orderBy("rank", "doc_id", "size"))).withColumn("more", F.col("nth") == 1)
    decided = placed.where(~is_filler).unionByName(chosen.drop("nth"))
    decided = decided.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more").cast("long")).alias("copies"))
    return decided.withColumn("taken", F.col("copies") * F.col("size"))


def _fill(state: DataFrame) -> DataFrame:
    """Take open documents that fit in rank order while their words stay within the source's goal; lower the goal by them."""
    fits = ~F.col("more") & (F.col("size") > 0) & (F.col("size") <= F.col("goal"))
    per_bin = state.where(fits).groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("goal").alias("goal"))
    along = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # at most BINS rows per source
    per_bin = per_bin.withColumn("upto", F.sum("words").over(along))
    beyond = F.when(F.col("upto") > F.col("goal"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))
    edges = per_bin.groupBy("source").agg(F.min(beyond).alias("edge"))
    placed = _with_source(state, checkpoint(edges)).withColumn("fits", fits)
    at_edge = F.coalesce(F.col("fits") & (F.col("bin") == F.col("edge.bin")), F.lit(False))
    inner = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    inside = placed.where(at_edge).withColumn("more", F.col("edge.before") + F.sum("size").over(inner) <= F.col("goal"))
    outside = placed.where(~at_edge).withColumn("more", F.col("more") | F.coalesce(F.col("fits") & (F.col("edge").isNull() | (F.col("bin") < F.col("edge.bin"))), F.lit(False)))
    taken = inside.unionByName(outside)
    words = taken.where("more and fits").groupBy("source").agg(F.sum("size").alias("words"))
    lowered = _with_source(taken, words).withColumn("goal", F.col("goal") - F.coalesce("words", F.lit(0)))
    return lowered.drop("edge", "fits", "words")


def copies_of(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of `docs`, each repeated as often as `plan` (from `mix`) says; doc_id must be unique and not null."""
    times = plan.where("copies > 0").select("doc_id", F.col("copies").cast("int").alias("__copies"))
    repeated = docs.join(times, "doc_id").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*docs.columns)


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Left join on source where null equals null."""
    other = sources.withColumnRenamed("source", "__source")
    return rows.join(other, rows["source"].eqNullSafe(other["__source"]), "left").drop("__source")


def _rank(rows: DataFrame) -> DataFrame:
    """Whole copies, the words left for single copies, the Pareto rank of every document and its bin."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio).cast("long")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    share = F.when(F.col("source_size") > 0, F.col("extra") / F.col("source_size")).otherwise(0.0)
    odds = F.when(share < 1, share / (1 - share)).otherwise(F.lit(1e18)) * F.col("importance")
    rank = F.when(odds > 0, F.col("u") / (1 - F.col("u")) / odds).otherwise(F.lit(1e18))
    # Folded into (0, 1), so that bins have fixed borders.
    return rows.withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))

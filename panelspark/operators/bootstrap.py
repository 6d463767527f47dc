"""Resampling whole clusters or whole days with reproducible, distributed draws."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.operators.ordered import running
from panelspark.session import checkpoint

PRIME = 2147483647  # fixed value: modulus of the multiplicative generator
BLOCK = 100  # replicates computed together by one task
SLOTS = 1 << 12  # thresholds of a group in one task: at most so many times its days in rows
ROWS = 1 << 13  # of these rows, as many as are multiplied at a time


def draw(replicate: Column, slot: Column, seed: int, size: Column) -> Column:
    """Pseudo-random whole number in [0, size) from (replicate, slot), in plain integer arithmetic any engine repeats."""
    start = (replicate.cast("long") * 1000003 + slot.cast("long") * 7919 + F.lit(seed * 104729)) % PRIME
    once = start * 48271 % PRIME
    return ((once + slot.cast("long") * 65539) % PRIME * 16807 % PRIME) % size


def drawn_slots(replicate: int, slots: np.ndarray, seed: int, size: int) -> np.ndarray:
    """`draw` for all slots of a replicate."""
    start = (replicate * 1000003 + slots * 7919 + seed * 104729) % PRIME
    return ((start * 48271 % PRIME + slots * 65539) % PRIME * 16807 % PRIME) % size


def numbered(units: DataFrame, groups: list[str], unit: str) -> DataFrame:
    """(groups, unit, __i, __size): units counted from 0 in order, and how many their group has."""
    indexed = running(units.select(*groups, unit).distinct().withColumn("__one", F.lit(1)), groups, unit, {"__i": "__one"}, totals=True)
    return indexed.select(*groups, unit, (F.col("__i") - 1).alias("__i"), F.col("__i_total").alias("__size"))


def multiplicities(units: DataFrame, groups: list[str], unit: str, replicates: int, seed: int) -> DataFrame:
    """How often each unit is drawn in each replicate: as many draws as units, with replacement, per group.

    Each unit contributes one slot per replicate, so drawing is spread over tasks
    and the output has at most units x replicates rows.
    """
    indexed = numbered(units, groups, unit)
    slots = indexed.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    drawn = slots.select(*groups, "replicate", draw(F.col("replicate"), F.col("__i"), seed, F.col("__size")).alias("__i"))
    counted = drawn.groupBy(*groups, "replicate", "__i").agg(F.count(F.lit(1)).alias("times"))
    return counted.join(indexed.drop("__size"), [*groups, "__i"]).select(*groups, "replicate", unit, "times")


def cluster_bootstrap(pairs: DataFrame, cluster: str, difference: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Mean difference over rows with a 95 % interval from resampling clusters."""
    sums = pairs.where(F.col(difference).isNotNull()).groupBy(cluster).agg(F.sum(difference).alias("__s"), F.count(F.lit(1)).alias("__c"))
    times = multiplicities(sums, [], cluster, replicates, seed)
    means = times.join(sums, cluster).groupBy("replicate").agg((F.sum(F.col("times") * F.col("__s")) / F.sum(F.col("times") * F.col("__c"))).alias("__m"))
    spread = means.agg(F.percentile("__m", F.lit(0.025)).alias("low"), F.percentile("__m", F.lit(0.975)).alias("high"))  # one value per replicate
    whole = sums.agg((F.sum("__s") / F.sum("__c")).alias("mean"), F.sum("__c").alias("steps"), F.count(F.lit(1)).alias("clusters"))
    return whole.select("mean", "steps", "clusters", spread.select("low").scalar().alias("low"), spread.select("high").scalar().alias("high"))


def replicate_ap(rows: DataFrame, group: str, day: str, y: str, p: str, replicates: int, seed: int) -> DataFrame:
    """Exact average precision of every replicate of each group, ties included: (group, replicate, ap).

    Only scores of positive rows are thresholds. Every other row is folded into
    the highest threshold at or below it, so what meets the replicates has at most
    one row per day and threshold, not one per source row. Replicates are computed in
    blocks and thresholds in pieces: a first pass sums each piece's rows for every replicate of a block, the sums of
    the pieces before it are where a piece starts, and a second pass adds up its part of the
    average precision. So a group of any size is spread over tasks of SLOTS thresholds. A
    replicate without a positive scores 0.
    """
    levels = rows.groupBy(group, p).agg(F.max(F.col(y).cast("int")).alias("__pos"))
    marked = running(levels, [group], p, {"__k": "__pos"}, descending=True)
    slot = F.col("__k") + F.when(F.col("__pos") == 1, 0).otherwise(1)
    daily = rows.groupBy(group, day, p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    folded = daily.join(marked.select(group, p, slot.alias("slot")), [group, p]).groupBy(group, day, "slot").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    met = checkpoint(folded.join(numbered(rows, [group], day), [group, day]))
    blocks = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))))
    piece = F.floor(F.col("slot") / SLOTS).cast("long").alias("piece")
    keys = ["group", "block", "piece"]
    dealt = blocks.select(F.col(group).alias("group"), F.col("block").cast("long").alias("block"), piece, F.col("slot").cast("long").alias("slot"), "n", "pos", F.col("__i").cast("long").alias("i"), F.col("__size").cast("long").alias("size"))
    schema, step, width = dealt.select("group").schema, ROWS, BLOCK

    def times(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The block's replicates, and how often each draws each day."""
        block, size = table.column("block")[0].as_py(), table.column("size")[0].as_py()
        own = np.arange(block * width, min(replicates, (block + 1) * width))
        days = np.arange(size, dtype=np.int64)
        return own, np.column_stack([np.bincount(drawn_slots(r, days, seed, size), minlength=size) for r in own.tolist()])

    def keyed(table: pa.Table, names: list[str], own: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
        heads = table.select(names).take(pa.array(np.zeros(len(own), dtype=np.int64)))
        return pa.table([*heads.columns, pa.array(own), *map(pa.array, columns.values())], names=[*names, "replicate", *columns])

    def total(table: pa.Table) -> pa.Table:
        own, drawn = times(table)
        i, n, pos = (table.column(c).to_numpy() for c in ("i", "n", "pos"))
        by_day = [np.bincount(i, weights=v, minlength=len(drawn)) @ drawn for v in (n, pos)]
        return keyed(table, keys, own, dict(zip(("n", "pos"), by_day)))

    def part(table: pa.Table, start: pa.Table) -> pa.Table:
        own, drawn = times(table)
        start = start.sort_by("replicate")
        order = np.argsort(table.column("slot").to_numpy(), kind="stable")
        slot, n, pos, i = (table.column(c).to_numpy()[order] for c in ("slot", "n", "pos", "i"))
        state = Replicates(start.column("n").to_numpy(), start.column("pos").to_numpy())
        for at in range(0, len(slot), step):
            own_rows = slice(at, at + step)
            state.add(slot[own_rows], n[own_rows], pos[own_rows], drawn[i[own_rows]])
        return keyed(table, ["group"], own, {"ap": state.finish(), "pos": state.pos - start.column("pos").to_numpy()})

    for name in ("block", "piece", "replicate"):
        schema = schema.add(name, "long")
    sums = dealt.groupBy(*keys).applyInArrow(total, schema.add("n", "double").add("pos", "double"))
    before = W.partitionBy("group", "replicate").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "replicate", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("n", "pos")])
    parts = dealt.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInArrow(part, dealt.select("group").schema.add("replicate", "long").add("ap", "double").add("pos", "double"))
    ap = F.when(F.sum("pos") > 0, F.sum("ap") / F.sum("pos")).otherwise(0.0)
    return parts.groupBy("group", "replicate").agg(ap.alias("ap")).withColumnRenamed("group", group)


class Replicates:
    """Running sums of a block of replicates, fed in threshold order from where the thresholds before left them."""

    def __init__(self, n: np.ndarray, pos: np.ndarray) -> None:
        self.n, self.pos, self.ap = n, pos, np.zeros(len(n))
        self.slot, self.open_n, self.open_pos = None, np.zeros(len(n)), np.zeros(len(n))

    def _close(self, n: np.ndarray, pos: np.ndarray) -> None:
        """Rows are successive thresholds."""
        n_upto, pos_upto = self.n + np.cumsum(n, axis=0), self.pos + np.cumsum(pos, axis=0)
        self.ap += np.where(n_upto > 0, pos * pos_upto / np.maximum(n_upto, 1), 0.0).sum(axis=0)
        self.n, self.pos = n_upto[-1], pos_upto[-1]

    def add(self, slot: np.ndarray, n: np.ndarray, pos: np.ndarray, times: np.ndarray) -> None:
        starts = np.concatenate(([0], np.flatnonzero(np.diff(slot)) + 1))
        ns = np.add.reduceat(times * n[:, None], starts, axis=0).astype(float)
        ps = np.add.reduceat(times * pos[:, None], starts, axis=0).astype(float)
        if self.slot == slot[0]:
            ns[0] += self.open_n
            ps[0] += self.open_pos
        elif self.slot is not None:
            self._close(self.open_n[None], self.open_pos[None])
        if len(starts) > 1:
            self._close(ns[:-1], ps[:-1])
        self.slot, self.open_n, self.open_pos = slot[-1], ns[-1], ps[-1]

    def finish(self) -> np.ndarray:
        """The sum of precision over the positives fed."""
        self._close(self.open_n[None], self.open_pos[None])
        return self.ap


def paired_day_bootstrap(rows: DataFrame, group: str, day: str, y: str, scores: dict[str, str], replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Average precision of several models per replicate, on the same resampled days: (group, replicate, ap_<model>...)."""
    table = None
    for model, p in scores.items():
        part = replicate_ap(rows, group, day, y, p, replicates, seed).withColumnRenamed("ap", f"ap_{model}")
        table = part if table is None else table.join(part, [group, "replicate"])
    return table


def bootstrap_interval(replicates: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """Unweighted mean over groups per replicate, then the difference with its 95 % interval and win shares."""
    means = replicates.groupBy("replicate").agg(F.avg(second).alias("b"), F.avg(first).alias("a")).withColumn("d", F.col("b") - F.col("a"))
    share = lambda c: F.avg(c.cast("double"))
    return means.agg(
        F.avg("d").alias("mean_delta"), F.percentile("d", F.lit(0.5)).alias("median_delta"), F.stddev_samp("d").alias("standard_error"),
        F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"),
        share(F.col("d") > 0).alias("share_better"), share(F.col("d") < 0).alias("share_worse"), share(F.col("d") == 0).alias("share_tied"),
    )

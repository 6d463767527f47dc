"""Helpers shared by the operators: tables in the shared folder, word hashing, grouped Arrow streams, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.session import checkpoint, shared_folder

__all__ = ["Scratch", "checkpoint", "components", "let", "powers", "shared_folder", "slices", "whole_groups", "word_hashes", "WORD"]

#: A word: a maximal run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd multipliers of the polynomial hashes modulo 2**64 (any odd numbers with well mixed bits serve).
BASE, SECOND, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
_tables: dict[int, np.ndarray] = {}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it; the expression holds it once, too."""
    return F.transform(F.array(value), body)[0]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown per worker."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 17), base, dtype=np.uint64)
        steps[0] = 1
        have = _tables[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix_hash(data: np.ndarray, base: int) -> np.ndarray:
    """H[i] = sum of data[j] * base**j over j < i, modulo 2**64 (length n + 1)."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of data[start:end] for arrays of slices, equal for equal bytes wherever they stand."""
    inverse = powers(pow(base, -1, 1 << 64), len(prefix))
    return mixed((prefix[end] - prefix[start]) * inverse[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def word_hashes(lowered: bytes) -> np.ndarray:
    """One 64-bit hash per word of a byte string."""
    data = np.frombuffer(lowered, dtype=np.uint8)
    edges = np.empty(len(data) + 2, dtype=np.int8)
    edges[0] = edges[-1] = 0
    np.logical_not(_SPACE[data], out=edges[1:-1].view(bool))
    change = np.diff(edges)
    return slice_hash(prefix_hash(data, BASE), np.flatnonzero(change == 1), np.flatnonzero(change == -1), BASE)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of `size` consecutive words; a shorter text has one for its whole sequence, an empty one none."""
    if not len(words):
        return words
    size = min(size, len(words))
    last = len(words) - size + 1
    out = words[:last].copy()
    for k in range(1, size):
        out = out * np.uint64(SECOND) + words[k : k + last]
    return mixed(out)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, empty for null."""
    for value in batch.column(column).cast(pa.binary()).to_pylist():
        yield value or b""


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream sorted by `keys` (integers) into tables of whole groups, with the first row of each group and the end.

    No more than one group beyond `least` rows is held at a time.
    """
    held: list[pa.Table] = []
    rows = 0

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            values = table.column(k).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(held).combine_chunks()
        first = starts(table)
        cut = int(first[-1])
        held, rows = [table.slice(cut)], table.num_rows - cut
        if cut:
            yield table.slice(0, cut), np.append(first[:-1], cut)
    if held:
        table = pa.concat_tables(held).combine_chunks()
        yield table, np.append(starts(table), table.num_rows)


class Scratch:
    """Written intermediate tables that can be dropped once what was built from them is written."""

    def __init__(self, spark) -> None:
        self.spark, self.places = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, "scratch")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.places[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables, and let Spark clean up shuffles that nothing refers to any more."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.places.pop(id(table))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that occurs in `edges` (a, b long): the smallest node of its connected component.

    Large-star and small-star steps alternate; each makes the graph flatter, so the
    rounds grow with the logarithm of the longest chain. Every round is written to the
    shared folder, which cuts the lineage. A star's centre may have any number of
    leaves: its minimum is pre-aggregated and the join that returns it can be split.
    """

    def least(pairs: DataFrame) -> DataFrame:
        lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(lowest, "u")

    pairs = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        pairs = checkpoint(small.where("u <> v").distinct())
        # Done when no centre is a leaf and no leaf has two centres.
        inner = pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        double = pairs.groupBy("u").count().where("count > 1").select("u")
        if inner.unionByName(double).isEmpty():
            break
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

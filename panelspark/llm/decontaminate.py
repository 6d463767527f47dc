"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item of n distinct shingles is contained in a document when at least
ceil(threshold * n) of them occur there. So whatever the document's length, at least
one of any n - ceil(threshold * n) + 1 chosen item shingles must occur: the sketch of an
item is that many of its smallest hash values. Items of like size share a partition with
one sketch size, so the search compares a short item with a long document without
converting containment to a Jaccard threshold, and misses nothing. Documents are
streamed once against the sketches; hits are verified on the words themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import WORD, shingle_hashes, texts_of, word_hashes

#: UTF-8 bytes of item texts that one pass over the documents holds in memory; more items take more passes.
ITEM_BYTES = 64 << 20
#: Words that an item needs before `clean` drops documents for it: shorter ones stand in ordinary text.
LEAST_WORDS = 8
PAIRS = "doc_id long, item_id long, shared long, shingles long, containment double"


def shingles(words: list[bytes], size: int) -> set[bytes]:
    size = min(size, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


class Sketches:
    """The items of one pass: their shingles as text, and the sketch hashes by size partition."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, threshold: float) -> None:
        self.size, self.threshold = size, threshold
        self.items: list[tuple[int, int, frozenset[bytes]]] = []
        by_class: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item_id, text in items:
            words = text.lower().split()
            if words:
                grams = shingles(words, size)
                by_class[min(size, len(words)), int(math.log2(len(grams)))].append(len(self.items))
                self.items.append((item_id, min(size, len(words)), frozenset(grams)))
        entries: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for (width, _), members in by_class.items():
            # One sketch size per partition: enough for its largest item.
            keep = max(len(self.items[i][2]) - math.ceil(threshold * len(self.items[i][2]) - 1e-9) + 1 for i in members)
            for i in members:
                hashes = np.unique(np.concatenate([shingle_hashes(word_hashes(g), width) for g in self.items[i][2]]))
                entries[width] += [(int(h), i) for h in hashes[:keep]]
        self.tables = {}
        for width, found in entries.items():
            found.sort()
            self.tables[width] = np.array([h for h, _ in found], dtype=np.uint64), np.array([i for _, i in found])
        self.seen = {w: self._bitmap(h) for w, (h, _) in self.tables.items()}

    @staticmethod
    def _bitmap(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, dtype=bool)
        bits[hashes >> np.uint64(44)] = True
        return bits

    def search(self, text: bytes) -> Iterator[tuple[int, int, int, float]]:
        """(item, shared, of, containment) of the items that `text` contains."""
        lowered = text.lower()
        hashes, found = word_hashes(lowered), set()
        for width, (table, owner) in self.tables.items():
            if len(hashes) < width:
                continue
            grams = shingle_hashes(hashes, width)
            grams = np.unique(grams[self.seen[width][grams >> np.uint64(44)]])
            low, high = np.searchsorted(table, grams, "left"), np.searchsorted(table, grams, "right")
            for a, b in zip(low[high > low], high[high > low]):
                found.update(owner[a:b].tolist())
        if found:
            words = lowered.split()
            own = {w: shingles(words, w) for w in {self.items[i][1] for i in found}}
            for i in sorted(found):
                item_id, width, grams = self.items[i]
                shared = len(grams & own[width])
                if shared >= self.threshold * len(grams) - 1e-9:
                    yield item_id, shared, len(grams), shared / len(grams)


def passes(benchmark: DataFrame, size: int, threshold: float, item_bytes: int) -> Iterator[Sketches]:
    """The items in as many bounded sets as their bytes ask for; sets without items are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = 1 + int(total) // item_bytes * 2
    for k in range(number):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k)
        sketches = Sketches([(r.item_id, r.text.encode()) for r in part.collect()], size, threshold)  # bounded by item_bytes
        if sketches.items:
            yield sketches


def clean(docs: DataFrame, benchmark: DataFrame, *, size: int = 5, threshold: float = 0.8, item_bytes: int = ITEM_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of `docs` that contain no item to `threshold` (see `contaminated`), with all their columns; nothing is shuffled.

    Items of fewer than `least_words` words, null and empty ones included, drop nothing: an answer of one word would
    take most of a corpus with it. `contaminated` reports them all the same. Null and empty texts are kept.
    """
    telling = benchmark.where(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)) >= least_words)
    for sketches in passes(telling, size, threshold, item_bytes):

        def keep(batches: Iterator[pa.RecordBatch], sketches: Sketches = sketches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([next(sketches.search(t), None) is None for t in texts_of(batch)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, *, size: int = 5, threshold: float = 0.8, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row (doc_id, item_id, shared, shingles, containment) per document and item it contains to `threshold` or more.

    Shingles are `size` consecutive words (split at ASCII white space, A-Z lower-cased);
    an item of fewer words is one shingle of all its words, an item without words matches
    nothing, a null text is empty. Rows with null ids keep the null; repeated document
    rows repeat their pairs; items with equal ids are searched one by one. Extra columns are ignored.
    The items of a pass are at most `item_bytes` of text on the driver and in each task;
    a larger benchmark takes more passes over the documents.
    """
    corpus = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found: list[DataFrame] = []
    for sketches in passes(benchmark, size, threshold, item_bytes):

        def search(batches: Iterator[pa.RecordBatch], sketches: Sketches = sketches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(d, *hit) for d, text in zip(ids, texts_of(batch)) for hit in sketches.search(text)]
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "shared", "shingles", "containment"])

        found.append(corpus.mapInArrow(search, PAIRS))
    if not found:
        return docs.sparkSession.createDataFrame([], PAIRS)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out

"""Suffix-array dedup by a depth-limited radix sort: repeated byte windows of a fixed length.

Suffixes are ordered only through their first `window` bytes, most significant digit
first, and a group of one leaves after any pass. The digits of a window are read in an order that
starts at its anchor, the `gram` bytes with the smallest hash in it (the leftmost of equal
ones): equal windows have equal anchors at equal places, so this reorders the digits
of all equal windows alike, and consecutive windows with one anchor - a run - share
their first digits. Passes:

1. the anchor's gram: a gram that occurs once has no repeated window;
2. the bytes around it that a run's windows cover together: runs that agree in these
   agree in every window, and all their windows repeat;
3. for grams whose runs differ, in one run per distinct content: the bytes that the windows
   of a block have in common; a block whose common bytes occur once has no repeated window;
4. the remaining digits of the single windows of the blocks left; equal windows of
   different runs repeat.

Digits are compared as 64-bit hashes within the group of the digits before. Each pass
counts per digit, combined before the shuffle, so a passage shared by any number of
documents costs one row per task. About one run per (window - gram) / 2 bytes is sorted
instead of every suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import BASE, SECOND, Scratch, mixed, prefix_hash, slice_hash, slices

WINDOW, GRAM = 200, 80
#: Windows per block of the third pass.
BLOCK = 16
#: Low bits of the selection key that hold a position; longer texts are anchored in overlapping pieces.
PLACE = 24
PIECE = (1 << PLACE) - (1 << 16)


def runs(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor hash, content hash) of each run of windows with one anchor; window starts are inclusive."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) < window:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    prefix = prefix_hash(data, BASE)
    at = np.arange(len(data) - gram + 1)
    grams = slice_hash(prefix, at, at + gram, BASE)
    starts, span = [], window - gram + 1
    for low in range(0, len(data) - window + 1, PIECE):
        part = grams[low : min(low + PIECE, len(data) - window + 1) + span - 1]
        key = (part >> np.uint64(PLACE)) << np.uint64(PLACE) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < span:
            key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
        starts.append((key & np.uint64((1 << PLACE) - 1)).astype(np.int64) + low)
    anchor = np.concatenate(starts)
    change = np.flatnonzero(np.diff(anchor)) + 1
    first, last = np.concatenate(([0], change)), np.concatenate((change - 1, [len(anchor) - 1]))
    own = anchor[first]
    # The place of the anchor belongs to the content: it fixes which windows the run has.
    content = slice_hash(prefix_hash(data, SECOND), first, last + window, SECOND)
    content ^= ((own - first) << 32 | (last - first)).astype(np.uint64) * np.uint64(BASE)
    return first, last, grams[own].view(np.int64), content.view(np.int64)


def _with_key(docs: DataFrame) -> DataFrame:
    """Texts keyed by two hashes of their content, so that ids may be null or repeated."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), F.col("text"))})


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(t1, t2, spans) per distinct text with repeated windows: spans are array<struct<start, stop>>, covered bytes.

    t1 and t2 are the text's key (see `_with_key`); overlapping spans are not merged here.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _with_key(docs)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [runs(t or b"", window, gram) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            offsets = pa.array(np.cumsum([0] + [len(f[0]) for f in found]), pa.int32())
            columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(4)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c, k)) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), *lists], ["t1", "t2", "first", "last", "gram", "content"])

    kinds = "t1 long, t2 long, first array<int>, last array<int>, gram array<long>, content array<long>"
    table = scratch.keep(texts.select("text", "t1", "t2").mapInArrow(anchored, kinds))
    flat = table.select("t1", "t2", F.explode(F.arrays_zip("first", "last", "gram", "content")).alias("r")).select("t1", "t2", "r.*")

    # Passes 1 and 2: occurrences per content, distinct contents per gram.
    contents = flat.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("n"))
    kinds_of = contents.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("fewest"), F.max("n").alias("most"))
    kinds_of = kinds_of.where("kinds > 1 or most > 1").select("gram", ((F.col("kinds") > 1) & (F.col("fewest") == 1)).alias("mixed"))
    alive = scratch.keep(contents.join(kinds_of, "gram").select("gram", "content", (F.col("n") > 1).alias("repeats"), "mixed"))
    scratch.drop()
    hits = scratch.keep(flat.join(alive, ["gram", "content"]))
    scratch.drop(table, alive)

    # The bytes of one run per content of the mixed grams.
    chosen = hits.where("mixed").groupBy("gram", "content", "repeats").agg(F.min(F.struct("t1", "t2", "first", "last")).alias("at"))
    asked = chosen.select("at.*", "gram", "content", "repeats").groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last", "gram", "content", "repeats")).alias("asked"))
    wanted = texts.join(asked, ["t1", "t2"]).select("text", "asked", "t1", "t2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names = ["gram", "content", "repeats", "bytes"]
        for batch in slices(batches):
            rows = []
            for text, a, b, runs_of in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("asked").to_pylist()):
                if (a, b) not in seen:  # else a copy in the same task
                    seen.add((a, b))
                    rows += [(r["gram"], r["content"], r["repeats"], text[r["first"] : r["last"] + window]) for r in runs_of]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names)

    pieces = scratch.keep(wanted.mapInArrow(cut, "gram long, content long, repeats boolean, bytes binary"))
    scratch.drop()

    # Pass 3: blocks of windows. Without its common bytes elsewhere none of a block's windows repeats.
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = _joined(batch.column("bytes"))
            prefix = prefix_hash(data, SECOND)
            count = np.diff(bounds) - window + 1
            # Blocks are aligned to the run's first window, which equal runs of other contents may lack, so to the anchor.
            anchor = _anchors(data, bounds, gram, window)
            low, high = (anchor - count + 1) // BLOCK, anchor // BLOCK
            number = high - low + 1
            row = np.repeat(np.arange(len(number)), number)
            block = np.repeat(low, number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
            at = bounds[:-1][row] + anchor[row]
            core = slice_hash(prefix, at - block * BLOCK, at - block * BLOCK - BLOCK + 1 + window, SECOND)
            core = mixed(core + block.astype(np.uint64) * np.uint64(BASE))
            content = batch.column("content").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(content), pa.array(block.astype(np.int32)), pa.array(core.view(np.int64))], ["content", "block", "core"])

    # The common bytes hold the gram, so they are a key by themselves; equal keys only select what pass 4 compares.
    parts = pieces.select("content", "bytes").mapInArrow(blocks, "content long, block int, core long")
    # Copies of a text may repeat their rows, so distinct contents count (a run has each window once).
    cores = parts.groupBy("core").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select("core")
    left = parts.join(cores, "core", "left_semi").groupBy("content").agg(F.collect_set("block").alias("blocks"))

    # Pass 4: the single windows of the blocks that remain.
    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = _joined(batch.column("bytes"))
            prefix = prefix_hash(data, SECOND)
            anchor = _anchors(data, bounds, gram, window)
            count = np.diff(bounds) - window + 1
            lists = batch.column("blocks")
            ends = lists.offsets.to_numpy()
            row = np.repeat(np.arange(len(count)), np.diff(ends))
            block = lists.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
            # Window starts, relative to the run, of each block: anchor - offset.
            low = np.maximum(anchor[row] - block * BLOCK - BLOCK + 1, 0)
            high = np.minimum(anchor[row] - block * BLOCK, count[row] - 1)
            number = np.maximum(high - low + 1, 0)
            each = np.repeat(row, number)
            at = np.repeat(low, number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
            digits = slice_hash(prefix, bounds[:-1][each] + at, bounds[:-1][each] + at + window, SECOND)
            columns = [batch.column(k).to_numpy(zero_copy_only=False)[each] for k in ("gram", "content", "repeats")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(digits.view(np.int64)), pa.array(at.astype(np.int32))], ["gram", "content", "repeats", "digits", "at"])

    windows = pieces.join(left, "content").mapInArrow(single, "gram long, content long, repeats boolean, digits long, at int")
    windows = scratch.keep(windows)
    scratch.drop(pieces)
    counted = windows.groupBy("gram", "digits").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    equal = counted.where("low <> high").select("gram", "digits")
    found = windows.where(~F.col("repeats")).join(equal, ["gram", "digits"], "left_semi")
    found = found.groupBy("gram", "content").agg(F.collect_set("at").alias("offsets"))

    whole = hits.where("repeats").select("t1", "t2", "first", F.col("last").alias("until"))
    partly = hits.where("mixed and not repeats").join(found, ["gram", "content"]).select("t1", "t2", "first", F.explode("offsets").alias("o"))
    partly = partly.select("t1", "t2", (F.col("first") + F.col("o")).alias("first"), (F.col("first") + F.col("o")).alias("until"))
    spans = whole.unionByName(partly).select("t1", "t2", F.struct(F.col("first").alias("start"), (F.col("until") + window).alias("stop")).alias("span"))
    out = scratch.keep(spans.groupBy("t1", "t2").agg(F.collect_set("span").alias("spans")))
    scratch.drop(windows, hits)
    return out


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each value starts."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]] if len(column) else np.zeros(0, dtype=np.uint8)
    return data, bounds - bounds[0]


def _anchors(data: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Place of the anchor in each run: in all its windows, so the smallest key of the places all of them have."""
    prefix = prefix_hash(data, BASE)
    at = np.arange(len(data) - gram + 1)
    key = slice_hash(prefix, at, at + gram, BASE) >> np.uint64(PLACE)
    # All windows of the run have the grams from its last window's start to its first window's end.
    low, high = bounds[1:] - window, bounds[:-1] + window - gram + 1
    key = np.append(key, ~np.uint64(0))  # a bound may lie one past the end
    best = np.minimum.reduceat(key, np.column_stack([low, high]).ravel())[::2] if len(low) else key[:0]
    number = high - low
    row = np.repeat(np.arange(len(number)), number)
    place = np.repeat(low, number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    hit = np.flatnonzero(key[place] == best[row])
    _, first = np.unique(row[hit], return_index=True)
    return place[hit[first]] - bounds[:-1]


def removed(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) per document.

    Every byte covered by a `window`-byte string that also starts anywhere else in the
    table (same document included, overlaps count) is removed; strings are judged on the
    input. `spans` are the maximal removed byte runs, `kept` the remaining bytes, which
    need not be valid UTF-8. Null texts are empty; null and repeated ids and repeated rows are
    kept as they are; texts shorter than `window` lose nothing. Extra columns are ignored.
    """
    spans = repeated_spans(docs, window=window, gram=gram)
    joined = _with_key(docs).join(spans, ["t1", "t2"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans")):
                if found.is_valid:
                    starts, stops = (found.values.field(k).to_numpy().astype(np.int64) for k in range(2))
                    order = np.argsort(starts, kind="stable")
                    starts, reach = starts[order], np.maximum.accumulate(stops[order])
                    new = np.concatenate(([True], starts[1:] > reach[:-1]))
                    low, high = starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
                else:
                    low = high = np.zeros(0, dtype=np.int64)
                edges = [0, *np.column_stack([low, high]).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                merged = [{"start": a, "stop": b} for a, b in zip(low.tolist(), high.tolist())]
                rows.append((doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), merged, kept))
            columns = list(zip(*rows)) or [()] * 7
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary"
    return joined.mapInArrow(cut, out)

"""SimHash near-duplicates: fingerprints, pigeonring search for close pairs, groups.

Two fingerprints within `distance` bits, cut into m segments that form a ring, have a
segment from which every chain of l consecutive segments differs in at most
floor(l * distance / m) bits. With 4 segments and 3 bits a chain starts with an equal
segment, and its first two segments differ in at most one bit. A fingerprint is filed
under its first two segments at each of the 4 starts and also visits the files that differ
in one bit of the second segment, so every close pair meets in a file of 32 equal
bits; longer chains prune what meets there before the full Hamming check.

For a similarity too low for this guarantee (many differing bits), documents are filed
under the first shingles of their sets instead: in any fixed order of all shingles, two sets
with Jaccard s or more share one of their first n - ceil(s * n) + 1, n the size of the set. Frequent
shingles come last in that order, so that the many texts with a common line don't meet in its files.
Wide fingerprints leave out the distant pairs that meet there, and the groups that remain
are taken apart by the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from panelspark.llm.common import BASE, SECOND, checkpoint, components, mixed, prefix_hash, shingle_hashes, slice_hash, slices, texts_of, whole_groups
from panelspark.session import parts_for

SEED = 42
#: A file with more members is cut into blocks, and pairs of blocks go to tasks of their own.
BLOCK = 1 << 15
#: Up to this many members all pairs are compared at once; beyond it a spanning forest is searched.
FEW = 12
#: Candidates whose sets have more shingles together are cut into blocks of about this many (8 bytes each).
SHINGLES = 1 << 21
#: One text in so many tells which shingles are frequent: at most COMMON of them, from LEAST repeats on, counted in parts of about PART.
TOLD, COMMON, LEAST, PART = 8, 1 << 18, 3, 1 << 22
#: Hashes, with their sets, that are packed and that meet in a task (16 bytes each).
BUCKET = 1 << 19
#: Bits of the bit maps of nodes and of frequent shingles: nodes without a candidate are dropped before their sets are shuffled.
FILTER_BITS = 1 << 23


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LOWEST = np.uint64(0x0101010101010101)
#: Blanks for ASCII white space, lower case for A-Z; and whether a byte of that is part of a word.
_PLAIN = bytes(0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c + 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))
_WORDS = bytes(c != 0x20 for c in range(256))
#: Bytes of text that are worked on at once, so that the arrays stay in a core's cache.
AT_ONCE = 1 << 16


class Words:
    """The words of several texts, split at ASCII white space and A-Z lower-cased: `data` has them with single
    blanks between, from `start` to `stop`; those of text i are numbered from first[i] to first[i + 1]."""

    def __init__(self, texts: list[bytes]) -> None:
        padded = b"".join((b" ", b" ".join(texts), b" " * 40)).translate(_PLAIN)
        self.data, known = np.frombuffer(padded, dtype=np.uint8), np.frombuffer(padded.translate(_WORDS), dtype=np.int8)
        change = np.diff(known)
        self.start, self.stop = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
        places = np.cumsum([1, *[len(t) + 1 for t in texts]])
        self.first = np.searchsorted(self.start, places)
        if (self.start[1:] - self.stop[:-1] > 1).any():
            keep = known.astype(bool)
            keep[1:] |= keep[:-1].copy()
            keep[-40:] = True
            moved = np.cumsum(keep) - 1
            self.data, self.start, self.stop = self.data[keep], moved[self.start], moved[self.stop]

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and the word after the last of all runs of `size` words, text by text (a shorter text has its whole sequence), and where each text's runs begin."""
        words = np.diff(self.first)
        count = np.where(words < size, np.minimum(words, 1), words - size + 1)
        begin = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(begin[-1]) + np.repeat(self.first[:-1] - begin[:-1], count)
        return at, at + np.repeat(np.minimum(words, size), count), begin

    def digests(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """XXH64 of the shingles of `size` words, text by text with repeats, and where each text's begin."""
        at, end, begin = self.runs(size)
        return xxh64(self.data, self.start[at], self.stop[end - 1] - self.start[at]), begin

    def sets(self, size: int) -> list[np.ndarray]:
        """`shingle_set` of each text."""
        words = slice_hash(prefix_hash(self.data, BASE), self.start, self.stop, BASE)
        out, last = words[: max(0, len(words) - size + 1)].copy(), max(0, len(words) - size + 1)
        for k in range(1, size):
            out *= np.uint64(SECOND)
            out += words[k : k + last]
        out, found = mixed(out), []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            one = np.sort(out[a : b - size + 1] if b - a >= size else shingle_hashes(words[a:b], size))
            found.append(one[np.concatenate(([True], one[1:] != one[:-1]))] if len(one) else one)
        return found


def together(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The texts in lists of about AT_ONCE bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 64
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 (seed SEED) of each slice of `data`, which has 40 bytes or more behind the last slice.

    Slices of up to 31 bytes, the most part, are hashed side by side in order of length, longer ones one by one.
    """
    out = np.empty(len(start), dtype=np.uint64)
    long = np.flatnonzero(length > 31)
    if len(long):
        whole, digest = data.tobytes(), xxhash.xxh64_intdigest
        out[long] = np.array([digest(whole[a : a + n], SEED) for a, n in zip(start[long].tolist(), length[long].tolist())], dtype=np.uint64)
    order = np.argsort(np.minimum(length, 32).astype(np.uint8), kind="stable")[: len(start) - len(long)]
    at, size = start[order], length[order]
    place = np.searchsorted(size, np.arange(33))
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).copy()
    h = size.astype(np.uint64) + np.uint64((SEED + int(_P5)) % (1 << 64))
    for k in range(3):
        own = slice(place[8 * k + 8], None)
        h[own] = _turned(h[own] ^ _turned(eight[at[own] + 8 * k] * _P2, 31) * _P1, 27) * _P1 + _P4
    rest = eight[at + (size & ~7)]
    for k in range(8):
        if k % 2:
            own = slice(place[4 * k], place[4 * k + 4])
            h[own] = _turned(h[own] ^ (rest[own] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
            rest[own] >>= np.uint64(32)
        for n in range(1, 4):
            own = slice(place[4 * k + n], place[4 * k + 4])
            h[own] = _turned(h[own] ^ (rest[own] & np.uint64(0xFF)) * _P5, 11) * _P1
            rest[own] >>= np.uint64(8)
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    out[order] = h ^ (h >> np.uint64(32))
    return out


def majorities(hashes: np.ndarray, begin: np.ndarray, lanes: int) -> np.ndarray:
    """(texts, lanes) words of 64 bits: a bit is set if more than half of the text's hashes, from begin[i] to begin[i + 1], set it.

    Lanes after the first take hashes mixed from these; a text without hashes has zeros. Bits of up to 255 hashes
    are added side by side in the bytes of one word.
    """
    count = np.diff(begin)
    out, own = np.zeros((len(count), lanes), dtype=np.uint64), np.flatnonzero(count)
    if not len(own):
        return out
    pieces = -(-count[own] // 255)
    at = np.cumsum(pieces) - pieces
    starts = np.repeat(begin[:-1][own] - 255 * at, pieces) + 255 * np.arange(pieces.sum())
    for lane in range(lanes):
        own_hashes = hashes if not lane else mixed(hashes + np.uint64((lane * 0x9E3779B97F4A7C15) % (1 << 64)))
        bits = np.empty((len(own), 8, 8), dtype=bool)
        for k in range(8):
            sums = np.add.reduceat((own_hashes >> np.uint64(k)) & _LOWEST, starts).view(np.uint8).reshape(-1, 8)
            bits[:, :, k] = np.add.reduceat(sums, at, axis=0, dtype=np.int64) * 2 > count[own, None]
        out[own, lane] = np.packbits(bits.reshape(len(own), 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def votes(text: bytes, size: int, lanes: int) -> np.ndarray:
    """`lanes` words of 64 bits: a bit is set if more than half of the shingles' hashes (repeats included) set it."""
    return majorities(*Words([text]).digests(size), lanes)[0]


def fingerprints(docs: DataFrame, *, words: int = 3, bits: int = 64, label: F.Column | None = None) -> DataFrame:
    """(label, f0, f1, ...) per document: `bits` / 64 longs, the first with bits 0-63; `label` defaults to doc_id.

    Words are split at ASCII white space and A-Z lower-cased; a text of fewer words has
    one shingle, a text without words (or null) fingerprint zero. Rows keep null and
    repeated ids; extra columns are ignored.
    """
    lanes = bits // 64
    names = [f"f{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majorities(*Words(t).digests(words), lanes) for t in together(texts_of(batch))]
            found = np.concatenate([np.zeros((0, lanes), dtype=np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(found[:, k]) for k in range(lanes)]], ["label", *names])

    slim = docs.select((F.col("doc_id").cast("long") if label is None else label).alias("label"), F.col("text").cast("string").alias("text"))
    schema = slim.select("label").schema
    for n in names:
        schema = schema.add(n, "long")
    return slim.mapInArrow(run, schema)


def _segment(column: F.Column, k: int) -> F.Column:
    return F.shiftrightunsigned(column, 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))


def ring_keys(column: str = "f0") -> F.Column:
    """Files of a 64-bit fingerprint for 3 bits: array of (key, home)."""
    f, files = F.col(column), []
    single = F.array(*[F.lit(1 << b).cast("long") for b in range(16)])

    def start(k: int) -> list[F.Column]:
        first, second = _segment(f, k), _segment(f, k + 1)
        base = F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(first, 16))
        own = F.array(F.struct(base.bitwiseOR(second).alias("key"), F.lit(True).alias("home")))
        # Only towards the larger second segment, so a pair that differs in one bit there meets once.
        up = F.filter(single, lambda bit: second.bitwiseAND(bit) == 0)
        return [own, F.transform(up, lambda bit: F.struct(base.bitwiseOR(second.bitwiseOR(bit)).alias("key"), F.lit(False).alias("home")))]

    for k in range(4):
        files += start(k)
    return F.concat(*files)


def ring_viable(keys: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether the chains that start at the file's segment stay within floor(3 l / 4) bits for l = 1, 2, 3."""
    start = (keys >> 32).astype(np.uint64)
    total, ok = np.zeros(len(keys), dtype=np.int64), np.ones(len(keys), dtype=bool)
    lane = differ[:, 0]
    for chain in range(1, 4):
        shift = ((start + np.uint64(chain - 1)) % np.uint64(4)) * np.uint64(16)
        total += np.bitwise_count((lane >> shift) & np.uint64(0xFFFF))
        ok &= total <= 3 * chain // 4
    return ok


def ring_files(prints: DataFrame) -> DataFrame:
    """(node, f0, key, home) rows for `links` of 64-bit fingerprints at 3 bits."""
    # Dealt out before each becomes 68 rows: so few bytes would stay in a few tasks.
    dealt = prints.select("node", "f0").repartition(parts_for(prints), "node")
    return dealt.select("node", "f0", F.explode(ring_keys("f0")).alias("file")).select("node", "f0", "file.key", "file.home")


def prefix_files(prints: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """(node, names, key, home) rows: each shingle set under its first hashes (see `set_prints`).

    Every pair of sets with the Jaccard similarity that those were taken for shares a file. Files of one set, most
    of them, are left out: hashes and sets travel packed, BUCKET of them a task or a few times that, and only the rest become rows.
    """
    total = nodes.agg(F.sum(F.col("keys"))).first()[0] or 0
    buckets = -(-total // BUCKET) or 1

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, node = (np.concatenate(x) for x in zip(*held))
        own = key.view(np.uint64) % np.uint64(buckets)
        order = np.argsort(own, kind="stable")
        key, node, (own, at) = key[order], node[order], np.unique(own[order], return_index=True)
        parts = [pa.array([x.tobytes() for x in np.split(values, at[1:])], pa.binary()) for values in (key, node)]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *parts], ["bucket", "key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, rows = set(), [], 0
        for batch in slices(batches):
            node, keys, new = batch.column("node").to_numpy(), batch.column("keys"), np.zeros(batch.num_rows, dtype=bool)
            for i, name in enumerate(node.tolist()):
                if name not in seen:
                    seen.add(name)
                    new[i] = True
            keys, node = keys.filter(pa.array(new)), node[new]
            held.append((keys.flatten().to_numpy(), np.repeat(node, np.diff(keys.offsets.to_numpy()))))
            rows += len(held[-1][0])
            if rows >= BUCKET:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for own, key, node in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(own, []).append((key, node))
        while held:
            key, node = (np.frombuffer(b"".join(x), dtype=np.int64) for x in zip(*held.popitem()[1]))
            order = np.argsort(key)
            key, node = key[order], node[order]
            equal = key[1:] == key[:-1]
            several = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
            key, node = key[several], node[several]
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))[: len(key)]
            key, node = key[new], node[new]
            equal = key[1:] == key[:-1]
            several = (np.concatenate(([False], equal)) | np.concatenate((equal, [False])))[: len(key)]
            yield pa.RecordBatch.from_arrays([pa.array(key[several]), pa.array(node[several])], ["key", "node"])

    filed = prints.select("node", "keys").mapInArrow(run, "bucket long, key binary, node binary")
    filed = checkpoint(filed.repartition(buckets, "bucket").mapInArrow(shared, "key long, node long"))
    return filed.join(nodes.select("node", *names), "node").withColumn("home", F.lit(True))


def links(filed: DataFrame, names: list[str], distance: int, viable: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(a, b) of nodes whose fingerprints differ in at most `distance` bits and meet in a file.

    `filed` has a row (node long, `names`, key, home) per distinct fingerprint and file it
    is in or visits; only files that are someone's home count. Per file the links
    found connect exactly the members that are connected by close pairs: of a large file
    only a spanning forest is returned, so copies never expand into all pairs. Files
    beyond BLOCK members are cut into blocks, compared pair by pair of blocks.
    """
    large = filed.where("home").groupBy("key").count().where(F.col("count") > BLOCK)
    # Written, so that Spark sees how few they are before it chooses the join.
    large = checkpoint(large.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    filed = filed.join(large, "key", "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    across = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))
    pairs = pairs.when(F.col("home"), F.transform(across, lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y"))))
    pairs = pairs.otherwise(F.transform(across, lambda j: F.struct(j.alias("x"), j.alias("y"))))
    dealt = filed.withColumn("cell", F.explode(pairs)).select("key", "cell.x", "cell.y", "home", "node", *names)
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, ["key", "x", "y"]):
            key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
            prints = np.column_stack([table.column(n).to_numpy() for n in names]).view(np.uint64)
            home = np.add.reduceat(table.column("home").to_numpy(zero_copy_only=False).astype(np.int64), first[:-1])
            sizes = np.diff(first)
            a, b = [], []
            use = (sizes > 1) & (home > 0)
            few = use & (sizes <= FEW)
            last = np.repeat(np.where(few, first[1:], 0), sizes)
            rows = np.flatnonzero(last)
            for lag in range(1, FEW):
                rows = rows[rows + lag < last[rows]]
                if not len(rows):
                    break
                left, right = rows, rows + lag
                differ = prints[left] ^ prints[right]
                if viable is not None:
                    ok = viable(key[left], differ)
                    left, right, differ = left[ok], right[ok], differ[ok]
                ok = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= distance
                a.append(node[left[ok]])
                b.append(node[right[ok]])
            for g in np.flatnonzero(use & ~few):
                for left, right in forest(prints[first[g] : first[g + 1]], distance):
                    a.append(node[first[g] + left])
                    b.append(node[first[g] + right])
            a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def forest(prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (as arrays of row numbers) of a spanning forest of the close pairs among the rows.

    Breadth first: every row is compared once with the rows not yet reached.
    """
    waiting, rest = np.arange(len(prints)), np.ascontiguousarray(prints.T)
    while len(waiting):
        queue, waiting, rest = [int(waiting[0])], waiting[1:], rest[:, 1:]
        while queue and len(waiting):
            at = queue.pop()
            differ = np.zeros(len(waiting), dtype=np.uint16)
            for lane, own in zip(rest, prints[at]):
                differ += np.bitwise_count(lane ^ own)
            near = differ <= distance
            if near.any():
                yield np.full(int(near.sum()), at), waiting[near]
                queue += waiting[near].tolist()
                waiting, rest = waiting[~near], rest[:, ~near]


def groups(prints: DataFrame, names: list[str], edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`prints` (label and fingerprint columns) with component_id, the smallest label reachable over links.

    Equal fingerprints are one node, so a group of copies costs one row; the return
    join can be split where copies are many. Null labels belong to a group but never name it
    (a group of null labels only has a null id).
    """
    nodes = checkpoint(prints.groupBy(*names).agg(F.min("label").alias("lowest")).withColumn("node", F.xxhash64(*names) if len(names) > 1 else F.col(names[0])))
    roots = components(edges(nodes))
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = joined.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = joined.select("root", *names).join(lowest, "root").drop("root")
    return prints.join(named, names)


def near_duplicates(docs: DataFrame, *, words: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, f0, component_id) per document: 64-bit fingerprints linked at `distance` <= 3 bits, without loss.

    See `fingerprints` for nulls, empty and short texts: fingerprint zero is linked
    like any other. Rows are returned once each, repeated rows too.
    """
    if distance > 3:
        raise ValueError("four segments guarantee links of at most 3 bits; use similar_documents beyond")
    prints = checkpoint(fingerprints(docs, words=words))
    found = groups(prints, ["f0"], lambda nodes: links(ring_files(nodes), ["f0"], distance, ring_viable if distance == 3 else None))
    return found.withColumnRenamed("label", "doc_id")


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return Words([text]).sets(size)[0]


def set_name(found: np.ndarray) -> int:
    """One signed 64-bit name for a shingle set, equal for equal sets; zero for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64)) if len(found) else 0


def bit_map(found: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, of which those of the column `p` modulo FILTER_BITS are set; the driver gets a megabyte at most."""
    place = F.pmod("p", F.lit(FILTER_BITS)) + 1
    found = found.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    # Places count from 1: bucket b has a byte for every eight from (b - 1) * 32768 + 1.
    marks = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
    for row in found.collect():
        marks[(row.bucket - 1) << 12 : row.bucket << 12] = np.frombuffer(row.bits, dtype=np.uint8)
    return marks


def marked(marks: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit name is set."""
    at = names.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """A bit map of the frequent shingles (and of a few others). They only come last in an order; any order gives the same links.

    One text in TOLD is looked at, copies once a task. Each part reports its repeated shingles, less one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found[times > 1].view(np.int64)), pa.array(times[times > 1] - 1)], ["p", "times"])

        for batch in slices(batches):
            for texts in together(texts_of(batch)):
                for one in Words(texts).sets(words):
                    name = set_name(one)
                    if name not in seen:
                        seen.add(name)
                        held.append(one)
                        size += len(one)
                if size >= PART:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    told = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(TOLD)) == 0)
    sums = told.mapInArrow(run, "p long, times long").groupBy("p").agg(F.sum("times").alias("times")).where(F.col("times") >= LEAST)
    return bit_map(sums.orderBy(F.desc("times"), "p").limit(COMMON))


def set_prints(docs: DataFrame, label: F.Column, words: int, lanes: int, similarity: float, near: int = 0) -> DataFrame:
    """(label, node, size, f0, ..., keys) per document: the name and size of its shingle set, the majority bits of the set, and its first hashes.

    `keys` has as many hashes as `similarity` asks for, frequent ones last, else the smallest first: sets with that Jaccard
    similarity have one in common, and a line that many texts share brings them together only where there is little else.
    With `near`, also s0: the 64-bit fingerprint of `fingerprints` from shingles of so many words, repeats included.
    """
    names = [f"f{k}" for k in range(lanes)]
    extra = ["s0"] if near else []
    late = docs.sparkSession.sparkContext.broadcast(frequent(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            node, size, prints, keys = [], [], [np.zeros((0, lanes + len(extra)), dtype=np.uint64)], []
            for texts in together(texts_of(batch)):
                held = Words(texts)
                sets = held.sets(words)
                size += map(len, sets)
                node += map(set_name, sets)
                every, begin = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
                found, last = majorities(every, begin, lanes), marked(late.value, every)
                prints.append(np.column_stack([found, majorities(*held.digests(near), 1)]) if near else found)
                for one, at in zip(sets, begin.tolist()):
                    end = last[at : at + len(one)]
                    # Rounded down in favour of one more key.
                    keys.append(np.concatenate((one[~end], one[end]))[: len(one) - math.ceil(similarity * len(one) - 1e-6) + 1].view(np.int64))
            prints = np.concatenate(prints).view(np.int64)
            columns = [batch.column("label"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), *[pa.array(prints[:, k]) for k in range(prints.shape[1])]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64()))], ["label", "node", "size", *names, *extra, "keys"])

    slim = docs.select(label.alias("label"), F.col("text").cast("string").alias("text"))
    schema = slim.select("label").schema
    for n in ("node", "size", *names, *extra):
        schema = schema.add(n, "long")
    return slim.mapInArrow(run, schema.add("keys", ArrayType(LongType())))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, label: F.Column | None = None) -> DataFrame:
    """(node, shingles) once per shingle set whose `node` is in `wanted`, and a few others.

    A bit map of fixed size leaves out most other sets, and every task emits a set
    once, so copies are not shuffled. With the documents' `label`, `wanted` also has the label of
    one document of each set; other documents are left out before they are read, most of them.
    """
    labelled = label is not None
    names = F.explode(F.array("node", F.xxhash64("label")) if labelled else F.array("node"))
    packed = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.select(names.alias("p"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = packed.value, set()
        for batch in slices(batches):
            if labelled:
                batch = batch.filter(pa.array(marked(held, batch.column("at").to_numpy())))
            nodes, sets = [], []
            for texts in together(texts_of(batch)):
                found = Words(texts).sets(words)
                names = np.array([set_name(one) for one in found], dtype=np.int64)
                for k in np.flatnonzero(marked(held, names)).tolist():
                    node = int(names[k])
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(found[k].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    slim = docs.select(F.col("text").cast("string").alias("text"), *([F.xxhash64(label).alias("at")] if labelled else []))
    return slim.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def pairwise(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function that gives the sizes of the intersections of a set with other ones, all by number."""

    def common(at: int, others: np.ndarray) -> np.ndarray:
        mine, out = sets[at], np.zeros(len(others), dtype=np.int64)
        for k, other in enumerate(others.tolist()):
            if len(mine) and len(sets[other]):
                slot = np.minimum(np.searchsorted(mine, sets[other]), len(mine) - 1)
                out[k] = (mine[slot] == sets[other]).sum()
        return out

    return common


def indexed(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """`pairwise` for many sets: those that have a shingle are listed, or marked by a bit where they are one in 32 or more (4 bytes a shingle at most)."""
    many, row = len(sets), np.repeat(np.arange(len(sets)), [len(one) for one in sets])
    begin = np.concatenate(([0], np.cumsum([len(one) for one in sets])))
    _, place, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = (holders > 1) & (holders * 32 >= many)
    column = np.cumsum(dense) - 1
    bits = np.zeros((-(-int(dense.sum()) // 64), many), dtype=np.uint64)
    own = dense[place]
    np.bitwise_or.at(bits, (column[place[own]] >> 6, row[own]), np.uint64(1) << (column[place[own]] & 63).astype(np.uint64))
    listed = row[np.argsort(place, kind="stable")]
    first = np.cumsum(holders) - holders
    rare = (holders > 1) & ~dense

    def common(at: int, others: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(bits & bits[:, at, None]).sum(axis=0, dtype=np.int64)
        mine = place[begin[at] : begin[at + 1]]
        mine = mine[rare[mine]]
        length = holders[mine]
        out += np.bincount(listed[np.arange(length.sum()) + np.repeat(first[mine] - np.cumsum(length) + length, length)], minlength=many)
        return out[others]

    return common


def exact_forest(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of sets with Jaccard `similarity` or more, breadth first."""
    size = np.array([len(s) for s in sets])
    common = (pairwise if len(sets) <= FEW else indexed)(sets)
    waiting = np.arange(len(sets))
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            # Sets of other sizes cannot reach the similarity.
            low, high = np.minimum(size[waiting], size[at]), np.maximum(size[waiting], size[at])
            near = low >= similarity * high
            other = waiting[near]
            shared = common(at, other)
            near[near] = shared >= similarity * (size[at] + size[other] - shared)
            for k in waiting[near].tolist():
                yield at, k
            queue += waiting[near].tolist()
            waiting = waiting[~near]


def exact_links(docs: DataFrame, nodes: DataFrame, loose: DataFrame, words: int, similarity: float, label: F.Column) -> DataFrame:
    """(a, b) of nodes whose shingle sets have Jaccard `similarity` or more, enough of them to connect the nodes that such pairs connect.

    `loose` (node, root) has the groups in which such pairs are looked for. A group with more than
    SHINGLES shingles is cut into blocks, and each pair of blocks is a task of its own.
    """
    sized = checkpoint(loose.join(nodes.select("node", "size", F.col("lowest").alias("label")), "node"))
    blocks = sized.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    across = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(across, lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
    dealt = sized.join(blocks, "root").select("root", "node", F.explode(pairs).alias("cell")).select("root", "node", "cell.x", "cell.y")
    dealt = sets_of(docs, sized, words, label).join(dealt, "node").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(slices(batches), ["root", "x", "y"], 1):
            node, held = table.column("node").to_numpy(), pa.concat_arrays(table.column("shingles").chunks)
            ends, values = held.offsets.to_numpy(), held.values.to_numpy().view(np.uint64)
            a, b = [], []
            for start, stop in zip(first[:-1].tolist(), first[1:].tolist()):
                sets = [values[ends[i] : ends[i + 1]] for i in range(start, stop)]
                for left, right in exact_forest(sets, similarity):
                    a.append(node[start + left])
                    b.append(node[start + right])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.select("root", "x", "y", "node", "shingles").mapInArrow(run, "a long, b long").distinct()


def set_links(docs: DataFrame, prints: DataFrame, nodes: DataFrame, names: list[str], words: int, similarity: float, slack: float, label: F.Column) -> DataFrame:
    """(a, b) of `nodes` (node, size, names, lowest label) of `prints`, enough of them to connect all whose shingle sets have Jaccard `similarity` or more.

    All such pairs meet in a file (see `prefix_files`). Sets of one size with that Jaccard
    meet at an angle whose share of 180 degrees is the expected share of differing bits;
    documents are candidates up to that many bits plus `slack` standard deviations (the
    only step that could lose a pair: by the binomial about 2 in a million at 0.8 for sets of 4 and 5
    shingles, whose bits differ most, and under 1 in 100 million for the other sizes up to 80), and linked if the
    Jaccard similarity of their sets (of 64-bit hashes) is high enough.
    """
    share, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * len(names)
    distance = math.floor(bits * share + slack * math.sqrt(bits * share * (1 - share)))
    loose = checkpoint(components(links(prefix_files(prints, nodes, names), names, distance)))
    return exact_links(docs, nodes, loose, words, similarity, label)


def similar_documents(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, bits: int = 256, slack: float = 7.0, label: F.Column | None = None) -> DataFrame:
    """(label, f0 .., component_id) per document: groups linked by pairs whose shingle sets have Jaccard `similarity` or more.

    See `set_links`. Nulls and short texts as in `fingerprints`; texts without words form one group.
    """
    names = [f"f{k}" for k in range(bits // 64)]
    label = F.col("doc_id").cast("long") if label is None else label
    prints = checkpoint(set_prints(docs, label, words, len(names), similarity))
    nodes = checkpoint(prints.groupBy("node", "size", *names).agg(F.min("label").alias("lowest"), F.first(F.size("keys")).alias("keys")))
    roots = components(set_links(docs, prints, nodes, names, words, similarity, slack, label))
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = joined.groupBy("root").agg(F.min("lowest").alias("component_id"))
    return prints.select("label", "node", *names).join(joined.select("node", "root").join(lowest, "root").drop("root"), "node").drop("node")


def near_or_similar(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, bits: int = 256, slack: float = 7.0, near: int = 3, label: F.Column | None = None) -> DataFrame:
    """(label, component_id) per document: groups linked by the pigeonring search of `near_duplicates` or as in `similar_documents`.

    The 64-bit fingerprints of `near`-word shingles are linked at 3 bits, without loss; at that distance the search misses
    many pairs of high Jaccard similarity, which the links of the shingle sets add. Fingerprints and sets
    are nodes of one graph, with an edge between a text's fingerprint and its set.
    """
    names = [f"f{k}" for k in range(bits // 64)]
    label = F.col("doc_id").cast("long") if label is None else label
    prints = checkpoint(set_prints(docs, label, words, len(names), similarity, near))
    nodes = checkpoint(prints.groupBy("node", "size", *names).agg(F.min("label").alias("lowest"), F.first(F.size("keys")).alias("keys")))
    close = checkpoint(prints.select(F.col("s0").alias("node"), F.col("s0").alias("f0")).distinct())
    close = links(ring_files(close), ["f0"], 3, ring_viable)

    def a_print(column: str) -> F.Column:
        return F.xxhash64(F.lit("fingerprint"), column)

    def a_set(column: str) -> F.Column:
        return F.xxhash64(F.lit("set"), column)

    edges = prints.select(a_set("node").alias("a"), a_print("s0").alias("b"))
    edges = edges.unionByName(close.select(a_print("a").alias("a"), a_print("b").alias("b")))
    edges = edges.unionByName(set_links(docs, prints, nodes, names, words, similarity, slack, label).select(a_set("a").alias("a"), a_set("b").alias("b")))
    # Every set has an edge, so all have a root.
    joined = nodes.select("node", "lowest", a_set("node").alias("at")).join(components(edges).withColumnRenamed("node", "at"), "at")
    lowest = joined.groupBy("root").agg(F.min("lowest").alias("component_id"))
    return prints.select("label", "node").join(joined.select("node", "root").join(lowest, "root").drop("root"), "node").drop("node")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group of `near_or_similar` the one with the smallest doc_id.

    Null ids come after all others, equal ids follow the text, and of repeated rows one stays.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"))
    found = near_or_similar(docs, label=own, **options)
    kept = found.where(F.col("label") == F.col("component_id")).select(F.coalesce("label.id", F.lit(0)).alias("__id"), "label.t", "label.none").distinct()
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__none": F.col("doc_id").isNull(), "__t": F.xxhash64("text")})
    kept = kept.select("__id", F.col("t").alias("__t"), F.col("none").alias("__none"))
    return rows.join(kept, ["__id", "__t", "__none"], "left_semi").dropDuplicates(["__id", "__t", "__none"]).select(*docs.columns)


def hexadecimal(column: str = "f0") -> F.Column:
    """A 64-bit fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))

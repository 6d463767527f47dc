"""Jaccard self-join of n-gram sets with a prefix tree.

All n-grams have one global order: those that repeat within many parts of the corpus come
last, the others go by their hash. Two sets whose Jaccard similarity is s or more share one of their
first n - ceil(s * n) + 1 n-grams, so sets are filed under these; files with the same members are one. In
a file, pairs whose sizes or whose parity bits rule the similarity out are left aside: the bits in
which the parities of two sets differ are never more than the n-grams in which they differ. What
remains are groups of like sets; each is stored in a prefix tree, and every set walks the tree
once: nodes share the overlap of the sets below them, and subtrees whose remaining
lengths cannot reach the similarity, or whose sets are all linked already, are not entered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.common import checkpoint, components, shingle_hashes, slices, texts_of, whole_groups, word_hashes
from panelspark.llm.simhash import set_name, sets_of

#: Words of parity bits that go with a set; sets of more than twice their bits have wider ones besides.
LANES = 4
PARITY = [f"p{k}" for k in range(LANES)]
MEMBER = ["size", *PARITY, "wide"]
#: N-grams are counted in parts of about this many; an n-gram that occurs once in a part does not count there.
PART = 1 << 22
#: At most so many n-grams are known as frequent (16 bytes each): those with the highest counts, from LEAST on.
FREQUENT, LEAST = 1 << 18, 4
#: A file with more sets is cut into blocks, and pairs of blocks go to tasks of their own.
FILE_BLOCK = 1 << 14
#: A group of like sets with more n-grams is cut into blocks likewise.
GROUP_BLOCK = 1 << 21


def gram_set(text: bytes, words: int) -> np.ndarray:
    """The distinct word n-grams of a text as sorted 64-bit hashes: one of the whole sequence if it is shorter, none without words."""
    return np.unique(shingle_hashes(word_hashes(text.lower()), words))


def least_overlap(a, b, percent: int):
    """Fewest common n-grams of sets of a and b that make 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def parities(found: np.ndarray) -> tuple[np.ndarray, bytes | None]:
    """Whether an odd number of n-grams falls to each of 64 * LANES bits; and to each of more bits (half the set's size to all of it) for a large set.

    The wider bits fold into the narrower ones by exclusive or of their halves.
    """
    bits = 64 * LANES
    width = max(bits, 1 << (len(found) - 1).bit_length() - 1) if len(found) > 2 * bits else bits
    place = (found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) & np.uint64(width - 1)
    odd = (np.bincount(place.astype(np.int64), minlength=width) & 1).astype(np.uint8)
    narrow = np.bitwise_xor.reduce(odd.reshape(-1, bits), axis=0)
    return np.packbits(narrow, bitorder="little").view(np.uint64), np.packbits(odd, bitorder="little").tobytes() if width > bits else None


def folded(bits: int, width: int, to: int) -> int:
    """Parity bits of a width as those of a smaller one."""
    while width > to:
        width //= 2
        bits = (bits >> width) ^ (bits & ((1 << width) - 1))
    return bits


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, node, size, p0, ..., wide) per document: the name, size and parities of its n-gram set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [gram_set(t, words) for t in texts_of(batch)]
            pairs = [parities(s) for s in sets]
            bits = np.array([narrow for narrow, _ in pairs], dtype=np.uint64).reshape(-1, LANES).view(np.int64)
            columns = [batch.column("doc_id"), pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(bits[:, k]) for k in range(LANES)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([wide for _, wide in pairs], pa.binary())], ["doc_id", "node", *MEMBER])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, node long, size long, " + ", ".join(f"{p} long" for p in PARITY) + ", wide binary")


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent n-grams. The counts only order; any would give the same links.

    Each part of the corpus reports its repeated n-grams, less one: what a summary with a counter for
    each would keep after a decrement. Texts with one set count once per task.
    """
    part = PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def counted() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            more = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(grams[more].view(np.int64)), pa.array(counts[more] - 1)], ["gram", "times"])

        for batch in slices(batches):
            for text in texts_of(batch):
                found = gram_set(text, words)
                name = set_name(found)
                if name in seen:
                    continue
                seen.add(name)
                held.append(found)
                size += len(found)
                if size >= part:
                    yield counted()
                    held, size = [], 0
        yield counted()

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, times long")
    sums = parts.groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= LEAST)
    top = sums.orderBy(F.desc("times"), "gram").limit(FREQUENT).toArrow()
    gram, times = top.column("gram").to_numpy().view(np.uint64), top.column("times").to_numpy()
    order = np.argsort(gram)
    return gram[order], times[order]


def ordered(found: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set of sorted hashes in the global order."""
    gram, times = known
    if not len(gram) or not len(found):
        return found
    at = np.minimum(np.searchsorted(gram, found), len(gram) - 1)
    return found[np.argsort(np.where(gram[at] == found, times[at], 0), kind="stable")]


def filed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(file, node): the sets that have one of the first n-grams of their orders in common, which similar sets cannot all miss.

    A file is named by its members' hashes; n-grams of one set only are left out.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            grams, nodes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for text in texts_of(batch):
                found = gram_set(text, words)
                name = set_name(found)
                if len(found) and name not in seen:
                    seen.add(name)
                    grams.append(ordered(found, known.value)[: len(found) - least_share(len(found), percent) + 1])
                    nodes.append(np.full(len(grams[-1]), name, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(nodes))], ["gram", "node"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, node long").repartition("gram").dropDuplicates(["gram", "node"])
    gram = Window.partitionBy("gram")
    named = found.select("node", F.bit_xor(F.xxhash64("node")).over(gram).alias("file"), F.count(F.lit(1)).over(gram).alias("members"))
    # Two sets that share many n-grams meet in one file, not in as many.
    return named.where("members > 1").select("file", "node").dropDuplicates(["file", "node"])


def least_share(size: int, percent: int) -> int:
    """Fewest n-grams that a set of `size` shares with any similar set."""
    return -(-percent * size // 100)


def in_blocks(members: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """`members` with x and y, once for each pair of blocks that its own block is part of; `blocks` has (key, blocks)."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
    return members.join(blocks, key).withColumn("cell", F.explode(pairs)).select("*", "cell.x", "cell.y").drop("cell", "blocks")


def like_pairs(files: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of sets of one file whose sizes and parities allow the similarity, enough of them to connect all that such pairs connect."""
    blocks = files.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / FILE_BLOCK).cast("int").alias("blocks"))
    dealt = in_blocks(files, "file", blocks).join(nodes.select("node", *MEMBER), "node")
    dealt = dealt.select("file", "x", "y", "node", *MEMBER).repartition("file", "x", "y").sortWithinPartitions("file", "x", "y", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(slices(batches, 4096), ["file", "x", "y"], 1 << 13):
            node, size = table.column("node").to_numpy(), table.column("size").to_numpy()
            bits = np.column_stack([table.column(p).to_numpy() for p in PARITY]).view(np.uint64)
            wide = table.column("wide").to_pylist()
            a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

            def like(at: int, others: np.ndarray) -> np.ndarray:
                most = size[at] + size[others] - 2 * least_overlap(size[at], size[others], percent)
                ok = np.bitwise_count(bits[at] ^ bits[others]).sum(axis=1, dtype=np.int64) <= most
                if wide[at] is not None:
                    own, width = int.from_bytes(wide[at], "little"), 8 * len(wide[at])
                    for k in np.flatnonzero(ok).tolist():
                        other = wide[others[k]]
                        if other is not None:
                            to = min(width, 8 * len(other))
                            differ = folded(own, width, to) ^ folded(int.from_bytes(other, "little"), 8 * len(other), to)
                            ok[k] = differ.bit_count() <= most[k]
                return others[ok]

            for start, stop in zip(first[:-1].tolist(), first[1:].tolist()):
                waiting = np.arange(start, stop)
                while len(waiting) > 1:
                    queue, waiting = [int(waiting[0])], waiting[1:]
                    while queue and len(waiting):
                        at = queue.pop()
                        # By size: sets of other sizes than these cannot be similar.
                        low = np.searchsorted(size[waiting], -(-percent * size[at] // 100))
                        high = np.searchsorted(size[waiting], 100 * size[at] // percent, side="right")
                        near = like(at, waiting[low:high])
                        if len(near):
                            a.append(np.full(len(near), node[at]))
                            b.append(node[near])
                            queue += near.tolist()
                            waiting = np.setdiff1d(waiting, near, assume_unique=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


class Trie:
    """A compressed prefix tree of ordered sets; `left` counts the sets below each node that are not yet taken out.

    Nodes are numbered; node 0 is the root. A node holds the members `depth` to `end` of the path of the sets
    `low` to `high` - 1 (in the order of the tree), which part or end there.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        """`sets` hold ascending ranks and are themselves in lexicographic order, without repeats."""
        self.sets = sets
        size = np.array([len(s) for s in sets])
        common = []
        for a, b in zip(sets, sets[1:]):
            n = min(len(a), len(b))
            other = np.flatnonzero(a[:n] != b[:n])
            common.append(int(other[0]) if len(other) else n)
        self.parent, self.depth, self.end, self.low, self.high = [-1], [0], [0], [0], [len(sets)]
        self.children: list[list[int]] = [[]]
        self.leaf = np.zeros(len(sets), dtype=np.int64)
        common = np.array(common, dtype=np.int64)
        todo = [0]
        while todo:
            at = todo.pop()
            low, high = self.low[at], self.high[at]
            self.end[at] = int(common[low : high - 1].min()) if high - low > 1 else int(size[low])
            if high - low == 1:
                self.leaf[low] = at
                continue
            # The sets below part where neighbours share no more than this node.
            cuts = low + 1 + np.flatnonzero(common[low : high - 1] == self.end[at])
            for a, b in zip([low, *cuts.tolist()], [*cuts.tolist(), high]):
                child = len(self.parent)
                self.parent.append(at)
                self.depth.append(self.end[at])
                self.end.append(0)
                self.low.append(a)
                self.high.append(b)
                self.children.append([])
                self.children[at].append(child)
                todo.append(child)
        self.shortest = [int(size[a:b].min()) for a, b in zip(self.low, self.high)]
        self.longest = [int(size[a:b].max()) for a, b in zip(self.low, self.high)]
        self.left = [b - a for a, b in zip(self.low, self.high)]

    def take(self, k: int) -> None:
        at = int(self.leaf[k])
        while at >= 0:
            self.left[at] -= 1
            at = self.parent[at]

    def similar(self, k: int, mark: np.ndarray, percent: int) -> list[int]:
        """The sets still in the tree that are similar to set k; `mark` is true at its ranks."""
        mine, out = self.sets[k], []
        size = len(mine)
        todo = [(0, 0)]
        while todo:
            at, overlap = todo.pop()
            if not self.left[at]:
                continue
            depth, end, longest = self.depth[at], self.end[at], self.longest[at]
            need = least_overlap(size, self.shortest[at], percent)
            path = self.sets[self.low[at]]
            # What both sides have left bounds the overlap. The more of a path is known the tighter: a long one is read step by step.
            step, possible = 64, True
            while possible and depth < end:
                to = min(end, depth + step)
                overlap += int(mark[path[depth:to]].sum())
                rest = size - int(np.searchsorted(mine, path[to - 1], side="right"))
                possible = overlap + min(rest, longest - to) >= need
                depth, step = to, 2 * step
            if not possible:
                continue
            if self.children[at]:
                todo += [(child, overlap) for child in self.children[at]]
            elif overlap >= least_overlap(size, end, percent):
                out.append(self.low[at])
        return out


def tree_forest(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of sets (of hashes, all distinct) that are similar, breadth first through a prefix tree.

    Within the tree n-grams go by how many of its sets have them, frequent ones first, so
    that like sets share long paths.
    """
    names, rank, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(names), dtype=np.int64)
    place[np.lexsort((names, -times))] = np.arange(len(names))
    ends = np.cumsum([0, *map(len, sets)])
    ranked = [np.sort(place[rank[a:b]]) for a, b in zip(ends, ends[1:])]
    order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
    tree = Trie([ranked[i] for i in order])
    mark = np.zeros(len(names), dtype=bool)
    waiting = np.ones(len(sets), dtype=bool)
    for start in range(len(sets)):
        queue = [start] if waiting[start] else []
        for k in queue:
            waiting[k] = False
            tree.take(k)
        while queue and tree.left[0]:
            k = queue.pop()
            mark[tree.sets[k]] = True
            found = tree.similar(k, mark, percent)
            mark[tree.sets[k]] = False
            for other in found:
                waiting[other] = False
                tree.take(other)
                yield order[k], order[other]
            queue += found


def tree_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of similar sets, enough of them to connect all that similar pairs connect; `groups` (node, root) has the groups to look in.

    A group with more than GROUP_BLOCK n-grams is cut into blocks, and each pair of blocks is a tree of its own.
    """
    sized = checkpoint(groups.join(nodes.select("node", "size"), "node"))
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("size") / GROUP_BLOCK).cast("int").alias("blocks"))
    cells = in_blocks(sized.drop("size"), "root", blocks)
    dealt = sets_of(docs, sized, words).join(cells, "node").select("root", "x", "y", "node", "shingles")
    dealt = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(slices(batches), ["root", "x", "y"], 1):
            node, held = table.column("node").to_numpy(), pa.concat_arrays(table.column("shingles").chunks)
            ends, values = held.offsets.to_numpy(), held.values.to_numpy().view(np.uint64)
            a, b = [], []
            for start, stop in zip(first[:-1].tolist(), first[1:].tolist()):
                for left, right in tree_forest([values[ends[i] : ends[i + 1]] for i in range(start, stop)], percent):
                    a.append(node[start + left])
                    b.append(node[start + right])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, *, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document: its n-gram set's size and the smallest doc_id reachable over links.

    Documents link when 100 * intersection >= `percent` * union of their sets of word n-grams (A-Z lower-cased,
    split at ASCII white space; a text of fewer words is one n-gram). Documents with
    equal sets are linked; sets are compared as 64-bit hashes. Null texts and texts without words have empty sets
    and link with nothing, each its own component. Null doc_ids belong to components but never name
    one, unless all of its ids are null. Repeated rows are returned once each; an empty table
    gives no rows; other columns are ignored.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    sets = checkpoint(set_table(docs, words))
    nodes = checkpoint(sets.where("size > 0").groupBy("node", *MEMBER).agg(F.min("doc_id").alias("lowest")))
    loose = checkpoint(components(like_pairs(checkpoint(filed(docs, words, percent)), nodes, percent)))
    roots = components(tree_links(docs, nodes, loose, words, percent))
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = joined.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = joined.select("node", "root").join(lowest, "root").drop("root")
    known = sets.where("size > 0").join(named, "node").select("doc_id", "size", "component_id")
    empty = sets.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return known.unionByName(empty).withColumnRenamed("size", "n_shingles")

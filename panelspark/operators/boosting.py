"""Gradient boosting on quantile bins, in which unknown values have a bin and a learned side of their own.

Training rows are binned once and packed into blocks: a byte per value, 255 for unknown.
A pass over the blocks counts, for the large nodes asked for, the gradients, curvatures and rows of
every (node, column, bin); the sums meet by column, where the best cut of each node is found, so the
driver sees one row for each of them. A tree is much like those before it, so a pass also counts the nodes
that there would be if the cuts below were those found before: where they are, their sums hold,
and where they are not, the next pass counts the right nodes. The rows of a node of at most LOCAL rows
meet in one task, which grows all that the tree may have below it. Trees grow best first, and all ways
give the same cuts. A fitted model is a small table of nodes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.contracts import ContractError
from panelspark.operators.ordered import running
from panelspark.session import checkpoint

UNKNOWN = 255
#: Rows of a packed block, of a partition of blocks, and rounds after which the rows' margins are written anew.
BLOCK, PARTITION, ROUNDS = 1 << 15, 1 << 18, 5
#: Rows up to which a node is grown in one task.
LOCAL = 1 << 18
#: Leaves of the trees whose rows are located through sets of leaves (a byte for every eight).
MASKED = 32
#: A child must have so much curvature.
LEAST_CURVATURE = 1e-3
CUT = "gain double, feature int, bin int, unknown_left boolean, left_g double, left_h double, left_n double, g double, h double, n double"
_CUT = [pa.float64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 6]
NODES = "tree int, node int, feature string, threshold double, unknown_left boolean, left int, right int, value double"


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    rate: float = 0.05
    leaves: int = 15
    min_leaf: int = 100
    l2: float = 1.0
    bins: int = 255

    def __post_init__(self) -> None:
        if not 2 <= self.bins <= UNKNOWN or self.leaves < 1 or self.rounds < 0:
            raise ContractError("bins must be 2 to 255, leaves positive and rounds not negative")


@dataclass(frozen=True)
class Tree:
    """Nodes by number, 0 the root; a node without a left child is a leaf. Known values up to `threshold` (bin `bin`) go left."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    unknown_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, rows: int, goes_left: Callable[[Tree, int, np.ndarray], np.ndarray]) -> np.ndarray:
        """The leaf of every row; `goes_left` tells it for a node and row numbers."""
        out, todo = np.zeros(rows, dtype=np.int32), [(0, np.arange(rows))]
        while todo:
            at, own = todo.pop()
            if self.left[at] < 0:
                out[own] = at
            elif len(own):
                left = goes_left(self, at, own)
                todo += [(int(self.left[at]), own[left]), (int(self.right[at]), own[~left])]
        return out


def _binned(bins: np.ndarray) -> Callable[[Tree, int, np.ndarray], np.ndarray]:
    def goes_left(tree: Tree, at: int, rows: np.ndarray) -> np.ndarray:
        own = bins[tree.feature[at]][rows]
        return np.where(own == UNKNOWN, tree.unknown_left[at], own <= tree.bin[at])

    return goes_left


def leaf_sets(tree: Tree) -> tuple[list[int], dict[int, list[bytes]]]:
    """The leaves from left to right; per column, tables of 256 sets of leaves that a bin leaves open, eight leaves in each. Without tables for more than MASKED leaves."""
    ends: list[int] = []
    inner = []

    def visit(at: int) -> None:
        if tree.left[at] < 0:
            ends.append(at)
            return
        start = len(ends)
        visit(int(tree.left[at]))
        middle = len(ends)
        visit(int(tree.right[at]))
        inner.append((at, start, middle, len(ends)))

    visit(0)
    if len(ends) > MASKED:
        return ends, {}
    spans = lambda a, b: (1 << b) - (1 << a)
    every, tables = spans(0, MASKED), {}
    for at, start, middle, stop in inner:
        left = np.arange(256) <= tree.bin[at]
        left[UNKNOWN] = tree.unknown_left[at]
        table = tables.setdefault(int(tree.feature[at]), np.full(256, every, dtype="<u8"))
        table &= np.where(left, every ^ spans(middle, stop), every ^ spans(start, middle)).astype("<u8")
    return ends, {c: [(t >> np.uint64(8 * k) & np.uint64(255)).astype(np.uint8).tobytes() for k in range(-(-len(ends) // 8))] for c, t in tables.items()}


#: Tables that turn the one leaf of a set, or none, into its number, for the first eight leaves, the next eight, ...
_NUMBERS = [bytes(8 * k + n.bit_length() - 1 if n and not n & (n - 1) else 0 for n in range(256)) for k in range(MASKED // 8)]


def leaf_finder(tree: Tree, bins: np.ndarray, sets: tuple[list[int], dict[int, list[bytes]]] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives, for an array of one entry per node, every row's entry at its leaf.

    The sets of leaves (`leaf_sets`) that a row's bins leave open have one leaf in common. Trees of more than
    MASKED leaves are walked.
    """
    ends, tables = leaf_sets(tree) if sets is None else sets
    if len(ends) == 1:
        return lambda entries: np.full(bins.shape[1], entries[0])
    if len(ends) > MASKED:
        found = tree.leaves(bins.shape[1], _binned(bins))
        return lambda entries: entries[found]
    held = {c: bins[c].tobytes() for c in tables}
    number = np.zeros(bins.shape[1], dtype=np.uint8)
    for k in range(-(-len(ends) // 8)):
        open_ = np.full(bins.shape[1], (1 << min(8, len(ends) - 8 * k)) - 1, dtype=np.uint8)
        for c, own in tables.items():
            open_ &= np.frombuffer(held[c].translate(own[k]), dtype=np.uint8)
        number |= np.frombuffer(open_.tobytes().translate(_NUMBERS[k]), dtype=np.uint8)
    return lambda entries: entries[ends][number]


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending upper edges of all bins but the last, per column: every value where they are few, else the values at the bins' quantiles.

    Counts are exact and cover all rows; at most bins - 1 numbers a column reach the driver.
    """
    long = F.array(*[F.struct(F.lit(i).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value")) for i, c in enumerate(features)])
    counts = df.select(F.explode(long).alias("v")).select("v.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts.withColumn("one", F.lit(1)), ["column"], "value", {"upto": "n", "place": "one"}, totals=True)
    step = lambda upto: F.floor(upto * bins / F.col("upto_total"))
    edge = (F.col("place_total") <= bins) | (step(F.col("upto")) > step(F.col("upto") - F.col("n")))
    found = placed.where(edge & (F.col("place") < F.col("place_total"))).select("column", "value").toPandas()
    return [np.sort(found["value"][found["column"] == i].to_numpy()) for i in range(len(features))]


def pack(df: DataFrame, features: Sequence[str], y: Column, weight: Column, edges: list[np.ndarray], start: float, rows: int) -> DataFrame:
    """Blocks of binned rows: (rows, bins, y, weight, margin), the last four as packed arrays; of weights that follow from y in a block, the two."""
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = edges
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                bins = np.empty((len(held), part.num_rows), dtype=np.uint8)
                for k, edge in enumerate(held):
                    values = part.column(k + 2).to_numpy(zero_copy_only=False).astype(np.float64)
                    bins[k] = np.where(np.isnan(values), UNKNOWN, np.searchsorted(edge, values))
                y, weights = (part.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (0, 1))
                two = np.array([weights[y == k][0] if (y == k).any() else 1.0 for k in (0, 1)])
                y = y.astype(np.uint8)
                if not (two[y] == weights).all():
                    two = np.concatenate((two, weights))
                yield _block(part.num_rows, bins, y, two, np.full(part.num_rows, start))

    slim = df.select(y.cast("double").alias("y"), weight.cast("double").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    slim = slim.repartition(max(1, -(-rows // PARTITION)))
    return checkpoint(slim.mapInArrow(run, "rows long, bins binary, y binary, weight binary, margin binary"))


def _block(n: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], ["rows", "bins", "y", "weight", "margin"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bins, y, weight, margin) of every block as they are packed."""
    for batch in batches:
        for k in range(batch.num_rows):
            n = batch.column(0)[k].as_py()
            bins, y, weight, margin = (np.frombuffer(batch.column(c + 1)[k].as_buffer(), dtype=d) for c, d in enumerate((np.uint8, np.uint8, float, float)))
            yield n, bins.reshape(-1, n), y, weight, margin


def with_margins(blocks: DataFrame, trees: list[Tree]) -> DataFrame:
    """The blocks with the trees' values added to the margins, written anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [leaf_sets(t) for t in trees]
        for n, bins, y, weight, margin in _unpacked(batches):
            for tree, own in zip(trees, sets):
                margin = margin + leaf_finder(tree, bins, own)(tree.value)
            yield _block(n, bins, y, weight, margin)

    return checkpoint(blocks.mapInArrow(run, blocks.schema))


def best_cut(sums: np.ndarray, settings: Settings) -> tuple:
    """Gain, bin, side of the unknown, and the sums of the left child and of the node, from (gradient, curvature, rows) x 256 bins.

    A cut after the last bin parts the known from the unknown. Without unknown values in the node they
    would go with the larger child. No allowed cut: gain 0.
    """
    known, unknown = np.cumsum(sums[:, :UNKNOWN], axis=1), sums[:, UNKNOWN:]
    total = known[:, -1:] + unknown
    best = (0.0, -1, False, 0.0, 0.0, 0.0)
    for unknown_left in (False, True) if unknown[2, 0] else (False,):
        left = known + unknown if unknown_left else known
        right = total - left
        ok = np.minimum(left[2], right[2]) >= settings.min_leaf
        ok &= np.minimum(left[1], right[1]) >= LEAST_CURVATURE
        if ok.any():
            score = lambda s: s[0] ** 2 / (s[1] + settings.l2)
            gain = np.where(ok, score(left) + score(np.maximum(right, [[-np.inf], [0], [0]])) - score(total), 0)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                side = unknown_left if unknown[2, 0] else bool(left[2, at] > right[2, at])
                best = (float(gain[at]), at, side, *map(float, left[:, at]))
    return (*best, *map(float, total[:, 0]))


def _counted(bins: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of (gradient, curvature, rows) by slot, column and bin."""
    base, size = slot * 256, slots * 256
    out = np.empty((slots, len(bins), 3, 256))
    for k, own in enumerate(bins):
        for j, values in enumerate((g, h, None)):
            out[:, k, j] = np.bincount(base + own, weights=values, minlength=size).reshape(-1, 256)
    return out


def _best(cuts_: Iterator[tuple]) -> tuple:
    """The cut with the highest gain, of the first column among equals; cuts are (gain, column, ...)."""
    return min(cuts_, key=lambda c: (-c[0], c[1]))


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    fields = [*names, *[c.split()[0] for c in CUT.split(", ")]]
    return pa.table([pa.array(v, k) for v, k in zip(zip(*rows), [*kinds, *_CUT])], names=fields)


def subtree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, settings: Settings) -> dict[str, tuple]:
    """The best cuts of a node and of all below it that a tree of `leaves` leaves may split, by path ("" the node, then l and r)."""

    def looked(rows: np.ndarray) -> tuple:
        sums = _counted(bins[:, rows], np.zeros(len(rows), dtype=np.int64), 1, g[rows], h[rows])[0]
        return _best((gain, k, *rest) for k, (gain, *rest) in enumerate(best_cut(s, settings) for s in sums))

    rows = {"": np.arange(bins.shape[1])}
    known = {"": looked(rows[""])}
    order, splits = [(-known[""][0], "")], 0
    while order and splits < settings.leaves - 1:
        gain, path = heapq.heappop(order)
        if gain >= 0:
            break
        splits += 1
        _, feature, bin_, side, *_ = known[path]
        own = bins[feature][rows[path]]
        left = np.where(own == UNKNOWN, side, own <= bin_)
        for name, part in ((path + "l", left), (path + "r", ~left)):
            rows[name] = rows[path][part]
            known[name] = looked(rows[name])
            heapq.heappush(order, (-known[name][0], name))
        del rows[path]
    return known


def cuts(blocks: DataFrame, trees: list[Tree], tree: Tree, wanted: dict[str, list[int]], small: dict[str, int], width: int, settings: Settings) -> dict[str, tuple]:
    """The best cut of each node in `wanted` ({path: its leaves in the growing tree}): (gain, column, bin, side, left sums, own sums).

    Also those of the nodes in `small` ({path: node of the growing tree}) and of the nodes below these.
    """
    found: dict[str, tuple] = {}
    names, locals_ = list(wanted), list(small)
    counted = sorted({at for leaves in wanted.values() for at in leaves})
    slots = np.full(len(tree.left), -1)
    slots[counted + list(small.values())] = np.arange(len(counted) + len(small))
    own_slots = [slots[leaves].tolist() for leaves in wanted.values()]
    many = len(counted)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        growing, sets = leaf_sets(tree), [leaf_sets(t) for t in trees]
        for n, bins, y, weight, margin in _unpacked(batches):
            slot = leaf_finder(tree, bins, growing)(slots)
            own = slot >= 0
            if not own.all():
                slot, bins, y, margin = slot[own], bins[:, own], y[own], margin[own]
                weight = weight if len(weight) == 2 else np.concatenate((weight[:2], weight[2:][own]))
            for one, leaves in zip(trees, sets):
                margin = margin + leaf_finder(one, bins, leaves)(one.value)
            p = 1 / (1 + np.exp(-margin))
            weight = weight[y] if len(weight) == 2 else weight[2:]
            g = weight * (p - y)
            weight = weight * p
            yield slot, bins, g, weight * (1 - p)

    def keep(rows) -> None:
        for r in rows:
            path, best = names[r.node] if r.path is None else locals_[r.node] + r.path, tuple(r[2:])
            best = (*best[:4], best[4:7], best[7:])
            found[path] = _best(iter([best, found[path]])) if path in found else best

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of small nodes, block by block (column -1 and below), and the sums of the others by column."""
        sums = np.zeros((many, width, 3, 256))
        for slot, bins, g, h in located(batches):
            for k in range(len(locals_)):
                own = slot == many + k
                if own.any():
                    packed = [pa.array([x.tobytes()], pa.binary()) for x in (bins[:, own], g[own], h[own])]
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - k], pa.int32()), *packed], ["column", "values", "g", "h"])
            if locals_ and many:
                own = slot < many
                slot, bins, g, h = slot[own], bins[:, own], g[own], h[own]
            if many:
                sums += _counted(bins, slot, many, g, h)
        if many:
            packed, none = [sums[:, k].tobytes() for k in range(width)], pa.nulls(width, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(packed, pa.binary()), none, none], ["column", "values", "g", "h"])

    def meet(table: pa.Table) -> pa.Table:
        column = table.column("column")[0].as_py()
        if column >= 0:
            sums = sum(np.frombuffer(x.as_buffer()) for x in table.column("values")).reshape(many, 3, 256)
            best = [best_cut(sums[leaves].sum(axis=0), settings) for leaves in own_slots]
            return _table([(k, None, gain, column, *rest) for k, (gain, *rest) in enumerate(best)], ["node", "path"], [pa.int32(), pa.string()])
        g, h = (np.concatenate([np.frombuffer(x) for x in table.column(c).to_pylist()]) for c in ("g", "h"))
        bins = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(width, -1) for x in table.column("values").to_pylist()], axis=1)
        return _table([(-1 - column, path, *cut) for path, cut in subtree(bins, g, h, settings).items()], ["node", "path"], [pa.int32(), pa.string()])

    # One pass serves both kinds of nodes.
    dealt = blocks.mapInArrow(look, "column int, values binary, g binary, h binary").repartition(len(locals_) + width * bool(many), "column")
    keep(dealt.groupBy("column").applyInArrow(meet, f"node int, path string, {CUT}").collect())
    return found


def _assembled(split: dict[str, tuple], edges: list[np.ndarray], settings: Settings, own: tuple | None = None) -> tuple[Tree, dict[int, str]]:
    """The tree of the split nodes (by path: "" the root, then l and r), and the paths of its nodes."""
    names, rows, sums, at = [""], [], {"": own}, 0
    while at < len(names):
        name = names[at]
        if name in split:
            _, feature, bin_, side, left, total = split[name]
            sums[name + "l"], sums[name + "r"] = left, tuple(a - b for a, b in zip(total, left))
            edge = edges[feature]
            rows.append((feature, bin_, float(edge[bin_]) if bin_ < len(edge) else math.inf, side, len(names), len(names) + 1, 0.0))
            names += [name + "l", name + "r"]
        else:
            g, h, _ = sums[name] or (0.0, 0.0, 0.0)
            rows.append((-1, -1, math.nan, False, -1, -1, -settings.rate * g / (h + settings.l2)))
        at += 1
    kinds = (np.int32, np.int32, np.float64, bool, np.int32, np.int32, np.float64)
    return Tree(*[np.array(c, dtype=k) for c, k in zip(zip(*rows), kinds)]), dict(enumerate(names))


#: Stands for the sums of nodes that only locate rows.
_ANY = ((0.0, 1.0, 0.0), (0.0, 2.0, 0.0))


def grow(look: Callable[[Tree, dict[str, list[int]], dict[str, int]], dict[str, tuple]], edges: list[np.ndarray], settings: Settings, rows: int, memory: dict | None = None) -> Tree:
    """Split the node with the highest gain until there are `leaves` leaves or no gain; `look` finds the cuts of nodes.

    One look serves all nodes that the order of splits so far would still depend on, and grows small ones to the end.
    Below the large ones it also counts the nodes that remembered cuts make, those of the highest gains; a node is
    taken from there only if the cuts above it are found to be those. `memory` has the (gain, column, bin, side) found
    last, by a node's cuts from the root and by its path.
    """
    known: dict[str, tuple] = {}
    memory = {} if memory is None else memory
    while True:
        split: dict[str, tuple] = {}
        order = [(-known[""][0], "")] if known else []
        missing = {} if known else {"": rows}
        while order and len(split) < settings.leaves - 1:
            gain, name = heapq.heappop(order)
            if gain >= 0:
                break
            split[name] = known[name]
            if len(split) < settings.leaves - 1:
                left, total = known[name][4][2], known[name][5][2]
                for child, n in ((name + "l", left), (name + "r", total - left)):
                    if child in known:
                        heapq.heappush(order, (-known[child][0], child))
                    else:
                        missing[child] = n
        if not missing:
            return _assembled(split, edges, settings, known[""][5] if known else None)[0]
        large = [name for name, n in missing.items() if n > LOCAL]
        above = {name: tuple((split[name[:k]][1:4], name[k]) for k in range(len(name))) for name in large}
        below: dict[str, tuple] = {}
        ahead: list[tuple[float, str]] = []

        def expect(name: str) -> None:
            cut = memory.get(above[name]) or memory.get(name)
            if cut and cut[0] > 0:
                heapq.heappush(ahead, (-cut[0], name))

        for name in large:
            expect(name)
        while ahead and len(split) + len(below) < max(settings.leaves, MASKED) - 1:
            name = heapq.heappop(ahead)[1]
            cut = (memory.get(above[name]) or memory[name])[1:]
            below[name] = (0.0, *cut, *_ANY)
            for side in "lr":
                above[name + side] = (*above[name], (cut, side))
                expect(name + side)
        tree, names = _assembled(split | below, edges, settings, known[""][5] if known else _ANY[0])
        at = {name: k for k, name in names.items()}
        wanted = {name: [k for k, end in names.items() if tree.left[k] < 0 and end.startswith(name)] for name in above}
        found = look(tree, wanted, {name: at[name] for name, n in missing.items() if n <= LOCAL})
        known |= {name: cut for name, cut in found.items() if name not in wanted}
        for name in wanted:
            memory[above[name]] = found[name][:4]
        while large:
            name = large.pop()
            known[name] = found[name]
            memory[name] = found[name][:4]
            if name in below and found[name][1:4] == below[name][1:4]:
                large += [name + "l", name + "r"]


@dataclass(frozen=True)
class Boosted:
    """A fitted model: the log-odds of the training rows, and trees."""

    features: tuple[str, ...]
    start: float
    trees: list[Tree] = field(repr=False)

    def table(self, spark) -> DataFrame:
        """One row per node; a leaf has a value and no feature."""
        rows = []
        for k, t in enumerate(self.trees):
            for n in range(len(t.left)):
                inner = t.left[n] >= 0
                cut = (self.features[t.feature[n]], float(t.threshold[n]), bool(t.unknown_left[n]), int(t.left[n]), int(t.right[n]), None)
                rows.append((k, n, *(cut if inner else (None, None, None, None, None, float(t.value[n])))))
        return spark.createDataFrame(rows, NODES)

    def margins(self, df: DataFrame, keys: Sequence[str], prefixes: Sequence[int]) -> DataFrame:
        """Keys and the log-odds after the first n rounds as m_n, for several n; unknown values take their learned side."""
        wanted, trees = sorted(set(prefixes)), self.trees
        if wanted and wanted[-1] > len(trees):
            raise ContractError(f"the model has {len(trees)} rounds")
        width = len(keys)
        # The thresholds in use, at most one a bin, put every value in a place that decides all of its cuts.
        places = [np.unique(np.concatenate([np.zeros(0), *[t.threshold[(t.left >= 0) & (t.feature == i)] for t in trees]])) for i in range(len(self.features))]
        trees = [replace(t, bin=np.array([np.searchsorted(places[f], x) if f >= 0 else -1 for f, x in zip(t.feature, t.threshold)], dtype=np.int32)) for t in trees]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = [leaf_sets(t) for t in trees]
            for batch in batches:
                bins = np.empty((len(places), batch.num_rows), dtype=np.uint8)
                for i, c in enumerate(batch.columns[width:]):
                    values = c.to_numpy(zero_copy_only=False).astype(np.float64)
                    bins[i] = np.where(np.isnan(values), UNKNOWN, np.searchsorted(places[i], values))
                margin, out = np.full(batch.num_rows, self.start), {}
                for n in range(wanted[-1] + 1):
                    if n:
                        margin = margin + leaf_finder(trees[n - 1], bins, sets[n - 1])(trees[n - 1].value)
                    if n in wanted:
                        out[f"m_{n}"] = pa.array(margin)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *out.values()], [*keys, *out])

        slim = df.select(*keys, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(self.features)])
        schema = slim.select(*keys).schema
        for n in wanted:
            schema = schema.add(f"m_{n}", "double")
        return slim.mapInArrow(run, schema)

    def score(self, df: DataFrame, keys: Sequence[str], name: str = "p") -> DataFrame:
        """Keys with the probability of class 1."""
        last = f"m_{len(self.trees)}"
        return self.margins(df, keys, [len(self.trees)]).select(*keys, probability(F.col(last)).alias(name))


def probability(margin: Column) -> Column:
    return 1 / (F.exp(-margin) + 1)


def fit(train: DataFrame, features: Sequence[str], y: str, settings: Settings = Settings(), weight: Column | None = None) -> Boosted:
    """Fit on all rows of `train`; NULL and NaN are unknown, `weight` defaults to one.

    Labels must be 0 or 1 and both occur. Every pass reads the written blocks, so a lost executor costs its
    tasks only; at most ROUNDS trees are walked again per pass.
    """
    weight = F.lit(1.0) if weight is None else weight
    label = F.col(y).cast("double")
    n, pos, all_, odd = train.agg(F.count(F.lit(1)), F.sum(weight * label), F.sum(weight), F.count(F.when(label.isNull() | ~label.isin(0.0, 1.0), 1))).first()
    if odd or not n or not 0 < pos < all_:
        raise ContractError("labels must be 0 or 1, and both classes are needed")
    edges, start = bin_edges(train, features, settings.bins), math.log(pos / (all_ - pos))
    blocks, trees, done, memory = pack(train, features, label, weight, edges, start, n), [], 0, {}
    for _ in range(settings.rounds):
        if len(trees) - done == ROUNDS:
            blocks, done = with_margins(blocks, trees[done:]), len(trees)
        fresh = trees[done:]
        trees.append(grow(lambda tree, wanted, small: cuts(blocks, fresh, tree, wanted, small, len(features), settings), edges, settings, n, memory))
    return Boosted(tuple(features), start, trees)

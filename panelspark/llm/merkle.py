"""Merkle manifest of a dataset: one ternary hash tree per source, and one over the sources.

Leaves are numbered within their tree by a range partition and cut into superblocks of
3**7. Going up, every superblock becomes one node, until each tree has one. Going down, the nodes of a
superblock are cogrouped with the outer nodes that its path to the root needs, and one
pandas function finishes the local levels, joins the proofs and folds them. The number of
passes grows with the logarithm of the largest tree; a superblock is all that a task holds.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelspark.llm.common import checkpoint
from panelspark.session import parts_for

ARITY = 3
#: Nodes of a superblock, a power of the arity: seven local levels at a time.
SUPERBLOCK = ARITY**7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, pos long, total long, digest string"
PATH = "left array<string>, right array<string>, subroot string, root string"


def digest(*inputs: str) -> str:
    """Lowercase hex SHA-256 of the inputs, concatenated."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(text: F.Column | None = None) -> F.Column:
    """The digest of a document row's fields; `text` stands in for its text."""

    def encoded(name: str) -> F.Column:
        value = (text if name == "text" and text is not None else F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[encoded(n) for n in FIELDS]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with pos (0-based by `order`, nulls first, within `tree`) and total (rows of the tree).

    The whole table is range partitioned by tree and order, so a tree with a third of all rows is spread over many
    tasks; equal rows are told apart by their place in the input, which they may swap.
    """
    rows = rows.withColumn("own", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order, "own"]]
    cut = checkpoint(rows.repartitionByRange(parts_for(rows), *keys).withColumn("piece", F.spark_partition_id()))
    sizes = cut.groupBy("tree", "piece").agg(F.count(F.lit(1)).alias("size"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(tree.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("tree", "piece", before.alias("before"), F.sum("size").over(tree).alias("total"))
    within = F.row_number().over(Window.partitionBy("tree", "piece").orderBy(*keys[1:]))
    ranked = cut.withColumn("within", within).join(places, ["tree", "piece"])
    return ranked.withColumn("pos", (F.col("before") + F.col("within") - 1).cast("long")).drop("own", "piece", "before", "within")


def _levels(digests: list[str], single: bool, size: int) -> list[list[str]]:
    """The levels of a superblock up to its one node: all of its own if it is a whole tree, else as many as a full one."""
    out = [digests]
    while len(out[-1]) > 1 or size > 1 and not single:
        below = out[-1]
        out.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
        size //= ARITY
    return out


def _block(size: int) -> F.Column:
    return F.floor(F.col("pos") / size).cast("long").alias("block")


def reduced(nodes: DataFrame, size: int) -> DataFrame:
    """The node of every superblock, numbered within its tree."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, total = rows.sort_values("pos"), int(rows["total"].iloc[0])
        top = _levels(rows["digest"].tolist(), total <= size, size)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "total": [-(-total // size)], "digest": [top]})

    return nodes.select("tree", _block(size), "pos", "total", "digest").groupBy("tree", "block").applyInPandas(run, NODES)


def climbed(nodes: DataFrame, size: int) -> list[DataFrame]:
    """The nodes of every pass, from the given ones to one node per tree."""
    passes = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 1
    while most > 1 or len(passes) == 1:
        passes.append(checkpoint(reduced(passes[-1].select("tree", "pos", "total", "digest"), size)))
        most = -(-most // size)
    return passes


def _finish(rows: pd.DataFrame, outer: pd.DataFrame, size: int) -> tuple[pd.DataFrame, list[list[str]], list[list[str]]]:
    """The rows of a superblock by position, with what stands left and right of each node's path, level by level to the root."""
    rows = rows.sort_values("pos")
    first, path = int(rows["pos"].iloc[0]) % size, outer.iloc[0]
    assert first == 0, "a superblock must be whole"
    beside = []
    for nodes in _levels(rows["digest"].tolist(), int(rows["total"].iloc[0]) <= size, size)[:-1]:
        beside.append([("".join(nodes[j - j % ARITY : j]), "".join(nodes[j + 1 : j - j % ARITY + ARITY])) for j in range(len(nodes))])
    outer_left, outer_right = list(path["left"]), list(path["right"])
    left = [[level[i // ARITY**k][0] for k, level in enumerate(beside)] + outer_left for i in range(len(rows))]
    right = [[level[i // ARITY**k][1] for k, level in enumerate(beside)] + outer_right for i in range(len(rows))]
    return rows, left, right


def descended(passes: list[DataFrame], top: DataFrame, size: int) -> DataFrame:
    """(tree, block, left, right, subroot, root) for every superblock of the first pass; `top` has (tree, ...) of each tree's one node."""

    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # never: every path belongs to a superblock
            return pd.DataFrame(columns=["tree", "block", "left", "right", "subroot", "root"])
        rows, left, right = _finish(rows, outer, size)
        return pd.DataFrame({"tree": rows["tree"], "block": rows["pos"], "left": left, "right": right, "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0]})

    paths = top.withColumn("block", F.lit(0).cast("long"))
    for nodes in passes[-2:0:-1]:
        blocks = nodes.select("tree", _block(size), "pos", "total", "digest").groupBy("tree", "block")
        paths = blocks.cogroup(paths.groupBy("tree", "block")).applyInPandas(run, f"tree string, block long, {PATH}")
    return paths


def tampered() -> F.Column:
    """Whether the row's text loses its newlines: where 2 divides the unsigned CRC-32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def manifest(docs: DataFrame, changed: F.Column | None = None, altered: F.Column | None = None, size: int = SUPERBLOCK) -> DataFrame:
    """(doc_id, source, pos, leaf, subroot, root, proof_sha256, folded_root, verified) per document row.

    The last two tell whether a row that may have changed since (its text is `altered`
    where `changed` is true) still folds to the stored root with the siblings of its proof. A null
    field is a leaf input of its own, apart from the empty text; null sources form one tree, before all others;
    null doc_ids come first in their tree. Repeated rows are leaves each, in any order as they are equal;
    rows of one doc_id go by their leaf; `size` nodes make a superblock. An empty table gives no rows; further columns are ignored.
    """
    changed = F.lit(False) if changed is None else changed
    now = F.when(changed, leaf(F.col("text") if altered is None else altered)).otherwise(F.col("leaf"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # '-' sorts before '='
    leaves = checkpoint(docs.withColumn("leaf", leaf()).select("doc_id", "source", tree.alias("tree"), F.col("leaf").alias("digest"), now.alias("now")))
    leaves = checkpoint(numbered(leaves, ["doc_id", "digest"]))
    passes = climbed(leaves, size)

    subroots = passes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("subroot"))
    subroots = checkpoint(numbered(subroots, ["name"]).withColumnRenamed("subroot", "digest"))
    over = climbed(subroots, size)
    none = F.array().cast("array<string>")
    top = over[-1].select("tree", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("digest").alias("root"))

    def join_sources(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, left, right = _finish(rows, outer, size)
        return pd.DataFrame({"tree": rows["name"], "left": left, "right": right, "subroot": rows["digest"], "root": outer["root"].iloc[0]})

    blocks = subroots.select("tree", _block(size), "pos", "total", "digest", "name").groupBy("tree", "block")
    above = checkpoint(blocks.cogroup(descended(over, top, size).groupBy("tree", "block")).applyInPandas(join_sources, f"tree string, {PATH}"))

    def join_leaves(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, left, right = _finish(rows, outer, size)
        folded = []
        for node, before, after in zip(rows["now"], left, right):
            for a, b in zip(before, after):
                node = digest(a, node, b)
            folded.append(node)
        root = outer["root"].iloc[0]
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"], "source": rows["source"], "pos": rows["pos"], "leaf": rows["digest"], "subroot": outer["subroot"].iloc[0], "root": root,
                "proof_sha256": [digest(*[x for level in zip(a, b) for x in level]) for a, b in zip(left, right)], "folded_root": folded, "verified": [f == root for f in folded],
            }
        )

    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    blocks = leaves.select("tree", _block(size), "pos", "total", "digest", "now", F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source")).groupBy("tree", "block")
    schema = "doc_id string, source string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = blocks.cogroup(descended(passes, above, size).groupBy("tree", "block")).applyInPandas(join_leaves, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind["doc_id"])).withColumn("source", F.col("source").cast(kind["source"]))

"""The Merkle manifest against a plain recomputation, and its hard cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, leaf string, own int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def tree(nodes):
    """The levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def proof(levels, at):
    """(left, right) of each level from a leaf to the root."""
    path = []
    for nodes in levels[:-1]:
        start = at - at % 3
        path.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + 3])))
        at //= 3
    return path


def plain(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for s in names:
        for at, (_, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            path = proof(trees[s], at) + proof(top, names.index(s))
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            fold = own if odd else leaf(r, r[1] and r[1].replace("\n", ""))
            for a, b in path:
                fold = H(a, fold, b)
            out.append((r[0], own, trees[s][-1][0], root, H(*[x for p in path for x in p]), fold, fold == root))
    return out


def found(spark, rows, size=merkle.SUPERBLOCK):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS)
    got = merkle.manifest(docs, merkle.tampered(), F.replace(F.col("text"), F.lit("\n"), F.lit("")), size)
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def made(n, sources, seed=0):
    draw = np.random.default_rng(seed)
    rows = [(int(i), "a\nb" * int(draw.integers(0, 4)), "en", sources[int(draw.integers(len(sources)))], 3) for i in draw.permutation(n)]
    # Nulls in every column, repeated rows and ids, other alphabets.
    return rows + [(None, "x\ny", None, None, None), (None, None, None, None, None), (5, "x", "é", "Z", 1), (5, "x", "é", "Z", 1), (5, "y", "é", "Z", 1), (7, None, "en", "\U0001F600", 0), (8, "", "en", "é", -2), rows[0]]


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("n, block", [(60, 3), (300, 9), (80, 2187)])
def test_equal_to_a_plain_manifest(spark, n, block):
    """Small superblocks take several passes up and down; half of the rows sit in one source."""
    rows = made(n, ["a", "a", "a", "b", "c", "", "ab", *[f"s{i}" for i in range(20)]])
    got, want = found(spark, rows, block), plain(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[-1] for r in got} == {True, False}


def test_a_lone_row_and_an_empty_table(spark):
    rows = [(1, "a\nb", "en", "s", 3)]
    assert found(spark, rows) == plain(rows) and found(spark, rows)[0][1] == found(spark, rows)[0][3]
    assert found(spark, []) == []


def test_a_changed_row_fails_alone(spark):
    rows = made(40, ["a", "b"])
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS)
    got = merkle.manifest(docs, F.coalesce(F.col("doc_id") == 11, F.lit(False)), F.lit("other")).collect()
    assert {r.doc_id for r in got if not r.verified} == {11}
    assert all(r.folded_root == r.root for r in merkle.manifest(docs).collect())

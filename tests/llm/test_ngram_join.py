"""The n-gram join against all pairs, and its hard cases."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, node string, size int, gram string, root int, lowest string"


def gram_set(text, size=4):
    found = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not found:
        return frozenset()
    return frozenset(" ".join(found[i : i + size]) for i in range(len(found) - size + 1)) or frozenset([" ".join(found)])


def plain(docs, percent=85):
    sets = [gram_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    lowest = {}
    for i, (doc, _) in enumerate(docs):
        lowest.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in lowest.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def found(spark, docs, **options):
    rows = ngram_join.linked(spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in docs], DOCS), **options).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def varied(draw, base, changes):
    out = list(base)
    for at in draw.integers(0, len(out), changes):
        out[at] = f"z{draw.integers(1000)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Families of near copies on both sides of the threshold, chains of them, a passage that many share, and hard texts."""
    draw = np.random.default_rng(8)
    word = lambda: f"w{draw.integers(400)}"
    passage = [word() for _ in range(50)]
    docs, at = [], 100
    for size in (4, 5, 7, 12, 30, 80, 200, 600):
        for _ in range(3):
            text = [word() for _ in range(size)]
            for _ in range(10):
                docs.append((at, " ".join(text)))
                text, at = varied(draw, text, int(draw.integers(0, max(2, size // 40)))), at + 1
    for _ in range(60):
        own = [word() for _ in range(int(draw.integers(10, 60)))]
        docs.append((at, " ".join([*own, *passage, *own[::-1]])))
        at += 1
    docs += [docs[5], docs[5], (None, docs[5][1]), (None, None), (None, "lone words of no id"), (1, None), (2, ""), (3, "\t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, "TWO\twords"), (8, "Übung \U0001F600"), (9, docs[40][1].upper())]
    docs.append((10, " ".join(word() for _ in range(20000))))
    docs.append((11, docs[-1][1] + " end"))
    return docs


def test_equal_to_all_pairs(spark, corpus):
    assert found(spark, corpus) == plain(corpus)


def test_blocks_and_frequent_grams(spark, corpus, monkeypatch):
    """Small blocks of files and groups, and a count of frequent n-grams that many n-grams reach: the same links."""
    monkeypatch.setattr(ngram_join, "FILE_BLOCK", 7)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 300)
    monkeypatch.setattr(ngram_join, "PART", 500)
    monkeypatch.setattr(ngram_join, "LEAST", 1)
    assert found(spark, corpus) == plain(corpus)


@pytest.mark.parametrize("percent", [50, 100])
def test_other_thresholds(spark, corpus, percent):
    docs = corpus[:240:2] + corpus[-17:-2]
    assert found(spark, docs, percent=percent) == plain(docs, percent)


def test_tree_against_all_pairs():
    """The spanning forest connects what similar pairs connect, whatever the sets share."""
    draw = np.random.default_rng(1)
    for _ in range(30):
        sets = {tuple(np.unique(draw.integers(0, 40, draw.integers(1, 25)))) for _ in range(40)}
        sets = [np.array(s, dtype=np.uint64) for s in sorted(sets)]
        links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
        edges = [tuple(sorted(e)) for e in ngram_join.tree_forest(sets, 60)]
        assert set(edges) <= set(links) and len(edges) < max(1, len(sets))

        def parts(pairs):
            parent = list(range(len(sets)))
            for a, b in pairs:
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
            top = []
            for i in range(len(sets)):
                while parent[i] != i:
                    i = parent[i]
                top.append(i)
            return top

        assert parts(edges) == parts(links)


def test_subtrees_are_pruned():
    """Sets whose lengths or paths rule the similarity out are not visited: a probe of a family meets that family's paths alone."""
    sets = sorted((np.arange(k * 1000, k * 1000 + 50 + j) for k in range(20) for j in range(5)), key=lambda s: s.astype(">u4").tobytes())
    tree = ngram_join.Trie(sets)
    mark = np.zeros(30000, dtype=bool)
    mark[sets[0]] = True
    visited = []
    tree.left = type("Seen", (list,), {"__getitem__": lambda self, k: (visited.append(k), list.__getitem__(self, k))[1]})(tree.left)
    assert sorted(tree.similar(0, mark, 85)) == [0, 1, 2, 3, 4]
    assert len(visited) <= 1 + 20 + 10


def test_empty_and_blank(spark):
    assert found(spark, []) == [] and found(spark, [(3, None), (4, " ")]) == [(3, 0, 3), (4, 0, 4)]
    with pytest.raises(ValueError):
        ngram_join.linked(spark.createDataFrame([], DOCS), percent=0)


def test_frequent_grams_come_last(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST", 5)
    docs = spark.createDataFrame([(i, f"own{i} of this document here and a line that all of them share", "x", 1, "y", 2, "z") for i in range(50)], DOCS).coalesce(1)
    known = ngram_join.frequent(docs, 4)
    one = ngram_join.gram_set(b"own1 of this document here and a line that all of them share", 4)
    last = ngram_join.ordered(one, known)
    assert len(known[0]) == len(one) - 1 and set(last) == set(one) and last[0] not in known[0]
    assert docs.select(F.count("text")).first()[0] == 50

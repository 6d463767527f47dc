"""Ranked search against a plain recomputation, and its hard cases."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, term string, members int, score string"
ITEMS = "item_id long, text string, item int, place string, doc_id int"


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, items, k=10):
    """[(item_id, [(doc_id, score), ...])] per item row."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n_docs) // length if length else 10
            gain = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if gain > 0:
                scored.append((-gain, doc is None, doc or 0, doc))
        out.append((item, [(d, -s) for s, _, _, d in sorted(scored, key=lambda x: x[:3])[:k]]))
    return out


def found(spark, docs, items, k=10):
    left = spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], ITEMS)
    rows = search.search(left, right, k).orderBy("item_id", "rank").collect()
    assert all(r["rank"] >= 1 for r in rows)
    return rows


def same(rows, want):
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.item_id), r["rank"])):
        got[r.item_id].append((r.doc_id, r.score))
    assert dict(got) == {i: x for i, x in want if x}
    for i in got:
        assert sorted(r["rank"] for r in rows if r.item_id == i) == list(range(1, len(got[i]) + 1))


@pytest.fixture(scope="module")
def corpus():
    draw = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Übung", "naïve", "x1"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)

    def text(n):
        return " ".join(draw.choice(vocabulary, n, p=weights / weights.sum()))

    docs = [(i, text(int(draw.integers(0, 60)))) for i in range(150)]
    # Copies, copies with other words outside of the items' vocabulary, repeated rows, null ids, null and blank texts, a long one.
    docs += [(200 + i, docs[7][1]) for i in range(25)] + [(300 + i, docs[7][1].replace("w50", "w51")) for i in range(5)]
    docs += [docs[3], (None, docs[7][1]), (None, None), (400, None), (401, ""), (402, " ,.\n"), (403, text(30000))]
    items = [(i, text(int(draw.integers(1, 12)))) for i in range(20)] + [(50, None), (51, ""), (52, "unheard of"), (53, "W1! w1-W1"), (54, docs[7][1])]
    return docs, items


def test_equal_to_a_plain_search(spark, corpus):
    same(found(spark, *corpus), plain(*corpus))


def test_blocks_and_small_batches(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_PAIRS", 20)
    monkeypatch.setattr(search, "CELLS", 40)
    same(found(spark, *corpus, k=3), plain(*corpus, k=3))


def test_repeated_items_are_ranked_each(spark):
    rows = found(spark, [(1, "a b"), (2, "a")], [(9, "a"), (9, "a"), (None, "b")], k=1)
    assert [(r.item_id, r["rank"]) for r in rows] == [(None, 1), (9, 1), (9, 1)] and len({r.score for r in rows if r.item_id == 9}) == 1


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, None)]) == []


def test_a_class_of_copies_is_scored_once(spark, corpus):
    docs, items = corpus
    terms_of = search.item_terms(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], ITEMS))
    bags = search.vectors(spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in docs], DOCS), search.vocabulary_filter(terms_of))
    kinds = search.classes(bags, 150, 4000, 10)
    of = kinds.where(F.exists("members", lambda m: m["doc_id"] == 7)).collect()
    # The first ten members, though over thirty documents share the vector.
    assert [m.doc_id for m in of[0].members] == [7, *range(200, 209)] and len(of) == 1

"""Ranked search against an exhaustive ranking."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _exhaustive(docs, items, top=10):
    counts = [(k, Counter(_terms(t))) for k, t in docs]
    n_all = sum(bool(c) for _, c in counts)
    n_terms = sum(c.total() for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in items:
        scored = []
        for k, c in counts:
            m = 25 + (75 * c.total() * n_all) // max(1, n_terms)
            parts = [math.floor(1000 * math.log((2 * n_all + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in _terms(text) if c[t]]
            if sum(parts) > 0:
                scored.append((-sum(parts), k))
        rows += [(item, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scored)[:top])]
    return sorted(rows)


def test_search_equals_the_exhaustive_ranking(spark):
    draw = np.random.default_rng(3)
    words = ["the", "of", "Ñandú", "naïve", "x1", "日本", *(f"w{k}" for k in range(60))]
    odds = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(draw.choice(words, draw.integers(0, 80), p=odds / odds.sum())) for _ in range(300)]
    docs = [*enumerate(texts), (300, None), (301, ""), (302, "!?"), (303, texts[5]), (304, texts[5]), (305, "the " * 50_000 + "w7\x00w8")]
    items = [(1, texts[5]), (2, "the the THE w7"), (3, None), (4, "unheard"), (5, "naïve_日本 Ñandú ñandú"), (6, "w59 w58 of")]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([*items, items[0]], "item_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == _exhaustive(docs, items)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_hybrid_evaluation_skips_nothing(data):
    """Windows, blocks, short and long lists of one segment against plain sums."""
    size = data.draw(st.integers(1, 6000))
    draw = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    n = draw.integers(1, 400, size)
    m = lexical.lengths(n, size, int(n.sum()))
    lists, total = [], np.zeros(size, np.int64)
    for share in draw.random(data.draw(st.integers(1, 8))) ** 3:
        docs = np.flatnonzero(draw.random(size) < share)
        if len(docs):
            counts, weight = draw.integers(1, 5, len(docs)), int(draw.integers(0, 4000))
            at = np.arange(0, len(docs), lexical.BLOCK)
            lists.append((weight, lexical.Postings(docs, counts, np.maximum.reduceat(counts, at), np.minimum.reduceat(n[docs], at))))
            total[docs] += weight * lexical.saturated(counts, m[docs])
    places, scores = lexical.best(lists, m, dict(zip(n.tolist(), m.tolist(), strict=True)))
    expect = np.lexsort((np.arange(size), -total))[:10]
    expect = expect[total[expect] > 0]
    assert places.tolist() == expect.tolist()
    assert scores.tolist() == total[expect].tolist()


def test_null_ids_repeats_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, segment string, term int, id int, score string"
    docs = spark.createDataFrame([(2, "a b", "s", 1, 1, "x"), (None, "a b", None, None, None, None), (2, "a b", "s", 1, 1, "x"), (3, "c", "s", 1, 1, "x")], schema)
    items = spark.createDataFrame([(None, "a", 1), (7, "B", 2)], "item_id long, text string, rank int")
    found = sorted(((r["item"], r["rank"], r["id"]) for r in lexical.search(docs, items).collect()), key=str)
    assert found == sorted([(k, r, i) for k in (None, 7) for r, i in ((1, None), (2, 2), (3, 2))], key=str)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0

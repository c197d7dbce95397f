"""Near copies beyond the fingerprint radius, against a brute search."""

import itertools

import numpy as np

from pagemill.llm import simhash


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]


def _find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def _copies():
    """Copies with a few changed words; a crowd of them in one bucket; a chain; the same words in other
    orders, which only the exact check tells apart."""
    rng = np.random.default_rng(5)
    words, texts = [f"w{k}" for k in range(400)], []
    for n in [1] * 20 + [3] * 10 + [70]:
        base = list(rng.choice(words, 300))
        texts.append(" ".join(base))
        for _ in range(n):
            copy = list(base)
            for at in rng.integers(0, 300, 4):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy))
    base = list(rng.choice(words, 120))
    texts += [" ".join(rng.permutation(base)) for _ in range(30)]
    looser = list(rng.choice(words, 200))
    for _ in range(40):
        copy = list(looser)
        for at in rng.integers(0, 200, 7):
            copy[at] = str(rng.choice(words))
        texts.append(" ".join(copy))
    return [*texts, "one two", "ONE  two", "one three"]


def test_similar_texts_beyond_the_radius_share_a_class(spark):
    texts = _copies()
    sets, codes = _sets(texts), [simhash.fingerprint(t.encode()) for t in texts]
    root, pairs = list(range(len(texts))), []
    for a, b in itertools.combinations(range(len(texts)), 2):
        similar = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        if similar:
            pairs.append((a, b))
        if similar or (codes[a] ^ codes[b]).bit_count() <= simhash.RADIUS:
            low, high = sorted((_find(root, a), _find(root, b)))
            root[high] = low
    rows = {r["id"]: r["component_id"] for r in simhash.classes(_docs(spark, texts), similar=0.8).collect()}
    assert rows == {k: _find(root, k) for k in rows}
    assert sum((codes[a] ^ codes[b]).bit_count() <= simhash.RADIUS for a, b in pairs) < 0.5 * len(pairs)


def test_the_prefix_filter_loses_no_similar_pair(spark):
    """Random sets of many sizes and overlaps; classes alternate by fours."""
    draw = np.random.default_rng(12)
    base = [draw.choice(3000, 60, replace=False) for _ in range(4)]
    sets = []
    for k in range(90):
        own = set(base[k % 4][: draw.integers(20, 61)].tolist())
        sets.append(sorted(own | set((10_000 + draw.choice(200, draw.integers(0, 9))).tolist())))
    frame = spark.createDataFrame([*enumerate(sets)], "code long, grams array<long>")
    members = spark.createDataFrame([(k, k // 4 % 2) for k in range(90)], "code long, root long")
    found = {tuple(r) for r in simhash._apart(members, frame, 0.8).distinct().collect()}
    similar = set()
    for a, b in itertools.combinations(range(90), 2):
        x, y = set(sets[a]), set(sets[b])
        if a // 4 % 2 != b // 4 % 2 and len(x & y) >= 0.8 * len(x | y):
            similar.add((a, b))
    assert similar and similar <= found
    assert all(a // 4 % 2 != b // 4 % 2 for a, b in found)


def test_texts_of_one_template_below_the_similarity_meet_nowhere(spark):
    """1000 texts that share 70 % of their shingles pairwise: linear, not a million pairs."""
    shared = list(range(700))
    own = lambda k: [10_000 + 1000 * k + i for i in range(150)]
    frame = spark.createDataFrame([(k, shared + own(k)) for k in range(1000)], "code long, grams array<long>")
    members = spark.createDataFrame([(k, k) for k in range(1000)], "code long, root long")
    assert simhash._apart(members, frame, 0.8).count() == 0


def test_texts_a_little_below_the_similarity_seldom_meet(spark):
    """Each of 200 texts lacks 12 shingles of its template and has 12 of its own, so pairs have a
    similarity of about 0.73; what only one of the two lacks would allow 0.8."""
    draw = np.random.default_rng(4)
    template = draw.integers(-(2**62), 2**62, 150)
    sets = [[*draw.permutation(template)[12:].tolist(), *draw.integers(-(2**62), 2**62, 12).tolist()] for _ in range(200)]
    frame = spark.createDataFrame([*enumerate(sets)], "code long, grams array<long>")
    members = spark.createDataFrame([(k, k) for k in range(200)], "code long, root long")
    pairs = [(a, b) for a, b in itertools.combinations(range(200), 2)]
    similar = {(a, b) for a, b in pairs if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    found = {tuple(r) for r in simhash._apart(members, frame, 0.8).collect()}
    assert similar <= found and len(found) < len(pairs) / 10


def test_a_template_group_gives_pairs_in_proportion(spark, monkeypatch):
    """All candidate pairs of a whole run, counted where they are written."""
    counts, verified = [], simhash._verified

    def counting(pairs, nodes, docs, key, similar, folder):
        found = verified(pairs, nodes, docs, key, similar, folder)
        counts.append(spark.read.parquet(f"{folder}/pairs").count())
        return found

    monkeypatch.setattr(simhash, "_verified", counting)
    words = [f"t{k}" for k in range(200)]
    made = {}
    for n in (150, 300):
        counts.clear()
        texts = []
        for k in range(n):
            text, at = list(words), (k * 37) % 160
            text[at : at + 32] = [f"u{k}x{i}" for i in range(32)]
            texts.append(" ".join(text))
        assert len({r["component_id"] for r in simhash.classes(_docs(spark, texts), similar=0.8).collect()}) == n
        made[n] = sum(counts)
    assert made[300] < 3 * made[150]

"""What one batch asks of the language model's levels, against plain computations."""

import numpy as np
import pytest

from pagemill.llm import eliasfano as ef
from pagemill.llm import ngramlm

PAIRS = sorted({(k * 7919 % 400, k * 104729 % 9001) for k in range(4000)})


@pytest.fixture
def level(tmp_path):
    """A level of these pairs in three shards, whose children are the second numbers."""
    shards, meta = {}, []
    for a, b in PAIRS:
        shards.setdefault(int(ngramlm.spread(np.array([a]), 3)[0]), []).append((a, b))
    for number, pairs in shards.items():
        contexts, children = np.array(pairs).T
        start = ngramlm.firsts(contexts)
        index, width = np.searchsorted(contexts[start], contexts), int(children.max()) + 1
        arrays = ef.encode(contexts[start], "context") | ef.encode(np.append(start, len(contexts)), "pointer") | ef.encode(index * width + children, "child")
        ef.save(str(tmp_path), f"s{number}", arrays | {"width": np.array([width])} | ef.small(np.ones(len(contexts), np.int64), "count"))
        meta.append((number, len(contexts), f"s{number}"))
    return ngramlm.Level(str(tmp_path), meta, 3)


def test_a_context_is_looked_up_once_for_all_its_queries(level, monkeypatch):
    asked, find = [], ef.Sequence.find
    monkeypatch.setattr(ef.Sequence, "find", lambda self, keys: asked.append((self is not None and self.noted[0][:7], len(keys))) or find(self, keys))
    contexts = np.repeat(np.arange(-1, 420), 50)
    children = np.arange(len(contexts)) % 9001
    places = level.lookup(contexts, children)[0]
    held = set(PAIRS)
    assert [p >= 0 for p in places] == [(a, b) in held for a, b in zip(contexts.tolist(), children.tolist(), strict=True)]
    assert sum(n for name, n in asked if name == "context") == 420


def test_places_and_ranks_tell_every_pair(level):
    contexts, children = np.array(PAIRS).T
    places, ranks, _, left = level.lookup(contexts, children, ranked=True)
    assert sorted(places.tolist()) == list(range(len(PAIRS))) and (left == 1).all()
    assert ranks.tolist() == (np.arange(len(PAIRS)) - np.searchsorted(contexts, contexts)).tolist()
    assert (level.ranks(places) == ranks).all() and (level.counts(places) == 1).all()
    missing = level.lookup(np.array([500, -1, PAIRS[0][0]]), np.array([1, 1, 8999]), ranked=True)
    assert missing[0].tolist() == missing[1].tolist() == [-1, -1, -1]


@pytest.mark.parametrize("keys", [[], [0], [5] * 300 + [9], list(range(0, 900_000, 3)) + [2**61, 2**62], [0, 1, 2] + [2**40 + k for k in range(700)]])
def test_sequences_give_all_numbers_and_find_them(keys):
    keys = np.array(keys, np.int64)
    sequence = ef.Sequence(ef.encode(keys, "k"), "k")
    assert (sequence.every() == keys).all() and (sequence.access(np.arange(len(keys))) == keys).all()
    asked = np.concatenate([keys, keys + 1, [0, 7, 2**62]])
    assert (sequence.successor(asked) == np.searchsorted(keys, asked)).all()
    found = sequence.find(asked)
    assert ((found >= 0) == np.isin(asked, keys)).all() and (keys[found[found >= 0]] == asked[found >= 0]).all()


@pytest.mark.parametrize("top", [3, 2**40, 2**62])
def test_distinct_equals_numpy(top):
    keys = np.random.default_rng(1).integers(0, top, 5000)
    for ours, theirs in zip(ngramlm.distinct(keys), np.unique(keys, return_inverse=True), strict=True):
        assert (ours == theirs).all()


def test_packed_numbers_come_back():
    for numbers in ([], [0], [1, 255, 256, 2**63 - 1], [3] * 1000):
        assert ngramlm.unpacked(ngramlm.packed(np.array(numbers, np.uint64))).tolist() == numbers


def test_tokens_are_words_between_ascii_white_space():
    texts = [t.encode() for t in ("", " ", "A b\x0b\x0cÄ ä b", "\n\nx\x1c\x85y  ", " z", "a\x00b")]
    words, at, ends = ngramlm.tokenized(texts)
    runs = [[words[k] for k in part] for part in np.split(at, ends[:-1])]
    assert runs == [[*t.lower().split(), b"\n"] for t in texts]


def test_shares_are_gathered_before_they_are_dealt(level):
    rng = np.random.default_rng(2)
    keys = [np.unique(rng.integers(0, len(PAIRS), 40).astype(np.uint64) | np.uint64(k << 32)) for k in range(60)]
    parts = [(k, ngramlm.packed(np.diff(x, prepend=np.uint64(0))), ngramlm.packed(np.full(len(x), 3))) for k, x in enumerate(keys)]
    batches = [ngramlm._rows(parts[:25]), ngramlm._rows([]), ngramlm._rows(parts[25:])]
    out = [r for b in ngramlm.taken(iter(batches), level) for r in b.to_pylist()]
    assert len(out) == 3 < len([r for b in ngramlm.taken(iter(batches), level, most=1) for r in b.to_pylist()])
    got = {(r["part"], int(p)): int(n) for r in out for p, n in zip(np.cumsum(ngramlm.unpacked(r["keys"])), ngramlm.unpacked(r["counts"]), strict=True)}
    places, times = np.unique(np.concatenate(keys) & np.uint64(0xFFFFFFFF), return_counts=True)
    part, local = level.local(places.astype(np.int64))
    share = 3 * ngramlm.SCALE - round(ngramlm.DISCOUNT * ngramlm.SCALE)
    assert got == {(p, x): n * share for p, x, n in zip(part.tolist(), local.tolist(), times.tolist(), strict=True)}
    assert list(ngramlm.taken(iter([]), level)) == []

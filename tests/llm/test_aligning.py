"""Alignment of two tokenizers against a plain pairwise comparison."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import aligning, queries
from pagemill.llm.records import byte_letters

A, B = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.path(queries.PIECES)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    letters = "ab é\n  \t" + "ñ😀1,. <s>日本' "
    made = ["".join(draw.choices(letters, k=draw.randint(1, 300))) for _ in range(40)]
    fixed = ["", None, "Hello world", "  two  spaces ", "<|endoftext|> x", "<s> y </s><unk><0x41>", "a▁b", "\x00a", "ﬁne ①", "it's " * 3000]
    return [*fixed, *made, made[0]]


def _brute(texts):
    """Rows as the contract has them, from token byte ranges compared pair by pair."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    of = {c: b for b, c in enumerate(byte_letters())}
    docs, totals = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
        names = [second.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names, strict=True)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            docs.append(None)
            continue
        ends = [[0, *np.cumsum([len(x) for x in side]).tolist()] for side in (a_bytes, b_bytes)]
        links = []
        for i in range(len(a)):
            links += [(a[i], b[j]) for j in range(len(b)) if ends[0][i] < ends[1][j + 1] and ends[1][j] < ends[0][i + 1]] if len(a) < 900 else []
        if len(a) >= 900:
            cuts, j = sorted({*ends[0], *ends[1]}), 0
            links = [(a[np.searchsorted(ends[0], c, "right") - 1], b[np.searchsorted(ends[1], c, "right") - 1]) for c in cuts[:-1]]
        cuts, groups = sorted({*ends[0]} & {*ends[1]}), []
        for low, high in zip(cuts, cuts[1:], strict=False):
            sides = [",".join(str(x) for x, e in zip(ids, end[1:], strict=True) if low < e <= high) for ids, end in zip((a, b), ends, strict=True)]
            groups.append("|".join(sides))
        docs.append((len(a), len(b), groups, links))
        totals.update(links)
    highest = defaultdict(int)
    for (_, right), n in totals.items():
        highest[right] = max(highest[right], n)
    for doc in docs:
        if doc is None:
            yield (0, 0, 0, 0, "", 0, 0)
        else:
            n_a, n_b, groups, links = doc
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            yield (n_a, n_b, len(groups), len(links), digest, sum(totals[x] == highest[x[1]] for x in links), sum(totals[x] for x in links))


def test_alignment_equals_the_pairwise_comparison(spark, texts):
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(6)
    rows = aligning.align(frame, A, public_tokenizers.PATTERN, B).orderBy("id").collect()
    found = [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in rows]
    assert found == list(_brute(texts))
    assert sum(f[0] > 0 for f in found) > 40


def test_groups_are_the_digested_text(spark, texts):
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    groups = {r["id"]: r["groups"] for r in aligning.groups(frame, A, public_tokenizers.PATTERN, B).collect()}
    for r in aligning.align(frame, A, public_tokenizers.PATTERN, B).collect():
        text = groups[r["id"]]
        assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if text else "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60), st.data())
def test_lanes_change_nothing(a, b, data):
    """Any cut of a run into lanes gives the links and cuts of one lane."""
    short, long = sorted((a, b), key=sum)
    short = [*short, *[1] * (sum(long) - sum(short))]
    a_end, b_end = np.cumsum(long), np.cumsum(short)
    lanes = sorted({0, *data.draw(st.lists(st.integers(0, len(a_end) - 1)))})
    one, many = (aligning.lockstep(a_end, b_end, np.array(x)) for x in ([0], lanes))
    pairs = [sorted(zip(m.link_a.tolist(), m.link_b.tolist(), strict=True)) for m in (one, many)]
    a_start, b_start = a_end - long, b_end - short
    assert pairs[0] == pairs[1]
    assert pairs[0] == [(i, j) for i in range(len(a_end)) for j in range(len(b_end)) if a_start[i] < b_end[j] and b_start[j] < a_end[i]]
    assert one.cut_a.tolist() == many.cut_a.tolist()
    assert (a_end[one.cut_a].tolist(), b_end[one.cut_b].tolist()) == (sorted({*a_end.tolist()} & {*b_end.tolist()}),) * 2


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, part string, slots int, links string, id int"
    frame = spark.createDataFrame([(None,) * 6, (1, "same text", "p", 1, "l", 1), (1, "same text", "p", 1, "l", 1), (None, "same", "p", 1, "l", 1)], schema)
    rows = aligning.align(frame, A, public_tokenizers.PATTERN, B).collect()
    assert sorted((r["id"] is None, r["n_links"]) for r in rows) == [(False, 2), (False, 2), (True, 0), (True, 1)]
    assert aligning.align(frame.limit(0), A, public_tokenizers.PATTERN, B).count() == 0
    blank = frame.filter("text is null")
    assert [tuple(r) for r in aligning.align(blank, A, public_tokenizers.PATTERN, B).collect()] == [(None, 0, 0, 0, 0, "", 0, 0)]

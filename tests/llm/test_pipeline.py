"""The whole pipeline on a small fixture, each stage against a plain computation of its own input."""

import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = (
    "the of and to in is that for it was on are as with his they be at one have this from or had by not but what all were when we there "
    "can an your which their said if do will each about how up out them then she many some so these would other into has more her two like"
).split()


def _sentence(draw, n):
    return " ".join(draw.choice(WORDS) + (draw.choice(["", "ing", "er", "al"]) if draw.random() < 0.4 else "") for _ in range(n)) + "."


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of each stage; planted: junk, exact copies, near copies, passages of the benchmark."""
    draw = random.Random(21)
    items = [(k, _sentence(draw, 30)) for k in range(6)]
    texts = ["\n".join(_sentence(draw, 25) for _ in range(8)) for _ in range(50)]
    planted = {"junk": ["too short", "", None, "spam spam " * 200], "copy": [texts[0], texts[1], texts[1]], "near": [], "leak": []}
    for k in range(2, 8):
        words = texts[k].split(" ")
        words[90] = "changed"
        planted["near"].append(" ".join(words))
    for k, (_, item) in enumerate(items):
        planted["leak"].append(texts[20 + k].replace("\n", "\n" + item + "\n", 1) + _sentence(draw, 20 + k))
    rows = [(t, "plain") for t in texts] + [(t, kind) for kind, made in planted.items() for t in made]
    folder = str(tmp_path_factory.mktemp("sf"))
    frame = [(k, t, "en", ("web", "books", None)[k % 3], len(t or "")) for k, (t, _) in enumerate(rows)]
    spark.createDataFrame(frame, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {"documents": spark.createDataFrame(frame, DOCS).collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    out["kinds"] = {k: kind for k, (_, kind) in enumerate(rows)}
    out["items"], out["folder"] = items, folder
    return out


def test_stages_keep_the_columns_of_documents(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name] and set(stages[name][0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_quality_drops_junk_and_keeps_text(stages):
    kept = {r["doc_id"] for r in stages["quality_rules"]}
    for row in stages["documents"]:
        words = (row["text"] or "").split()
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = {w for w in windows if windows.count(w) > 1} if len(words) < 2000 else set()
        places = {p for at, w in enumerate(windows) if w in seen for p in (at, at + 1, at + 2)}
        failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
        if failed:
            assert row["doc_id"] not in kept
        elif stages["kinds"][row["doc_id"]] != "junk":
            assert row["doc_id"] in kept


def test_near_dedup_keeps_the_smallest_of_each_class(stages):
    rows = {r["doc_id"]: r["text"] for r in stages["quality_rules"]}
    shingles = {}
    for k, text in rows.items():
        words = text.lower().split()
        shingles[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {k: k for k in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(rows), 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert {r["doc_id"] for r in stages["near_dedup"]} == {find(k) for k in rows}
    assert len(rows) - len(stages["near_dedup"]) >= 9


def test_decontamination_drops_exactly_the_leaks(stages):
    before, after = ({r["doc_id"]: r["text"] for r in stages[name]} for name in ("near_dedup", "decontaminate"))
    held = {k for k, t in before.items() if any(item in t for _, item in stages["items"])}
    assert len(held) == 6 and set(before) - set(after) == held


def test_the_mix_comes_near_its_targets(stages):
    sizes = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in stages["decontaminate"]}
    times = {k: 0 for k in sizes}
    for r in stages["mix_sources"]:
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 2
    whole, taken = {}, {}
    for k, (source, n) in sizes.items():
        whole[source] = whole.get(source, 0) + n
        taken[source] = taken.get(source, 0) + n * times[k]
    ordered = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ordered)}
    target, free, rest = {}, set(ordered), 1.5 * sum(whole.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * whole[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2 * whole[s]
            rest -= target[s]
        free -= full
    for s in ordered:
        assert abs(taken[s] - target[s]) <= max(n for t, n in sizes.values() if t == s)


def test_records_hold_the_mix(stages):
    whole = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    expect, start = [], 0
    for row in sorted(stages["mix_sources"], key=lambda r: r["doc_id"]):
        ids = whole.encode(row["text"], add_special_tokens=False).ids + [0]
        expect.append((row["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in stages["token_records"])
    assert found == expect


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, stages["folder"]).drop("shard", "offset").collect()
    assert sorted(map(tuple, rows)) == sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in stages["token_records"])

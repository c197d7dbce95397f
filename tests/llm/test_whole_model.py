"""The query's model against a plain one that keeps every pair and triple."""

import math
import zlib
from collections import Counter

import pytest

from pagemill.llm import ngramlm, queries


def _plain(train):
    """Absolute discounting with interpolation over all counts."""
    single, double, triple = Counter(), Counter(), Counter()
    for run in train:
        whole = ["\n", *run]
        single.update(run)
        double.update(zip(whole, whole[1:], strict=False))
        triple.update(zip(whole, whole[1:], whole[2:], strict=False))
    d, taken2, taken1, context = ngramlm.DISCOUNT, Counter(), Counter(), Counter()
    left2, left3, gain2 = Counter(), Counter(), {}
    for (a, b, c), n in triple.items():
        taken2[b, c] += n - d
        context[b] += n - d
        left3[a, b] += (n - d) / double[a, b]
    for (a, b), n in double.items():
        rest = max(n - taken2[a, b] - d, 0)
        gain2[a, b] = rest / max(single[a] - context[a], 1e-12)
        left2[a] += gain2[a, b]
        taken1[b] += taken2[a, b] + rest
    total = sum(single.values()) - sum(taken1.values()) + len(single) + 1

    def log(run):
        out, whole = 0.0, ["\n", *run]
        for k in range(1, len(whole)):
            b, c = whole[k - 1], whole[k]
            p = (single[c] - taken1[c] + 1) / total
            p = gain2.get((b, c), 0) + (1 - left2[b]) * p
            if k > 1:
                a = whole[k - 2]
                p = max(triple[a, b, c] - d, 0) / max(double[a, b], 1) + (1 - left3[a, b]) * p
            out += math.log10(p)
        return out

    return log


@pytest.fixture(scope="module")
def table(spark, sf, tmp_path_factory):
    """Documents, and a held-out copy of a passage that training holds once."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fresh = [k for k in range(10**9, 10**9 + 200)]
    held = [k for k in fresh if zlib.crc32(str(k).encode()) % 7 == 2]
    seen = [k for k in fresh if k not in held]
    words = [r for _, t in rows for r in (t or "").lower().split()][:4000]
    once = " ".join(words[k * 37 % len(words)] for k in range(300))
    folder = str(tmp_path_factory.mktemp("once"))
    spark.createDataFrame([*rows, (seen[0], once), (held[0], once)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, held[0]


def test_scores_equal_a_plain_model_of_all_pairs_and_triples(spark, table):
    folder, copy = table
    got = {r["doc_id"]: r for r in queries.op3_score(spark, folder).collect()}
    runs = {r["doc_id"]: [w.decode() for w in (r["text"] or "").encode().lower().split()] + ["\n"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    log = _plain([r for k, r in runs.items() if not got[k]["held_out"]])
    for k, run in runs.items():
        assert got[k]["score"] == pytest.approx(log(run), rel=0.01, abs=0.5)
    pruned = {r["id"]: r["score"] for r in ngramlm.score(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert got[copy]["held_out"] and got[copy]["score"] > 0.6 * pruned[copy]

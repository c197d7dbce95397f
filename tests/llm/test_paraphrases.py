"""Paraphrases that keep 50 to 80 % of an item's words and its answer, against a brute search."""

import math

import numpy as np

from pagemill.llm import decontam


def test_paraphrases_with_half_of_the_words_and_the_answer_leak(spark, sf):
    rng = np.random.default_rng(3)
    hosts = [(r["text"] or "").split() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts, expect = [], set()
    for row in benchmark.collect():
        words, item = row["text"].split(), decontam.terms_of(row["text"].encode())
        answer = len(decontam.Items._last(row["text"].encode()))
        if len(words) != len(item) or len(item) < decontam.MIN_TERMS:
            continue
        for keep in (0.5, 0.55, 0.6, 0.7, 0.8):
            stay = math.ceil(keep * len(item)) - answer
            if not 0 <= stay <= len(item) - answer:
                continue
            kept = {*rng.choice(len(item) - answer, stay, replace=False).tolist(), *range(len(item) - answer, len(item))}
            host = hosts[int(rng.integers(len(hosts)))]
            at = int(rng.integers(len(host) + 1))
            passage = [w if k in kept else f"unknown{k}" for k, w in enumerate(words)]
            # The rule, by brute force over the passage: half of the item in order, and its answer.
            run = [t for w in passage for t in decontam.terms_of(w.encode())]
            assert decontam.lcs(decontam.Index._bits(item), len(item), run) >= decontam.LIKELY_SHARE * len(item)
            expect.add((len(texts), row["item_id"]))
            texts.append(" ".join([*host[:at], *passage, *host[at:]]))
    rows = decontam.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark).collect()
    found = {(r["id"], r["item_id"]) for r in rows}
    assert len(expect) > 50 and len(expect & found) >= 0.98 * len(expect), (len(expect & found), len(expect))
    assert all(r["share"] >= decontam.LIKELY_SHARE for r in rows)

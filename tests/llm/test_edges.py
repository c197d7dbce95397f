"""Empty tables, nulls in every column, repeated rows, and further columns with clashing names."""

import public_tokenizers
import pytest

from pagemill.llm import decontam, linededup, mixing, ngramlm, quality, queries, records, simhash, trietokens, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, tie int, words string, row int"
WORDS = "a b c " * 30
ROWS = [
    (1, WORDS, "en", None, 1, 1, "k", 1, "w", 1),
    (None,) * 10,
    (1, WORDS, "en", None, 1, 1, "k", 1, "w", 1),
    (3, "", "xx", "s", 0, 1, "k", 1, "w", 2),
]


def _leaks(docs):
    bench = docs.sparkSession.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    return decontam.without_leaks(docs, bench)


def _judged(docs):
    model = urlfilter.train(urlfilter.labelled(docs.sparkSession))
    return urlfilter.judge(docs, model, url="text")


JOBS = {
    "records": (lambda d: records.round_trip(d, public_tokenizers.path(queries.VOCABULARY)), 4),
    "mixing": (mixing.mix, 4),
    "scores": (ngramlm.score, 4),
    "lines": (linededup.drop_lines, 4),
    "leaks": (_leaks, 4),
    "tokens": (lambda d: trietokens.token_counts(d, public_tokenizers.path(queries.PIECES)), 4),
    "simhash": (simhash.one_of_each, 2),
    "similar": (lambda d: simhash.one_of_each(d, similar=simhash.SIMILAR), 2),
    "quality": (quality.assess, 4),
    "urls": (_judged, 4),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_edges(spark, name):
    job, n = JOBS[name]
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert job(frame.limit(0)).count() == 0
    found = len(job(frame).collect())
    assert n is None or found == n


def test_mix_of_nulls_and_repeats(spark):
    """Rows of no words are not taken; equal rows move together; a null source stands apart."""
    rows = [(r["row"]["doc_id"], r["size"], r["times"]) for r in mixing.mix(spark.createDataFrame(ROWS, SCHEMA)).collect()]
    assert sorted((d, n) for d, n, _ in rows if d is not None) == [(1, 90), (1, 90), (3, 0)]
    assert {t for d, _, t in rows if d == 1} == {1} or {t for d, _, t in rows if d == 1} == {2}


def test_an_empty_benchmark_leaks_nothing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "one two")], "item_id long, text string")
    assert decontam.without_leaks(docs, bench.limit(0)).count() == 4
    assert decontam.without_leaks(docs, bench).count() == 4


def test_a_very_long_text(spark):
    """A quarter of a million words of one text, beside a short one."""
    long = " ".join(f"w{k % 5000}" for k in range(250_000))
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, WORDS, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["id"]: r["n_tokens"] for r in ngramlm.score(docs).collect()}[1] == 250_001
    assert quality.assess(docs).count() == 2
    assert simhash.one_of_each(docs, similar=simhash.SIMILAR).count() == 2
    kept = linededup.drop_lines(docs).select("row.doc_id", "kept_text").collect()
    assert {r["doc_id"]: r["kept_text"] for r in kept}[1] == long

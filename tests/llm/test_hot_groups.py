"""One key with a third of all rows: what one row, range or salt holds stays bounded."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, linededup, mixing, oracles, queries

CHATS = "conv_id long, turn long, role string, text string"


def test_a_conversation_of_equal_turn_numbers_is_rendered_in_bounded_rows(spark):
    rows = [(None, 7, "user" if k % 2 else None, f"text {k}") for k in range(3000)]
    rows += [(None, None, "user", "first"), (None, 300, "user", "last"), (None, 300, "user", "last")]
    rows += [(1, t, "user", f"t{t}") for t in range(5)] + [(2, t, "user", f"t{t}") for t in range(3)]
    got = chat.render(spark.createDataFrame(rows, CHATS), rows=100).collect()
    hot = [r for r in got if r["conv_id"] is None]
    assert max(r["n_turns"] for r in got) < 200
    texts = [line for r in hot for line in r["chat"].split("\n") if line.endswith("<|end|>")]
    assert sorted(texts) == sorted([f"text {k}<|end|>" for k in range(3000)] + ["first<|end|>", "last<|end|>"])
    in_order = sorted(hot, key=lambda r: (r["part"], r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["slice"]))
    assert in_order[0]["chat"].startswith("<|user|>\nfirst") and in_order[-1]["chat"].startswith("<|user|>\nlast")
    # The shorter conversation is a prefix of the longer one and goes.
    assert [(r["conv_id"], r["n_turns"]) for r in got if r["conv_id"]] == [(1, 5)]


def test_a_long_turn_counts_by_its_bytes(spark):
    rows = [(1, k, "user", chr(97 + k) * 1000) for k in range(6)]
    got = chat.render(spark.createDataFrame(rows, CHATS), size=2500).collect()
    assert sorted((r["turn"], r["n_turns"]) for r in got) == [(k, 1) for k in range(6)]
    whole = chat.render(spark.createDataFrame(rows, CHATS)).collect()
    assert [(r["turn"], r["n_turns"]) for r in whole] == [(None, 6)]


def test_the_query_gives_a_part_of_many_rows_in_one_row_and_in_order(spark, tmp_path):
    rows = [(5, t, "user" if k % 2 else "assistant", f"text {t} {k}") for t in (3, 9, 260) for k in range(1500)]
    spark.createDataFrame(rows, CHATS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries.op9_chats(spark, str(tmp_path)).select("part", "n_turns", "n_logged", "chat").orderBy("part").collect()]
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    sql = oracles.oracle_sql()["op9_chats"]
    assert got == connection.execute(f"select part, n_turns, n_logged, chat from ({sql}) order by part").fetchall()
    assert [r[:3] for r in got] == [(0, 3000, 1), (1, 1500, 1)]


def test_null_turns_and_clashing_columns_of_chats(spark):
    schema = CHATS + ", part long, slice string, n long, c string"
    rows = [(None,) * 8, (1, None, None, "a", 1, "s", 1, "c"), (1, None, None, "a", 2, "s", 1, "c"), (1, 0, "user", None, 1, "s", 1, "c")]
    got = {r["conv_id"]: r for r in chat.render(spark.createDataFrame(rows, schema)).collect() if r["part"] == -1}
    assert got[1]["chat"] == "<||>\na<|end|>\n" and got[None]["n_turns"] == 1


@pytest.fixture(scope="module")
def repetitive(spark):
    """4000 documents of one source whose lines repeat, so that nearly all keys are large."""
    rows = [(k, ("line\n" * (3 + k % 40)) + f"own {k}", "s" if k % 3 else None) for k in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_ranges_follow_the_keys(spark, repetitive, tmp_path):
    thin = mixing.sized(repetitive).drop("row").cache()
    plan = mixing.targets(thin).withColumn("rest", F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size"))
    found = mixing.edges(thin, plan, str(tmp_path), rows=60).collect()
    assert found and max(r["n"] for r in found) <= 60


def test_narrow_ranges_change_no_draw(spark, repetitive):
    taken = [sorted((r["id"], r["times"]) for r in mixing.mix(repetitive, rows=n).select("row.doc_id", "times").toDF("id", "times").collect()) for n in (50, 100_000)]
    assert taken[0] == taken[1]
    assert {t for _, t in taken[0]} == {1, 2}


def test_a_line_of_every_document_is_dealt_over_salts(spark):
    rows = [(k, f"own {k}\nshared\nown again {k}") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = linededup.drop_lines(frame).select("row.doc_id", "kept_text", "n_dropped").collect()
    assert all(r["kept_text"] == f"own {r['doc_id']}\nown again {r['doc_id']}" and r["n_dropped"] == 1 for r in kept)
    places = linededup.line_hashes(frame).groupBy("h1", F.pmod(F.xxhash64("k1", "pos"), F.lit(linededup.SALTS)).alias("salt")).count()
    assert places.agg(F.max("count")).first()[0] < 400 / linededup.SALTS * 3

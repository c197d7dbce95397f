"""What a run leaves on disk: files of the model, and no shuffle files of what has ended."""

import os
import time

import numpy as np

from pagemill.llm import eliasfano as ef
from pagemill.llm import ngramlm
from pagemill.llm.store import freed, written


def _bytes(folder):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names)


def test_small_counts_take_a_byte_and_large_ones_stay_whole(tmp_path):
    counts = np.array([1, 254, 255, 256, 1, 10**12, 3], np.int64)
    ef.save(str(tmp_path), "counts", ef.small(counts, "count"))
    arrays = ef.load(str(tmp_path), "counts")
    assert arrays["count"].itemsize == 1
    assert ef.counts(arrays, "count").tolist() == counts.tolist()
    at = np.array([5, 0, 2, 3, 5, 1])
    assert ef.counts(arrays, "count", at).tolist() == counts[at].tolist()
    assert ef.counts(ef.small(counts[:0], "count"), "count").tolist() == []


def test_a_model_takes_few_bytes_an_ngram(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngramlm, "work_folder", lambda spark: str(tmp_path))
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 3000, 400))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngramlm.score(docs).count() == 300
    assert not {"words", "pairs", "triples"} & set(os.listdir(tmp_path))
    runs = [["\n", *t.split(), "\n"] for k, t in rows]
    ngrams = len({p for r in runs for p in zip(r, r[1:], strict=False)} | {p for r in runs for p in zip(r, r[1:], r[2:], strict=False)})
    levels = sum(os.path.getsize(f"{tmp_path}/{x}") for x in os.listdir(tmp_path) if x.startswith(("pairs-", "triples-")))
    assert levels < 8 * ngrams


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    with freed(spark):
        assert spark.conf.get(setting) == "true"
    assert spark.conf.get(setting) == before
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    live = lambda: {b.name() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(tracker.getAllBlocks()) if "shuffle_" in b.name()}
    held = live()
    written(spark.range(10_000).repartition(7, "id"), str(tmp_path / "out"))
    for _ in range(50):
        if not live() - held:
            break
        time.sleep(0.1)
    assert not live() - held

"""The latent space of op5_leaks and of the pipeline is fitted on every passage of every document."""

import numpy as np

from pagemill.llm import decontam


def test_the_fit_reads_all_documents(spark, sf, monkeypatch):
    seen, latent = [], decontam.latent
    monkeypatch.setattr(decontam, "FIT_DOCUMENTS", 1, raising=False)
    monkeypatch.setattr(decontam, "latent", lambda rows, items, idf: seen.append(rows.count()) or latent(rows, items, idf))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    decontam.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert seen == [docs.count()]


def test_products_equal_dense_ones(spark, sf, monkeypatch):
    monkeypatch.setattr(decontam, "ENTRIES", 64)
    rng = np.random.default_rng(5)
    items = decontam.Items(spark.read.parquet(f"{sf}/benchmark.parquet").limit(20).collect())
    runs = [rng.integers(0, len(items.vocabulary), n).astype("<i4") for n in (0, 1, 47, 48, 49, 300)]
    rows = spark.createDataFrame(
        [(len(r), np.arange(len(r), dtype="<i4").tobytes(), r.tobytes()) for r in runs], "n long, places binary, terms binary"
    ).repartition(3)
    idf = rng.random(len(items.vocabulary)) + 0.5

    def dense(pieces):
        out = np.zeros((len(idf), len(idf)))
        for piece in pieces:
            row = np.bincount(piece, minlength=len(idf)) * idf
            row /= np.linalg.norm(row)
            out += np.outer(row, row)
        return out

    right = rng.standard_normal((len(idf), 7))
    whole = dense([r[k : k + decontam.PASSAGE] for r in runs for k in range(0, len(r), decontam.PASSAGE)]) @ right
    own = dense([np.array(r) for r in items.runs]) @ right
    expect = whole / np.linalg.norm(whole) + own / np.linalg.norm(own)
    assert np.allclose(decontam.gram(rows, items, idf, right), expect, atol=1e-5)

"""The comparison of two versions extracts pages again only where their bytes differ."""

from pagemill.operators import derived, documents
from pagemill.plans import catalog


def test_pages_that_stay_are_extracted_once(spark, sf, monkeypatch):
    read, build = [], documents.build_documents
    monkeypatch.setattr(documents, "build_documents", lambda pages: read.append(pages.count()) or build(pages))
    catalog.queries()["shadow_comparison"](spark, sf)
    assert len(read) == 2 and 0 < read[1] < read[0] / 2


def test_pages_not_redone_are_equal(spark):
    shape = "page_id long, score int, content_digest string"
    left = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 5, "c"), (5, 7, "e")], shape)
    right = spark.createDataFrame([(2, 7, "x"), (4, 5, "d"), (5, 7, "e")], shape)
    redone = spark.createDataFrame([(2,), (3,), (4,), (5,)], "page_id long")
    rows = {tuple(r) for r in derived.shadow_comparison(left, right, redone).collect()}
    assert rows == {(1, "equal", 0), (2, "changed", 2), (3, "only_left", None), (4, "only_right", None), (5, "equal", 0)}

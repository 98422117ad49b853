"""Bucketed tables: merges without moving what is stored, counts from the write, checked vectors."""

import pytest

from loomspan.functions.text import chunks
from loomspan.operators.store import Store
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
LONG = " ".join(f"S{i} {'word ' * 30}end." for i in range(40))


@pytest.fixture()
def store(spark, tmp_path):
    docs = [(i, f"Title {i}\nAbstract of {i}.") for i in range(40)] + [(50, f"Long\n{LONG}"), (60, "Title alone"), (61, None), (62, "\nno title")]
    return Store(spark, f"file://{tmp_path}/store", 8).ingest(spark.createDataFrame(docs, DOCS))


def ledger(store):
    return {r.version: r for r in store.ledger().collect()}


def test_counts_and_failures_come_from_the_write(spark, store):
    first = ledger(store)[0]
    assert (first.status, first.seen, first.created, first.updated, first.skipped, first.failed) == ("failed", 44, 41, 0, 0, 3)
    assert first.errors == "60: no abstract\n61: no text\n62: no title"
    new = [(0, "Title 0\nAbstract of 0."), (1, "Title 1\nAnother."), (2, " Title  2 \n Abstract of 2. "), (100, "New\nOne."), (3, "gone")]
    second = store.ingest(spark.createDataFrame(new, DOCS))
    row = ledger(second)[1]
    assert (row.status, row.seen, row.created, row.updated, row.skipped, row.failed, row.chunks) == ("failed", 5, 1, 1, 2, 1, 2)
    papers = {r.doc_id: r.text for r in second.table("papers").collect()}
    assert len(papers) == 42 and papers[1] == "Title 1\nAnother." and papers[3] == "Title 3\nAbstract of 3."
    third = second.ingest(spark.createDataFrame(new[:3], DOCS))
    row = ledger(third)[2]
    assert (row.status, row.skipped, row.chunks) == ("success", 3, 0)
    assert third.table("chunks").count() == second.table("chunks").count()


def test_chunks_follow_their_papers(spark, store):
    want = spark.createDataFrame([(LONG,)], "t string").select(F.size(chunks(F.concat(F.lit("Long\n"), "t")))).first()[0]
    assert store.table("chunks").where("doc_id = 50").count() == want > 1
    short = store.ingest(spark.createDataFrame([(50, "Long\nno more")], DOCS))
    assert [r.text for r in short.table("chunks").where("doc_id = 50").collect()] == ["Long no more"]
    assert short.table("chunks").select("doc_id").distinct().count() == 41


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_what_comes_in_is_moved(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merge = plan(store.merged(spark.createDataFrame([(1, "a\nb")], DOCS)))
        assert merge.count("Exchange") == 1 and "REPARTITION_BY_NUM" in merge and "Bucketed: true" in merge
        changed = store.table("papers").where("changed").select("doc_id")
        assert "Exchange" not in plan(store.table("chunks").join(changed, "doc_id", "left_anti"))
        store.store_vectors(store.table("chunks").limit(5).select("doc_id", "chunk_index", F.array(F.lit(1.0), F.lit(2.0)).alias("vector")), 2)
        assert "Exchange" not in plan(store.unembedded())
        assert store.unembedded().count() == store.table("chunks").count() - 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_vector_of_another_width_fails_the_write(spark, store):
    for bad in ([1.0], None, [1.0, None], [1.0, float("nan")]):
        vectors = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, bad)], "doc_id long, chunk_index long, vector array<double>")
        with pytest.raises(Exception, match="instead of 2 numbers: 2#0"):
            store.store_vectors(vectors, 2)


def test_a_stopped_ingest_leaves_no_ledger_row_and_can_be_repeated(spark, store, monkeypatch):
    from loomspan.operators import store as module

    new = spark.createDataFrame([(1, "Title 1\nAnother.")], DOCS)
    with monkeypatch.context() as m:
        m.setattr(module, "chunk_table", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            store.ingest(new)
    assert set(ledger(store)) == {0}
    assert ledger(store.ingest(new))[1].updated == 1

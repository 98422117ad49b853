"""Every query of the reference's own operators against its SQL, and worked examples."""

import duckdb
import pandas as pd
import pytest

from loomspan.jobs import catalogue
from loomspan.operators import evaluation, retrieval

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    ours = catalogue.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_chunks_cover_every_sentence_and_overlap_by_one(spark):
    from pyspark.sql import functions as F

    from loomspan.functions.text import chunks

    text = " ".join(f"S{i} {'word ' * 20}end." for i in range(40))
    got = spark.createDataFrame([(text,)], "t string").select(chunks(F.col("t"), 100).alias("c")).first().c
    assert len(got) > 10
    assert all(a.split("S")[-1].strip() == b.split("S")[1].strip() for a, b in zip(got, got[1:]) if b.count("S") > 1)


def test_fusion_orders_by_score_then_id(spark):
    run = lambda ids: spark.createDataFrame([(1, d, r) for r, d in enumerate(ids, 1)], "item_id long, doc_id string, rank long")
    out = retrieval.fused({"x": run(["a", "b", "c"]), "y": run(["c", "a", "d"])}).orderBy("rank")
    assert [r.doc_id for r in out.collect()] == ["a", "c", "b", "d"]


def test_ndcg_of_a_worked_example(spark):
    runs = spark.createDataFrame([("m", 1, d, r) for r, d in enumerate("abcd", 1)], "mode string, item_id long, doc_id string, rank long")
    truth = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z")], "item_id long, doc_id string")
    row = evaluation.scores(runs, truth).first()
    assert row.ndcg_5 == pytest.approx((1 / 1.584962500721156 + 1 / 2.321928094887362) / (1 + 1 / 1.584962500721156 + 0.5), abs=1e-6)
    assert (row.precision_5, row.mrr, row.recall_1) == (0.4, 0.5, 0.0)


def test_hybrid_marks_a_missing_run_and_refuses_none(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "item_id long, doc_id string, rank long")
    assert {r.degraded for r in retrieval.hybrid({"x": run, "y": None}).collect()} == {True}
    assert {r.degraded for r in retrieval.hybrid({"x": run, "y": run}).collect()} == {False}
    with pytest.raises(ValueError):
        retrieval.hybrid({"x": None, "y": None})


def test_versions_of_names(spark):
    from pyspark.sql import functions as F

    from loomspan.functions.text import versioned

    names = ["2401.00001v2", "2401.00001", "hep-th/9901001v12", "v3", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(versioned(F.col("n")).alias("v")).collect()
    assert [tuple(r.v) for r in rows[:5]] == [("2401.00001", 2), ("2401.00001", 1), ("hep-th/9901001", 12), ("v3", 1), ("", 1)]
    assert rows[5].v.base is None


def test_a_document_is_complete_once_every_chunk_is_indexed(spark):
    from loomspan.operators import ingest

    state = spark.createDataFrame([(1, 0, True, True), (1, 1, False, True), (2, 0, True, False)], "doc_id long, chunk_index long, indexed boolean, embedded boolean")
    assert {r.doc_id: r.complete for r in ingest.completeness(state).collect()} == {1: False, 2: True}
    assert {(r.doc_id, r.chunk_index) for r in ingest.stale(state).collect()} == {(1, 1), (2, 0)}


def test_relevance_finds_every_containing_text(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two three"), (3, ""), (4, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "(alpha beta gamma delta) tail"), (11, "so one two three."), (12, None), (13, "one  two three")], "doc_id long, text string")
    assert sorted(map(tuple, evaluation.relevant(items, docs).collect())) == [(1, 10), (2, 11), (4, 10)]


def test_white_space_is_that_of_unicode(spark):
    from pyspark.sql import functions as F

    from loomspan.functions.text import abstained, n_words, squeezed

    rows = [("a\u00a0b c",), ("\u2003x\u3000\u3000y\x1fz\x85",), (" \n\n`insufficient_context`.\nno",), ("INSUFFICIENT_CONTEXT of it",)]
    df = spark.createDataFrame(rows, "t string").select("t", squeezed(F.col("t")).alias("s"), n_words(F.col("t")).alias("n"), abstained(F.col("t")).alias("a")).collect()
    assert [(r.s, r.n) for r in df[:2]] == [(" ".join(t.split()), len(t.split())) for (t,) in rows[:2]]
    assert [r.a for r in df] == [False, False, True, False]


def test_blank_queries_have_no_hits_and_dense_ranks_all_documents(spark):
    items = spark.createDataFrame([(1, " \u00a0\n"), (2, "alpha")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"alpha w{i}") for i in range(5)], "doc_id long, text string")
    for run in (retrieval.bm25(items, docs), retrieval.dense(items, docs)):
        assert [(r.item_id, r.rank) for r in run.orderBy("rank").collect()] == [(2, k) for k in range(1, 6)]


def test_fusion_refuses_what_would_mislead(spark):
    run = spark.createDataFrame([(1, "a", 0)], "item_id long, doc_id string, rank long")
    with pytest.raises(ValueError):
        retrieval.fused({"x": run}, k=-1)
    with pytest.raises(Exception, match="ranks begin at 1"):
        retrieval.fused({"x": run}).collect()
    with pytest.raises(ValueError, match="failed: y"):
        retrieval.hybrid({"x": run, "y": None}, tolerate_failure=False)


def test_modes_scored_on_different_items_are_an_error(spark):
    scored = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6), ("b", 2, 0.1)], "mode string, item_id long, m double")
    with pytest.raises(Exception, match="different items"):
        evaluation.mode_pairs(scored, "m").collect()


def test_medians_of_odd_even_and_repeated_values(spark):
    values = {"odd": [3, 1, 2], "even": [4, 1, 1, 9], "one": [5], "same": [2, 2, 2, 2]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: (r.n, r.middle, r.upper_middle) for r in evaluation.medians(df, "k", "v").collect()}
    assert got == {k: (len(vs), float(pd.Series(vs).median()), float(sorted(vs)[len(vs) // 2])) for k, vs in values.items()}


def test_replay_of_several_files_equals_one_pass(spark, sf_dir, tmp_path):
    from loomspan.streaming.replay import latest, replay

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3, "event_id").write.parquet(f"{tmp_path}/events")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    got = replay(spark, f"{tmp_path}/events", keys, order, parts=8)
    want = latest(events, keys, order).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_products_in_a_grid_equal_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "PACKED", 7)
    monkeypatch.setattr(retrieval, "CELL_ROWS", 20)
    monkeypatch.setattr(retrieval, "CELL_QUERIES", 10)
    x = np.random.default_rng(1).integers(-2, 3, (90, 4)).astype(float)
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, v binary")
    got = retrieval.ranked(retrieval.top_products(df, df, 5, but_own=True), 5).collect()
    for i in range(90):
        s = x @ x[i]
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-s[j], j))[:5]
        assert [r.doc_id for r in sorted((r for r in got if r.item_id == i), key=lambda r: r.rank)] == order


def test_an_answer_needs_passages_and_a_model(spark):
    from loomspan.operators import answering

    responses = spark.createDataFrame([(1, "So [1] [9] [1].", None), (2, "x [1]", None), (3, "x", "timed out"), (4, "INSUFFICIENT_CONTEXT", None), (5, "no marks", None)], "item_id long, text string, failure string")
    passages = spark.createDataFrame([(i, n, 10 * i + n) for i in (1, 3, 4, 5) for n in (1, 2)], "item_id long, number long, doc_id long")
    got = {r.item_id: r for r in answering.answers(responses, passages).collect()}
    assert (got[1].cited, got[1].invalid, got[1].cited_ids, got[1].grounded) == ([1, 9, 1], [9], [11], False)
    assert got[2].abstained and not got[2].degraded and got[2].cited == []
    assert got[3].degraded and not got[3].abstained and got[4].abstained and not got[5].abstained

"""Runs that are published whole or not at all, baselines, and listings by place."""

import re

import pytest

from loomspan.operators.evaluation import HEADLINE
from loomspan.operators.runs import RunLog, commit_of
from loomspan.sources.listing import Listing, default_order

KNOWN = {"papers": 5, "chunks": 7, "golden_set_version": 1, "top_k": 10}


def scored(spark, shift=0.0, items=4):
    rows = [(mode, i, *[0.5 + i / 10 - shift] * len(HEADLINE)) for mode in ("bm25", "dense") for i in range(items)]
    return spark.createDataFrame(rows, "mode string, item_id long, " + ", ".join(f"{m} double" for m in HEADLINE))


def test_a_later_gate_reads_a_stored_baseline(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/runs")
    first = log.publish(scored(spark), KNOWN, "abc")
    log.write_baseline("main", first, "dense")
    second = RunLog(spark, f"{tmp_path}/runs").publish(scored(spark, 0.1), KNOWN | {"papers": 6})
    assert (first, second) == (0, 1)
    got = {r.subject: r.failed for r in RunLog(spark, f"{tmp_path}/runs").gate("main", second, "dense").collect()}
    assert got == {"papers": True, "chunks": False, "queries": False, "golden_set_version": False, "top_k": False} | dict.fromkeys(HEADLINE, True)
    assert log.worse("main", second, "dense").count() == 4 and log.worse("main", first, "dense").count() == 0
    assert {(r.run, r.commit) for r in log.runs().collect()} == {(0, "abc"), (1, "")}
    assert log.queries().groupBy("run").count().orderBy("run").collect() == [(0, 8), (1, 8)]


def test_an_interrupted_publication_is_invisible(spark, tmp_path, monkeypatch):
    from loomspan.operators import runs

    log = RunLog(spark, f"{tmp_path}/runs")
    with pytest.raises(ValueError, match="no run"):
        log.runs()
    log.publish(scored(spark), KNOWN)
    with monkeypatch.context() as m:
        m.setattr(runs, "averages", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            log.publish(scored(spark, 0.2, 9), KNOWN)
    assert log.queries().count() == 8 and log.runs().select("run").distinct().count() == 1
    assert log.publish(scored(spark, 0.1), KNOWN) == 1
    assert log.queries().count() == 16


def test_what_has_no_provenance_or_baseline_is_refused(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/runs")
    with pytest.raises(ValueError, match="no chunks"):
        log.publish(scored(spark), {k: v for k, v in KNOWN.items() if k != "chunks"})
    run = log.publish(scored(spark), KNOWN)
    with pytest.raises(ValueError, match="no mode"):
        log.write_baseline("main", run, "hybrid")
    with pytest.raises(ValueError, match="no baseline"):
        log.gate("main", run, "dense")


def test_a_folder_without_commits_has_no_commit_id(tmp_path):
    assert commit_of(str(tmp_path)) == ""


def test_any_page_is_the_slice_of_the_whole_order(spark, tmp_path):
    rows = [(i, (i * 7919) % 1009, "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, published long, place2 string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listing = Listing.write(df, default_order("papers"), str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert listing.n == 1000 and Listing.open(spark, str(tmp_path)) == listing
    for number in (1, 2, 17, 50):
        page = listing.page(number).collect()
        assert [r.doc_id for r in page] == order[20 * number - 20 : 20 * number]
        assert [r.place for r in page] == list(range(20 * number - 19, 20 * number + 1))
    assert listing.page(51).collect() == []
    starts = {r.part: r.before for r in listing.starts().collect()}
    own = max(p for p, before in starts.items() if before < 781)
    plan = listing.page(40)._jdf.queryExecution().executedPlan().toString()
    assert len(starts) == 4 and re.search(r"PartitionFilters: \[[^\]]*_part", plan), plan
    assert {r.place for r in listing.rows([own]).collect()} >= {781}


def test_an_empty_listing_has_no_pages(spark, tmp_path):
    listing = Listing.write(spark.createDataFrame([], "doc_id long, published long"), default_order("papers"), str(tmp_path))
    assert listing.n == 0

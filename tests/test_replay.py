"""A replay that stops between or within batches and goes on equals one pass."""

import pytest

from loomspan.streaming import replay as S

KEYS, ORDER = ["user_id", "event_type"], ["ts", "event_id"]


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.fixture()
def files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4, "event_id").write.parquet(f"{tmp_path}/events")
    return events, f"{tmp_path}/events"


@pytest.mark.parametrize("stop", ["before the write", "before the commit", "after the commit"])
def test_a_run_that_stops_goes_on_where_it_was(spark, files, tmp_path, monkeypatch, stop):
    events, path = files
    root, calls = f"{tmp_path}/state", []
    plain_latest, plain_versions = S.latest, S.versions

    def stopping_latest(*a):
        calls.append(1)
        if len(calls) == 3 and stop == "before the write":  # the first call is for the schema
            raise RuntimeError("stopped")
        return plain_latest(*a)

    def stopping_versions(spark, base, before=None):
        if stop != "before the write" and before == (1 if stop == "before the commit" else 2):
            if stop == "before the commit":  # the second batch has written, but not committed
                new = plain_latest(events, KEYS, ORDER)
                new.withColumn("part", new["user_id"] * 0).write.mode("overwrite").partitionBy("part").parquet(f"{root}/version=1")
            raise RuntimeError("stopped")
        return plain_versions(spark, base, before)

    with monkeypatch.context() as m:
        m.setattr(S, "latest", stopping_latest)
        m.setattr(S, "versions", stopping_versions)
        with pytest.raises(Exception, match="stopped"):
            S.replay(spark, path, KEYS, ORDER, parts=8, root=root)
    want = S.latest(events, KEYS, ORDER)
    assert rows(S.snapshot(spark, root, want.schema)) != rows(want)
    got = S.replay(spark, path, KEYS, ORDER, parts=8, root=root)
    assert rows(got) == rows(want)


def test_a_later_call_takes_new_files_only(spark, files, tmp_path):
    events, path = files
    root = f"{tmp_path}/state"
    S.replay(spark, path, KEYS, ORDER, files_a_batch=2, parts=4, root=root)
    before = {v for v in S.versions(spark, root).values()}
    late = events.limit(50).withColumn("event_id", events["event_id"] + 10_000_000)
    late.coalesce(1).write.mode("append").parquet(path)
    got = S.replay(spark, path, KEYS, ORDER, files_a_batch=2, parts=4, root=root)
    assert rows(got) == rows(S.latest(events.unionByName(late), KEYS, ORDER))
    assert max(S.versions(spark, root).values()) == max(before) + 1

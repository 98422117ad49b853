"""What the driver and the workers hold doesn't grow with the tables."""

import pytest

from loomspan.llm import components, order_minhash, repeated_spans


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables that the near duplicates, their components and the repeated passages write."""
    seen = []
    for module in (components, order_minhash, repeated_spans):

        def table(df, purpose, write=module.table):
            seen.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
            return write(df, purpose)

        monkeypatch.setattr(module, "table", table)
    return seen


def test_no_growing_table_passes_through_the_driver(spark, sf_dir, plans):
    # all tables are small here, so that Spark broadcasts each that it may
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {name: f(docs) for name, f in (("classes", order_minhash.near_duplicates), ("kept", order_minhash.one_of_each), ("cut", repeated_spans.remove_repeats))}
    plans += [(name, df._jdf.queryExecution().executedPlan().toString()) for name, df in found.items()]
    assert {"shared-buckets", "pairs", "links", "edges", "open-blocks", "contexts"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []

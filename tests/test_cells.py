"""The vector index against a scan of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import retrieval as R
from loomspan.operators.cells import VectorIndex

ROWS = "vec_id long, embedding array<double>, colour string"


def clustered(n, seed, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 40, width))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, width)) * 0.15


def scan(x, ids, q, own, k):
    s = np.round(x @ q / np.sqrt((x * x).sum(1) * (q @ q)), 6)
    return [int(ids[i]) for i in sorted((i for i in range(len(ids)) if ids[i] != own), key=lambda i: (-s[i], ids[i]))[:k]]


@pytest.mark.parametrize("colour", [None, "red", "rare"])
def test_probed_cells_hold_every_neighbour_that_a_filter_leaves(spark, tmp_path, colour):
    x = clustered(2000, 3)
    x[100] = x[7]
    colours = ["rare" if i % 400 == 0 else "red" if i % 3 else "blue" for i in range(2000)]
    rows = [(i, x[i].tolist(), colours[i]) for i in range(2000)]
    rows += [(3000, None, "red"), (3001, [0.0] * 12, "red"), (3002, [1.0, 2.0], "red"), (3003, [float("nan")] * 12, "red"), (3004, [None] * 12, "red"), (None, x[0].tolist(), "red")]
    df = spark.createDataFrame(rows, ROWS)
    index = VectorIndex.build(df, f"{tmp_path}/cells", keep=("colour",))
    asked = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = index.search(asked.unionByName(asked), 10, None if colour is None else F.col("colour") == colour, but_own=True)
    hits = R.ranked(found.selectExpr("query_id AS item_id", "vec_id AS doc_id", "similarity AS score"), 10).collect()
    kept = np.array([i for i in range(2000) if colour in (None, colours[i])])
    for q in range(0, 2000, 100):
        assert [r.doc_id for r in sorted((r for r in hits if r.item_id == q), key=lambda r: r.rank)] == scan(x[kept], kept, x[q], q, 10)


def test_most_rows_of_clustered_vectors_are_not_read(spark, tmp_path):
    x = clustered(4000, 5)
    df = spark.createDataFrame([(i, v.tolist(), "red") for i, v in enumerate(x)], ROWS)
    index = VectorIndex.build(df, f"{tmp_path}/cells")
    asked = df.where("vec_id % 200 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    read = []
    plain = index._products
    object.__setattr__(index, "_products", lambda pairs, *a: (read.append(pairs.join(index.cells(), "cell").agg(F.sum("n")).first()[0] or 0), plain(pairs, *a))[1])
    index.search(asked, 10).count()
    assert sum(read) < 0.4 * 20 * 4000


def test_vectors_of_several_lengths_do_not_meet(spark):
    rows = [(i, [float(i + 1), 1.0], "x") for i in range(6)] + [(10 + i, [1.0, 2.0, float(i)], "x") for i in range(3)] + [(20, [0.0, 0.0], "x")]
    got = R.knn(spark.createDataFrame(rows, ROWS), 2, 3).collect()
    assert {r.query_id for r in got} == {0, 2, 4} and {r.vec_id for r in got} <= set(range(6))

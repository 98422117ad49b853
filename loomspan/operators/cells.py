"""A stored vector index: k-means cells, probed until the k-th score is safe.

Vectors are kept at unit length in the cell of their nearest centre, with the columns that
searches filter by. A cell's reach is the largest angle between its centre and a member, so that
a query can't score more in a cell than the cosine of its angle to the centre less the reach. A
search takes the cells with the best bounds first, then all cells whose bound is not below the
k-th score: its answer is that of a scan of all rows. A filter runs where rows are read, before
any product; a filtered search reaches further only if its cells held too few rows.

Centres are fitted on at most ``SAMPLE`` rows; every row is indexed. Of cells there are about
the root of the rows, ``MOST_CELLS`` at most, so that their centres fit in every task.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE, MOST_CELLS, ROUNDS = 16_384, 4096, 8
#: Cells of the first look, rows of a block of a cell, parts that cells are laid out in.
FIRST, BLOCK, PARTS = 8, 32_768, 32
#: Scores this near may round to a tie.
TIE = 1.1e-6


def usable(vector: Column) -> Column:
    """Not null or zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit length; one without members stays where it is."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.sqrt(np.square(sums).sum(1))
        centres[norm > 1e-12] = sums[norm > 1e-12] / norm[norm > 1e-12, None]
    return centres


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    root: str
    width: int

    @classmethod
    def build(cls, vectors: DataFrame, root: str, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> "VectorIndex":
        """An index of the usable vectors of the most common length (the smaller of two), with the columns ``keep``."""
        spark = vectors.sparkSession
        rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *keep)
        sizes = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
        if sizes is None:
            raise ValueError("no usable vector")
        index, rows = cls(spark, root, sizes.width), rows.where(F.size("vector") == sizes.width)
        sample = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).collect()
        centres = fitted(units(np.array([r.vector for r in sample])), max(1, min(MOST_CELLS, int(sizes["count"] ** 0.5))))

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = units(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, centres.shape[1]))
                near = x @ centres.T
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1)) if len(x) else np.zeros(0)
                own = {"id": batch.column("id"), "v": pa.array([v.tobytes() for v in x], pa.binary()), "cell": pa.array(cell, pa.int32()), "angle": pa.array(angle, pa.float64())}
                yield pa.record_batch(own | {c: batch.column(c) for c in keep})

        kinds = "".join(f", {c} {dict(rows.dtypes)[c]}" for c in keep)
        placed = rows.mapInArrow(assigned, f"id long, v binary, cell int, angle double{kinds}").withColumn("part", F.pmod("cell", F.lit(PARTS)))
        placed.hint("rebalance", F.col("part")).sortWithinPartitions("part", "cell").write.mode("overwrite").partitionBy("part").parquet(index._path("rows"))
        reach = index.rows().groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach"))
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")  # ``MOST_CELLS`` at most
        known.join(reach, "cell").write.mode("overwrite").parquet(index._path("cells"))
        return index

    def _path(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self._path("rows"))

    def cells(self) -> DataFrame:
        return self.spark.read.schema("cell int, centre array<double>, n long, reach double").parquet(self._path("cells"))

    def search(self, queries: DataFrame, k: int, where: Column | str | None = None, but_own: bool = False) -> DataFrame:
        """(query_id, vec_id, similarity): for queries (id, vector) their best ``k`` rows, and what may tie with the last."""
        from loomspan.sources.staging import staged

        known = self.cells().orderBy("cell").collect()  # ``MOST_CELLS`` at most
        centres, reach = np.array([r.centre for r in known]), np.array([r.reach for r in known])
        names = np.array([r.cell for r in known])

        def bounds(batch: pd.DataFrame) -> np.ndarray:
            x = np.frombuffer(b"".join(batch["v"]), np.float64).reshape(len(batch), -1)
            angle = np.arccos(np.clip(x @ centres.T, -1, 1))
            return np.cos(np.maximum(angle - reach - 1e-9, 0))

        def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Pairs of queries and cells: the first ones, or with a last score the others that may matter."""
            for batch in batches:
                if not len(batch):
                    continue
                bound = bounds(batch)
                order = np.argsort(-bound, axis=1, kind="stable")
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order[:, :FIRST], True, 1)
                if "last" in batch:
                    first = ~first & (bound >= batch["last"].to_numpy()[:, None] - TIE)
                q, c = np.nonzero(first)
                yield pd.DataFrame({"item": batch["id"].to_numpy()[q], "q": batch["v"].to_numpy()[q], "cell": names[c]})

        same = F.size("vector") == self.width
        asked = queries.where(usable(F.col("vector")) & same & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["id"])

        def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = units(np.stack(batch["vector"].to_numpy())) if len(batch) else []
                yield pd.DataFrame({"id": batch["id"], "v": [v.tobytes() for v in x]})

        asked = staged(asked.mapInPandas(unit, "id long, v binary"), "vector-queries")
        pairs = "item long, q binary, cell int"
        near = staged(self._products(asked.mapInPandas(picked, pairs), k, where, but_own), "near")
        last = near.groupBy("query_id").agg(F.sort_array(F.collect_list("similarity"), False).alias("s")).select(F.col("query_id").alias("id"), F.coalesce(F.get("s", F.lit(k - 1)), F.lit(-2.0)).alias("last"))
        rest = asked.join(last, "id", "left").withColumn("last", F.coalesce("last", F.lit(-2.0)))
        return near.unionByName(self._products(rest.mapInPandas(picked, pairs), k, where, but_own))

    def _products(self, pairs: DataFrame, k: int, where: Column | str | None, but_own: bool) -> DataFrame:
        from loomspan.sources.staging import staged

        pairs = staged(pairs, "cell-pairs")
        probed = [r.cell for r in pairs.select("cell").distinct().collect()]  # ``MOST_CELLS`` at most
        rows = self.rows().where(F.col("part").isin(sorted({c % PARTS for c in probed})) & F.col("cell").isin(probed))
        rows = rows.where(where) if where is not None else rows
        blocks = F.broadcast(self.cells().select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))  # ``MOST_CELLS`` at most
        rows = rows.select("id", "v", "cell").join(blocks, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        pairs = pairs.join(blocks, "cell").select("item", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(asked):
                return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
            ids = rows["id"].to_numpy()
            x = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(len(ids), -1)
            out = []
            for i in range(0, len(asked), 256):
                own = asked.iloc[i : i + 256]
                scores = np.frombuffer(b"".join(own["q"]), np.float64).reshape(len(own), -1) @ x.T
                for item, s in zip(own["item"], scores):
                    if but_own:
                        s[ids == item] = -np.inf
                    pick = np.flatnonzero(s >= np.partition(s, -k)[-k] - TIE) if len(s) > k else np.arange(len(s))
                    pick = pick[s[pick] > -np.inf]
                    out.append((np.full(len(pick), item), ids[pick], s[pick]))
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "similarity"), map(np.concatenate, zip(*out)))))

        grid = rows.groupBy("cell", "block").cogroup(pairs.groupBy("cell", "block"))
        return grid.applyInPandas(best, "query_id long, vec_id long, similarity double")

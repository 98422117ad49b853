"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

The codes: the signs of a centred vector after a rotation that an alternation of signs
and orthogonal Procrustes steps learns on a bounded sample (ITQ). The index: codes are
split into substrings of about log2(rows) bits, and each shard of vectors keeps, for each
substring, a table from value to rows. A search within Hamming radius r looks up, in the
table of each of the m substrings, the values that differ from the query's in at most r // m
bits, or one less beyond the first r % m + 1 of them: if all substrings differed by more, they
would differ by more than r, so by the pigeonhole principle no code within r is missed. Codes
within r are then ranked by exact distances.

The radius is learnt on the sample so that ``RECALL`` of its true neighbours' codes lie
within; the neighbours of the full table are nearer still. Queries with fewer than k
results within r are searched again with the radius of the whole code, exactly.

Shards and blocks of queries meet in a grid, both of a bounded number of rows, so that a
task holds one of each, and the grid grows with the table and the queries. Candidates' distances are computed in double precision on the original
vectors.

Defined cases: vectors that are null, empty, zero, of another length than most of the
sample, or that hold null or non-finite components take no part, as queries or as
candidates; ties go to the smaller id; a row that occurs twice is two candidates, but
a query once, with the rows of other ids; with fewer than k candidates all are returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import table

#: Rows at most that the rotation and the radius are learnt from.
SAMPLE = 4096
#: Rotations, each of as many bits as the vectors have dimensions.
ROTATIONS = 2
RECALL = 0.96
#: Rows of a shard and of a block of queries at most, of a shard at least where there are
#: fewer shards than tasks, and those that travel as one row.
SHARD, BLOCK, LEAST_SHARD, PACKED = 65_536, 32_768, 2048, 512


def usable(vector: Column) -> Column:
    """Not null or zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Codes:
    """Learned rotations, and the codes and radius they give."""

    def __init__(self, sample: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.centre = sample.mean(0)
        x = sample - self.centre
        d = x.shape[1]
        self.turns = []
        for _ in range(ROTATIONS):
            turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(20):
                u, _, v = np.linalg.svd(np.where(x @ turn >= 0, 1.0, -1.0).T @ x)
                turn = (u @ v).T
            self.turns.append(turn)
        self.bits = d * ROTATIONS
        self.radius = self._learn_radius(sample)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of zeros and ones."""
        return np.concatenate([(x - self.centre) @ t >= 0 for t in self.turns], 1)

    def _learn_radius(self, sample: np.ndarray, k: int = 10) -> int:
        queries, codes = sample[:256], self.encode(sample)
        if len(sample) < 2:
            return self.bits
        away = np.square(queries[:, None] - sample[None]).sum(2) if len(sample) * len(queries) < 1 << 14 else (
            np.square(queries).sum(1)[:, None] + np.square(sample).sum(1)[None] - 2 * queries @ sample.T
        )
        np.fill_diagonal(away, np.inf)
        k = min(k, len(sample) - 1)
        near = np.argpartition(away, k - 1, axis=1)[:, :k]
        hamming = (codes[: len(queries), None] ^ codes[near]).sum(2)
        return int(np.quantile(hamming, RECALL))


def _packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, to count differing bits by."""
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1).view(np.uint64)


class Shard:
    """One shard's rows and, for each substring of their codes, a table from value to rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray):
        self.ids, self.vectors, self.codes = ids, vectors, _packed_bits(bits)
        wide = max(1, min(16, int(np.log2(max(2, len(ids))))))
        self.cuts = [slice(i, min(i + wide, bits.shape[1])) for i in range(0, bits.shape[1], wide)]
        self._masks: dict[tuple[int, int], np.ndarray] = {}
        self.tables = []
        for cut in self.cuts:
            values = self._values(bits, cut)
            starts = np.zeros((1 << (cut.stop - cut.start)) + 1, np.int64)
            np.cumsum(np.bincount(values, minlength=len(starts) - 1), out=starts[1:])
            self.tables.append((starts, np.argsort(values, kind="stable")))

    @staticmethod
    def _values(bits: np.ndarray, cut: slice) -> np.ndarray:
        return bits[:, cut] @ (1 << np.arange(cut.stop - cut.start))

    def _near(self, wide: int, each: int) -> np.ndarray:
        """What differs in at most ``each`` of ``wide`` bits."""
        if (wide, each) not in self._masks:
            every = np.arange(1 << wide)
            self._masks[wide, each] = every[np.bitwise_count(every) <= each]
        return self._masks[wide, each]

    def within(self, bits: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes lie within ``radius``, looked up by every substring's near values."""
        hit = np.zeros(len(self.ids), bool)
        each, more = divmod(radius, len(self.cuts))
        for i, (cut, (starts, order)) in enumerate(zip(self.cuts, self.tables)):
            near = each if i <= more else each - 1
            if near < 0:
                break
            own = int(self._values(bits[None], cut)[0])
            probes = own ^ self._near(cut.stop - cut.start, near)
            begin, size = starts[probes], starts[probes + 1] - starts[probes]
            some = size > 0
            begin, size = begin[some], size[some]
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            hit[order[at]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ _packed_bits(bits[None])).sum(1) <= radius]

    def nearest(self, query: np.ndarray, own: int, rows: np.ndarray, k: int) -> list[tuple[int, float]]:
        rows = rows[self.ids[rows] != own]
        away = np.sqrt(np.square(self.vectors[rows] - query).sum(1))
        if len(rows) > 4 * k:
            cut = np.partition(away, k - 1)[k - 1]
            rows, away = rows[away <= cut], away[away <= cut]
        order = np.lexsort((self.ids[rows], away))[:k]
        return list(zip(self.ids[rows[order]].tolist(), away[order].tolist()))


def _packed(rows: DataFrame, n: int) -> DataFrame:
    """Rows of up to ``n`` vectors each: no, ids and vectors as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), n):
                part = batch.iloc[i : i + n]
                ids = part["id"].to_numpy(np.int64)
                vectors = np.stack(part["vector"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"no": [int(ids[0])], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

    return rows.mapInPandas(pack, "no long, ids binary, vectors binary")


def search(rows: DataFrame, queries: DataFrame, codes: Codes, k: int, radius: int) -> DataFrame:
    """(query_id, vec_id, score): of each query the k nearest of each shard within radius."""

    def unpacked(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(b"".join(part["ids"]), np.int64)
        return ids, np.frombuffer(b"".join(part["vectors"]), np.float64).reshape(len(ids), -1)

    def probe(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(block):
            ids, x = unpacked(shard)
            index, everything = Shard(ids, x, codes.encode(x)), np.arange(len(ids))
            asked, y = unpacked(block)
            for q, vector, code in zip(asked.tolist(), y, codes.encode(y)):
                found = index.within(code, radius) if radius < codes.bits else everything
                out.extend((q, v, s) for v, s in index.nearest(vector, q, found, k))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    n, tasks = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-n // max(LEAST_SHARD, min(SHARD, n // tasks))))
    across = max(1, -(-queries.count() // BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    dealt = lambda n: F.pmod(F.xxhash64("no", "ids"), F.lit(n))
    shards = _packed(rows, PACKED).withColumn("down", dealt(down)).withColumn("across", each(across))
    blocks = _packed(queries, PACKED).withColumn("across", dealt(across)).withColumn("down", each(down))
    grid = shards.groupBy("down", "across").cogroup(blocks.groupBy("down", "across"))
    return grid.applyInPandas(probe, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of every usable query among all usable rows."""
    spark = rows.sparkSession
    pick = lambda df: df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows, queries = pick(rows), pick(queries).dropDuplicates(["id"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    lengths = [len(r.vector) for r in sample]
    d = max(set(lengths), key=lengths.count)
    codes = Codes(np.array([r.vector for r in sample if len(r.vector) == d]))
    same = F.size("vector") == d
    rows, queries = rows.where(same), queries.where(same)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    rank = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = table(rank(search(rows, queries, codes, k, codes.radius)), "near")
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = table(queries.join(full, "id", "left_anti"), "short-queries")
    if not short.isEmpty():
        again = rank(search(rows, short, codes, k, codes.bits))
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every query row of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding")

"""Vector codes of four bytes and more: every part of a vector as its codebook's nearest entry.

Components become integers, so that sums and distances are exact. Each part position has a
codebook, which starts as parts of the smallest ids and is refined in rounds: all parts are
assigned to their nearest entries, and every entry moves to the floored mean of its parts.

The nearest entry is found through grid cells. A part falls into a coarse cell, a box of
``CELL`` integers a side. For each cell that a task meets it keeps the entries that are not
dominated across the box: an entry goes if its least distance to the box exceeds the largest
distance of another one. Distances to the ball around the box rule out most entries by one
matrix product, those to the box itself most of the rest. Only what stays is evaluated, exactly
and on the part itself, so that equal and near parts share the work and no result depends on
what is kept. A task keeps ``KEPT`` cells a codebook at most and then begins anew.

A round is one pass over the vectors. A task sends one row for each entry that it used; the
codebooks, whose size doesn't depend on the rows, pass through the driver.

Defined cases: vectors that are null, hold null or non-finite components or have another length
than most (of equally common lengths, the smallest counts) take no part; zero vectors do. A
length that the parts don't divide is filled up with zeros. Components beyond ±10^14 count as
that. Equal ids are rows of their own, in order of their vectors where ids start a codebook; a
null id comes last there. With fewer vectors than entries, there are as many entries. An error
beyond 2^63 - 1 counts as that. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.shared import table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Side of a cell, a power of two, and the cells that a task keeps for each codebook.
CELL, KEPT = 16, 50_000
#: Components' bound, rows handled at once (their sums fit in 64 bits), groups that are broadcast.
BOUND, ROWS, SMALL = 10**14, 10_000, 100_000
MOST = 2**63 - 1


def finite(vector: Column) -> Column:
    """Not null, every component a finite number."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """Rows of components as integers, filled up to a multiple of the parts: (row, part, place)."""
    q = np.clip(np.floor(x.astype(np.float64) * SCALE), -BOUND, BOUND).astype(np.int64)
    q = np.pad(q, ((0, 0), (0, -q.shape[1] % PARTS)))
    return q.reshape(len(q), PARTS, -1)


class Cells:
    """One codebook, and of each coarse cell met the entries that may be nearest to a part in it."""

    def __init__(self, entries: np.ndarray):
        self.entries, self._slots, self._lists = entries, {}, []
        self._norms = np.square(entries.astype(np.float64)).sum(1)
        d = entries.shape[1]
        self._exact = math.isqrt(2**62 // max(1, d))  # differences up to it sum in 64 bits

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's entry and squared distance; ties go to the smaller entry."""
        cells = np.ascontiguousarray(parts // CELL)
        keys = [c.tobytes() for c in cells]
        if len(self._slots) > KEPT:
            self._slots, self._lists = {}, []
        new = {k: i for i, k in enumerate(keys) if k not in self._slots}
        at = np.fromiter(new.values(), np.int64, len(new))
        for i in range(0, len(at), 1024):
            self._lists.extend(self._undominated(cells[at[i : i + 1024]]))
        self._slots.update(zip(new, range(len(self._slots), len(self._slots) + len(new))))
        own = [self._lists[self._slots[k]] for k in keys]
        counts = np.fromiter(map(len, own), np.int64, len(own))
        row, entry = np.repeat(np.arange(len(own)), counts), np.concatenate(own)
        away = self._squared(parts[row], entry)
        starts = np.cumsum(counts) - counts
        least = np.minimum.reduceat(away, starts)
        hit = np.flatnonzero(away == np.repeat(least, counts))
        first = hit[np.diff(row[hit], prepend=-1) > 0]
        return entry[first], least

    def _squared(self, parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Exact squared distances of pairs; Python's integers where 64 bits could overflow."""
        apart = parts - self.entries[entry]
        if apart.size and np.abs(apart).max() > self._exact:
            return np.square(apart.astype(object)).sum(1)
        return np.einsum("ij,ij->i", apart, apart)

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """Of each cell the entries whose least distance is within the smallest largest one."""
        half = (CELL - 1) / 2
        centres = cells.astype(np.float64) * CELL + half
        norms = np.square(centres).sum(1)
        # what rounding may have done to distances of large components
        slack = 1e-12 * (norms[:, None] + self._norms)
        squared = norms[:, None] - 2 * centres @ self.entries.T.astype(np.float64) + self._norms
        ball = half * math.sqrt(centres.shape[1]) * (1 + 1e-9)
        low = np.sqrt(np.maximum(squared - slack, 0)) - ball
        high = np.sqrt(np.maximum(squared, 0) + slack) + ball
        row, entry = np.nonzero(low <= high.min(1, keepdims=True))
        apart = np.abs(centres[row] - self.entries[entry])
        least = np.square(np.maximum(apart - half, 0)).sum(1)
        largest = np.square(apart + half).sum(1)
        counts = np.bincount(row, minlength=len(cells))
        bound = np.minimum.reduceat(largest, np.cumsum(counts) - counts)
        stay = least * (1 - 1e-9) <= bound[row]
        row, entry = row[stay], entry[stay]
        return np.split(entry, np.flatnonzero(np.diff(row)) + 1)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield part, integers(flat.reshape(part.num_rows, width))


def _sums(books: np.ndarray, width: int) -> Callable:
    """A task's number of parts and sums by part position and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object)
        for _, q in _batches(batches, width):
            for p, own in enumerate(cells):
                entry, _ = own.nearest(q[:, p])
                some = np.zeros(books.shape[1:], np.int64)
                np.add.at(some, entry, q[:, p])
                n[p] += np.bincount(entry, minlength=len(n[p]))
                sums[p] += some
        part, entry = np.nonzero(n)
        rows = [[Decimal(int(v)) for v in sums[p, e]] for p, e in zip(part, entry)]
        yield pa.record_batch({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n[part, entry], pa.int64()), "sums": pa.array(rows, pa.list_(pa.decimal128(38, 0)))})

    return run


def _coded(books: np.ndarray, width: int) -> Callable:
    """Each row's code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch, q in _batches(batches, width):
            found = [own.nearest(q[:, p]) for p, own in enumerate(cells)]
            codes = np.stack([entry for entry, _ in found], 1).astype(np.uint8)
            # beyond 64 bits the sum is taken as Python's integers
            wide = any(away.dtype == object or away.max(initial=0) > MOST // PARTS for _, away in found)
            error = sum(away.astype(object) if wide else away for _, away in found)
            if wide:
                error = [min(int(e), MOST) for e in error]
            yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"), "code": pa.array([c.tobytes().hex() for c in codes], pa.string()), "error": pa.array(error, pa.int64())})

    return run


def refined(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round over all rows (vector)."""
    sums = rows.select("vector").mapInArrow(_sums(books, width), "part int, entry int, n long, sums array<decimal(38,0)>")
    place = sums.select("part", "entry", "n", F.posexplode("sums").alias("place", "s"))
    found = place.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy()
    for r in found.collect():  # a row for each component of the codebooks at most
        out[r.part, r.entry, r.place] = int(r.s) // r.n
    return out


def compressed(rows: DataFrame, id_col: str, vector_col: str, label_col: str, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of every usable row, the codebooks (part, entry, place))."""
    v = F.col(vector_col)
    usable = rows.where(finite(v)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vector"))
    common = usable.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    kind = "id: {0}, label: {1}".format(*(usable.schema[c].dataType.simpleString() for c in ("id", "label"))) + ", code: string, error: long"
    if common is None:
        return rows.sparkSession.createDataFrame([], kind), np.zeros((PARTS, 0, 0), np.int64)
    usable = usable.where(F.size("vector") == common.width)
    first = usable.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    books = integers(np.array([r.vector for r in first], np.float64).reshape(len(first), common.width)).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refined(usable, books, common.width)
    return table(usable.mapInArrow(_coded(books, common.width), kind), "vector-codes"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable ``embeddings``, with the errors of rows and labels."""
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    labels = F.broadcast(labels) if labels.limit(SMALL + 1).count() <= SMALL else labels
    both = codes.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

"""A stored inverted index: built without moving texts, searched by bounds, updated by segments.

Every task turns the documents it reads into runs of at most about ``RUN`` terms: the postings
of each term, as places within the run and counts, in blocks of ``BLOCK``. A block carries its
largest count and its least ratio of length to count, which bound the weight that any of its
postings can have, whatever the corpus's mean length has become since. Blocks are laid out by a
hash of their term, so that a search reads the parts that hold its terms.

A search joins the asked terms to their blocks, gathers them by run and finds the best
documents of each run: terms with large bounds first, until no other document can reach the
depth-th score so far; the rest is only looked up for documents that still can, in blocks that
hold one. A run sends its best documents on, not its postings.

An update adds a segment of the documents that are new or changed by hash, and lists what it
replaces or removes as dead, with the counts that their terms lose. Nothing else is read or
written again. A manifest, written last, names the segments that count; without it an update
hasn't happened. Documents are named by an id, or by an id and a part (a chunk); ids are unique, and rows
without one are left out.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.stemming import stem, stemmed
from loomspan.functions.text import SPACES, english_words, terms

K1, B = 1.2, 0.75
#: Terms of a run, postings of a block, parts that terms are hashed to, queries searched at once.
RUN, BLOCK, PARTS, QUERIES = 4_000_000, 128, 32, 1024
#: Scores this near to the last one that counts may round to a tie with it.
TIE = 1.1e-6

#: Parts of the table that hold no postings: a run's documents, and each document's own terms.
HEADS, FORWARD = -1, -2
ROW = (
    "run string, term string, n int, cf long, low int, high int, places binary, counts binary, most int, ratio double, "
    "ids binary, chunks binary, lengths binary, doc_id long, hash string, terms array<string>, tfs array<int>, kind int"
)


@dataclass(frozen=True)
class Analysis:
    """How a text becomes terms: an expression for its words, and whether these are stemmed."""

    name: str
    words: Callable[[Column], Column]
    stems: bool = False

    def terms(self, text: Column) -> Column:
        own = F.coalesce(self.words(text), F.array().cast("array<string>"))
        return stemmed(own) if self.stems else own


PLAIN, ENGLISH = Analysis("plain", terms), Analysis("english", english_words, True)


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of ``values``, from each of ``cuts`` to the next, as bytes."""
    at = (np.append(cuts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _run(held: list[pa.RecordBatch], name: str, stems: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one run of documents (doc_id, chunk, hash, words)."""
    docs = pa.Table.from_batches(held).combine_chunks()
    column = lambda c: docs.column(c).to_numpy()
    words = docs.column("words").combine_chunks()
    lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    codes, known = coded.indices.to_numpy(), coded.dictionary
    if stems:
        again = pa.array([stem(w) for w in known.to_pylist()], pa.string()).dictionary_encode()
        codes, known = again.indices.to_numpy()[codes], again.dictionary
    order, n = np.lexsort((column("chunk"), column("doc_id"))), docs.num_rows
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    pairs, tf = np.unique(codes.astype(np.int64) * n + np.repeat(place, lengths), return_counts=True)
    term, at = pairs // n, pairs % n
    length = lengths[order]
    schema = pa.schema([("run", pa.string()), ("term", pa.string()), ("n", pa.int32()), ("cf", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("places", pa.binary()), ("counts", pa.binary()), ("most", pa.int32()), ("ratio", pa.float64()), ("ids", pa.binary()), ("chunks", pa.binary()), ("lengths", pa.binary()), ("doc_id", pa.int64()), ("hash", pa.string()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32())), ("kind", pa.int32())])

    def rows(count: int, **columns) -> pa.RecordBatch:
        columns |= {"run": pa.array([name] * count, pa.string())}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

    if len(pairs):
        firsts = np.flatnonzero(np.diff(term, prepend=-1))
        within = np.arange(len(term)) - np.repeat(firsts, np.diff(np.append(firsts, len(term))))
        cuts = np.flatnonzero(within % BLOCK == 0)
        ends = np.append(cuts[1:], len(term))
        yield rows(
            len(cuts), term=known.take(pa.array(term[cuts])), n=pa.array(ends - cuts), cf=pa.array(np.add.reduceat(tf, cuts)), low=pa.array(at[cuts]), high=pa.array(at[ends - 1]),
            places=_binaries(at.astype(np.int32), cuts), counts=_binaries(tf.astype(np.int32), cuts), most=pa.array(np.maximum.reduceat(tf, cuts)), ratio=pa.array(np.minimum.reduceat(length[at] / tf, cuts)), kind=pa.array([0] * len(cuts)),
        )
    whole = np.zeros(1, np.int64)
    yield rows(1, n=pa.array([n]), cf=pa.array([int(length.sum())]), ids=_binaries(column("doc_id")[order].astype(np.int64), whole), chunks=_binaries(column("chunk")[order].astype(np.int32), whole), lengths=_binaries(length.astype(np.int32), whole), kind=pa.array([HEADS]))
    by_doc = np.argsort(at, kind="stable")
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(at, minlength=n))).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(offsets, values)
    yield rows(n, n=pa.array(length), doc_id=pa.array(column("doc_id")[order]), hash=docs.column("hash").combine_chunks().take(pa.array(order)), terms=lists(known.take(pa.array(term[by_doc]))), tfs=lists(pa.array(tf[by_doc].astype(np.int32))), kind=pa.array([FORWARD] * n))


def _runs(segment: int, stems: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, number, task = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column("words").flatten())
            if size >= RUN:
                yield from _run(held, f"{segment}-{task}-{number}", stems)
                held, size, number = [], 0, number + 1
        if held:
            yield from _run(held, f"{segment}-{task}-{number}", stems)

    return run


class _Postings:
    """A term's blocks in one run, in order; weights are worked out for the blocks that are needed."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bounds: np.ndarray, places: np.ndarray, counts: np.ndarray, idf: float, scale: np.ndarray):
        self.low, self.high, self.bounds, self.most = low, high, bounds, float(bounds.max())
        self._places, self._counts, self._idf, self._scale = places, counts, idf, scale
        self._whole: tuple[np.ndarray, np.ndarray] | None = None

    def _weighed(self, places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        at, tf = np.frombuffer(places, np.int32), np.frombuffer(counts, np.int32)
        return at, self._idf * (K1 + 1) * tf / (tf + self._scale[at])

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights."""
        return self._weighed(self._places[i], self._counts[i])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self._whole is None:
            self._whole = self._weighed(b"".join(self._places), b"".join(self._counts))
        return self._whole


def _kth(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, -k)[-k]) if len(scores) >= k else -np.inf


def best_of_run(terms: list[_Postings], acc: np.ndarray, depth: int) -> np.ndarray:
    """Places of the documents that may be among the best ``depth``; ``acc`` gets their scores.

    ``acc``: zeros, and less than any score for documents that are dead.
    """
    terms = sorted(terms, key=lambda t: -t.most)
    left = np.append(np.cumsum([t.most for t in terms][::-1])[::-1], 0.0)  # what the terms from each on may add
    i = 0
    while i < len(terms):
        places, weights = terms[i].whole()
        acc[places] += weights
        i += 1
        # a document that no term so far names can't get there: only those named need the rest
        if acc.max() > left[i] and _kth(acc, depth) - TIE > left[i]:
            break
    able = np.flatnonzero(acc > 0)
    last = _kth(acc[able], depth) - TIE
    for j in range(i, len(terms)):
        able = able[acc[able] + left[j] >= last]
        t = terms[j]
        within = np.minimum(np.searchsorted(t.high, able), len(t.high) - 1)
        reach = (t.low[within] <= able) & (able <= t.high[within]) & (acc[able] + t.bounds[within] + left[j + 1] >= last)
        for b in np.unique(within[reach]):
            places, weights = t.block(b)
            own = able[reach & (within == b)]
            at = np.minimum(np.searchsorted(places, own), len(places) - 1)
            hit = places[at] == own
            acc[own[hit]] += weights[at[hit]]
        last = _kth(acc[able], depth) - TIE
    return able[acc[able] >= last]


def _searched(depth: int, mean: float) -> Callable:
    """The best documents of one run for one block of queries; rows are its terms' blocks, its head, its dead."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"item_id": [], "doc_id": [], "chunk": [], "score": []})
        postings = rows[rows["kind"] == 0]
        heads = rows[rows["kind"] == HEADS]
        if not len(postings) or not len(heads):
            return out
        head = heads.iloc[0]
        ids, chunks = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["chunks"], np.int32)
        scale = K1 * (1 - B + B * np.frombuffer(head["lengths"], np.int32) / mean)
        dead = [np.frombuffer(x, np.int64) for x in rows.loc[rows["kind"] == FORWARD, "ids"]]
        gone = np.isin(ids, np.concatenate(dead)) if dead else np.zeros(len(ids), bool)
        term, _ = pd.factorize(postings["term"])
        order = np.lexsort((postings["low"], term))
        term = term[order]
        low, high, most, ratio, idf, places, counts, items = (postings[c].to_numpy()[order] for c in ("low", "high", "most", "ratio", "idf", "places", "counts", "items"))
        bounds = idf * (K1 + 1) / (1 + K1 * ((1 - B) / most + B * ratio / mean)) * (1 + 1e-12)
        firsts = np.flatnonzero(np.diff(term, prepend=-1))
        of: dict = {}
        for i, j in zip(firsts, np.append(firsts[1:], len(term))):
            p = _Postings(low[i:j], high[i:j], bounds[i:j], places[i:j], counts[i:j], float(idf[i]), scale)
            for item in items[i]:
                of.setdefault(item, []).append(p)
        found = []
        for item, terms_ in of.items():
            acc = np.where(gone, -np.inf, 0.0)
            best = best_of_run(terms_, acc, depth)
            best = best[acc[best] > 0]
            found.append((np.full(len(best), item), best, acc[best]))
        if not found:
            return out
        item, best, score = map(np.concatenate, zip(*found))
        return pd.DataFrame({"item_id": item, "doc_id": ids[best], "chunk": chunks[best], "score": score})

    return run


@dataclass(frozen=True)
class Index:
    """A version of an index below ``root``."""

    spark: SparkSession
    root: str
    analysis: Analysis
    version: int
    segments: tuple[int, ...]
    n: int
    total: int

    # building and updating

    @classmethod
    def build(cls, docs: DataFrame, root: str, analysis: Analysis = PLAIN) -> "Index":
        """An index of documents (doc_id, text, and chunk if there are parts)."""
        index = cls(docs.sparkSession, root, analysis, -1, (), 0, 0)
        return index._with_segment(docs, None)

    @classmethod
    def open(cls, spark: SparkSession, root: str, analysis: Analysis = PLAIN) -> "Index":
        """The newest version that was committed."""
        last = spark.read.schema("version int, segments array<int>, n long, total long").json(posixpath.join(root, "manifest", "version=*")).orderBy(F.desc("version")).first()
        if last is None:
            raise ValueError(f"no index at {root}")
        return cls(spark, root, analysis, last.version, tuple(last.segments), last.n, last.total)

    def update(self, docs: DataFrame, removed: DataFrame | None = None) -> "Index":
        """The index after an upsert of ``docs``, whole documents, and the removal of ids (doc_id)."""
        live = self.live().select("doc_id", "hash").groupBy("doc_id").agg(_set_hash(F.col("hash")).alias("old"))
        marked = docs.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
        new = marked.groupBy("doc_id").agg(_set_hash(F.col("hash")).alias("new"))
        both = new.join(live, "doc_id", "left")
        changed = both.where(~F.col("old").eqNullSafe(F.col("new"))).select("doc_id", F.col("old").isNotNull().alias("known"))
        path = posixpath.join(self.root, "changed", f"version={self.version + 1}")
        changed.write.mode("overwrite").parquet(path)
        changed = self.spark.read.schema("doc_id long, known boolean").parquet(path)
        gone = changed.where("known").select("doc_id")
        if removed is not None:
            gone = gone.union(removed.select("doc_id")).distinct()
        return self._with_segment(docs.join(changed.select("doc_id"), "doc_id", "left_semi"), gone)

    def _with_segment(self, docs: DataFrame, gone: DataFrame | None) -> "Index":
        number = max(self.segments, default=-1) + 1
        chunk = F.col("chunk").cast("int") if "chunk" in docs.columns else F.lit(0)
        words = F.coalesce(self.analysis.words(F.col("text")), F.array().cast("array<string>"))
        # at least a run for every core, where there are few files
        tasks = self.spark.sparkContext.defaultParallelism
        docs = docs if docs.rdd.getNumPartitions() >= tasks else docs.repartition(tasks, "doc_id")
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), chunk.alias("chunk"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), words.alias("words"))
        part = F.when(F.col("kind") == 0, _part_of("term")).otherwise(F.col("kind"))
        rows = rows.mapInArrow(_runs(number, self.analysis.stems), ROW).withColumn("part", part)
        rows = rows.hint("rebalance", F.col("part")).sortWithinPartitions("part", "term")
        rows.write.mode("overwrite").partitionBy("part").parquet(self._path("segment", number))
        counted = self._heads([number]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("cf"), F.lit(0)).alias("total")).first()
        n, total = self.n + counted.n, self.total + counted.total
        if gone is not None:
            lost = self.live().join(gone, "doc_id", "left_semi").select("run", "doc_id", "n", "terms", "tfs")
            lost.write.mode("overwrite").parquet(self._path("dead", number))
            lost = self.spark.read.schema("run string, doc_id long, n int, terms array<string>, tfs array<int>").parquet(self._path("dead", number))
            row = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
            n, total = n - row.n, total - row.total
        out = Index(self.spark, self.root, self.analysis, self.version + 1, (*self.segments, number), n, total)
        manifest = self.spark.range(1).select(F.lit(out.version).alias("version"), F.array(*map(F.lit, out.segments)).alias("segments"), F.lit(n).alias("n"), F.lit(total).alias("total"))
        manifest.coalesce(1).write.mode("overwrite").json(posixpath.join(self.root, "manifest", f"version={out.version}"))
        return out

    # what is stored

    def _path(self, kind: str, number: int) -> str:
        return posixpath.join(self.root, kind, f"{kind}={number}")

    def _rows(self, columns: str, segments: list[int] | tuple[int, ...]) -> DataFrame:
        reader = self.spark.read.schema(columns + ", part int").option("basePath", posixpath.join(self.root, "segment"))
        return reader.parquet(*[self._path("segment", s) for s in segments])

    def _heads(self, segments: list[int] | tuple[int, ...]) -> DataFrame:
        return self._rows("run string, n int, cf long, ids binary, chunks binary, lengths binary, kind int", segments).where(F.col("part") == HEADS)

    def _dead(self, columns: str) -> DataFrame | None:
        """Rows that updates have replaced; a first segment has none."""
        paths = [self._path("dead", s) for s in self.segments if s > 0]
        return self.spark.read.schema(columns).parquet(*paths) if paths else None

    def live(self) -> DataFrame:
        """Documents and parts that count: (run, doc_id, n, hash, terms, tfs)."""
        rows = self._rows("run string, doc_id long, n int, hash string, terms array<string>, tfs array<int>", self.segments).where(F.col("part") == FORWARD)
        dead = self._dead("run string, doc_id long")
        return rows if dead is None else rows.join(dead.distinct(), ["run", "doc_id"], "left_anti")

    def vocabulary(self, asked: DataFrame | None = None, parts: list[int] | None = None) -> DataFrame:
        """(term, df, cf) of all terms, or of those asked for (term), which lie in ``parts``."""
        blocks = self._rows("term string, n int, cf long", self.segments)
        blocks = blocks.where(F.col("part").isin(parts) if parts else F.col("part") >= 0).select("term", "n", "cf")
        dead = self._dead("terms array<string>, tfs array<int>")
        if dead is not None:
            lost = dead.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), F.lit(-1).alias("n"), (-F.col("x.tfs")).cast("long").alias("cf"))
            blocks = blocks.unionByName(lost)
        if asked is not None:
            blocks = blocks.join(asked, "term", "left_semi")
        return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    # searching

    def holding(self, asked: DataFrame) -> DataFrame:
        """(item_id, doc_id) of documents that hold the item's term (item_id, term)."""
        kind = dict(asked.dtypes)["item_id"]
        blocks = self._rows("run string, term string, places binary, kind int", self.segments).where(F.col("part") >= 0).select("run", "term", "places")
        hits = blocks.join(asked, "term").join(self._heads(self.segments).select("run", "ids"), "run")

        def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for run, item, places, ids in zip(batch["run"], batch["item_id"], batch["places"], batch["ids"]):
                    own = np.frombuffer(ids, np.int64)[np.frombuffer(places, np.int32)]
                    yield pd.DataFrame({"run": run, "item_id": item, "doc_id": own})

        out = hits.select("run", "item_id", "places", "ids").mapInPandas(found, f"run string, item_id {kind}, doc_id long")
        dead = self._dead("run string, doc_id long")
        out = out if dead is None else out.join(dead.distinct(), ["run", "doc_id"], "left_anti")
        return out.select("item_id", "doc_id").distinct()

    def search(self, queries: DataFrame, depth: int) -> DataFrame:
        """(item_id, doc_id, chunk, score): each run's best for queries (item_id, text), all that may be among the best ``depth``."""
        from loomspan.sources.staging import staged

        kind = dict(queries.dtypes)["item_id"]
        schema = f"item_id {kind}, doc_id long, chunk int, score double"
        asked = queries.where(F.regexp_replace("text", SPACES, "") != "")
        asked = asked.select("item_id", F.explode(F.array_distinct(self.analysis.terms(F.col("text")))).alias("term"))
        # written tables have a known size, by which Spark decides what to broadcast
        asked = staged(asked, "asked-terms")
        size = asked.agg(F.count_distinct("item_id").alias("items"), F.collect_set(_part_of("term")).alias("parts")).first()
        if not self.n or not self.total or not size.items:
            return self.spark.createDataFrame([], schema)
        across = -(-size.items // QUERIES)
        df = self.vocabulary(asked.select("term").distinct(), size.parts)
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        lots = asked.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(across)).alias("lot"), "term").agg(F.collect_list("item_id").alias("items"))
        askers = staged(lots.join(df, "term").select("lot", "term", idf.alias("idf"), "items"), "askers")
        blocks = self._rows("run string, term string, low int, high int, places binary, counts binary, most int, ratio double, kind int", self.segments)
        hits = blocks.where(F.col("part").isin(size.parts)).drop("part").join(askers, "term")
        every = F.explode(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<bigint>")).alias("lot")
        heads = self._heads(self.segments).select("run", "ids", "chunks", "lengths", "kind", every)
        rows = hits.unionByName(heads, allowMissingColumns=True)
        dead = self._dead("run string, doc_id long")
        if dead is not None:
            gone = dead.distinct().groupBy("run").applyInPandas(lambda d: pd.DataFrame({"run": [d["run"].iat[0]], "ids": [d["doc_id"].to_numpy(np.int64).tobytes()]}), "run string, ids binary")
            rows = rows.unionByName(gone.select("run", "ids", F.lit(FORWARD).alias("kind"), every), allowMissingColumns=True)
        return rows.groupBy("run", "lot").applyInPandas(_searched(depth, self.total / self.n), schema)


def _set_hash(hashes: Column) -> Column:
    """One hash of the hashes of a document's parts."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(hashes)), ","), 256)


def _part_of(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")

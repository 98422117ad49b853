"""Removal of repeated byte strings by distributed difference-cover suffix sorting.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier: in a
smaller document, or before in the same one. Sorting every suffix of the corpus would
move many times its size, so the suffixes are dealt out by content first:

1. Every window of ``LENGTH`` bytes has an anchor, its smallest k-gram (the leftmost of
   equals), which equal windows share. The windows of one anchor are consecutive; the
   bytes they cover are the anchor's context. About one byte in forty is an anchor.
2. Of anchors with equal contexts all but the first are repeated as a whole. Most are found
   among the texts that a task reads together, and only first ones travel on.
3. Anchors meet in buckets of their hash. One that no other shares has no repeated window,
   and equal contexts are settled as before. A bucket of more than ``HOT_BUCKET`` anchors,
   as a very common phrase makes, is settled by aggregates over its rows instead, which no
   single task has to hold.
4. First contexts of a shared anchor that differ are what is left to sort: they go, by
   anchor, to buckets whose suffixes a difference-cover sort puts in order, where
   neighbours that agree on ``LENGTH`` bytes are the repeated windows.
5. An anchor with more than ``HOT`` differing contexts would overfill a bucket. Its
   windows are counted by hash instead, with partial aggregates.

Nothing is dropped on the way: equal windows always share the anchor and its bucket.

Defined cases: null text is empty; texts shorter than the length lose nothing; of rows
with equal ids the one with the smaller text hash counts as earlier; a null id sorts
first; an empty table gives no rows; other columns pass through ``remove_repeats``
unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.shared import shuffled, table
from loomspan.llm.suffix_sort import equal_prefix_groups

LENGTH = 100
KGRAM = 24
#: Bytes of text that are hashed at once, whose anchors are packed into rows together, and
#: that a bucket of anchors or contexts stands for. Hashing takes about 80 times its bytes.
BUFFER, PACKED, BUCKET_BYTES = 1 << 20, 1 << 23, 1 << 22
HOT, HOT_BUCKET = 4096, 1 << 20

_RANDOM = np.random.default_rng(11)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x5851F42D4C957F2D
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


class Hashes:
    """Hashes of any stretch of a byte array from one pass of prefix sums."""

    def __init__(self, text: np.ndarray):
        self._sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE[text] * _power(_P, len(text)), out=self._sums[1:])
        self._back = _power(_P_INVERSE, len(text) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._back[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def anchors(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, kgram: int = KGRAM):
    """(anchor hash, context hash, first window, windows) of documents laid end to end.

    ``ends``: of each byte, where its document ends.
    """
    n, wide = len(text), length - kgram + 1
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    hashes, at = Hashes(text), np.arange(n)
    grams = hashes.of(at[: n - kgram + 1], at[: n - kgram + 1] + kgram)
    # the smallest of a window, the leftmost of equals: positions are the low bits
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | at[: len(grams)].astype(np.uint64)
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    window = np.flatnonzero(at[: len(least)] + length <= ends[: len(least)])
    if not len(window):
        return grams[:0], grams[:0], window, window
    anchor = (least[window] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))
    count = np.diff(np.append(first, len(window)))
    start, p = window[first], anchor[first]
    context = hashes.of(start, start + count - 1 + length) + (p - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return grams[p], context, start, count


def _hashed(batch: pd.DataFrame) -> Iterator[tuple[int, tuple]]:
    """(bytes, (anchors, contexts, documents, starts, counts)) of some text at a time."""
    keys, texts, held = [], [], 0
    for key, text in zip(batch["doc"], batch["text"]):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > BUFFER:
            yield from _long(key, raw)
            continue
        if held + len(raw) > BUFFER:
            yield held, _short(keys, texts)
            keys, texts, held = [], [], 0
        keys.append(key)
        texts.append(raw)
        held += len(raw)
    if keys:
        yield held, _short(keys, texts)


def _short(keys: list, texts: list[bytes]) -> tuple:
    sizes = np.array([len(t) for t in texts])
    stop = np.cumsum(sizes)
    a, c, start, count = anchors(np.frombuffer(b"".join(texts), np.uint8), np.repeat(stop, sizes))
    of = np.searchsorted(stop, start, side="right")
    return a, c, np.array(keys, np.int64)[of], start - (stop - sizes)[of], count


def _long(key: int, raw: bytes) -> Iterator[tuple[int, tuple]]:
    """A long text in overlapping pieces; runs of windows are cut at their seams."""
    for i in range(0, len(raw) - LENGTH + 1, BUFFER):
        part = np.frombuffer(raw[i : i + BUFFER + LENGTH - 1], np.uint8)
        a, c, start, count = anchors(part, np.full(len(part), len(part)))
        yield len(part), (a, c, np.full(len(a), key), start + i, count)


def _packed(pieces: list[tuple], buckets: int) -> pd.DataFrame:
    """First contexts of some texts by bucket, and all repeated ones as bucket -1."""
    a, c, d, start, count = (np.concatenate(x) for x in zip(*pieces))
    order = np.lexsort((start, d, c, a))
    a, c, d, start, count = a[order], c[order], d[order], start[order], count[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    bucket = np.where(first, ((a >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), -1)
    order = np.argsort(bucket, kind="stable")
    cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-2)), len(order))
    rows = []
    for i, j in zip(cut, cut[1:]):
        o = order[i:j]
        rows.append((int(bucket[o[0]]), j - i, a[o].tobytes(), c[o].tobytes(), d[o].tobytes(), start[o].astype("<u4").tobytes(), count[o].astype(np.uint8).tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "n", "a", "c", "d", "start", "count"])


def _scattered(docs: DataFrame, buckets: int) -> DataFrame:
    """Every anchor's hashes and place, packed in columns by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, held = [], 0
        for batch in batches:
            for n, piece in _hashed(batch):
                pieces.append(piece)
                held += n
                if held > PACKED:
                    yield _packed(pieces, buckets)
                    pieces, held = [], 0
        if pieces:
            yield _packed(pieces, buckets)

    return docs.mapInPandas(run, "bucket long, n long, a binary, c binary, d binary, start binary, count binary")


def _arrays(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    kinds = {"a": np.uint64, "c": np.uint64, "d": np.int64, "start": "<u4", "count": np.uint8}
    return tuple(np.frombuffer(b"".join(part[x]), kind) for x, kind in kinds.items())


MARKS = "doc long, start long, count long, anchor long, kind long"


def _met(scattered: DataFrame) -> DataFrame:
    """(doc, start, count, anchor, kind) of shared anchors: 1 repeated, 2 to sort, 3 hot."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        a, c, d, start, count = _arrays(part)
        o = np.lexsort((start, d, c, a))
        a, c, d, start, count = a[o], c[o], d[o], start[o], count[o]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
        group = np.cumsum(new_a) - 1
        contexts = np.bincount(group, weights=new_c)[group]
        kind = np.where(~new_c, 1, np.where(contexts > HOT, 3, np.where(contexts > 1, 2, 0)))
        k = kind > 0
        return pd.DataFrame({"doc": d[k], "start": start[k].astype(np.int64), "count": count[k].astype(np.int64), "anchor": np.where(kind > 1, a.view(np.int64), 0)[k], "kind": kind[k]})

    return scattered.groupBy("bucket").applyInPandas(run, MARKS)


def _unpacked(scattered: DataFrame) -> DataFrame:
    """(anchor, context, doc, start, count) of packed rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                a, c, d, start, count = _arrays(batch.iloc[i : i + 1])
                yield pd.DataFrame({"anchor": a.view(np.int64), "context": c.view(np.int64), "doc": d, "start": start.astype(np.int64), "count": count.astype(np.int64)})

    return scattered.drop("n", "bucket").mapInPandas(run, "anchor long, context long, doc long, start long, count long")


def _met_in_hot_buckets(scattered: DataFrame) -> DataFrame:
    """As ``_met``, by aggregates and joins over single rows."""
    rows = table(_unpacked(scattered), "hot-anchors")
    place = F.struct("doc", "start", "count")
    firsts = table(rows.groupBy("anchor", "context").agg(F.min(place).alias("first")), "first-contexts")
    again = rows.join(shuffled(firsts), ["anchor", "context"]).where(place != F.col("first"))
    again = again.select("doc", "start", "count", F.lit(0).cast("long").alias("anchor"), F.lit(1).cast("long").alias("kind"))
    shared = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    kind = F.when(F.col("n") > HOT, 3).otherwise(2).cast("long").alias("kind")
    return again.unionByName(firsts.join(shuffled(shared), "anchor").select("first.*", "anchor", kind))


def _marks(scattered: DataFrame) -> DataFrame:
    """Marks of all buckets, hot ones apart from the others."""
    alone = _unpacked(scattered.where("bucket < 0")).select("doc", "start", "count", F.lit(0).cast("long").alias("anchor"), F.lit(1).cast("long").alias("kind"))
    met = scattered.where("bucket >= 0")
    hot = table(met.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_BUCKET).select("bucket"), "hot-buckets")
    if hot.isEmpty():
        return alone.unionByName(_met(met))
    return alone.unionByName(_met(met.join(hot, "bucket", "left_anti"))).unionByName(_met_in_hot_buckets(met.join(hot, "bucket", "left_semi")))


def _contexts(docs: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """Contexts to sort (bucket, doc, start, context) and hot windows (hash, doc, start)."""
    listed = marks.where("kind > 1").groupBy("doc").agg(F.collect_list(F.struct("start", "count", "anchor", "kind")).alias("marks"))
    # a left join on both uses of the documents, so that they share one exchange
    rows = docs.select("doc", "text").join(shuffled(listed), "doc", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for doc, text, marks in zip(batch["doc"], batch["text"], batch["marks"]):
                if marks is None:
                    continue
                raw = (text or "").encode("utf-8", "surrogatepass")
                for m in marks:
                    s, n = m["start"], m["count"]
                    if m["kind"] == 2:
                        out.append((((m["anchor"] >> 20) & 0xFFFFFFFFFFF) % buckets, doc, s, raw[s : s + n - 1 + LENGTH]))
                        held += n + LENGTH
                    else:
                        for i in range(s, s + n):
                            out.append((-1, doc, i, sha256(raw[i : i + LENGTH]).digest()[:16]))
                            held += 16
                if held > 1 << 23:
                    yield pd.DataFrame(out, columns=["bucket", "doc", "start", "context"])
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=["bucket", "doc", "start", "context"])

    return rows.mapInPandas(run, "bucket long, doc long, start long, context binary")


def _sorted_repeats(contexts: DataFrame) -> DataFrame:
    """(doc, start, count): repeated windows among the contexts of each bucket."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        raw = part["context"].tolist()
        sizes = np.array([len(x) for x in raw])
        text = np.frombuffer(b"".join(x + b"\0" for x in raw), np.uint8).astype(np.int64) + 1
        begin = np.cumsum(sizes + 1) - sizes - 1
        text[begin + sizes] = 0  # between contexts
        windows = sizes - LENGTH + 1
        of = np.repeat(np.arange(len(raw)), windows)
        within = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        group = equal_prefix_groups(text, begin[of] + within, LENGTH)
        doc, at = part["doc"].to_numpy()[of], part["start"].to_numpy()[of] + within
        o = np.lexsort((at, doc, group))
        again = o[1:][group[o[1:]] == group[o[:-1]]]
        again.sort()  # windows of one context are consecutive again
        return _runs(doc[again], at[again])

    return contexts.groupBy("bucket").applyInPandas(run, "doc long, start long, count long")


def _runs(doc: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    if not len(doc):
        return pd.DataFrame({"doc": doc, "start": at, "count": at})
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
    return pd.DataFrame({"doc": doc[first], "start": at[first], "count": np.diff(np.append(first, len(doc)))})


def _hot_repeats(windows: DataFrame) -> DataFrame:
    """(doc, start, count) of the windows that have an equal one earlier, by their hash."""
    first = windows.groupBy("context").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = windows.join(shuffled(first), "context").where(F.struct("doc", "start") != F.col("first"))
    return again.select("doc", "start", F.lit(1).cast("long").alias("count"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, text, row) with ``spans``: the first window and number of windows of each.

    ``doc`` is a unique long that orders the documents.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    marks = table(_marks(table(_scattered(docs.select("doc", "text"), buckets), "anchors")), "anchor-marks")
    contexts = table(_contexts(docs, marks, 4 * buckets), "contexts")  # smaller ones: sorting needs many times their bytes
    found = _sorted_repeats(contexts.where("bucket >= 0")).unionByName(_hot_repeats(contexts.where("bucket < 0")))
    spans = marks.where("kind = 1").select("doc", "start", "count").unionByName(found)
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    return docs.join(shuffled(listed), "doc", "left")


def removed(n: int, spans, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of removed bytes of a text of ``n`` bytes."""
    if spans is None or not len(spans):
        return []
    s = np.array([(x["start"], x["start"] + x["count"] - 1 + length) for x in spans])
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    first = np.flatnonzero(np.concatenate([[True], s[1:, 0] > reach[:-1]]))
    return list(zip(s[first, 0].tolist(), np.append(reach[first[1:] - 1], reach[-1]).tolist()))


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, text, row): a unique long in the order of ids, the text, and the whole row.

    Ids that are unique and not null, the rule, serve as they are. Otherwise the rows,
    sorted by ranges over all tasks, are written with increasing numbers.
    """
    ids = F.col("doc_id").cast("long")
    repeated = docs.groupBy(ids.alias("i")).agg(F.count("*").alias("n")).where("n > 1 or i is null")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if repeated.isEmpty():
        return docs.select(ids.alias("doc"), "text", row)
    order = [ids, F.xxhash64("text")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return table(ordered.select(F.monotonically_increasing_id().alias("doc"), "text", row), "ordered")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text``; ``n_chars`` follows if there.

    What a cut leaves of a character that it splits is dropped with it.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            raw = (text or "").encode("utf-8", "surrogatepass")
            gone = removed(len(raw), own)
            out.append(_kept(raw, gone).decode("utf-8", "ignore") if gone else text)
        return pd.Series(out, dtype=object)

    out = repeated_spans(_numbered(docs)).select("row", cut("text", "spans").alias("left"))
    row = F.col("row").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("left").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(row.alias("row")).select("row.*")


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its bytes, those removed, and a digest of what is kept."""
    docs = _numbered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone = removed(len(raw), spans)
                rows.append((doc, len(raw), sum(b - a for a, b in gone), len(gone), sha256(_kept(raw, gone)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    spans = repeated_spans(docs.select("doc", "text", F.col("row.doc_id").cast("long").alias("doc_id")))
    return spans.select("doc_id", "text", "spans").mapInPandas(run, schema)

"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words, lower-cased, each labelled with how often
the same run came before it. A sketch is, under one random order, the two smallest
labelled k-mers in the order of the text; two texts agree on it with a probability that
grows with both the shared k-mers and their common order, as edit similarity does.
Sixteen sketches are taken.

Texts with the same words are one class from the start. Classes that agree on a sketch
share a bucket; each bucket elects a head at random, and members pair with the head. Two texts
of an edit similarity of 0.82 with scattered edits share one of the sixteen with a probability
of about 0.95, nearer ones almost surely. Thus a bucket of s members makes s - 1 pairs. A
pair is linked if the words that a banded alignment matches make up at least 0.8 of all
words of both texts: common k-mers anchor it, near the diagonal that such an alignment must
keep to, and the words between anchors are matched by their longest common subsequence. Two
texts whose five-word shingles in order have a similarity of 0.8 are always linked by it.
One more round, over buckets whose members aren't yet in one component, pairs one member
of each of its components with a new head. These rounds only make components larger.
Buckets that still span several are finished exactly: block against block of like length,
every pair across components with an agreeing sketch, and whose counts of words by hash
don't yet differ by more than such an alignment leaves unmatched, is aligned. So the
classes are those of all pairs that share a bucket.

Defined cases: a text of fewer than five words is one k-mer; null, empty and blank
texts have none and are classes of their own; rows of one id (repeated rows, or other texts) belong to
one class, of all that any of their texts links to; very long texts are read whole; a null id takes part as a copy, but never as a head, and keeps a class without id
only if all of it has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.components import components
from loomspan.llm.shared import shuffled, table

WORDS, SIMILARITY = 5, 0.8
SKETCHES, AGREE = 16, 1
#: Rounds of random draws after the first; what they leave is compared in blocks of so
#: many members and words at most, by their counts of words in so many bins first.
MORE_ROUNDS, BLOCK, BLOCK_WORDS, BINS = 1, 1024, 1 << 22, 256

_MIX = np.random.default_rng(7).integers(1, 1 << 63, (2, SKETCHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    tokens = (text or "").lower().split()
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in tokens), np.uint64, len(tokens))


def labelled(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of the k-mers of a text's words, each with its occurrence number, in text order."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n = max(1, len(h) - words + 1)
    k = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        k = _mixed(k + h[i : i + n] + np.uint64(i))
    order = np.argsort(k, kind="stable")
    s = k[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if not new.all():
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        label = np.empty(n, np.uint64)
        label[order] = (np.arange(n) - start).astype(np.uint64)
        k = np.where(label > 0, _mixed(k + label * np.uint64(0x9E3779B97F4A7C15)), k)
    return k


def labelled_kmers(text: str | None) -> np.ndarray:
    return labelled(word_hashes(text))


def sketch(kmers: np.ndarray) -> np.ndarray:
    """The sketches: each a hash of the two smallest labelled k-mers in text order."""
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, min(SKETCHES, (1 << 20) // len(kmers)))
    for j in range(0, SKETCHES, step):
        mul, add = _MIX[:, j : j + step, None]
        order = _mixed(kmers[None] * mul + add)
        if len(kmers) > 2:
            two = np.sort(np.argpartition(order, 1, axis=1)[:, :2], axis=1)
        else:
            two = np.broadcast_to([0, len(kmers) - 1], (len(order), 2))
        first, second = kmers[two[:, 0]], kmers[two[:, 1]]
        out[j : j + step] = _mixed(_mixed(first) + second)
    return out


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    if not a or not b:
        return 0
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = every = (1 << len(a)) - 1
    for w in b:
        if (hit := at.get(w)) is not None:
            row = (row + (row & hit) | row & ~hit) & every
    return len(a) - row.bit_count()


def _anchored(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, length) of runs of equal words, in order in both texts, within the band.

    ``x`` and ``y`` are the labelled k-mers of the words ``a`` and ``b``.

    Labelled k-mers are distinct, so that the longest chain of common ones is the longest
    increasing run of their positions.
    """
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    order = np.argsort(i[near])
    i, j = i[near][order], j[near][order]
    if len(j) > 1 and (np.diff(j) <= 0).any():
        tails: list[int] = []
        ends: list[int] = []
        before = []
        for n, v in enumerate(j.tolist()):
            at = bisect_left(tails, v)
            tails[at : at + 1] = [v]
            ends[at : at + 1] = [n]
            before.append(ends[at - 1] if at else -1)
        chain, n = [], ends[-1]
        while n >= 0:
            chain.append(n)
            n = before[n]
        i, j = i[chain[::-1]], j[chain[::-1]]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)])) if len(i) else np.zeros(0, int)
    wide = np.diff(np.append(first, len(i))) + min(WORDS, len(a), len(b)) - 1
    return i[first], j[first], wide


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, kmers: tuple | None = None) -> float:
    """Aligned words as a share of all of both texts (hashes of words); 0 below ``least``.

    An alignment that reaches ``least`` leaves at most ``band`` words unmatched, and none of
    its matches lies farther off the diagonal. Common k-mers within the band anchor it;
    between two of them the longest common subsequence of the words is taken. ``kmers``:
    labelled ones of both, where they are known already.
    """
    n, m = len(a), len(b)
    need = least * (n + m) / (1 + least) - 1e-9
    if not n or not m or min(n, m) < need:
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    matched, x, y, gaps = 0, 0, 0, []
    for i, j, wide in zip(*(v.tolist() for v in _anchored(a, b, *(kmers or (labelled(a), labelled(b))), band))):
        cut = max(0, x - i, y - j)
        if cut < wide:
            gaps.append((x, i + cut, y, j + cut))
            matched += wide - cut
            x, y = i + wide, j + wide
    gaps = [(p, q, r, s) for p, q, r, s in [*gaps, (x, n, y, m)] if p < q and r < s]
    if matched + sum(min(q - p, s - r) for p, q, r, s in gaps) < need:
        return 0.0
    matched += sum(common_words(a[p:q].tolist(), b[r:s].tolist()) for p, q, r, s in gaps)
    return matched / (n + m - matched) if matched >= need else 0.0


def word_counts(h: np.ndarray) -> np.ndarray:
    """Words by bin of their hash, at most 255 each.

    Counts of two texts differ in sum by no more than the words that an alignment leaves.
    """
    return np.minimum(np.bincount((_mixed(h) % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = word_hashes(text)
                if not len(words):
                    rows.append((doc, None, 0, [], None))
                    continue
                whole = blake2b(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                rows.append((doc, whole, len(words), sketch(labelled(words)).astype(np.int64), word_counts(words).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "whole", "n", "sketches", "counts"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, whole binary, n long, sketches array<long>, counts binary")


def _candidates(members: DataFrame, seed: int) -> DataFrame:
    """(a, b, agree): bucket members with their bucket's head for this round."""
    heads = members.groupBy("bucket").agg(
        F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("r"), "id", "marks")).alias("head"), F.count("*").alias("n")
    )
    heads = heads.where("n > 1").select("bucket", F.col("head.id").alias("b"), F.col("head.marks").alias("other"))
    agree = F.size(F.filter(F.zip_with("marks", "other", lambda x, y: x == y), lambda x: x))
    pairs = members.join(shuffled(heads), "bucket").where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), agree.alias("agree"))
    return pairs.where(F.col("agree") >= AGREE).distinct()


def _apart(members: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with their ``part``, and the buckets that hold several parts."""
    known = members.join(shuffled(parts), "id", "left").withColumn("part", F.coalesce("component_id", "id")).drop("component_id")
    return known, known.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")


def _root(joined: dict[int, int], x: int) -> int:
    while x in joined:
        x = joined[x]
    return x


def _across(members: DataFrame, classes: DataFrame, texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b): links that join all components which a link within a bucket joins."""
    apart = table(_apart(members, parts)[1], "open-buckets")
    open_ = table(members.join(shuffled(apart), "bucket", "left_semi").select("id", "bucket", "j"), "open-members")
    ids = table(open_.select("id").distinct(), "open-ids")

    @F.pandas_udf("binary")
    def hashed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: word_hashes(t).astype(np.uint32).tobytes())

    words = texts.withColumnRenamed("doc_id", "id").join(shuffled(ids), "id", "left_semi").select("id", hashed("text").alias("words"))
    words = table(words, "open-words")
    rows = classes.join(shuffled(ids), "id", "left_semi").join(shuffled(parts), "id", "left")
    rows = rows.select("id", F.coalesce("component_id", "id").alias("part"), "n", "s", "counts").join(shuffled(open_), "id")
    # texts of a pair are in the same step of lengths or in neighbouring ones
    rows = rows.withColumn("step", F.floor(F.log("n") / float(np.log(1 / SIMILARITY))))
    sizes = rows.groupBy("bucket", "j", "step").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_WORDS)).alias("blocks"))
    sizes = table(sizes, "open-sizes")
    rows = rows.join(shuffled(sizes), ["bucket", "j", "step"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.join(shuffled(words), "id")
    packed = rows.groupBy("bucket", "j", "step", "blocks", "block").agg(F.collect_list(F.struct("id", "part", "n", "s", "counts", "words")).alias("m"))
    packed = table(packed, "open-blocks")
    left = packed.select("bucket", "j", "step", "block", F.col("m").alias("x"))
    same = left.join(shuffled(sizes), ["bucket", "j", "step"]).withColumn("to", F.col("step"))
    same = same.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    up = sizes.select("bucket", "j", (F.col("step") - 1).alias("step"), F.col("step").alias("to"), "blocks")
    above = left.join(shuffled(up), ["bucket", "j", "step"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["bucket", "j", "step", "block", "x", "to", "other"]
    left = same.select(*columns).unionByName(above.select(*columns))
    right = packed.select("bucket", "j", F.col("step").alias("to"), F.col("block").alias("other"), F.col("m").alias("y"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = (batch["step"] == batch["to"]) & (batch["block"] == batch["other"])
            for j, alone, *sides in zip(batch["j"], own, batch["x"], batch["y"]):
                (i, p, n, s, u), (k, q, m, t, v) = (
                    [np.array([r[c] for r in side], np.int64) for c in ("id", "part", "n")]
                    + [np.stack([r["s"] for r in side]), np.frombuffer(b"".join([r["counts"] for r in side]), np.uint8).reshape(-1, BINS)]
                    for side in sides
                )
                good = p[:, None] != q
                if alone:
                    good = np.triu(good, 1)
                shorter, longer = np.minimum(n[:, None], m), np.maximum(n[:, None], m)
                good &= (shorter >= SIMILARITY * longer) & (s[:, j][:, None] == t[:, j])
                agree = np.zeros(good.shape, np.int8)
                for c in range(SKETCHES):
                    equal = s[:, c][:, None] == t[:, c]
                    if c < j:  # an earlier bucket of both makes this pair
                        good &= ~equal
                    agree += equal
                x, y = np.nonzero(good & (agree >= AGREE))
                left_over = (n[x] + m[y]) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6
                apart_by = [np.abs(u[x[z : z + 4096]].astype(np.int16) - v[y[z : z + 4096]]).sum(1) for z in range(0, len(x), 4096)]
                keep = np.concatenate([*apart_by, np.zeros(0, int)]) <= left_over
                texts_of = [lru_cache(None)(lambda z, side=side: (w := np.frombuffer(side[z]["words"], np.uint32).astype(np.uint64), labelled(w))) for side in sides]
                x, y = x[keep], y[keep]
                order = np.argsort(-agree[x, y], kind="stable")
                linked, joined = [], {}
                for x, y in zip(x[order].tolist(), y[order].tolist()):
                    a, b = _root(joined, int(p[x])), _root(joined, int(q[y]))
                    if a == b:  # one component by now
                        continue
                    (f, kf), (g, kg) = texts_of[0](x), texts_of[1](y)
                    if aligned_similarity(f, g, kmers=(kf, kg)):
                        joined[a] = b
                        linked.append(sorted((int(i[x]), int(k[y]))))
                yield pd.DataFrame(linked, columns=["a", "b"], dtype=np.int64)

    return left.join(shuffled(right), ["bucket", "j", "to", "other"]).mapInPandas(compare, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts' alignment reaches the similarity, with it."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = lru_cache(64)(word_hashes)
        for batch in batches:
            values = [aligned_similarity(words(x), words(y)) for x, y in zip(batch["text_a"], batch["text_b"])]
            yield batch[["a", "b"]].assign(similarity=values)[lambda d: d["similarity"] > 0]

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(shuffled(left), "a").join(shuffled(right), "b")
    return both.mapInPandas(align, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = table(_sketched(docs), "order-sketches")
    classes = rows.where("whole is not null").groupBy("whole").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketches").alias("s"), F.first("counts").alias("counts"))
    classes = table(classes.where("id is not null"), "text-classes")
    # 15 bits of each sketch tell how many agree; the bucket is the whole sketch
    marks = F.transform("s", lambda x: x.bitwiseAND(F.lit(0x7FFF)).cast("short"))
    members = classes.select("id", marks.alias("marks"), F.posexplode("s").alias("j", "value"))
    members = members.select("id", "marks", "j", F.xxhash64("j", "value").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = table(members.join(shuffled(shared), "bucket"), "shared-buckets")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = table(docs.join(shuffled(ids), "doc_id", "left_semi").distinct(), "shared-texts")
    links, parts, seen = None, None, None
    for seed in range(1 + MORE_ROUNDS):
        if parts is None:
            pairs = _candidates(members, seed).select("a", "b")
        else:
            known, apart = _apart(members, parts)
            one = F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("r"), "id", "marks")).alias("x")
            of_part = known.join(shuffled(apart), "bucket").groupBy("bucket", "part").agg(one).select("bucket", "x.id", "x.marks")
            pairs = _candidates(of_part, seed).select("a", "b").join(shuffled(seen), ["a", "b"], "left_anti")
        pairs = table(pairs, "pairs")
        found = table(_verified(pairs, texts).select("a", "b"), "links")
        if links is not None and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        seen = pairs if seen is None else seen.unionByName(pairs)
        parts = table(components(links), "near-components")
    found = table(_across(members, classes, texts, parts), "links")
    if not found.isEmpty():
        parts = table(components(links.unionByName(found)), "near-components")
    classes = classes.join(shuffled(parts), "id", "left").select("whole", F.coalesce("component_id", "id").alias("class_id"))
    out = rows.join(shuffled(classes), "whole", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without rows that aren't their class's first; rows without id stay.

    Of rows with one id, equal texts leave one row, and texts that differ all stay.
    """
    classes = near_duplicates(docs)
    gone = classes.where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    out = docs.join(shuffled(gone), "doc_id", "left_anti")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    if repeated.isEmpty():
        return out
    return out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(out.where("doc_id is null"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it stays."""
    classes = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))

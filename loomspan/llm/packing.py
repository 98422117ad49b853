"""Vector bin packing of examples into training sequences.

A sequence has three limits: tokens, segments, and loss-bearing tokens. The dot-product
heuristic fills one sequence at a time: of the waiting examples that fit, it places the
one whose demand vector has the largest dot product with what is left of the limits,
each dimension scaled by its limit and weighted by the mean demand. When none fits, the
best one is cut to fill what is left; its rest goes on waiting.

Each Spark partition packs its own rows in reading order with a bounded pool of waiting
examples, so nothing is shuffled or collected. A sequence that can't be filled, because
nothing is left or its segments or loss-bearing tokens are used up, is cut into sequences
whose lengths are powers of two, which need no padding.

Defined cases: a null text or prompt is empty, and both together give the end id alone;
null ids are kept; equal and repeated rows are packed one by one; a very long text is cut
into as many pieces as it takes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.tokens import default_tokenizer, encoder

END_ID = 2
#: Examples that wait for a place in one partition.
POOL = 1024
#: What is left of a sequence is filled by a cut once it is this small.
CUT_BELOW = 96


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 64
    loss: int = 4096


@dataclass
class Piece:
    """``length`` tokens of example ``key`` from ``start``; ``loss`` of them bear loss."""

    key: int
    start: int
    length: int
    loss: int


class DotProductPacker:
    """Fills sequences from examples added one by one.

    The last ``loss`` tokens of an example bear loss, as the answers of instruction
    data do; a cut piece keeps those of its own range.
    """

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits
        self._cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        self._whole: dict[int, tuple[int, int]] = {}
        self._key: list[int] = []
        self._start: list[int] = []
        self._need = np.zeros((0, 3))
        self._new: list[tuple[float, float, float]] = []
        self._done: list[int] = []

    def __len__(self) -> int:
        return len(self._key)

    def _loss(self, key: int, start: int, length: int) -> int:
        n, loss = self._whole[key]
        return max(0, start + length - max(start, n - loss))

    def _wait(self, key: int, start: int) -> None:
        length = self._whole[key][0] - start
        if length > 0:
            self._key.append(key)
            self._start.append(start)
            self._new.append((length, 1, self._loss(key, start, length)))

    def add(self, key: int, tokens: int, loss: int) -> None:
        self._whole[key] = (tokens, loss)
        self._wait(key, 0)

    def _longest(self, i: int, left: np.ndarray) -> int:
        """Tokens of waiting example ``i`` that fit in what is left."""
        key, start = self._key[i], self._start[i]
        free = max(0, self._whole[key][0] - self._whole[key][1] - start)
        return int(min(self._need[i, 0], left[0], free + left[2]))

    def fill(self) -> list[Piece]:
        """One sequence's pieces, in order; empty if nothing waits."""
        for key in self._done:
            del self._whole[key]
        self._done = []
        if self._new:
            self._need = np.vstack([self._need, np.array(self._new, float)])
            self._new = []
        if not self._key:
            return []
        left, out = self._cap.copy(), []
        alive = np.ones(len(self._key), bool)
        weight = self._need.mean(0) / self._cap / self._cap
        cut: list[tuple[int, int]] = []
        while left[0] >= 1 and left[1] >= 1 and alive.any():
            value = self._need @ (weight * left)
            fits = alive & (self._need <= left).all(1)
            if fits.any() and (left[0] >= CUT_BELOW or not (alive & (self._need[:, 0] > left[0])).any()):
                i = int(np.where(fits, value, -1).argmax())
                length = int(self._need[i, 0])
            else:
                i = int(np.where(alive, value, -1).argmax())
                length = self._longest(i, left)
                if length < 1:  # no loss-bearing token fits any more
                    free = [j for j in np.flatnonzero(alive) if self._longest(j, left) >= 1]
                    if not free:
                        break
                    i = free[0]
                    length = self._longest(i, left)
            key, start = self._key[i], self._start[i]
            loss = self._loss(key, start, length)
            out.append(Piece(key, start, length, loss))
            left -= (length, 1, loss)
            alive[i] = False
            if length < self._need[i, 0]:
                cut.append((key, start + length))
            else:
                self._done.append(key)
        keep = np.flatnonzero(alive)
        self._key = [self._key[i] for i in keep]
        self._start = [self._start[i] for i in keep]
        self._need = self._need[keep]
        for key, start in cut:
            self._wait(key, start)
        return out

    @property
    def waiting_tokens(self) -> int:
        return int(self._need[:, 0].sum() + sum(x[0] for x in self._new))

    def powers(self, pieces: list[Piece]) -> list[list[Piece]]:
        """The pieces of a sequence that isn't full, cut into ones of 2^n tokens."""
        total, out, queue = sum(p.length for p in pieces), [], list(pieces)
        while total:
            room, seq = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                p = queue.pop(0)
                if p.length > room:
                    queue.insert(0, Piece(p.key, p.start + room, p.length - room, self._loss(p.key, p.start + room, p.length - room)))
                    p = Piece(p.key, p.start, room, self._loss(p.key, p.start, room))
                seq.append(p)
                room -= p.length
            out.append(seq)
        return out


def sequences(examples: Iterator[tuple[int, int, int]], limits: Limits, pool: int = POOL) -> Iterator[list[Piece]]:
    """Packs (key, tokens, loss) of one partition."""
    packer = DotProductPacker(limits)

    def filled() -> list[list[Piece]]:
        pieces = packer.fill()
        full = sum(p.length for p in pieces) == limits.tokens
        return [pieces] if full else packer.powers(pieces)

    for key, tokens, loss in examples:
        packer.add(key, tokens, loss)
        while len(packer) > pool and packer.waiting_tokens >= limits.tokens:
            yield from filled()
    while len(packer):
        yield from filled()


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    pool: int = POOL,
    prompt_col: str | None = None,
) -> DataFrame:
    """One row per piece of every document, with its ids and its place in its sequence.

    Every token of a plain document bears loss; a prompt's tokens come before the text's
    and bear none. ``ids`` are little-endian unsigned 32-bit integers. Sequence ids are the partition's number
    times 2^32 plus a count, the same again when a task is repeated.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end, encode = {}, np.array([END_ID], "<u4").tobytes(), encoder(tokenizer)
        base, done = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []
        held = 0  # ids in them

        def examples():
            n = 0
            for batch in batches:
                for i in range(0, len(batch), 256):
                    part = batch.iloc[i : i + 256]
                    before = encode(part["prompt"].tolist()) if prompt_col else [b""] * len(part)
                    for doc, prompt, ids in zip(part["doc_id"], before, encode(part["text"].tolist())):
                        whole, loss = (len(prompt) + len(ids)) // 4 + 1, len(ids) // 4 + 1
                        ids_of[n] = [doc, prompt + ids + end, whole]
                        yield n, whole, loss
                        n += 1

        def frame():
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"])
            rows.clear()
            return out.astype({"doc_id": "Int64"})

        for pieces in sequences(examples(), limits, pool):
            offset = 0
            for p in pieces:
                own = ids_of[p.key]
                doc, ids, whole = own[0], own[1], len(own[1]) // 4
                own_ids = ids[4 * p.start : 4 * (p.start + p.length)]
                rows.append((None if pd.isna(doc) else int(doc), p.start, p.length, own_ids, whole, base + done, offset, p.loss))
                offset += p.length
                own[2] -= p.length
                if not own[2]:
                    del ids_of[p.key]
            done += 1
            held += sum(p.length for p in pieces)
            if held >= 1 << 21:
                held = 0
                yield frame()
        if rows:
            yield frame()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    prompt = [f"`{prompt_col}` prompt"] if prompt_col else []
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text", *prompt).mapInPandas(pack, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in their place."""
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 4096 tokens."""
    return digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))

"""SentencePiece encoding, decoding, and sampling of distinct segmentations.

The segmentations of a text form a lattice whose edges are vocabulary pieces. Their
distribution is proportional to the product of the pieces' weights. Gumbel top-k draws k
of them without replacement: a perturbed A-star search keeps a queue of lattice prefixes,
each with the largest perturbed log-probability of any segmentation below it, and always
takes the best one down to its end; what it leaves on its way goes back to the queue with
Gumbels truncated at the value of the path taken. The value of the (k + 1)-th
segmentation turns each drawn one's probability into its inclusion score.

No piece spans a white space that isn't its start, so that the lattice is a chain of
small ones, one for each word; each worker keeps those of the words it has met in flat
arrays, and the searches of many texts take their steps together. The random numbers of a
row are hashes of its key, the seed and their place alone.

Defined cases: null and empty texts have one segmentation, the empty one, with inclusion
score 1; texts with fewer than k segmentations give them all, each with score 1;
characters without a piece become byte pieces; rows with equal keys draw the same
numbers; null keys count as a key; very long texts are searched whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Edges of words that one worker remembers (beyond them, before a group of texts, only the
#: words most used stay), characters of texts that are searched together, and of new words
#: that are added together.
CACHE_EDGES, GROUP_CHARS, ADD_CHARS = 4_000_000, 200_000, 16_000
#: The weight of a piece of a merge-ordered vocabulary is (rank + 2) to the minus this.
RANK_POWER = 1.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A character that ends words: beyond Unicode, so that no piece has it.
_END = 0x1FFFFF
#: Bits of a slot of the table of trie keys; -2 marks slots of several keys.
_SLOT_BITS = 20
#: Where there is no piece.
_NONE = np.iinfo(np.int32).min

#: Factors of the characters of a word in its hash, by place.
_FACTORS = np.random.default_rng(1).integers(1, 1 << 64, 1024, np.uint64)

_lattices: dict[str, "Lattice"] = {}


class _Growing:
    """An array that values are appended to."""

    def __init__(self, kind):
        self._all, self.size = np.zeros(1 << 12, kind), 0

    def keep(self, values) -> None:
        """Only these, at most as many as there are."""
        self.size = len(values)
        self._all[: self.size] = values

    def extend(self, values) -> None:
        end = self.size + len(values)
        if end > len(self._all):
            self._all = np.concatenate([self._all[: self.size], np.zeros(end - self.size + end // 4, self._all.dtype)])
        self._all[self.size : end] = values
        self.size = end

    @property
    def array(self) -> np.ndarray:
        return self._all[: self.size]


class Lattice:
    """Word lattices of one SentencePiece model.

    Nodes are positions of words, numbered through, and one without edges after each word;
    ``first`` says where a node's edges begin. Of every edge there is the node that it leads
    to (-1: the word's end), its conditional probability, the log of it, its node's
    probabilities up to it, and its piece (below 0: several, of a character in bytes).

    ``ranked``: scores are merge ranks below 0, not log-probabilities.
    """

    def __init__(self, path: str, ranked: bool = True):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._pieces: dict[str, tuple] = {}
        m = self.model
        for i in range(m.get_piece_size()):
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
                s = m.get_score(i)
                self._pieces[m.id_to_piece(i)] = (i, (2 - s) ** -RANK_POWER if ranked else math.exp(s))
        if any(SPACE in p.lstrip(SPACE) for p in self._pieces):
            raise ValueError("a piece spans a white space")
        # pieces that don't mix letters with others let words be cut between them
        mixed = regex.compile(rf"{SPACE}*(\p{{L}}+|[^\p{{L}}{SPACE}]*)")
        apart = all(mixed.fullmatch(p) for p in self._pieces)
        #: of every character 2 (white space), else 1 (letters, if they are cut from others) or 0
        self._class = np.zeros(0x110000, np.uint8)
        for run in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))) if apart else ():
            self._class[run.start() : run.end()] = 1
        self._class[ord(SPACE)] = 2
        self._bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._byte_weight = min(w for _, w in self._pieces.values()) / math.e
        self._trie()
        self._reset()

    def _trie(self) -> None:
        """States of a trie over the pieces: keys of (state, character), the state that each
        leads to, and of every state its piece (-1 for none) and log-weight."""
        states, keys, ids, weights = {"": 0}, [], [-1], [1.0]
        for piece, (i, weight) in self._pieces.items():
            for q in range(1, len(piece) + 1):
                if piece[:q] not in states:
                    states[piece[:q]] = len(states)
                    keys.append(((states[piece[: q - 1]] << 21) + ord(piece[q - 1]), states[piece[:q]]))
                    ids.append(-1)
                    weights.append(1.0)
            ids[states[piece]], weights[states[piece]] = i, weight
        keys.sort()
        self._keys, self._to = (np.array(x, np.int64) for x in zip(*keys))
        self._id_of, self._log_of = np.array(ids), np.log(weights)
        slots = self._slot(self._keys)
        self._slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self._slots[slots] = np.arange(len(slots))
        self._slots[np.bincount(slots, minlength=1 << _SLOT_BITS) > 1] = -2

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _follow(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states go on with their character, and to which states these do."""
        key = (state << 21) + char
        hit = self._slots[self._slot(key)]
        shared = np.flatnonzero(hit == -2)
        if len(shared):
            hit[shared] = np.minimum(np.searchsorted(self._keys, key[shared]), len(self._keys) - 1)
        good = np.flatnonzero((hit >= 0) & (self._keys[hit] == key))
        return good, self._to[hit[good]]

    def _reset(self) -> None:
        # of every word its root, uses and hash; where its characters begin; words whose hash another has
        self._root, self._uses, self._hash = _Growing(np.int64), _Growing(np.int64), _Growing(np.uint64)
        self._chars, self._from, self._clash = _Growing(np.uint32), _Growing(np.int64), {}
        self._from.extend([0])
        self._table_bits = 18
        self._tabulate()
        self._several: list[tuple[int, ...]] = []
        self._first, self._next, self._piece = _Growing(np.int32), _Growing(np.int32), _Growing(np.int32)
        self._share, self._log, self._upto = _Growing(np.float64), _Growing(np.float64), _Growing(np.float64)
        self._first.extend([0])

    def encode(self, text: str | None) -> list[int]:
        return self.model.encode(text or "")

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)

    def roots(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text the first node of each word's lattice, for the model's normal form of it."""
        found = [self.model.normalize(t) if t else "" for t in texts]
        sizes, text = np.array([len(t) for t in found], np.int64), "".join(found)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self._class[chars]
        # a word is white space and then characters of one class; none goes on in the next text
        ends = np.cumsum(sizes)
        begins = np.ones(len(kind), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 2)
        begins[(ends - sizes)[sizes > 0]] = True
        begin = np.flatnonzero(begins)
        number = self._numbers(text, chars, begin) if len(begin) else begin
        uses = self._uses.array
        uses += np.bincount(number, minlength=len(uses))
        return np.split(self._root.array[number], np.searchsorted(begin, ends[:-1]))

    def _numbers(self, text: str, chars: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The number of every word of a text; words are found by hashes and compared character by character."""
        end = np.append(begin[1:], len(chars))
        sizes, place = end - begin, np.arange(len(chars))
        own = self._hashes(chars, begin, place - np.repeat(begin, sizes))
        number = self._find(own)
        new = np.flatnonzero(number < 0)
        if len(new):
            first = np.sort(new[np.unique(own[new], return_index=True)[1]])
            known = self._root.size
            self._add([text[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())])
            self._hash.extend(own[first])
            if self._root.size > 1 << self._table_bits - 2:
                self._table_bits += 1
                self._tabulate()
            else:
                self._place(np.arange(known, self._root.size))
            number[new] = self._find(own[new])
        start = self._from.array
        other = start[number + 1] - start[number] != sizes
        place += np.repeat(start[number] - begin, sizes)
        differ = self._chars.array.take(place, mode="clip") != chars
        if differ.any():
            other |= np.logical_or.reduceat(differ, begin)
        for i in np.flatnonzero(other).tolist():
            word = text[begin[i] : end[i]]
            if word not in self._clash:
                self._clash[word] = self._root.size
                self._add([word])
                self._hash.extend(own[i : i + 1])
            number[i] = self._clash[word]
        return number

    @staticmethod
    def _hashes(chars: np.ndarray, begin: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A hash of every word, from its characters and their places in it."""
        own = np.add.reduceat((chars + np.uint64(1)) * _FACTORS[place & len(_FACTORS) - 1], begin)
        return (own ^ (own >> np.uint64(32))) * _ODD

    def _find(self, own: np.ndarray) -> np.ndarray:
        """The first word's number of each hash, or -1."""
        number, known, at = np.full(len(own), -1), self._hash.array, np.arange(len(own))
        slot = (own >> np.uint64(64 - self._table_bits)).astype(np.int64)
        while len(at) and len(known):
            here = self._table[slot]
            same = (here >= 0) & (known[here] == own)
            number[at[same]] = here[same]
            on = np.flatnonzero((here >= 0) & ~same)
            at, own, slot = at[on], own[on], slot[on] + 1 & len(self._table) - 1
        return number

    def _place(self, number: np.ndarray) -> None:
        """Puts words, of different hashes, in the table."""
        slot = (self._hash.array[number] >> np.uint64(64 - self._table_bits)).astype(np.int64)
        while len(number):
            free = self._table[slot] < 0
            self._table[slot[free]] = number[free]
            on = np.flatnonzero(self._table[slot] != number)
            number, slot = number[on], slot[on] + 1 & len(self._table) - 1

    def _tabulate(self) -> None:
        self._table = np.full(1 << self._table_bits, -1, np.int32)
        self._place(np.setdiff1d(np.arange(self._hash.size), list(self._clash.values())).astype(np.int64))

    def _add(self, words: list[str]) -> None:
        """Adds the lattices of new words, some at a time."""
        part, held = [], 0
        for word in words:
            part.append(word)
            held += len(word)
            if held >= ADD_CHARS:
                self._add_part(part)
                part, held = [], 0
        if part:
            self._add_part(part)

    def _add_part(self, words: list[str]) -> None:
        """Adds the lattices of words; edges of a node stand in falling order of length."""
        sizes = np.array([len(w) for w in words])
        stops = np.cumsum(sizes + 1) - 1
        text = "\0".join(words) + "\0"
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars[stops] = _END
        n = len(chars)
        left = np.repeat(stops, sizes + 1) - np.arange(n)
        # every piece that begins at every position, by a walk of all positions through the trie
        at, step, found = np.flatnonzero(left), 0, []
        state = np.zeros(len(at), np.int64)
        while len(at):
            good, state = self._follow(state, chars[at + step])
            at, step = at[good], step + 1
            whole = np.flatnonzero(self._id_of[state] >= 0)
            if len(at):
                found.append((at[whole], state[whole]))
        wide = max(len(found), 1)
        lengths = np.arange(wide, 0, -1)
        # positions stand by what is left of their words, so that a step back is a slice
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        log, piece = np.full((wide, n), -np.inf), np.full((n, wide), _NONE, np.int32)
        for step, (at, state) in enumerate(found, 1):
            log[wide - step, rank[at]] = self._log_of[state]
            piece[at, wide - step] = self._id_of[state]
        # characters without a piece
        bare = np.flatnonzero((piece[:, wide - 1] == _NONE) & (left > 0))
        if len(bare):
            raw = [text[i].encode("utf-8", "surrogatepass") for i in bare.tolist()]
            piece[bare, wide - 1] = -len(self._several) - 1 - np.arange(len(bare))
            log[wide - 1, rank[bare]] = np.log(self._byte_weight) * np.array([len(r) for r in raw])
            self._several.extend([tuple([self._bytes[b] for b in r]) for r in raw])
        # log-sums of what lies below, from the ends of words backwards, all words at once
        below = np.zeros(n + wide)
        cuts = np.cumsum(np.bincount(left)).tolist()
        for a, b, low in zip(cuts, cuts[1:], range(wide - 1, -len(cuts), -1)):
            low = max(low, 0)  # no piece is longer than what is left
            here, own = order[a:b], log[low:, a:b]
            own += below[here + lengths[low:, None]]
            most = own.max(0)
            own -= most
            top = own == 0
            others = np.exp(own)
            others[top] = 0.0
            total = np.log1p(others.sum(0) + (top.sum(0) - 1))  # exact beside a piece that leaves next to nothing
            below[here] = most + total
            own -= total
        piece = piece.ravel()
        edge = np.flatnonzero(piece != _NONE)
        piece, begin = piece[edge], edge // wide
        column = edge - begin * wide
        log, to = log[column, rank[begin]], begin + lengths[column]
        upto = np.cumsum(np.bincount(begin, minlength=n))
        share = np.maximum(np.exp(log), 1e-300)
        sums = np.concatenate([[0.0], np.cumsum(share)])
        base = self._first.size - 1
        reach = np.minimum(sums[1:] - sums[np.concatenate([[0], upto[:-1]])][begin], 1.0)
        reach[upto[left > 0] - 1] = 1.0
        self._upto.extend(reach)
        self._first.extend(self._next.size + upto)
        self._share.extend(share)
        self._log.extend(np.maximum(log, math.log(1e-300)))  # 0 where there is no choice
        self._next.extend(np.where(left[to] > 0, base + to, -1))
        self._piece.extend(piece)
        self._root.extend(base + stops - sizes)
        self._from.extend(self._chars.size + np.cumsum(sizes))
        self._chars.extend(chars[left > 0])
        self._uses.extend(np.zeros(len(words), np.int64))

    def make_room(self) -> None:
        """Keeps, if there are too many edges, half as many of them, of the words most used (more than once)."""
        if self._next.size <= CACHE_EDGES:
            return
        several = self._several
        first, root, uses = self._first.array, self._root.array, self._uses.array
        nodes = np.diff(root, append=len(first) - 1)
        edges = first[root + nodes] - first[root]
        order = np.argsort(-uses, kind="stable")
        keep = uses > 1
        keep[list(self._clash.values())] = False
        keep[order[np.cumsum(edges[order]) > CACHE_EDGES // 2]] = False
        node, edge = np.repeat(keep, nodes), np.repeat(keep, edges)
        moved = np.append(np.cumsum(node) - 1, -1)
        to, piece = moved[self._next.array[edge]], self._piece.array[edge]
        bare = np.flatnonzero(piece < 0)
        self._several = [several[-i - 1] for i in piece[bare].tolist()]
        piece[bare] = -1 - np.arange(len(bare))
        for column in (self._share, self._log, self._upto):
            column.keep(column.array[edge])
        self._next.keep(to)
        self._piece.keep(piece)
        self._first.keep(np.concatenate([[0], np.cumsum(np.diff(first)[node])]))
        self._root.keep(moved[root[keep]])
        self._uses.keep(uses[keep] // 2)
        sizes = np.diff(self._from.array)
        self._chars.keep(self._chars.array[np.repeat(keep, sizes)])
        self._from.keep(np.concatenate([[0], np.cumsum(sizes[keep])]))
        self._hash.keep(self._hash.array[keep])
        self._clash = {}
        self._tabulate()

    def ids(self, edges: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of segmentations that follow one another, ``sizes`` edges each, and their numbers of pieces."""
        found = self._piece.array[edges]
        several = np.flatnonzero(found < 0)
        if not len(several):
            return found, sizes
        runs = [self._several[-i - 1] for i in found[several].tolist()]
        more = np.array([len(r) - 1 for r in runs])
        out = np.insert(found, np.repeat(several + 1, more), 0) if more.any() else found
        at = several + np.cumsum(more) - more
        for i, run in zip(at.tolist(), runs):
            out[i : i + len(run)] = run
        ends = np.cumsum(sizes)
        beyond = np.concatenate([[0], np.cumsum(more)])
        upto = lambda x: x + beyond[np.searchsorted(several, x)]
        return out, upto(ends) - upto(ends - sizes)


def _mix(x: np.ndarray) -> np.ndarray:
    """A number between 0 and 1, both excluded, for every hash; overwrites the hashes."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(12)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


def _hash(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What ``_mix`` takes, for every seed and place."""
    return seed + at.astype(np.uint64) * _ODD


def key_seed(key: object, seed: int) -> int:
    return int.from_bytes(blake2b(f"{seed}|{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _down(lat: Lattice, node: np.ndarray, slot: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walks from every node to its word's end: all edges, walk by walk, and where each walk begins, and the last ends."""
    first, following, upto = lat._first.array, lat._next.array, lat._upto.array
    noise = _hash(seed, slot << 32)
    walk, step, out, size = np.arange(len(node)), 0, [], np.zeros(len(node), np.int64)
    while len(node):
        edge = first[node]
        reach = upto[edge]
        if reach.min() < 1:
            u = _mix(noise + np.uint64(step * int(_ODD) & (1 << 64) - 1))
            # long pieces stand first, so that few steps find most; a node's last edge reaches 1
            beyond = np.flatnonzero(reach <= u)
            while len(beyond):
                at = edge[beyond] + 1
                edge[beyond] = at
                beyond = beyond[upto[at] <= u[beyond]]
        out.append((walk, edge))
        step += 1
        to = following[edge]
        on = np.flatnonzero(to >= 0)
        size[walk] = step
        node, noise, walk = to[on], noise[on], walk[on]
    begin = np.concatenate([[0], np.cumsum(size)])
    edges = np.empty(begin[-1], np.int64)
    for step, (walk, edge) in enumerate(out):
        edges[begin[walk] + step] = edge
    return edges, begin


def _truncated(value: float, mass: float, u: float) -> float:
    """The largest Gumbel of a set of this log-mass, truncated at ``value``."""
    a, b = -value, math.log(-math.log(u)) - mass
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


def _leaving(log: np.ndarray, total: float, u: float) -> int:
    """A step of a path, drawn by the masses that leave it at its steps; ``total``: the sum of ``log``, below 0."""
    bound, end = -math.log1p(u * math.expm1(total)), 64
    while True:
        sums = -np.cumsum(log[:end])
        if sums[-1] > bound:
            return int(np.searchsorted(sums, bound, "right"))
        if end >= len(log):  # by rounding alone
            return int(np.flatnonzero(log)[-1])
        end *= 8


def sample(lat: Lattice, texts: list[np.ndarray], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Of each text (roots of its words) up to ``k`` distinct (edges, log-probability, perturbed value, inclusion score)."""
    first, share, log_share, following = lat._first.array, lat._share.array, lat._log.array, lat._next.array
    m = len(texts)
    seeds = np.array(seeds, np.uint64)
    #: value, log-probability of the prefix, path it leaves, between which steps, their log-probability, edges shut
    start = -np.log(-np.log(_mix(_hash(seeds, np.zeros(m, np.int64)))))
    queues: list[list[tuple]] = [[(v, 0.0, None, 0, 0, 0.0, ())] for v in start.tolist()]
    found: list[list[tuple]] = [[] for _ in texts]
    for round_ in range(k):
        live = [t for t in range(m) if queues[t]]
        if not live:
            break
        own = seeds + np.uint64((round_ + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        draws = _mix(_hash(own[:, None], np.arange(6).astype(np.uint64) + np.uint64(1 << 63))).tolist()
        turns = []
        for t in live:
            best = max(range(len(queues[t])), key=lambda i: queues[t][i][0])
            value, prefix, path, a, b, total, shut = queues[t].pop(best)
            if path is None:
                turns.append((t, value, prefix, None, 0, -1, -1, -1))
                continue
            whole, log, shift, word, heads, marks = path
            u = draws[t]
            v = a
            if not shut:
                v += _leaving(log[a:b], total, u[0])
                if v > a:
                    gone = float(log[a:v].sum())
                    if gone < 0:
                        queues[t].append((_truncated(value, prefix + math.log(-math.expm1(gone)), u[1]), prefix, path, a, v, gone, ()))
                    prefix += gone
                rest = float(log[v + 1 : b].sum())
                if rest < 0:
                    then = prefix + float(log[v])
                    queues[t].append((_truncated(value, then + math.log(-math.expm1(rest)), u[2]), then, path, v + 1, b, rest, ()))
                shut = (int(whole[shift + v]),)
            node = int(np.searchsorted(first, np.int32(shut[0]), "right")) - 1
            open_ = [e for e in range(int(first[node]), int(first[node + 1])) if e not in shut]
            shares = [float(share[e]) for e in open_]
            pick, rest = len(open_) - 1, u[3] * sum(shares)
            for i, p in enumerate(shares):
                rest -= p
                if rest < 0:
                    pick = i
                    break
            e = open_[pick]
            if v >= heads:
                word += int(np.searchsorted(marks, marks[0] + v - heads, "right"))
            if len(open_) > 1:
                mass = prefix + math.log(sum(shares[:pick]) + sum(shares[pick + 1 :]))
                queues[t].append((_truncated(value, mass, u[4]), prefix, path, v, v + 1, 0.0, (*shut, e)))
            turns.append((t, value, prefix, path, v, word, e, int(following[e])))
        # what is left of words that were left within, and the words behind them, are walked down
        roots = [x for t, *_, w, _, to in turns for x in (((to,),) if to >= 0 else ()) + (texts[t][w + 1 :],)]
        within = np.array([to >= 0 for *_, to in turns])
        after = np.array([w + 1 for *_, w, _, _ in turns])
        sizes = np.array([len(texts[t]) for t in live]) - after + within
        bases = np.cumsum(sizes) - sizes
        slot = np.arange(sizes.sum()) + np.repeat(after - within - bases, sizes)
        walked, begin = _down(lat, np.concatenate(roots), slot, np.repeat(own[live], sizes))
        logs = log_share[walked]
        for (t, value, prefix, path, v, w, e, to), base, size in zip(turns, bases.tolist(), sizes.tolist()):
            part, shift, heads = slice(begin[base], begin[base + size]), 0, 0
            whole, log = walked[part], logs[part]
            then, rest = prefix, float(log.sum())
            marks = begin[base : base + size + 1]
            if path is not None:
                shift, heads = path[2] + v, 1
                if to >= 0:
                    heads, marks = 1 + int(marks[1] - marks[0]), marks[1:]
                whole = np.concatenate([path[0][:shift], [e], whole])
                own_log = log_share[e : e + 1]
                then += float(own_log[0])
                if round_ + 1 < k:
                    log = np.concatenate([own_log, log])
            found[t].append((whole, then + rest, value))
            if rest < 0:
                mass = then + math.log(-math.expm1(rest))
                left = (whole, log, shift, w, heads, marks)
                queues[t].append((_truncated(value, mass, draws[t][5]), then, left, min(heads, 1), len(log), rest, ()))
    out = []
    for t in range(m):
        bound = max([q[0] for q in queues[t]], default=-math.inf)
        out.append([(e, log, value, -math.expm1(-math.exp(min(log - bound, 700.0)))) for e, log, value in found[t]])
    return out


def lattice(path: str) -> Lattice:
    """This worker's lattices of the model file at ``path``."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def sample_segmentations(df: DataFrame, keys: list[str], text_col: str, model: str, k: int = 4, seed: int = 0) -> DataFrame:
    """``keys`` and, of each row, up to ``k`` distinct segmentations in order drawn.

    Columns: sample (from 1), ids (little-endian unsigned 32-bit), n_pieces, log_prob,
    perturbed, inclusion.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        own, texts, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                own.append(key)
                texts.append(text)
                held += len(text or "") + 16
                if held >= GROUP_CHARS:
                    yield own, texts
                    own, texts, held = [], [], 0
        if own:
            yield own, texts

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for own, texts in groups(batches):
            lat.make_room()
            drawn = sample(lat, lat.roots(texts), [key_seed(x, seed) for x in own], k)
            rows = [(key, n, *one) for key, of in zip(own, drawn) for n, one in enumerate(of, 1)]
            key, n, edges, log, value, score = zip(*rows)
            ids, sizes = lat.ids(np.concatenate(edges), np.array([len(e) for e in edges]))
            ids, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key, pa.string()),
                    pa.array(n, pa.int32()),
                    pa.array([ids[4 * a : 4 * b].tobytes() for a, b in zip([0, *ends], ends)], pa.binary()),
                    pa.array(sizes, pa.int64()),
                    *[pa.array(x, pa.float64()) for x in (log, value, score)],
                ],
                names=["key", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion"],
            )

    key = F.to_json(F.struct(*[F.col(c).cast("string").alias(str(i)) for i, c in enumerate(keys)]))
    schema = "key string, sample int, ids binary, n_pieces long, log_prob double, perturbed double, inclusion double"
    out = df.select(key.alias("key"), F.col(text_col).alias("text")).mapInArrow(draw, schema)
    types = dict(df.dtypes)
    clash = {"sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion"}.intersection(keys)
    if clash:
        raise ValueError(f"keys named like results: {sorted(clash)}")
    back = [F.get_json_object("key", f"$['{i}']").cast(types[c]).alias(c) for i, c in enumerate(keys)]
    return out.select(*back, "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion")


def _free(df: DataFrame, name: str) -> str:
    """``name``, unless ``df`` has such a column, which would be lost."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {name} already")
    return name


def encode_texts(df: DataFrame, text_col: str, model: str, to: str = "ids") -> DataFrame:
    """``df`` with a new column ``to``: the model's own segmentation, as bytes; null counts as empty."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.array(lattice(model).encode(t), "<u4").tobytes())

    return df.withColumn(_free(df, to), ids(text_col))


def decode_ids(df: DataFrame, ids_col: str, model: str, to: str = "decoded") -> DataFrame:
    """``df`` with a new column ``to``: the text of any segmentation; null counts as empty."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: lattice(model).decode(np.frombuffer(x or b"", "<u4").tolist()))

    return df.withColumn(_free(df, to), decoded(ids_col))


def op10_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distinct sampled segmentations of every document, with a digest of their ids."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    drawn = sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], "text", model)
    return drawn.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")

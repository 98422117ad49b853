"""Operators that search by draws or lists, held to all pairs where draws are scarce."""

import zlib

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from loomspan.llm import nn_descent, order_minhash, quality
from loomspan.llm.tokens import default_tokenizer


def named(n: int, a, b) -> list[int]:
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a, b):
        x, y = find(int(x)), find(int(y))
        root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def family(n: int, seed: int, words: int = 204, changed: tuple[int, int] = (18, 22)) -> list[str]:
    """Variants of one template; only those whose changed runs overlap reach 0.8."""
    rng = np.random.default_rng(seed)
    template = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        length = int(rng.integers(*changed))
        at = int(rng.integers(0, words - length))
        out.append(" ".join(template[:at] + [f"v{i}x{k}" for k in range(length)] + template[at + length :]))
    return out


def agreeing_pairs(texts: list[str]) -> tuple[list[int], list[int]]:
    """All pairs with a common sketch, two agreeing ones and an alignment of 0.8."""
    words = [order_minhash.word_hashes(t) for t in texts]
    s = np.stack([order_minhash.sketch(order_minhash.labelled(w)) for w in words])
    a, b = [], []
    for i in range(len(texts)):
        for j in np.flatnonzero((s[i] == s[i + 1 :]).sum(1) >= order_minhash.AGREE) + i + 1:
            if order_minhash.aligned_similarity(words[i], words[j]):
                a.append(i)
                b.append(j)
    return a, b


def test_classes_of_a_template_family(spark):
    texts = family(240, seed=1)
    want = named(len(texts), *agreeing_pairs(texts))
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_dense_groups_that_link_each_other(spark):
    # two groups of 20 equal vectors at cosine 0.95: every list of 12 holds its own group
    x = np.zeros((41, 4))
    x[:20, 0] = 1
    x[20:40, :2] = 0.95, np.sqrt(1 - 0.95**2)
    x[40, 3] = 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicate_vectors(df).collect()}
    near = x @ x.T >= nn_descent.THRESHOLD
    part = named(len(x), *np.nonzero(near))
    assert got == {i: (near[i].sum() - 1, part[i]) for i in range(len(x))}


def test_planted_links_of_every_density_are_all_found(spark):
    # clusters of 2 to 60 about random centres, copies, a chain and noise, in two labels
    rng = np.random.default_rng(5)
    x, label = [], []
    for size in [2] * 60 + [5] * 20 + [60] * 3:
        c = rng.normal(size=24)
        x += [c + rng.normal(size=24) * rng.uniform(0.05, 0.35) for _ in range(size)]
        label += [size % 2] * size
    x += [x[-1]] * 150 + list(rng.normal(size=(400, 24)))
    turn = np.linspace(0, np.pi, 40)
    x += [np.r_[np.cos(t), np.sin(t), np.zeros(22)] for t in turn]
    label += [label[-1]] * 150 + [0] * 440
    x, label = np.array(x), np.array(label)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicate_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= nn_descent.THRESHOLD) & (label[:, None] == label[None])
    part = named(len(x), *np.nonzero(near))
    assert got == {i: (near[i].sum() - 1, part[i]) for i in range(len(x))}


def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline

    scores = quality.op1_quality_qda(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    docs = docs[docs.doc_id.isin(scores[scores.predicted == 1].doc_id)].sort_values("doc_id")
    words = [order_minhash.word_hashes(t) for t in docs.text]
    a, b = [], []
    for i in range(len(words)):
        for j in range(i):
            if len(words[i]) and len(words[i]) == len(words[j]) and (words[i] == words[j]).all() or order_minhash.aligned_similarity(words[i], words[j]):
                a.append(i)
                b.append(j)
    kept = docs[[i == r for i, r in enumerate(named(len(docs), a, b))]]
    seen, want = set(), {}
    tokenizer = Tokenizer.from_file(default_tokenizer())
    for doc, text in zip(kept.doc_id, kept.text):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        want[doc] = [*tokenizer.encode(left, add_special_tokens=False).ids, 2]
    pieces = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(pieces.doc_id) == set(want)
    for p in pieces.itertuples():
        assert p.ids_crc32 == zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    assert pieces.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in want.items()}

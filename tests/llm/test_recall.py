"""Near pairs with scattered edits, several texts of an id, repeated queries, pages without an article element."""

import random

import numpy as np
import pytest

from loomspan.llm import multi_index, order_minhash, page_text, sampled_pieces


def test_scattered_edits_near_the_threshold_are_found(spark):
    rng = random.Random(5)
    rows = []
    for pair in range(200):
        words = [f"w{rng.randrange(50_000)}" for _ in range(200)]
        edited = list(words)
        for i in rng.sample(range(200), 20):  # matched words: 180 of each 200, 0.818 of both with what replaces them
            edited[i] = f"x{rng.randrange(50_000)}" if i % 2 else edited[i] + f" y{rng.randrange(50_000)}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(edited))]
    classes = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(classes[2 * p] == classes[2 * p + 1] for p in range(200)) >= 180
    assert all(classes[d] // 2 == d // 2 for d in classes)


def test_texts_that_differ_under_one_id_all_stay(spark):
    texts = {1: ["one two three four five six seven"], 2: ["quite another text of seven words here", "and a third text that is not alike", "and a third text that is not alike"]}
    rows = [(i, t, i) for i, own in texts.items() for t in own] + [(None, "no id at all here", 0)] * 2
    kept = order_minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, extra long")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, texts[1][0]), (2, texts[2][0]), (2, texts[2][1]), (0, "no id at all here"), (0, "no id at all here")])


def test_a_repeated_query_is_answered_once(spark):
    x = np.random.default_rng(1).normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.nearest(df, df.where("vec_id = 0"), "vec_id", "embedding", 5).orderBy("rank").collect()
    away = np.sqrt(np.square(x - x[0]).sum(1))
    assert [(r.rank, r.vec_id) for r in got] == list(enumerate(np.argsort(away)[1:6].tolist(), 1))


def test_probing_reaches_every_code_within_a_radius():
    rng = np.random.default_rng(2)
    bits = rng.random((3000, 40)) < 0.5
    shard = multi_index.Shard(np.arange(3000), rng.normal(size=(3000, 2)), bits)
    for radius in (0, 1, 3, 4, 7, 10, 13):
        for q in bits[:5]:
            near = q.copy()
            near[rng.integers(0, 40, 3)] ^= True
            assert shard.within(near, radius).tolist() == np.flatnonzero((bits ^ near).sum(1) <= radius).tolist()


def test_text_of_its_own_stays_wherever_it_stands(spark):
    word = lambda rng, n: " ".join("".join(rng.choices("aeioulnrst", k=6)) for _ in range(n))
    forms = {
        "lead.example": "<div class='lead'>{a}</div><section>{b}</section><section>{c}</section>",
        "head.example": "<div><h1>{a}</h1></div><main>{b}</main><div>{c}</div>",
        "table.example": "<main>{a}</main><table class='facts'><tr><td>{b}</td><td>{c}</td></tr></table>",
        "fix.example": "<article>{a}{b}</article><div class='note2'>{c}</div>",
    }
    rows, want = [], {}
    for h, (host, form) in enumerate(forms.items()):
        for i in range(8):
            rng = random.Random(100 * h + i)
            a, b, c = word(rng, 12), word(rng, 80), word(rng, 30)
            body = form.format(a=f"<p>{a}</p>", b=f"<p>{b}</p>", c=f"<p>{c}</p>")
            menu = "<div class='links9'><a href='/x'>Home</a> <a href='/y'>All news</a></div>"
            rows.append((100 * h + i, f"http://{host}/{i}", f"<html><body>{menu}{body}<footer>{word(rng, 6)}</footer></body></html>"))
            want[100 * h + i] = f"{a} {b} {c}"
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_encoding_replaces_no_column(spark):
    df = spark.createDataFrame([("a", b"")], "IDS string, decoded binary")
    for f in (lambda: sampled_pieces.encode_texts(df, "IDS", "m"), lambda: sampled_pieces.decode_ids(df, "decoded", "m")):
        with pytest.raises(ValueError, match="already"):
            f()
    assert sampled_pieces.encode_texts(df, "IDS", "m", "fresh").columns == ["IDS", "decoded", "fresh"]

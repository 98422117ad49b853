"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import gzip
import hashlib
import io
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspan.llm import archives, multi_index, nn_descent, order_minhash, packing, page_text, quality, repeated_spans, sampled_pieces, suffix_sort, token_files
from loomspan.llm.shared import shared_dir
from loomspan.llm.tokens import default_tokenizer, encoder

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
rng = np.random.default_rng(0)
LONG = " ".join(rng.choice(WORDS, 20_000))
BASE = " ".join(f"{w}{i}" for i, w in enumerate(rng.choice(WORDS, 200)))
NEAR = BASE.replace("0 ", "0 ", 1).rsplit(" ", 1)[0] + " changed"
ROWS = [(1, BASE, "x"), (2, NEAR, "x"), (3, None, "x"), (4, "", None), (5, LONG, "x"), (6, BASE, "x"), (7, "one two", "x"), (8, "ünï cödé " * 40, "x")]
SCHEMA = "doc_id long, text string, bucket string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (9, None)], "doc_id long, quality int")
    out = quality.score(docs, labels).toPandas()
    assert len(out) == 8 and out.score.between(0, 1).all() and set(out.predicted) <= {0, 1}
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]
    assert quality.score(none, labels).count() == 0
    assert set(quality.score(docs, labels.limit(0)).toPandas().score) == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns
    more = docs.unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", docs.doc_id * None))
    again = quality.score(more.withColumnRenamed("bucket", "score"), labels.unionByName(labels.limit(1))).toPandas()
    assert len(again) == 10 and len(set(again[(again.doc_id == 2) | again.doc_id.isna()].score)) == 1
    assert not again[again.doc_id.isna()].held_out.any()


def test_quality_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    out = quality.op1_quality_qda(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.95


def test_page_text(spark):
    article = "<article><h1>Head &amp; line</h1><p>One <b>bo</b>ld<p>Two<br>three<div class='ad'>buy</div><form>f</form></article>"
    pages = [(i, "http://h.example/", f"<html><head><title>t</title></head><body><nav>menu</nav><p>{i}</p>{article}<footer>f</footer>", 1) for i in range(20)]
    plain = [(100 + i, "http://g.example/x", f"<body><p>Same line</p><p>Own {i}</p><script>var t='</p>'</script>", 1) for i in range(8)]
    odd = [(200, None, None, 1), (201, "u", "", 1), (202, "u", "<p>a < b &lt; c", 1), (203, "u", "<div>" * 5000 + "deep", 1), (203, "u", "x", 1)]
    df = spark.createDataFrame(pages + plain + odd, "page_id long, url string, html string, salt int")
    out = page_text.extract(df).toPandas()
    text = out.set_index("page_id").text
    assert len(out) == 33 and text[0] == "0 Head & line One bold Two three" and text[100] == "Own 0" and out.n_templates[0] > 0
    assert text[200] == "" and text[201] == "" and text[202] == "a < b < c" and sorted(text[203]) == ["deep", "x"]
    assert (out.n_chars == out.text.str.len()).all() and page_text.extract(df.limit(0)).count() == 0


def test_host_templates_equal_brute_force(spark, sf_dir):
    # templates decide on most pages, nothing of an article is lost, and counting per host in plain Python agrees
    d = sf_dir.replace("sf0.001", "sf0.01")
    pages = spark.read.parquet(f"{d}/pages.parquet").toPandas()
    got = page_text.op2_template_removal(spark, d).toPandas().set_index("page_id")
    host = pages.url.str.extract(r"^[a-z]+://([^/]+)")[0]
    roots = {i: page_text.parse(h) for i, h in zip(pages.page_id, pages.html)}
    per_host, pooled, size = {}, Counter(), Counter(host)
    for i, h in zip(pages.page_id, host):
        found = list(page_text.slots(roots[i]))
        per_host.setdefault(h, Counter()).update({s for _, s in found})
        if size[h] < page_text.LEAST_PAGES:
            pooled.update({s for x, s in found if "." in x.name or x.kind != page_text.KEPT})
    low = {s for s, n in pooled.items() if n >= max(page_text.SLOT_PAGES, page_text.SLOT_SHARE * sum(n for n in size.values() if n < page_text.LEAST_PAGES))}
    changed = 0
    for i, h, html in zip(pages.page_id, host, pages.html):
        counted = size[h] >= page_text.LEAST_PAGES
        own = {s for s, n in per_host[h].items() if n >= max(page_text.SLOT_PAGES, page_text.SLOT_SHARE * size[h])} if counted else low
        text, _ = page_text.main_text(roots[i], page_text.Templates(slots=frozenset(own), counted=counted))
        assert got.text[i] == text
        article = page_text.parse(re.search("<article>.*</article>", html, re.S)[0])
        assert text == page_text.main_text(article)[0]
        changed += counted and text != page_text.main_text(roots[i], page_text.Templates(counted=True))[0]
    assert changed > len(pages) / 2


@pytest.mark.parametrize(
    "html, text",
    [
        ("<main><p>Body text here</p><article class='comment'>Reader says</article></main>", "Body text here"),
        ("<article><div class='entry-header'><h1>Title</h1></div><p class='share-price'>Up</p></article>", "Title Up"),
        ("<article><header><h1>T</h1></header><div class='ad-box'>buy</div><p>x</p></article><header>site</header>", "T x"),
        ("<div id='comments'>no</div><p hidden>no</p><p>yes</p>", "yes"),
    ],
)
def test_what_elements_declare(html, text):
    assert page_text.main_text(page_text.parse(html))[0] == text


def test_near_duplicates(docs, none):
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 6: 1, 3: 3, 4: 4, 5: 5, 7: 7, 8: 8}
    assert order_minhash.near_duplicates(none).count() == 0
    twice = docs.unionByName(docs.where("doc_id = 5"))
    assert sorted(r.doc_id for r in order_minhash.one_of_each(twice).collect()) == [1, 3, 4, 5, 7, 8]


def test_alignment_is_a_longest_common_order():
    a = np.arange(50, dtype=np.uint64)
    assert order_minhash.aligned_similarity(a, a) == 1
    b = np.delete(a, [10, 20])
    assert order_minhash.aligned_similarity(a, b) == pytest.approx(48 / 50)
    assert order_minhash.aligned_similarity(a, a[::-1].copy()) == 0
    assert order_minhash.aligned_similarity(a, np.concatenate([a[25:], a[:25]])) == 0


def test_vectors(spark):
    v = rng.normal(size=(60, 8))
    v[1] = v[0] + 0.01
    v[31:60] = v[30] + rng.normal(size=(29, 8)) * 0.001
    rows = [(i, x.tolist(), i % 2 if i < 30 else 0, "x") for i, x in enumerate(v)]
    rows[1] = (1, v[1].tolist(), 0, "x")
    rows += [(100, None, 0, "x"), (101, [0.0] * 8, 0, "x"), (102, [float("nan")] * 8, 0, "x"), (103, v[0].tolist(), None, "x"), (104, [None] * 8, 0, "x"), (105, [], 0, "x"), (106, [1.0] * 9, 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string")
    out = {r.vec_id: r for r in nn_descent.near_duplicate_vectors(df).collect()}
    x = np.array(v, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:60]])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    assert [out[i].n_links for i in range(60)] == near.sum(1).tolist()
    assert out[45].component_id == 30 and not out[45].kept and out[1].component_id == 0
    assert all(out[i].n_links == 0 and out[i].kept for i in range(100, 107)) and len(out) == 67
    assert nn_descent.near_duplicate_vectors(df.limit(0)).count() == 0
    twice = nn_descent.near_duplicate_vectors(df.unionByName(df.where("vec_id = 45")).unionByName(df.where("vec_id = 0").withColumn("vec_id", df.vec_id * None))).toPandas()
    assert sorted(twice[twice.vec_id == 45].n_links) == [near[45].sum()] * 2 and twice[twice.vec_id.isna()].n_links.tolist() == [0]
    found = multi_index.nearest(df, df.where("vec_id in (0, 45, 100)"), "vec_id", "embedding", 5).toPandas()
    assert sorted(set(found.query_id)) == [0, 45] and len(found) == 10
    few = multi_index.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), "vec_id", "embedding", 5).toPandas()
    exact = np.sqrt(np.square(np.float32(v[0]).astype(float) - np.float32(v[1]).astype(float)).sum())
    assert few.vec_id.tolist()[0] == 1 and len(few) == 2 and few.score[0] == pytest.approx(exact, rel=1e-12)
    assert multi_index.nearest(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0
    ties = spark.createDataFrame([(i, [1.0, float(i % 2)] + [0.0] * 6) for i in (9, 4, 7, 2, 5, 7)], "vec_id long, embedding array<float>")
    own = multi_index.nearest(ties, ties.where("vec_id = 4"), "vec_id", "embedding", 5).orderBy("rank").toPandas()
    assert own.vec_id.tolist() == [2, 5, 7, 7, 9] and own.score.tolist() == [0.0, 1.0, 1.0, 1.0, 1.0]


def test_multi_index_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    got = multi_index.op8_multi_index(spark, sf_dir).toPandas()
    x = np.stack(e.embedding).astype(float)
    hit = total = 0
    for i in np.flatnonzero(e.vec_id.to_numpy() % 100 == 0):
        away = np.square(x - x[i]).sum(1)
        away[i] = np.inf
        hit += len(set(got[got.query_id == e.vec_id[i]].vec_id) & set(e.vec_id[np.argsort(away)[:10]]))
        total += 10
    assert hit / total >= 0.9



def test_shard_finds_every_code_in_the_radius():
    x = rng.normal(size=(500, 16))
    codes = multi_index.Codes(x)
    packed = codes.encode(x)
    shard = multi_index.Shard(np.arange(500), x, packed)
    for r in (0, 3, 9, 14):
        brute = np.flatnonzero((packed ^ packed[7]).sum(1) <= r)
        assert shard.within(packed[7], r).tolist() == brute.tolist()


def test_suffix_ranks():
    for n in (1, 2, 3, 5, 8, 60):
        for top in (1, 2, 4):
            s = rng.integers(1, top + 1, n)
            order = sorted(range(n), key=lambda i: s[i:].tolist())
            want = np.empty(n, int)
            want[order] = np.arange(1, n + 1)
            assert suffix_sort.suffix_ranks(s, 1 << 20).tolist() == want.tolist()


def _brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        out[i] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot, bucket", [(4096, 1 << 20), (1, 1 << 20), (4096, 0), (1, 5)])
def test_repeats(spark, docs, none, tmp_path, monkeypatch, hot, bucket):
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    monkeypatch.setattr(repeated_spans, "HOT_BUCKET", bucket)
    more = [(10 + i, f"{i} " * 60 + BASE[50 * i : 50 * i + 400] + f" {i}" * 30, "x") for i in range(12)] + [(30, "ab" * 400, "x")]
    df = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in repeated_spans.op5_suffix_repeats(spark, str(tmp_path)).collect()}
    assert got == _brute([(r[0], r[1]) for r in ROWS + more])
    cut = {r.doc_id: r.text for r in repeated_spans.remove_repeats(df).collect()}
    assert cut[6] == "" and cut[1] == BASE and cut[3] is None
    assert repeated_spans.remove_repeats(none).count() == 0
    clash = df.selectExpr("doc_id", "text", "bucket", "bucket doc", "doc_id spans", "1 `row`", "length(text) n_chars")
    for r in repeated_spans.remove_repeats(clash).collect():
        assert (r.doc, r.spans, r.row, r.n_chars, r.text) == (r.bucket, r.doc_id, 1, None if r.text is None else len(r.text), cut[r.doc_id])
    twice = df.unionByName(df.where("doc_id = 1")).unionByName(df.where("doc_id = 1").withColumn("doc_id", df.doc_id * None))
    assert sorted(len(r.text or "") for r in repeated_spans.remove_repeats(twice).where("text like 'alpha0%' or text like '%changed' or text = ''").collect())[0] == 0


def test_pieces_of_text_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(repeated_spans, "BUFFER", 500)
    sizes = [0, 50, 100, 499, 500, 501, 1700, 599, 3]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab c"), n)) for n in sizes]
    batch = pd.DataFrame({"doc": range(len(sizes)), "text": texts})
    pieces = [piece for _, piece in repeated_spans._hashed(batch)]
    windows = sorted((d, s + i) for p in pieces for d, s, n in zip(p[2], p[3], p[4]) for i in range(n))
    assert windows == [(d, i) for d, n in enumerate(sizes) for i in range(max(0, n - repeated_spans.LENGTH + 1))]
    packed = repeated_spans._packed(pieces, 7)
    assert packed.bucket.is_unique and packed.n.sum() == sum(map(len, packed["count"])) and sum(map(len, packed["count"])) == sum(len(p[0]) for p in pieces)


def test_archives(spark):
    rows = [(1, "http://a/ b", "same", 1), (2, "http://b/", "same", 1), (3, None, None, 1), (4, "http://c/", "", 1), (5, "http://d/", "é\r\n\r\nWARC/1.1\n" * 9, 1), (2, "http://b/", "same", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file int")
    arcs = shared_dir(spark, "arc")
    long = spark.createDataFrame([(9, "http://l/", LONG * 40, 1)], df.schema)
    records = archives.choose_types(archives.write_arcs(df.unionByName(long), arcs))
    manifest = archives.convert(records, arcs, shared_dir(spark, "warc"))
    out = archives.read_warcs(manifest).toPandas()
    assert len(out) == 7 and out.payload_bytes.max() == len(LONG * 40)
    heads = []
    for r in manifest.collect():
        with gzip.open(r.path) as f:
            heads += [h for h, _ in archives.read_warc(f)]
    ids = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert sum(h["WARC-Type"] == "warcinfo" for h in heads) == manifest.count() and len({h["WARC-Record-ID"] for h in heads}) == len(heads)
    assert all(h["WARC-Refers-To"] in ids for h in heads if h["WARC-Type"] == "revisit")
    assert sorted(out[out.page_id == 2].record_type) == ["response", "revisit"]  # of repeated rows one is the response
    assert {r.record_type for r in archives.read_warcs(archives.convert(archives.choose_types(archives.write_arcs(df, arcs), 10), arcs, shared_dir(spark, "warc"))).where("payload_bytes < 10").collect()} == {"response"}
    out = out[(out.page_id != 9)]
    for r in out.itertuples():
        payload = (next(x[2] for x in rows if x[0] == r.page_id) or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = {r.page_id: (r.record_type, None if r.refers_to != r.refers_to or r.refers_to is None else int(r.refers_to)) for r in out.astype(object).itertuples()}
    assert kind[1] == ("revisit", 2) and kind[3] == ("revisit", 4)
    empty = archives.choose_types(archives.write_arcs(df.limit(0), arcs))
    assert archives.read_warcs(archives.convert(empty, arcs, shared_dir(spark, "warc"))).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_and_damage(version):
    r = archives.ArcRecord("http://x/", "1.2.3.4", "20200102030405", "text/html", b"a\nfiledesc://b\n")
    data = archives.arc_header(version, "f") + archives.arc_record(version, r, 0, "f")
    assert list(archives.read_arc(io.BytesIO(data)))[1:] == [r]
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(data[:-5])))
    assert archives.warc_date("20200102030405") == "2020-01-02T03:04:05Z"


def test_packing(docs, none):
    out = packing.digests(packing.pack_documents(docs, default_tokenizer())).toPandas()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    for doc, text, _ in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = out[out.doc_id == doc].sort_values("start")
        assert own.length.sum() == len(ids) and (own.start == own.length.cumsum() - own.length).all()
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    size = out.groupby("sequence_id").length.sum()
    assert size.max() <= 4096 and all(n & (n - 1) == 0 for n in size)
    assert packing.pack_documents(none, default_tokenizer()).count() == 0


def test_packing_of_prompts_many_short_rows_and_null_ids(spark):
    rows = [(None if i % 50 == 0 else i % 900, f"Question {i}?", "Yes." if i % 3 else None, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, q string, text string, prompt string").coalesce(2)
    out = packing.pack_documents(df, default_tokenizer(), prompt_col="q", limits=packing.Limits(512, 8, 100)).toPandas()
    seqs = out.groupby("sequence_id").agg(n=("length", "sum"), k=("length", "count"), loss=("loss_tokens", "sum"))
    assert seqs.k.max() <= 8 and seqs.loss.max() <= 100 and all(n & (n - 1) == 0 for n in seqs.n)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    whole = lambda x: len(tokenizer.encode(x or "", add_special_tokens=False).ids)
    assert out.length.sum() == sum(whole(q) + whole(t) + 1 for _, q, t, _ in rows)
    assert out.loss_tokens.sum() == sum(whole(t) + 1 for _, _, t, _ in rows)
    assert all(len(r.ids) == 4 * r.length for r in out.itertuples()) and out.doc_id.isna().sum() >= 60


def test_packer_keeps_all_three_limits():
    limits = packing.Limits(100, 3, 40)
    items = [(i, int(t), int(l)) for i, (t, l) in enumerate(zip(rng.integers(1, 150, 200), rng.integers(0, 60, 200)))]
    items = [(i, t, min(t, l)) for i, t, l in items]
    got = Counter()
    for seq in packing.sequences(iter(items), limits, 16):
        assert sum(p.length for p in seq) <= 100 and len(seq) <= 3 and sum(p.loss for p in seq) <= 40
        for p in seq:
            got[p.key, "n"] += p.length
            got[p.key, "l"] += p.loss
    assert all(got[i, "n"] == t and got[i, "l"] == l for i, t, l in items)


def test_token_files(spark, docs, none):
    folder = shared_dir(spark, "tokens")
    manifest = token_files.write_token_files(docs, default_tokenizer(), folder)
    rows = sorted(token_files.read_token_files(manifest).collect())
    tokenizer = Tokenizer.from_file(default_tokenizer())
    at = 0
    for r, (doc, text, _) in zip(rows, ROWS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (doc, at, ids)
        at += len(ids)
    assert [r.doc_id for r in token_files.read_token_files(manifest, [5, 7]).orderBy("doc_id").collect()] == [5, 7]
    odd = docs.where("doc_id in (2, 5)").unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id = 7").withColumn("doc_id", docs.doc_id * None))
    back = token_files.read_token_files(token_files.write_token_files(odd.withColumnRenamed("bucket", "ids"), default_tokenizer(), folder)).toPandas().sort_values("start")
    assert [None if i != i or i is None else int(i) for i in back.doc_id.astype(object).where(back.doc_id.notna(), None)] == [None, 2, 2, 5]
    assert back.start.tolist() == [0, *np.cumsum([len(x) // 4 for x in back.ids])[:-1].tolist()]
    empty = token_files.write_token_files(none, default_tokenizer(), folder)
    assert token_files.read_token_files(empty).count() == 0


def test_token_file_checksums():
    out = io.BytesIO()
    writer = token_files.ShardWriter(out)
    for i in range(5):
        writer.add(i, np.arange(40_000, dtype="<u4").tobytes())
    writer.finish()
    data = out.getvalue()
    assert len(token_files.ShardReader(io.BytesIO(data), len(data)).seek) == 3
    bad = bytearray(data)
    bad[200] ^= 1
    with pytest.raises(Exception):
        list(token_files.ShardReader(io.BytesIO(bytes(bad)), len(bad)).documents())


def test_word_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(default_tokenizer())
    odd = ["", "  ", "a\tb", "İ ΣΑΣ x", "<|endoftext|> a<|endoftext|>b", "don't can'T 12½ ²x_ª \x1c z \x85y \xa0q", "日本語 ß ŒUVRE", "a" * 500]
    odd += ["".join(rng.choice(list("abcZ É½²ªµ'srt_\t\n\xa0\xad\x85<|>é\x1c\x00"), 60)) for _ in range(100)]
    for text, ids in zip(odd, encoder(default_tokenizer())(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_sampled_pieces(spark, docs, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    df = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", docs.doc_id * None))
    out = sampled_pieces.sample_segmentations(df, ["doc_id"], "text", model, 3)
    rows = out.toPandas()
    plain = sampled_pieces.decode_ids(out, "ids", model).toPandas()
    for doc, text, _ in ROWS:
        own = rows[rows.doc_id == doc]
        times = 2 if doc == 1 else 1
        assert len(own) == times * len(set(own.ids)) == times * (3 if text else 1)
        assert set(plain[plain.doc_id == doc].decoded) == {text or ""}
        assert own.perturbed.iloc[:3].is_monotonic_decreasing and own.inclusion.between(0, 1).all()
        assert all(len(r.ids) == 4 * r.n_pieces for r in own.itertuples())
    assert len(rows[rows.doc_id.isna()]) == 3
    assert sampled_pieces.sample_segmentations(none, ["doc_id"], "text", model).count() == 0
    again = sampled_pieces.sample_segmentations(docs.where("doc_id = 1"), ["doc_id"], "text", model, 3).toPandas()
    assert again.ids[0] == rows[rows.doc_id == 1].ids.iloc[0]
    own = sampled_pieces.decode_ids(sampled_pieces.encode_texts(docs, "text", model, "i"), "i", model, "t").toPandas()
    assert own.t.tolist() == [t or "" for t in own.text]
    with pytest.raises(ValueError):
        sampled_pieces.sample_segmentations(docs.withColumnRenamed("doc_id", "ids"), ["ids"], "text", model)


def test_gumbel_top_k_has_the_right_distribution():
    lat = sampled_pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    (roots,), every = lat.roots(["ab cé ☃"]), [((), 0.0)]
    first, share, following = lat._first.array, lat._share.array, lat._next.array

    def below(node):
        for e in range(first[node], first[node + 1]):
            rest = below(following[e]) if following[e] >= 0 else [((), 0.0)]
            for b, d in rest:
                yield (e, *b), math.log(share[e]) + d

    for root in roots:
        every = [(a + c, b + d) for a, b in every for c, d in below(root)]
    logs, n = dict(every), 4000
    assert sum(map(math.exp, logs.values())) == pytest.approx(1)
    count, second, estimate = Counter(), Counter(), 0.0
    for drawn in sampled_pieces.sample(lat, [roots] * n, [sampled_pieces.key_seed(i, 1) for i in range(n)], 3):
        count[tuple(drawn[0][0])] += 1
        second[tuple(drawn[1][0])] += 1
        assert len({tuple(d[0]) for d in drawn}) == 3 and drawn[0][2] > drawn[1][2] > drawn[2][2]
        assert all(abs(logs[tuple(d[0])] - d[1]) < 1e-9 for d in drawn)
        estimate += sum(math.exp(d[1]) / d[3] for d in drawn)
    assert estimate / n == pytest.approx(1, abs=0.02)
    assert max(abs(count[k] / n - math.exp(v)) for k, v in logs.items()) < 0.03
    # the second drawn: without replacement
    p = {k: math.exp(v) for k, v in logs.items()}
    want = {k: sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k) for k in p}
    assert max(abs(second[k] / n - want[k]) for k in p) < 0.03
    whole = sampled_pieces.sample(lat, [roots], [0], len(logs) + 9)[0]
    assert len(whole) == len(logs) and {d[3] for d in whole} == {1.0}
    # numbers of a row don't depend on its neighbours
    pair = sampled_pieces.sample(lat, [*lat.roots(["x y"]), roots], [1, 2], 2)
    assert pair[1][0][2] == sampled_pieces.sample(lat, [roots], [2], 2)[0][0][2]


def test_most_used_words_are_built_once(monkeypatch):
    lat = sampled_pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    built, add = Counter(), sampled_pieces.Lattice._add
    monkeypatch.setattr(sampled_pieces.Lattice, "_add", lambda self, words: (built.update(words), add(self, words)))
    monkeypatch.setattr(sampled_pieces, "CACHE_EDGES", 2000)
    often = "the model ☃ learns, été 日本 ☃☃ words!"
    first = None
    for i in range(12):
        fresh = " ".join("".join(rng.choice(list("abcdeé☃"), 7)) for _ in range(30))
        lat.make_room()
        texts = [often, f"{often} {fresh}  ", ""]
        roots = lat.roots(texts)
        for text, drawn in zip(texts, sampled_pieces.sample(lat, roots, [1, i, 2], 4)):
            ids, sizes = lat.ids(np.concatenate([d[0] for d in drawn]), np.array([len(d[0]) for d in drawn]))
            own = np.split(ids, np.cumsum(sizes)[:-1])
            assert len({x.tobytes() for x in own}) == len(own) == (4 if text else 1)
            assert {lat.decode(x.tolist()) for x in own} == {lat.decode(lat.encode(text))}
            assert all(d[1] == pytest.approx(np.log(lat._share.array[d[0]]).sum()) for d in drawn)
            if text is often:  # what was kept draws as what was built
                first = first or [x.tolist() for x in own]
                assert [x.tolist() for x in own] == first
    assert len(built) > 300 and lat._next.size < 4000
    assert {built[w] for w in ("▁the", "▁model", "▁learns", "▁words", "▁☃☃")} == {1}


def test_words_of_equal_hashes_stay_apart(monkeypatch):
    texts = [None, "", "a", "  ▁a!! a", "the cat\n\nthe ☃ 日本", "x" * 3000, *("".join(rng.choice(list("ab ▁!é1☃\n"), 40)) for _ in range(60))]

    def drawn():
        lat, out = sampled_pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model")), []
        for part in (texts[:20], texts, texts[30:]):
            lat.make_room()
            for of in sampled_pieces.sample(lat, lat.roots(part), list(range(len(part))), 3):
                ids, _ = lat.ids(np.concatenate([d[0] for d in of]), np.array([len(d[0]) for d in of]))
                out.append((ids.tolist(), [d[1:] for d in of]))
        return out

    want, hashes = drawn(), sampled_pieces.Lattice._hashes
    for edges in (10**6, 500):
        monkeypatch.setattr(sampled_pieces, "CACHE_EDGES", edges)
        monkeypatch.setattr(sampled_pieces.Lattice, "_hashes", staticmethod(lambda *a: hashes(*a) >> np.uint64(60)))
        for (ids, numbers), (other, others) in zip(want, drawn(), strict=True):
            assert ids == other and np.allclose(numbers, others)


def test_pipeline_follows_its_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_pipeline_stages_take_any_rows(spark, docs, none, sf_dir, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    odd = docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", docs.doc_id * None))
    odd = odd.selectExpr("doc_id", "text", "bucket", "bucket doc", "bucket spans", "bucket class_id", "bucket score", "bucket id")
    out = run(spark, odd, sf_dir)
    if stage < 3:
        assert out.columns == odd.columns and out.count() <= odd.count()
        assert run(spark, none.withColumn("n_chars", none.doc_id), sf_dir).count() == 0
    else:
        pieces = out.toPandas()
        assert pieces[pieces.start == 0].shape[0] == odd.count() and run(spark, none, sf_dir).count() == 0

"""Grid codes against plain numpy in exact integers, and their defined cases."""

import hashlib
import math

import numpy as np
import pytest

from loomspan.llm import grid_codes as G

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=256, rounds=4):
    """(id, code, error, label) of usable rows and the digest, with Python's integers."""
    good = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in good]
    width = min(sorted(set(lengths)), key=lambda n: (-lengths.count(n), n))
    good = sorted([g for g in good if len(g[1]) == width], key=lambda g: (g[0] is None, g[0] or 0, g[1]))
    d = -(-width // 4)
    whole = [[max(-(10**14), min(10**14, math.floor(1024 * x))) for x in v] + [0] * (4 * d - width) for _, v, _ in good]
    parts = [[w[p * d : (p + 1) * d] for w in whole] for p in range(4)]
    books = [own[:entries] for own in parts]

    def assign(own, book):
        return [min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book)) for x in own]

    for _ in range(rounds):
        for p in range(4):
            near = assign(parts[p], books[p])
            for e in range(len(books[p])):
                own = [x for x, (_, n) in zip(parts[p], near) if n == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    final = [assign(parts[p], books[p]) for p in range(4)]
    out = [(g[0], "".join(f"{final[p][i][1]:02x}" for p in range(4)), min(2**63 - 1, sum(final[p][i][0] for p in range(4))), g[2]) for i, g in enumerate(good)]
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_equal_brute_force(spark, entries):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) / 3).tolist(), i % 3) for i in range(60)]
    rows += [(100, rows[0][1], None), (100, rows[0][1], None), (3, rows[9][1], 1), (None, rows[7][1], None)]  # repeated vectors and ids
    rows += [(200, None, 1), (201, [None] * 8, 1), (202, [math.nan] + [0.0] * 7, 1), (203, [math.inf] * 8, 1), (204, [1.0, 2.0], 1), (205, [], 1)]
    rows += [(206, [0.0] * 8, 2), (207, [1e7, -1e7] * 4, 2), (208, [1e300, -1e300] * 4, 2), (209, [3e10] * 8, 2)]
    codes, books = G.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding", "label", entries=entries)
    want, digest = brute(rows, entries)
    got = [(r.id, r.code, r.error, r.label) for r in codes.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert G.digest(books) == digest


def test_a_length_that_parts_do_not_divide_is_filled_up(spark):
    rows = [(i, [i / 7, -i / 5, i % 3 / 2, 0.1, 0.3], None) for i in range(20)]
    codes, books = G.compressed(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", entries=4)
    want, digest = brute(rows, 4)
    assert sorted((r.id, r.code, r.error, r.label) for r in codes.collect()) == sorted(want)
    assert G.digest(books) == digest


def test_an_empty_table_and_one_of_unusable_vectors_give_no_rows(spark, tmp_path):
    for name, rows in {"none": [], "bad": [(1, None, 1), (2, [math.nan], 2)]}.items():
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        out = G.op11_grid_cells(spark, f"{tmp_path}/{name}")
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert out.collect() == []


def test_clashing_columns_and_errors_of_labels(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) / 4).tolist(), None if i % 4 == 0 else i % 2, "x", i, "y") for i in range(400)]
    spark.createDataFrame(rows, SCHEMA + ", code string, error int, id string").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = G.op11_grid_cells(spark, str(tmp_path)).collect()
    want, digest = brute([r[:3] for r in rows])
    total = {}
    for _, _, error, label in want:
        total[label] = total.get(label, 0) + error
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in out) == sorted((i, c, e, total[label]) for i, c, e, label in want)
    assert {r.codebooks_sha256 for r in out} == {digest}


def test_cells_keep_every_nearest_entry_and_few_others():
    rng = np.random.default_rng(6)
    entries = np.floor(rng.normal(size=(256, 16)) * 128).astype(np.int64)
    entries[7] = entries[3]
    parts = np.concatenate([np.floor(rng.normal(size=(3000, 16)) * 128).astype(np.int64), entries])
    cells = G.Cells(entries)
    entry, away = cells.nearest(parts)
    every = np.square(parts[:, None] - entries[None]).sum(2)
    assert (entry == every.argmin(1)).all() and (away == every.min(1)).all()
    assert np.mean([len(x) for x in cells._lists]) < 16
    kept = len(cells._slots)
    cells.nearest(parts)
    assert len(cells._slots) == kept  # met before: nothing new is worked out

"""Vector codes against plain loops over whole integers."""

import hashlib

import numpy as np
import pytest

from tracegraph.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, v string, key int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "v", 2) for r in rows], SCHEMA)


def brute(rows, entries=256, rounds=4):
    kept = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = len(kept[min(kept)]) // 4
    parts = lambda v: [v[p * width:(p + 1) * width] for p in range(4)]
    books = [[parts(kept[i])[p] for i in sorted(kept)[:entries]] for p in range(4)]
    near = lambda q, p: min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for v in kept.values():
                groups.setdefault(near(parts(v)[p], p)[1], []).append(parts(v)[p])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = {i: [near(q, p) for p, q in enumerate(parts(v))] for i, v in kept.items()}
    errors = {i: sum(d for d, _ in f) for i, f in found.items()}
    label = {i: g for i, _, g in rows}
    sums = {}
    for i, e in errors.items():
        sums[label[i]] = sums.get(label[i], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in f), errors[i], sums[label[i]], digest) for i, f in found.items()}


@pytest.mark.parametrize("entries", [256, 9])
def test_codes(spark, entries):
    rng = np.random.default_rng(entries)
    v = np.concatenate([rng.normal(size=(40, 8)), rng.normal(size=(20, 8)) * 100, np.repeat(rng.normal(size=(1, 8)), 15, axis=0), -rng.integers(0, 3, (30, 8)) / 1024])
    rows = [(int(i), [float(x) for x in r], None if i % 5 == 0 else int(i) % 3) for i, r in zip(rng.permutation(len(v)), v)]
    rows += [(900, None, 1), (901, [1.0] * 7 + [float("nan")], 1), (902, [float("inf")] + [0.0] * 7, 1), (903, [None] + [0.0] * 7, 1)]
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(table(spark, rows), entries=entries).collect()}
    assert got == brute(rows, entries)


def test_odd_vectors(spark):
    rows = [(3, [1.0, 2.0, 3.0, 4.0], 1), (3, [1.0, 2.0, 3.0, 4.0], 1), (4, [1e30, -1e30, 0.0, 0.0], None), (None, [0.5, 0.5, 0.5, 0.5], 2), (5, [1.0], 1), (6, [], 1)]
    got = sorted((str(r.vec_id), r.error) for r in vector_codes.compress(table(spark, rows)).collect())
    assert [k for k, _ in got] == ["3", "3", "4", "None"] and all(e is not None for _, e in got)
    assert vector_codes.compress(table(spark, [(1, [1.0, 2.0, 3.0], 1)])).first().code is None  # not to be cut into four
    assert vector_codes.compress(table(spark, [(None, [1.0] * 4, 1)])).first().code is None  # no seed
    assert vector_codes.compress(table(spark, [])).count() == 0


def test_nearest_is_exact_and_ties_go_to_the_lowest():
    rng = np.random.default_rng(1)
    for spread in (3, 1000, 1 << 26):
        e, q = rng.integers(-spread, spread + 1, (256, 6)), rng.integers(-spread, spread + 1, (3000, 6))
        code, error = vector_codes.Slices(e).nearest(q)
        d = ((q[:, None] - e[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()


def test_boxes_hold_what_they_should():
    rng = np.random.default_rng(2)
    e, q, r = rng.integers(-50, 50, (100, 3)), rng.integers(-50, 50, (200, 3)), rng.integers(0, 40, 200)
    assert (vector_codes.Slices(e).candidates(q, r) == (np.abs(q[:, None] - e[None]) <= r[:, None, None]).all(2)).all()


def test_decoding(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)]
    vectors = vector_codes.kept_vectors(table(spark, rows)).persist()
    books = vector_codes.train_codebooks(vectors)
    for r in vector_codes.encode(vectors, books, ("key", "label", "v")).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.v, books.decode(r.code))) == r.error

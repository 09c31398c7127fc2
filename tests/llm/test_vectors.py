"""Whitening and vector codes against brute force over whole small tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import vector_codes, whitening
from tallymark.llm.common import saved, spread_join

SCHEMA = ("vec_id long, embedding array<float>, label int, key string, x int, size int, component int, n string, code int, "
          "error string, v int, more0 int, digest string")


def vectors():
    """Random vectors, one that a third of all rows share, near ones, unusable ones, repeated and null ids."""
    rnd = np.random.default_rng(3)
    plain = rnd.normal(size=(150, 32)) * np.linspace(0.2, 2, 32) / 6
    rows = [(int(k) * 3, v.astype(np.float32).tolist(), int(k) % 4 if k % 9 else None) for k, v in enumerate(plain)]
    rows += [(1000 + k, rows[5][1], 2) for k in range(90)] + [(rows[7][0], rows[7][1], 1), (None, rows[8][1], None)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [1.0, None] * 16, 1), (2003, [math.nan] * 32, 1), (2004, [math.inf] * 32, 0)]
    rows += [(2005, [0.0] * 32, 3), (2006, [-1.0 / 512] * 32, 3)]
    return rows


@pytest.fixture(scope="module")
def given():
    return vectors()


@pytest.fixture(scope="module")
def frame(spark, given):
    return saved(spark.createDataFrame([(*r, "k", 1, 2, 3, "n", 4, "e", 5, 6, "d") for r in given], SCHEMA).repartition(3))


def usable(given):
    return [r for r in given if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


def test_whitening(frame, given):
    good = usable(given)
    x = np.floor(1024 * np.array([r[1] for r in good], float)).astype(int) + 100_000
    n, total = len(x), x.sum(0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = whitening.whiten(frame).collect()
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    assert sorted(r.vec_id or -1 for r in out if r.component == 1) == sorted(r[0] or -1 for r in good)
    deviation = {r[0]: int(d) for r, d in zip(good, (np.square(n * x - total)).sum(1))}
    white = {r[0]: c @ axes[:, :8] / np.sqrt(values[:8]) for r, c in zip(good, centred)}
    sign = {k: math.copysign(1, next(r for r in out if r.component == k + 1 and r.vec_id == 0).whitened * white[0][k]) for k in range(8)}
    for r in out:
        k = r.component - 1
        assert r.deviation == deviation[r.vec_id]
        assert abs(r.whitened * sign[k] - white[r.vec_id][k]) < 1e-6
        assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_weights_and_edges(spark, frame):
    distinct = frame.dropDuplicates(["embedding"])
    ones = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whiten(frame, weights="one").collect()}
    for r in whitening.whiten(distinct).collect():
        assert abs(abs(r.whitened) - ones[r.vec_id, r.component]) < 1e-6
    assert whitening.whiten(frame.limit(0)).collect() == []
    flat = spark.createDataFrame([(k, [0.5, 0.25]) for k in range(4)], "vec_id long, embedding array<double>")
    out = whitening.whiten(flat).collect()
    assert len(out) == 8 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in out} == {(0.0, 0.0, 0.0, 0)}
    mixed = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [1e12])], "vec_id long, embedding array<double>")
    out = {(r.vec_id, r.component): r for r in whitening.whiten(mixed).collect()}
    assert set(out) == {(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2)}
    assert abs(abs(out[1, 1].whitened) - 1) < 1e-12 and out[1, 1].n == 2 and out[3, 2].whitened == 0.0
    with pytest.raises(ValueError):
        whitening.whiten(mixed, weights="some")


def test_whitening_far_from_zero():
    """Sums that pass a long stay exact, a deviation that passes one is null."""
    x = np.array([[2 ** 40, 7], [3, 2 ** 40]])
    apart = whitening.scaled(x, 2 ** 30, [2 ** 69, 5])
    assert apart[0].tolist() == [2 ** 70 - 2 ** 69, 7 * 2 ** 30 - 5]
    assert whitening.squares(apart) == [None, None]
    assert whitening.squares(np.array([[3, 4]])) == [25]


def brute_codes(good, parts=16, entries=64, rounds=2):
    x = np.floor(256 * np.array([r[1] for r in good], float)).astype(int)
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, x[k].tolist()))
    width = x.shape[1] // parts
    cut = [x[:, p * width:(p + 1) * width] for p in range(parts)]
    books = [c[order[:entries]].copy() for c in cut]

    def nearest(c, book):
        far = np.square(c[:, None, :] - book[None]).sum(-1)
        return far.argmin(1), far.min(1)

    for _ in range(rounds):
        for p in range(parts):
            at, _ = nearest(cut[p], books[p])
            for e in range(len(books[p])):
                if (at == e).any():
                    books[p][e] = [int(s) // int((at == e).sum()) for s in cut[p][at == e].sum(0)]
    final = [nearest(c, b) for c, b in zip(cut, books)]
    codes = ["".join(f"{at[k]:02x}" for at, _ in final) for k in range(len(good))]
    errors = sum(far for _, far in final)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return codes, errors, digest


def test_codes(frame, given):
    good = usable(given)
    codes, errors, digest = brute_codes(good)
    by_label = {}
    for r, e in zip(good, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = sorted(((r[0], c, int(e), by_label[r[2]], digest) for r, c, e in zip(good, codes, errors)), key=key)
    assert sorted((tuple(r) for r in vector_codes.compress(frame).collect()), key=key) == expected


def test_codes_edges(spark, frame):
    assert vector_codes.compress(frame.limit(0)).collect() == []
    few = spark.createDataFrame([(2, [0.1, 0.9, 0.3], "a"), (1, [0.5, 0.2, 0.3], "a"), (3, [1e7, 0.0, 0.0], "a"), (9, [0.5], None)],
                                "vec_id long, embedding array<double>, label string")
    out = {r.vec_id: r for r in vector_codes.compress(few, parts=2).collect()}
    assert set(out) == {1, 2, 9}
    assert (out[1].code, out[2].code, out[9].code) == ("0000", "0100", "0000")
    assert {r.error for r in out.values()} == {0} and out[1].codebooks_sha256 == out[2].codebooks_sha256 != out[9].codebooks_sha256
    assert [list(r) for r in vector_codes.cut(5, 3)] == [[0, 1], [2, 3], [4]]


def test_hot_keys_meet_by_broadcast_the_others_by_shuffle(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") < 100, "hot").when(F.col("id") < 110, None).otherwise(F.col("id").cast("string")).alias("k"))
    keyed = saved(rows.groupBy("k").agg(F.count("*").alias("size"), F.min("id").alias("least")))
    for share in (1, 5, 100_000):
        out = spread_join(rows, keyed, "k", "size", share).collect()
        assert len(out) == 300 and all(r.least == (0 if r.id < 100 else 100 if r.id < 110 else r.id) for r in out)

import math

import numpy as np
import pytest

from estatelens.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, k=4):
    """By the words of the contract, in one process."""
    kept = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    x = np.array([[math.floor(256 * float(np.float32(e))) for e in v] for _, v in kept], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, sums = len(fit), fit.sum(0)
    centred = ((fit * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    whitened = ((x * n - sums) / n).astype(float) @ vectors / np.sqrt(values)
    trace = np.trace(centred.T @ centred / n)
    return {(i, c + 1): (n, int(((row * n - sums) ** 2).sum()), w[c], values[c] / trace)
            for (i, _), row, w in zip(kept, x, whitened) for c in range(k)}


def compare(got, want, k=4):
    assert len(got) == len(want)
    signs = {}
    for r in sorted(got, key=lambda r: r.vec_id):
        n, far, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, far)
        if abs(w) > 1e-3:
            signs.setdefault(r.component, np.sign(w) * np.sign(r.whitened))
        assert r.whitened * signs.get(r.component, 1) == pytest.approx(w, rel=1e-6, abs=1e-8)
        assert r.explained == pytest.approx(share, rel=1e-9) and r.identity_error < 1e-9


def test_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(queries.op12_block_whitening(spark, sf).collect(), plain(rows))


def test_nulls_copies_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies count once
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 5), (2004, [float("inf")] * 5),
           (2005, [-0.0] * 5), (2006, [1.0] * 3)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: whitening.F.lit("clash") for c in ("x", "n", "ids", "block", "part")})
    monkeypatch.setattr(whitening, "BLOCK", 32)
    got = whitening.whiten(df.repartition(5)).collect()
    compare(got, plain(rows + [odd[5]]))


def test_deviations_are_exact_or_null():
    x = np.array([[3, -4], [2**40, 1], [-2**62, 2**62]])
    assert whitening.deviations(x[:1], 3, [1, 2]) == [8**2 + 14**2]
    assert whitening.deviations(x, 3, [1, 2])[:2] == [8**2 + 14**2, None]
    assert whitening.deviations(x[1:2], 1, [2**40 - 5, 0]) == [26]
    assert whitening.deviations(x[2:], 5, [-5 * 2**62, 5 * 2**62 + 3]) == [9]


def test_vectors_without_variance(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], SCHEMA)
    got = whitening.whiten(flat).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [
        (i, c, 1, 0, 0.0, 0.0, 0.0) for i in (0, 1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(10)], SCHEMA)
    rows = whitening.whiten(line).collect()
    assert all(r.whitened == 0 for r in rows if r.component == 2) and rows[0].identity_error < 1e-9
    assert sum(r.whitened**2 for r in rows if r.component == 1) == pytest.approx(10)


def test_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []

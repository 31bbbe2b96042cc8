"""Whitening, exact search and spelling variants against brute force, on odd tables, too."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.llm import embedding_whitening, spelling, vector_search

VECTORS = "vec_id long, embedding array<float>, label int, place int, code int, z int, query int, dim int, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vectors(spark, rows, kind=VECTORS):
    return spark.createDataFrame([(i, v, None, 1, 2, 3, 4, 5, 6) for i, v in rows], kind)


def odd_rows(n=240, dim=6, seed=2):
    """Vectors with copies, near copies, null ones, null and non-finite entries, other lengths, and repeated and null ids."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7]) for i in range(40)] + [(2000 + i, [x + 0.001 for x in base[9]]) for i in range(20)]
    rows += [(50, None), (100, []), (150, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (200, [math.nan] * dim), (3000, [math.inf] + [0.0] * 5)]
    rows += [(50, base[3]), (50, base[3]), (None, base[3]), (None, base[4]), (4000, [0.5, 0.25]), (4050, [0.5, 0.5]), (4100, [0.0] * dim), (4150, [100.0, -200.0, 3.0, 0.0, 0.0, 0.0])]
    return rows


def sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4096, 16])
def test_exact_search_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr(vector_search, "GROUP", 2 if block == 16 else 512)
    monkeypatch.setattr(vector_search, "WAVE_BYTES", 100 if block == 16 else 16 << 20)
    rows = odd_rows()
    want = []
    codes = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if sound(v)]
    for at, (q, x) in enumerate(codes):
        if q is not None and q % 50 == 0:
            hits = [(-sum(a * b for a, b in zip(x, y, strict=True)), i is None, i or 0, i) for k, (i, y) in enumerate(codes) if k != at and len(x) == len(y)]
            want += [(q, r + 1, h[3], -h[0]) for r, h in enumerate(sorted(hits, key=lambda h: h[:3])[:5])]
    got = [tuple(r) for r in vector_search.top_k(vectors(spark, rows).repartition(5), F.col("vec_id") % 50 == 0).collect()]
    order = lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_bounds_hold_and_cells_are_small():
    rng = np.random.default_rng(3)
    for x in (rng.integers(-300, 300, (500, 7)), np.zeros((3, 5), int), rng.integers(-(1 << 27), 1 << 27, (40, 9))):
        q = x[:20]
        lower, upper = vector_search.bounds(*vector_search.approximate(x.astype("<i4")), q)
        true = (q.astype(object) @ x.T.astype(object)).astype(float)
        assert (lower <= true).all() and (true <= upper).all()
    assert vector_search.approximate(x.astype("<i4"))[0].nbytes == 40 * 5
    assert all(d * vector_search.limit(d) ** 2 < 1 << 63 for d in (1, 2, 3, 64, 100, 4096))


def test_search_and_whitening_of_empty_tables(spark):
    none = vectors(spark, [])
    assert vector_search.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    assert vector_search.top_k(vectors(spark, [(1, [1.0]), (50, None)]), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_search.top_k(vectors(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert embedding_whitening.whiten(none).count() == embedding_whitening.whiten(vectors(spark, [(1, None), (2, [math.nan])])).count() == 0


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 12):
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        a = q @ np.diag(rng.random(n) + 0.1) @ q.T
        e, v = embedding_whitening.jacobi((a + a.T) / 2)
        assert e == pytest.approx(np.linalg.eigvalsh(a)[::-1], rel=1e-12) and (np.diff(e) <= 0).all()
        assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-13
    # Eigenvalues from 1 down to 1e-24, whose digits a method that looks at the whole matrix's size would lose.
    scale = np.diag(10.0 ** -np.arange(0, 13, 3))
    b = np.array([[1 if i == j else 0.5 for j in range(5)] for i in range(5)])
    e, _ = embedding_whitening.jacobi(scale @ b @ scale)
    inverse = np.diag(1 / np.diag(scale)) @ np.linalg.inv(b) @ np.diag(1 / np.diag(scale))
    assert e[-1] == pytest.approx(1 / np.linalg.eigvalsh(inverse)[-1], rel=1e-9)


@pytest.mark.parametrize("wide", [False, True])
def test_whitening_against_numpy(spark, wide):
    """Whole numbers are exact; with entries of 1e5, sums of squares leave 64 bits."""
    rows = odd_rows()
    if wide:
        rows += [(5000 + i, [1e5 * (i - 2), 1.0, 2.0 * i, 0.0, 1.0, 1e4]) for i in range(5)]
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if sound(v) and len(v) == 6]
    n, s = len(x), [sum(c) for c in zip(*(v for _, v in x), strict=True)]
    got = embedding_whitening.whiten(vectors(spark, rows).repartition(4)).collect()
    assert len(got) == 6 * n and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    want = collections.Counter((i, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))) for i, v in x)
    assert collections.Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == want
    m = np.array([v for _, v in x], float)
    e, v = np.linalg.eigh(np.cov(m.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    z = (m - m.mean(axis=0)) @ v / np.sqrt(e)
    for k in range(6):
        a = sorted(r.whitened for r in got if r.component == k + 1)
        assert min(np.abs(np.array(a) - np.sort(sign * z[:, k])).max() for sign in (1, -1)) < (1e-6 if wide else 1e-9)
        assert [r.explained for r in got if r.component == k + 1] == pytest.approx([e[k] / e.sum()] * n, rel=1e-4 if wide else 1e-9)


def test_whitening_of_flat_tables(spark):
    """A dimension that never changes has no component; a single vector has none at all."""
    rng = random.Random(1)
    got = embedding_whitening.whiten(vectors(spark, [(i, [rng.random(), 1.0, rng.random()]) for i in range(30)])).collect()
    assert all((r.whitened is None) == (r.component == 3) for r in got) and got[0].identity_error < 1e-12
    one = embedding_whitening.whiten(vectors(spark, [(7, [1.0, 2.0])])).collect()
    assert [(r.component, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in one] == [(1, None, None, None, 0), (2, None, None, None, 0)]
    told = embedding_whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 5.0])], "vec_id string, embedding array<double>"))
    assert sorted({r.vec_id for r in told.collect()}) == ["a", "b"]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_automaton_against_all_words():
    rng = random.Random(2)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abé"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 50))})
        trie = spelling.build(words, list(range(1, len(words) + 1)))
        for w in [*words, "", "abababababab", "z"]:
            assert sorted(spelling.neighbours(trie, w)) == [(x, k + 1) for k, x in enumerate(words) if one_edit(w, x)]


def spelled(rows, every=97):
    count = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w if h % every else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("small", [False, True])
def test_variants_against_all_pairs(spark, small, monkeypatch):
    rng = random.Random(3)
    if small:
        for name, value in (("SHARD_WORDS", 7), ("WAVE_BYTES", 900), ("TASK_WORDS", 20), ("HELD_WORDS", 10), ("PIECE", 40)):
            monkeypatch.setattr(spelling, name, value)
    stems = ["".join(rng.choice("abcdeÉÀ×") for _ in range(rng.randint(4, 8))) for _ in range(25)]
    many = "Colour " * 60 + "colours " * 20 + "colourse " * 8 + "colourses " * 3
    rows = [(None, None), (1, ""), (1, "123 4_5"), (2, many), (2, many.upper()), (None, "ÉTÉSA étésa ÉTÉsa Étésa" * 3), (3, "x" * 70_000), (3, ("y" * 50_000 + " ") * 6)]
    for i in range(80):
        words = [rng.choice(stems) for _ in range(30)]
        for _ in range(6):
            w = rng.choice(words)
            at = rng.randrange(len(w))
            words.append(w[:at] + rng.choice(["", "x", w[at] * 2]) + w[at + 1 :])
        rows.append((10 + i, "-".join(words)))
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, word int, n int, near int, root int").repartition(5)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table).collect()}
    want = spelled(rows)
    assert got == want and any(v[0] for v in want.values()) and any(v[1] != v[0] for w, v in want.items() if v[0])
    assert want["colourses"][1] == "colour"


def test_variants_of_empty_tables(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([("a", None), ("b", "too few words here")], "doc_id string, text string")).count() == 0
    with pytest.raises(ValueError, match="factor"):
        spelling.group_variants(spark.createDataFrame([("a", 1)], "word string, n long"), 1)

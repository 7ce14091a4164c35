"""Token counts, whitening and hard negatives against the library, dense algebra and brute force."""
import math
import random

import numpy as np
import pytest

from settlegrid.checks import ContractError
from settlegrid.llm import hard_negatives, token_counts, whitening

EMBEDDED = "vec_id long, embedding array<float>, label int, x int, score string, block long, tag double"


def embedded(spark, rows):
    """Embeddings with further columns whose names clash with those inside."""
    real = lambda v: v and [None if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, real(v), lab, 3, "s", 4, 0.5) for i, v, lab in rows], EMBEDDED)


# --- token counts ---

@pytest.fixture(scope="module")
def merger():
    return token_counts.Merger(token_counts.vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(token_counts.vocabulary())


def test_counts_equal_the_library(merger, library):
    r, count = random.Random(5), merger.counter()
    texts = ["", " ", "\n\n  x", "aaaaaaa" * 30, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftex", "it's We'LL I'd"]
    texts += ["".join(r.choices("aab bcd\n\t  .,'st12é日本☃😀́  ", k=r.randint(0, 300))) for _ in range(300)]
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts += ["".join(map(chr, r.choices(points, k=200))) for _ in range(50)]
    assert count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_symbols_of_overlapping_pairs_and_long_words(merger, library):
    r = random.Random(6)
    words = ["a" * n for n in range(1, 40)] + ["".join(r.choices("abcdefgh", k=k)) for k in (1, 2, 3, 5000, 20_000)]
    got = merger.symbols([w.encode() for w in words]).tolist()
    assert got == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert merger.symbols([]).tolist() == []


@pytest.mark.parametrize("held, long_text", [(3, 5), (1 << 19, 1 << 20)])
def test_memory_bounds_change_no_count(monkeypatch, merger, library, held, long_text):
    monkeypatch.setattr(token_counts, "HELD_WORDS", held)
    monkeypatch.setattr(token_counts, "HELD_BYTES", held)
    monkeypatch.setattr(token_counts, "LONG_WORD", 4)
    monkeypatch.setattr(token_counts, "LONG_TEXT", long_text)
    texts = ["one two  three\n four", "anticonstitutionally " * 9, "two four", ""]
    assert merger.counter()(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_tokens_table(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 60_000), (4, "é" * 300), (5, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, n_bytes string")
    got = token_counts.count_tokens(docs).collect()
    by_id = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in got}
    assert len(got) == 7 and got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    assert by_id[1, 0] == by_id[2, 0] == (0, False) and by_id[None, 3] == (2, False)
    assert by_id[3, 300_000] == (60_001, True) and by_id[5, 13] == (1, False)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    assert {r.over_limit for r in token_counts.count_tokens(docs.where("doc_id = 5"), limit=0).collect()} == {True}


def test_other_vocabularies_are_refused():
    import public_tokenizers
    with pytest.raises(ContractError):
        token_counts.Merger(public_tokenizers.path("word_bpe_49k.json"))


# --- whitening ---

def test_inertia_and_components_against_dense_algebra():
    r = np.random.default_rng(0)
    for t in range(40):
        d = int(r.integers(1, 30))
        a = r.standard_normal((d, int(r.integers(1, 50))))
        v = a @ a.T / a.shape[1]
        if t % 5 == 0:  # repeated eigenvalues
            q = np.linalg.qr(r.standard_normal((d, d)))[0]
            v = q @ np.diag(np.round(r.random(d) * 3)) @ q.T
            v = (v + v.T) / 2
        if t % 7 == 0:
            v = np.eye(d) * 3
        e = np.linalg.eigvalsh(v)[::-1]
        k = min(16, int((e > 1e-12 * e.sum()).sum()))
        values, vectors = whitening.leading_components(v, 16)
        assert np.allclose(values, e[:k], rtol=1e-9, atol=1e-12 * max(e.sum(), 1))
        assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-9
        assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-11 * max(1, e[0])
        for shift in r.random(3) * e[0]:
            assert whitening.inertia(v - shift * np.eye(d)) == (e > shift).sum()
    assert [len(p) for p in whitening.leading_components(np.zeros((3, 3)), 2)] == [0, 3]


def test_whitened_against_numpy(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.standard_normal(6) * [3, 2, 1, 1, .5, .2]).tolist(), 1) for i in range(200)]
    rows += [(300 + i, rows[0][1], 0) for i in range(150)] + [(7, rows[7][1], 2), (None, rows[3][1], None)]
    bad = [(900, None, 1), (901, [1.0, None, 1, 1, 1, 1], 1), (902, [math.nan, 0, 0, 0, 0, 0], 1), (903, [math.inf, 0, 0, 0, 0, 0], 1)]
    got = whitening.whitened(embedded(spark, rows + bad), k=4).collect()
    assert len(got) == 4 * len(rows)
    x = np.array([[math.floor(64 * np.float32(c).astype(float)) + 1_000_000 for c in v] for _, v, _ in rows])
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(0)
    v = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    want, far = (x - mean) @ u / np.sqrt(e), ((n * x - fit.sum(0)) ** 2).sum(1)
    cells = {}
    for row in got:
        cells.setdefault((row.vec_id, row.deviation), {})[row.component] = row.whitened
        assert row.n == n and row.identity_error < 1e-9 and abs(row.explained - e[row.component - 1] / np.trace(v)) < 1e-12
    mine = np.array([[cells[i, int(f)][c] for c in (1, 2, 3, 4)] for (i, _, _), f in zip(rows, far)])
    assert np.allclose(mine * np.sign((mine * want).sum(0)), want, atol=1e-9)


def test_whitened_odd_tables(spark):
    same = embedded(spark, [(i, [1.0, 2.0], 0) for i in range(5)])
    assert whitening.whitened(same).count() == 0
    assert whitening.whitened(same.limit(0)).count() == 0
    assert whitening.whitened(embedded(spark, [(1, [], 0), (2, None, 0)])).count() == 0
    line = whitening.whitened(embedded(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)])).collect()
    assert len(line) == 5 and {r.component for r in line} == {1}
    with pytest.raises(ContractError):
        whitening.whitened(embedded(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)]))


# --- hard negatives ---

def brute(rows, positives=5, negatives=10):
    live = [(i, [math.floor(256 * np.float32(c).astype(float)) for c in v], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab)
            for i, v, lab in rows if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, v, lab) in enumerate(live):
        if i is None or i % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), math.inf if j is None else j, m) for b, (j, w, m) in enumerate(live) if b != a]
        for ps, pid, _ in sorted(s for s in scored if s[2] == lab)[:positives]:
            inside = sorted(s for s in scored if s[2] != lab and -30 * ps <= -100 * s[0] <= -90 * ps)[:negatives]
            out += [(i, pid, k, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(inside, 1)]
    return sorted(tuple(None if c == math.inf else c for c in r) for r in out)


def mined(df):
    key = lambda r: tuple(math.inf if c is None else c for c in r)
    return sorted((tuple(r) for r in df.collect()), key=key), key


@pytest.mark.parametrize("block", [7, 1024])
def test_hard_negatives_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ROWS", (block, block))
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    r = np.random.default_rng(4)
    centre = r.standard_normal((4, 12))
    rows = [(i, (centre[i % 4] * .4 + r.standard_normal(12) * .3).tolist(), int(r.integers(0, 4))) for i in range(0, 1000, 4)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)] + [(100, rows[25][1], 2), (100, rows[25][1], 2), (8, rows[2][1], 3)]
    rows += [(None, rows[1][1], 1), (2000, None, 1), (2100, rows[1][1], None), (2200, [None] + [0.0] * 11, 1),
             (2300, [math.nan] * 12, 1), (2400, [0.0] * 12, 1), (2500, [-5.0] * 12, 9)]
    got, key = mined(hard_negatives.mine(embedded(spark, rows)))
    assert got == sorted(brute(rows), key=key) and len(got) > 300


def test_hard_negatives_of_few_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [.5, 0.0], 2), (3, [.5, 1.0], 3), (4, [1.0, 0.0], 3)]
    got, key = mined(hard_negatives.mine(embedded(spark, rows)))
    assert got == brute(rows) == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 3, 65536, 32768)]
    assert hard_negatives.mine(embedded(spark, rows[:2])).count() == 0
    assert hard_negatives.mine(embedded(spark, rows).limit(0)).count() == 0


def test_scan_is_exact_where_bounds_are_tight():
    r = np.random.default_rng(9)
    for d in (1, 3, 17, 40):
        cols = r.integers(-3, 4, (d, 500)).astype(np.float32)
        a, ids = r.integers(-3, 4, d).astype(np.float32), r.permutation(500)
        alive = r.random(500) < .8
        score = a @ cols
        windows = [(-1e9, 1e9), (0, 2), (5, 4), (score.max(), score.max())]
        found = hard_negatives.scan(a, cols, cols.min(1), cols.max(1), alive, windows, 7, ids, ids)
        for (low, high), (rows, got) in zip(windows, found):
            want = sorted((-s, i) for s, i, on in zip(score, ids, alive) if on and low <= s <= high)[:7]
            assert [(-s, ids[p]) for p, s in zip(rows, got)] == want

"""Operators 11 to 13 against brute force, and on awkward and empty tables."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import fim, packing, whitening

from .helpers import awkward, documents, empty, prose

# --- 11 ---


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_tokenizer())


def whole(library, text):
    return array("I", [*library.encode(text or "", add_special_tokens=False).ids, 0]).tobytes()


HOSTILE = ["ab", "Ab.", "don't", "it's'll", "é", "ÉCLAIR,", "İx", "J̌", "à", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "x1y22", "...", "&&&", "a-b_c", "\xa0", "　", "\x85", "\x1c", "\x00", "中文", "Σας", "ΟΔΟΣ", "ﬁ", "½", "²", "ǅ", "​", "'s", "'S", "ß", "ŉ", "ſ", "\U0001f600", "Å", "Å"]


def test_ids_equal_the_librarys(library):
    rng, encoder = random.Random(3), packing.Encoder(packing.default_tokenizer())
    for _ in range(4000):
        text = "".join(rng.choice(HOSTILE) + rng.choice(["", " ", "\n", "\t ", "\r\n"]) for _ in range(rng.randrange(7)))
        assert encoder.encode(text.encode()) == whole(library, text), repr(text)


def used(plan, counts):
    full, got = len(counts) - 1, np.zeros_like(counts)
    for p, n in plan:
        assert n > 0
        assert sum(p) <= full
        for v in p:
            got[v] += n
    return got


@pytest.mark.parametrize("bars", [{}, {64: 5}, {1: 1}, {1: 700}, {22: 300, 20: 100}, {60: 9}, {33: 7, 31: 3, 1: 1}, {40: 50, 24: 50}])
def test_plans_hold_all_pieces(bars):
    counts = np.zeros(65, dtype=np.int64)
    for k, n in bars.items():
        counts[k] = n
    plan = packing.plan(counts)
    assert (used(plan, counts) == counts).all()
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit([], counts))


@pytest.mark.parametrize("seed", range(6))
def test_plans_come_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    n = int(10 ** rng.uniform(2, 6))
    counts = np.bincount(np.clip(rng.lognormal(rng.uniform(3, 5.5), 1, n).astype(int), 1, 512), minlength=513)
    plan = packing.plan(counts)
    assert (used(plan, counts) == counts).all()
    bound = -(-int((counts * np.arange(513)).sum()) // 512)
    assert sum(n for _, n in plan) <= max(bound + 2, bound * 1.002)


def test_the_fit_is_that_of_least_squares():
    counts = np.zeros(65, dtype=np.int64)
    counts[[40, 24, 30, 34, 12]] = [50, 70, 40, 30, 20]
    p = packing.patterns(counts)
    x = packing.least_squares(p, counts, 3000)
    a = np.zeros((65, len(p)))
    for j, row in enumerate(p):
        for v in row[row > 0]:
            a[v, j] += 1
    gradient = a.T @ (a @ x - counts)
    assert (x >= 0).all()
    assert gradient.min() > -1e-3  # no pattern would improve it
    assert np.abs(gradient[x > 1e-6]).max() < 1e-3


def packed_rows(spark, docs, length=64):
    rows = [r.asDict() for r in packing.pack(docs, packing.default_tokenizer(), length).collect()]
    room = defaultdict(list)
    for r in rows:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in room.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    return rows, room


def test_pieces_are_whole_and_gapless(spark, library):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 3, 8, 8, 8, 40, 200])) for _ in range(300)] + ["same words"] * 200 + [None, "", "x " * 5000]
    rows, room = packed_rows(spark, documents(spark, texts).repartition(7))
    by_doc = defaultdict(dict)
    for r in rows:
        assert r["start"] == 64 * r["piece"]
        by_doc[r["doc_id"]][r["piece"]] = bytes(r["ids"])
    for i, t in enumerate(texts):
        want = whole(library, t)
        assert [by_doc[i][k] for k in range(len(by_doc[i]))] == [want[j : j + 256] for j in range(0, len(want), 256)]
    assert len(room) <= -(-sum(r["length"] for r in rows) // 64) + 1


def test_sequences_hold_their_pieces_ids(spark):
    rng = random.Random(4)
    packed = packing.pack(documents(spark, [prose(rng, rng.randrange(1, 60)) for _ in range(50)]), packing.default_tokenizer(), 64).cache()
    want = {}
    for r in sorted(packed.collect(), key=lambda r: (r.sequence_id, r.offset)):
        want[r.sequence_id] = want.get(r.sequence_id, b"") + bytes(r.ids)
    got = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert {k: bytes(r.ids) for k, r in got.items()} == want
    assert all(sum(r.lengths) * 4 == len(r.ids) and len(r.doc_ids) == len(r.lengths) for r in got.values())


def test_packing_of_awkward_and_empty_tables(spark, library):
    d = awkward(spark)
    rows, _ = packed_rows(spark, d, 2048)
    want = Counter((r.doc_id, k // 4, zlib.crc32(ids[k : k + 8192])) for r in d.collect() for ids in [whole(library, r.text)] for k in range(0, len(ids), 8192))
    assert Counter((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in rows) == want
    assert packing.pack(empty(spark), packing.default_tokenizer()).count() == 0


# --- 12 ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, component string, whitened string, at int")


def brute(x, k=8):
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, sums, c, e, u, np.square(c).sum() / n


@pytest.mark.parametrize(("dim", "n", "kept"), [(5, 40, 8), (40, 300, 8), (90, 400, 2)])
def test_whitening_equals_brute_force(spark, dim, n, kept):
    rng = np.random.default_rng(dim)
    data = (rng.standard_normal((n, dim)) @ np.diag(rng.uniform(0.2, 1, dim)) + rng.standard_normal(dim)).astype(np.float32)
    rows, d = whitening.sound(vectors(spark, [(i, v.tolist(), 0, 1, "c", "w", 2) for i, v in enumerate(data)]).repartition(3))
    w = whitening.fit(rows, d, kept=kept)
    x = np.floor(1024 * data.astype(np.float64)).astype(np.int64) + 100_000
    n_, sums, c, e, u, trace = brute(x)
    k = min(8, dim)
    assert (w.n, w.sums.tolist()) == (n_, sums.tolist())
    assert w.values == pytest.approx(e[:k], rel=1e-10)
    assert w.trace == pytest.approx(trace, rel=1e-12)
    got = {r.vec_id: r for r in whitening.whiten(rows, d, w).collect()}
    y = np.array([got[i].whitened for i in range(n)])
    want = c @ u / np.sqrt(e)
    assert np.abs(y * np.sign((y * want).sum(axis=0)) - want).max() < 1e-7
    assert [got[i].deviation for i in range(n)] == [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    assert whitening.identity_error(rows, d, w) < 1e-10


def test_equal_eigenvalues_are_all_found(spark):
    data = np.concatenate([np.eye(12) * 3, -np.eye(12) * 3])
    rows, d = whitening.sound(vectors(spark, [(i, v.tolist(), 0, 1, "c", "w", 2) for i, v in enumerate(data)]))
    w = whitening.fit(rows, d)
    assert w.values == pytest.approx([w.values[0]] * 8)
    assert np.abs(w.components.T @ w.components - np.eye(8)).max() < 1e-12


def test_whitening_of_awkward_and_empty_tables(spark):
    rng = np.random.default_rng(1)
    fine = [(i, rng.standard_normal(6).astype(np.float32).tolist(), None, 1, "c", "w", 2) for i in range(30)]
    odd = [None, [], [1.0] * 5 + [None], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1.0, 2.0], [3e38] + [1.0] * 5]
    table = vectors(spark, [*fine, fine[3], (None, fine[4][1], 1, 1, "c", "w", 2), *[(100 + i, v, 1, 1, "c", "w", 2) for i, v in enumerate(odd)]])
    rows, d = whitening.sound(table)
    w = whitening.fit(rows, d)
    assert (d, w.n) == (6, 32)
    assert Counter(r.vec_id for r in whitening.whiten(rows, d, w).collect()) == Counter([*range(30), 3, None])
    rows, d = whitening.sound(table.limit(0))
    assert d == 0
    assert whitening.fit(rows, d) is None
    same, d = whitening.sound(vectors(spark, [(i, [0.5, 1.5], 0, 1, "c", "w", 2) for i in range(5)]))
    w = whitening.fit(same, d)
    assert whitening.identity_error(same, d, w) is None
    assert all(r.deviation == 0 and all(np.isnan(v) for v in r.whitened) for r in whitening.whiten(same, d, w).collect())


def test_deviations_too_large_for_a_long_are_null():
    w = whitening.Whitening(4_000_000_000, np.array([0, 0]), np.eye(2), np.ones(2), 2.0, 1, np.zeros(2))
    assert w.deviations(np.array([[1, 0], [5, 5]])) == [None, None]
    w = whitening.Whitening(3_000_000_000, np.array([0, 0]), np.eye(2), np.ones(2), 2.0, 1, np.zeros(2))
    assert w.deviations(np.array([[1, 0], [1, 1]])) == [9 * 10**18, None]


# --- 13 ---


def plainly(doc_id, text):
    """The contract, said with a regular expression."""
    k = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    r, n = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)], len(k)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or r[2] % 100 >= 90:
        return text, n, "plain", None, None
    a, b = sorted((r[0] % (n + 1), r[1] % (n + 1)))
    x, y, z = "".join(k[:a]), "".join(k[a:b]), "".join(k[b:])
    if r[3] % 100 < 20:
        return f"<S>{z}<P>{x}<M>{y}", n, "spm", len(x), len(y)
    return f"<P>{x}<S>{z}<M>{y}", n, "psm", len(x), len(y)


def test_fill_in_middle_equals_the_plain_form_and_comes_back(spark):
    rng = random.Random(8)
    parts = ["ab", "Z", " ", "\n", "é", "日本", "\U0001f600", "<", "P>", "<P", "S>", "<S>", "<M", ">", "1", "ſ", "K", "̀", "\x00"]
    texts = ["".join(rng.choice(parts[: rng.choice([7, 19])]) for _ in range(rng.randrange(30))) for _ in range(600)]
    d = documents(spark, texts)
    made = fim.fill_in_middle(d).withColumn("back", fim.restored(F.col("text"), F.col("fim.form")))
    got = {r.doc_id: r for r in made.collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.text, r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars) == plainly(i, t)
        assert r.back == t
    assert {r.fim.form for r in got.values()} == {"plain", "psm", "spm"}


def test_rates_and_salts(spark):
    d = documents(spark, ["some words to cut, here"] * 400)
    forms = lambda **k: Counter(r.fim.form for r in fim.fill_in_middle(d, **k).collect())
    assert forms(moved_percent=0) == {"plain": 400}
    assert forms(moved_percent=100, spm_percent=100) == {"spm": 400}
    assert fim.draws(7) != fim.draws(7, "2")


def test_fill_in_middle_of_awkward_and_empty_tables(spark):
    d = awkward(spark).withColumn("fim", F.lit(1)).withColumn("a b", F.lit("x"))
    got = fim.fill_in_middle(d)
    assert got.columns == [c for c in d.columns if c != "fim"] + ["fim"]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(((r.doc_id, plainly(r.doc_id, r.text or "")[0]) for r in d.collect()), key=key)
    assert fim.fill_in_middle(empty(spark)).count() == 0

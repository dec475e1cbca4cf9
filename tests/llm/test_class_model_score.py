"""The class model's scores against the formulas said in plain Python, and its classes against all single moves."""

import collections
import functools
import math
import random
import zlib

import numpy as np
import pytest

from veilframe.llm import classlm

from .helpers import documents

END = b"\n"


def corpus():
    rng = random.Random(12)
    subjects, verbs, things = ([f"{x}{i}" for i in range(n)] for x, n in (("su", 7), ("ve", 5), ("thi", 9)))
    texts = [" ".join(w for _ in range(rng.randrange(1, 6)) for w in (rng.choice(subjects), rng.choice(verbs), rng.choice(things))) for _ in range(90)]
    return [*texts, None, "", "  ", "Su1 VE2 unseen9", "never met thi3 thi3"]


def tokens(text):
    return [*(text or "").lower().encode().split(), END]


@pytest.mark.parametrize("top", [classlm.TOP, 8])
def test_scores_equal_plain_python(spark, monkeypatch, top):
    fit = classlm.fit
    seen = []

    def kept(*args, **more):
        seen.append(fit(*args, top=top, **more))
        return seen[-1]

    monkeypatch.setattr(classlm, "fit", kept)
    monkeypatch.setattr(classlm, "release", lambda *tables: None)
    texts = corpus()
    got = {r.doc_id: r for r in classlm.score(documents(spark, texts)).collect()}
    (model, known), = seen
    placed = {r.h: r.cls for r in known.where("cls is not null").select("h", "cls").collect()}
    assert bool(placed) == (top == 8)

    @functools.cache
    def cls(word):
        if word == END:
            return 0
        t = classlm.Tokens([word])
        return placed.get(int(t.hashes.view(np.int64)[0]), int(model.classes[model.items.of(t)[0]]))

    train = [tokens(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for t in train for w in t)
    bigrams = collections.Counter((cls(a), cls(b)) for t in train for a, b in zip([END, *t], t))
    n, classes = sum(count.values()), classlm.CLASSES
    into, out = collections.Counter(), collections.Counter()
    for (a, b), k in bigrams.items():
        out[a] += k
        into[b] += k
    followers = collections.Counter(a for a, _ in bigrams)
    words = collections.Counter()
    rare = {1: collections.Counter(), 2: collections.Counter()}
    for w, k in count.items():
        words[cls(w)] += k
        if k in rare:
            rare[k][cls(w)] += 1

    def step(a, b):
        spread = max(followers[a], 1)
        return (bigrams[a, b] + spread * (into[b] + 1) / (n + classes)) / (out[a] + spread)

    def emission(w):
        k = cls(w)
        free = 0.0 if k == 0 else min(max(rare[1][k] / max(rare[1][k] + 2 * rare[2][k], 1), 0.05), 0.95)
        if count[w]:
            return (count[w] - free) / words[k]
        return free / words[k] if words[k] else 1.0

    for i, text in enumerate(texts):
        t = tokens(text)
        want = sum(math.log10(step(cls(a), cls(b)) * emission(b)) for a, b in zip([END, *t], t))
        assert got[i].score == pytest.approx(want, rel=1e-9), (i, text)


def test_no_single_move_raises_the_likelihood():
    words = sorted({w for t in corpus() for w in tokens(t)} - {END})
    number = {END: 0} | {w: i + 1 for i, w in enumerate(words)}
    counts = np.zeros((len(number),) * 2)
    for t in corpus():
        for a, b in zip([END, *tokens(t)], tokens(t)):
            counts[number[a], number[b]] += 1
    classes = 6

    def likelihood(cls):
        one = np.eye(classes)[cls]
        table = one.T @ counts @ one
        return classlm.plogp(table).sum() - classlm.plogp(table.sum(0)).sum() - classlm.plogp(table.sum(1)).sum()

    cls = classlm.exchange(counts, classes=classes, sweeps=100)
    best = likelihood(cls)
    for i in range(1, len(cls)):
        for k in range(1, classes):
            moved = cls.copy()
            moved[i] = k
            assert likelihood(moved) <= best + 1e-5
    start = np.array([0, *(1 + np.arange(len(cls) - 1) % (classes - 1))])
    assert best > likelihood(start)

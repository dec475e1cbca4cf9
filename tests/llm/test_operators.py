"""Each operator against brute force on small fixtures, and on awkward and empty tables."""

import collections
import math
import random
import time
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import classlm, components, decontam, embeddings, jaccard, langid, mixing, pii, substrings, tokens, toxicity
from veilframe.llm.common import hashed_words, windows

from .helpers import awkward, documents, empty, prose


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- 1 ---


def test_targets_are_water_filled(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 1000), (3, "c", 1000), (4, None, 7)], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in rows(mixing.targets(sizes))}
    total, weights, caps = 2017, {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 30, "b": 3000, "c": 3000, None: 21}
    want = {s: 0.0 for s in weights}
    open_, left = set(weights), float(total)
    while left > 1e-9:
        share = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            want[s] += share * weights[s]
            if want[s] > caps[s]:
                left += want[s] - caps[s]
                want[s] = caps[s]
        open_ = {s for s in open_ if want[s] < caps[s]}
    assert got == pytest.approx(want)


def test_hypergeometric_draws_have_its_mean_and_variance(spark):
    u = mixing.uniform(F.col("id"))
    x = spark.range(8000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(40).cast("long"), u).alias("x")).toPandas().x
    assert abs(x.mean() - 12) < 0.15
    assert abs(x.var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.4


def test_blocks_are_dealt_once_and_quotas_hold(spark):
    goal = spark.createDataFrame([("a", 0, 900, 1000.0), ("b", 1, 5000, 3333.0), (None, 2, 10, 0.0)], "source string, s int, source_size long, target double")
    got = mixing.deal(goal, 3, block=10, shard=32).toPandas()
    assert got.groupby("s").size().to_dict() == {0: 100, 1: 334}
    assert not got.duplicated(["s", "block"]).any()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1


def test_mix_takes_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    d = documents(spark, [prose(rng, rng.randrange(1, 300)) for _ in range(90)]).union(documents(spark, [None, ""], start=500))
    got = mixing.taken(mixing.mix(mixing.sized(d))).toPandas()
    again = mixing.taken(mixing.mix(mixing.sized(d))).toPandas()
    assert got.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()
    assert (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    mixed = mixing.mixed_documents(d).toPandas()
    assert mixed.text.str.split().str.len().sum() == got.taken.sum()


def test_mix_of_awkward_and_empty_tables(spark):
    d = awkward(spark)
    assert mixing.taken(mixing.mix(mixing.sized(d))).count() == d.count()
    assert mixing.mixed_documents(d).columns == d.columns
    assert mixing.mixed_documents(d).count() > 0
    assert mixing.mixed_documents(empty(spark)).count() == 0


# --- 2 ---


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    syllables = {"aa": ["th", "ing", "er", "on"], "bb": ["ü", "sch", "ung", "ein"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4)))
    texts = [(i, " ".join(word(lang) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = langid.fit(d.where("doc_id < 80"))
    got = langid.predict(d.where("doc_id >= 80"), model, "doc_id").join(d, "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_sample_counts_copies_once(spark):
    texts = ["alpha beta gamma", "delta epsilon", "zeta eta theta", "iota kappa lambda"]
    d = spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string")
    copied = d.orderBy(F.xxhash64("text")).limit(1).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("k")
    got = langid.fit(d.union(copied), rows=4).dictionaries
    assert got == langid.fit(d, rows=4).dictionaries
    assert all(t.encode() in got["aa"] for t in texts)


def test_language_by_the_smallest_encoding_of_whole_texts(spark):
    import zstandard

    model = langid.LanguageModel({"aa": b"the cat sat on the mat and then the dog", "bb": "der hund und die katze saßen auf der matte".encode(), "cc": "हिन्दी में लिखा हुआ पाठ".encode()}, chunk=64)
    texts = ["the cat and the dog", "die katze und der hund", "123 -- !!", None, "हिन्दी में पाठ", "the dog " * 400 + "und der hund " * 200, "A" * 5000]

    def size(raw, text):
        z = zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(z.compress(text[i : i + 64])) for i in range(0, len(text), 64))

    got = rows(langid.predict(documents(spark, texts), model, "doc_id").orderBy("doc_id"))
    for t, r in zip(texts, got, strict=True):
        if not any(map(str.isalpha, t or "")):
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        sizes = {lang: size(raw, " ".join(t.lower().split()).encode()) for lang, raw in model.dictionaries.items()}
        assert sizes[r["lang_pred"]] == min(sizes.values())
    assert langid.folded("हिन्दी, 12 में").decode() == "हिन्दी में"


def test_language_learns_from_whole_texts_and_small_samples(spark):
    long = prose(random.Random(3), 3000)
    d = spark.createDataFrame([("aa", "xy"), ("aa", None), ("bb", long), ("cc", "12 34"), (None, "abc")], "lang string, text string")
    got = langid.fit(d, dictionary_bytes=100).dictionaries
    assert set(got) == {"aa", "bb"} and got["bb"] == langid.folded(long) and b"xy" in got["aa"]


def test_language_of_awkward_and_empty_tables(spark):
    d = awkward(spark)
    model = langid.fit(langid.learnable(d))
    got = langid.predict(d.select(F.struct("*").alias("r"), "text"), model, "r").toPandas()
    assert len(got) == d.count()
    assert {r.lang_pred for r in got.itertuples() if not (r.r["text"] or "").strip()} == {"und"}
    assert langid.keep_identified(d, model).columns == d.columns
    nothing = langid.fit(empty(spark))
    assert langid.keep_identified(empty(spark), nothing).count() == 0
    assert langid.keep_identified(d, nothing).count() == 0


# --- 3 ---


def removed(texts, w):
    words = [(t or "").split() for t in texts]
    seen = collections.Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for x in words:
        gone = set()
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone.update(range(i, i + w))
        out.append((len(x), len(gone), " ".join(v for i, v in enumerate(x) if i not in gone)))
    return out


def test_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_windows_are_equal_just_where_words_are():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 3, 300).astype(np.uint64)
    for n in (1, 2, 5, 15, 35):
        got, want = windows(h, n), [h[i : i + n].tobytes() for i in range(len(h) - n + 1)]
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
    assert len(windows(h[:4], 5)) == 0


def test_words_are_hashed_alike_wherever_they_stand():
    words = [b"a", b"ab", b"ba", b"x" * 63, b"x" * 64, b"x" * 65, b"x" * 900, "\u00e9\u00df".encode(), b"\x1c", b"\x00"]
    raw = b" \t".join(words * 3) + b"\n\n" + b"\x0b".join(words)
    starts, ends, h = hashed_words(raw)
    assert [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)] == words * 4
    assert [raw[i:].split()[0] for i in starts.tolist()] == words * 4
    assert len(set(h.tolist())) == len(words) and (h.reshape(4, -1) == h[: len(words)]).all()
    assert len(hashed_words(b"")[2]) == 0 == len(hashed_words(b" \n")[2])


def test_repeated_passages(spark):
    rng = random.Random(3)
    p = [prose(rng, n) for n in (34, 35, 36, 50, 90)]
    texts = [f"{prose(rng, rng.randrange(0, 40))} {rng.choice(p)} {prose(rng, rng.randrange(0, 40))}" for _ in range(40)]
    texts += [p[0], p[0], "a " * 34, "a " * 35, "b " * 36, None, "", f"{p[3]} {p[3]}", "x y " * 30]
    got = {r["doc_id"]: (r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"].decode()) for r in rows(substrings.kept_words(documents(spark, texts)))}
    assert got == dict(enumerate(removed(texts, 35)))


def test_repeated_passages_of_awkward_and_empty_tables(spark):
    d = awkward(spark)
    want = collections.Counter((len((r["text"] or "").split())) for r in rows(d))
    got = rows(substrings.kept_words(d))
    assert collections.Counter(r["n_words"] for r in got) == want
    assert all(r["kept"] == b"" for r in got if r["doc_id"] in (5, 6))
    assert substrings.kept_words(empty(spark)).count() == 0


# --- 4 ---


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 64))
    x = np.concatenate([base, base[:30] + 0.25 * rng.standard_normal((30, 64)), base[:10] * 3, base[:5] + 0.33 * rng.standard_normal((5, 64))])
    x = x.astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = {i: i for i in range(len(x))}
    for _ in x:
        for i, j in zip(*np.nonzero(near), strict=True):
            root[i] = root[j] = min(root[i], root[j])
    got = embeddings.near_duplicates(d).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == near.sum(1).tolist()
    assert got.component_id.tolist() == [root[i] for i in range(len(x))]
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_crowded_buckets_and_huge_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BUCKET", 16)
    rng = np.random.default_rng(6)
    mean = 3 * rng.standard_normal(32)
    x = mean + rng.standard_normal((300, 32)) * 0.8
    x[:5] *= 1e200
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = embeddings.near_duplicates(d).toPandas().sort_values("vec_id")
    assert near.sum() > 300 and (got.n_links.to_numpy() <= near.sum(1)).all()
    assert got.n_links.sum() >= 0.99 * near.sum()


def test_embeddings_large_family_and_awkward_rows(spark):
    rng = np.random.default_rng(5)
    one = rng.standard_normal(64)
    many = [(i, (one + 0.01 * rng.standard_normal(64)).tolist()) for i in range(1500)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None] * 64), (None, one.tolist()), (9006, one.tolist()[:32]), (9007, [float("inf")] * 64), (3, many[3][1])]
    got = embeddings.near_duplicates(spark.createDataFrame(many + odd, "vec_id long, embedding array<float>")).toPandas()
    assert len(got) == 1509
    assert (got[got.vec_id < 1500].n_links == 1499).all()
    assert (got[got.vec_id.isna() | (got.vec_id > 9000)].n_links == 0).all()
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 5 ---

PII = [
    "card 4111 1111 1111 1111 bad 4111 1111 1111 1112 iban GB29NWBK60161331926819.",
    "again 4111 1111 1111 1111; +1 (269) 555-3296 4524132264652876 and 2024-02-29, 31/12/1850, 2026-99-99",
    'mail a.b42@mail7.example.com 10.0.0.8 token = "fc22f42429fef2ebde85e081b172bc127a2eef28"',
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def test_pseudonyms_keep_their_format_and_link(spark):
    got = [r["text"] for r in rows(pii.pseudonymized(documents(spark, PII), "key").orderBy("doc_id"))]
    first, second = got[0][5:24], got[1][6:25]
    assert first == second != "4111 1111 1111 1111" and luhn(first)
    assert "4111 1111 1111 1112" in got[0] and "2026-99-99" in got[1]
    iban = got[0].split("iban ")[1].rstrip(".")
    assert iban[:2] == "GB" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert [[c.isdigit() for c in a] for a in got[:1]] == [[c.isdigit() for c in a] for a in PII[:1]]
    for secret in ("4524132264652876", "555-3296", "a.b42", "10.0.0.8", "fc22f42429"):
        assert not any(secret in t for t in got)


def test_pseudonyms_permute_dates_and_octets(spark):
    days = spark.range(0, 3000).selectExpr("cast(date_add(to_date('1999-01-01'), cast(id as int)) as string) AS s")
    got = days.select(pii.date(F.col("s"), "k").alias("v")).toPandas().v
    assert got.nunique() == 3000 and got.str.match(r"^(19|20)\d\d-\d\d-\d\d$").all()
    ips = spark.range(0, 2000).selectExpr("concat('10.1.', id div 250, '.', id % 250) AS s").select(pii.ip(F.col("s"), "k").alias("v")).toPandas().v
    assert ips.nunique() == 2000


def test_pseudonyms_of_forms_that_the_detectors_accept(spark):
    values = ["8.8.8.8", "12-03-2024", "3/4/24", "29-02-24", "415 555 0100", "+1 2 3 4 5 6 7 8", "9876543210", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "abcdEFGH.ijkl~mnop/qr", "abcd-efgh-ijkl-mnop"]
    before = {8: "Bearer ", 9: 'api_key = "'}
    texts = [f"so {before.get(i, '')}{v} there" for i, v in enumerate(values)] + ["at 2024-03-01T10:00 there", "so 8.8.8.8 and 77 there"]
    got = rows(pii.pseudonymized(documents(spark, texts), "k").orderBy("doc_id"))
    assert [r["n_pii"] for r in got] == [1] * len(texts)
    assert not any(v in r["text"] for v, r in zip([*values, "2024-03-01", "8.8.8.8"], got, strict=True))
    assert got[-1]["text"].split()[1] == got[0]["text"].split()[1] and got[-2]["text"].endswith("T10:00 there")
    days = spark.range(0, 3000).selectExpr("date_format(date_add(to_date('2001-01-01'), cast(id as int)), 'MM-dd-yy') AS s").select(pii.date(F.col("s"), "k").alias("v")).toPandas().v
    assert days.nunique() == 3000 and days.str.match(r"^\d\d-\d\d-\d\d$").all()


HOSTILE = ["a.", "a", "1", "1.", "1-", "1 ", "@", "a@", "+", "+1 ", "(", "_", "eyJ", "Bearer ", "Bearer a", "api_key", "api_key=", "sk-live-", "AB12", "/", "1/", "-", ".", "gh", "ghp_a", "é", "\n", "\"token = \"", "1,", ":", "a:"]


def test_pseudonyms_of_hostile_texts_take_no_time(spark):
    texts = [(u * (100_000 // len(u.encode())) + " " + e) for u in HOSTILE for e in ("", "x@y.zz 12")] + ["x@" + "a." * 50_000 + "com 12"]
    # every one of these holds many values
    texts += [u * (10_000 // len(u)) + "12" for u in ("x@a.", "eyJaaaaaaaa.", "8.8.8.8 ")]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    pii.pseudonymized(d.limit(3), "k").collect()
    start = time.time()
    assert pii.pseudonymized(d, "k").agg(F.sum(F.length("text"))).first()[0] > 0
    assert time.time() - start < 40


def test_pseudonyms_of_awkward_and_empty_tables(spark):
    d = awkward(spark)
    got = pii.pseudonymized(d, "k")
    assert got.columns == [*d.columns, "n_pii"] and got.count() == d.count()
    assert pii.pseudonymized(empty(spark), "k").count() == 0


# --- 6 ---


def jaccard_brute(texts):
    words = [(t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    n = len(sets)
    links, root = [0] * n, list(range(n))
    near = [(i, j) for i in range(n) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in near:
        links[i] += 1
        links[j] += 1
    for _ in range(n):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    return links, root


def test_jaccard_join_matches_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randrange(5, 150)).split()
        for _ in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(["x1", "x2"])
            texts.append(" ".join(t))
    texts += [None, "", "one two", "one two", "a b c d e", "b a c d e"]
    links, root = jaccard_brute(texts)
    got = jaccard.jaccard_join(documents(spark, texts)).toPandas().sort_values("doc_id")
    assert got.n_links.tolist() == links
    assert got.component_id.tolist() == root


def test_jaccard_join_of_a_large_family_with_a_shared_passage(spark):
    rng = random.Random(7)
    passage, base = prose(rng, 80), prose(rng, 200).split()
    family = [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(180)]
    texts = family + family[:20] + [f"{passage} {prose(rng, 100)}" for _ in range(150)]
    links, root = jaccard_brute(texts)
    got = jaccard.jaccard_join(documents(spark, texts)).toPandas().sort_values("doc_id")
    assert got.n_links.tolist() == links and got.component_id.tolist() == root
    kept = {r["doc_id"] for r in rows(jaccard.keep_first(documents(spark, texts)))}
    assert kept == {i for i, r in enumerate(root) if i == r}


def test_families_larger_than_a_chunk_are_proven_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PROOF", 16)
    rng = random.Random(8)
    base = prose(rng, 120).split()
    texts = [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(70)]
    links, root = jaccard_brute(texts)
    got = jaccard.jaccard_join(documents(spark, texts)).toPandas().sort_values("doc_id")
    assert got.n_links.tolist() == links and got.component_id.tolist() == root


def test_jaccard_join_of_awkward_and_empty_tables(spark):
    d = awkward(spark)
    assert jaccard.jaccard_join(d).count() == d.count()
    kept = jaccard.keep_first(d)
    assert kept.columns == d.columns and kept.where("doc_id in (5, 6)").count() == 2
    assert jaccard.keep_first(empty(spark)).count() == 0


@pytest.mark.parametrize("one_task", [1000, 0, 40])
def test_components(spark, one_task):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 400 + i // 3) for i in range(200)] + [(900 - i, 899 - i) for i in range(60)] + [(5, 5)]
    got = {r["a"]: r["b"] for r in rows(components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7), one_task))}
    up = dict(enumerate(range(1000)))
    for _ in range(300):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {i: r for i, r in up.items() if i != r}


def test_jaccard_join_of_buckets_that_stay_large(spark, monkeypatch):
    for name, value in (("SMALL", 4), ("LARGE", 8), ("CHUNK", 16), ("PROOF", 64)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(12)
    base, passage = prose(rng, 150).split(), prose(rng, 60)
    texts = [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(120)] + [f"{passage} {prose(rng, 20)}" for _ in range(60)] + [" ".join(base[:130]) + " " + prose(rng, 12)]
    links, root = jaccard_brute(texts)
    got = jaccard.jaccard_join(documents(spark, texts)).toPandas().sort_values("doc_id")
    assert got.n_links.tolist() == links and got.component_id.tolist() == root


def test_near_duplicates_among_rows_that_share_ids(spark):
    rng = random.Random(13)
    a, b, c = (prose(rng, 60) for _ in range(3))
    d = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a + " x"), (None, c), (None, c + " y"), (None, prose(rng, 50)), (None, None), (None, None), (3, ""), (3, "")], "doc_id long, text string")
    kept = sorted((repr(r["doc_id"]), r["text"] or "") for r in rows(jaccard.keep_first(d)))
    assert len(kept) == 2 + 2 + 4 and ("1", a) in kept and ("1", b) in kept and ("2", a + " x") not in kept
    assert sum(t in (c, c + " y") for _, t in kept) == 1


# --- 7 ---


def test_class_model_counts_and_beats_the_base(spark):
    rng = random.Random(10)
    lines = {0: [f"ka{i}" for i in range(50)], 1: [f"lo{i}" for i in range(50)]}
    texts = [" ".join(rng.choice(lines[(i + k) % 2]) for k in range(60)) for i in range(140)] + [None, "", "never seen", "CASE ka1"]
    got = classlm.score(documents(spark, texts)).toPandas().set_index("doc_id")
    words = [(t or "").lower().encode().split() + [b"\n"] for t in texts]
    train = collections.Counter(w for i, x in enumerate(words) if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(train.values()), len(train)
    for i, x in enumerate(words):
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(train[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + 1 * (v + 1))) for w in x))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = got[got.held_out & (got.index < 140)]
    assert (held.score > held.base_score).mean() > 0.9


def test_class_model_is_a_distribution():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 9, (6, 6))
    table[:, 4] = 0
    assert np.allclose((10 ** classlm.transitions(table)).sum(axis=1), 1)
    counts, cls = np.array([5, 1, 1, 2, 7, 3]), np.array([1, 1, 1, 2, 2, 3])
    total = np.bincount(cls, weights=counts, minlength=5)
    discount = classlm.discounts(*(np.bincount(cls, weights=counts == k, minlength=5) for k in (1, 2)))
    for k in range(1, 5):
        seen = classlm.emissions(counts[cls == k], cls[cls == k], total, discount)
        unseen = classlm.emissions(np.zeros(1), np.array([k]), total, discount)[0]
        assert np.isclose(seen.sum() + max(1, len(seen)) * unseen, 1)


def test_endings_are_whole_characters():
    t = classlm.Tokens(["x\u00e9\u00df\u00fc \u00e9\u00df\u00fc ab\u00e9\u00df\u00fc fc b\u00fc".encode()])
    e = t.endings().tolist()
    assert e[0] == e[1] == e[2] and len(set(e)) == 3


def test_exchange_finds_alternating_classes():
    c = np.zeros((9, 9))
    c[1:5, 5:9] = 10
    c[5:9, 1:5] = 10
    got = classlm.exchange(c, classes=3)
    assert len(set(got[1:5])) == 1 and len(set(got[5:9])) == 1 and got[1] != got[5]


def test_every_word_is_placed_by_its_own_bigrams(spark):
    rng = random.Random(11)
    # rare words of one ending, in either of two places where frequent words stand as well
    texts = [" ".join(x for k in range(15) for x in ("in", f"a{i % 40}{k % 5}xyz", "out", f"b{i % 40}{k % 5}xyz", "in", f"p{rng.randrange(4)}", "out", f"q{rng.randrange(4)}")) for i in range(160)]
    d = documents(spark, texts).select(F.col("text").cast("binary").alias("text"), F.lit(True).alias("train"), F.pmod("doc_id", F.lit(3)).cast("int").alias("block"))
    model, known = classlm.fit(d, classlm.lexicon(d)[1], top=10)
    assert len(model.items.top) == 10 and model.total.sum() == model.tokens
    got = {r["h"]: r["cls"] for r in rows(known)}
    signed = lambda w: hashed_words(w)[2].view(np.int64)[0]
    a, b = ({got[signed(f"{x}{i}{k}xyz".encode())] for i in range(40) for k in range(5)} for x in "ab")
    assert None not in a | b and not a & b
    t = classlm.Tokens([b"a00xyz b00xyz"])
    assert t.endings()[0] == t.endings()[1]


def test_class_model_of_awkward_and_empty_tables(spark):
    d = awkward(spark)
    got = classlm.score(d).toPandas()
    assert len(got) == d.count() and got.score.notna().all() and np.isfinite(got.score).all()
    assert classlm.score(empty(spark)).count() == 0


# --- 8 ---


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(11)
    for _ in range(60):
        t = rng.integers(1, 4, int(rng.integers(0, 60)))
        index = decontam.FMIndex(t, 5)
        for m in (1, 2, 4):
            p = rng.integers(1, 5, (1, m))
            low, high = index.search(p, np.array([m]))
            got = index.locate(np.arange(low[0], max(low[0], high[0])))
            assert sorted(got.tolist()) == [i for i in range(len(t) - m + 1) if (t[i : i + m] == p[0]).all()]


def hits(text, items, window=13):
    words = decontam.words_of((text or "").encode())
    gone, found = set(), set()
    for item, t in items:
        x = decontam.words_of((t or "").encode())
        n = min(window, len(x))
        for i in range(len(x) - n + 1) if x else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == x[i : i + n]:
                    gone.update(range(j, j + n))
                    found.add(item)
    return len(words), len(gone), sorted(str(i) for i in found if i is not None)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(12)
    items = [(1, prose(rng, 40)), (2, prose(rng, 13)), (3, "short Item-here"), (4, None), (5, ""), (10, prose(rng, 20)), (None, "an item without an id")]
    items.append((12, items[0][1]))
    texts = [None, "", "see SHORT item, here: yes", items[1][1].upper(), "an item without an id"]
    for _ in range(30):
        cut = rng.choice(items[:2])[1].split()
        i = rng.randrange(len(cut))
        texts.append(f"{prose(rng, rng.randrange(60))}, {' '.join(cut[i : i + rng.randrange(30)])}! {prose(rng, rng.randrange(60))}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 100):
        got = {r["doc_id"]: (r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["items"]) for r in rows(decontam.hit_spans(documents(spark, texts), bench, "doc_id", block_bytes=block))}
        assert got == {i: hits(t, items) for i, t in enumerate(texts)}
    kept = {r["doc_id"] for r in rows(decontam.decontaminate(documents(spark, texts), bench))}
    assert kept == {i for i, t in enumerate(texts) if not (hits(t, items)[1] and 20 * hits(t, items)[1] >= hits(t, items)[0])}


def test_contamination_in_blocks_keeps_every_row(spark):
    items = [(i, " ".join(f"w{i * 20 + k}" for k in range(15))) for i in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = "nothing of it here"
    d = spark.createDataFrame([(1, items[0][1]), (1, clean), (1, clean), (None, items[1][1]), (None, "x " + items[2][1]), (None, clean)], "doc_id long, text string")
    inner = d.select(F.struct("*").alias("row"), "text")
    for key, docs in (("doc_id", d), ("row", inner)):
        one, many = (sorted(map(repr, rows(decontam.hit_spans(docs, bench, key, block_bytes=b)))) for b in (decontam.BLOCK_BYTES, 100))
        assert len(one) == d.count() and one == many


def test_contamination_by_a_benchmark_of_one_text(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(i % 40, text) for i in range(400)], "item_id long, text string")
    d = documents(spark, ["a b " + text, "nothing"])
    one = sorted(map(repr, rows(decontam.hit_spans(d, bench, "doc_id"))))
    sizes, phrases = [], decontam._phrases

    def counted(items, window):
        sizes.append(items.count())
        return phrases(items, window)

    monkeypatch.setattr(decontam, "_phrases", counted)
    many = sorted(map(repr, rows(decontam.hit_spans(d, bench, "doc_id", block_bytes=len(text) * 100))))
    assert one == many and sum(sizes) == 40 and max(sizes) < 30


def test_contamination_of_awkward_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    d = awkward(spark)
    assert decontam.decontaminate(d, bench).columns == d.columns
    assert decontam.decontaminate(d, bench.limit(0)).count() == d.count()
    assert decontam.decontaminate(empty(spark), bench).count() == 0


# --- 9 ---


def test_folding():
    assert toxicity.folded("You 1D10T, іdіot tr@sh!") == " you idiot idiot trash "
    assert "cafe" in toxicity.folded("Café")


def test_toxic_words_and_stems_are_learned(spark):
    rng = random.Random(13)
    bad = ["idiot", "moron"]
    texts, labels = [], []
    for i in range(700):
        words = prose(rng, 60).split()
        toxic = i % 5 == 0
        if toxic:
            words[3] = rng.choice(bad) if i % 2 else f"zork{rng.choice('abcdefgh')}{rng.randrange(9)}"
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    d = documents(spark, texts)
    known = spark.createDataFrame(labels, "doc_id long, label int")
    lexicon = toxicity.learn(d, known.where("doc_id < 500"))
    got = toxicity.score(d.where("doc_id >= 500"), lexicon, "doc_id").join(known, "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.label == 1)).mean() > 0.95
    assert lexicon.score("he is an 1d10t " + texts[1]) > 0.5 > lexicon.score("")


def test_exceptions_are_spared():
    lexicon = toxicity.Lexicon({" trash ": 5.0}, (-3.0, 2.0, 0.0, 0.0))
    assert lexicon.features("the trash can")[0] == 0 < lexicon.features("you trash")[0]


def test_scores_by_the_lexicon_match_brute_force(spark):
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " idi": 2.0, " trash ": 2.5, " mor": 1.5}, (-2.0, 1.0, 0.5, 0.1))
    texts = [None, "", "you idiot", "IDIOCY and more trash", "the trash can is not trash", "1d10t idiot idiot moron", "idiot proof idiot " * 500, "a trash trash can trash"]

    def brute(text):
        t = toxicity.folded(text)
        spans = [(i, i + len(p) + 2) for p in toxicity.EXCEPTIONS for i in range(len(t)) if t.startswith(f" {p} ", i)]
        seen = collections.Counter()
        for i in range(len(t)):
            here = [x for x in lexicon.weights if t.startswith(x, i) and not any(a <= i and i + len(x) <= b for a, b in spans)]
            if here:
                seen[max(here, key=lexicon.weights.get)] += 1
        n = 1 + t.count(" ")
        damped = sum(lexicon.weights[x] * (1 + math.log(k)) for x, k in seen.items())
        plain = sum(lexicon.weights[x] * k for x, k in seen.items())
        z = sum(c * x for c, x in zip(lexicon.curve, (1, math.log1p(damped), damped / math.sqrt(n), math.log1p(100 * plain / n)), strict=True))
        return 1 / (1 + math.exp(-z))

    got = {r["doc_id"]: r["score"] for r in rows(toxicity.score(documents(spark, texts), lexicon, "doc_id"))}
    assert got == pytest.approx({i: brute(t) for i, t in enumerate(texts)})


def test_long_words_are_terms(spark):
    assert f" {'x' * 40} " in toxicity.terms("a " + "x" * 40, 9)[0]


def test_toxicity_of_awkward_and_empty_tables(spark):
    d = awkward(spark)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int")
    lexicon = toxicity.learn(d, none)
    got = toxicity.score(d.select(F.struct("*").alias("r"), "text"), lexicon, "r")
    assert got.count() == d.count() and {round(r["score"], 3) for r in rows(got.select("score"))} == {0.498}
    assert toxicity.score(empty(spark), lexicon, "doc_id").count() == 0


# --- 10 ---


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(14)
    texts = [None, "", " ", "a  b", "a \n b", "x\n\ny", "It's the\nend. 'S", "<|endoftext|> 你好 123 café", "x<|endoftext|>", "t\tb", "Z" * 10_000 + "'", "ab" * 5_000 + "\u2019 c", "q" * 3_000 + "你", prose(rng, 40_000), *[prose(rng, 50) for _ in range(40)]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    d = spark.createDataFrame([(i * 3 - 20, texts[i]) for i in order], "doc_id long, text string")
    path = tokens.write_tokens(d, f"file://{tmp_path}/t", tokens.default_tokenizer(), shard_bytes=50_000)
    got = rows(tokens.token_digest(spark, path).orderBy("doc_id"))
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    at = 0
    for i, r in enumerate(got):
        ids = array("I", plain.encode(texts[i] or "", add_special_tokens=False).ids + [0])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i * 3 - 20, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(texts)


def test_token_files_of_one_id_and_of_many_shards(spark, tmp_path):
    rng = random.Random(15)
    texts = [prose(rng, 60) for _ in range(200)]
    d = spark.createDataFrame([(None if i % 3 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    path = tokens.write_tokens(d, f"file://{tmp_path}/o", tokens.default_tokenizer(), shard_bytes=10_000)
    got = rows(tokens.token_digest(spark, path).orderBy("start"))
    assert [r["doc_id"] for r in got] == [None] * 133 + [7] * 67
    assert len({r["shard"] for r in rows(tokens.read_tokens(spark, path).select("shard"))}) > 5
    made = spark.createDataFrame([(f"part-{n}-x.txt", n, 0, 10, 1) for n in ("99999", "100000", "00002")], "shard string, doc_id string, local_start long, n_tokens long, ids_crc32 long")
    assert {r["doc_id"]: r["start"] for r in rows(tokens.placed(made))} == {"00002": 0, "99999": 10, "100000": 20}


def test_a_reader_decompresses_only_what_is_asked_for():
    docs = [(i, array("I", range(i, i + 3000)).tobytes()) for i in range(60)]
    content = b"".join(f + tokens.PAD for f in tokens.frames(iter(docs), frame_bytes=50_000))
    read = []
    shard = tokens.Shard(lambda at, n: (read.append(n), content[at : at + n])[1], len(content))
    before = sum(read)
    assert shard.document(40) == docs[40][1] and shard.document(99) is None
    assert sum(read) - before < len(content) / 5
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole.startswith(b"".join(ids for _, ids in docs))
    damaged = bytearray(content)
    damaged[100] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(tokens.Shard.of(bytes(damaged)).documents())


def test_token_files_of_awkward_and_empty_tables(spark, tmp_path):
    d = awkward(spark)
    path = tokens.write_tokens(d, f"file://{tmp_path}/a", tokens.default_tokenizer())
    assert tokens.token_digest(spark, path).count() == d.count()
    path = tokens.write_tokens(empty(spark), f"file://{tmp_path}/e", tokens.default_tokenizer())
    assert tokens.token_digest(spark, path).count() == 0

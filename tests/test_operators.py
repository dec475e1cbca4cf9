"""Sessions, layout, images, names, audits, readers and writers."""

import base64
import datetime as dt
import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.functions import text as checks
from veilframe.operators import audit, images, layout, names, session
from veilframe.operators.aliases import over_capacity
from veilframe.operators.rules import Rules
from veilframe.sources import readers, writers

T0 = dt.datetime(2024, 1, 1, 12)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_ipv6_forms(spark):
    import ipaddress

    forms = ["::", "::1", "1::", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::ffff:1.2.3.400", "12345::", "1:2:3:4:5:6:7:8:9", ":1:2", "1:2:3:4::5:6:7:8", "1::1.2.3.4", "::01.2.3.4"]

    def ok(s):
        try:
            return isinstance(ipaddress.ip_address(s), ipaddress.IPv6Address)
        except ValueError:
            return False

    got = {r["s"]: r["ok"] for r in rows(spark.createDataFrame([(s,) for s in forms], "s string").select("s", checks.ipv6_ok(F.col("s")).alias("ok")))}
    assert got == {s: ok(s) for s in forms}


def test_dates(spark):
    want = {"2025-12-31": True, "2025-02-31": True, "31/12/2025": False, "12/31/2025": True, "2025-13-01": False, "1-2-3": True, "1-2": False, "0/1/2025": False}
    got = {r["s"]: r["ok"] for r in rows(spark.createDataFrame([(s,) for s in want], "s string").select("s", checks.date_ok(F.col("s")).alias("ok")))}
    assert got == want


def _events(spark, steps):
    return spark.createDataFrame([("s", T0 + dt.timedelta(seconds=t), i, o, "EMAIL", k) for i, (t, o, k) in enumerate(steps)], "session string, ts timestamp_ntz, seq long, original string, kind string, type string")


def test_expiry_is_open_and_counters_run_on(spark):
    e = _events(spark, [(0, "a", "touch"), (1, "b", "touch"), (2, "c", "touch"), (1000, "b", "touch"), (1000, "c", "touch"), (1800, "a", "touch"), (2799, "b", "touch"), (2800, None, "clear"), (2801, "c", "touch")])
    got = {(r["original"], r["epoch"]): r["token"] for r in rows(session.lives(e))}
    assert got == {("a", 1): "EMAIL_1", ("b", 1): "EMAIL_2", ("c", 1): "EMAIL_3", ("a", 2): "EMAIL_4", ("c", 2): "EMAIL_5"}
    live = session.live_at(session.lives(e), e.where("type = 'clear'"), (T0 + dt.timedelta(seconds=2900)).isoformat(" "))
    assert {r["original"] for r in rows(live)} == {"c"}
    assert rows(session.status(live)) == [{"session": "s", "count": 1, "expires_in_seconds": 1701}]


def test_capacity_names_the_first_call_over_it(spark):
    a = spark.createDataFrame([("s", "x", 1), ("s", "y", 1), ("s", "z", 2), ("t", "x", 1)], "session string, original string, seq long")
    assert rows(over_capacity(a, 2)) == [{"session": "s", "seq": 2}]


WORDS = "image_id string, word_ix int, text string, x int, y int, w int, h int, conf float"


def _image_words(spark, words):
    return spark.createDataFrame([("i", k, *w, 0.9) for k, w in enumerate(words)], WORDS)


@pytest.mark.parametrize("words, text", [([("a", 0, 0, 8, 16), ("lex@b.co", 9, 0, 60, 16)], "alex@b.co"), ([("a", 0, 0, 8, 16), ("b", 18, 0, 8, 16)], "a b"), ([("a", 0, 0, 8, 16), ("b", 9, 40, 8, 16)], "a b")])
def test_joined_words(spark, words, text):
    assert rows(layout.image_text(layout.joined(_image_words(spark, words))))[0]["text"] == text


def test_boxes_of_repeated_values(spark):
    w = layout.joined(_image_words(spark, [("é", 0, 0, 10, 10), ("ab", 20, 2, 10, 10), ("x", 40, 2, 10, 10), ("ab", 60, 2, 10, 10), ("ab", 80, 2, 0, 10)]))
    m = spark.createDataFrame([("i", "TERM_1", "ab"), ("i", "TERM_2", "zz"), ("i", "TERM_3", r"a\Eb")], "image_id string, token string, original string")
    got = rows(layout.boxes(w, m))
    assert [g["token"] for g in got] == ["TERM_1"]
    assert got[0]["boxes"] == [{"x": 18, "y": 0, "w": 14, "h": 14}, {"x": 58, "y": 0, "w": 14, "h": 14}]


def test_clamped_boxes(spark):
    cases = [((8, 8, 100, 100), (8, 8, 2, 2)), ((-4, -3, 8, 6), (0, 0, 4, 3)), ((1.8, 2.8, 2.4, 2.4), (1, 2, 4, 4)), ((0, 0, 1, 9), None), ((float("nan"), 0, 5, 5), None), ((20, 20, 5, 5), None), ((1, 1, -3, 4), None), ((0, 0, float("inf"), 4), None)]
    d = spark.createDataFrame([(i, *map(float, c)) for i, (c, _) in enumerate(cases)], "i int, x double, y double, w double, h double")
    got = {r["i"]: r["b"] and tuple(r["b"].values()) for r in rows(d.select("i", layout.clamped(*[F.col(c) for c in "xywh"], F.lit(10), F.lit(10)).alias("b")))}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_responses_are_all_or_nothing(spark):
    word = {"text": "ok", "x": 0, "y": 0, "w": 5, "h": 5, "conf": 0.5}
    bodies = {"good": {"width": 10, "height": 10, "words": [word]}, "size": {"width": 11, "height": 10, "words": [word]}, "blank": {"width": 10, "height": 10, "words": [word, word | {"text": " "}]}, "out": {"width": 10, "height": 10, "words": [word | {"x": 6}]}, "more": {"width": 10, "height": 10, "words": [word], "z": 1}, "conf": {"width": 10, "height": 10, "words": [word | {"conf": 1.5}]}}
    d = spark.createDataFrame([(k, json.dumps(v), 10, 10) for k, v in bodies.items()] + [("junk", "{", 10, 10)], "image_id string, body string, width int, height int")
    assert [r["image_id"] for r in rows(layout.decoded_responses(d))] == ["good"]


def test_native_words_and_review(spark):
    o = spark.createDataFrame([("i", 0, "a@b.co  x", 0.1, 0.5, 0.9, 1.0, 0.9, 100, 50)], "image_id string, obs_ix int, text string, min_x double, min_y double, max_x double, max_y double, conf float, width int, height int")
    got = rows(layout.native_words(o))
    assert [(g["text"], g["x"], g["y"], g["w"], g["h"]) for g in got] == [("a@b.co", 10, 0, 80, 25), ("x", 10, 0, 80, 25)]
    a = spark.createDataFrame([("i", "1,1,2,2"), ("i", "3,3,2,2")], "image_id string, key string")
    b = spark.createDataFrame([("i", "3,3,2,2"), ("i", "5,5,2,2")], "image_id string, key string")
    assert {r["key"] for r in rows(layout.toggled(a, b))} == {"1,1,2,2", "5,5,2,2"}


def test_greedy_letters(spark):
    steps = [[0, 5, 0], [0, 5, 0], [9, 0, 0], [0, 5, 0], [0, 0, 7]]
    d = spark.createDataFrame([("l", i, [float(v) for v in s]) for i, s in enumerate(steps)], "line_id string, step int, logits array<float>")
    got = rows(layout.ctc_decoded(d, ["a", "b"]))
    assert got[0]["text"] == "aab" and 0.98 < got[0]["conf"] < 1


def _pixels(n=10):
    return np.full((n, n, 4), 255, np.uint8)


def test_png_and_redaction(spark):
    px = np.random.default_rng(0).integers(0, 256, (12, 9, 4), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(px)) == px).all()
    raw = b"".join(bytes([f]) + bytes([10, 20, 30, 5, 5, 5]) for f in range(5))
    chunk = lambda n, p: struct.pack(">I", len(p)) + n + p + struct.pack(">I", zlib.crc32(n + p))
    rgb = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    got = images.decode_png(rgb)
    assert got[0, 0].tolist() == [10, 20, 30, 255] and got[1, 1].tolist() == [15, 25, 35, 255] and got[2, 0].tolist() == [20, 40, 60, 255]
    png = images.encode_png(_pixels())
    cases = {"in": [(2, 2, 4, 4)], "clip": [(8, 8, 99, 99)], "out": [(20, 20, 4, 4)], "none": [], "zero": [(1, 1, 0, 5)]}
    d = spark.createDataFrame([(k, png, [{"x": a, "y": b, "w": c, "h": e} for a, b, c, e in v]) for k, v in cases.items()] + [("bad", b"GIF89a", [{"x": 0, "y": 0, "w": 1, "h": 1}])], "image_id string, content binary, boxes array<struct<x: int, y: int, w: int, h: int>>")
    out = {r["image_id"]: r for r in rows(images.redacted(d))}
    assert {k: r["status"] for k, r in out.items()} == {"in": "ok", "clip": "ok", "out": "outside", "none": "boxes", "zero": "outside", "bad": "undecodable"}
    p = images.decode_png(bytes(out["in"]["content"]))
    assert p[4, 4].tolist() == [0, 0, 0, 255] and p[0, 0, 0] == p[9, 9, 0] == 255
    assert rows(images.normalised(d.where("image_id in ('in', 'bad')")).select("status", "width"))[0]["width"] in (10, None)


def test_files_of_other_formats(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(6, 4, 1)
    for x in range(6):
        for y in range(4):
            image.setRGB(x, y, 0x00FF0000 if x < 3 else 0x000000FF)
    for kind in ("png", "bmp", "gif", "jpg"):
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(f"{tmp_path}/i.{kind}"))
    (tmp_path / "no.png").write_bytes(b"junk")
    got = rows(images.from_rasters(readers.rasters(spark, str(tmp_path))))
    assert len(got) == 4 and {r["status"] for r in got} == {"ok"}
    for r in got:
        px = images.decode_png(bytes(r["content"])).astype(int)
        assert px.shape == (4, 6, 4)
        assert np.abs(px[1, 0] - [255, 0, 0, 255]).max() < 90 and np.abs(px[1, 5] - [0, 0, 255, 255]).max() < 90


def test_regions():
    s = np.zeros((20, 20))
    s[2:7, 3:8] = 0.9
    s[15, 15] = 1
    assert images.regions(s) == [(2, 1, 7, 7)]
    assert images.detector_tensor(_pixels(50)).shape == (3, 64, 64) or images.detector_tensor(_pixels(50)).shape[1] % 32 == 0


def test_windows_cover_and_fit():
    for text in ("abc " * 2500, "界! " * 2500, "ﬃ " * 2500):
        cut = names.windows(text)
        assert cut[0][0] == 0 and cut[-1][0] + len(cut[-1][1]) == len(text)
        assert all(b[0] <= a[0] + len(a[1]) for a, b in zip(cut, cut[1:], strict=False))
        assert all(len(names.normalized(w)[0]) <= names.MOST_TOKENS for _, w in cut)
    assert names.windows("") == []


def test_word_pieces():
    vocab = {"un": 0, "##aff": 1, "##able": 2}
    assert [p for p, _, _ in names.word_pieces("unaffable", vocab)] == ["un", "##aff", "##able"]
    assert names.word_pieces("xyz", vocab) == [("[UNK]", 0, 3)] and names.word_pieces("u" * 101, vocab)[0][0] == "[UNK]"
    assert names.normalized("Élan\x00 界")[0] == "elan  界 "
    assert names.basic_tokens("a-b c") == [(0, 1), (1, 2), (2, 3), (4, 5)]


def test_names_are_decoded(spark):
    labels = ["O", "B-PERSON", "I-PERSON", "B-LOCATION", "B-MISC"]
    p = lambda k, v: [float(np.log(v if i == k else (1 - v) / 4)) for i in range(5)]
    text = "Anna Bell in Rome X q"
    steps = [(0, 0, 4, p(1, 0.81)), (1, 4, 9, p(2, 0.51)), (2, 10, 12, p(0, 0.9)), (3, 13, 17, p(3, 0.79)), (4, 13, 17, p(3, 0.85)), (5, 18, 19, p(1, 0.9)), (6, 20, 21, p(4, 0.9))]
    d = spark.createDataFrame([(1, 0, i, a, b, x) for i, a, b, x in steps], "doc_id long, window_ix int, token_ix int, start int, end int, logits array<double>")
    got = rows(names.bio_decoded(d, labels, spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert sorted((g["start"], g["end"], g["kind"]) for g in got) == [(0, 9, "PERSON"), (13, 17, "LOC")]


def test_tagger_is_a_plug_in(spark):
    from veilframe.operators.detect import with_spans

    d = spark.createDataFrame([(1, "My name is Wolfgang and I live in Berlin")], "doc_id long, text string")
    off = names.tagged(d, None)
    assert rows(off)[0]["ner_active"] is False and rows(off)[0]["tagged"] == []
    on = names.tagged(d, lambda cut: [[(11, 19, "PERSON"), (34, 40, "LOC")] for _ in cut])
    spans = rows(with_spans(on, tagged=F.col("tagged")))[0]["spans"]
    assert [s["kind"] for s in spans] == ["PERSON", "LOC"]
    never = rows(with_spans(on, Rules.checked([], ["name is Wolfgang and"]), tagged=F.col("tagged")))[0]["spans"]
    assert [s["kind"] for s in never] == ["LOC"]


def test_audits_and_manifests(spark):
    files = spark.createDataFrame([("a/.env", 3, b"x=1"), ("b.txt", 60, b"-----BEGIN RSA PRIVATE KEY-----\n"), ("c.txt", 5, b"ghp_" + b"a" * 36), ("d.bin", 50, b"\0ghp_" + b"a" * 36), ("e.md", 20_000_000, b"ok"), ("f.md", 2, b"ok")], "path string, length long, content binary")
    got = {r["path"]: r["problems"] for r in rows(audit.audited(files))}
    assert got == {"a/.env": ["forbidden path"], "b.txt": ["private-key material"], "c.txt": ["credential-like token"], "e.md": ["too large"]}
    body = json.dumps({"files": {"m": {"sha256": hashlib.sha256(b"ok").hexdigest().upper(), "bytes": 2, "remote": "r"}}})
    m = readers.manifest(spark, body)
    f = lambda c, n="m": spark.createDataFrame([(n, c)], "name string, content binary")
    assert [rows(audit.manifest_ok(x, m))[0]["ok"] for x in (f(b"ok"), f(b"no"), f(b"ok", "z"), f(b"ok").limit(0))] == [True, False, False, False]


def test_readers_and_writers(spark, tmp_path):
    d = spark.createDataFrame([(base64.b64encode(b"hi").decode(),), ("a===",), ("####",)], "s string")
    assert [bytes(r["b"]) if r["b"] else None for r in rows(d.select(readers.from_base64(F.col("s")).alias("b")))] == [b"hi", None, None]
    u = spark.createDataFrame([("data:image/png;base64,QUJD",), ("data:text/plain;base64,QUJD",)], "s string")
    assert [r["p"] for r in rows(u.select(readers.data_url_payload(F.col("s")).alias("p")))] == ["QUJD", None]
    rules = Rules.checked(["Acme"], ["Bolt"], True)
    writers.rules(spark, rules, f"{tmp_path}/rules")
    assert readers.rules_file(spark, f"{tmp_path}/rules") == rules
    assert readers.rules_file(spark, f"{tmp_path}/missing") == Rules()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "r.json").write_text("{")
    assert readers.rules_file(spark, f"{tmp_path}/bad") == Rules()
    assert readers.labels(spark, '{"id2label": {"10": "c", "2": "b", "0": "a"}}') == ["a", "b", "c"]
    with pytest.raises(ValueError):
        writers.images(spark.createDataFrame([("a.gif", b"x")], "name string, content binary"), f"{tmp_path}/i")
    writers.images(spark.createDataFrame([("a.PNG", b"x")], "name string, content binary"), f"{tmp_path}/i")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("hello")
    assert rows(readers.texts(spark, f"{tmp_path}/t", "text"))[0]["text"] == "hello"
    assert [bytes(r["b"]) if r["b"] else None for r in rows(spark.createDataFrame([("4a4B",), ("4",), ("zz",)], "s string").select(readers.bytes_of_hex(F.col("s")).alias("b")))] == [b"JK", None, None]


def test_regions_match_a_flood_fill():
    rng = np.random.default_rng(5)
    for _ in range(40):
        s = (rng.random((int(rng.integers(1, 30)), int(rng.integers(1, 40)))) < 0.62).astype(float)
        left, want = s >= 0.4, []
        for y0, x0 in zip(*np.nonzero(left), strict=True):
            if not left[y0, x0]:
                continue
            todo, seen = [(y0, x0)], set()
            while todo:
                y, x = todo.pop()
                if 0 <= y < s.shape[0] and 0 <= x < s.shape[1] and left[y, x]:
                    left[y, x] = False
                    seen.add((int(y), int(x)))
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            if len(seen) >= 20:
                ys, xs = zip(*seen, strict=True)
                a, b = max(min(xs) - 1, 0), max(min(ys) - 1, 0)
                want.append((a, b, min(max(xs) - min(xs) + 3, s.shape[1] - a), min(max(ys) - min(ys) + 3, s.shape[0] - b)))
        assert images.regions(s) == want[:200]


def test_tensors_of_a_recogniser_and_a_detector():
    px = np.zeros((20, 50, 4), np.uint8)
    px[..., 0], px[..., 3] = 255, 255
    t = images.recogniser_tensor(px, (5, 2, 40, 12))
    assert t.shape == (3, 48, 160) and np.allclose(t[0], 1) and np.allclose(t[1:], -1)
    assert images.recogniser_tensor(px, (0, 0, 2, 20)).shape == (3, 48, 48) and images.recogniser_tensor(px, (0, 0, 50, 1)).shape == (3, 48, 960)
    assert images.detector_tensor(px).shape == (3, 32, 64)


def test_png_files_are_saved(spark, tmp_path):
    from veilframe.sources import writers

    png = images.encode_png(np.zeros((2, 2, 4), np.uint8))
    writers.png_files(spark.createDataFrame([("a.png", png), ("b.PNG", png), ("c.png", None)], "name string, content binary"), f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.png", "b.PNG"] and (tmp_path / "out/a.png").read_bytes() == png
    for name in ("a.jpg", "../a.png"):
        with pytest.raises(ValueError):
            writers.png_files(spark.createDataFrame([(name, png)], "name string, content binary"), f"{tmp_path}/out")


def test_images_are_detected(spark):
    from veilframe.operators import screenshots

    png = images.encode_png(np.full((40, 200, 4), 255, np.uint8))
    words = [("mail", 0, 5, 30, 10, 0.9), ("a@b.co", 100, 5, 60, 10, 0.8)]
    d = spark.createDataFrame([(1, png), (2, b"no image"), (3, png)], "image_id long, content binary")
    got = {r["image_id"]: r for r in screenshots.detected_images(d, lambda content: words).collect()}
    assert set(got) == {1, 3} and got[1]["text"] == "mail EMAIL_1" and got[3]["count"] == 1
    assert [(r["token"], [tuple(b) for b in r["boxes"]]) for r in got[1]["redactions"]] == [("EMAIL_1", [(98, 3, 64, 14)])]


def test_model_places_are_tried_in_turn(spark):
    from veilframe.operators import audit

    files = spark.createDataFrame([("b", "m", b"x"), ("c", "m", b"y")], "pack string, name string, content binary")
    wanted = files.select("pack", "name", F.sha2("content", 256).alias("sha256"), F.lit(1).alias("bytes")).replace("b", "zz", "pack").union(spark.createDataFrame([("b", "m", "00", 1)], "pack string, name string, sha256 string, bytes int"))
    packs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "pack string, nth int")
    assert [r[0] for r in audit.first_sound(packs, files, wanted).collect()] == ["c"]

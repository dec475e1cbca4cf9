"""Writes that fail leave what was there; a search index's pages follow each other."""

import os

import pytest
from pyspark.sql import functions as F

from veilframe.operators import session
from veilframe.operators.rules import Rules
from veilframe.sources import readers, writers


def images(spark, names):
    return spark.createDataFrame([(n, None if n is None else n.encode()) for n in names], "name string, content binary").repartition(4)


def test_image_files_come_all_or_none(spark, tmp_path):
    names = [f"{i}.png" for i in range(40)]
    writers.png_files(images(spark, [*names, None]), f"{tmp_path}/a")
    assert sorted(os.listdir(tmp_path / "a")) == sorted(names)
    assert (tmp_path / "a" / "7.png").read_bytes() == b"7.png"
    for bad in ("x.gif", "../x.png", "d/x.png"):
        with pytest.raises(Exception, match="must end in .png"):
            writers.png_files(images(spark, [*names, bad]), f"{tmp_path}/b")
    failing = images(spark, names).withColumn("content", F.when(F.col("name") == "31.png", F.expr("raise_error('no content')").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no content"):
        writers.png_files(failing, f"{tmp_path}/b")
    with pytest.raises(Exception, match="FileExists"):
        writers.png_files(images(spark, names[:1]), f"{tmp_path}/a")
    assert sorted(os.listdir(tmp_path)) == ["a"]
    assert len(os.listdir(tmp_path / "a")) == 40
    writers.png_files(images(spark, names[:0]), f"{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == []


def test_rules_change_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/rules"
    first, second = Rules.checked(always=["Acme"]), Rules.checked(never=["x@y.zz"], money_dates=True)
    writers.rules(spark, first, path)
    assert readers.rules_file(spark, path) == first
    place = writers._place
    monkeypatch.setattr(writers, "_place", lambda *a: (_ for _ in ()).throw(OSError("store is gone")))
    with pytest.raises(OSError, match="gone"):  # the new version is written, but not pointed to
        writers.rules(spark, second, path)
    assert readers.rules_file(spark, path) == first
    monkeypatch.setattr(writers, "_place", place)
    writers.rules(spark, second, path)
    assert readers.rules_file(spark, path) == second
    assert len([n for n in os.listdir(path) if n.startswith("v-")]) == 1
    assert readers.rules_file(spark, f"{tmp_path}/nowhere") == Rules()


def test_pages_of_a_search_follow_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "BLOCK", 40)
    rows = [("ab"[i % 2], i // 3, i % 3, f"EMAIL_{i}", "EMAIL", f"User{i:03d}@ex.com") for i in range(300)] + [(None, None, 0, "IP_1", "IP", "10.0.0.7"), ("a", 1, 0, "TERM_1", "TERM", None)]
    m = spark.createDataFrame(rows, "session string, seq long, ord int, token string, kind string, original string").repartition(3)
    path = f"{tmp_path}/index"
    session.write_search_index(m, path)
    assert len(os.listdir(f"{path}/rows")) > 4

    def all_pages(q):
        out, after = [], None
        while page := [tuple(r) for r in session.search_pages(spark, path, q, after, page=20).collect()]:
            out, after = out + page, page[-1][:4]
            if len(out) > 400:
                break
        return out

    key = lambda r: [(v is not None, v) for v in r[:4]]
    for q in ("USER01", "r2", "email_29", "0.7", "nothing like it"):
        want = sorted((r for r in rows if q.lower() in " ".join(x for x in (r[3], r[4], {"EMAIL": "Email", "IP": "IP address", "TERM": "Term"}[r[4]], r[5]) if x).lower()), key=key)
        assert all_pages(q) == want, q
    plan = session.search_pages(spark, path, "user017")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan

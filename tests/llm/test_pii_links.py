"""Pseudonyms against a plain Feistel network, across the ways a value is written, and back."""

import hashlib
import ipaddress
import random
import re

from pyspark.sql import functions as F

from veilframe.llm import pii

KEY = "k"


def plain(s, kind):
    """The network said in Python: digits and letters shifted by a keyed hash of those at the other places."""
    base = [48 if c.isdigit() else 97 if c.islower() else 65 if c.isalpha() else ord(c) for c in s]
    radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in s]
    x = [ord(c) - b for c, b in zip(s, base)]
    for k in range(pii.ROUNDS):
        seen = hashlib.sha256(",".join(str(v) for i, v in enumerate(x) if i % 2 != k % 2).encode()).hexdigest()
        shift = lambda i: int(hashlib.sha256(f"{KEY}|{kind}|{k}|{i}|{seen}".encode()).hexdigest()[:12], 16)  # noqa: B023, E731
        x = [(v + shift(i)) % radix[i] if i % 2 == k % 2 else v for i, v in enumerate(x)]
    return "".join(chr(b + v) for b, v in zip(base, x))


def test_permuted_equals_a_plain_network_and_comes_back(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice("abzAZ019-. _") for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    d = spark.createDataFrame([(v,) for v in values], "s string").withColumn("p", pii.permuted(F.col("s"), KEY, "ssn"))
    for r in d.withColumn("back", pii.original(F.col("p"), "ssn", KEY)).collect():
        assert r.p == plain(r.s, "ssn")
        assert r.back == r.s


def shown(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_pii) for r in pii.pseudonymized(d, KEY).orderBy("doc_id").collect()]


def test_values_are_linked_however_they_are_written(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"]
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"]
    got = shown(spark, [f"pay {v} now" for v in [*cards, *ibans]])
    assert [n for _, n in got] == [1] * 5
    new = [t.removeprefix("pay ").removesuffix(" now") for t, _ in got]
    assert [re.sub("[0-9A-Z]", "x", v) for v in new] == [re.sub("[0-9A-Z]", "x", v) for v in [*cards, *ibans]]
    bare = [re.sub("[ -]", "", v) for v in new]
    assert len(set(bare[:3])) == len(set(bare[3:])) == 1
    assert bare[0] != cards[0] and bare[3] != ibans[0] and bare[3].startswith("DE")


def test_uuids_keep_their_form_and_all_kinds_come_back(spark):
    values = {"uuid": ["a1b2c3d4-e5f6-a7b8-c9d0-e1f2a3b4c5d6", "A1B2C3D4-E5F6-A7B8-C9D0-E1F2A3B4C5D6"], "card": ["4111 1111 1111 1111"], "iban": ["DE89 3704 0044 0532 0130 00"], "email": ["jo.doe@mail.example.org"], "ip": ["10.0.250.7"], "phone": ["+44 20 7946 0958"]}
    for kind, every in values.items():
        for v in every:
            (text, n), = shown(spark, [f"see {v} here"])
            new = text.removeprefix("see ").removesuffix(" here")
            assert n == 1 and new != v
            assert spark.range(1).select(pii.original(F.lit(new), kind, KEY).alias("v")).first().v == v
    low, high = (shown(spark, [v])[0][0] for v in values["uuid"])
    assert low.upper() == high and re.fullmatch("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low)


def test_ipv6_addresses_are_linked_across_their_forms_and_come_back(spark):
    forms = {
        "2001:db8::1:2": ["2001:0DB8:0:0:0:0:0001:2", "2001:db8:0:0::1:2", "2001:0db8:0000::0001:0002"],
        "::ffff:10.2.0.255": ["::FFFF:a02:ff", "0:0:0:0:0:ffff:10.2.0.255"],
        "1:22:333:4444:5:66:777:8888": ["0001:0022:0333:4444:0005:0066:0777:8888"],
        "fe80:1::": ["FE80:1:0:0:0:0:0:0"],
    }
    every = [v for k, more in forms.items() for v in [k, *more]]
    got = shown(spark, [f"at [{v}]: up" for v in every])
    assert [n for _, n in got] == [1] * len(every)
    new = dict(zip(every, (t.removeprefix("at [").removesuffix("]: up") for t, _ in got), strict=True))
    values = set()
    for k, more in forms.items():
        same = {ipaddress.ip_address(new[v]) for v in [k, *more]}
        assert len(same) == 1 and same != {ipaddress.ip_address(k)}
        values |= same
    assert len(values) == len(forms)
    for v in every:
        assert re.sub("[0-9A-Fa-f]", "x", new[v].rpartition(":")[0] if "." in v else new[v]) == re.sub("[0-9A-Fa-f]", "x", v.rpartition(":")[0] if "." in v else v)
        back = spark.range(1).select(pii.original(F.lit(new[v]), "ip6", KEY).alias("v")).first().v
        assert back.lower() == v.lower()
    assert spark.range(1).select(pii.original(F.lit(new["fe80:1::"]), "ip6", KEY).alias("v")).first().v == "fe80:1::"


def test_what_only_looks_like_ipv6_stays(spark):
    texts = ["at 12:34:56 h", "mac aa:bb:cc:dd:ee:ff", "std::vector a :: b", "a::b::c", "1:2:3:4:5:6:7:8:9", "::1.2.3.400 x", "x fe80::1g", None, "", ":" * 100_000, "a:" * 50_000]
    assert shown(spark, texts) == [(t, 0) for t in texts]
    assert shown(spark, ["up fe80::1: ok"])[0][1] == 1
    assert shown(spark, ["1:2:192.168.0.1"])[0][1] == 1  # the IPv4 address in it

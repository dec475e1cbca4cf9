"""The name tagger's share: windows, normalised text, word pieces, decoding of logits. The model itself is a plug-in.

tagger is a callable from a list of windows to a list of (tokens, labels x tokens logits, offsets); without one, or where
its files are missing or damaged, no names are found and the tagger counts as off.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import NAME_ORDER, NAME_PRIORITY

# Window, overlap, most tokens, confidence to open and to go on, unknown piece, longest word.
WINDOW, OVERLAP, MOST_TOKENS, OPEN, GO_ON, UNKNOWN, LONGEST = 500, 50, 510, 0.80, 0.50, "[UNK]", 100
KINDS = {"PERSON": "PERSON", "PER": "PERSON", "ORGANIZATION": "ORG", "ORG": "ORG", "LOCATION": "LOC", "LOC": "LOC"}
#: Scripts whose characters are words of their own. Fixed values.
WIDE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A600, 0x2D7FF), (0x2F800, 0x2FA1F), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3100, 0x312F), (0x3130, 0x318F), (0x3200, 0x32FF), (0xFF00, 0xFFEF))


def normalized(text: str) -> tuple[str, list[int]]:
    """Lower-case text without marks and controls, wide characters apart, and the place in text of each of its characters."""
    out: list[str] = []
    at: list[int] = []

    def put(s: str, i: int) -> None:
        out.append(s)
        at.extend([i] * len(s))

    for i, c in enumerate(text):
        if c.isspace():
            put(" ", i)
        elif unicodedata.category(c) == "Cc":
            continue
        elif any(a <= ord(c) <= b for a, b in WIDE):
            put(f" {c} ", i)
        else:
            put("".join(d for d in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.category(d).startswith("M")), i)
    return "".join(out), at


def windows(text: str) -> list[tuple[int, str]]:
    """Starts and texts of overlapping windows, halved until their normalised form fits the model: its length is a difference of running sums."""
    size = np.cumsum([0] + [len(normalized(c)[0]) for c in text])  # characters are normalised each for itself
    cuts: list[tuple[int, int]] = []
    at, n = 0, len(text)
    while at < n:
        wide = min(WINDOW, n - at)
        while wide > 1 and size[at + wide] - size[at] > MOST_TOKENS:
            wide //= 2
        cuts.append((at, at + wide))
        at = n if at + wide >= n else at + wide - min(OVERLAP, wide // 2)
    return [(i, text[i:j]) for i, j in cuts]


#: A word, or one ASCII mark. White space stands between.
TOKEN = regex.compile(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+")


def basic_tokens(norm: str) -> list[tuple[int, int]]:
    """Start and end of words and of single ASCII marks in normalised text."""
    return [m.span() for m in TOKEN.finditer(norm)]


def word_pieces(word: str, vocab: dict[str, int]) -> list[tuple[str, int, int]]:
    """Greedy longest pieces of a word, with start and end; later ones begin with ##. One unknown piece where that fails."""
    unknown = [(UNKNOWN, 0, len(word))]
    out: list[tuple[str, int, int]] = []
    while (at := out[-1][2] if out else 0) < len(word) <= LONGEST:
        mark = "##" if out else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocab), None)
        if end is None:
            return unknown
        out.append((mark + word[at:end], at, end))
    return out if len(word) <= LONGEST else unknown


def encoded(window: str, vocab: dict[str, int]) -> tuple[list[int], list[tuple[int, int]]]:
    """The model's ids for a window, [CLS] ids [SEP], and the places in the window of those between."""
    norm, at = normalized(window)
    ids, places = [], []
    for i, j in basic_tokens(norm):
        for piece, a, b in word_pieces(norm[i:j], vocab):
            ids.append(vocab.get(piece, vocab.get(UNKNOWN, 100)))
            places.append((at[i + a], at[i + b - 1] + 1))
    ids, places = ids[:MOST_TOKENS], places[:MOST_TOKENS]
    return [vocab.get("[CLS]", 101), *ids, vocab.get("[SEP]", 102)], places


def decoded(window: str, places: list[tuple[int, int]], logits: np.ndarray, labels: list[str]) -> list[tuple[int, int, str]]:
    """start, end and kind of the names in a window by the logits of its tokens (a row for each place), as bio_decoded() finds them."""
    x = np.exp(logits.astype(np.float64) - logits.max(axis=1, keepdims=True))
    p, best = (x / x.sum(axis=1, keepdims=True)).max(axis=1), logits.argmax(axis=1)
    names: list[list] = []
    is_open = False
    for (i, j), k, sure in zip(places, best.tolist(), p.tolist(), strict=True):
        label = labels[k] if k < len(labels) else "O"
        if is_open and label == f"I-{names[-1][2]}" and sure >= GO_ON:
            names[-1][1] = j
        elif is_open := label.startswith("B-") and sure >= OPEN:
            names.append([i, j, label[2:]])
    out = []
    for i, j, kind in names:
        raw = window[i:j]
        i, j = i + len(raw) - len(raw.lstrip()), j - len(raw) + len(raw.rstrip())
        if j - i >= 2 and kind in KINDS:
            out.append((i, j, KINDS[kind]))
    return out


def model_tagger(vocab: dict[str, int], labels: list[str], run: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[list[str]], list[list[tuple[int, int, str]]]]:
    """A tagger for tagged() from a model: run takes ids, mask and types (1 by tokens) and gives logits (1 by tokens by labels). A window whose run fails has no names."""

    def tag(texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out = []
        for window in texts:
            ids, places = encoded(window, vocab)
            found: list[tuple[int, int, str]] = []
            if places:
                row = np.array([ids], dtype=np.int64)
                logits = np.asarray(run(row, np.ones_like(row), np.zeros_like(row)))
                if logits.ndim == 3 and logits.shape[1] == len(ids):
                    found = decoded(window, places, logits[0, 1:-1], labels)
            out.append(found)
        return out

    return tag


def softmax_best(logits: Column) -> Column:
    """label (place of the highest logit) and p (its probability)."""
    peak = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - peak))
    return F.struct((F.array_position(logits, peak).cast("int") - 1).alias("label"), (1 / total).alias("p"))


def bio_decoded(tokens: DataFrame, labels: list[str], texts: DataFrame) -> DataFrame:
    """doc_id, start, end and kind of names: tokens (doc_id, window_ix, token_ix, start, end, logits) with offsets in texts (doc_id, text).

    A name opens at B-x with 0.80, goes on by I-x of the same with 0.50; white space at its ends goes; one of fewer than
    two characters, or of a kind that isn't mapped, is dropped.
    """
    names = F.array(*[F.lit(x) for x in labels])
    best = softmax_best(F.col("logits"))
    rows = tokens.select("doc_id", "window_ix", "token_ix", "start", "end", best.alias("b")).withColumn("label", F.coalesce(F.get(names, F.col("b.label")), F.lit("O")))
    one = F.struct("token_ix", "start", "end", "label", F.col("b.p").alias("p"))
    lines = rows.groupBy("doc_id", "window_ix").agg(F.array_sort(F.collect_list(one)).alias("line"))

    def fold(acc: Column, t: Column) -> Column:
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        goes_on = acc["open"] & (t["label"] == F.concat(F.lit("I-"), last["type"])) & (t["p"] >= GO_ON)
        opens = t["label"].startswith("B-") & (t["p"] >= OPEN)
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), t["end"].alias("end"), last["type"].alias("type"))))
        new = F.concat(acc["out"], F.array(F.struct(t["start"].alias("start"), t["end"].alias("end"), F.substring(t["label"], 3, 100).alias("type"))))
        return F.struct(F.when(goes_on, longer).when(opens, new).otherwise(acc["out"]).alias("out"), F.coalesce(goes_on | opens, F.lit(False)).alias("open"))

    start = F.struct(F.expr("cast(array() as array<struct<start: int, end: int, type: string>>)").alias("out"), F.lit(False).alias("open"))
    found = lines.select("doc_id", F.explode(F.aggregate("line", start, fold, lambda acc: acc["out"])).alias("n")).select("doc_id", "n.*").join(texts, "doc_id")
    raw = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    lead = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", F.lit("")))
    trail = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)\s+$", F.lit("")))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    out = found.select("doc_id", (F.col("start") + lead).cast("int").alias("start"), (F.col("end") - trail).cast("int").alias("end"), F.try_element_at(kinds, F.col("type")).alias("kind"))
    return out.where((F.col("end") - F.col("start") >= 2) & F.col("kind").isNotNull()).distinct()


def tagged(docs: DataFrame, tagger: Callable[[list[str]], list[list[tuple[int, int, str]]]] | None) -> DataFrame:
    """docs (doc_id, text) with tagged, spans that detect.with_spans() takes, and ner_active. tagger: windows to (start, end, kind) lists."""
    spans = "array<struct<start: int, end: int, kind: string, priority: int, det: int, seq: int>>"
    if tagger is None:
        return docs.withColumn("tagged", F.expr(f"cast(array() as {spans})")).withColumn("ner_active", F.lit(False))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for text in b["text"].to_pylist():
                cut = windows(text or "")
                found = sorted({(s + at, e + at, k) for (at, _), names in zip(cut, tagger([w for _, w in cut]) if cut else [], strict=True) for s, e, k in names})
                out.append([{"start": s, "end": e, "kind": k, "priority": NAME_PRIORITY, "det": NAME_ORDER, "seq": i} for i, (s, e, k) in enumerate(found)])
            fields = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("priority", pa.int32()), ("det", pa.int32()), ("seq", pa.int32())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(out, pa.list_(pa.struct(fields)))], ["doc_id", "text", "tagged"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, text string, tagged {spans}").withColumn("ner_active", F.lit(True))

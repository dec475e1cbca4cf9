"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Texts are folded: compatibility forms (NFKC), lower-case, homoglyphs of other scripts and digit or sign substitutions
inside words to Latin letters, other characters to spaces; words with marks come once more without them. The lexicon holds whole words and beginnings
of words with weights learned from labelled rows: smoothed log odds of the term under
either label; of a word's beginnings the shortest that says as much is kept. Exception phrases are matched too; a term inside one
does not count. A text's weights are summed, repeats of a term damped, and normalised by length; a logistic curve, fitted on
labelled rows, gives the score.

The lexicon is learned from a bounded sample of labels; scores cover all texts whole. Null, empty and wordless texts get the curve's value at no
match. Rows of labels with a null label, and labels of rows that don't exist, aren't learned. With several labels for an
id each counts. Repeated rows are scored alike, and rows that share a labelled id are all learned. An empty table gives
no rows; without labels every score is 0.5 less a little. Columns but the key and the text aren't read. Only the text is
an input of a score.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_table, fold_of, materialize, small_batches

# Letters of other scripts that look like Latin ones, after NFKD and lower-casing.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁһαβεικνορτυχı", "abekmhopctyxijsdhabeikvoptuxi")
# Digits and signs written for letters.
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
#: A word of letters with a substitute in it: a digit or sign before a letter.
MIXED = re.compile(r"(?<![\w@$!|])(?=[a-z0-9@$!|]*[013457@$!|][a-z])(?=[a-z0-9@$!|]*[a-z])[a-z0-9@$!|]+")
OTHER = re.compile(r"[\W_]+")
#: Phrases in which a term means no harm. Fixed values.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "pond scum", "sore loser award", "stupid simple", "idiot proof", "oxy moron")


def folded(text: str | None) -> str:
    """Lower-case words with single spaces and a space at either end; words with marks once more without them, after a bar."""
    t = unicodedata.normalize("NFKC", text or "").lower()
    if not t.isascii():
        t = t.translate(HOMOGLYPHS)
    t = MIXED.sub(lambda m: m[0].rstrip("!|").translate(SUBSTITUTES), t)
    t = f" {OTHER.sub(' ', t).strip()} "
    if not t.isascii():
        marked = " ".join(w for w in t.split() if not w.isascii())
        plain = "".join(c for c in unicodedata.normalize("NFKD", marked) if not unicodedata.combining(c))
        t = f"{t}| {plain} "
    return t


class Lexicon:
    """Terms with weights, exceptions, and the curve; the automaton is built where it is used."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, ...] = (-0.01, 0.0, 0.0, 0.0), exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.curve, self.exceptions = weights, curve, exceptions
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term in self.weights:
                self._automaton.add_word(term, (term, len(term), True))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (phrase, len(phrase) + 2, False))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Logarithm of the summed weights, their share of the root of the words, and of the words."""
        t = folded(text)
        a = self.automaton()
        if not len(a):
            return 0.0, 0.0, 0.0
        found, spared = [], []
        for end, (term, size, counts) in a.iter(t):
            (found if counts else spared).append((end + 1 - size, end + 1, term))
        best: dict[int, str] = {}
        starts, reach = [], []  # exceptions by their start, and how far any up to it goes
        for i, j, _ in sorted(spared):
            starts.append(i)
            reach.append(max(j, reach[-1]) if reach else j)
        for start, stop, term in found:  # of terms that begin together the heaviest
            if start not in best or self.weights[term] > self.weights[best[start]]:
                at = bisect.bisect_right(starts, start)
                if not at or reach[at - 1] < stop:
                    best[start] = term
        seen: dict[str, int] = {}
        for term in best.values():
            seen[term] = seen.get(term, 0) + 1
        n = 1 + t.count(" ")
        damped = sum(self.weights[term] * (1 + math.log(k)) for term, k in seen.items())
        plain = sum(self.weights[term] * k for term, k in seen.items())
        return math.log1p(damped), damped / math.sqrt(n), math.log1p(100 * plain / n)

    def score(self, text: str | None) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms(text: str | None, longest: int) -> tuple[dict[str, int], int]:
    """Words (with a space at either end) and their beginnings of 3 letters and more (with a space before), with damped counts; and their sum over words."""
    words: dict[str, int] = {}
    n = 0
    for w in folded(text).split():
        if w != "|":
            words[w] = words.get(w, 0) + 1
    out: dict[str, int] = {}
    for w, k in words.items():
        k = k.bit_length()  # repeats are damped
        n += k
        out[f" {w} "] = k
        for i in range(3, min(len(w), longest) + 1):
            t = f" {w[:i]}"
            out[t] = out.get(t, 0) + k
    return out, n


def counted(labelled: DataFrame, longest: int = 9) -> DataFrame:
    """term, docs (texts of label 1 that have it), pos, neg: how often a term occurs under either label; the null term counts all words. Each task adds up its own texts first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, list[int]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            keys = list(counts)
            for i in range(0, len(keys), 50000):
                part = keys[i : i + 50000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[k][c] for k in part], pa.int64()) for c in (2, 1, 0))], ["term", "docs", "pos", "neg"])
            counts.clear()

        for b in it:
            for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
                found, n = terms(text, longest)
                found[None] = n
                for term, k in found.items():
                    c = counts.get(term)
                    if c is None:
                        c = counts[term] = [0, 0, 0]
                    c[label] += k
                    c[2] += label
                if len(counts) > 300_000:
                    yield from sent()
        yield from sent()

    sums = [F.sum(c).alias(c) for c in ("docs", "pos", "neg")]
    return small_batches(labelled).select("text", "label").mapInArrow(run, "term string, docs long, pos long, neg long").groupBy("term").agg(*sums)


def learn(docs: DataFrame, labels: DataFrame, rows: int = 30_000, size: int = 2000, least: int = 5, curve_rows: int = 10_000) -> Lexicon:
    """A lexicon of at most size terms from docs (doc_id, text) and labels (doc_id, label 0 or 1).

    It is fitted on a bounded sample: the rows labels of the smallest hash, which are few enough to be broadcast; the
    curve on about curve_rows of them.
    """
    sample = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id", "label"), "doc_id").limit(rows)
    labelled = materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label"), "labelled")
    counts = materialize(counted(labelled), "terms")
    whole = counts.where("term is null").first()
    if whole is None or not whole["pos"] or not whole["neg"]:
        return Lexicon({}, exceptions=())
    pos, neg = float(whole["pos"]), float(whole["neg"])
    odds = F.log((F.col("pos") + 0.5) / pos) - F.log((F.col("neg") + 0.5) / neg)
    # surprise: how far the count lies from what chance gives it
    z = (F.col("pos") - pos / (pos + neg) * (F.col("pos") + F.col("neg"))) / F.sqrt(F.col("pos") + F.col("neg"))
    heavy = counts.where(F.col("term").isNotNull() & (F.col("docs") >= least)).withColumn("w", odds).withColumn("z", z)
    lexicon = Lexicon(chosen({r["term"]: (r["w"], r["docs"]) for r in heavy.where("w > 1 and z > 3").orderBy(F.desc("z"), "term").limit(size).collect()}))
    share = min(1.0, curve_rows / max(1, labelled.count()))
    # rows are drawn each for itself, as very many may share a text; the table is written, so their numbers stay
    few = labelled.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1_000_000)) < int(share * 1_000_000))
    shared = labelled.sparkSession.sparkContext.broadcast(lexicon)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [shared.value.features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b["label"].cast(pa.int32())], ["x", "label"])

    found = few.mapInArrow(run, "x array<double>, label int").collect()
    if len({r["label"] for r in found}) > 1:
        lexicon.curve = fitted(np.array([[1.0, *r["x"]] for r in found]), np.array([r["label"] for r in found], dtype=float))
    return lexicon


def chosen(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Of terms that extend each other: none that an extension stands for in nine of ten texts; then the shortest that weighs nearly as much."""
    support: dict[str, int] = {}
    kept = []
    for term in sorted(found, key=lambda t: (-len(t), t)):
        if support.get(term, 0) < 0.9 * found[term][1]:
            kept.append(term)
        for k in range(2, len(term)):
            support[term[:k]] = max(support.get(term[:k], 0), found[term][1])
    out: dict[str, float] = {}
    for term in reversed(kept):
        if not any(out.get(term[:k], -1) >= found[term][0] - 0.7 for k in range(2, len(term))):
            out[term] = found[term][0]
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's steps with a little ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (y - p) - ridge * b
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def score(docs: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """key and score (0 to 1) for every row of docs (key, text)."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # a bounded number of terms

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b[key], pa.array([shared.value.score(t) for t in b["text"].to_pylist()], pa.float64())], [key, "score"])

    return small_batches(docs).select(key, "text").mapInArrow(run, f"`{key}` {kind}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole text of documents."""
    docs = docs_table(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    lexicon = learn(docs, labels)
    rows = docs.select(F.struct("doc_id", (F.coalesce(fold_of(F.col("doc_id"), 5), F.lit(0)) == 0).alias("held_out")).alias("row"), "text")
    return score(rows, lexicon, "row").select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding: lower case, look-alike letters of other scripts and digits or signs inside words become the Latin letters they
imitate, everything that is no letter or digit becomes one space. Lexicon entries are whole words or beginnings of words;
an entry's weight is its smoothed log-odds between toxic and clean labelled documents. Entries inside an exception phrase do
not count; phrases can be given, and those two-word phrases are learned that hold a strong entry in clean documents only.
The score is a logistic function of the summed weights, the hits, and the hits per word.

Learning reads at most about `most_rows` labelled training rows (a documented bound, drawn by a hash of doc_id), drops near
copies among them, and counts in Spark; the lexicon (at most `size` entries) and the few feature columns of those rows reach
the driver. Scoring covers every document. Null or empty text has no hits and gets the score of no hits; without toxic
training rows every score is 0. Repeated label rows count once (toxic if any is).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, staged

# Letters of other scripts that look like Latin ones, and signs written in place of letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝαβεικνορτυχ", "abekmhopctyxijsdqwabeiknoptux"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(LOOKALIKES)
_SIGN = str.maketrans(SIGNS)
_FOREIGN = re.compile("[Ͱ-ԯ]")
_WIDE = re.compile("[！-～]")
#: Words in which a sign stands beside a letter.
_MIXED = re.compile(r"(?<=[^\W\d_])[0-9@$!]{1,3}(?=[^\W\d_])|(?<![^\W_])[0-9@$](?=[^\W\d_])|(?<=[^\W\d_]{2})[0-9@$](?![^\W_])")
_GAP = re.compile(r"[\W_]+")
PREFIXES = range(4, 8)
#: Tasks over the training rows, which are few.
TRAINING_PARTS = 16


def fold(text: str) -> str:
    """' word word ' in plain letters."""
    text = text.lower()
    if not text.isascii():
        if _FOREIGN.search(text):
            text = text.translate(_FOLD)
        if _WIDE.search(text):
            text = _WIDE.sub(lambda m: chr(ord(m[0]) - 0xFEE0), text).lower()
    text = _MIXED.sub(lambda m: m[0].translate(_SIGN), text)
    return f" {_GAP.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    weights: dict[str, float]  # ' word ' or ' beginning'
    exceptions: tuple[str, ...] = ()  # folded phrases
    beta: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.weights, self.exceptions, self.beta

    def __setstate__(self, state):
        self.weights, self.exceptions, self.beta = state
        self._automaton = None

    def hits(self, folded: str) -> tuple[float, int, int]:
        """(sum of weights, hits, words): per place the heaviest entry, none inside an exception phrase."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for p, w in self.weights.items():
                self._automaton.add_word(p, (len(p), w))
            for p in self.exceptions:
                self._automaton.add_word(p, (len(p), -1.0))
            self._automaton.make_automaton()
        words = folded.count(" ") - 1 if folded != "  " else 0
        if not len(self._automaton):
            return 0.0, 0, words
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self._automaton.iter(folded):
            start = end - n + 1
            if w < 0:
                spared.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), w)
        for a, b in spared:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sum(best.values()), len(best), words

    def features(self, text: str | None) -> tuple[float, float, float]:
        total, n, words = self.hits(fold(text or ""))
        return math.log1p(total), math.log1p(n), math.log1p(1000 * n / max(words, 20))

    def score(self, text: str | None) -> float:
        z = self.beta[0] + sum(b * x for b, x in zip(self.beta[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if self.weights else 0.0


def entries(folded: str) -> set[str]:
    """Candidate entries of a folded text."""
    out = set()
    for w in set(folded.split()):
        if not w.isdigit() and len(w) <= 40:
            if len(w) >= 3:
                out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in PREFIXES if len(w) > n)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(text, toxic), a written table, of about most_rows labelled rows outside the held-out third, near copies dropped."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    cut = min(1.0, most_rows / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(cut * (1 << 20)))  # about most_rows rows of 12 bytes
    rows = staged(id_text(docs).join(F.broadcast(own), "doc_id"), "labelled")  # the one pass over all documents

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for t in batch.column(1).to_pylist():
                w = fold(t or "").split()
                keys.append(min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.int64()), batch.column(2)], names=["doc_id", "text", "sketch", "toxic"])

    sketched = rows.select("doc_id", "text", "toxic").mapInArrow(sketch, "doc_id long, text string, sketch long, toxic int")
    kept = sketched.groupBy("sketch", "toxic").agg(F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))  # a row each, whatever ids they share
    return staged(kept.select("text", "toxic").repartition(TRAINING_PARTS), "training")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Coefficients of a ridge logistic regression by Newton's method, intercept first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def learn_lexicon(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, size: int = 4096, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Fit the lexicon and the score from labels (doc_id, toxic) of documents (doc_id, text)."""
    rows = training_rows(docs, labels, most_rows)
    given = tuple(fold(p) for p in exceptions)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums[int(bool(y))]
                own.update(entries(fold(t or "")))
                own[""] += 1
        keys = list(sums[0].keys() | sums[1].keys())
        for a in range(0, len(keys), 50_000):
            k = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([sums[1][p] for p in k], pa.int64()), pa.array([sums[0][p] for p in k], pa.int64())], names=["entry", "pos", "neg"])

    counted = rows.mapInArrow(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # The row '' has the numbers of documents; entries in fewer than five toxic ones are no evidence. Strongest first, at most `size`.
    strong = (F.col("entry") == "") | ((F.col("pos") >= 5) & (F.col("pos") * 4 >= F.col("neg")))
    found = counted.where(strong).orderBy((F.col("entry") == "").desc(), (F.col("pos") - F.col("neg")).desc(), "entry").limit(4 * size).collect()
    total = next(((r.pos, r.neg) for r in found if r.entry == ""), (0, 0))
    weights: dict[str, float] = {}
    for r in sorted((r for r in found if r.entry), key=lambda r: (len(r.entry), r.entry)):
        w = math.log((r.pos + 0.5) / (total[0] + 1)) - math.log((r.neg + 0.5) / (total[1] + 1))
        shorter = max((weights.get(r.entry[:n], 0.0) for n in range(5, len(r.entry))), default=0.0)
        if w >= 1.5 and w / math.sqrt(1 / (r.pos + 0.5) + 1 / (r.neg + 0.5)) >= 4 and w > shorter + 0.5:
            weights[r.entry] = w
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:size])
    lexicon = Lexicon(weights, given)
    if not weights:
        return lexicon
    lexicon.exceptions = given + learned_exceptions(rows, lexicon, size)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in (zip(*f) if f else [[]] * 3)), batch.column(1).cast(pa.int32())], names=["a", "b", "c", "y"])

    sample = np.array([tuple(r) for r in rows.mapInArrow(measure, "a double, b double, c double, y int").collect()])  # at most about most_rows rows of four numbers
    sample = sample[np.lexsort(sample.T)]  # sums do not depend on row order
    lexicon.beta = logistic(sample[:, :3], (sample[:, 3] > 0).astype(float))
    return lexicon


def learned_exceptions(rows: DataFrame, lexicon: Lexicon, size: int, least: int = 5) -> tuple[str, ...]:
    """Two-word phrases around an entry, found in at least `least` clean training documents and in no toxic one."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(t or "")
                if lexicon.hits(folded)[1]:
                    w = folded.split()
                    own = {f" {a} {b} " for a, b in zip(w, w[1:])}
                    out += [(p, int(bool(y))) for p in own if lexicon.hits(p)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], names=["phrase", "y"])

    counted = rows.mapInArrow(phrases, "phrase string, y int").groupBy("phrase").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    return tuple(r.phrase for r in counted.where((F.col("pos") == 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "phrase").limit(size).collect())


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lexicon.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Documents (doc_id, text, …) whose score is under the threshold, all columns kept."""
    lexicon = learn_lexicon(docs, labels)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)

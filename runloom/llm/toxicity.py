"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector w for all ordered
thresholds t_1 < t_2 < ...; the expected severity is the sum of these chances.
Features are words and prefixes of words, counted per thousand words and
taken as logarithms. Which features count is found in Spark from how many
documents of each grade hold them; the weights are fitted on the driver, on a
bounded sample of labelled rows; all documents are scored on the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty, written

#: At most so many labelled rows are fitted on, chosen by a hash of their id.
SAMPLE = 8_000
#: So many features at most, and so many sampled documents that must hold one.
FEATURES, LEAST_DOCS = 2_048, 6
#: Features whose G-test falls under this are left out: chance alone gives as much.
LEAST_GAIN = 12.0
PREFIXES = (4, 5, 6, 7)
#: Counts are per so many words, and a text counts as having this many at least.
PER, SHORT = 1_000, 150
#: A document is rejected from this chance of grade 1 or more.
REJECT = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> tuple[Counter, int]:
    """Counts of words and of their prefixes (marked by ^), and the number of words."""
    words = Counter(_WORD.findall(text.lower()))
    found: Counter = Counter()
    total = 0
    for w, n in words.items():
        total += n
        found[w] += n
        for k in PREFIXES:
            if len(w) > k:
                found["^" + w[:k]] += n
    return found, total


def known_features(text: str, index: dict[str, int]) -> tuple[dict[int, int], int]:
    """As features(), but only those in ``index``, by their number."""
    words = Counter(_WORD.findall(text.lower()))
    found: dict[int, int] = {}
    total = 0
    for w, n in words.items():
        total += n
        for f in (w, *("^" + w[:k] for k in PREFIXES if len(w) > k)):
            i = index.get(f)
            if i is not None:
                found[i] = found.get(i, 0) + n
    return found, total


def value(count, words):
    return np.log1p(PER * count / np.maximum(words, SHORT))


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        if not hasattr(self, "_index"):
            self._index = {f: i for i, f in enumerate(self.names)}
        found, total = known_features(text, self._index)
        score = sum(float(self.weights[i] * value(found[i], total)) for i in sorted(found))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, penalty: float = 2e-3, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised logistic loss summed over thresholds (Adam on all rows).

    Thresholds are a first one and positive steps, so that they stay in order.
    """
    above = (grade[:, None] >= np.arange(1, grades)).astype(np.float32)
    share = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
    start = np.log(1 / share - 1)
    params = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    f = x.shape[1]
    for i in range(1, rounds + 1):
        steps = np.exp(params[f + 1 :])
        t = params[f] + np.concatenate([[0.0], np.cumsum(steps)])
        z = (x @ params[:f].astype(np.float32)).astype(np.float64)[:, None] - t
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - above
        pull = error.sum(1) / len(x)
        down = -error.sum(0) / len(x)
        grad = np.concatenate([x.T @ pull.astype(np.float32) + penalty * params[:f], [down.sum()], np.cumsum(down[::-1])[::-1][1:] * steps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return params[:f], params[f] + np.concatenate([[0.0], np.cumsum(np.exp(params[f + 1 :]))])


def choose_features(sample: DataFrame, most: int = FEATURES, least: int = LEAST_DOCS, least_gain: float = LEAST_GAIN) -> list[str]:
    """Those features of ``sample`` (text, grade) that tell grade 0 from the others best (G-test), by name among equals."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marked, plain = Counter(), Counter()
            for t, g in zip(b.column("text").to_pylist(), b.column("grade").to_pylist(), strict=True):
                (marked if g else plain).update(features(t)[0].keys())
            names = sorted(marked.keys() | plain.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([marked[n] for n in names], pa.int64()), pa.array([plain[n] for n in names], pa.int64())], names=["name", "marked", "plain"])

    totals = sample.agg(F.sum((F.col("grade") > 0).cast("long")).alias("m"), F.count("*").alias("n")).first()
    m, n = totals["m"] or 0, totals["n"]
    if not m or m == n:
        return []
    counts = sample.select("text", "grade").mapInArrow(each, "name string, marked long, plain long").groupBy("name").agg(F.sum("marked").alias("marked"), F.sum("plain").alias("plain"))
    held = F.col("marked") + F.col("plain")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    gain = part(F.col("marked"), held * (m / n)) + part(F.col("plain"), held * ((n - m) / n)) + part(m - F.col("marked"), (n - held) * (m / n)) + part((n - m) - F.col("plain"), (n - held) * ((n - m) / n))
    best = counts.where((held >= least) & (held < n)).select("name", F.round(gain, 6).alias("gain")).where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "name").limit(most)
    return sorted(r["name"] for r in best.collect())  # at most ``most`` names


def sampled(docs: DataFrame, labels: DataFrame, grade: str, most: int = SAMPLE) -> DataFrame:
    """doc_id, text and grade of at most ``most`` labelled documents, those of the least hash of their id."""
    few = labels.where(F.col("doc_id").isNotNull() & F.col(grade).isNotNull()).groupBy("doc_id").agg(F.max(F.col(grade).cast("int")).alias("grade"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    joined = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("grade").alias("grade"))
    return written(joined, "labelled")[0]


def train(docs: DataFrame, labels: DataFrame, grade: str = "toxic", split: bool = True, most: int = SAMPLE, most_features: int = FEATURES, least_docs: int = LEAST_DOCS, least_gain: float = LEAST_GAIN) -> Model:
    """Fit on documents with a label (columns doc_id and ``grade``, 0 for clean, more for worse).

    Labels of several grades are fitted as they are. Only where they say no more than yes or no, and
    with ``split``, they become three grades: of the marked documents those with more than the median share of telling words
    count as grade 2; a severity over 1 then says how much of such words there is, not what somebody labelled. Labels that are null or whose document is missing aren't
    used; of several labels of one document the highest counts. Without labels of both kinds no
    document is rejected; an empty label table is such a case. At most ``most`` rows are sampled, which bounds what the
    driver holds: a row's counts of the chosen features. Those are at most ``most_features``, each in
    ``least_docs`` sampled documents or more and with a G-test of ``least_gain`` or more.
    """
    sample = sampled(docs, labels, grade, most)
    names = choose_features(sample, most_features, least_docs, least_gain)
    if not names:
        return Model([], np.zeros(0), np.array([np.inf]))
    spec = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [known_features(t, spec.value) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("grade"), pa.array([f[1] for f in found], pa.int64()), pa.array([list(f[0]) for f in found], pa.list_(pa.int32())), pa.array([list(f[0].values()) for f in found], pa.list_(pa.int64()))],
                names=["doc_id", "grade", "words", "at", "counts"],
            )

    kind = dict(sample.dtypes)["doc_id"]
    known = sample.mapInArrow(rows, f"doc_id {kind}, grade int, words long, at array<int>, counts array<long>").toArrow()  # ``most`` rows
    known = known.sort_by("doc_id")
    x = np.zeros((known.num_rows, len(names)), np.float32)
    grades, words = known["grade"].to_numpy(), known["words"].to_numpy()
    for i, (at, counts) in enumerate(zip(known["at"].to_pylist(), known["counts"].to_pylist(), strict=True)):
        x[i, at] = value(np.array(counts, float), words[i])
    if split and grades.max() == 1:
        held = x > 0
        telling = held[grades == 1].mean(0) > 4 * held[grades == 0].mean(0)
        share = np.expm1(x[:, telling]).sum(1)
        grades = np.where((grades == 1) & (share > np.median(share[grades == 1])), 2, grades)
    weights, thresholds = fit_ordinal(x, grades, int(grades.max()) + 1)
    return Model(names, weights, thresholds)


def severity(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """``docs`` (doc_id, text, ...) with severity, grade and rejected.

    severity is the expected grade, grade the highest whose chance is a half or
    more, rejected whether the chance of grade 1 or more reaches ``reject``.
    A null text counts as empty; rows stay one to one, repeated ones too; an
    empty table stays empty; columns named like a result are replaced. Each text is scored whole and alone.
    """
    kept = [c for c in docs.columns if c not in ("severity", "grade", "rejected")]
    rows = docs.select(*[docs[c] for c in kept])
    schema = T.StructType([*rows.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chances = [shared.value.chances(t or "") for t in b.column("text").to_pylist()]
            made = [pa.array([float(c.sum()) for c in chances], pa.float64()), pa.array([int((c >= 0.5).sum()) for c in chances], pa.int32()), pa.array([bool(c[0] >= reject) for c in chances], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "severity", "grade", "rejected"])

    return rows.mapInArrow(score, schema)


def accepted(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` (text, ...) that severity() wouldn't reject, with all their columns as they are, whatever they are called.

    A null text counts as empty, repeated rows stay, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(shared.value.chances(t or "")[0] < reject) for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)

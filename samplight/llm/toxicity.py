"""Toxicity grades by cumulative-link ordinal regression on sparse features.

Features say whether a text has a word or a piece of a word (4 or 5 characters,
ends marked). Those that toxic labelled documents have far more often than
clean ones are kept (at most MAX_FEATURES); the labels, which only say toxic or
not, become grades by how many different marked words a toxic document has;
marked for that are words with features found on the other half of the sample,
so that a document's grade doesn't rest on what it was itself counted for.
The regression shares one weight vector across the ordered thresholds:
P(grade > k) = 1 / (1 + exp(threshold_k - w.x)); the output is the expected
grade. It is fitted on a bounded sample of labelled documents, whole texts,
weighted back to the labels' shares.

Edge cases: null, empty and unlabelled texts are scored like others; without
labels of both kinds every document is clean; rows that repeat a document get
the same answer; an empty table gives an empty result; other columns are
ignored; labels without a document, with nulls or that contradict each other are
not used.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplight.llm.common import kept, map_arrow, stage, text_slices
from samplight.llm.langid import cores

#: Labelled documents of each kind that the model is fitted on, on average.
SAMPLE_DOCS = 2_500
MAX_FEATURES = 2_048
#: How many standard errors apart a feature's shares in toxic and clean documents are, at least.
LEAST_Z = 6.0
LEAST_DOCS = 5
#: A toxic document's grade is 1 plus the number of these that its count of different marked words reaches.
GRADE_AT = (3, 5)
LENGTHS = (4, 5)
STEPS, RATE, RIDGE = 800, 0.05, 2e-5
#: Above this probability of a grade over 0 a document counts as toxic.
LEAST_TOXIC = 0.5


def _grams(word: str) -> set[str]:
    marked = f"^{word}$"
    out = {marked[i : i + n] for n in LENGTHS for i in range(len(marked) - n + 1)}
    out.add(marked)
    return out


#: Documents that have a feature: clean and toxic ones of either half of the sample.
COUNTS = ("clean_0", "clean_1", "toxic_0", "toxic_1")


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch, limit=1 << 20):
            words, code, strings = cores(rows.column("text"))
            kind = [2 * y + half for y, half in zip(rows.column("toxic").to_pylist(), rows.column("half").to_pylist(), strict=True)]
            grams = [_grams(s) if s else set() for s in strings]
            seen = [Counter() for _ in range(4)]
            for i, k in enumerate(kind):
                own = np.unique(code[words.codes[words.offsets[i] : words.offsets[i + 1]]])
                seen[k].update(set().union(*[grams[k] for k in own.tolist()]))
            names = list(set().union(*seen))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[g] for g in names], pa.int64()) for c in seen)], names=["feature", *COUNTS])


class Matcher:
    """Finds features in words."""

    def __init__(self, features: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, f in enumerate(features):
            self.automaton.add_word(f, (k, len(f)))
        if features:
            self.automaton.make_automaton()
        self.any = bool(features)

    def per_text(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature) of every distinct pair, and the different marked words of each text."""
        words, code, strings = cores(column)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(column), np.int64)
        if not self.any or not len(strings):
            return none
        joined = "\n".join(f"^{s}$" for s in strings)
        found = np.array([(end, k) for end, (k, _) in self.automaton.iter(joined)], np.int64).reshape(-1, 2)
        if not len(found):
            return none
        ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)) + 3)
        of_core = np.searchsorted(ends, found[:, 0], side="right")
        order = np.argsort(of_core, kind="stable")
        of_core, feature = of_core[order], found[order, 1]
        first = np.searchsorted(of_core, np.arange(len(strings) + 1))
        marked = first[1:] > first[:-1]
        at = code[words.codes]
        text = np.repeat(np.arange(len(column)), np.diff(words.offsets))[marked[at]]
        pair = np.unique(text * len(strings) + at[marked[at]])
        text, at = pair // len(strings), pair % len(strings)
        n = first[at + 1] - first[at]
        which = feature[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        width = int(feature.max()) + 1
        both = np.unique(np.repeat(text, n) * width + which)
        return both // width, both % width, np.bincount(text, minlength=len(column))


class Model:
    def __init__(self, features: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds, self.key = features, weights, thresholds, uuid.uuid4().hex

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -50, 50)))


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, weights: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge, by Adam: (weights, ordered thresholds)."""
    n_grades = int(max(grades.max(), 1)) + 1
    size = n_features + n_grades - 1
    p = np.zeros(size)
    p[n_features] = 2.0
    first, second = np.zeros(size), np.zeros(size)
    weights = weights / weights.sum()
    n = len(grades)
    lower, upper = grades - 1, grades
    for step in range(1, STEPS + 1):
        gaps = np.exp(p[n_features + 1 :])
        cuts = p[n_features] + np.concatenate(([0], np.cumsum(gaps)))
        s = np.bincount(rows, p[columns], n)
        over = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts - s[:, None], -50, 50))), np.zeros((n, 1))), axis=1)
        slope = over * (1 - over)
        i = np.arange(n)
        chance = np.maximum(over[i, lower + 1] - over[i, upper + 1], 1e-12)
        d_score = -weights * (slope[i, lower + 1] - slope[i, upper + 1]) / chance
        d_cut = np.zeros((n, n_grades + 1))
        d_cut[i, lower + 1] += weights * slope[i, lower + 1] / chance
        d_cut[i, upper + 1] -= weights * slope[i, upper + 1] / chance
        d_cut = d_cut[:, 1:-1].sum(axis=0)
        grad = np.concatenate((np.bincount(columns, d_score[rows], n_features) + RIDGE * p[:n_features], [d_cut.sum()], gaps * np.cumsum(d_cut[::-1])[::-1][1:]))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        p = p - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return p[:n_features], p[n_features] + np.concatenate(([0], np.cumsum(np.exp(p[n_features + 1 :]))))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on about sample_docs toxic and as many clean labelled documents."""
    spark = docs.sparkSession
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model([], np.zeros(0), np.zeros(1))
    rate = {y: min(1.0, sample_docs / n) for y, n in sizes.items()}
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, rate[1] * 1e6).otherwise(rate[0] * 1e6))
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int").alias("half")
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", half), "toxicity-sample")  # about 2 * sample_docs ids
    found = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({y for y, _ in found}) < 2:
        return Model([], np.zeros(0), np.zeros(1))
    counted = map_arrow(sample.select("text", "toxic", "half"), _count_features, "feature string, " + ", ".join(f"{c} long" for c in COUNTS))
    counted = stage(counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in COUNTS]).filter(f"toxic_0 + toxic_1 >= {LEAST_DOCS}"), "toxicity-counts")

    def select(*halves: int) -> list[str]:
        """The features that toxic documents of these halves have far more often than clean ones."""
        n0, n1 = (sum(found.get((y, h), 0) for h in halves) for y in (0, 1))
        if not n0 or not n1:
            return []
        clean, toxic = (sum((F.col(f"{y}_{h}") for h in halves), F.lit(0)) for y in ("clean", "toxic"))
        share = (toxic + clean) / F.lit(n0 + n1)
        apart = (toxic / n1 - clean / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n0 + 1 / n1))
        best = counted.withColumn("z", apart).filter((F.col("z") >= LEAST_Z) & (toxic >= LEAST_DOCS)).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
        return [r["feature"] for r in best.select("feature", "z").collect()]

    features = select(0, 1)
    if not features:
        return Model([], np.zeros(0), np.zeros(1))
    shared = spark.sparkContext.broadcast((features, select(1), select(0)))  # those of the other half by half

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(f) for f in shared.value]
        for batch in batches:
            for rows in text_slices(batch):
                text, feature, _ = matchers[0].per_text(rows.column("text"))
                others = np.stack([m.per_text(rows.column("text"))[2] for m in matchers[1:]])
                marked = others[np.asarray(rows.column("half")), np.arange(rows.num_rows)]
                cut = np.searchsorted(text, np.arange(rows.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("toxic"), pa.array(marked), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(feature.astype(np.int32)))],
                    names=["doc_id", "toxic", "marked", "features"],
                )

    got = map_arrow(sample, found_in, "doc_id long, toxic int, marked long, features array<int>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["features"]))
    rows = np.repeat(np.arange(len(got)), [len(r["features"]) for r in got])
    columns = np.array([f for r in got for f in r["features"]], np.int64)
    grades = np.array([r["toxic"] * (1 + sum(r["marked"] >= g for g in GRADE_AT)) for r in got], np.int64)
    weights = np.array([1 / rate[r["toxic"]] for r in got])
    return Model(features, *fit(rows, columns, grades, weights, len(features)))


def _matcher(model: Model) -> Matcher:
    return kept(("toxicity", model.key), lambda: Matcher(model.features))


def grade(docs: DataFrame, model: Model, least_toxic: float = LEAST_TOXIC) -> DataFrame:
    """doc_id, expected_severity, severity (likeliest grade), p_toxic, toxic for every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES short strings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows in text_slices(batch):
                text, feature, _ = _matcher(model).per_text(rows.column("text"))
                scores = np.bincount(text, model.weights[feature], rows.num_rows) if len(text) else np.zeros(rows.num_rows)
                over = model.above(scores) if model.features else np.zeros((rows.num_rows, 1))
                each = -np.diff(np.concatenate((np.ones((rows.num_rows, 1)), over, np.zeros((rows.num_rows, 1))), axis=1), axis=1)
                out = [rows.column("doc_id"), pa.array(over.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0]), pa.array(over[:, 0] > least_toxic)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "expected_severity", "severity", "p_toxic", "toxic"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, expected_severity double, severity int, p_toxic double, toxic boolean")

"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and the unlabelled corpus are compared; labelled negatives aren't used. With the logistic loss the unbiased risk  prior * E_P[l(f) - l(-f)] + E_U[l(-f)]  is convex
(l(f) - l(-f) = -f), so Newton steps minimise it: each step is one pass over the feature table, whose
partial sums are added up by block before they reach the driver. A step is shortened, and the fit ends,
where the implied risk of negatives  E_U[l(-f)] - prior * E_P[l(-f)]  would fall below zero.

A text's features are its shape (length, capitals, marks, repetition ...), cut at the corpus's quantiles.
Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import bounded_batches, discard, durable, plain_text
from lectern.llm._tokens import chunks, slices, small, words_of

FEATURES = (
    "log_bytes", "log_words", "mean_word", "capitals", "digits", "symbols", "shouts", "marks", "wide", "distinct_words",
    "distinct_triples", "lines", "words_a_line", "repeated_lines", "longest_word", "capital_words",
)
QUANTILES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
#: Weight decay of the first fit; it is lowered by LOWER as long as the fit stays free of a negative risk.
RIDGE, LOWER, ROUNDS, STEPS = 0.1, 2.0, 12, 3
BLOCKS = 16

# classes of bytes: 0 other letter, 1 space, 2 line end, 3 capital, 4 digit, 5 symbol, 6 shout, 7 mark, 8 wide
_CLASS = np.zeros(256, np.int64)
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 7
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[33] = 6
_CLASS[128:] = 8


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` a text."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for a, b in chunks(texts):
        part = texts[a:b]
        sizes = np.array([len(x) for x in part])
        counts = _byte_classes(part, sizes)
        found = words_of(part, shape=True)
        words = np.diff(found.bounds).astype(float)
        some, letters = np.maximum(words, 1), np.maximum(counts[:, 0] + counts[:, 3] + counts[:, 8] / 2, 1)
        for k, text in enumerate(part):
            i, j = found.bounds[k], found.bounds[k + 1]
            own = found.hashes[i:j]
            triples = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)
            lines, different = _lines(text)
            out[a + k] = (
                np.log1p(sizes[k]), np.log1p(words[k]), (sizes[k] - counts[k, 1] - counts[k, 2]) / some[k], counts[k, 3] / letters[k],
                counts[k, 4] / max(sizes[k], 1), counts[k, 5] / some[k], counts[k, 6] / some[k], counts[k, 7] / some[k], counts[k, 8] / max(sizes[k], 1),
                len(np.unique(own)) / some[k], len(np.unique(triples)) / max(j - i - 2, 1), np.log1p(lines),
                words[k] / max(lines, 1), 1 - different / max(lines, 1), found.lengths[i:j].max(initial=0),
                found.shouted[i:j].sum() / some[k],
            )
    return out


def _byte_classes(texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """How many bytes of each class every text has."""
    if len(texts) == 1:  # a text of any length, slice by slice
        data = np.frombuffer(texts[0], np.uint8)
        return sum((np.bincount(_CLASS[data[a:b]], minlength=9) for a, b in slices(data)), np.zeros(9, np.int64))[None, :].astype(float)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return np.bincount(owner * 9 + _CLASS[np.frombuffer(b"".join(texts), np.uint8)], minlength=9 * len(texts)).reshape(-1, 9).astype(float)


def _lines(text: bytes) -> tuple[int, int]:
    """How many lines a text has that aren't blank, and how many different ones."""
    n, seen = 0, set()
    for line in io.BytesIO(text):
        if line.strip():
            n += 1
            seen.add(hash(line.rstrip(b"\n")))
    return n, len(seen)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, x)."""
    for batch in small(batches):
        x = features(batch.column(1).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["id", "x"])


@dataclass
class QualityModel:
    """Cut points of each feature, and the weight of each interval."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def columns(self, x: np.ndarray) -> np.ndarray:
        """The columns that are 1 in each row: one a feature, for its interval, and the last, which always is."""
        at = np.cumsum([0] + [len(cut) + 1 for cut in self.cuts[:-1]])
        each = [first + np.searchsorted(cut, x[:, k], side="left") for k, (first, cut) in enumerate(zip(at, self.cuts))]
        return np.stack([*each, np.full(len(x), len(self.weights) - 1)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[self.columns(x)].sum(axis=1), -30, 30)))


def _sums(model: QualityModel):
    """Rows (is_positive, x) to one row of partial sums: gradient, curvature, losses, counts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.weights)
        total = np.zeros(d * d + 2 * d + 4)
        for batch in batches:
            if not batch.num_rows:
                continue
            positive = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            on = model.columns(batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)))
            f = np.clip(model.weights[on].sum(axis=1), -30, 30)
            p = 1 / (1 + np.exp(-f))
            loss = np.logaddexp(0, f)  # l(-f)
            for k in range(on.shape[1]):  # row by row of the curvature, by pairs of columns that are 1 together
                pairs = on[:, k : k + 1] * d + on
                total[: d * d] += np.bincount(pairs.ravel(), np.repeat(p * (1 - p), on.shape[1]), minlength=d * d)
            total[d * d : d * d + d] += np.bincount(on.ravel(), np.repeat(p, on.shape[1]), minlength=d)
            total[d * d + d : d * d + 2 * d] += np.bincount(on[positive].ravel(), minlength=d)
            total[-4:] += (loss.sum(), loss[positive].sum(), len(f), positive.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return sums


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            own = np.frombuffer(x)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _pass(table: DataFrame, model: QualityModel, ridge: float = 0.0) -> dict[str, np.ndarray]:
    partial = table.select("positive", "x").mapInArrow(_sums(model), "sums binary")
    blocks = partial.repartition(BLOCKS).mapInArrow(_added, "sums binary").collect()  # BLOCKS rows at most
    total = sum(np.frombuffer(r["sums"]) for r in blocks)
    d = len(model.weights)
    unlabelled_loss, positive_loss, n, positives = total[-4:]
    return {
        "curve": total[: d * d].reshape(d, d) / n, "slope": total[d * d : d * d + d] / n, "positive": total[d * d + d : d * d + 2 * d] / max(positives, 1),
        "negative_risk": unlabelled_loss / n - model.prior * positive_loss / max(positives, 1), "positives": positives, "n": n,
        "risk": unlabelled_loss / n - model.prior * float(model.weights @ total[d * d + d : d * d + 2 * d]) / max(positives, 1) + ridge / 2 * float(model.weights @ model.weights),
    }


def fit(table: DataFrame, prior: float | None) -> QualityModel | None:
    """Fits on rows (positive, x); ``prior``: the share of positives in the corpus, None: estimated.

    The estimate is the least ratio of the corpus's share to the positives' share over the intervals
    that hold a fair part of the positives: there the corpus has hardly any negatives. Without positives
    there is no model.
    """
    cuts = table.select(*[F.percentile_approx(F.element_at("x", k + 1), list(QUANTILES), 2000).alias(f"q{k}") for k in range(len(FEATURES))]).first()
    if cuts is None or cuts[0] is None:
        return None
    cuts = [np.unique(np.array(c, np.float32)) for c in cuts]
    d = sum(len(c) + 1 for c in cuts) + 1
    model = QualityModel(cuts, np.zeros(d), prior or 0.5)
    now = _pass(table, model)
    if not now["positives"]:
        return None
    if prior is None:
        share = 2 * now["slope"]  # at weight 0 each row counts a half
        fair = now["positive"] > 0.08
        model.prior = float(np.clip((share[fair] / now["positive"][fair]).min(), 0.02, 0.98))

        now = _pass(table, model)
    ridge = RIDGE
    for _ in range(ROUNDS):
        own = (model, _pass(table, model, ridge))
        for _ in range(STEPS):
            last, at = own
            slope = at["slope"] - last.prior * at["positive"] + ridge * last.weights
            tried = QualityModel(cuts, last.weights - np.linalg.solve(at["curve"] + ridge * np.eye(d), slope), last.prior)
            own = (tried, _pass(table, tried, ridge))
            if at["risk"] - own[1]["risk"] < 1e-4:
                break
        if own[1]["negative_risk"] < 0:
            break
        model = own[0]
        ridge /= LOWER
    return model


def labelled(table: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Adds ``label`` (null: none) to rows with ``id``; of repeated labels the largest counts."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    return table.join(own, F.col("id") == F.col("__id"), "left").drop("__id")


def held_out(id_column):
    return F.coalesce(F.pmod(F.crc32(F.encode(id_column.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def _fit_on(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> QualityModel | None:
    rows = labelled(measured.where(~held_out(F.col("id"))), labels, id_col, label_col).select(F.coalesce(F.col("label") == 1, F.lit(False)).alias("positive"), "x")
    learn = durable(rows, "pu-rows")
    model = fit(learn, None)
    discard(learn)
    return model


def _measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("text"))
    return named.mapInArrow(_measured, f"id {named.schema['id'].dataType.simpleString()}, x array<float>")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if score >= threshold).

    Fits on the rows that are not held out (crc32 of the id as text, modulo 5, is not 0), all of them as
    unlabelled text and those labelled 1 as positives. Null and empty texts have a score like any other;
    a null id is never held out and never labelled. With no positive label every score is 0.5. Labels
    that are neither 0 nor 1 are ignored. Rows that repeat an id or a text are rows of their own; equal
    texts score alike. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    measured = durable(_measure(docs, id_col, text_col), "pu-features")
    model = _fit_on(measured, labels, id_col, label_col)

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy().reshape(-1, len(FEATURES))) if model and len(x) else np.full(len(x), 0.5))

    scored = measured.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, with all columns, that score ``threshold`` or more; nothing is shuffled for it.

    Null and empty texts are scored and judged like any other, rows that repeat an id or a text each by
    themselves; ties with the threshold stay. Learning is as in :func:`quality_scores`; without a
    positive label all rows stay. An empty table gives an empty result. The texts go to Python in bounded
    batches, and so do those of later queries of the session.
    """
    bounded_batches(docs.sparkSession)
    measured = durable(_measure(docs, id_col, text_col), "pu-features")
    model = _fit_on(measured, labels, id_col, label_col)
    discard(measured)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model is None or not len(text):
            return pa.array(np.full(len(text), 0.5))
        parts = small([pa.RecordBatch.from_arrays([text.cast(pa.binary())], ["text"])])
        return pa.array(np.concatenate([model.score(features(x.column(0).to_pylist())) for x in parts]))

    return docs.where(score(plain_text(F.col(text_col))) >= threshold)

"""Quality scores by a naive Bayes support vector machine.

A document's features are indicators of n-grams: runs of one to three characters by class (letters by case,
digits, punctuation by kind), runs of up to four words by whether each repeats the one before it, hashed words and hashed
pairs of words. Each indicator is scaled by the logarithm of the ratio of the two classes' smoothed document
counts; a linear hinge-loss model on the scaled indicators is fitted by dual coordinate descent, and its margin
is turned into a probability by a logistic curve fitted on labelled rows that the margin hasn't seen.

The class counts cover all labelled rows. The model is fitted on a sample of at most SAMPLE labelled rows, chosen
by a hash of the id; a fit takes memory for those only. Scores depend on the text alone.

Defined cases: a null text is an empty one and is scored (by the bias and nothing else); a document labelled more
than once counts with its lowest label, null labels don't count; without labels of both classes the score is the
share of label 1, or 0.5 without labels; repeated rows are scored alike, and each counts where its doc_id is labelled;
an empty table of documents gives no rows; extra columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetweave.llm.common import arrow_limits, unused
from assetweave.llm.shingles import BASE, buffers, mixed, word_hashes

#: Most labelled rows that the hinge-loss model is fitted on.
SAMPLE = 6_000
#: Labels up to this number are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 500_000
THRESHOLD = 0.7
SMOOTHING = 1.0
PENALTY = 0.1
EPOCHS = 12

#: Character classes: a number for each ASCII byte; 3 to 6 are small and capital letters, digits, other bytes.
KINDS = [" ", "\n\t\r\x0b\x0c", "a-z", "A-Z", "0-9", "other", ".", ",", ";:", "!", "?", "'\"`", "-_", "()[]{}", "/\\", "|", "*", "#", "%", "&", "$", "@", "+=~^", "<>"]
CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(KINDS, 1):
    if _k not in (3, 4, 5, 6):
        CLASS[[ord(c) for c in _chars]] = _k
CLASS[ord("a") : ord("z") + 1], CLASS[ord("A") : ord("Z") + 1], CLASS[ord("0") : ord("9") + 1], CLASS[128:] = 3, 4, 5, 6

SHAPES = 32 + 32**2 + 32**3
REPEATS = 2 + 4 + 8 + 16
#: Words and pairs of words are hashed to so many numbers each.
HASHED = 1 << 17
FEATURES = SHAPES + REPEATS + 2 * HASHED
#: Rows for which one table of indicators is kept.
ROWS = 200


def _indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, at = buffers(texts)
    rows, wide = len(at) - 1, SHAPES + REPEATS + 1
    small = np.zeros(rows * wide, bool)  # the last column takes runs that would go over a row's end
    if len(raw):
        base = np.repeat(np.arange(rows) * wide, np.diff(at))
        ends = at[1:][np.diff(at) > 0] - 1
        kind = CLASS[raw].astype(np.int32)
        small[base + kind] = True
        run, low = kind, 32
        for n in (2, 3):
            run = run[:-1] * 32 + kind[n - 1 :]
            place = base[: len(run)] + (low + run)
            for back in range(n - 1):
                over = ends - back
                over = over[(over >= 0) & (over < len(run))]
                place[over] = base[over] + wide - 1
            small[place] = True
            low += 32**n
    words, word_at = word_hashes(texts)
    row = np.repeat(np.arange(rows), np.diff(word_at))
    big = np.empty(0, np.int64)
    if len(words):
        again = np.zeros(len(words), np.int64)
        again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        low, pattern = SHAPES, again
        for n in range(1, 5):
            if n > 1:
                pattern = pattern[:-1] * 2 + again[n - 1 :]
            inside = row[: len(pattern)] == row[n - 1 :]
            small[row[: len(pattern)][inside] * wide + low + pattern[inside]] = True
            low += 2**n
        inside = row[1:] == row[:-1]
        pairs = mixed(words[:-1][inside] * BASE + words[1:][inside])
        hashed = [(words % np.uint64(HASHED)).astype(np.int64), (pairs % np.uint64(HASHED)).astype(np.int64) + HASHED]
        big = np.unique(np.concatenate([row, row[1:][inside]]) * (2 * HASHED) + np.concatenate(hashed))
    on = np.flatnonzero(small)
    r, c = np.divmod(on, wide)
    own = c < wide - 1
    return np.concatenate([r[own], big // (2 * HASHED)]), np.concatenate([c[own], big % (2 * HASHED) + SHAPES + REPEATS])


def indicators(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Steps of some rows: the first row, and the (row in the step, feature) pairs that are on."""
    for low in range(0, len(texts), ROWS):
        yield low, *_indicators(texts[low : low + ROWS])


def features(texts: pa.Array) -> list[np.ndarray]:
    """The features that are on in each text."""
    out = []
    for low, row, feature in indicators(texts):
        order = np.lexsort((feature, row))
        n = min(ROWS, len(texts) - low)
        out += np.split(feature[order], np.searchsorted(row[order], np.arange(1, n)))
    return out


@dataclass
class Model:
    """weight has the log-count ratio multiplied in; square is the ratio's square, for the length of a row."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for low, row, feature in indicators(texts):
            n = min(ROWS, len(texts) - low)
            total = np.bincount(row, self.weight[feature], minlength=n)
            length = np.sqrt(np.bincount(row, self.square[feature], minlength=n))
            out[low : low + n] = total / np.maximum(length, 1.0)
        return out + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def hinge_fit(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, size: int, epochs: int = EPOCHS, enough: float = 1e-4) -> tuple[np.ndarray, float]:
    """L1-loss linear support vector machine by dual coordinate descent; classes weigh the same in all.

    rows: features and their values of each document. Steps go through the documents in a fixed shuffled order.
    """
    share = {s: len(sign) / (2 * max(1, (sign == s).sum())) for s in (-1, 1)}
    top = np.array([PENALTY * share[s] for s in sign])
    square = np.array([float(v @ v) + 1 for _, v in rows])
    dual, weight, bias = np.zeros(len(rows)), np.zeros(size), 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            f, v = rows[i]
            slope = sign[i] * (weight[f] @ v + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), top[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weight[f] += step * v
                bias += step
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < enough:
            break
    return weight, bias


def logistic_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with smoothed targets."""
    good, bad = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(at[0], 1e-6)), float(at[1])


def scaled(ratio: np.ndarray, documents: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features of each document that have a ratio, and these ratios over the row's length where that is over 1.

    All rows are views of two arrays, so that they take eight bytes a feature and go at once.
    """
    most = sum(len(f) for f in documents)
    flat, value, rows, end = np.empty(most, np.int32), np.empty(most, np.float32), [], 0
    for f in documents:
        f = f[ratio[f] != 0]
        v = ratio[f]
        start, end = end, end + len(f)
        flat[start:end], value[start:end] = f, v / max(float(np.sqrt(v @ v)), 1.0)
        rows.append((flat[start:end], value[start:end]))
    return rows


def fit_rows(ratio: np.ndarray, documents: list[np.ndarray], label: np.ndarray) -> Model:
    """The model from the log-count ratios and the sampled documents' features."""
    rows = scaled(ratio, documents)
    sign = np.where(label == 1, 1, -1)
    # margins for the logistic curve come from models that haven't seen the rows
    margin, fold = np.zeros(len(rows)), np.arange(len(rows)) % 3
    for k in range(3):
        own = np.flatnonzero(fold == k)
        rest = np.flatnonzero(fold != k)
        if len(own) and len(set(sign[rest])) == 2:
            w, b = hinge_fit([rows[i] for i in rest], sign[rest], len(ratio))
            margin[own] = [w[rows[i][0]] @ rows[i][1] + b for i in own]
    weight, bias = hinge_fit(rows, sign, len(ratio))
    slope, shift = logistic_fit(margin, label)
    return Model(weight * ratio, ratio**2, bias, slope, shift)


def labelled(docs: DataFrame, labels: DataFrame, keep: Column) -> DataFrame:
    """doc_id, text and label (0 or 1) of the documents with labels for which keep holds."""
    own = labels.where(keep & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    if own.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return docs.select("doc_id", "text").join(own, "doc_id")


def class_counts(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents of either label that have each feature, over all rows; and the documents of either label."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch["label"].to_numpy(zero_copy_only=False)
            docs += np.bincount(label, minlength=2)
            for low, row, feature in indicators(batch["text"]):
                for k in (0, 1):
                    total[k] += np.bincount(feature[label[row + low] == k], minlength=FEATURES)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[0][seen], docs[0])), pa.array(np.append(total[1][seen], docs[1]))], names=["feature", "n0", "n1"])

    found = rows.mapInArrow(counts, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    feature, n0, n1 = (found[c].to_numpy() for c in ("feature", "n0", "n1"))
    own, table = feature >= 0, np.zeros((2, FEATURES))
    table[0][feature[own]], table[1][feature[own]] = n0[own], n1[own]
    return table, int(n0[~own].sum()), int(n1[~own].sum())


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, sample: int = SAMPLE) -> Model:
    """The model from the labelled documents for which keep, a condition on labels, holds."""
    arrow_limits(docs.sparkSession)
    rows = labelled(docs, labels, F.lit(True) if keep is None else keep)
    table, bad, good = class_counts(rows)
    if not bad or not good:
        share = good / (bad + good) if bad + good else 0.5
        none = np.zeros(FEATURES)
        return Model(none, none, 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    ratio = np.log((table[1] + SMOOTHING) / (good + 2 * SMOOTHING)) - np.log((table[0] + SMOOTHING) / (bad + 2 * SMOOTHING))
    ratio[table.sum(axis=0) == 0] = 0
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f.astype(np.int32).tobytes() for f in features(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(rows, pa.binary())], names=["doc_id", "label", "features"])

    got = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "label", "text").mapInArrow(on, "doc_id long, label int, features binary").toArrow().combine_chunks()
    # views of what has come; rows of one doc_id in the order of their features
    sets = [np.frombuffer(x.as_buffer(), np.int32) for x in got["features"]]
    ids, label = got["doc_id"].to_pylist(), got["label"].to_numpy()
    several = len(set(ids)) < len(ids)
    order = sorted(range(len(ids)), key=lambda k: (ids[k], sets[k].tobytes() if several else b""))
    return fit_rows(ratio, [sets[k] for k in order], label[order])


def score(text: Column, model: Model) -> Column:
    """The probability that a text has label 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(pa.Array.from_pandas(texts, type=pa.large_string())), dtype=float)

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that the model never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model from the rows that aren't held out."""
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier doesn't reject."""
    model = train(docs, labels)
    # one evaluation of the score per row: the filter is on the projected column
    (own,) = unused(docs, "score")
    return docs.withColumn(own, score(F.col("text"), model)).where(F.col(own) >= THRESHOLD).select(*docs.columns)

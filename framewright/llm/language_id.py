"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to ``MAX_N`` letters of the lower-cased text; all
other characters count as one blank. A feature's value is its share of the text's
n-grams, times its inverse document frequency, times ``SCALE``. Weights are learned
one document at a time with follow-the-regularised-leader (FTRL-proximal) with
elastic-net penalties, on a sample of about ``sample_rows`` labelled documents, taken by
hash of id and text: the same share of each language, but more of rare ones, so that
each has a quarter of an equal share (all its rows if it has fewer). Document frequencies are counted over all labelled
training documents. A temperature, fitted on a part of the sample that is not
learned from, calibrates the probabilities.

Only the per-feature counts (a fixed 2^BITS), the sample's sparse features and the
model pass through the driver. Prediction is narrow: no shuffle.

Defined cases: a text that is null or has no letter gets ``und`` with score 0. If no
labelled document with letters exists, every text gets ``und``. With one language
only, every other text gets it, with score 1. Null labels are not learned from;
ties between languages go to the first in order. Rows are predicted one by one,
so repeated rows agree. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import worker

BITS, MAX_N, SCALE = 15, 3, 100.0
SIZE = 1 << BITS
#: Characters of text handled at a time in one task.
CHUNK = 1 << 20

def _codes() -> np.ndarray:
    """A code for each code point: 0 for all that is not a letter."""
    kept = worker.store("language_id")
    if "letters" not in kept:
        points = np.arange(0x110000, dtype=np.uint32)
        known = np.fromiter((0xD800 <= p < 0xE000 or chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        known[0xD800:0xE000] = False
        kept["letters"] = np.where(known, points * np.uint32(2654435761) | np.uint32(1), 0).astype(np.uint32)
    return kept["letters"]


def text_codes(text: str) -> np.ndarray:
    """Letter codes of one text, lower-cased, with runs of other characters as single zeros and a zero at each end."""
    codes = _codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([codes, np.zeros(1, np.uint32)])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return np.concatenate([np.zeros(1, np.uint32), codes[keep] if codes[0] else codes[keep][1:]])


def gram_ids(codes: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the n-grams that start at each place, for n from 1 to MAX_N; codes end in MAX_N zeros."""
    out, mixed = [], np.zeros(len(codes), np.uint32)
    for n in range(MAX_N):
        mixed = mixed * np.uint32(0x9E3779B1) + np.roll(codes, -n)
        mixed ^= mixed >> np.uint32(15)
        out.append(((mixed * np.uint32(0x85EBCA6B)) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(32 - BITS))
    return out


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts, grouped to about CHUNK characters."""
    group, size = [], 0
    for k, text in enumerate(texts):
        group.append(k)
        size += len(text)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def sparse_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, ascending, and their shares; empty if the text has no letter."""
    codes = text_codes(text)
    n = len(codes)
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.concatenate([g[:n] for g in gram_ids(np.concatenate([codes, np.zeros(MAX_N, np.uint32)]))])
    counts = np.bincount(ids, minlength=SIZE)
    at = np.flatnonzero(counts)
    return at, counts[at] / n


@dataclass
class Model:
    """Weights with the inverse document frequencies multiplied in, biases, and the temperature."""

    languages: list[str]
    weights: np.ndarray  # language x feature
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ shares + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language and the calibrated probability of each text."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for group in _groups(texts):
            codes = [text_codes(texts[k]) for k in group]
            some = [k for k, c in zip(group, codes, strict=True) if c.any()]
            codes = [c for c in codes if c.any()]
            if not some:
                continue
            pad = np.zeros(MAX_N, np.uint32)
            flat = np.concatenate([x for c in codes for x in (c, pad)])
            lengths = np.array([len(c) for c in codes])
            starts = np.concatenate([[0], np.cumsum(lengths + MAX_N)[:-1]])
            edges = np.stack([starts, starts + lengths], 1).ravel()
            edges = edges[:-1] if edges[-1] >= len(flat) else edges
            sums = np.zeros((len(self.languages), len(some)))
            for ids in gram_ids(flat):
                for c, row in enumerate(self.weights):
                    sums[c] += np.add.reduceat(row[ids], edges)[::2]
            z = (sums / lengths + self.bias[:, None]) / self.temperature
            z = np.exp(z - z.max(0))
            p = z / z.sum(0)
            for j, k in enumerate(some):
                best = int(np.argmax(p[:, j]))
                names[k], scores[k] = self.languages[best], float(p[best, j])
        return names, scores


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by FTRL-proximal with elastic-net penalties; rows are (features, values, class)."""
    z, n = np.zeros((classes, SIZE)), np.zeros((classes, SIZE))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def solve(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, values, label in rows:
            w, b = solve(z[:, at], n[:, at], l1), solve(zb, nb, 0.0)
            s = w @ values + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = p[:, None] * values
            step = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - step * w
            n[:, at] += g * g
            step = (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha
            zb += p - step * b
            nb += p * p
    return solve(z, n, l1), solve(zb, nb, 0.0)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search.

    Labels are smoothed by one row in all, so that a sample without errors does not
    give boundless confidence.
    """
    if not len(labels):
        return 1.0

    smooth = 1 / (len(labels) + 2)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        told = (1 - smooth) * z[np.arange(len(labels)), labels] + smooth * z.mean(1)
        return float(np.mean(np.log(np.exp(z).sum(1)) - told))

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    @worker.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(SIZE, np.int64), 0, np.zeros(SIZE, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes = text_codes(text)
                if not codes.any():
                    continue
                n += 1
                for ids in gram_ids(np.concatenate([codes, np.zeros(MAX_N, np.uint32)])):
                    seen[ids[: len(codes)]] = True
                at = np.flatnonzero(seen)
                df[at] += 1
                seen[at] = False
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "n"])

    rows = docs.select(text_col).filter(F.col(text_col).isNotNull()).mapInArrow(run, "feature long, n long")
    found = dict(rows.groupBy("feature").agg(F.sum("n")).collect())
    df = np.zeros(SIZE)
    for k, v in found.items():
        if k >= 0:
            df[k] = v
    return df, int(found.get(-1, 0) or 0)


def shares(counts: dict[str, int], sample_rows: int) -> dict[str, float]:
    """The share of each language's rows to sample: sample_rows in all, and at least a quarter of an equal part of each."""
    total = sum(counts.values())
    least = -(-sample_rows // (4 * max(1, len(counts))))
    return {k: min(1.0, max(sample_rows / total, least / n)) for k, n in counts.items() if n}


def _sample(docs: DataFrame, share: dict[str, float], id_col: str, text_col: str, label_col: str) -> list[tuple[np.ndarray, np.ndarray, str]]:
    @worker.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sparse_features(x) for x in batch.column(0).to_pylist()]
            at = pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([at, pa.array([v for _, v in found], pa.list_(pa.float64())), batch.column(1), batch.column(2).cast(pa.string())], ["at", "shares", "label", "id"])

    if not share:
        return []
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    limit = F.try_element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col(label_col).cast("string"))
    made = docs.filter(place < limit).select(text_col, label_col, F.col(id_col).alias("_id")).mapInArrow(run, "at array<int>, shares array<double>, label string, id string")
    rows = sorted(made.collect(), key=lambda r: (len(r["id"] or ""), r["id"] or "", r["label"], r["at"], r["shares"]))
    return [(np.array(r["at"], np.int64), np.array(r["shares"]), r["label"]) for r in rows if r["at"]]


def train(docs: DataFrame, sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from the labelled rows of docs."""
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    df, n = _document_frequencies(labelled, text_col)
    counts = {str(r[0]): r[1] for r in labelled.groupBy(label_col).count().collect()}  # one row a language
    rows = _sample(labelled, shares(counts, sample_rows), id_col, text_col, label_col)
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((0, SIZE)), np.zeros(0))
    idf = SCALE * (np.log((1 + n) / (1 + df)) + 1)
    data = [(at, shares * idf[at], languages.index(label)) for at, shares, label in rows]
    held = [r for k, r in enumerate(data) if k % 5 == 4]
    weights, bias = ftrl([r for k, r in enumerate(data) if k % 5 != 4], len(languages))
    logits = np.array([weights[:, at] @ v + bias for at, v, _ in held]).reshape(len(held), len(languages))
    temperature = calibrate(logits, np.array([r[2] for r in held], np.int64))
    return Model(languages, weights * idf, bias, temperature)


def predict(docs: DataFrame, model: Model, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row: the columns to keep, lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights a language

    @worker.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.predict([x or "" for x in batch.column(batch.num_columns - 1).to_pylist()])
            kept = [batch.column(k) for k in range(len(id_cols))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*id_cols, "lang_pred", "score"])

    source = docs.select(*id_cols, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[:-1])
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo folds, is fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))

"""Quality scores learned from preferences by a Bradley-Terry model.

A pair of labelled documents, one good and one bad, is a preference; the model is a logistic regression without an
intercept on the difference of the two feature vectors, fitted by Newton's method. A document's strength is the
weighted sum of its features. The threshold is the quantile of the training documents' strengths that separates the
labels best; strengths become scores by a logistic curve that passes through the accepted score at that threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenfold.llm.common import lean, ship

MARKS = b".,;:!?|%*#&$@/\\<>=+-_~^(){}[]'\"`"
LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.zeros(256, np.int64)  # other control bytes
_CLASS[ord(" ")], _CLASS[ord("\n")] = 1, 2
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 3, 4, 5, 6
for _i, _b in enumerate(MARKS):
    _CLASS[_b] = 7 + _i
N_CLASSES = 7 + len(MARKS)
#: Places that the byte trigrams of a text are hashed to.
TRIGRAMS = 256
N_FEATURES = 2 * N_CLASSES + 12 + TRIGRAMS
#: Hashed trigrams count for so much less than the measures: a few labelled rows would fit them by chance.
CAUTION = 10.0
#: Preferences that ``fit`` expands to differences at once.
PAIRS_AT_ONCE = 4096


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, of capitals as of small letters; zeros where there are none."""
    low = raw.astype(np.uint32)
    low[(low >= 65) & (low <= 90)] += 32
    code = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(24)
    return np.sqrt(np.bincount(code, minlength=TRIGRAMS) / max(1, len(code)))


def features(text: str) -> np.ndarray:
    """Shares of byte classes (and their square roots, for rare marks), measures of words and lines, and hashed byte trigrams; all of
    the whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    share = np.bincount(_CLASS[raw], minlength=N_CLASSES) / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    counts = len(set(words)) / n
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    ends = np.fromiter((not w[-1].isalnum() for w in words), bool, len(words)) if words else np.zeros(1, bool)
    heads = sum(w[0].isupper() for w in words) / n
    bare = sum(not LETTER.search(w) for w in set(words)) / n
    full = [x for x in lines if x]
    more = [np.log1p(len(raw)), np.log1p(len(words)), counts, counts * np.log1p(n), sizes.mean(), sizes.std(), sizes.max() ** 0.25, ends.mean(), heads, bare, len(set(full)) / max(1, len(full)), np.log1p(len(raw) / max(1, len(full)))]
    return np.concatenate([share, np.sqrt(share), more, trigrams(raw)])


@dataclass
class Ranking:
    """Weights on centred and scaled features, the threshold among strengths, and the score it is given."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    accept: float
    slope: float = 1.0

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        base = np.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strengths(x) - self.threshold) + base, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, accept: float = 0.3, pairs: int = 60_000, penalty: float = 3.0, seed: int = 5) -> Ranking:
    """Learn from ``pairs`` drawn preferences. With one label only (or none) every document is accepted alike."""
    d = x.shape[1]
    if not good.any() or good.all():
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0 if good.all() else 1.0, accept)
    centre, scale = x.mean(0, dtype=float), np.sqrt(x.var(0, dtype=float)) + 1e-6
    scale[-TRIGRAMS:] *= CAUTION if d == N_FEATURES else 1.0
    z = np.empty(x.shape, np.float32)
    for i in range(0, len(x), PAIRS_AT_ONCE):
        z[i : i + PAIRS_AT_ONCE] = np.clip((x[i : i + PAIRS_AT_ONCE] - centre) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    better, worse = draw.choice(np.flatnonzero(good), pairs), draw.choice(np.flatnonzero(~good), pairs)
    w = np.zeros(d)
    for _ in range(30):
        gradient, hessian = -penalty * w, penalty * np.eye(d)
        for i in range(0, pairs, PAIRS_AT_ONCE):
            diff = z[better[i : i + PAIRS_AT_ONCE]].astype(float) - z[worse[i : i + PAIRS_AT_ONCE]]
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            gradient += diff.T @ (1 - p)
            hessian += (diff * (p * (1 - p))[:, None]).T @ diff
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # The quantile at which the two labels' rates of error sum to the least.
    cuts = np.quantile(s, np.linspace(0, 1, 1001))
    bad = np.sort(s[~good]).searchsorted(cuts) / (~good).sum()
    lost = np.sort(s[good]).searchsorted(cuts) / good.sum()
    best = np.flatnonzero(bad - lost >= (bad - lost).max() - 1e-9)
    return Ranking(centre, scale, w, float(cuts[best].mean()), accept)


def fold(id_col: str):
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t or "").astype(np.float32).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "x"])

    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(lean(run), f"id {dict(docs.dtypes)[id_col]}, x binary")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, accept: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Fit on at most ``max_labelled`` labelled rows outside fold 0, chosen by a hash of their ids: the bound on what the
    driver gets (that many feature vectors) and on what is broadcast (that many ids and labels)."""
    ship(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    rows = feature_rows(picked.select(F.struct("id", "label").alias("key"), "text"), "key", "text").select("id.id", "id.label", "x").orderBy("id").collect()
    good = np.array([r.label == 1 for r in rows], bool)
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), N_FEATURES)
    del rows
    return fit(x, good, accept)


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``score`` double appended (an input column of that name is replaced); null texts score as empty ones."""
    ship(docs.sparkSession)
    base = docs.drop("score")
    at = base.columns.index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or "") for t in b.column(at).to_pylist()]).reshape(len(b), N_FEATURES)
            yield b.append_column("score", pa.array(model.value.scores(x)))

    return base.mapInArrow(lean(run), ", ".join(f"`{c}` {t}" for c, t in base.dtypes) + ", score double")

"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text are enough: the model
minimises the non-negative unbiased risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
stepping back on the second term when it turns negative. The class prior is
estimated from the same data by the best-bin rule: over thresholds of a
classifier of positives against unlabelled, the least ratio of the two
upper-tail shares, each with its deviation bound. Labels 0 are never read.

A text becomes some twenty shape statistics (character classes, word and line
repetition, lengths), none of them language or source; each is cut into
quantile bins and the score is a logistic sum of bin weights. Fitting uses a
bounded sample (`max_positives`, `max_unlabelled`, the rows with the
smallest hashed id); scoring reads every whole text in one pass, without a shuffle.

Defined cases: a null or empty text is scored as the empty text; other columns
(also of clashing names) are ignored; repeated rows get equal scores; a null doc_id
is scored, never trained on, and not held out; of an id on several rows the fit takes
one, that of the smallest statistics, so its limits hold for rows; texts of any length are read whole. Without any positive the
score is the prior 0.5 for all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from dualspace.llm.common import text_or_empty

THRESHOLD = 0.7
MAX_POSITIVES = 12_000
MAX_UNLABELLED = 24_000
N_BINS = 24

_CLASSES = {  # byte classes whose share of the text is a feature
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "newline": [10], "blank": [9, 11, 12, 13, 32],
    "symbol": b"#*$%&|<>@^~\\_=+{}[]", "shout": b"!?", "stop": b".", "comma": b",;:", "quote": b"\"'()/-", "wide": range(128, 256),
}
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _i
FEATURES = [*_CLASSES, "control", "log_words", "distinct_words", "distinct_pairs", "same_next", "top_line", "word_bytes",
            "line_words", "distinct_lines", "upper_start", "stopped"]


def features(text: str) -> list[float]:
    """Shape statistics of one text; shares are of its bytes, words or lines."""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(_CLASS_OF, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=len(_CLASSES) + 1)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    after = words[1:]
    return [
        *(hist / max(len(raw), 1)).tolist(), float(np.log1p(len(words))), len(set(words)) / n,
        len(set(zip(words, after))) / max(len(after), 1), sum(map(str.__eq__, words, after)) / max(len(after), 1),
        max(map(len, lines), default=0) / max(len(text), 1), (len(raw) - hist[3] - hist[4]) / n, min(n / m, 1e6),
        len(set(lines)) / m, sum(x[:1].isupper() for x in lines) / m, sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines) / m,
    ]


def _feature_kernel(batches: Iterator) -> Iterator:
    import pyarrow as pa
    for b in batches:
        rows = [features(t) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))],
                                         names=["k", "positive", "x"])


@dataclass
class Model:
    edges: np.ndarray    # (features, bins - 1) quantile cuts
    weights: np.ndarray  # (features * bins,)
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        n = self.edges.shape[1] + 1
        return np.stack([np.searchsorted(e, x[:, j], "right") + j * n for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[self.bins(x)].sum(axis=1) + self.bias) if len(x) else np.empty(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class _Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def _logit_fit(pos: np.ndarray, unl: np.ndarray, size: int, prior: float | None, steps: int, l2: float) -> np.ndarray:
    """Weights and (last) bias over bin indices. prior None: positives against
    unlabelled, equally weighted; else the non-negative risk, logistic loss."""
    w, adam = np.zeros(size + 1), _Adam(size + 1, 0.05)

    def grad(bins, per_row):
        g = np.zeros(size + 1)
        g[:size] = np.bincount(bins.ravel(), weights=np.repeat(per_row, bins.shape[1]), minlength=size)
        g[size] = per_row.sum()
        return g
    for _ in range(steps):
        zp, zu = w[pos].sum(axis=1) + w[size], w[unl].sum(axis=1) + w[size]
        plus = grad(pos, -(1 - _sigmoid(zp)) / len(pos))          # of mean loss(z, +1) over positives
        minus_u = grad(unl, _sigmoid(zu) / len(unl))              # of mean loss(z, -1) over unlabelled
        if prior is None:
            g = plus + minus_u
        else:
            minus_p = grad(pos, _sigmoid(zp) / len(pos))
            gap = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g = prior * plus + minus_u - prior * minus_p if gap >= 0 else prior * minus_p - minus_u
        g[:size] += l2 * w[:size]
        w = adam.step(w, g)
    return w


def class_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate of the positives' share of the unlabelled, from held-out scores."""
    cuts = np.unique(np.quantile(pos, np.linspace(0.0, 0.99, 100)))
    dev = lambda n: np.sqrt(np.log(4 / delta) / (2 * max(n, 1)))
    best, at = np.inf, 1.0
    for c in cuts:
        qp, qu = (pos >= c).mean(), (unl >= c).mean()
        if qp > 0 and (bound := (qu + dev(len(unl)) + dev(len(pos))) / qp) < best:
            best, at = bound, qu / qp
    return float(np.clip(at, 0.01, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray, n_bins: int = N_BINS, steps: int = 300, l2: float = 1e-4) -> Model:
    """Feature rows of trusted positives and of unlabelled texts -> model."""
    pool = np.concatenate([pos, unl])
    edges = np.quantile(pool, np.linspace(0, 1, n_bins + 1)[1:-1], axis=0).T
    model = Model(edges, np.zeros(edges.shape[0] * n_bins), 0.0, 0.5)
    if not len(pos) or not len(unl):
        return model
    bp, bu, size = model.bins(pos), model.bins(unl), edges.shape[0] * n_bins
    half = lambda b, i: b[i::2] if len(b) > 1 else b
    w = _logit_fit(half(bp, 0), half(bu, 0), size, None, steps // 2, l2)
    prior = class_prior(w[half(bp, 1)].sum(axis=1), w[half(bu, 1)].sum(axis=1))
    w = _logit_fit(bp, bu, size, prior, steps, l2)
    return Model(edges, w[:size], float(w[size]), prior)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED,
          key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on at most `max_positives` rows labelled 1 and `max_unlabelled` rows
    whose label is not looked at, none of them held out."""
    first = lambda df, n: df.orderBy(F.xxhash64("k"), "k").limit(n)
    own = lambda df: df.select(F.col(key).alias("k")).where(F.col("k").isNotNull() & ~held_out("k")).distinct()
    ids = first(own(labels.where(F.col(label) == 1)), max_positives).withColumn("positive", F.lit(True)).union(
        first(own(docs), max_unlabelled).withColumn("positive", F.lit(False)))
    texts = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("body")).join(F.broadcast(ids), "k")  # at most both limits
    rows = texts.select("k", "positive", "body").mapInArrow(
        _feature_kernel, f"k {dict(docs.dtypes)[key]}, positive boolean, x array<double>")
    # of a repeated id one row, so that the limits hold for rows
    rows = rows.groupBy("k", "positive").agg(F.min("x").alias("x")).orderBy("k", "positive").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    positive = rows["positive"].to_numpy(dtype=bool)
    return fit(x[positive], x[~positive]) if len(rows) else Model(np.zeros((len(FEATURES), 1)), np.zeros(2 * len(FEATURES)), 0.0, 0.5)


def _score_kernel(model: Model, text_at: int, column: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            x = np.array([features(t or "") for t in b.column(text_at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], names=[*b.schema.names, column])
    return run


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "_ds_score") -> DataFrame:
    """`docs` with a last column `column`, which they must not have (`common.free_name` finds one): 0 to 1, higher for likelier label 1."""
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column {column!r}; name another one for the score")
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(_score_kernel(model, docs.columns.index(text), column), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: quality score of every document."""
    base = sf_dir.rstrip("/")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), F.col("_ds_score").alias("score"),
                      (F.col("_ds_score") >= THRESHOLD).cast("int").alias("predicted"))

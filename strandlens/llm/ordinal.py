"""Quality classifier: cumulative-link regression on graded ratings.

A text's features are its hashed words of letters, digits and bytes beyond ASCII (A-Z lower-cased) and the hashed last
three bytes of its words `[^\\x20\\x09-\\x0D]+`, each once. Shared weights w and ordered thresholds t1 < t2 < ... give P(grade < k) = 1 / (1 + exp(w.x - tk)),
from which follow the expected grade and each tail probability; a document is kept if the tail from `wanted` on is
`least` or more. Training reads at most MAX_TRAIN rated documents of MAX_TRAIN_BYTES or fewer each, those of smallest hash
of their id, in seeded mini-batches on the driver, which holds 4 bytes a feature: MAX_TRAIN * MAX_TRAIN_BYTES * 4 at the
very most, and about a tenth of the texts' bytes as measured. Scoring reads all documents in one pass.

Null and empty texts have no features and get the grades of the thresholds alone. Of several ratings of one id the
lowest counts, of several documents of a rated id the text that sorts first. Without any rating every grade is as likely
and all documents are kept; where ratings give no feature a weight, the thresholds' tails decide alike for every document. Each row gives one row, also a repeated one; a tail of exactly `least` is kept; an empty table
gives no rows. Columns expected_grade, tails and kept of the input give way to the new ones; others stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlens.llm import text as tx
from strandlens.llm.store import table

BUCKETS = 1 << 18
MAX_TRAIN, MAX_TRAIN_BYTES = 12_000, 8192
#: Weights are given to features of at least so many training documents whose mean grade is so many standard errors off.
MIN_DOCS, STANDARD_ERRORS = 8, 6.0
EPOCHS, BATCH, RATE, RIDGE, SEED = 20, 64, 0.2, 3e-4, 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.array([c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in LOWER.tolist()], np.uint8)


def features(array: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and the n + 1 places where each text's begin. Each bucket counts once a text."""
    data, offsets = tx.raw(array)
    data = LOWER[data]
    plain = tx.Words(PLAIN[data], offsets)
    words = tx.Words(data, offsets)
    owner = np.concatenate([np.repeat(np.arange(len(array), dtype=np.uint64), np.diff(x.bounds)) for x in (plain, words)])
    sizes = words.ends - words.starts
    tail = np.zeros(len(sizes), np.uint64)
    for k in (1, 2, 3):
        has = sizes >= k
        tail[has] = tail[has] * np.uint64(256) + data[words.ends[has] - k]
    own = np.concatenate([plain.hashes()[1], tx.mix(tail + np.uint64(0x1F3D5B79))]) % np.uint64(buckets)
    both = np.unique(owner * np.uint64(buckets) + own)
    return (both % np.uint64(buckets)).astype(np.int32), np.searchsorted(both // np.uint64(buckets), np.arange(len(array) + 1, dtype=np.uint64))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    rated: bool = True  # whether there was any rating to learn from

    def below(self, scores: np.ndarray) -> np.ndarray:
        """P(grade < k) for k = 1, 2, ..., one column each."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds, -40, 40)))

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return tx.totals(self.weights[ids], bounds)


def cuts(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logs of the gaps."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def loss_and_slopes(score: np.ndarray, y: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """-log likelihood of grades y, and its slopes by each score and by `free`."""
    levels, at = len(free) + 1, np.arange(len(y))
    low = 1 / (1 + np.exp(np.clip(score[:, None] - cuts(free), -40, 40)))  # P(grade < k)
    low = np.concatenate([np.zeros((len(y), 1)), low, np.ones((len(y), 1))], axis=1)
    p = np.maximum(low[at, y + 1] - low[at, y], 1e-12)
    up, down = low[at, y + 1] * (1 - low[at, y + 1]), low[at, y] * (1 - low[at, y])
    by_cut = np.zeros((len(y), levels + 1))
    by_cut[at, y + 1] -= up / p
    by_cut[at, y] += down / p
    g = by_cut[:, 1:levels].sum(axis=0)
    return float(-np.log(p).sum()), (up - down) / p, np.cumsum(g[::-1])[::-1] * np.concatenate([[1], np.exp(free[1:])])


def train(ids: list[np.ndarray], grades: np.ndarray, levels: int, buckets: int = BUCKETS) -> Model:
    """Maximum likelihood with a ridge, by seeded AdaGrad mini-batches."""
    every = np.concatenate([np.zeros(0, np.int64), *ids])
    many = np.bincount(every, minlength=buckets)
    mean = np.bincount(every, np.repeat(grades.astype(float), list(map(len, ids))), buckets) / np.maximum(many, 1)
    telling = (many >= MIN_DOCS) & (np.abs(mean - grades.mean()) * np.sqrt(many) >= STANDARD_ERRORS * max(grades.std(), 1e-9))
    ids = [x[telling[x]] for x in ids]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=levels))[:-1] / max(1, len(grades)), 0.01, 0.99)
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    weights, seen, seen_free = np.zeros(buckets), np.full(buckets, 1e-8), np.full(len(free), 1e-8)
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            flat = np.concatenate([ids[i] for i in own])
            row = np.repeat(np.arange(len(own)), [len(ids[i]) for i in own])
            _, slope, by_free = loss_and_slopes(np.bincount(row, weights[flat], len(own)), grades[own], free)
            hit, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, slope[row]) / len(own) + RIDGE * weights[hit]
            seen[hit] += g * g
            weights[hit] -= RATE * g / np.sqrt(seen[hit])
            g = by_free / len(own)
            seen_free += g * g
            free = free - RATE * g / np.sqrt(seen_free)
    return Model(weights, cuts(free))


def fit(docs: DataFrame, ratings: DataFrame, levels: int, key: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN, buckets: int = BUCKETS) -> Model:
    """`ratings`: columns of `key` and grade (0 to levels - 1)."""
    rated = ratings.filter(F.col(key).isNotNull() & F.col("grade").between(0, levels - 1)).groupBy(key).agg(F.min("grade").alias("grade"))
    rated = rated.orderBy(F.xxhash64(key), key).limit(max_train).select(F.col(key).alias("rated_id"), F.col("grade").cast("int").alias("rated_grade"))
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= MAX_TRAIN_BYTES)
    part = plain.join(F.broadcast(rated), F.col("key") == F.col("rated_id")).groupBy("key", "rated_grade").agg(F.min("text").alias("text"))

    def hashed(batches):
        for batch in tx.steps(batches, "text"):
            ids, bounds = features(batch.column("text"), buckets)
            yield pa.record_batch([pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()), batch.column("rated_grade"), batch.column("key").cast(pa.string())], names=["ids", "grade", "key"])

    rows = part.select("text", "rated_grade", "key").mapInArrow(hashed, "ids binary, grade int, key string").collect()
    rows.sort(key=lambda r: (r.key, bytes(r.ids)))
    grades = np.array([r.grade for r in rows], np.int64)
    if not len(rows):
        return Model(np.zeros(buckets), np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1)), rated=False)
    return train([np.frombuffer(r.ids, np.int32) for r in rows], grades, levels, buckets)


def classify(docs: DataFrame, model: Model, text: str = "text", wanted: int | None = None, least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns, `carry` or all) with expected_grade, tails (P(grade >= k) for k = 1, 2, ...) and kept."""
    docs = docs.drop("expected_grade", "tails", "kept")
    names = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)
    top = len(model.thresholds) if wanted is None else wanted

    def score(batches):
        model = shared.value
        for part in tx.steps(batches, text):
            tails = 1 - model.below(model.scores(*features(part.column(text), len(model.weights))))
            kept = np.ones(len(tails), bool) if not model.rated else tails[:, top - 1] >= least
            column = pa.FixedSizeListArray.from_arrays(pa.array(tails.ravel()), tails.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*(part.column(k) for k in names), pa.array(tails.sum(axis=1)), column, pa.array(kept)], names=[*names, "expected_grade", "tails", "kept"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(names).schema)
    return docs.mapInArrow(score, fields + "expected_grade double, tails array<double>, kept boolean")


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the labels table: one grade for quality and one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, graded(table(spark, sf_dir, "labels")), 3)
    return classify(docs, model, carry=["doc_id"])

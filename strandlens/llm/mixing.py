"""Mixing sources to target weights: soft domain membership and nonnegative document rates. DataFrame functions only.

A multinomial logistic regression on hashed words, trained on at most MAX_TRAIN labelled documents (of smallest hash of
their id), gives every document a posterior p over the K domains. With n words in a document, rates r >= 0 are sought
whose expected domain totals, the sum of r n p, match the targets T: the least of |sum(r n p) - T|^2, by projected gradient
from rate 1, r <- max(0, r - p.g). As each row's step is scaled by 1 / n, G = sum(n p p') is the curvature. First
g = G^-1 (sum(r n p) - T), which settles in a pass or two where nonnegative rates can match the targets; where QUICK such
steps don't, g = (sum(r n p) - T) / |G| goes from rate 1 to the least squares, with momentum: a step starts at
r + b (r - r before). A pass sums 2 K numbers over all documents; the K-vectors g and the b of all passes so
far are all the state there is, so a lost executor costs one pass and no rates are kept between passes. Posteriors are
made once, written and read again.

Targets are shares of the budget: all words, a number, or LOSSLESS, the smallest for which no domain has to shrink. Domains
without a target get share 0. Column missed tells how far off the worst domain's total is, as a share of the budget: above
TOLERANCE the rates of PASSES passes don't match the targets (none may). Documents that no target wants get rate 0. Null and empty
texts have no words: they add nothing and their rate follows their posterior alike. Without labels every domain is as
likely everywhere. Each row gives one row, also a repeated one; of several labels of an id the first by name counts. An
empty table gives no rows. Columns n_words, posterior, rate and missed of the input give way to the new ones; others stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from strandlens.llm.store import forget, keep, table

LOSSLESS = -1.0
FEATURES, MAX_TRAIN, PASSES, QUICK, PATIENCE, TOLERANCE = 1 << 14, 6_000, 60, 4, 6, 1e-6


def words(text: str) -> Column:
    """Words of letters, digits and all beyond ASCII, A-Z lower-cased."""
    plain = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.filter(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def hashed(docs: DataFrame) -> DataFrame:
    """`docs` with __features from __words: which hashed words occur, at length 1, so that long texts weigh no more."""
    found = HashingTF(numFeatures=FEATURES, binary=True, inputCol="__words", outputCol="__found").transform(docs)
    return Normalizer(inputCol="__found", outputCol="__features").transform(found).drop("__words", "__found")


class Domains:
    """Domain names, and the trained regression over them (None if fewer than two have labelled documents)."""

    def __init__(self, names: list[str], model):
        self.names, self.model = names, model

    def posteriors(self, docs: DataFrame, text: str) -> DataFrame:
        """`docs` with __n (words) and __p (an array with each domain's probability)."""
        k = len(self.names)
        docs = docs.withColumn("__words", words(text)).withColumn("__n", F.size("__words").cast("double"))
        if self.model is None:
            return docs.withColumn("__p", F.array(*[F.lit(1.0 / k)] * k)).drop("__words")
        made = self.model.transform(hashed(docs))
        # the regression knows no domain after the last one that has labels; behind a generator, so that what refers to
        # the probabilities doesn't make them again
        found = vector_to_array("__posterior")
        p = F.concat(found, F.array_repeat(F.lit(0.0), k - self.model.numClasses)) if self.model.numClasses < k else found
        return made.withColumn("__p", F.explode(F.array(p))).drop("__features", "__posterior", "__raw")


def learn(docs: DataFrame, labelled: DataFrame, names: list[str], key: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> Domains:
    """`labelled`: columns of `key` and domain. Names that no label has stay without probability."""
    known = labelled.filter(F.col(key).isNotNull() & F.col("domain").isin(names)).groupBy(key).agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64(key), key).limit(max_train).select(F.col(key).alias("__id"), "domain")
    place = F.coalesce(*[F.when(F.col("domain") == x, float(i)) for i, x in enumerate(names)])
    plain = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    rows = plain.join(F.broadcast(known), F.col("__key") == F.col("__id")).select(words("text").alias("__words"), place.alias("__label"))
    known = keep(hashed(rows), "labelled")
    if known.select("__label").distinct().count() < 2:
        return Domains(names, None)
    fit = LogisticRegression(family="multinomial", maxIter=30, regParam=0.0003, featuresCol="__features", labelCol="__label", predictionCol="", probabilityCol="__posterior", rawPredictionCol="__raw", standardization=False)
    model = fit.fit(known)
    forget(known)
    return Domains(names, model)


def moved(steps: list[tuple[list[float], float]]) -> Column:
    """From __p a struct of r after the given steps (g, b), and of y, where the next step starts."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not steps:
        return start
    moves = F.array(*[F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(float(b)).alias("b")) for g, b in steps])
    along = lambda g: sum((F.col("__p")[k] * g[k] for k in range(1, len(steps[0][0]))), F.col("__p")[0] * g[0])

    def step(at: Column, move: Column) -> Column:
        new = F.greatest(F.lit(0.0), at["y"] - along(move["g"]))
        return F.struct(new.alias("r"), (new + move["b"] * (new - at["r"])).alias("y"))

    return F.aggregate(moves, start, step)


def rate(steps: list[tuple[list[float], float]]) -> Column:
    return moved(steps)["r"]


def solve(scored: DataFrame, shares: list[float], budget: float | None = None) -> tuple[list[tuple[list[float], float]], float]:
    """The steps that bring the expected totals of `scored` (__n, __p) to the shares of the budget, and what is missed."""
    k = len(shares)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = scored.agg(F.sum("__n"), *[F.sum(F.col("__n") * F.col("__p")[i] * F.col("__p")[j]) for i, j in pairs]).first()
    total = row[0] or 0.0
    if not total:
        return [], 0.0
    gram = np.zeros((k, k))
    for (i, j), x in zip(pairs, row[1:]):
        gram[i, j] = gram[j, i] = x
    if budget == LOSSLESS:
        now = gram.sum(axis=1)  # each domain's words, as posteriors sum to 1
        budget = max((w / x for w, x in zip(now, shares) if x > 0), default=total)
    target = np.array(shares) * (total if budget is None else budget)
    size = max(target.sum(), 1e-300)
    plain = np.eye(k) / max(np.linalg.eigvalsh(gram)[-1], 1e-300)
    metric, steps, best, least, worst = np.linalg.pinv(gram + 1e-9 * total * np.eye(k)), [], [], np.inf, np.inf
    waited, pace, last = 0, 1.0, np.inf
    for _ in range(PASSES):
        made = scored.select("__n", "__p", moved(steps).alias("m"))
        now = np.array(list(made.agg(*[F.sum(F.col(f"m.{x}") * F.col("__n") * F.col("__p")[i]) for x in "ry" for i in range(k)]).first()))
        off, ahead = now[:k] - target, now[k:] - target
        distance = float(off @ off)
        waited = 0 if distance < least * (1 - 1e-6) else waited + 1
        if distance < least:
            best, least, worst = list(steps), distance, float(np.abs(off).max() / size)
        if worst <= TOLERANCE or waited >= PATIENCE and metric is plain:
            break
        if metric is not plain and len(steps) >= QUICK:
            # not matched that way: the plain metric begins anew
            metric, steps, waited = plain, [], 0
            continue
        if metric is plain and distance > last:
            pace = 1.0  # momentum has carried too far: begin anew
        last = distance
        further = (1 + np.sqrt(1 + 4 * pace**2)) / 2 if metric is plain else 1.0
        steps.append(((metric @ ahead).tolist(), float((pace - 1) / further)))
        pace = further
    return best, worst


def mix(docs: DataFrame, domains: Domains, targets: dict[str, float], text: str = "text", budget: float | None = None, carry: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns, `carry` or all) with n_words, posterior (an array in the order of domains.names), rate and missed."""
    docs = docs.drop("n_words", "posterior", "rate", "missed", "__n", "__p", "__words", "__found", "__features", "__raw", "__posterior")
    total = sum(targets.values()) or 1.0
    shares = [targets.get(x, 0.0) / total for x in domains.names]
    names = docs.columns if carry is None else carry
    scored = keep(domains.posteriors(docs, text).select(*names, "__n", "__p"), "posteriors")
    steps, missed = solve(scored, shares, budget)
    out = scored.withColumn("rate", rate(steps)).withColumn("missed", F.lit(missed))
    return out.select(*names, F.col("__n").cast("long").alias("n_words"), F.col("__p").alias("posterior"), "rate", "missed")


def copies(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each row as often as its rate says: the whole part, and one more with the rest's probability, by a hash of its
    id, so that expected totals are those of the rates. Column copy numbers a row's copies from 0."""
    chance = F.pmod(F.xxhash64(F.col(key), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("rate") + chance).cast("int")
    return mixed.withColumn("__times", times).filter("__times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__times") - 1))).drop("__times")


#: The languages of `documents` and the share of words that each is to have.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    plain = docs.select("doc_id", "text")
    return mix(plain, learn(plain, labelled, sorted(TARGETS)), TARGETS, carry=["doc_id"]).select("doc_id", "n_words", "posterior", "rate", "missed")

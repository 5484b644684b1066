"""Scoring of candidates against clusters, archetypes and rules, ranks, quotas and selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlens.functions import residues as R
from strandlens.operators.counts import features
from strandlens.sources.sequences import long_residues


#: Clusters that are compared with every design at once; more are taken in blocks of about that many.
MAX_CLUSTERS = 200_000


def plain_patterns(patterns: list[str], width: int) -> np.ndarray:
    """Residue codes of patterns of `width` letters, a row for each; other letters are no residue."""
    code = np.full(256, len(R.RESIDUES), np.int64)
    code[np.frombuffer(R.RESIDUES.encode(), np.uint8)] = np.arange(len(R.RESIDUES))
    return code[np.frombuffer("".join(patterns).encode("ascii", "replace"), np.uint8).reshape(len(patterns), width)]


def bitsets(patterns: list[str], width: int) -> np.ndarray:
    """For each place and residue one bit a pattern, whether it has that residue there, in words of 64."""
    letters, words = plain_patterns(patterns, width), max(1, -(-len(patterns) // 64))
    out = np.zeros((width, len(R.RESIDUES) + 1, words), np.uint64)
    for k in range(width):
        for a in range(len(R.RESIDUES)):
            bits = np.packbits(letters[:, k] == a, bitorder="little")
            out[k, a].view(np.uint8)[: len(bits)] = bits
    return out


def best_of(masks: np.ndarray, own: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(design, pattern, matches) of the `best` patterns of each design: most places alike, one at least, then the earlier
    pattern. Counts of places are numbers written across words, a word for each binary digit, added for 64 patterns at once."""
    column, planes = [masks[k, own[:, k]] for k in range(masks.shape[0])], []
    while column:
        carried = []
        while len(column) > 1:  # an adder: two or three words of a digit give one of it and one of the next
            a, b, *c = column[-3:]
            half = a ^ b
            carried.append((a & b) | (half & c[0]) if c else a & b)
            column[-3:] = [half ^ c[0] if c else half]
        planes.insert(0, column[0])
        column = carried
    left = planes[0].copy()
    for x in planes[1:]:
        left |= x
    above, need = np.zeros_like(left), np.full(len(own), best)
    for x in planes:  # the best-th largest count, digit by digit: what is above it, and what still can equal it
        ones = left & x
        n = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
        many = (n >= need)[:, None]
        above |= np.where(many, np.uint64(0), ones)
        left = np.where(many, ones, left & ~x)
        need = np.where(many[:, 0], need, need - n)
    design, at = [], []
    for words, most in ((above, np.full(len(own), best)), (left, need)):
        row, word = np.nonzero(words)
        near = np.arange(len(row)) - np.searchsorted(row, row) < most[row]  # a word has one bit or more
        row, word = row[near], word[near]
        i, bit = np.nonzero(np.unpackbits(words[row, word].view(np.uint8).reshape(len(row), 8), axis=1, bitorder="little"))
        row, place = row[i], word[i] * 64 + bit
        keep = np.arange(len(row)) - np.searchsorted(row, row) < most[row]
        design.append(row[keep])
        at.append(place[keep])
    design, at = np.concatenate(design), np.concatenate(at)
    same = sum(((planes[-1 - k][design, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k for k in range(len(planes)))
    return design, at, same


def cluster_matches(designs: DataFrame, clusters: DataFrame, best: int = 5, least: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each design's best clusters (of `least` rows or more) by equal vernier residues, one at least, then by size, with the
    design's `keep` columns. Designs pass by a table of MAX_CLUSTERS patterns at most, and keep their `best` of each such table."""
    wanted = clusters.filter(F.col("n") >= least).select("family", "pattern", "n")
    own_columns = ["doc_id", *keep]
    of = designs.select(*own_columns, F.concat(*[R.residue("v", p) for p in R.VERNIER]).alias("pattern"))
    kept = ", ".join(f"{k} {of.schema[k].dataType.simpleString()}" for k in own_columns)
    blocks = max(1, -(-wanted.count() // MAX_CLUSTERS))

    def passed(block: int) -> DataFrame:
        held = wanted.filter(F.pmod(F.xxhash64("family", "pattern"), F.lit(blocks)) == block).orderBy(F.desc("n"), "family", "pattern").toArrow().combine_chunks()
        shared = designs.sparkSession.sparkContext.broadcast((held, bitsets(held.column("pattern").to_pylist(), len(R.VERNIER))))

        def compare(batches):
            rows, masks = shared.value
            size = max(1, (1 << 13) // masks.shape[-1])  # designs at a time, so that their words stay in the cache
            for batch in batches:
                own = plain_patterns(batch.column("pattern").to_pylist(), masks.shape[0])
                found = [best_of(masks, own[start : start + size], best) for start in range(0, len(own), size)] if rows.num_rows else []
                if found:
                    design = np.concatenate([x[0] + i * size for i, x in enumerate(found)])
                    at, same = (np.concatenate([x[k] for x in found]) for k in (1, 2))
                    held = rows.take(pa.array(at)).combine_chunks()
                    yield pa.record_batch([*[batch.column(k).take(pa.array(design)) for k in own_columns], *[held.column(k).combine_chunks() for k in ("family", "pattern", "n")], pa.array(same)], names=[*own_columns, "family", "pattern", "n", "matches"])

        return of.mapInArrow(compare, f"{kept}, family string, pattern string, n long, matches long")

    met = reduce(DataFrame.union, map(passed, range(blocks)))
    order = Window.partitionBy("doc_id").orderBy(F.desc("matches"), F.desc("n"), "family", "pattern")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


FEATURES = {"length": 1.0, "charge": 0.5, "aromatic": 0.5}
#: Mean and deviation of each feature where there are no clusters.
DEFAULTS = {"length": (15.0, 5.0), "charge": (0.0, 3.0), "aromatic": (2.0, 1.5)}


def naturalness(designs: DataFrame, clusters: DataFrame, least: int = 100) -> DataFrame:
    """Weighted deviations of cdr3 length, charge and aromatics from the best clusters (weight matches * sqrt(n)), and
    their score; from the mean and population deviation of all clusters' means, weighted by size up to 1000, where the best
    has fewer than two matches."""
    rows = features(designs)
    good = cluster_matches(rows, clusters, least=least, keep=tuple(FEATURES)).withColumn("weight", F.col("matches") * F.sqrt("n"))
    stats = [f"{k}_{x}" for k in FEATURES for x in ("mean", "std")]
    named = good.join(clusters.filter(F.col("n") >= least).select("family", "pattern", *stats), ["family", "pattern"])
    own = rows.select("doc_id", *FEATURES)
    z = {k: (F.col(k) - F.col(f"{k}_mean")) / F.greatest(F.col(f"{k}_std"), F.lit(low)) for k, low in FEATURES.items()}
    near = named.groupBy("doc_id").agg(*[(F.sum(x * F.col("weight")) / F.sum("weight")).alias(f"z_{k}") for k, x in z.items()], F.max("matches").alias("best_match")).filter("best_match >= 2")
    weight = F.least("n", F.lit(1000))
    mean = {k: F.sum(F.col(f"{k}_mean") * weight) / F.sum(weight) for k in FEATURES}
    squares = {k: F.sum(F.col(f"{k}_mean") * F.col(f"{k}_mean") * weight) / F.sum(weight) for k in FEATURES}
    every = clusters.agg(*[F.coalesce(mean[k], F.lit(m)).alias(f"{k}_mean") for k, (m, _) in DEFAULTS.items()],
                         *[F.coalesce(F.when(F.count(F.lit(1)) > 0, F.sqrt(F.greatest(F.round(squares[k] - mean[k] * mean[k], 9), F.lit(0.0)))), F.lit(d)).alias(f"{k}_std") for k, (_, d) in DEFAULTS.items()])  # one row
    both = own.join(near, "doc_id", "left").crossJoin(F.broadcast(every))
    out = both.select("doc_id", *[F.when(F.col("best_match").isNull(), x).otherwise(F.col(f"z_{k}")).alias(f"z_{k}") for k, x in z.items()], F.coalesce("best_match", F.lit(0).cast("long")).alias("best_match"))
    score = F.col("z_length") * F.col("z_length") + F.col("z_charge") * F.col("z_charge") + 0.5 * F.col("z_aromatic") * F.col("z_aromatic")
    return out.withColumn("score", F.round(score, 9)).withColumns({f"z_{k}": F.round(f"z_{k}", 9) for k in z})


def score_class(scored: DataFrame) -> DataFrame:
    """Class, risk and risk factors of a naturalness score."""
    grade = F.when(F.col("score") < 1, "excellent").when(F.col("score") < 3, "good").when(F.col("score") < 6, "fair").when(F.col("score") < 12, "poor").otherwise("bad")
    far = lambda k, above, below: F.when(F.abs(f"z_{k}") > 2, F.when(F.col(f"z_{k}") > 0, above).otherwise(below))
    factors = F.concat_ws(",", F.when(F.col("best_match") == 0, "no cluster"), far("length", "long", "short"), far("charge", "positive", "negative"), far("aromatic", "aromatic", "aromatic"))
    worst = F.greatest(*[F.abs(f"z_{k}") for k in FEATURES])
    risk = F.when((F.col("score") < 3) & (worst <= 2), "low").when(F.col("score") < 6, "medium").otherwise("high")
    return scored.withColumns({"grade": grade, "factors": factors, "risk": risk})


def family_probability(designs: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Consensus matches of each design with each family (frame positions from 66 on count twice), as shares."""
    of = long_residues(designs, R.VERNIER, ["doc_id"]).withColumnRenamed("aa", "own")
    weight = F.when(F.col("pos") >= 66, 2).otherwise(1)
    joined = of.join(F.broadcast(archetypes.select("family", "pos", "consensus")), "pos").groupBy("doc_id", "family").agg(F.sum(F.when(F.col("own") == F.col("consensus"), weight).otherwise(0)).alias("points"))
    total = F.sum("points").over(Window.partitionBy("doc_id"))
    return joined.withColumn("probability", F.col("points") * F.lit(1.0) / F.when(total > 0, total))


def applicable_rules(designs: DataFrame, rules: DataFrame, confidence: float = 0.5) -> DataFrame:
    """doc_id, family (of the rule), condition, pos, wanted, confidence, obeyed: rules of any family whose condition holds for
    a design. A condition may join several parts by AND; parts of unknown name hold.

    A rule meets designs by one of its parts, and the others are looked up in the design's row, which goes along, so that
    the met rules, some hundreds a design, are never shuffled themselves. Hallmarks are as many as the input has, so rules by
    them are joined as their size asks; all other parts are of a fixed number, and their rules are broadcast."""
    names = ("family", "hallmarks", "cdr3_len", "cdr3_charge", "cdr3_cys")
    named = {k: F.col(k) for k in names} | {f"cdr3[-{k}]": F.substring("cdr3", -k, 1) for k in (1, 2, 3)}
    own = {k: F.concat(F.lit(f"{k}="), x) for k, x in named.items()}
    base = features(designs).select("doc_id", "v", F.array(*own.values()).alias("own"))
    every = F.array_distinct(F.filter(F.split("condition", " AND "), lambda x: F.substring_index(x, "=", 1).isin(list(named))))
    wanted = rules.filter((F.col("rank") == 1) & (F.col("confidence") >= confidence)).select("family", "condition", "pos", F.col("aa").alias("wanted"), "confidence", every.alias("parts"))
    # the part to meet by, from a generator, so that filters on it don't make the rules twice; a rule without parts meets all
    by_marks = F.filter("parts", lambda x: x.startswith("hallmarks="))
    wanted = wanted.select("*", F.explode(F.slice(F.concat(by_marks, "parts", F.array(F.lit(""))), 1, 1)).alias("part"))
    marks = F.col("part").startswith("hallmarks=")
    own_marks = F.explode(F.slice("own", names.index("hallmarks") + 1, 1))
    others = F.explode(F.concat(F.filter("own", lambda x: ~x.startswith("hallmarks=")), F.array(F.lit(""))))
    met = base.select("*", others.alias("part")).join(F.broadcast(wanted.filter(~marks)), "part")
    met = met.union(base.select("*", own_marks.alias("part")).join(wanted.filter(marks), "part"))
    met = met.filter((F.size("parts") <= 1) | F.forall("parts", lambda x: F.array_contains("own", x)))
    return met.select("doc_id", "family", "condition", "pos", "wanted", "confidence", (F.expr("substring(v, pos, 1)") == F.col("wanted")).alias("obeyed"))


def rule_compliance(designs: DataFrame, rules: DataFrame, confidence: float = 0.5, shown: int = 5) -> DataFrame:
    """Per design, by the rules of its own family: how many apply, how many its residues obey, the share of confidence
    obeyed (1 if none apply), and the first violations by confidence."""
    own = designs.select("doc_id", F.col("family").alias("own"))
    met = applicable_rules(designs, rules, confidence).join(own, "doc_id").filter("family = own")
    broken = F.when(~F.col("obeyed"), F.struct((-F.col("confidence")).alias("c"), "pos", "wanted", "condition"))
    out = met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("applicable"), F.sum(F.col("obeyed").cast("long")).alias("obeyed"),
                                    F.round(F.sum(F.when(F.col("obeyed"), F.col("confidence")).otherwise(0.0)) / F.sum("confidence"), 6).alias("compliance"), F.slice(F.array_sort(F.collect_list(broken)), 1, shown).alias("broken"))
    named = F.array_join(F.transform("broken", lambda x: F.concat(x["pos"].cast("string"), x["wanted"])), ",")
    out = own.join(out, "doc_id", "left").select("doc_id", F.coalesce("applicable", F.lit(0)).alias("applicable"), F.coalesce("obeyed", F.lit(0)).alias("obeyed"), F.coalesce("compliance", F.lit(1.0)).alias("compliance"), F.coalesce(named, F.lit("")).alias("violations"))
    return out


def violations(designs: DataFrame, rules: DataFrame, top: int = 10) -> DataFrame:
    """The rules of their own family that designs break most often."""
    own = designs.select("doc_id", F.col("family").alias("own"))
    met = applicable_rules(designs, rules).join(own, "doc_id").filter("family = own AND NOT obeyed")
    return met.groupBy("condition", "pos", "wanted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "condition", "pos", "wanted").limit(top)


def min_max(frame: DataFrame, column: str, by: str) -> DataFrame:
    """The column brought to 0..1 within each group; 0 where all are equal. Ends are aggregated, so that no group is gathered."""
    ends = frame.groupBy(by).agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    return frame.join(ends, by).withColumn("scaled", F.coalesce((F.col(column) - low) / F.when(high > low, high - low), F.lit(0.0))).drop("__low", "__high")


def capped(frame: DataFrame, key: str, order: list, n: int = 3) -> DataFrame:
    """At most n rows for each key, in the given order."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= n)


def quota_selection(frame: DataFrame, by: str, order: list, quota: dict[str, int], otherwise: int) -> DataFrame:
    """The first rows of each group, as many as its quota."""
    most = F.coalesce(*[F.when(F.col(by) == k, n) for k, n in quota.items()], F.lit(otherwise))
    return frame.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= most)


def framework_identity(designs: DataFrame, leads: DataFrame, by: str) -> DataFrame:
    """Share of framework positions equal to the residues of the row's own lead (columns `by` and lead)."""
    places = [p for k, (a, b) in R.REGIONS.items() if k.startswith("fr") for p in range(a, b + 1)]
    same = sum(((R.residue("v", p) == R.residue("lead", p)).cast("int") for p in places), F.lit(0))
    return designs.join(leads, by).select("doc_id", (same * F.lit(1.0) / len(places)).alias("framework_identity"))


def pure_clusters(clusters: DataFrame, best: int) -> DataFrame:
    """The clusters of each dominant family by size times purity, the dominant family's share."""
    top = clusters.groupBy("pattern").agg(F.sum("n").alias("n"), F.max_by("family", F.struct("n", "family")).alias("family"), (F.max("n") * F.lit(1.0) / F.sum("n")).alias("purity"))
    order = Window.partitionBy("family").orderBy(F.desc(F.col("n") * F.col("purity")), "pattern")
    return top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("family", "pattern", "n", "purity", "rank")


def motif_pool(archetypes: DataFrame, sizes: range = range(2, 6)) -> DataFrame:
    """Windows of 2 to 5 successive archetype positions, as pos+residue strings, distinct."""
    whole = archetypes.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "consensus"))), lambda x: F.concat(x["pos"].cast("string"), x["consensus"])).alias("m"))

    def windows(k: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("m")), lambda i: i + k - 1 <= F.size("m"))
        return F.transform(starts, lambda i: F.array_join(F.slice("m", i, F.lit(k)), " "))

    return whole.select(F.explode(F.flatten(F.array(*map(windows, sizes)))).alias("motif")).distinct()


#: Places that are never changed; single probes, additional changes of tracks 2 and 3, changes of track 4 at most.
PROTECTED, PROBES, EXTRA, LAYER = [2, *R.HALLMARKS], 20, {2: 2, 3: 3}, 8


def candidates(leads: DataFrame, archetypes: DataFrame, draws: int = 4, rate: int = 300_000) -> DataFrame:
    """Design candidates for a table of leads: doc_id, family, track, draw, n_mutations, mutations.

    Every lead takes each family's consensus residues, but never at cysteines, gaps or protected places. Track 0: the graft
    without changes, and all of them; 1: single ones, PROBES at most; 2 and 3: one window of 2 or 3, or of 3 to 5,
    successive consensus places, and EXTRA others at most; 4: each place by a hashed draw, LAYER at most. All choices
    go by hashes of (lead, draw, family, place), so that candidates are reproducible.
    """
    ranked = archetypes.select("family", "pos", "consensus", F.row_number().over(Window.partitionBy("family").orderBy("pos")).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("family")).alias("places"))
    own = F.expr("substring(v, pos, 1)")
    met = leads.select("doc_id", "v").join(F.broadcast(ranked))  # 16 rows a family
    base = met.filter(~F.col("pos").isin(PROTECTED) & ~own.isin("C", "-") & (own != F.col("consensus")))
    base = base.select("doc_id", "family", "i", "places", "pos", F.concat(own, F.col("pos").cast("string"), F.col("consensus")).alias("change"))
    key = lambda *x: R.sample_key(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("family"), *[F.lit(str(a)) if not isinstance(a, Column) else a.cast("string") for a in x]))
    of = Window.partitionBy("doc_id", "family")
    track = lambda frame, number, draw: frame.select("doc_id", "family", F.lit(number).alias("track"), draw.cast("int").alias("draw"), "pos", "change")
    parts = [track(base, 0, F.lit(1))]
    probes = base.withColumn("rank", F.row_number().over(of.orderBy(key("probe", F.col("pos")), "pos"))).filter(F.col("rank") <= PROBES)
    parts.append(track(probes, 1, F.col("rank")))
    for number, (least, most) in {2: (2, 3), 3: (3, 5)}.items():
        size = least + key("size", number) % (most - least + 1)
        start = 1 + key("start", number) % (F.greatest(F.col("places") - size, F.lit(0)) + 1)
        inside = F.col("i").between(start, start + size - 1)
        extra = F.row_number().over(Window.partitionBy("doc_id", "family", "inside").orderBy(key("extra", number, F.col("pos")), "pos"))
        chosen = base.withColumn("inside", inside).withColumn("rank", extra).filter(F.col("inside") | (F.col("rank") <= EXTRA[number]))
        parts.append(track(chosen, number, F.lit(0)))
    drawn = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("chance", key("draw", F.col("draw"), F.col("pos"))).filter(F.col("chance") < rate)
    layered = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "family", "draw").orderBy("chance", "pos"))).filter(F.col("rank") <= LAYER)
    parts.append(track(layered, 4, F.col("draw")))
    made = reduce(DataFrame.union, parts).groupBy("doc_id", "family", "track", "draw").agg(F.count(F.lit(1)).alias("n_mutations"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "change"))), lambda x: x["change"]), ",").alias("mutations"))
    graft = leads.select("doc_id").join(F.broadcast(archetypes.select("family").distinct())).select("doc_id", "family", F.lit(0), F.lit(0), F.lit(0).cast("long"), F.lit(""))
    return made.union(graft)


def repair_selection(frame: DataFrame, by: str, n: int, share: float = 0.35) -> DataFrame:
    """Exactly n rows for each lead (or all it has), best score first, no kind over `share` of n while others are left.
    Of each kind only the n best of a lead can be chosen; these are taken first, by a window that Spark limits before it
    shuffles, so that the greedy walk over one lead holds n rows a kind at most."""
    best = Window.partitionBy(by, "kind").orderBy("score", "candidate")
    columns = frame.columns
    frame = frame.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= n).select(columns)

    def walk(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "candidate"])
        most, used, taken, rest = max(1, int(share * n)), {}, [], {}
        for i, kind in zip(pool.index, pool["kind"]):
            if used.get(kind, 0) < most and len(taken) < n:
                taken.append(i)
                used[kind] = used.get(kind, 0) + 1
            else:
                rest.setdefault(kind, []).append(i)
        while len(taken) < n and rest:  # the kind with the fewest so far gives its next best
            kind = min(rest, key=lambda k: (used.get(k, 0), k))
            taken.append(rest[kind].pop(0))
            used[kind] = used.get(kind, 0) + 1
            if not rest[kind]:
                del rest[kind]
        return pool.loc[taken]

    return frame.groupBy(by).applyInPandas(walk, frame.schema)

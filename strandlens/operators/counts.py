"""Counting operators: rules, archetypes, conservation, clusters, triplets, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlens.functions import residues as R
from strandlens.sources.sequences import long_residues, valid


def features(rows: DataFrame) -> DataFrame:
    """Adds cdr3 length, charge, hydro, n_cys, aromatic and their bins."""
    out = rows.withColumns({"length": F.length("cdr3"), "charge": R.charge("cdr3"), "hydro": R.hydrophobicity("cdr3"), "n_cys": R.count_of("cdr3", "C"), "aromatic": R.count_of("cdr3", "FWY")})
    return out.withColumns({"cdr3_len": R.length_bin(F.col("length")), "cdr3_charge": R.charge_bin(F.col("charge")), "cdr3_cys": R.cysteine_bin(F.col("n_cys"))})


def condition_tokens(full: bool = False) -> Column:
    tail = [F.concat(F.lit(f"cdr3[-{k}]="), F.substring("cdr3", -k, 1)) for k in range(1, 4 if full else 2)]
    named = [F.concat(F.lit(f"{k}="), F.col(k)) for k in ("family", "hallmarks", "cdr3_len", "cdr3_charge", "cdr3_cys")]
    return F.array(*named, *tail)


def rules(rows: DataFrame, mode: str = "fr3fr4", min_obs: int = 5, min_support: int = 3, min_confidence: float = 0.7, min_lift: float = 1.1, top: int = 2) -> DataFrame:
    """family, condition, pos, aa, support, confidence, confidence_all, lift, baseline, rank: residues that conditions predict.

    Rows are summed by their condition vector, position and residue before conditions are expanded, so that the
    expansion works on counts. Conditions that define the position's residue (hallmarks at hallmark positions) go.
    """
    keys = ["family", "hallmarks", "cdr3_len", "cdr3_charge", "cdr3_cys", "last"]
    base = features(rows).withColumn("last", F.substring("cdr3", -1, 1))
    counted = long_residues(base, R.positions(mode), keys).filter(valid()).groupBy(*keys, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    named = [F.concat(F.lit(f"{k}="), F.col(k)) for k in keys[:-1]] + [F.concat(F.lit("cdr3[-1]="), F.col("last"))]
    counts = counted.withColumn("condition", F.explode(F.array(*named))).groupBy("family", "condition", "pos", "aa").agg(F.sum("n").alias("support"))
    total = base.withColumn("condition", F.explode(condition_tokens())).groupBy("family", "condition").agg(F.count(F.lit(1)).alias("n_condition"))
    by_family = counted.groupBy("family", "pos", "aa").agg(F.sum("n").alias("n")).withColumn("baseline", F.col("n") * F.lit(1.0) / F.sum("n").over(Window.partitionBy("family", "pos"))).drop("n")
    place = Window.partitionBy("family", "condition", "pos")
    out = counts.withColumn("n_valid", F.sum("support").over(place)).join(by_family, ["family", "pos", "aa"]).join(total, ["family", "condition"])
    out = out.withColumns({"confidence": F.col("support") * F.lit(1.0) / F.col("n_valid"), "confidence_all": F.col("support") * F.lit(1.0) / F.col("n_condition")})
    out = out.withColumn("lift", F.col("confidence") / F.col("baseline"))
    definitional = F.col("condition").startswith("hallmarks=") & F.col("pos").isin(R.HALLMARKS)
    out = out.filter((F.col("n_valid") >= min_obs) & (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift) & ~definitional)
    out = out.withColumn("rank", F.row_number().over(place.orderBy(F.desc("support"), "aa"))).filter(F.col("rank") <= top)
    return out.select("family", "condition", "pos", "aa", "support", "n_valid", "confidence", "confidence_all", "lift", "baseline", "rank")


def global_rules(rows: DataFrame, mode: str = "vernier", min_support: int = 10, min_confidence: float = 0.6) -> DataFrame:
    """condition, pos, aa, support, confidence, lift: the top residue of each condition over all families."""
    base = features(rows).withColumn("condition", F.explode(condition_tokens(full=True)))
    counts = long_residues(base, R.positions(mode), ["condition"]).filter(valid()).groupBy("condition", "pos", "aa").agg(F.count(F.lit(1)).alias("support"))
    place = Window.partitionBy("condition", "pos")
    base_counts = long_residues(rows, R.positions(mode), []).filter(valid()).groupBy("pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    base_counts = base_counts.withColumn("baseline", F.col("n") * F.lit(1.0) / F.sum("n").over(Window.partitionBy("pos"))).drop("n")
    out = counts.withColumn("n_valid", F.sum("support").over(place)).withColumn("rank", F.row_number().over(place.orderBy(F.desc("support"), "aa"))).filter("rank = 1")
    out = out.withColumn("confidence", F.col("support") * F.lit(1.0) / F.col("n_valid")).join(base_counts, ["pos", "aa"]).withColumn("lift", F.col("confidence") / F.col("baseline"))
    definitional = F.col("condition").startswith("hallmarks=") & F.col("pos").isin(R.HALLMARKS)
    return out.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & ~definitional).select("condition", "pos", "aa", "support", "confidence", "lift")


def hallmark_counts(rows: DataFrame, top: int = 50) -> DataFrame:
    return rows.groupBy("hallmarks").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("family").alias("n_families")).orderBy(F.desc("n"), "hallmarks").limit(top)


def family_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def archetypes(rows: DataFrame, by: str = "family", least: int = 10, places: list[int] | None = None, second: bool = False) -> DataFrame:
    """Consensus, frequency and support at each position of each group with `least` rows or more; and second choices."""
    big = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= least)
    counts = long_residues(rows, places or R.VERNIER, [by]).filter(valid()).groupBy(by, "pos", "aa").agg(F.count(F.lit(1)).alias("support"))
    place = Window.partitionBy(by, "pos")
    ranked = counts.withColumn("total", F.sum("support").over(place)).withColumn("rank", F.row_number().over(place.orderBy(F.desc("support"), "aa")))
    ranked = ranked.filter(F.col("rank") <= (2 if second else 1)).withColumn("frequency", F.col("support") * F.lit(1.0) / F.col("total")).join(big.select(by), by)
    return ranked.select(by, "pos", "rank", F.col("aa").alias("consensus"), "frequency", "support")


def conservation(rows: DataFrame, places: list[int]) -> DataFrame:
    """n_obs, gap_rate, major residue and frequency, and entropy in bits, for each family and position."""
    counts = long_residues(rows, places, ["family"]).groupBy("family", "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("family", "pos")
    seen = counts.withColumns({"n_rows": F.sum("n").over(place), "n_obs": F.sum(F.when(valid(), F.col("n")).otherwise(0)).over(place)}).filter(valid())
    seen = seen.withColumns({"p": F.col("n") * F.lit(1.0) / F.col("n_obs"), "rank": F.row_number().over(place.orderBy(F.desc("n"), "aa"))})
    return seen.groupBy("family", "pos").agg(
        F.max("n_obs").alias("n_obs"), (1 - F.max("n_obs") * F.lit(1.0) / F.max("n_rows")).alias("gap_rate"), F.max(F.when(F.col("rank") == 1, F.col("aa"))).alias("major"),
        F.max("p").alias("major_frequency"), F.round(F.sum(F.col("p") * F.log2(1 / F.col("p"))), 6).alias("entropy"))


def pearson(x: Column, y: Column) -> Column:
    """From moments, cut to -1..1; null where a variance is zero."""
    n, x, y = F.sum(F.when(x.isNotNull() & y.isNotNull(), 1.0)), F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    top = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    below = F.sqrt(F.greatest(n * F.sum(x * x) - F.sum(x) * F.sum(x), F.lit(0.0)) * F.greatest(n * F.sum(y * y) - F.sum(y) * F.sum(y), F.lit(0.0)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(top, F.when(below > 0, below))))


def feature_correlations(rows: DataFrame, place: int) -> DataFrame:
    """Correlations of cdr3 length, charge and hydrophobicity with residue classes at a position, by family."""
    base = features(rows).withColumn("aa", R.residue("v", place)).filter(valid())
    marks = {"positive": "KRH", "negative": "DE", "aromatic": "FWY"}
    pairs = [("charge", "positive"), ("charge", "negative"), ("hydro", "aromatic"), ("hydro", "positive"), ("charge", "aromatic")]
    aggs = [F.round(pearson(F.col(a), F.col("aa").isin(list(marks[b])).cast("double")), 6).alias(f"r_{a}_{b}") for a, b in pairs]
    return base.groupBy("family").agg(F.count(F.lit(1)).alias("n"), *aggs).withColumn("pos", F.lit(place))


def cdr_statistics(rows: DataFrame) -> DataFrame:
    """Means, sample deviations (0 for one row), least and most of cdr3 features and of all loops' lengths by family."""
    base = features(rows).withColumns({f"{k}_length": F.length(R.region("v", k)) for k in ("cdr1", "cdr2", "cdr3")})
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in ("charge", "hydro", "aromatic", "cdr1_length", "cdr2_length", "cdr3_length"):
        aggs += [F.round(F.avg(k), 6).alias(f"{k}_mean"), F.round(F.coalesce(F.stddev_samp(k), F.lit(0.0)), 6).alias(f"{k}_std"), F.min(k).alias(f"{k}_min"), F.max(k).alias(f"{k}_max")]
    return base.groupBy("family").agg(*aggs)


def pattern_clusters(rows: DataFrame, places: list[int] | None = None) -> DataFrame:
    """One row for each family and pattern of residues at the vernier positions, all of them filled."""
    pattern = F.concat(*[R.residue("v", p) for p in places or R.VERNIER])
    base = features(rows).withColumn("pattern", pattern).filter(F.col("pattern").rlike(f"^[{R.RESIDUES}]+$"))
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in ("length", "charge", "aromatic"):
        aggs += [F.round(F.avg(k), 6).alias(f"{k}_mean"), F.round(F.coalesce(F.stddev_samp(k), F.lit(0.0)), 6).alias(f"{k}_std")]
    return base.groupBy("family", "pattern").agg(*aggs)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """One row: clusters, share of singletons, those of 2 and of 10 rows or more, and rows covered."""
    return clusters.agg(F.count(F.lit(1)).alias("clusters"), F.avg((F.col("n") == 1).cast("double")).alias("singleton_share"), F.sum((F.col("n") >= 2).cast("long")).alias("n2"),
                        F.sum((F.col("n") >= 10).cast("long")).alias("n10"), F.sum("n").alias("covered"))


def mixed_clusters(rows: DataFrame, least: int = 3) -> DataFrame:
    """Patterns of the hallmark positions and 71, 78, 94 over all families: family histogram, percentiles, cysteine shares."""
    pattern = F.concat(*[R.residue("v", p) for p in [*R.HALLMARKS, 71, 78, 94]])
    base = features(rows).withColumn("pattern", pattern)
    by_family = base.groupBy("pattern", "family").agg(F.count(F.lit(1)).alias("n")).groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list(F.concat("family", F.lit(":"), F.col("n").cast("string")))), ",").alias("families"))
    stats = base.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.percentile("charge", p), 6).alias(f"charge_p{int(p * 100)}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)], F.avg((F.col("n_cys") > 0).cast("double")).alias("with_cys"))
    return stats.filter(F.col("n") >= least).join(by_family, "pattern")


def envelopes(clusters: DataFrame, floor: float = 5.0) -> DataFrame:
    """Mean +- 2 deviations of cluster features, length not below `floor`."""
    out = [F.greatest(F.lit(floor), F.round(F.col("length_mean") - 2 * F.col("length_std"), 6)).alias("length_low"), F.round(F.col("length_mean") + 2 * F.col("length_std"), 6).alias("length_high")]
    for k in ("charge", "aromatic"):
        out += [F.round(F.col(f"{k}_mean") - 2 * F.col(f"{k}_std"), 6).alias(f"{k}_low"), F.round(F.col(f"{k}_mean") + 2 * F.col(f"{k}_std"), 6).alias(f"{k}_high")]
    return clusters.select("family", "pattern", "n", *out)


def triplet_rules(rows: DataFrame, least: int = 3, confidence: float = 0.5) -> DataFrame:
    """Junction rules: the last three residues of cdr3 predict the first three of fr4, within families."""
    base = rows.select("family", F.substring("cdr3", -3, 3).alias("lhs"), F.substring("v", 118, 3).alias("rhs"))
    counts = base.filter(F.concat("lhs", "rhs").rlike(f"^[{R.RESIDUES}]{{6}}$")).groupBy("family", "lhs", "rhs").agg(F.count(F.lit(1)).alias("support"))
    lhs, every = Window.partitionBy("family", "lhs"), Window.partitionBy("family")
    out = counts.withColumns({"n_lhs": F.sum("support").over(lhs), "n_rhs": F.sum("support").over(Window.partitionBy("family", "rhs")), "n_family": F.sum("support").over(every)})
    out = out.withColumns({"rank": F.row_number().over(lhs.orderBy(F.desc("support"), "rhs")), "confidence": F.col("support") * F.lit(1.0) / F.col("n_lhs")})
    out = out.withColumn("lift", F.col("confidence") / (F.col("n_rhs") * F.lit(1.0) / F.col("n_family")))
    return out.filter((F.col("rank") == 1) & (F.col("n_lhs") >= least) & (F.col("confidence") >= confidence)).select("family", "lhs", "rhs", "support", "n_lhs", "confidence", "lift")


def pair_rules(rows: DataFrame, pairs: list[tuple[int, int]], least: int = 5, confidence: float = 0.65) -> DataFrame:
    """Within a cdr3 length-charge bin, a residue at pos1 predicts one at pos2."""
    base = features(rows)
    long = base.select("cdr3_charge", F.explode(F.array(*[F.struct(F.lit(a).alias("pos1"), R.residue("v", a).alias("aa1"), F.lit(b).alias("pos2"), R.residue("v", b).alias("aa2")) for a, b in pairs])).alias("x")).select("cdr3_charge", "x.*")
    counts = long.groupBy("cdr3_charge", "pos1", "aa1", "pos2", "aa2").agg(F.count(F.lit(1)).alias("support"))
    total = Window.partitionBy("cdr3_charge", "pos1", "aa1", "pos2")
    out = counts.withColumn("confidence", F.col("support") * F.lit(1.0) / F.sum("support").over(total))
    return out.filter((F.col("support") >= least) & (F.col("confidence") >= confidence))


def coverage(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many rows have how many filled residues in fr3 and fr4."""
    filled = lambda name: F.length(F.regexp_replace(R.region("v", name), f"[^{R.RESIDUES}]", ""))
    return rows.groupBy(filled("fr3").alias("fr3_filled"), filled("fr4").alias("fr4_filled"), *(by or [])).agg(F.count(F.lit(1)).alias("n"))


def annotation_summary(rows: DataFrame, shard: str = "source") -> DataFrame:
    """Rows and families of each shard, and a total row (null shard)."""
    return rows.rollup(shard).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("family").alias("families"), F.sum((F.col("family") == "VH_like").cast("long")).alias("vh_like"), F.sum(F.col("family").startswith("F_").cast("long")).alias("f_like"))

"""Design support: sampling, selections, rule conversion, pools, ranks, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlens.functions import residues as R


def fixed_sample(rows: DataFrame, shard: str, key: str, n: int) -> DataFrame:
    """n rows of each shard, by a hash of their key."""
    order = Window.partitionBy(shard).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def parse_conditions(rules: DataFrame) -> DataFrame:
    """Condition strings `a=b AND IMGT49=G` as one row for each part: kind, name, value."""
    part = F.explode(F.split("condition", " AND "))
    out = rules.select("*", part.alias("part"))
    return out.withColumns({"name": F.substring_index("part", "=", 1), "value": F.substring_index("part", "=", -1),
                            "kind": F.when(F.col("part").rlike("^IMGT[0-9]+="), "position").when(F.col("part").startswith("cdr3["), "loop_end").otherwise("feature")})


def convert_rules(rules: DataFrame, least: float = 70.0) -> DataFrame:
    """Rules at percent confidence, one for each condition, place and residue, from `least` on, with their tier."""
    out = rules.withColumn("percent", F.col("confidence") * 100).filter(F.col("percent") >= least)
    tier = F.when(F.col("percent") >= 90, "high").when(F.col("percent") >= 80, "medium").otherwise("base")
    return out.withColumn("tier", tier).select("family", "condition", "pos", "aa", "percent", "tier").distinct()


def shared_motifs(profile: DataFrame, group: str = "family", frequency: float = 0.3, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Motifs of one, two or three consensus residues that several groups share, with their mean frequency. A group's
    consensus has a residue a position, so its motifs are taken from one row."""
    strong = profile.filter(F.col("frequency") >= frequency).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "consensus", "frequency"))).alias("m"))
    name = lambda x: F.concat(x["pos"].cast("string"), x["consensus"])
    made = {1: F.transform("m", lambda a: F.struct(name(a).alias("motif"), a["frequency"].alias("f")))}
    two = lambda a, i: F.transform(F.filter("m", lambda b: b["pos"] > a["pos"]), lambda b: F.struct(F.concat_ws(" ", name(a), name(b)).alias("motif"), ((a["frequency"] + b["frequency"]) / 2).alias("f"), b["pos"].alias("last"), (a["frequency"] + b["frequency"]).alias("s")))
    pairs = F.flatten(F.transform("m", two))
    made[2] = F.transform(pairs, lambda p: F.struct(p["motif"], p["f"]))
    made[3] = F.flatten(F.transform(pairs, lambda p: F.transform(F.filter("m", lambda c: c["pos"] > p["last"]), lambda c: F.struct(F.concat_ws(" ", p["motif"], name(c)).alias("motif"), ((p["s"] + c["frequency"]) / 3).alias("f")))))
    out = strong.select(F.explode(F.concat(*[made[k] for k in sizes])).alias("x")).select("x.*")
    return out.groupBy("motif").agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg("f"), 6).alias("mean_frequency")).filter("groups >= 3")


def ranks(frame: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """The n best rows with their global rank, and their rank and rank name within their group."""
    top = frame.orderBy(score, key).limit(n)
    out = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(score, key))).withColumn("group_rank", F.row_number().over(Window.partitionBy(group).orderBy(score, key)))
    return out.withColumn("name", F.concat(F.col(group), F.lit("-"), F.lpad(F.col("group_rank").cast("string"), 4, "0")))


def across_tracks(frame: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the one of highest track, then lowest score, then id."""
    order = Window.partitionBy(key).orderBy(F.desc("track"), "score", "doc_id")
    return frame.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def control_violations(rows: DataFrame, lead: str, allowed: list[int]) -> DataFrame:
    """Positions at which rows differ from the lead though they may not."""
    places = [p for p in range(1, 129) if p not in allowed]
    differ = F.filter(F.array(*[F.when(R.residue("v", p) != lead[p - 1], F.lit(p)) for p in places]), lambda x: x.isNotNull())
    return rows.select("doc_id", F.size(differ).alias("n"), F.array_join(F.slice(differ, 1, 5).cast("array<string>"), ",").alias("first")).filter("n > 0")


def terminal_fix(v: Column) -> Column:
    """A last alanine becomes serine."""
    return F.when(v.endswith("A"), F.concat(F.expr("left(v, length(v) - 1)"), F.lit("S"))).otherwise(v)


def generation_plan(families: DataFrame, total: int, universal: float = 0.3) -> DataFrame:
    """How many candidates each scaffold and group is to have: a universal share, given to the first group by name, and the
    rest of the original scaffold in proportion, in whole numbers that add up to `total`."""
    first = int(round(total * universal))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "family")  # one row a family
    share = families.withColumn("upto", F.floor(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) * (total - first) / F.sum("n").over(Window.partitionBy(F.lit(1)))))
    original = share.select(F.lit("original").alias("scaffold"), "family", (F.col("upto") - F.coalesce(F.lag("upto").over(w), F.lit(0))).cast("long").alias("wanted"))
    return original.union(families.agg(F.min("family").alias("family")).select(F.lit("universal"), "family", F.lit(first).cast("long")))


def hallmark_plan(pool: DataFrame, total: int, lead: str = "YQRL") -> DataFrame:
    """family, hallmarks, wanted: `total` candidates of the original scaffold in equal parts over the families of `pool` (family,
    hallmarks, n; a few rows a family), what is left over to the last by name; and within a family over its hallmarks, `lead`
    first, then the most frequent, of which the first ones take one more where the part doesn't divide. Those with none go."""
    families = pool.select("family").distinct()
    every = Window.partitionBy(F.lit(1))
    families = families.withColumns({"at": F.row_number().over(every.orderBy("family")), "m": F.count(F.lit(1)).over(every)})
    each = F.expr(f"{int(total)} DIV m")
    families = families.select("family", F.when(F.col("at") < F.col("m"), each).otherwise(F.lit(int(total)) - (F.col("m") - 1) * each).alias("part"))
    own = Window.partitionBy("family")
    order = own.orderBy((F.col("hallmarks") == lead).desc(), F.desc("n"), "hallmarks")
    ranked = pool.withColumns({"j": F.row_number().over(order), "k": F.count(F.lit(1)).over(own)}).join(families, "family")
    wanted = F.expr("part DIV k + IF(j <= part % k, 1, 0)").cast("long")
    return ranked.select("family", "hallmarks", wanted.alias("wanted")).filter("wanted > 0")


def fasta_lines(rows: DataFrame) -> DataFrame:
    """One line for each record, header and sequence together, for text sinks."""
    return rows.select("doc_id", F.concat(F.lit(">"), F.concat_ws("|", F.col("doc_id").cast("string"), "source", "family"), F.lit("\n"), F.col("v")).alias("record"))


def ranked_fasta(rows: DataFrame) -> DataFrame:
    """FASTA records of ranked rows: `>rank|id|source|score`, and the residues without gaps."""
    head = F.concat_ws("|", *[F.col(k).cast("string") for k in ("rank", "doc_id", "source", "score")])
    return rows.select("rank", F.concat(F.lit(">"), head, F.lit("\n"), F.translate("v", "-", "")).alias("record"))


def detail_json(rows: DataFrame) -> DataFrame:
    """One JSON document a row, with its marks, scores and provenance nested."""
    scoring = F.struct(R.charge("v").alias("charge"), R.count_of("v", "C").alias("cysteines"))
    return rows.select("doc_id", F.to_json(F.struct("doc_id", F.struct("family", "hallmarks").alias("marks"), scoring.alias("scoring"), F.struct("text_id", "source", "lang").alias("provenance"))).alias("detail"))


def parameter_hash(parameters: dict) -> str:
    """Twelve hex digits of the sorted parameters."""
    import hashlib
    import json

    return hashlib.md5(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:12]


def write_sharded(rows: DataFrame, path: str, by: str | None = None, most: int = 2_000_000) -> DataFrame:
    """Parquet files of at most `most` rows, in folders by a column if given; returns the index of files and rows."""
    writer = rows.write.option("maxRecordsPerFile", most)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))

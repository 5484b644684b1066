"""Registered rule, candidate, classifier and hit queries, each with the same query in SQL; and SQL for queries of other plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strandlens.functions import anchors as A, residues as R
from strandlens.operators import blocks as B, candidates as Q, counts as C, coupling as K, design as D, merge as M, models as L, score as P, search as G, tallies as T
from strandlens.plans.counting import EVERY, FAMILY, LEFTS, RIGHTS, SEQS, SOME, SQL as COUNTED, TOKENS, archetype_sql, association_sql, letters_in, long_sql, pairs_sql, seq, with_
from strandlens.plans.designs import FR1, FR2, FR3, FR4, scratch, spliced
from strandlens.plans.ingest import BASES, BEST, frames_sql, heuristic_sql
from strandlens.plans.working import H, HITS, META, rows_and_queries
from strandlens.sources import records as X
from strandlens.sources.sequences import sequences, table

#: Residues of the universal framework at some places, and what other scaffolds have there instead.
UNIVERSAL = {42: "F", 49: "G", 50: "L", 52: "A", 71: "F", 94: "L", 118: "W"}
SCAFFOLDS = {"universal": {}, "FERG": {49: "E", 50: "R", 52: "G"}, "YERL": {42: "Y", 49: "E", 50: "R", 52: "L"}, "YQRL": {42: "Y", 49: "Q", 50: "R", 52: "L"}, "FQRA": {49: "Q", 50: "R"}}
CELLS = [(k, p, own.get(p, a)) for k, own in SCAFFOLDS.items() for p, a in UNIVERSAL.items()]
LIBRARY = [(k, FR1, FR2 if k != "YERL" else FR2[:1] + "Y" + FR2[2:], FR3, FR4) for k in ("universal", "YERL", "FERG")]
#: region, place in it from 1, residues, exact or similar.
CONSTRAINTS = [("cdr3", 1, "AGST", "exact"), ("fr2", 4, "FW", "similar"), ("fr3", 39, "C", "similar")]
LOOPS = sorted({*LEFTS} - {27, 28, 29})


def names_of(doc_id):
    """A framework's name for each design, one of them unknown."""
    return F.element_at(F.array(*[F.lit(x) for x in ("universal", "YERL", "FERG", "nowhere")]), (F.pmod(doc_id, F.lit(4)) + 1).cast("int"))


def constrained(spark, sf_dir):
    """Whether each sequence meets all constraints on its residues, and how many; from the row itself."""
    good = []
    for region, i, allowed, how in CONSTRAINTS:
        letters = set(allowed).union(*[g for g in R.GROUPS.values() if how == "similar" and set(g) & set(allowed)])
        good.append(R.residue("v", R.REGIONS[region][0] + i - 1).isin(sorted(letters)))
    return sequences(spark, sf_dir).select("doc_id", reduce(lambda x, y: x & y, good).alias("met"), reduce(lambda x, y: x + y, [g.cast("long") for g in good]).alias("n_met"))


def anchored(s):
    out = spliced(s)
    for step in A.anchored_cdr3("v"):
        out = out.withColumns({k: F.expr(x) for k, x in step.items()})
    return out.select("doc_id", "cdr3")


def alternative_bins(s):
    n, q = R.count_of("x", R.RESIDUES), R.charge("x")
    loops = F.explode(F.array(*[F.struct(F.lit(k).alias("region"), R.region("v", k).alias("x")) for k in ("cdr1", "cdr2", "cdr3")]))
    long = s.select("doc_id", loops.alias("l")).select("doc_id", "l.*")
    return long.select("doc_id", "region", F.when(n < 10, "short").when(n < 14, "medium_short").when(n < 18, "medium").when(n < 22, "medium_long").otherwise("long").alias("len_bin"),
                       F.when(q < -2, "very_neg").when(q < -0.5, "negative").when(q < 1, "neutral").when(q < 3, "positive").otherwise("very_pos").alias("charge_bin"), F.when(R.count_of("x", "C") > 0, "with_cys").otherwise("no_cys").alias("cys_bin"))


def loop_bins(s):
    loops = F.explode(F.array(*[F.struct(F.lit(k).alias("region"), R.region("v", k).alias("x")) for k in ("cdr1", "cdr2", "cdr3")]))
    long = s.select("doc_id", loops.alias("l")).select("doc_id", "l.*")
    return long.select("doc_id", "region", R.length_bin(F.length("x")).alias("len_bin"), R.charge_bin(R.charge("x")).alias("charge_bin"), R.cysteine_bin(R.count_of("x", "C")).alias("cys_bin"))


def germline(s):
    n, a, d = R.count_of("v", "C"), R.residue("v", 42), R.residue("v", 52)
    family = F.when((a == "V") & (d == "W"), "VH_like").when(a.isin("Y", "F") & (d == "W"), "VHH_W52").when(a.isin("Y", "F"), F.concat(a, F.when(n >= 4, "_C4").otherwise("_C2"))).otherwise("Other_VHH")
    return s.select("doc_id", family.alias("germline"), F.concat_ws("-", *[R.residue("v", p) for p in R.HALLMARKS]).alias("motif"))


def cysteine_class(s):
    a, b = R.residue("v", 55) == "C", R.residue("v", 100) == "C"
    return s.select("doc_id", F.when(a & b, "C4").when(a | b, "INVALID").otherwise("C2").alias("cys_class"))


def weighted_hits(spark, sf_dir):
    made = G.pair_values(*rows_and_queries(spark, sf_dir), ["doc_id"], {"score": G.loop_score(("cdr1", "cdr3"))})
    return made.withColumn("score", F.round("score", 9))


def ruled_hits(spark, sf_dir):
    rows, asked = rows_and_queries(spark, sf_dir)
    rules = {"cdr3": lambda loops: loops["cdr3"].identity, "cdr1": lambda loops: loops["cdr1"].identity, "cdr1+cdr2+cdr3": G.loop_score()}
    parts = [G.best_pairs(rows, asked, score).select(F.lit(rule).alias("rule"), "query_id", "doc_id", "rank") for rule, score in rules.items()]
    return reduce(lambda a, b: a.union(b), parts)


def annotated_coverage(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("text_id")).distinct()
    return G.window_coverage(sequences(spark, sf_dir).join(good, "text_id", "left_semi"), G.queries(table(spark, sf_dir, "benchmark")))


def scored_candidates(spark, sf_dir):
    s = sequences(spark, sf_dir)
    first = s.groupBy("source").agg(F.min("doc_id").alias("first"))
    rows = s.join(first, "source").select("doc_id", "source", (F.col("doc_id") == F.col("first")).alias("is_lead"), F.when(F.pmod("doc_id", F.lit(11)) != 0, R.sample_key(F.col("doc_id")) / 1e6).alias("loss"), (F.pmod("doc_id", F.lit(97)) / 97.0).alias("naturalness"))
    return Q.combined_score(rows, "source").select("doc_id", "combined")


def loop_rules(s):
    return K.associations(s, LOOPS, RIGHTS, least=5, by=["family"])


def fitted(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return Q.scaffold_fit(s, loop_rules(s), spark.createDataFrame(CELLS, "scaffold string, pos int, aa string"), cut=40)


def applied(s):
    return Q.applicable_rules(s, T.mined(s)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("obeyed").alias("obeyed"))


def merged_rules(spark, sf_dir):
    """Places and residues of strict rules at some positions, and those that weaker rules at all positions add. A rule's figures
    are those of its own place, and what reaches 0.7 ranks first there, so the strict rules are among the weaker ones, which are
    mined once and stored, as they are read three times."""
    path = f"{scratch(spark)}/rules"
    T.mined(sequences(spark, sf_dir), mode="all", min_confidence=0.5).write.parquet(path)
    weaker = spark.read.parquet(path)
    strict = weaker.filter((F.col("confidence") >= 0.7) & F.col("pos").isin(R.positions("fr3fr4")))
    return M.merge_rules(D.convert_rules(strict).select("pos", "aa").distinct(), weaker.select("pos", "aa").distinct())


def natural_designs(spark, sf_dir):
    """Rules and archetypes come from one counting pass; what they are made of is stored, as it is read three times."""
    s, path, places = sequences(spark, sf_dir), f"{scratch(spark)}/found", R.positions("fr3fr4")
    B.found(B.packed(s, places), places, {"obs": 5, "support": 3, "confidence": 0.7}).write.parquet(path)
    found = spark.read.parquet(path)
    return Q.naturalness_by_rules(s, B.family_archetypes(found), B.family_rules(found))


def library_designs(spark, sf_dir):
    s = sequences(spark, sf_dir)
    designs = s.select("doc_id", names_of(F.col("doc_id")).alias("name"), *[R.region("v", k).alias(k) for k in ("cdr1", "cdr2", "cdr3")])
    return Q.framework_library(designs, spark.createDataFrame(LIBRARY, "name string, FR1 string, FR2 string, FR3 string, FR4 string"))


QUERIES = {
    "P06_positional_families": seq(lambda s: s.select("doc_id", R.family_positional("v").alias("family"))),
    "P07_classical_families": seq(lambda s: s.groupBy(R.family_classical("v").alias("family")).agg(F.count(F.lit(1)).alias("n"))),
    "P08_light_families": seq(lambda s: s.select("doc_id", R.family_light(F.col("hallmarks")).alias("family"))),
    "P09_germline_families": seq(germline),
    "P10_framework_types": seq(lambda s: s.groupBy(R.framework_type(F.col("hallmarks")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))),
    "P03_position_sets": seq(lambda s: reduce(lambda a, b: a.union(b), [C.long_residues(s, R.positions(m), []).groupBy("pos").agg(F.count_if(C.valid()).alias("n")).select(F.lit(m).alias("mode"), "pos", "n") for m in ("vernier", "fr3fr4", "all")])),
    "P15_cysteine_class": seq(cysteine_class),
    "P17_pattern_split": seq(lambda s: s.select("doc_id", *[x.alias(k) for k, x in Q.pattern_split(F.rtrim("v", F.lit("-")), R.region("v", "cdr1"), R.region("v", "cdr2"), F.col("cdr3")).items()])),
    "P18_constraints": constrained,
    "F02_loop_bins": seq(loop_bins),
    "F04_alternative_bins": seq(alternative_bins),
    "F12_weighted_score": weighted_hits,
    "F14_anchored_cdr3": seq(anchored),
    "J02_condition_lift": seq(lambda s: Q.condition_lift(s, SOME)),
    "J03_region_properties": lambda spark, d: Q.region_properties(sequences(spark, d), spark),
    "J04_applicable_rules": seq(applied),
    "J08_shared_pairs": seq(lambda s: D.shared_motifs(C.archetypes(s, "hallmarks", least=5), "hallmarks", 0.5, sizes=(2,))),
    "J10_framework_library": library_designs,
    "J11_partners": lambda spark, d: Q.partner_completion(sequences(spark, d)),
    "W01_ranked_suggestions": seq(lambda s: T.mined(s, min_confidence=0.2, top=3).select("family", "condition", "pos", "rank", "aa", "support")),
    "W04_hallmarks_by_cluster": seq(lambda s: P.capped(s.groupBy("family", "hallmarks").agg(F.count(F.lit(1)).alias("n")), "family", [F.desc("n"), "hallmarks"], 2)),
    "T03_ruled_hits": ruled_hits,
    "G05_annotated_coverage": annotated_coverage,
    "U04_rule_merge": merged_rules,
    "M03_capped_information": seq(lambda s: K.mutual_information(s, EVERY, rate=500_000)),
    "M04_capped_sample": seq(lambda s: X.capped_sample(s.select("doc_id", R.residue("v", 71).alias("aa")), ["aa"], "doc_id", 20)),
    "D03_family_probability": seq(lambda s: Q.family_terms(s, C.archetypes(s)).select("doc_id", "family", F.round("probability", 9).alias("probability"))),
    "D05_rule_naturalness": natural_designs,
    "D06_combined_score": scored_candidates,
    "D13_scaffold_fit": fitted,
    "D14_rule_tiers": seq(lambda s: Q.rule_tiers(s, T.mined(s), UNIVERSAL)),
    "L03_coefficients": seq(lambda s: L.coefficients(s, 71)),
}

TOKEN_LIST = TOKENS + ", 'cdr3[-2]=' || substr(cdr3, -2, 1), 'cdr3[-3]=' || substr(cdr3, -3, 1)]"
RULES = f"r AS (SELECT * FROM ({COUNTED['A01_rule_mining']}) WHERE rank = 1)"
APPLIED = f"""{RULES}, tok AS (SELECT doc_id, v, family AS own, unnest({TOKEN_LIST}) AS condition FROM s),
app AS (SELECT doc_id, own, r.family, condition, pos, aa AS wanted, confidence, substr(v, pos, 1) = aa AS obeyed FROM tok JOIN r USING (condition))"""
ARCHETYPES = f"ar AS (SELECT * FROM ({with_(archetype_sql('family', 1))}))"
TERMS = f"""{ARCHETYPES}, fm AS (SELECT doc_id, ar.family, cdr3_len, hallmarks, sum(CASE WHEN substr(v, pos, 1) = consensus THEN CASE WHEN pos >= 66 THEN 2 ELSE 1 END ELSE 0 END)::DOUBLE AS hit, sum(CASE WHEN pos >= 66 THEN 2 ELSE 1 END)::DOUBLE AS total,
 sum((pos >= 66 AND substr(v, pos, 1) = consensus)::INT) / sum((pos >= 66)::INT)::DOUBLE AS core FROM s, ar WHERE ar.family <> 'VH_like' GROUP BY ALL),
fs AS (SELECT *, (hit + CASE WHEN family LIKE 'F^_%' ESCAPE '^' THEN CASE WHEN cdr3_len <> 'long' THEN 1.0 ELSE 0.5 END WHEN family LIKE 'Y^_%' ESCAPE '^' THEN CASE WHEN cdr3_len <> 'short' THEN 1.0 ELSE 0.5 END ELSE 0.7 END::DOUBLE
 + CASE WHEN (family LIKE 'F^_%' ESCAPE '^' OR family LIKE 'Y^_%' ESCAPE '^') AND left(hallmarks, 1) = left(family, 1) THEN 2.0 WHEN family = 'Other_VHH' THEN 1.0 ELSE 0.0 END::DOUBLE) / (total + 3.0::DOUBLE) AS score FROM fm),
ft AS (SELECT doc_id, family, hallmarks, core, score / sum(score) OVER (PARTITION BY doc_id) AS probability FROM fs)"""


def match_sql(wanted: str) -> str:
    mates = lambda a: ", ".join(repr(x) for x in next((v for v in R.GROUPS.values() if a in v), a))
    return "((" + " + ".join(f"CASE WHEN {H[k]} = '{a}' THEN 1.0::DOUBLE WHEN {H[k]} IN ({mates(a)}) THEN 0.5 ELSE 0 END" for k, a in enumerate(wanted, 1)) + ") / 4)"


def position_set(mode: str) -> str:
    return f"SELECT '{mode}' AS mode, p.pos::INTEGER AS pos, sum((substr(v, p.pos, 1) <> '-')::INT)::BIGINT AS n FROM s, (SELECT unnest({R.positions(mode)}) AS pos) p GROUP BY p.pos"


def ranked_hits(rule: str, score: str) -> str:
    return f"SELECT '{rule}' AS rule, query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, doc_id)::INTEGER AS rank FROM ids) WHERE rank <= 3"


def weighted_sql(loops: dict[int, float]) -> str:
    top = " + ".join(f"CASE WHEN i{k} > 0 THEN i{k} * {w}::DOUBLE ELSE 0 END" for k, w in loops.items())
    below = " + ".join(f"CASE WHEN i{k} > 0 THEN {w}::DOUBLE ELSE 0 END" for k, w in loops.items())
    return f"coalesce((0.0::DOUBLE + {top}) / nullif(0.0::DOUBLE + {below}, 0), 0)"


def anchored_sql(source: str) -> str:
    out = source
    for step in A.anchored_cdr3("v", "strpos"):
        out = f"SELECT * {'EXCLUDE (cdr3) ' if 'cdr3' in step and source == out else ''}, {', '.join(f'{x} AS {k}' for k, x in step.items())} FROM ({out})"
    return f"SELECT doc_id, cdr3 FROM ({out})"


SPLICED = f"sp AS (SELECT doc_id, '{FR1}' || translate(substr(v, 27, 12), 'CW', 'SA') || '{FR2}' || translate(substr(v, 56, 10), 'CW', 'SA') || '{FR3}' || translate(cdr3, 'CW', 'SA') || '{FR4}' AS v FROM s)"
SPLIT = "^(.{15,30}?C)(.{3,17}?)(W[YFVIL]RQ.{9,11}?)(.{3,12}?)(.{30,45}C)(.{3,35}?)(WG[QR]GT.*)$"
LOOP_ROWS = "l3 AS (SELECT doc_id, unnest(['cdr1', 'cdr2', 'cdr3']) AS region, unnest([substr(v, 27, 12), substr(v, 56, 10), cdr3]) AS x FROM s)"
QX = f"({letters_in('x', 'KRH')} - {letters_in('x', 'DE')})"
WHERES = {"cdr3": 105, "fr2": 39, "fr3": 66}


def constraint_sql() -> str:
    parts = []
    for k, i, allowed, how in CONSTRAINTS:
        aa = f"substr(v, {WHERES[k] + i - 1}, 1)"
        mates = "".join(g for g in R.GROUPS.values() if any(a in g for a in allowed)) if how == "similar" else ""
        parts.append(f"({aa} IN ({', '.join(repr(x) for x in dict.fromkeys(allowed + mates))}))")
    return SEQS + f" SELECT doc_id, {' AND '.join(parts)} AS met, ({' + '.join(f'{x}::INT' for x in parts)})::BIGINT AS n_met FROM s"


def coded(*cuts: tuple[int, int]) -> str:
    """The letters of a numbered row's slices: every seventh place is a gap, those beyond 190 are padding."""
    places = " || ".join(f"coalesce(list_aggregate(list_transform(list_filter(range({a + 1}, {b + 1}), lambda p: p % 7 <> 0 AND p <= 190), lambda p: upper(substr(w, p, 1))), 'string_agg', ''), '')" for a, b in cuts)
    return f"({places})"


TAIL_SQL = f"CASE WHEN starts_with(tail, 'C') AND contains(tail, 'W') THEN string_split(tail, 'W')[1] ELSE tail END"

def drawn_sql(*parts: str) -> str:
    """The hashed draw of a lead, a family, a word and columns."""
    text = " || '|' || ".join(["doc_id", "family", f"'{parts[0]}'", *[x if x.isalpha() else f"'{x}'" for x in parts[1:]]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % 1000000)"


def windowed_sql(track: int, least: int, most: int) -> str:
    """CTE k<track>: changes inside of a drawn window of consensus places, and the rank of those outside."""
    return f"""z{track} AS (SELECT *, {least} + {drawn_sql('size', str(track))} % {most - least + 1} AS size FROM b), y{track} AS (SELECT *, 1 + {drawn_sql('start', str(track))} % (greatest(places - size, 0) + 1) AS start FROM z{track}),
x{track} AS (SELECT *, i BETWEEN start AND start + size - 1 AS inside FROM y{track}), k{track} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, family, inside ORDER BY {drawn_sql('extra', str(track), 'pos')}, pos) AS rank FROM x{track})"""


SQL = {
    "P06_positional_families": SEQS + " SELECT doc_id, CASE WHEN family LIKE 'F_C_' OR family LIKE 'Y_C_' THEN left(family, 1) || CASE WHEN substr(v, 55, 1) = 'C' AND substr(v, 100, 1) = 'C' THEN '_C4' ELSE '_C2' END ELSE family END AS family FROM s",
    "P07_classical_families": SEQS + f" SELECT CASE WHEN {H[3]} = 'L' THEN 'VH_like' WHEN {H[1]} IN ('F', 'Y') AND {H[2]} IN ('E', 'Q') AND {H[3]} = 'R' THEN CASE WHEN {letters_in('v', 'C')} IN (2, 4) THEN {H[1]} || '_C' || {letters_in('v', 'C')} ELSE 'Classical_other' END WHEN {H[4]} = 'W' THEN 'VHH_W52' ELSE 'Non_classical' END AS family, count(*) AS n FROM s GROUP BY 1",
    "P08_light_families": SEQS + " SELECT doc_id, CASE WHEN hallmarks LIKE 'Y%' THEN 'Y_like' WHEN hallmarks LIKE 'FER%' THEN 'F_C2' WHEN hallmarks LIKE 'VG%' THEN 'VH_like' ELSE 'other' END AS family FROM s",
    "P09_germline_families": SEQS + f" SELECT doc_id, CASE WHEN {H[1]} = 'V' AND {H[4]} = 'W' THEN 'VH_like' WHEN {H[1]} IN ('Y', 'F') AND {H[4]} = 'W' THEN 'VHH_W52' WHEN {H[1]} IN ('Y', 'F') THEN {H[1]} || CASE WHEN {letters_in('v', 'C')} >= 4 THEN '_C4' ELSE '_C2' END ELSE 'Other_VHH' END AS germline, {' || chr(45) || '.join(H.values())} AS motif FROM s",
    "P10_framework_types": SEQS + f" SELECT CASE WHEN {H[1]} IN ('F', 'Y') AND {H[2]} IN ('E', 'Q') AND {H[3]} = 'R' AND {H[4]} IN ('G', 'L', 'F', 'A') THEN 'Classical_VHH' WHEN {H[1]} = 'V' AND {H[4]} = 'W' THEN 'VH' WHEN {H[1]} IN ('F', 'Y') AND {H[4]} IN ('G', 'L', 'F', 'A') AND ({H[2]} = 'G' OR {H[3]} = 'L') THEN 'Humanized_VHH' WHEN {H[1]} = 'V' THEN 'VH_like' ELSE 'Mixed' END AS kind, count(*) AS n FROM s GROUP BY 1",
    "P03_position_sets": SEQS + " " + " UNION ALL ".join(map(position_set, ("vernier", "fr3fr4", "all"))),
    "P15_cysteine_class": SEQS + " SELECT doc_id, CASE WHEN substr(v, 55, 1) = 'C' AND substr(v, 100, 1) = 'C' THEN 'C4' WHEN substr(v, 55, 1) = 'C' OR substr(v, 100, 1) = 'C' THEN 'INVALID' ELSE 'C2' END AS cys_class FROM s",
    "P17_pattern_split": SEQS + """, p AS (SELECT doc_id, rtrim(v, '-') AS v, substr(v, 27, 12) AS c1, substr(v, 56, 10) AS c2, cdr3 AS c3 FROM s), q AS (SELECT *, strpos(v, c1) AS a, strpos(v, c2) AS b, strpos(v, c3) AS c FROM p),
f AS (SELECT doc_id, a, b, c, substr(v, 1, a - 1) AS fr1, CASE WHEN b > a + 12 THEN substr(v, a + 12, b - a - 12) ELSE '' END AS fr2, CASE WHEN c > b + 10 THEN substr(v, b + 10, c - b - 10) ELSE '' END AS fr3, substr(v, c + 13) AS fr4 FROM q),
g AS (SELECT *, b > a AND c > b AND length(fr1) BETWEEN 10 AND 40 AND length(fr2) BETWEEN 10 AND 25 AND length(fr3) BETWEEN 20 AND 50 AND length(fr4) BETWEEN 5 AND 20 AS good FROM f)
SELECT doc_id, CASE WHEN good THEN fr1 END AS fr1, CASE WHEN good THEN fr2 END AS fr2, CASE WHEN good THEN fr3 END AS fr3, CASE WHEN good THEN fr4 END AS fr4 FROM g""",
    "P18_constraints": constraint_sql(),
    "F02_loop_bins": SEQS + f", {LOOP_ROWS} SELECT doc_id, region, CASE WHEN length(x) <= 8 THEN 'short' WHEN length(x) <= 14 THEN 'medium' ELSE 'long' END AS len_bin, CASE WHEN {QX} <= -2 THEN 'negative' WHEN {QX} >= 2 THEN 'positive' ELSE 'neutral' END AS charge_bin, CASE WHEN {letters_in('x', 'C')} = 0 THEN 'no_cys' WHEN {letters_in('x', 'C')} = 1 THEN 'one_cys' ELSE 'multi_cys' END AS cys_bin FROM l3",
    "F04_alternative_bins": SEQS + f", {LOOP_ROWS} SELECT doc_id, region, CASE WHEN length(x) < 10 THEN 'short' WHEN length(x) < 14 THEN 'medium_short' WHEN length(x) < 18 THEN 'medium' WHEN length(x) < 22 THEN 'medium_long' ELSE 'long' END AS len_bin, CASE WHEN {QX} < -2 THEN 'very_neg' WHEN {QX} < -0.5 THEN 'negative' WHEN {QX} < 1 THEN 'neutral' WHEN {QX} < 3 THEN 'positive' ELSE 'very_pos' END AS charge_bin, CASE WHEN {letters_in('x', 'C')} > 0 THEN 'with_cys' ELSE 'no_cys' END AS cys_bin FROM l3",
    "F12_weighted_score": with_(HITS + f" SELECT query_id, doc_id, round({weighted_sql({1: 0.2, 3: 0.5})}, 9) AS score FROM ids"),
    "F14_anchored_cdr3": with_(SPLICED + " " + anchored_sql("SELECT * FROM sp")),
    "J02_condition_lift": with_(f"""{long_sql('l', 'family, cdr3_charge', SOME)}, k AS (SELECT family, cdr3_charge, pos, aa, count(*) AS n FROM l GROUP BY ALL),
fk AS (SELECT family, pos, aa, sum(n) AS m FROM k GROUP BY ALL), fa AS (SELECT *, m * 1.0::DOUBLE / t AS f FROM (SELECT *, sum(m) OVER (PARTITION BY family, pos) AS t FROM fk)),
gk AS (SELECT pos, aa, sum(n) AS m FROM k GROUP BY ALL), ga AS (SELECT pos, aa, m * 1.0::DOUBLE / sum(m) OVER (PARTITION BY pos) AS g FROM gk),
w AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY family, cdr3_charge, pos) AS share FROM k)
SELECT family, cdr3_charge AS condition, pos, aa, n, round(share / CASE WHEN t >= 50 THEN f ELSE g END, 9) AS lift FROM w JOIN fa USING (family, pos, aa) JOIN ga USING (pos, aa)"""),
    "J03_region_properties": with_(long_sql("l", "", list(range(1, 129))) + ", t(aa, charge, hydro, volume) AS (VALUES " + ", ".join(f"('{a}', {int(a in 'KRH') - int(a in 'DE')}, {R.HYDROPHOBICITY[a]}, {R.VOLUME[a]})" for a in R.RESIDUES) + "), g(region, low, high) AS (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in R.REGIONS.items()) + ") SELECT region, count(*) AS n, sum(charge)::BIGINT AS charge, sum(hydro)::BIGINT AS hydro, sum(volume)::BIGINT AS volume FROM l JOIN t USING (aa) JOIN g ON pos BETWEEN low AND high GROUP BY 1"),
    "J04_applicable_rules": with_(APPLIED + " SELECT doc_id, count(*) AS n, sum(obeyed::INT)::BIGINT AS obeyed FROM app GROUP BY 1"),
    "J08_shared_pairs": f"WITH a AS ({with_(archetype_sql('hallmarks', 1, 5))}), g AS (SELECT * FROM a WHERE frequency >= 0.5) SELECT x.pos || x.consensus || ' ' || y.pos || y.consensus AS motif, count(*) AS groups, round(avg((x.frequency + y.frequency) / 2), 6) AS mean_frequency FROM g x JOIN g y ON x.hallmarks = y.hallmarks AND x.pos < y.pos GROUP BY ALL HAVING count(*) >= 3",
    "J10_framework_library": SEQS + ", lib(k, name, f1, f2, f3, f4) AS (VALUES " + ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in row) + ")" for i, row in enumerate(LIBRARY)) + ") SELECT doc_id, name, f1 || substr(v, 27, 12) || f2 || substr(v, 56, 10) || f3 || cdr3 || f4 AS sequence FROM s JOIN lib ON doc_id % 4 = k",
    "J11_partners": SEQS + ", pt(pos, aa, partner, wanted, c) AS (VALUES " + ", ".join(str(x) for x in Q.PARTNERS if x[4] >= 0.8) + f"""), m AS (SELECT doc_id, pos, pt.aa, partner, wanted, substr(v, partner, 1) AS own FROM s JOIN pt ON substr(v, pos, 1) = pt.aa)
SELECT doc_id, pos, aa, partner, wanted, CASE WHEN own = wanted THEN 'present' WHEN partner IN ({', '.join(map(str, Q.PROTECTED))}) THEN 'protected' WHEN count(DISTINCT wanted) OVER (PARTITION BY doc_id, partner) > 1 THEN 'conflict' ELSE 'added' END AS state FROM m""",
    "W01_ranked_suggestions": "SELECT family, condition, pos, rank, aa, support FROM (" + COUNTED["A01_rule_mining"].replace("confidence >= 0.7", "confidence >= 0.2").replace("WHERE rank <= 2", "WHERE rank <= 3") + ")",
    "W04_hallmarks_by_cluster": SEQS + " SELECT family, hallmarks, n, rank FROM (SELECT family, hallmarks, count(*) AS n, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, hallmarks)::INTEGER AS rank FROM s GROUP BY 1, 2) WHERE rank <= 2",
    "T03_ruled_hits": with_(HITS + " " + " UNION ALL ".join([ranked_hits("cdr3", "i3"), ranked_hits("cdr1", "i1"), ranked_hits("cdr1+cdr2+cdr3", weighted_sql({1: 0.2, 2: 0.3, 3: 0.5}))])),
    "G05_annotated_coverage": with_(HITS + ", n AS (SELECT length(replace(v, '-', '')) AS n FROM s WHERE text_id IN (SELECT doc_id FROM labels WHERE quality = 1)) SELECT query_id, " + ", ".join(f"(SELECT count(*) FROM n WHERE abs(n - length(replace(qv, '-', ''))) <= {w}) AS within_{w}" for w in (1, 2, 3, 5)) + " FROM q"),
    "U04_rule_merge": f"WITH a AS (SELECT DISTINCT pos, aa FROM ({COUNTED['A01_rule_mining']}) WHERE confidence * 100 >= 70), b AS (SELECT DISTINCT pos, aa FROM (" + COUNTED["A01_rule_mining"].replace("confidence >= 0.7", "confidence >= 0.5").replace(str(R.positions("fr3fr4")), str(R.positions("all"))) + ")) SELECT pos, aa FROM a UNION ALL SELECT pos, aa FROM b WHERE (pos, aa) NOT IN (SELECT (pos, aa) FROM a)",
    "M03_capped_information": SEQS.replace("s AS (SELECT *, CASE", "s9 AS (SELECT *, CASE") + ", s AS (SELECT * FROM s9 WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000000 < 500000),\n" + pairs_sql(EVERY) + " SELECT pos1, pos2, n, round(mi, 6) + 0.0::DOUBLE AS mi FROM i",
    "M04_capped_sample": SEQS + " SELECT doc_id, aa FROM (SELECT doc_id, substr(v, 71, 1) AS aa, row_number() OVER (PARTITION BY substr(v, 71, 1) ORDER BY md5(doc_id::VARCHAR), doc_id) AS rk FROM s) WHERE rk <= 20",
    "D03_family_probability": with_(TERMS + " SELECT doc_id, family, round(probability, 9) AS probability FROM ft"),
    "D05_rule_naturalness": with_(f"""{APPLIED}, {TERMS}, co AS (SELECT doc_id, family, sum(CASE WHEN obeyed THEN confidence ELSE 0 END) / sum(confidence) AS compliance FROM app GROUP BY 1, 2),
bo AS (SELECT ft.*, coalesce(compliance, 1.0::DOUBLE) AS compliance FROM ft LEFT JOIN co USING (doc_id, family)),
na AS (SELECT doc_id, sum(CASE WHEN probability >= 0.15 THEN probability * compliance ELSE 0 END) AS nat FROM bo GROUP BY 1),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(probability, 9) DESC, family) AS rk FROM bo) WHERE rk = 1)
SELECT doc_id, family, round(nat, 9) AS naturalness, round(least(100.0::DOUBLE, 100.0::DOUBLE * (0.25 * CASE {' '.join(f"WHEN family = '{k}' THEN {match_sql(x)}" for k, x in Q.EXPECTED.items())} ELSE 0 END + 0.25 * core + 0.5 * nat)), 7) AS confidence FROM be JOIN na USING (doc_id)"""),
    "D06_combined_score": SEQS + """, c AS (SELECT doc_id, source, doc_id = min(doc_id) OVER (PARTITION BY source) AS is_lead, CASE WHEN doc_id % 11 <> 0 THEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000000 / 1e6::DOUBLE END AS loss, doc_id % 97 / 97.0::DOUBLE AS nat FROM s),
e AS (SELECT *, min(loss) OVER (PARTITION BY source) AS lo, max(loss) OVER (PARTITION BY source) AS hi FROM c)
SELECT doc_id, CASE WHEN is_lead THEN 999.0::DOUBLE ELSE round((1 - nat) * (0.7::DOUBLE / 0.9::DOUBLE) + coalesce((loss - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END, 0.5::DOUBLE) * (0.2::DOUBLE / 0.9::DOUBLE), 9) END AS combined FROM e""",
    "D13_scaffold_fit": with_(association_sql("a", "family", 5) + f""", st AS (SELECT * FROM a WHERE confidence * 100 >= 40 AND pos1 IN ({', '.join(map(str, LOOPS))})),
md AS (SELECT * FROM (SELECT doc_id, pos2 AS pos, predicted, confidence, row_number() OVER (PARTITION BY doc_id, pos2 ORDER BY confidence DESC, predicted) AS rk FROM s JOIN st ON s.family = st.family AND substr(v, pos1, 1) = aa1) WHERE rk = 1),
cells(scaffold, pos, aa) AS (VALUES {', '.join(str(x) for x in CELLS)}),
sc AS (SELECT doc_id, scaffold, round(100 * sum(CASE WHEN aa = predicted THEN confidence ELSE 0 END) / sum(confidence), 6) AS fit, sum((aa <> predicted)::INT)::BIGINT AS grafts FROM md JOIN cells USING (pos) GROUP BY 1, 2),
ev AS (SELECT s.doc_id, x.scaffold, coalesce(fit, 100.0::DOUBLE) AS fit, coalesce(grafts, 0) AS grafts FROM s CROSS JOIN (SELECT DISTINCT scaffold FROM cells) x LEFT JOIN sc ON sc.doc_id = s.doc_id AND sc.scaffold = x.scaffold)
SELECT doc_id, scaffold, fit, grafts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fit DESC, scaffold) AS rk FROM ev) WHERE rk = 1"""),
    "D14_rule_tiers": with_(f"""{APPLIED}, b AS (SELECT * FROM (SELECT doc_id, pos, wanted AS aa, confidence, row_number() OVER (PARTITION BY doc_id, pos ORDER BY confidence DESC, wanted) AS rk FROM app WHERE family = own AND confidence >= 0.8) WHERE rk = 1)
SELECT doc_id, pos, aa, confidence, CASE WHEN confidence >= 0.9 THEN 'high' WHEN pos IN ({', '.join(map(str, Q.HUMANIZED))}) THEN 'medium_humanized' ELSE 'medium' END AS tier FROM b WHERE NOT ({' OR '.join(f"(pos = {p} AND aa = '{a}')" for p, a in UNIVERSAL.items())})"""),
    # queries of other plans
    "S04_numbered_decode": with_(f"cw AS (SELECT doc_id, v || v AS w FROM s) SELECT doc_id, {coded((16, 190))} AS whole FROM cw"),
    "S05_numbered_regions": with_(f"cw AS (SELECT doc_id, v || v AS w FROM s), ct AS (SELECT *, {coded((150, 190))} AS tail FROM cw) SELECT doc_id, {coded((39, 46))} AS cdr1, {coded((66, 75), (85, 91))} AS cdr2, {TAIL_SQL} AS cdr3, {coded((0, 27), (46, 65), (91, 150), (190, 200))} AS frameworks, {coded((16, 190))} AS whole FROM ct"),
    "F07_six_frames": f"WITH d AS (SELECT doc_id, {BASES} AS b FROM documents), {frames_sql('d', 'b')} SELECT * FROM f",
    "P13_read_filter": f"WITH d AS (SELECT doc_id, {BASES} AS b FROM documents), {frames_sql('d', 'b')} SELECT doc_id, frame, NOT regexp_matches(protein, '\\*.') AND length(rtrim(protein, '*')) >= 25 AS kept FROM f",
    "I02_best_frame": f"WITH d AS (SELECT doc_id, {BASES} AS b FROM documents), {frames_sql('d', 'b')}, {BEST} SELECT * FROM b",
    "F13_heuristic_cdr3": with_(f"{SPLICED} SELECT doc_id, {heuristic_sql('v')} AS cdr3 FROM sp"),
    "F15_anchor_split": with_(f"{SPLICED} SELECT doc_id, " + ", ".join(f"regexp_extract(v, '{SPLIT}', {i}) AS {k}" for i, k in enumerate(("fr1", "cdr1", "fr2", "cdr2", "fr3", "cdr3", "fr4"), 1)) + " FROM sp"),
    "J09_rules_not_known": f"WITH a AS ({COUNTED['A01_rule_mining']}), b AS ({COUNTED['A02_global_rules']}) SELECT condition, pos, aa FROM a UNION ALL SELECT condition, pos, aa FROM b WHERE (pos, aa) NOT IN (SELECT (pos, aa) FROM a)",
    "A32_violations": with_(APPLIED + " SELECT condition, pos, wanted, count(*) AS n FROM app WHERE family = own AND NOT obeyed GROUP BY ALL ORDER BY n DESC, condition, pos, wanted LIMIT 10"),
    "D04_rule_compliance": with_(f"""{APPLIED}, o AS (SELECT * FROM app WHERE family = own), k AS (SELECT doc_id, count(*) AS applicable, sum(obeyed::INT)::BIGINT AS obeyed, round(sum(CASE WHEN obeyed THEN confidence ELSE 0 END) / sum(confidence), 6) AS compliance FROM o GROUP BY 1),
br AS (SELECT doc_id, string_agg(pos || wanted, ',' ORDER BY confidence DESC, pos, wanted, condition) AS violations FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, pos, wanted, condition) AS rk FROM o WHERE NOT obeyed) WHERE rk <= 5 GROUP BY 1)
SELECT s.doc_id, coalesce(applicable, 0) AS applicable, coalesce(obeyed, 0) AS obeyed, coalesce(compliance, 1.0::DOUBLE) AS compliance, coalesce(violations, '') AS violations FROM s LEFT JOIN k USING (doc_id) LEFT JOIN br USING (doc_id)"""),
    "D08_candidates": with_(f"""{HITS}, ld AS (SELECT query_id AS doc_id, qv AS v FROM q), {ARCHETYPES}, rk AS (SELECT family, pos, consensus, row_number() OVER (PARTITION BY family ORDER BY pos) AS i, count(*) OVER (PARTITION BY family) AS places FROM ar),
b AS (SELECT doc_id, rk.family, i, places, pos, substr(v, pos, 1) || pos || consensus AS change FROM ld, rk WHERE pos NOT IN ({', '.join(map(str, P.PROTECTED))}) AND substr(v, pos, 1) NOT IN ('C', '-', consensus)),
k1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, family ORDER BY {drawn_sql('probe', 'pos')}, pos) AS rank FROM b),
{windowed_sql(2, 2, 3)}, {windowed_sql(3, 3, 5)},
k4 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, family, draw ORDER BY chance, pos) AS rank FROM (SELECT *, {drawn_sql('draw', 'draw', 'pos')} AS chance FROM b, (SELECT unnest(range(0, 4)) AS draw)) WHERE chance < 300000),
u AS (SELECT doc_id, family, 0 AS track, 1 AS draw, pos, change FROM b UNION ALL SELECT doc_id, family, 1, rank, pos, change FROM k1 WHERE rank <= {P.PROBES} UNION ALL SELECT doc_id, family, 2, 0, pos, change FROM k2 WHERE inside OR rank <= {P.EXTRA[2]}
 UNION ALL SELECT doc_id, family, 3, 0, pos, change FROM k3 WHERE inside OR rank <= {P.EXTRA[3]} UNION ALL SELECT doc_id, family, 4, draw, pos, change FROM k4 WHERE rank <= {P.LAYER})
SELECT doc_id, family, track::INTEGER AS track, draw::INTEGER AS draw, count(*) AS n_mutations, string_agg(change, ',' ORDER BY pos) AS mutations FROM u GROUP BY ALL UNION ALL SELECT doc_id, x.family, 0, 0, 0, '' FROM ld, (SELECT DISTINCT family FROM ar) x"""),
    "D07_motif_pool": f"WITH a AS ({with_(archetype_sql('family', 1))}), m AS (SELECT family, list(pos || consensus ORDER BY pos) AS m FROM a GROUP BY 1) SELECT DISTINCT list_aggregate(list_slice(m, i, i + k - 1), 'string_agg', ' ') AS motif FROM m, range(2, 6) x(k), range(1, 17) y(i) WHERE i + k - 1 <= len(m)",
}

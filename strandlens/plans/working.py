"""Registered classifier, function, merge, search and scoring queries, each with the same query in SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlens.functions import residues as R
from strandlens.operators import blocks as B, counts as C, coupling as K, merge as M, score as D, search as G, segments as N, tallies as T
from strandlens.plans.counting import CLUSTERS, SEQS, archetype_sql, every, letters_in, seq, with_
from strandlens.sources import sequences as S
from strandlens.sources.sequences import STEP, all_sequences, complete, sequences, table

PRIORITY = {"src0": 3, "src1": 2, "src2": 1}
CDR3 = "cdr3"
CUT = {"cdr1": 0.2, "cdr2": 0.2, "cdr3": 0.2}
#: Thresholds that few rows reach, as a search for relatives has them: what the segment index is for.
CLOSE = {"cdr1": 0.7, "cdr2": 0.7, "cdr3": 0.7}


def searched(spark, sf_dir):
    """Sequences of some region lengths against the benchmark's."""
    asked = G.queries(table(spark, sf_dir, "benchmark"))
    return G.pair_up(G.regions(sequences(spark, sf_dir)), asked), asked


def rows_and_queries(spark, sf_dir):
    return G.regions(sequences(spark, sf_dir), list(G.WEIGHTS)), G.queries(table(spark, sf_dir, "benchmark"))


def valued(f, **how):
    """query_id, doc_id and identity of all pairs that searched() has."""
    return lambda spark, d: G.pair_values(*rows_and_queries(spark, d), ["doc_id"], {"identity": f}, **how)


def combined(loops):
    return 1 - sum(x.distance for x in loops.values()) / sum(x.longer for x in loops.values())


def metadata(spark, sf_dir):
    """Sequences with labels as their metadata, missing values as empty strings."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("text_id"), F.when(F.col("quality") == 1, "q").otherwise("").alias("targets"), F.when(F.col("toxic") == 1, "t").otherwise("").alias("patent_id"))
    rows = sequences(spark, sf_dir).select("doc_id", "text_id", "source", "lang", "v").join(labels, "text_id", "left").drop("text_id").fillna("")
    return rows.withColumn("organism", F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))).withColumn("pdb_id", F.lit(""))


def frames(spark, sf_dir):
    return M.six_frames(table(spark, sf_dir, "documents"), "doc_id", "text")


def gapped(spark, sf_dir):
    """All sequences with every eleventh place blanked, by id."""
    v = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(128)), lambda p: F.when((F.col("doc_id") + p) % 11 == 0, "-").otherwise(F.substring("v", p, F.lit(1)))), "")
    return all_sequences(spark, sf_dir).select("doc_id", v.alias("v"))


def id_lists(spark, sf_dir):
    """Customers' orders as comma lists of ids, with the orders' priorities and states as metadata."""
    orders = table(spark, sf_dir, "orders")
    listed = orders.groupBy(F.col("o_custkey").alias("seq_id")).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ",").alias("ids"))
    meta = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return M.join_metadata(listed, meta, ["priority", "status"], 60).select("seq_id", "priority", "status")


#: Rows from which a cluster takes part, in the small tables' queries.
LEAST = 3


def scored_designs(spark, sf_dir):
    """Clusters are stored first, as they are read four times."""
    from strandlens.plans.designs import scratch

    s, path = sequences(spark, sf_dir), f"{scratch(spark)}/clusters"
    C.pattern_clusters(s).write.parquet(path)
    return D.naturalness(s, spark.read.parquet(path), LEAST)


def unknown_rules(spark, sf_dir):
    """Family rules, and global rules for places and residues that they don't have. What both are made of comes from one counting
    pass and is stored, as it is read three times."""
    from strandlens.plans.designs import scratch

    path = f"{scratch(spark)}/found"
    B.both_found(sequences(spark, sf_dir)).write.parquet(path)
    found, names = spark.read.parquet(path), ["condition", "pos", "aa"]
    return M.merge_rules(B.family_rules(found).select(*names), B.global_rules(found).select(*names))


def classified(s):
    return s.select("doc_id", "family", R.family_positional("v").alias("positional"), R.family_classical("v").alias("classical"), R.family_light(F.col("hallmarks")).alias("light"), R.framework_type(F.col("hallmarks")).alias("framework"))


MOTIFS = {"wxxw": "W..W", "gg": "GG", "ggg": "GGG", "pp": "PP", "ss": "SS", "yy": "YY"}


def cdr_vector(s):
    """27 features of the third loop: length, charge, hydrophobicity, cysteines, aromatics, volume, beta propensity, counts and
    shares of classes, motifs, and its ends' classes."""
    size = F.greatest(F.length("cdr3"), F.lit(1))
    return C.features(s).select("doc_id", "length", "charge", "hydro", "n_cys", "aromatic", R.weighted("cdr3", R.VOLUME).alias("volume"), R.weighted("cdr3", R.BETA).alias("beta"), *[R.count_of("cdr3", x).alias(f"n_{k}") for k, x in R.CATEGORIES.items()],
                                *[F.round(R.count_of("cdr3", x) / size, 9).alias(f"share_{k}") for k, x in R.CATEGORIES.items()], *[F.col("cdr3").rlike(x).alias(k) for k, x in MOTIFS.items()],
                                R.group_of(F.substring("cdr3", 1, 1), R.CATEGORIES).alias("first_kind"), R.group_of(F.substring("cdr3", -1, 1), R.CATEGORIES).alias("last_kind"))


def truncation(rows):
    filled = lambda a, n: F.length(F.translate(F.substring("v", a, n), "-X*", ""))
    return rows.select("doc_id", filled(4, 23).alias("fr1_filled"), filled(118, 8).alias("fr4_filled"), complete().alias("kept"))


#: Heads and tails that sequences get by id, to be found again.
HEADS, TAILS = ["", "MSKIK", "", "SKIK"], ["HHHHHH", "DYKDDDDK", "GSATYPYDVPDYAGSYPYDVPDYA", "WSHPQFEKGGGSGGGSAWSHPQFEK", "EPEA", "", "WSHPQFEKHHHHHHHH"]


def tagged(s):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod("doc_id", F.lit(len(names))) + 1).cast("int"))
    return s.select("doc_id", F.concat(pick(HEADS), F.rtrim("v", F.lit("-")), pick(TAILS)).alias("tagged"))


def hits(spark, sf_dir):
    return N.search(G.regions(sequences(spark, sf_dir)), G.queries(table(spark, sf_dir, "benchmark")), CUT)


def relatives(spark, sf_dir, cut):
    """Hits of the sequences of every twentieth text among those of all other texts."""
    rows = sequences(spark, sf_dir)
    asked = rows.filter("text_id % 20 = 0").select(F.col("doc_id").alias("query_id"), *[R.region("v", k).alias(f"q_{k}") for k in cut])
    return N.search(G.regions(rows), asked, cut).filter(F.floor(F.col("query_id") / STEP) != F.floor(F.col("doc_id") / STEP))


def candidates(spark, sf_dir):
    """The benchmark's sequences are the leads, the documents' families what they take."""
    leads = G.queries(table(spark, sf_dir, "benchmark")).select(F.col("query_id").alias("doc_id"), F.col("qv").alias("v"))
    return D.candidates(leads, C.archetypes(sequences(spark, sf_dir)))


def selected(spark, sf_dir):
    s = sequences(spark, sf_dir)
    pool = s.select(F.col("source").alias("lead"), F.col("doc_id").alias("candidate"), F.col("family").alias("kind"), (R.charge("v") * F.lit(1.0)).alias("score"))
    return D.repair_selection(pool, "lead", 12)


def codes(spark, sf_dir):
    """Numbered rows: 200 character codes each, every seventh a gap."""
    c = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda p: F.when(p % 7 == 0, F.lit(0)).when(p > 190, F.lit(124)).otherwise(F.ascii(F.substring("w", p, F.lit(1)))))
    wide = sequences(spark, sf_dir).select("doc_id", F.concat("v", "v").alias("w")).select("doc_id", c.alias("codes"))
    return wide.select("doc_id", *[x.alias(k) for k, x in S.numbered_regions(F.col("codes")).items()])


QUERIES = {
    "S04_numbered_decode": lambda spark, d: codes(spark, d).select("doc_id", "whole"),
    "S05_numbered_regions": codes,
    "S08_region_strings": every(lambda s: s.select("doc_id", *[R.region("v", k).alias(k) for k in R.REGIONS])),
    "P01_norm_cell": lambda spark, d: table(spark, d, "customer").select("c_custkey", R.norm_cell(F.when(F.col("c_custkey") % 3 == 0, " NaN ").otherwise(F.col("c_mktsegment"))).alias("cell")),
    "P02_truncation": lambda spark, d: truncation(gapped(spark, d)),
    "P04_hallmarks": seq(lambda s: s.select("doc_id", "hallmarks")),
    "P05_families": seq(classified),
    "P11_true_vhh": seq(lambda s: s.groupBy(M.true_vhh_reason(F.col("hallmarks")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))),
    "P13_read_filter": lambda spark, d: frames(spark, d).select("doc_id", "frame", M.read_filter(F.col("protein"), 25).alias("kept")),
    "P14_cysteines": seq(lambda s: s.groupBy(M.cysteine_reasons().alias("reasons")).agg(F.count(F.lit(1)).alias("n"))),
    "P16_length_window": lambda spark, d: searched(spark, d)[0].groupBy("query_id").agg(F.count(F.lit(1)).alias("n")),
    "F01_cdr_features": seq(lambda s: C.features(s).select("doc_id", "length", "charge", "hydro", "n_cys", "aromatic", "cdr3_len", "cdr3_charge", "cdr3_cys")),
    "F03_cdr_vector": seq(cdr_vector),
    "F05_condition_tokens": seq(lambda s: C.features(s).select("doc_id", F.explode(C.condition_tokens(True)).alias("token"))),
    "F06_junction_triplets": seq(lambda s: K.junction_rows(s, ["doc_id"])),
    "F07_six_frames": frames,
    "F09_identity": valued(lambda loops: loops["cdr3"].identity),
    "F10_weighted_identity": valued(lambda loops: loops["cdr3"].identity, weighted=True),
    "F11_combined_identity": valued(combined),
    "F16_tag_strip": seq(lambda s: M.stripped(tagged(s), "tagged").select("doc_id", "plain", "removed")),
    "F20_residue_groups": seq(lambda s: s.groupBy(R.group_of(R.residue("v", 71)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))),
    "F21_hallmark_match": seq(lambda s: s.select("doc_id", R.hallmark_match(F.col("hallmarks"), "FERG").alias("match"))),
    "F24_sample_key": seq(lambda s: s.select("doc_id", R.sample_key(F.col("doc_id")).alias("sample"))),
    "F26_framework_hash": seq(lambda s: s.select("doc_id", F.concat_ws("|", *[R.residue("v", p) for p in R.VERNIER]).alias("framework"))),
    "J01_metadata_lists": id_lists,
    "J05_archetype_matches": seq(lambda s: D.family_probability(s, C.archetypes(s))),
    "J06_query_pairs": lambda spark, d: searched(spark, d)[0].select("query_id", "doc_id"),
    "J07_cluster_matches": seq(lambda s: D.cluster_matches(s, C.pattern_clusters(s), least=LEAST).select("doc_id", "family", "pattern", "n", "matches", "rank")),
    "J09_rules_not_known": unknown_rules,
    "U01_source_merge": lambda spark, d: M.merge_sources({"docs": table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang"), "pages": table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url")}),
    "U02_first_seen": every(lambda s: M.first_seen(s.select("doc_id", "source", "v"), "v", ["source", "doc_id"])),
    "U06_duplicate_groups": every(lambda s: M.duplicate_groups(s, "v", "doc_id")),
    "W02_best_duplicate": lambda spark, d: M.keep_best(metadata(spark, d), "v", M.metadata_score(PRIORITY), "doc_id").select("doc_id", "v", "score"),
    "A28_metadata_coverage": lambda spark, d: M.metadata_coverage(metadata(spark, d), "source", ["targets", "patent_id", "organism"]),
    "I02_best_frame": lambda spark, d: M.best_frame(frames(spark, d), "doc_id"),
    "G01_region_search": hits,
    "G01_close_search": lambda spark, d: relatives(spark, d, CLOSE),
    "J06_close_pairs": lambda spark, d: relatives(spark, d, {"cdr3": CLOSE["cdr3"]}).select("query_id", "doc_id", "id_cdr3"),
    "G02_threshold_advice": lambda spark, d: G.threshold_advice(searched(spark, d)[0]),
    "G03_threshold_grid": lambda spark, d: G.threshold_grid(searched(spark, d)[0], [0.1, 0.2, 0.3], 100),
    "G04_best_hits": lambda spark, d: G.best_pairs(*rows_and_queries(spark, d), G.loop_score(), ["family"]),
    "G06_lead_similarity": seq(lambda s: D.min_max(G.lead_similarity(s, s.orderBy("doc_id").limit(1)), "score", "other_loop").drop("scaled")),
    "T04_similarity_order": seq(lambda s: G.ordered_by_similarity(G.lead_similarity(s, s.orderBy("doc_id").limit(1)), s.agg(F.min("doc_id").alias("lead"))).select("doc_id", "score", "differences", "is_lead")),
    "A30_scan_statistics": lambda spark, d: G.scan_statistics(hits(spark, d), sequences(spark, d)).select("source", "n_rows", "hits", "best", "worst", "q75"),
    "D01_naturalness": scored_designs,
    "D02_score_class": lambda spark, d: D.score_class(scored_designs(spark, d)),
    "D04_rule_compliance": seq(lambda s: D.rule_compliance(s, T.mined(s))),
    "A32_violations": seq(lambda s: D.violations(s, T.mined(s))),
    "D07_motif_pool": seq(lambda s: D.motif_pool(C.archetypes(s))),
    "D08_candidates": candidates,
    "D09_selection": selected,
    "D11_framework_identity": seq(lambda s: D.framework_identity(s, s.groupBy("source").agg(F.min_by("v", "doc_id").alias("lead")), "source")),
    "W03_top_clusters": seq(lambda s: D.pure_clusters(C.pattern_clusters(s), 5)),
    "W06_quota_selection": seq(lambda s: D.quota_selection(s.select("doc_id", "family", "source"), "family", ["source", "doc_id"], {"Other_VHH": 30, "F_C4": 15}, 10)),
    "W07_min_max": seq(lambda s: D.min_max(s.select("doc_id", "family", R.charge("v").alias("charge")), "charge", "family")),
}

HITS = f"""q0 AS (SELECT item_id, regexp_extract_all(translate(regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g'), 'EFTRAYNGHLIWSC', 'FERTYAGNLHWICS'), '[A-Z]{{1,128}}') AS ws FROM benchmark),
q AS (SELECT query_id, rpad(w, 128, '-') AS qv FROM (SELECT item_id * 1000000 + unnest(range(0, len(ws))) AS query_id, unnest(ws) AS w FROM q0) WHERE length(w) >= 117),
pairs AS (SELECT query_id, doc_id, source, family, v, qv, substr(v, 27, 12) AS cdr1, substr(v, 56, 10) AS cdr2, cdr3, substr(qv, 27, 12) AS q1, substr(qv, 56, 10) AS q2, substr(qv, 105, 13) AS q3 FROM s, q WHERE abs(length(cdr3) - length(substr(qv, 105, 13))) <= 3),
ids AS (SELECT *, {', '.join(f"CASE WHEN length(cdr{k}) = 0 OR length(q{k}) = 0 THEN 0.0::DOUBLE ELSE 1 - levenshtein(cdr{k}, q{k}) / greatest(length(cdr{k}), length(q{k}))::DOUBLE END AS i{k}" for k in (1, 2, 3))} FROM pairs)"""
#: As HITS, for every twentieth text's sequences and those of other texts.
RELATED = "pairs AS (SELECT b.doc_id AS query_id, a.doc_id, a.source, a.family, substr(a.v, 27, 12) AS cdr1, substr(a.v, 56, 10) AS cdr2, a.cdr3, substr(b.v, 27, 12) AS q1, substr(b.v, 56, 10) AS q2, b.cdr3 AS q3 FROM s a JOIN s b ON b.text_id % 20 = 0 AND a.text_id <> b.text_id AND abs(length(a.cdr3) - length(b.cdr3)) <= 3)" + HITS[HITS.index(",\nids AS") :]
META = """m AS (SELECT s.doc_id, source, v, CASE WHEN quality = 1 THEN 'q' ELSE '' END AS targets, CASE WHEN toxic = 1 THEN 't' ELSE '' END AS patent_id, CASE WHEN lang = 'en' THEN '' ELSE lang END AS organism FROM s LEFT JOIN (SELECT doc_id AS text_id, quality, toxic FROM labels) USING (text_id))"""
MATCHES = f"""d AS (SELECT doc_id, p.i, substr(v, p.pos, 1) AS aa FROM s, (SELECT unnest({R.VERNIER}) AS pos, generate_subscripts({R.VERNIER}, 1) AS i) p),
cl AS (SELECT family, pattern, n, x.i, substr(pattern, x.i::INTEGER, 1) AS aa FROM c, range(1, {len(R.VERNIER) + 1}) x(i) WHERE n >= {LEAST}),
met AS (SELECT doc_id, family, pattern, n, count(*) AS matches FROM d JOIN cl USING (i, aa) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY matches DESC, n DESC, family, pattern)::INTEGER AS rank FROM met)"""
NATURAL = f"""{CLUSTERS}, {MATCHES}, topped AS (SELECT *, max(matches) OVER (PARTITION BY doc_id) AS top FROM best WHERE rank <= 5),
z AS (SELECT b.doc_id, b.top, b.matches * sqrt(b.n) AS w, {', '.join(f'(s.{k} - c.{k}_mean) / greatest(c.{k}_std, {low}) AS {k[0]}' for k, low in D.FEATURES.items())} FROM topped b JOIN c USING (family, pattern) JOIN s ON s.doc_id = b.doc_id WHERE b.top >= 2),
near AS (SELECT doc_id, max(top)::BIGINT AS best_match, sum(l * w) / sum(w) AS l, sum(c * w) / sum(w) AS c, sum(a * w) / sum(w) AS a FROM z GROUP BY 1),
m AS (SELECT {', '.join(f'coalesce(sum({k}_mean * least(n, 1000)) / sum(least(n, 1000)), {d[0]}) AS {k}_m, coalesce(CASE WHEN count(*) > 0 THEN sqrt(greatest(round(sum({k}_mean * {k}_mean * least(n, 1000)) / sum(least(n, 1000)) - (sum({k}_mean * least(n, 1000)) / sum(least(n, 1000))) ** 2, 9), 0)) END, {d[1]}) AS {k}_s' for k, d in D.DEFAULTS.items())} FROM c),
far AS (SELECT doc_id, 0::BIGINT AS best_match, {', '.join(f'(s.{k} - m.{k}_m) / greatest(m.{k}_s, {low}) AS {k[0]}' for k, low in D.FEATURES.items())} FROM s, m WHERE doc_id NOT IN (SELECT doc_id FROM near)),
y AS (SELECT * FROM near UNION ALL BY NAME SELECT * FROM far),
nat AS (SELECT doc_id, best_match, round(l, 9) + 0.0::DOUBLE AS z_length, round(c, 9) + 0.0::DOUBLE AS z_charge, round(a, 9) + 0.0::DOUBLE AS z_aromatic, round(l * l + c * c + 0.5 * a * a, 9) AS score FROM y)"""


def grouped(x: str, groups=R.GROUPS) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(repr(a) for a in v)}) THEN '{k}'" for k, v in groups.items()) + " ELSE 'other' END"


H = {k: f"substr(hallmarks, {k}, 1)" for k in (1, 2, 3, 4)}
MATCH = "(" + " + ".join(f"CASE WHEN {H[k]} = '{a}' THEN 1.0::DOUBLE WHEN {H[k]} IN ({', '.join(repr(x) for x in next(v for v in R.GROUPS.values() if a in v))}) THEN 0.5 ELSE 0 END" for k, a in enumerate("FERG", 1)) + ") / 4"
#: CTEs t0, t1, ... that take one tag after the other from x, and the names of those that went.
TAGGED = f"t0 AS (SELECT doc_id, ['{"', '".join(HEADS)}'][(doc_id % {len(HEADS)} + 1)::INT] || rtrim(v, '-') || ['{"', '".join(TAILS)}'][(doc_id % {len(TAILS)} + 1)::INT] AS x, '' AS removed FROM s)"
for _i, (_name, _pattern) in enumerate(M.TAGS.items()):
    TAGGED += f", t{_i + 1} AS (SELECT doc_id, regexp_replace(x, '{_pattern}', '') AS x, removed || CASE WHEN regexp_matches(x, '{_pattern}') THEN ',{_name}' ELSE '' END AS removed FROM t{_i})"
LEAD = f"""l AS (SELECT v AS lead FROM s ORDER BY doc_id LIMIT 1),
a AS (SELECT doc_id, p.pos BETWEEN 27 AND 38 OR p.pos BETWEEN 56 AND 65 OR p.pos BETWEEN 105 AND 117 AS lp, substr(v, p.pos::INTEGER, 1) AS x, substr(lead, p.pos::INTEGER, 1) AS y FROM s, l, range(1, 129) p(pos)),
g AS (SELECT doc_id, lp, x = y AS same, x <> y AND {grouped('x')} = {grouped('y')} AS alike FROM a),
sim AS (SELECT *, similar_frame + 2 * other_frame + 2 * similar_loop + 4 * other_loop AS score FROM (SELECT doc_id, sum(same::INT)::BIGINT AS same, sum((alike AND lp)::INT)::BIGINT AS similar_loop, sum((alike AND NOT lp)::INT)::BIGINT AS similar_frame, sum((NOT same AND NOT alike AND lp)::INT)::BIGINT AS other_loop, sum((NOT same AND NOT alike AND NOT lp)::INT)::BIGINT AS other_frame FROM g GROUP BY 1))"""
REASONS = f"""concat_ws(';', CASE WHEN {letters_in('v', 'C')} % 2 = 1 THEN 'odd' END, CASE WHEN NOT (substr(v, 22, 1) = 'C' OR substr(v, 23, 1) = 'C') THEN 'first' END, CASE WHEN NOT (substr(v, 103, 1) = 'C' OR substr(v, 104, 1) = 'C') THEN 'second' END, CASE WHEN (substr(v, 55, 1) = 'C') <> (substr(v, 100, 1) = 'C') THEN 'half_pair' END)"""
FRAME_PLACES = [p for k, (a, b) in R.REGIONS.items() if k.startswith("fr") for p in range(a, b + 1)]

SQL = {
    "S08_region_strings": SEQS + " SELECT doc_id, " + ", ".join(f"replace(substr(v, {a}, {b - a + 1}), '-', '') AS {k}" for k, (a, b) in R.REGIONS.items()) + " FROM s1",
    "P01_norm_cell": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE c_mktsegment END AS cell FROM customer",
    "P02_truncation": SEQS + ", g AS (SELECT doc_id, (SELECT count(*) FROM range(4, 27) p(p) WHERE (doc_id + p) % 11 <> 0 AND substr(v, p::INTEGER, 1) <> '-')::INTEGER AS fr1_filled, (SELECT count(*) FROM range(118, 126) p(p) WHERE (doc_id + p) % 11 <> 0 AND substr(v, p::INTEGER, 1) <> '-')::INTEGER AS fr4_filled FROM s1) SELECT *, fr1_filled >= 20 AND fr4_filled >= 6 AS kept FROM g",
    "P04_hallmarks": SEQS + " SELECT doc_id, hallmarks FROM s",
    "P05_families": SEQS + f""" SELECT doc_id, family, CASE WHEN family LIKE 'F_C_' OR family LIKE 'Y_C_' THEN left(family, 1) || CASE WHEN substr(v, 55, 1) = 'C' AND substr(v, 100, 1) = 'C' THEN '_C4' ELSE '_C2' END ELSE family END AS positional,
CASE WHEN {H[3]} = 'L' THEN 'VH_like' WHEN {H[1]} IN ('F', 'Y') AND {H[2]} IN ('E', 'Q') AND {H[3]} = 'R' THEN CASE WHEN {letters_in('v', 'C')} IN (2, 4) THEN {H[1]} || '_C' || {letters_in('v', 'C')} ELSE 'Classical_other' END WHEN {H[4]} = 'W' THEN 'VHH_W52' ELSE 'Non_classical' END AS classical,
CASE WHEN hallmarks LIKE 'Y%' THEN 'Y_like' WHEN hallmarks LIKE 'FER%' THEN 'F_C2' WHEN hallmarks LIKE 'VG%' THEN 'VH_like' ELSE 'other' END AS light,
CASE WHEN {H[1]} IN ('F', 'Y') AND {H[2]} IN ('E', 'Q') AND {H[3]} = 'R' AND {H[4]} IN ('G', 'L', 'F', 'A') THEN 'Classical_VHH' WHEN {H[1]} = 'V' AND {H[4]} = 'W' THEN 'VH' WHEN {H[1]} IN ('F', 'Y') AND {H[4]} IN ('G', 'L', 'F', 'A') AND ({H[2]} = 'G' OR {H[3]} = 'L') THEN 'Humanized_VHH' WHEN {H[1]} = 'V' THEN 'VH_like' ELSE 'Mixed' END AS framework FROM s""",
    "P11_true_vhh": SEQS + f" SELECT CASE WHEN {H[3]} <> 'R' THEN 'pos50' WHEN {H[4]} = 'W' THEN 'pos52' WHEN {H[1]} NOT IN ('F', 'Y') THEN 'pos42' WHEN {H[2]} NOT IN ('E', 'Q', 'K') THEN 'pos49' ELSE 'kept' END AS reason, count(*) AS n FROM s GROUP BY 1",
    "P14_cysteines": SEQS + f" SELECT {REASONS} AS reasons, count(*) AS n FROM s GROUP BY 1",
    "P16_length_window": with_(HITS + " SELECT query_id, count(*) AS n FROM pairs GROUP BY 1"),
    "F01_cdr_features": SEQS + " SELECT doc_id, length, charge, hydro, n_cys, aromatic, cdr3_len, cdr3_charge, cdr3_cys FROM s",
    "F03_cdr_vector": SEQS + " SELECT doc_id, length, charge, hydro, n_cys, aromatic, " + ", ".join(f"({' + '.join(f'{letters_in(CDR3, a)} * {v}' for a, v in values.items())})::INTEGER AS {k}" for k, values in (("volume", R.VOLUME), ("beta", R.BETA))) + ", " + ", ".join(f"{letters_in('cdr3', v)}::INTEGER AS n_{k}, round({letters_in('cdr3', v)} / greatest(length(cdr3), 1)::DOUBLE, 9) AS share_{k}" for k, v in R.CATEGORIES.items()) + ", " + ", ".join(f"regexp_matches(cdr3, '{x}') AS {k}" for k, x in MOTIFS.items()) + f", {grouped('left(cdr3, 1)', R.CATEGORIES)} AS first_kind, {grouped('right(cdr3, 1)', R.CATEGORIES)} AS last_kind FROM s",
    "F05_condition_tokens": SEQS + " SELECT doc_id, unnest(['family=' || family, 'hallmarks=' || hallmarks, 'cdr3_len=' || cdr3_len, 'cdr3_charge=' || cdr3_charge, 'cdr3_cys=' || cdr3_cys, 'cdr3[-1]=' || right(cdr3, 1), 'cdr3[-2]=' || substr(cdr3, -2, 1), 'cdr3[-3]=' || substr(cdr3, -3, 1)]) AS token FROM s",
    "F06_junction_triplets": SEQS + f""", jn(j, a, b) AS (VALUES {', '.join(f"('{k}', {a}, {b})" for k, (a, b) in K.JUNCTIONS.items())}) SELECT doc_id, j AS junction, substr(v, a, 3) AS "left", substr(v, b, 5) AS "right" FROM s, jn WHERE NOT contains(substr(v, a, 3) || substr(v, b, 5), '-')""",
    "F09_identity": with_(HITS + " SELECT query_id, doc_id, i3 AS identity FROM ids"),
    "F11_combined_identity": with_(HITS + " SELECT query_id, doc_id, 1 - (levenshtein(cdr1, q1) + levenshtein(cdr2, q2) + levenshtein(cdr3, q3)) / (greatest(length(cdr1), length(q1)) + greatest(length(cdr2), length(q2)) + greatest(length(cdr3), length(q3)))::DOUBLE AS identity FROM pairs"),
    "F16_tag_strip": with_(TAGGED + f" SELECT doc_id, x AS plain, ltrim(removed, ',') AS removed FROM t{len(M.TAGS)}"),
    "F20_residue_groups": SEQS + f" SELECT {grouped('substr(v, 71, 1)')} AS kind, count(*) AS n FROM s GROUP BY 1",
    "F21_hallmark_match": SEQS + f" SELECT doc_id, {MATCH} AS match FROM s",
    "F24_sample_key": SEQS + " SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000000 AS sample FROM s",
    "F26_framework_hash": SEQS + " SELECT doc_id, concat_ws('|', " + ", ".join(f"substr(v, {p}, 1)" for p in R.VERNIER) + ") AS framework FROM s",
    "J01_metadata_lists": "SELECT o_custkey AS seq_id, left(string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority), 60) AS priority, left(string_agg(DISTINCT o_orderstatus, '; ' ORDER BY o_orderstatus), 60) AS status FROM orders GROUP BY 1",
    "J05_archetype_matches": SEQS + f", ar AS ({archetype_sql('family', 1).replace('l AS (', 'WITH l AS (', 1)}), pt AS (SELECT doc_id, a.family, sum(CASE WHEN substr(v, pos, 1) = consensus THEN CASE WHEN pos >= 66 THEN 2 ELSE 1 END ELSE 0 END)::BIGINT AS points FROM s, ar a GROUP BY ALL) SELECT *, points * 1.0::DOUBLE / nullif(sum(points) OVER (PARTITION BY doc_id), 0) AS probability FROM pt",
    "J06_query_pairs": with_(HITS + " SELECT query_id, doc_id FROM pairs"),
    "J07_cluster_matches": with_(f"{CLUSTERS}, {MATCHES} SELECT doc_id, family, pattern, n, matches, rank FROM best WHERE rank <= 5"),
    "U01_source_merge": "SELECT doc_id::VARCHAR AS id, coalesce(lang, '') AS lang, 'docs' AS origin, '' AS url FROM documents UNION ALL SELECT page_id::VARCHAR, '', 'pages', coalesce(url, '') FROM pages",
    "U02_first_seen": SEQS + " SELECT doc_id, source, v FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY source, doc_id) AS rk FROM s1) WHERE rk = 1",
    "U06_duplicate_groups": SEQS + ", r AS (SELECT v, doc_id, row_number() OVER (PARTITION BY v ORDER BY doc_id) AS rk FROM s1) SELECT v, count(*) AS n, string_agg(lpad(doc_id::VARCHAR, 18, '0'), ',' ORDER BY doc_id) FILTER (WHERE rk <= 10) AS members FROM r GROUP BY 1 HAVING count(*) > 1",
    "W02_best_duplicate": with_(META + ", r AS (SELECT *, ((targets <> '')::INT * 20 + (patent_id <> '')::INT * 10 + (organism <> '')::INT * 5 + CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src2' THEN 1 ELSE 0 END)::INTEGER AS score FROM m) SELECT doc_id, v, score FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, doc_id) AS rk FROM r) WHERE rk = 1"),
    "A28_metadata_coverage": with_(META + " SELECT source, count(*) AS n, avg((targets <> '')::INT) AS targets_share, avg((patent_id <> '')::INT) AS patent_id_share, avg((organism <> '')::INT) AS organism_share FROM m GROUP BY 1"),
    "G01_region_search": with_(HITS + " SELECT query_id, doc_id, source, family, i1 AS id_cdr1, i2 AS id_cdr2, i3 AS id_cdr3, (0.0::DOUBLE + i1 + i2 + i3) / 3 AS identity FROM ids WHERE i1 >= 0.2 AND i2 >= 0.2 AND i3 >= 0.2"),
    "G01_close_search": with_(RELATED + " SELECT query_id, doc_id, source, family, i1 AS id_cdr1, i2 AS id_cdr2, i3 AS id_cdr3, (0.0::DOUBLE + i1 + i2 + i3) / 3 AS identity FROM ids WHERE i1 >= 0.7 AND i2 >= 0.7 AND i3 >= 0.7"),
    "J06_close_pairs": with_(RELATED + " SELECT query_id, doc_id, i3 AS id_cdr3 FROM ids WHERE i3 >= 0.7"),
    "G02_threshold_advice": with_(HITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i3 DESC, doc_id) AS rk FROM ids) SELECT query_id, count(*)::BIGINT AS n, max(i3) AS most, " + ", ".join(f"round(quantile_cont(i3, {p}), 9) AS p{int(p * 100)}" for p in (0.5, 0.75, 0.9, 0.95)) + ", max(CASE WHEN rk = 20 THEN i3 END) AS threshold FROM r GROUP BY 1"),
    "G03_threshold_grid": with_(HITS + ", t AS (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS t), x AS (SELECT floor(i1 * 100) AS a, floor(i2 * 100) AS b, floor(i3 * 100) AS c FROM ids), k AS (SELECT t1.t AS t1, t2.t AS t2, t3.t AS t3, (SELECT count(*) FROM x WHERE a >= t1.t * 100 AND b >= t2.t * 100 AND c >= t3.t * 100) AS matches FROM t t1, t t2, t t3) SELECT *, abs(matches - 100) AS off FROM k"),
    "G04_best_hits": with_(HITS + ", w AS (SELECT query_id, doc_id, family, coalesce((0.0::DOUBLE + CASE WHEN i1 > 0 THEN i1 * 0.2::DOUBLE ELSE 0 END + CASE WHEN i2 > 0 THEN i2 * 0.3::DOUBLE ELSE 0 END + CASE WHEN i3 > 0 THEN i3 * 0.5::DOUBLE ELSE 0 END) / nullif(0.0::DOUBLE + CASE WHEN i1 > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN i2 > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN i3 > 0 THEN 0.5::DOUBLE ELSE 0 END, 0), 0) AS score FROM ids) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM w) WHERE rank <= 3"),
    "G06_lead_similarity": with_(LEAD + " SELECT * FROM sim"),
    "T04_similarity_order": with_(LEAD + " SELECT doc_id, score, 128 - same AS differences, doc_id = (SELECT min(doc_id) FROM s) AS is_lead FROM sim ORDER BY is_lead DESC, score, 128 - same, other_loop + similar_loop, doc_id LIMIT 50"),
    "A30_scan_statistics": with_(HITS + ", h AS (SELECT source, (0.0::DOUBLE + i1 + i2 + i3) / 3 AS identity FROM ids WHERE i1 >= 0.2 AND i2 >= 0.2 AND i3 >= 0.2), f AS (SELECT source, count(*) AS hits, max(identity) AS best, min(identity) AS worst, round(quantile_cont(identity, 0.75), 9) AS q75 FROM h GROUP BY 1) SELECT source, n_rows, coalesce(hits, 0) AS hits, best, worst, q75 FROM (SELECT source, count(*) AS n_rows FROM s GROUP BY 1) LEFT JOIN f USING (source)"),
    "D01_naturalness": with_(NATURAL + " SELECT * FROM nat"),
    "D02_score_class": with_(NATURAL + """, f AS (SELECT *, concat_ws(',', CASE WHEN best_match = 0 THEN 'no cluster' END, CASE WHEN abs(z_length) > 2 THEN CASE WHEN z_length > 0 THEN 'long' ELSE 'short' END END, CASE WHEN abs(z_charge) > 2 THEN CASE WHEN z_charge > 0 THEN 'positive' ELSE 'negative' END END, CASE WHEN abs(z_aromatic) > 2 THEN 'aromatic' END) AS factors FROM nat)
SELECT *, CASE WHEN score < 1 THEN 'excellent' WHEN score < 3 THEN 'good' WHEN score < 6 THEN 'fair' WHEN score < 12 THEN 'poor' ELSE 'bad' END AS grade, CASE WHEN score < 3 AND greatest(abs(z_length), abs(z_charge), abs(z_aromatic)) <= 2 THEN 'low' WHEN score < 6 THEN 'medium' ELSE 'high' END AS risk FROM f"""),
    "D11_framework_identity": SEQS + ", ld AS (SELECT source, arg_min(v, doc_id) AS lead FROM s GROUP BY 1) SELECT doc_id, (" + " + ".join(f"(substr(v, {p}, 1) = substr(lead, {p}, 1))::INT" for p in FRAME_PLACES) + f") * 1.0::DOUBLE / {len(FRAME_PLACES)} AS framework_identity FROM s JOIN ld USING (source)",
    "W03_top_clusters": with_(CLUSTERS + ", p AS (SELECT pattern, sum(n)::BIGINT AS n, arg_max(family, (n, family)) AS family, max(n) * 1.0::DOUBLE / sum(n) AS purity FROM c GROUP BY 1) SELECT family, pattern, n, purity, rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n * purity DESC, pattern)::INTEGER AS rank FROM p) WHERE rank <= 5"),
    "W06_quota_selection": SEQS + " SELECT doc_id, family, source, place FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY source, doc_id)::INTEGER AS place FROM s) WHERE place <= CASE family WHEN 'Other_VHH' THEN 30 WHEN 'F_C4' THEN 15 ELSE 10 END",
    "W07_min_max": SEQS + f", c AS (SELECT doc_id, family, ({letters_in('v', 'KRH')} - {letters_in('v', 'DE')})::INTEGER AS charge FROM s) SELECT *, coalesce((charge - min(charge) OVER w) / nullif(max(charge) OVER w - min(charge) OVER w, 0)::DOUBLE, 0) AS scaled FROM c WINDOW w AS (PARTITION BY family)",
}

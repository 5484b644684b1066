"""Registered design, sampling, rule-conversion, source, model and stream queries, with SQL where it can say the same."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from strandlens.functions import anchors as A, residues as R
from strandlens.operators import counts as C, design as D, merge as M, models as L, score as P, tallies as T
from strandlens.plans.counting import SEQS, archetype_sql, every, letters_in, seq, with_
from strandlens.plans.working import TAGGED, gapped, tagged
from strandlens.sources.sequences import all_sequences, sequences, table
from strandlens.streaming import shards

LEAD = "QVQLVESGGGLVQPGGSLRLSCAASG" * 5
ALLOWED = [*R.HALLMARKS, *range(27, 39), *range(56, 66), *range(105, 118)]
#: The published universal frameworks, spliced around each row's loops to test anchors.
FR1, FR2, FR3, FR4 = "QVQLVESGGGLVQPGGSLRLSC", "WYRQAPGQGLEAVA", "YYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYC", "WGQGTLVTVSS"


def scratch(spark) -> str:
    """A new folder beside the session's checkpoints, on whatever store these are."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/strandlens-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def spliced(s):
    plain = lambda x: F.translate(x, "CW", "SA")
    v = F.concat(F.lit(FR1), plain(R.region("v", "cdr1")), F.lit(FR2), plain(R.region("v", "cdr2")), F.lit(FR3), plain(F.col("cdr3")), F.lit(FR4))
    return s.select("doc_id", v.alias("v"))


def graded(s):
    """Sequences as candidates: a track by source, a score by charge."""
    return s.select("doc_id", "family", "v", F.pmod("doc_id", F.lit(5)).cast("int").alias("track"), R.charge("v").alias("score"))


def arriving(spark, sf_dir):
    """The documents' languages and sources counted as a stream of files."""
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    docs.write.option("maxRecordsPerFile", 300).parquet(f"{path}/in")
    return shards.count_shards(spark, f"{path}/in", docs.schema, f"{path}/counts", f"{path}/state", ["lang", "source"], D.parameter_hash({"keys": ["lang", "source"]}))


def arriving_once(spark, sf_dir):
    path = scratch(spark)
    rows = all_sequences(spark, sf_dir).select("v")
    rows.write.option("maxRecordsPerFile", 300).parquet(f"{path}/in")
    return shards.first_seen(spark, f"{path}/in", rows.schema, f"{path}/out", f"{path}/state", "v")


def sharded(spark, sf_dir):
    """Files of at most 300 rows: how many rows they hold together, and the most of one."""
    files = D.write_sharded(sequences(spark, sf_dir), f"{scratch(spark)}/shards", most=300)
    return files.agg(F.sum("n").alias("n"), (F.max("n") <= 300).alias("bounded"))


def by_source(spark, sf_dir):
    path = f"{scratch(spark)}/shards"
    D.write_sharded(sequences(spark, sf_dir), path, "source")
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def back_from_csv(spark, sf_dir):
    from strandlens.sources.sequences import read_annotated

    path = f"{scratch(spark)}/csv"
    sequences(spark, sf_dir).select(F.col("doc_id").alias("Doc ID"), F.col("family").alias("Family"), "cdr3").write.option("header", True).csv(path)
    return read_annotated(spark, [path]).select(F.col("doc_id").cast("long").alias("doc_id"), "family", "cdr3")


def back_from_fasta(spark, sf_dir):
    from strandlens.sources.sequences import read_fasta

    path = f"{scratch(spark)}/fasta"
    D.fasta_lines(sequences(spark, sf_dir)).select("record").write.text(path)
    return read_fasta(spark, path)


def conditions(s):
    both = T.mined(s).select(F.concat("condition", F.lit(" AND IMGT"), F.col("pos").cast("string"), F.lit("="), F.col("aa")).alias("condition"), "family")
    return D.parse_conditions(both).select("family", "condition", "kind", "name", "value")


def long_wide(s):
    """All positions as columns, each cut from the row itself."""
    return s.select("doc_id", *[R.residue("v", p).alias(f"imgt_{p}") for p in range(1, 129)])


QUERIES = {
    "S01_annotated_csv": back_from_csv,
    "S06_fasta": back_from_fasta,
    "K01_sharded_files": sharded,
    "K02_source_shards": by_source,
    "K06_fasta_records": seq(lambda s: D.ranked_fasta(D.ranks(graded(s).join(s.select("doc_id", "source"), "doc_id"), "family", "score", "doc_id", 100))),
    "K07_detail_json": seq(D.detail_json),
    "I05_grid_annotation": seq(lambda s: s.select("doc_id", "hallmarks", R.family_light(F.col("hallmarks")).alias("family"), *[F.length(R.region("v", k)).alias(f"len_{k}") for k in R.REGIONS])),
    "I06_wide_positions": every(long_wide),
    "F13_heuristic_cdr3": seq(lambda s: spliced(s).select("doc_id", A.heuristic_cdr3(F.col("v")).alias("cdr3"))),
    "F15_anchor_split": seq(lambda s: spliced(s).select("doc_id", *[x.alias(k) for k, x in A.framework_split(F.col("v")).items()])),
    "F17_tag_prevalence": seq(lambda s: tagged(s).select(F.explode(F.array_compact(F.array(*[F.when(F.col("tagged").rlike(p), F.lit(k)) for k, p in M.TAGS.items()]))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))),
    "F18_position_regions": seq(lambda s: s.select(F.explode(F.sequence(F.lit(1), F.lit(128))).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).select("pos", "n", F.coalesce(*[F.when(F.col("pos").between(a, b), k) for k, (a, b) in R.REGIONS.items()]).alias("region"))),
    "F19_grid": seq(lambda s: s.select("doc_id", F.explode(A.grid(*[R.region("v", k) for k in ("fr1", "fr2", "fr3", "fr4")])).alias("g")).select("doc_id", "g.pos", "g.aa")),
    "F22_parse_conditions": seq(conditions),
    "F23_tempered": seq(lambda s: C.archetypes(s).select("family", "pos", F.round(A.tempered(F.col("frequency") * 0.98 + 0.01, 2.0), 6).alias("p"))),
    "D10_across_tracks": seq(lambda s: D.across_tracks(graded(s), "v")),
    "D12_control_violations": seq(lambda s: D.control_violations(s, LEAD, ALLOWED)),
    "D15_rule_conversion": seq(lambda s: D.convert_rules(T.mined(s))),
    "D16_terminal_fix": seq(lambda s: s.select("doc_id", D.terminal_fix(F.col("v")).alias("v"))),
    "D17_generation_plan": seq(lambda s: D.generation_plan(C.family_counts(s), 1000)),
    "W05_ranks": seq(lambda s: D.ranks(graded(s).select("doc_id", "family", "score"), "family", "score", "doc_id", 100)),
    "W08_capped_pick": seq(lambda s: P.capped(s.select("doc_id", "hallmarks", "family"), "hallmarks", ["doc_id"], 3)),
    "M01_fixed_sample": seq(lambda s: D.fixed_sample(s.select("doc_id", "source"), "source", "doc_id", 5)),
    "A31_shared_motifs": seq(lambda s: D.shared_motifs(C.archetypes(s), frequency=0.1)),
    "A33_breakdown": seq(lambda s: s.cube("family", "lang").agg(F.count(F.lit(1)).alias("n"))),
    "A26_gap_rates": lambda spark, d: gapped(spark, d).select(F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), R.residue("v", p).alias("aa")) for p in R.positions("vernier")])).alias("x")).groupBy("x.pos").agg(F.avg((F.col("x.aa") == "-").cast("double")).alias("gap_rate")),
    "T01_rule_order": seq(lambda s: T.mined(s).orderBy(F.desc("support"), F.desc("confidence"), F.desc("lift"), "family", "condition", "pos", "aa").limit(25).select("family", "condition", "pos", "aa", "support")),
    "L01_residue_model": seq(lambda s: L.accuracy(L.predict(s, 71))),
    "L02_residue_forest": seq(lambda s: L.importances(s, 71)),
    "L04_residue_scores": seq(lambda s: L.predict(s, 50, forest=True)),
    "X01_arriving_counts": arriving,
    "X02_arriving_first_seen": arriving_once,
}

REGION_CASE = "CASE " + " ".join(f"WHEN pos BETWEEN {a} AND {b} THEN '{k}'" for k, (a, b) in R.REGIONS.items()) + " END"
GRID = [("substr(v, 1, 26)", 1, 10), ("substr(v, 39, 17)", 41, None), ("substr(v, 66, 39)", 66, 73), ("rtrim(substr(v, 118, 11), '-')", 118, None)]


def rules_sql(body: str) -> str:
    from strandlens.plans.counting import SQL as counting

    return f"WITH r AS ({counting['A01_rule_mining']}) {body}"


SQL = {
    "S01_annotated_csv": SEQS + " SELECT doc_id, family, cdr3 FROM s",
    "S06_fasta": SEQS + " SELECT doc_id || '|' || source || '|' || family AS id, v AS seq FROM s",
    "K01_sharded_files": SEQS + " SELECT count(*) AS n, true AS bounded FROM s",
    "K02_source_shards": SEQS + " SELECT source, count(*) AS n FROM s GROUP BY 1",
    "K06_fasta_records": SEQS + f", g AS (SELECT doc_id, source, v, ({letters_in('v', 'KRH')} - {letters_in('v', 'DE')})::INTEGER AS score FROM s ORDER BY score, doc_id LIMIT 100), r AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS rank FROM g) SELECT rank::INTEGER AS rank, '>' || rank || '|' || doc_id || '|' || source || '|' || score || chr(10) || replace(v, '-', '') AS record FROM r",
    "K07_detail_json": SEQS + f""" SELECT doc_id, '{{"doc_id":' || doc_id || ',"marks":{{"family":"' || family || '","hallmarks":"' || hallmarks || '"}},"scoring":{{"charge":' || ({letters_in('v', 'KRH')} - {letters_in('v', 'DE')}) || ',"cysteines":' || {letters_in('v', 'C')} || '}},"provenance":{{"text_id":' || text_id || ',"source":"' || source || '","lang":"' || lang || '"}}}}' AS detail FROM s""",
    "I05_grid_annotation": SEQS + " SELECT doc_id, hallmarks, CASE WHEN hallmarks LIKE 'Y%' THEN 'Y_like' WHEN hallmarks LIKE 'FER%' THEN 'F_C2' WHEN hallmarks LIKE 'VG%' THEN 'VH_like' ELSE 'other' END AS family, " + ", ".join(f"length(replace(substr(v, {a}, {b - a + 1}), '-', ''))::INTEGER AS len_{k}" for k, (a, b) in R.REGIONS.items()) + " FROM s",
    "I06_wide_positions": SEQS + " SELECT doc_id, " + ", ".join(f"substr(v, {p}, 1) AS imgt_{p}" for p in range(1, 129)) + " FROM s1",
    "F17_tag_prevalence": with_(TAGGED + " " + " UNION ALL ".join(f"SELECT '{k}' AS tag, count(*) AS n FROM t0 WHERE regexp_matches(x, '{p}') HAVING count(*) > 0" for k, p in M.TAGS.items())),
    "F18_position_regions": SEQS + f", p AS (SELECT pos::INTEGER AS pos, (SELECT count(*) FROM s) AS n FROM range(1, 129) x(pos)) SELECT pos, n, {REGION_CASE} AS region FROM p",
    "F19_grid": SEQS + " " + " UNION ALL ".join(f"SELECT doc_id, ({start} + i - 1{f' + CASE WHEN {start} + i - 1 >= {skip} THEN 1 ELSE 0 END' if skip else ''})::INTEGER AS pos, substr({part}, i::INTEGER, 1) AS aa FROM s, range(1, 40) x(i) WHERE i <= length({part})" for part, start, skip in GRID),
    "F22_parse_conditions": rules_sql(", c AS (SELECT family, condition || ' AND IMGT' || pos || '=' || aa AS condition, unnest(string_split(condition || ' AND IMGT' || pos || '=' || aa, ' AND ')) AS part FROM r) SELECT family, condition, CASE WHEN regexp_matches(part, '^IMGT[0-9]+=') THEN 'position' WHEN part LIKE 'cdr3[%' THEN 'loop_end' ELSE 'feature' END AS kind, string_split(part, '=')[1] AS name, string_split(part, '=')[-1] AS value FROM c"),
    "F23_tempered": f"WITH a AS ({with_(archetype_sql('family', 1))}) SELECT family, pos, round(1 / (1 + exp(-ln((frequency * 0.98::DOUBLE + 0.01::DOUBLE) / (1 - (frequency * 0.98::DOUBLE + 0.01::DOUBLE))) / 2.0::DOUBLE)), 6) AS p FROM a",
    "D10_across_tracks": SEQS + f", g AS (SELECT doc_id, family, v, (doc_id % 5)::INTEGER AS track, ({letters_in('v', 'KRH')} - {letters_in('v', 'DE')})::INTEGER AS score FROM s) SELECT doc_id, family, v, track, score FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY track DESC, score, doc_id) AS rk FROM g) WHERE rk = 1",
    "D12_control_violations": SEQS + f", d AS (SELECT doc_id, p.pos FROM s, (SELECT unnest({[p for p in range(1, 129) if p not in ALLOWED]}) AS pos) p WHERE substr(v, p.pos, 1) <> substr('{LEAD}', p.pos, 1)) SELECT doc_id, count(*)::INTEGER AS n, list_aggregate(list_slice(list(pos ORDER BY pos), 1, 5), 'string_agg', ',') AS first FROM d GROUP BY 1",
    "D15_rule_conversion": rules_sql("SELECT DISTINCT family, condition, pos, aa, confidence * 100 AS percent, CASE WHEN confidence * 100 >= 90 THEN 'high' WHEN confidence * 100 >= 80 THEN 'medium' ELSE 'base' END AS tier FROM r WHERE confidence * 100 >= 70"),
    "D16_terminal_fix": SEQS + " SELECT doc_id, CASE WHEN v LIKE '%A' THEN left(v, 127) || 'S' ELSE v END AS v FROM s",
    "D17_generation_plan": SEQS + ", f AS (SELECT family, count(*) AS n FROM s GROUP BY 1), u AS (SELECT *, floor(sum(n) OVER (ORDER BY n DESC, family) * 700 / (sum(n) OVER ())::DOUBLE) AS upto FROM f) SELECT 'original' AS scaffold, family, (upto - coalesce(lag(upto) OVER (ORDER BY n DESC, family), 0))::BIGINT AS wanted FROM u UNION ALL SELECT 'universal', min(family), 300::BIGINT FROM f",
    "W05_ranks": SEQS + f", g AS (SELECT doc_id, family, ({letters_in('v', 'KRH')} - {letters_in('v', 'DE')})::INTEGER AS score FROM s ORDER BY score, doc_id LIMIT 100), r AS (SELECT *, row_number() OVER (ORDER BY score, doc_id)::INTEGER AS rank, row_number() OVER (PARTITION BY family ORDER BY score, doc_id)::INTEGER AS group_rank FROM g) SELECT *, family || '-' || lpad(group_rank::VARCHAR, 4, '0') AS name FROM r",
    "W08_capped_pick": SEQS + " SELECT * FROM (SELECT doc_id, hallmarks, family, row_number() OVER (PARTITION BY hallmarks ORDER BY doc_id)::INTEGER AS rank FROM s) WHERE rank <= 3",
    "M01_fixed_sample": SEQS + " SELECT * FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id)::INTEGER AS place FROM s) WHERE place <= 5",
    "A31_shared_motifs": f"""WITH a AS ({with_(archetype_sql('family', 1))}), g AS (SELECT family, pos, pos || consensus AS m, frequency AS f FROM a WHERE frequency >= 0.1),
p AS (SELECT x.family, y.pos, x.m || ' ' || y.m AS m, x.f + y.f AS f FROM g x JOIN g y ON x.family = y.family AND x.pos < y.pos),
t AS (SELECT m, f FROM g UNION ALL SELECT m, f / 2 FROM p UNION ALL SELECT p.m || ' ' || g.m, (p.f + g.f) / 3 FROM p JOIN g ON p.family = g.family AND p.pos < g.pos)
SELECT m AS motif, count(*) AS groups, round(avg(f), 6) AS mean_frequency FROM t GROUP BY 1 HAVING count(*) >= 3""",
    "A33_breakdown": SEQS + " SELECT family, lang, count(*) AS n FROM s GROUP BY CUBE (family, lang)",
    "A26_gap_rates": SEQS + f" SELECT p.pos::INTEGER AS pos, avg(((doc_id + p.pos) % 11 = 0 OR substr(v, p.pos, 1) = '-')::INT) AS gap_rate FROM s1, (SELECT unnest({R.positions('vernier')}) AS pos) p GROUP BY 1",
    "T01_rule_order": rules_sql("SELECT family, condition, pos, aa, support FROM r ORDER BY support DESC, confidence DESC, lift DESC, family, condition, pos, aa LIMIT 25"),
    "X01_arriving_counts": "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2",
    "X02_arriving_first_seen": SEQS + " SELECT DISTINCT v FROM s1",
}

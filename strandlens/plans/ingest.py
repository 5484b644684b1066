"""Registered source, sink and ingestion queries, each with the same query in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strandlens.functions import anchors as A, residues as R
from strandlens.operators import counts as C, coupling as K, design as D, merge as M, tallies as T
from strandlens.plans.counting import SEQS, SQL as COUNTED, every, letters_in, seq, with_
from strandlens.plans.designs import scratch
from strandlens.plans.working import META, PRIORITY
from strandlens.sources import records as X
from strandlens.sources.sequences import once, sequences, table

LEAST_BASES, LEAST_RESIDUES = 60, 25


def reads(spark, sf_dir):
    """The documents' letters ACGTN as reads, with marks that filters look at."""
    productive = F.element_at(F.array(*[F.lit(x) for x in ("T", "F", "yes", "TRUE")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", once(M.clean_bases(F.coalesce("text", F.lit("")))).alias("sequence"), productive.alias("productive"), F.when(F.col("lang") == "en", "IGH").otherwise("IGK").alias("locus"), "source")


def read_reasons():
    """Why a read is refused; empty if it isn't."""
    return F.concat_ws(";", F.when(F.coalesce(F.length("sequence"), F.lit(0)) < LEAST_BASES, "short"), F.when(~F.coalesce(F.upper("productive").isin("TRUE", "T", "1", "YES"), F.lit(False)), "unproductive"), F.when(~F.coalesce(F.col("locus") == "IGH", F.lit(False)), "locus"))


def repertoire(spark, sf_dir):
    """Reads written as repertoire tables, a folder a source, tabs in one half of them and commas in the other, and read back."""
    path = f"{scratch(spark)}/repertoire"
    rows = reads(spark, sf_dir)
    sep = F.when(F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(2)) == 0, "\t").otherwise(",")
    cells = rows.select("source", F.concat_ws(",", F.col("doc_id").cast("string"), "sequence", "productive", "locus").alias("value"))
    tops = [F.concat(F.lit('{"Run": "'), F.col("source"), F.lit('"}')), F.lit("read,sequence,productive,locus")]
    heads = rows.select("source").distinct().select("source", F.explode(F.array(*tops)).alias("value"))
    lines = heads.union(cells).withColumn("value", F.when(F.col("value").startswith("{"), F.col("value")).otherwise(F.translate("value", ",", "\x01"))).select("source", F.regexp_replace("value", "\x01", sep).alias("value"))
    lines.repartition("source").write.partitionBy("source").text(path)
    found = X.read_repertoire(spark, path, ["read", "sequence", "productive", "locus", "v_call"])
    return found.select(F.col("read").cast("long").alias("doc_id"), F.coalesce("sequence", F.lit("")).alias("sequence"), "productive", "locus", "v_call", F.get_json_object("metadata", "$.Run").alias("run"))


def pairs(spark, sf_dir):
    """Sequences with comma lists of ids, and the ids' metadata, written and read as tab-separated tables."""
    path = scratch(spark)
    s = sequences(spark, sf_dir)
    s.select(F.col("v").alias("Sequence"), F.concat_ws(", ", F.col("text_id").cast("string"), F.concat(F.lit("x"), F.col("doc_id").cast("string"))).alias("Comma-separated db-specific IDS"), F.col("doc_id").alias("row")).write.option("sep", "\t").option("header", True).csv(f"{path}/sequences")
    table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality").write.option("sep", "\t").option("header", True).csv(f"{path}/metadata")
    rows, meta = X.read_pairs(spark, f"{path}/sequences", f"{path}/metadata", "ext", {"Sequence": "aa_v_full", "Comma-separated db-specific IDS": "ids"})
    return rows, meta


def pair_rows(spark, sf_dir):
    rows, meta = pairs(spark, sf_dir)
    joined = M.join_metadata(rows.drop("seq_id").withColumnRenamed("row", "seq_id"), meta, ["quality"], 300)
    return rows.select(F.col("row").cast("long").alias("doc_id"), "seq_id", "aa_v_full").join(joined.select(F.col("seq_id").cast("long").alias("doc_id"), F.coalesce("quality", F.lit("")).alias("quality")), "doc_id")


def atoms(spark, sf_dir):
    """Each sequence as a structure's ATOM lines."""
    return X.atom_lines(sequences(spark, sf_dir).select("doc_id", F.rtrim("v", F.lit("-")).alias("seq")), "doc_id", "seq")


def model_back(spark, sf_dir):
    path = f"{scratch(spark)}/rules"
    X.write_model(T.mined(sequences(spark, sf_dir)), path)
    return X.read_model(spark, path).select("family", "condition", "pos", "rank", "aa", "support")


def run_folder(spark, sf_dir):
    """A run's outputs in one folder, each as JSON, and how many rows each has."""
    path, s = scratch(spark), sequences(spark, sf_dir)
    outputs = {"archetypes": C.archetypes(s), "clusters": C.pattern_clusters(s), "correlations": C.feature_correlations(s, 71), "rules": T.mined(s)}
    for name, frame in outputs.items():
        frame.write.json(f"{path}/{name}")
    read = [spark.read.text(f"{path}/{name}").select(F.lit(name).alias("output")) for name in outputs]
    return reduce(lambda a, b: a.union(b), read).groupBy("output").agg(F.count(F.lit(1)).alias("n"))


RUN = {"min_obs": 5, "min_support": 3, "positions": "fr3fr4"}


def run_config(spark, sf_dir):
    """Family counts with the parameters of the run that made them, and their hash."""
    text = F.lit("{" + ", ".join(f'"{k}": ' + (f'"{v}"' if isinstance(v, str) else str(v)) for k, v in sorted(RUN.items())) + "}")
    return C.family_counts(sequences(spark, sf_dir)).withColumn("parameters", text).withColumn("parameter_hash", F.substring(F.md5("parameters"), 1, 12))


def matrix_file(spark, sf_dir):
    """The window correlations as a tab-separated matrix, written and read back."""
    path = f"{scratch(spark)}/matrix"
    names = list(K.WINDOWS)
    wide = K.window_correlations(sequences(spark, sf_dir)).groupBy("window1").pivot("window2", names).agg(F.first("r"))
    wide.write.option("sep", "\t").option("header", True).csv(path)
    return spark.read.option("sep", "\t").option("header", True).schema("window1 string, " + ", ".join(f"{k} double" for k in names)).csv(path)


def leads(spark, sf_dir):
    """Parts as a lead table under odd headers."""
    part = table(spark, sf_dir, "part")
    flag = F.element_at(F.array(*[F.lit(x) for x in ("Yes", "no", " TRUE ", "0")]), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return X.read_leads(part.select(flag.alias("LEAD?"), F.concat(F.lit(" p#"), F.col("p_partkey").cast("string")).alias("Seq-ID"), F.col("p_name").alias("AA Sequence")))


def translated_reads(spark, sf_dir):
    """Reads that pass, in their best forward frame, as residues without stops at the end, with the third loop by heuristics."""
    good = reads(spark, sf_dir).filter(read_reasons() == "")
    frames = M.six_frames(good, "doc_id", "sequence").filter(F.col("frame").startswith("+"))
    best = M.best_frame(frames, "doc_id").select("doc_id", "frame", F.rtrim("protein", F.lit("*")).alias("aa"))
    best = best.filter(F.length("aa") >= LEAST_RESIDUES)
    return best.select("doc_id", "frame", "aa", F.length("aa").alias("len_v"), A.heuristic_cdr3(F.col("aa")).alias("cdr3"), F.col("aa").contains("*").alias("has_stop"))


def production(spark, sf_dir):
    """Two sources under common columns with their metadata, the best row of each sequence kept: a production table."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("text_id"), F.when(F.col("quality") == 1, "q").otherwise("").alias("targets"), F.when(F.col("toxic") == 1, "t").otherwise("").alias("patent_id"))
    s = sequences(spark, sf_dir)
    first = s.filter("lang = 'en'").join(labels, "text_id", "left").select("doc_id", "source", "targets", "patent_id", F.col("v").alias("aa_v_full"), "cdr3")
    second = s.filter("lang <> 'en'").select("doc_id", "source", F.col("lang").alias("organism"), F.col("v").alias("aa_v_full"), "cdr3")
    merged = M.merge_sources({"labelled": first, "plain": second}).withColumn("pdb_id", F.lit(""))
    best = M.keep_best(merged, "aa_v_full", M.metadata_score(PRIORITY), "doc_id")
    return best.select("doc_id", "origin", "targets", "patent_id", "organism", "cdr3", F.length(F.translate("aa_v_full", "-", "")).alias("len_v"), F.length("cdr3").alias("len_cdr3"), "score")


def dict_table(spark, sf_dir):
    """Loops from printed dictionaries, as external tables have them."""
    printed = F.concat(F.lit("{'cdr1': '"), R.region("v", "cdr1"), F.lit("', 'cdr2': "), F.when(F.col("family") == "VH_like", F.lit("None")).otherwise(F.concat(F.lit("'"), R.region("v", "cdr2"), F.lit("'"))), F.lit(', "cdr3": "'), F.col("cdr3"), F.lit('"}'))
    return sequences(spark, sf_dir).select("doc_id", printed.alias("cell")).select("doc_id", *X.dict_cells(F.col("cell"), ["cdr1", "cdr2", "cdr3"]))


def repeated_headers(spark, sf_dir):
    """A table joined with itself has each column twice; the first ones stay."""
    s = sequences(spark, sf_dir).select("doc_id", "family", "cdr3")
    other = s.select(F.col("doc_id").alias("other"), F.lit("second").alias("family"), F.lit("second").alias("cdr3"))
    return X.first_columns(s.join(other, s.doc_id == other.other)).drop("other")


def common_positions(spark, sf_dir):
    """Gap shares at those positions that two tables have both."""
    from strandlens.sources.sequences import all_sequences

    s = all_sequences(spark, sf_dir)
    one, two = ([R.residue("v", p).alias(f"imgt_{p}") for p in range(a, b)] for a, b in ((110, 126), (120, 129)))
    first, second = s.filter("lang = 'en'").select(*one), s.filter("lang <> 'en'").select(*two)
    shared = X.common_columns([first, second])
    both = first.select(shared).union(second.select(shared))
    cells = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("position"), (F.col(c) == "-").alias("gap")) for c in shared])).alias("x")).select("x.*")
    return cells.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gap").cast("long")).alias("gaps"))


def assembled_ids(s):
    rank = F.pmod("doc_id", F.lit(1000))
    mutations = F.concat(F.lit("H"), F.substring("v", 2, 1), F.lit("n"))
    track = F.when(rank % 7 != 0, (rank % 5).cast("int"))
    return s.select("doc_id", X.msa_id(X.sanitized(F.concat(F.lit("M 69/"), "source")), F.when(rank % 2 == 0, "universal").otherwise("original"), F.col("hallmarks"), track, mutations, rank, rank / 1000.0).alias("name"))


QUERIES = {
    "S02_repertoire_tables": repertoire,
    "S03_sequence_pairs": pair_rows,
    "S07_structure_atoms": lambda spark, d: X.atom_chains(atoms(spark, d), "doc_id", "line", "H"),
    "S09_rule_model": model_back,
    "S10_lead_table": leads,
    "K03_run_outputs": run_folder,
    "K04_run_config": run_config,
    "K05_matrix_file": matrix_file,
    "P12_read_quality": lambda spark, d: reads(spark, d).select("doc_id", read_reasons().alias("reasons")),
    "F08_translate_reads": lambda spark, d: M.first_frame(reads(spark, d), "doc_id", "sequence", {"with_x": "N", "with_a": "A"}),
    "F25_assembled_ids": seq(assembled_ids),
    "I01_reads_to_sequences": translated_reads,
    "I03_production_table": production,
    "I04_dict_loops": dict_table,
    "U03_repeated_headers": repeated_headers,
    "U05_common_positions": common_positions,
}

BASES = "regexp_replace(upper(coalesce(text, '')), '[^ACGTN]', '', 'g')"
READS = f"""r AS (SELECT doc_id, {BASES} AS sequence, ['T', 'F', 'yes', 'TRUE'][(doc_id % 4 + 1)::INT] AS productive, CASE WHEN lang = 'en' THEN 'IGH' ELSE 'IGK' END AS locus, source FROM documents)"""
REASONS = f"concat_ws(';', CASE WHEN length(sequence) < {LEAST_BASES} THEN 'short' END, CASE WHEN upper(productive) NOT IN ('TRUE', 'T', '1', 'YES') THEN 'unproductive' END, CASE WHEN locus <> 'IGH' THEN 'locus' END)"


def codons_sql(x: str, frame: int) -> str:
    """A frame's residues of the bases in column x."""
    place = lambda o: f"strpos('TCAG', substr({x}, i * 3 + {frame + o + 1}, 1))"
    letter = f"CASE WHEN {place(0)} * {place(1)} * {place(2)} > 0 THEN substr('{M.CODE}', 16 * {place(0)} + 4 * {place(1)} + {place(2)} - 20, 1) ELSE 'X' END"
    return f"coalesce(list_aggregate(list_transform(range(0, greatest(0, (length({x}) - {frame}) // 3)), lambda i: {letter}), 'string_agg', ''), '')"


def frames_sql(source: str, bases: str) -> str:
    """CTE f: all six frames of the rows of `source`."""
    one = lambda name, x, k: f"SELECT doc_id, '{name}' AS frame, {codons_sql(x, k)} AS protein FROM st"
    parts = " UNION ALL ".join(one(f"{s}{k + 1}", x, k) for s, x in (("+", "fw"), ("-", "rv")) for k in range(3))
    return f"""st AS (SELECT doc_id, {bases} AS fw, reverse(translate({bases}, 'ACGTN', 'TGCAN')) AS rv FROM {source}), f0 AS ({parts}),
f AS (SELECT *, {letters_in('protein', '*')}::INTEGER AS stops, list_max(list_transform(string_split(protein, '*'), lambda x: length(x)))::INTEGER AS longest FROM f0)"""


BEST = "b AS (SELECT * EXCLUDE rk FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY longest DESC, stops, frame) AS rk FROM f) WHERE rk = 1)"


def heuristic_sql(v: str) -> str:
    before = "CASE " + " ".join(f"WHEN regexp_matches({v}, '{t}') THEN regexp_extract({v}, '^(.*){t}', 1)" for t in A.TAILS) + f" WHEN contains(right({v}, 30), 'W') THEN regexp_extract({v}, '^(.*)W', 1) END"
    loop = f"regexp_extract({before}, '(C[^C]*)$', 1)"
    return f"CASE WHEN length({loop}) >= 3 THEN {loop} ELSE '' END"


SQL = {
    "S02_repertoire_tables": f"WITH {READS} SELECT doc_id, sequence, productive, locus, NULL::VARCHAR AS v_call, source AS run FROM r",
    "S03_sequence_pairs": SEQS + " SELECT s.doc_id, 'ext_' || text_id AS seq_id, v AS aa_v_full, coalesce((SELECT min(quality)::VARCHAR FROM labels l WHERE l.doc_id = s.text_id), '') AS quality FROM s",
    "S07_structure_atoms": SEQS + " SELECT doc_id, rtrim(v, '-') AS seq FROM s",
    "S09_rule_model": f"SELECT family, condition, pos, rank, aa, support FROM ({COUNTED['A01_rule_mining']})",
    "S10_lead_table": "SELECT p_partkey % 4 IN (0, 2) AS is_lead, 'p_' || p_partkey AS id, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS seq FROM part",
    "K03_run_outputs": " UNION ALL ".join(f"SELECT '{name}' AS output, count(*) AS n FROM ({COUNTED[q]})" for name, q in (("archetypes", "A04_archetypes"), ("clusters", "A08_pattern_clusters"), ("correlations", "A06_feature_correlations"), ("rules", "A01_rule_mining"))),
    "K04_run_config": SEQS + f""", p AS (SELECT '{{"min_obs": 5, "min_support": 3, "positions": "fr3fr4"}}' AS parameters) SELECT family, count(*) AS n, any_value(parameters) AS parameters, any_value(left(md5(parameters), 12)) AS parameter_hash FROM s, p GROUP BY family""",
    "K05_matrix_file": f"SELECT window1, {', '.join(f'''max(r) FILTER (WHERE window2 = '{k}') AS {k}''' for k in K.WINDOWS)} FROM ({COUNTED['A23_window_correlations']}) GROUP BY 1",
    "P12_read_quality": f"WITH {READS} SELECT doc_id, {REASONS} AS reasons FROM r",
    "F08_translate_reads": f"WITH {READS}, y AS (SELECT doc_id, sequence, replace(sequence, 'N', 'A') AS filled FROM r) SELECT doc_id, {codons_sql('sequence', 0)} AS with_x, {codons_sql('filled', 0)} AS with_a FROM y",
    "F25_assembled_ids": SEQS + """, k AS (SELECT doc_id, doc_id % 1000 AS k, 'M_69_' || source || CASE WHEN doc_id % 2 = 0 THEN '_Univ_' ELSE '_Orig_' END || hallmarks AS head, v FROM s)
SELECT doc_id, head || CASE WHEN k % 7 = 0 THEN '_LEAD' ELSE '_T' || (k % 5) || 'R_H' || substr(v, 2, 1) || 'n_r' || lpad(k::VARCHAR, 3, '0') || '_s' || lpad(k::VARCHAR, 3, '0') END AS name FROM k""",
    "I01_reads_to_sequences": f"WITH {READS}, g AS (SELECT * FROM r WHERE {REASONS} = ''), {frames_sql('g', 'sequence').replace('f AS (', 'f1 AS (')}, f AS (SELECT * FROM f1 WHERE frame LIKE '+%'), {BEST}, a AS (SELECT doc_id, frame, rtrim(protein, '*') AS aa FROM b) SELECT doc_id, frame, aa, length(aa)::INTEGER AS len_v, {heuristic_sql('regexp_replace(aa, ' + chr(39) + '[^A-Z]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS cdr3, contains(aa, '*') AS has_stop FROM a WHERE length(aa) >= {LEAST_RESIDUES}",
    "I03_production_table": with_(META + """, p AS (SELECT doc_id, source, v, CASE WHEN organism = '' THEN 'labelled' ELSE 'plain' END AS origin, CASE WHEN organism = '' THEN targets ELSE '' END AS targets, CASE WHEN organism = '' THEN patent_id ELSE '' END AS patent_id, organism FROM m),
r AS (SELECT *, ((targets <> '')::INT * 20 + (patent_id <> '')::INT * 10 + (organism <> '')::INT * 5 + CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src2' THEN 1 ELSE 0 END)::INTEGER AS score FROM p)
SELECT doc_id, origin, targets, patent_id, organism, substr(v, 105, 13) AS cdr3, length(replace(v, '-', ''))::INTEGER AS len_v, 13 AS len_cdr3, score FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, doc_id) AS rk FROM r) WHERE rk = 1"""),
    "I04_dict_loops": SEQS + " SELECT doc_id, substr(v, 27, 12) AS cdr1, CASE WHEN family = 'VH_like' THEN '' ELSE substr(v, 56, 10) END AS cdr2, cdr3 FROM s",
    "U03_repeated_headers": SEQS + " SELECT doc_id, family, cdr3 FROM s",
    "U05_common_positions": SEQS + " SELECT 'imgt_' || p.pos AS position, count(*) AS n, sum((substr(v, p.pos::INTEGER, 1) = '-')::INT)::BIGINT AS gaps FROM s1, range(120, 126) p(pos) GROUP BY 1",
}

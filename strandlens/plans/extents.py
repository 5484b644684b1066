"""Further forms of registered operators: pair combinations, residuals within families, refusals by reason, conditional tag
removal, legacy names, rebuilt frameworks, delimited records, controls by track, pools, rank names, held-out accuracy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from strandlens.functions import anchors as A, residues as R
from strandlens.operators import coupling as K, design as D, merge as M, models as L, score as P, search as G
from strandlens.plans.counting import SEQS, SOME, letters_in, seq, windows_sql, with_
from strandlens.plans.designs import LEAD, graded, scratch
from strandlens.plans.working import CUT, H, HITS, TAGGED, rows_and_queries, tagged
from strandlens.sources import records as X
from strandlens.sources.sequences import once, sequences, table

#: Hallmarks that a pool has in any case, and places that a track may change beside the loops.
ALWAYS = ["YQRL", "FQRA"]
LOOPS = [*range(27, 39), *range(56, 66), *range(105, 118)]
BY_TRACK = {0: [2, *R.HALLMARKS], 1: R.VERNIER, 2: R.VERNIER, 3: R.VERNIER, 4: sorted({2, *R.VERNIER, *range(80, 97)})}
SHARE = 0.14


def pair_combinations(s):
    """Each hallmark's six most frequent residue pairs, over all pairs of some places."""
    counts = s.select("hallmarks", F.explode(K.pairs_of(SOME)).alias("x")).select("hallmarks", "x.*").groupBy("hallmarks", "pos1", "pos2", "aa1", "aa2").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return P.capped(counts, "hallmarks", [F.desc("n"), "pos1", "pos2", "aa1", "aa2"], 6)


def scan_reasons(spark, sf_dir):
    """Pairs of each source, and of all, by the first loop whose identity is too low, or as hits."""
    def first_low(loops):
        return np.select([loops[k].identity < least for k, least in CUT.items()], np.arange(len(CUT)), len(CUT)).astype(float)

    ids = G.pair_values(*rows_and_queries(spark, sf_dir), ["source"], {"reason": first_low})
    reason = F.element_at(F.array(*map(F.lit, [*CUT, "hit"])), F.col("reason").cast("int") + 1)
    return ids.select("source", reason.alias("reason")).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("c")).rollup("reason", "source").agg(F.sum("c").alias("n")).filter("reason IS NOT NULL")


def removed_if_common(s):
    rows = tagged(s)
    return M.stripped(rows, "tagged", M.common_tags(rows, "tagged", SHARE)).select("doc_id", "plain", "removed")


def legacy(s):
    """Framework positions under their older names (region and place in it), and back."""
    starts = {k: a for k, (a, _) in R.REGIONS.items() if k.startswith("fr")}
    long = s.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), R.residue("v", p).alias("aa")) for p in (4, 42, 49, 66, 94, 118)])).alias("x")).select("x.*")
    region = F.coalesce(*[F.when(F.col("pos").between(*R.REGIONS[k]), k) for k in starts])
    start = F.create_map(*[x for k, a in starts.items() for x in (F.lit(k), F.lit(a))])
    named = long.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.concat(F.upper(region), F.lit("_"), (F.col("pos") - start[region] + 1).cast("string")))
    back = start[F.lower(F.substring_index("name", "_", 1))] + F.substring_index("name", "_", -1).cast("int") - 1
    return named.withColumn("back", back)


def rebuilt(s):
    """Frameworks put together again from the cells of their grid, row by row."""
    cells = s.select("doc_id", once(F.array_sort(A.grid(*[R.region("v", k) for k in ("fr1", "fr2", "fr3", "fr4")]))).alias("g"))
    part = lambda a, b: F.array_join(F.transform(F.filter("g", lambda x: x["pos"].between(a, b)), lambda x: x["aa"]), "")
    return cells.select("doc_id", part(1, 27).alias("fr1"), part(41, 57).alias("fr2"), part(66, 105).alias("fr3"), part(118, 128).alias("fr4"))


def delimited(spark, sf_dir):
    path = f"{scratch(spark)}/records"
    sep = F.element_at(F.array(*map(F.lit, (",", ";", "\t", " | ", ": "))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    s = sequences(spark, sf_dir)
    s.select(F.concat(F.concat(F.lit("q"), F.col("doc_id").cast("string")), sep, F.lower("v"))).write.text(path)
    return X.read_delimited(spark, path)


def track_violations(s):
    """Rows of each track, as controls, that differ from the lead where their track may not."""
    rows = graded(s)
    different = [F.when(R.residue("v", p) != LEAD[p - 1], F.lit(p)) for p in range(1, 129) if p not in LOOPS]
    allowed = F.coalesce(*[F.when(F.col("track") == t, F.array(*map(F.lit, sorted(places)))) for t, places in BY_TRACK.items()])
    bad = F.size(F.array_except(F.array_compact(F.array(*different)), allowed))
    return rows.select("track", (bad > 0).alias("bad"), bad.alias("n")).groupBy("track").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("bad").cast("long")).alias("violating"), F.sum("n").alias("violations"))


def hallmark_pool(s):
    """The two most frequent true hallmarks of each family, and those that a pool always has."""
    true = s.filter(M.true_vhh_reason(F.col("hallmarks")) == "kept").groupBy("family", "hallmarks").agg(F.count(F.lit(1)).alias("n"))
    picked = P.capped(true, "family", [F.desc("n"), "hallmarks"], 2).select("hallmarks")
    return picked.union(s.sparkSession.createDataFrame([(x,) for x in ALWAYS], "hallmarks string")).distinct()


def hallmark_shares(s):
    """700 candidates over the five most frequent true hallmarks of each family."""
    true = s.filter(M.true_vhh_reason(F.col("hallmarks")) == "kept").groupBy("family", "hallmarks").agg(F.count(F.lit(1)).alias("n"))
    return D.hallmark_plan(P.capped(true, "family", [F.desc("n"), "hallmarks"], 5), 700)


def rank_names(s):
    """Lead, (Control) or a number for each of a family's best rows: the first row is the lead, track 0 are controls."""
    top = graded(s).select("doc_id", "family", "track", "score").orderBy("score", "doc_id").limit(100)
    order = Window.partitionBy("family", "control").orderBy("score", "doc_id")
    out = top.withColumn("control", F.col("track") == 0).withColumn("place", F.row_number().over(order))
    lead = F.col("doc_id") == F.min("doc_id").over(Window.partitionBy("family"))
    return out.select("doc_id", "family", F.when(lead, "Lead").when(F.col("control"), "(Control)").otherwise(F.col("place").cast("string")).alias("name"))


def held_out(s):
    """Accuracy of a place's model on the half of the rows that it wasn't fitted to."""
    key = R.sample_key(F.col("doc_id"))
    return L.accuracy(L.predict(s.filter(key >= 500_000), 71, fit_on=s.filter(key < 500_000)))


def weighted_best(spark, sf_dir):
    """Each query's three best rows of the annotated documents by weighted identity of the loops, with the annotation."""
    from strandlens.plans.working import metadata

    good = metadata(spark, sf_dir).filter("targets <> ''").select("doc_id", "targets", "organism", *[R.region("v", k).alias(k) for k in G.WEIGHTS])
    score = G.loop_score()
    best = G.best_pairs(good, G.queries(table(spark, sf_dir, "benchmark")), lambda loops: np.round(score(loops), 9), ["targets", "organism"], weighted=True)
    return best.withColumn("score", F.round("score", 9))


QUERIES = {
    "A14_pair_combinations": seq(pair_combinations),
    "A25_within_family_residuals": seq(lambda s: K.window_correlations(s, ("total", "len_cdr3", "len_v"), within=True)),
    "A30_scan_reasons": scan_reasons,
    "F17_conditional_removal": seq(removed_if_common),
    "F18_legacy_names": seq(legacy),
    "F19_rebuilt_frameworks": seq(rebuilt),
    "S06_delimited_records": delimited,
    "D12_track_violations": seq(track_violations),
    "D17_hallmark_pool": seq(hallmark_pool),
    "D17_hallmark_plan": seq(hallmark_shares),
    "W05_rank_names": seq(rank_names),
    "L01_held_out": seq(held_out),
    "G04_weighted_hits": weighted_best,
}


def common_sql() -> str:
    """CTEs u0, u1, ... that take one tag after the other, those of SHARE or more only."""
    out = "n0 AS (SELECT " + ", ".join(f"(avg(regexp_matches(x, '{p}')::INT) >= {SHARE}) AS has_{k}" for k, p in M.TAGS.items()) + " FROM t0), u0 AS (SELECT doc_id, x, '' AS removed FROM t0)"
    for i, (k, p) in enumerate(M.TAGS.items()):
        out += f", u{i + 1} AS (SELECT doc_id, CASE WHEN has_{k} THEN regexp_replace(x, '{p}', '') ELSE x END AS x, removed || CASE WHEN has_{k} AND regexp_matches(x, '{p}') THEN ',{k}' ELSE '' END AS removed FROM u{i}, n0)"
    return out + f" SELECT doc_id, x AS plain, ltrim(removed, ',') AS removed FROM u{len(M.TAGS)}"


def violating(track: int) -> str:
    return "(" + " + ".join(f"(substr(v, {p}, 1) <> '{LEAD[p - 1]}')::INT" for p in range(1, 129) if p not in LOOPS and p not in BY_TRACK[track]) + ")"


TRUE = f"{H[3]} = 'R' AND {H[4]} <> 'W' AND {H[1]} IN ('F', 'Y') AND {H[2]} IN ('E', 'Q', 'K')"
LEGACY = {4: "FR1_4", 42: "FR2_4", 49: "FR2_11", 66: "FR3_1", 94: "FR3_29", 118: "FR4_1"}

SQL = {
    "A14_pair_combinations": with_(f"""k AS (SELECT hallmarks, a.p::INTEGER AS pos1, b.p::INTEGER AS pos2, substr(v, a.p, 1) AS aa1, substr(v, b.p, 1) AS aa2, count(*) AS n FROM s, (SELECT unnest({SOME}) AS p) a, (SELECT unnest({SOME}) AS p) b WHERE a.p < b.p GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hallmarks ORDER BY n DESC, pos1, pos2, aa1, aa2)::INTEGER AS rank FROM k) WHERE rank <= 6"""),
    "A25_within_family_residuals": windows_sql(["total", "len_cdr3", "len_v"], within=True),
    "A30_scan_reasons": with_(HITS + ", r AS (SELECT source, CASE WHEN i1 < 0.2 THEN 'cdr1' WHEN i2 < 0.2 THEN 'cdr2' WHEN i3 < 0.2 THEN 'cdr3' ELSE 'hit' END AS reason FROM ids) SELECT reason, source, count(*)::BIGINT AS n FROM r GROUP BY GROUPING SETS ((reason, source), (reason))"),
    "F17_conditional_removal": with_(TAGGED + ", " + common_sql()),
    "F18_legacy_names": SEQS + ", p(pos, name) AS (VALUES " + ", ".join(f"({p}, '{n}')" for p, n in LEGACY.items()) + ") SELECT pos, (SELECT count(*) FROM s) AS n, name, pos AS back FROM p",
    "F19_rebuilt_frameworks": SEQS + " SELECT doc_id, substr(v, 1, 26) AS fr1, substr(v, 39, 17) AS fr2, substr(v, 66, 39) AS fr3, rtrim(substr(v, 118, 11), '-') AS fr4 FROM s",
    "S06_delimited_records": SEQS + " SELECT 'q' || doc_id AS id, v AS seq FROM s",
    "D12_track_violations": SEQS + ", x AS (SELECT (doc_id % 5)::INTEGER AS track, CASE (doc_id % 5) " + " ".join(f"WHEN {t} THEN {violating(t)}" for t in BY_TRACK) + " END AS n FROM s) SELECT track, count(*) AS rows, sum((n > 0)::INT)::BIGINT AS violating, sum(n)::BIGINT AS violations FROM x GROUP BY 1",
    "D17_hallmark_pool": SEQS + f", k AS (SELECT family, hallmarks, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, hallmarks) AS rk FROM s WHERE {TRUE} GROUP BY 1, 2) SELECT hallmarks FROM k WHERE rk <= 2 UNION SELECT unnest({ALWAYS})",
    "D17_hallmark_plan": SEQS + f", k AS (SELECT family, hallmarks, count(*) AS n, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, hallmarks) AS rk FROM s WHERE {TRUE} GROUP BY 1, 2), o AS (SELECT family, row_number() OVER (PARTITION BY family ORDER BY (hallmarks = 'YQRL')::INT DESC, n DESC, hallmarks) AS j, count(*) OVER (PARTITION BY family) AS k, hallmarks FROM k WHERE rk <= 5), f AS (SELECT family, row_number() OVER (ORDER BY family) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT family FROM o)), p AS (SELECT family, CASE WHEN i < m THEN 700 // m ELSE 700 - (m - 1) * (700 // m) END AS part FROM f) SELECT family, hallmarks, (part // k + CASE WHEN j <= part % k THEN 1 ELSE 0 END)::BIGINT AS wanted FROM o JOIN p USING (family) WHERE part // k + CASE WHEN j <= part % k THEN 1 ELSE 0 END > 0",
    "W05_rank_names": SEQS + f""", g AS (SELECT doc_id, family, doc_id % 5 = 0 AS control, ({letters_in('v', 'KRH')} - {letters_in('v', 'DE')})::INTEGER AS score FROM s ORDER BY score, doc_id LIMIT 100)
SELECT doc_id, family, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY family) THEN 'Lead' WHEN control THEN '(Control)' ELSE (row_number() OVER (PARTITION BY family, control ORDER BY score, doc_id))::VARCHAR END AS name FROM g""",
}

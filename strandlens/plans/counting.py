"""Registered counting queries, each with the same query in SQL."""

from __future__ import annotations

from strandlens.functions import residues as R
from strandlens.operators import counts as C, coupling as K, tallies as T
from strandlens.sources.sequences import all_sequences, sequences


def letters_in(x: str, letters: str) -> str:
    return f"(length({x}) - length(translate({x}, '{letters}', '')))"


def hydro_sql(x: str) -> str:
    by: dict[int, str] = {}
    for a, v in R.HYDROPHOBICITY.items():
        by[v] = by.get(v, "") + a
    return f"round(({' + '.join(f'{letters_in(x, a)} * ({v})' for v, a in by.items())}) / 10.0::DOUBLE / greatest(length({x}), 1), 3)"


FAMILY = f"""CASE WHEN substr(v, 50, 1) = 'L' THEN 'VH_like' WHEN substr(v, 52, 1) = 'W' THEN 'VHH_W52'
 WHEN substr(v, 42, 1) IN ('F', 'Y') THEN substr(v, 42, 1) || CASE WHEN {letters_in('v', 'C')} >= 4 THEN '_C4' ELSE '_C2' END ELSE 'Other_VHH' END"""
#: All sequences s1, and the complete ones s with cdr3 features, that every query below starts from.
SEQS = f"""WITH a0 AS (SELECT doc_id AS text_id, lang, source, regexp_extract_all(translate(regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g'), 'EFTRAYNGHLIWSC', 'FERTYAGNLHWICS'), '[A-Z]{{1,128}}') AS ws FROM documents),
s0 AS (SELECT text_id, lang, source, text_id * 1000000 + n - 1 AS doc_id, rpad(w, 128, '-') AS v FROM (SELECT text_id, lang, source, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM a0)),
s1 AS (SELECT *, substr(v, 42, 1) || substr(v, 49, 1) || substr(v, 50, 1) || substr(v, 52, 1) AS hallmarks, replace(substr(v, 105, 13), '-', '') AS cdr3, {FAMILY} AS family FROM s0),
c1 AS (SELECT * FROM s1 WHERE length(replace(substr(v, 4, 23), '-', '')) >= 20 AND length(replace(substr(v, 118, 8), '-', '')) >= 6),
s2 AS (SELECT *, length(cdr3)::INTEGER AS length, ({letters_in('cdr3', 'KRH')} - {letters_in('cdr3', 'DE')})::INTEGER AS charge, {hydro_sql('cdr3')} AS hydro, {letters_in('cdr3', 'C')}::INTEGER AS n_cys, {letters_in('cdr3', 'FWY')}::INTEGER AS aromatic FROM c1),
s AS (SELECT *, CASE WHEN length <= 8 THEN 'short' WHEN length <= 14 THEN 'medium' ELSE 'long' END AS cdr3_len,
 CASE WHEN charge <= -2 THEN 'negative' WHEN charge >= 2 THEN 'positive' ELSE 'neutral' END AS cdr3_charge, CASE WHEN n_cys = 0 THEN 'no_cys' WHEN n_cys = 1 THEN 'one_cys' ELSE 'multi_cys' END AS cdr3_cys FROM s2)"""


def with_(body: str) -> str:
    return SEQS + ",\n" + body


def long_sql(name: str, keep: str, places: list[int], source: str = "s") -> str:
    return f"{name} AS (SELECT {keep}{', ' if keep else ''}p.pos::INTEGER AS pos, substr(v, p.pos, 1) AS aa FROM {source}, (SELECT unnest({places}) AS pos) p WHERE substr(v, p.pos, 1) <> '-')"


RULE_PLACES = R.positions("fr3fr4")
TOKENS = "['family=' || family, 'hallmarks=' || hallmarks, 'cdr3_len=' || cdr3_len, 'cdr3_charge=' || cdr3_charge, 'cdr3_cys=' || cdr3_cys, 'cdr3[-1]=' || right(cdr3, 1)"
HALL = "(" + ", ".join(map(str, R.HALLMARKS)) + ")"
COVARIATES = {"total": f"({letters_in('v', 'KRH')} - {letters_in('v', 'DE')})", "len_cdr3": "length(cdr3)", "len_v": "length(replace(v, '-', ''))"}


def windows_sql(covariates: list[str] = [], within: bool = False) -> str:
    """Correlations of window charges; covariates are taken out one after the other, over all rows or within families."""
    charges = [f"({letters_in(f'substr(v, {a}, {b - a + 1})', 'KRH')} - {letters_in(f'substr(v, {a}, {b - a + 1})', 'DE')})::DOUBLE AS {k}" for k, (a, b) in K.WINDOWS.items()]
    over, names = "OVER (PARTITION BY family)" if within else "OVER ()", [*K.WINDOWS, *covariates]
    kept = " WHERE family IN (SELECT family FROM s GROUP BY 1 HAVING count(*) >= 10)" if within else ""
    steps = [f"w AS (SELECT family, {', '.join([*charges, *[f'{COVARIATES[k]}::DOUBLE AS {k}' for k in covariates]])} FROM s{kept})", f"d0 AS (SELECT family, {', '.join(f'{k} - avg({k}) {over} AS {k}' for k in names)} FROM w)"]
    for i, c in enumerate(covariates):
        names.remove(c)
        steps.append(f"d{i + 1} AS (SELECT family, {', '.join(f'{k} - {c} * coalesce(sum({k} * {c}) {over} / nullif(sum({c} * {c}) {over}, 0), 0) AS {k}' for k in names)} FROM d{i})")
    steps.append(f"g AS (SELECT {', '.join(f'sum({a} * {b}) AS {a}_{b}' for a in K.WINDOWS for b in K.WINDOWS)} FROM d{len(covariates)})")
    return with_(", ".join(steps) + " " + " UNION ALL ".join(f"SELECT '{a}' AS window1, '{b}' AS window2, round({a}_{b} / nullif(sqrt({a}_{a} * {b}_{b}), 0), 6) + 0.0::DOUBLE AS r FROM g" for a in K.WINDOWS for b in K.WINDOWS))


SOME = [42, 49, 50, 52, 71, 78, 94]
#: Three residues at each end of each loop, and what they are associated with.
LEFTS, RIGHTS = [27, 28, 29, 36, 37, 38, 56, 57, 58, 63, 64, 65, 105, 106, 107, 115, 116, 117], [*R.VERNIER, 118]
EVERY, FRAMEWORK = list(range(1, 129)), [p for k, (a, b) in R.REGIONS.items() if k.startswith("fr") for p in range(a, b + 1)]


def association_sql(name: str, by: str, least: int, source: str = "s") -> str:
    b = by + ", " if by else ""
    return f"""{name} AS (SELECT {b}pos1, aa1, pos2, aa2 AS predicted, n, total, n * 1.0::DOUBLE / total AS confidence FROM (
 SELECT *, sum(n) OVER (PARTITION BY {b}pos1, aa1, pos2)::BIGINT AS total, row_number() OVER (PARTITION BY {b}pos1, aa1, pos2 ORDER BY n DESC, aa2) AS rk FROM (
 SELECT {b}a.p::INTEGER AS pos1, substr(v, a.p, 1) AS aa1, b.p::INTEGER AS pos2, substr(v, b.p, 1) AS aa2, count(*) AS n FROM {source}, (SELECT unnest({LEFTS}) AS p) a, (SELECT unnest({RIGHTS}) AS p) b GROUP BY ALL)) WHERE rk = 1 AND total >= {least})"""


def pairs_sql(places: list[int], gaps: bool = True) -> str:
    return f"""j AS (SELECT a.p::INTEGER AS pos1, b.p::INTEGER AS pos2, substr(v, a.p, 1) AS aa1, substr(v, b.p, 1) AS aa2, count(*) AS n FROM s, (SELECT unnest({places}) AS p) a, (SELECT unnest({places}) AS p) b WHERE a.p < b.p{'' if gaps else " AND substr(v, a.p, 1) <> '-' AND substr(v, b.p, 1) <> '-'"} GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY pos1, pos2) AS t, sum(n) OVER (PARTITION BY pos1, pos2, aa1) AS n1, sum(n) OVER (PARTITION BY pos1, pos2, aa2) AS n2 FROM j),
i AS (SELECT pos1, pos2, max(t)::BIGINT AS n, sum(n * 1.0::DOUBLE / t * log2(n * 1.0::DOUBLE * t / (n1 * n2))) AS mi, greatest(-sum(n * 1.0::DOUBLE / t * log2(n1 * 1.0::DOUBLE / t)), -sum(n * 1.0::DOUBLE / t * log2(n2 * 1.0::DOUBLE / t))) AS h FROM m GROUP BY pos1, pos2)"""


IN_LOOP = "({0} BETWEEN 27 AND 38 OR {0} BETWEEN 56 AND 65 OR {0} BETWEEN 105 AND 117)"


def corr_sql(x: str, y: str) -> str:
    return f"round(corr({x}::DOUBLE, {y}::DOUBLE), 6)"


def safe_corr(x: str, y: str) -> str:
    top = f"(count(*) * sum({x} * {y}) - sum({x}) * sum({y}))"
    var = lambda z: f"greatest(count(*) * sum({z} * {z}) - sum({z}) * sum({z}), 0)"
    return f"round(greatest(-1::DOUBLE, least(1::DOUBLE, {top} / nullif(sqrt({var(x)} * {var(y)}), 0))), 6)"


def stats_sql(names: list[str], kind: str = "stddev_samp", extremes: bool = True) -> str:
    return ", ".join(f"round(avg({k}), 6) AS {k}_mean, round(coalesce({kind}({k}), 0), 6) AS {k}_std" + (f", min({k}) AS {k}_min, max({k}) AS {k}_max" if extremes else "") for k in names)


CLUSTERS = f"""c AS (SELECT family, {' || '.join(f'substr(v, {p}, 1)' for p in R.VERNIER)} AS pattern, count(*) AS n, {stats_sql(['length', 'charge', 'aromatic'], extremes=False)} FROM s GROUP BY ALL)"""
def weighted_sum_sql(x: str, values: dict[str, int]) -> str:
    by: dict[int, str] = {}
    for a, v in values.items():
        by[v] = by.get(v, "") + a
    return "(" + " + ".join(f"{letters_in(x, a)} * ({v})" for v, a in by.items()) + ")"


def feature_sql() -> str:
    out = []
    for k, x in (("cdr1", "substr(v, 27, 12)"), ("cdr2", "substr(v, 56, 10)"), ("cdr3", "cdr3")):
        out += [f"length({x})::INTEGER AS {k}_length", f"({letters_in(x, 'KRH')} - {letters_in(x, 'DE')})::INTEGER AS {k}_charge", f"{weighted_sum_sql(x, R.HYDROPHOBICITY)}::INTEGER AS {k}_hydro", f"{letters_in(x, 'FWY')}::INTEGER AS {k}_aromatic",
                f"{letters_in(x, 'C')}::INTEGER AS {k}_cys", f"{weighted_sum_sql(x, R.VOLUME)}::INTEGER AS {k}_volume", f"{weighted_sum_sql(x, R.BETA)}::INTEGER AS {k}_beta"]
    return ", ".join([*out, f"({letters_in('v', 'KRH')} - {letters_in('v', 'DE')})::INTEGER AS total_charge"])


COMPENSATION = f"""h AS (SELECT family, v, {feature_sql()} FROM s), {long_sql('l', 'family, ' + ', '.join(K.FEATURE_NAMES), FRAMEWORK, 'h')},
c AS (SELECT *, count(*) OVER (PARTITION BY family, pos) AS kinds FROM (SELECT family, pos, aa, count(*) AS n, {', '.join(f'avg({k}) AS {k}_mean, round(stddev_pop({k}), 6) AS {k}_std, min({k}) AS {k}_min, max({k}) AS {k}_max, ' + ', '.join(f'round(quantile_cont({k}, {q}), 6) AS {k}_p{round(q * 100)}' for q in K.SHARES) for k in K.FEATURE_NAMES)} FROM l GROUP BY ALL) WHERE n >= 10)"""


def archetype_sql(by: str, top: int, least: int = 10) -> str:
    return f"""{long_sql('l', by, R.VERNIER)}, k AS (SELECT {by}, pos, aa, count(*) AS support FROM l GROUP BY ALL),
r AS (SELECT *, sum(support) OVER (PARTITION BY {by}, pos) AS total, row_number() OVER (PARTITION BY {by}, pos ORDER BY support DESC, aa)::INTEGER AS rank FROM k)
SELECT {by}, pos, rank, aa AS consensus, support * 1.0::DOUBLE / total AS frequency, support FROM r WHERE rank <= {top} AND {by} IN (SELECT {by} FROM s GROUP BY 1 HAVING count(*) >= {least})"""


CONSERVATION = f"""{long_sql('l', 'family', R.positions('fr3fr4'))}, k AS (SELECT family, pos, aa, count(*) AS n FROM l GROUP BY ALL), fam AS (SELECT family, count(*) AS n_rows FROM s GROUP BY 1),
o AS (SELECT *, sum(n) OVER (PARTITION BY family, pos)::BIGINT AS n_obs, row_number() OVER (PARTITION BY family, pos ORDER BY n DESC, aa) AS rk FROM k),
cons AS (SELECT family, pos, max(n_obs) AS n_obs, 1 - max(n_obs) * 1.0::DOUBLE / max(n_rows) AS gap_rate, max(CASE WHEN rk = 1 THEN aa END) AS major, max(n * 1.0::DOUBLE / n_obs) AS major_frequency, round(sum(n * 1.0::DOUBLE / n_obs * log2(1 / (n * 1.0::DOUBLE / n_obs))), 6) AS entropy FROM o JOIN fam USING (family) GROUP BY ALL)"""


def seq(f):
    return lambda spark, sf_dir: f(sequences(spark, sf_dir))


def every(f):
    return lambda spark, sf_dir: f(all_sequences(spark, sf_dir))


QUERIES = {
    "A01_rule_mining": seq(T.mined),
    "A02_global_rules": seq(T.global_mined),
    "A03_hallmark_frequency": seq(C.hallmark_counts),
    "A03_family_frequency": seq(C.family_counts),
    "A04_archetypes": seq(C.archetypes),
    "A05_conservation": seq(lambda s: C.conservation(s, R.positions("fr3fr4"))),
    "A06_feature_correlations": seq(lambda s: C.feature_correlations(s, 71)),
    "A07_cdr_statistics": seq(C.cdr_statistics),
    "A08_pattern_clusters": seq(C.pattern_clusters),
    "A09_mixed_clusters": seq(C.mixed_clusters),
    "A10_mutual_information": seq(lambda s: K.mutual_information(s, EVERY, top=20)),
    "A11_normalised_information": seq(lambda s: K.mutual_information(s, EVERY, normalised=True, least=1000)),
    "A12_triplet_rules": seq(C.triplet_rules),
    "A13_pair_rules": seq(lambda s: C.pair_rules(s, [(42, 49), (49, 50), (50, 52), (66, 71), (78, 94)])),
    "A14_hallmark_profiles": seq(lambda s: C.archetypes(s, "hallmarks", least=3, second=True)),
    "A15_compensation": seq(lambda s: K.compensation(s, FRAMEWORK)),
    "A16_compensation_effects": seq(lambda s: K.compensation_effects(K.compensation(s, FRAMEWORK))),
    "A17_envelopes": seq(lambda s: C.envelopes(C.pattern_clusters(s))),
    "A18_associations": seq(lambda s: K.associations(s, LEFTS, RIGHTS)),
    "A19_junctions": seq(K.junctions),
    "A20_universal_associations": seq(lambda s: K.universal_associations(s, LEFTS, RIGHTS)),
    "A21_dependent_positions": seq(lambda s: K.dependent_positions(s, LEFTS, RIGHTS, confidence=0.5)),
    "A22_family_dependent": seq(lambda s: K.family_dependent_positions(C.conservation(s, R.positions("fr3fr4")), 0.15)),
    "A23_window_correlations": seq(lambda s: K.window_correlations(s, windows=K.windows_of(K.available(s)))),
    "A24_residual_correlations": seq(lambda s: K.window_correlations(s, ("total", "len_cdr3", "len_v"), windows=K.windows_of(K.available(s)))),
    "A25_within_family_correlations": seq(lambda s: K.window_correlations(s, within=True)),
    "A26_coverage": every(C.coverage),
    "A27_annotation_summary": seq(C.annotation_summary),
    "A29_cluster_sizes": seq(lambda s: C.cluster_sizes(C.pattern_clusters(s))),
    "T02_top_information": seq(lambda s: K.mutual_information(s, R.VERNIER, top=5)),
    "M02_rate_sample": seq(lambda s: s.filter(R.sample_key(s.doc_id) < 200_000).select("doc_id", "family")),
}

SQL = {
    "A01_rule_mining": with_(f"""{long_sql('l', 'family, hallmarks, cdr3_len, cdr3_charge, cdr3_cys, cdr3', RULE_PLACES)},
k AS (SELECT family, c, pos, aa, count(*) AS support FROM (SELECT family, pos, aa, unnest({TOKENS}]) AS c FROM l) GROUP BY ALL),
t AS (SELECT family, c, count(*) AS n_condition FROM (SELECT family, unnest({TOKENS}]) AS c FROM s) GROUP BY ALL),
b AS (SELECT family, pos, aa, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY family, pos) AS baseline FROM (SELECT family, pos, aa, count(*) AS n FROM l GROUP BY ALL)),
q AS (SELECT *, sum(support) OVER (PARTITION BY family, c, pos)::BIGINT AS n_valid FROM k),
z AS (SELECT family, c AS condition, pos, aa, support, n_valid, support * 1.0::DOUBLE / n_valid AS confidence, support * 1.0::DOUBLE / n_condition AS confidence_all, (support * 1.0::DOUBLE / n_valid) / baseline AS lift, baseline FROM q JOIN t USING (family, c) JOIN b USING (family, pos, aa))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, condition, pos ORDER BY support DESC, aa)::INTEGER AS rank FROM z WHERE n_valid >= 5 AND support >= 3 AND confidence >= 0.7 AND lift >= 1.1 AND NOT (condition LIKE 'hallmarks=%' AND pos IN {HALL})) WHERE rank <= 2"""),
    "A02_global_rules": with_(f"""{long_sql('l', 'family, hallmarks, cdr3_len, cdr3_charge, cdr3_cys, cdr3', R.positions('vernier'))},
k AS (SELECT c, pos, aa, count(*) AS support FROM (SELECT pos, aa, unnest({TOKENS}, 'cdr3[-2]=' || substr(cdr3, -2, 1), 'cdr3[-3]=' || substr(cdr3, -3, 1)]) AS c FROM l) GROUP BY ALL),
b AS (SELECT pos, aa, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY pos) AS baseline FROM (SELECT pos, aa, count(*) AS n FROM l GROUP BY ALL)),
q AS (SELECT *, support * 1.0::DOUBLE / sum(support) OVER (PARTITION BY c, pos) AS confidence, row_number() OVER (PARTITION BY c, pos ORDER BY support DESC, aa) AS rk FROM k)
SELECT c AS condition, pos, aa, support, confidence, confidence / baseline AS lift FROM q JOIN b USING (pos, aa) WHERE rk = 1 AND support >= 10 AND confidence >= 0.6 AND NOT (c LIKE 'hallmarks=%' AND pos IN {HALL})"""),
    "A03_hallmark_frequency": SEQS + " SELECT hallmarks, count(*) AS n, count(DISTINCT family) AS n_families FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "A03_family_frequency": SEQS + " SELECT family, count(*) AS n FROM s GROUP BY 1",
    "A04_archetypes": with_(archetype_sql("family", 1)),
    "A05_conservation": with_(CONSERVATION + " SELECT * FROM cons"),
    "A06_feature_correlations": SEQS + ", f AS (SELECT family, charge::DOUBLE AS charge, hydro, " + ", ".join(f"(substr(v, 71, 1) IN ({', '.join(repr(x) for x in ls)}))::INT::DOUBLE AS {k}" for k, ls in (("positive", "KRH"), ("negative", "DE"), ("aromatic", "FWY"))) + " FROM s) SELECT family, count(*) AS n, " + ", ".join(f"{safe_corr(a, b)} AS r_{a}_{b}" for a, b in (("charge", "positive"), ("charge", "negative"), ("hydro", "aromatic"), ("hydro", "positive"), ("charge", "aromatic"))) + ", 71 AS pos FROM f GROUP BY family",
    "A07_cdr_statistics": SEQS + f", a7 AS (SELECT *, 12 AS cdr1_length, 10 AS cdr2_length, length AS cdr3_length FROM s) SELECT family, count(*) AS n, {stats_sql(['charge', 'hydro', 'aromatic', 'cdr1_length', 'cdr2_length', 'cdr3_length'])} FROM a7 GROUP BY family",
    "A08_pattern_clusters": with_(CLUSTERS + " SELECT * FROM c"),
    "A09_mixed_clusters": with_(f"""p AS (SELECT *, {' || '.join(f'substr(v, {p}, 1)' for p in [*R.HALLMARKS, 71, 78, 94])} AS pattern FROM s),
f AS (SELECT pattern, string_agg(family || ':' || n, ',' ORDER BY family || ':' || n) AS families FROM (SELECT pattern, family, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1)
SELECT pattern, count(*) AS n, {', '.join(f'round(quantile_cont(charge, {q}), 6) AS charge_p{int(q * 100)}' for q in (0.05, 0.25, 0.5, 0.75, 0.95))}, avg((n_cys > 0)::INT) AS with_cys, any_value(families) AS families FROM p JOIN f USING (pattern) GROUP BY pattern HAVING count(*) >= 3"""),
    "A10_mutual_information": with_(pairs_sql(EVERY) + " SELECT pos1, pos2, n, round(mi, 6) + 0.0::DOUBLE AS mi FROM i ORDER BY round(mi, 6) DESC, pos1, pos2 LIMIT 20"),
    "A11_normalised_information": with_(pairs_sql(EVERY, False) + f", k AS (SELECT *, {IN_LOOP.format('pos1')} AS l1, {IN_LOOP.format('pos2')} AS l2 FROM i WHERE n >= 1000) SELECT pos1, pos2, n, round(mi, 6) + 0.0::DOUBLE AS mi, round(mi / nullif(h, 0), 6) + 0.0::DOUBLE AS nmi, CASE WHEN l1 AND l2 THEN 'CDR-CDR' WHEN l1 OR l2 THEN 'FR-CDR' ELSE 'FR-FR' END AS kind, CASE WHEN l1 THEN pos2 ELSE pos1 END IN ({', '.join(map(str, R.VERNIER))}) AS vernier FROM k"),
    "A12_triplet_rules": with_("""k AS (SELECT family, right(cdr3, 3) AS lhs, substr(v, 118, 3) AS rhs, count(*) AS support FROM s WHERE length(cdr3) >= 3 GROUP BY ALL),
q AS (SELECT *, sum(support) OVER (PARTITION BY family, lhs)::BIGINT AS n_lhs, sum(support) OVER (PARTITION BY family, rhs) AS n_rhs, sum(support) OVER (PARTITION BY family) AS n_family, row_number() OVER (PARTITION BY family, lhs ORDER BY support DESC, rhs) AS rk FROM k)
SELECT family, lhs, rhs, support, n_lhs, support * 1.0::DOUBLE / n_lhs AS confidence, (support * 1.0::DOUBLE / n_lhs) / (n_rhs * 1.0::DOUBLE / n_family) AS lift FROM q WHERE rk = 1 AND n_lhs >= 3 AND support * 1.0::DOUBLE / n_lhs >= 0.5"""),
    "A13_pair_rules": with_("""k AS (SELECT cdr3_charge, x.a::INTEGER AS pos1, substr(v, x.a, 1) AS aa1, x.b::INTEGER AS pos2, substr(v, x.b, 1) AS aa2, count(*) AS support FROM s, (VALUES (42, 49), (49, 50), (50, 52), (66, 71), (78, 94)) x(a, b) GROUP BY ALL),
q AS (SELECT *, support * 1.0::DOUBLE / sum(support) OVER (PARTITION BY cdr3_charge, pos1, aa1, pos2) AS confidence FROM k) SELECT * FROM q WHERE support >= 5 AND confidence >= 0.65"""),
    "A14_hallmark_profiles": with_(archetype_sql("hallmarks", 2, 3)),
    "A15_compensation": with_(COMPENSATION + " SELECT * FROM c WHERE kinds >= 2"),
    "A16_compensation_effects": with_(COMPENSATION + ", e AS (SELECT a.family, a.pos, a.aa AS aa1, b.aa AS aa2, " + ", ".join(f"b.{k}_mean - a.{k}_mean AS d_{k}" for k in K.EFFECTS) + " FROM c a JOIN c b ON a.family = b.family AND a.pos = b.pos AND a.aa < b.aa) SELECT * FROM e WHERE " + " OR ".join(f"abs(d_{k}) >= {x}" for k, x in K.EFFECTS.items())),
    "A17_envelopes": with_(CLUSTERS + " SELECT family, pattern, n, greatest(5.0::DOUBLE, round(length_mean - 2 * length_std, 6)) AS length_low, round(length_mean + 2 * length_std, 6) AS length_high, " + ", ".join(f"round({k}_mean - 2 * {k}_std, 6) AS {k}_low, round({k}_mean + 2 * {k}_std, 6) AS {k}_high" for k in ("charge", "aromatic")) + " FROM c"),
    "A18_associations": with_(association_sql("a", "", 10) + " SELECT * FROM a"),
    "A19_junctions": with_(f"""jn(j, a, b) AS (VALUES {', '.join(f"('{k}', {a}, {b})" for k, (a, b) in K.JUNCTIONS.items())}), jr AS (SELECT j AS junction, substr(v, a, 3) AS "left", substr(v, b, 5) AS "right" FROM s, jn WHERE NOT contains(substr(v, a, 3) || substr(v, b, 5), '-')
 UNION ALL SELECT 'length_cdr3_cdr1', length(cdr3)::VARCHAR, '12' FROM s UNION ALL SELECT 'length_cdr3_cdr2', length(cdr3)::VARCHAR, '10' FROM s), k AS (SELECT junction, "left", "right", count(*) AS n FROM jr GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY junction, "left")::BIGINT AS total, row_number() OVER (PARTITION BY junction, "left" ORDER BY n DESC, "right") AS rk FROM k) SELECT junction, "left", "right", n, total FROM q WHERE rk = 1 AND total >= 5"""),
    "A20_universal_associations": with_(f"""top AS (SELECT hallmarks FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50), w AS (SELECT *, hallmarks AS signature FROM s WHERE hallmarks IN (SELECT hallmarks FROM top)),
{association_sql('e', '', 3)}, {association_sql('i', 'signature', 3, 'w')},
g AS (SELECT e.pos1, e.aa1, e.pos2, e.predicted, count(*) AS clusters, avg((i.predicted = e.predicted)::INT) AS agreement FROM i JOIN e ON i.pos1 = e.pos1 AND i.aa1 = e.aa1 AND i.pos2 = e.pos2 GROUP BY ALL)
SELECT *, agreement >= 0.8 AS universal FROM g WHERE clusters >= 3"""),
    "A21_dependent_positions": with_(association_sql("a", "family", 3) + " SELECT family, pos1, pos2, count(*) AS n, count(DISTINCT predicted) AS kinds FROM a WHERE confidence >= 0.5 GROUP BY ALL HAVING count(DISTINCT predicted) > 1"),
    "A22_family_dependent": with_(CONSERVATION + " SELECT pos, count(DISTINCT major) AS kinds, count(*) AS families FROM cons WHERE major_frequency >= 0.15 GROUP BY 1 HAVING count(DISTINCT major) > 1"),
    "A23_window_correlations": windows_sql(),
    "A24_residual_correlations": windows_sql(["total", "len_cdr3", "len_v"]),
    "A25_within_family_correlations": windows_sql(within=True),
    "A26_coverage": SEQS + f" SELECT length(regexp_replace(substr(v, 66, 39), '[^{R.RESIDUES}]', '', 'g'))::INTEGER AS fr3_filled, length(regexp_replace(substr(v, 118, 11), '[^{R.RESIDUES}]', '', 'g'))::INTEGER AS fr4_filled, count(*) AS n FROM s1 GROUP BY ALL",
    "A27_annotation_summary": SEQS + " SELECT source, count(*) AS n, count(DISTINCT family) AS families, sum((family = 'VH_like')::INT)::BIGINT AS vh_like, sum((family LIKE 'F\\_%' ESCAPE '\\')::INT)::BIGINT AS f_like FROM s GROUP BY ROLLUP (source)",
    "A29_cluster_sizes": with_(CLUSTERS + " SELECT count(*) AS clusters, avg((n = 1)::INT) AS singleton_share, sum((n >= 2)::INT)::BIGINT AS n2, sum((n >= 10)::INT)::BIGINT AS n10, sum(n)::BIGINT AS covered FROM c"),
    "T02_top_information": with_(pairs_sql(R.VERNIER) + " SELECT pos1, pos2, n, round(mi, 6) AS mi FROM i ORDER BY round(mi, 6) DESC, pos1, pos2 LIMIT 5"),
    "M02_rate_sample": SEQS + " SELECT doc_id, family FROM s WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000000 < 200000",
}

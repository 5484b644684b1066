"""Steps that are counted in dense arrays or by whole columns, against plain versions of the same."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlens.functions import residues as R
from strandlens.operators import counts as C, distances as N, merge as M, score as P, search as G, tallies as T

LETTERS = R.RESIDUES


def random_rows(spark, n, seed=1, letters="ACDFY"):
    draw = random.Random(seed)
    made = [(i, ("F_C2", "Y_C4")[draw.random() < 0.4], "".join(draw.choice(letters) for _ in range(128))) for i in range(n)]
    rows = spark.createDataFrame(made, "doc_id long, family string, v string")
    return rows.withColumns({"hallmarks": R.hallmarks("v"), "cdr3": R.region("v", "cdr3")})


def test_global_rules_by_tallies(spark):
    rows = random_rows(spark, 400, letters="AAAAAC")
    want = {tuple(r) for r in C.global_rules(rows, min_support=3).collect()}
    assert want and {tuple(r) for r in T.global_mined(rows, min_support=3).collect()} == want


def edit(a, b, cost):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + cost(x, y))
    return row[-1]


@pytest.mark.parametrize("n, m", [(13, 13), (10, 13), (12, 9), (1, 3), (0, 2), (2, 0), (40, 38), (300, 260)])
def test_distances_by_diagonals(n, m):
    draw = random.Random(n * m)
    word = lambda k: "".join(draw.choice("ACDEKR") for _ in range(k))
    rows, query = [word(n) for _ in range(7)], word(m)
    letters = np.stack([N.plain(x) for x in rows]).T if n else np.zeros((0, 7), np.uint8)
    assert list(N.distances(letters, N.plain(query))) == [edit(x, query, lambda a, b: int(a != b)) for x in rows]
    costs = N.Costs(letters, G.QUARTERS, np.unique(N.plain(query)))
    assert list(N.distances(letters, N.plain(query), costs) / 4) == [edit(x, query, G.substitution_cost) for x in rows]


@pytest.mark.parametrize("weighted", [False, True])
def test_best_pairs_and_values_equal_all_pairs(spark, weighted):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("ADEK") for _ in range(draw.choice([0, 3, 5, 6, 9])))
    rows = spark.createDataFrame([(i, f"f{i}", word(), word(), word()) for i in range(120)], "doc_id long, family string, cdr1 string, cdr2 string, cdr3 string").repartition(3)
    asked = spark.createDataFrame([(i, word(), word(), word()) for i in range(9)], "query_id long, q_cdr1 string, q_cdr2 string, q_cdr3 string")
    ids = G.identities(G.pair_up(rows, asked), ["query_id", "doc_id", "family"], weighted=weighted)
    scored = ids.select("query_id", "doc_id", "family", G.weighted_score({k: F.col(f"id_{k}") for k in G.WEIGHTS}).alias("score"), "id_cdr3")
    found = G.pair_values(rows, asked, ["doc_id"], {"x": lambda loops: loops["cdr3"].identity}, weighted=weighted).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in scored.select("query_id", "doc_id", "id_cdr3").collect()} and len(found) == ids.count()
    want = P.capped(scored.drop("id_cdr3"), "query_id", [F.desc("score"), "doc_id"], 3)
    best = G.best_pairs(rows, asked, G.loop_score(), ["family"], weighted=weighted).select(want.columns)
    assert {tuple(r) for r in best.collect()} == {tuple(r) for r in want.collect()}


def test_read_frames_equal_columns(spark):
    draw = random.Random(3)
    reads = ["", "A", "AC", "ATG", *["".join(draw.choice("ACGTN") for _ in range(draw.randrange(90))) for _ in range(40)]]
    strands = [F.col("x"), M.reverse_complement(F.col("x"))]
    want = spark.createDataFrame([(x,) for x in reads], "x string").select(F.array(*[M.translate_frame(s, k) for s in strands for k in range(3)]).alias("f")).collect()
    assert [M.read_frames(x) for x in reads] == [list(r.f) for r in want]


def test_first_frame_equals_columns(spark):
    draw = random.Random(4)
    reads = ["", "A", "AC", "NNN", "ATGN", *["".join(draw.choice("ACGTN") for _ in range(draw.randrange(90))) for _ in range(40)]]
    rows = spark.createDataFrame(list(enumerate(reads)), "doc_id long, sequence string")
    want = rows.select("doc_id", M.translate_frame(F.col("sequence"), 0).alias("x"), M.translate_frame(F.translate("sequence", "N", "A"), 0).alias("a")).collect()
    found = M.first_frame(rows.repartition(3), "doc_id", "sequence", {"x": "N", "a": "A"})
    assert sorted(found.collect()) == sorted(want)
    assert "transform(" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, best", [(3, 5), (64, 5), (700, 5), (700, 1)])
def test_best_clusters_by_bitsets(n, best):
    draw = random.Random(n)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(16))
    patterns, designs = [word("ACDE") for _ in range(n)], [word("ACDE") for _ in range(20)] + ["-" * 16, "A" * 16, word("WA-")]
    found = [set() for _ in designs]
    for d, p, same in zip(*P.best_of(P.bitsets(patterns, 16), P.plain_patterns(designs, 16), best)):
        found[d].add((int(p), int(same)))
    for own, got in zip(designs, found):
        counts = sorted((-sum(a == b for a, b in zip(own, p)), i) for i, p in enumerate(patterns))
        assert got == {(i, -c) for c, i in counts[:best] if c}


def test_more_controls_than_are_chosen(spark):
    from strandlens.plans.quotas import holds

    made = [("a", i, 0 if i < 40 else 1 + i % 4, "k", "b", "original", 1.0) for i in range(60)]
    pool = spark.createDataFrame(made, "lead string, candidate long, track int, kind string, bucket string, scaffold string, score double")
    assert [tuple(r) for r in holds(pool, 30).collect()] == [("a", 30, 30, 40, True, True, True)]


def test_pair_counts_and_scaffold_fit(spark):
    from strandlens.operators import candidates as Q, coupling as K

    rows = random_rows(spark, 150, letters="AACD-")
    lefts, rights = [27, 56, 106], [42, 49]
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("pos1"), R.residue("v", a).alias("aa1"), F.lit(b).alias("pos2"), R.residue("v", b).alias("aa2")) for a in lefts for b in rights])).alias("x")
    for by in ([], ["family"]):
        want = {tuple(r) for r in rows.select(*by, pairs).groupBy(*by, "x.pos1", "x.aa1", "x.pos2", "x.aa2").count().collect()}
        keys = [*by, "pos1", "aa1", "pos2", "aa2"]
        assert {tuple(r) for r in K.pair_counts(rows.repartition(3), lefts, rights, by).groupBy(*keys).agg(F.sum("n")).collect()} == want
    rules = K.associations(rows, lefts, rights, least=2, by=["family"]).collect()
    cells = [("x", 42, "A"), ("x", 49, "C"), ("y", 42, "D"), ("y", 49, "A")]
    table = spark.createDataFrame(rules, "family string, pos1 int, aa1 string, pos2 int, predicted string, n long, total long, confidence double")
    found = {r.doc_id: (r.scaffold, r.fit, r.grafts) for r in Q.scaffold_fit(rows, table, spark.createDataFrame(cells, "scaffold string, pos int, aa string"), cut=40).collect()}
    for r in rows.collect():
        best = {}
        for x in rules:
            if x.family == r.family and r.v[x.pos1 - 1] == x.aa1 and x.confidence * 100 >= 40:
                best[x.pos2] = min(best.get(x.pos2, (0, "")), (-x.confidence, x.predicted))
        fits = []
        for k in "xy":
            mine = [(best[p], a) for s, p, a in cells if s == k and p in best]
            total = sum(-c for (c, _), _ in mine)
            fits.append((-round(100 * sum(-c for (c, q), a in mine if q == a) / total, 6) if mine else -100.0, k, sum(q != a for (_, q), a in mine)))
        f, k, grafts = min(fits)
        assert found[r.doc_id] == (k, pytest.approx(-f, abs=2e-6), grafts)


def test_atom_chains_from_scattered_lines(spark):
    from strandlens.sources.records import THREE, atom_chains

    draw, lines, want = random.Random(8), [], {}
    for ident in range(12):
        found = {}
        for serial in draw.sample(range(1, 400), 90):
            number, name = draw.choice([draw.randrange(-3, 40), serial // 8]), draw.choice([*THREE, "UNK"])
            lines.append((ident, f"ATOM  {serial:5d}  CA  {name} H{number:4d}    "))
            found[number] = min(found.get(number, (999, "")), (serial, THREE.get(name, "X")))
        want[ident] = "".join(found[k][1] for k in sorted(found))
    for parts in (1, 5):
        got = atom_chains(spark.createDataFrame(lines, "id long, line string").repartition(parts), "id", "line", "H").collect()
        assert {r.id: r.seq for r in got} == want


def test_met_rules_are_not_shuffled(spark):
    from strandlens.operators import candidates as Q

    rows = random_rows(spark, 60)
    base = C.features(rows).collect()
    own = [{f"{k}={r[k]}" for k in ("family", "hallmarks", "cdr3_len", "cdr3_charge", "cdr3_cys")} | {f"cdr3[-{k}]={r.cdr3[-k]}" for k in (1, 2, 3) if len(r.cdr3) >= k} for r in base]
    one = base[0]
    conditions = [f"hallmarks={one.hallmarks}", f"cdr3_len={one.cdr3_len} AND hallmarks={one.hallmarks}", f"cdr3_cys={one.cdr3_cys} AND cdr3_charge={one.cdr3_charge}", f"cdr3[-1]={one.cdr3[-1]} AND other=x", "other=x", f"family={one.family} AND family={one.family}", "cdr3_len=never AND other=x"]
    rules = spark.createDataFrame([("F_C2", c, 70, "A", 0.9, 1) for c in conditions] + [("F_C2", conditions[0], 71, "A", 0.3, 1)], "family string, condition string, pos int, aa string, confidence double, rank int")
    found = P.applicable_rules(rows, rules)
    known = ("family=", "hallmarks=", "cdr3")
    right = sorted((r.doc_id, c, r.v[69] == "A") for r, o in zip(base, own) for c in conditions if all(p in o for p in c.split(" AND ") if p.startswith(known)))
    assert sorted((r.doc_id, r.condition, r.obeyed) for r in found.collect()) == right
    assert "hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()
    kinds = spark.createDataFrame([("F_C2", p, "A") for p in (40, 70)], "family string, pos int, consensus string")
    assert Q.family_terms(rows, kinds)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(doc_id") == 1


def test_blocks_of_parts_give_the_rules_of_the_whole(spark, monkeypatch):
    from strandlens.operators import blocks as B

    monkeypatch.setattr(B, "AT_ONCE", 7)
    rows = random_rows(spark, 900, letters="AAAAAC-")
    rows = rows.withColumn("family", F.when(F.col("doc_id") % 17 != 0, F.col("family"))).repartition(3)
    places = R.positions("fr3fr4")
    parts = [B.packed(rows.filter(F.col("doc_id") % 3 == k), places) for k in range(3)]
    kept = B.compacted(parts[0].union(B.compacted(parts[1].union(parts[2]), len(places))), len(places))
    assert kept.groupBy("family", "condition").count().filter("count > 1").count() == 0
    plain = lambda f: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in f.collect())
    want = T.rules_of(T.tallied(rows, places), min_confidence=0.6, min_lift=0.5, top=3)
    for blocks in (kept, parts[0].union(parts[1]).union(parts[2])):
        assert plain(B.rules_of(blocks, places, min_confidence=0.6, min_lift=0.5, top=3).select(want.columns)) == plain(want)
    assert len(plain(want)) > 20
    both = B.both_found(rows)
    assert plain(B.family_rules(both)) == plain(T.rules_of(T.tallied(rows, places))) and plain(B.global_rules(both)) == plain(T.global_mined(rows))


def test_a_batch_writes_its_own_rows_and_levels_are_merged(spark, tmp_path, monkeypatch):
    from strandlens.streaming import rules as A

    monkeypatch.setattr(A, "FAN", 2)
    rows, path, places = random_rows(spark, 70, letters="AC"), f"file://{tmp_path}/counts", [50, 70]
    batch = lambda k: rows.filter(F.col("doc_id") % 7 == k).select("family", "hallmarks", "cdr3", "v")
    for k in range(7):
        A.merge(batch(k), k, path, places)
        levels = [x["level"] for x in A.manifest(spark, path, k)]
        assert levels == [i for i in (2, 1, 0) if (k + 1) >> i & 1]
    assert A.current(spark, path).filter("condition LIKE 'family=%'").agg(F.sum("n")).first()[0] == 70
    kept = {x["at"] for k in A.versions(spark, path) for x in A.manifest(spark, path, k)}
    assert {x.name for x in (tmp_path / "counts").iterdir() if x.name.startswith("blocks")} == kept


def test_merged_rules_come_from_one_counting_pass(spark, monkeypatch):
    from strandlens.operators import blocks as B, design as D
    from strandlens.plans import rulework, working
    from strandlens.sources.sequences import sequences

    sf, passes, packed = "/root/testdata/sf0.001", [], B.packed
    rows = sequences(spark, sf).cache()
    monkeypatch.setattr(B, "packed", lambda *a, **b: passes.append(a) or packed(*a, **b))
    names = ["condition", "pos", "aa"]
    want = M.merge_rules(C.rules(rows).select(*names), C.global_rules(rows).select(*names))
    found = working.QUERIES["J09_rules_not_known"](spark, sf)
    assert sorted(found.collect()) == sorted(want.collect()) and len(passes) == 1
    want = M.merge_rules(D.convert_rules(C.rules(rows)).select("pos", "aa").distinct(), C.rules(rows, mode="all", min_confidence=0.5).select("pos", "aa").distinct())
    found = rulework.QUERIES["U04_rule_merge"](spark, sf)
    assert sorted(found.collect()) == sorted(want.collect()) and len(passes) == 2
    rows.unpersist()


def test_rule_naturalness_is_looked_up_in_the_row(spark):
    from strandlens.operators import candidates as Q

    rows = random_rows(spark, 80, seed=6, letters="ACDFY-")
    some = rows.select("hallmarks").limit(3).collect()
    marks = [f"hallmarks={r.hallmarks}" for r in some]
    conditions = [*marks, f"cdr3_cys=multi_cys AND {marks[0]}", "cdr3_len=medium AND cdr3_cys=multi_cys", "cdr3[-1]=A AND other=x", "other=x", "family=F_C2"]
    made = [(f, c, p, a, 0.5 + (i % 7) / 20, 1) for i, (f, c, p, a) in enumerate((f, c, p, a) for f in ("F_C2", "Y_C4", "VH_like") for c in conditions for p, a in ((70, "A"), (71, "D")))]
    rules = spark.createDataFrame([*made, ("F_C2", marks[0], 80, "A", 0.4, 1), ("F_C2", marks[0], 80, "C", 0.9, 2)], "family string, condition string, pos int, aa string, confidence double, rank int")
    kinds = spark.createDataFrame([(f, p, a) for f, a in (("F_C2", "F"), ("Y_C4", "Y"), ("Other_VHH", "A"), ("VH_like", "A")) for p in (42, 50, 70, 90)], "family string, pos int, consensus string")
    found = Q.naturalness_by_rules(rows, kinds, rules)
    met = {}
    for r in P.applicable_rules(rows, rules).collect():
        met.setdefault((r.doc_id, r.family), []).append((r.confidence, r.obeyed))
    terms = {}
    for r in Q.family_terms(rows, kinds).collect():
        terms.setdefault(r.doc_id, []).append(r)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == 80 and any(k[1] == "F_C2" for k in met)
    for doc, own in terms.items():
        comply = {r.family: (lambda x: sum(c for c, o in x if o) / sum(c for c, _ in x) if x else 1.0)(met.get((doc, r.family), [])) for r in own}
        best = min(own, key=lambda r: (-round(r.probability, 9), r.family))
        assert got[doc].family == best.family and got[doc].naturalness == pytest.approx(sum(r.probability * comply[r.family] for r in own if r.probability >= 0.15), abs=2e-9)
    assert "hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_atom_lines_of_cells_and_of_rows_give_the_chain(spark):
    from strandlens.sources.records import THREE, atom_chains, atom_lines

    seqs = ["ACDEFGHIKLMNPQRSTVWY" * 7, "A", "", "WX-Y", "C" * 128]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, s string")
    made = atom_lines(rows.repartition(2), "id", "s")
    one = {r.id: r.line.split("\n") for r in made.collect()}
    name = {v: k for k, v in THREE.items()}
    want = {}
    for k, x in enumerate(seqs):
        for i, a in enumerate(x):
            own = [(3 * i + 1, "N", name[a]), (3 * i + 2, "CA", name[a])] if a in name else []
            own += [(3 * i + 3, "CA", "GLY")] if i % 5 == 0 else []
            want.setdefault(k, []).extend(f"ATOM  {n:5d}  {at:<2s}  {res} H{i + 1:4d}    " for n, at, res in own)
    assert {k: [x.rstrip() for x in v] for k, v in one.items()} == {k: [x.rstrip() for x in v] for k, v in want.items() if v}
    chains = {0: seqs[0], 1: "A", 3: "WY", 4: seqs[4]}
    assert {r.id: r.seq for r in atom_chains(made, "id", "line", "H").collect()} == chains
    lines = [(k, x) for k, v in one.items() for x in v]
    odd = [(0, None), (0, "ATOM"), (0, "HETATM    1  CA  ALA H   1    "), (0, "ATOM      1  CA  ALA L   1    "), (9, "ATOM   é   1  CA ALA H   1"), (5, "ATOM      x  CA  ALA H   y    "), (5, "ATOM      7  CA  UNK H   2")]
    single = atom_chains(spark.createDataFrame(lines + odd, "id long, line string").repartition(3), "id", "line", "H").collect()
    assert {r.id: r.seq for r in single if r.id != 9} == chains | {5: "AX"}

"""Hand rows for the sequence functions."""

import pytest
from pyspark.sql import functions as F

from strandlens.functions import anchors as A, residues as R
from strandlens.operators import counts as C, coupling as K, design as D, merge as M, models as L, score as P, search as G
from strandlens.sources import sequences as S


def sequence(**at):
    letters = ["S"] * 128
    for k, a in at.items():
        letters[int(k[1:]) - 1] = a
    return "".join(letters)


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("marks, wanted", [
    (dict(p42="F", p49="E", p50="R", p52="G", p22="C", p103="C"), "F_C2"),
    (dict(p42="V", p49="G", p50="L", p52="W"), "VH_like"),
    (dict(p42="Y", p49="E", p50="R", p52="W"), "VHH_W52"),
    (dict(p42="F", p1="C", p2="C", p3="C", p4="C"), "F_C4"),
    (dict(p42="A"), "Other_VHH"),
])
def test_families(spark, marks, wanted):
    assert one(spark, R.family("v"), v=sequence(**marks)) == wanted


def test_positional_cysteines_and_reasons(spark):
    assert one(spark, R.family_positional("v"), v=sequence(p42="F", p55="C", p100="C")) == "F_C4"
    assert one(spark, M.cysteine_reasons("v"), v=sequence(p55="C", p23="C", p104="C")) == "odd;half_pair"
    assert one(spark, M.cysteine_reasons("v"), v=sequence(p23="C", p104="C")) == ""


@pytest.mark.parametrize("n, name", [(8, "short"), (9, "medium"), (14, "medium"), (15, "long")])
def test_length_bins(spark, n, name):
    assert one(spark, R.length_bin(F.lit(n))) == name


@pytest.mark.parametrize("q, name", [(-2, "negative"), (-1, "neutral"), (1, "neutral"), (2, "positive")])
def test_charge_bins(spark, q, name):
    assert one(spark, R.charge_bin(F.lit(q))) == name


def test_features_and_null_strings(spark):
    assert one(spark, R.charge("x"), x="KRHDEA") == 1
    assert one(spark, R.hydrophobicity("x"), x="IV") == pytest.approx(4.35)
    assert one(spark, R.hydrophobicity(F.lit(None).cast("string"))) == 0.0
    assert [one(spark, R.norm_cell(F.lit(x))) for x in (" NaN ", "", "none", " A ")] == ["-", "-", "-", "A"]
    assert one(spark, R.identity(F.lit(""), F.lit("A"))) == 0.0 and one(spark, R.identity(F.lit("ABCD"), F.lit("ABXD"))) == 0.75


@pytest.mark.parametrize("a, b, wanted", [("D", "E", 0.75), ("K", "H", 0.5), ("A", "W", 0.0), ("AD", "AE", 0.875), ("", "A", 0.0)])
def test_weighted_identity(spark, a, b, wanted):
    assert one(spark, G.weighted_identity("a", "b"), a=a, b=b) == pytest.approx(wanted)


def test_heuristic_loops(spark):
    head = "QVQLVESGGGLVQPGGSLRLSCAASGFTF"
    cases = {head + "YYCAADRGYWGQGTLVTVSS": "CAADRGY", head + "YYCAAWGQG": "CAA", "A" * 10 + "C" + "D" * 50 + "WGQG": "C" + "D" * 50, "AAAA": "", "CAWAA": "", "xxcaaa-wsqg": "CAAA"}
    for v, loop in cases.items():
        assert one(spark, A.heuristic_cdr3(F.col("v")), v=v) == loop


def anchored(v, place="instr"):
    import re

    # the same search in plain Python, by hand
    start = next((60 + m.start() for t in A.FR2_STARTS if (m := re.search(t, v[10:60]))), 80)
    end = next((start + m.start() for t in A.FR4_STARTS if (m := re.search(t, v[start:]))), None)
    if end is None and (m := re.search("QG[TL][LQ]VTVSS", v[-25:])):
        end = len(v) - 25 + m.start() - 2
    if end is None:
        end = next((p for p in range(len(v) - 15, start, -1) if v[p : p + 2] in ("WG", "WS", "WV")), None)
    c = next((p for p in range((end or 0) - 5, max(start - 10, (end or 0) - 40), -1) if p >= 0 and v[p] == "C"), None) if end is not None else None
    return "" if c is None else v[c + 1 : end]


def test_anchored_loops_against_plain_search(spark):
    import random

    rng, texts = random.Random(3), []
    parts = ["WFRQ", "WYRK", "WARA", "WGQGTLVTVSS", "WGQGT", "WSQG", "SSQGTQVTVSS", "C", "WG", "WS", "WV", "AQGTLVTVSS"]
    for _ in range(300):
        texts.append("".join(rng.choice(parts) if rng.random() < 0.06 else rng.choice("ADEFGKLQRSTVYC") for _ in range(rng.randint(60, 150))))
    frame = spark.createDataFrame([(v,) for v in texts], "v string")
    for step in A.anchored_cdr3("v"):
        frame = frame.withColumns({k: F.expr(x) for k, x in step.items()})
    assert [r.cdr3 for r in frame.select("cdr3").collect()] == [anchored(v) for v in texts]


def rows_of(spark, *marks):
    frame = spark.createDataFrame([(i, "x", "s", sequence(**m)) for i, m in enumerate(marks)], "doc_id long, lang string, source string, v string")
    return frame.withColumns({"family": R.family("v"), "hallmarks": R.hallmarks("v"), "cdr3": R.region("v", "cdr3")})


def test_compliance_weighs_by_confidence(spark):
    rows = rows_of(spark, dict(p71="K", p78="D"), dict(p71="K", p78="E"), dict(p42="F"))
    rules = spark.createDataFrame([("Other_VHH", "family=Other_VHH", 71, "K", 0.9, 1), ("Other_VHH", "cdr3_len=medium AND cdr3[-1]=S", 78, "D", 0.6, 1), ("Other_VHH", "cdr3_len=long", 78, "A", 0.9, 1)], "family string, condition string, pos int, aa string, confidence double, rank int")
    found = {r.doc_id: r for r in P.rule_compliance(rows, rules).collect()}
    assert (found[0].applicable, found[0].obeyed, found[0].compliance) == (2, 2, 1.0)
    assert found[1].compliance == pytest.approx(0.6) and found[1].violations == "78D"
    assert (found[2].applicable, found[2].compliance, found[2].violations) == (0, 1.0, "")


def test_plans_add_up(spark):
    families = spark.createDataFrame([("a", 7), ("b", 3), ("c", 1)], "family string, n long")
    rows = D.generation_plan(families, 101).collect()
    assert sum(r.wanted for r in rows) == 101 and {r.wanted for r in rows if r.scaffold == "universal"} == {30}


def test_hallmark_plan(spark):
    pool = spark.createDataFrame([("a", "FERG", 9), ("a", "YQRL", 1), ("a", "FERA", 9), ("b", "VGLW", 2), ("c", "YERL", 4), ("c", "YERA", 5)], "family string, hallmarks string, n long")
    found = {(r.family, r.hallmarks): r.wanted for r in D.hallmark_plan(pool, 32).collect()}
    assert found == {("a", "YQRL"): 4, ("a", "FERA"): 3, ("a", "FERG"): 3, ("b", "VGLW"): 10, ("c", "YERA"): 6, ("c", "YERL"): 6}
    # fewer than families: all is left over to the last
    assert sorted(tuple(r) for r in D.hallmark_plan(pool, 2).collect()) == [("c", "YERA", 1), ("c", "YERL", 1)]
    assert D.hallmark_plan(pool.limit(0), 5).count() == 0


def test_naturalness_without_clusters(spark):
    rows = rows_of(spark, dict(p71="K"), dict(p105="W"))
    found = P.naturalness(rows, C.pattern_clusters(rows), least=5).collect()
    assert len(found) == 2 and all(r.best_match == 0 for r in found)
    none = P.naturalness(rows, C.pattern_clusters(rows).filter("n < 0")).collect()
    assert {r.z_length for r in none} == {-0.4}  # 13 against 15 with deviation 5


def test_cluster_blocks_give_the_same(spark, monkeypatch):
    rows = rows_of(spark, *[dict(p71="ACDEFGH"[i % 7], p78="KRST"[i % 4]) for i in range(40)])
    clusters = C.pattern_clusters(rows)
    whole = sorted(map(tuple, P.cluster_matches(rows, clusters, least=1).collect()))
    monkeypatch.setattr(P, "MAX_CLUSTERS", 5)
    assert sorted(map(tuple, P.cluster_matches(rows, clusters, least=1).collect())) == whole


def test_weighted_distance_of_batches(spark):
    import random

    rng = random.Random(1)
    pairs = [("".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randint(0, 9))), "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=rng.randint(0, 9)))) for _ in range(200)] + [("D", "E")] * 3
    found = spark.createDataFrame(pairs, "a string, b string").select(G.weighted_identity("a", "b").alias("x")).collect()
    want = [1 - G.weighted_distance(a, b) / max(len(a), len(b)) if a and b else 0.0 for a, b in pairs]
    assert [r.x for r in found] == pytest.approx(want)


def test_selection_equals_the_walk_over_all(spark):
    import random

    rng = random.Random(2)
    pool = [("l", i, rng.choice("abc"), float(rng.randint(0, 20))) for i in range(120)]
    found = {r.candidate for r in P.repair_selection(spark.createDataFrame(pool, "lead string, candidate long, kind string, score double"), "lead", 20).collect()}
    most, used, taken, rest = 7, {}, set(), {}
    for _, c, k, s in sorted(pool, key=lambda x: (x[3], x[1])):
        if used.get(k, 0) < most and len(taken) < 20:
            taken.add(c)
            used[k] = used.get(k, 0) + 1
    assert found == taken


def test_universal_grid(spark):
    frames = ["QVQLVESGGGLVQPGGSLRLSCAASG", "WFRQAPGQGLEAVA", "YYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYC", "WGQGTLVTVSS"]
    cells = dict(one(spark, A.grid(*[F.lit(x) for x in frames])))
    assert (cells[23], cells[104], cells[41]) == ("C", "C", "W") and 10 not in cells and 73 not in cells and cells[27] == "G"
    assert "".join(cells[p] for p in R.HALLMARKS) == "FGLA"


def test_frames_and_tags(spark):
    rows = spark.createDataFrame([("a", "TAAATGGCTGCTGCTTAA"), ("b", None), ("c", "AC")], "id string, dna string")
    best = {r.id: r for r in M.best_frame(M.six_frames(rows, "id", "dna"), "id").collect()}
    assert best["a"].longest >= 5 and best["c"].protein == ""
    assert one(spark, M.translate_frame(F.lit("ATGNNNTAA"), 0)) == "MX*" and one(spark, M.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert one(spark, M.strip_tags(F.lit("WGQGTLVTVSSHHHHHH"))) == "WGQGTLVTVSS"


def test_truncation_and_numbered_rows(spark):
    from strandlens.plans.working import truncation

    rows = spark.createDataFrame([(n, "SSS" + "S" * n + "-" * (23 - n) + "S" * 91 + "S" * 6 + "-" * 5) for n in (19, 20)], "doc_id int, v string")
    assert {r.doc_id: r.kept for r in truncation(rows).collect()} == {19: False, 20: True}
    assert one(spark, S.decode_numbered(F.array(*[F.lit(c) for c in (81, 0, 118, 124, 76)]))) == "QVL"


def test_correlations_are_symmetric_with_unit_diagonal(spark):
    rows = spark.createDataFrame([(i, "s", "x", ("KDEAQ"[i % 5] + "RSTKD"[i % 4]) * 64) for i in range(40)], "doc_id int, source string, lang string, v string")
    rows = rows.withColumns({"family": F.lit("f"), "hallmarks": R.hallmarks("v"), "cdr3": R.region("v", "cdr3")})
    found = {(r.window1, r.window2): r.r for r in K.window_correlations(rows).collect()}
    assert all(found[a, a] == pytest.approx(1.0) for a in K.WINDOWS) and all(found[a, b] == found[b, a] for a, b in found)


def test_selection_is_exact_and_dedup_idempotent(spark):
    pool = spark.createDataFrame([("l", i, "k" if i < 30 else "m", float(i)) for i in range(40)], "lead string, candidate long, kind string, score double")
    rows = P.repair_selection(pool, "lead", 20).collect()
    assert len(rows) == 20 and sum(r.kind == "k" for r in rows) == 10
    twice = spark.createDataFrame([(1, "b", "AA"), (2, "a", "AA"), (3, "a", "")], "doc_id int, source string, v string")
    once = M.first_seen(twice, "v", ["source", "doc_id"])
    assert [r.doc_id for r in once.collect()] == [2] and M.first_seen(once, "v", ["source", "doc_id"]).count() == 1


def test_rule_probabilities(spark):
    rows = spark.createDataFrame([(i, "x", "s", sequence(p42="F", p71="K" if i % 2 else "R", p117="K" if i % 2 else "D")) for i in range(40)], "doc_id int, lang string, source string, v string")
    rows = rows.withColumns({"family": R.family("v"), "hallmarks": R.hallmarks("v"), "cdr3": R.region("v", "cdr3")})
    found = {(r.condition, r.pos, r.aa): r for r in C.rules(rows).collect()}
    rule = found["cdr3[-1]=K", 71, "K"]
    assert (rule.support, rule.confidence, rule.lift) == (20, 1.0, 2.0)
    assert C.rules(rows.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("forest", [False, True])
def test_models_score_every_row(spark, forest):
    kinds = "K" * 40 + "R" * 30 + "D" * 5
    rows = spark.createDataFrame([(i, "x", "s", sequence(p71=a, p110="KDEAC"[i % 5], p117=a)) for i, a in enumerate(kinds)], "doc_id int, lang string, source string, v string")
    rows = rows.withColumns({"family": R.family("v"), "hallmarks": R.hallmarks("v"), "cdr3": R.region("v", "cdr3")})
    scored = L.predict(rows, 71, cap=20, forest=forest)
    found = scored.collect()
    assert sorted(r.doc_id for r in found) == list(range(75))
    assert all((r.p_own == 0 and not r.match) == (r.aa == "D") for r in found if r.aa == "D" or r.match)
    (total,) = L.accuracy(scored).collect()
    assert total.majority == pytest.approx(40 / 75) and total.accuracy == pytest.approx(sum(r.match for r in found) / 75)


def test_sources_read_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID, CDR3 ,family,family\n1,AAA,F,G\n2,NaN,Y,Z\n")
    (tmp_path / "b.csv").write_text("id,cdr3\n3,CCC\n")
    rows = S.read_annotated(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("id").collect()
    assert [(r.id, r.cdr3, r.family) for r in rows] == [("1", "AAA", "F"), ("2", "-", "Y"), ("3", "CCC", None)]
    (tmp_path / "c.csv").write_text("id,x\n1,2\n")
    with pytest.raises(ValueError):
        S.read_annotated(spark, [str(tmp_path / "c.csv")])
    (tmp_path / "d.fa").write_text(">one\nAC\nDE\n>two x\nff\n")
    assert sorted(map(tuple, S.read_fasta(spark, str(tmp_path / "d.fa")).collect())) == [("one", "ACDE"), ("two", "FF")]
    assert D.parameter_hash({"a": 1, "b": 2}) == D.parameter_hash({"b": 2, "a": 1})

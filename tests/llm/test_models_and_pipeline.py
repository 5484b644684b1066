from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlens.llm import mixing, ordinal, secrets
from tests.llm.fixtures import awkward, documents, prose

BAD = ["trash", "scum", "moron"]


def graded_texts(n):
    texts, grades = [], []
    for i in range(n):
        own = prose(i + 1, 60)
        kind = i % 3
        texts.append(own if kind == 2 else f"{own} {BAD[i % 2]} {own[:40]}" if kind == 1 else " ".join(w + "%%%" for w in own.split()) + " trash")
        grades.append(kind)
    return texts, grades


def test_ordinal_regression_on_held_out_texts(spark):
    texts, grades = graded_texts(900)
    docs = documents(spark, texts + awkward())
    ratings = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 4] + [(None, 1), (1, 2), (5000, 1)], "doc_id long, grade int")
    model = ordinal.fit(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    rows = {r.doc_id: r for r in ordinal.classify(docs.withColumn("kept", F.lit(1)), model).collect()}
    assert len(rows) == 900 + len(awkward())
    held = [i for i in range(900) if i % 4 == 0]
    right = [sum(t >= 0.5 for t in rows[i].tails) == grades[i] for i in held]
    assert np.mean(right) > 0.9
    for r in rows.values():
        assert r.tails[0] >= r.tails[1] and r.expected_grade == pytest.approx(sum(r.tails)) and r.kept == (r.tails[1] >= 0.5)
    untrained = ordinal.fit(docs, ratings.filter("grade > 7"), 3)
    assert all(r.kept and r.expected_grade == pytest.approx(1.0) for r in ordinal.classify(docs, untrained).collect())
    assert ordinal.classify(documents(spark, []), model).count() == 0


def test_slopes_match_finite_differences():
    rng = np.random.default_rng(0)
    for levels in (2, 3, 5):
        score, y, free = rng.normal(size=40), rng.integers(0, levels, 40), rng.normal(scale=0.5, size=levels - 1)
        _, by_score, by_free = ordinal.loss_and_slopes(score, y, free)
        for at, slopes in ((0, by_score), (1, by_free)):
            for k in range(len(slopes)):
                ends = []
                for step in (1e-5, -1e-5):
                    given = [score.copy(), free.copy()]
                    given[at][k] += step
                    ends.append(ordinal.loss_and_slopes(given[0], y, given[1])[0])
                assert slopes[k] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    ids = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(400)]
    score = np.array([x.min() for x in ids])
    model = ordinal.train(ids, np.digitize(score, [3, 8]), 3, 30)
    plain = np.array([model.weights[x].sum() for x in ids])
    assert np.corrcoef(plain, score)[0, 1] > 0.5 and (model.below(plain) > 0).all()


def test_ordinal_takes_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(1, "z" * 20_000), (2, None), (None, "a")], "doc_id long, text string").selectExpr("*", "'x' AS kept", "1 AS key", "2 AS grade", "3 AS own")
    ratings = spark.createDataFrame([(1, 2), (1, 0), (2, 1)], "doc_id long, grade int")
    rows = ordinal.classify(docs, ordinal.fit(docs, ratings, 3)).collect()
    assert len(rows) == 6 and all(r.own == 3 and r.key == 1 and isinstance(r.kept, bool) for r in rows)


def test_forest_rules_equal_the_forest(spark):
    rng = np.random.default_rng(4)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    texts = awkward()
    for i in range(120):
        own = prose(i + 1, 30)
        texts.append(f'{own} token = "{hexes(40)}" {own}' if i % 2 else f"{own} thenonustandingwhentherivers {rng.integers(10**15, 10**16)} a.quiet.long.lantern{i}@mail.example.com {own}")
    docs = documents(spark, texts).withColumn("secrets", F.lit("clash"))
    findings = secrets.labelled_findings(docs)
    rules = secrets.train(findings)
    rows = {r.doc_id: r for r in secrets.scan(docs, rules).collect()}
    n = len(awkward())
    assert all(len(rows[n + i].secrets) == i % 2 for i in range(120))
    assert secrets.MASK in rows[n + 1].redacted and rows[n + 1].secrets[0] not in rows[n + 1].redacted
    assert all(rows[i].redacted == texts[i] for i in range(n) if not rows[i].secrets) and rows[0].redacted is None
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(findings)
    forest = RandomForestClassifier(numTrees=secrets.TREES, maxDepth=secrets.DEPTH, seed=3, labelCol="label").fit(made)
    votes = F.expr(secrets.conditions(forest.toDebugString))
    both = forest.transform(made).withColumn("c", F.struct(*secrets.FEATURES)).select(votes.alias("v"), "prediction")
    assert all((r.v >= 0.5) == (r.prediction == 1.0) for r in both.collect() if abs(r.v - 0.5) > 0.11)
    assert all(not r.secrets for r in secrets.scan(docs, None).collect())
    assert secrets.train(secrets.labelled_findings(documents(spark, []))) is None


def test_every_run_of_a_word_is_a_candidate(spark):
    a, b = "0123456789abcdef0123", "fedcba98765432100123"
    texts = [f'{{"a":"{a}","b":"{b}"}}', f"https://host/some-long-path-name?token={a}", f"{a}.{b}.{a}", f"x {a} y", "short.words.only.here", None]
    docs = documents(spark, texts)
    assert [r.n_candidates for r in secrets.scan(docs, None).orderBy("doc_id").collect()] == [2, 2, 3, 1, 0, 0]
    found = secrets.with_candidates(docs, "text", "source").select(F.explode("__found").alias("c")).select("c.core").collect()
    assert {a, b, f"token={a}"} <= {r.core for r in found}
    every = "Tree 0:\n  Predict: 1.0"
    rows = {r.doc_id: r for r in secrets.scan(docs, every).collect()}
    assert rows[0].secrets == [a, b] and rows[0].redacted == '{"a":"[SECRET]","b":"[SECRET]"}'


def test_secrets_are_masked_by_place(spark):
    a, b = "0123456789abcdef0123456789abcdef01234567", "fedcba98765432100123456789abcdef01234567"
    texts = [f'{{"token":"{a}","secret":"{b}"}}', f'"{a}","{b}"', f'token = "{a}" and token = "{a}ffff0000" {a}', f"AWS_SECRET_ACCESS_KEY={a}", None, "", f"\ttoken: {a}\n  x  "]
    docs = documents(spark, texts).withColumn("secrets", F.lit(1)).withColumn("own", F.lit("kept"))
    rows = secrets.scan(docs, secrets.BY_LABEL).orderBy("doc_id").collect()
    assert [r.redacted for r in rows] == ['{"token":"[SECRET]","secret":"[SECRET]"}', texts[1], 'token = "[SECRET]" and token = "[SECRET]" [SECRET]', "[SECRET]", None, "", "\ttoken: [SECRET]\n  x  "]
    assert all(r.own == "kept" for r in rows)
    # the forest decides: it removes what the rule names
    assert all(not r.secrets for r in secrets.scan(docs, "Tree 0:\n  Predict: 0.0").collect())
    every = secrets.scan(docs, "Tree 0:\n  Predict: 1.0").orderBy("doc_id").collect()
    assert every[1].redacted == '"[SECRET]","[SECRET]"'


def test_features_and_candidates_against_brute_force(spark):
    import re

    texts = awkward() + [f'{prose(k, 12)} a.{"0f" * (8 + k)}/b="{"Ab3" * 7}"; x-{"long" * 5}={k} {prose(k, 3)}' for k in range(12)]
    docs = documents(spark, texts)
    parts = secrets.dictionary(docs)
    words = [w for t in texts for w in re.findall("[a-z]+", (t or "").lower()) if 4 <= len(w) <= 12]
    times = Counter(words)
    top = sorted(times, key=lambda w: (-times[w], w))[: secrets.DICTIONARY]
    assert parts == secrets.pattern_of(top)
    rows = secrets.with_candidates(docs, "text", "source", parts).select("doc_id", F.explode("__found").alias("c")).select("doc_id", "c.*").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        runs = re.findall(secrets.RUN, text or "")
        assert [r.core for r in by.get(i, [])] == runs
        for r, x in zip(by.get(i, []), runs):
            assert r.length == len(x) and r.digits == pytest.approx(sum(c.isdigit() for c in x) / len(x))
            assert r.transitions == sum(a.isalpha() and b.isdigit() or a.isdigit() and b.isalpha() for a, b in zip(x, x[1:]))
            assert r.variety == pytest.approx(len(set(x.lower())) / len(x))
            assert r.covered == pytest.approx((len(x) - len(re.sub(parts, "", x.lower()))) / len(x))


def test_forest_on_held_out_findings(spark):
    rng = np.random.default_rng(6)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    shapes = [lambda: (f'token = "{hexes(40)}"', 1), lambda: (f"db_password: {hexes(24)}", 1), lambda: (f'"api_key":"{hexes(32)}"', 1), lambda: (f"commit {hexes(40)} by", 0),
              lambda: ("thenonustandingwhentherivers", 0), lambda: (f"see https://host/some/long/path/of/pages{hexes(3)} there", 0)]
    made = [shapes[i % 6]() for i in range(600)]
    docs = documents(spark, [f"{prose(i, 8)} {x} {prose(i + 1, 8)}" for i, (x, _) in enumerate(made)])
    findings = secrets.labelled_findings(docs.filter("doc_id DIV 6 % 2 = 0"))
    votes = F.expr(secrets.conditions(secrets.train(findings)))
    held = secrets.with_candidates(docs.filter("doc_id DIV 6 % 2 = 1"), "text", "source").select("doc_id", F.explode("__found").alias("c"))
    rows = held.select("doc_id", (votes >= 0.5).alias("secret")).groupBy("doc_id").agg(F.max("secret").alias("secret")).collect()
    assert np.mean([r.secret == bool(made[r.doc_id][1]) for r in rows]) > 0.97


def test_labels_of_findings(spark):
    key = "0123456789abcdef0123"
    true = [f'api_key="{key}"', f"DB_PASSWORD={key}", f'access_token = "{key}"', f'"AWS_SECRET_ACCESS_KEY": "{key}"', f'{{"user":1,"secret_key":"{key}"}}', f"token: {key}", f"https://host/some-long-path-name?token={key}"]
    false = [f"commit {key}", f'author = "{key}"', f"/srv/some/long/path/{key}", f"see token of the session {key}"]
    for texts, label in ((true, 1.0), (false, 0.0)):
        for text in texts:
            rows = secrets.labelled_findings(documents(spark, [text])).filter(F.col("core").contains(key)).collect()
            assert [r.label for r in rows] == [label], text
    # one label only: it decides
    only = documents(spark, true[:3])
    rules = secrets.train(secrets.labelled_findings(only))
    assert all(len(r.secrets) == 1 and key not in r.redacted for r in secrets.scan(only, rules).collect())
    # a bound on one label leaves the other's findings
    many = documents(spark, [f"token = 'a{i:020d}'" for i in range(40)] + [f"plain b{i:020d}" for i in range(40)])
    counts = {r.label: r["count"] for r in secrets.labelled_findings(many, max_findings=10).groupBy("label").count().collect()}
    assert counts == {0.0: 10, 1.0: 10}


def test_mixing_meets_targets(spark):
    texts = awkward() + [prose(i, 40 + i) for i in range(120)] + [" ".join("zz" + w for w in prose(i, 30).split()) for i in range(60)]
    docs = documents(spark, texts).withColumn("rate", F.lit(1))
    n = len(awkward())
    labelled = spark.createDataFrame([(i, "a" if i < n + 120 else "b") for i in range(n, n + 180, 2)] + [(None, "a"), (n, "a")], "doc_id long, domain string")
    domains = mixing.learn(docs, labelled, ["a", "b", "never"])
    rows = mixing.mix(docs, domains, {"a": 0.7, "b": 0.3}).collect()
    assert len(rows) == len(texts) and all(r.rate >= 0 for r in rows)
    words, p, rate = np.array([r.n_words for r in rows]), np.array([r.posterior for r in rows]), np.array([r.rate for r in rows])
    assert p.sum(axis=1) == pytest.approx(1.0)
    got = (rate * words) @ p
    assert got[:2] / words.sum() == pytest.approx([0.7, 0.3], abs=1e-3)
    assert all(r.missed <= mixing.TOLERANCE for r in rows)
    copied = mixing.copies(mixing.mix(docs, domains, {"a": 0.7, "b": 0.3}))
    many = Counter(r.doc_id for r in copied.collect())
    assert all(many[r.doc_id] in (int(r.rate), int(r.rate) + 1) for r in rows)
    none = mixing.learn(docs, labelled.filter("domain = 'z'"), ["a", "b"])
    assert {tuple(r.posterior) for r in mixing.mix(docs, none, {"a": 1.0, "b": 1.0}).collect()} == {(0.5, 0.5)}
    assert mixing.mix(documents(spark, []), domains, {"a": 1.0}).count() == 0


def least_squares(n, p, target, passes):
    """Nonnegative least squares over the rates' totals, by projected gradient on all rates at once."""
    rate = np.ones(len(n))
    step = 1 / np.linalg.eigvalsh((p.T * n) @ p)[-1]
    for _ in range(passes):
        rate = np.maximum(0, rate - step * (p @ (rate * n @ p - target)))
    return rate * n @ p


@pytest.mark.parametrize("targets", [(0.5, 0.3, 0.2), (1.0, 0.0, 0.0), (0.05, 0.05, 0.9)])
def test_rates_against_nonnegative_least_squares(spark, targets):
    rng = np.random.default_rng(7)
    n, p = rng.integers(1, 200, 60).astype(float), rng.dirichlet([2, 2, 1], 60)
    scored = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p)], "__n double, __p array<double>")
    steps, missed = mixing.solve(scored, list(targets))
    target = np.array(targets) * n.sum()
    rates = np.array([r[0] for r in scored.select(mixing.rate(steps)).collect()])
    want = least_squares(n, p, target, 60)  # where no rates match, both still come closer slowly
    assert (rates >= 0).all() and missed == pytest.approx(np.abs(rates * n @ p - target).max() / n.sum(), abs=1e-9)
    mine, best = ((rates * n @ p - target) ** 2).sum(), ((want - target) ** 2).sum()
    assert mine <= best * 1.05 + (1e-5 * n.sum()) ** 2


def test_mixing_carries_other_columns(spark):
    docs = documents(spark, awkward()).selectExpr("*", "7 AS own", "'x' AS n_words", "2 AS copy")
    domains = mixing.Domains(["a", "b"], None)
    rows = mixing.mix(docs, domains, {"a": 1.0}).collect()
    assert len(rows) == len(awkward()) and all(r.own == 7 and r.copy == 2 and isinstance(r.n_words, int) for r in rows)


def edited(text, every):
    """One word in so many replaced."""
    words = text.split()
    return " ".join(f"edit{i}" if i % every == every // 2 else w for i, w in enumerate(words))


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)} - {""}


def brute_survivors(rows):
    """Smallest ids of the components of all pairs of similarity 0.8 or more."""
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    change = True
    while change:
        change = False
        for i, j in near:
            low = min(label[i], label[j])
            change |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    groups = {}
    for (i, t), k in zip(rows, label):
        groups.setdefault(k, []).append((i is None, i or 0, t or ""))
    return sorted(min(g)[1] for g in groups.values())


def test_near_copies_against_brute_force(spark, tmp_path, monkeypatch):
    from strandlens.llm import simhash

    base = [prose(700 + k, 150) for k in range(8)]
    rows = [(i, base[i % 8]) for i in range(16)] + [(100 + i, edited(base[i % 8], 45 + i)) for i in range(24)] + [(200 + i, edited(base[i % 8], 9)) for i in range(8)]
    rows += [(300 + i, prose(800 + i, 60)) for i in range(40)] + [(400, None), (401, ""), (402, "  "), (403, "one two"), (404, "one two"), (None, base[0]), (None, prose(901, 50))]
    rows += [(7, prose(950, 80)), (7, prose(951, 80))]  # one id, different texts
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS least", "2 AS __others").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = brute_survivors(rows)
    for members in (simhash.MAX_MEMBERS, 3):
        monkeypatch.setattr(simhash, "MAX_MEMBERS", members)
        found = simhash.drop_near_copies(docs).collect()
        assert sorted(r.doc_id or 0 for r in found) == want and all(r.fp == "x" and r.least == 1 for r in found)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert simhash.drop_near_copies(docs).count() == len(want)
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_spanning_forest_of_least_weight():
    from strandlens.llm import simhash

    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b, w = rng.integers(0, 12, 30), rng.integers(0, 12, 30), rng.integers(0, 6, 30)
        label, want = list(range(12)), []
        for k in sorted(range(30), key=lambda k: (w[k], k)):
            x, y = label[a[k]], label[b[k]]
            if x != y:
                want.append(k)
                label = [x if z == y else z for z in label]
        assert simhash.spanning(12, a, b, w).tolist() == sorted(want)


def test_pipeline_stages(spark, tmp_path):
    texts = [prose(300 + i, 120) for i in range(80)] + [t if len(t or "") < 5000 else "long" for t in awkward()] + [prose(303, 120), prose(303, 120) + " tail"]
    texts += [f'{prose(900 + i, 60)} token = "{i:08x}c0ffee12345678abcdef0123456789abcd" {prose(950 + i, 30)}' for i in range(12)]
    # the columns that operators add, and others, come back as they were
    clash = ["kept", "n_candidates", "llr_sum", "n_tokens", "__n", "ids", "rate", "posterior", "fp", "secrets", "copy", "own"]
    docs = documents(spark, texts).select("*", *[F.lit(f"was {c}").alias(c) for c in clash])
    docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(5).cast("long"), "text": F.lit(prose(777, 90))})).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 9 == 0)) for i in [*range(80), 94, 95]] + [(81, 0, 0), (85, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert all(r[c] == f"was {c}" for r in rows for c in clash)
        kept.append(Counter(r.doc_id for r in rows))
    assert set(range(80)) <= set(kept[0]) and 80 not in kept[0]
    assert kept[1][3] == 1 and 94 not in kept[1] and 95 not in kept[1] and kept[1][5] == 2 and kept[2] == kept[1]
    assert all("c0ffee" not in (r.text or "") for r in rows)
    out = corpus_pipeline.encoded(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == kept[3] and all(r.round_trip is True and r.input_ids == "was ids" for r in out)


def test_pipeline_runs_whole(spark, tmp_path):
    documents(spark, [prose(300 + i, 120) for i in range(30)] + [None, "", prose(301, 120)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= set(range(30)) and all(r.round_trip for r in rows)


def test_pipeline_takes_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def jaccard_roots(texts):
    """The smallest place reached over all pairs whose five-word shingle sets are 0.8 alike or more."""
    from strandlens.llm import simhash

    sets, root = [set(simhash.shingles((t or "").encode(), 5)) for t in texts], list(range(len(texts)))
    size = np.array([len(x) for x in sets])
    number = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    rows = np.zeros((len(sets), len(number)), np.float32)
    for i, x in enumerate(sets):
        rows[i, [number[g] for g in x]] = 1
    both = rows @ rows.T
    for i, j in zip(*np.nonzero(np.triu(both >= 0.8 * (size[:, None] + size - both), 1))):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("edits, rest, chunk", [(2, 600, 4096), (3, 600, 100), (4, 300, 4096)])
def test_near_copies_in_a_family_of_one_template(spark, monkeypatch, edits, rest, chunk):
    from strandlens.llm import simhash

    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(edits)
    word = lambda: "w" + str(rng.integers(1 << 40))
    template = [word() for _ in range(200)]

    def changed(words, k):
        words = list(words)
        for i in rng.choice(len(words), k, replace=False):
            words[i] = word()
        return words

    pages = [changed(template, 6) for _ in range(rest)]
    pages += [changed(pages[i], edits) for i in rng.choice(rest, 100, replace=False)]
    texts = [" ".join(p) for p in pages]
    left = sorted(r.doc_id for r in simhash.drop_near_copies(documents(spark, texts).repartition(4)).collect())
    assert left == sorted(set(jaccard_roots(texts)))
    assert len(left) < len(texts) - 60


def test_few_ratings_decide_by_the_thresholds(spark):
    from strandlens.llm import ordinal

    docs = documents(spark, [prose(i, 40) for i in range(30)])
    ratings = spark.createDataFrame([(i, 0 if i < 27 else 2) for i in range(30)], "doc_id long, grade int")
    model = ordinal.fit(docs, ratings, 3)
    assert model.rated and not model.weights.any()
    assert not any(r.kept for r in ordinal.classify(docs, model).collect())
    unrated = ordinal.fit(docs, ratings.limit(0), 3)
    assert not unrated.rated and all(r.kept for r in ordinal.classify(docs, unrated).collect())

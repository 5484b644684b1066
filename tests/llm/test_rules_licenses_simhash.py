import re

import numpy as np
import xxhash

from strandlens.llm import license_scan, quality_rules, simhash
from strandlens.llm.components import components
from tests.llm.fixtures import awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_rules_against_brute_force(spark):
    texts = awkward() + [prose(i, 200) for i in range(20, 40)] + ["### junk%%% " * 30 + prose(5, 100)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(14, 30)] + [(14, 1, 0), (None, 1, 0), (34, 0, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(words) < 2000 else None
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = rows[i]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or "")) and r.n_dup_lines == dup
        if covered is not None:
            assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    score = brute_ratios(texts, set(range(14, 30)))
    assert all(abs(rows[i].llr - score[i]) < 2e-6 for i in range(len(texts)))
    assert rows[34].llr < min(rows[i].llr for i in range(14, 30))


def brute_ratios(texts, trusted, buckets=quality_rules.BUCKETS):
    def grams(text):
        hashes = []
        for word in WORD.findall(text or ""):
            h = 0
            for byte in word.encode():
                h = (h * 1000003 + byte) % (2**31 - 1)
            hashes.append(h)
        return [h % buckets for h in hashes], [(a * 31337 + b * 17) % (2**31 - 1) % buckets for a, b in zip(hashes, hashes[1:])]

    both = [grams(t) for t in texts]
    logs = []
    for k in (0, 1):
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for i, g in enumerate(both):
            np.add.at(raw, g[k], 1)
            if i in trusted:
                np.add.at(target, g[k], 1)
        logs.append(np.log((target + quality_rules.SMOOTH) / (raw * target.sum() / raw.sum() + quality_rules.SMOOTH)))
    return [(logs[0][a].sum() + logs[1][b].sum()) / max(1, len(a) + len(b)) for a, b in both]


def test_quality_rules_empty_tables_and_clashing_columns(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.apply_rules(documents(spark, []), labels).count() == 0
    from pyspark.sql import functions as F

    docs = documents(spark, [prose(1, 50)]).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(7)).withColumn("trusted", F.lit(1))
    (row,) = quality_rules.apply_rules(docs, labels).collect()
    assert row.n_words == 50 and row.kept is True and row.llr == 0.0


def test_quality_rules_count_all_trusted(spark):
    docs = spark.range(20_200).selectExpr("id AS doc_id", "concat('w', id, ' v', id % 7) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    # where all are trusted, both multinomials are the same
    assert quality_rules.apply_rules(docs, labels).filter("llr <> 0").count() == 0


def test_word_hashes_in_runs_and_pieces(monkeypatch):
    from strandlens.llm import text as tx

    data = ("ab " * 50 + "x" * 1000 + " é漢 " + "yz" * 130 + " q").encode()
    whole = tx.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes()
    monkeypatch.setattr(tx, "PIECE", 64)
    monkeypatch.setattr(tx, "RUN_BYTES", 100)
    cut = tx.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes()
    assert all((a == b).all() for a, b in zip(whole, cut))


def brute_matches(words, templates, least):
    """For each template its longest substring that ends at each word, where the next word doesn't extend it."""
    out = []
    for k, t in enumerate(templates):
        grams = {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        best = [max((n for n in range(end + 1) if n == 0 or tuple(words[end - n : end]) in grams), default=0) for end in range(len(words) + 1)]
        out += [(k, e, best[e]) for e in range(1, len(words) + 1) if best[e] >= least and (e == len(words) or best[e + 1] <= best[e])]
    return sorted(out)


def test_automaton_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        templates = [rng.integers(0, 4, rng.integers(3, 20)).tolist() for _ in range(3)]
        words = rng.integers(0, 5, 60).tolist()
        automaton = license_scan.SuffixAutomaton(templates)
        found = automaton.matches(words, 2)
        assert sorted((k, e, n) for k, e, n, _ in found) == brute_matches(words, templates, 2)
        for k, e, n, s in found:
            assert automaton.ends[s][k] == {i for i in range(n, len(templates[k]) + 1) if templates[k][i - n : i] == words[e - n : e]}


def test_chains_against_brute_force():
    """Every way to chain a template's matches, on small random words."""
    rng = np.random.default_rng(9)
    for _ in range(40):
        own = ["".join(rng.choice(list("abcd"), 1)) for _ in range(14)]
        scanner = license_scan.Scanner([("x", own[0], " ".join(own))], {})
        words = [scanner.vocabulary.get(w.encode(), -1) for w in rng.choice(list("abcde"), 30)]
        runs, found = [], []
        for i, w in enumerate(words + [-1]):
            if w < 0:
                found += [(k, e + i - len(runs), n, s) for k, e, n, s in scanner.automaton.matches(runs, 3)] if runs else []
                runs = []
            else:
                runs.append(w)
        matches = [(e, n, at) for _, e, n, s in found for at in sorted(scanner.automaton.ends[s][0])]

        def best(i):
            end, n, at = matches[i]
            joined = [best(j) + min(n, end - matches[j][0], at - matches[j][2]) for j in range(i) if end - n - matches[j][0] <= license_scan.MAX_GAP and min(end - matches[j][0], at - matches[j][2]) > 0]
            return max([n, *joined])

        assert max((c for _, _, _, c, _ in scanner.chains(found)), default=0) == max((best(i) for i in range(len(matches))), default=0)


def test_license_notices():
    from strandlens.llm.templates import _cc, _gnu

    cases = {
        "licensed under the terms of the Apache license": "apache",
        "This project is licensed under the terms of the MIT license.": "mit",
        "This project is licensed under the terms of the Apache license.": "apache",
        _gnu("library", "Lesser General Public License", "2.1"): "lgpl",
        _gnu("program", "Affero General Public License", "3"): "agpl",
        _gnu("program", "General Public License", "3"): "gpl",
        "Licensed under the GNU General Public License, version 3.": "gpl-3",
        "Licensed under the GNU Lesser General Public License, version 3.": "lgpl",
        _cc("Attribution-NoDerivatives"): "cc-by-nd",
        _cc("Attribution-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        _cc("Attribution"): "cc-by",
        "This file is NOT licensed under the Apache License, Version 2.0": "",
        "This program is not licensed under the terms of the MIT license": "",
        "the license of the software is a matter of the terms": "",
    }
    scanner = license_scan.Scanner()
    for text, want in cases.items():
        assert ",".join(sorted({x[0] for x in scanner.scan([text.encode()])[0]["spans"]})) == want, text
    for label, _, text in license_scan.TEMPLATES:
        assert {x[0] for x in scanner.scan([b"and so on " + text.encode() + b" ends here"])[0]["spans"]} == {label}


def test_license_scan(spark):
    apache = license_scan.TEMPLATES[5][2]
    texts = [None, "", "Released UNDER the MIT-License. under the mit license", "x " + apache.replace("agreed to in writing", "agreed upon"),
             "cc by nc " * 3, prose(2, 300), "under the mit", "Licensed under the GNU General Public License, version 3."]
    docs = documents(spark, texts).selectExpr("*", "1 AS labels", "'x' AS score")
    rows = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (0, 0, None, "", 0.0)
    assert (rows[2].n_base, rows[2].first_word, rows[2].last_word, rows[2].base_labels) == (2, 1, 5, "mit")
    assert rows[3].base_labels == "apache-2" and rows[3].labels == "apache-2" and rows[3].spans[0].covered > 60
    assert rows[4].n_base == 3 and rows[4].base_labels == "cc-by-nc"
    assert rows[5].labels == "" and rows[6].n_base == 0 and rows[7].labels == "gpl-3" and 0 < rows[7].score <= 1
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    own = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, ids):
    label = list(range(len(fps)))
    change = True
    while change:
        change = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], change = label[j], True
    return [min(ids[j] for j in range(len(fps)) if label[j] == label[i]) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    base = prose(77, 500).split()
    near = []
    for k in range(60):
        words = list(base)
        for j in range(k % 6):
            words[(k * 37 + j * 101) % 500] = f"edit{k}{j}"
        near.append(" ".join(words))
    texts = awkward()[:9] + near + [prose(i, 60) for i in range(200, 260)] + awkward()[9:]
    rows = sorted(simhash.near_duplicate_groups(documents(spark, texts)).collect())
    fps = [brute_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in rows] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in rows] == brute_components(fps, list(range(len(texts))))
    assert simhash.near_duplicate_groups(documents(spark, [])).count() == 0


def test_links_of_hot_shards_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 5)
    fps = {0}
    for c in centre:
        for _ in range(120):
            x = int(c)
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for limit in (7, 10_000):
        found = {r.node: r.root for r in components(simhash.links(frame, max_members=limit)).collect()}
        label = dict(zip(signed, brute_components(fps, signed)))
        assert {x: found.get(x, x) for x in signed} == label


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {x: 100 for x in range(100, 140)}

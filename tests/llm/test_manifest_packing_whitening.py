import hashlib
import zlib

import numpy as np
import pytest

from strandlens.llm import merkle, packing, whitening
from tests.llm.fixtures import DOCS, awkward, documents, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(digests):
    """Levels from the lowest to the root."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def climb(levels, place, folded):
    siblings = []
    for level in levels[:-1]:
        run = level[place // 16 * 16 : place // 16 * 16 + 16]
        before, after = run[: place % 16], run[place % 16 + 1 :]
        siblings += before + after
        folded, place = h(*before, folded, *after), place // 16
    return folded, siblings


def brute_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the rows of op11."""
    told = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: h(told(r[0]), told(r[3]), told(r[2]), told(r[4]), told(text))
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by = {}
    for r in rows:
        due = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lower(r[1]) if due else r[1]), r[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = tree_of([trees[s][-1][0] for s in order])
    out = []
    for rank, s in enumerate(order):
        for place, x in enumerate(sorted(by[s], key=lambda x: x[:3])):
            folded, below = climb(trees[s], place, x[3])
            folded, above = climb(top, rank, folded)
            out.append((x[4], x[2], trees[s][-1][0], top[-1][0], h(*below, *above), folded, folded == top[-1][0]))
    return sorted(map(repr, out))


def found_manifest(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS leaf", "1 AS place", "2 AS parent", "3 AS tree", "4 AS slot").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(repr(tuple(r)) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect())


def test_manifest_against_brute_force(spark, tmp_path):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(awkward())]
    rows += [(100 + i, f"Text {i}", None if i % 7 == 0 else "de", f"s{i % 19}" if i % 3 else "hot", i) for i in range(700)]
    rows += [(5000 + i, "Alone", "en", f"alone{i}", None) for i in range(3)] + [(6000, "no source", "en", None, 3), (6005, "NO SOURCE", "en", None, 3)]
    rows += [(None, "No id", "en", "src0", 1), (100, "Text 0", None, "hot", 0), (100, "Text 0", None, "hot", 0), (103, "other", "en", "hot", 5), (7000, "É ß", "Ä", "é", 3)]
    want = brute_manifest(rows)
    assert found_manifest(spark, rows, tmp_path) == want
    assert any(x.endswith("False)") for x in want)


@pytest.mark.parametrize("n, bound", [(1, 0), (2, 1 << 16), (17, 0)])
def test_manifest_of_one_source(spark, tmp_path, monkeypatch, n, bound):
    monkeypatch.setattr(merkle, "BROADCAST_NODES", bound)
    rows = [(i, "Some Text", "en", "only", 1) for i in range(n)]
    assert found_manifest(spark, rows, tmp_path) == brute_manifest(rows)


def test_manifest_of_no_rows(spark, tmp_path):
    assert found_manifest(spark, [], tmp_path) == []


def test_proofs_are_siblings(spark):
    built = merkle.manifest(spark.createDataFrame([(i, "a", h(str(i))) for i in range(40)], "doc_id long, source string, leaf string"))
    rows = {r[0]: r for r in merkle.prove(built.leaves, built.nodes, carry=["doc_id"]).select("doc_id", "folded_root", "siblings").collect()}
    levels = tree_of([h(str(i)) for i in range(40)])
    for i, r in rows.items():
        assert (r[1], r[2]) == climb(levels, i, h(str(i)))
        assert r[1] == built.root
    built.forget()


# packing


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_model()).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library_s(monkeypatch):
    texts = [t or "" for t in awkward()] + ["It's don't WE'LL  <|endoftext|> a<|startoftext|>b", "Café café ﬁ İstanbul ΣΑΣ", "a b c　d \x1c e\x85f", "٣½ 12.5%...?!", " ́x á e ́"]
    for memo in (packing.MEMO, 20):
        monkeypatch.setattr(packing, "MEMO", memo)
        monkeypatch.setattr(packing, "PARTS", memo)
        encoder = packing.Encoder(packing.default_model())
        for part in (texts[:8], texts[8:], texts):
            ids, sizes = encoder.encode([t.encode() for t in part])
            at = 0
            for text, n in zip(part, sizes.tolist()):
                assert ids[at : at + n].tolist() == library_ids(text) + [packing.END]
                at += n


def test_plain_words_need_the_model_alone():
    encoder = packing.Encoder(packing.default_model())
    encoder.library = None
    for text in ("It's what We'LL do, Ça et là: naïve œuvre (12.5%)...?!", "it's ÉTÉ do#what### x_y 4a4 ĲSSEL"):
        assert encoder.encode([text.encode()])[0].tolist() == library_ids(text) + [packing.END]


def test_windows_cost_least():
    rng = np.random.default_rng(4)
    for _ in range(60):
        length = int(rng.choice([16, 20, 64]))
        place = np.concatenate([[0], np.cumsum(rng.integers(1, 9, int(rng.integers(1, 40))))])
        fee = rng.choice([0, packing.SENTENCE, packing.ANYWHERE], len(place))
        pad = lambda n: 0 if n.bit_count() == 1 else length - n
        best = [0]
        for j in range(1, len(place)):
            best.append(min(best[i] + pad(int(place[j] - place[i])) for i in range(j) if place[j] - place[i] <= length) + packing.START + fee[j])
        cuts = packing.windows(place, fee, length)
        own = sum(pad(b - a) + packing.START + fee[np.searchsorted(place, b)] for a, b in zip(cuts, cuts[1:]))
        assert own == best[-1] and cuts[0] == 0 and cuts[-1] == place[-1] and max(np.diff(cuts)) <= length


@pytest.mark.parametrize("block, most", [(500, 0.03), (packing.BLOCK, 0.02)])  # streams of a few sequences, and blocks of less than one, leave little to choose
def test_pieces_are_the_documents(spark, monkeypatch, block, most):
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing.tx, "STEP_BYTES", 4096)
    texts = awkward() + [prose(i, 30 + 13 * i).replace(" the ", ". the ") for i in range(60)] + ["no end " * 6000]
    frame = documents(spark, texts).union(documents(spark, [None, "again"])).selectExpr("*", "1 AS ids", "2 AS offset").repartition(3)
    found = packing.pack(frame).collect()
    sums = {(r.doc_id, r.start, r.sequence_id): r.ids_crc32 for r in packing.with_checksum(packing.pack(frame)).collect()}
    documents_of, sequences = {}, {}
    for r in found:
        assert len(r.ids) == r.length > 0
        assert sums[r.doc_id, r.start, r.sequence_id] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents_of.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    whole = lambda t: library_ids(t or "") + [packing.END]
    for i, text in enumerate(texts):
        pieces = sorted(documents_of.pop(i))
        if i < 2:  # these ids are there twice
            assert sum(len(x[1]) for x in pieces) == len(whole(text)) + len(whole([None, "again"][i]))
            continue
        assert [t for x in pieces for t in x[1]] == whole(text) and {x[2] for x in pieces} == {len(whole(text))}
        assert [x[0] for x in pieces] == np.cumsum([0, *(len(x[1]) for x in pieces)])[:-1].tolist()
    assert not documents_of
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    row = packing.padding(packing.pack(frame)).first()
    assert row.padding < most * row.tokens and row.sequences == len(sequences)


def test_packing_of_no_rows(spark):
    assert packing.with_checksum(packing.pack(documents(spark, []))).count() == 0


def test_the_last_sequence_is_cut_only_where_that_costs_less():
    assert packing.closed([0, 4096, 4096 + 1025]) == [0, 4096, 4096 + 1024, 4096 + 1025]
    assert packing.closed([0, 4095]) == [0, 4095] and packing.closed([0, 2048]) == [0, 2048] and packing.closed([0]) == [0]


# whitening


def check_whitening(found, rows, d, components=32):
    good = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    n, x = len(good), np.array([v for _, v in good], object)
    sums = x.sum(axis=0)
    y = (x - sums // n).astype(float) - (np.array([int(s) % n for s in sums]) / n)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    z = y @ vectors[:, :k] / np.sqrt(values[:k])
    exact = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for _, v in good]
    assert len(found) == n * k
    own = np.zeros((n, k))
    by_key = sorted(found, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation, r.component))
    order = sorted(range(n), key=lambda i: (good[i][0] is None, good[i][0] or 0, exact[i]))
    for r, (i, c) in zip(by_key, [(i, c) for i in order for c in range(k)]):
        assert (r.vec_id, r.n, r.deviation) == (good[i][0], n, exact[i])
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-8
        assert r.identity_error < 1e-9
    for r in found:
        if r.vec_id is not None and sum(g[0] == r.vec_id for g in good) == 1:
            own[[g[0] for g in good].index(r.vec_id), r.component - 1] = r.whitened
    for c in range(k):
        seen = own[:, c] != 0
        sign = np.sign(own[seen, c] @ z[seen, c])
        assert np.abs(own[seen, c] - sign * z[seen, c]).max() < 1e-7


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=40) * np.linspace(3, 0.2, 40) + rng.normal(scale=30)).tolist()) for i in range(500)]
    rows += [(500, None), (501, []), (502, [1.0] * 39 + [None]), (503, [float("nan")] * 40), (504, [float("inf")] + [0.0] * 39), (505, [1.0, 2.0]), (None, rows[3][1]), (7, rows[9][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).selectExpr("*", "1 AS x", "'y' AS deviation")
    check_whitening(whitening.components_of(frame).collect(), rows, 40)


def test_whitening_of_a_lower_rank(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-50, 50, size=(60, 4))
    rows = [(i, (np.concatenate([b, b, [7, 7]]) / 64).tolist()) for i, b in enumerate(base)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_whitening(whitening.components_of(frame).collect(), rows, 10)


def test_whitening_without_spread(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)]):
        assert whitening.components_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    for d in (1, 2, 5, 16, 33):
        x = rng.normal(size=(100, d)) * np.exp(rng.normal(size=d) * 2)
        v = x.T @ x / 100
        lower, order = whitening.pivoted_cholesky(v)
        assert np.allclose(lower @ lower.T, v[np.ix_(order, order)]) and np.allclose(np.triu(lower, 1), 0)
        values, vectors = whitening.principal(v)
        assert np.allclose(vectors * values @ vectors.T, v, rtol=1e-10) and np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert (np.diff(values) <= 0).all()


def test_deviations_are_exact_beyond_doubles():
    model = whitening.Whitening(10**6, np.array([10**12 + 7, 10**12 - 3]), np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[1_000_900, 999_100], [10**6, 10**6]])
    assert model.deviations(x).tolist() == [sum((10**6 * int(a) - int(s)) ** 2 for a, s in zip(r, model.sums)) for r in x]
    with pytest.raises(OverflowError):
        model.deviations(np.array([[10**7, 0]]))

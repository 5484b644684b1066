import duckdb
import numpy as np

from strandlens.llm import mtree


def brute(rows, k=5):
    """Each query row against every other row."""
    good = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(good) if m != n and len(c) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.2, size=16)).tolist()) for i in range(700)]
    rows += [(i, rows[100][1]) for i in range(700, 1000)]  # one vector fills a region
    rows += [(1000, None), (1001, []), (1050, [1.0, None]), (1100, [float("nan")] * 16), (1150, [float("inf")] + [0.0] * 15), (None, rows[0][1])]
    rows += [(1200, [1.0, 2.0]), (1201, [3.0, -1.0]), (1250, [0.5, 0.5]), (1300, [7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).selectExpr("*", "1 AS row", "'x' AS page")
    for page in (40, 4096):
        assert sorted(map(tuple, mtree.top_k(frame, page=page).collect())) == brute(rows)


def test_repeated_rows_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    best = max((r for r in rows if r[0] % 50), key=lambda r: np.dot(r[1], rows[50][1]))
    rows += [best] * 4 + [rows[0]] + [(100, rows[3][1])] + [(101, rows[7][1])] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(mtree.SQL).fetchall())
    assert [x[2] for x in want if x[0] == 50] == [best[0]] * 5
    for page in (20, 4096):
        assert sorted(map(tuple, mtree.top_k(frame, page=page).collect())) == want


def test_bounds_spare_products(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(scale=2000, size=(40, 8))
    rows = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(scale=20, size=(2000, 8)))
    monkeypatch.setattr(mtree, "LEAF", 64)
    root, seen = mtree.build(rows, np.arange(2000), np.arange(2000), rows[0]), []
    plain = mtree.products
    mtree.products = lambda q, x, d: seen.append(len(x)) or plain(q, x, d)
    try:
        found = mtree.best_first(root, rows[0], rows[7], 7, 5, -np.inf)
    finally:
        mtree.products = plain
    scores = sorted(((int(s), -i) for i, s in enumerate(rows @ rows[7]) if i != 7), reverse=True)[:5]
    assert sorted((x[:2] for x in found), reverse=True) == scores and sum(seen) < 1000


def test_rows_of_the_query_s_id_are_candidates(spark):
    rows = [(50, [4.0, 0.0])] * 2 + [(1, [2.0, 0.0])] * 2 + [(2, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, mtree.top_k(frame).collect()))
    assert found == brute(rows)
    assert [x[3] for x in found if x[1] == 1] == [4 * 4 * 256 * 256] * 2 and len(found) == 8


def test_page_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(50):
        rows, q, p = np.floor(rng.normal(scale=300, size=(200, 6))), np.floor(rng.normal(scale=300, size=(20, 6))), np.floor(rng.normal(scale=300, size=6))
        away = mtree.distances(rows, p)
        ring = np.argsort(away)[40:80]
        bound = mtree.page_bounds(q @ p, np.sqrt((q**2).sum(axis=1)), mtree.distances(q, p), away[ring].min(), away[ring].max(), np.sqrt((rows[ring] ** 2).sum(axis=1)).max())
        assert (bound + 1e-6 * np.abs(bound) >= (q @ rows[ring].T).max(axis=1)).all()


def test_no_rows(spark):
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

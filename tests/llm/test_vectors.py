import os
import time

import numpy as np

from duskframe.llm import vectors


def plain(rows):
    good = {i: np.asarray(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(good)
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return links, {i: find(i) for i in parent}


def _rows():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((30, 16))
    rows = [(i, (centers[i % 30] + rng.standard_normal(16) * 0.12 * (i // 30)).tolist()) for i in range(150)]
    rows += [(200, rows[3][1]), (201, [2 * x for x in rows[4][1]]), (202, None), (203, [0.0] * 16), (204, [float("nan")] + [1.0] * 15), (205, [None] + [1.0] * 15), (206, []), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [1e300] * 16)]
    return rows


def test_against_all_pairs(spark):
    rows = _rows()
    links, parts = plain(rows)
    out = vectors.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == len(rows)
    assert {r["vec_id"]: r["n_links"] for r in out} == links
    assert {r["vec_id"]: r["component_id"] for r in out} == parts


def test_long_lists_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 40)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.1).tolist()) for i in range(300)]
    links, parts = plain(rows)
    out = vectors.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in out} == links
    assert {r["component_id"] for r in out} == set(parts.values())


def test_a_task_holds_two_blocks_of_a_long_list(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vectors, "QUERIES", 40)
    match = vectors._match

    def counted(*args):
        run = match(*args)

        def count(table):
            held = np.unique(table["list"].to_numpy(), return_counts=True)[1].max()
            (tmp_path / f"{time.time_ns()}-{os.getpid()}").write_text(str(held))
            return run(table)

        return count

    monkeypatch.setattr(vectors, "_match", counted)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.1).tolist()) for i in range(300)]
    links, _ = plain(rows)
    out = vectors.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in out} == links
    held = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert len(held) > 36 and max(held) <= 140


def test_empty(spark):
    assert vectors.vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_odd_rows(spark, monkeypatch):
    """Null and repeated ids, columns of clashing names, one vector in many rows. Vectors of one id share its links."""
    monkeypatch.setattr(vectors, "QUERIES", 8)
    rows = [(None, [1.0, 2.0], "x"), (3, [1.0, 2.0], "y"), (3, [5.0, -1.0], "z")] + [(10 + i, [2.0, 4.1], "c") for i in range(50)]
    out = vectors.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies string")).collect()
    assert len(out) == len(rows)
    assert [tuple(r) for r in out if r["vec_id"] is None] == [(None, 0, None, None)]
    assert sorted(r["n_links"] for r in out if r["vec_id"] == 3) == [50, 50] and {r["component_id"] for r in out if r["vec_id"] != 3 and r["vec_id"]} == {3}
    assert all(r["n_links"] == 50 for r in out if (r["vec_id"] or 0) >= 10)


def test_the_window_cuts():
    assert vectors.window_share(10_000) < 0.62


def test_recall_is_calibrated():
    assert vectors.recall(10_000, 0.9) > 0.999 and vectors.recall(10_000_000, 0.9, pairs=1000) > 0.97
    assert vectors.recall(100_000, 0.0) < 0.005  # unrelated vectors


def test_dense_clouds(spark):
    """All vectors on the same lists: in one cloud few pairs are links, in the other all are."""
    rng = np.random.default_rng(8)
    rows, base = [], rng.standard_normal((2, 64))
    for k, (n, mean) in enumerate(((1200, 0.85), (600, 0.95))):
        away = rng.standard_normal((n, 64))
        cloud = np.sqrt(mean) * base[k] / np.linalg.norm(base[k]) + np.sqrt(1 - mean) * away / np.linalg.norm(away, axis=1, keepdims=True)
        rows += [(len(rows) + i, [float(c) for c in v]) for i, v in enumerate(cloud)]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r for r in vectors.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert links[1200:].min() == 599 and {got[i]["component_id"] for i in range(1200, 1800)} == {1200}

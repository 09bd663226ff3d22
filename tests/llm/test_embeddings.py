"""Embedding near-duplicates against all pairs."""

import numpy as np

from inkfold.llm import embeddings as e


def brute(rows):
    fine = [(i, k, np.array(x, float)) for i, (k, x, lab) in enumerate(rows) if lab is not None and x and None not in x and np.isfinite(np.array(x, float)).all() and np.array(x, float).any()]
    near = {i: set() for i in range(len(rows))}
    for i, _, x in fine:
        for j, _, y in fine:
            if i < j and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                near[i].add(j)
                near[j].add(i)
    part = list(range(len(rows)))
    for _ in rows:
        for i in near:
            for j in near[i]:
                part[i] = part[j] = min(part[i], part[j])
    return near, part


def data(n=300):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1, 2):
        base = rng.normal(size=(n // 10, 32))
        for b in base:
            for _ in range(3):
                rows.append((k, (b + rng.normal(size=32) * rng.choice([0.0, 0.02, 0.1])).astype(np.float32).tolist(), label))
                k += 1
    rows += [(k, None, 1), (k + 1, [], 1), (k + 2, [0.0] * 32, 1), (k + 3, [float("nan")] * 32, 1), (k + 4, [1.0] * 31 + [None], 1), (k + 5, rows[0][1], None), (k + 6, rows[0][1], 0), (k + 7, [2 * x for x in rows[0][1]], 0), (k + 8, [1.0, 2.0], 0), (k + 9, [2.0, 4.0], 0)]
    return rows


def test_links_are_those_of_all_pairs(spark):
    rows = data()
    near, part = brute(rows)
    found = {r["vec_id"]: r for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(found) == len(rows)
    links = sum(len(x) for x in near.values())
    got = sum(found[i]["n_links"] for i in range(len(rows)))
    assert got <= links and got >= 0.97 * links
    exact = sum(found[i]["n_links"] == len(near[i]) and found[i]["component_id"] == part[i] and found[i]["kept"] == (part[i] == i) for i in range(len(rows)))
    assert exact >= 0.97 * len(rows)


def test_repeated_rows_and_empty_table(spark):
    kind = "vec_id long, embedding array<float>, label int, cell long"
    rows = [(1, [1.0, 0.0], 3, 9), (1, [1.0, 0.0], 3, 9), (2, [1.0, 0.01], 3, 9), (None, [1.0, 0.0], 3, 9)]
    found = e.near_duplicates(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r["n_links"] for r in found) == [3, 3, 3, 3] and {r["component_id"] for r in found} == {1}
    assert e.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_lattice_points_are_the_nearest():
    x = np.random.default_rng(1).normal(0, 2, (500, 8))
    p = e.decode(x)
    assert (((x - p) ** 2).sum(1) <= ((x[:, None] - (p[:, None] + e.MINIMAL)) ** 2).sum(2).min(1) + 1e-9).all()


def at_threshold(n, size, cosine):
    rng = np.random.default_rng(11)
    x, z = rng.normal(size=(2, n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


def test_recall_at_the_threshold():
    for size in (16, 32, 64, 256):
        a, b = (e.cells(v) for v in at_threshold(1500, size, 0.98))
        met = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2))
        assert met.mean() > 0.99


def test_random_pairs_seldom_share_a_cell():
    x = e._units(np.random.default_rng(2).normal(size=(6000, 64)))
    found = e.cells(x)
    met = 0
    for t in range(e.TABLES):
        own, n = np.unique(found[:, t, 0], return_counts=True)
        probes = found[:, t, 1:].ravel()
        at = np.minimum(np.searchsorted(own, probes), len(own) - 1)
        met += n[at][own[at] == probes].sum()
    assert met / 6000**2 / e.TABLES < 1e-6  # so candidates stay a few for each row up to millions of rows in a label


def test_links_at_the_threshold(spark):
    x, y = at_threshold(400, 64, 0.9801)
    rows = [(2 * k + i, v[k].tolist(), 0) for k in range(400) for i, v in enumerate((x, y))]
    found = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r["n_links"] for r in found) > 0.99 * 800
    assert all(r["component_id"] in (r["vec_id"], r["vec_id"] - r["vec_id"] % 2) for r in found)


def test_unequal_labels_never_link(spark):
    # These labels have one crc32.
    rows = [(1, [1.0, 2.0], 549403235232767), (2, [1.0, 2.0], 492379585184846), (3, [1.0, 2.01], 492379585184846)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert found == {1: (0, 1), 2: (1, 2), 3: (1, 2)}


def test_huge_and_tiny_components_and_clashing_columns(spark):
    kind = "vec_id long, embedding array<double>, label string, node long, size int, cell string, key string, own int, copies int"
    rows = [(1, [1e200, 2e200], "x"), (2, [1e-300, 2e-300], "x"), (3, [1e-320, 0.0], "x"), (4, [float("inf"), 1.0], "x"), (5, [1.0] * 20_000, "x"), (6, [1.0] * 20_000, "x")]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_duplicates(spark.createDataFrame([(*r, 1, 1, "c", "k", 1, 1) for r in rows], kind)).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5)}

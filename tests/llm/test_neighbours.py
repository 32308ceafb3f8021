import numpy as np

from fernglass.llm.neighbours import hadamard, nearest_axes, turned, most_similar, rotations, search, similar_pairs

SCHEMA = "chunk_id string, domain string, vector array<float>, rank string, cosine int"


def frame(spark, rows):
    return spark.createDataFrame([(i, d, None if v is None else [float(x) for x in v], "x", 1) for i, d, v in rows], SCHEMA)


def brute(vectors, k):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    return {i: {ids[j] for j in np.argsort(-s[n], kind="stable")[:k]} for n, i in enumerate(ids)}


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(20, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    assert np.allclose(hadamard(np.eye(4, dtype=np.float32)) @ hadamard(np.eye(4, dtype=np.float32)), np.eye(4), atol=1e-6)
    signs = rotations(64, 1)[0]
    by_steps = np.concatenate([turned(x[:9], signs), turned(x[9:], signs)])
    assert np.allclose(turned(np.concatenate([x] * 4), signs)[:20], by_steps, atol=1e-4)
    own = nearest_axes(by_steps, 5)
    assert own.shape == (20, 5) and len(set(own[0] // 2)) == 5


def test_recall_and_tiles_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 64))
    vectors = {f"v{n:04d}": centres[n % 30] + rng.normal(size=64) for n in range(1500)}
    rows = [(i, " Notes" if n % 2 else "notes ", v) for n, (i, v) in enumerate(vectors.items())]
    want = brute({i: np.float32(v).astype(float) for i, v in vectors.items()}, 10)
    for shard in (131_072, 400):
        got = {}
        for r in most_similar(frame(spark, rows), shard=shard).collect():
            assert r["domain"] == "notes"
            got.setdefault(r["chunk_id"], set()).add(r["neighbour"])
        assert all(len(g) == 10 for g in got.values()) and len(got) == 1500
        assert sum(len(got[i] & want[i]) for i in want) / 15000 >= 0.95


def test_odd_vectors_small_domains_and_repeats(spark):
    one = np.eye(64)
    rows = [("a", "d", one[0]), ("a", "D ", one[0]), ("b", "d", one[0] * 3), ("c", "d", one[1]), ("z", "d", one[0] * 0), ("n", "d", [np.nan, *one[0][1:]]), ("i", "d", [np.inf, *one[0][1:]]), ("s", "d", one[0][:5]), ("0", "d", None), ("x", None, one[0]), (None, "d", one[0]), ("alone", "e", one[0])]
    got = most_similar(frame(spark, rows)).collect()
    assert sorted((r["chunk_id"], r["rank"], r["neighbour"]) for r in got) == [("a", 1, "b"), ("a", 2, "c"), ("b", 1, "a"), ("b", 2, "c"), ("c", 1, "a"), ("c", 2, "b")]
    assert [tuple(r) for r in similar_pairs(most_similar(frame(spark, rows))).collect()] == [("a", "b")]
    assert most_similar(frame(spark, rows).limit(0)).count() == 0


def test_rows_found_are_those_of_brute_force_at_any_number_of_rows():
    rng = np.random.default_rng(2)
    asked = rng.normal(size=(300, 64)).astype(np.float32)
    asked[:, 0] = np.abs(asked[:, 0]) + 8
    far = rng.normal(size=(17_000, 64)).astype(np.float32)
    far[:, 0] = -np.abs(far[:, 0]) - 8
    want = brute({f"{n:05d}": v.astype(float) for n, v in enumerate(asked)}, 10)
    for others in (0, 8000, 17_000):
        base = np.concatenate([asked, far[:others]])
        q, b = search(asked, base, np.arange(300), 10)
        assert {f"{n:05d}": {f"{r:05d}" for r in b[q == n]} for n in range(300)} == want, others


def test_neighbours_do_not_depend_on_shards_tables_or_probes(spark):
    rng = np.random.default_rng(3)
    vectors = {f"v{n:04d}": np.float32(rng.normal(size=64)).astype(float) for n in range(1500)}
    rows = frame(spark, [(i, "notes", v) for i, v in vectors.items()]).cache()
    want = brute(vectors, 10)
    for options in ({}, {"shard": 400}, {"tables": 1, "probes": 1}):
        got = most_similar(rows, **options).collect()
        found = {}
        for r in got:
            found.setdefault(r["chunk_id"], set()).add(r["neighbour"])
        assert len(got) == 15_000 and found == want, options


def test_equal_and_parallel_vectors_rank_by_id():
    rng = np.random.default_rng(4)
    rows = np.concatenate([np.repeat(rng.normal(size=(1, 64)), 3000, axis=0), rng.normal(size=(1, 64)) * 2.0 ** np.arange(-60, 60)[:, None]]).astype(np.float32)
    q, b = search(rows, rows, np.arange(3120), 3)
    lists = b.reshape(3120, 3)
    assert (q == np.repeat(np.arange(3120), 3)).all()
    assert [lists[n].tolist() for n in (0, 1, 2, 3, 2999)] == [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2], [0, 1, 2]]
    assert [lists[n].tolist() for n in (3000, 3001, 3119)] == [[3001, 3002, 3003], [3000, 3002, 3003], [3000, 3001, 3002]]

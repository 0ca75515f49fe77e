"""The graph on tables far larger than its parts and homes."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from holdfast.llm import neighbours


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found_of(df, step):
    got: dict = {}
    for r in neighbours.nearest(df, "vec_id", "embedding", F.col("id") % step == 0, k=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return got


def recall(x, got):
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s, kind="stable")[:20].tolist()))
    return hits / (20 * len(got))


def vectors_of(spark, x, tmp_path):
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": column}), f"{tmp_path}/x.parquet", row_group_size=5000)
    return spark.read.parquet(f"{tmp_path}/x.parquet")


def test_one_level_takes_the_nearest_pivot(spark, monkeypatch):
    """Also where a part's nodes meet copies of its pivots in several groups."""
    for name, value in (("PART", 50), ("CHUNK", 70), ("PARTITIONS", 1)):
        monkeypatch.setattr(neighbours, name, value)
    x = unit(np.random.default_rng(3).normal(size=(600, 8))).astype(np.float16)
    rows = [(0, "", i, v.tobytes()) for i, v in enumerate(x)]
    got = neighbours._split(spark.createDataFrame(rows, "z int, part string, id bigint, v binary"), 8, 42).collect()
    assert sorted(r["id"] for r in got) == list(range(600)) and all(r["v"] == x[r["id"]].tobytes() for r in got)
    cells: dict = {}
    for r in got:
        cells.setdefault(r["part"], []).append(r["id"])
    assert set(cells) == {f".{p}" for p in range(12)}
    # A cell's pivot is the member that all members are nearest to, among such members.
    y = x.astype(np.float32)
    hashed = spark.range(600).select("id", F.xxhash64("id", F.lit(0), F.lit(42)).alias("h")).collect()
    pivots = [r["id"] for r in sorted(hashed, key=lambda r: r["h"])][:12]
    assert all((y[ids] @ y[pivots].T).argmax(1).tolist() == [int(part[1:])] * len(ids) for part, ids in cells.items())


def test_parts_are_bounded_whatever_the_nodes(spark, monkeypatch):
    """Several levels; a dense heap of nodes that no pivot parts is cut by hash."""
    monkeypatch.setattr(neighbours, "PART", 16)
    monkeypatch.setattr(neighbours, "FAN", 4)
    rng = np.random.default_rng(4)
    x = unit(np.concatenate([rng.normal(size=(500, 4)), [1, 0, 0, 0] + 1e-4 * rng.normal(size=(300, 4))]))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    parts = neighbours.parted(nodes, 4, 42)
    sizes = parts.groupBy("z", "part").count().collect()
    assert sum(r["count"] for r in sizes) == 9 * 800
    # The hash cuts a heap into parts of 16 on average.
    assert max(r["count"] for r in sizes) <= 40 and len(sizes) > 9 * 50
    assert neighbours._levels(16) == 0 and neighbours._levels(17) == 1 and neighbours._levels(65) == 2


def test_what_meets_at_a_node():
    """Of two members, each is sent the other if that would enter its list and one of both is new."""
    x = unit(np.array([[1, 0.1], [1, 0.2], [0, 1], [1, 0.3]])).astype(np.float16)
    least = np.array([-np.inf, 0.999, -np.inf, -np.inf], np.float32)
    new = [True, False, False, False]
    batch = pa.record_batch({
        "part": ["a"] * 4, "m": pa.array([7] * 4), "u": pa.array([1, 2, 3, 4]), "new": new,
        "x": pa.array([v.tobytes() for v in x], pa.binary()), "least": pa.array(least),
    })
    v, w, s, fresh = neighbours.met(batch, 2)
    # 2 knows better than 1; 2, 3 and 4 have met before.
    assert sorted(zip(v.tolist(), w.tolist())) == [(1, 2), (1, 3), (1, 4), (3, 1), (4, 1)] and fresh.all()
    assert all(abs(t - x[a - 1].astype(float) @ x[b - 1].astype(float)) < 1e-3 for a, b, t in zip(v, w, s))


def test_old_entries_stay_old():
    v, w = np.array([1, 1, 1, 2]), np.array([5, 5, 6, 5])
    s, new = np.array([.5, .5, .9, .1], np.float32), np.array([True, False, True, True])
    assert [c.tolist() for c in neighbours.best_entries(v, w, s, new, 2)][:2] == [[1, 1, 2], [6, 5, 5]]
    assert neighbours.best_entries(v, w, s, new, 2)[3].tolist() == [True, False, True]


def test_pairs_are_merged_before_they_are_held(spark, monkeypatch):
    """The graph is the same if a task can hold few found pairs."""
    x = unit(np.random.default_rng(8).normal(size=(300, 6)))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    monkeypatch.setattr(neighbours, "PART", 32)
    parts = neighbours.parted(nodes, 6, 42)
    graph = neighbours.first_lists(parts.where("z between 1 and 2"), 6, 8)
    homes = parts.where("z = 0").drop("z")

    def once():
        rows = neighbours.descend(graph, homes, 6, 8).collect()
        return {(r["v"], w): n for r in rows for w, n in zip(r["w"], r["new"])}

    want = once()
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    got = once()
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.995 * len(want) and any(got.values())


def test_recall_with_default_constants(spark, tmp_path):
    """Parts, rounds and hops as on a cluster, on far more nodes than a part."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(400, 32))
    x = unit(centres[rng.integers(400, size=40_000)] + 0.6 * rng.normal(size=(40_000, 32)))
    got = found_of(vectors_of(spark, x, tmp_path), 200)
    assert len(got) == 200 and all(len(f) == 20 for f in got.values())
    assert recall(x, got) >= 0.95


@pytest.mark.parametrize("fan", [4, 64])
def test_recall_beyond_one_part(spark, monkeypatch, tmp_path, fan):
    monkeypatch.setattr(neighbours, "PART", 64)
    monkeypatch.setattr(neighbours, "FAN", fan)
    x = np.random.default_rng(6).normal(size=(6000, 24))
    got = found_of(vectors_of(spark, x, tmp_path), 60)
    assert len(got) == 100 and all(len(f) == 20 for f in got.values())
    assert recall(x, got) >= 0.9

"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Index. Equal vectors are one node (named by its smallest id), so a vector that a
third of the rows share can't shut its copies in among themselves. If lengths
differ, one more component lifts every vector to the same length, which makes
inner products comparable as nearness.

* First lists: several rough partitions of the nodes. A part is split by the nearest
  of its pivots, a sample of at most ``FAN`` of its own nodes, level by level until
  parts hold about ``PART`` nodes; what is larger after the last level is split by
  hash. Pivots meet their part's nodes in a shuffle, never on the driver. The best
  ``degree`` of each node's parts start its list.
* NN-descent: Spark joins bring the vectors of a node's ``NEAR`` nearest and
  ``REVERSED`` nearest reversed neighbours together at that node. They are compared
  there, unless both were there in an earlier round, and whatever would enter
  another's list is sent to it. Rows are at most ``NEAR + REVERSED`` a node, whatever
  the nodes' number. Rounds go on until no more than ``FEW`` of the edges are new.

Search. Each query keeps a beam of its best nodes. A hop joins the best of the
beam that are not yet expanded with the graph, and what they lead to with the
vectors, for all queries at once, until no more than ``FEW`` of the beams' entries
are unexpanded; a node is expanded once a query. A query starts at the nearest of
``ENTRY_POINTS`` nodes and, if its vector is in the index, at that node. What the
beam ends with is scored exactly, in double precision, on original vectors, and
nodes are expanded to the smallest of their ids.

The graph keeps vectors as half-precision numbers; they steer, they don't score.
The driver gets the ``ENTRY_POINTS`` vectors and counts. Rows as in
``finite_vectors``; zero vectors take no part either; a shorter vector counts as
padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.common import finite_vectors, matrix, padded, staged, whole_groups

PART = 4096
FAN = 64                # pivots that one part is split by at one level
CHUNK = 65_536          # nodes of one part that meet its pivots in one group
ENTRY_POINTS = 2048     # nodes that queries start from
PARTITIONS = 8
DEGREE = 32
NEAR, REVERSED = 20, 16
FEW = 0.02              # part of the edges, or of the beams' entries, that may be left to improve
SLIGHT = 1e-6           # of vectors of length 1 at most: a rise of a score that counts as none
PAIRS = 1 << 21         # found pairs that a task holds before it merges them
BEAM, EXPAND = 96, 32
ENTRIES = 4


def nodes_of(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """(id, x, node) of every row that takes part; (id, v) of every node; the width of v."""
    clean = finite_vectors(vectors, key, vector).where(F.exists("x", lambda v: v != 0))
    clean = staged(clean, "vectors")
    width, = clean.agg(F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    clean = clean.select("id", padded(width).alias("x"))
    classes = clean.groupBy(F.col("x").alias("y")).agg(F.min("id").alias("node"))
    square = F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v)
    most, = classes.agg(F.coalesce(F.max(square), F.lit(0.0))).first()
    lifted = F.concat("y", F.array(F.sqrt(F.greatest(F.lit(most) - square, F.lit(0.0)))))
    scaled = F.transform(lifted, lambda v: (v / F.lit(max(most, 1e-300) ** 0.5)).cast("float"))
    nodes = staged(classes.select("node", "y", scaled.alias("v")), "nodes")
    members = staged(clean.join(nodes.select("node", "y"), F.col("x") == F.col("y")).select("id", "x", "node"), "members")
    return members, nodes.select(F.col("node").alias("id"), "v"), width + 1


def halves(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, np.float16)
    return pa.array([row.tobytes() for row in m], pa.binary())


def singles(column, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float16).reshape(-1, width).astype(np.float32)


# --- first lists -----------------------------------------------------------

def parted(nodes: DataFrame, width: int, seed: int) -> DataFrame:
    """(z, part, id, v): each node's home (z = 0) and its part in each rough partition."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1), width, np.float32)
                yield pa.record_batch({"id": batch.column(0), "v": halves(v)})

    every = F.explode(F.sequence(F.lit(0), F.lit(PARTITIONS))).alias("z")
    rows = staged(nodes.mapInArrow(packed, "id bigint, v binary"), "parts").select(
        every, F.lit("").alias("part"), "id", "v")
    for _ in range(_levels(nodes.count())):
        rows = staged(_split(rows, width, seed), "parts")
    found = rows.groupBy("z", "part").agg(F.count(F.lit(1)).alias("n"))
    split = F.pmod(F.xxhash64("id", "z"), F.ceil(F.col("n") / PART))
    return rows.join(found, ["z", "part"]).select("z", F.concat_ws("-", "part", split).alias("part"), "id", "v")


def _levels(count: int) -> int:
    """Levels until parts of ``count`` nodes in all would hold ``PART`` of them."""
    levels, parts = 0, 1
    while parts * PART < count:
        levels, parts = levels + 1, parts * FAN
    return levels


def _split(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """Each part by the nearest of its pivots. Chunks of a part meet copies of them."""
    sizes = rows.groupBy("z", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("pivots", F.least(F.ceil(F.col("n") / PART), F.lit(FAN)))
    sizes = sizes.withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    order = Window.partitionBy("z", "part").orderBy(F.xxhash64("id", "z", F.lit(seed)), "id")
    first = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= FAN).join(sizes, ["z", "part"])
    first = first.where("at <= pivots").select(
        "z", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "at", "id", "v")
    nodes = rows.join(sizes, ["z", "part"]).select(
        "z", "part", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.lit(FAN + 1).alias("at"), "id", "v")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(3).to_numpy()
            names = list(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))))
            cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for start, end in zip([0, *cuts], [*cuts, len(names)]):
                if names[start] != group:
                    group, pivots = names[start], np.zeros((0, width), np.float32)
                v = singles(batch.column(5).slice(start, end - start), width)
                leads = at[start:end] <= FAN
                pivots = np.concatenate([pivots, v[leads]])
                if leads.all():
                    continue
                best = (v[~leads] @ pivots.T).argmax(1)
                kept = batch.slice(start, end - start).filter(pa.array(~leads))
                yield pa.record_batch({
                    "z": kept.column(0), "part": pa.array([f"{group[1]}.{b}" for b in best], pa.string()),
                    "id": kept.column(4), "v": kept.column(5),
                })

    keys = ["z", "part", "chunk"]
    return first.union(nodes).repartition(*keys).sortWithinPartitions(*keys, "at").mapInArrow(
        assign, "z int, part string, id bigint, v binary")


def entry_points(nodes: DataFrame, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of ``ENTRY_POINTS`` nodes, those of the smallest hashes."""
    first = nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(ENTRY_POINTS).select("id", "v").toArrow()
    table = matrix(first["v"], width, np.float32) if len(first) else np.zeros((0, width))
    return first["id"].to_numpy(), table.astype(np.float16).astype(np.float32)


def first_lists(parts: DataFrame, width: int, degree: int) -> DataFrame:
    """(v, w, s): the best ``degree`` nodes that share one of v's parts."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["z", "part"]):
            ids, m = group["id"].to_numpy(), singles(group["v"], width)
            k = min(degree, len(ids) - 1)
            if k < 1:
                continue
            for at in range(0, len(ids), 512):
                s = m[at:at + 512] @ m.T
                rows = np.arange(len(s))
                s[rows, at + rows] = -np.inf
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield pa.record_batch({
                    "v": pa.array(ids[at:at + 512], pa.int64()),
                    "w": lists(ids[top]), "s": lists(np.take_along_axis(s, top, 1)),
                })

    found = parts.repartition("z", "part").sortWithinPartitions("z", "part").mapInArrow(within, EDGES)
    return best_of(found.withColumn("new", F.lit(True)), degree)


EDGES = "v bigint, w array<bigint>, s array<float>"


def best_of(rows: DataFrame, most: int) -> DataFrame:
    """(v, w, s, new array<boolean>): of all lists of a node, the ``most`` best distinct
    entries. ``rows``: (v, w, s, new boolean); an entry is new if all lists with it are."""
    return rows.repartition("v").sortWithinPartitions("v").mapInArrow(_merge(most), EDGES + ", new array<boolean>")


def lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    kind = pa.int64() if m.dtype.kind == "i" else pa.float32()
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.reshape(-1), kind))


def _merge(degree: int):
    """Rows come sorted by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            v = batch.column(0).to_numpy()
            cut = int(np.searchsorted(v, v[-1]))
            if cut:
                yield merged(batch.slice(0, cut), degree)
            rest = batch.slice(cut)
        if rest is not None:
            yield merged(rest, degree)

    return run


def merged(batch: pa.RecordBatch, degree: int) -> pa.RecordBatch:
    sizes = pa.compute.list_value_length(batch.column(1)).to_numpy()
    v = np.repeat(batch.column(0).to_numpy(), sizes)
    new = np.repeat(batch.column(3).to_numpy(zero_copy_only=False).astype(bool), sizes)
    w, s = (batch.column(c).flatten().to_numpy() for c in (1, 2))
    return as_lists(*best_entries(v, w, s, new, degree))


def best_entries(v: np.ndarray, w: np.ndarray, s: np.ndarray, new: np.ndarray, degree: int) -> tuple:
    """Of the entries of each v, each w once, and of those the ``degree`` best, in order."""
    order = np.lexsort((new, w, v))
    v, w, s, new = v[order], w[order], s[order], new[order]
    fresh = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])[:len(v)]
    v, w, s, new = v[fresh], w[fresh], s[fresh], new[fresh]
    order = np.lexsort((w, -s, v))
    v, w, s, new = v[order], w[order], s[order], new[order]
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])[:len(v)])
    keep = np.arange(len(v)) - np.repeat(starts, np.diff([*starts, len(v)])) < degree
    return v[keep], w[keep], s[keep], new[keep]


def as_lists(v: np.ndarray, w: np.ndarray, s: np.ndarray, new: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries in order of v as a row for each v."""
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])[:len(v)])
    offsets = pa.array([*starts, len(v)], pa.int32())
    columns = {
        "v": pa.array(v[starts], pa.int64()),
        "w": pa.ListArray.from_arrays(offsets, pa.array(w, pa.int64())),
        "s": pa.ListArray.from_arrays(offsets, pa.array(s, pa.float32())),
    }
    if new is not None:
        columns["new"] = pa.ListArray.from_arrays(offsets, pa.array(new, pa.bool_()))
    return pa.record_batch(columns)


# --- NN-descent ------------------------------------------------------------

def reversed_lists(graph: DataFrame) -> DataFrame:
    """(b, r): the nearest of the nodes whose lists hold b, with the edge's flag."""
    edges = graph.select("v", F.explode(F.arrays_zip("w", "s", "new")).alias("e")).select("v", "e.w", "e.s", "e.new")
    order = Window.partitionBy("w").orderBy(F.desc("s"), "v")
    return edges.withColumn("at", F.row_number().over(order)).where(F.col("at") <= REVERSED).groupBy(
        F.col("w").alias("b")
    ).agg(F.collect_list(F.struct(F.col("v").alias("u"), "new")).alias("r"))


def descend(graph: DataFrame, homes: DataFrame, width: int, degree: int) -> DataFrame:
    """One round: the graph with what its nodes' neighbours found in each other.

    ``homes``: (part, id, v), a part and vector for each node. Nodes of one part are
    dealt with in one task, so that pairs that several of them find are merged there.
    """
    forth = F.slice(F.transform(F.arrays_zip("w", "new"), lambda e: F.struct(e["w"].alias("u"), e["new"])), 1, NEAR)
    back = F.filter("r", lambda e: ~F.array_contains(F.slice("w", 1, NEAR), e["u"]))
    around = graph.join(reversed_lists(graph), F.col("v") == F.col("b"), "left").select(
        F.col("v").alias("id"), F.when(F.col("r").isNull(), forth).otherwise(F.concat(forth, back)).alias("members"))
    # Members that were all there before have met.
    around = around.where(F.exists("members", lambda e: e["new"])).join(homes.select("part", "id"), "id")
    members = around.select("part", F.col("id").alias("m"), F.explode("members").alias("e")).select("part", "m", "e.u", "e.new")
    least = F.when(F.size("s") < degree, F.lit(float("-inf"))).otherwise(F.element_at("s", -1)).cast("float")
    vectors = homes.select(F.col("id").alias("u"), F.col("v").alias("x")).join(
        graph.select(F.col("v").alias("u"), least.alias("least")), "u")
    groups = members.join(vectors, "u").select("part", "m", "u", "new", "x", "least")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = [], 0
        for members in _whole_middles(batches):
            held.append(met(members, width))
            pairs += len(held[-1][0])
            if pairs > PAIRS:
                held = [best_entries(*map(np.concatenate, zip(*held)), degree)]
                pairs = len(held[0][0])
                if pairs > PAIRS // 2:
                    yield as_lists(*held[0][:3])
                    held, pairs = [], 0
        if pairs:
            yield as_lists(*best_entries(*map(np.concatenate, zip(*held)), degree)[:3])

    found = groups.repartition("part").sortWithinPartitions("part", "m").mapInArrow(meet, EDGES)
    return best_of(
        graph.select("v", "w", "s", F.lit(False).alias("new")).union(found.select("*", F.lit(True))), degree)


def _whole_middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by m, cut between values of m."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        m = batch.column(1).to_numpy()
        other = np.flatnonzero(m != m[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None:
        yield rest


def met(members: pa.RecordBatch, width: int) -> tuple:
    """(v, w, s, new) of all w that enter v's list, by the nodes at which they meet."""
    m, u = members.column(1).to_numpy(), members.column(2).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    sizes = np.diff([*starts, len(m)])
    shape = (len(starts), int(sizes.max()))
    row = np.repeat(np.arange(len(starts)), sizes)
    column = np.arange(len(m)) - np.repeat(starts, sizes)
    x = np.zeros((*shape, width), np.float32)
    x[row, column] = singles(members.column(4), width)
    new, least = np.zeros(shape, bool), np.full(shape, np.inf, np.float32)
    new[row, column] = members.column(3).to_numpy(zero_copy_only=False)
    least[row, column] = members.column(5).to_numpy()
    at = np.zeros(shape, np.int64)
    at[row, column] = np.arange(len(m))
    s = np.matmul(x, x.transpose(0, 2, 1))
    enters = (s > least[:, :, None] + SLIGHT) & (new[:, :, None] | new[:, None, :])
    enters &= (np.arange(shape[1]) < sizes[:, None])[:, None, :]
    enters[:, np.arange(shape[1]), np.arange(shape[1])] = False
    g, i, j = np.nonzero(enters)
    return u[at[g, i]], u[at[g, j]], s[g, i, j], np.ones(len(g), bool)


def neighbour_graph(nodes: DataFrame, width: int, degree: int = DEGREE, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(v, w, s, new) lists and (part, id, v) homes."""
    parts = staged(parted(nodes, width, seed), "parts")
    homes = parts.where("z = 0").drop("z")
    graph = staged(first_lists(parts.where("z > 0"), width, degree), "graph")
    while True:
        graph = staged(descend(graph, homes, width, degree), "graph")
        new, edges = graph.agg(
            F.coalesce(F.sum(F.size(F.filter("new", lambda e: e))), F.lit(0)), F.coalesce(F.sum(F.size("w")), F.lit(0))
        ).first()
        if new <= FEW * edges:
            return graph, homes


# --- search ----------------------------------------------------------------

STATE = "q bigint, x binary, b array<bigint>, s array<float>, done array<bigint>"


def greedy_search(graph: DataFrame, homes: DataFrame, queries: DataFrame, entries: tuple[np.ndarray, np.ndarray],
                  width: int, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(q, b): each query's beam of node ids after the last hop.

    ``queries``: (q, x, node): the lifted vector (halves; the component lifted is 0)
    and a node of the same vector to start at, or NULL.
    """
    back = reversed_lists(graph)
    around = staged(graph.join(back, F.col("v") == F.col("b"), "left").select(F.col("v").alias("n"), F.array_union(
        "w", F.coalesce(F.col("r")["u"], F.array().cast("array<bigint>"))).alias("around")), "around")
    names, table = entries

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = singles(batch.column(1), width)
            scores = x @ table.T
            top = np.argsort(-scores, axis=1, kind="stable")[:, :ENTRIES]
            b, s = [], []
            for row, own, score in zip(top, batch.column(2).to_pylist(), (x * x).sum(1)):
                found = {**dict(zip(names[row].tolist(), scores[len(b), row].tolist())), own: float(score)}
                found.pop(None, None)
                b.append(sorted(found, key=lambda n: (-found[n], n)))
                s.append([found[n] for n in b[-1]])
            yield pa.record_batch({
                "q": batch.column(0), "x": batch.column(1), "b": pa.array(b, pa.list_(pa.int64())),
                "s": pa.array(s, pa.list_(pa.float32())), "done": pa.array([[]] * len(b), pa.list_(pa.int64())),
            })

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", singles(batch.column(2), width), singles(batch.column(3), width))
                w = batch.column(1).to_numpy()
                yield pa.record_batch({"v": batch.column(0), "w": lists(w[:, None]), "s": lists(s[:, None])})

    state = staged(queries.select("q", "x", "node").mapInArrow(start, STATE), "beam")
    todo = F.array_except("b", "done")
    while True:
        unexpanded, held = state.agg(
            F.coalesce(F.sum(F.size(todo)), F.lit(0)), F.coalesce(F.sum(F.size("b")), F.lit(0))).first()
        if unexpanded <= FEW * held:
            return state.select("q", "b")
        open_ = state.withColumn("open", F.slice(todo, 1, expand))
        reach = open_.select("q", F.explode("open").alias("n")).join(around, "n").groupBy("q").agg(
            F.flatten(F.collect_list("around")).alias("reach"))
        fresh = F.array_except(F.coalesce("reach", F.array().cast("array<bigint>")), "b")
        hop = staged(open_.join(reach, "q", "left").select(
            "q", "x", "b", "s", F.array_union("done", "open").alias("done"), fresh.alias("fresh")), "hop")
        pairs = hop.select("q", "x", F.explode("fresh").alias("id")).join(homes.select("id", "v"), "id")
        scored = pairs.select("q", "id", "x", "v").mapInArrow(score, EDGES)
        beams = best_of(
            hop.select("q", "b", "s", F.lit(False).alias("new")).toDF("v", "w", "s", "new")
            .union(scored.select("*", F.lit(True))), beam)
        state = staged(beams.select(F.col("v").alias("q"), F.col("w").alias("b"), "s").join(
            hop.select("q", "x", "done"), "q").select("q", "x", "b", "s", "done"), "beam")


def nearest(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, without itself.

    ``is_query`` is a condition on the column ``id`` of the given rows.
    """
    members, nodes, width = nodes_of(vectors, key, vector)
    graph, homes = neighbour_graph(nodes, width)
    queries = members.where(is_query)
    lifted = homes.select(F.col("id").alias("node"), F.col("v").alias("x"))
    asked = queries.select(F.col("id").alias("q"), "node").join(lifted, "node")
    asked = asked.mapInArrow(_unlifted(width), "q bigint, x binary, node bigint")
    beams = greedy_search(graph, homes, asked, entry_points(nodes, width, 42), width)
    found = beams.select("q", F.explode(F.slice("b", 1, 3 * k)).alias("node"))
    found = found.union(queries.select(F.col("id"), "node")).distinct()
    # Of a node's ids, the k + 1 smallest are all that a query can return.
    names = members.select("node", "id", F.row_number().over(Window.partitionBy("node").orderBy("id")).alias("at"))
    names = names.where(F.col("at") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    scored = (
        found.join(members.select(F.col("id").alias("node"), F.col("x").alias("y")), "node")
        .join(queries.select(F.col("id").alias("q"), "x"), "q")
        .select("q", "node", product.alias("score"))
    )
    # Nodes behind k ids and the query's own can't give any more, so a query's
    # rows stay a few times k where vectors have many copies.
    nearer = Window.partitionBy("q").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("q", "score")
    ahead = F.sum(F.size("ids")).over(nearer) - F.sum(F.size("ids")).over(level)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        scored.join(names, "node").withColumn("ahead", ahead).where(F.col("ahead") <= k)
        .select(F.col("q").alias("query_id"), F.explode("ids").alias("vec_id"), "score")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _unlifted(width: int):
    """Queries with the lifted component at 0, so that products are those of the originals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            if not batch.num_rows:
                continue
            x = singles(columns["x"], width)
            x[:, -1] = 0
            yield pa.record_batch({"q": columns["q"], "x": halves(x), "node": columns["node"]})

    return run

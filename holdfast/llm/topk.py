"""Exact top-k inner products: norm-sorted, SVD-rotated, bounded by Cauchy-Schwarz.

Components are scaled and floored to whole numbers, so scores are exact.

* The rotation is the right singular basis, from one distributed d x d Gram
  matrix, so that the first few coordinates carry most of every product.
* Queries form groups of about ``QUERIES``; candidates are dealt into lanes by
  their id's hash. A cell (query group, lane) streams its candidates by
  descending length, a batch at a time, next to the group's running top k.
* A lane stops once the length of what is left times a query's length can't
  reach any query's k-th score. Before that, the product over the leading
  coordinates plus the product of the remaining lengths bounds a pair from above;
  only pairs whose bound reaches the k-th score get their whole product.
* Each cell sends k rows for each query; the best of them is a top-k window.

No task holds more than one query group and one batch of candidates. Lanes do
not depend on lengths or values, so equal vectors spread evenly.

Rows as in ``finite_vectors``; a shorter vector counts as padded with zeros.
Ties go to the smaller id. A query with fewer candidates returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.llm.common import finite_vectors, matrix, padded, staged, whole_groups

QUERIES = 1024
MOST_WIDTH = 4096
LEADING = 0.8  # the part of the squared length that the leading coordinates carry
EXACT = float(2 ** 53)
SLACK = 1e-9


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x)


def rotation(vectors: DataFrame, width: int, scale: int) -> tuple[np.ndarray, int]:
    """Right singular vectors of the scaled corpus, largest first, and how many lead."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = whole(matrix(batch.column(0), width), scale)
            total += m.T @ m
        yield pa.record_batch({"i": pa.array(range(width), pa.int32()), "row": pa.array(list(total))})

    rows = (
        vectors.select("x").mapInArrow(grams, "i int, row array<double>")
        .groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"g{j}") for j in range(width)])
        if width <= 128 else
        vectors.select("x").mapInArrow(grams, "i int, row array<double>")
        .select("i", F.posexplode("row").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g"))
        .groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "g")))["g"].alias("row"))
    )
    gram = np.zeros((width, width))
    for row in rows.collect():  # width x width numbers
        gram[row["i"]] = row["row"] if width > 128 else row[1:]
    values, basis = np.linalg.eigh(np.nan_to_num(gram))
    values, basis = np.maximum(values[::-1], 0), np.ascontiguousarray(basis[:, ::-1])
    if not values.sum():
        return basis, width
    lead = int(np.searchsorted(np.cumsum(values) / values.sum(), LEADING)) + 1
    return basis, min(lead, width)


def exact_top_k(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int = 10,
                scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest products.

    ``is_query`` is a condition on the column ``id``. A query's own id is no
    candidate of it.
    """
    clean = staged(finite_vectors(vectors, key, vector), "vectors")
    width, = clean.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    width = max(width, 1)
    if width > MOST_WIDTH:
        raise ValueError(f"vectors have {width} components; at most {MOST_WIDTH}")
    clean = clean.select("id", padded(width).alias("x"))
    basis, lead = rotation(clean, width, scale)

    queries = clean.where(is_query)
    groups = max(1, -(-queries.count() // QUERIES))
    partitions = int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, -(-partitions // groups))
    hashed = F.xxhash64("id")
    asked = queries.select(
        F.pmod(hashed, F.lit(groups)).cast("int").alias("grp"),
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.lit(0).alias("kind"), F.lit(0.0).alias("length"), "id", "x",
    )
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    offered = clean.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
        F.pmod(hashed, F.lit(lanes)).cast("int").alias("lane"),
        F.lit(1).alias("kind"), length.alias("length"), "id", "x",
    )
    cells = asked.union(offered).repartition("grp", "lane").sortWithinPartitions(
        "grp", "lane", "kind", F.desc("length"), "id"
    )
    best = cells.mapInArrow(_cells(width, k, scale, basis, lead), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _cells(width: int, k: int, scale: int, basis: np.ndarray, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, current = None, None
        for batch in batches:
            for part in whole_groups(iter([batch]), ["grp", "lane"]):
                name = (part["grp"][0].as_py(), part["lane"][0].as_py())
                if name != current:
                    if cell is not None:
                        yield from cell.rows()
                    cell, current = Cell(width, k, basis, lead), name
                ids = part["id"].to_numpy()
                x = whole(matrix(part["x"], width), scale)
                cut = int(np.searchsorted(part["kind"].to_numpy(), 1))
                cell.ask(ids[:cut], x[:cut])
                cell.offer(ids[cut:], x[cut:])
        if cell is not None:
            yield from cell.rows()

    return run


class Cell:
    """The running top k of a query group over a stream of candidates."""

    def __init__(self, width: int, k: int, basis: np.ndarray, lead: int):
        self.k, self.basis, self.lead = k, basis, lead
        self.ids, self.x = np.zeros(0, np.int64), np.zeros((0, width))
        self.best: list[tuple[np.ndarray, np.ndarray]] = []
        self.least = np.zeros(0)  # each query's k-th score so far

    def ask(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids):
            return
        self.ids, self.x = np.concatenate([self.ids, ids]), np.concatenate([self.x, x])
        self.turned = self.x @ self.basis
        self.length = np.sqrt((self.x ** 2).sum(1))
        self.tail = np.sqrt((self.turned[:, self.lead:] ** 2).sum(1))
        self.best += [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        self.least = np.concatenate([self.least, np.full(len(ids), -np.inf)])

    def offer(self, ids: np.ndarray, x: np.ndarray, step: int = 1024) -> None:
        for at in range(0, len(ids) if len(self.ids) else 0, step):
            self._offer(ids[at:at + step], x[at:at + step])

    def _offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        lengths = np.sqrt((x ** 2).sum(1))
        longest = lengths.max()
        slack = SLACK * self.length * longest
        # Lengths were sorted before flooring, so each step's own maximum bounds it.
        open_ = np.flatnonzero(self.length * longest + slack >= self.least)
        if not len(open_):
            return
        turned = x @ self.basis
        tail = np.sqrt((turned[:, self.lead:] ** 2).sum(1))
        bound = self.turned[open_, :self.lead] @ turned[:, :self.lead].T + np.outer(self.tail[open_], tail)
        q, c = np.nonzero(bound + slack[open_, None] >= self.least[open_, None])
        if not len(q):
            return
        q = open_[q]
        if self.length.max() * longest < EXACT:
            if len(q) * 4 < len(open_) * len(ids):
                score = np.concatenate([
                    np.einsum("ij,ij->i", self.x[q[s:s + 65_536]], x[c[s:s + 65_536]])
                    for s in range(0, len(q), 65_536)
                ])
            else:
                score = (self.x @ x.T)[q, c]
        else:  # beyond the whole numbers that doubles hold
            score = np.array([
                sum(int(a) * int(b) for a, b in zip(self.x[i], x[j])) for i, j in zip(q, c)
            ], dtype=object)
        ok = (score >= self.least[q]) & (ids[c] != self.ids[q])
        q, c, score = q[ok], c[ok], score[ok]
        cuts = np.flatnonzero(np.diff(q)) + 1
        for rows in np.split(np.arange(len(q)), cuts) if len(q) else ():
            i = q[rows[0]]
            scores = np.concatenate([self.best[i][0], score[rows]])
            names = np.concatenate([self.best[i][1], ids[c[rows]]])
            keep = np.lexsort((names, -scores))[:self.k]
            self.best[i] = scores[keep], names[keep]
            if len(keep) == self.k:
                self.least[i] = scores[keep[-1]]

    def rows(self) -> Iterator[pa.RecordBatch]:
        sizes = [len(s) for s, _ in self.best]
        if sum(sizes):
            yield pa.record_batch({
                "query_id": pa.array(np.repeat(self.ids, sizes), pa.int64()),
                "vec_id": pa.array(np.concatenate([n for _, n in self.best]), pa.int64()),
                "score": pa.array([int(v) for s, _ in self.best for v in s], pa.int64()),
            })

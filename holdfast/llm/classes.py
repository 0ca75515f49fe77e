"""Language-model scores from Brown's class-based bigrams.

Every training word belongs to one class. Exchange clustering starts from the most
frequent words as classes of their own and all other words in one more. In a round
every word is held against the round's class-transition counts: its own counts are
taken out of its class, and it goes where the likelihood of the training text gains
most (ties: the class with the smallest number). All words of a round move at once:
first, for some rounds, those seen often enough, then once all words there are. The
model then is P(word | before) = P(class | class before) P(word | class): transitions
smoothed towards the classes' shares (Witten-Bell), emissions discounted, and what a
class's discounts leave is its chance of an unknown word. Over the known words and
one unknown word the probabilities add up to 1 after every class.

Texts become chunks once: a task's words and its token ids, in a table bucketed by
chunk. One exchange of each chunk's words tells every chunk the words' training counts
and one number for each, the place where the word is met first. In a round a chunk
sends one row for each word that may move, with its neighbours by class, to the word's
place; the word's new class goes back the same way. Only class-by-class counts reach
the driver.

Rows: every input row gives one output row. A NULL text counts as empty: one token,
the end. NULL and repeated keys are rows like others. Without training rows every
token is unknown, with chance 1. Extra columns are not looked at. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from holdfast.llm.common import pack, quoted, slices, staged, unpack
from holdfast.session import scratch_path

CHUNK_BYTES = 16_000_000
CELLS = 1_000_000
END, MOST_CLASSES = 0, 128
# A word's place: partition, chunk of it, word of that.
CHUNK_BITS, LOCAL_BITS = 16, 26


@dataclass(frozen=True)
class Clustering:
    """``classes``: the end's own class and those of the words, 128 at most (a
    neighbour's side and class fit one byte). ``rounds`` of exchanges among the words
    with ``least`` training occurrences come before the one of all words."""

    classes: int = 64
    rounds: int = 2
    least: int = 16

    def __post_init__(self):
        if not 3 <= self.classes <= MOST_CLASSES:
            raise ValueError(f"classes must be 3 to {MOST_CLASSES}")


# --- chunks ------------------------------------------------------------------

def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; the six ASCII blanks part them."""
    return text.lower().split()


def chunked(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """One row for each chunk: its documents' keys, which of them are held out, its
    words, their counts in training documents, and all token ids (0: an end)."""
    slim = docs.select(
        quoted(key).alias("key"), F.coalesce(~train, F.lit(True)).alias("held"),
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"),
    )
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(slim.schema["key"].dataType)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("n", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << CHUNK_BITS)
        vocabulary, ids, keys, held, size = None, [], [], [], 0

        def row() -> pa.RecordBatch:
            words = list(vocabulary)
            flags = np.concatenate(held)
            all_ids = np.concatenate(ids)
            trained = all_ids[np.repeat(~flags, [len(i) for i in ids])]
            n = np.bincount(trained, minlength=len(words) + 1)[1:]

            def one(values) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            return pa.RecordBatch.from_arrays([
                pa.array([next(numbers)], pa.int64()), one(pa.concat_arrays(keys)), one(pa.array(flags)),
                one(pa.array(words, pa.binary()).cast(pa.string())), one(pa.array(n, pa.int64())),
                pa.array([pack(all_ids)], pa.binary()),
            ], names=schema.names)

        for batch in slices(batches, "text", CHUNK_BYTES):
            if vocabulary is None:
                vocabulary = defaultdict(count(1).__next__)
            for data in batch.column("text").cast(pa.binary()).to_pylist():
                found = tokens(data)
                row_ids = np.zeros(len(found) + 1, np.uint32)
                row_ids[:-1] = np.fromiter(map(vocabulary.__getitem__, found), np.uint32, len(found))
                ids.append(row_ids)
                size += len(data)
            keys.append(batch.column("key"))
            held.append(batch.column("held").to_numpy(zero_copy_only=False).astype(bool))
            if size >= CHUNK_BYTES:
                yield row()
                vocabulary, ids, keys, held, size = None, [], [], [], 0
        if ids:
            yield row()

    return slim.mapInArrow(run, schema)


class Corpus:
    """The chunks, and what they know of their words, as tables bucketed by chunk:
    joins on it move the other side only."""

    def __init__(self, docs: DataFrame, key: str, text: str, train: Column):
        made = chunked(docs, key, text, train)
        self.spark, self.names = docs.sparkSession, {}
        # A partition gives a chunk or a few.
        self.buckets = max(made.rdd.getNumPartitions(), 1)
        self._keep(made, "chunks")
        self._keep(self._named(), "named")

    def _keep(self, rows: DataFrame, kind: str) -> None:
        path = scratch_path(self.spark, kind)
        self.names[kind] = path.rsplit("/", 1)[1].replace("-", "_")
        rows.write.bucketBy(self.buckets, "chunk").option("path", path).saveAsTable(self.names[kind])

    def rows(self, *columns: str) -> DataFrame:
        return self.spark.table(self.names["chunks"]).select("chunk", *columns)

    def named(self, *columns: str) -> DataFrame:
        return self.spark.table(self.names["named"]).select("chunk", *columns)

    def _named(self) -> DataFrame:
        """(chunk, numbers, counts): by local id a word's number and its count in all training documents."""
        words = self.rows("words", "n").select(
            "chunk", F.posexplode(F.arrays_zip("words", "n")).alias("local", "w")
        ).select("w.words", "w.n", (F.shiftleft("chunk", LOCAL_BITS) + F.col("local") + 1).alias("at"))
        # A word has one row for each chunk that holds it.
        same = Window.partitionBy("words")
        told = words.select("at", F.min("at").over(same).alias("number"), F.sum("n").over(same).alias("total"))
        return _gathered(told, self.buckets, {"number": "<i8", "total": "<i8"}, ["numbers", "counts"])

    def drop(self) -> None:
        """The tables' entries; their files are scratch."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _gathered(rows: DataFrame, buckets: int, kinds: dict[str, str], into: Sequence[str]) -> DataFrame:
    """(chunk, locals, ...): the rows' values by chunk, as packed arrays in the order of local ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            local = table.column("at").to_numpy() & ((1 << LOCAL_BITS) - 1)
            packed = [local.astype("<u4"), *(table.column(c).to_numpy().astype(k) for c, k in kinds.items())]
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in packed)],
                names=["chunk", "locals", *into],
            )

        for batch in batches:
            chunk = batch.column("at").to_numpy() >> LOCAL_BITS
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and chunk[lo] != current:
                    yield done()
                    held = []
                current = int(chunk[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()

    dealt = rows.repartition(buckets, F.shiftright("at", LOCAL_BITS)).sortWithinPartitions("at")
    return dealt.mapInArrow(run, ", ".join(["chunk bigint", "locals binary", *(f"{c} binary" for c in into)]))


# --- classes of a chunk's words ----------------------------------------------

def _train_tokens(ids: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Flags of the tokens that belong to training documents."""
    ends = np.flatnonzero(ids == 0)
    return np.repeat(~held, np.diff(ends, prepend=-1))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time; lists as Arrow arrays, packed numbers of words as numpy arrays."""
    packed = {"numbers": "<i8", "counts": "<i8", "classes": np.uint8, "locals": "<u4", "moved": np.uint8}
    for batch in batches:
        for r in range(batch.num_rows):
            row = {}
            for c, name in enumerate(batch.schema.names):
                cell = batch.column(c)[r]
                if name in packed:
                    row[name] = np.frombuffer(cell.as_py(), packed[name]) if cell.is_valid else None
                else:
                    row[name] = cell.values if isinstance(cell, pa.ListScalar) else cell.as_py()
            yield row


def _first_classes(corpus: Corpus, classes: int) -> DataFrame:
    """(chunk, classes): the most frequent words in classes of their own, the others in the last."""
    words = corpus.rows("words").join(corpus.named("numbers", "counts").hint("shuffle_hash"), "chunk")

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A chunk knows the whole count of each of its words.
        for row in _rows(batches):
            n = row["counts"]
            least = np.partition(n, -classes)[-classes] if len(n) > classes else 0
            some = np.flatnonzero((n >= least) & (n > 0))
            yield pa.record_batch({
                "word": row["words"].take(pa.array(some)), "number": pa.array(row["numbers"][some]), "n": pa.array(n[some]),
            })

    often = words.mapInArrow(top, "word string, number bigint, n bigint").distinct()
    seeds = [r["number"] for r in often.orderBy(F.col("n").desc(), "word").limit(classes - 2).collect()]
    order = np.argsort(np.array(seeds, np.int64))
    known = np.array(seeds, np.int64)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            out = np.full(len(row["numbers"]) + 1, classes - 1, np.uint8)
            if len(known):
                at = np.minimum(np.searchsorted(known, row["numbers"]), len(known) - 1)
                out[1:] = np.where(known[at] == row["numbers"], order[at] + 1, classes - 1)
            out[0] = END
            yield pa.record_batch({"chunk": pa.array([row["chunk"]], pa.int64()), "classes": pa.array([out.tobytes()], pa.binary())})

    # A chunk of empty texts has no words, and no row of counts.
    named = corpus.rows().join(corpus.named("numbers").hint("shuffle_hash"), "chunk", "left")
    named = named.withColumn("numbers", F.coalesce("numbers", F.lit(b"")))
    return staged(named.mapInArrow(run, "chunk bigint, classes binary"), "classes")


def _cells(n: np.ndarray) -> pa.RecordBatch:
    cell = np.flatnonzero(n)
    return pa.record_batch({"cell": pa.array(cell, pa.int32()), "n": pa.array(n[cell].astype(np.int64))})


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    found = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def transitions(corpus: Corpus, known: DataFrame, classes: int) -> np.ndarray:
    """Counts of class after class over all training tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, held = unpack(row["ids"]), row["held"].to_numpy(zero_copy_only=False)
            here = row["classes"][ids].astype(np.int32)
            cell = here.copy()
            cell[1:] += here[:-1] * classes
            yield _cells(np.bincount(cell[_train_tokens(ids, held)], minlength=classes * classes))

    # A word without training counts is no training token, whatever its class.
    rows = corpus.rows("held", "ids").join(known.hint("shuffle_hash"), "chunk")
    return _summed(rows.mapInArrow(run, "cell int, n bigint"), classes * classes).reshape(classes, classes)


def class_sizes(corpus: Corpus, known: DataFrame, classes: int) -> np.ndarray:
    """Two rows: the words of each class, and those of them that occur once. A word
    counts in the chunk that meets it first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            own = (row["numbers"] >> LOCAL_BITS == row["chunk"]) & (row["counts"] > 0)
            cls = row["classes"][1:].astype(np.int64)
            n = [np.bincount(cls[own & more], minlength=classes) for more in (True, row["counts"] == 1)]
            yield _cells(np.concatenate(n))

    rows = corpus.named("numbers", "counts").join(known.hint("shuffle_hash"), "chunk")
    return _summed(rows.mapInArrow(run, "cell int, n bigint"), 2 * classes).reshape(2, classes)


def neighbours(corpus: Corpus, known: DataFrame, classes: int, least: int) -> DataFrame:
    """(number, at, around): for each word of each chunk with ``least`` training
    occurrences pairs of bytes. The first has its present class; the others a
    neighbour's class (plus ``classes`` if it stands before) and how often, 255 at
    most; more counts take more pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * classes
        for row in _rows(batches):
            ids, now, n = unpack(row["ids"]), row["classes"], row["counts"]
            moving = np.concatenate([[False], n >= least])
            # A word's cells are numbered by its place among those that move.
            place = (np.cumsum(moving) - 1).astype(np.uint32 if moving.sum() * width < 1 << 32 else np.int64)
            mine = _train_tokens(ids, row["held"].to_numpy(zero_copy_only=False)) & moving[ids]
            at = np.flatnonzero(mine)
            own = place[ids[at]] * place.dtype.type(width)
            sides = (own + now[ids[at + 1]], own + now[np.where(at > 0, ids[at - 1], 0)] + place.dtype.type(classes))
            del mine, at, own
            cell, n = np.unique(np.concatenate(sides), return_counts=True)
            del sides
            local = np.flatnonzero(moving)
            word = (cell // width).astype(np.int64)
            pairs = -(-n // 255)
            # One pair more for each word, ahead of its own.
            ahead = np.cumsum(pairs) + word  # the last pair of each cell, with those put ahead
            flat = np.full((int(pairs.sum()) + len(local), 2), 255, np.uint8)
            sizes = np.bincount(word, weights=pairs, minlength=len(local)).astype(np.int64) + 1
            tops = np.concatenate([[0], np.cumsum(sizes)])
            body = np.ones(len(flat), bool)
            body[tops[:-1]] = False
            flat[body, 0] = np.repeat(cell % width, pairs)
            flat[ahead, 1] = n - 255 * (pairs - 1)
            flat[tops[:-1], 0] = now[local]
            around = pa.BinaryArray.from_buffers(
                pa.binary(), len(local), [None, pa.py_buffer((2 * tops).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]
            )
            yield pa.record_batch({
                "number": pa.array(row["numbers"][local - 1]), "at": pa.array((row["chunk"] << LOCAL_BITS) + local), "around": around,
            })

    rows = corpus.rows("held", "ids").join(corpus.named("numbers", "counts").hint("shuffle_hash"), "chunk")
    return rows.join(known.hint("shuffle_hash"), "chunk").mapInArrow(run, "number bigint, at bigint, around binary")


# --- exchange ----------------------------------------------------------------

def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(counts: np.ndarray) -> float:
    """What of the training text's log-likelihood the classes decide."""
    return float(_f(counts).sum() - _f(counts.sum(0)).sum() - _f(counts.sum(1)).sum())


def moves(around: np.ndarray, now: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best class of each word. ``around``: a row for each word, its neighbours'
    counts by class behind it and, in the second half, before it."""
    classes = len(counts)
    table = np.concatenate([counts, counts.T], axis=1).T  # (neighbour, class)
    held, totals = _f(table), counts.sum(0)
    n = around[:, :classes].sum(1)
    out = now.astype(np.int64).copy()
    word, cell = np.nonzero(around)
    if not len(word):
        return out
    filled, first = np.unique(word, return_index=True)
    step = max(CELLS // classes, 1)
    cuts = [0]
    while cuts[-1] < len(filled):
        reach = first[cuts[-1]] + step
        cuts.append(max(int(np.searchsorted(first, reach, side="right")) - 1, cuts[-1] + 1)
                    if reach < len(word) else len(filled))
    edges = np.append(first, len(word))
    for lo, hi in zip(cuts, cuts[1:]):
        part, rows = slice(edges[lo], edges[hi]), filled[lo:hi]
        w, c = word[part], cell[part]
        r, own = around[w, c], now[w]
        gain = _f(table[c] + r[:, None]) - held[c]
        line = np.arange(len(w))
        gain[line, own] = held[c, own] - _f(np.maximum(table[c, own] - r, 0))
        total = np.add.reduceat(gain, first[lo:hi] - edges[lo], axis=0)
        size, home = n[rows], now[rows]
        marginal = _f(totals + size[:, None]) - _f(totals)
        marginal[np.arange(len(rows)), home] = _f(totals[home]) - _f(np.maximum(totals[home] - size, 0))
        total -= 2 * marginal
        total[:, END] = -np.inf
        out[rows] = total.argmax(1)
    return out


def _exchanged(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(at, moved): each word's new class, for every chunk that has it."""
    classes = len(counts)

    def decided(words: pa.Table) -> pa.RecordBatch:
        number = words.column("number").to_numpy()
        new = np.concatenate([[True], number[1:] != number[:-1]])
        group = np.cumsum(new) - 1
        around = words.column("around").combine_chunks()
        offsets = np.frombuffer(around.buffers()[1], "<i4")[around.offset:around.offset + len(around) + 1]
        flat = np.frombuffer(around.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, 2)
        ahead = (offsets[:-1] - offsets[0]) // 2
        weights = flat[:, 1].astype(np.float64)
        weights[ahead] = 0
        key = np.repeat(group, np.diff(offsets) // 2) * (2 * classes) + flat[:, 0]
        dense = np.bincount(key, weights, (group[-1] + 1) * 2 * classes).reshape(-1, 2 * classes)
        best = moves(dense, flat[ahead, 0][new], counts)
        return pa.record_batch({"at": words.column("at").combine_chunks(), "moved": pa.array(best[group], pa.int16())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            number = held.column("number").to_numpy()
            # Rows are sorted: all but the last word are complete.
            whole = int(np.searchsorted(number, number[-1], side="left"))
            if whole:
                yield decided(held.slice(0, whole))
            rest = held.slice(whole)
        if rest is not None:
            yield decided(rest)

    return rows.repartition("number").sortWithinPartitions("number").mapInArrow(run, "at bigint, moved smallint")


def _moved(known: DataFrame, moved: DataFrame, buckets: int) -> DataFrame:
    """The chunks' classes with some words in new ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            out = row["classes"].copy()
            if row["locals"] is not None:
                out[row["locals"]] = row["moved"]
            yield pa.record_batch({"chunk": pa.array([row["chunk"]], pa.int64()), "classes": pa.array([out.tobytes()], pa.binary())})

    news = _gathered(moved, buckets, {"moved": "u1"}, ["moved"])
    return staged(known.join(news, "chunk", "left").mapInArrow(run, "chunk bigint, classes binary"), "classes")


# --- the model ---------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """``counts`` of class after class; ``types`` and ``singles``: the words of a
    class and those that occur once."""

    counts: np.ndarray
    types: np.ndarray
    singles: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.counts.sum())

    @property
    def vocabulary(self) -> int:
        return int(self.types.sum())

    @property
    def discount(self) -> np.ndarray:
        return (self.singles + 1) / (self.types + 2)

    def transition(self) -> np.ndarray:
        """log10 P(class | class before); the last row and column stand for an unknown word."""
        k = len(self.counts)
        out = np.zeros((k + 1, k + 1))
        total = self.counts.sum(0)
        if not total.sum():
            return out
        share = total / total.sum()
        left = self.counts.sum(1)
        kinds = np.maximum((self.counts > 0).sum(1), 1)
        after = (self.counts + kinds[:, None] * share) / (left + kinds)[:, None]
        freed = self.discount * self.types
        unknown = np.divide(freed, total, out=np.zeros(k), where=total > 0)
        out[:k, :k] = after
        out[k, :k] = freed / freed.sum() @ after
        out[:, k] = out[:, :k] @ unknown
        with np.errstate(divide="ignore"):
            return np.log10(out)

    def emission(self, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(word | its class) of known words."""
        return np.log10((n - self.discount[cls]) / self.counts.sum(0)[cls])


def fit(corpus: Corpus, clustering: Clustering) -> tuple[Model, DataFrame]:
    """The model, and the classes of each chunk's words."""
    classes = clustering.classes
    known = _first_classes(corpus, classes)
    for least in [clustering.least] * clustering.rounds + [1]:
        counts = transitions(corpus, known, classes)
        moved = _exchanged(neighbours(corpus, known, classes, least), counts)
        known = _moved(known, moved, corpus.buckets)
    counts = transitions(corpus, known, classes)
    types, singles = class_sizes(corpus, known, classes)
    ends = counts[:, END].sum()
    types[END], singles[END] = float(ends > 0), float(ends == 1)
    return Model(counts, types, singles), known


RESULTS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def scored(corpus: Corpus, known: DataFrame, model: Model, key: str) -> DataFrame:
    """One row for each document, in one pass over the chunks."""
    tokens, types = model.tokens, model.vocabulary
    ends = int(model.counts[:, END].sum())
    transition = model.transition()
    unknown = len(model.counts)
    kind = corpus.rows("keys").schema["keys"].dataType.elementType
    kinds = (T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([T.StructField(key, kind), *map(T.StructField, RESULTS, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, cls = unpack(row["ids"]), row["classes"]
            n = np.concatenate([[ends], row["counts"] if row["counts"] is not None else []]).astype(np.int64)
            base = np.log10((n + 1) / (tokens + types + 1))
            emission = np.zeros(len(n))
            some = n > 0
            emission[some] = model.emission(cls[some], n[some])
            cls = np.where(some, cls, unknown)
            here = cls[ids]
            # Every document starts after an end.
            before = np.concatenate([[END if ends else unknown], here[:-1]])
            each = transition[before, here] + emission[ids]
            stops = np.flatnonzero(ids == 0)
            starts = np.concatenate([[0], stops[:-1] + 1])
            size = stops - starts + 1
            score = np.add.reduceat(each, starts)
            columns = [
                row["keys"], row["held"], pa.array(size, pa.int64()),
                pa.array(np.add.reduceat(some[ids].astype(np.int64), starts), pa.int64()),
                pa.array(np.full(len(size), tokens), pa.int64()), pa.array(np.add.reduceat(base[ids], starts), pa.float64()),
                pa.array(score, pa.float64()), pa.array(10 ** np.minimum(-score / size, 300), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = corpus.rows("keys", "held", "ids").join(corpus.named("counts").hint("shuffle_hash"), "chunk", "left")
    return rows.join(known.hint("shuffle_hash"), "chunk").mapInArrow(run, schema)


def score(docs: DataFrame, key: str, text: str, train: Column, clustering: Clustering = Clustering()) -> DataFrame:
    """Per row: the key, whether it was held out (``train`` false or NULL), its tokens,
    those known from training, all training tokens, the add-one unigram score and the
    model's (both log10 probabilities), and the model's perplexity a token."""
    corpus = Corpus(docs, key, text, train)
    try:
        model, known = fit(corpus, clustering)
        return staged(scored(corpus, known, model, key), "scores")
    finally:
        corpus.drop()

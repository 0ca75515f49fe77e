"""Toxic spans by a linear-chain conditional random field.

Labels are known for whole documents, so tokens are labelled first: in a bounded
sample of labelled documents (``SAMPLE`` toxic ones, ``CLEAN`` times as many
others, near copies counted once) a word whose documents are toxic far more often
than chance allows (likelihood ratio above ``EVIDENCE``) is a toxic token in toxic
documents. A two-state CRF learns from these, with features of a word's identity,
its beginnings and its endings, so it also knows words that were too rare to label.

Scoring reads every text whole. Forward-backward over each sentence gives each
token's marginal probability; a document's score comes from its highest marginal
and the number of toxic tokens expected, through a logistic step fitted on the
same sample and weighted back to the labelled rows' share of toxic documents.
Offsets are those of words with a marginal of one half or more.

A sentence ends at . ! ? or a line end, or after ``LONGEST`` words. Sequences of a
batch step through the recursions together. The fit runs in one executor task on
the bounded sample; the model is bounded by the number of feature slots.

Rows: every row gives one row. A NULL or empty text has no words and the score of
a text without evidence; repeated rows stay. Labels other than 0 and 1 are not
read; of several labels of one document the highest counts. With documents of
only one label, or none, every score is the smoothed share of toxic ones.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from holdfast.llm.common import quoted, slices, without

SAMPLE = 1500           # toxic documents at most
CLEAN = 2               # others for each of them
EVIDENCE = 22.0
SLOTS = 1 << 20
LONGEST = 64
STEPS = 40
RATE = 0.3
SHRINK = 1e-4
BATCH_BYTES = 2_000_000
MOST_KNOWN = 300_000    # words a worker remembers the emissions of
FLOOR = -12.0           # log-odds below which a marginal counts as nothing
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = (".", "!", "?", "\n")
BEGINNINGS, ENDINGS = (3, 5, 7), (4,)


# --- the field -------------------------------------------------------------

def features(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the identity, the beginnings and the ending of each word's
    lower-cased bytes, one word's after another's, and where each word's start."""
    slots, firsts, crc = [], [], zlib.crc32
    for word in words:
        low = word.lower().encode()
        size = len(low)
        firsts.append(len(slots))
        slots.append(crc(low, 1))
        for n in BEGINNINGS:
            if n < size:
                slots.append(crc(low[:n], 2))
        for n in ENDINGS:
            if n < size:
                slots.append(crc(low[-n:], 3))
    return np.array(slots, np.int64) % SLOTS, np.array(firsts, np.int64)


def sequences(ends: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of sentences over a run of words, longest first.

    ``ends``: the positions (before a word) at which a sentence or document ended.
    """
    cuts = np.unique(np.concatenate([[0], ends, stops]))
    cuts = cuts[cuts <= stops[-1]] if len(stops) else cuts[:1]
    lengths = np.diff(cuts)
    pieces = -(-lengths // LONGEST)
    starts = np.repeat(cuts[:-1], pieces)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = starts + nth * LONGEST
    lengths = np.minimum(np.repeat(lengths, pieces) - nth * LONGEST, LONGEST)
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def messages(emission: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
             move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-ratios (toxic to clean) of the forward and backward messages of each word."""
    forward, backward = np.array(emission, float), np.zeros(len(emission))
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths.max(initial=0)) + 1)]
    for t in range(1, len(alive) - 1 if len(alive) else 0):
        at = starts[:alive[t]] + t
        before = forward[at - 1]
        forward[at] += np.logaddexp(move[0, 1], move[1, 1] + before) - np.logaddexp(move[0, 0], move[1, 0] + before)
    for t in range(len(alive) - 3, -1, -1):
        at = starts[:alive[t + 1]] + t
        after = emission[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(move[1, 0], move[1, 1] + after) - np.logaddexp(move[0, 0], move[0, 1] + after)
    return forward, backward


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Field:
    """Feature weights, transitions, and the step from marginals to a score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.float32))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = 0.0
    last: np.ndarray = field(default_factory=lambda: np.zeros(3))
    share: float | None = None  # set where there was nothing to learn from

    def score(self, top: np.ndarray, expected: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(top), self.share)
        return sigmoid(evidence(top, expected) @ self.last)


def evidence(top: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """What the score is made of: a constant, the highest marginal's log-odds, the expected count."""
    return np.column_stack([np.ones(len(top)), np.clip(top, FLOOR, 12.0), np.log1p(expected)])


class Numbers(defaultdict):
    """Words numbered as they come, behind the marks that end a sentence."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__
        for mark in ENDS:
            self[mark]


class Words:
    """Texts as word numbers, with the places where sentences and texts end."""

    def __init__(self, numbers: Numbers):
        self.numbers = numbers
        self.codes: list[int] = []
        self.stops: list[int] = []

    def add(self, text: str | None) -> None:
        if text:
            self.codes.extend(map(self.numbers.__getitem__, TOKEN.findall(text)))
        self.stops.append(len(self.codes))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Numbers of the words (from 0), and the places before a word where a
        sentence ends and where each text ends."""
        codes = np.array(self.codes, np.int64) - len(ENDS)
        words = np.concatenate([[0], np.cumsum(codes >= 0)])
        return codes[codes >= 0], words[np.flatnonzero(codes < 0)], words[np.array(self.stops, np.int64)]


def per_text(odds: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's highest log-odds and its expected number of toxic words."""
    starts = np.concatenate([[0], stops[:-1]]).astype(int)
    filled = stops > starts
    top, expected = np.full(len(stops), FLOOR), np.zeros(len(stops))
    if filled.any():
        top[filled] = np.maximum.reduceat(odds, starts[filled])
        chance = np.where(odds > FLOOR, sigmoid(odds), 0.0)
        expected[filled] = np.add.reduceat(np.where(chance >= 0.5, chance, 0.0), starts[filled])
    return top, expected


# --- fitting ---------------------------------------------------------------

def _distinct(texts: list[str], labels: list[int]) -> list[int]:
    """Positions of the texts that share none of four shingle minima with an earlier one of their label."""
    seen, kept = set(), []
    mixers = np.array([[1], [0x9E3779B1], [0x85EBCA6B], [0xC2B2AE35]], np.uint64)
    for i, text in enumerate(texts):
        words = np.array([zlib.crc32(w.encode()) for w in text.split()] or [0], np.uint64)
        shingles = words[:max(len(words) - 7, 1)].copy()
        for n in range(1, min(8, len(words))):
            shingles = shingles * np.uint64(1_000_003) + words[n:n + len(shingles)]
        minima = ((shingles ^ (shingles >> np.uint64(29))) * mixers % np.uint64(2 ** 31)).min(1)
        marks = [(labels[i], n, int(m)) for n, m in enumerate(minima)]
        if not any(m in seen for m in marks):
            kept.append(i)
        seen.update(marks)
    return kept


def toxic_words(texts: list[str], labels: list[int]) -> set[str]:
    """Words found in toxic documents far beyond chance."""
    counts, sizes = (Counter(), Counter()), [0, 0]
    for text, label in zip(texts, labels):
        counts[label].update({t.lower() for t in TOKEN.findall(text)})
        sizes[label] += 1
    share = sizes[1] / max(sum(sizes), 1)
    out = set()
    for word, toxic in counts[1].items():
        clean = counts[0][word]
        rate = toxic / (toxic + clean)
        if toxic < 3 or rate <= share or word in ENDS or clean * 20 > toxic:
            continue
        gain = toxic * np.log(rate / share) + (clean * np.log((1 - rate) / (1 - share)) if clean else 0.0)
        if 2 * gain >= EVIDENCE:
            out.add(word)
    return out


def fit_field(texts: list[str], labels: list[int], prior: tuple[int, int]) -> Field:
    """``prior``: clean and toxic documents among all that may be learned from."""
    if not prior[0] or not prior[1] or 0 not in labels or 1 not in labels:
        return Field(share=(prior[1] + 0.5) / (sum(prior) + 1))
    kept = _distinct(texts, labels)
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    marked = toxic_words(texts, labels)
    toxic = sum(labels)
    # The field learns from the toxic documents and half as many clean ones.
    learn = [i for i, y in enumerate(labels) if y] + [i for i, y in enumerate(labels) if not y][:max(toxic // 2, 50)]
    numbers = Numbers()
    words = Words(numbers)
    for i in learn:
        words.add(texts[i])
    codes, ends, stops = words.arrays()
    model = Field()
    if not len(codes):
        return Field(share=(prior[1] + 0.5) / (sum(prior) + 1))
    starts, lengths = sequences(ends, stops)
    vocabulary = list(numbers)[len(ENDS):]
    is_marked = np.array([w.lower() in marked for w in vocabulary], bool)
    of_toxic = np.repeat(np.array([labels[i] for i in learn], bool), np.diff(np.concatenate([[0], stops])))
    y = (is_marked[codes] & of_toxic).astype(float)
    flat, firsts = features(vocabulary)
    sizes = np.diff(np.append(firsts, len(flat)))
    inner = np.ones(len(codes), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    followed = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4)
    theta = np.zeros(SLOTS)
    state = [(np.zeros(SLOTS), np.zeros(SLOTS)), (np.zeros(4), np.zeros(4)), (np.zeros(1), np.zeros(1))]

    def climb(value, slope, i, step):
        m, v = state[i]
        m += 0.1 * (slope - m)
        v += 0.01 * (slope ** 2 - v)
        return value + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    bias = np.array([-4.0])
    for step in range(1, STEPS + 1):
        emission = (np.add.reduceat(theta[flat], firsts) + bias[0])[codes]
        forward, backward = messages(emission, starts, lengths, model.move)
        chance = sigmoid(forward + backward)
        gap = np.bincount(codes, weights=y - chance, minlength=len(vocabulary))
        slope = np.bincount(flat, weights=np.repeat(gap, sizes), minlength=SLOTS) - SHRINK * theta
        a, c = forward[inner - 1], emission[inner] + backward[inner]
        zero = np.zeros_like(a)
        pair = np.stack([zero, c, a, a + c]) + model.move.reshape(4, 1)
        pair = np.exp(pair - pair.max(0))
        expected = (pair / pair.sum(0)).sum(1)
        theta = climb(theta, slope, 0, step)
        model.move = climb(model.move.reshape(4), followed - expected, 1, step).reshape(2, 2)
        bias = climb(bias, np.array([gap.sum()]), 2, step)
    model.weights = theta.astype(np.float32)
    model.move = model.move - model.move[0, 0]
    model.bias = float(bias[0])
    _fit_last(model, texts, labels, prior)
    return model


def _fit_last(model: Field, texts: list[str], labels: list[int], prior: tuple[int, int]) -> None:
    """The logistic step, by Newton's method on three numbers."""
    top, expected = [], []
    reader = Reader(model)
    for at in range(0, len(texts), 256):
        t, e, _ = reader.read(texts[at:at + 256])
        top.append(t)
        expected.append(e)
    x = evidence(np.concatenate(top), np.concatenate(expected))
    y = np.array(labels, float)
    weight = np.where(y == 1, prior[1] / max(y.sum(), 1), prior[0] / max((1 - y).sum(), 1))
    weight = weight * len(y) / weight.sum()
    beta = np.zeros(3)
    for _ in range(50):
        p = sigmoid(x @ beta)
        slope = x.T @ (weight * (y - p)) - 1.0 * beta * np.array([0.01, 1, 1])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.01, 1, 1])
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.last = beta


# --- reading texts ---------------------------------------------------------

class Reader:
    """Scores texts; remembers the emissions of words."""

    def __init__(self, model: Field):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.emission = np.zeros(0)

    def read(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each text's highest log-odds, its expected toxic words, and each word's log-odds."""
        if len(self.numbers) > MOST_KNOWN:
            self.forget()
        words = Words(self.numbers)
        for text in texts:
            words.add(text)
        codes, ends, stops = words.arrays()
        known = len(self.emission)
        if len(self.numbers) - len(ENDS) > known:
            weights = self.model.weights
            flat, firsts = features(islice(self.numbers, known + len(ENDS), None))
            sums = np.add.reduceat(weights[flat].astype(float), firsts) + self.model.bias
            self.emission = np.concatenate([self.emission, sums])
        if not len(codes):
            return np.full(len(stops), FLOOR), np.zeros(len(stops)), [np.zeros(0)] * len(stops)
        starts, lengths = sequences(ends, stops)
        forward, backward = messages(self.emission[codes], starts, lengths, self.model.move)
        odds = forward + backward
        top, expected = per_text(odds, stops)
        return top, expected, np.split(odds, stops[:-1])


def spans_of(text: str, odds: np.ndarray) -> list[dict]:
    """Offsets (code points, end exclusive) and marginals of the toxic words of a text."""
    words = (m for m in TOKEN.finditer(text) if m[0] not in ENDS)
    return [{"start": m.start(), "end": m.end(), "marginal": float(sigmoid(o))}
            for m, o in zip(words, odds) if o >= 0]


# --- on Spark --------------------------------------------------------------

def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column,
        sample: int = SAMPLE, clean: int = CLEAN) -> Field:
    """``learn``: a condition on the column ``id`` of the labels that may be learned from."""
    marks = (
        labels.select(quoted(key).alias("id"), quoted(label).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)").where(learn).groupBy("id").agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(0, 0), counts.get(1, 0))
    order = [F.xxhash64("id"), F.col("id")]
    toxic = marks.where("y = 1").orderBy(*order).limit(sample)
    others = marks.where("y = 0").orderBy(*order).limit(sample * clean)
    # At most sample * (1 + clean) ids, so the texts need no shuffle.
    chosen = F.broadcast(toxic.union(others))
    texts = docs.select(quoted(key).alias("id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    bounded = texts.join(chosen, "id").select("id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["id"], r["y"], r["text"]) for b in batches for r in b.to_pylist()), key=repr)
        model = fit_field([r[2] for r in rows], [r[1] for r in rows], prior)
        yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})

    row = bounded.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else Field(share=(prior[1] + 0.5) / (sum(prior) + 1))


def score(docs: DataFrame, text: str, model: Field, into: Sequence[str] = ("score", "toxic_spans"),
          keep: Sequence[str] | None = None, with_spans: bool = True) -> DataFrame:
    """The kept columns (all, unless named), the score, and the toxic spans."""
    kept = [c for c in (docs.columns if keep is None else keep) if c in without(docs, into)]
    added = into if with_spans else into[:1]
    # A kept text is read where it stands; any other text travels beside the kept columns.
    own = text in kept and docs.schema[text].dataType == T.StringType()
    slim = docs.select(*[quoted(c) for c in kept], *([] if own else [quoted(text).cast("string").alias("__text")]))
    read = text if own else "__text"
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("marginal", T.DoubleType())]))
    kinds = dict(zip(into, (T.DoubleType(), span)))
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, kinds[n]) for n in added]])
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # SLOTS numbers
    flat = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shipped.value)
        reader = Reader(model)
        for batch in slices(batches, read, BATCH_BYTES):
            texts = batch.column(batch.schema.get_field_index(read)).to_pylist()
            top, expected, odds = reader.read(texts)
            columns = [*batch.columns[:len(kept)], pa.array(model.score(top, expected), pa.float64())]
            if with_spans:
                found = [spans_of(t, o) if t and best >= 0 and model.share is None else []
                         for t, o, best in zip(texts, odds, top)]
                columns.append(pa.array(found, flat))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Rows kept for testing: the hash of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))

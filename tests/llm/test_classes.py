"""Class-based scores against plain counts, sums over all words, and moves tried one by one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import classes as C
from holdfast.llm.queries import op13_class_model

def train():
    return F.col("doc_id") % 4 != 0


def is_trained(key):
    """A NULL key gives NULL, which holds out."""
    return key is not None and key % 4 != 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def base_of(rows, trained):
    """{row number: (tokens, known, all training tokens, base)}; ``trained`` by row number."""
    seen = Counter(w for i, t in rows if trained[i] for w in words_of(t))
    total, kinds = sum(seen.values()), len(seen)
    return {
        i: (len(words_of(t)), sum(seen[w] > 0 for w in words_of(t)), total,
            sum(math.log10((seen[w] + 1) / (total + kinds + 1)) for w in words_of(t)))
        for i, t in rows
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    tongues = [["the", "The", "of", "cat", "dog", "sat"], ["der", "die", "hund", "katze", "É𝄞", "x\x00"]]
    out = [(1, None), (2, ""), (4, ""), (3, " \n\t "), (5, "word " * 20_000), (6, "neu neu neu")]
    for i in range(7, 200):
        tongue = rng.choice(tongues)
        out.append((i, " ".join(rng.choice(tongue) if rng.random() < .95 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(60)))))
    return out + [(9, "the cat"), (9, "the cat"), (9, "another text"), (None, "the dog")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("key", "words", "chunk", "score", "n", "held"):
        df = df.withColumn(name, F.lit("x"))
    return df


def results(df):
    rows = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, repr(r)))


def test_counts_and_base(docs, rows):
    got = results(C.score(docs, "doc_id", "text", train(), C.Clustering(8, 1, 5)).drop("score", "perplexity"))
    numbered = list(enumerate(t for _, t in rows))
    want = base_of(numbered, {n: is_trained(i) for n, (i, _) in enumerate(rows)})
    expected = [(i, not is_trained(i), *want[n][:3], round(want[n][3], 9)) for n, (i, _) in enumerate(rows)]
    assert got == sorted(expected, key=lambda r: (r[0] is None, repr(r)))


def test_chunks_change_nothing(docs, monkeypatch):
    one = results(C.score(docs.coalesce(1), "doc_id", "text", train(), C.Clustering(8, 2, 5)))
    monkeypatch.setattr(C, "CHUNK_BYTES", 300)
    monkeypatch.setattr(C, "CELLS", 40)
    many = results(C.score(docs.repartition(5), "doc_id", "text", train(), C.Clustering(8, 2, 5)))
    assert one == many


def test_scores_follow_from_classes_and_add_up(spark, docs, rows):
    """Recomputed word by word from the words' classes; all words and the unknown one add up to 1."""
    corpus = C.Corpus(docs.repartition(3), "doc_id", "text", train())
    try:
        model, known = C.fit(corpus, C.Clustering(8, 2, 5))
        of_word = {}
        for r in corpus.rows("words").join(corpus.named("counts"), "chunk").join(known, "chunk").collect():
            cls, n = np.frombuffer(r["classes"], np.uint8), np.frombuffer(r["counts"], "<i8")
            for w, c, k in zip(r["words"], cls[1:], n):
                assert of_word.setdefault(w, (c, k)) == (c, k)
        got = {(r["doc_id"], r["n_tokens"], round(r["score"], 7)) for r in C.scored(corpus, known, model, "doc_id").collect()}
    finally:
        corpus.drop()
    trained = [t for i, t in rows if is_trained(i)]
    seen = Counter(w for t in trained for w in words_of(t))
    assert {w: k for w, (_, k) in of_word.items() if k} == {w: k for w, k in seen.items() if w}
    cls = {w: int(c) for w, (c, k) in of_word.items() if k} | {None: 0}
    pairs = Counter()
    for t in trained:
        line = [None, *words_of(t)]
        pairs.update((cls[a], cls[b]) for a, b in zip(line, line[1:]))
    assert all(model.counts[a, b] == n for (a, b), n in pairs.items()) and model.counts.sum() == sum(pairs.values())

    total = Counter()
    for (_, b), n in pairs.items():
        total[b] += n
    kinds, singles = Counter(cls.values()), Counter(c for w, c in cls.items() if seen[w] == 1)
    used = sorted(total)
    discount = {c: (singles[c] + 1) / (kinds[c] + 2) for c in used}

    def after(a, b):
        if a is None:  # an unknown word: as likely of a class as that leaves chance for it
            freed = {c: discount[c] * kinds[c] for c in used}
            return sum(freed[c] * after(c, b) for c in used) / sum(freed.values())
        left = sum(n for (x, _), n in pairs.items() if x == a)
        more = sum(1 for (x, _) in pairs if x == a)
        return (pairs[a, b] + more * total[b] / sum(total.values())) / (left + more)

    unknown = {c: discount[c] * kinds[c] / total[c] for c in used}

    def chance(a, w):
        if w in cls:
            return after(a, cls[w]) * (seen[w] - discount[cls[w]]) / total[cls[w]]
        return sum(after(a, c) * unknown[c] for c in used)

    for a in [None, *used]:
        assert sum(chance(a, w) for w in [*cls, "never seen"]) == pytest.approx(1)
    for i, t in rows:
        line = [None, *words_of(t)]
        score = sum(math.log10(chance(0 if k == 0 else cls.get(line[k]), w)) for k, w in enumerate(line[1:]))
        assert any(d == i and n == len(line) - 1 and s == pytest.approx(score, abs=1e-5) for d, n, s in got)


def test_moves_equal_trying_every_class():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 60, (6, 6)).astype(float) + 30
    around = rng.integers(0, 4, (40, 12)) * (rng.random((40, 12)) < .4)
    around[:, 6:] = 0
    for w in range(40):  # as many neighbours before as behind
        for c in rng.integers(0, 6, around[w, :6].sum()):
            around[w, 6 + c] += 1
    now = rng.integers(1, 6, 40)
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    totals = counts.sum(0)
    for w, best in enumerate(C.moves(around.astype(float), now, counts)):
        if not around[w].any():
            assert best == now[w]
            continue
        n, gains = around[w, :6].sum(), {}
        for k in range(1, 6):
            sign = -1 if k == now[w] else 1
            g = sum(sign * (f(counts[k, c] + sign * around[w, c]) - f(counts[k, c])) for c in range(6))
            g += sum(sign * (f(counts[c, k] + sign * around[w, 6 + c]) - f(counts[c, k])) for c in range(6))
            gains[k] = g - 2 * sign * (f(totals[k] + sign * n) - f(totals[k]))
        assert gains[best] == pytest.approx(max(gains.values()))


def test_rounds_raise_the_likelihood(docs):
    found = []
    corpus = C.Corpus(docs, "doc_id", "text", train())
    try:
        found = [C.likelihood(C.transitions(corpus, C._first_classes(corpus, 6), 6))]
        found += [C.likelihood(C.fit(corpus, C.Clustering(6, rounds, 5))[0].counts) for rounds in (0, 2)]
    finally:
        corpus.drop()
    assert found == sorted(found) and found[0] < found[2]


def test_nothing_to_learn_from(spark, docs):
    rows = C.score(docs.limit(20), "doc_id", "text", F.lit(False), C.Clustering(4, 1)).collect()
    assert len(rows) == 20
    assert {(r["held_out"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["perplexity"]) for r in rows} == {
        (True, 0, 0, 0.0, 0.0, 1.0)}
    assert C.score(docs.limit(0), "doc_id", "text", train()).collect() == []


def test_query_on_held_out_documents(spark):
    """Counts and base are exact, and documents kept from training are told better than by word counts."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = base_of(texts.items(), {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in texts})
    rows = op13_class_model(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][3], abs=1e-6)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)

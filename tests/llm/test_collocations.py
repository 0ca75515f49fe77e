"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import collocations as C

LIMIT = 12


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def all_counts(rows):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[i:i + size])] += 1
    return f, n


def brute(rows, least, most=2000):
    f, n = all_counts(rows)
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, words), a in f.items():
        if len(words) < 2:
            continue
        score, k = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
        held = any(
            100 * b >= 80 * a and any(longer[i:i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            for (l2, longer), b in f.items() if l2 == lang and len(longer) > len(words)
        )
        if not held:
            out.append((lang, score, a, " ".join(words), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    ranked = []
    for lang in sorted({r[0] for r in out}):
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))
        ranked += [(lang, i + 1, r[3], r[2], r[4], r[5], r[6], r[1]) for i, r in enumerate(mine[:most])]
    return sorted(ranked)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "a", "b", "é𝄞", "x y", "New", "York", "city", "x\x00"]
    out = [(1, "en", None), (2, "en", ""), (3, None, "new york city. new york"), (None, None, "a a a a a a"), (4, "xx", " \t\n.")]
    for i in range(5, 160):
        picks = [rng.choice(words[:rng.choice((2, 5, 11))]) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice((" ", " ", " ", "\t ", ". ", "\n", "\r", ", ")) for w in picks)
        out.append((i, rng.choice(("en", "de", None, "und")), text + "new york city\x0b" * rng.randrange(3)))
    return out + [(5, "en", "the of the of " * 4_000)] + [(6, "de", "copied line of words!")] * 40


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    for name in ("phrase", "f", "n", "sampled", "rank"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(4)


@pytest.mark.parametrize("mining", [
    C.Mining(LIMIT), C.Mining(LIMIT, sample=2, lowered=2.0), C.Mining(LIMIT, sample=10**9),
])
def test_equals_brute_force(docs, rows, mining):
    """The last sample is empty, so that every phrase is found by expansion."""
    assert rows_of(C.collocations(docs, "doc_id", "text", "lang", mining)) == brute(rows, LIMIT)


def test_full_bitmaps_and_small_chunks(docs, rows, monkeypatch):
    """A bitmap that says yes to nearly everything changes no result."""
    monkeypatch.setattr(C, "LEAST_BITS", 64)
    monkeypatch.setattr(C, "MOST_BITS", 64)
    monkeypatch.setattr(C, "CHUNK_BYTES", 500)
    monkeypatch.setattr(C, "OUT_ROWS", 7)
    mining = C.Mining(LIMIT, sample=10**9)
    assert rows_of(C.collocations(docs, "doc_id", "text", "lang", mining, most=5)) == brute(rows, LIMIT, 5)


def test_an_earlier_pass_counts_only_what_it_reached():
    """``before`` has the pair by chance, but not its words: the triple was never looked at."""
    ids = np.array([1, 2, 3, 0], np.uint32)
    hashes = np.concatenate([[0], C._word_hashes("en", ["a", "b", "c"])]).astype(np.uint64)
    pairs = C._longer(hashes[1:3], hashes[2:4])

    def bitmap(some):
        out = np.zeros(1 << 10, np.uint64)
        for at in C._probes(some, 1 << 16):
            np.bitwise_or.at(out, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        return out

    before = bitmap(pairs)
    found = list(C._counted(ids, hashes, [2, 3], before | bitmap(hashes[1:]), before))
    assert [f.tolist() for f, _ in found] == [[[1, 2], [2, 3]], [[1, 2, 3]]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert C.collocations(docs, "doc_id", "text", "lang").collect() == []


def test_products_beyond_64_bits(spark):
    big = 9 * 10**18
    frequent = spark.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "a b", big)], "lang string, phrase string, f bigint")
    row = C.cuts(frequent).first()
    assert (row["a"], row["l"], row["r"], row["score"]) == (big, big, big, 1_000_000)

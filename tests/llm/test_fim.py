"""Fill-in-middle against code that decodes the texts."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from holdfast.llm import fim

TEXTS = [
    (1, "plain ascii words in a row"), (2, None), (3, ""), (None, "É𝄞ñ ß — 漢字"), (4, "ab"), (4, "ab"), (4, "another"),
    (5, "漢𝄞é " * 60_000), (6, "has <S> inside"), (7, "<"), (8, "S> <M <P"), (9, "̀́"), (10, "x"),
]
TEXTS += [(i, "é" * (i % 5) + "a𝄞b" * (i % 7)) for i in range(20, 400)]


def brute(key, text, recipe=fim.Recipe()):
    text = text or ""
    digest = hashlib.sha256(f"{recipe.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, s, m = recipe.sentinels
    if not text or any(x in text for x in recipe.sentinels) or h3 % 100 >= recipe.reordered:
        return text, "plain", n, None, None
    if h4 % 100 < recipe.suffix_first:
        return s + text[b:] + p + text[:a] + m + text[a:b], "spm", n, a, b - a
    return p + text[:a] + s + text[b:] + m + text[a:b], "psm", n, a, b - a


@pytest.mark.parametrize("recipe", [fim.Recipe(), fim.Recipe(("<|pre|>", "<|suf|>", "<|mid|>"), 100, 50, 7)])
def test_transform_equals_brute_force(spark, recipe):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    for name in ("output", "Form", "__n", "key", "h1"):
        docs = docs.withColumn(name, F.lit("x"))
    made = fim.transform(docs.repartition(3), "doc_id", "text", recipe=recipe)
    assert made.columns == ["doc_id", "__n", "key", "h1", *fim.RESULTS]
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"), recipe)).collect()
    got = sorted((str(r["doc_id"]), *(repr(r[c]) for c in fim.RESULTS), r["back"]) for r in rows)
    assert got == sorted((str(i), *map(repr, brute(i, t, recipe)), t or "") for i, t in TEXTS)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.transform(docs, "doc_id", "text").collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_rank_and_select(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    units = fim.Units(data)
    chars = "".join(texts)
    ends = np.array([0, *np.cumsum([len(c.encode()) for c in chars])], np.int64)
    assert units.rank(ends).tolist() == list(range(len(chars) + 1))
    assert units.select(np.arange(len(chars) + 1)).tolist() == ends.tolist()

"""The registered queries on the smallest tables, against SQL or brute force."""

import re

import brute
import numpy as np
import pytest
from compare import connect, duck_rows, kinds, spark_rows

from holdfast.llm.checks import statements
from holdfast.llm.queries import LLM_QUERIES

SQL = statements()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = LLM_QUERIES[name](spark, sf)
    assert spark_rows(df) == duck_rows(con, SQL[name])
    ours, theirs = kinds(con, df, SQL[name])
    assert ours == theirs


def test_secret_spans_equal_python(spark, sf, texts):
    got = {r["doc_id"]: r["spans"] for r in LLM_QUERIES["op2_secret_scan"](spark, sf).collect()}
    assert got == {i: brute.secret_spans(t) for i, t in texts.items()}


def test_nearest_neighbours_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    got: dict = {}
    for r in LLM_QUERIES["op4_nearest_neighbours"](spark, sf).collect():
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        best = sorted((i for i in x if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20]
        hits += len(set(best) & set(found.values()))
        total += len(best)
        assert sorted(found) == list(range(1, len(found) + 1))
    assert hits / total >= 0.9


def test_toxicity_held_out(spark, sf):
    rows = {r["doc_id"]: r for r in LLM_QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(rows[r["doc_id"]], r["toxic"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    toxic, clean = ([r["predicted"] for r, y in held if y == want] for want in (1, 0))
    assert sum(toxic) / len(toxic) >= 0.6 and sum(clean) / len(clean) <= 0.02


def test_byte_bpe_equals_the_library(spark, sf, texts):
    encode = brute.encoder().encode_ordinary
    got = {r[0]: tuple(r[1:]) for r in LLM_QUERIES["op6_byte_bpe"](spark, sf).collect()}
    assert got == {i: brute.token_digests(t, encode) for i, t in texts.items()}


def test_simhash_equals_brute_force(spark, sf, texts):
    prints = {i: brute.fingerprint(t) for i, t in texts.items()}
    names = brute.component_names(prints)
    got = {r[0]: tuple(r[1:]) for r in LLM_QUERIES["op10_simhash"](spark, sf).collect()}
    assert got == {i: (f"{p:016x}", names[i]) for i, p in prints.items()}


def test_license_lines_are_found(spark, sf, texts):
    line = re.compile(r"^(Licensed under .*|Released under the MIT License\.|This work is licensed under .*)$", re.M)
    want = {(i, m.start(), m.end()) for i, t in texts.items() for m in line.finditer(t or "")}
    got = {(r["doc_id"], r["span_start"], r["span_end"]) for r in LLM_QUERIES["op8_license_scan"](spark, sf).collect()}
    assert got == want


def test_pages_give_the_article(spark, sf):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in LLM_QUERIES["op7_html_extraction"](spark, sf).collect():
        html = source[r["page_id"]]
        article = html[html.index("<article>"):html.index("</article>")]
        assert r["n_chars"] == len(r["text"]) and "<" not in r["text"]
        assert r["text"].count("\n") + 1 <= article.count("<p>") + 1
        assert r["text"].split("\n")[0] in " ".join(article.split()).replace("&amp;", "&").replace("&quot;", '"')

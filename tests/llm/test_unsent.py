"""No side of a join that grows with the corpus is sent to the driver and every task."""

import pytest

import corpus_pipeline as C
from holdfast.llm import common, secrets, simhash

DOCS = [(i, f"one two three four five six seven eight nine {i // 3} ten", "en", "s", 7) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan
    return [line for line in plan.splitlines() if "Broadcast" in line]


@pytest.fixture
def plans(monkeypatch):
    """The plans of what an operator stages on its way."""
    seen = []

    def staged(df, *rest):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return common.staged(df, *rest)

    for module in (simhash, C):
        monkeypatch.setattr(module, "staged", staged)
    return seen


def test_links_and_components(docs, plans):
    found = simhash.near_duplicates(docs, "doc_id", "text")
    assert joins(found) == []
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert found.count() == len(DOCS)


def test_what_stays_and_what_is_masked(spark, docs, plans):
    assert joins(C.keep_one_of_each(spark, docs, "")) == []
    assert joins(C.mask_secrets(spark, docs, "")) == []
    ledger = common.staged(secrets.scan_unseen(docs, "text"), "ledger")
    assert joins(secrets.scan_unseen(docs, "text", ledger=ledger)) == []


def test_a_frame_too_large_to_send_is_not_sent(docs):
    slim = docs.select("doc_id", "lang")
    assert joins(docs.join(common.sized(slim, "t", 29), "doc_id")) == []
    assert joins(docs.join(common.sized(slim, "t", 29).where("lang = 'en'"), "doc_id", "left")) == []
    assert joins(docs.join(common.sized(slim, "t", 30), "doc_id"))

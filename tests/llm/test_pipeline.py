"""The pipeline's stages, each against what a plain version does with its input."""

import brute
import pytest

import corpus_pipeline as C
from holdfast.llm import toxicity
from holdfast.llm import queries as Q
from holdfast.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxic_documents_go(spark, stages):
    model = Q.toxicity_model(spark, stages[0], SF)
    scored = toxicity.score(stages[0], "text", model).collect()
    assert rows(stages[1]).keys() == {r["doc_id"] for r in scored if r["score"] < Q.PREDICTED}


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    names = brute.component_names({i: brute.fingerprint(r["text"]) for i, r in before.items()})
    assert after.keys() == set(names.values()) and all(after[i] == before[i] for i in after)


def test_secrets_are_masked(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert brute.secret_spans(r["text"]) == "" and r["n_chars"] == len(r["text"])
        if not brute.secret_spans(before[i]["text"]):
            assert r == before[i]


def test_mixture_is_whole_documents(stages):
    before, after = rows(stages[3]), stages[4].collect()
    assert all(before[r["doc_id"]] == r for r in after)
    def size(r):
        return len((r["text"] or "").split())
    assert sum(map(size, after)) <= sum(map(size, before.values())) * Q.MIX_PERMILLE / 1000


def test_last_stage_and_run(spark, stages):
    encode = brute.encoder().encode_ordinary
    want = sorted((r["doc_id"], *brute.token_digests(r["text"], encode)) for r in stages[4].collect())
    assert sorted(tuple(r) for r in stages[5].collect()) == want
    assert sorted(tuple(r) for r in C.run(spark, SF).collect()) == want


def test_repeated_and_nameless_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, "x", "en", "s", 1), (3, None, None, None, None)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = C.keep_one_of_each(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "None"]
    assert len(C.mask_secrets(spark, docs, SF).collect()) == 5


def test_the_row_of_a_repeated_id_does_not_depend_on_the_run(spark):
    """Two texts under one id, equal but for another column, extra columns, in any order of rows."""
    rows = [(1, "b one two three", "en", "s", 7, {"k": 1}), (1, "a four five six", "en", "z", 7, {"k": 2}),
            (1, "a four five six", "de", "s", 7, None), (2, "seven eight nine ten", "en", "s", 7, {})]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `x.y` map<string,int>"
    for order in (rows, rows[::-1]):
        kept = C.keep_one_of_each(spark, spark.createDataFrame(order, schema).repartition(3), SF)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "x.y"]
        assert sorted((r["doc_id"], r["text"], r["lang"]) for r in kept.collect()) == [
            (1, "a four five six", "de"), (2, "seven eight nine ten", "en")]
    for stage in (C.keep_one_of_each, C.mask_secrets, C.mix_sources):
        assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
        assert stage(spark, spark.createDataFrame(rows, schema), SF).columns == kept.columns

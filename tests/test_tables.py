import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import PEOPLE, ROWS
from holdfast.operators.keyed import KeyConflict, constraint_report
from holdfast.plans import catalog
from holdfast.__main__ import main
from holdfast.plans.loading import (
    create_tables, customer_table, delete_customers, load_customers, open_views, publish_tables, quarantined, score_table,
    semantic_views,
)
from holdfast.plans.scoring import publish_scores
from holdfast.schema import CUSTOMERS, SCORES
from holdfast.sources import files
from holdfast.sources.keyed_table import KeyedTable


@pytest.fixture()
def raw_file(tmp_path):
    lines = [",".join(PEOPLE)]
    for row in ROWS:
        cells = list(row)
        cells[2] = "1" if cells[2] == "Yes" else "0"
        lines.append(",".join(str(c) for c in cells))
    new = lines[1].replace("P-10", "P-20").split(",")
    new[5], new[19] = "0", " "
    path = tmp_path / "raw.csv"
    path.write_text("\n".join([*lines, ",".join(new)]) + "\n")
    return str(path)


def test_missing_file_raises(spark):
    with pytest.raises(AnalysisException):
        files.read_raw(spark, "/tmp/no/such/file.csv")


def test_raw_read_keeps_the_text(spark, raw_file):
    assert files.read_raw(spark, raw_file).where("customerID = 'P-20'").first().TotalCharges == " "


def test_bad_lines_are_set_aside(spark, raw_file, tmp_path):
    """A short line, a long one, bad numbers and a record without a key; the good ones load."""
    with open(raw_file) as file:
        lines = file.read().splitlines()
    good = lines[1:]
    word, price = good[1].replace("P-11", "P-31").split(","), good[1].replace("P-11", "P-32").split(",")
    word[5], price[18] = "many", "9.9.9"
    bad = ["P-30,Male", good[0].replace("P-10", "P-33") + ",extra", ",".join(word), ",".join(price)]
    unnamed = good[2].replace("P-12", "")
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.csv").write_text("\n".join([lines[0], *good[:3], bad[0], bad[1], unnamed]) + "\n")
    (tmp_path / "mixed" / "b.csv").write_text("\n".join([lines[0], bad[2], *good[3:], bad[3]]) + "\n")
    root = str(tmp_path / "db")
    for _ in range(2):
        assert load_customers(spark, str(tmp_path / "mixed"), root, run_id="r1") == len(good)
    aside = quarantined(spark, root, "r1").collect()
    assert sorted(r.record for r in aside if r.reason == "malformed") == sorted(bad)
    assert [r.record[:7] for r in aside if r.reason == "no key"] == [",Female"]
    assert {r.source_file.rsplit("/", 1)[1] for r in aside} == {"a.csv", "b.csv"} and len(aside) == 5
    loaded = sorted(map(tuple, customer_table(spark, root).read().collect()))
    load_customers(spark, raw_file, str(tmp_path / "clean"))
    assert loaded == sorted(map(tuple, customer_table(spark, str(tmp_path / "clean")).read().collect()))
    # What is selected does not change what counts as malformed.
    sound, others = files.read_checked(spark, str(tmp_path / "mixed"))
    assert sound.select("gender").count() == sound.count() == len(good) and others.select("reason").count() == 5


def test_load_twice_is_load_once(spark, raw_file, tmp_path):
    root = str(tmp_path / "db")
    assert load_customers(spark, raw_file, root) == 5
    first = sorted(map(tuple, customer_table(spark, root).read().collect()))
    assert load_customers(spark, raw_file, root) == 5
    table = customer_table(spark, root)
    assert sorted(map(tuple, table.read().collect())) == first
    rows = {r.customer_id: r for r in table.read().collect()}
    assert float(rows["P-20"].total_charges) == 0
    assert rows["P-11"].senior_citizen == 1 and float(rows["P-13"].monthly_charges) == 80.25


def test_upsert_replaces_and_keeps(spark, raw_file, tmp_path):
    root = str(tmp_path / "db")
    load_customers(spark, raw_file, root)
    table = customer_table(spark, root)
    changed = table.read().where("customer_id = 'P-10'").withColumn("tenure", F.lit(2))
    added = table.read().where("customer_id = 'P-13'").withColumn("customer_id", F.lit("P-99"))
    assert table.upsert(changed.unionByName(added)) == 2
    got = {r.customer_id: r.tenure for r in table.read().collect()}
    assert got == {"P-10": 2, "P-11": 36, "P-12": 5, "P-13": 60, "P-20": 0, "P-99": 60}


def test_repeated_key_is_refused(spark, raw_file, tmp_path):
    root = str(tmp_path / "db")
    load_customers(spark, raw_file, root)
    table = customer_table(spark, root)
    twice = table.read().unionByName(table.read())
    with pytest.raises(KeyConflict):
        table.upsert(twice)
    assert table.read().count() == 5


def test_scores_keep_the_newest_and_the_stale(spark, sf, tmp_path):
    scores = catalog.scores(spark, sf).persist()
    root = str(tmp_path / "db")
    table = score_table(spark, root)
    summary = publish_scores(scores, str(tmp_path / "export"), table).first()
    n = scores.count()
    assert summary.scored_customers == n == table.read().count()
    # Later scores for some customers, in one batch with older ones.
    some = scores.where("contract = 'Two year'")
    later = some.withColumn("scored_at", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    publish_scores(some.unionByName(later), str(tmp_path / "export2"), table, fmt="parquet")
    got = table.read()
    assert got.count() == n
    assert got.where("year(scored_at) = 2025").count() == some.count()


def test_older_schema_reads_as_null(spark, tmp_path):
    old = spark.createDataFrame([("a", 1)], "customer_id string, tenure int")
    row = files.conform(old, SCORES).first()
    assert row.customer_id == "a" and row.clv_at_risk is None
    old.write.parquet(str(tmp_path / "old"))
    assert spark.read.schema(SCORES).parquet(str(tmp_path / "old")).first().clv_at_risk is None


def test_records_by_run(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for run, v in (("a", 1), ("b", 2)):
        files.write_record(spark.createDataFrame([(v,)], "v int"), path, run)
    assert files.read_record(spark, path, "b").collect() == [(2,)]


def test_bucketed_tables_join_without_a_shuffle(spark, sf, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{tmp_path}/shop'")
    files.save_bucketed(catalog.customers(spark, sf), "shop.customers", "customer_id", 4)
    files.save_bucketed(catalog.scores(spark, sf), "shop.scores", "customer_id", 4)
    from holdfast.operators.semantic import customer_view

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = customer_view(spark.table("shop.customers"), spark.table("shop.scores"))
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert view.count() == 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE shop CASCADE")


def test_views_after_loading(spark, raw_file, tmp_path):
    root = str(tmp_path / "db")
    load_customers(spark, raw_file, root)
    open_views(spark, root)
    row = spark.sql("SELECT * FROM v_churn_bi_kpis").first()
    assert (row.total_customers, row.churned_customers, row.scored_active_customers) == (5, 1, 0)
    assert row.expected_monthly_revenue_at_risk is None
    assert spark.table("v_customer_churn_analytics").count() == 5


def test_constraint_report_finds_what_is_wrong(spark):
    base = {f.name: None for f in CUSTOMERS.fields}
    rows = [{**base, "customer_id": "a", "contract": "x" * 31}, {**base, "customer_id": "a"},
            {**base, "customer_id": "b"}]
    customers = spark.createDataFrame([tuple(r.values()) for r in rows], CUSTOMERS)
    scores = spark.createDataFrame([("zz",) + (None,) * 10], SCORES)
    bad = {(r.table_name, r.check_name, r.column_name): r.violations
           for r in constraint_report(customers, scores).collect() if r.violations}
    assert bad == {("customers", "width", "contract"): 1, ("customers", "unique", "customer_id"): 1,
                   ("churn_scores", "references", "customer_id"): 1}


def test_created_tables_are_left_alone(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS fresh LOCATION '{tmp_path}/fresh'")
    try:
        create_tables(spark, "fresh", 2)
        spark.createDataFrame([("a",) + (None,) * 10], SCORES).write.insertInto("fresh.churn_scores")
        create_tables(spark, "fresh", 2)
        assert spark.table("fresh.churn_scores").count() == 1
        assert [f.dataType for f in spark.table("fresh.customers").schema] == [f.dataType for f in CUSTOMERS]
    finally:
        spark.sql("DROP DATABASE fresh CASCADE")


def test_money_that_does_not_fit_raises(spark):
    from pyspark.errors import ArithmeticException

    from holdfast.plans.scoring import score_columns

    df = spark.createDataFrame([("a", 1, "x", 1e9, 0.5)],
                               "customer_id string, tenure int, contract string, monthly_charges double, p double")
    with pytest.raises(ArithmeticException):
        score_columns(df, 0.5, "2024-01-01 00:00:00").collect()


def test_jobs_from_file_to_workbook(spark, raw_file, tmp_path):
    root, out = str(tmp_path / "db"), str(tmp_path / "out")
    main(["load", "--raw", raw_file, "--root", root], spark)
    main(["workbook", "--root", root, "--out", out], spark)
    assert spark.read.parquet(f"{out}/source_data").count() == 5
    summary = spark.read.parquet(f"{out}/contract_summary").orderBy("position").collect()
    assert [(r.contract, r.source_customers, r.scored_customers) for r in summary] == [
        ("Month-to-month", 2, 0), ("One year", 2, 0), ("Two year", 1, 0)]
    assert {r.customers for r in spark.read.parquet(f"{out}/risk_summary").collect()} == {0}


def test_a_repeated_run_replaces_its_record(spark, tmp_path):
    for value, run in ((7, "x"), (33, "x"), (5, "y")):
        files.write_record(spark.createDataFrame([(value,)], "v int"), str(tmp_path / "r"), run)
    assert [r["v"] for r in files.read_record(spark, str(tmp_path / "r"), "x").collect()] == [33]
    assert [r["v"] for r in files.read_record(spark, str(tmp_path / "r"), "y").collect()] == [5]


LETTERS = "customer_id string, scored_at int, note string"


@pytest.fixture()
def letters(spark, tmp_path):
    """A table of letters with a number that says which row is newer, in eight buckets."""
    kind = spark.createDataFrame([], LETTERS).schema

    class Letters(KeyedTable):
        def put(self, *rows, how="latest"):
            return self.upsert(spark.createDataFrame(list(rows), LETTERS), how)

        def held(self):
            return sorted(tuple(r) for r in self.read().collect())

    return Letters(spark, str(tmp_path / "t"), kind, "customer_id", "scored_at", buckets=8)


def _files(folder):
    return {p.relative_to(folder).as_posix(): (p.stat().st_mtime_ns, p.stat().st_size) for p in folder.rglob("*.parquet")}


def test_a_batch_touches_only_the_buckets_it_names(spark, tmp_path):
    """Ten keys of two thousand: all other buckets keep their very files, and they are not read."""
    kind = spark.createDataFrame([], "customer_id string, n int").schema
    table = KeyedTable(spark, str(tmp_path / "t"), kind, "customer_id", buckets=64)
    rows = spark.range(2_000).select(F.col("id").cast("string").alias("customer_id"), F.lit(1).alias("n"))
    table.upsert(rows)
    before = _files(tmp_path / "t")
    batch = rows.limit(10).withColumn("n", F.lit(2))
    named = {r[0] for r in batch.select(table.bucket()).distinct().collect()}
    assert table.upsert(batch) == 10
    after = _files(tmp_path / "t")
    changed = {n.split("/")[0] for n in before.keys() ^ after.keys()} | {n.split("/")[0] for n in before.keys() & after.keys() if before[n] != after[n]}
    assert changed == {f"bucket={b}" for b in named} and len(before) == 64
    assert table.read().agg(F.sum("n"), F.count("*")).first() == (2_010, 2_000)
    plan = table._rows().where(F.col("bucket").isin(sorted(named)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_newest_row_of_batch_and_table_wins(letters):
    assert letters.held() == []
    letters.put(("a", 1, "x"), ("b", 5, "x"), ("a", 3, "y"))
    letters.put(("a", 2, "late"), ("b", 6, "z"), ("c", 1, "x"))
    before = letters.held()
    letters.put(("a", 2, "late"), ("b", 6, "z"), ("c", 1, "x"))
    assert letters.held() == before == [("a", 3, "y"), ("b", 6, "z"), ("c", 1, "x")]
    assert letters.put() == 0 and letters.held() == before


def test_refused_batches_leave_the_table(letters):
    letters.put(("a", 1, "x"))
    with pytest.raises(KeyConflict):
        letters.put(("b", 1, "x"), ("b", 2, "x"), how="error")
    with pytest.raises(KeyConflict):
        letters.put((None, 1, "x"))
    assert letters.held() == [("a", 1, "x")]


def test_delete_insert_and_replay(spark, letters):
    letters.put(("a", 1, "x"), ("b", 1, "x"), ("c", 9, "x"))
    letters.delete(spark.createDataFrame([("a",), ("c",), ("zz",), (None,), ("a",)], "customer_id string"), 5)
    # The last row of a bucket goes, too; a row newer than the deletion stays.
    assert letters.held() == [("b", 1, "x"), ("c", 9, "x")]
    letters.put(("a", 1, "x"), ("zz", 5, "x"))
    assert letters.held() == [("b", 1, "x"), ("c", 9, "x")]
    letters.put(("a", 6, "again"))
    letters.delete(spark.createDataFrame([("a",)], "customer_id string"), 5)
    assert letters.held() == [("a", 6, "again"), ("b", 1, "x"), ("c", 9, "x")]
    with pytest.raises(ValueError):
        letters.delete(spark.createDataFrame([("a",)], "customer_id string"))


def test_deleted_customers_lose_their_scores(spark, sf, tmp_path):
    root = str(tmp_path / "db")
    people = catalog.customers(spark, sf)
    customer_table(spark, root).upsert(people)
    score_table(spark, root).upsert(catalog.scores(spark, sf))
    some = score_table(spark, root).read().limit(7).select("customer_id").persist()
    before = score_table(spark, root).read().count()
    delete_customers(spark, root, some, "2024-06-01 00:00:00")
    left = customer_table(spark, root).read()
    assert left.count() == people.count() - 7 and left.join(some, "customer_id").isEmpty()
    assert score_table(spark, root).read().count() == before - 7
    assert customer_table(spark, root).upsert(people) == people.count()
    assert customer_table(spark, root).read().count() == people.count()


def test_state_lets_only_newer_records_through(spark, tmp_path):
    """Batches in any order: each key's rows rise in time, and a repeated row is seen once."""
    from holdfast.streaming.newest import newest_per_key

    schema = "customer_id string, note string, money decimal(10,2), scored_at timestamp_ntz"
    batches = [
        [("a", "one", "2024-01-01 00:00:00"), ("b", "two", "2024-01-02 00:00:00"), ("a", "new", "2024-01-03 00:00:00.5")],
        [("a", "late", "2024-01-02 00:00:00"), ("b", "two", "2024-01-02 00:00:00"), (None, "x", "2024-01-09 00:00:00")],
        [("b", "three", "2024-01-02 00:00:01"), ("a", "new", "2024-01-03 00:00:00.5"), ("c", "x", None)],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "customer_id string, note string, t string").select(
            "customer_id", "note", F.lit("1.25").cast("decimal(10,2)").alias("money"), F.col("t").cast("timestamp_ntz").alias("scored_at"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        # Files are taken by their time.
        for p in (tmp_path / f"in/{i}").iterdir():
            os.utime(p, (1_700_000_000 + 100 * i,) * 2)
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = newest_per_key(stream, "customer_id", "scored_at").writeStream.foreachBatch(
        lambda batch, i: seen.append(sorted((r.customer_id, r.note) for r in batch.collect()))
    ).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [s for s in seen if s] == [[("a", "new"), ("b", "two")], [("b", "three")]]


def test_state_takes_many_keys_in_a_call(spark, tmp_path, monkeypatch):
    """Keys that share a group stay apart, with their missing values, over chunks and batches, whole numbers exact."""
    from holdfast.streaming import newest

    monkeypatch.setattr(newest, "GROUPS", 2)
    wide = "customer_id string, n bigint, note string, scored_at timestamp_ntz"
    for i, offset in enumerate((0, 5, 0)):
        # Each key twice, a day apart; of every third the number is missing.
        rows = spark.range(0, 80).select(
            F.concat(F.lit("k"), (F.col("id") % 40 + offset).cast("string")).alias("customer_id"),
            F.when(F.col("id") % 3 > 0, F.lit(2**60 + 1) + F.col("id")).alias("n"), F.lit("x").alias("note"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 40).cast("int")).cast("timestamp_ntz").alias("scored_at"))
        rows.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for p in (tmp_path / f"in/{i}").iterdir():
            os.utime(p, (1_700_000_000 + 100 * i,) * 2)
    seen, calls = [], spark.sparkContext.accumulator(0)

    class Counted(newest._Newest):
        def handleInputRows(self, key, rows, timers):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timers)

    monkeypatch.setattr(newest, "_Newest", Counted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = spark.readStream.schema(wide).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        newest.newest_per_key(stream, "customer_id", "scored_at").writeStream.foreachBatch(
            lambda batch, i: seen.append({r.customer_id: (r.n, r.scored_at.day) for r in batch.collect()})
        ).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    number = lambda i: 2**60 + 1 + i if i % 3 else None
    assert seen[0] == {f"k{i}": (number(i + 40), 2) for i in range(40)}
    # The second batch names k5 to k44; rows of one instant rank by their digest.
    assert {f"k{i}" for i in range(40, 45)} <= set(seen[1]) <= {f"k{i}" for i in range(5, 45)}
    # The third repeats the first.
    assert all(not s for s in seen[2:])
    assert 0 < calls.value <= 6


def test_published_tables_join_without_a_shuffle(spark, sf, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    people, scores = catalog.customers(spark, sf), catalog.scores(spark, sf)
    try:
        for view in (
            catalog.q_v1_bucketed(spark, sf),
            publish_tables(spark, people, scores, "reports", 4, f"{tmp_path}/reports")["v_customer_churn_analytics"],
        ):
            plan = view._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert spark.table("reports.v_customer_churn_analytics").count() == view.count() == 150
        assert spark.table("reports.v_churn_contract_summary").count() == 3
        # A second run replaces the tables.
        publish_tables(spark, people.limit(5), scores, "reports", 4)
        assert spark.table("reports.v_churn_bi_kpis").first().total_customers == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE IF EXISTS reports CASCADE")


def test_jobs_load_score_delete_publish(spark, raw_file, tmp_path):
    root = str(tmp_path / "db")
    main(["load", "--raw", raw_file, "--root", root, "--buckets", "4"], spark)
    keys = tmp_path / "keys.csv"
    keys.write_text("customer_id\nP-11\n")
    main(["delete", "--root", root, "--buckets", "4", "--keys", str(keys), "--at", "2024-06-01 00:00:00"], spark)
    try:
        main(["publish", "--root", root, "--buckets", "4", "--database", "by_job", "--tables", "2"], spark)
        assert spark.table("by_job.v_churn_bi_kpis").first().total_customers == 4
        assert spark.table("by_job.churn_scores").count() == 0
    finally:
        spark.sql("DROP DATABASE IF EXISTS by_job CASCADE")


def _kept_and_recomputed(spark, root, buckets):
    from holdfast.plans.rollups import kept

    people, scores = customer_table(spark, root, buckets).read(), score_table(spark, root, buckets).read()
    afresh = semantic_views(people, scores)
    for name, held in kept(spark, root).items():
        assert held.columns == afresh[name].columns
        assert sorted(map(str, held.collect())) == sorted(map(str, afresh[name].collect())), name
    return kept(spark, root)["v_churn_bi_kpis"].first()


def test_rollups_follow_upserts_and_deletes(spark, sf, tmp_path):
    """Some keys at a time, late, twice, and down to no customer: always the full recomputation."""
    from holdfast.plans.rollups import refresh

    root, buckets = str(tmp_path / "db"), 16
    c, s = catalog.customers(spark, sf), catalog.scores(spark, sf)
    people, scores = customer_table(spark, root, buckets), score_table(spark, root, buckets)
    people.upsert(c)
    assert refresh(spark, root, buckets=buckets) == list(range(buckets))
    scores.upsert(s)
    refresh(spark, root, s, buckets)
    first = _kept_and_recomputed(spark, root, buckets)
    assert first.total_customers == 150 and first.scored_active_customers == s.count()
    some = c.orderBy("customer_id").limit(3).withColumn("monthly_charges", F.lit("7.77").cast("decimal(10,2)"))
    before = _files(tmp_path / "db" / "rollup")
    people.upsert(some)
    named = refresh(spark, root, some, buckets)
    after = _files(tmp_path / "db" / "rollup")
    assert {n.split("/")[0] for n in before.keys() ^ after.keys()} == {f"bucket={b}" for b in named} and len(named) <= 3
    _kept_and_recomputed(spark, root, buckets)
    later = s.limit(9).withColumns({"is_high_risk": F.lit(1), "scored_at": F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")})
    scores.upsert(later, on_duplicate="latest")
    for _ in range(2):
        refresh(spark, root, later, buckets)
    assert str(_kept_and_recomputed(spark, root, buckets).latest_score_timestamp) == "2024-05-01 00:00:00"
    # The newest instant goes with its customers.
    delete_customers(spark, root, later, "2024-06-01 00:00:00", buckets)
    refresh(spark, root, later, buckets)
    assert str(_kept_and_recomputed(spark, root, buckets).latest_score_timestamp) == "2024-01-01 00:00:00"
    assert refresh(spark, root, c.limit(0), buckets) == []
    delete_customers(spark, root, c, "2024-06-01 00:00:00", buckets)
    main(["rollup", "--root", root, "--buckets", str(buckets)], spark)
    assert _kept_and_recomputed(spark, root, buckets).total_customers == 0

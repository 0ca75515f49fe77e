"""Sketches that were merged against one pass and against exact figures."""

import pytest
from pyspark.sql import functions as F

from compare import plan
from holdfast.operators.sketches import RANK_ERROR, distinct_error, estimates, judged, merged, sketched

ROWS = 300_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Numbers with a third of the rows on one value, keys that are nearly all distinct,
    a label with a few values and NULLs, and a cell that holds a third of all rows."""
    n = F.col("id")
    return spark.range(ROWS).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), n % 17)).alias("day"),
        F.when(n % 3 == 1, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("amount"),
        F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(200_000))).alias("key"),
        F.when(n % 10 < 6, "yes").when(n % 10 < 9, "no").alias("label"),
        F.lit(None).cast("int").alias("nothing"),
    ).persist()


def test_merged_is_as_good_as_one_pass(skewed):
    columns = ["amount", "key", "label", "nothing"]
    cells = sketched(skewed, columns, ["day"]).persist()
    assert cells.count() == 18 * 4
    once = {r.column_name: r for r in estimates(sketched(skewed, columns), top=2).collect()}
    both = estimates(merged(cells), top=2)
    rows = {r.column_name: r for r in both.collect()}
    for name, r in rows.items():
        for c in ("present", "missing", "min_value", "max_value", "top" if name != "key" and name != "amount" else "present"):
            assert r[c] == once[name][c], (name, c)
    assert [tuple(t) for t in rows["label"].top] == [("yes", ROWS * 6 // 10), ("no", ROWS * 3 // 10)]
    assert rows["label"].missing == ROWS // 10
    # A value with a third of the rows is found among hundreds of thousands.
    value, n = rows["amount"].top[0]
    assert value == "5.0" and abs(n - ROWS // 3) <= ROWS / 256
    assert (rows["nothing"].present, rows["nothing"].missing, rows["nothing"].distinct_values) == (0, ROWS, 0)
    assert rows["nothing"].quantiles is None and rows["nothing"].top == [] and rows["nothing"].min_value is None
    exact = skewed.select(F.countDistinct("key")).first()[0]
    assert abs(rows["key"].distinct_values - exact) <= 4 * distinct_error() * exact
    told = {r.column_name: r for r in judged(skewed, both, columns, []).collect()}
    assert told["amount"].ranks_within and told["amount"].distinct_within and told["key"].distinct_within
    assert told["key"].ranks_within is None


def test_any_selection_of_cells(skewed):
    """Merged in two steps, the selection by its cells; ranks hold within the bound."""
    cells = sketched(skewed, ["amount"], ["day", "label"])
    days = merged(cells, ["day"])
    some = days.where("day <> 'hot'")
    got = estimates(merged(some), quantiles=[0.01, 0.5, 0.9, 0.99]).first()
    rows = skewed.where("day <> 'hot'")
    n = rows.count()
    assert got.present == n
    for q, v in zip((0.01, 0.5, 0.9, 0.99), got.quantiles):
        below, up_to = rows.agg(F.count_if(F.col("amount") < v), F.count_if(F.col("amount") <= v)).first()
        assert below / n <= q + RANK_ERROR and up_to / n >= q - RANK_ERROR
    assert "Expand" not in plan(cells)


def test_judged_sees_a_wrong_estimate(skewed):
    good = estimates(sketched(skewed, ["amount"]))
    wrong = good.withColumns({
        "distinct_values": F.col("distinct_values") * 2, "quantiles": F.transform("quantiles", lambda v: v + 20_000)})
    r = judged(skewed, wrong, ["amount"], []).first()
    assert not r.distinct_within and not r.ranks_within


def test_no_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", None)], "g string, x int")
    assert sketched(df.limit(0), ["x"]).count() == sketched(df.limit(0), ["x"], ["g"]).count() == 0
    assert merged(sketched(df.limit(0), ["x"], ["g"])).count() == 0
    got = {r.g: (r.present, r.missing, r.quantiles) for r in estimates(sketched(df, ["x"], ["g"]), ["g"], [0.0, 1.0]).collect()}
    assert got == {None: (2, 0, [1.0, 3.0]), "a": (0, 1, None)}
    found = estimates(merged(sketched(df, ["x"], ["g"]), ["g"]), ["g"])
    assert judged(df, found, ["x"], ["g"]).count() == 1

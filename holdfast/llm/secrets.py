"""Secret scans over a content-addressed ledger, in DataFrame functions only.

Every historical version of every path is named by the hash of its content (a
blob). The ledger has a row for each blob, rule and rule version that was ever
scanned, with the spans found, none included. A run scans only the pairs that
the ledger lacks, each distinct blob once however many paths hold it, and joins
the findings back to all paths. A new rule version makes its pairs unseen again;
the other rules' entries stay valid.

Distinct texts are grouped on the text itself, which combines map-side, so a
text that a third of the paths share crosses the exchange once for each task.

Rows: every row of the versions gives one row. A NULL text counts as empty; a
NULL path stays. Repeated rows stay repeated. Columns of the input whose names
are in the way of the result's are not read at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.llm.common import quoted, unsent

SPAN = "struct<start:bigint,at:int,end:bigint,kind:string>"
SPANS = f"array<{SPAN}>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern; with ``least``, those whose
    ``group`` has at least so many characters. A failing match still takes up
    its text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


# A run of 24 or more is found whole by its own pattern, and a shorter run holds
# no match, so the two bounded patterns need no check behind them.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)


def spans_of(text: Column, rule: Rule, at: int) -> Column:
    """The rule's spans in code points, end exclusive.

    The text between matches and the matches alternate, so a running total of
    their lengths gives every offset. Only matches that pass are kept.
    """
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))

    def passes(hit: Column) -> Column:
        if not rule.least:
            return hit.isNotNull()
        part = F.regexp_extract(hit, rule.pattern, rule.group) if rule.group else hit
        return F.coalesce(F.char_length(part) >= rule.least, F.lit(False))

    steps = F.zip_with(F.split(text, rule.pattern, -1), hits, lambda gap, hit: F.struct(
        F.char_length(gap).cast("bigint").alias("gap"),
        F.coalesce(F.char_length(hit), F.lit(0)).cast("bigint").alias("size"),
        passes(hit).alias("passes"),
    ))

    def add(acc: Column, step: Column) -> Column:
        start, end = acc["to"] + step["gap"], acc["to"] + step["gap"] + step["size"]
        one = F.struct(start.alias("start"), F.lit(at).alias("at"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(
            end.alias("to"),
            F.when(step["passes"], F.concat(acc["spans"], F.array(one.cast(SPAN)))).otherwise(acc["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("to"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(steps, start, add, lambda acc: acc["spans"])


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def scan_unseen(versions: DataFrame, text: str, rules: Sequence[Rule] = BASE_RULES,
                ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the blob and rule-version pairs that the ledger lacks."""
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    blobs = versions.select(blob_of(whole).alias("blob"), whole.alias("text"))
    wanted = F.array(*[F.concat_ws(":", F.lit(r.kind), F.lit(str(r.version))) for r in rules])
    if ledger is None:
        todo = blobs.distinct().withColumn("todo", wanted)
    else:
        seen = ledger.groupBy(F.col("blob").alias("known")).agg(
            F.collect_set(F.concat_ws(":", "rule", F.col("version").cast("string"))).alias("done")
        )
        none = F.array().cast("array<string>")
        todo = (
            blobs.join(unsent(seen), F.col("blob") == F.col("known"), "left")
            .withColumn("todo", F.array_except(wanted, F.coalesce("done", none)))
            .where(F.size("todo") > 0).select("blob", "text", "todo").distinct()
        )
    pairs = F.array(*[
        F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), F.struct(
            F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
            spans_of(F.col("text"), r, i).alias("spans"),
        )) for i, r in enumerate(rules)
    ])
    return todo.select("blob", F.explode(F.array_compact(pairs)).alias("pair")).select("blob", "pair.*")


def findings(versions: DataFrame, paths: Sequence[str], text: str, ledger: DataFrame,
             rules: Sequence[Rule] = BASE_RULES, into: str = "spans") -> DataFrame:
    """Per row of ``versions``: its path columns and all spans of its content,
    by start and then by the rules' order, under the current rule versions."""
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    per_blob = (
        ledger.where(F.array_contains(current, F.concat_ws(":", "rule", F.col("version").cast("string"))))
        .groupBy(F.col("blob").alias("known"))
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))  # a row for each rule
        .where(F.size("found") > 0)
    )
    rows = versions.select(
        *[quoted(p).alias(f"p{i}") for i, p in enumerate(paths)], blob_of(quoted(text)).alias("blob")
    )
    return rows.join(unsent(per_blob), F.col("blob") == F.col("known"), "left").select(
        *[F.col(f"p{i}").alias(p) for i, p in enumerate(paths)],
        F.coalesce("found", F.array().cast(SPANS)).alias(into),
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that some span covers replaced by the mark."""
    def add(acc: Column, span: Column) -> Column:
        fresh = span["start"] >= acc["to"]
        gap = F.substring(text, (acc["to"] + 1).cast("int"), (span["start"] - acc["to"]).cast("int"))
        return F.struct(
            F.greatest(acc["to"], span["end"]).alias("to"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        spans, start, add,
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["to"] + 1).cast("int"), F.lit(2**31 - 1))),
    ))

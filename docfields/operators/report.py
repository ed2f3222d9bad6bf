"""Reports: P1, J6, A7, X27, X28, V3, V4, A13-A15, W2, A8, A9, J10, J12, U4, S7.

One job for all workspaces: the per-workspace N+1 queries of the reference become
a semi/anti join (J6) and a grouped count (A7); values live in the long form
(workspace_id, column, value) until the final pivot with an explicit column list.
"""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions import text as T
from docfields.session import cut_lineage

SYSTEM_COLUMNS = ("S.No", "Event Date", "Event Name")
DOC_SEPARATOR = "\n\n---\n\n"
MAX_WIDTH = 50


def workspaces_in_range(ws: DataFrame, start: str, end: str) -> DataFrame:
    """event_date in [start, end], or no event_date and created_at within
    [start 00:00:00, end 23:59:59].  Pushed to the scan as plain predicates."""
    s_ts, e_ts = F.lit(f"{start} 00:00:00").cast("timestamp_ntz"), F.lit(f"{end} 23:59:59").cast("timestamp_ntz")
    cond = (F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))) | (
        F.col("event_date").isNull() & F.col("created_at").between(s_ts, e_ts))
    return ws.where(cond)


def split_by_docs(ws: DataFrame, docs: DataFrame, key: str = "workspace_id") -> tuple[DataFrame, DataFrame]:
    """(workspaces with documents, skipped workspaces without)."""
    d = docs.select(key)
    return ws.join(d, key, "left_semi"), ws.join(d, key, "left_anti")


def flag_docs(ws: DataFrame, docs: DataFrame, key: str = "workspace_id") -> DataFrame:
    """J6 in one join: every workspace with ``has_docs``."""
    d = docs.select(key).distinct().withColumn("has_docs", F.lit(True))
    return ws.join(d, key, "left").withColumn("has_docs", F.coalesce("has_docs", F.lit(False)))


def doc_counts(docs: DataFrame, key: str = "workspace_id") -> DataFrame:
    """Exact document count per workspace."""
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"))


def column_hints(cols: DataFrame, config: DataFrame) -> DataFrame:
    """Requested columns with the user's description; duplicates: last wins.
    cols: (name, pos); config: (name, description, order)."""
    last = config.groupBy("name").agg(F.max_by("description", "order").alias("description"))
    return cols.join(last, "name", "left")


def field_context(fields: DataFrame, locations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per workspace ``Field: L (Key: k)`` + first 5 values + up to 3 distinct
    non-empty context lines, fields joined by a blank line (rank order)."""
    keys = keys or ["workspace_id"]
    ctx = locations.select(*keys, "field_key", T.py_strip("context_line").alias("c"), "doc_id", "char_start") \
        .where(F.length("c") > 0) \
        .groupBy(*keys, "field_key", "c").agg(F.min(F.struct("doc_id", "char_start")).alias("o")) \
        .groupBy(*keys, "field_key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))),
                                                             lambda x: x["c"]), 1, 3).alias("ctx"))
    f = fields.join(ctx, [*keys, "field_key"], "left")
    lbl = F.coalesce(F.col("label"), F.col("field_key"))
    block = F.concat(
        F.lit("Field: "), lbl, F.lit(" (Key: "), F.col("field_key"), F.lit(")"),
        F.when(F.size("refs") > 0, F.concat(F.lit("\n  Values: "), F.array_join(F.slice("refs", 1, 5), ", "))).otherwise(F.lit("")),
        F.when(F.size(F.coalesce("ctx", F.array())) > 0, F.concat(F.lit("\n  Context: "), F.array_join("ctx", "; "))).otherwise(F.lit("")),
    )
    rank = F.col("rank") if "rank" in fields.columns else F.col("seq")
    return f.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), block.alias("b")))),
                                                         lambda x: x["b"]), "\n\n").alias("context"))


def hint_lines(columns: str | Column) -> Column:
    """One line a requested column, ``- name`` or ``- name (Hint: description)``.
    columns: ARRAY<STRUCT<name, description>>."""
    def line(c):
        hint = F.when(F.length(F.coalesce(c["description"], F.lit(""))) > 0,
                      F.concat(F.lit(" (Hint: "), c["description"], F.lit(")"))).otherwise(F.lit(""))
        return F.concat(F.lit("- "), c["name"], hint)
    return F.array_join(F.transform(columns, line), "\n")


def build_request(template: str, **parts: Column) -> Column:
    """The caller's ``template`` with each ``{part}`` put in, trimmed; a missing part is empty."""
    out, rest = [], template
    while rest:
        at = {rest.find("{" + name + "}"): name for name in parts if "{" + name + "}" in rest}
        if not at:
            out.append(F.lit(rest))
            break
        i = min(at)
        out += [F.lit(rest[:i]), F.coalesce(T.py_strip(parts[at[i]]), F.lit(""))]
        rest = rest[i + len(at[i]) + 2:]
    return F.concat(*out) if out else F.lit("")


class Request(NamedTuple):
    """What a resolver sees: the text to answer from and the columns asked for, as (name, description)."""
    context: str
    columns: list[tuple[str, str | None]]


Resolver = Callable[[list[Request]], list[dict]]


def ask(requests: DataFrame, resolver: Resolver, keys: list[str], batch: int = 32) -> DataFrame:
    """Put requests (keys, context, columns ARRAY<STRUCT<name, description>>) to a user's callable, ``batch`` at
    a time -> (keys, column, value), a row for every column asked for.

    A batch that fails is asked again one by one, and a request that fails alone leaves its columns without a
    value, as does an answer that lacks a column.  Values become trimmed text; blank ones are none."""
    kinds = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in keys)

    def answers(part: list[Request]) -> list[dict]:
        try:
            got = resolver(part)
            if len(got) != len(part):
                raise ValueError(f"{len(got)} answers to {len(part)} requests")
            return got
        except Exception:  # noqa: BLE001 - a user's callable may raise anything
            return [{}] if len(part) == 1 else [answers([r])[0] for r in part]

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                rows = frame.iloc[at:at + batch]
                asked = [Request(c, [(x["name"], x["description"]) for x in cols])
                         for c, cols in zip(rows["context"], rows["columns"])]
                out = []
                for key, request, got in zip(rows[keys].itertuples(index=False), asked, answers(asked)):
                    for name, _ in request.columns:
                        value = (got or {}).get(name)
                        out.append((*key, name, None if value is None else str(value).strip() or None))
                yield pd.DataFrame(out, columns=[*keys, "column", "value"])
    wanted = requests.select(*keys, F.coalesce("context", F.lit("")).alias("context"), "columns")
    return wanted.mapInPandas(run, f"{kinds}, column string, value string")


def context_resolver(contexts: DataFrame, resolver: Resolver, batch: int = 32):
    """V3 with a user's callable: (workspace context, columns with hints) -> values; for ``report_values``.
    contexts: (workspace_id, context), for instance ``field_context``."""
    def resolve(fields: DataFrame, columns: DataFrame) -> DataFrame:
        asked = columns.agg(F.array_sort(F.collect_list(F.struct("col_order", "name", "description")))).scalar()
        return ask(contexts.select("workspace_id", "context", asked.alias("columns")), resolver, ["workspace_id"], batch)
    return resolve


def document_resolver(resolver: Resolver, columns: DataFrame, batch: int = 32):
    """V4 with a user's callable: it sees one document at a time and the columns its workspace lacks (with
    their hints); the first value in document order counts.  For ``resolve_from_docs``'s place."""
    def resolve(docs: DataFrame, missing: DataFrame, order: str = "doc_id") -> DataFrame:
        hints = column_hints(missing.select("workspace_id", F.col("column").alias("name")), columns)
        wanted = hints.groupBy("workspace_id").agg(F.array_sort(F.collect_list(F.struct("name", "description"))).alias("columns"))
        asked = docs.where(F.length("text") > 0).select("workspace_id", F.col(order).alias("__o"), F.col("text").alias("context"))
        got = ask(asked.join(wanted, "workspace_id"), resolver, ["workspace_id", "__o"], batch).where(F.col("value").isNotNull())
        first = got.groupBy("workspace_id", "column").agg(F.min_by("value", "__o").alias("value"))
        return missing.join(first, ["workspace_id", "column"], "left")
    return resolve


def resolve_default(fields: DataFrame, columns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V3 default resolver: per (workspace, column) the field with the best keyword
    overlap between (column name + hint) and (field key + label); value = its first
    reference; no overlap -> NULL.  Candidates come from an equi-join on shared tokens.
    columns: (name, description)."""
    keys = keys or ["workspace_id"]
    ct = columns.select("name", F.explode(T.keyword_tokens(F.concat_ws(" ", "name", "description"))).alias("tok"))
    ft = fields.select(*keys, "field_key", F.explode(T.keyword_tokens(
        F.concat_ws(" ", T.display_key("field_key"), "label"))).alias("tok"))
    ov = ft.join(ct, "tok").groupBy(*keys, "field_key", "name").agg(F.count(F.lit(1)).alias("overlap"))
    rank = F.col("rank") if "rank" in fields.columns else F.col("seq")
    cand = ov.join(fields.select(*keys, "field_key", rank.alias("frank"), F.element_at("refs", 1).alias("value")),
                   [*keys, "field_key"])
    w = Window.partitionBy(*keys, "name").orderBy(F.col("overlap").desc(), F.col("frank").asc())
    return cand.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(
        *keys, F.col("name").alias("column"), "value")


def report_values(ws: DataFrame, fields: DataFrame, columns: DataFrame, resolver=resolve_default) -> DataFrame:
    """Long report values (workspace_id, column, value) for every workspace x requested
    column: system columns from the workspace row, the rest from the resolver."""
    cols = columns.select("name", "description", F.col("order").alias("col_order"))
    llm_cols = cols.where(~F.col("name").isin(*SYSTEM_COLUMNS))
    resolved = resolver(fields, llm_cols)
    # every workspace with every requested column: the column list is a request parameter, a scalar subquery
    requested = cols.agg(F.collect_list(F.struct("name", "col_order"))).scalar()
    grid = ws.select("workspace_id", F.col("name").alias("ws_name"), "event_date", "created_at",
                     requested.alias("cols")).select("workspace_id", "ws_name", "event_date", "created_at", F.inline("cols"))
    j = grid.join(resolved, (grid["workspace_id"] == resolved["workspace_id"]) & (grid["name"] == resolved["column"]), "left") \
        .drop(resolved["workspace_id"])
    value = (F.when(F.col("name") == "Event Name", F.col("ws_name"))
             .when(F.col("name") == "Event Date", T.report_date("event_date", "created_at"))
             .when(F.col("name") == "S.No", F.lit(None).cast("string"))
             .otherwise(F.col("value")))
    return j.select("workspace_id", "created_at", F.col("name").alias("column"), "col_order", value.alias("value"))


def split_resolved(values: DataFrame) -> DataFrame:
    """Per workspace, the non-system columns without a value; outcome
    'unresolved' when any, else 'valid' (D2)."""
    miss = F.when(~F.col("column").isin(*SYSTEM_COLUMNS) & F.col("value").isNull(), F.col("column"))
    return values.groupBy("workspace_id", "created_at").agg(
        F.array_sort(F.collect_list(F.struct("col_order", miss.alias("c")))).alias("m")).select(
        "workspace_id", "created_at",
        F.transform(F.filter("m", lambda x: x["c"].isNotNull()), lambda x: x["c"]).alias("unresolved_columns")
    ).withColumn("outcome", F.when(F.size("unresolved_columns") > 0, F.lit("unresolved")).otherwise(F.lit("valid")))


def number_rows(df: DataFrame, order: list, col: str = "S.No") -> DataFrame:
    """Serial numbers 1..n in report order, without one task that sees all rows: the rows are
    ranged by the order and cut (so the ranges stay what they are), numbered inside each range, and
    shifted by the row counts of the ranges before it (one small row a range)."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__shift"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__i", within).join(shift, "__p").withColumn(
        col, (F.col("__shift") + F.col("__i")).cast("int")).drop("__p", "__i", "__shift")


def pivot_report(values: DataFrame, cols: list[str]) -> DataFrame:
    """Long -> wide, one column per requested name (all present)."""
    return values.groupBy("workspace_id").pivot("column", cols).agg(F.first("value"))


def outcome_summary(outcomes: DataFrame, skipped: DataFrame) -> DataFrame:
    """Counts of valid / unresolved / skipped."""
    o = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    s = skipped.agg(F.count(F.lit(1)).alias("n")).select(F.lit("skipped").alias("outcome"), "n")
    return o.unionByName(s)


def width_profile(rows: DataFrame, cols: list[str], order_col: str = "S.No", first_n: int = 10) -> DataFrame:
    """least(greatest(len(header), max len of the first 10 rows) + 2, 50); empty values ignored."""
    head = rows.orderBy(F.col(f"`{order_col}`").cast("long")).limit(first_n)
    aggs = [F.max(F.when(F.length(F.col(f"`{c}`").cast("string")) > 0, F.length(F.col(f"`{c}`").cast("string")))).alias(c)
            for c in cols]
    m = head.agg(*aggs)
    return m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.least(
        F.greatest(F.lit(len(c)), F.coalesce(F.col(f"`{c}`"), F.lit(0))) + 2, F.lit(MAX_WIDTH)).alias("width"))
        for c in cols])).alias("w")).select("w.*")


def concat_docs(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """The picked documents' texts joined by the separator in requested order,
    empty texts skipped.  picks: (workspace_id, doc_id, pos)."""
    j = picks.join(docs.select("doc_id", "text"), "doc_id").where(F.length("text") > 0)
    return j.groupBy("workspace_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), DOC_SEPARATOR).alias("context"))


def resolve_from_docs(docs: DataFrame, missing: DataFrame, order: str = "doc_id") -> DataFrame:
    """V4 default: value of the first ``Column: value`` line of the workspace's documents in order.
    Each document is searched by itself and the first hit is kept, so no workspace's texts are
    joined into one string.  docs: (workspace_id, doc_id, text); missing: (workspace_id, column)."""
    wanted = missing.groupBy("workspace_id").agg(F.collect_set("column").alias("columns"))
    j = docs.select("workspace_id", F.col(order).alias("__o"), "text").join(wanted, "workspace_id") \
        .select("workspace_id", "__o", "text", F.explode("columns").alias("column"))
    pat = F.concat(F.lit("(?im)^[ \\t]*"), T.regex_quote("column"), F.lit("[ \\t]*:[ \\t]*(.+)$"))
    v = F.call_function("regexp_extract", F.col("text"), pat, F.lit(1))
    hits = j.select("workspace_id", "column", "__o", v.alias("v")).where(F.col("v") != "")
    first = hits.groupBy("workspace_id", "column").agg(T.py_strip(F.min_by("v", "__o")).alias("value"))
    return missing.join(first, ["workspace_id", "column"], "left")


def fill_rows(partial: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved values override the partial row's missing columns."""
    r = resolved.select("workspace_id", "column", F.col("value").alias("rv"))
    return partial.join(r, ["workspace_id", "column"], "left").withColumn(
        "value", F.coalesce("rv", "value")).drop("rv")


def append_resolved(valid: DataFrame, resolved: DataFrame) -> DataFrame:
    """U4: valid rows first, then resolved rows."""
    return valid.withColumn("src_rank", F.lit(0)).unionByName(resolved.withColumn("src_rank", F.lit(1)))


def write_report(wide: DataFrame, cols: list[str], path: str, title: str | None = None, order: str = "S.No") -> None:
    """Ordered columns, list values joined by ', '.  Rows are ranged by ``order`` into as many files as
    there are ranges; the header is a row before the first one, so the files, put together by name, are one
    CSV sheet with one header, and no task sees all rows.  The title goes into a side file (``_title``)."""
    text = [(T.list_to_cell(F.col(f"`{c}`")) if str(wide.schema[c].dataType).startswith("Array")
             else F.col(f"`{c}`").cast("string")).alias(c) for c in cols]
    body = wide.select(F.col(f"`{order}`").cast("long").alias("__pos"), *text)
    head = wide.sparkSession.range(1).select(F.lit(0).cast("long").alias("__pos"), *[F.lit(c).alias(c) for c in cols])
    out = head.unionByName(body).repartitionByRange("__pos").sortWithinPartitions("__pos")
    out.drop("__pos").write.mode("overwrite").option("quoteAll", True).option("escape", '"').csv(path)
    if title:
        wide.sparkSession.createDataFrame([(title,)], "title string").write.mode("overwrite").text(path + "_title")


def read_report(spark, cols: list[str], path: str) -> DataFrame:
    """The rows of ``write_report``, all as text (an empty cell is null)."""
    names = ", ".join(f"`c{i}` string" for i in range(len(cols)))
    rows = spark.read.schema(names).option("multiLine", True).option("escape", '"').csv(path)
    is_head = F.lit(True)
    for i, c in enumerate(cols):
        is_head = is_head & F.col(f"c{i}").eqNullSafe(F.lit(c))
    return rows.where(~is_head).toDF(*cols)

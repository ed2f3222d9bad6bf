"""Text and table edits: P7, X20-X22, X24, A6, A10, N4, N5, W4."""
from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Pairs that go to Python in one index; more meet their paragraphs in a join.
INDEX_MAX_PAIRS = 200_000
INDEX_MAX_BYTES = 64 << 20
REFILLED = StructType([StructField("runs", ArrayType(StringType())), StructField("count", LongType())])


def attach_pairs(docs: DataFrame, pairs: DataFrame, key: str | None = None) -> DataFrame:
    """Attach the ordered (old, new) list to each document row as ``pairs``.

    pairs: (seq, old, new[, key]).  With ``key`` (e.g. workspace_id or doc_id) every
    document gets its own list through an equi-join; without a key the one global
    list (a request parameter) is a scalar subquery, not a join."""
    cols = F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("pairs")
    if key:
        plist = pairs.groupBy(key).agg(cols)
        return docs.join(plist, key, "left").withColumn(
            "pairs", F.coalesce("pairs", F.array().cast(plist.schema["pairs"].dataType)))
    return docs.withColumn("pairs", pairs.agg(cols).scalar())


ARR_STR = "array<string>"


def effective_replacements(fields: DataFrame, user_values: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(ref, new) pairs where the trimmed new value is non-empty and differs from
    the trimmed reference; ``new`` is trimmed, ``ref`` kept as is.
    fields: (keys, field_key, refs); user_values: (keys, field_key, ref, value)."""
    from docfields.functions.text import py_strip

    keys = keys or ["workspace_id"]
    refs = fields.select(*keys, "field_key", F.posexplode("refs").alias("ref_pos", "ref"))
    j = refs.join(user_values, [*keys, "field_key", "ref"], "left")
    new = py_strip("value")
    return j.where(F.col("value").isNotNull() & (F.length(new) > 0) & (new != py_strip("ref"))) \
        .select(*keys, "field_key", "ref_pos", "ref", new.alias("new"))


def split_edits(edits: DataFrame) -> DataFrame:
    """An edit whose old or new value holds a newline becomes one edit per line
    position that differs (the shorter side padded with ''); otherwise it is kept
    only when the value changes.  Adds ``part`` (line position, 0 when not split)."""
    multi = F.coalesce(F.col("old_value").contains("\n"), F.lit(False)) | \
        F.coalesce(F.col("new_value").contains("\n"), F.lit(False))
    old_l = F.coalesce(F.split("old_value", "\n", -1), F.array(F.lit("")))
    new_l = F.coalesce(F.split("new_value", "\n", -1), F.array(F.lit("")))
    n = F.greatest(F.size(old_l), F.size(new_l))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        (i - 1).alias("part"),
        F.coalesce(F.get(old_l, i - 1), F.lit("")).alias("o"),
        F.coalesce(F.get(new_l, i - 1), F.lit("")).alias("n")))
    others = [c for c in edits.columns if c not in ("old_value", "new_value")]
    split = edits.where(multi).select(*others, F.inline(pairs)).where(F.col("o") != F.col("n")) \
        .select(*others, "part", F.col("o").alias("old_value"), F.col("n").alias("new_value"))
    single = edits.where(~multi).where(~F.col("old_value").eqNullSafe(F.col("new_value"))) \
        .select(*others, F.lit(0).alias("part"), "old_value", "new_value")
    return split.unionByName(single)


def replacement_count(text, old):
    from docfields.functions.text import count_nonoverlapping

    return count_nonoverlapping(text, old)


def replace_runs(runs: DataFrame, pairs: DataFrame, key: str | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Run-preserving replacement per paragraph.

    runs: (doc_id, para_idx, run_idx, text); pairs: (seq, old, new[, key]).
    For each pair in order: join the runs, count non-overlapping occurrences, replace,
    then hand the text back to the runs by their previous lengths (the last run takes
    the overflow); a paragraph without the old text is left as is.  Returns one row per
    paragraph: (doc_id, para_idx, runs ARRAY<STRING>, count).  ``owners`` (doc_id, key), one row a document, says
    whose pairs a document takes where the runs don't.
    """
    from docfields.functions.text import count_nonoverlapping, running_starts

    paras = runs.groupBy("doc_id", "para_idx").agg(
        F.sort_array(F.collect_list(F.struct("run_idx", "text")))["text"].alias("runs"))  # without a lambda, a call a run
    none = F.lit(0).cast("bigint")
    if not key:  # one list for all: few pairs, which go to Python with the paragraphs that hold one of them
        paras = attach_pairs(paras, pairs).withColumn("combined", F.array_join("runs", ""))
        hit = F.exists("pairs", lambda p: (F.length(p["old"]) > 0) & F.col("combined").contains(p["old"]))
        st = _refill(*[F.when(hit, c) for c in (F.col("runs"), F.col("pairs")["old"], F.col("pairs")["new"])])
        return paras.select("doc_id", "para_idx", "runs", st.alias("st")).select(
            "doc_id", "para_idx", F.coalesce("st.runs", "runs").alias("runs"), F.coalesce("st.count", none).alias("count"))

    owned = runs.select("doc_id", key).distinct() if owners is None else owners.select("doc_id", key)
    # the hints, here and below: paragraphs need no sort to meet the few rows of the other side
    paras, whole = paras.join(owned.hint("shuffle_hash"), "doc_id"), paras
    index = _pair_index(pairs, key)
    if index is not None:
        # Only paragraphs that hold a pair come back from Python and meet the others: what has been in Python counts as
        # not dealt out, and would be exchanged as a whole when it is grouped by document.
        touched, refilled = _indexed(index)
        mine = whole.join(owned.distinct().hint("shuffle_hash"), "doc_id").withColumn("__key", F.col(key).cast("string"))
        st = refilled("runs", "__key")
        done = mine.where(touched(F.array_join("runs", ""), F.col("__key"))).select(
            F.col("doc_id").alias("__doc"), F.col("para_idx").alias("__para"), F.col(key).alias("__key"), st.alias("st"))
        same = (F.col("doc_id") == F.col("__doc")) & F.col("para_idx").eqNullSafe(F.col("__para")) & (F.col(key) == F.col("__key"))
        return paras.join(done.hint("shuffle_hash"), same, "left").select(
            "doc_id", "para_idx", F.coalesce("st.runs", "runs").alias("runs"), F.coalesce("st.count", none).alias("count"))
    paras = attach_candidate_pairs(paras, pairs, key, F.array_join("runs", ""))

    def step(st, p):
        rs = st["runs"]
        combined = F.array_join(rs, "")
        old, new = p["old"], F.coalesce(p["new"], F.lit(""))
        hit = (F.coalesce(F.length(old), F.lit(0)) > 0) & (F.size(rs) > 0) & combined.contains(old)
        replaced = F.replace(combined, old, new)
        n = F.size(rs)
        # offsets are computed once per pair (zipped), never per element
        zipped = F.arrays_zip(rs.alias("r"), running_starts(F.transform(rs, F.length)).alias("o"))
        new_runs = F.transform(zipped, lambda z, i: F.when(
            i == n - 1, F.substring(replaced, z["o"] + 1, 1 << 30)
        ).otherwise(F.substring(replaced, z["o"] + 1, F.length(z["r"]))))
        return F.struct(
            F.when(hit, new_runs).otherwise(rs).alias("runs"),
            (st["count"] + F.when(hit, count_nonoverlapping(combined, old)).otherwise(F.lit(0))).alias("count"))

    init = F.struct(F.col("runs").alias("runs"), none.alias("count"))
    st = F.when(F.size("pairs") > 0, F.aggregate("pairs", init, step)).otherwise(init)
    out = paras.select("doc_id", "para_idx", st.alias("st"))
    return out.select("doc_id", "para_idx", F.col("st.runs").alias("runs"), F.col("st.count").alias("count"))


def _refilled(rs: list, text: str) -> list:
    """``text`` back to the runs by their lengths, the last one takes the rest."""
    at, out = 0, []
    for r in rs[:-1]:
        out.append(None if r is None else text[at:at + len(r)])
        at += len(r or "")
    return [*out, text[at:]]


@F.pandas_udf(REFILLED)
def _refill(runs: pd.Series, olds: pd.Series, news: pd.Series) -> pd.DataFrame:
    """X22 on paragraphs: pair after pair, the text goes back to the runs by their lengths, the last one takes the rest."""
    def one(rs, pairs):
        rs, count = list(rs), 0
        for old, new in pairs:
            text = "".join(r for r in rs if r is not None)
            if not old or old not in text:
                continue
            count += text.count(old)
            rs = _refilled(rs, text.replace(old, new or ""))
        return rs, count

    done = [(None, None) if r is None or o is None else one(r, list(zip(o, n, strict=True)))
            for r, o, n in zip(runs, olds, news, strict=True)]
    return pd.DataFrame({"runs": pd.Series([d[0] for d in done], dtype=object),
                         "count": pd.Series([d[1] for d in done], dtype="Int64")})


class PairIndex:
    """The ordered (old, new) pairs of one key by the anchors (as in J1) that every occurrence of their old text carries."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        from docfields.operators import locate as L

        self.pairs = [(old, new or "") for old, new in pairs]
        self.reach = max(len(old) for old, _ in pairs) - 1
        # the same choice as ``ref_anchors`` makes: pairs of runs, else halves, else runs, else the q-gram in the middle
        choices, often = [], Counter()
        for old, _ in pairs:
            kind, found = min(len(old), L.QGRAM), None
            for k, pattern in ((L.PAIR, L.REF_PAIR), (L.HALF, L.REF_HALF), (L.RUN, L.REF_RUN)):
                if found := set(re.findall(pattern, old)):
                    kind = k
                    break
            at = (len(old) - kind) // 2
            choices.append((kind, found or {old[at:at + kind]}))
            often.update((kind, a) for a in choices[-1][1])
        self.at: dict = defaultdict(lambda: defaultdict(list))
        for i, (kind, found) in enumerate(choices):
            self.at[kind][min(found, key=lambda a: (often[kind, a], -len(a), a))].append(i)
        self.at = {kind: dict(where) for kind, where in self.at.items()}
        self.cuts = {kind: re.compile({L.RUN: L.LINE_RUN, L.PAIR: L.LINE_PAIR, L.HALF: L.LINE_HALF}[kind]) for kind in self.at if kind <= 0}

    def found(self, text: str) -> set[int]:
        """The pairs whose old text stands in ``text``."""
        out = set()
        for kind, where in self.at.items():
            have = {text[i:i + kind] for i in range(len(text) - kind + 1)} if kind > 0 else set(self.cuts[kind].findall(text))
            for a in where.keys() & have:
                out.update(i for i in where[a] if self.pairs[i][0] in text)
        return out

    def refill(self, rs: list) -> tuple[list, int]:
        """X22 with all pairs in order.  Only pairs that are found are tried: at first in the text, then around what has been
        put into it, where a later pair may have got its old text."""
        text, count, last = "".join(r for r in rs if r is not None), 0, -1
        todo = sorted(self.found(text))
        while todo:
            i = heapq.heappop(todo)
            old, new = self.pairs[i]
            if i <= last or old not in text:
                continue
            last, parts = i, text.split(old)
            count, text, at = count + len(parts) - 1, new.join(parts), 0
            rs = _refilled(rs, text)
            for part in parts[:-1]:
                at += len(part)
                for j in self.found(text[max(0, at - self.reach):at + len(new) + self.reach]):
                    if j > i:
                        heapq.heappush(todo, j)
                at += len(new)
        return rs, count


def _pair_index(pairs: DataFrame, key: str):
    """A broadcast of one ``PairIndex`` a key (as text); nothing if the pairs are too many."""
    real = pairs.where((F.length("old") > 0) & F.col(key).isNotNull())
    size = real.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("old") + F.coalesce(F.octet_length("new"), F.lit(0)) + 64).alias("bytes")).first()
    if size["n"] > INDEX_MAX_PAIRS or (size["bytes"] or 0) > INDEX_MAX_BYTES:
        return None
    lists = defaultdict(list)
    for k, old, new in real.orderBy("seq", "old", "new").select(F.col(key).cast("string"), "old", "new").collect():
        lists[k].append((old, new))
    return pairs.sparkSession.sparkContext.broadcast({k: PairIndex(v) for k, v in lists.items()})


def _indexed(held):
    """Whether a paragraph's text holds a pair of its key; the runs of such a paragraph with the pairs in them, and how many."""
    @F.pandas_udf("boolean")
    def touched(texts: pd.Series, keys: pd.Series) -> pd.Series:
        of = held.value
        return pd.Series([text is not None and k in of and bool(of[k].found(text)) for text, k in zip(texts, keys, strict=True)], dtype=bool)

    @F.pandas_udf(REFILLED)
    def refilled(runs: pd.Series, keys: pd.Series) -> pd.DataFrame:
        of = held.value
        done = [(None, None) if rs is None else of[k].refill(list(rs)) for rs, k in zip(runs, keys, strict=True)]
        return pd.DataFrame({"runs": pd.Series([d[0] for d in done], dtype=object), "count": pd.Series([d[1] for d in done], dtype="Int64")})

    return touched, refilled


def attach_candidate_pairs(docs: DataFrame, pairs: DataFrame, key: str, text) -> DataFrame:
    """``attach_pairs`` with a key for rows whose text carries an anchor (as in J1) of one of its pairs; the other rows,
    in which no pair can begin to apply, get an empty list and need no pass over all pairs of their key."""
    from docfields.operators.locate import _line_anchors, ref_anchors

    real = pairs.where(F.length("old") > 0)
    anchors = ref_anchors(real.select(key, F.lit(0).alias("ref_id"), F.col("old").alias("ref")), [key])
    kinds = sorted(r["kind"] for r in anchors.select("kind").distinct().collect())  # five at most
    have = anchors.groupBy(key).agg(F.lit(1).alias("__any"), *[
        F.collect_set(F.when(F.col("kind") == k, F.col("anchor"))).alias(f"__a{i}") for i, k in enumerate(kinds)])
    plist = real.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("__all"))
    out = docs.withColumn("__text", text).join(plist, key, "left").join(have, key, "left")
    found = F.lit(False)
    for i, k in enumerate(kinds):
        found = found | F.coalesce(F.arrays_overlap(_line_anchors(F.col("__text"), k), F.col(f"__a{i}")), F.lit(False))
    empty = F.array().cast(plist.schema["__all"].dataType)
    return out.withColumn("pairs", F.when(found, F.coalesce("__all", empty)).otherwise(empty)).drop(
        "__text", "__all", "__any", *[f"__a{i}" for i in range(len(kinds))])


def last_write(edits: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Newest edit per (doc, table, row, col) wins."""
    keys = keys or ["doc_id", "table_index", "row", "col"]
    others = [c for c in edits.columns if c not in keys]
    agg = edits.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("w"))
    return agg.select(*keys, *[F.col(f"w.{c}").alias(c) for c in others])


def group_edits(edits: DataFrame) -> DataFrame:
    """A10: per (doc, table): the ordered edit list (row, col, old, new) -- D7 keys by
    (doc_id, table_index)."""
    return edits.groupBy("doc_id", "table_index").agg(
        F.array_sort(F.collect_list(F.struct("seq", "row", "col", "old_value", "new_value"))).alias("edits"))


def apply_cell_edits(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply ordered edits to table cells.

    cells: (doc_id, table_index, row, col, paras ARRAY<STRING>); edits: (doc_id,
    table_index, row, col, old_value, new_value, seq).  An edit only reaches an existing
    cell (bounds check by the equi-join; negative or missing coordinates never match).
    With old_value: replace its occurrences in every paragraph (applied when any
    changed); empty old text appends the new value as a paragraph (D10).  Without
    old_value: the first paragraph becomes new_value, later ones are blanked (applied
    unless both are empty); a cell without paragraphs gets one.
    Returns cells with new ``paras`` and ``n_applied``; plus (edits not applied) via
    ``edit_outcomes``.
    """
    key = ["doc_id", "table_index", "row", "col"]
    per_cell = edits.groupBy(*key).agg(F.array_sort(F.collect_list(
        F.struct("seq", "old_value", "new_value"))).alias("log"))
    j = cells.join(per_cell, key, "left")

    def step(st, e):
        ps = st["paras"]
        old, new = e["old_value"], F.coalesce(e["new_value"], F.lit(""))
        has_old = old.isNotNull()
        empty_old = has_old & (F.length(old) == 0)
        hit = has_old & (F.length(old) > 0) & F.exists(ps, lambda p: p.contains(old))
        replaced = F.transform(ps, lambda p: F.replace(p, old, new))
        first = F.get(ps, 0)
        set_ok = (F.size(ps) == 0) | (F.length(F.coalesce(first, F.lit(""))) > 0) | (F.length(new) > 0)
        set_paras = F.when(F.size(ps) == 0, F.array(new)).otherwise(
            F.transform(ps, lambda p, i: F.when(i == 0, new).otherwise(F.lit(""))))
        new_ps = (F.when(hit, replaced)
                  .when(empty_old & (F.length(new) > 0), F.concat(ps, F.array(new)))
                  .when(~has_old & set_ok, set_paras)
                  .otherwise(ps))
        applied = hit | (empty_old & (F.length(new) > 0)) | (~has_old & set_ok)
        return F.struct(new_ps.alias("paras"), (st["n"] + applied.cast("int")).alias("n"))

    init = F.struct(F.col("paras").alias("paras"), F.lit(0).alias("n"))
    st = F.when(F.col("log").isNull(), init).otherwise(F.aggregate("log", init, step))
    others = [c for c in cells.columns if c not in (*key, "paras")]
    return j.select(*key, *others, st.alias("st")).select(
        *key, *others, F.col("st.paras").alias("paras"), F.col("st.n").cast("bigint").alias("n_applied"))


def preview_overlay(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Original grid with the newest new value put over in-range cells."""
    key = ["doc_id", "table_index", "row", "col"]
    lw = last_write(edits.select(*key, "new_value", "seq"))
    j = cells.join(lw, key, "left")
    return j.withColumn("shown", F.coalesce("new_value", "display")).drop("new_value", "seq")

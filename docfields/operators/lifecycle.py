"""Table lifecycle: S1, S2, S5, S8, S10, M1-M10, J8, P6, X9-X11, W3, A4, A5.

Mutations are pure functions ``base, changes -> new DataFrame`` (set-based: anti
joins, unions, outer joins); writing is a separate overwrite / append step, or
MERGE INTO where the catalog supports it.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions import text as T

# Default model per provider when a key row names none (fixed values).
DEFAULT_MODEL_BY_PROVIDER = {
    "openai": "gpt-4.1-mini",
    "gemini": "gemini-2.0-flash",
    "groq": "llama-3.3-70b-versatile",
}
FALLBACK_MODEL = "gpt-4.1-mini"
TTL_SERVER = 3600
TTL_BROWSER = 24 * 3600


# ----------------------------------------------------------------------------- scans / sinks
def scan_workspaces(ws: DataFrame) -> DataFrame:
    """All workspaces, newest first."""
    return ws.select("workspace_id", "name", "description", "created_at", "event_date").orderBy(
        F.col("created_at").desc(), "workspace_id")


def scan_documents(docs: DataFrame, workspace_id: str | None = None) -> DataFrame:
    """All documents, or those of one workspace (predicate pushed to the scan)."""
    return docs if workspace_id is None else docs.where(F.col("workspace_id") == workspace_id)


def lookup(df: DataFrame, key: str, value, cols: list[str], single: bool = False) -> DataFrame:
    """Projection of the row with ``key == value``; ``single`` raises unless exactly one."""
    out = df.where(F.col(key) == F.lit(value)).select(*cols)
    if single:
        n = out.count()
        if n != 1:
            raise ValueError(f"expected exactly one row for {key}={value!r}, got {n}")
    return out


def write_documents(docs: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Every document after edits, partitioned by workspace, named as the original."""
    docs.write.mode("overwrite").partitionBy("workspace_id").format(fmt).options(**options).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add immutable rows (audit log).  Each call adds files; none is ever rewritten."""
    df.write.mode("append").format(fmt).save(path)


# ----------------------------------------------------------------------------- mutations
def upsert(base: DataFrame, changes: DataFrame, key: list[str], seq: str | None = None) -> DataFrame:
    """M1: insert or replace whole rows; changes de-duplicated by last write."""
    if seq:
        w = Window.partitionBy(*key).orderBy(F.col(seq).desc())
        changes = changes.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", seq)
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes.select(*base.columns))


def upsert_partial(base: DataFrame, changes: DataFrame, key: list[str], cols: list[str],
                   reset_when: str | None = None, reset: dict | None = None) -> DataFrame:
    """M2: only supplied (non-null) columns change; others keep old values; when
    ``reset_when`` is supplied the ``reset`` columns take the given values."""
    c = changes.select(*key, *[F.col(x).alias(f"__n_{x}") for x in cols])
    j = base.join(c, key, "full_outer")
    out = []
    for x in base.columns:
        if x in key:
            out.append(F.col(x))
        elif x in cols:
            out.append(F.coalesce(F.col(f"__n_{x}"), F.col(x)).alias(x))
        elif reset and x in reset and reset_when:
            out.append(F.when(F.col(f"__n_{reset_when}").isNotNull(), F.lit(reset[x])).otherwise(F.col(x)).alias(x))
        else:
            out.append(F.col(x))
    return j.select(*out)


def update_where(base: DataFrame, cond: Column, sets: dict) -> DataFrame:
    """M3: set columns on matching rows."""
    return base.withColumns({k: F.when(cond, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k))
                             for k, v in sets.items()})


def delete_cascade(ws: DataFrame, docs: DataFrame, ids: DataFrame, key: str = "workspace_id"):
    """M4: delete workspaces and their documents (two anti joins)."""
    return ws.join(ids.select(key), key, "left_anti"), docs.join(ids.select(key), key, "left_anti")


def delete_workspace_docs(docs: DataFrame, ids: DataFrame, key: str = "workspace_id"):
    """M5: survivors, deleted count per workspace, and the distinct file paths to remove."""
    gone = docs.join(ids.select(key), key, "left_semi")
    survivors = docs.join(ids.select(key), key, "left_anti")
    counts = gone.groupBy(key).agg(F.count(F.lit(1)).alias("deleted"))
    paths = gone.select(F.explode(F.array("original_path", "template_path")).alias("path")) \
        .where(F.col("path").isNotNull()).distinct()
    return survivors, counts, paths


def filter_uploads(batch: DataFrame, docs: DataFrame) -> DataFrame:
    """M6: keep names that end in '.docx' (as written) and are not already in the workspace (first of equal names in
    the batch wins, D12); duplicates report the existing document id."""
    b = batch.where(F.col("name").endswith(".docx"))
    w = Window.partitionBy("workspace_id", "name").orderBy("seq")
    b = b.withColumn("__rn", F.row_number().over(w))
    existing = docs.select("workspace_id", "name", F.col("doc_id").alias("existing_id"))
    existing = existing.groupBy("workspace_id", "name").agg(F.min("existing_id").alias("existing_id"))
    j = b.join(existing, ["workspace_id", "name"], "left")
    return j.select("workspace_id", "name", "seq", "existing_id",
                    F.when(F.col("existing_id").isNotNull(), F.lit("duplicate"))
                    .when(F.col("__rn") > 1, F.lit("duplicate_in_batch")).otherwise(F.lit("upload")).alias("action"))


def replace_config(base: DataFrame, rows: DataFrame, user_col: str = "user_id") -> DataFrame:
    """M7: a user's new ordered list replaces all of the user's old rows (an empty list leaves
    none); order = position.  Other users keep theirs.
    base: (user_id, name, description, order); rows: (user_id, cols ARRAY<STRUCT<name, description>>)."""
    new = rows.select(user_col, F.posexplode("cols").alias("order", "c")).select(
        user_col, F.col("c.name").alias("name"), F.col("c.description").alias("description"), "order")
    return base.join(rows.select(user_col), user_col, "left_anti").unionByName(new.select(*base.columns))


STATUS_BY_OUTCOME = (("ok", "ready"), ("failed", "failed"), ("error", "error"), ("no_config", "not_configured"))


def resolve_status(log: DataFrame) -> DataFrame:
    """M8: latest upload outcome per document -> status (pending when none)."""
    last = log.groupBy("doc_id").agg(F.max_by("outcome", F.struct("ts", "seq")).alias("outcome"))
    st = F.lit("pending")
    for o, s in reversed(STATUS_BY_OUTCOME):
        st = F.when(F.col("outcome") == o, F.lit(s)).otherwise(st)
    return last.select("doc_id", st.alias("status"))


def migrate_summary(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """M9: per user, moved and failed counts among documents having a remote id."""
    j = docs.where(F.col("remote_id").isNotNull()).join(outcomes, "doc_id", "left")
    return j.groupBy("user_id").agg(F.count_if(F.col("moved")).alias("moved"),
                                    F.count_if(~F.coalesce(F.col("moved"), F.lit(False))).alias("failed"))


def classify_changes(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """M10: 'created' when the key is absent from base, 'rotated' when present."""
    b = base.select(*key).distinct().withColumn("__present", F.lit(True))
    j = changes.join(b, key, "left")
    return j.withColumn("action", F.when(F.col("__present"), F.lit("rotated")).otherwise(F.lit("created"))).drop("__present")


def revoke(keys: DataFrame, user_id, provider: str, key: str = "user_id") -> DataFrame:
    """The user's key rows of a provider become 'revoked'; no such row is an error."""
    hit = (F.col(key) == F.lit(user_id)) & (F.col("provider") == provider)
    if keys.where(hit).isEmpty():
        raise ValueError(f"no key of {user_id!r} for {provider!r}")
    return update_where(keys, hit, {"status": "revoked"})


# ----------------------------------------------------------------------------- caches, hashing
def fingerprint(docs: DataFrame, group: str = "workspace_id", order: str = "doc_id", instructions: str = "",
                prefix_chars: int | None = None, paths_col: str | None = None) -> DataFrame:
    """SHA-256 over ``name:text`` of each document in order, ``docx:path`` of each attached
    path and ``user_instructions:`` with the trimmed instructions, joined without separators.
    Whole texts and instructions by default (D6); ``prefix_chars`` cuts the texts.

    A group's parts stream through one digest in order, batch by batch, so no row holds the texts of a group; only
    its paths are kept until its end."""
    import hashlib

    txt = F.col("text") if prefix_chars is None else F.substring("text", 1, prefix_chars)
    part = F.concat(F.col("name"), F.lit(":"), F.coalesce(txt, F.lit("")))
    path = F.concat(F.lit("docx:"), F.col(paths_col)) if paths_col else F.lit("")
    tail = ("user_instructions:" + instructions.strip()).encode()

    def digests(frames):
        key, digest, paths = None, None, []

        def close():
            digest.update("".join(paths).encode() + tail)
            return pd.DataFrame({"g": [key], "fingerprint": [digest.hexdigest()]})
        for frame in frames:
            for g, p, q in zip(frame["g"], frame["p"], frame["q"]):
                if digest is None or g != key:
                    if digest is not None:
                        yield close()
                    key, digest, paths = g, hashlib.sha256(), []
                digest.update(p.encode())
                paths.append(q)
        if digest is not None:
            yield close()
    rows = docs.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(part, F.lit("")).alias("p"),
                                                       F.coalesce(path, F.lit("")).alias("q"))
    kind = rows.schema["g"].dataType.simpleString()
    ordered = rows.repartition("g").sortWithinPartitions("g", "o", "p", "q").select("g", "p", "q")
    return ordered.mapInPandas(digests, f"g {kind}, fingerprint string").withColumnRenamed("g", group)


def doc_fingerprint(name: Column, text: Column) -> Column:
    """X9 for a single document input."""
    return F.sha2(F.concat(name, F.lit(":"), F.coalesce(text, F.lit("")), F.lit("user_instructions:")), 256)


def fresh(df: DataFrame, as_of: str, ttl_seconds: int = TTL_SERVER, ts: str = "stored_at") -> DataFrame:
    """Entries with ``as_of - stored_at < ttl`` (explicit clock); the filter reaches the scan."""
    oldest = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return df.where(F.col(ts).cast("timestamp") > oldest)


def split_cached(inputs: DataFrame, results: DataFrame, as_of: str, ttl_seconds: int = TTL_SERVER):
    """Inputs whose fingerprint has a fresh stored result take it (cache_hit), the
    rest go to processing.  Returns (hits with payload, misses)."""
    fr = fresh(results, as_of, ttl_seconds)
    latest = fr.groupBy("fingerprint").agg(F.max_by("payload", "stored_at").alias("payload"))
    hits = inputs.join(latest, "fingerprint", "inner").withColumn("cache_hit", F.lit(True))
    misses = inputs.join(latest.select("fingerprint"), "fingerprint", "left_anti")
    return hits, misses


def short_hash(c) -> Column:
    """First 16 hex characters of SHA-256."""
    return F.substring(F.sha2(F.col(c) if isinstance(c, str) else c, 256), 1, 16)


def encrypt(c, key: str) -> Column:
    """X11: AES-256-GCM, base64(nonce 12 || ciphertext || tag); blank input -> error."""
    col = F.col(c) if isinstance(c, str) else c
    ok = F.length(T.py_strip(col)) > 0
    return F.when(ok, F.base64(F.aes_encrypt(col, F.lit(key), F.lit("GCM")))).otherwise(
        F.raise_error(F.lit("cannot encrypt a blank value")))


def decrypt(c, key: str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.aes_decrypt(F.unbase64(col), F.lit(key), F.lit("GCM")).cast("string")


def latest_active(keys: DataFrame, user: str = "user_id") -> DataFrame:
    """Per user the active row by last_used_at desc, then created_at desc, nulls
    first on desc (Postgres default); model defaults by provider when null."""
    w = Window.partitionBy(user).orderBy(F.col("last_used_at").desc_nulls_first(), F.col("created_at").desc_nulls_first())
    m = F.create_map(*[x for kv in DEFAULT_MODEL_BY_PROVIDER.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    a = keys.where(F.col("status") == "active").withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    return a.select(user, "provider", F.coalesce(F.col("model"), F.element_at(m, F.col("provider")),
                                                 F.lit(FALLBACK_MODEL)).alias("model"))


# ----------------------------------------------------------------------------- usage
def usage_summary(calls: DataFrame, key: str = "run_id") -> DataFrame:
    """A4: calls, input, output, total tokens and floor averages per run (D3)."""
    g = calls.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("prompt_chars").alias("prompt_chars"))
    return g.select(key, "calls", "input_tokens", "output_tokens",
                    (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "prompt_chars",
                    F.expr("input_tokens div calls").alias("avg_input_tokens"),
                    F.expr("output_tokens div calls").alias("avg_output_tokens"))


def cost(summary: DataFrame, in_price: float = 0.0, out_price: float = 0.0) -> DataFrame:
    """A5: tokens x price (per million tokens), only when calls > 0."""
    c = (F.col("input_tokens") * in_price + F.col("output_tokens") * out_price) / 1_000_000
    return summary.withColumn("cost", F.when(F.col("calls") > 0, F.round(c, 6)))

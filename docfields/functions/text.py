"""Scalar text functions (Column -> Column), all JVM-side Spark SQL expressions.

IDs follow SURVEY section 2.9 (X*) and S4.  No Python UDF is used here: every
helper composes built-in expressions so it stays inside whole-stage codegen
(higher-order functions fall back to interpreted evaluation but still run in
the JVM, per row, without a Python round trip).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour (kept together, in order).
# Whitespace removed by Python's str.strip(): Unicode White_Space.
WS_CLASS = r"[\s\x0B\x{85}\p{Z}]"
# Markdown image link removed during clean-up.
IMAGE_LINK = r"!\[[^\]]*]\([^)]*\)"
# Line-type markers, checked in this order: table row, header, list item, blockquote.
HEADER_RE = r"^#{1,6}" + WS_CLASS
# Punctuation folding: left curly double quote, right curly double quote, left single
# quote, right single quote, en dash, em dash, no-break space, ellipsis.
FOLD_FROM = "“”‘’–— …"
FOLD_TO = "\"\"''-- ."
# Shortening lengths used for hints (220) and labels (25), with suffix "...".
SHORT_HINT = 220
SHORT_LABEL = 25
# Separator between head and tail when a text has no query keywords.
HEAD_TAIL_MARK = "\n\n[...truncated for context window...]\n\n"
# Separator between packed chunks.
PACK_MARK = "\n\n[...relevant extracted context...]\n\n"
# Keyword token pattern (lower-cased text, length > 2).
KEYWORD_RE = r"[a-zA-Z0-9_]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body) -> Column:
    """``body(x)`` with ``value`` evaluated once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def running_starts(lengths) -> Column:
    """Sum of the earlier lengths at each position of an array<int>.

    Appending to an array copies it, so a plain fold costs the square of the length.  Here
    blocks of about sqrt(n) elements are folded one by one and shifted by the sums of the
    blocks before them: 100,000 lines cost two folds of some 316 steps a block."""
    def fold(a):
        init = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(a, init, lambda acc, n: F.struct(
            (acc["s"] + n).cast("int").alias("s"), F.array_append(acc["a"], acc["s"]).alias("a")))

    def blocked(a):
        step = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        firsts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), step)
        folded = F.transform(firsts, lambda i: fold(F.slice(a, i, step)))
        return bind(folded, lambda b: bind(fold(F.transform(b, lambda x: x["s"]))["a"], lambda base: F.flatten(
            F.transform(b, lambda x, i: F.transform(x["a"], lambda v: v + base[i])))))

    return bind(_c(lengths), blocked)


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(c), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def clean_markdown(c) -> Column:
    """Drop image links, squeeze 3+ newlines to 2, strip the ends."""
    no_img = F.regexp_replace(_c(c), IMAGE_LINK, "")
    return py_strip(F.regexp_replace(no_img, r"\n{3,}", "\n\n"))


def line_type(line) -> Column:
    """Markdown line type of one line (order of checks matters)."""
    line = _c(line)
    stripped = py_strip(line)
    return (
        F.when(stripped.startswith("|"), F.lit("table_row"))
        .when(line.rlike(HEADER_RE), F.lit("header"))
        .when(stripped.startswith("- ") | stripped.startswith("* "), F.lit("list_item"))
        .when(stripped.startswith(">"), F.lit("blockquote"))
        .otherwise(F.lit("paragraph"))
    )


def fold_punctuation(c) -> Column:
    """Curly quotes, dashes, no-break space and ellipsis to ASCII."""
    return F.translate(_c(c), FOLD_FROM, FOLD_TO)


def normalize_key(c) -> Column:
    """Lower, space and '-' to '_'."""
    return F.translate(F.lower(_c(c)), " -", "__")


def new_field_key(c) -> Column:
    """X3 create-field form: lower, whitespace runs to '_'."""
    return F.regexp_replace(F.lower(_c(c)), r"\s+", "_")


def label_from_key(c) -> Column:
    """X4: '_' -> space, then title case (initcap; see D8)."""
    return F.initcap(F.replace(_c(c), F.lit("_"), F.lit(" ")))


def display_key(c) -> Column:
    """X4 display form: only '_' -> space."""
    return F.replace(_c(c), F.lit("_"), F.lit(" "))


def safe_filename(c) -> Column:
    """Every char that is not a letter, digit, '.', '-' or '_' becomes '_'."""
    return F.regexp_replace(_c(c), r"[^\p{L}\p{N}._-]", "_")


def storage_path(user_id, workspace_id, doc_id, name) -> Column:
    """user/workspace/doc/safe_name."""
    return F.concat_ws("/", _c(user_id), _c(workspace_id), _c(doc_id).cast("string"), safe_filename(name))


def template_path(original_path, workspace_id, doc_id, name) -> Column:
    """X6 template variant: first segment of the original path, then '_template'."""
    first = F.split_part(_c(original_path), F.lit("/"), F.lit(1))
    return F.concat(
        F.concat_ws("/", first, _c(workspace_id), _c(doc_id).cast("string"), safe_filename(name)),
        F.lit("_template"),
    )


def folder_id(c) -> Column:
    """Id after 'folders/' else the stripped input."""
    m = F.regexp_extract(_c(c), r"folders/([a-zA-Z0-9_-]+)", 1)
    return F.when(m != "", m).otherwise(py_strip(c))


def token_estimate(c) -> Column:
    """Fallback token count ``len // 4 + 1``."""
    return (F.floor(F.length(_c(c)) / 4) + 1).cast("bigint")


def token_count(c, load: Callable[[], Callable[[list[str]], list[int]]]) -> Column:
    """X8 with a caller's tokenizer.  ``load`` is called once a task and returns a function from texts to token
    counts (an Arrow batch at a time); where it cannot be loaded, raises, or the count is missing, the estimate of
    ``token_estimate`` stands in.  A null text has no count."""
    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # noqa: BLE001 - no tokenizer: the estimate counts
            model = None
        for texts in batches:
            known = texts.notna()
            out = pd.Series([None] * len(texts), dtype="Int64", index=texts.index)
            try:
                if model is not None:
                    out[known] = model(texts[known].tolist())
            except Exception:  # noqa: BLE001
                out[:] = None
            yield out
    return F.coalesce(counts(_c(c)), token_estimate(c))


def keyword_tokens(c) -> Column:
    """Distinct lower-case [a-zA-Z0-9_]+ tokens longer than 2 (first-seen order)."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(KEYWORD_RE), 0)
    return F.array_distinct(F.filter(toks, lambda t: F.length(t) > 2))


def keyword_overlap(a, b) -> Column:
    """Size of the token-set intersection."""
    return F.size(F.array_intersect(_c(a), _c(b)))


def normalize_name(c) -> Column:
    """Lower, non-alphanumerics to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"[^a-z0-9]+", " "))


def json_object_text(c) -> Column:
    """First '{' to last '}'; NULL when absent."""
    m = F.regexp_extract(_c(c), r"(?s)\{.*\}", 0)
    return F.when(m != "", m)


def report_date(event_date, created_at) -> Column:
    """event_date else created_at as text; 10-char text kept; ISO text -> its
    first 10 characters (own offset, D9); unparsable -> raw text; NULL -> ''."""
    raw = F.coalesce(_c(event_date).cast("string"), _c(created_at).cast("string"))
    iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    return (
        F.when(raw.isNull(), F.lit(""))
        .when(F.length(raw) == 10, raw)
        .when(iso, F.substring(raw, 1, 10))
        .otherwise(raw)
    )


def shorten(c, n: int = SHORT_HINT) -> Column:
    """Longer than n -> first n characters + '...'."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def head_tail(c, budget: int = 8000) -> Column:
    """Text within budget unchanged, else first half + marker + last half."""
    c = _c(c)
    half = budget // 2
    return F.when(F.length(c) <= budget, c).otherwise(
        F.concat(F.substring(c, 1, half), F.lit(HEAD_TAIL_MARK), F.substring(c, -half, half))
    )


def chunk_starts(length_col, size: int = 1800, overlap: int = 250) -> Column:
    """X19 chunk start offsets (0-based).  Windows of ``size``; next start is
    ``max(end - overlap, start + 1)``, i.e. a fixed step ``max(size - overlap, 1)``
    while a window ends before the text end; count = 1 + ceil((len - size) / step)."""
    n = _c(length_col)
    step = max(size - overlap, 1)
    count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), ((count - 1) * step).cast("int"), F.lit(step))
    )


def chunks(c, size: int = 1800, overlap: int = 250) -> Column:
    """The overlapping chunks of a text as an array."""
    c = _c(c)
    return F.transform(chunk_starts(F.length(c), size, overlap), lambda s: F.substring(c, s + 1, size))


def replace_all(text, pairs) -> Column:
    """Apply ordered (old, new) pairs, each to the result of the last.
    ``pairs`` is an array<struct<old,new>> already sorted by seq; empty old is a no-op."""
    return F.aggregate(
        _c(pairs), _c(text),
        lambda t, p: F.when(F.coalesce(F.length(p["old"]), F.lit(0)) == 0, t)
        .otherwise(F.replace(t, p["old"], F.coalesce(p["new"], F.lit("")))),
    )


def regex_quote(c) -> Column:
    r"""Quote a literal for Java regex: every char that is not a letter, digit or
    whitespace gets a backslash (safe inside and outside classes)."""
    return F.regexp_replace(_c(c), r"([^\p{L}\p{N}\s])", r"\\$1")


def replacement_quote(c) -> Column:
    """Escape '\\' and '$' of a regex replacement string."""
    return F.regexp_replace(_c(c), r"([\\$])", r"\\$1")


def replace_ci(text, old, new) -> Column:
    """Case-insensitive, left to right, non-overlapping; other text keeps its case."""
    pattern = F.concat(F.lit("(?iu)"), regex_quote(old))
    return F.when(F.coalesce(F.length(_c(old)), F.lit(0)) == 0, _c(text)).otherwise(
        F.regexp_replace(_c(text), pattern, replacement_quote(new))
    )


def count_nonoverlapping(text, old) -> Column:
    """Python ``str.count`` (non-overlapping occurrences)."""
    text, old = _c(text), _c(old)
    return F.when(F.coalesce(F.length(old), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.floor((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old))
    ).cast("bigint")


def html_escape(c) -> Column:
    """X26: '&', '<', '>' in that order."""
    c = _c(c)
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def cell_text(paras) -> Column:
    """Strip each paragraph, drop blank ones, join by newline."""
    return F.array_join(F.filter(F.transform(_c(paras), lambda p: py_strip(p)), lambda p: p != ""), "\n")


def list_to_cell(c) -> Column:
    """List values joined by ', '."""
    return F.array_join(_c(c), ", ")


def multipart_text(json_col) -> Column:
    """A JSON string -> itself; a JSON array -> its string items, objects give
    ``text`` else ``content`` when that is a string; other items dropped; joined
    without separator.  Uses the VARIANT type so strings and numbers stay apart."""
    v = F.try_parse_json(_c(json_col))
    kind = F.schema_of_variant(v)
    arr = F.try_variant_get(v, "$", "array<variant>")

    def is_str(x):
        return F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))

    def part(x):
        t = F.try_variant_get(x, "$.text", "variant")
        c = F.try_variant_get(x, "$.content", "variant")
        return (F.when(is_str(x), F.variant_get(x, "$", "string"))
                .when(F.schema_of_variant(x).startswith("OBJECT"),
                      F.when(is_str(t), F.variant_get(t, "$", "string"))
                      .when(is_str(c), F.variant_get(c, "$", "string"))))

    return (F.when(arr.isNotNull(), F.array_join(F.transform(arr, part), ""))
            .when(kind == "STRING", F.variant_get(v, "$", "string"))
            .otherwise(F.lit("")))


def mention_query(c) -> Column:
    """Text after a trailing '@' at start or after whitespace; NULL when none."""
    c = _c(c)
    return F.when(c.rlike(r"(?:^|\s)@([^\s@]*)$"), F.regexp_extract(c, r"(?:^|\s)@([^\s@]*)$", 1))


def strip_mention(c) -> Column:
    """Selecting a workspace removes the trailing mention, squeezes whitespace and trims the start."""
    no_mention = F.regexp_replace(_c(c), r"(?:^|\s)@([^\s@]*)$", " ")
    return F.ltrim(F.regexp_replace(no_mention, r"\s+", " "))

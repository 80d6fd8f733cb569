"""Text expressions: tokens, previews, and parsing of model responses."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A tokeniser's separators: everything but letters and numbers.
SEPARATORS = r"[^\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters below the marks, from Unicode's own decomposition."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            found[chr(code)] = plain
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _accents()


def tokens(text: Column) -> Column:
    """Lower-case tokens without diacritics; null for null. A run of letters without spaces is one token."""
    folded = F.lower(F.translate(text, ACCENTED, PLAIN))
    return F.filter(F.split(folded, SEPARATORS), lambda t: t != "")


#: ASCII letters in lower case and digits; all else is a space.
_ASCII = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def with_tokens(rows: DataFrame, text: Column) -> DataFrame:
    """Add what token_lists() makes tokens of, as the last two columns: an ASCII text as it is, else its tokens."""
    plain = F.octet_length(text) == F.length(text)
    return rows.select("*", F.when(plain, F.encode(text, "UTF-8")).alias("plain__"), F.when(~plain, tokens(text)).alias("tokens__"))


def token_lists(batch: pa.RecordBatch) -> pa.ListArray:
    """tokens() of each row of with_tokens(). An ASCII text is cut here, byte by byte from a table."""
    plain, found = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
    cut = pa.array([None if t is None else t.translate(_ASCII).split() for t in plain], pa.list_(pa.binary()))
    if not cut.null_count:
        return cut.cast(pa.list_(pa.string()))
    both = pa.concat_arrays([cut.cast(found.type), found])
    n = len(cut)
    return both.take(pa.array([i if t is not None else n + i for i, t in enumerate(plain)], pa.int64()))


def preview(text: Column, n: int) -> Column:
    """The first n characters on one line, with dots when there is more."""
    return F.concat(F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" ")), F.when(F.length(text) > n, "...").otherwise(""))


def file_name(source_path: Column, title: Column) -> Column:
    """Base name of the path, else the title, else `untitled`."""
    base = F.substring_index(source_path, "/", -1)
    return F.coalesce(F.when(base != "", base), F.when(title != "", title), F.lit("untitled"))


def file_type(source_path: Column) -> Column:
    """Lower-case suffix without its dot, or `unknown`."""
    suffix = F.lower(F.regexp_extract(F.coalesce(source_path, F.lit("")), r"\.([^./]+)$", 1))
    return F.when(suffix != "", suffix).otherwise("unknown")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unfenced(raw: Column) -> Column:
    """A response without code fences: only if it begins with one, all lines that begin with one go."""
    text = strip(raw)
    inner = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith("```")), "\n")
    return F.when(text.startswith("```"), strip(inner)).otherwise(text)


def parse_strings(raw: Column) -> Column:
    """A JSON array of strings, each stripped, blank ones dropped; an empty array for anything else.

    Spark turns numbers into strings on the way, so elements are read as they stand and must be quoted.
    """
    text = unfenced(raw)
    items = F.from_json(text, "array<string>")
    quoted = F.size(F.filter(F.from_json(text, "array<variant>"), lambda v: F.schema_of_variant(v) != "STRING")) == 0
    good = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.when(F.coalesce(quoted, F.lit(False)), good).otherwise(F.array().cast("array<string>"))


def parse_queries(raw: Column) -> Column:
    """A JSON array of {query, query_type}: blank queries dropped, the type `factual` by default; null if it can't be read."""
    items = F.from_json(unfenced(raw), "array<struct<query:string,query_type:string>>")
    good = F.filter(items, lambda x: F.coalesce(strip(x["query"]), F.lit("")) != "")
    return F.transform(good, lambda x: F.struct(strip(x["query"]).alias("query"), F.coalesce(x["query_type"], F.lit("factual")).alias("query_type")))

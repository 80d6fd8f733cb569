"""Cross-site boilerplate: lines that stand on many distinct sites.

A sketch of distinct sites is kept for each line hash; sketches merge by aggregation, in the map side first.
Lines whose estimate lies near the threshold get an exact count of distinct sites, and only then lines are
removed. The first occurrence of a removed line, by document id, stays, so that no passage leaves the corpus.

DataFrame functions only.

Cases: a null text stays null and has no lines; an empty one stays empty. Lines are compared without outer
spaces; those of fewer than `min_chars` characters are left alone. A null site is no site. Rows that repeat both
id and text are treated alike: if the first occurrence is theirs, each keeps it. An empty table gives an empty
table. All other columns pass through, and helper columns take names that the input doesn't have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.shared import fresh, written

MIN_SITES = 6
MIN_CHARS = 20
#: Base-2 logarithm of a sketch's registers. Small counts are held as a list and are exact.
REGISTERS = 10
#: Documents with removals up to which their line numbers are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Tasks that the rows of one line are dealt to beyond that.
SALTS = 64


def line_hash(line: Column) -> list[Column]:
    """96 bits of two hashes."""
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def site_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """A row for each line that counts: id, t (hash of the text), site, pos from 0, h1, h2."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.col(site_col).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)
    return rows.select("id", "t", "site", "pos", *line_hash(F.col("line")))


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines that may stand on min_sites sites: h1, h2, `near` (an exact count must decide) and the estimate.

    A line of fewer rows than min_sites can't reach it and is left out.
    """
    estimate = F.hll_sketch_estimate("sketch")
    band = max(2.0, 5 * 1.04 / 2 ** (REGISTERS / 2) * min_sites)
    sketches = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", REGISTERS).alias("sketch"))
    found = sketches.where(F.col("n") >= min_sites).select("h1", "h2", estimate.alias("sites"))
    return found.where(F.col("sites") >= min_sites - band).select("h1", "h2", "sites", (F.col("sites") <= min_sites + band).alias("near"))


def _met(lines: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    """Lines joined with a row for each of some hashes: by broadcast if these are few, else salted, so that the rows of
    one common line are dealt to SALTS tasks."""
    if few:
        return lines.join(F.broadcast(found), ["h1", "h2"])
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)))
    return salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))), ["h1", "h2", "salt"]).drop("salt")


def boilerplate(docs: DataFrame, min_sites: int, min_chars: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """Occurrences to remove: id, t and `drop`, the array of line numbers, for each document that has some."""
    lines = site_lines(docs, id_col, text_col, site_col, min_chars)
    wide = written(spread(lines, min_sites), "spread")
    few = wide.count() <= BROADCAST_ROWS
    places = written(_met(lines, wide, few), "places")
    exact = places.where("near").groupBy("h1", "h2", "site").count().groupBy("h1", "h2").agg(F.count("site").alias("n_sites"))
    sure = places.where("not near").groupBy("h1", "h2").agg(F.lit(min_sites).cast("long").alias("n_sites"))
    chosen = exact.unionByName(sure).where(F.col("n_sites") >= min_sites).select("h1", "h2")
    first = places.groupBy("h1", "h2").agg(F.min(F.struct("id", "t", "pos")).alias("first"))
    gone = _met(places, first.join(chosen, ["h1", "h2"], "left_semi"), few)
    return gone.where(F.struct("id", "t", "pos") != F.col("first")).groupBy("id", "t").agg(F.collect_set("pos").alias("drop"))


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", removed_col: str | None = None
) -> DataFrame:
    """docs with boilerplate lines taken out of text_col; removed_col, if named, gets how many."""
    gone = written(boilerplate(docs, min_sites, min_chars, id_col, text_col, site_col), "gone")
    i, t, drop, key, parts = (fresh(docs, x) for x in ("id__", "t__", "drop__", "key__", "parts__"))
    gone = gone.toDF(i, t, drop)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("shuffle_hash")
    text = F.col(text_col).cast("string")
    both = docs.withColumn(key, F.xxhash64(text)).join(gone, (F.col(id_col).eqNullSafe(F.col(i))) & (F.col(key) == F.col(t)), "left")
    both = both.withColumn(parts, F.when(F.col(drop).isNotNull(), F.split(text, "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop)  # by a hash table, not lines times removals
    cleaned = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(F.transform(left, lambda n: F.get(parts, n)), "\n"))
    out = [cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return both.select(*out, *([F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(removed_col)] if removed_col else []))

"""Quality score by a sparse ensemble of rules.

Statistics of a text are Spark columns. A random forest over them is grown on the labelled rows; every path from a
root to a node is a conjunction of comparisons, a rule. Lasso logistic regression over the rules keeps a few of
them, and these are compiled into one Spark column expression, so scoring needs no model at all.

Cases: null and empty texts have statistics of 0 and a score as any other. Without labelled rows of both kinds
the score is the smoothed base rate, 0.5 for none. Repeated rows, and several labels of one id, count each. A null
id has no label. Only the named columns are used; helper columns take names that the input doesn't have.
"""

from __future__ import annotations

import json
import math
import re
import sys
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.shared import fresh, written

THRESHOLD = 0.3
TREES = 24
DEPTH = 3
LASSO = 0.002
#: Rows that a rule must hold for, as a share of the labelled ones, from below and above.
SUPPORT = (0.002, 0.998)
FOLDS = 5
#: Labelled rows that a model is fitted on, about, chosen by a hash of the id. The bound of the sample.
FIT_ROWS = 50_000


def word_array(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _chars(text: Column, of: str) -> Column:
    """Characters of a class, which a regular expression counts in half the time of translate()."""
    return F.regexp_count(text, F.lit(of))


STATISTICS = (
    "log_words", "mean_word", "symbol_share", "mark_share", "upper_share", "digit_share", "bar_share", "comma_share",
    "distinct_share", "echo_share", "distinct_lines", "words_a_line", "open_class", "ends_open",
)


def statistics(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """docs with `out`, a struct of STATISTICS, all doubles. They are computed once for a row: what explode() gives isn't
    computed anew where a filter or a score uses it."""
    t, w, n = fresh(docs, "text__"), fresh(docs, "words__"), fresh(docs, "n__")
    docs_in = docs.columns
    step = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    step = step.withColumn(w, word_array(F.col(t)))
    step = step.withColumn(n, F.greatest(F.size(w), F.lit(1)))
    text, words, count = F.col(t), F.col(w), F.col(n)
    chars = F.greatest(F.length(text), F.lit(1))
    rows = F.size(F.split(text, "\n", -1))
    echo = F.size(F.filter(F.zip_with(words, F.slice(words, 2, count), lambda a, b: a == b), lambda x: x))
    values = {
        "log_words": F.log1p(F.size(words)),
        "mean_word": (chars - _chars(text, r"[ \n\t\r]")) / count,
        "symbol_share": _chars(text, "[#*$%&<>]") / count,
        "mark_share": _chars(text, "!") / count,
        "upper_share": _chars(text, "[A-Z]") / chars,
        "digit_share": _chars(text, "[0-9]") / chars,
        "bar_share": _chars(text, "[|]") / count,
        "comma_share": _chars(text, "[,.]") / count,
        "distinct_share": F.size(F.array_distinct(words)) / count,
        "echo_share": echo / count,
        "distinct_lines": F.size(F.array_distinct(F.split(text, "\n", -1))) / rows,
        "words_a_line": count / rows,
        "open_class": F.size(F.filter(words, lambda x: F.length(x) <= 3)) / count,
        "ends_open": F.when(F.trim(text).rlike(r"[.!?]\s*$"), 0.0).otherwise(1.0),
    }
    return step.select(*docs_in, F.explode(F.array(F.struct(*(values[k].cast("double").alias(k) for k in STATISTICS)))).alias(out))


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: for a statistic, low < value <= high."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, stats: Column) -> Column:
        parts = []
        for name, low, high in self.bounds:
            value = stats.getField(name)
            parts += [value > low] * (low > -math.inf) + [value <= high] * (high < math.inf)
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class RuleModel:
    """An intercept and weighted rules."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as a column expression over a struct of statistics."""
        total = reduce(lambda s, r: s + F.when(r[0].column(stats), r[1]).otherwise(0.0), self.rules, F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def tree_rules(debug: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The paths of every tree in a forest's printed form, merged into one interval for each statistic."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, str, str, float]] = []
    for line in debug.split("\n"):
        m = re.match(r"( +)(?:If|Else) \(feature (\d+) (<=|>) (-?[\d.]+(?:E-?\d+)?)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, names[int(m[2])], m[3], float(m[4])))
        span: dict[str, tuple[float, float]] = {}
        for _, name, sign, at in path:
            low, high = span.get(name, (-math.inf, math.inf))
            span[name] = (low, min(high, at)) if sign == "<=" else (max(low, at), high)
        found[Rule(tuple((k, *span[k]) for k in sorted(span)))] = None
    return list(found)


def rule_hits(rules: list[Rule], values: Column) -> Column:
    """Whether each rule holds, an array of booleans, for an array of STATISTICS. The bounds are one literal, so hundreds
    of candidate rules make no larger plan and no more generated code than one."""
    most = sys.float_info.max  # the statistics are finite
    bounds = [[{"at": STATISTICS.index(k) + 1, "low": max(low, -most), "high": min(high, most)} for k, low, high in r.bounds] for r in rules]
    literal = F.from_json(F.lit(json.dumps(bounds)), "array<array<struct<at: int, low: double, high: double>>>")
    inside = lambda b: (F.element_at(values, b["at"]) > b["low"]) & (F.element_at(values, b["at"]) <= b["high"])
    return F.transform(literal, lambda rule: F.forall(rule, inside))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 11) -> RuleModel:
    """Fit on rows with `stats`, a struct of STATISTICS, and `label`, 0 or 1."""
    rows = rows.select("stats", F.col("label").cast("double").alias("label")).where("label in (0, 1)")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    base = (ones + 1) / (n + 2)
    prior = RuleModel(math.log(base / (1 - base)))
    if not 0 < ones < n:
        return prior
    table = written(rows.select("label", "stats", array_to_vector(F.array(*(F.col("stats").getField(k) for k in STATISTICS))).alias("features")), "labelled")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=1.0, featureSubsetStrategy="onethird", minInstancesPerNode=5, maxBins=64).fit(table)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return prior
    values = F.array(*(F.col("stats").getField(k) for k in STATISTICS))
    table = written(table.select("label", F.xxhash64("stats").alias("mark"), rule_hits(rules, values).alias("hits")), "rule-hits")
    # rules that hold for the same labelled rows are taken as one: they have the same number and sums of the rows' hashes
    mark = F.col("mark")
    sums = [F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit((1 << 30) - 1))).alias("s")]
    held = table.select("mark", F.posexplode("hits").alias("rule", "hit")).where("hit").groupBy("rule").agg(*sums).collect()
    seen: dict[object, int] = {}
    for r in sorted(held, key=lambda r: (len(rules[r["rule"]].bounds), r["rule"])):
        if SUPPORT[0] <= r["n"] / n <= SUPPORT[1]:
            seen.setdefault((r["n"], r["x"], r["s"]), r["rule"])
    if not seen:
        return prior
    hits = table.select("label", array_to_vector(F.transform("hits", lambda x: x.cast("double"))).alias("hits"))
    hits = VectorSlicer(inputCol="hits", outputCol="features", indices=list(seen.values())).transform(hits)
    rules = [rules[i] for i in seen.values()]
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=True, tol=1e-5).fit(hits)
    weights = model.coefficients.toArray()
    return RuleModel(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9))


def held_out(id_col: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def known_labels(labels: DataFrame, label_col: str = "quality", most: int = FIT_ROWS) -> DataFrame:
    """key__ and label of about `most` rows outside the held-out fold, or of all if they are fewer."""
    known = labels.select(F.col("doc_id").alias("key__"), F.col(label_col).alias("label")).where(~held_out(F.col("key__")) & F.col("label").isNotNull())
    share = math.ceil(1_000_000 * min(1.0, most / max(known.count(), 1)))
    return known.where(F.pmod(F.xxhash64("key__", F.lit(29)), F.lit(1_000_000)) < share)


def labelled(narrow: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Join rows (doc_id, stats) with the sample of labels, whose size is bounded."""
    return narrow.join(F.broadcast(known_labels(labels, label_col)), narrow["doc_id"] == F.col("key__")).select("stats", "label")


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted. Texts are read once; statistics are written as narrow rows."""
    narrow = written(statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "stats").select("doc_id", "stats"), "statistics")
    model = fit(labelled(narrow, labels, label_col))
    score = model.score(F.col("stats"))
    return narrow.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at the threshold or above, with their columns."""
    known = F.broadcast(known_labels(labels, label_col))
    texts = docs.join(known, docs[id_col] == F.col("key__")).select(F.col(text_col).alias("text"), "label")
    model = fit(written(statistics(texts, "text", "stats").select("stats", "label"), "statistics"))
    stats = fresh(docs, "stats__")
    return statistics(docs, text_col, stats).where(model.score(F.col(stats)) >= threshold).select(*docs.columns)

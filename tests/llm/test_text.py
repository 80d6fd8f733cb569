"""Quality rules, rule ensemble, toxicity grammar, queries, pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from oracle_check import assert_same, connect
from pyspark.sql import functions as F

from rillwork.llm import quality_classifier as qc
from rillwork.llm import queries as registered
from rillwork.llm import quality_rules as qr
from rillwork.llm import toxicity as tx

SF = "/root/testdata/sf0.001"


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_measures_by_definition():
    rng = random.Random(1)
    texts = [None, "", " \n ", "a b", "x y z\x0bq\x1cr", "same\nsame\nsame \n\n\n"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) + "\n#*$" for _ in range(200)] + ["a " * 3000]
    for t in texts:
        assert qr.measure(t)[:5] == plain_measures(t), t


def test_ledger_policies_and_ablation(spark, make_docs):
    good = " ".join(f"word{i} and more" for i in range(30)) + "."
    docs = make_docs([(1, good), (2, "few"), (3, None), (4, "one two three four five six seven eight nine " * 10), (5, " ".join(f"w{i}#$%&" for i in range(40))), (1, good)])
    rows = qr.rule_verdicts(docs)
    got = {r.doc_id: (r.base_failed, r.kept) for r in rows.collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, False)}
    ledger = qr.ledger(docs).collect()
    rules = qr.default_rules()
    names = qr.POLICIES[2]
    mask = qr.mask_of(names, rules)
    for r in qr.ablation(qr.ledger(docs), names).collect():
        bit = qr.mask_of([r.rule], rules)
        assert (r.n_failed, r.n_only) == (sum(bool(x.failures & bit) for x in ledger), sum(x.failures & mask == bit for x in ledger))
        assert (r.kept, r.kept_without) == (sum(not x.failures & mask for x in ledger), sum(not x.failures & mask & ~bit for x in ledger))
    assert qr.rule_verdicts(make_docs([])).count() == 0


def test_verdicts_of_odd_rows(spark, make_docs):
    pairs = [(None, "one two three"), (None, None), (4, "a b\x1cc " * 300_000), (5, ""), (5, ""), (6, "\n \t\n"), (7, "x" * 2_000_000), (7, "same id, another text")]
    rows = qr.rule_verdicts(make_docs(pairs).repartition(3)).collect()
    want = Counter((i, *plain_measures(t)) for i, t in pairs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("name,label,least", [("op1_quality_classifier", "quality", 0.95), ("op2_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    got = registered.queries()[name](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 500 and auc(held.score.to_numpy(), held[label].to_numpy()) > least
    assert got.score.between(0, 1).all()


def test_held_out_labels_are_not_read(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("toxic", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.fit(docs, x) for x in (labels, other))
    assert a.lexicon.stems == b.lexicon.stems and np.allclose(a.weights, b.weights)


def test_rules_are_intervals():
    debug = "Tree 0 (weight 1.0):\n  If (feature 0 <= 1.5)\n   If (feature 1 <= -2.0E-4)\n    Predict: 0.0\n   Else (feature 1 > -2.0E-4)\n    If (feature 0 <= 0.5)\n     Predict: 1.0\n    Else (feature 0 > 0.5)\n     Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    got = {r.bounds for r in qc.tree_rules(debug, ("a", "b"))}
    inf = float("inf")
    assert got == {(("a", -inf, 1.5),), (("a", -inf, 1.5), ("b", -inf, -2e-4)), (("a", -inf, 1.5), ("b", -2e-4, inf)), (("a", -inf, 0.5), ("b", -2e-4, inf)), (("a", 0.5, 1.5), ("b", -2e-4, inf)), (("a", 1.5, inf),)}


def test_compiled_rules_equal_plain_ones(spark, make_docs):
    rule = qc.Rule((("log_words", 0.5, 3.0), ("upper_share", float("-inf"), 0.5)))
    model = qc.RuleModel(-1.0, ((rule, 2.5),))
    docs = qc.statistics(make_docs([(1, "some words here"), (2, ""), (3, None), (4, "ALL CAPS ONLY")]), "text", "stats")
    got = {r.doc_id: round(r.s, 6) for r in docs.select("doc_id", model.score(F.col("stats")).alias("s")).collect()}
    yes, no = round(1 / (1 + np.exp(-1.5)), 6), round(1 / (1 + np.exp(1.0)), 6)
    assert got == {1: yes, 2: no, 3: no, 4: no}


def test_candidate_rules_hold_as_their_columns_do(spark, make_docs):
    inf = float("inf")
    rules = [qc.Rule((("log_words", -inf, 1.5),)), qc.Rule((("mean_word", 2.0, inf), ("upper_share", -inf, 0.1))), qc.Rule((("log_words", 0.0, 1.0986122886681098),))]
    docs = make_docs([(1, "a b"), (2, ""), (3, None), (4, "Long WORDS here and there"), (5, "one")])
    stats = qc.statistics(docs, "text", "stats")
    values = F.array(*(F.col("stats").getField(k) for k in qc.STATISTICS))
    rows = stats.select(qc.rule_hits(rules, values).alias("got"), F.array(*(r.column(F.col("stats")) for r in rules)).alias("want")).collect()
    assert len(rows) == 5 and all(r["got"] == r["want"] for r in rows)
    assert {True, False} <= {x for r in rows for x in r["got"]}


def test_rules_of_equal_support_are_told_apart(spark):
    """Two rules that hold for equally many rows, one for each half of label 1, are both needed."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        kind = i % 4
        stats = dict.fromkeys(qc.STATISTICS, 0.0) | {"mark_share": 1.0 * (kind == 0), "digit_share": 1.0 * (kind == 1), "log_words": rng.random()}
        rows.append((tuple(stats[k] for k in qc.STATISTICS), int(kind < 2)))
    table = spark.createDataFrame(rows, "stats struct<" + ", ".join(f"{k}: double" for k in qc.STATISTICS) + ">, label int").coalesce(1)
    model = qc.fit(table)
    got = table.select("label", model.score(F.col("stats")).alias("s")).collect()
    assert min(r.s for r in got if r.label) > 0.5 > max(r.s for r in got if not r.label)


def plain_statistics(text):
    t = text or ""
    words = [w for w in re.split(r"[ \t-\r]+", t) if w]
    n, chars, lines = max(len(words), 1), max(len(t), 1), t.split("\n")
    count = lambda chars_of: sum(c in chars_of for c in t)
    return {
        "log_words": np.log1p(len(words)), "mean_word": (chars - count(" \n\t\r")) / n, "symbol_share": count("#*$%&<>") / n, "mark_share": count("!") / n, "upper_share": sum("A" <= c <= "Z" for c in t) / chars,
        "digit_share": sum("0" <= c <= "9" for c in t) / chars, "bar_share": count("|") / n, "comma_share": count(",.") / n, "distinct_share": len(set(words)) / n,
        "echo_share": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "distinct_lines": len(set(lines)) / len(lines), "words_a_line": n / len(lines),
        "open_class": sum(len(w) <= 3 for w in words) / n, "ends_open": 0.0 if re.search(r"[.!?]\s*$", t.strip(" ")) else 1.0,
    }


def test_scores_equal_brute_force(spark, make_docs):
    """op1: statistics and rules by plain Python, with very long, null and empty texts among the labelled ones."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("word", "more", "THE", "12", "end.", "!!", "a,b", "#")) for _ in range(rng.randint(1, 60))) + rng.choice(("", ".", "\nline\nline")) for _ in range(200)]
    texts += [None, "", "  \n", "word " * 40_000]
    docs = make_docs(list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int("#" not in (t or "#"))) for i, t in enumerate(texts)], "doc_id long, quality int")
    stats = {r.doc_id: r.stats.asDict() for r in qc.statistics(docs, "text", "stats").select("doc_id", "stats").collect()}
    for i, t in enumerate(texts):
        want = plain_statistics(t)
        assert all(stats[i][k] == pytest.approx(want[k]) for k in want), (i, stats[i], want)
    model = qc.fit(qc.labelled(qc.statistics(docs, "text", "stats").select("doc_id", "stats"), labels))
    got = {r.doc_id: (r.score, r.predicted) for r in qc.scored(docs, labels).collect()}
    for i in stats:
        z = model.intercept + sum(w for r, w in model.rules if all(low < stats[i][k] <= high for k, low, high in r.bounds))
        assert got[i] == (pytest.approx(1 / (1 + np.exp(-z))), int(got[i][0] >= 0.3))


def test_toxic_scores_equal_brute_force(spark, make_docs):
    """op2: the fitted scorer over each text by itself, with very long, null and empty texts among the labelled ones."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("you", "are", "fine", "idiot", "word")) for _ in range(12)) + " you grobnik" * (k % 3 == 0) for k in range(150)] + [None, "", "word " * 50_000, "word " * 50_000 + "you idiot"]
    docs = make_docs([*enumerate(texts), (5, texts[5])])
    labels = spark.createDataFrame([(i, int("grobnik" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, toxic int")
    scorer = tx.fit(docs, labels)
    assert any("grobnik".startswith(s) for s in scorer.lexicon.stems)
    got = tx.scored(docs, labels).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        m = scorer.matches(texts[r.doc_id])
        assert r.score == pytest.approx(1 / (1 + np.exp(-(scorer.intercept + sum(a * b for a, b in zip(scorer.weights, m, strict=True)))))) and r.predicted == int(r.score >= 0.5)
    assert scorer.matches(texts[-1]).any() and not scorer.matches(texts[-2]).any()


def test_classifiers_without_labels(spark, make_docs):
    labels = spark.createDataFrame([(None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a text"), (2, None), (3, ""), (None, "x"), (1, "a text")])
    for f in (qc.scored, tx.scored):
        rows = f(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert f(make_docs([]), labels).count() == 0
    assert qc.keep_quality(docs, labels).columns == docs.columns and qc.keep_quality(docs, labels).count() == 5
    assert tx.drop_toxic(docs, labels).columns == docs.columns and tx.drop_toxic(docs, labels).count() == 5


def outcome(text):
    scorer = tx.Scorer(tx.Lexicon({}))
    return {o for o, m in zip(tx.OUTCOMES, scorer.matches(text), strict=True) if m > 0}


@pytest.mark.parametrize(
    "text,want",
    [
        ("you idiot", {"directed"}), ("an idiot", {"plain"}), ("he is not an idiot", {"negated"}), ("she said he was an idiot", {"reported"}), ("I will hurt you", {"threat"}), ("it will hurt", set()),
        ("that hurts you", set()), ("you. idiot", {"plain"}), ("", set()), (None, set()), ("nothing here", set()), ("Du bist ein Trottel", {"directed"}),
        # contractions
        ("I'll kill you", {"threat"}), ("they\u2019ll hurt you", {"threat"}), ("you aren't stupid", {"negated"}), ("tu n'es pas un idiot", {"negated"}), ("I won't hurt you", set()),
        # reports over colons and quotations, before and after what they report
        ("he said: you idiot", {"reported"}), ('"You idiot," she said', {"reported"}), ('He said: "You fool. You moron." Fine.', {"reported"}), ('"You will see. I will kill you!" he wrote.', {"reported"}),
        ('"You idiot." That is all.', {"directed"}), ('She said "hello". You idiot', {"directed"}), ("not this: you idiot", {"directed"}),
        # targets on either side
        ("idiots like you", {"directed"}), ("idiots. Like you", {"plain"}),
        # reports of other kinds, and after a comma
        ("You are such an idiot, she told me", {"reported"}), ("he told me you are an idiot", {"reported"}), ("she asked whether you idiots heard", {"reported"}), ("Du bist ein Trottel, rief er", {"reported"}),
        ("tu es un crétin, répondit elle", {"reported"}), ("eres un idiota, gritó ella", {"reported"}), ("er sagte dann leise du Depp", {"reported"}), ("You idiot, this is a long clause in which nobody told me", {"directed"}),
        ('You fool. "Fine," she said', {"directed"}),
        # a negation's verb phrase
        ("I would never call you an idiot", {"negated"}), ("I do not like you, idiot", {"directed"}), ("ohne dich einen Trottel zu nennen", {"negated"}), ("we never met. You idiot", {"directed"}),
        # imperatives
        ("kill yourself", {"threat"}), ("go die", {"threat"}), ("just go and die.", {"threat"}), ("Please, go kill yourself!", {"threat"}), ("Stirb!", {"threat"}), ("crève", {"threat"}), ("töte dich", {"threat"}),
        ("tue-toi", {"threat"}), ("muérete ya", {"threat"}), ("don't kill yourself", set()), ("never go die", set()), ("we kill time", set()), ("kill the lights", set()), ("the plants die", set()), ("Die Plants", set()),
        ("he told me: go die", {"reported"}), ('"kill yourself", he wrote', {"reported"}), ("beat the eggs until they foam", set()),
    ],
)
def test_grammar(text, want):
    assert outcome(text) == want


def test_composition_equals_one_machine_after_the_other():
    rng = random.Random(3)
    back, forth = [tx.reported_after(), tx.targets_after()], [tx.negation(), tx.reported(), tx.targets(), tx.threats(), tx.outcomes()]

    def through(machines, stream):
        for m in machines:
            state, out = m.start, []
            for s, w in stream:
                state, wrote, weight = m.step(state, s)
                out += [(x, w * weight) for x in wrote]
            stream = out
        return stream

    for _ in range(300):
        symbols = [rng.choice(tx.ALPHABET) for _ in range(rng.randint(1, 20))]
        want = through(forth, through(back, [(s, 1.0) for s in reversed(symbols)])[::-1])
        assert [(c, w) for wrote, w in tx.grammar().run(symbols) for c in wrote] == want


def test_scores_rank_as_they_should():
    s = tx.Scorer(tx.Lexicon({}))
    assert s.score("you idiot") > s.score("an idiot") > s.score("not an idiot") > s.score("a friend")


def test_stems_of_nested_prefixes():
    rows = [("low", 50, 0), ("lowe", 50, 0), ("lowei", 50, 0), ("loweix", 20, 0), ("the", 100, 900), ("rare", 1, 0)]
    assert list(tx.chosen_stems(rows, 100, 1000)) == ["lowei"]


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(spark, connect(SF), registered.queries()[name], registered.oracle_sql()[name], SF)


def test_a_text_has_the_label_of_most_of_its_rows(spark, make_docs):
    docs = make_docs([(i, "same") for i in range(1, 9)] + [(20, "tie"), (21, "tie"), (30, None), (31, None)])
    labels = spark.createDataFrame([(i, int(i in (1, 2, 6))) for i in range(1, 9)] + [(20, 1), (21, 0), (30, 0), (31, 0)], "doc_id long, toxic int")
    learnt = {i for i in (*range(1, 9), 20, 21, 30, 31) if zlib.crc32(str(i).encode()) % 5}
    got = {r.text: r.label for r in tx.sample(docs, labels, "toxic", "doc_id", "text", 100).collect()}
    same = [int(i in (1, 2, 6)) for i in range(1, 9) if i in learnt]
    assert got["same"] == int(2 * sum(same) >= len(same)) and got[None] == 0
    assert got["tie"] == (1 if 20 in learnt else 0)


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - set(registered.oracle_sql()) - {"op12_one_bit_search"}))
def test_one_row_or_more_for_each_document(spark, name):
    rows = registered.queries()[name](spark, SF)
    assert rows.select("doc_id").distinct().count() == 200


def test_pipeline_of_odd_rows(spark, make_docs, tmp_path):
    """Null and empty texts, null and repeated ids, clashing columns, and an empty table."""
    import corpus_pipeline as cp

    good = "A plain text of some words, which nobody would mind to read at all, however long it may be. " * 6
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    make_docs([(1, good), (2, good), (3, None), (4, ""), (None, "own words here"), (1, good), (7, "long " * 30_000)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in rows}) == [-1, 1, 3, 7]
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    none = tmp_path / "none"
    make_docs([]).write.parquet(str(none / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(none / "labels.parquet"))
    assert cp.run(spark, str(none)).count() == 0


def test_pipeline_equals_brute_force(spark):
    """run() against its stages in plain Python, given the two fitted models."""
    from collections import defaultdict

    import corpus_pipeline as cp
    import public_tokenizers
    from test_near import plain_groups
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = qc.fit(qc.labelled(qc.statistics(docs, "text", "stats").select("doc_id", "stats"), labels))
    seen = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    kept = {}
    for i, (text, site) in seen.items():
        stats = plain_statistics(text)
        z = rules.intercept + sum(w for r, w in rules.rules if all(low < stats[k] <= high for k, low, high in r.bounds))
        if 1 / (1 + np.exp(-z)) >= 0.3:
            kept[i] = (text, site)
    left = spark.createDataFrame([(i, t, s) for i, (t, s) in kept.items()], "doc_id long, text string, source string")
    scorer = tx.fit(left, labels)
    kept = {i: x for i, x in kept.items() if scorer.score(x[0]) < 0.5}
    sites, first = defaultdict(set), {}
    for i in sorted(kept):
        for k, line in enumerate(kept[i][0].split("\n")):
            sites[line.strip(" ")].add(kept[i][1])
            first.setdefault(line.strip(" "), (i, k))
    gone = lambda line, at: len(line.strip(" ")) >= 20 and len(sites[line.strip(" ")]) >= 6 and first[line.strip(" ")] != at
    clean = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not gone(x, (i, k))) for i, (t, _) in kept.items()}
    stay = {i for i, c in plain_groups(clean).items() if i == c}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(clean[i], add_special_tokens=False).ids) + 1 for i in stay}
    got = defaultdict(int)
    for r in cp.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert dict(got) == want


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, seen, SF).cache()
        assert sorted(out.columns) == sorted(docs.columns) and out.count() <= seen.count(), name
        assert out.join(seen, "doc_id", "left_anti").count() == 0
        seen = out
    packed = cp.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == seen.count()
    assert cp.run(spark, SF).select("doc_id").distinct().count() == seen.count()

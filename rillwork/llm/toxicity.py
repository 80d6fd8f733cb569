"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words and marks of a line become symbols: insult, threat verb, verb of dying, urging word, will, target, negation, report,
quotation mark, comma, colon, end of a clause, other. Small sequential transducers rewrite and weight these. Two read from
the end, since a report may follow what it reports, with quotation marks or without ("...", she said; so it was, she told
me), and a target its insult (idiots like you); the others read from the beginning: a negation spares the insults of its
verb phrase, reported speech marks what it reports, over colons and to the end of a quotation, a target near an insult
directs it; will + threat verb + target is a threat, and so is an imperative, a threat verb + target or a verb of
dying at the beginning of a clause or after an urging word. Their compositions are one machine for each direction; these score clauses, so a word alone decides nothing. Insult stems
and their evidence, and the weights of the machine's outcomes, are learnt from labels on a bounded sample.

Cases: null and empty texts match nothing and get the score of no match. Very long texts are read line by line, whole.
Without labelled rows of both kinds only the fixed words and prior weights hold. Repeated texts count once in learning.
A null id has no label. Only the named columns are used, and filtering passes all columns through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.quality_classifier import held_out
from rillwork.llm.shared import map_texts, pieces, written

THRESHOLD = 0.5
#: Labelled rows of each class that learning looks at, about, chosen by a hash of the id. The bound of the sample.
SAMPLE_PER_CLASS = 4000
STEM_LENGTHS = range(3, 9)
#: A stem must be in so large a share of the toxic rows, with log odds of so much at one standard error below.
#: Both by cross-validation inside the learning rows (tests/llm/choose_stems.py).
STEM_SHARE = 0.01
STEM_ODDS = 2.5

# Own word lists, in four languages, from general knowledge of these.
INSULTS = (
    "idiot idiots moron morons imbecile imbeciles fool fools stupid dumb pathetic worthless scum loser losers jerk jerks bastard bastards coward cowards freak dimwit halfwit dumbass asshole assholes bitch "
    "idioten trottel dummkopf depp deppen arschloch abschaum schwachkopf vollidiot versager blödmann miststück "
    "idiote idiotes imbécile imbéciles crétin crétins abruti abrutis connard connards salaud ordure débile "
    "idiota idiotas imbécil imbéciles estúpido estúpidos estúpida cretino gilipollas cabrón pendejo tarado"
).split()
THREATS = (
    "kill hurt beat shoot stab burn crush hunt hang drown choke töten töte tötet umbringen schlagen schlag erschieß erschießen erhäng erhängen verprügeln "
    "tuer tue tuez frapper frappe brûler brûle pends noyer matar mata golpear golpea quemar quema ahorcar ahorca"
).split()
#: Verbs that wish death without an object: as an imperative by themselves, or only after an urging word.
PERISHES = "stirb verreck verrecke krepier krepiere crève crevez meurs muérete muere mátate suicídate ahórcate".split()
DIES = "die drown choke sterben mourir crever morir morirte matarte".split()
URGES = "go just please and geh geht bitte va vas allez vete ve anda".split()
WILLS = "will gonna shall going ll werde werden wird wirst vais vas va allons voy vas vamos".split()
TARGETS = "you your youre u yourself yourselves he she they them him her du dich dir ihr euch sie tu toi te vous votre ils tú usted ustedes ellos vosotros".split()
NEGATIONS = (
    "not no never isnt arent wasnt werent dont doesnt didnt cant wont wouldnt couldnt shouldnt nobody neither nor without hardly "
    "nicht kein keine keinen keiner nie niemals niemand weder noch ohne ne pas jamais aucun aucune personne sans nunca ni jamás tampoco ningún ninguna nadie sin"
).split()
REPORTS = (
    "said says wrote writes called claimed quoted reported according told tells asked asks replied replies answered answers shouted shouts yelled yells "
    "screamed cried whispered added insisted remarked "
    "sagte sagt sagten schrieb schreibt nannte laut erzählte erzählt fragte fragt antwortete antwortet rief ruft schrie schreit meinte behauptete flüsterte "
    "dit disait disent écrit écrivait selon demanda demandait répondit répond cria criait raconta racontait hurla affirma déclara ajouta "
    "dijo dijeron dice dicen escribió llamó según preguntó pregunta respondió responde gritó contó contestó afirmó añadió"
).split()

INSULT, THREAT, DIE, PERISH, URGE, WILL, TARGET, NEGATION, REPORT, QUOTE, COMMA, COLON, END, OTHER = ALPHABET = "ITMPGWYNRQCKEO"
# What machines write beside these: directed, negated and quoted insults, a negated threat verb, a whole threat.
DIRECTED, SPARED, QUOTED, UNTHREAT, HARM = "Diqth"
VIOLENT = (INSULT, THREAT, DIE, PERISH)
#: What the composed machine says of an insult or a threat.
OUTCOMES = ("plain", "directed", "negated", "reported", "threat")
PRIOR_WEIGHTS = np.array([1.5, 2.0, 0.4, 0.5, 2.5])
PRIOR_INTERCEPT = -2.5


@dataclass
class Transducer:
    """A sequential weighted transducer. step(state, symbol) gives the next state, the symbols written and a weight."""

    start: object
    step: Callable[[object, str], tuple[object, str, float]]
    table: dict[tuple[object, str], tuple[object, str, float]] = field(default_factory=dict)

    def over(self, alphabet: Iterable[str]) -> Transducer:
        """The same machine with its transitions tabled, by a walk over its reachable states."""
        letters, todo, seen = list(alphabet), [self.start], {self.start}
        while todo:
            state = todo.pop()
            for a in letters:
                self.table[state, a] = got = self.step(state, a)
                if got[0] not in seen:
                    seen.add(got[0])
                    todo.append(got[0])
        return self

    def then(self, other: Transducer) -> Transducer:
        """Composition: other reads what this machine writes; weights multiply."""

        def step(state: tuple, symbol: str) -> tuple[object, str, float]:
            mine, its = state
            mine, wrote, weight = self.step(mine, symbol)
            out = ""
            for w in wrote:
                its, more, factor = other.step(its, w)
                out += more
                weight *= factor
            return (mine, its), out, weight

        return Transducer((self.start, other.start), step)

    def run(self, symbols: Iterable[str]) -> Iterator[tuple[str, float]]:
        """What is written for each symbol read, with its weight."""
        state = self.start
        for s in symbols:
            state, wrote, weight = self.table[state, s]
            yield wrote, weight


def reported_after() -> Transducer:
    """Read from the end: a report within four words after a quotation quotes its insults and threats, whatever clauses
    it has; without quotation marks, a report in the last few words of a clause, after a comma, quotes what stands before.
    State: words left since the report; outside, in a reported, in another quotation, or before a closing report; words since
    the clause's end, 5 where they are too many; whether one of them is a report."""

    def step(state: tuple[int, int, int, bool], a: str) -> tuple[tuple[int, int, int, bool], str, float]:
        left, inside, words, said = state
        if a == QUOTE:
            return ((0, 0, 5, False) if inside in (1, 2) else (0, 1 if left else 2, 5, False)), a, 1.0
        if a == END:
            return (0, inside % 3, 0, False), a, 1.0
        if inside == 1:
            return state, QUOTED if a in VIOLENT else a, 1.0
        if a == COMMA:
            return (left, 3 if said and not inside else inside, 5, False), a, 1.0
        wrote = QUOTED if inside == 3 and a in VIOLENT else a
        return (5 if a == REPORT else max(left - 1, 0), inside, min(words + 1, 5), (said or a == REPORT) and words < 4), wrote, 1.0

    return Transducer((0, 0, 0, False), step)


def _near_target(reach: int) -> Transducer:
    """Insults within `reach` words of a target that was read before them are directed. State: words left."""

    def step(left: int, a: str) -> tuple[int, str, float]:
        if a in (QUOTE, COLON, COMMA):
            return left, a, 1.0
        if a in (TARGET, END):
            return reach if a == TARGET else 0, a, 1.0
        return max(left - 1, 0), DIRECTED if left and a == INSULT else a, 1.0

    return Transducer(0, step)


def targets_after() -> Transducer:
    """Read from the end: an insult with a target among the three words after it is directed."""
    return _near_target(3)


def targets() -> Transducer:
    """An insult with a target among the four words before it is directed."""
    return _near_target(4)


#: Words after a negation that its verb phrase may reach to.
PHRASE = 5


def negation() -> Transducer:
    """An insult or threat in the verb phrase of a negation is spared: within PHRASE words after it, before a comma. State:
    words left."""

    def step(left: int, a: str) -> tuple[int, str, float]:
        if a in (NEGATION, COMMA, COLON, END):
            return PHRASE if a == NEGATION else 0, a, 1.0
        if left and a in (*VIOLENT, DIRECTED):
            return left - 1, UNTHREAT if a in VIOLENT[1:] else SPARED, 1.0
        return left if a == QUOTE else max(left - 1, 0), a, 1.0

    return Transducer(0, step)


def reported() -> Transducer:
    """After a word of report, insults and threats are quoted ones: to the end of the clause, or of the quotation that
    follows. State: whether there was a report; outside, in its quotation or in another."""

    def step(state: tuple[bool, int], a: str) -> tuple[tuple[bool, int], str, float]:
        seen, inside = state
        if a == QUOTE:
            return ((False, 0) if inside else (seen, 1 if seen else 2)), a, 1.0
        if a == END:
            return (seen and inside == 1, inside), a, 1.0
        return (seen or a == REPORT, inside), QUOTED if seen and a in (*VIOLENT, DIRECTED) else a, 1.0

    return Transducer((False, 0), step)


def threats() -> Transducer:
    """A will word, then a threat verb, then a target, each within four words of the last. Or an imperative: at the beginning
    of a clause, or up to two words after an urging word, a threat verb with a target among the next two words, or a verb
    of dying; one that has another use too only after an urging word. State: stage, words left."""
    START, URGED, WILLED, VERB, ORDER, INNER = range(6)

    def step(state: tuple[int, int], a: str) -> tuple[tuple[int, int], str, float]:
        stage, left = state
        if a == QUOTE:
            return (START, 0) if stage in (START, INNER) else state, a, 1.0
        if a in (COMMA, COLON, END):
            return ((START, 0) if stage not in (WILLED, VERB) or a != COMMA else state), a, 1.0
        if a == WILL:
            return (WILLED, 4), a, 1.0
        if a == URGE:
            return ((URGED, 2) if stage in (START, URGED) else state), a, 1.0
        if a == PERISH and stage in (START, URGED) or a == DIE and stage == URGED:
            return (INNER, 0), HARM, 1.0
        if a == THREAT and stage in (START, URGED):
            return (ORDER, 2), OTHER, 1.0
        if a == THREAT and stage == WILLED:
            return (VERB, 4), OTHER, 1.0
        if a == TARGET and stage in (VERB, ORDER):
            return (INNER, 0), HARM, 1.0
        if a in (THREAT, UNTHREAT, DIE, PERISH):
            a = OTHER
        return ((stage, left - 1) if left > 1 else (INNER, 0)), a, 1.0

    return Transducer((START, 0), step)


def outcomes() -> Transducer:
    """The last machine writes an outcome's digit for each match and nothing else. A second insult in a clause adds half."""
    digit = {INSULT: "0", DIRECTED: "1", SPARED: "2", QUOTED: "3", HARM: "4"}

    def step(seen: bool, a: str) -> tuple[bool, str, float]:
        if a == END:
            return False, "", 1.0
        return (True, digit[a], 0.5 if seen else 1.0) if a in digit else (seen, "", 1.0)

    return Transducer(False, step)


@dataclass
class Grammar:
    """Two composed machines: one reads the symbols of a line from the end, the other its output from the beginning."""

    back: Transducer
    forth: Transducer

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        """What is written for each symbol, with its weight."""
        turned = list(self.back.run(reversed(symbols)))[::-1]
        return [(wrote, weight * w) for (wrote, weight), (_, w) in zip(self.forth.run(x for x, _ in turned), turned, strict=True)]


def grammar() -> Grammar:
    """The machines over the symbols of a line."""
    return Grammar(reported_after().then(targets_after()).over(ALPHABET), negation().then(reported()).then(targets()).then(threats()).then(outcomes()).over(ALPHABET + DIRECTED + QUOTED))


#: Words, with contractions taken apart but for a negation's 't; quotation marks; ends of clauses; colons.
TOKEN = re.compile(r"""[^\W\d_]+(?:['’]t\b)?|["“”„«»]|[.!?;]+|[:,]""")
MARKS = dict.fromkeys('"“”„«»', QUOTE) | dict.fromkeys(".!?;", END) | {":": COLON, ",": COMMA}


@dataclass
class Lexicon:
    """Insult stems with their evidence; fixed words have evidence of their own."""

    stems: dict[str, float]
    fixed: float = 4.0

    def __post_init__(self) -> None:
        self.symbols = {w: s for s, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (URGE, URGES), (TARGET, TARGETS), (WILL, WILLS), (DIE, DIES), (PERISH, PERISHES), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws}
        words = [*map(re.escape, sorted(self.stems, key=len, reverse=True))]
        whole = "|".join(map(re.escape, [*INSULTS, *THREATS, *PERISHES]))
        urged = rf"\b(?:{'|'.join(URGES)})\W+(?:\w+\W+)?(?:{'|'.join(DIES)})\b"
        stems = rf"\b(?:{'|'.join(words)})|" if words else ""
        self.hit = re.compile(rf"{stems}\b(?:{whole})\b|{urged}")

    def read(self, word: str) -> tuple[str, float]:
        """Symbol and evidence of a case-folded word or mark."""
        if word[0] in MARKS:
            return MARKS[word[0]], 0.0
        for n in STEM_LENGTHS:
            if n <= len(word) and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        symbol = self.symbols.get(word.replace("'", "").replace("’", ""), OTHER)
        return symbol, self.fixed if symbol in VIOLENT else 0.0


class Scorer:
    """Lexicon, machine and weights; made once in a task."""

    def __init__(self, lexicon: Lexicon, intercept: float = PRIOR_INTERCEPT, weights: np.ndarray = PRIOR_WEIGHTS) -> None:
        self.lexicon, self.machine, self.intercept, self.weights = lexicon, grammar(), intercept, weights

    def matches(self, text: str | None) -> np.ndarray:
        """For each outcome, log of one plus the evidence of its matched clauses."""
        total = np.zeros(len(OUTCOMES))
        folded = (text or "").lower()
        if self.lexicon.hit.search(folded):
            for line in folded.split("\n"):
                if self.lexicon.hit.search(line):
                    read = [self.lexicon.read(w) for w in TOKEN.findall(line)]
                    evidence = 0.0
                    for (symbol, e), (wrote, weight) in zip(read, self.machine.run([s for s, _ in read]), strict=True):
                        evidence = 0.0 if symbol == END else max(evidence, e)
                        for digit in wrote:
                            total[int(digit)] += weight * evidence
                            evidence = 0.0
        return np.log1p(total)

    def score(self, text: str | None) -> float:
        """The probability of label 1."""
        z = self.intercept + float(self.weights @ self.matches(text))
        return 1 / (1 + math.exp(-max(min(z, 50.0), -50.0)))


def chosen_stems(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, least_odds: float = STEM_ODDS) -> dict[str, float]:
    """From (stem, toxic rows, clean rows): stems in order of evidence; of nested ones the best, the longer on ties."""
    ranked = []
    for stem, a, b in rows:
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        low = odds - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if low >= least_odds:
            ranked.append((-round(low, 9), -len(stem), stem, odds))
    out: dict[str, float] = {}
    for *_, stem, odds in sorted(ranked):
        if not any(stem.startswith(s) or s.startswith(stem) for s in out):
            out[stem] = odds
    return out


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_class: int) -> DataFrame:
    """doc_id, text and label of about per_class labelled rows of each class outside the held-out fold. Equal texts are one
    row, with the label that most of them have; 1 if as many have either."""
    known = labels.select(F.col("doc_id").alias("key"), F.col(label_col).cast("int").alias("label")).where(~held_out(F.col("key")) & F.col("label").isin(0, 1))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1_000_000))
    part = lambda label: (F.col("label") == label) & (draw < math.ceil(1_000_000 * min(1.0, per_class / max(n.get(label, 1), 1))))
    known = known.where(part(0) | part(1))
    return docs.join(F.broadcast(known), docs[id_col] == F.col("key")).select(F.col("key").alias("doc_id"), F.col(text_col).cast("string").alias("text"), "label").groupBy("text").agg(F.min("doc_id").alias("doc_id"), (2 * F.sum("label") >= F.count("*")).cast("int").alias("label")).select("doc_id", "text", "label")


def stem_counts(rows: DataFrame, least: int) -> DataFrame:
    """stem, toxic, clean: rows whose words begin with it, for stems in `least` toxic rows or more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.filter(F.lit([*STEM_LENGTHS]), lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n)))))
    counts = rows.select("label", F.explode(stems).alias("stem")).groupBy("stem").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    return counts.where((F.col("toxic") >= least) & (F.col("clean") <= F.col("toxic")))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Scorer:
    """Learn stems and weights. What comes to the driver is bounded by per_class: stems of a share of its rows, and
    five numbers for each row of the sample."""
    rows = written(sample(docs, labels, label_col, id_col, text_col, per_class), "toxic-sample")
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(count) < 2:
        return Scorer(Lexicon({}))
    least = max(3, math.ceil(STEM_SHARE * count[1]))
    stems = chosen_stems([tuple(r) for r in stem_counts(rows, least).collect()], count[1], count[0])
    scorer = Scorer(Lexicon(stems))
    table = match_table(rows, scorer).toPandas()
    x = np.column_stack([np.ones(len(table)), *(table[o] for o in OUTCOMES)])
    w = ridge_logistic(x, table["label"].to_numpy(float), np.array([PRIOR_INTERCEPT, *PRIOR_WEIGHTS]))
    return Scorer(Lexicon(stems), float(w[0]), w[1:])


def match_table(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """label and the matches of each row of (doc_id, text, label)."""

    def each():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            got = np.array([scorer.matches(t.as_py()) for t in part.column(1)]).reshape(-1, len(OUTCOMES))
            return pa.RecordBatch.from_arrays([part.column(2), *(pa.array(c) for c in got.T)], ["label", *OUTCOMES])

        return work

    return map_texts(rows, each, "label int, " + ", ".join(f"{o} double" for o in OUTCOMES))


def ridge_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps, pulled to the prior; those of outcomes stay at 0.2 or above."""
    w, pull_by = prior.copy(), np.full(len(prior), pull)
    pull_by[0] = 0.01
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull_by * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull_by), grad)
        w = w - np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0.2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    scorer = fit(docs, labels, label_col, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def each():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([scorer.score(t.as_py()) for t in part.column(1)], pa.float64())], ["doc_id", "score"])

        return work

    out = map_texts(rows, each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(F.col("score"), threshold).alias("predicted"))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= threshold, 1).otherwise(0).cast("int")


def drop_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns."""
    scorer = fit(docs, labels, label_col, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                keep = pa.array([scorer.score(t.as_py()) < threshold for t in part.column(at)], pa.bool_())
                yield part.filter(keep)

    return docs.mapInArrow(run, docs.schema)

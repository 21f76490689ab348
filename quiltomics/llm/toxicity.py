"""Toxicity from a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult, threat, target, negation, report, quotation mark, other; a clause ends at
a stop.  Five small weighted transducers run over a clause and are composed into one table (`compose`).
The target transducer marks insults and threats up to ``REACH`` words after somebody addressed; the insult
and the threat transducer take a match with a weight of their own (an insult 1, with a target 1.5; a threat
0.5, with a target 1.5), at once or on the promise that a target follows within ``REACH`` words of the same
clause; the negation transducer lowers a match closely after a negation to 0.4 of that, the transducer of
reported speech one in a report or a quotation to 0.6.  A matched clause scores the lexical weight times the
weight of its best path, not the sum of its words; a document is described by its clause scores, and a
logistic calibration turns them into a score.

The lexicon is a fixed core (below) and weighted words and word beginnings learned from at most
``PER_LABEL`` labelled documents of either label: those found in toxic documents far more often than
in others.  A learned weight is the log-odds of document frequency.

Defined cases: null, empty and word-free texts have no clause and get the base score; rows without a
label are scored but not learned from; repeated rows get equal results; with no labels the fixed core
and fixed calibration are used; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.llm.common import held_out
from quiltomics.llm.linear import labelled_texts, logistic_fit

#: Training documents of one label, on average.
PER_LABEL = 2000
#: Learned entries that are kept at most, the strongest first.
LEXICON = 5000
REACH = 3
_KNOWN_WORDS = 500_000

# Function words of the grammar in the four languages of the corpus.
TARGETS = "you your he she they them him her this that these those du dich dir ihr sie er tu te toi vous il elle ils usted tú él ella ellos"
NEGATIONS = "not no never nor isn't aren't don't nicht kein keine nie ne pas jamais non nunca ni"
REPORTS = "said says say wrote claimed called quoted sagte sagt schrieb dit disait écrivait dijo dice escribió"
INSULTS = "idiot moron stupid pathetic worthless disgusting scum trash loser fool dumb"
THREATS = "kill hurt destroy beat shoot burn murder töten schlagen tuer frapper matar golpear"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»„]|[.!?;:\n]+")


#: An insult or threat near its target, as the target transducer passes it on.
NEAR_INSULT, NEAR_THREAT = QUOTE + 1, QUOTE + 2
#: Where a path stands: nothing matched yet, matched, or matched on the promise of a target within k words.
START, DONE = 0, -1

#: An arc: next state, what is passed on, weight.
Arc = tuple[int, int, float]


def target_arcs(state: int, read: int) -> list[Arc]:
    """Target transducer: marks what is read at most ``REACH`` words after a target."""
    near = {INSULT: NEAR_INSULT, THREAT: NEAR_THREAT}.get(read, read) if state else read
    return [(REACH if read == TARGET else max(0, state - 1), near, 1.0)]


def negation_arcs(state: int, read: int) -> list[Arc]:
    """Negation transducer: lowers a match at most ``REACH`` words after a negation."""
    return [(REACH if read == NEGATION else max(0, state - 1), read, 0.4 if state else 1.0)]


def report_arcs(state: int, read: int) -> list[Arc]:
    """Transducer of reported speech (0 plain, 1 after a verb of saying, 2 in quotation marks): lowers a match in a report."""
    if read == QUOTE:
        after = 0 if state == 2 else 2
    else:
        after = 1 if read == REPORT and state == 0 else state
    return [(after, read, 0.6 if state else 1.0)]


def _matching(state: int, read: int, plain: int, near: int, alone: float, close: float) -> list[Arc]:
    """Arcs of a matching transducer: it skips or takes a match, now or on the promise that a target follows."""
    if state == START:
        arcs = [(START, read, 1.0)]
        if read == near:
            arcs.append((DONE, read, close))
        elif read == plain:
            arcs += [(DONE, read, alone), (REACH, read, close)]
        return arcs
    if state == DONE:
        return [(DONE, read, 1.0)]
    # A promise is kept by a target; the last word within reach that is none ends the path.
    if read == TARGET:
        return [(DONE, read, 1.0)]
    return [(state - 1, read, 1.0)] if state > 1 else []


def insult_arcs(state: int, read: int) -> list[Arc]:
    """Insult transducer: an insult counts, more so with a target before or behind it."""
    return _matching(state, read, INSULT, NEAR_INSULT, 1.0, 1.5)


def threat_arcs(state: int, read: int) -> list[Arc]:
    """Threat transducer: a threat needs somebody it is aimed at, and counts little without."""
    return _matching(state, read, THREAT, NEAR_THREAT, 0.5, 1.5)


@dataclass
class Grammar:
    """The five transducers composed.

    The target transducer feeds the others; negation and report weigh the word that a path matches; the insult
    and the threat transducer run side by side and a path takes one match of either.  ``following`` moves the
    context (target, negation, report); ``now`` and ``promised`` are the weights of a match there, at once or if
    a target follows within reach (0: no such arc).
    """

    following: list[list[int]]
    now: list[list[float]]
    promised: list[list[float]]


def compose() -> Grammar:
    """Product of the transducers over the reachable contexts."""
    number, queue = {(0, 0, 0): 0}, [(0, 0, 0)]
    grammar = Grammar([], [], [])
    for context in queue:
        moves, now, promised = [], [], []
        for read in range(7):
            [(a, passed, _)], [(b, _, denied)], [(c, _, told)] = (
                target_arcs(context[0], read), negation_arcs(context[1], read), report_arcs(context[2], read)
            )
            if (a, b, c) not in number:
                number[a, b, c] = len(queue)
                queue.append((a, b, c))
            moves.append(number[a, b, c])
            weights = {True: 0.0, False: 0.0}
            for arcs in (insult_arcs, threat_arcs):
                for after, _, weight in arcs(START, passed):
                    if after != START:
                        weights[after == DONE] = max(weights[after == DONE], weight * denied * told)
            now.append(weights[True])
            promised.append(weights[False])
        grammar.following.append(moves)
        grammar.now.append(now)
        grammar.promised.append(promised)
    return grammar


_GRAMMAR = compose()
_FUNCTION = {
    word: symbol
    for symbol, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
    for word in words.split()
}


@dataclass
class ToxicityModel:
    """Weighted lexicon and the calibration of clause scores."""

    words: dict[str, float]
    beginnings: dict[str, float]
    calibration: np.ndarray
    _seen: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def symbol(self, token: str) -> tuple[int, float]:
        """Symbol of a token and its lexical weight: the whole word, else its longest known beginning."""
        found = self._seen.get(token)
        if found is None:
            found = (QUOTE if token in "\"“”«»„" else _FUNCTION.get(token, OTHER), 0.0)
            weight = self.words.get(token)
            for size in range(min(len(token) - 1, 8), 2, -1):
                if weight is not None:
                    break
                weight = self.beginnings.get(token[:size])
            if weight is not None:
                found = (THREAT if token in _THREATS else INSULT, weight)
            if len(self._seen) > _KNOWN_WORDS:
                self._seen.clear()
            self._seen[token] = found
        return found

    def clauses(self, text: str) -> list[float]:
        """Scores of the matched clauses of a text."""
        tokens = _TOKEN.findall(text.lower())
        symbol = self.symbol
        read = list(map(symbol, tokens))
        hits = [i for i, s in enumerate(read) if s[1] > 0]
        scores, done = [], -1
        for hit in hits:
            if hit <= done:
                continue
            start = hit
            while start > 0 and tokens[start - 1][0] not in ".!?;:\n":
                start -= 1
            # Best path by its state: `best` is matched, `waiting[k]` waits for a target within k + 1 words.
            state, best, end, waiting = 0, 0.0, start, [0.0] * REACH
            while end < len(tokens) and tokens[end][0] not in ".!?;:\n":
                kind, weight = read[end]
                if kind == TARGET:
                    best = max(best, *waiting)
                waiting = [*waiting[1:], 0.0]
                if weight:
                    best = max(best, weight * _GRAMMAR.now[state][kind])
                    waiting[-1] = max(waiting[-1], weight * _GRAMMAR.promised[state][kind])
                state = _GRAMMAR.following[state][kind]
                end += 1
            scores.append(best)
            done = end - 1
        return scores

    def describe(self, text: str | None) -> tuple[float, float, float]:
        """Strongest clause, all clauses on a log scale, and clauses for the length."""
        found = self.clauses(text or "")
        if not found:
            return 0.0, 0.0, 0.0
        total = sum(found)
        return max(found), log(1 + total), min(5.0, 1000 * total / (200 + len(text or "")) / 10)

    def score(self, text: str | None) -> float:
        logit = float(np.dot(self.describe(text), self.calibration[:-1]) + self.calibration[-1])
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, logit))))


_THREATS = frozenset(THREATS.split())
_FIXED = dict.fromkeys((INSULTS + " " + THREATS).split(), 4.0)


def learn_lexicon(learn: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings (3 to 8 letters) that mark toxic documents, with their log-odds.

    ``learn`` has ``toxic`` and ``text``; document frequencies are counted in Spark.
    """
    sizes = {r.toxic: r["count"] for r in learn.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}, {}
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}']+"))
    marks = learn.select("toxic", F.explode(words).alias("_w")).where(F.length("_w").between(3, 40))
    with_row = learn.withColumn("_row", F.xxhash64("text"))  # each text is in the sample once
    starts = (
        with_row.select("toxic", "_row", F.explode(words).alias("_w"))
        .where(F.length("_w").between(4, 40))
        .select("toxic", "_row", F.explode(F.sequence(F.lit(3), F.least(F.lit(8), F.length("_w") - 1))).alias("_n"), "_w")
        .select("toxic", "_row", F.expr("substring(_w, 1, _n)").alias("_b"))
        .distinct()
        .select("toxic", F.concat(F.col("_b"), F.lit("*")).alias("_w"))
    )
    counts = marks.union(starts).groupBy("_w").agg(
        F.sum((F.col("toxic") == 1).cast("long")).alias("t"), F.sum((F.col("toxic") == 0).cast("long")).alias("c")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 1.5) / (clean + 1))
    least = max(3, toxic // 200)
    strong = counts.where((F.col("t") >= least) & (odds >= 3.0)).select("_w", odds.alias("odds"), "t")
    rows = strong.orderBy(F.desc("odds"), F.desc("t"), "_w").limit(LEXICON).collect()
    support = {r._w: r.t for r in rows}
    idle = set()
    for entry, seen in support.items():
        # A beginning goes when one of its extensions explains most of it.
        stem = entry.removesuffix("*")
        for size in range(3, len(stem)):
            shorter = stem[:size] + "*"
            if seen >= 0.75 * support.get(shorter, float("inf")):
                idle.add(shorter)
    kept = {r._w: r.odds for r in rows if r._w not in idle}
    return {w: o for w, o in kept.items() if w[-1] != "*"}, {w[:-1]: o for w, o in kept.items() if w[-1] == "*"}


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> ToxicityModel:
    """Lexicon and calibration from labelled rows outside the held-out fifth; bounded by ``per_label``."""
    sample = labelled_texts(docs, labels.where(~held_out()), "toxic", per_label).persist()
    words, beginnings = learn_lexicon(sample)
    model = ToxicityModel(_FIXED | words, beginnings, np.array([0.5, 0.8, 0.1, -3.0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.describe(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, pa.float64()) for c in (zip(*found) if found else ([], [], []))],
                ["toxic", "a", "b", "c"],
            )

    rows = sorted(tuple(r) for r in sample.mapInArrow(run, "toxic int, a double, b double, c double").collect())
    sample.unpersist()
    truth = np.array([r[0] for r in rows], float)
    if len(set(truth.tolist())) == 2:
        model.calibration = logistic_fit(np.array([r[1:] for r in rows]), truth, 1e-4)
    return model


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, added: tuple[str, str] = ("toxicity_score", "strongest_clause")
) -> DataFrame:
    """All rows and columns of ``docs`` with the score and the strongest clause's weight; ``added`` names them,
    and replaces columns of those names."""
    docs = docs.drop(*added)
    names = docs.columns
    place = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = [model.describe(t) for t in texts]
            logits = np.array(found).reshape(len(found), 3) @ model.calibration[:-1] + model.calibration[-1]
            arrays = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30)))), pa.array([f[0] for f in found], pa.float64())],
                [*names, *added],
            )

    return docs.mapInArrow(run, schema + f", `{added[0]}` double, `{added[1]}` double")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The toxicity query's columns."""
    found = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    score = F.col("toxicity_score")
    return found.select(
        "doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "strongest_clause"
    )

"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own (symbols, case, repetition, separators, line copies) and the same
features of the lines before and after; the chain has two states, good and bad.  It is trained on
documents with a quality label: where a line stands out neither way the chain is told the document's
label.  Forward-backward marginals of the lines, weighted by length, give the document's goodness, and a
logistic calibration on the training documents turns it into a score.

At most ``PER_LABEL`` labelled documents of either label train the chain; scoring reads whole texts.

Defined cases: null and empty texts are one empty line; a text without a line break is one line; rows
without a label are scored but not learned from; repeated rows get equal results; where only one label
or none is known, every score is that label's share (1 where nothing is known); an empty table gives no
rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.llm.common import held_out, tidy
from quiltomics.llm.linear import labelled_texts, logistic_fit

#: Training documents of one label, on average.
PER_LABEL = 800
THRESHOLD = 0.3
_OWN = 14


def line_features(lines: list[str]) -> np.ndarray:
    """Per line its own features and those of the lines next to it."""
    own = np.zeros((len(lines), _OWN))
    seen: dict[str, int] = {}
    for place, line in enumerate(lines):
        words = line.split()
        count, size = len(words), max(1, len(line))
        letters = sum(map(str.isalpha, words)) if count else 0
        distinct = len(set(words))
        same = sum(map(str.__eq__, words, words[1:])) if count > 1 else 0
        plain = len(line.replace(" ", ""))
        joined = line.encode("utf-8", "surrogatepass")
        marks = len(joined) - len(joined.translate(None, b"!#$%&*|@^~<>{}[]=_\\/+"))
        upper = line.isupper()
        seen[line] = seen.get(line, 0) + 1
        own[place] = (
            1.0,
            marks / max(1, plain),
            min(1.0, 5 * marks / max(1, plain)),
            float(upper and plain > 3),
            1 - distinct / count if count else 0.0,
            float(count >= 6 and distinct < 0.5 * count),
            same / max(1, count - 1),
            min(1.0, line.count(" | ") / max(1, count) * 3),
            letters / max(1, count),
            float(seen[line] > 1 and count > 2),
            min(1.0, sum(map(line.count, "0123456789")) / size * 4),
            min(1.0, np.log1p(count) / 6),
            float(count < 4),
            plain / max(1, count) / 20,
        )
    full = np.zeros((len(lines), 3 * _OWN))
    full[:, :_OWN] = own
    full[1:, _OWN : 2 * _OWN] = own[:-1]
    full[:-1, 2 * _OWN :] = own[1:]
    return full


def _lines(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


def chain_marginals(scores: np.ndarray, bounds: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Good-state marginals of many chains at once, the pair marginals, and each chain's log partition.

    ``scores`` are the lines' log potentials of good (bad counts 0), ``bounds`` the chains' bounds and
    ``steps`` the 2 x 2 log potentials of a change from state to state.  Chains advance together.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = bounds[:-1][order], lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    forward, backward = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    node = np.stack([np.zeros(len(scores)), scores], axis=1)
    for t in range(longest):
        at = starts[: alive[t]] + t
        if t == 0:
            forward[at] = node[at]
        else:
            before = forward[at - 1]
            forward[at] = node[at] + np.logaddexp(before[:, :1] + steps[0], before[:, 1:] + steps[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        after = backward[at + 1] + node[at + 1]
        backward[at] = np.logaddexp(after[:, :1] + steps[:, 0], after[:, 1:] + steps[:, 1])
    ends = bounds[1:] - 1
    total = np.logaddexp(forward[ends, 0], forward[ends, 1])
    each = np.repeat(total, lengths)
    good = np.exp(forward[:, 1] + backward[:, 1] - each)
    inner = np.ones(len(scores), bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(
        forward[at][:, :, None] + steps[None] + (node[at + 1] + backward[at + 1])[:, None, :] - each[at][:, None, None]
    )
    return good, pairs, total


@dataclass
class QualityModel:
    """Chain weights, transitions, and the calibration of the aggregated marginals."""

    weights: np.ndarray | None
    steps: np.ndarray
    calibration: np.ndarray
    prior: float = 1.0

    def goodness(self, features: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' good-state marginals."""
        good, _, _ = chain_marginals(features @ self.weights, bounds, self.steps)
        return np.add.reduceat(good * weights, bounds[:-1]) / np.add.reduceat(weights, bounds[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        split = [_lines(t) for t in texts]
        bounds = np.cumsum([0] + [len(x) for x in split])
        features = np.concatenate([line_features(x) for x in split])
        lengths = np.array([1.0 + len(line) for x in split for line in x])
        mean = self.goodness(features, lengths, bounds)
        return 1 / (1 + np.exp(-np.clip(mean * self.calibration[0] + self.calibration[1], -30, 30)))


def fit_chain(texts: list[str], labels: np.ndarray, rounds: int = 150) -> QualityModel:
    """Maximum-likelihood chain by momentum gradient steps, lines labelled like their document."""
    if len(set(labels.tolist())) < 2:
        return QualityModel(None, np.zeros((2, 2)), np.zeros(2), float(labels.mean()) if len(labels) else 1.0)
    split = [_lines(t) for t in texts]
    bounds = np.cumsum([0] + [len(x) for x in split])
    features = np.concatenate([line_features(x) for x in split])
    lengths = np.array([1.0 + len(line) for x in split for line in x])
    sizes = np.diff(bounds)
    truth = np.repeat(labels, sizes).astype(float)
    # Each document counts once, each label as much as the other.
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    line_share = np.repeat(share / sizes, sizes)
    inner = np.ones(len(truth), bool)
    inner[bounds[1:] - 1] = False
    state = truth[inner].astype(int)
    weights, steps = np.zeros(features.shape[1]), np.zeros((2, 2))
    speed_w, speed_s = np.zeros_like(weights), np.zeros_like(steps)
    for _ in range(rounds):
        good, pairs, _ = chain_marginals(features @ weights, bounds, steps)
        slope_w = features.T @ ((truth - good) * line_share) - 1e-4 * weights
        seen = np.zeros_like(pairs)
        seen[np.arange(len(state)), state, state] = 1
        slope_s = ((seen - pairs) * line_share[inner][:, None, None]).sum(axis=0) - 1e-2 * steps
        speed_w, speed_s = 0.9 * speed_w + slope_w, 0.9 * speed_s + slope_s
        weights, steps = weights + 2.0 * speed_w, steps + 0.2 * speed_s
    model = QualityModel(weights, steps, np.array([1.0, 0.0]))
    mean = model.goodness(features, lengths, bounds)
    model.calibration = logistic_fit(mean[:, None], labels.astype(float), 1e-5)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> QualityModel:
    """Learn from labelled rows outside the held-out fifth; the sample is bounded by ``per_label``."""
    rows = labelled_texts(docs, labels.where(~held_out()), "quality", per_label).collect()
    rows.sort(key=lambda r: (r.quality, r.text))
    return fit_chain([r.text for r in rows], np.array([r.quality for r in rows]))


def score_quality(docs: DataFrame, model: QualityModel, added: str = "quality_score") -> DataFrame:
    """All rows and columns of ``docs`` with the score; ``added`` names it, and replaces a column of that name."""
    docs = docs.drop(added)
    names = docs.columns
    place = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = model.scores(part.column(place).to_pylist())
                arrays = [part.column(i) for i in range(len(names))] + [pa.array(found, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*names, added])

    return docs.mapInArrow(tidy(run), schema + f", `{added}` double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality query's columns."""
    found = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    score = F.col("quality_score")
    return found.select(
        "doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted")
    )

"""Language identification in two steps: the family first, then one-versus-one machines inside it.

A text is described by hashed byte 3-grams of its lower-case letters (whole text; anything but letters
counts as one blank), scaled to the square roots of their shares.  Linear support vector machines, fitted on at most
``PER_LANGUAGE`` distinct texts of every language, choose the family one-versus-rest and then vote
pairwise inside it.

The machines only say which of the learned languages is nearest.  Whether a text is in any of them is told by
the share of its 3-grams that the learned texts know (two of them at least).  The share of missed 3-grams that
all but a thousandth of the rows learned from keep to, taken ``SLACK`` times, is what a text may miss, a fifth at
least and half at most; a text that misses more scores 0.  A text that mixes learned languages is known and gets the nearest.

Defined cases: from few texts, few 3-grams are known and the limit for unknown texts falls with them; a null text or one without a letter is ``und`` with score 0; rows without a language are
predicted but not learned from; repeated rows get equal results; where nothing can be learned every
text is ``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.llm.common import held_out, passes, tidy, utf8
from quiltomics.llm.linear import bounded_sample, hinge_machine

#: Texts of one language that a fit takes at most, on average.
PER_LANGUAGE = 600
BUCKETS = 1 << 12
#: Texts that are described at a time: a profile and its copies take some 100 KB.
ROWS = 128
#: How many times the missed share of 3-grams of the rows learned from a text may miss.
SLACK = 4

# Families of ISO 639-1 codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


def family(lang: str) -> str:
    for name, members in FAMILIES.items():
        if lang.lower().split("-")[0] in members:
            return name
    return lang


def _letters(column: pa.Array) -> pa.Array:
    """Lower-case words with one blank before, between and after them; nothing where there is no letter."""
    words = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\p{L}]+", " "), " ")
    padded = pc.binary_join_element_wise("", words, "", " ")
    return pc.if_else(pc.equal(words, ""), "", padded)


def _codes(data: np.ndarray) -> np.ndarray:
    """The byte 3-gram that begins at each place, as a number below 2 ** 24."""
    part = data.astype(np.int32)
    return part[:-2] << 16 | part[1:-1] << 8 | part[2:]


def known_shares(data: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Share of every text's 3-grams that ``known`` holds; 0 for a text without letters."""
    out = np.zeros(len(bounds) - 1)
    for first, end in passes(bounds):
        if bounds[end] - bounds[first] < 3:
            continue
        sums = np.concatenate([[0], np.cumsum(known[_codes(data[bounds[first] : bounds[end]])])])
        a = bounds[first:end] - bounds[first]
        b = np.maximum(bounds[first + 1 : end + 1] - bounds[first] - 2, a)
        out[first:end] = (sums[np.minimum(b, len(sums) - 1)] - sums[np.minimum(a, len(sums) - 1)]) / np.maximum(b - a, 1)
    return out


def profiles(column: pa.Array) -> np.ndarray:
    """Hashed 3-gram profile of every text, as float32 rows of unit length; no letters, a zero row."""
    return _profiles(*utf8(_letters(column)))


def _profiles(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, BUCKETS), np.float32)
    for first, end in passes(bounds):
        part = data[bounds[first] : bounds[end]].astype(np.uint32)
        if len(part) < 3:
            continue
        code = part[:-2] * np.uint32(0x9E3779B1) ^ part[1:-1] * np.uint32(0x85EBCA77) ^ part[2:] * np.uint32(0xC2B2AE3D)
        code = (code * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int64)
        for row in range(first, end):
            a, b = bounds[row] - bounds[first], bounds[row + 1] - bounds[first] - 2
            if b > a:
                out[row] = np.bincount(code[a:b], minlength=BUCKETS)
    out = np.sqrt(out)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norms, 1e-9)


@dataclass
class LanguageModel:
    """Family machines and the pairwise machines of each family."""

    languages: list[str]
    families: dict[str, list[str]] = field(default_factory=dict)
    heads: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)
    #: Known byte 3-grams and the least share of them in a text of the learned languages.
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    floor: float = 0.0

    def known(self) -> np.ndarray:
        table = np.zeros(1 << 24, bool)
        table[self.grams] = True
        return table

    def predict(self, points: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score: the share of the family times the least pairwise certainty of the winner."""
        names = list(self.families)
        if len(names) > 1:
            margins = np.stack([points @ self.heads[n][0] + self.heads[n][1] for n in names], axis=1)
            chances = 1 / (1 + np.exp(-4 * margins))
            best = margins.argmax(axis=1)
            sure = chances[np.arange(len(points)), best] / np.maximum(chances.sum(axis=1), 1e-12)
        else:
            best, sure = np.zeros(len(points), np.int64), np.ones(len(points))
        found = np.empty(len(points), object)
        for place, name in enumerate(names):
            rows = np.flatnonzero(best == place)
            members = self.families[name]
            votes = np.zeros((len(rows), len(members)))
            least = np.ones((len(rows), len(members)))
            for i, one in enumerate(members):
                for j in range(i + 1, len(members)):
                    weights, bias = self.pairs[one, members[j]]
                    chance = 1 / (1 + np.exp(-4 * (points[rows] @ weights + bias)))
                    votes[:, i] += chance >= 0.5
                    votes[:, j] += chance < 0.5
                    least[:, i] = np.minimum(least[:, i], chance)
                    least[:, j] = np.minimum(least[:, j], 1 - chance)
            winner = (votes + least * 0.5).argmax(axis=1)
            found[rows] = np.array(members, object)[winner]
            sure[rows] *= least[np.arange(len(rows)), winner]
        return found.tolist(), sure


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from rows with a language outside the held-out fifth; the sample is bounded by ``per_language``."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    sample = bounded_sample(learn, "lang", "text", per_language)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                rows = [r.astype("<f2").tobytes() for r in profiles(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["lang", "profile"])

    # Bounded: per_language rows of 8 KB for each language.
    rows = sample.mapInArrow(tidy(describe), "lang string, profile binary").collect()
    points = {}
    for lang in sorted({r.lang for r in rows}):
        own = np.stack([np.frombuffer(r.profile, "<f2").astype(np.float32) for r in rows if r.lang == lang])
        own = own[own.any(axis=1)]
        if len(own):
            points[lang] = own[np.lexsort(own.T[:4])]
    model = LanguageModel(sorted(points))
    for lang in model.languages:
        model.families.setdefault(family(lang), []).append(lang)
    if len(model.families) > 1:
        every = np.concatenate([points[x] for x in model.languages])
        kinds = np.concatenate([[family(x)] * len(points[x]) for x in model.languages])
        for name in model.families:
            model.heads[name] = hinge_machine(every, np.where(kinds == name, 1.0, -1.0))
    for members in model.families.values():
        for i, one in enumerate(members):
            for two in members[i + 1 :]:
                both = np.concatenate([points[one], points[two]])
                signs = np.concatenate([np.ones(len(points[one])), -np.ones(len(points[two]))])
                model.pairs[one, two] = hinge_machine(both, signs)
    if points:
        _fit_known(model, learn, sample)
    return model


def _fit_known(model: LanguageModel, learn: DataFrame, sample: DataFrame) -> None:
    """Known 3-grams from the sample; the least share of them from all rows learned from."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(_letters(batch.column(1)))
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a >= 3:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(_codes(data[a:b])))], ["gram"])

    counts = sample.mapInArrow(tidy(distinct), "gram int").groupBy("gram").count()
    # At most the distinct 3-grams of the sample.
    model.grams = np.array(sorted(r.gram for r in counts.where("count >= 2").select("gram").collect()), np.int32)

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                data, bounds = utf8(_letters(batch.column(0).slice(first, ROWS)))
                shares = known_shares(data, bounds, known)[np.diff(bounds) >= 3]
                yield pa.RecordBatch.from_arrays([pa.array(np.ceil((1 - shares) * 10_000).astype(np.int32))], ["missed"])

    # At most 10,001 rows.
    found = sorted((r.missed, r["count"]) for r in learn.select("text").mapInArrow(tidy(missed), "missed int").groupBy("missed").count().collect())
    if not found:
        return
    below = np.cumsum([n for _, n in found])
    most, usual = (found[int(np.searchsorted(below, below[-1] * part))][0] / 10_000 for part in (0.999, 0.5))
    # From a few texts hardly any 3-gram is known twice: then less is asked, by what half of the rows have.
    model.floor = min(0.8, max(1 - SLACK * most, min(0.5, 0.6 * (1 - usual))))


def identify(docs: DataFrame, model: LanguageModel, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` with the language and its score; ``added`` names them, and replaces columns of those names."""
    docs = docs.drop(*added)
    names = docs.columns
    place = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.known()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                data, bounds = utf8(_letters(part.column(place)))
                points = _profiles(data, bounds)
                blank = ~points.any(axis=1)
                if model.languages:
                    found, sure = model.predict(points)
                    sure = np.where(known_shares(data, bounds, known) < model.floor, 0.0, sure)
                else:
                    found, sure, blank = [], np.zeros(len(points)), np.ones(len(points), bool)
                found = ["und" if b else found[i] for i, b in enumerate(blank)]
                arrays = [part.column(i) for i in range(len(names))]
                arrays += [pa.array(found, pa.string()), pa.array(np.where(blank, 0.0, sure).astype(float), pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*names, *added])

    return docs.mapInArrow(tidy(run), schema + f", `{added[0]}` string, `{added[1]}` double")


def language_digest(docs: DataFrame) -> DataFrame:
    """The language query's columns."""
    found = identify(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

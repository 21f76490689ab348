"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

A word that is to be matched is cut into two disjoint chunks, its halves.  Its partner, of the same length or
one code point shorter, contributes its positional grams of the chunks' sizes.  One edit destroys at most
one of two disjoint chunks, so the other one is a gram of the partner, at the same position or (behind an
inserted code point) one earlier: chunks and grams join on length, chunk and text with positions within
shift one, and the rest of the two words decides.

A chunk may be shared by any share of all words (``inter...``, ``...ation``).  Groups of more than ``PAIRS``
chunk-gram pairs are not paired: the open rest of each of their words is cut into two disjoint chunks by
the same rule, one more of which the edit preserves, and these join along with the first.  This repeats, in
at most log2(length) rounds, until groups are small or the rest is one code point, where every pair left is
a pair of different code points at one place.  No group is cut short, and none is paired whole.

Each pair of words is found once: of the rests that may hold the edit, the one with the first differing place counts.

Words come from texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  Where 199 divides
the CRC of ``<id>:<run>``, the run loses the code point at CRC modulo length.  Words of at least ``shortest`` code
points that occur ``least`` times take part.  A word's form is its near word of the largest count, if that is
at least ``ratio`` times its own; the root follows forms to the last.  Counts grow along forms, so there are
no cycles, and roots are found by doubling.

Defined cases: a null text has no words; a null id counts as an empty one; empty texts and tables give
no rows; repeated rows count each; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltomics.llm.common import passes, utf8
from quiltomics.session import settled

#: Chunk-gram pairs of a group that are compared without cutting their rests again.
PAIRS = 4096
_WINDOW = 2 << 20
_HELD = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased runs of letters of many UTF-8 texts, and the text of each."""
    lead = data == 0xC3  # U+00C0 to U+00FF are 0xC3 and one more byte
    word = _LETTER[data] | lead
    word[1:] |= lead[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first, last = word.copy(), word.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[inner] = True
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = data | (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[word])])
    return words.dictionary_encode(), np.searchsorted(bounds, starts, side="right") - 1


def _changed(run: bytes, crc: int) -> str:
    text = run.decode()
    place = crc % len(text)
    return text[:place] + text[place + 1 :]


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word, n`` of the words that occur often enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            data, bounds = utf8(batch.column(1))
            seeds = [zlib.crc32(f"{x}:".encode()) for x in batch.column(0).to_pylist()]
            for start, end in passes(bounds, _WINDOW):
                coded, rows = _runs(data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start])
                if not len(coded):
                    continue
                runs = coded.dictionary.to_pylist()
                key, counts = np.unique(rows * len(runs) + coded.indices.to_numpy(), return_counts=True)
                ids = key % len(runs)
                owners = (key // len(runs) + start).tolist()
                crcs = np.fromiter(map(zlib.crc32, map(runs.__getitem__, ids.tolist()), map(seeds.__getitem__, owners)), np.int64, len(key))
                hit = crcs % 199 == 0
                texts = coded.dictionary.cast(pa.string())
                long_enough = np.array([len(t) >= shortest for t in texts.to_pylist()], bool)
                kept = np.bincount(ids[~hit], counts[~hit], len(runs)).astype(np.int64)
                for place in np.flatnonzero(long_enough & (kept > 0)).tolist():
                    found[texts[place].as_py()] += int(kept[place])
                for place in np.flatnonzero(hit).tolist():
                    word = _changed(runs[ids[place]], int(crcs[place]))
                    if len(word) >= shortest:
                        found[word] += int(counts[place])
                if len(found) >= _HELD:
                    yield batch_of()
        if found:
            yield batch_of()

    texts = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def _half(low: Column, high: Column) -> Column:
    return low + F.floor((high - low) / 2).cast("int")


def _rests(rows: DataFrame) -> DataFrame:
    """Cut the open rest ``lo..hi`` (places in the matched word) in two: either half may hold the edit.

    The other half is a chunk of the matched word, which joins the key; a partner gives its gram there, at
    the same place if it lies before the open half, ``shift`` earlier if behind it.
    """
    middle = _half(F.col("lo"), F.col("hi"))
    back = F.when(F.col("asks"), F.lit(0)).otherwise(F.col("shift"))

    def gram(start: Column, end: Column, moved: Column) -> Column:
        return F.substring(F.col("word"), start - moved + 1, end - start)

    # Open half first: the gram behind it is moved.  Open half last: the gram before it stands.
    first = F.struct(F.col("lo").alias("lo"), middle.alias("hi"), gram(middle, F.col("hi"), back).alias("gram"), F.lit("b").alias("side"))
    last = F.struct(middle.alias("lo"), F.col("hi").alias("hi"), gram(F.col("lo"), middle, F.lit(0)).alias("gram"), F.lit("a").alias("side"))
    cut = rows.withColumn("_c", F.explode(F.array(first, last)))
    return cut.select(
        "word", "n", "asks", "shift", "length", F.col("_c.lo").alias("lo"), F.col("_c.hi").alias("hi"),
        # Grams end at a sign no word has.
        F.concat(F.col("key"), F.col("_c.side"), F.col("_c.gram"), F.lit("|")).alias("key"),
    )


def near_pairs(words: DataFrame, pairs: int | None = None) -> DataFrame:
    """``x, nx, y, ny``: all pairs of different words one edit apart, once, from ``word, n``; x is not the shorter one."""
    limit = PAIRS if pairs is None else pairs
    base = words.select("word", "n", F.char_length("word").cast("int").alias("_own"))
    # A word asks partners of its length and one shorter; as a partner it answers words of its length and one longer.
    roles = F.array(*[
        F.struct(F.lit(asks).alias("asks"), F.lit(shift).alias("shift"), (F.col("_own") + (0 if asks else shift)).cast("int").alias("length"))
        for asks in (True, False)
        for shift in (0, 1)
    ])
    rows = base.select("word", "n", F.explode(roles).alias("r")).select(
        "word", "n", "r.asks", "r.shift", "r.length", F.lit(0).alias("lo"), F.col("r.length").alias("hi"), F.lit("").alias("key")
    )
    group = ["length", "shift", "lo", "hi", "key"]
    open_rows, found = _rests(rows), None
    while True:
        open_rows = settled(open_rows, "chunks")
        sizes = open_rows.groupBy(*group).agg(F.count_if("asks").alias("_a"), F.count_if(~F.col("asks")).alias("_b"))
        sizes = settled(
            sizes.where((F.col("_a") > 0) & (F.col("_b") > 0)).select(
                *group, ((F.col("_a").cast("double") * F.col("_b") > limit) & (F.col("hi") - F.col("lo") > 1)).alias("_heavy")
            ),
            "chunk-groups",
        )
        light = open_rows.join(sizes.where(~F.col("_heavy")), group, "left_semi")
        asking = light.where("asks").select(*group, F.col("word").alias("x"), F.col("n").alias("nx"))
        answers = light.where("NOT asks").select(*group, F.col("word").alias("y"), F.col("n").alias("ny"))
        some = asking.join(answers, group).where(_one_edit()).select("x", "nx", "y", "ny")
        found = some if found is None else found.unionByName(some)
        if sizes.where("_heavy").isEmpty():
            return found
        open_rows = _rests(open_rows.join(sizes.where("_heavy"), group, "left_semi"))


def _one_edit() -> Column:
    """The rests of x and y differ by one edit whose first place lies in the rest."""
    size = F.col("hi") - F.col("lo")
    one, two = F.substring("x", F.col("lo") + 1, size), F.substring("y", F.col("lo") + 1, size - F.col("shift"))
    # Code points of two rests of one length that differ.
    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    differing = F.size(F.filter(places, lambda i: F.substring(one, i, F.lit(1)) != F.substring(two, i, F.lit(1))))
    replaced = (F.col("shift") == 0) & (F.col("x") < F.col("y")) & (differing == 1)
    dropped = F.exists(places, lambda i: F.concat(F.substring(one, F.lit(1), i - 1), F.substring(one, i + 1, size)) == two)
    # With the same code points up to the end of the rest, the edit can be placed behind it, and is found there.
    inserted = (F.col("shift") == 1) & dropped & (F.substring("y", F.col("lo") + 1, size) != one)
    return replaced | inserted


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form, by doubling."""
    known = settled(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = known.join(further, "root", "left")
        step = settled(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        known = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return known


def spelling_variants(
    docs: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every word with its form, root, count, number of near words and the form's count."""
    words = settled(word_counts(docs, shortest, least, id_column, text_column), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("x").alias("word"), F.col("nx").alias("n"), F.col("y").alias("near"), F.col("ny").alias("m")).union(
        pairs.select("y", "ny", "x", "nx")
    )
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("b"))
    forms = settled(
        best.select(
            "word", "n_near",
            F.when(-F.col("b.m") >= F.col("n") * ratio, F.col("b.near")).alias("form"),
            F.when(-F.col("b.m") >= F.col("n") * ratio, -F.col("b.m")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(forms.where(F.col("form").isNotNull()))
    return (
        words.join(forms, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"),
        )
    )

"""Phrase collocations by stripes: a prefix keys an associative counter of the words that follow it.

Level m counts the phrases of m words: a task turns its texts into stripes ``prefix -> {next word: count}``
(the empty prefix counts single words), stripes meet by prefix, and counters are merged element by element.
The merged stripes are one table of extensions ``lang, prefix, next, f`` from which everything else follows:
what a phrase occurs (its own extension), what its parts occur (extensions one or more levels up), and by how
much a longer phrase subsumes it (the largest extension of a prefix, or of a phrase without its first word).

A phrase can be frequent only where all its parts are.  So level m counts only phrases whose two parts of
m - 1 words may be frequent, which tasks look up in a bit table of the frequent phrases one level down.  The
table has 16 bits for each of them, up to ``FILTER_BITS``: beyond that it lets more infrequent phrases
through to be counted, and never stops a frequent one.

Hot prefixes: the stripes of the empty prefix and of every phrase that makes up a 1,024th of all words are cut
into slices by the next word (512 and 64), so no task merges the whole counter of a frequent word, and tasks
count before anything is shuffled.

Defined cases: a null text is empty, a null language is ``und``; texts without words add nothing; repeated
rows count each; an empty table gives no rows; a text of any length is cut into windows that overlap by the
words of a phrase; other columns are ignored.  Words are compared as text, never by hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiltomics.llm.common import WordHasher, mixed
from quiltomics.session import settled

#: Bytes of text that a task counts at a time.
WINDOW = 6 << 20
#: Largest bit table of frequent phrases (32 MB).
FILTER_BITS = 1 << 28
_ROWS = 100_000
_WORD_SLICES, _SLICES = 512, 64
#: A phrase that makes up this part of all words is hot; there are at most so many of one length.
HOT = 1024

_BREAK = re.compile(rb"[ \t.,;:!?\n-\r]")
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_PLACES = mixed(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)
_STRIPES = "lang string, prefix string, slice int, nexts string, counts string"


def windows(data: bytes, size: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """Stretches of about ``limit`` bytes, and how many bytes of each are its own.

    What follows is the ``size - 1`` words that phrases begun in the stretch may reach.
    """
    tail = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n-\r]+){0,%d}" % (size - 1))
    start = 0
    while len(data) - start > limit:
        cut = _BREAK.search(data, start + limit)
        if cut is None:
            break
        yield data[start : tail.match(data, cut.start()).end()], cut.start() - start
        start = cut.start()
    yield data[start:], len(data) - start


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang))


def _phrase_hashes(words: np.ndarray, size: int, seed: np.uint64 | np.ndarray) -> np.ndarray:
    """Hash of the ``size`` words from every place on."""
    total = np.zeros(max(0, len(words) - size + 1), np.uint64) + seed
    for place in range(size):
        total += words[place : place + len(total)] * _PLACES[place]
    return mixed(total)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _listed(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = _places(hashes, len(table) * 64)
    six, low = np.uint64(6), np.uint64(63)
    return ((table[one >> six] >> (one & low)) & (table[two >> six] >> (two & low)) & np.uint64(1)).astype(bool)


def _joined(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), " ")


class StripeCounter:
    """Stripes of one level; ``known`` is the bit table of the level below (none for single words), ``hot`` hashes of its hot phrases."""

    def __init__(self, size: int, known: np.ndarray | None, hot: np.ndarray | None = None) -> None:
        self.size, self.known, self.hasher = size, known, WordHasher()
        self.hot = np.zeros(0, np.uint64) if hot is None else hot

    def stripes(self, data: bytes, own: int, lang: str) -> pa.Table | None:
        """Stripes of the phrases that begin in the first ``own`` bytes."""
        raw = np.frombuffer(data, np.uint8)
        low = raw | (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
        kind = _KIND[low]
        word = kind == 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return None
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[word])])
        coded = words.dictionary_encode()
        ids, lexicon = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
        begun = int(np.searchsorted(starts, own))
        hashes = self._hashes(coded.dictionary)
        if self.size == 1:
            counts = np.bincount(ids[:begun], minlength=len(lexicon))
            kept = np.flatnonzero(counts)
            total = pa.table([[lang], [""], pa.array([0], pa.int32()), [""], [str(begun)]], ["lang", "prefix", "slice", "nexts", "counts"])
            slices = hashes[kept] % np.uint64(_WORD_SLICES)
            rows = self._rows(lang, lexicon, np.zeros(len(kept), np.int64), kept, counts[kept], slices, None)
            return pa.concat_tables([total, rows])
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        parts = _phrase_hashes(hashes[ids], self.size - 1, _seed(lang))
        places = self._candidates(parts, piece, begun)
        if not len(places):
            return None
        key, width, distinct = ids[places], len(lexicon), len(lexicon)
        for step in range(1, self.size):
            if distinct * width >= 1 << 62:
                found, key = np.unique(key, return_inverse=True)
                distinct = len(found)
            key, distinct = key * width + ids[places + step], distinct * width
        key, first, counts = np.unique(key, return_index=True, return_counts=True)
        first = places[first]
        slices = np.where(np.isin(parts[first], self.hot), hashes[key % width] % np.uint64(_SLICES), np.uint64(0))
        return self._rows(lang, lexicon, key // width, key % width, counts, slices, ids[first[:, None] + np.arange(self.size - 1)])

    def _hashes(self, lexicon: pa.Array) -> np.ndarray:
        _, offsets, data = lexicon.buffers()
        bounds = np.frombuffer(offsets, np.int64)[lexicon.offset : lexicon.offset + len(lexicon) + 1]
        return self.hasher.words(np.frombuffer(data, np.uint8)[: bounds[-1]], bounds)[0]

    def _candidates(self, parts: np.ndarray, piece: np.ndarray, begun: int) -> np.ndarray:
        """Places of phrases inside one piece of which both parts may be frequent."""
        count = len(piece) - self.size + 1
        if count <= 0:
            return np.zeros(0, np.int64)
        part = _listed(self.known, parts)
        sound = part[:count] & part[1 : count + 1] & (piece[:count] == piece[self.size - 1 :])
        return np.flatnonzero(sound[:begun])

    def _rows(self, lang: str, lexicon: pa.Array, prefix: np.ndarray, following: np.ndarray, counts: np.ndarray, slices: np.ndarray, words: np.ndarray | None) -> pa.Table:
        """One row for each prefix and slice of next words."""
        slices = slices.astype(np.int64)
        order = np.lexsort((slices, prefix))
        prefix, slices, following, counts = prefix[order], slices[order], following[order], counts[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (prefix[1:] != prefix[:-1]) | (slices[1:] != slices[:-1])
        starts = np.flatnonzero(fresh)
        bounds = np.append(starts, len(order))
        if words is None:
            names = pa.array([""] * len(starts), pa.string())
        else:
            columns = words[order[starts]]
            names = pc.binary_join_element_wise(*[lexicon.take(pa.array(columns[:, j])) for j in range(columns.shape[1])], " ")
        return pa.table({
            "lang": pa.array([lang] * len(starts), pa.string()),
            "prefix": names,
            "slice": pa.array(slices[starts], pa.int32()),
            "nexts": _joined(lexicon.take(pa.array(following)), bounds),
            "counts": _joined(pa.array(counts).cast(pa.string()), bounds),
        })


def _counted(size: int, known: object, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = StripeCounter(size, *(known.value if known is not None else (None, None)))
        held: dict[str, list[bytes]] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                # A line break between texts ends a piece.
                for data, own in windows(b"\n".join(texts), size, limit):
                    rows = counter.stripes(data, own, lang)
                    if rows is not None:
                        yield from rows.combine_chunks().to_batches(_ROWS)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                text = text.as_py()
                held.setdefault(lang, []).append(text)
                total += len(text)
                if total >= limit:
                    yield from flush()
                    total = 0
        yield from flush()

    return run


def _extensions(docs: DataFrame, size: int, known: object, least: int) -> DataFrame:
    """Merged stripes of one level: extensions that occur ``least`` times (and all words, as next word '')."""
    stripes = docs.mapInArrow(_counted(size, known, WINDOW), _STRIPES)
    each = F.explode(F.arrays_zip(F.split("nexts", " ").alias("next"), F.split("counts", " ").alias("f"))).alias("e")
    # Slices of a prefix meet whole; the sums below need no further exchange.
    merged = (
        stripes.repartition("lang", "prefix", "slice")
        .select("lang", "prefix", "slice", each)
        .groupBy("lang", "prefix", "slice", F.col("e.next").alias("next"))
        .agg(F.sum(F.col("e.f").cast("long")).alias("f"))
    )
    return merged.where((F.col("f") >= least) | (F.col("next") == "")).select("lang", "prefix", "next", "f")


def _phrase(prefix: str = "prefix", following: str = "next") -> Column:
    return F.when(F.col(prefix) == "", F.col(following)).otherwise(F.concat_ws(" ", prefix, following))


def _text_hashes(langs: list[str], phrases: pa.Array, size: int) -> np.ndarray:
    """Hashes of phrases of ``size`` words given as text."""
    texts = phrases.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    words = WordHasher().words(np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0])[0]
    total = np.array([_seed(x) for x in langs], np.uint64)
    for place in range(size):
        total += words.reshape(-1, size)[:, place] * _PLACES[place]
    return mixed(total)


def _bit_table(spark: SparkSession, phrases: DataFrame, size: int, total: int) -> object:
    """Broadcast bit table of ``lang, phrase, f`` rows of ``size`` words (its size is bounded by ``FILTER_BITS``), and hashes of the hot ones."""
    count = phrases.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * count - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _text_hashes(batch.column(0).to_pylist(), batch.column(1), size)
            found = np.unique(np.concatenate(_places(hashes, bits)))
            masks = (np.uint64(1) << (found & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(6)).astype(np.int64)), pa.array(masks)], ["place", "mask"])

    # At most FILTER_BITS / 64 rows of two numbers.
    marks = phrases.select("lang", "phrase").mapInArrow(mark, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[marks.column("place").to_numpy()] = marks.column("mask").to_numpy().view(np.uint64)
    # They occur total / HOT times each, so there are at most HOT x size of them.
    rows = phrases.where(F.col("f") * HOT >= total).select("lang", "phrase").collect()
    hot = _text_hashes([r.lang for r in rows], pa.array([r.phrase for r in rows], pa.string()), size) if rows else np.zeros(0, np.uint64)
    return spark.sparkContext.broadcast((table, np.sort(hot)))


def score_of(a: Column, parts: Column) -> Column:
    """``floor(2000000 * a / parts)`` in whole numbers of 38 digits."""
    product, whole = a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)"), parts.cast("decimal(20,0)")
    # The remainder goes first, so the quotient has no fraction that could be rounded.
    return ((product - product % whole) / whole).cast("decimal(38,0)").cast("long")


def collocations(
    docs: DataFrame,
    size: int = 4,
    least: int = 30,
    keep: int = 2000,
    subsumed: int = 80,
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """The best phrases of 2 to ``size`` words of each language that occur ``least`` times.

    The score of a phrase is that of its worst cut; a phrase goes when a longer one that holds it occurs
    at least ``subsumed`` percent as often.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(lang_column, F.lit("und")).alias("lang"), F.coalesce(text_column, F.lit("")).alias("text"))
    levels, known, total = [], None, 0
    for words in range(1, size + 1):
        level = settled(_extensions(texts, words, known, least), "stripes")
        levels.append(level.withColumn("size", F.lit(words)))
        if words == 1:
            total = level.where(F.col("next") == "").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        if words < size:
            known = _bit_table(spark, level.where(F.col("next") != "").select("lang", _phrase().alias("phrase"), "f"), words, total)
    extensions = levels[0]
    for level in levels[1:]:
        extensions = extensions.unionByName(level)
    totals = extensions.where(F.col("next") == "").groupBy("lang").agg(F.sum("f").alias("n"))
    counted = extensions.where(F.col("next") != "").select("lang", "size", "prefix", _phrase().alias("phrase"), "f")

    # Largest extension of a phrase to the right (it is the prefix) or to the left (it is all but the first word).
    longer = counted.where(F.col("size") > 2)
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    inside = longer.select("lang", "f", F.explode(F.array(F.col("prefix"), rest)).alias("phrase"))
    maxima = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))

    candidates = counted.where(F.col("size") > 1).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"),
    )
    part = counted.where(F.col("size") < size)
    heads = part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score_of(F.col("a"), F.col("l") + F.col("r")))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c"))
    free = worst.join(maxima, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.col("longest") * 100 < F.col("c.a") * subsumed)
    )
    rows = free.select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # Two steps, so that the last one gets 16 x keep rows of a language at most.
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    for groups in (["lang", "_salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= keep)
    return salted.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM g, (VALUES (1), (2), (3), (4)) s(m) WHERE i + m - 1 <= len(w) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30
), k AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM c, (VALUES (1), (2), (3)) s(k) WHERE k < m
), s AS (
  SELECT k.lang, k.phrase, a, k, h.f AS l, t.f AS r,
    CAST((CAST(2000000 AS HUGEINT) * a) // (h.f + t.f) AS BIGINT) AS score
  FROM k JOIN f h ON h.lang = k.lang AND h.phrase = k.head JOIN f t ON t.lang = k.lang AND t.phrase = k.tail
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), x AS (
  SELECT lang, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase, a FROM c WHERE m > 2
), y AS (
  SELECT lang, phrase, max(a) AS longest FROM x GROUP BY lang, phrase
), z AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN y ON y.lang = b.lang AND y.phrase = b.phrase
  WHERE longest IS NULL OR 100 * longest < 80 * a
)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""

"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole, by a byte-level tokenizer.  Every token's span in the text follows
from the bytes its id stands for.  Sections are spans of the text (by default its lines, each with its
line break, so that sections tile the document); tokens are joined to them by interval, with one binary
search per document.  A token that crosses a boundary belongs to the section that holds most of its
bytes, and to the earlier of two that hold as many.

Defined cases: null and empty texts have one empty section and no tokens; repeated rows are counted
each; sections may be given in any order but must not overlap, and a token outside of all sections is
counted by section -1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltomics.llm.tokenizing import byte_encoding

_ENCODINGS: dict[str, tuple] = {}


def _encoding(path: str) -> tuple:
    """This worker's encoding and the byte length of every id."""
    if path not in _ENCODINGS:
        encoding = byte_encoding(path)
        sizes = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)], np.int64)
        _ENCODINGS[path] = encoding, sizes
    return _ENCODINGS[path]


def token_ends(text: str, path: str) -> np.ndarray:
    """End of each token of a text, in bytes."""
    encoding, sizes = _encoding(path)
    return np.cumsum(sizes[np.array(encoding.encode_ordinary(text), np.int64)])


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the lines of a text, line breaks included."""
    breaks = np.flatnonzero(raw == 10) + 1
    ends = np.append(breaks, len(raw)) if not len(breaks) or breaks[-1] < len(raw) else breaks
    return np.append(0, ends[:-1]), ends


def attribute(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses a boundary; sections in order, not overlapping.

    A token can reach over many short sections; each step gives it to the next one if that holds more of it.
    """
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    best, most = np.full(len(ends), -1), np.zeros(len(ends), np.int64)
    place = np.searchsorted(stops, begins, side="right")
    parts = np.zeros(len(ends), np.int64)
    while len(starts):
        open_ = np.flatnonzero((place < len(starts)) & (starts[np.minimum(place, len(starts) - 1)] < ends))
        if not len(open_):
            break
        at = place[open_]
        held = np.minimum(ends[open_], stops[at]) - np.maximum(begins[open_], starts[at])
        parts[open_] += held > 0
        better = held > most[open_]
        best[open_[better]], most[open_[better]] = at[better], held[better]
        place[open_] += 1
    return best, (parts > 1) | ((parts == 1) & (most < ends - begins))


def section_tokens(docs: DataFrame, path: str, spans: str | None = None) -> DataFrame:
    """``doc_id, section, start_char, end_char, n_tokens, n_crossing`` for every section of every document.

    ``spans`` names a column of array<struct<start int, end int>> in characters; by default lines are the sections.
    """
    schema = "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long"
    columns = ["doc_id", "text"] + ([spans] if spans else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                given = part.column(2).to_pylist() if spans else [None] * part.num_rows
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                for key, text, sections in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), given):
                    text = text or ""
                    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
                    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # characters begun before each byte
                    if spans:
                        wanted = np.array([(s["start"], s["end"]) for s in sections or []], np.int64).reshape(-1, 2)
                        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                        wanted = at[wanted.clip(0, len(at) - 1)]
                        order = np.argsort(wanted[:, 0], kind="stable")
                        starts, stops = wanted[order, 0], wanted[order, 1]
                    else:
                        order, (starts, stops) = None, line_spans(raw)
                    found, crossing = attribute(token_ends(text, path), starts, stops)
                    count = np.bincount(found + 1, minlength=len(starts) + 1)
                    across = np.bincount((found + 1)[crossing], minlength=len(starts) + 1)
                    names = np.arange(len(starts)) if order is None else order
                    rows = slice(0 if count[0] else 1, None)
                    out[0].append(np.full(len(count[rows]), key))
                    out[1].append(np.append(-1, names)[rows])
                    out[2].append(np.append(0, chars[starts])[rows])
                    out[3].append(np.append(len(text), chars[stops])[rows])
                    out[4].append(count[rows])
                    out[5].append(across[rows])
                arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in out]
                yield pa.RecordBatch.from_arrays(
                    arrays, ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns[1:]).mapInArrow(run, schema)

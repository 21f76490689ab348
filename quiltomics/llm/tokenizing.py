"""Public tokenizers inside tasks; the vocabulary's path is a parameter."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

import numpy as np

from quiltomics.llm.common import kept

#: Chunks kept by one worker; above it the store starts anew (about 200 bytes a chunk).
CHUNKS = 1_000_000
_LONG = 64
#: Marks behind a word of Latin letters, which a tokenizer that cuts words from marks codes apart.
_MARKS = ".,;:!?)*%"
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: What tells whether a tokenizer does so and lower-cases: a word and marks, and their ids one after the other.
_PROBES = (("\u00c9tude", "***"), ("Word", ".,;:!?)*%"), ("caf\u00e9", "%"), ("s", "."), ("ll", ":"))


class ChunkEncoder:
    """Exact ids of whole texts for a tokenizer that drops white space and never joins across it.

    Each distinct chunk between blanks is encoded once, many chunks in one call; the ids of a text are
    its chunks' ids in order.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._chunks: dict[str, bytes] = {"": b""}
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._plain = all(self._ids(w + m) == self._ids(w.lower()) + self._ids(m) for w, m in _PROBES)

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: Iterable[str], store: dict[str, bytes]) -> None:
        """Put the ids of chunks into the store; words with marks are put together from both."""
        if not self._plain:
            self._code(list(chunks), store)
            return
        joined, words, rest = [], set(), set()
        for chunk in chunks:
            word = chunk.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or _LATIN(word)):
                marks = chunk[len(word) :]
                word = word.lower()
                joined.append((chunk, word, marks))
                words.add(word)
                rest.add(marks)
            else:
                rest.add(chunk)
        self._code_words(list(words.difference(store)), store)
        self._code(list(rest.difference(store)), store)
        for chunk, word, marks in joined:
            store[chunk] = store[word] + store[marks]

    def _code_words(self, words: list[str], store: dict[str, bytes]) -> None:
        """The same as ``_code`` for words of letters alone, told apart by the tokens that end a word."""
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            if len(cuts) != len(part) or cuts[-1] != 4 * len(ids):
                self._code(part, store)
                continue
            raw = ids.tobytes()
            store.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))

    def _code(self, chunks: list[str], store: dict[str, bytes]) -> None:
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            coded = self._tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(coded.ids, dtype="<u4")
            at = np.array(coded.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            starts = np.cumsum([0] + [len(c) + 1 for c in part[:-1]])
            cuts = np.searchsorted(at, starts).tolist() + [len(ids)]
            raw = ids.tobytes()
            for chunk, a, b in zip(part, cuts, cuts[1:]):
                store[chunk] = raw[4 * a : 4 * b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self._chunks) > CHUNKS:
            self._chunks = {"": b""}
        chunks = self._chunks
        fresh = set(chain.from_iterable(split)).difference(chunks)
        if fresh:
            long = [c for c in fresh if len(c) > _LONG]
            self._learn(fresh.difference(long), chunks)
            if long:
                chunks = _Overlay(chunks)
                for c in long:
                    self._code([c], chunks.extra)
        get = chunks.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


class _Overlay:
    """The kept chunks and, for one call, the long ones that are not kept."""

    def __init__(self, kept: dict[str, bytes]) -> None:
        self.kept, self.extra = kept, {}

    def __getitem__(self, chunk: str) -> bytes:
        found = self.kept.get(chunk)
        return self.extra[chunk] if found is None else found


def chunk_encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file; tasks that do not keep ``path`` let it go."""
    return kept(path, lambda: ChunkEncoder(path))


def byte_encoding(path: str):
    """A byte-level BPE from a rank file, without special tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

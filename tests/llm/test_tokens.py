import numpy as np
import public_tokenizers
from collections import defaultdict

from quiltomics.llm.tokens import attribute, section_tokens, token_ends

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = {
    1: None, 2: "", 3: "one line", 4: "two\nlines", 5: "trailing\n", 6: "\n\n  \n\nblank\n\n\n\nlines\n",
    7: "héllo wörld\n日本語テキスト\n👩‍👩‍👧 done", 8: "word " * 50_000, 9: "a\r\nb\tc\n",
}


def brute(text):
    """Bytes of each token counted line by line."""
    raw, counts, crossing = (text or "").encode(), defaultdict(int), defaultdict(int)
    line = np.append(0, np.cumsum(np.frombuffer(raw, np.uint8) == 10))[:-1] if raw else []
    start = 0
    for end in token_ends(text or "", PATH):
        lines, times = np.unique(line[start:end], return_counts=True)
        best = int(lines[times.argmax()])
        counts[best] += 1
        crossing[best] += len(lines) > 1
        start = end
    return counts, crossing, start


def test_lines_match_bytewise_count(spark):
    data = [(i, t, 3, "s") for i, t in TEXTS.items()] + [(3, TEXTS[3], 3, "s")]
    rows = section_tokens(spark.createDataFrame(data, "doc_id long, text string, section int, n_tokens string"), PATH).collect()
    for key, text in TEXTS.items():
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.section)
        if key == 3:
            assert own[0] == own[1]
            own = own[:1]
        counts, crossing, end = brute(text)
        assert end == len((text or "").encode())
        assert {r.section: r.n_tokens for r in own if r.n_tokens} == dict(counts)
        assert {r.section: r.n_crossing for r in own if r.n_crossing} == {k: v for k, v in crossing.items() if v}
        # Sections tile the text.
        assert own[0].start_char == 0 and own[-1].end_char == len(text or "")
        assert all(a.end_char == b.start_char for a, b in zip(own, own[1:]))
        assert [(text or "")[r.start_char : r.end_char] for r in own] == ((text or "").split("\n") and _lines(text or ""))


def _lines(text):
    parts = [p + "\n" for p in text.split("\n")]
    parts[-1] = parts[-1][:-1]
    return parts if parts[-1] or len(parts) == 1 else parts[:-1]


def test_given_sections_and_the_rest(spark):
    text = "title here\nbody of é text, and more"
    spans = [(11, 20), (0, 5)]
    data = [(1, text, [{"start": a, "end": b} for a, b in spans]), (2, text, None), (3, None, [])]
    docs = spark.createDataFrame(data, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    rows = section_tokens(docs, PATH, "parts").collect()
    total = len(token_ends(text, PATH))
    for key in (1, 2):
        assert sum(r.n_tokens for r in rows if r.doc_id == key) == total
    assert {(r.section, r.start_char, r.end_char) for r in rows if r.doc_id == 1 and r.section >= 0} == {(0, 11, 20), (1, 0, 5)}
    assert {r.section for r in rows if r.doc_id == 2} == {-1} and not [r for r in rows if r.doc_id == 3]


def test_rule_for_crossing_tokens():
    ends = np.array([2, 6, 9])
    found, crossing = attribute(ends, np.array([0, 4, 7]), np.array([4, 7, 9]))
    # Token 2-6 lies half in each of two sections: the earlier one; 6-9 has one byte, then two.
    assert found.tolist() == [0, 0, 2] and crossing.tolist() == [False, True, True]


def test_empty_table(spark):
    assert section_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

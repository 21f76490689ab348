import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quiltomics.llm.packing import cutting_patterns, pack, packing_digest, sequences, token_pieces
from quiltomics.llm.tokenizing import ChunkEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  \n\t ", "Hello  WORLD's don't", "<|endoftext|> a<|startoftext|>b", "é café x y", "日本語 テキスト",
    "a" * 300 + " b" * 50, "x\u001cy\u0085z", "ÄÖÜ ß ǅ İ", "tab\tnew\r\nline", "👩‍👩‍👧 12345 №",
]


def direct(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def test_chunks_give_the_tokenizers_ids():
    encoder = ChunkEncoder(PATH)
    for _ in range(2):
        assert [list(np.frombuffer(raw, "<u4")) for raw in encoder.encode(ODD)] == [direct(t)[:-1] for t in ODD]


@pytest.mark.parametrize("room, kinds, seed", [(16, 16, 1), (64, 40, 2), (64, 1, 3), (512, 60, 4)])
def test_patterns_cover_the_demand(room, kinds, seed):
    rng = random.Random(seed)
    demand = np.zeros(room, np.int64)
    for _ in range(kinds):
        demand[rng.randrange(room)] += rng.choice([1, 7, 5000])
    patterns = cutting_patterns(demand, room)
    sizes = np.arange(1, room + 1)
    assert (sum(c * n for c, n in patterns) == demand).all()
    assert all((c * sizes).sum() <= room and n > 0 for c, n in patterns)
    # Near the volume bound, but for at most one more sequence per row of the program.
    used, bound = sum(n for _, n in patterns), max((demand * sizes).sum() / room, demand[sizes > room // 2].sum())
    assert used <= (demand > 0).sum() + bound * (1.2 if kinds > 1 else 2)


def test_empty_demand():
    assert cutting_patterns(np.zeros(8, np.int64), 8) == []


def check(rows, texts, capacity):
    places = defaultdict(list)
    for row in rows:
        ids = direct(texts[row.doc_id])
        piece = ids[row.start : row.start + row.length]
        assert row.doc_tokens == len(ids) and row.length == len(piece) > 0
        assert row.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        places[row.sequence_id].append((row.offset, row.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return places


def test_pieces_are_whole_and_gapless(spark):
    rng = random.Random(5)
    texts = [None, "", *ODD, *[" ".join(rng.choices(["alpha", "beta", "gamma!"], k=rng.randrange(1, 200))) for _ in range(150)]]
    data = [(i, t, 9, "x") for i, t in enumerate(texts)] + [(3, texts[3], 9, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, length int, sequence_id string")
    rows = packing_digest(docs, PATH, 128).collect()
    places = check(rows, texts, 128)
    assert sum(r.length for r in rows) == sum(len(direct(t)) for _, t, *_ in data)
    filled = sum(r.length for r in rows) / (128 * len(places))
    assert filled > 0.9


def test_hot_length_spreads_over_slices(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "'one two three' AS text")
    rows = packing_digest(docs, PATH, 64).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 9000
    assert max(r.sequence_id for r in rows) + 1 <= 9000 / 8


def test_sequences_hold_the_ids(spark):
    texts = {1: "a b c", 2: "some more words here", 3: "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    packed = pack(token_pieces(docs, PATH, 16, ids=True), 16, 1)
    built = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for row in packed.collect():
        assert built[row.sequence_id][row.offset : row.offset + row.length] == direct(texts[row.doc_id])[row.start : row.start + row.length]


def test_empty_table(spark):
    assert packing_digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_and_marks_are_coded_as_the_whole_text():
    """Words and the marks behind them are coded apart; odd chunks, contractions and foreign letters as they stand."""
    encoder = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    coded = []
    encoder._code, code = lambda chunks, store: (coded.extend(chunks), code(chunks, store)), encoder._code
    draw, letters = random.Random(3), "abcXYZÉéßÿ.,;:!?)*%'\"<|>12 \n\t̸́;×÷ªº-_İΣς"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    texts += ["It's. we'll: l'Été's, <|endoftext|>. a<|startoftext|>b", "x" * 500 + ".", "É" * 70 + "***", "École, école. ÉCOLE***"]
    whole = encoder._tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [w.ids for w in whole]
    assert not {"École,", "école.", "ÉCOLE***", "école"} & set(coded)

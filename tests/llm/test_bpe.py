"""BPE against the tokenizers library, which encodes whole texts at once."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from turnloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
HARD = ["", " ", "\n\t", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|endoftext", "it's I'LL 'S'", "ΣΑΣ İstanbul",
        "café é̂", "x y z　w", "日本語のテキスト", "🙂‍🙂", "12 345", "a" * 5000, "ab" * 3000 + "!",
        "!?" * 900 + "x", "'" * 400, "é" * 300, "Σ" * 300]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    parts = ["the", "ing", "'s", "<|endoftext|>", "  ", "É", "ß", "é", "가", "日", "9", "!", "\n", "'", "Σ", "aaaa"]
    return HARD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(300)]


@pytest.mark.parametrize("chunk", [9, 30, 1000, bpe.CHUNK])
def test_encode_is_the_librarys(rows, chunk):
    encoder = bpe.Encoder(bpe.tables(PATH), chunk)
    for text in rows:
        assert list(encoder.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids, text


def test_transducer_emits_only_what_the_whole_word_has():
    t = bpe.tables(PATH)
    rng = random.Random(1)
    for _ in range(3):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
        whole = LIBRARY.encode(word, add_special_tokens=False).ids
        run, got, most = bpe.Transducer(t), [], 0
        for i in range(0, len(word), 700):
            got += list(run.push(word[i:i + 700].encode()))
            assert got == whole[:len(got)]
            most = max(most, len(run.pending))
        assert got and got + run.finish() == whole
        assert most <= 2 * run.window


def test_lookahead_of_a_small_merge_list():
    # a b -> ab, c ab -> cab, d cab -> dcab: the text behind "d c a" decides about all of it.
    merges = [(0, 1, 4), (2, 4, 5), (3, 5, 6)]
    assert bpe.lookahead(merges, {4: 0, 5: 2, 6: 3}, [1, 1, 1, 1, 2, 3, 4]) == 3


def test_decoder_waits_for_whole_characters(rows):
    t = bpe.tables(PATH)
    for text in rows:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        one = bpe.Decoder(t)
        pieces = "".join(one.push([i]) for i in ids) + one.finish()
        assert pieces == LIBRARY.decode(ids, skip_special_tokens=False)


def test_byte_level_decoder_gives_text():
    t = bpe.Tables(PATH)
    letters = {c: b for b, c in enumerate(bpe.byte_letters())}
    t.pieces = [bytes(letters[c] for c in n.removesuffix("</w>")) if i < 49406 else n.encode() for i, n in enumerate(t.names)]
    t.separator = b""
    decoder = bpe.Decoder(t)
    ids = LIBRARY.encode("日本🙂", add_special_tokens=False).ids
    assert "".join(decoder.push([i]) for i in ids) + decoder.finish() == "日本🙂"


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello there", "x"), (None, None, None), (1, "Hello there", "x"), (2, "", "y")],
                               "doc_id LONG, text STRING, ids STRING")
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = {(r.doc_id, r.text, tuple(r.ids), r.decoded) for r in out.collect()}
    ids = tuple(LIBRARY.encode("Hello there", add_special_tokens=False).ids)
    assert got == {(1, "Hello there", ids, "hello</w> there</w>"), (None, None, (), ""), (2, "", (), "")}
    assert out.count() == 4
    assert bpe.encode(df.limit(0), PATH).count() == 0

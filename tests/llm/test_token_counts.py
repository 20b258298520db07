"""Token counts against the tokenizers library's unigram model over the same pieces and scores."""

import random

import public_tokenizers
from tokenizers import Tokenizer, models, normalizers

from turnloom.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, byte_fallback):
    t = Tokenizer(models.Unigram(list(pieces), 0, byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def texts(alphabet, n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_real_vocabulary():
    pieces = token_counts.pieces(PATH)
    counter, tokenizer = token_counts.Counter(list(pieces)), library(pieces, True)
    for text in [*texts("the anon  éß日本🙂\n\t<0xA>s▁.,", 500), "word " * 2000, "x" * 3000, "🙂" * 300]:
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_ties_and_runs_of_unknown_characters():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("a▁b", -3.0)]
    counter, tokenizer = token_counts.Counter(pieces), library(pieces, False)
    for text in texts("ab z", 500, 1):
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_frames(spark):
    df = spark.createDataFrame([(1, "the cat", 7), (None, None, None), (1, "the cat", 7), (2, "", 0)],
                               "doc_id LONG, text STRING, N_TOKENS INT")
    out = token_counts.count_tokens(df, PATH)
    n = token_counts.Counter(list(token_counts.pieces(PATH))).count("the cat")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out.collect()) == [(0, 0), (1, n), (1, n), (2, 0)]
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0

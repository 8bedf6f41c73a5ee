import math
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from residuum.llm import sentencepiece_codec, token_counts
from residuum.llm.sentencepiece_codec import Codec
from residuum.llm.word_tokens import WordTokenizer

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "   a", "a  b   c ", "\n\n a\n b ", "▁a▁▁b", "日本語 テスト 梦벨ゼ", "a" * 40, "<s> </s> <unk> <0x41>", "𝔘𝔫𝔦 é é́", "x" * 900, " " * 300 + "a", "\x00a\x00", "T̈ it's IT'S. don't## <|endoftext|>, a\x1cb\x85c"]


@pytest.fixture(scope="module")
def codec():
    return Codec(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_equals_library(codec, library, corpus):
    for text in ODD + [c[1] or "" for c in corpus]:
        ids = library.encode(text)
        assert codec.encode(text).tolist() == ids
        assert codec.decode(np.array(ids)) == library.decode(ids)


def test_long_words_take_seconds(codec, library):
    rnd = random.Random(3)
    million = ["".join(rnd.choice(a) for _ in range(1_000_000)) for a in ("etaoinsh", "ABCDabcdefghij0123456789+/", "的一是不了人我在有他这中大来上国")]
    for text in [*million, "a" * 1_000_000, "ab" * 500_000]:
        start = time.time()
        ids = codec.encode(text)
        assert time.time() - start < 20
        assert ids.tolist() == library.encode(text)
    for unit in ("the", "abc", "ation", "aab"):
        assert codec.encode(unit * 700).tolist() == library.encode(unit * 700)
    start = time.time()
    assert codec.decode(codec.encode("the" * 300_000)) == "the" * 300_000
    assert time.time() - start < 20


def test_unspaced_text(codec, library, corpus):
    for text in [(c[1] or "").replace(" ", "") for c in corpus]:
        assert codec.encode(text).tolist() == library.encode(text)


def _unigram(vocabulary, **options):
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, **options))
    library.normalizer = normalizers.Sequence([normalizers.Replace(" ", "▁"), normalizers.Prepend("▁")])
    return library


def _pieces(rnd, crossing=False):
    made = {"".join(rnd.choice("abcé▁" if crossing else "abcé") for _ in range(rnd.randint(1, 4))) for _ in range(60)}
    made |= {"▁" + x for x in list(made)[:20] if not x.startswith("▁")} | {"▁", "a", "b", "\n"}
    return sorted(made - {""})


@pytest.mark.parametrize("crossing", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
def test_fractional_scores_equal_library(crossing, fallback):
    """Scores of one decimal give ties that only the rounding of the sums decides."""
    rnd = random.Random(8)
    for _ in range(12):
        scores = [("<unk>", 0.0)] + [(p, -rnd.randint(1, 60) / 10) for p in _pieces(rnd, crossing)]
        if fallback:
            scores += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
        library = _unigram(scores, byte_fallback=fallback)
        counter = token_counts.Counter(scores, byte_fallback=fallback)
        for _ in range(60):
            text = "".join(rnd.choice("aaabbbcé  \nxy") for _ in range(rnd.choice([5, 40, 400])))
            assert counter.count([text])[0] == len(library.encode(text, add_special_tokens=False).ids), text


def test_logarithmic_scores_equal_library(corpus):
    """The 32k pieces with scores as of a Zipf law."""
    vocabulary = [(p, -math.log(i + 2)) for i, (p, _) in enumerate(token_counts.read_vocabulary(MODEL))]
    library = _unigram(vocabulary, byte_fallback=True)
    counter = token_counts.Counter(vocabulary)
    for text in [*ODD, *(c[1] or "" for c in corpus)]:
        assert counter.count([text])[0] == len(library.encode(text, add_special_tokens=False).ids), text[:80]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abtheinr  \n▁é中.,", max_size=60))
def test_codec_any_text(text):
    codec, library = sentencepiece_codec.codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert codec.encode(text).tolist() == library.encode(text)


def test_codec_digests(docs, corpus, odd, nothing, library):
    import hashlib

    got = {r.doc_id: r for r in sentencepiece_codec.round_trip_digests(docs, MODEL).collect()}
    for i, text, *_ in corpus:
        ids = library.encode(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.round_trip_digests(odd, MODEL).count() == odd.count()
    assert sentencepiece_codec.round_trip_digests(nothing, MODEL).count() == 0
    ids = {r.doc_id: r.ids for r in sentencepiece_codec.encode_documents(docs, MODEL).collect()}
    assert ids[0] == library.encode(corpus[0][1])


def test_counts_equal_library(docs, corpus, odd, nothing):
    vocabulary = token_counts.read_vocabulary(MODEL)
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Replace(" ", "▁"), normalizers.Prepend("▁")])
    counter = token_counts.Counter(vocabulary)
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("abtheinr  \n▁é中.,") for _ in range(40)) for _ in range(300)]
    for text in texts:
        assert counter.count([text])[0] == len(library.encode(text, add_special_tokens=False).ids), text
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, MODEL).collect()}
    assert all(got[i] == len(library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in corpus)
    assert token_counts.count_tokens(odd, MODEL).count() == odd.count()
    assert token_counts.count_tokens(nothing, MODEL).count() == 0


def test_word_tokenizer_equals_library(corpus):
    own, library = WordTokenizer(WORDS, 1), Tokenizer.from_file(WORDS)
    rnd = random.Random(2)
    alphabet = "abcXYZ'sStT.,#%0123 \n\té́ẗT̈İI<|>endoftext日ß&*"
    texts = ODD + [c[1] or "" for c in corpus] + ["".join(rnd.choice(alphabet) for _ in range(50)) for _ in range(1500)]
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]

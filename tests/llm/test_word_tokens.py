import random

import numpy as np

from residuum.llm.queries import tokenizer_file
from residuum.llm.word_tokens import WordTokenizer

PATH = tokenizer_file("word_bpe_49k.json")


def counting(tok):
    """The texts that the library is given from now on."""
    given, batch = [], tok._batch
    tok._batch = lambda texts: given.extend(texts) or batch(texts)
    return given


def test_a_worker_keeps_common_words():
    tok = WordTokenizer(PATH, 1)
    given = counting(tok)
    first = tok.encode(["some words, and more", None, "Words!"])
    assert given
    tok.clear()
    given.clear()
    assert tok.encode(["some words, and more", None, "Words!"]) == first
    assert not given


def test_words_before_marks_are_not_encoded_again():
    tok = WordTokenizer(PATH, 1)
    tok.encode(["plainword , another, third?!"])
    given = counting(tok)
    tok.encode(["plainword, another third,"])
    assert not given


def test_ids_equal_the_library_with_a_small_cache():
    rnd = random.Random(5)
    some = ["of", "Of,", "ñ,", "ção.", "Éa!!", "x" * 300, "y" * 300 + ",", "a.b", "it's", "!!", "12,5", "éx", " ", "İx", "ﬁn;", "漢字。"]
    words = some + [f"w{i % 7}{'abcdef'[i % 6]}{',' * (i % 3)}" for i in range(60)]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t ", "\x0b", "\x0c\r"]) for _ in range(rnd.randrange(30))) for _ in range(60)]
    texts += [None, "", " ", " \n of", "of "]
    tok = WordTokenizer(PATH, 1, cache_words=25)
    for at in range(0, len(texts), 5):
        for text, raw in zip(texts[at : at + 5], tok.encode(texts[at : at + 5])):
            assert np.frombuffer(raw, "<u4").tolist() == [*tok.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]

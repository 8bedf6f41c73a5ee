"""Token ids of whole texts by a ``tokenizers`` file, through a cache of words.

The tokenizer must drop white space and never join what stands on its two sides
(checked by its pre-tokenizer), so words between ASCII white space are encoded
one by one and each only once while it stays in the cache.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from residuum.llm.common import BoundedCache, release, text_bytes


_MARKS = b".,;:!?#%*$&"
_MARK_SET = frozenset(_MARKS)
_KEPT = 100_000  # words that a worker keeps from task to task, some 20 MB


class WordTokenizer:
    def __init__(self, path: str, end_id: int, cache_words: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if len(self.tokenizer.encode("a b", add_special_tokens=False)) != 2 * len(
            self.tokenizer.encode("a", add_special_tokens=False)
        ):
            raise ValueError("the tokenizer does not treat words one by one")
        upper, lower = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("ABC", "abc"))
        apart = self.tokenizer.encode("ab.#", add_special_tokens=False).ids
        if apart != self._ids("ab") + self._ids(".#"):
            raise ValueError("the tokenizer does not cut between letters and marks")
        self.lower = upper == lower
        self.end = np.array([end_id], "<u4").tobytes()
        self._ends = None  # ids that end a word, if the vocabulary marks them
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            vocabulary = self.tokenizer.get_vocab()
            self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self._ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self._known = BoundedCache(cache_words, self._encode_parts)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word; many words of Latin letters at a time, which the marks of word ends tell apart."""
        out: dict[bytes, bytes] = {}
        rest = words
        if self._ends is not None:
            plain = [w for w in words if w.isalpha() or self._latin(w)]
            groups = [plain[i : i + 100] for i in range(0, len(plain), 100)]
            for at in range(0, len(groups), 100):  # the library's results are large, so few are held
                some = groups[at : at + 100]
                for group, raw in zip(some, self._batch([b" ".join(g).decode() for g in some])):
                    ends = (4 * np.flatnonzero(self._ends[np.frombuffer(raw, "<u4")]) + 4).tolist()
                    if len(ends) == len(group):
                        out.update(zip(group, [raw[b:e] for b, e in zip([0, *ends], ends)]))
            rest = [w for w in words if w not in out]
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            out.update(zip(some, self._batch([w.decode() for w in some])))
        return out

    @staticmethod
    def _latin(word: bytes) -> bool:
        """A word of Latin letters that stay such in lower case, not all of them ASCII."""
        if word.isascii():
            return False
        text = word.decode()
        return text.isalpha() and max(text) < "\u0250" and text.lower().isalpha()

    def _encode_parts(self, words: list[bytes]) -> list[bytes]:
        """Words with the marks behind them encoded apart, since the pre-tokenizer always cuts there; parts are kept as words are."""
        cut = {w: self._split(w) for w in words if w[-1] in _MARK_SET}
        parts = set(chain.from_iterable(cut.values()))
        parts.discard(b"")
        held = self._known.held_of(parts)
        wanted = parts.difference(held)
        ids = self._encode_words(list(wanted.union([w for w in words if w not in cut])))
        self._known.keep({w: ids[w] for w in wanted.difference(words)})
        ids.update(held)
        ids[b""] = b""
        ids.update([(w, ids[core] + ids[tail]) for w, (core, tail) in cut.items()])
        return [ids[w] for w in words]

    def _split(self, word: bytes) -> tuple[bytes, bytes]:
        core = word.rstrip(_MARKS)
        if not core or not core[-1:].isalnum():
            return word, b""
        return (core.lower() if self.lower and core.isascii() else core), word[len(core) :]

    def clear(self) -> None:
        self._known.clear(_KEPT)
        release()

    def _bytes(self, text: str | None) -> bytes:
        """The letters A-Z in lower case if the tokenizer has no other; not beside combining marks, which may join with a letter."""
        raw = text_bytes(text)
        return raw.lower() if self.lower and b"\xcc" not in raw and b"\xcd" not in raw else raw

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, ``end_id`` last.

        Words are numbered by Arrow, so that only unlike ones become objects; ids are put together by number.
        """
        split = pc.ascii_split_whitespace(pa.array(map(self._bytes, texts), pa.large_binary()).view(pa.large_string()))
        numbered = split.values.dictionary_encode()
        number, words = numbered.indices.to_numpy(), numbered.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known = self._known.look_up({w for w in words if w})
        ids = [known[w] if w else b"" for w in words]  # white space at an end leaves an empty word
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        count = size[number]
        upto = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat((np.cumsum(size) - size)[number] - upto[:-1], count) + np.arange(upto[-1])
        flat, ends = np.frombuffer(b"".join(ids), "<u4")[at].tobytes(), (4 * upto[split.offsets.to_numpy()]).tolist()
        return [flat[b:e] + self.end for b, e in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def word_tokenizer(path: str, end_id: int) -> WordTokenizer:
    return WordTokenizer(path, end_id)

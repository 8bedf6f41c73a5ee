"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each
character. Dynamic programming carries the best score and its number of pieces
to every position; no path is kept. Ties follow the ``tokenizers`` library: of
equal scores the piece that starts first wins. A character that is no piece by
itself may stand as unknown at ``min_score - 10`` and then counts as its UTF-8
bytes (byte fallback); without byte fallback a run of unknown characters is one.

Texts are prefixed and spaces replaced by U+2581. Words that no piece crosses
are counted one by one and kept in a cache; where pieces go over spaces, a text
is one word. Scores may be fractions: sums of doubles then depend on all that
stands before, so a word whose choice is closer than the rounding error of its
text is counted again from the score that the library carries to it.

Null counts as the empty text with no token. Very long texts and words are
counted whole. Repeated rows and null identifiers are counted like others; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from residuum.llm.common import BoundedCache, map_batches, slices
from residuum.llm.sentencepiece_codec import SPACE, word_pattern

_UNKNOWN_PENALTY = 10.0  # fixed value of the library


def read_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, float(p.score)) for p in model.pieces]


class Counter:
    """Counts pieces under ``vocabulary``, pairs of piece and score."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache_words: int = 600_000, byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - _UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.whole = all(score == int(score) for _, score in vocabulary) and abs(self.unknown) < 1 << 20
        self._words = word_pattern(piece for piece, _ in vocabulary)
        self.simple = self.whole and self.byte_fallback
        one = self.count_word if self.simple else self.trace_word
        self._known = BoundedCache(cache_words, lambda words: [one(w) for w in words])

    def count_word(self, word: str) -> int:
        """Pieces of the best path through ``word``, where sums of scores are exact."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        for end, found in enumerate(ends):
            score = count = None
            found.sort(reverse=True)  # longest first: it starts first
            for length, value in found:
                before, pieces = best[end + 1 - length]
                if score is None or before + value > score:
                    score, count = before + value, pieces + 1
            if not found or found[-1][0] != 1:
                before, pieces = best[end]
                if score is None or before + self.unknown > score:
                    score = before + self.unknown
                    count = pieces + len(word[end].encode("utf-8", "surrogatepass"))
            best.append((score, count))
        return best[-1][1]

    def trace_word(self, word: str, begin: float = 0.0) -> tuple[int, tuple[float, ...], float, bool, bool]:
        """Of the best path through ``word`` from the score ``begin``.

        Its number of pieces, their scores, how close the closest choice was, and
        whether it begins and ends with an unknown character that joins its neighbours.
        """
        best: list[tuple[float, int]] = [(begin, 0)]
        path: list[tuple[int, float]] = []  # where the last piece begins, and its score
        joins = [False]  # the best path ends with an unknown character that joins the next
        margin = float("inf")
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        for end, found in enumerate(ends):
            score = count = None
            found.sort(reverse=True)  # longest first: it starts first
            if not found or found[-1][0] != 1:
                found = [*found, (0, self.unknown)]
            for length, value in found:
                at = end + 1 - (length or 1)
                before, pieces = best[at]
                total = before + value
                if score is not None and not self.whole:
                    margin = min(margin, abs(total - score))
                if score is None or total > score:
                    score, last, fused = total, (at, value), not length and not self.byte_fallback
                    if length:
                        count = pieces + 1
                    elif self.byte_fallback:
                        count = pieces + len(word[end].encode("utf-8", "surrogatepass"))
                    else:
                        count = pieces + (not joins[at])
            best.append((score, count))
            path.append(last)
            joins.append(fused)
        scores, end, begins = [], len(word), False
        while end:
            at, value = path[end - 1]
            scores.append(value)
            begins, end = at == 0 and joins[end], at
        return best[-1][1], tuple(reversed(scores)), margin, begins, joins[-1]

    def words(self, text: str) -> list[str]:
        return self._words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.words(t or "") for t in texts]
        known = self._known.look_up(set().union(*split))
        if self.simple:
            return [sum([known[w] for w in words]) for words in split]
        return [self._count_in_order([known[w] for w in words], words) for words in split]

    def _count_in_order(self, found: list[tuple], words: list[str]) -> int:
        """The count of a text whose sums round, or whose unknown characters join over words."""
        largest = sum(abs(x) for f in found for x in f[1]) if not self.whole else 0.0
        error = 4 * max(map(len, words), default=0) * math.ulp(largest)
        score, total, joined = 0.0, 0, False
        for word, one in zip(words, found):
            if one[2] <= error and not self.whole:
                one = self.trace_word(word, score)
            for x in one[1]:
                score += x
            total += one[0] - (joined and one[3])
            joined = one[4]
        return total


@lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    return Counter(read_vocabulary(model_path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, n_tokens`` of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, texts = counter(model_path), batch["text"].to_pylist()
        counts = [n for begin, end in slices(texts) for n in c.count(texts[begin:end])]
        chars = [len(t or "") for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(chars, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_chars", "n_tokens"]
        )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(rows, run, "doc_id long, n_chars long, n_tokens long")

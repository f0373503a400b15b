"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word;
dynamic programming over their ends carries the best score and the
number of pieces of the path that has it.  Ties are settled as the
tokenizers library's Unigram model does: starts go from left to right,
pieces of one start from short to long, and a path replaces another only
with a higher score.  A character that no piece of its own covers costs
the least score less 10 and counts as its UTF-8 bytes (byte fallback).

Blanks are written as U+2581, and one is put in front of the text.  Where
no piece of the vocabulary has that mark behind another character, every
path breaks before a word; where scores are whole numbers too, sums are
exact in any order.  With such a vocabulary words are counted on their
own, with a bounded memo.  With any other one the whole text is one path,
whose sums grow from the left as the library's do.

The vocabulary is read from a sentencepiece model file with its stored
scores; a file whose model is of another type serves as a unigram
vocabulary all the same.

Edge cases: a null or empty text has no tokens and score 0; an empty table
gives no rows; very long texts take memory in proportion to their size;
repeated rows give repeated results; other input columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices

#: Words that a worker remembers before it starts anew.
MEMO = 300_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        #: Whether words may be counted on their own.
        self.by_word = all(score == int(score) and not re.search(f"[^{MARK}]{MARK}", piece) for piece, score in pieces)
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.memo: dict[str, tuple[int, float]] = {}

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and score of a text."""
        if not text:
            return 0, 0.0
        if not self.by_word:
            return self.viterbi(MARK + text.replace(" ", MARK))
        memo, tokens, total = self.memo, 0, 0.0
        if len(memo) > MEMO:
            memo.clear()
        for word in WORD.findall(MARK + text.replace(" ", MARK)):
            found = memo.get(word)
            if found is None:
                found = memo[word] = self.viterbi(word)
            tokens += found[0]
            total += found[1]
        return tokens, total

    def viterbi(self, word: str) -> tuple[int, float]:
        """Matches arrive by end; at one end, earlier starts come first, as they do when paths grow from the left."""
        n = len(word)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        at = 0  # ends up to here are settled
        single = False
        ends: list[tuple[int, float]] = []

        def settle(end: int) -> None:
            # Longest match first is smallest start first; the automaton gives them in that order.
            top, number = None, 0
            for size, score in ends:
                candidate = best[end - size] + score
                if top is None or candidate > top:
                    top, number = candidate, pieces[end - size] + 1
            if not single:
                candidate = best[end - 1] + self.unknown
                if top is None or candidate > top:
                    top, number = candidate, pieces[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best[end], pieces[end] = top, number

        for last, (size, score) in self.automaton.iter(word):
            while at < last:
                at += 1
                settle(at)
                ends, single = [], False
            ends.append((size, score))
            single = single or size == 1
        while at < n:
            at += 1
            settle(at)
            ends, single = [], False
        return pieces[n], best[n]


def pieces_of(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(pieces_of(path))


def count(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, score."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = counter(vocabulary)
        found = [model.count(t) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return map_slices(docs, work, "doc_id long, n_tokens long, score double")

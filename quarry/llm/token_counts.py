"""Token counts by a count-only Viterbi over a unigram vocabulary.

The text is cut as the tokenizer's metaspace step does: blanks become U+2581, one is put before the text,
and a word starts at each. For a word, an Aho-Corasick automaton lists the vocabulary pieces that end at
each position, longest first; the dynamic programme keeps the best score and its number of pieces, and a
later candidate replaces an earlier one only if strictly better, so ties go to the piece that starts first.
A character without a piece of its own scores ten below the lowest score; it counts its UTF-8 bytes where
the vocabulary has byte pieces, else neighbouring unknown characters count one together.

Null and empty texts have no tokens. Whole texts are counted, of any length; words that repeat are counted
once per worker. Repeated rows count alike; extra columns pass through, and the output column replaces one
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import Memo

SPACE = "▁"
#: Fixed value: how far an unknown character's score lies below the lowest piece score.
UNKNOWN_PENALTY = 10.0


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], unknown_piece: str = "<unk>"):
        vocabulary = {p for p, _ in pieces}
        self.unknown_piece = unknown_piece
        self.found = ahocorasick.Automaton()
        for piece, score in pieces:
            # the unknown piece's own spelling in a text is unknown text
            self.found.add_word(piece, (len(piece), score, piece == unknown_piece))
        self.found.make_automaton()
        self.single = {p for p in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytewise = all(f"<0x{b:02X}>" in vocabulary for b in range(256))
        self.words = Memo(self.count_word)

    def count_word(self, word: str) -> int:
        n = len(word)
        score: list[float | None] = [0.0] + [None] * n
        count, run = [0] * (n + 1), [-1] * (n + 1)  # run: where the unknown run that ends here began, else -1
        matches = self.found.iter(word)
        end, hit = next(matches, (n, None))
        for i in range(n):
            best, came, unknown = None, 0, False
            while end == i:
                size, own, odd = hit
                candidate = score[i + 1 - size] + own
                if best is None or candidate > best:
                    best, came, unknown = candidate, i + 1 - size, odd
                end, hit = next(matches, (n, None))
            if word[i] not in self.single:
                candidate = score[i] + self.unknown
                if best is None or candidate > best:
                    best, came, unknown = candidate, i, True
            score[i + 1] = best
            if unknown:
                begin = run[i + 1] = came if run[came] < 0 else run[came]
                count[i + 1] = count[begin] + self.unknown_pieces(word, begin, came, i + 1, count)
            else:
                count[i + 1] = count[came] + 1
        return count[n]

    def unknown_pieces(self, word: str, begin: int, came: int, end: int, count: list[int]) -> int:
        """Pieces of the unknown run word[begin:end], whose part up to `came` is counted."""
        if not self.bytewise or (end - begin == len(self.unknown_piece) and word[begin:end] == self.unknown_piece):
            return 1
        whole = len(word[begin:came].encode()) if came - begin <= len(self.unknown_piece) else count[came] - count[begin]
        return whole + len(word[came:end].encode())

    def count(self, text: str) -> int:
        if not text:
            return 0
        spaced = text.replace(" ", SPACE)
        words = spaced.split(SPACE)
        if spaced[0] == SPACE:
            words = words[1:]
        return sum(map(self.words.__getitem__, [SPACE + w for w in words]))


@lru_cache(1)
def counter(model_path: str) -> Counter:
    return Counter(pieces_of(model_path))


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text."""

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(model_path).count
        for texts in batches:
            yield pd.Series([of(t) if t else 0 for t in texts], index=texts.index, dtype="int64")

    return df.withColumn(count_col, counts(F.col(text_col)))

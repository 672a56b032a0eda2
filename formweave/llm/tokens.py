"""Token counts of a unigram vocabulary by a count-only Viterbi pass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import check_columns

SPACE = "▁"
#: Units whose counts a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 600_000, 40
#: The score of an unknown character lies this far below the least piece's.
UNKNOWN = 10.0
#: Scores are multiples of 1 / GRID: sums of them are exact, so that ties are ties in any order of adding.
GRID = 1 << 16
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def load_vocabulary(path: str = DEFAULT_MODEL) -> list[tuple[str, float]]:
    """Pieces that texts can match, in the order of their ids, with log-probabilities, of a sentencepiece model file.

    A unigram model brings its own.  A model of merges has only their order, which is
    the order of frequency when they were made: the piece of rank r gets Zipf's share,
    1 / r over the sum of all shares.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(Path(path).resolve()))
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in ids]
    if all(x == int(x) for x in scores):  # ranks of merges
        order = sorted(range(len(ids)), key=lambda k: -scores[k])
        whole = log(sum(1 / r for r in range(1, len(ids) + 1)))
        for r, k in enumerate(order, 1):
            scores[k] = -log(r) - whole
    return [(model.id_to_piece(i), round(x * GRID) / GRID) for i, x in zip(ids, scores, strict=True)]


class UnigramCounter:
    """Counts the tokens of the best segmentation of a text under a unigram vocabulary.

    A space counts as a character of its own, ``SPACE``; a text that starts with none
    gets one.  The best path is that of the whole text: it is searched in units only
    where no piece of the vocabulary reaches from one into the next (from a word into
    the spaces after it, over a line end), so that every path passes there.
    The Aho-Corasick automaton lists, at each end, the matching pieces longest first;
    a later start replaces the best path only with a strictly higher score, as a
    forward pass over the starts would.  A character that no piece covers costs
    UNKNOWN below the least score and counts one token for each of its UTF-8 bytes.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.unknown = min(s for _, s in vocabulary) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = frozenset(piece for piece, _ in vocabulary if len(piece) == 1)
        self.lines = not any("\n" in piece and piece != "\n" for piece, _ in vocabulary)
        inside = re.compile(f"[^{SPACE}]{SPACE}")
        self.words = not any(inside.search(piece) for piece, _ in vocabulary)
        self.line_end = self._word("\n")
        self.counts = _Counts(self)

    def _word(self, word: str) -> int:
        """Tokens of a text that is segmented as a whole."""
        n = len(word)
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if self.known.issuperset(word):  # each end is reached by a match before it is left
            for last, (length, value) in self.automaton.iter(word):
                total = best[last + 1 - length] + value
                if total > best[last + 1]:
                    best[last + 1], count[last + 1] = total, count[last + 1 - length] + 1
            return count[n]
        at, single = 0, True  # ends up to ``at`` are settled but for its unknown character

        def settle(end: int) -> None:
            nonlocal at, single
            while at < end:
                if at and not single:
                    self._unknown(word, at, best, count)
                at, single = at + 1, False

        for last, (length, value) in self.automaton.iter(word):
            settle(last + 1)
            single = single or length == 1
            total = best[last + 1 - length] + value
            if total > best[last + 1]:
                best[last + 1], count[last + 1] = total, count[last + 1 - length] + 1
        settle(n + 1)
        return count[n]

    def _unknown(self, word: str, end: int, best: list[float], count: list[int]) -> None:
        """The path through an unknown last character, which starts last and so needs a higher score."""
        total = best[end - 1] + self.unknown
        if total > best[end]:
            best[end], count[end] = total, count[end - 1] + len(word[end - 1].encode("utf-8", "replace"))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        if not text.startswith(" "):
            text = " " + text
        lines = text.split("\n") if self.lines else [text]
        return sum(map(self._line, lines)) + (len(lines) - 1) * self.line_end

    def _line(self, line: str) -> int:
        counts = self.counts
        if not self.words:
            return counts[line] if line else 0
        if "  " in line or line.endswith(" "):
            return sum(map(counts.__getitem__, UNIT.findall(line)))
        first, *words = line.split(" ")
        return (counts[first] if first else 0) + sum([counts[" " + w] for w in words])


#: A run of spaces and the word after it.
UNIT = re.compile(" *[^ ]+| +")


class _Counts(dict):
    """Counts of units, filled on demand and emptied when full."""

    def __init__(self, counter: UnigramCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> int:
        found = self.counter._word(unit.replace(" ", SPACE))
        if len(unit) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = found
        return found


#: Of a worker process, by model path and vocabulary size.
_counters: dict[tuple, UnigramCounter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id_col, n_tokens, n_chars) for every row; a null or empty text has no tokens.

    The vocabulary is read on the driver and sent with the tasks (its size is the
    model's, not the data's).  Rows are counted alone, so repeated rows, null ids
    and other columns change nothing; an empty table gives no rows.  Of paths of one
    score the earliest start of a piece counts.  Memory is a text and REMEMBERED units.
    """
    check_columns(docs, id_col, text_col)
    vocabulary = load_vocabulary(model)
    key, shared = (model, hash(tuple(vocabulary))), docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters[key] = UnigramCounter(shared.value)
        counter = _counters[key]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [counter.count(t) for t in texts]
            chars = [len(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(chars, pa.int64())], names=["id", "n_tokens", "n_chars"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = plain.mapInArrow(run, "id long, n_tokens long, n_chars long")
    return counted.withColumnRenamed("id", id_col)

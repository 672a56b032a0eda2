"""Benchmark decontamination: word pairs find passages, local alignment scores them.

An alignment of at least the threshold has neighbouring words of its item side by side,
or one word apart, at a known number of places (``least_pairs``).  Every passage with
as many is aligned, however many others hold the same words; no other passage can
reach the threshold.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, check_columns, placed, without_rows
from .textarrays import chunks, mix, text_bytes, word_hashes, word_spans

#: Least words of an item that is aligned; a shorter one is looked for as it stands.
SEED = 4
#: Words of benchmark items that one pass over the documents takes; more items take more passes.
BLOCK_WORDS = 1_000_000
#: Alignment: a match, a mismatch, a skipped word.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, as a share of an item's alignment with itself.
THRESHOLD = 0.5
#: A pair of more items than this is common: up to half of the pairs that an item needs are not looked up.
COMMON = 8

_BITS = 22


def _pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of the words with those ``apart`` places on; shorter input has none."""
    if len(words) <= apart:
        return np.zeros(0, np.uint64)
    total = words[:-apart] * np.uint64(0xC2B2AE3D27D4EB4F)
    total ^= total >> np.uint64(29)
    return mix(total ^ words[apart:])


def _run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    n = max(len(words) - length + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total = mix(total ^ words[j : j + n]) + np.uint64(j)
    return total


def _least_score(m: int, threshold: float) -> int:
    return int(np.ceil(MATCH * m * threshold - 1e-9))


def least_pairs(m: int, threshold: float) -> int:
    """How many neighbours of an item of m words stand side by side, or one word apart, in any alignment of the threshold.

    With n matches, n - 1 steps lead from match to match.  All else costs 1 a word: a step
    over words of the item takes one of its m - n unmatched words, a step over two or
    more words of the passage costs 2; the score leaves 2 n - score to spend.  The
    answer is 1 at least, which a threshold of 0.5 grants to items of SEED words.
    """
    score, least = _least_score(m, threshold), m
    for n in range(1, m + 1):
        if (spare := MATCH * n - score) >= 0:
            over = min(m - n, spare)
            least = min(least, n - 1 - over - (spare - over) // 2)
    return max(1, least)


class Items:
    """A block of benchmark items as word hashes, with an index of their pairs."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float):
        column = pa.array([t for _, t in rows], pa.string())
        raw, offsets = text_bytes(column)
        starts, ends, doc = word_spans(raw, offsets)
        hashes = word_hashes(raw, starts, ends)
        bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
        self.ids = [i for i, _ in rows]
        self.words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.score = [_least_score(len(w), threshold) for w in self.words]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.need = np.ones(len(rows), np.int64)
        own = [_pairs(w, 1).tolist() if len(w) >= SEED else [] for w in self.words]
        holders = Counter(s for pairs in own for s in set(pairs))
        found: list[tuple[int, int, int]] = []
        for k, pairs in enumerate(own):
            least = least_pairs(len(self.words[k]), threshold)
            common = sorted((p for p, s in enumerate(pairs) if holders[s] > COMMON), key=lambda p: (-holders[pairs[p]], p))[: least // 2]
            self.need[k] = least - len(common)
            found += [(s, k, p) for p, s in enumerate(pairs) if p not in common]
        found.sort()
        self.seeds, first = np.unique(np.array([s for s, _, _ in found], np.uint64), return_index=True)
        self.first = np.append(first, len(found)).astype(np.int64)
        self.item, self.place = (np.array([x[c] for x in found], np.int64) for c in (1, 2))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in range(1, SEED):
            few = np.flatnonzero(self.size == length)
            if len(few):
                runs = np.array([_run_hashes(self.words[k], length)[0] for k in few], np.uint64)
                order = np.argsort(runs)
                self.short[length] = runs[order], few[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.seeds & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in the item) of every pair of words of one document that an item has side by side."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for apart in (1, 2):
            seeds = _pairs(words, apart)
            maybe = np.flatnonzero(self.bits[(seeds & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.seeds, seeds[maybe]), len(self.seeds) - 1)
            right = (self.seeds[at] == seeds[maybe]) & (doc[maybe] == doc[maybe + apart]) if len(maybe) else np.zeros(0, bool)
            maybe, at = maybe[right], at[right]
            n = self.first[at + 1] - self.first[at]
            each = np.arange(n.sum()) + np.repeat(self.first[at] - np.cumsum(n) + n, n)
            out.append((np.repeat(maybe, n), self.item[each], self.place[each]))
        position, item, place = (np.concatenate(c) for c in zip(*out, strict=True))
        return position, item, place

    def runs(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(last word's position, item) of every place where the words of an item of fewer than SEED words stand."""
        for length, (hashes, items) in self.short.items():
            found = _run_hashes(words, length)
            low, high = (np.searchsorted(hashes, found, side) for side in ("left", "right"))
            at = np.flatnonzero(high > low)
            at = at[doc[at] == doc[at + length - 1]]
            n = (high - low)[at]
            each = np.arange(n.sum()) + np.repeat(low[at] - np.cumsum(n) + n, n)
            yield np.repeat(at + length - 1, n), items[each]

    def passages(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, int, int]]:
        """(document, item, first word, words, own part's start and end) wherever enough pairs lie within an alignment's reach; overlapping own parts of an item are one."""
        if not len(self.seeds):
            return
        position, item, place = self.hits(words, doc)
        group = doc[position] * len(self.ids) + item
        order = np.lexsort((position, group))
        position, item, place, group = position[order], item[order], place[order], group[order]
        spare = MATCH * self.size - np.array(self.score, np.int64)  # most words that an alignment skips
        last = np.arange(len(order)) + self.need[item] - 1
        i = np.flatnonzero(last < len(order))
        i = i[(group[last[i]] == group[i]) & (position[last[i]] - position[i] < (self.size + spare)[item[i]])]
        marks = np.zeros(len(order) + 1, np.int64)
        np.add.at(marks, i, 1)
        np.add.at(marks, last[i] + 1, -1)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for h in np.flatnonzero(np.cumsum(marks[:-1]) > 0).tolist():
            k, p = int(item[h]), int(position[h] - place[h])
            m = len(self.words[k])
            spans[int(doc[position[h]]), k].append((p - m // 4 - 4, p + m + m // 4 + 4))
        for (d, k), found in spans.items():
            lo, hi = (int(x) for x in np.searchsorted(doc, [d, d + 1]))
            found.sort()
            merged = [found[0]]
            for a, b in found[1:]:
                if a > merged[-1][1]:
                    merged.append((a, b))
                else:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            for a, b in merged:
                # all that an alignment through one of the pairs may reach
                first = max(lo, a - int(spare[k]))
                yield d, k, first - lo, words[first : min(hi, b + int(spare[k]))], max(a, lo) - first, b - first


def _aligned(item: np.ndarray, passage: np.ndarray, first: int, last: int) -> tuple[int, int, int, int]:
    """Best Smith-Waterman score and the word that it ends with, and both of what ends with words first to last - 1."""
    steps = np.arange(len(passage)) * -GAP
    row, best, end, own, own_end = np.zeros(len(passage) + 1, np.int64), 0, 0, 0, 0
    for word in item:
        through = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        open_ = np.maximum(np.maximum(through, row[1:] + GAP), 0)
        row[1:] = np.maximum.accumulate(open_ + steps) - steps
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax()) - 1
        part = row[first + 1 : last + 1]
        if len(part) and (top := int(part.max())) > own:
            own, own_end = top, first + int(part.argmax())
    return best, end, own, own_end


def align(item: np.ndarray, passage: np.ndarray) -> float:
    """Smith-Waterman score of two word sequences over the item's score with itself."""
    if not len(item) or not len(passage):
        return 0.0
    return _aligned(item, passage, 0, 0)[0] / (MATCH * len(item))


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared)
        for batch in batches:
            ids, raw, offsets = batch.column(0), *text_bytes(batch.column(1))
            out: list[list] = [[], [], [], []]
            for first, _, part, at in chunks(raw, offsets) if len(items.seeds) or items.short else ():
                starts, ends, doc = word_spans(part, at)
                words = word_hashes(part, starts, ends)
                for position, found in items.runs(words, doc):
                    out[0] += ids.take(pa.array(doc[position] + first)).to_pylist()
                    out[1] += [items.ids[k] for k in found.tolist()]
                    out[2] += (position - np.searchsorted(doc, doc[position])).tolist()
                    out[3] += [1.0] * len(found)
                for d, k, start, passage, a, b in items.passages(words, doc):
                    item = items.words[k]
                    # a match takes a word of the item that the passage has
                    if MATCH * int(np.isin(item, passage).sum()) < items.score[k]:
                        continue
                    best, end, own, own_end = _aligned(item, passage, a, b)
                    # a copy that only the reach holds is its own passage's, and known by its end
                    where = start + (own_end if own >= items.score[k] else end)
                    for column, value in zip(out, (ids[first + d].as_py(), items.ids[k], where, best / (MATCH * len(item))), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc", "item", "place", "score"])

    return run


_known: dict[int, Items] = {}


def _items(shared) -> Items:
    """The block's index, built once for a worker process."""
    key, rows, threshold = shared.value
    if key not in _known:
        _known.clear()
        _known[key] = Items(rows, threshold)
    return _known[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, item_col, score, n_passages): documents that hold an edited or exact copy of an item.

    Words are lower-cased (A-Z).  The score is the best local alignment of a passage,
    1 for a verbatim copy.  Every passage that can score the threshold is aligned,
    however common its words are (below a threshold of 0.5, if it has a pair of
    the item's neighbouring words).  An item of fewer than SEED words is found wherever its
    words stand side by side, with the score 1.  Null texts and ids on either side, and items
    without words, match nothing; items that share an id are one row, with
    the best score; so are repeated documents.  A score of exactly the threshold counts; of
    several copies of an item each counts as a passage.  Empty tables find nothing.  The benchmark is taken in blocks of
    about BLOCK_WORDS words, each sent to the executors; documents are never capped.
    """
    check_columns(docs, id_col, text_col)
    check_columns(benchmark, item_col, text_col)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    n = tests.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    blocks = -(-n // BLOCK_WORDS)
    results = []
    for b in range(blocks):
        rows = [tuple(r) for r in tests.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item", "text").collect()]
        # items that share an id get a row each here
        shared = spark.sparkContext.broadcast((hash((tuple(rows), threshold)), rows, threshold))
        scored = texts.mapInArrow(_finder(shared), "doc long, item long, place long, score double")
        results.append(scored.where(F.col("score") >= threshold))
    if not results:
        results = [spark.createDataFrame([], "doc long, item long, place long, score double")]
    total = results[0]
    for more in results[1:]:
        total = total.union(more)
    return total.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(F.max("score").alias("score"), F.count_distinct("place").alias("n_passages"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold a copy of an item, by their places (``common.placed``): null and repeated ids are rows like others.

    Null texts hold nothing and stay; so does an empty table.  A score of exactly the threshold counts.
    """
    check_columns(docs, text_col)
    table, place = placed(docs)
    rows = table.select(F.col(place).alias("row"), F.col(text_col).alias("text"))
    tests = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    return without_rows(table, place, contaminated(rows, tests, "row", "text", "item", threshold).select("row").distinct())

"""Byte-pair encoding of whole texts, and back: speculate with longest matches, verify neighbours, merge the rest.

A sequence of tokens is what the merges give exactly if each token is what the merges make
of its own symbols and no two neighbours would have been merged across their seam.  So the
longest match at every place proposes tokens, array arithmetic checks all pairs of neighbours
of all words of a batch, and only words with a pair that fails are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import check_columns

DEFAULT_MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: The symbol after the last byte of a word; bytes are the symbols before it.
END = 256
#: Words whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 40
#: Words up to so many bytes are merged by looking through their pairs, longer ones with a heap.
SHORT = 64
#: Characters of texts that are encoded at once; a longer text is a run of its own.
RUN = 1 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where it is printed, else the next one from 256."""
    printed = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of byte-level merges with word ends, as arrays of a few MB that are sent with the tasks.

    Read: the normaliser NFC, white space, lower case; a pattern that keeps its matches;
    merges in the order of their rank.  A file of another kind raises ValueError, and so
    does a vocabulary in which a merge comes before its parts or gives a token a second time.
    """

    def __init__(self, path: str = DEFAULT_MODEL):
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model, steps = file["model"], (file["normalizer"] or {}).get("normalizers", [])
        cuts = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = all(not model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        kept = len(cuts) == 2 and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and cuts[1]["type"] == "ByteLevel"
        marked = all(not t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (plain and kept and marked and model["type"] == "BPE" and model["end_of_word_suffix"] and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and not file["decoder"]):
            raise ValueError(f"{path} is not a vocabulary of byte-level merges with word ends")
        self.path, self.pattern = str(path), cuts[0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ids, end = model["vocab"], model["end_of_word_suffix"]
        names = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.size = max(names) + 1
        self.names = [names.get(i, "") for i in range(self.size)]
        symbols: dict[int, tuple[int, ...]] = {}
        self.base = np.full((256, 2), -1, np.int64)
        for b, c in enumerate(byte_characters()):
            self.base[b] = ids[c], ids[c + end]
            symbols[ids[c]], symbols[ids[c + end]] = (b,), (b, END)
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            whole, a, b = ids[a + b], ids[a], ids[b]
            if whole in symbols or a not in symbols or b not in symbols:
                raise ValueError(f"{path}: merge {rank} comes before its parts or gives a token again")
            symbols[whole] = symbols[a] + symbols[b]
            self.left[whole], self.right[whole], self.rank[whole] = a, b, rank
        made = np.flatnonzero(self.rank >= 0)
        keys = self.left[made] * self.size + self.right[made]
        order = np.argsort(keys)
        self.pairs, self.whole = keys[order], made[order]
        sound = np.ones(self.size, bool)
        sound[made] = self.apart(self.left[made], self.right[made], within=True)
        for t in made[np.argsort(self.rank[made])]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self._grow(symbols, sound)

    def _grow(self, symbols: dict[int, tuple[int, ...]], sound: np.ndarray) -> None:
        """The tree of the tokens' symbols: sorted edges (node, symbol) with the node that they lead to."""
        edges: dict[int, int] = {}
        ends = [-1]
        for token, text in symbols.items():
            if not sound[token]:
                continue  # never the outcome of the merges
            node = 0
            for s in text:
                node = edges.setdefault(node << 9 | s, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = token
        self.edges = np.array(sorted(edges), np.int64)
        self.leads = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def merged(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; a rank after all others where there is none."""
        keys = first * self.size + second
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.rank[self.whole[at]], np.iinfo(np.int64).max)

    def apart(self, first: np.ndarray, second: np.ndarray, within: bool = False) -> np.ndarray:
        """Whether the merges keep each pair of neighbours apart.

        Time runs backwards over the ranks.  At any time the seam lies between one token of
        the first's right edge and one of the second's left edge; taking the later made of the
        two apart goes back in time to the rank of its making.  If the two that met there had
        a merge of a lower rank, it would have come first.  Of equal ranks the one further left
        comes first.  ``within``: the pair itself becomes a token, so its own merge counts for nothing.
        """
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)  # a merge below it would have come before
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            if not within:
                bad = self.merged(x, y) < limit[live]
                good[live[bad]] = False
                live, x, y = live[~bad], x[~bad], y[~bad]
            within = False
            go_left = self.rank[x] > self.rank[y]
            done = (self.rank[x] < 0) & (self.rank[y] < 0)
            limit[live] = np.where(go_left, self.rank[x], self.rank[y] + 1)
            a[live] = np.where(go_left, self.right[x], x)
            b[live] = np.where(go_left, y, self.left[y])
            live = live[~done]
        return good


class Encoder:
    """Encodes and decodes with a vocabulary; lives as long as its worker."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        marks = sorted(vocabulary.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.names = pa.array(vocabulary.names, pa.string())
        self.specials = {i: i.to_bytes(4, "little") for i in vocabulary.special.values()}
        self.ids_of: dict[str | int, bytes] = dict(self.specials)
        self.known: set[str] = set()
        self.ranks = dict(zip(vocabulary.pairs.tolist(), vocabulary.rank[vocabulary.whole].tolist(), strict=True))
        self.made = vocabulary.whole[np.argsort(vocabulary.rank[vocabulary.whole])].tolist()

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if not text.isascii():
            if not self.known.issuperset(text) and self._newer(text):
                return self._newer_words(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character is lowered alone
        return self.find(text.lower())

    def _newer(self, text: str) -> bool:
        """Whether a character has no class in Python's Unicode tables."""
        fresh = set(text) - self.known
        free = {c for c in fresh if unicodedata.category(c) == "Cn"}
        self.known |= fresh - free
        return bool(free)

    def _newer_words(self, text: str) -> list[str]:
        """Characters that Python's tables do not know yet: the library's tables tell their case and class."""
        import tokenizers

        if not hasattr(self, "newer"):
            self.newer = tokenizers.Tokenizer.from_file(self.v.path)
        text = self.newer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.newer.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens."""
        if self.marks is None or "<" not in text:
            return self.words(text)
        found: list[str | int] = []
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                found.append(self.v.special[part])
            elif part:
                found.extend(self.words(part))
        return found

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token and length of the longest match at every place that leaves no word end alone."""
        v, n = self.v, len(symbols)
        token, length = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, node, depth = np.flatnonzero(symbols != END), 0, 0
        while len(at):
            last = symbols[at + depth]
            keys = node << 9 | last if depth else last
            edge = np.minimum(np.searchsorted(v.edges, keys), len(v.edges) - 1)
            found = v.edges[edge] == keys
            at, node, last = at[found], v.leads[edge[found]], last[found]
            depth += 1
            ended, known = last == END, v.ends[node]
            fits = known >= 0
            fits[~ended] &= symbols[at[~ended] + depth] != END
            token[at[fits]], length[at[fits]] = known[fits], depth
            at, node = at[~ended], node[~ended]
        return token, length

    def speculate(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that follow each other by longest matches, and their words; starts are the words' first places."""
        token, length = self.longest(symbols)
        at, word = starts, np.arange(len(starts))
        rounds = []
        while len(at) > 16:
            rounds.append((word, token[at]))
            at = at + length[at]
            more = symbols[at - 1] != END
            at, word = at[more], word[more]
        for place, w in zip(at.tolist(), word.tolist(), strict=True):
            run = []
            while True:
                run.append(token[place])
                place += int(length[place])
                if symbols[place - 1] == END:
                    break
            rounds.append((np.full(len(run), w), np.array(run, np.int64)))
        words, tokens = (np.concatenate(x) for x in zip(*rounds, strict=True))
        order = np.argsort(words, kind="stable")
        return tokens[order], words[order]

    def exact(self, symbols: np.ndarray) -> list[int]:
        """The merges in the order of their rank, the leftmost first; symbols are one word with its end."""
        base = self.v.base
        line = base[symbols[:-1], 0].tolist()
        line[-1] = int(base[symbols[-2], 1])
        return self._short(line) if len(line) <= SHORT else self._long(line)

    def _short(self, line: list[int]) -> list[int]:
        """Looks through all pairs for each merge."""
        size, ranks, none = self.v.size, self.ranks, len(self.made)
        near = [ranks.get(a * size + b, none) for a, b in pairwise(line)]
        while near and (least := min(near)) < none:
            k = near.index(least)
            whole = self.made[least]
            line[k : k + 2] = [whole]
            del near[k]
            if k:
                near[k - 1] = ranks.get(line[k - 1] * size + whole, none)
            if k < len(near):
                near[k] = ranks.get(whole * size + line[k + 1], none)
        return line

    def _long(self, line: list[int]) -> list[int]:
        """A heap of the pairs' ranks and places."""
        size, ranks, n = self.v.size, self.ranks, len(line)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def look(k: int) -> None:
            if k >= 0 and after[k] < n:
                rank = ranks.get(line[k] * size + line[after[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, line[k], line[after[k]]))

        for k in range(n - 1):
            look(k)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            gone = after[k]
            if line[k] != a or gone >= n or line[gone] != b:
                continue  # one of the two was merged meanwhile
            line[k], line[gone] = self.made[rank], -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            look(k)
            look(before[k])
        return [t for t in line if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not remembered."""
        raws = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        stops = np.cumsum(sizes)
        symbols = np.full(int(stops[-1]), END, np.int64)
        inside = np.ones(len(symbols), bool)
        inside[stops - 1] = False
        symbols[inside] = np.frombuffer(b"".join(raws), np.uint8)
        tokens, of = self.speculate(symbols, stops - sizes)
        near = np.flatnonzero(of[1:] == of[:-1])
        keys, back = np.unique(tokens[near] * self.v.size + tokens[near + 1], return_inverse=True)
        good = self.v.apart(keys // self.v.size, keys % self.v.size)
        failed = np.zeros(len(words), bool)
        failed[of[near[~good[back]]]] = True
        packed, bounds = tokens.astype("<u4").tobytes(), np.searchsorted(of, np.arange(len(words) + 1)) * 4
        spans = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        self.ids_of.update(zip(words, (packed[a:b] for a, b in spans), strict=True))
        for k in np.flatnonzero(failed):
            ids = self.exact(symbols[stops[k] - sizes[k] : stops[k]])
            self.ids_of[words[k]] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        lines = [self.parts(t) for t in texts]
        if len(self.ids_of) > REMEMBERED:
            self.ids_of = dict(self.specials)
        fresh = list(set().union(*lines) - self.ids_of.keys())
        if fresh:
            self.learn(fresh)
        found = [b"".join(map(self.ids_of.__getitem__, line)) for line in lines]
        for w in fresh:
            if len(w) > LONGEST:
                del self.ids_of[w]
        return found

    def decode(self, packed: list[bytes]) -> pa.Array:
        """The tokens' names with a space between them."""
        offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)))
        names = self.names.take(pa.array(np.frombuffer(b"".join(packed), "<u4")))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), names), " ")


#: Of a worker process, by vocabulary file.
_encoders: dict[str, Encoder] = {}


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id_col, n_tokens, ids, decoded) for every row.

    ids are packed as little-endian unsigned 32-bit integers, as training shards hold them;
    decoded is their tokens' names with a space between them.  A null text is empty: no
    tokens, empty ids, an empty decoded text.  Special tokens inside a text count as such.
    Rows are encoded alone, so repeated rows, null ids and other columns change nothing; an
    empty table gives no rows.  Of equal ranks the leftmost pair is merged first.

    The vocabulary is read on the driver and sent with the tasks (its size is the model's).
    Memory of a worker is a run of texts (RUN characters, or one longer text), the Arrow
    batch that it came in and REMEMBERED words.
    """
    check_columns(docs, id_col, text_col)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _encoders:
            _encoders[model] = Encoder(vocabulary.value)
        encoder = _encoders[model]
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                done = int(sizes[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, done + RUN, "right")))
                part = batch.slice(first, last - first)
                packed = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                counts = pa.array([len(p) // 4 for p in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(packed, pa.binary()), encoder.decode(packed).cast(pa.string())], names=["id", "n_tokens", "ids", "decoded"])
                first = last

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)

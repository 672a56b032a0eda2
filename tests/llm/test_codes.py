"""Conversation repair, vector codes and byte-pair codes against brute force, a tokenizer library and round trips."""

import hashlib
import heapq
import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from formweave.llm import conversations as C, queries, vector_codes as V
from formweave.llm.bpe import DEFAULT_MODEL, Encoder, Vocabulary, encode_texts

WHITE = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string, part int, audit string, conv string"

# conversations


def cheapest(rows):
    """(cost, letters, lines) of rows (role, text, fault) by a search over whole scripts in order of (cost, letters)."""
    heap, done = [(0, "", 0, "", ())], set()
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    while True:
        cost, letters, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, letters, lines
        if (i, last) in done:
            continue
        done.add((i, last))
        for x in "ua":
            if x in after[last]:
                heapq.heappush(heap, (cost + 2, letters + "I", i, x, (*lines, name[x] + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                short = fault == "truncated"
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(heap, (cost + short, letters + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for x in "ua":
                    if x in after[last]:
                        heapq.heappush(heap, (cost + 2 + short, letters + "R", i + 1, x, (*lines, f"{name[x]}:{text}")))


def plainly(rows):
    """The report of undamaged rows (conv, turn, role, text), one conversation after the other."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, letters, lines = cheapest([(r, x, f) for (_, r, x), f in zip(own, faults)])
        n = Counter(faults)
        found[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def reported(frame, **options):
    found = C.conversation_report(C.repaired_conversations(frame, **options))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r[1:]) for r in found.collect()}


def random_rows(r, convs, longest):
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", "ulterior", None]
    texts = ["a.", "b", "c!", "d?  ", "e. x", "", " \t", "f.", "g ", None, *map(str, range(20))]
    for conv in convs:
        for _ in range(r.randint(1, longest)):
            yield conv, r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)


def with_columns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], ROWS)


def test_repair_against_all_scripts(spark):
    rows = list(random_rows(random.Random(4), [None, *range(150)], 9))
    rows += rows[:40]  # repeated rows
    assert reported(with_columns(spark, rows)) == plainly(rows)


@pytest.mark.parametrize("piece", [1 << 23, 50])
def test_conversations_over_many_parts(spark, piece, monkeypatch):
    """Three conversations of hundreds of rows, dealt over parts that begin and end inside them; the longest has most rows."""
    monkeypatch.setattr(C, "PIECE", piece)
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), f"{r.randrange(250)}{r.choice('.!x')}") for c, n in ((1, 40), (2, 700), (3, 90), (4, 3)) for t in range(n)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        frame = with_columns(spark, rows)
        pieces = C.repaired_conversations(frame)
        assert {r["conv_id"] for r in pieces.where("NOT alone").collect()} >= {2}
        assert reported(frame) == plainly(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_one_row_many_times(spark):
    rows = [(1, 5, "user", "same.")] * 3000 + [(1, 6, "assistant", "b.")]
    found = reported(with_columns(spark, rows))
    assert found[1][:6] == (0, 0, 2999, 0, 3 * 1000 - 1, 3 * 2999) and found[1][6] == "K" + "D" * 2999 + "K"


def test_damage_and_rows_that_stand_nowhere(spark):
    rows = [(c, t, "assistant", "x. y! z?") for c in (1, None) for t in [*range(60), None]]
    damaged = C.damaged_conversations(with_columns(spark, rows)).collect()
    fates = {}
    for c, t, *_ in rows:
        fates[c, t] = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    for r in damaged:
        fate = fates[r["conv_id"], r["turn"]]
        assert (r["times"], r["role"], r["text"]) == ({0: 0, 3: 2}.get(fate, 1), "user" if fate == 4 else "assistant", {1: "", 2: "x y z"}.get(fate, "x. y! z?"))
    assert set(fates.values()) >= {0, 1, 2, 3, 4}
    gone = spark.createDataFrame([(7, 1, "user", "a.", 0), (7, None, None, None, 0), (8, 1, "user", "a.", 1), (8, 2, "assistant", "b.", 1)], "conv_id long, turn long, role string, text string, times long")
    empty = hashlib.sha256(b"").hexdigest()
    assert reported(gone, times_col="times") == {7: (0, 0, 0, 0, 0, 0, "", empty), 8: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest())}


def test_conversations_without_rows_and_long_texts(spark):
    assert reported(with_columns(spark, [])) == {}
    rows = [(1, 1, "user", "long " * 600_000 + "."), (1, 2, "assistant", "y" * 1_000_000)]
    assert reported(with_columns(spark, rows)) == plainly(rows)


# vectors


def coded(rows, parts=8, entries=16, rounds=6):
    """The codes of rows (id, vector, label) by measuring every entry with whole numbers of any size."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in sorted(kept, key=lambda r: (r[0], r[1]))[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((far(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            for p in range(parts):
                groups.setdefault((p, nearest(v, p)[1]), []).append(part(v, p))
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found, sums = [], Counter()
    for i, v, lab in kept:
        near = [nearest(v, p) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), lab))
        sums[lab] += found[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, d, sums[lab], digest) for i, c, d, lab in found)


VECTORS = "vec_id long, embedding array<double>, label string, code string, error long, id long, n long"


def test_codes_against_every_entry(spark):
    r = random.Random(2)
    rows = [(k, [r.choice([-1, 1]) * r.random() * r.choice([0.001, 1, 9]) for _ in range(16)], r.choice([None, "", "a", "b"])) for k in range(300)]
    rows += [(k + 300, rows[k % 7][1], "copies") for k in range(400)]  # more than half are copies of a few
    rows += [(900, None, "a"), (901, [math.nan] * 16, "a"), (902, [0.0] * 15 + [math.inf], "b"), (903, [0.0] * 15 + [None], None)]
    frame = spark.createDataFrame([(*x, "x", 1, 2, 3) for x in rows], VECTORS).repartition(5)
    found = V.vector_codes(frame)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect())) == coded(rows)


def test_ties_and_few_vectors(spark):
    rows = [(k, [float(k % 2), 0.0, -1e-9, 1.0 / 3] * 4, None) for k in range(5)]
    frame = spark.createDataFrame([(*x, "x", 1, 2, 3) for x in rows], VECTORS)
    assert sorted(map(tuple, V.vector_codes(frame).collect())) == coded(rows)
    assert V.vector_codes(frame.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, [0.5] * 8, "a", "x", 1, 2, 3), (2, [0.5] * 7, "a", "x", 1, 2, 3), (3, [], "a", "x", 1, 2, 3), (4, [1e300] + [0.0] * 7, "b", "x", 1, 2, 3), (None, [0.5] * 8, "a", "x", 1, 2, 3)], VECTORS)
    found = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in V.vector_codes(odd).collect()}
    assert found == {1: ("00" * 8, 0, 0), 2: (None, None, 0), 3: (None, None, 0), 4: (None, None, 0), None: ("00" * 8, 0, 0)}


def test_bounds_hold_and_leave_few(spark):
    r = np.random.default_rng(1)
    book, rows = r.integers(-5000, 5000, (16, 8)), r.integers(-6000, 6000, (2000, 8))
    low, high = V.CellFile(book).bounds(rows)
    exact = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()
    assert (low <= high.min(1, keepdims=True)).mean() < 0.6
    entry, least = V.CellFile(book).nearest(rows)
    assert (entry == exact.argmin(1)).all() and (least == exact.min(1)).all()


def test_decoded_vectors(spark):
    frame = spark.createDataFrame([(k, [k / 4, -k / 8] * 8, "a", "", 0, 0, 0) for k in range(12)], VECTORS)
    books = V.train_codebooks(frame)
    back = V.decode_vectors(V.encode_vectors(frame, books), books)
    assert {r["vec_id"]: list(r["decoded"]) for r in back.collect()} == {k: [k / 4, -k / 8] * 8 for k in range(12)}  # an entry for each


# byte pairs


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(DEFAULT_MODEL)


def same_as_library(library, texts):
    encoder = Encoder(Vocabulary())
    packed = encoder.encode(texts)
    for text, ids, decoded, known in zip(texts, packed, encoder.decode(packed).to_pylist(), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == known.ids, text[:200]
        assert decoded == library.decode(known.ids, skip_special_tokens=False)


def test_random_texts(library):
    r = random.Random(1)
    bits = ["a", "b", "e", "th", "ing", "'", "s", " ", "\n", "É", "Σ", "ς", "1", "9", "!", "?", "<|endoftext|>", "<|startoftext|>", "<|", "ß", "İ", "ſ", "́", "\x1c", "\x85", "​", "中", "文", "😀", "가", "ᄀ", "ᅡ", "…", "\U00010d50", "Ɤ", "aa", "ab", "\x00"]
    same_as_library(library, ["".join(r.choices(bits, k=r.randint(0, 40))) for _ in range(3000)])
    same_as_library(library, ["".join(r.choices("etaoinshr", k=20)) for _ in range(3000)] + ["a" * k for k in range(1, 200)] + ["".join(r.choices("ab", k=50)) for _ in range(500)])
    same_as_library(library, ["x" * 200_000 + "ab" * 50_000, "!?" * 3000, ""])


@pytest.mark.parametrize("gap", [" ", "1", "a"])
def test_every_character(library, gap):
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn" and chr(c) not in "<|"]
    same_as_library(library, [gap.join(known)])


def test_neighbours_decide(library):
    """The check of all pairs tells exactly those words that longest matches get wrong."""
    encoder = Encoder(Vocabulary())
    merged = []
    exact = encoder.exact
    encoder.exact = lambda symbols: merged.append(bytes(symbols[:-1].astype(np.uint8)).decode()) or exact(symbols)
    r = random.Random(3)
    words = sorted({"".join(r.choices("etaoinshrdlu", k=r.randint(1, 12))) for _ in range(4000)})
    encoder.encode([" ".join(words)])
    greedy = Encoder(Vocabulary())
    greedy.exact = lambda symbols: greedy.speculate(symbols, np.array([0]))[0].tolist()
    greedy.encode([" ".join(words)])
    wrong = {w for w in words if np.frombuffer(greedy.ids_of[w], "<u4").tolist() != library.encode(w, add_special_tokens=False).ids}
    assert wrong == set(merged) and 0 < len(wrong) < len(words)


def test_byte_pairs_of_hard_rows(spark, library):
    rows = [(None, None), (None, "Hello World"), (1, None), (2, ""), (3, " \t\n"), (4, "same"), (4, "same"), (5, "x" * 3_000_000), (6, "\x00é日本  " * 30)]
    frame = spark.createDataFrame([(*r, 9, "x", "y") for r in rows], "doc_id long, text string, n_tokens long, ids string, decoded string")
    found = encode_texts(frame)
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    known = Counter()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        known[i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r[0], r[1], bytes(r[2]), r[3]) for r in found.collect()) == known
    assert encode_texts(frame.limit(0)).collect() == []


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError, match="word ends"):
        Vocabulary(DEFAULT_MODEL.replace("word_bpe_49k", "byte_bpe_50k"))


def test_digests_of_the_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("text")).collect()}
    found = queries.op13_bpe_codes(spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

"""The pipeline over the whole smallest table: each stage against plain Python on its own input, and run() against the last."""

import re
from collections import Counter
from math import floor

import numpy as np
import pyarrow as pa

import corpus_pipeline
from formweave.llm import mixing
from formweave.llm.decontaminate import THRESHOLD, align
from formweave.llm.pii import personal_data
from formweave.llm.site_quality import site_quality
from formweave.llm.textarrays import text_bytes, word_hashes, word_spans

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def without_copies(rows):
    """One row of each group of texts that links of 85 % connect: the one with the least id."""
    sets = []
    for _, text, *_ in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    holders = {}
    for i, own in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(i)
    shared = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            group[root(a)] = root(b)
    best = {}
    for i, row in enumerate(rows):
        key = root(i)
        if key not in best or row[0] < rows[best[key]][0]:
            best[key] = i
    return [rows[i] for i in best.values()]


def hashes(texts):
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends, doc = word_spans(raw, offsets)
    found = word_hashes(raw, starts, ends)
    return [found[doc == i] for i in range(len(texts))]


def mixed(rows):
    """Copies by one offset over each source's documents in order of size, every second one on the way back."""
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    sources = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    own = {s: sum(n for n, r in zip(sizes, rows) if r[3] == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    left, open_, target = sum(own.values()), set(sources), {}
    while True:
        share = sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * left >= 3 * own[s] * share]
        if not full:
            break
        s = min(full, key=lambda s: (3 * own[s] / weight[s], sources.index(s)))
        target[s] = 3.0 * own[s]
        left, open_ = left - 3 * own[s], open_ - {s}
    target |= {s: weight[s] * left / share for s in open_}
    start, out = mixing.offset_of(20240301), Counter()
    for s in sources:
        inside = [(n, r) for n, r in zip(sizes, rows) if r[3] == s]

        def place(x):
            n, r = x
            step = 10 ** max(len(str(n)) - 2, 0)
            return n - n % step, r[0] % mixing.PRIME * mixing.FACTOR % mixing.PRIME % mixing.SALTS, n, r[0]

        each = min(target[s] / own[s], 3.0) if own[s] else 0.0
        for nth, (_, r) in enumerate(sorted(inside, key=place), 1):
            at = (nth + 1) // 2 if nth % 2 else len(inside) + 1 - nth // 2
            out[r] += min(floor(at * each + start) - floor((at - 1) * each + start), 3)
    return +out


def test_every_stage_on_what_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def through(name, docs):
        stages[name](spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    judged = {r["doc_id"]: r["kept"] for r in site_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    before, docs = rows_of(docs), through("quality", docs)
    rows = rows_of(docs)
    assert Counter(rows) == Counter(r for r in before if judged[r[0]]) and 0 < len(rows) < len(before)

    docs = through("near_dedup", docs)
    before, rows = rows, rows_of(docs)
    assert Counter(rows) == Counter(without_copies(before)) and len(rows) < len(before)

    docs = through("decontaminate", docs)
    before, rows = rows, rows_of(docs)
    items = hashes([r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    texts = hashes([r[1] or "" for r in before])
    # a score of the threshold needs half of an item's words in the text
    bad = {i for i, words in enumerate(texts) if any(np.isin(item, words).sum() * 2 >= THRESHOLD * 2 * len(item) and align(item, words) >= THRESHOLD for item in items)}
    assert Counter(rows) == Counter(r for i, r in enumerate(before) if i not in bad) and bad

    spans = {r["doc_id"]: r["spans"] for r in personal_data(docs).collect()}
    docs = through("personal_data", docs)
    before, rows, want = rows, rows_of(docs), []
    for i, text, lang, source, n in before:
        found, end = [], 0
        for kind, a, b in sorted((x.split(":") for x in spans[i].split(",") if x), key=lambda x: (int(x[1]), -int(x[2]))):
            if int(a) >= end:
                found.append((kind, int(a), int(b)))
                end = int(b)
        for kind, a, b in reversed(found):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        want.append((i, text, lang, source, n if text is None else len(text)))
    assert Counter(rows) == Counter(want) and rows != before

    docs = through("mix", docs)
    assert Counter(rows_of(docs)) == mixed(rows)
    assert Counter(rows_of(corpus_pipeline.run(spark, FOLDER))) == Counter(rows_of(docs))

"""From words to phrases: line folds, learned merging of wrapped lines, text rules."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from formweave.functions.groups import fold_groups, map_groups

BOX = ("x0", "y0", "x1", "y1")
#: Vertical strips of a page at most.
STRIPS = 64
#: Later phrases that each phrase is compared with all at once, before it looks into its strips.
NEAR = 256
#: Ground phrases of a list that are compared as part of the plan; more of them are a table.
LISTED = 64
#: A word over this size is a header.
HEADER_SIZE = 12


def _reading() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("word_idx")


def word_size(x0: str = "x0", x1: str = "x1", text: str = "text") -> Column:
    """Width of a character of a word."""
    return (F.col(x1) - F.col(x0)) / F.length(text)


def split_words(words: DataFrame, mark: str = ":") -> DataFrame:
    """words cut at a punctuation mark, which is a word of its own; a part's box is its characters' share of the word's."""
    parts = F.regexp_extract_all("text", F.lit(f"[{mark}]|[^{mark}]+"), F.lit(0))
    rows = words.select("*", F.length("text").alias("_n"), parts.alias("_parts")).select("*", F.posexplode("_parts").alias("_k", "_t"))
    ahead = F.length(F.array_join(F.slice("_parts", F.lit(1), F.col("_k")), ""))
    at = lambda n: F.col("x0") + (F.col("x1") - F.col("x0")) * n / F.col("_n")
    rows = rows.select("*", at(ahead).alias("_a"), at(ahead + F.length("_t")).alias("_z"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("word_idx", "_k")) - 1
    changed = {"word_idx": place, "text": F.col("_t"), "x0": F.col("_a"), "x1": F.col("_z")}
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in words.columns))


def words_to_phrases(words: DataFrame, y_near: float = 4.0, gap: float | None = None, parity: bool = False) -> DataFrame:
    """phrases from words (doc_id, word_idx, page, text, box): neighbours on a line become one phrase.

    A word continues the phrase if its gap to the last word is at most the mean of both
    sizes (or the fixed ``gap``), and its middle lies within ``y_near`` of the middle of
    the phrase's first word; ``:`` is dropped and ends a phrase.  All but the middle is a
    matter of neighbours, and so is a middle further than 2 ``y_near`` from the last
    word's; the short runs between such breaks are folded for the rest.  The last phrase
    and the union of boxes are kept, and phrases end with their page.  With ``parity`` the
    last phrase of a document goes, pages do not count, and a box is the first word's but
    for the last word's right end.
    """
    rows = words.withColumn("_size", word_size()).withColumn("_mid", (F.col("y0") + F.col("y1")) / 2)
    before = lambda c: F.lag(c).over(_reading())
    room = F.lit(gap) if gap is not None else (before("_size") + F.col("_size")) / 2
    joins = (before("text") != ":") & (F.col("x0") - before("x1") <= room) & (F.abs(before("_mid") - F.col("_mid")) < 2 * y_near)
    if not parity:
        joins = joins & (before("page") == F.col("page"))
    rows = rows.withColumn("_run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(_reading())).where("text <> ':'")
    word = F.struct("word_idx", "text", *BOX, "page", F.col("_mid").alias("mid"))
    runs = rows.groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(word)).alias("w"))
    fold = f"""aggregate(sequence(0, size(w) - 1), named_struct('starts', CAST(array() AS ARRAY<INT>), 'mid', CAST(NULL AS DOUBLE)), (s, i) ->
        CASE WHEN abs(w[i].mid - s.mid) < {y_near!r}D THEN s ELSE named_struct('starts', array_append(s.starts, i), 'mid', w[i].mid) END, s -> s.starts)"""
    runs = runs.withColumn("at", F.expr(fold))
    found = runs.select("doc_id", F.explode(F.expr("transform(at, (a, k) -> slice(w, a + 1, coalesce(get(at, k + 1), size(w)) - a))")).alias("w"))
    order = Window.partitionBy("doc_id").orderBy(F.expr("w[0].word_idx"))
    box = ("w[0].x0", "w[0].y0", "element_at(w, -1).x1", "w[0].y1") if parity else tuple(f"array_{f}(transform(w, z -> z.{c}))" for f, c in (("min", "x0"), ("min", "y0"), ("max", "x1"), ("max", "y1")))
    out = found.select("doc_id", (F.row_number().over(order) - 1).alias("phrase_idx"), F.expr("w[0].page").alias("page"), F.expr("array_join(transform(w, z -> z.text), ' ')").alias("text"), *[F.expr(e).alias(c) for e, c in zip(box, BOX, strict=True)])
    if parity:
        last = F.max("phrase_idx").over(Window.partitionBy("doc_id"))
        out = out.withColumn("_last", last).where("phrase_idx < _last").drop("_last")
    return out


def line_phrases(words: DataFrame, gap: float = 3.0, pages: int | None = None) -> DataFrame:
    """The older rule: words of one line (equal top or bottom) closer than ``gap`` join; header-sized words go."""
    rows = words if pages is None else words.where(F.col("page") <= pages)
    before = lambda c: F.lag(c).over(_reading())
    line = ((before("y0") == F.col("y0")) | (before("y1") == F.col("y1"))) & (before("page") == F.col("page"))
    joins = F.coalesce(line & (F.abs(F.col("x0") - before("x1")) < gap), F.lit(False))
    rows = rows.withColumn("_phrase", F.sum(F.when(joins, 0).otherwise(1)).over(_reading())).where(word_size() <= HEADER_SIZE)
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    found = rows.groupBy("doc_id", "_phrase").agg(F.min("word_idx").alias("_at"), F.min("page").alias("page"), ordered.alias("_w"), *[getattr(F, f)(c).alias(c) for f, c in (("min", "x0"), ("min", "y0"), ("max", "x1"), ("max", "y1"))])
    order = Window.partitionBy("doc_id").orderBy("_at")
    return found.select("doc_id", (F.row_number().over(order) - 1).alias("phrase_idx"), "page", F.expr("array_join(transform(_w, w -> w.text), ' ')").alias("text"), *BOX)


def is_time(text: Column) -> Column:
    """Whether a text reads as a time like 9:30AM."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("h:mma")).isNotNull(), F.lit(False))


def is_number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double").isNotNull(), F.lit(False))


# Headers that run together in one family of reports, and their parts.
RUN_TOGETHER = {
    "Date AssignedRacialCategory / Type": ("Date Assigned", "Racial", "Category / Type"),
    "Disposition Completed Recorded On Camera": ("Disposition", "Completed", "Recorded On Camera"),
    "F/PAction": ("F/P", "Action"),
}
COURTESY, ACTION, DATE = "Courtesy:", "Action", "Date"


def split_colons(text: Column) -> Column:
    """Array of the trimmed parts of a phrase that are not empty.

    A phrase with one colon that is no time and no courtesy line has two, one of the
    headers that run together has the header's, and two colons around an action after
    a date make four; any other phrase stays whole.
    """
    colons = F.regexp_count(text, F.lit(":"))
    two = F.split(text, ":")
    found = F.when((colons == 1) & ~is_time(text) & ~text.contains(COURTESY), two)
    for header, parts in RUN_TOGETHER.items():
        found = found.when((colons == 0) & text.contains(header), F.array(*map(F.lit, parts)))
    action = F.split(text, f"{ACTION}:", 2)
    four = F.concat(F.split(F.get(action, F.lit(0)), ":"), F.array(F.lit(ACTION), F.get(action, F.lit(1))))
    found = found.when((colons == 2) & text.contains(f"{ACTION}:") & text.contains(DATE), four)
    cleaned = F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(found.isNotNull(), cleaned).otherwise(F.array(text))


def legacy_phrases(words: DataFrame, gap: float = 3.0, pages: int | None = None) -> DataFrame:
    """The older rule as a whole: lines' phrases, split at colons; parts keep their phrase's box, empty ones go."""
    parts = line_phrases(words, gap, pages).select("doc_id", "phrase_idx", "page", F.posexplode(split_colons(F.col("text"))).alias("k", "text"), *BOX).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("phrase_idx", "k")
    return parts.select("doc_id", (F.row_number().over(order) - 1).alias("n"), "page", "text", *BOX).withColumnRenamed("n", "phrase_idx")


def phrase_boxes(phrases: DataFrame) -> DataFrame:
    """(doc_id, text, first_idx, boxes): each text's boxes in order of appearance."""
    box = F.struct("phrase_idx", *BOX, "page")
    return phrases.groupBy("doc_id", "text").agg(F.min("phrase_idx").alias("first_idx"), F.array_sort(F.collect_list(box)).alias("boxes"))


def subphrases(texts: DataFrame, column: str = "text") -> DataFrame:
    """Distinct runs of tokens (sub) of all texts."""
    runs = "flatten(transform(sequence(1, size(t)), i -> transform(sequence(1, size(t) - i + 1), n -> array_join(slice(t, i, n), ' '))))"
    tokens = texts.select(F.expr(f"filter(split({column}, '\\\\s+'), x -> x <> '')").alias("t")).where("size(t) > 0")
    return tokens.select(F.expr(f"explode({runs})").alias("sub")).distinct()


def overlaps(a: str, b: str, ratio: float = 0.2) -> str:
    """SQL: x-overlap of at least a share of the narrower box on one page."""
    shared = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    return f"({a}.page = {b}.page AND {shared} > 0 AND {shared} >= {ratio} * least({a}.x1 - {a}.x0, {b}.x1 - {b}.x0))"


def vertical_gap(a: str, b: str) -> str:
    """SQL: distance of two boxes of a page along y, 0 if they overlap."""
    return f"CASE WHEN {a}.y1 < {b}.y0 THEN {b}.y0 - {a}.y1 WHEN {b}.y1 < {a}.y0 THEN {a}.y0 - {b}.y1 ELSE 0 END"


def _overlap(a0: float, a1: float, b0: float, b1: float, ratio: float = 0.2) -> bool:
    """As ``overlaps``, of two boxes of a page."""
    shared = min(a1, b1) - max(a0, b0)
    return shared > 0 and shared >= ratio * min(a1 - a0, b1 - b0)


class Strips:
    """The boxes of a page by vertical strips of about equally many edges: later boxes over a stretch of x, in order.

    A box is listed in the strips that it touches, so a walk meets neighbours in x only.
    """

    def __init__(self, x0: np.ndarray, x1: np.ndarray):
        edges = np.sort(np.concatenate([x0, x1]))
        count = min(STRIPS, max(1, len(x0) // 4))
        self.marks = np.unique(edges[np.arange(1, count) * len(edges) // count]) if len(edges) else edges
        self.lists: list[list[int]] = [[] for _ in range(len(self.marks) + 1)]
        low, high = np.searchsorted(self.marks, x0, "right"), np.searchsorted(self.marks, x1, "right")
        for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            for s in range(a, b + 1):
                self.lists[s].append(i)

    def after(self, at: int, left: float, right: float) -> Iterator[int]:
        """Places of at and later, ascending, whose boxes share a strip with the stretch."""
        a, b = (int(np.searchsorted(self.marks, x, "right")) for x in (left, right))
        heap = []
        for s in range(a, b + 1):
            k = bisect_left(self.lists[s], at)
            if k < len(self.lists[s]):
                heap.append((self.lists[s][k], s, k))
        heapq.heapify(heap)
        last = -1
        while heap:
            i, s, k = heap[0]
            if k + 1 < len(self.lists[s]):
                heapq.heapreplace(heap, (self.lists[s][k + 1], s, k + 1))
            else:
                heapq.heappop(heap)
            if i != last:
                last = i
                yield i


def later_overlaps(x0: np.ndarray, x1: np.ndarray, starts: np.ndarray, ratio: float = 0.2) -> np.ndarray:
    """For each box the place of the first later one of its page that it overlaps, or -1; ``starts`` are the places where pages start.

    All boxes meet the next one, then those still alone the one after it, NEAR times; what is left of long pages looks into its page's strips.
    """
    ends = np.append(starts, len(x0))[1:]
    end, width = np.repeat(ends, ends - starts), x1 - x0
    found, alone = np.full(len(x0), -1), np.arange(len(x0))
    for ahead in range(1, NEAR + 1):
        alone = alone[alone + ahead < end[alone]]
        if not len(alone):
            return found
        later = alone + ahead
        shared = np.minimum(x1[alone], x1[later]) - np.maximum(x0[alone], x0[later])
        met = (shared > 0) & (shared >= ratio * np.minimum(width[alone], width[later]))
        found[alone[met]] = later[met]
        alone = alone[~met]
    at = np.searchsorted(starts, alone, "right") - 1
    for page in np.unique(at).tolist():
        a, z = int(starts[page]), int(ends[page])
        strips, left, right = Strips(x0[a:z], x1[a:z]), x0[a:z].tolist(), x1[a:z].tolist()
        for i in (alone[at == page] - a).tolist():
            j = next((j for j in strips.after(i + NEAR + 1, left[i], right[i]) if _overlap(left[i], right[i], left[j], right[j], ratio)), -1)
            found[a + i] = a + j if j >= 0 else -1
    return found


def first_later(x0: np.ndarray, x1: np.ndarray) -> list[int]:
    """For each box of a page the first later one that it overlaps, or -1."""
    return later_overlaps(x0, x1, np.zeros(min(len(x0), 1), int)).tolist()


OVERLAPS = "doc_id string, page int, a int, b int, a_text string, b_text string, distance double"


def next_overlaps(phrases: DataFrame, dealt: bool = False) -> DataFrame:
    """(doc_id, page, a, b, a_text, b_text, distance): each phrase with the first later one of its page that x-overlaps it.

    The pages of a batch are compared at once, as columns.  ``dealt`` phrases lie by document already.
    """

    def pairs(pages: pa.Table, starts: np.ndarray) -> pa.Table:
        x0, y0, x1, y1 = (pages.column(c).to_numpy() for c in BOX)
        second = later_overlaps(x0, x1, starts)
        i = np.flatnonzero(second >= 0)
        j = second[i]
        a, b = pages.take(pa.array(i)), pages.select(["phrase_idx", "text"]).take(pa.array(j))
        distance = np.fmax(0.0, np.fmax(y0[j] - y1[i], y0[i] - y1[j]))
        found = {"doc_id": a["doc_id"], "page": a["page"], "a": a["phrase_idx"], "b": b["phrase_idx"], "a_text": a["text"], "b_text": b["text"], "distance": pa.array(distance)}
        return pa.table(found)

    return map_groups(phrases.select("doc_id", "page", "phrase_idx", "text", *BOX), ["doc_id", "page"], ["phrase_idx"], pairs, OVERLAPS, dealt)


def ground_table(phrases: DataFrame, ground: DataFrame | list[str]) -> DataFrame:
    """Ground phrases as a table with a column text, of a list or a table that has one."""
    if isinstance(ground, DataFrame):
        return ground.select("text").distinct()
    return phrases.sparkSession.createDataFrame([(g,) for g in sorted(set(ground))], "text string")


def _tokens(column: str) -> Column:
    return F.filter(F.split(column, r"\s+"), lambda x: x != "")


def _seams(ground: DataFrame) -> DataFrame:
    """(t, u, padded): neighbouring tokens of each ground phrase, with its tokens between single spaces: as many rows as tokens."""
    rows = ground.select(_tokens("text").alias("w")).where("size(w) > 1").select("w", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("padded"))
    return rows.select("padded", F.inline(F.array_distinct(_neighbours("w")))).select("t", "u", "padded")


def _neighbours(w: str) -> Column:
    return F.expr(f"zip_with(slice({w}, 1, size({w}) - 1), slice({w}, 2, size({w}) - 1), (a, b) -> named_struct('t', a, 'u', b))")


def _lists(ground: DataFrame) -> DataFrame:
    """(token, padded): ground phrases by each of their tokens."""
    return _seams(ground).select(F.explode(F.array("t", "u")).alias("token"), "padded").distinct()


def _met(texts: DataFrame, columns: list[str], lists: DataFrame) -> DataFrame:
    """texts with the ground phrases that have their tokens' rarest one; a text with a token that no ground phrase has meets none."""
    rows = texts.select(*columns, F.array_distinct(_tokens(columns[0]) if len(columns) == 1 else F.concat(*map(_tokens, columns))).alias("w")).where("size(w) > 0")
    counts = lists.groupBy("token").agg(F.count("*").alias("n"))
    found = rows.select(*columns, F.size("w").alias("all"), F.explode("w").alias("token")).join(counts, "token")
    rare = found.groupBy(*columns, "all").agg(F.min(F.struct("n", "token")).alias("m"), F.count("*").alias("here")).where("here = all")
    return rare.select(*columns, F.col("m.token").alias("token")).join(lists, "token")


def labelled_pairs(phrases: DataFrame, ground: DataFrame | list[str], dealt: bool = False) -> DataFrame:
    """next_overlaps with is_positive: the joined text is part of a ground phrase and the first one none itself.

    A short list of ground phrases is looked through for each pair, in the one pass that finds the pairs; of a table or a long list
    the different pairs meet the phrases that hold their rarest token.
    """
    pairs = next_overlaps(phrases, dealt)
    if not isinstance(ground, DataFrame) and len(set(ground)) <= LISTED:
        joined = F.concat(F.lit(" "), "a_text", F.lit(" "), "b_text", F.lit(" "))
        padded = [" ".join(["", *filter(None, re.split(r"[ \t\n\x0B\f\r]+", g)), ""]) for g in sorted(set(ground))]
        part = reduce(or_, (F.lit(p).contains(joined) for p in padded), F.lit(False))
        return pairs.withColumn("is_positive", F.coalesce(part & ~F.col("a_text").isin(sorted(set(ground))), F.lit(False)))
    ground = ground_table(phrases, ground)
    met = _met(pairs.select("a_text", "b_text").distinct(), ["a_text", "b_text"], _lists(ground))
    met = met.where(F.col("padded").contains(F.concat(F.lit(" "), "a_text", F.lit(" "), "b_text", F.lit(" "))))
    part = met.select("a_text", "b_text", F.lit(True).alias("_known")).distinct()
    whole = ground.select(F.col("text").alias("a_text"), F.lit(True).alias("_whole"))
    joined = pairs.join(part, ["a_text", "b_text"], "left").join(whole, "a_text", "left")
    return joined.select(*pairs.columns, (F.col("_whole").isNull() & F.col("_known").isNotNull()).alias("is_positive"))


def distance_threshold(pairs: DataFrame) -> DataFrame:
    """One row (max_positive, min_negative, threshold); -1 for both extremes if a side is empty."""
    extremes = pairs.agg(F.max(F.when(F.col("is_positive"), F.col("distance"))).alias("p"), F.min(F.when(~F.col("is_positive"), F.col("distance"))).alias("n"))
    empty = "p IS NULL OR n IS NULL"
    extremes = extremes.select(F.expr(f"CASE WHEN {empty} THEN -1.0D ELSE p END").alias("max_positive"), F.expr(f"CASE WHEN {empty} THEN -1.0D ELSE n END").alias("min_negative"))
    return extremes.withColumn("threshold", F.expr("least(min_negative - 0.001D, (max_positive + min_negative) / 2)"))


MERGED = "doc_id string, page int, k int, text string, x0 double, y0 double, x1 double, y1 double"


def _merged(page: dict[str, list], accepts) -> list[tuple]:
    """Greedy merging within a page, whose rows are in order: every unused phrase absorbs later unused x-overlapping ones.

    ``accepts`` sees the merged phrase (text, x0, y0, x1, y1) and a candidate's place; the
    search of a phrase ends at the first overlapping candidate that is not accepted.
    """
    x0, y0, x1, y1, texts = (list(page[c]) for c in ("x0", "y0", "x1", "y1", "text"))
    strips = Strips(np.array(x0), np.array(x1))
    free = [True] * len(texts)
    out = []
    for i in range(len(texts)):
        if not free[i]:
            continue
        merged, at = (texts[i], x0[i], y0[i], x1[i], y1[i]), i + 1
        while at:
            left, right = merged[1], merged[3]
            j = next((j for j in strips.after(at, left, right) if free[j] and _overlap(x0[j], x1[j], left, right)), 0)
            at = j + 1 if j and accepts(merged, j) else 0
            if at:
                free[j] = False
                merged = (f"{merged[0]} {texts[j]}", min(left, x0[j]), min(merged[2], y0[j]), max(right, x1[j]), max(merged[4], y1[j]))
        out.append(merged)
    return out


def _columns(page: dict[str, list], merged: list[tuple]) -> dict[str, list]:
    found = dict(zip(("text", *BOX), map(list, zip(*merged, strict=True)), strict=True))
    return {"doc_id": page["doc_id"][:1] * len(merged), "page": page["page"][:1] * len(merged), "k": list(range(len(merged)))} | found


def _numbered(merged: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("page", "k")
    return merged.select("doc_id", (F.row_number().over(order) - 1).alias("phrase_idx"), "page", "text", *BOX)


def merge_by_distance(phrases: DataFrame, threshold: float) -> DataFrame:
    """Lines of one cell become one phrase while the gap to the merged box is at most the threshold.

    Output is in order of page, top and left.
    """

    def merge(page: dict[str, list]) -> dict[str, list]:
        y0, y1 = page["y0"], page["y1"]
        return _columns(page, _merged(page, lambda m, j: max(0.0, y0[j] - m[4], m[2] - y1[j]) <= threshold))

    rows = phrases.select("doc_id", "page", "phrase_idx", "text", *BOX)
    return _numbered(fold_groups(rows, ["doc_id", "page"], ["y0", "x0", "phrase_idx"], merge, MERGED))


def merge_by_ground(phrases: DataFrame, ground: DataFrame | list[str]) -> DataFrame:
    """Lines of one cell become one phrase while the joined text is (part of) a ground phrase.

    Ground phrases are a table.  A phrase that is joined to another stands in a ground phrase behind
    the other's last token: by its rarest token it meets the ground phrases that hold it, and a page
    gets those of its phrases where the token before is the end of one of its phrases.
    """
    ground = ground_table(phrases, ground)
    behind = _met(phrases.select("text").distinct(), ["text"], _lists(ground)).withColumn("u", F.get(_tokens("text"), F.lit(0)))
    behind = behind.where(F.col("padded").contains(F.concat(F.lit(" "), "text", F.lit(" ")))).withColumn("w", _tokens("padded"))
    before = F.filter(_neighbours("w"), lambda z: (z["u"] == F.col("u")) & F.col("padded").contains(F.concat(F.lit(" "), z["t"], F.lit(" "), "text", F.lit(" "))))
    behind = behind.select("text", "padded", F.explode(before).alias("z")).select("text", "padded", F.col("z.t").alias("t"))
    last = phrases.select("doc_id", "page", F.element_at(_tokens("text"), -1).alias("t")).where("t IS NOT NULL").distinct()
    known = phrases.select("doc_id", "page", "text").distinct().join(behind, "text").join(last, ["doc_id", "page", "t"], "left_semi")
    known = known.groupBy("doc_id", "page").agg(F.collect_set("padded").alias("known"))
    rows = phrases.select("doc_id", "page", "phrase_idx", "text", *BOX).withColumn("last", F.lit(0)).unionByName(known.withColumn("last", F.lit(1)), allowMissingColumns=True)

    def merge(page: dict[str, list]) -> dict[str, list]:
        whole = "\n".join(page["known"][-1] or ())
        own = {c: v[: page["last"].count(0)] for c, v in page.items()}
        texts = own["text"]
        return _columns(own, _merged(own, lambda m, j: f" {m[0]} {texts[j]} " in whole))

    return _numbered(fold_groups(rows, ["doc_id", "page"], ["last", "phrase_idx"], merge, MERGED))


def apply_rules(phrases: DataFrame, ground: DataFrame | list[str]) -> DataFrame:
    """Learn the distance threshold from ground phrases, then merge by it where it separates, else by the ground phrases."""
    row = distance_threshold(labelled_pairs(phrases, ground)).first()
    if row["threshold"] >= 0 and row["threshold"] > row["max_positive"]:
        return merge_by_distance(phrases, row["threshold"])
    return merge_by_ground(phrases, ground)


def join_three(a: Column, b: Column, c: Column) -> Column:
    """One phrase of three structs of a page: joined text and the union of boxes; fails across pages."""
    same = F.assert_true((a["page"] == b["page"]) & (b["page"] == c["page"]), F.lit("phrases of different pages"))
    text = F.when(same.isNull(), F.concat_ws(" ", a["text"], b["text"], c["text"]))
    sides = [(F.least if k in ("x0", "y0") else F.greatest)(a[k], b[k], c[k]).alias(k) for k in BOX]
    return F.struct(text.alias("text"), *sides, a["page"].alias("page"))


def sample_pairs(pairs: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """A sample of negative pairs without replacement."""
    return pairs.where("NOT is_positive").orderBy(F.rand(seed)).limit(n)

"""Visual rows of phrase layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from formweave.functions.sql import string

PHRASES = "doc_id string, phrase_idx int, page int, text string, x0 double, y0 double, x1 double, y1 double"


def visual_rows(phrases: DataFrame, across_pages: bool = False, dealt: bool = False) -> DataFrame:
    """(doc_id, row_id, page, cells): phrases in reading order join a row while they y-overlap all its members.

    The members' state is their greatest y0 and least y1, so one fold over a page finds
    where rows start, and rows are slices; a page whose neighbours all stand level or apart
    needs no fold.  With ``across_pages`` a row may go on over a page break (groups are documents).  Phrases are dealt by document once, for this and
    all later steps; with ``dealt`` they are so already, and are not moved.
    """
    keys = ["doc_id"] if across_pages else ["doc_id", "page"]
    cell = F.struct(F.col("phrase_idx").alias("idx"), "text", "x0", "y0", "x1", "y1", "page")
    phrases = phrases if dealt else phrases.repartition("doc_id")
    pages = phrases.select(*keys, cell.alias("cell")).groupBy(*keys).agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    fold = """aggregate(sequence(0, size(cells) - 1), named_struct('starts', CAST(array() AS ARRAY<INT>), 'top', CAST(NULL AS DOUBLE), 'bottom', CAST(NULL AS DOUBLE)),
        (s, i) -> CASE WHEN cells[i].y0 <= s.bottom AND cells[i].y1 >= s.top
            THEN named_struct('starts', s.starts, 'top', greatest(s.top, cells[i].y0), 'bottom', least(s.bottom, cells[i].y1))
            ELSE named_struct('starts', array_append(s.starts, i), 'top', cells[i].y0, 'bottom', cells[i].y1) END, s -> s.starts)"""
    # where neighbours stand level or apart, rows start at those apart, and nothing is to be folded
    changes = "filter(sequence(0, size(cells) - 1), i -> CASE WHEN i > 0 THEN NOT coalesce(cells[i].y0 = cells[i - 1].y0 AND cells[i].y1 = cells[i - 1].y1, false) ELSE true END)"
    level = "forall(at, i -> cells[i].y0 <= cells[i].y1 AND CASE WHEN i > 0 THEN NOT (cells[i].y0 <= cells[i - 1].y1 AND cells[i].y1 >= cells[i - 1].y0) ELSE true END)"
    pages = pages.withColumn("at", F.expr(changes)).withColumn("at", F.expr(f"CASE WHEN {level} THEN at ELSE {fold} END"))
    own = F.expr("slice(cells, a + 1, coalesce(get(at, r + 1), size(cells)) - a)").alias("cells")
    if across_pages:
        rows = pages.select("doc_id", "cells", "at", F.posexplode_outer("at").alias("r", "a")).select("doc_id", "r", own)
        order = Window.partitionBy("doc_id").orderBy("page", "r")
        return rows.withColumn("page", F.expr("cells[0].page")).select("doc_id", (F.row_number().over(order) - 1).alias("row_id"), "page", "cells")
    ahead = F.sum(F.size("at")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.size("at")
    rows = pages.withColumn("ahead", ahead.cast("int")).select("doc_id", "page", "ahead", "cells", "at", F.posexplode_outer("at").alias("r", "a"))
    return rows.select("doc_id", (F.col("ahead") + F.col("r")).alias("row_id"), "page", own)


def row_texts(rows: DataFrame, between: str = " | ") -> DataFrame:
    """(doc_id, row_id, page, text): rows as lines of text, to look at."""
    return rows.select("doc_id", "row_id", "page", F.array_join("cells.text", between).alias("text"))


def without_last_row(rows: DataFrame) -> DataFrame:
    """A learning sample ends in a row that may be cut off; it goes."""
    last = F.max("row_id").over(Window.partitionBy("doc_id"))
    return rows.withColumn("_last", last).where("row_id < _last").drop("_last")


def metadata_share(metadata: list[str], cells: str = "cells") -> str:
    """SQL: share of a row's phrases that lie inside a metadata string, upper or lower case."""
    if not metadata:
        return "0.0D"
    inside = " OR ".join(f"contains({string(m.lower())}, t)" for m in metadata)
    return f"(size(filter(transform({cells}.text, t -> lower(t)), t -> {inside})) / size({cells}))"


def known_row(metadata_rows: list[list[str]], cells: str = "cells") -> str:
    """SQL: whether a row's texts equal a registered metadata row, upper or lower case."""
    if not metadata_rows:
        return "false"
    rows = ", ".join("array(" + ", ".join(string(t.lower()) for t in r) + ")" for r in metadata_rows if r)
    sizes = ", ".join(sorted({str(len(r)) for r in metadata_rows if r}))
    return f"CASE WHEN size({cells}) IN ({sizes}) THEN transform({cells}.text, t -> lower(t)) IN ({rows}) ELSE false END"


def holds_words(metadata: str, text: str) -> str:
    """SQL: whether a string holds a text between word bounds (space, line end, colon or an end), as written."""
    bound = r"[ \n:]"
    quoted = f"regexp_replace({text}, r'([^A-Za-z0-9 ])', r'\\\\$1')"
    return f"({metadata} RLIKE concat(r'(^|{bound})', {quoted}, r'($|{bound})'))"


def occurrences(phrases: DataFrame) -> DataFrame:
    """phrases with nth, the number of the phrase among its text's occurrences in the document: a text's nth box belongs to record nth."""
    return phrases.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("phrase_idx")))

"""Line-first cleaning: rules judge lines, failing lines go, documents that lose too much go."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, check_columns, words_of

# Patterns that Java and RE2 read alike.
#: Marks that end a sentence, a clause or a list's head, of every script that has some.
MARKS = ".!?:;…‼⁇⁈⁉。．！？：；｡؟؛۔।॥։׃።፧፨።។៕၊။།༎᠃᙮꓿"
#: Closing brackets and quotes by their Unicode classes, and white space.
CLOSERS, BLANKS = r"""[\p{Pe}\p{Pf}\p{Pi}"']*""", r"[\x20\x09-\x0D]*"
END = f"[{MARKS}]{CLOSERS}{BLANKS}$"
#: The same of a line read backwards, which only looks at its end.
REVERSED_END = f"^{BLANKS}{CLOSERS}[{MARKS}]"
STOP, COMMON_STOP = f"[,،、，{MARKS}]", "[.!?,;:]"
#: Scripts that end sentences with a space (Thai, Lao, Tibetan, Myanmar, Khmer): the punctuation rule does not judge their lines.
UNMARKED = "[\u0e00-\u109f\u1780-\u17ff]"
SYMBOL = r"[#*$%&|<>]"
NOT_SYMBOLS = r"[^#*$%&|<>{}=^~_\\]+"
SEPARATOR = r"[\x20\x09][|>»·•｜][\x20\x09]"
#: Phrases of site furniture in English, German, French and Spanish; letters beyond ASCII in both cases.
BOILERPLATE = (
    r"(?i)all rights reserved|cookie (policy|settings)|privacy policy|terms of (use|service)|enable javascript|(sign|log) in to"
    r"|subscribe to our|click here|lorem ipsum|powered by|skip to (main )?content"
    r"|alle rechte vorbehalten|cookie-?(richtlinie|einstellungen)|datenschutzerkl[äÄ]rung|nutzungsbedingungen|klicken sie hier|newsletter abonnieren|zum inhalt springen"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de (cookies|confidentialit[éÉ])|mentions l[éÉ]gales|conditions d['’]utilisation|cliquez ici|abonnez-vous [àÀ] notre|aller au contenu"
    r"|todos los derechos reservados|pol[íÍ]tica de (cookies|privacidad)|aviso legal|condiciones de uso|haga clic aqu[íÍ]|suscr[íÍ]bete a nuestr|saltar al contenido"
)
#: Of each phrase a part in lower case: a text without any of them has no such line.
NEEDLES = (
    "rights reserved", "cookie", "privacy policy", "terms of", "enable javascript", "in to", "subscribe to", "click here", "lorem ipsum", "powered by", "skip to",
    "rechte vorbehalten", "datenschutzerkl", "nutzungsbedingungen", "klicken sie", "newsletter abonnieren", "zum inhalt", "tous droits", "politique de", "mentions l",
    "conditions d", "cliquez ici", "abonnez-vous", "aller au contenu", "derechos reservados", "tica de", "aviso legal", "condiciones de uso", "haga clic", "bete a nuestr", "saltar al contenido",
)
#: A line of fewer words needs an end mark, a longer one any punctuation.
SHORT = 10
#: Most symbols of a line, percent of its characters.
SYMBOLS = 10
#: Most words that a kept document loses with its lines, percent.
LOST = 40


def _fails(line: Column) -> Column:
    """Whether a line breaks the punctuation or the navigation rule."""
    n = F.size(F.split(F.btrim(line, F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
    stopped = line.rlike(COMMON_STOP) | line.rlike(STOP)
    unpunctuated = ~F.reverse(line).rlike(REVERSED_END) & ((n < SHORT) | ~stopped) & ~line.rlike(UNMARKED)
    symbols = F.length(F.regexp_replace(line, NOT_SYMBOLS, "")) * 100 > F.length(line) * SYMBOLS
    navigation = F.size(F.split(line, SEPARATOR)) > 3
    return unpunctuated | symbols | navigation


def _all_fail(text: Column, lines: Column) -> Column:
    """For each line whether it breaks a rule; the boilerplate rule is asked where the text has a part of such a phrase."""
    low = F.lower(text)
    some = reduce(or_, [low.contains(needle) for needle in NEEDLES])
    return F.when(some, F.transform(lines, lambda x: _fails(x) | x.rlike(BOILERPLATE))).otherwise(F.transform(lines, _fails))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, n_bad_lines, clean_text) for every row.

    A null or blank text has zeros and fails the base (fewer than 50 words).  Rows
    are judged alone: repeated rows, null ids and other columns change nothing.
    Work and memory are linear in a text but for one sort of its word windows.
    ``clean_text`` is the text without blank and failing lines; a text that loses as
    much as LOST allows is kept.  Repeated lines are judged each.  An empty table gives no rows.
    """
    check_columns(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    spoken = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = rows.select("id", "text", spoken.alias("lines"), "words", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size("words").alias("n"))
    window = lambda i: F.struct(F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("w"), i.alias("i"))
    windows = F.when(F.col("n") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n") - 3), window)))
    rows = rows.select(
        "id", "text", "lines", "n", F.length(F.array_join("words", "")).alias("word_chars"), windows.alias("windows"), _all_fail(F.col("text"), F.col("lines")).alias("fails")
    )
    again = lambda x, k: F.coalesce(x["w"] == F.get("windows", k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get("windows", k + 1)["w"], F.lit(False))
    found = F.sort_array(F.transform(F.filter("windows", again), lambda x: x["i"]))
    bad, good = F.filter("lines", lambda x, i: F.get("fails", i)), F.filter("lines", lambda x, i: ~F.get("fails", i))
    rows = rows.select("id", "text", "lines", "n", "word_chars", bad.alias("bad"), F.array_join(good, "\n").alias("clean"), found.alias("found"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("found", zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    lost = F.aggregate("bad", F.lit(0), lambda a, x: a + F.size(F.split(F.btrim(x, F.lit(SPACES)), r"[\x20\x09-\x0D]+")))
    rows = rows.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        lost.cast("long").alias("lost_words"),
        F.size("bad").cast("long").alias("n_bad_lines"),
        F.col("clean").alias("clean_text"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= LOST * F.col("n_words")))
    return rows.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "n_bad_lines", "clean_text")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
#: The same counts and verdicts in DuckDB.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
b AS (SELECT doc_id, i, line, len({_WORDS.format("line")}) AS n,
    (NOT regexp_matches(line, {_sql(END)}) AND (len({_WORDS.format("line")}) < {SHORT} OR NOT regexp_matches(line, {_sql(STOP)})) AND NOT regexp_matches(line, {_sql(UNMARKED)}))
    OR length(regexp_replace(line, {_sql(NOT_SYMBOLS)}, '', 'g')) * 100 > length(line) * {SYMBOLS}
    OR len(regexp_split_to_array(line, {_sql(SEPARATOR)})) > 3 OR regexp_matches(line, {_sql(BOILERPLATE)}) AS bad FROM l),
lost AS (SELECT doc_id, sum(CASE WHEN bad THEN n ELSE 0 END)::BIGINT AS lost_words, count(*) FILTER (bad) AS n_bad_lines, string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS clean FROM b GROUP BY doc_id),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
x AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS twice FROM x),
z AS (SELECT doc_id, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM z GROUP BY doc_id),
q AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words, coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines, sha256(coalesce(clean, '')) AS clean_sha256
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_words <= {LOST} * n_words AS kept, lost_words, n_bad_lines, clean_sha256 FROM f
"""

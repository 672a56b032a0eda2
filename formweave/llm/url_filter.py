"""URL filters: host and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import check_columns

_UPPER = {c: c + 32 for c in range(65, 91)}

# The contract's rules, as verdict and host with path.
RULES: tuple[tuple[str, str], ...] = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: The default vocabulary was written for this operator from what such hosts commonly call themselves; it is a parameter.
#: One of these rejects a URL.
STRICT = ("porn", "porno", "xxx", "adult", "sex", "casino", "viagra", "cialis", "escort", "warez", "hentai", "milf", "onlyfans", "darknet")
#: Terms that count by weight; two different ones of total weight REJECT reject a URL.
SOFT = {
    "bet": 2, "bets": 2, "betting": 2, "poker": 2, "slots": 2, "jackpot": 2, "pills": 2, "pharmacy": 2, "spam": 2, "farm": 1, "ads": 2, "adserver": 2, "track": 1, "tracker": 2,
    "tracking": 1, "free": 1, "cheap": 1, "win": 1, "prize": 2, "lottery": 2, "torrent": 2, "crack": 2, "cracked": 2, "keygen": 2, "loan": 2, "loans": 2, "payday": 2, "replica": 2,
    "dating": 2, "hot": 1, "nude": 2, "click": 1, "clicks": 1, "popup": 2, "affiliate": 2, "discount": 1, "deal": 1, "deals": 1, "buy": 1, "now": 1, "bonus": 1, "crypto": 1, "seo": 1,
}
REJECT, DIFFERENT = 3, 2


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:]
    ends = [i for i in map(tail.find, "?#") if i >= 0]
    return rest[:cut].translate(_UPPER), tail[: min(ends, default=len(tail))]


class Rules:
    """Rules by host suffix; the longest that fits wins, among equals the first."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append(("/" + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        labels = host.split(".")
        for k in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best


class Vocabulary:
    """Counts strict and soft terms in a URL; a term's neighbours must not be letters."""

    def __init__(self, strict: tuple[str, ...], soft: dict[str, int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in soft.items():
            self.automaton.add_word(term, (term, weight))
        for term in strict:
            self.automaton.add_word(term, (term, 0))
        self.automaton.make_automaton()

    def count(self, url: str) -> tuple[int, int, int]:
        """Strict hits, different soft terms, their weight."""
        strict, soft = 0, {}
        for last, (term, weight) in self.automaton.iter(url):
            first = last - len(term)
            if (first < 0 or not url[first].isalpha()) and (last + 1 >= len(url) or not url[last + 1].isalpha()):
                if weight:
                    soft[term] = weight
                else:
                    strict += 1
        return strict, len(soft), sum(soft.values())


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, int] | None = None
) -> DataFrame:
    """(id_col, host, path, rule, verdict, strict_hits, soft_hits, soft_weight) for every row.

    A null or empty url has empty parts, no rule and is allowed.  Of rules of one length
    that fit, the first counts; a term that occurs twice is one different term.  Rows are
    judged alone: repeated rows, null ids and other columns change nothing.  An empty
    table gives no rows; a url of any length is read whole.
    """
    check_columns(pages, id_col, url_col)
    soft = SOFT if soft is None else soft

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = known.find(host, path)
                counts = terms.count((url or "").translate(_UPPER))
                bad = counts[0] > 0 or (counts[1] >= DIFFERENT and counts[2] >= REJECT)
                out.append((host, path, rule, verdict or ("block" if bad else "allow"), *counts))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int64()] * 3
            names = ["id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    schema = "id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight long"
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)


_ANY = "(^|[^a-z])({})($|[^a-z])"
#: The same parts, rules and verdicts in DuckDB; letters beyond a-z do not occur in the tables' URLs.
ORACLE = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}),
m AS (SELECT p.page_id, p.url, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM p JOIN r
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, position('/' IN rule))) GROUP BY ALL),
w(term, weight) AS (VALUES {", ".join(f"('{t}', {w})" for t, w in SOFT.items())}),
s AS (SELECT page_id, url, count(*) AS soft_hits, sum(weight) AS soft_weight FROM p JOIN w ON regexp_matches(lower(url), '(^|[^a-z])' || term || '($|[^a-z])') GROUP BY ALL),
x(term) AS (VALUES {", ".join(f"('{t}')" for t in STRICT)}),
h AS (SELECT page_id, url, sum(len(regexp_extract_all(regexp_replace(lower(url), '([^a-z])', '\\1\\1', 'g'), '(^|[^a-z])' || term || '($|[^a-z])'))) AS strict_hits FROM p CROSS JOIN x GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN strict_hits > 0 OR (coalesce(soft_hits, 0) >= {DIFFERENT} AND coalesce(soft_weight, 0) >= {REJECT}) THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits::BIGINT AS strict_hits, coalesce(soft_hits, 0)::BIGINT AS soft_hits, coalesce(soft_weight, 0)::BIGINT AS soft_weight
FROM p LEFT JOIN m USING (page_id, url) LEFT JOIN s USING (page_id, url) LEFT JOIN h USING (page_id, url)
"""

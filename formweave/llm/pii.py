"""Personal data: pattern kinds, high-recall candidates judged by boosted trees, spans and redaction.

Everything on the path of the data is a column expression.  The trees are grown
on the driver from a small labelled table, whose features the same expressions
compute, and return to the plan as nested CASE expressions.
"""

from __future__ import annotations

import json
import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .boosting import boost, calibrated_threshold, score, tree_sql
from .common import check_columns, row_place

KINDS = ("email", "ip", "card", "phone", "key", "number")
#: The contract's patterns.  A match can only start where a run of its first
#: characters starts or where the last match ended, which keeps long runs linear;
#: possessive repeats keep Java's matcher off the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without it has no match of the kind.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: High-recall generators, on the text with base matches blanked out: kind, sign, pattern.  No run is cut at a length.
GENERATORS = (
    ("email", r"(?i)(?:[(\[]at[)\]]|\x20at\x20\S+\x20dot\x20)", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?[a-z0-9-]++(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)|\x20at\x20[a-z0-9-]++\x20dot\x20)[a-z]{2,}+"),
    ("phone", "[0-9]", r"(?<![0-9A-Za-z.+])\+?(?:[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,8}(?:[\x20./-][0-9]{2,5}){0,4}(?![0-9A-Za-z])"),
    ("number", "[0-9]", r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9]{9,}+)(?![0-9A-Za-z])"),
    ("key", "[0-9]", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{12,}+"),
    ("key", r"(?i)(?:passw|passphrase|pwd|kennwort|contrase|mot\x20de\x20passe|clave|\bpin\b)", r"(?<![^\s\"'`:=])[^\s\"'`<>\x01]{4,}+"),
    ("key", "PRIVATE KEY-----", r"-----BEGIN\x20[A-Z0-9\x20]{0,40}+(?<=PRIVATE\x20KEY)-----(?:[A-Za-z0-9+/=:,\s\x01]*+-----END\x20[A-Z0-9\x20]{0,40}+(?<=PRIVATE\x20KEY)-----)?+"),
)
#: What must stand right before a candidate of a generator, by its place; blocks of a private key need nothing more.
BEHIND = {4: r"(?i)(?:passwor[dt]|passwd|passphrase|pwd|kennwort|contrase(?:ñ|n)a|mot\x20de\x20passe|clave|pin)\x20?(?:is|was|ist|lautet|es|est|:|=)[:=]?\x20?[\"'`]?$"}
BLOCKS = 5
#: Words before a candidate that speak for it, the nearest kind of them, and what speaks against it.
CUE = r"(?i)(passw|passwd|pwd|kennwort|contrase|mot de passe|\bclave\b|token|secret|api[_ -]?key|credential|bearer)"
CALL = r"(?i)(phone|tel\b|tel\.|tel:|t[eé]l[eé]f|call|mobile?\b|m[oó]vil|handy|fax|whatsapp|appel|anruf|ruf|llam)"
ACCOUNT = r"(?i)(ssn|social security|sozialvers|s[eé]curit[eé] sociale|iban|account|konto|cuenta|compte|card|passport|passeport|pasaporte|reisepass|tax id|steuer|\bnif\b|\bdni\b)"
MAIL = r"(?i)(mail|contact|write|reach|schreib|escrib|[eé]criv|kontakt)"
AGAINST = r"(?i)(commit|checksum|digest|sha-?[0-9]+|md5|uuid|guid|isbn|issn|\bdoi\b|version|build|revision|order|invoice|part no|model|article|figure|pages?|pp\.)"
#: Code points before a candidate that are read for cues.
CONTEXT = 24
BLOCK = 64
#: The score of what needs no judgement.
CERTAIN = 1000.0
#: Where the length of a candidate, a feature, saturates.
LONGEST = 200
FEATURES = ("kind", "length", "digits", "letters", "upper", "mixed", "groups", "shape", "cue", "hexadecimal")


def _with_matches(rows: DataFrame, text: str, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """rows with, for each (column, sign, pattern), the array of (m, s, e): matches with code point spans.

    Starts are prefix sums of the lengths of gaps and matches, by blocks, so that
    thousands of matches in a text stay cheap.  Each step is a projection of its
    own: a column read inside a lambda is then read, not computed again.
    """
    names = [n for n, _, _ in wanted]
    kept = [c for c in rows.columns if c not in names]

    def parts(sign: str, pattern: str) -> Column:
        matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        joined = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), (F.length(m) + F.length(g)).alias("t")))
        found = F.filter(joined, lambda x: x["m"].isNotNull())
        return F.when(F.col(text).rlike(sign), found).otherwise(F.array().cast("array<struct<m:string,g:int,t:int>>"))

    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x["t"])

    def ahead(name: str) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(name) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(name, b * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(name) > 0, F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n)))

    def placed(name: str) -> Column:
        def place(x: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            start = F.get(f"{name}_ahead", b) + total(F.slice(name, b * BLOCK + 1, i - b * BLOCK)) + x["g"]
            return F.struct(x["m"].alias("m"), start.alias("s"), (start + F.length(x["m"])).alias("e"))

        return F.transform(name, place)

    rows = rows.select(*kept, *[parts(sign, pattern).alias(n) for n, sign, pattern in wanted])
    rows = rows.select("*", *[ahead(n).alias(f"{n}_ahead") for n in names])
    return rows.select(*kept, *[placed(n).alias(n) for n in names])


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        def fits(p: Column) -> Column:
            bare = F.ltrim(p, F.lit("0"))
            return F.when(F.length(bare) <= 3, F.concat(F.lit("0"), bare).cast("int") <= 255).otherwise(False)

        return F.forall(F.split(m, r"\."), fits)
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def _validator(kind: str):
    return lambda x: _valid(kind, x["m"])


def _blanked(text: Column, kind: str) -> Column:
    """The text with each valid match of a kind replaced by as many blanks."""
    matches, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    blank = lambda m: F.when(_valid(kind, m), F.repeat(F.lit("\x01"), F.length(m))).otherwise(m)
    joined = F.array_join(F.zip_with(gaps, matches, lambda g, m: F.when(m.isNull(), g).otherwise(F.concat(g, blank(m)))), "")
    return F.when(text.rlike(SIGNS[kind]), joined).otherwise(text)


def _certain(m: str) -> str:
    """SQL: whether a number is an account or identity number by its checksum or its shape."""
    bare = f"regexp_replace({m}, ' ', '')"
    turned = f"concat(substring({bare}, 5, length({bare})), substring({bare}, 1, 4))"
    digit = "CASE WHEN substring(q, i, 1) BETWEEN '0' AND '9' THEN (r * 10 + CAST(substring(q, i, 1) AS INT)) % 97 ELSE (r * 100 + ascii(substring(q, i, 1)) - 55) % 97 END"
    iban = f"element_at(transform(array({turned}), q -> aggregate(sequence(1, length(q)), 0, (r, i) -> {digit})), 1) = 1"
    return f"CASE WHEN {m} RLIKE r'^[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]{{1,4}}){{3,8}}$' THEN {iban} ELSE {m} RLIKE r'^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$' END"


def _features(kind: int, m: str, before: str) -> dict[str, str]:
    """Format and context of a candidate, as SQL over two SQL operands."""
    count = lambda p: f"length(regexp_replace({m}, r'{p}', ''))"
    shape = " ".join(
        f"WHEN {m} RLIKE r'{p}' THEN {k}"
        for k, p in (
            (1, r"^\+?(?:1[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$"),
            (2, r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
            (3, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3}"),
            (4, r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|AIza|eyJ)"),
            (5, r"^(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}|(?:1[0-9]|20)[0-9]{2}[-/](?:1[0-9]|20)?[0-9]{2})$"),
            (6, r"^(?:0[0-9]{1,4}|\(0[0-9]{1,4}\))[\x20/-]?(?:[0-9]{5,8}|[0-9]{2,4}(?:[\x20.-][0-9]{2,4})+)$"),
            (7, r"^[0-9]{1,3}(?:[\x20.][0-9]{3})+$"),
            (8, r"(?i)[(\[]at[)\]]"),
        )
    )
    cue = " ".join(f"WHEN {before} RLIKE r'{p}' THEN {k}" for k, p in ((1, CUE), (2, CALL), (3, ACCOUNT), (4, MAIL), (5, AGAINST)))
    found = {
        "kind": str(kind), "length": f"least(length({m}), {LONGEST})", "digits": count("[^0-9]+"), "letters": count("[^A-Za-z]+"), "upper": count("[^A-Z]+"),
        "mixed": f"regexp_count({m}, r'(?:[0-9][A-Za-z]|[A-Za-z][0-9])')", "groups": f"size(split({m}, r'[^A-Za-z0-9]+'))",
        "shape": f"CASE {shape} ELSE 0 END", "cue": f"CASE {cue} ELSE 0 END", "hexadecimal": f"CASE WHEN {m} RLIKE r'^[0-9a-f]+$' THEN 1 ELSE 0 END",
    }
    return {n: f"CAST({x} AS DOUBLE)" for n, x in found.items()}


def _described(kind: int, m: str, before: str, *more: str) -> str:
    """A struct of the features, after other fields."""
    return f"named_struct({', '.join([*more, *[f"'{n}', {x}" for n, x in _features(kind, m, before).items()]])})"


class _Maker:
    """Draws the pieces of labelled candidates."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def of(self, alphabet: str, n: int) -> str:
        return "".join(self.r.choices(alphabet, k=n))

    def digits(self, n: int) -> str:
        return self.of(string.digits, n)

    def lower(self, a: int, b: int | None = None) -> str:
        return self.of(string.ascii_lowercase, self.r.randint(a, b or a))

    def prose(self) -> str:
        return " ".join(self.lower(2, 9) for _ in range(4)) + " "

    def mixed(self, n: int, alphabet: str) -> str:
        """A run with a digit and a letter at least."""
        return self.of(alphabet, n - 2) + self.r.choice(string.digits) + self.r.choice([c for c in alphabet if c.isalpha()])

    def pick(self, *options: str) -> str:
        return self.r.choice(options)


HEX, ALNUM = "0123456789abcdef", string.ascii_letters + string.digits


def labelled_table(seed: int = 7, each: int = 24) -> list[tuple[str, str, int]]:
    """(text before, candidate, 1 if personal or secret), made from a rule; trees and thresholds come from it."""
    m, rows = _Maker(seed), []
    for _ in range(each):
        rows += [
            (m.pick("password=", 'token = "', "api_key: ", "secret=", "Passwort: ", "mot de passe : "), m.mixed(m.r.choice([16, 18, 24, 40, 64]), HEX), 1),
            (m.prose(), "AKIA" + m.of(string.ascii_uppercase + "234567", 15) + "7", 1),
            (m.pick("Bearer ", "secret key ", "access token: "), m.mixed(m.r.choice([20, 32, 48]), ALNUM), 1),
            (m.prose(), m.pick("ghp_", "sk-", "xoxb-", "AIza", "eyJ") + m.mixed(m.r.choice([20, 36]), ALNUM), 1),
            (m.prose(), f"({m.digits(3)}) {m.digits(3)}-{m.digits(4)}", 1),
            (m.pick("phone ", "call me: ", "tel. "), f"{m.digits(3)}-{m.digits(3)}-{m.digits(4)}", 1),
            (m.pick("Tel: ", "mobile ", "llame al "), f"0{m.digits(2)} {m.digits(3)} {m.digits(4)}", 1),
            (m.pick("call ", "Anruf unter ", "fax "), f"0{m.digits(m.r.choice([2, 3]))}{m.pick(' ', '/', '-')}{m.digits(m.r.choice([6, 7, 8]))}", 1),
            (m.pick("appelez le ", "tel. "), f"0{m.digits(1)} " + " ".join(m.digits(2) for _ in range(4)), 1),
            (m.prose(), f"{m.digits(3)}-{m.digits(2)}-{m.digits(4)}", 1),
            (m.pick("IBAN ", "iban: ", "Konto "), f"{m.pick('DE', 'FR', 'ES', 'NL')}{m.digits(2)} {m.digits(4)} {m.digits(4)} {m.digits(4)} {m.digits(4)}", 1),
            (m.pick("account ", "SSN ", "cuenta ", "passport "), m.digits(m.r.choice([9, 10, 12, 22])), 1),
            (m.prose(), f"{m.lower(6)} (at) {m.lower(7)} (dot) com", 1),
            (m.prose(), f"{m.lower(5)}[at]{m.lower(7)}.org", 1),
            (m.prose(), f"{m.lower(5)} at {m.lower(5)} dot com", 1),
            (m.prose(), m.lower(12, 30), 0),
            (m.prose(), m.lower(12, 20).capitalize(), 0),
            (m.prose(), m.lower(12, 20).upper(), 0),
            (m.prose(), f"{m.lower(7)}-{m.lower(8)}", 0),
            (m.prose(), f"{m.lower(8)}_{m.lower(4)}{m.digits(1)}", 0),
            (m.prose(), f"{m.lower(5)}/{m.lower(6)}/{m.lower(5)}", 0),
            (m.prose(), m.mixed(12, string.ascii_lowercase[:8] + "12"), 0),
            (m.pick("commit ", "md5 ", "checksum: "), m.mixed(m.r.choice([32, 40, 64]), HEX), 0),
            (m.prose(), f"{m.mixed(8, HEX)}-{m.mixed(4, HEX)}-{m.mixed(4, HEX)}-{m.mixed(4, HEX)}-{m.mixed(12, HEX)}", 0),
            (m.prose(), f"{m.pick('19', '20')}{m.digits(2)}-{m.digits(2)}-{m.digits(2)}", 0),
            (m.prose(), f"{m.pick('19', '20')}{m.digits(2)}{m.pick('-', '/')}{m.pick('19', '20')}{m.digits(2)}", 0),
            (m.prose(), f"{m.digits(2)}-{m.digits(2)}", 0),
            (m.prose(), f"{m.digits(3)} {m.digits(3)}", 0),
            (m.prose(), f"{m.digits(2)} {m.digits(3)} {m.digits(3)}", 0),
            (m.prose(), f"{m.digits(4)}-{m.digits(4)}", 0),
            (m.pick("pages ", "pp. ", "order "), f"{m.digits(3)}-{m.digits(m.r.choice([3, 4, 7]))}", 0),
            (m.prose(), m.digits(m.r.choice([9, 10, 13, 25])), 0),
            (m.pick("ISBN ", "order ", "invoice "), m.digits(m.r.choice([9, 10, 13])), 0),
            (m.prose(), f"{m.lower(4)} at {m.lower(5)} dot {m.lower(9)}", 0),
            (m.pick("the password is ", "Kennwort: ", "pwd=", "mi clave es ", "Passwort ist "), m.lower(3, 8) + m.digits(m.r.choice([1, 2, 4])), 1),
            (m.pick("password: ", "passphrase is ", "mot de passe est ", "contraseña: ", "pwd="), m.lower(3, 5).capitalize() + m.pick("!", "#", "$", "-", "_") + m.mixed(5, ALNUM), 1),
            (m.pick("my pin is ", "PIN: ", "pwd: "), m.digits(m.r.choice([4, 6])), 1),
            (m.pick("the password is ", "Passwort ist ", "la clave es ", "mot de passe est "), m.lower(4, 11), 0),
            (m.pick("the password is ", "password: ", "Kennwort: "), m.lower(4, 9) + m.pick(".", ",", "!"), 0),
        ]
    return rows


#: Candidates of a group in ``labelled_table``.
KINDS_OF_ROWS = 39


def held_out_table(seed: int = 70, each: int = 12) -> list[tuple[str, str, int]]:
    """The same of other forms, cues and lengths than ``labelled_table`` has, for the figures of the README."""
    m, rows = _Maker(seed), []
    for _ in range(each):
        rows += [
            (m.pick("contraseña: ", "pwd=", "Kennwort ", "client_secret: "), m.mixed(m.r.choice([20, 28, 56]), ALNUM), 1),
            (m.pick("X-Api-Key: ", "credentials "), m.mixed(m.r.choice([22, 44, 300]), HEX), 1),
            (m.prose(), m.pick("gho_", "xoxp-", "ASIA") + m.mixed(m.r.choice([16, 30]), string.ascii_uppercase + string.digits), 1),
            (m.pick("Handy ", "whatsapp: ", "Telefon: "), f"0{m.digits(3)} {m.digits(7)}", 1),
            (m.pick("téléphone ", "phone no "), f"{m.digits(3)} {m.digits(3)} {m.digits(4)}", 1),
            (m.prose(), f"1-{m.digits(3)}-{m.digits(3)}-{m.digits(4)}", 1),
            (m.pick("compte ", "my iban is "), f"{m.pick('AT', 'BE', 'IT')}{m.digits(2)}{m.digits(16)}", 1),
            (m.pick("Reisepass ", "DNI ", "tax id "), m.digits(m.r.choice([9, 11])), 1),
            (m.prose(), f"{m.lower(4)}.{m.lower(6)} [at] {m.lower(5)} [dot] net", 1),
            (m.prose(), m.lower(18, 40), 0),
            (m.prose(), f"{m.lower(4)}-{m.lower(4)}-{m.lower(6)}", 0),
            (m.prose(), f"{m.lower(3).capitalize()}{m.lower(5).capitalize()}{m.lower(6).capitalize()}", 0),
            (m.pick("sha256 ", "digest ", "revision "), m.mixed(m.r.choice([40, 64]), HEX), 0),
            (m.prose(), f"{m.digits(2)}.{m.digits(2)}.{m.pick('19', '20')}{m.digits(2)}", 0),
            (m.prose(), f"{m.digits(1)} {m.digits(3)} {m.digits(3)}", 0),
            (m.pick("figure ", "model "), f"{m.digits(2)}-{m.digits(4)}", 0),
            (m.pick("version ", "build "), m.digits(m.r.choice([10, 12])), 0),
            (m.prose(), f"/{m.lower(4)}/{m.lower(6)}/{m.lower(4)}", 0),
        ]
    return rows


def second_table(seed: int = 170, each: int = 12) -> list[tuple[str, str, int]]:
    """Another one, of forms that neither of the others has; drawn after the generators and trees were done."""
    m, rows = _Maker(seed), []
    for _ in range(each):
        country, body = m.pick("DE", "FR", "PT"), m.digits(18)
        check = 98 - int(body + "".join(str(ord(c) - 55) for c in country) + "00") % 97
        rows += [
            (m.pick("passwd was ", "Passwort lautet ", "pin="), m.lower(2, 3) + m.digits(4) + m.lower(2, 4), 1),
            (m.pick("passphrase: ", "clave = "), m.lower(4, 6).upper() + m.digits(2) + m.pick("%", "&", "?"), 1),
            (m.prose(), f"{country}{check:02}{body}", 1),
            (m.prose(), f"{country}{check:02} {body[:4]} {body[4:8]} {body[8:12]} {body[12:16]} {body[16:]}", 1),
            (m.pick("her number ", "ID "), f"{m.r.randint(100, 599)}-{m.r.randint(10, 99)}-{m.r.randint(1000, 9999)}", 1),
            (m.pick("Basic ", "sig=", "session "), m.mixed(m.r.choice([24, 36]), ALNUM), 1),
            (m.pick("rufen Sie ", "call "), f"+{m.digits(2)} {m.digits(3)} {m.digits(6)}", 1),
            (m.pick("passwd was ", "Passwort lautet ", "pin is ", "clave es "), m.lower(4, 10), 0),
            (m.pick("tracking ", "serial "), m.mixed(14, string.ascii_uppercase + string.digits), 0),
            (m.pick("isbn ", "doi "), f"{m.digits(3)}-{m.digits(1)}-{m.digits(4)}-{m.digits(4)}-{m.digits(1)}", 0),
            (m.prose(), f"{m.digits(1)},{m.digits(3)},{m.digits(3)}", 0),
            (m.prose(), f"{m.lower(3)}_{m.lower(5)}_{m.lower(7)}", 0),
        ]
    return rows


@lru_cache(maxsize=1)
def _trained(spark: SparkSession) -> tuple[list, dict[int, float]]:
    """Trees and each kind's threshold, from the labelled table; a small job of bounded size."""
    i, x, y = described(spark, labelled_table())
    fit, kinds = i // KINDS_OF_ROWS % 2 == 0, x[:, 0].astype(int)
    trees = boost(x[fit], y[fit], rounds=20, depth=4, rate=0.4)
    return trees, {k: calibrated_threshold(trees, x[~fit & (kinds == k)], y[~fit & (kinds == k)]) for k in sorted(set(kinds.tolist()))}


def described(spark: SparkSession, labelled: list[tuple[str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, FEATURES and labels of labelled candidates, once for each generator that proposes exactly one."""
    rows = json.dumps([{"i": i, "before": a, "m": m, "y": y} for i, (a, m, y) in enumerate(labelled)])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<i:int,before:string,m:string,y:int>>")))
    quoted = lambda pattern: pattern.replace("'", "\\x27")
    proposed = ", ".join(
        f"CASE WHEN m RLIKE r'^(?:{quoted(pattern).replace('(?i)', '')})$' AND before RLIKE r'{quoted(BEHIND.get(g, ''))}' THEN {_described(KINDS.index(kind), 'm', 'before')} END"
        for g, (kind, _, pattern) in enumerate(GENERATORS) if g != BLOCKS
    )
    found = table.select("i", "y", F.expr(f"inline(filter(array({proposed}), f -> f IS NOT NULL))")).orderBy("i", "kind").collect()
    return np.array([r["i"] for r in found]), np.array([[r[n] for n in FEATURES] for r in found], float), np.array([r["y"] for r in found], float)


def judged_labels(spark: SparkSession, labelled: list[tuple[str, str, int]]) -> list[tuple[int, int]]:
    """(label, 1 if the trees accept it for any kind) of each labelled candidate."""
    trees, thresholds = _trained(spark)
    i, x, _ = described(spark, labelled)
    good = score(trees, x) >= np.array([thresholds.get(int(k), 0.0) for k in x[:, 0]])
    return [(y, int(good[i == n].any())) for n, (_, _, y) in enumerate(labelled)]


def _candidates(g: int, found: str, text: str) -> str:
    """SQL: a generator's candidates as structs of their span, whether they need no judgement, and their features.

    Numbers that a checksum or their shape proves, and blocks of private keys, need none.
    """
    kind = GENERATORS[g][0]
    k = KINDS.index(kind)
    if g == BLOCKS:
        none = ", ".join(f"'{n}', {float(k) if n == 'kind' else 0.0}D" for n in FEATURES)
        return f"transform({found}, x -> named_struct('s', x.s, 'e', x.e, 'sure', true, {none}))"
    before = f"substring({text}, greatest(x.s - {CONTEXT}, 0) + 1, least(x.s, {CONTEXT}))"
    if g in BEHIND:
        behind = BEHIND[g].replace("'", "\\x27")
        found = f"filter({found}, x -> {before} RLIKE r'{behind}')"
    sure = _certain("x.m") if kind == "number" else "false"
    return f"transform({found}, x -> {_described(k, 'x.m', before, "'s', x.s", "'e', x.e", f"'sure', {sure}")})"


def _judged(candidates: str, trees: list, thresholds: dict[int, float]) -> Column:
    """Spans (s, e, k, p) of the candidates in a column that the trees accept; p is their score.  The trees stand in the plan once."""
    score_of = f"CASE WHEN f.sure THEN {CERTAIN}D ELSE {tree_sql(trees, [f'f.{n}' for n in FEATURES])} END"
    scored = f"transform({candidates}, f -> named_struct('s', f.s, 'e', f.e, 'k', CAST(f.kind AS INT), 'p', {score_of}))"
    least = " ".join(f"WHEN {k} THEN {t!r}D" for k, t in thresholds.items())
    return F.expr(f"filter({scored}, f -> f.p >= CASE f.k {least} ELSE 0.0D END)")


#: Spans (s, e, k, p) in order of start; those that overlap become one, of the best-scored kind.
_APART = """CASE WHEN forall(sequence(1, greatest(size({a}) - 1, 1)), i -> coalesce(get({a}, i).s >= get({a}, i - 1).e, true)) THEN {a} ELSE aggregate(slice({a}, 2, size({a})),
    named_struct('out', slice({a}, 1, 0), 'c', {a}[0]), (t, x) -> CASE WHEN x.s >= t.c.e THEN named_struct('out', array_append(t.out, t.c), 'c', x)
        ELSE named_struct('out', t.out, 'c', named_struct('s', t.c.s, 'e', greatest(t.c.e, x.e), 'k', CASE WHEN x.p > t.c.p THEN x.k ELSE t.c.k END, 'p', greatest(t.c.p, x.p))) END,
    t -> array_append(t.out, t.c)) END"""


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with columns _base and _spans: arrays of (s, k, e) in order of start, then kind."""
    names = docs.columns
    trees, thresholds = _trained(docs.sparkSession)
    rows = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = _with_matches(rows, "_text", [(f"_{k}", SIGNS[k], p) for k, p in PATTERNS.items()])
    valid = [_spans(F.filter(f"_{k}", _validator(k)), k) for k in PATTERNS]
    rows = rows.select(*names, "_text", F.sort_array(F.concat(*valid)).alias("_base"))
    for kind in PATTERNS:  # a projection for each, else the expression would grow by powers
        rows = rows.withColumn("_text", F.when(F.size("_base") > 0, _blanked(F.col("_text"), kind)).otherwise(F.col("_text")))
    rows = _with_matches(rows, "_text", [(f"_g{i}", sign, p) for i, (_, sign, p) in enumerate(GENERATORS)])
    candidates = ", ".join(_candidates(i, f"_g{i}", "_text") for i in range(len(GENERATORS)))
    rows = rows.select(*names, "_base", F.expr(f"concat({candidates})").alias("_found"))
    rows = rows.select(*names, "_base", F.sort_array(_judged("_found", trees, thresholds)).alias("_spans"))
    rows = rows.withColumn("_spans", F.expr(f"transform({_APART.format(a='_spans')}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"))
    # the place is no constant: a filter on the result is not pushed down, where it would repeat all of the above by powers
    rows = rows.withColumn("_spans", F.when((F.size("_spans") == 0) & (row_place() >= 0), F.col("_base")).otherwise(F.sort_array(F.concat("_base", "_spans"))))
    return rows.select(*names, "_base", "_spans")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    A null text is empty: no spans.  Rows are judged alone; repeated rows, null
    ids and other columns change nothing.  Kinds that the trees add beside the
    contract's four: key (credentials, what a sentence gives as a password, whole blocks of private
    keys) and number (account and identity numbers; one that its checksum or shape proves is no other kind).
    Added spans that overlap are one span, of the kind with the best score (the first
    on ties); they never overlap base spans.  A threshold's own score is accepted.  An
    empty table gives no rows.
    """
    check_columns(docs, id_col, text_col)
    rows = find_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    counts = [_count(F.col("_base"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans take the first one's.

    A text without spans, also null, stays as it is, and so do all other columns, whatever
    their names; repeated rows are redacted alike; an empty table stays empty.
    """
    # the other columns travel in one, so that none of their names matters
    others = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col))
    bare = docs.select(others.alias("_others"), F.col(text_col).alias("_whole"))
    rows = find_spans(bare, "_whole").withColumn("_text", F.col("_whole").cast("string"))
    apart = "transform(_spans, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k, 'p', 0))"
    rows = rows.withColumn("_runs", F.expr(apart)).withColumn("_runs", F.expr(_APART.format(a="_runs")))
    # runs of spans, each with its stretch of the text, so that no span is looked for from the text's start
    parts = f"transform(sequence(0, (size(_runs) - 1) div {BLOCK}), b -> named_struct('f', coalesce(get(_runs, CAST(b * {BLOCK} - 1 AS INT)).e, 0), 'x', slice(_runs, CAST(b * {BLOCK} + 1 AS INT), {BLOCK})))"
    cut = "transform(_parts, p -> named_struct('f', p.f, 'x', p.x, 't', substring(_text, p.f + 1, element_at(p.x, -1).e - p.f)))"
    rows = rows.withColumn("_parts", F.expr(f"CASE WHEN size(_runs) > 0 THEN {parts} END")).withColumn("_parts", F.expr(cut))
    tags = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    before = "coalesce(get(p.x, j - 1).e, p.f)"
    joined = f"array_join(transform(_parts, p -> array_join(transform(p.x, (x, j) -> concat(substring(p.t, {before} - p.f + 1, x.s - {before}), get({tags}, x.k))), '')), '')"
    clean = F.concat(F.expr(joined), F.expr("substring(_text, element_at(_runs, -1).e + 1, length(_text))"))
    clean = F.when(F.size("_runs") > 0, clean).otherwise(F.col("_whole"))
    return rows.select(*((clean if c == text_col else F.col("_others").getField(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)))

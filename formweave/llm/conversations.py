"""Repair of conversations: the cheapest edits to a legal order of roles, found on the arcs that lie on some optimal path.

Costs run forward from the start and backward from the end of a conversation.  An arc is tight
if the cost up to it, its own and the cost after it add up to the optimum; the tight arcs are
all the cheapest scripts.  A walk keeps the set of places that the letters chosen so far can
lead to and takes the least letter that leaves it on a tight arc.

Rows are dealt by ranges of (conversation, turn), so a long conversation lies in many parts.
Its costs pass from part to part as small tables of (min, +) products, and so do the sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache, lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, check_columns, cut

#: Roles so far: none, a system turn, the last by the user, the last by the assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
FAR = 1 << 40
#: Characters of a repaired text in one row; a longer one is several rows.
PIECE = 1 << 23

Costs = tuple[int, ...]
Kind = tuple[str, int]  # initial of the role, 1 if the text is cut short


def _turned(state: int) -> list[int]:
    """States that a user's or an assistant's turn leads to."""
    return [NEXT[state, i] for i in "ua" if (state, i) in NEXT]


@cache
def arcs(kind: Kind) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, from, to, cost) over a row that need not go, letters ascending."""
    initial, short = kind
    found = []
    for q in range(4):
        found.append(("D", q, q, DELETE))
        if (q, initial) in NEXT:
            found.append(("K", q, NEXT[q, initial], KEEP + short * TRUNCATED))
        found.extend(("R", q, r, REROLE + short * TRUNCATED) for r in _turned(q))
    return tuple(sorted(found))


#: (from, to) of the inserted turns, which stay before the same row.
INSERTS = tuple((q, r) for q in range(4) for r in _turned(q))


def settle(costs: Iterable[int]) -> Costs:
    """Costs of reaching each state, with inserts."""
    found = list(costs)
    for _ in range(2):
        for q, r in INSERTS:
            found[r] = min(found[r], found[q] + INSERT)
    return tuple(found)


def settle_back(costs: Iterable[int]) -> Costs:
    """Costs from each state to the end, with inserts."""
    found = list(costs)
    for _ in range(2):
        for q, r in INSERTS:
            found[q] = min(found[q], found[r] + INSERT)
    return tuple(found)


@lru_cache(1 << 14)
def onward(costs: Costs, kind: Kind) -> Costs:
    """Least costs after a row."""
    found = [FAR] * 4
    for _, q, r, cost in arcs(kind):
        found[r] = min(found[r], costs[q] + cost)
    return settle(found)


@lru_cache(1 << 14)
def backward(costs: Costs, kind: Kind) -> Costs:
    found = [FAR] * 4
    for _, q, r, cost in arcs(kind):
        found[q] = min(found[q], costs[r] + cost)
    return settle_back(found)


def _run(step: Callable[[Costs, Kind], Costs], costs: Costs, kinds: Iterable[Kind]) -> list[Costs]:
    """All tables of a run; a table is kept as its distance from its least cost, so that steps repeat."""
    base, found = 0, [costs]
    for kind in kinds:
        least = min(costs)
        base += least
        costs = step(tuple(min(c - least, FAR) for c in costs), kind)
        found.append(tuple(c + base for c in costs))
    return found


FIRST: Costs = settle([0, FAR, FAR, FAR])
LAST: Costs = settle_back([0 if q in ENDS else FAR for q in range(4)])


def products(kinds: list[Kind]) -> list[Costs]:
    """For each state before the rows the least costs of all states after them."""
    return [_run(onward, settle(0 if q == p else FAR for q in range(4)), kinds)[-1] for p in range(4)]


class Walk:
    """The tight arcs of a run of rows, between given costs before and after it."""

    def __init__(self, kinds: list[Kind], before: Costs, after: Costs, whole: int):
        self.kinds, self.whole = kinds, whole
        self.forward = _run(onward, before, kinds)
        self.back = _run(backward, after, reversed(kinds))[::-1]

    def open_sets(self) -> list[frozenset[int]]:
        """All sets of states that a walk may be in before the first row."""
        tight = [q for q in range(4) if self.forward[0][q] + self.back[0][q] == self.whole]
        return [frozenset(q for k, q in enumerate(tight) if m >> k & 1) for m in range(1, 1 << len(tight))]

    def _inserted(self, i: int, at: frozenset[int]) -> frozenset[int]:
        return frozenset(r for q, r in INSERTS if q in at and self.forward[i][q] + INSERT + self.back[i][r] == self.whole)

    def letters(self, at: frozenset[int], last: bool) -> tuple[list[str], frozenset[int]]:
        """For each row the inserts before it and its own letter, and the set after the last row.

        With ``last`` the run ends its conversation, and one more entry has the inserts at its end.
        """
        found = []
        for i, kind in enumerate(self.kinds):
            word = ""
            while True:
                ways: dict[str, set[int]] = {}
                for letter, q, r, cost in arcs(kind):
                    if q in at and self.forward[i][q] + cost + self.back[i + 1][r] == self.whole:
                        ways.setdefault(letter, set()).add(r)
                if inserted := self._inserted(i, at):
                    ways["I"] = set(inserted)
                letter = min(ways)
                word, at = word + letter, frozenset(ways[letter])
                if letter != "I":
                    break
            found.append(word)
        if last:
            word = ""
            while not any(q in at and self.forward[-1][q] == self.whole for q in ENDS):
                word, at = word + "I", self._inserted(len(self.kinds), at)
            found.append(word)
        return found, at


def damaged_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times): rows as a faulty export leaves them, by crc32 of ``conv:turn`` modulo 20.

    0 drops a row (times 0), 1 empties its text, 2 removes its end marks, 3 repeats it (times 2),
    4 gives it to the user.  Null roles, texts and parts of the key read as one space.
    """
    check_columns(conversations, conv_col, turn_col, role_col, text_col)
    space = F.lit(" ")
    conv, turn = F.col(conv_col), F.col(turn_col).cast("long")
    fate = F.crc32(F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))) % 20
    text, role = F.coalesce(F.col(text_col).cast("string"), space), F.coalesce(F.col(role_col).cast("string"), space)
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fate == 4, "user").otherwise(role)
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), times.cast("long").alias("times"))


def _judged(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``n``, in order of conversation and turn, dealt by ranges: blank, first of its text, cut short."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("n"))
    bare = F.btrim("text", F.lit(SPACES))
    rows = rows.withColumns({"blank": bare == "", "short": ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "said": F.unhex(F.md5("text"))})
    spoken = rows.where("n > 0 AND NOT blank").groupBy("conv", "role", "said").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("free"))
    least = F.when(~F.col("free"), F.col("least"))
    key = F.struct("conv", "turn", "role", "said")  # parts of a struct may be null and equal
    spoken = spoken.select(F.struct("conv", least.alias("turn"), "role", "said").alias("key"), F.lit(True).alias("first"))
    rows = rows.withColumn("key", key).join(spoken, "key", "left").drop("key").withColumn("first", F.coalesce("first", F.lit(False)))
    order = ["conv", "turn", "role", F.substring("text", 1, 64), "said"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(rows.select("conv", "turn", "role", "text", "n", "blank", "first", "short"))


def _kind(role: str, short: bool) -> Kind:
    return (role[:1] if role[:1] in ("s", "u", "a") else "", int(short))


def _segments(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[object, list[tuple]]]:
    """The rows of each conversation of a part, one conversation at a time."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv", *columns)), strict=True))
    for conv, group in groupby(rows, lambda r: r[0]):
        yield conv, list(group)


def _live(rows: list[tuple]) -> list[Kind]:
    """Kinds of the rows (conv, role, n, blank, first, short) that need not go."""
    return [_kind(role, short) for _, role, n, blank, first, short in rows if n and first and not blank]


_STRUCTURE = ("role", "n", "blank", "first", "short")


def _edges(judged: DataFrame, kind: str) -> list[tuple[int, list[tuple[object, list[Costs]]]]]:
    """For each part the products of its first and its last conversation: no more rows than two a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None
        for conv, rows in _segments(batches, *_STRUCTURE):
            last = (conv, rows)
            first = first or last
        ends = [first] if first is last else [first, last]
        for place, end in enumerate(e for e in ends if e):
            costs = [c for table in products(_live(end[1])) for c in table]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([end[0]], conv_type), pa.array([costs], pa.list_(pa.int64()))], names=["part", "place", "conv", "costs"])

    conv_type = _arrow_type(judged)
    found = judged.select("conv", *_STRUCTURE).mapInArrow(run, f"part int, place int, conv {kind}, costs array<long>").collect()
    parts: dict[int, list[tuple[object, list[Costs]]]] = {}
    for r in sorted(found, key=lambda r: (r["part"], r["place"])):
        costs = r["costs"]
        parts.setdefault(r["part"], []).append((r["conv"], [tuple(costs[4 * q : 4 * q + 4]) for q in range(4)]))
    return sorted(parts.items())


def _arrow_type(frame: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema["conv"].dataType)


def _chains(edges: list[tuple[int, list[tuple[object, list[Costs]]]]]) -> list[list[tuple[int, object, list[Costs]]]]:
    """The conversations that lie in several parts: (part, conversation, products) in order."""
    chains: list[list[tuple[int, object, list[Costs]]]] = []
    running: list[tuple[int, object, list[Costs]]] = []
    for part, ends in edges:
        head, tail = ends[0], ends[-1]
        if running and running[-1][1] == head[0]:
            running.append((part, *head))
        else:
            running = [(part, *head)]
        if len(running) == 2:
            chains.append(running)
        if len(ends) > 1:
            running = [(part, *tail)]
    return chains


#: What a part must know of a conversation that it shares: costs before and after, the optimum, whether it starts or ends there.
Bounds = dict[tuple[int, object], tuple[Costs, Costs, int, bool]]


def _bounds(chains: list[list[tuple[int, object, list[Costs]]]]) -> Bounds:
    found: Bounds = {}
    for chain in chains:
        before, after = [FIRST], [LAST]
        for _, _, table in chain[:-1]:
            before.append(tuple(min(before[-1][q] + table[q][r] for q in range(4)) for r in range(4)))
        for _, _, table in reversed(chain):
            after.append(tuple(min(table[q][r] + after[-1][r] for r in range(4)) for q in range(4)))
        whole = after[-1][START]
        for k, (part, conv, _) in enumerate(chain):
            found[part, conv] = (before[k], after[len(chain) - 1 - k], whole, k == len(chain) - 1)
    return found


def _spoken(letters: list[str], kinds: list[Kind]) -> int:
    """Turns after a kept system turn."""
    turns = sum(c != "D" for word in letters for c in word)
    return turns - sum(word[-1:] == "K" and kind[0] == "s" for word, kind in zip(letters, kinds, strict=False))


def _entries(judged: DataFrame, chains: list, bounds: Bounds) -> dict[tuple[int, object], tuple[frozenset[int], int]]:
    """For each shared part the set that the walk enters it with and the turns before it, modulo 2.

    Each part tells for each set that may come where it leads: 15 rows a part at most.
    """
    if not chains:
        return {}
    shared = judged.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if not any(p == part for p, _ in shared.value):
            return
        for conv, rows in _segments(batches, *_STRUCTURE):
            if (part, conv) in shared.value:
                before, after, whole, last = shared.value[part, conv]
                walk = Walk(_live(rows), before, after, whole)
                maps = []
                for at in walk.open_sets():
                    letters, out = walk.letters(at, last)
                    maps.append([sum(1 << q for q in at), sum(1 << q for q in out), _spoken(letters, walk.kinds) % 2])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(maps), pa.int32()), pa.array([conv] * len(maps), conv_type), pa.array(maps, pa.list_(pa.int64()))], names=["part", "conv", "leads"])

    conv_type = _arrow_type(judged)
    found = judged.select("conv", *_STRUCTURE).mapInArrow(run, f"part int, conv {judged.schema['conv'].dataType.simpleString()}, leads array<long>").collect()
    leads = {(r["part"], r["conv"], r["leads"][0]): r["leads"][1:] for r in found}
    entries: dict[tuple[int, object], tuple[frozenset[int], int]] = {}
    for chain in chains:
        mask, odd = 1 << START, 0
        for part, conv, _ in chain:
            entries[part, conv] = (frozenset(q for q in range(4) if mask >> q & 1), odd)
            mask, spoken = leads[part, conv, mask]
            odd = (odd + spoken) % 2
    return entries


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
_EDGES = ("first_turn", "last_turn", "first_role", "last_role")


def _repaired(conv: object, rows: list[tuple], bound: tuple | None, entry: tuple | None) -> Iterator[dict]:
    """The pieces of a conversation, or of a part of one: counts, letters and the repaired text."""
    kinds = _live([(c, role, n, blank, first, short) for c, _, role, _, n, blank, first, short in rows])
    if bound is None:
        after = _run(backward, LAST, reversed(kinds))[-1]
        before, after, whole, last, at, odd = FIRST, LAST, after[START], True, frozenset([START]), 0
    else:
        (before, after, whole, last), (at, odd) = bound, entry
    letters = iter(Walk(kinds, before, after, whole).letters(at, last)[0])
    fresh = {"conv": conv, "chunk": 0, "alone": bound is None} | dict.fromkeys(_COUNTS, 0) | dict.fromkeys(_EDGES)
    piece, audit, lines, size, previous = dict(fresh), [], [], 0, None
    spoken = odd

    def turn(role: str | None, text: str) -> None:
        nonlocal spoken, size
        if role is None:
            role = ("user", "assistant")[spoken % 2]
        spoken += 1
        lines.append(f"{role}:{text}")
        size += len(role) + len(text) + 2

    for _, at_turn, role, text, n, blank, first, short in rows:
        if not n:
            continue
        if size > PIECE:
            yield piece | {"audit": "".join(audit), "repaired": "\n".join(lines), "alone": False}
            piece, audit, lines, size = fresh | {"chunk": piece["chunk"] + 1, "alone": False}, [], [], 0
            previous = None
        initial = role[:1]
        piece["illegal"] += n - 1 + (previous is not None and previous + initial not in LEGAL)
        piece["first_role"] = initial if piece["first_role"] is None else piece["first_role"]
        piece["last_role"] = previous = initial
        if at_turn is not None and at_turn != piece["last_turn"]:
            piece["turns"] += 1
            piece["first_turn"] = at_turn if piece["first_turn"] is None else piece["first_turn"]
            piece["last_turn"] = at_turn
        gone = n
        if blank:
            piece["blank"] += n
        else:
            gone = n - first
            piece["duplicate"] += gone
            if first:
                piece["truncated"] += short
                for letter in (word := next(letters)):
                    if letter == "I":
                        turn(None, "")
                    elif letter == "R":
                        turn(None, text)
                    elif letter == "K":
                        turn(role, text)
                        spoken -= initial == "s"
                audit.append(word)
                piece["cost"] += word.count("I") * INSERT + {"D": DELETE, "K": KEEP + TRUNCATED * short, "R": REROLE + TRUNCATED * short}[word[-1]]
        piece["cost"] += gone * DELETE
        audit.append("D" * gone)
    if last:
        for _ in (word := next(letters)):
            turn(None, "")
        audit.append(word)
        piece["cost"] += len(word) * INSERT
    yield piece | {"audit": "".join(audit), "repaired": "\n".join(lines)}


def repaired_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times_col: str | None = None
) -> DataFrame:
    """Pieces (conv_col, part, chunk, alone, blank, duplicate, truncated, illegal, cost, turns, first and last turn and role, audit, repaired).

    A conversation is one piece, ``alone``, unless it lies in several parts or its repaired text
    (``role:text`` lines) passes PIECE characters; then its pieces follow each other by (part, chunk).

    Turns count as longs; null turns come first, rows of one turn by role, then text.  A null role or
    text is one space.  ``times_col`` says how often a row stands (adjacent); rows that stand 0
    times only keep their conversation in the result.  A null conversation is one like others; an
    empty table gives no rows.  Blank rows and rows whose role and text came before must go.  Of
    scripts of one cost the one with the least letters is taken.  Other columns are ignored.

    Equal rows are counted before they are dealt, rows are dealt by ranges of (conversation, turn, role,
    text), and a task holds no more than its part of one conversation; the driver gets two rows a part.
    """
    check_columns(rows, conv_col, turn_col, role_col, text_col, *([times_col] if times_col else []))
    space = F.lit(" ")
    plain = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"), (F.col(times_col).cast("long") if times_col else F.lit(1).cast("long")).alias("times"),
    )
    judged = _judged(plain)
    kind = judged.schema["conv"].dataType.simpleString()
    chains = _chains(_edges(judged, kind))
    bounds = _bounds(chains)
    entries = _entries(judged, chains, bounds)
    shared = judged.sparkSession.sparkContext.broadcast((bounds, entries))
    conv_type = _arrow_type(judged)
    whole = [pa.field("conv", conv_type), pa.field("part", pa.int32()), pa.field("chunk", pa.int32()), pa.field("alone", pa.bool_())]
    whole += [pa.field(c, pa.int64()) for c in (*_COUNTS, "first_turn", "last_turn")]
    whole += [pa.field(c, pa.string()) for c in ("first_role", "last_role", "audit", "repaired")]
    schema = pa.schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bounds, entries = shared.value
        held: list[dict] = []
        size = 0
        for conv, own in _segments(batches, "turn", "role", "text", "n", "blank", "first", "short"):
            key = (part, conv)
            for piece in _repaired(conv, own, bounds.get(key), entries.get(key)):
                held.append(piece | {"part": part})
                size += len(piece["repaired"])
                if size > PIECE or len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    texts = "first_role string, last_role string, audit string, repaired string"
    numbers = ", ".join(f"{c} long" for c in (*_COUNTS, "first_turn", "last_turn"))
    return judged.mapInArrow(run, f"conv {kind}, part int, chunk int, alone boolean, {numbers}, {texts}").withColumnRenamed("conv", conv_col)


def conversation_report(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of repaired_conversations.

    gaps are turn numbers between the first and the last that no row has.  The texts of
    conversations of one piece are hashed where they are; only pieces of the others are
    sent, in order, to the task that reads their hash, which holds one of them at a time.
    """
    hashed = pieces.withColumn("hash", F.when(F.col("alone"), F.sha2("repaired", 256))).withColumn("repaired", F.when(~F.col("alone"), F.col("repaired")))
    kind = pieces.schema[conv_col].dataType.simpleString()
    dealt = hashed.withColumnRenamed(conv_col, "conv").repartition("conv").sortWithinPartitions("conv", "part", "chunk")
    conv_type = _arrow_type(dealt)
    out = pa.schema([pa.field("conv", conv_type), *(pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])

    def told(conv: object, group: Iterator[dict]) -> dict:
        sums, audit, digest, lines = dict.fromkeys(_COUNTS, 0), [], hashlib.sha256(), False
        least = most = role = None
        ready = None
        for r in group:
            for c in _COUNTS:
                sums[c] += r[c]
            audit.append(r["audit"])
            sums["illegal"] += role is not None and r["first_role"] is not None and role + r["first_role"] not in LEGAL
            role = r["last_role"] if r["last_role"] is not None else role
            if r["first_turn"] is not None:
                sums["turns"] -= r["first_turn"] == most
                least, most = r["first_turn"] if least is None else least, r["last_turn"]
            ready = r["hash"]
            if r["repaired"]:
                digest.update(b"\n" * lines + r["repaired"].encode())
                lines = True
        gaps = most - least + 1 - sums["turns"] if most is not None else 0
        return {"conv": conv, "gaps": gaps, "audit": "".join(audit), "repaired_sha256": ready or digest.hexdigest()} | {c: sums[c] for c in _COUNTS if c != "turns"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        rows = (row for batch in batches for part in range(0, batch.num_rows, 256) for row in batch.slice(part, 256).to_pylist())
        for conv, group in groupby(rows, lambda r: r["conv"]):
            held.append(told(conv, group))
            if len(held) >= 4096:
                yield pa.RecordBatch.from_pylist(held, out)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, out)

    numbers = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return dealt.mapInArrow(run, f"conv {kind}, {numbers}, audit string, repaired_sha256 string").withColumnRenamed("conv", conv_col)


#: The same in DuckDB: a forward search over states that carries the letters and texts themselves.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) % 20 AS fate FROM (SELECT DISTINCT k FROM base), tab),
hit AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM base JOIN crc USING (k)),
one AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark, left(role, 1) AS r0,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hit),
two AS (SELECT *, CASE WHEN mark = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN mark NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(r0) OVER (PARTITION BY conv_id ORDER BY i) AS r1 FROM one),
ids AS (SELECT DISTINCT conv_id FROM base),
sums AS (SELECT ids.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (r1 IS NOT NULL AND r1 || r0 NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN two ON ids.conv_id IS NOT DISTINCT FROM two.conv_id GROUP BY ids.conv_id),
arc(q, i, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
one_insert AS (SELECT q, r, 2 AS c, 'I' AS l, CASE i WHEN 'u' THEN 'user:' ELSE 'assistant:' END AS t FROM arc WHERE i <> 's'),
ins AS MATERIALIZED (SELECT q, q AS r, 0 AS c, '' AS l, NULL AS t FROM range(4) s(q) UNION ALL SELECT * FROM one_insert
  UNION ALL SELECT a.q, b.r, 4, 'II', a.t || chr(10) || b.t FROM one_insert a JOIN one_insert b ON a.r = b.q),
step AS MATERIALIZED (
  SELECT conv_id, i, q, q AS r, 3 AS c, 'D' AS l, NULL AS t FROM two, range(4) s(q)
  UNION ALL SELECT conv_id, two.i, q, r, (fault = 't')::INT, 'K', role || ':' || text FROM two JOIN arc ON r0 = arc.i WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, two.i, q, r, 2 + (fault = 't')::INT, 'R', CASE arc.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
    FROM two JOIN arc ON arc.i <> 's' WHERE fault NOT IN ('b', 'd')),
way AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'c': 0, 'l': '', 't': NULL::VARCHAR} AS s FROM ids
  UNION ALL SELECT conv_id, i, q, min(s) FROM (
    SELECT w.conv_id, w.i + 1 AS i, step.r AS q, {'c': w.s.c + ins.c + step.c, 'l': w.s.l || ins.l || step.l, 't': nullif(concat_ws(chr(10), w.s.t, ins.t, step.t), '')} AS s
    FROM way w JOIN ins ON w.q = ins.q JOIN step ON step.conv_id IS NOT DISTINCT FROM w.conv_id AND step.i = w.i + 1 AND step.q = ins.r) GROUP BY ALL),
best AS (SELECT w.conv_id, min({'c': s.c + ins.c, 'l': s.l || ins.l, 't': nullif(concat_ws(chr(10), s.t, ins.t), '')}) AS s
  FROM way w JOIN sums ON w.conv_id IS NOT DISTINCT FROM sums.conv_id AND w.i = sums.n JOIN ins ON w.q = ins.q WHERE ins.r IN (0, 3) GROUP BY w.conv_id)
SELECT sums.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, s.c::BIGINT AS cost, s.l AS audit, sha256(coalesce(s.t, '')) AS repaired_sha256
FROM sums JOIN best ON sums.conv_id IS NOT DISTINCT FROM best.conv_id
"""

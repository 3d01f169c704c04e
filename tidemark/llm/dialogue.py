"""Repair of conversations: the cheapest edits that make turns alternate, by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a piece; a longer conversation is searched piece by piece, from every state to every state.
PIECE = 16
#: Pieces whose answers a worker remembers.
REMEMBERED = 1 << 16
NEVER = 1 << 60

# States of the wanted order (s?(ua)+)?: nothing yet, after the system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or renamed row leads to.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state that a kept row leads to, by its initial.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DELETE, INSERT, RENAME, TRUNCATED = 4, 3, 3, 3
#: A row's code: FORCED if it has to go, else its initial's place here, plus 4 if it is truncated.
INITIALS = "sua?"
FORCED = 8


def _moves(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """Edits before or on a row in ASCII order: letter, cost, rows used up, next state."""
    found = [("D", DELETE, 1, state), ("I", INSERT, 0, NEXT[state])]
    if code != FORCED:
        extra = TRUNCATED if code >= 4 else 0
        kept = KEPT.get(INITIALS[code & 3], {}).get(state)
        if kept is not None:
            found.append(("K", extra, 1, kept))
        found.append(("R", RENAME + extra, 1, NEXT[state]))
    return found


_MOVES = [[_moves(code, state) for state in range(4)] for code in range(FORCED + 1)]


def _least(code: int, first: bool) -> int:
    """What a row costs at least; a system row is free only while nothing stands before it."""
    if code == FORCED:
        return DELETE
    extra = TRUNCATED if code >= 4 else 0
    fits = INITIALS[code & 3] in ("u", "a") or INITIALS[code & 3] == "s" and first
    return min(DELETE, extra if fits else RENAME + extra)


def _first_bounds(codes: bytes, goal: int | None) -> list[list[int]]:
    """By state and place, a lower bound of the cost from there to the goal (None: the end of a conversation)."""
    n = len(codes)
    bounds = [[0] * (n + 1) for _ in range(4)]
    for state in range(4):
        at = bounds[state]
        at[n] = (0, 2 * INSERT, INSERT, 0)[state] if goal is None else 0 if state == goal else NEVER
        ways_out = goal is None or goal in (USER, ASSISTANT) or state == goal
        rest = 0
        for i in range(n - 1, -1, -1):
            rest += _least(codes[i], state == NOTHING)
            reach = ways_out or goal == SYSTEM and state == NOTHING and any(c & 3 == 0 and c != FORCED for c in codes[i:])
            at[i] = rest if reach else NEVER
    return bounds


@lru_cache(REMEMBERED)
def search(codes: bytes, start: int = NOTHING, goal: int | None = None) -> tuple[int, str] | None:
    """Least cost and the ASCII-least edits of that cost from ``start`` through all rows to ``goal``, None if there is no way.

    Without ``goal`` the conversation ends here and may be given rows at its end; with one the last edit uses up
    the last row. Iterative-deepening A*: a depth-first search takes edits in ASCII order and turns back where the cost
    so far and the bound of the state exceed the limit. A state that failed is kept in ``bounds`` with the
    least cost that is still possible from it, so it fails at once at the same or a smaller remainder; the next limit is the
    first state's. The first path that arrives is the answer: no cheaper one passed a smaller limit, and none of its
    cost stands before it.
    """
    n, bounds = len(codes), _first_bounds(codes, goal)
    ends = [("I", INSERT, 0, NEXT[s]) for s in range(4)]
    limit = bounds[start][0]
    while limit < NEVER:
        path: list[str] = []
        stack = [(0, start, 0, 0)]
        while stack:
            i, state, cost, k = stack.pop()
            if k == 0 and i == n and (state == goal if goal is not None else state in (NOTHING, ASSISTANT)):
                return cost, "".join(path)
            moves = _MOVES[codes[i]][state] if i < n else [ends[state]] if goal is None else []
            for m in range(k, len(moves)):
                letter, extra, used, to = moves[m]
                if cost + extra + bounds[to][i + used] <= limit:
                    stack += [(i, state, cost, m + 1), (i + used, to, cost + extra, 0)]
                    path.append(letter)
                    break
            else:
                bounds[state][i] = max(bounds[state][i], min((extra + bounds[to][i + used] for _, extra, used, to in moves), default=NEVER))
                if path:
                    path.pop()
        limit = bounds[start][0]
    return None


def cheapest_edits(codes: bytes, piece: int = PIECE) -> tuple[int, str]:
    """Least cost and the ASCII-least edits of that cost of a whole conversation.

    A conversation of more than ``piece`` rows is cut. Each piece is searched from every state to every state; least costs to the
    end are added up from the back, and the least edits chosen from the front. Edits of a piece end with the
    edit of its last row, so none is the beginning of another and comparing them piece by piece compares the wholes.
    """
    cuts = [codes[k : k + piece] for k in range(0, len(codes), piece)] or [b""]
    to_end: list[list[int]] = [[(search(cuts[-1], s) or (NEVER,))[0] for s in range(4)] if len(cuts) > 1 else [0] * 4]
    for cut in reversed(cuts[:-1]):
        ahead = to_end[-1]
        found = [[search(cut, s, g) for g in range(4)] for s in range(4)]
        to_end.append([min(f[0] + ahead[g] if f else NEVER for g, f in enumerate(row)) for row in found])
    to_end.reverse()
    state, total, parts = NOTHING, 0, []
    for k, cut in enumerate(cuts[:-1]):
        ways = ((f, g) for g in range(4) if (f := search(cut, state, g)))
        least = [(f[1], g, f[0]) for f, g in ways if f[0] + to_end[k + 1][g] == to_end[k][state]]
        edits, state, cost = min(least)
        parts.append(edits)
        total += cost
    cost, edits = search(cuts[-1], state)
    return total + cost, "".join([*parts, edits])


# --- Spark side ---------------------------------------------------------------------------------


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, dropped``: rows with known faults, by the CRC-32 of ``conv:turn`` modulo 20.

    0 drops a row (flagged, so that a conversation without rows is still known), 1 empties its text, 2 takes its
    full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. A null counts as one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col)).cast("binary")) % 20
    named = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return named.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _streamed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, dropped_col: str | None) -> DataFrame:
    """A conversation's rows twice, in order: first their faults and codes (``text`` null), then roles and texts."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dropped = F.coalesce(F.col(dropped_col), F.lit(False)) if dropped_col else F.lit(False)
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), dropped.alias("dropped"))
    own = own.withColumn("digest", F.xxhash64("role", "text")).repartition("conv")
    same = Window.partitionBy("conv", "digest", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = F.when(end == "", "b").when(F.row_number().over(same) > 1, "d").when(~end.isin(".", "!", "?"), "t").otherwise("-")
    own = own.withColumn("fault", fault).drop("digest")
    both = own.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("phase")).where("phase = 0 or not dropped")
    text = F.when(F.col("phase") == 1, F.col("text"))
    order = ["conv", "phase", F.col("turn").asc_nulls_first(), "role", "content", F.col("fault") == "d"]  # of equal rows the first is no repetition
    return both.withColumn("content", F.col("text")).sortWithinPartitions(*order).select("conv", "phase", "turn", "role", text.alias("text"), "dropped", "fault")


class _Conversation:
    """What is known of a conversation while its rows go by: one byte a row at most, and a running digest."""

    def __init__(self) -> None:
        self.codes, self.last, self.low, self.high, self.turns = bytearray(), None, None, None, 0
        self.faults, self.illegal = {"b": 0, "d": 0, "t": 0, "-": 0}, 0
        self.cost, self.audit, self.at, self.state, self.lines, self.digest = 0, None, 0, NOTHING, 0, hashlib.sha256()

    def counted(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.faults[fault] += 1
        place = "sua".find(initial) if initial else -1
        self.codes.append(FORCED if fault in "bd" else (place if place >= 0 else 3) + (4 if fault == "t" else 0))

    def solved(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest_edits(bytes(self.codes))

    def _said(self, role: str, text: str) -> tuple[int, str, str]:
        self.digest.update((("\n" if self.lines else "") + role + ":" + text).encode("utf-8", "replace"))
        self.lines += 1
        return self.lines - 1, role, text

    def _inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.at += 1
            yield self._said("user" if self.state == USER else "assistant", "")

    def repaired(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        """The repaired rows up to and with this one."""
        self.solved()
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[:1]][self.state]
            yield self._said(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            yield self._said("user" if self.state == USER else "assistant", text)

    def ended(self) -> Iterator[tuple[int, str, str]]:
        self.solved()
        yield from self._inserted()

    def summary(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        f = self.faults
        return gaps, f["b"], f["d"], f["t"], self.illegal, self.cost, self.audit, self.digest.hexdigest()


def _walk(batches: Iterator[pa.RecordBatch], kind: pa.DataType, messages: bool) -> Iterator[pa.RecordBatch]:
    """One row a conversation, or with ``messages`` one row a repaired row."""
    names = ["place", "role", "text"] if messages else ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.int64(), pa.string(), pa.string()] if messages else [pa.int64()] * 6 + [pa.string(), pa.string()]
    out: list[tuple] = []
    held, now, talk = 0, None, None

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * (len(names) + 1)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [kind, *types])], names=["conv", *names])

    def close() -> None:
        rows = [(now, *said) for said in talk.ended()]
        out.extend(rows if messages else [(now, *talk.summary())])

    for part in batches:
        for conv, phase, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in part.columns)):
            if talk is None or conv != now:
                if talk is not None:
                    close()
                now, talk = conv, _Conversation()
            if phase:
                for said in talk.repaired(role, text):
                    if messages:
                        out.append((conv, *said))
                        held += len(said[2])
            elif not dropped:
                talk.counted(turn, role, fault)
            if len(out) >= 4096 or held > 1 << 22:
                yield batch()
                out, held = [], 0
    if talk is not None:
        close()
        yield batch()


def _run(rows: DataFrame, names: tuple[str, str, str, str], dropped_col: str | None, messages: bool) -> DataFrame:
    conv_col = names[0]
    work = _streamed(rows, *names, dropped_col)
    kind = rows.schema[conv_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    outs = "place long, role string, text string" if messages else "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return work.mapInArrow(lambda batches: _walk(batches, arrow, messages), f"conv {kind.simpleString()}, {outs}").withColumnRenamed("conv", conv_col)


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None
) -> DataFrame:
    """One row per conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, null turns first, equal turns by role and text. ``audit`` has a letter for each edit: Keep, Rerole
    to user or assistant (3), Delete (4, needed for a blank or repeated row), Insert an empty row (3); a truncated row that
    stays adds 3. The edits are the cheapest that leave roles in the order ``(s?(ua)+)?`` by their initials, the ASCII-least of
    those. A null role or text counts as one space; a null conversation id is a conversation of its own; rows
    flagged in ``dropped_col`` are not there, but their conversation is. An empty table gives an empty result;
    further columns are not read.

    One shuffle by conversation. A digest of the repaired text needs its rows in order in one task: they stream
    through it, faults first and texts after, and only one byte a row is held.
    """
    return _run(rows, (conv_col, turn_col, role_col, text_col), dropped_col, False)


def repaired_rows(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped_col: str | None = None
) -> DataFrame:
    """The repaired conversations as rows ``conv_id, place, role, text``, ``place`` counting from 0; edits as in ``repair``."""
    return _run(rows, (conv_col, turn_col, role_col, text_col), dropped_col, True)


def _cut(text: Column | str) -> str:
    return f"rtrim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def oracle() -> str:
    """The damage and its repair in DuckDB: a step per row from the states to the least cost and edits of each next state."""
    moves = [(q, "I" * k, INSERT * k) for q in range(4) for k in range(3)]

    def to(q: int, k: int) -> int:
        for _ in range(k):
            q = NEXT[q]
        return q

    gaps = ", ".join(f"({q}, '{t}', {c}, {to(q, len(t))})" for q, t, c in moves)
    keeps = ", ".join(f"('{i}', {q}, {r})" for i, by in KEPT.items() for q, r in by.items())
    nexts = ", ".join(f"({q}, {r})" for q, r in enumerate(NEXT))
    step = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b))"
    return f"""WITH RECURSIVE gap(q, letters, price, q1) AS (VALUES {gaps}), keep(initial, q1, q2) AS (VALUES {keeps}), nxt(q1, q2) AS (VALUES {nexts}),
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, b: {step}, 4294967295), 4294967295) % 20 AS kind FROM conversations),
    damaged AS (SELECT conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM keyed, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i, right({_cut('text')}, 1) AS ending,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, left(role, 1) AS initial FROM damaged),
    faulty AS MATERIALIZED (SELECT *, ending = '' AS blank, ending <> '' AND again AS duplicate, ending <> '' AND NOT again AND ending NOT IN ('.', '!', '?') AS truncated,
      lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM ordered),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
      count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
    options AS MATERIALIZED (SELECT conv_id, i, q1, q1 AS q2, 'D' AS letter, {DELETE} AS price FROM faulty, nxt
      UNION ALL SELECT conv_id, i, q1, q2, 'K', CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END FROM faulty JOIN keep USING (initial) WHERE NOT blank AND NOT duplicate
      UNION ALL SELECT conv_id, i, q1, q2, 'R', {RENAME} + CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END FROM faulty, nxt WHERE NOT blank AND NOT duplicate),
    walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS price, '' AS audit FROM counts
      UNION ALL SELECT conv_id, i + 1, q2, least_way.price, least_way.audit FROM (SELECT w.conv_id, w.i, o.q2, min(struct_pack(price := CAST(w.price + g.price + o.price AS BIGINT), audit := w.audit || g.letters || o.letter)) AS least_way
        FROM walk w JOIN gap g ON g.q = w.q JOIN options o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i AND o.q1 = g.q1 GROUP BY ALL)),
    ends AS (SELECT w.conv_id, min(struct_pack(price := CAST(w.price + g.price AS BIGINT), audit := w.audit || g.letters)) AS best
      FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN gap g ON g.q = w.q WHERE g.q1 IN (0, 3) GROUP BY 1),
    letters AS (SELECT conv_id, best.audit AS audit, unnest(generate_series(1, length(best.audit))) AS p FROM ends),
    parsed AS (SELECT conv_id, p, audit[p] AS letter, length(replace(left(audit, p - 1), 'I', '')) AS i FROM letters),
    placed AS (SELECT p.conv_id, p.p, p.letter, f.role, f.text, count(*) FILTER (p.letter <> 'D' AND NOT (p.letter = 'K' AND f.initial = 's')) OVER (PARTITION BY p.conv_id ORDER BY p.p) AS k
      FROM parsed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.letter <> 'I'),
    said AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS repaired FROM placed WHERE letter <> 'D' GROUP BY conv_id)
    SELECT k.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
      coalesce(e.best.price, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(s.repaired, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
    LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM k.conv_id"""

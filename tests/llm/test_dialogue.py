"""Conversation repair against a plain search, its SQL, and edge rows."""

import hashlib
import heapq
import random
import zlib

import pytest

import __spark_entry__ as entry
from tests.helpers import duck, same_rows
from tidemark.llm import dialogue

STEP = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}
GIVEN = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_edits(rows):
    """Least (cost, edits) of rows ``(initial, forced, truncated)`` by a search over all paths in order of cost and letters."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, edits, i, before = heapq.heappop(heap)
        if i == len(rows) and before in ("", "a"):
            return cost, edits
        if (i, before) in seen:
            continue
        seen.add((i, before))
        heapq.heappush(heap, (cost + 3, edits + "I", i, GIVEN[before]))
        if i < len(rows):
            initial, forced, truncated = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, before))
            if not forced:
                extra = 3 if truncated else 0
                heapq.heappush(heap, (cost + 3 + extra, edits + "R", i + 1, GIVEN[before]))
                if (initial, before) in STEP:
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, STEP[initial, before]))


def plain_repair(rows):
    """Summary of rows ``(turn, role, text)`` in order."""
    spaces = " \t\n\x0b\x0c\r"
    seen, faults, state = set(), [], []
    for turn, role, text in rows:
        fault = "blank" if not text.strip(spaces) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(spaces)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        state.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, edits = plain_edits(state)
    said, before, i = [], "", 0
    for e in edits:
        if e == "K":
            before = STEP[rows[i][1][:1], before]
            said.append((rows[i][1], rows[i][2]))
        elif e in "IR":
            before = GIVEN[before]
            said.append(({"u": "user", "a": "assistant"}[before], "" if e == "I" else rows[i][2]))
        i += e != "I"
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, digest, said


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_search_equals_the_plain_one():
    rng = random.Random(1)
    for _ in range(3000):
        codes = bytes(rng.choice([0, 1, 2, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(14)))
        rows = [("sua?"[c & 3], c == 8, 4 <= c < 8) for c in codes]
        assert dialogue.cheapest_edits(codes, rng.choice([1, 2, 3, 16])) == plain_edits(rows)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_made_conversations_equal_the_plain_version(spark):
    rng = random.Random(2)
    made = []
    for conv in range(150):
        rows = []
        for k in range(rng.choice([1, 3, 8, 60])):
            turn = None if rng.random() < 0.05 else k if rng.random() < 0.9 else rng.randrange(k + 1)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Üser"])
            rows.append((turn, role, rng.choice(["", " \t\r\n", "\x0b\x0c", "Yes.", "No! ", "well", "What? \n", "a.\xa0", f"t{rng.randrange(99)}."])))
        made += [(conv, *r) for r in rows]
    rng.shuffle(made)
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.repair(table(spark, made)).collect()}
    said = {}
    for r in sorted(dialogue.repaired_rows(table(spark, made)).collect()):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert r["place"] == len(said[r["conv_id"]]) - 1
    for conv in range(150):
        want = plain_repair(ordered([r[1:] for r in made if r[0] == conv]))
        assert got[conv] == want[:-1] and said.get(conv, []) == want[-1]


def test_edge_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", "a" * 300_000 + "."), (1, None, "assistant", "b."), (2, 5, "user", "x."), (2, 5, "user", "x."), (3, 1, "user", None), (4, 9, "system", "s.")]
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.repair(table(spark, rows)).collect()}
    named = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in (None, 1, 2, 3, 4):
        assert got[conv] == plain_repair(ordered([r[1:] for r in named if r[0] == conv]))[:-1]
    assert got[None][1:7] == (1, 0, 0, 0, 4, "D") and got[4][5:7] == (4, "D") and got[2][6] == "KDI"
    assert dialogue.repair(table(spark, []), dropped_col=None).count() == 0


def test_other_columns_and_ids_do_not_matter(spark):
    rows = [("x", 0, "user", "Hi.", "a", 1, 2), ("x", 1, "assistant", "Ho.", "b", 1, 2)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, fault string, phase int, conv int")
    (row,) = dialogue.repair(df).collect()
    assert row["conv_id"] == "x" and row["audit"] == "KK" and len(row) == 9


def test_a_conversation_whose_rows_are_all_dropped(spark):
    ids = [k for k in range(2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:3]
    got = dialogue.repair(dialogue.damage(table(spark, [(k, 0, "user", "Hi.") for k in ids])), dropped_col="dropped").collect()
    assert sorted(tuple(r) for r in got) == [(k, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in ids]


def test_damage_by_crc(spark):
    rows = [(k, t, "assistant", "One. Two! Three?") for k in range(40) for t in (0, None)]
    got = sorted(map(tuple, dialogue.damage(table(spark, rows)).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        want += [(c, t, "user" if kind == 4 else r, "" if kind == 1 else "One Two Three" if kind == 2 else x, kind == 0)] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    same_rows(entry.queries()["op12_dialogue_repair"](spark, path), entry.oracle_sql()["op12_dialogue_repair"], duck(path))

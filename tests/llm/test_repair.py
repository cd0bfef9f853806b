"""Conversation repair against a table of all states, whole in a partition and split into blocks."""

import hashlib
import random
import zlib

from skein.llm.repair import Row, repair, search

CONVERSATIONS = "conv_id long, turn long, role string, text string, part int, place long, result string"
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], CONVERSATIONS)


def brute(rows, damaged=True):
    """conv_id to the figures, from the least (cost, audit, lines) of each state after each row."""
    found = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        named = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(":".join(named[:2]).encode()) % 20 if damaged else 9
        role, text = "user" if kind == 4 else named[2], "" if kind == 1 else "".join(c for c in named[3] if kind != 2 or c not in ".!?")
        found[conv] += [(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {conv: figures(sorted(own)) for conv, own in found.items()}


def figures(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def put(ways):
        for _ in range(3):
            for s, (cost, audit, lines) in list(ways.items()):
                t, role = (3, "assistant") if s == 2 else (2, "user")
                ways[t] = min(ways.get(t, (10**9,)), (cost + 3, audit + "I", [*lines, f"{role}:"]))
        return ways

    ways = {0: (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        on = {}
        for s, (cost, audit, lines) in put(ways).items():
            t, other = (3, "assistant") if s == 2 else (2, "user")
            more = 3 if fault == "truncated" else 0
            moves = [(s, cost + 4, "D", lines)]
            if fault not in ("blank", "duplicate"):
                moves.append((t, cost + 3 + more, "R", [*lines, f"{other}:{text}"]))
                if (s, role[:1]) in KEEP:
                    moves.append((KEEP[s, role[:1]], cost + more, "K", [*lines, f"{role}:{text}"]))
            for to, c, edit, left in moves:
                on[to] = min(on.get(to, (10**9,)), (c, audit + edit, left))
        ways = on
    cost, audit, lines = min(w for s, w in put(ways).items() if s in (0, 3))
    turns = [t for known, t, _, _ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    steps = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), steps, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(rng, conversations=40, longest=9):
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system" if turn == 0 else "user", "user", "assistant", "user", "assistant", None, "", "tool", "système"])
            text = rng.choice([None, "", " \n", "Same.", "same", f"t{turn}!", f"t{turn}", "é日. ", "a\x0b"])
            rows += [(conv, rng.choice([turn, turn, turn, None, 7]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def check(spark, rows, **options):
    got = {r[0]: tuple(r[1:]) for r in repair(conversations(spark, rows), **options).collect()}
    assert got == brute(rows, options.get("damaged", False))


def test_conversations_match_brute_force(spark):
    rows = made(random.Random(1))
    check(spark, rows, damaged=True)
    check(spark, rows)


def test_conversations_over_many_blocks_match_brute_force(spark):
    rng = random.Random(2)
    rows = made(rng, 6, 40) + [(99, t, rng.choice(["user", "assistant"]), rng.choice(["", "x", f"t{t}."])) for t in range(400)]
    check(spark, rows, block=3, damaged=True)
    check(spark, [(5, None, "user", "same.")] * 50 + [(5, t, "user", "same.") for t in range(50)], block=4)


def test_odd_tables(spark):
    assert repair(conversations(spark, []), damaged=True).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repair(conversations(spark, [(gone, 0, "user", "x.")]), damaged=True).collect() == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    check(spark, [(1, 0, "user", "long " * 200_000 + "."), (1, 1, "assistant", "ok."), (2, 5, "assistant", "alone.")])


def test_search_prefers_the_least_audit():
    assert search([Row("assistant", "a.", 0)], 0, ()) == {3: (3, "IK")}
    assert search([Row("user", "a.", 0)], 0, ()) == {3: (3, "KI")}
    assert search([Row("tool", "", 1)], 0, ()) == {0: (4, "D")}

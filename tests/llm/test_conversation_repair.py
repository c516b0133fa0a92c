"""Conversation repair against a plain DP over whole strings, exhaustive search on tiny cases, and odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from stratapanel.llm import conversation_repair as repair, queries

NEXT = (2, 2, 3, 2)


def plain(rows):
    """Cheapest, then ASCII-least audit: strings and costs in full, relaxed until nothing changes."""
    def inserts(best):
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                offer = (c + 3, a + "I")
                best[NEXT[s]] = min(best.get(NEXT[s], offer), offer)
        return best

    best = {0: (0, "")}
    for initial, doomed, cut in rows:
        new = {}
        for s, (c, a) in inserts(best).items():
            offers = [(s, c + 4, "D")]
            if not doomed:
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {}).get(s)
                offers += [(NEXT[s], c + 3 + 3 * cut, "R")] + ([(to, c + 3 * cut, "K")] if to else [])
            for e, cost, letter in offers:
                new[e] = min(new.get(e, (cost, a + letter)), (cost, a + letter))
        best = new
    best = inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


def walked(rows, audit):
    """Cost and role initials that an audit gives, or None where it may not be applied."""
    cost, state, roles, k = 0, 0, "", 0
    for letter in audit:
        if letter == "I":
            state, cost = NEXT[state], cost + 3
            roles += " .ua"[state]
            continue
        initial, doomed, cut = rows[k]
        k += 1
        if letter == "D":
            cost += 4
        elif doomed:
            return None
        elif letter == "R":
            state, cost = NEXT[state], cost + 3 + 3 * cut
            roles += " .ua"[state]
        else:
            roles, cost = roles + initial, cost + 3 * cut
            state = {"s": 1, "u": 2, "a": 3}.get(initial, 0)
    return (cost, audit) if re.fullmatch("(s?(ua)+)?", roles) else None


def random_rows(rng, n):
    return [(rng.choice("suauax "), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def test_audit_against_exhaustive_search():
    rng = random.Random(1)
    for trial in range(60):
        rows = random_rows(rng, rng.randrange(5))
        best = None
        for order in itertools.product("DKR", repeat=len(rows)):
            for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
                audit = "".join(g + x for g, x in zip(gaps, (*order, "")))
                if (offer := walked(rows, audit)) and (best is None or offer < best):
                    best = offer
        assert plain(rows) == best
        cost, audit = repair.finished(*repair.audited(rows))
        assert (cost, audit.replace("J", "K")) == best


@pytest.mark.parametrize("collide", [False, True])
def test_audit_against_strings_in_full(collide, monkeypatch):
    """With a hash that always collides the letters alone decide."""
    if collide:
        monkeypatch.setattr(repair, "_MODULUS", 1)
    rng = random.Random(2)
    for trial in range(150):
        rows = random_rows(rng, rng.randrange(40))
        cost, audit = repair.finished(*repair.audited(rows))
        assert (cost, audit.replace("J", "K")) == plain(rows)


def test_blocks_route_to_the_same_audit():
    rng = random.Random(3)
    for trial in range(150):
        rows = random_rows(rng, rng.randrange(1, 50))
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(6))))
        parts = [repair.transfer(rows[i:j]) for i, j in zip([0, *cuts], [*cuts, len(rows)])]
        total, path, tail = repair.routed((c, r) for c, _, r in parts)
        audit = "".join(a[4 * s + e] for (_, a, _), (s, e) in zip(parts, path)) + tail
        assert (total, audit.replace("J", "K")) == plain(rows)


def test_ancestors_and_prefixes():
    trails, rng = repair.Trails(), random.Random(4)
    nodes, strings = [0], {0: ""}
    for _ in range(400):
        parent, letter = rng.choice(nodes[-30:]), rng.choice("DIKR")
        node = trails.add(parent, ord(letter))
        nodes.append(node)
        strings[node] = strings[parent] + letter
        assert "".join(map(chr, trails.string(node))) == strings[node]
    for _ in range(3000):
        a, b, x, y = rng.choice(nodes), rng.choice(nodes), rng.choice("DIKR"), rng.choice("DIKR")
        if strings[a] + x != strings[b] + y:
            assert trails.less(a, ord(x), b, ord(y)) == (strings[a] + x < strings[b] + y)


ROWS = "conv_id long, turn long, role string, text string, edit string, place int"


def brute(table):
    """The contract of op11 in plain Python."""
    sp = lambda v: " " if v is None else str(v)
    every, damaged = {}, {}
    for conv, turn, role, text, *_ in table:
        every[conv] = True
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        damaged.setdefault(conv, []).extend([(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = {}
    for conv in every:
        rows = sorted(damaged.get(conv, []))
        seen, faults = set(), []
        for _, _, role, text in rows:
            content = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not content else "duplicate" if (role, text) in seen else "truncated" if content[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain([(r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)])
        lines, state, k = [], 0, 0
        for letter in audit:
            role, text = (rows[k][2], rows[k][3]) if letter != "I" else (None, "")
            k += letter != "I"
            if letter in "IR":
                state = NEXT[state]
                role = ["", "", "user", "assistant"][state]
            elif letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            if letter != "D":
                lines.append(f"{role}:{text}")
        turns = [r[1] for r in rows if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(rng):
    texts = ["Yes.", "No", "Why?", "ok\n", " ", "", None, "x" * 50 + "!", "é.", "tail.  \t"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}.", "e", 0))
    rows += rows[:20]  # repeated rows
    rows += [(1000, t, ("user", "assistant")[t % 2], rng.choice(["a.", "b", "c!", ""]) + str(t) * (t % 3) + ".", "e", 0) for t in range(700)]  # a hot conversation
    rows += [(2000, 1, "user", "word " * 300_000, "e", 0), (2000, 2, "assistant", "fine.", "e", 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_query_against_brute_force(spark, monkeypatch, block_rows):
    table = conversations(random.Random(5))
    monkeypatch.setattr(queries, "table", lambda *a: spark.createDataFrame(table, ROWS).repartition(3))
    whole = repair.repaired
    monkeypatch.setattr(repair, "repaired", lambda rows: whole(rows, block_rows))
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, "").collect()}
    want = brute(table)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repaired_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi.", "e", 0), (1, 1, "user", "Why?", "e", 0), (1, 2, "user", "Why?", "e", 0), (2, 0, "user", "", "e", 0)], ROWS)
    fixed, report = repair.repaired(rows)
    got = [tuple(r) for r in fixed.orderBy("conv_id", "place", "part").select("conv_id", "turn", "role", "text", "edit").collect()]
    assert got == [(1, None, "user", "", "I"), (1, 0, "assistant", "Hi.", "K"), (1, 1, "user", "Why?", "K"), (1, None, "assistant", "", "I")]
    assert {r["conv_id"]: r["audit"] for r in report.collect()} == {1: "IKKDI", 2: "D"}
    fixed, report = repair.repaired(rows.limit(0))
    assert fixed.count() == 0 and report.count() == 0
    assert repair.digests(fixed).count() == 0

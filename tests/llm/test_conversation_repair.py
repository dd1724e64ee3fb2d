"""Conversation repair against exhaustive search, plain strings and odd tables."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from odd_tables import SF0001
from duelframe.llm import audits as A
from duelframe.llm import conversation_repair as R
from duelframe.llm import queries as Q

GOAL = re.compile(r"(s?(ua)+)?")


def exhaustive(turns, inserts):
    """All edits with at most ``inserts`` inserts at a place, on (letter, kind)."""
    best = None
    options = [[("D", "", 3)] if kind == A.MUST_GO else
               [("D", "", 3), ("K", letter, kind), ("R", "u", 2 + kind), ("R", "a", 2 + kind)] for letter, kind in turns]
    gaps = [[("I" * n, "".join(w), 2 * n) for n in range(inserts + 1) for w in product("ua", repeat=n)]] * (len(turns) + 1)
    for choice in product(*[x for pair in zip(gaps, options) for x in pair], gaps[-1]):
        if GOAL.fullmatch("".join(c[1] for c in choice)):
            found = (sum(c[2] for c in choice), "".join(c[0] for c in choice))
            best = found if best is None or found < best else best
    return best


def plain(turns):
    """The same program on whole strings."""
    def insert(best):
        for s in (0, 1, 3, 2):
            if s in best:
                t = 3 if s == 2 else 2
                new = (best[s][0] + 2, best[s][1] + "I")
                best[t] = min(best.get(t, new), new)
        return best

    best = insert({0: (0, "")})
    for letter, kind in turns:
        then = {}

        def offer(state, way):
            then[state] = min(then.get(state, way), way)

        for s, (c, w) in best.items():
            offer(s, (c + 3, w + "D"))
            if kind != A.MUST_GO:
                offer(3 if s == 2 else 2, (c + 2 + kind, w + "R"))
                if letter == "s" and s == 0:
                    offer(1, (c + kind, w + "K"))
                if letter == "u" and s != 2:
                    offer(2, (c + kind, w + "K"))
                if letter == "a" and s == 2:
                    offer(3, (c + kind, w + "K"))
        best = insert(then)
    return min(best[s] for s in (0, 3) if s in best)


def some_turns(r, n):
    return [(r.choice("uuaasx"), r.choice([0, 0, 0, 1, 2])) for _ in range(n)]


def test_program_against_exhaustive_search():
    r = random.Random(1)
    for _ in range(150):
        turns = some_turns(r, r.randrange(0, 4))
        assert A.cheapest(turns) == exhaustive(turns, 2)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 3])
def test_program_against_plain_strings(monkeypatch, modulus):
    monkeypatch.setattr(A.AuditTree, "MODULUS", modulus)  # 3: nearly all hashes collide
    r = random.Random(2)
    for n in [*range(0, 12)] * 8 + [60, 200]:
        turns = some_turns(r, n)
        assert A.cheapest(turns) == plain(turns)
    for letter in "uas":
        assert A.cheapest([(letter, 0)] * 150) == plain([(letter, 0)] * 150)


def test_segments_join_to_the_whole():
    r = random.Random(3)
    for _ in range(60):
        turns, chain, at = some_turns(r, r.randrange(1, 40)), A.Chain(), 0
        while at < len(turns):
            size = r.randrange(1, 9)
            part = A.Segment(range(4))
            for t in turns[at:at + size]:
                part.turn(*t)
            chain.add(part.ways())
            at += size
        assert chain.result() == plain(turns)


def expected(rows):
    """Of undamaged rows (conv, turn, role, text)."""
    conv = {}
    for c, t, role, text in rows:
        conv.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    out = []
    for c, found in conv.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, role, text in found:
            full = re.search(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not full else 1 if (role, text) in seen else 2 if text.rstrip(" \t\n\v\f\r")[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role[:1], A.MUST_GO if fault in (0, 1) else A.TRUNCATED if fault == 2 else A.FINE))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = plain(turns)
        lines, state, rest = [], 0, iter(found)
        for e in audit:
            _, role, text = ("", "", "") if e == "I" else next(rest)
            if e == "D":
                continue
            state = {"s": 1, "u": 2, "a": 3}[role[:1]] if e == "K" else 3 if state == 2 else 2
            lines.append(f"{role if e == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        known = [t for t, _, _ in found if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def damaged(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if case != 0:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            yield from [(c, t, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)


def digests(repair):
    by = {r.conv_id: r.sha256 for r in R.digest_turns(repair.repaired).collect()}
    return sorted(((r.conv_id, *[r[n] for n in R.REPORT[:5]], r.cost, r.audit, by.get(r.conv_id, hashlib.sha256(b"").hexdigest()))
                   for r in repair.report.collect()), key=repr)


def test_query_against_plain_repair(spark):
    for folder in (SF0001, SF0001.replace("0.001", "0.01")):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet")
                .select("conv_id", "turn", "role", "text").collect()]
        exp = expected(damaged(rows))
        gone = {r[0] for r in rows} - {e[0] for e in exp}
        exp += [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone]
        got = Q.op13_conversation_repair(spark, folder).collect()
        names = ["conv_id", *R.REPORT, "audit", "repaired_sha256"]
        assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(exp, key=repr)


@pytest.mark.parametrize("segment", [4000, 3])
def test_odd_rows_and_long_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    r = random.Random(5)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (1, None, "user", "a"), (1, None, "user", "a"),
            (1, 7, "assistant", " \t"), (2, 5, "", ""), (2, 9, "weird", "x!"), (3, 1, "system", "s."), (4, None, "user", "x" * 200_000 + "?")]
    rows += [(9, i // 2, r.choice(["user", "assistant", "system"]), r.choice(["yes.", "no", "", "why? ", f"{i}!"])) for i in range(900)]
    rows += [(10, 4, "user", "again.")] * 300
    table = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id long, turn long, role string, text string, _n int, audit string")
    got = digests(R.repair_conversations(table.repartition(5)))
    assert got == expected(rows)
    none = R.repair_conversations(table.limit(0))
    assert none.report.count() == 0 and R.digest_turns(none.repaired).count() == 0

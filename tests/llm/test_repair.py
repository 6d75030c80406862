"""Repair of conversations against trying all edits, and long ones against the plain table of states."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from areapanel.llm import repair

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    found = []
    for conv, turn, role, text in rows:
        said = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2], said[3]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        found += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return found


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACES)
        found.append("blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "fine")
        seen.add((role, text))
    return found


def every_way(rows):
    """Cheapest (cost, audit, repaired) of all edit sequences, with up to two turns put in at every place."""
    judged, found = faults(rows), None
    choices = []
    for (_, _, role, text), fault in zip(rows, judged):
        more = 3 if fault == "truncated" else 0
        own = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            own += [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]
        choices.append(own)
    puts = [[]] + [[(3, "I", ("user", ""))], [(3, "I", ("assistant", ""))], [(3, "I", ("user", "")), (3, "I", ("assistant", ""))], [(3, "I", ("assistant", "")), (3, "I", ("user", ""))]]
    for edits in itertools.product(*choices):
        for put in itertools.product(puts, repeat=len(rows) + 1):
            steps = list(put[0])
            for e, p in zip(edits, put[1:]):
                steps += [e, *p]
            turns = [t for _, _, t in steps if t]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
                way = (sum(c for c, _, _ in steps), "".join(a for _, a, _ in steps), turns)
                found = min(found, way, key=lambda w: w[:2]) if found else way
    return found


def expected(rows, solve):
    found = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged([r for r in rows if r[0] == conv])), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        if not own:
            found.append((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        judged = faults(own)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, done = solve(own)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        found.append((conv, gaps, *[judged.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(found, key=repr)


def by_table(rows):
    """Cheapest (cost, audit, repaired) row by row, all states at once, with turns put in until nothing gets lighter."""
    judged = faults(rows)
    follow = lambda q: "a" if q == "u" else "u"
    full = {"u": "user", "a": "assistant"}

    def settle(now):
        changed = True
        while changed:
            changed = False
            for q, (c, a, done) in list(now.items()):
                way = (c + 3, a + "I", [*done, (full[follow(q)], "")])
                if follow(q) not in now or way[:2] < now[follow(q)][:2]:
                    now[follow(q)], changed = way, True
        return now

    now = settle({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, judged):
        after = {}

        def offer(q, way):
            if q not in after or way[:2] < after[q][:2]:
                after[q] = way

        for q, (c, a, done) in now.items():
            offer(q, (c + 4, a + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] == follow(q) or (role[:1] == "s" and q == ""):
                offer(role[:1], (c + more, a + "K", [*done, (role, text)]))
            offer(follow(q), (c + 3 + more, a + "R", [*done, (full[follow(q)], text)]))
        now = settle(after)
    return min((now[q] for q in ("", "a") if q in now), key=lambda w: w[:2])


ROLES = ["user", "assistant", "system", "tool", None, "user", "assistant", "umpire"]
TEXTS = ["Fine.", "Yes!", "cut off", "  ", None, "Why?\n", "so.and", "é. ", ""]


def table(rng, convs, longest):
    rows = []
    for conv in convs:
        for k in range(rng.randrange(1, longest)):
            turn = rng.choice([k, k, k, k + rng.randrange(3), None])
            rows.append((conv, turn, rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.5 else f"Text {rng.randrange(40)}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, place string").repartition(3)


def test_few_rows_against_every_way(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for k in range(rng.randrange(1, 4)):
            rows.append((conv, k, rng.choice(ROLES), rng.choice(TEXTS)))
    got = repair.report(frame(spark, rows))
    small = [r for r in rows if len(damaged([x for x in rows if x[0] == r[0]])) <= 3]
    want = expected(small, every_way)
    kept = {w[0] for w in want}
    assert sorted((tuple(r) for r in got.collect() if r[0] in kept), key=repr) == want
    assert want == expected(small, by_table)


@pytest.mark.parametrize("segment, fan", [(512, 32), (2, 2), (3, 4)])
def test_report(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "FAN", fan)
    rng = random.Random(7)
    rows = table(rng, [*range(40), None], 14) + table(rng, [100, 101], 90) + [(200, None, None, None)] * 3
    rows += [(300, 5, "user", "Same.")] * 4 + [(300, 6, "assistant", "x" * 1_000_000 + ".")]
    got = repair.report(frame(spark, rows))
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, by_table)


def test_repaired_rows(spark):
    rows = table(random.Random(9), range(10), 9)
    got = {}
    for r in sorted(repair.repaired(repair.damaged(frame(spark, rows))).collect(), key=lambda r: (r["conv_id"], r["place"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv in range(10):
        own = sorted(damaged([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        assert got.get(conv, []) == by_table(own)[2]


def test_empty(spark):
    assert repair.report(frame(spark, [(1, 1, "user", "x")]).where("false")).collect() == []
    assert repair.repaired(repair.damaged(frame(spark, [(1, 1, "user", "x")]).where("false"))).collect() == []

"""Conversation repair against versions that try every edit, and that plan by suffix costs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from netgeo.llm import repair

RIGHT = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def tried(codes):
    """Least (cost, audit) over all edits with up to two inserts in a gap."""
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    edits = [[("D", 2, "")] + ([] if f in "bd" else [("K", 5 * (f == "t"), r), ("R", 1 + 5 * (f == "t"), "u"), ("R", 1 + 5 * (f == "t"), "a")]) for r, f in codes]
    for choice in itertools.product(*edits):
        for ins in itertools.product(gaps, repeat=len(codes) + 1):
            out = ins[0] + "".join(c[2] + g for c, g in zip(choice, ins[1:]))
            if RIGHT.match(out):
                x = (sum(c[1] for c in choice) + 5 * sum(map(len, ins)), "I" * len(ins[0]) + "".join(c[0] + "I" * len(g) for c, g in zip(choice, ins[1:])))
                best = x if best is None else min(best, x)
    return best


def planned(codes):
    """Suffix costs by backward induction, then the least letter that keeps to them."""
    n, inf = len(codes), 10**9

    def moves(i, q):
        out = []
        if i < n:
            r, f = codes[i]
            out.append(("D", 2, i + 1, q))
            if f not in "bd":
                more = 5 * (f == "t")
                if r in NEXT[q]:
                    out.append(("K", more, i + 1, NEXT[q][r]))
                out += [("R", more + 1, i + 1, p) for x, p in NEXT[q].items() if x in "ua"]
        out += [("I", 5, i, p) for x, p in NEXT[q].items() if x in "ua"]
        return out

    left = [[inf] * 4 for _ in range(n + 1)]
    left[n] = [0, inf, inf, 0]
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in range(4):
                left[i][q] = min([left[i][q]] + [c + left[j][p] for _, c, j, p in moves(i, q)])
    i, q, audit = 0, 0, ""
    while not (i == n and left[i][q] == 0):
        letter, _, i, q = min(m for m in moves(i, q) if m[1] + left[m[2]][m[3]] == left[i][q])
        audit += letter
    return left[0][0], audit


def goal(codes, cuts=()):
    """The operator's derivation, from segments that end at ``cuts``."""
    ends = [0, *cuts, len(codes)]
    leaves = [repair.segment_items("".join(r + f for r, f in codes[a:b])) for a, b in zip(ends, ends[1:]) if b > a]
    (item,) = repair.lightest([*leaves, repair.inserts()], whole=True).values()
    return item[0], item[2]


def brute(rows):
    """The whole contract, one conversation after the other."""
    out, groups = [], defaultdict(list)
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv].extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, codes = set(), []
        for _, role, text in own:
            core = text.strip(SPACE)
            fault = "b" if not core else "d" if (role, text) in seen else "-" if core[-1] in ".!?" else "t"
            seen.add((role, text))
            codes.append((role[0] if role and role[0] in "sua" else "o", fault))
        cost, audit = planned(codes)
        lines, q, i = [], 0, 0
        for letter in audit:
            role, text = ("assistant" if q == 2 else "user"), ""
            if letter != "I":
                role, text = (own[i][1] if letter == "K" else role), own[i][2]
                i += 1
            if letter != "D":
                lines.append(f"{role}:{text}")
                q = NEXT[q][role[0]]
        turns = [r[0] for r in own if r[0] is not None]
        faults = [f for _, f in codes]
        wrong = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), wrong, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_short_conversation_against_all_edits():
    kinds = [r + f for r in "suao" for f in "bt-"]
    for n in (1, 2):
        for codes in itertools.product(kinds, repeat=n):
            assert goal(codes) == planned(codes) == tried(codes), codes
    rnd = random.Random(2)
    for _ in range(25):
        codes = rnd.choices(kinds, k=3)
        assert goal(codes) == planned(codes) == tried(codes), codes


def test_long_conversations_whole_and_in_segments():
    rnd = random.Random(3)
    for n in [*range(4, 60), 300, 1000]:
        codes = [rnd.choice("sua" if rnd.random() < 0.1 else "ua"[k % 2] + "o" * (rnd.random() < 0.1)) + rnd.choice("---btd") for k in range(n)]
        assert goal(codes) == planned(codes), codes
        assert goal(codes, sorted(rnd.sample(range(1, n), 3))) == planned(codes), codes


@pytest.mark.parametrize("bits", [10, 2])
def test_repair_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rnd = random.Random(4)
    texts = ["Yes.", "No", "Why?", "", " \n\t", None, "a. ", "x!  \r\n", " ", "Yes.", "é.", "...", ".a", "long " * 50 + "end.", "\x1f"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "sudo"]
    rows = []
    for conv in [*range(60), None]:
        for k in range(rnd.randint(1, 25) if conv != 7 else 90):
            rows.append((conv, k if rnd.random() < 0.8 else rnd.choice([None, 3, -2, 40]), rnd.choice(roles[: rnd.choice([3, 10])]), rnd.choice(texts)))
    rows += rows[:15] + [(5000, 2**63 - 1, "user", "a."), (5000, -(2**63), "assistant", "b.")]
    rows += [(conv, 0, "user", "Hi.") for conv in range(6000, 6060)]  # some lose their only row
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    expected = brute(rows)
    expected = sorted([(r[0], 2**63 - 1, *r[2:]) if r[0] == 5000 and r[1] > 0 else r for r in expected], key=repr)
    out = result(repair.repair(repair.damage(df)))
    originals = {r[0] for r in rows}
    lost = [r for r in out if r[-1] == hashlib.sha256(b"").hexdigest()]
    assert {r[0] for r in out} == originals and len(out) == len(originals) and lost
    empty = {r[0]: (r[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in out}
    told = {r[0]: r for r in expected}
    assert out == sorted((told.get(c, empty[c]) for c in originals), key=repr)


def test_undamaged_empty_and_clashing(spark):
    assert result(repair.repair(repair.damage(spark.createDataFrame([], SCHEMA)))) == []
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "A."), (2, 1, "user", "B")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", pos bigint, code string, copies int")
    out = result(repair.repair(repair.undamaged(df)))
    assert [r[6:8] for r in out] == [(0, "KK"), (4, "DD")] and out[0][1:6] == (0,) * 5
    assert out[0][-1] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert out[1][1:6] == (0, 0, 0, 1, 0)

"""Repair of conversations against a plain dynamic program and a plain reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from priceshape.llm import auction, repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, _id int, `a b.c` string"
NEXT = (2, 2, 3, 2)


def cheapest(rows):
    """Least (cost, labels) by trying every edit at every row: rows are (initial, fault)."""
    def inserted(best):
        for _ in range(3):
            for q in range(4):
                if best[q]:
                    more = (best[q][0] + 5, best[q][1] + "I")
                    best[NEXT[q]] = min(filter(None, [best[NEXT[q]], more]))
        return best

    best = inserted([(0, ""), None, None, None])
    for initial, fault in rows:
        found = [[] for _ in range(4)]
        for q, state in enumerate(best):
            if not state:
                continue
            cost, labels = state
            found[q].append((cost + 2, labels + "D"))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                found[NEXT[q]].append((cost + 1 + more, labels + "R"))
                if initial == ("a" if q == 2 else "u"):
                    found[NEXT[q]].append((cost + more, labels + "K"))
                if initial == "s" and q == 0:
                    found[1].append((cost + more, labels + "K"))
        best = inserted([min(f) if f else None for f in found])
    return min(filter(None, [best[0], best[3]]))


def damaged(rows):
    out = []
    for row in rows:
        conv, turn, role, text = row[:4]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plainly(rows):
    """Audit of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, parsed = set(), []
    for _, _, role, text in rows:
        core = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        parsed.append((role[:1], fault))
    turns = [r[1] for r in rows if r[1] is not None]
    cost, labels = cheapest(parsed)
    made, at = [], iter(rows)
    for label in labels:
        row = next(at) if label != "I" else None
        if label == "D":
            continue
        if label == "K":
            made.append((row[2], row[3]))
        else:
            led = bool(made) and made[0][0][:1] == "s"
            made.append(("assistant" if (len(made) - led) % 2 else "user", row[3] if row else ""))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[sum(f == kind for _, f in parsed) for kind in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(parsed)),
        cost, labels, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()), made


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "what", "", "  ", "Ok. \n", " ", "x" * 3000 + ".", "Wo? ", None]
    out = []
    for conv in [*range(120), None]:
        roles = rng.choice([("user", "assistant"), ("system", "user", "assistant"), ("user",), ("", None, "tool", "uncle", "System", "assistant")])
        for turn in range(rng.randrange(1, 9)):
            out.append((conv, None if rng.random() < 0.1 else rng.choice([turn, turn, 2 * turn, 0]), rng.choice(roles), rng.choice(texts)))
    out += [(500, turn, "user" if turn % 3 else "assistant", f"text {turn % 40}.") for turn in range(700)]
    out += [out[0], out[0]] + [(501, 7, "user", "Same.")] * 300
    return [(*r, "old", 5, "extra") for r in out]


def test_auction_equals_the_dynamic_program():
    rng = random.Random(1)
    cases = [bytes(c) for n in range(3) for c in itertools.product(range(16), repeat=n)]
    cases += [bytes(rng.choice([1, 2, 2, 3, 3, 3, 0, 6, 14, 15, *range(16)]) for _ in range(rng.randrange(2, 400 if k % 9 == 0 else 12)))
              for k in range(1500)]
    faults = ["", "blank", "duplicate", "truncated"]
    for case in cases:
        assert auction.plan(case) == cheapest([(auction.INITIALS[c % 4].strip(), faults[c // 4]) for c in case])


def test_auction_is_linear_in_long_conversations():
    cost, audit = auction.plan(bytes([2]) * 5000)  # every second user becomes the assistant
    assert (cost, audit) == (2500, "KR" * 2500)


def test_damage_keeps_columns_and_follows_the_key(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    made = repair.damage(frame)
    assert made.columns == frame.columns and made.where("audit <> 'old' OR _id <> 5").count() == 0
    assert sorted(map(str, (tuple(r[:4]) for r in made.collect()))) == sorted(map(str, damaged(rows)))


def test_digests_equal_the_plain_reading(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(repair.damage(frame), frame.select("conv_id")).collect()}
    whole = damaged(rows)
    wanted = {conv: plainly([r for r in whole if r[0] == conv])[0] for conv in {r[0] for r in rows}}
    assert found == wanted


def test_repaired_turns_and_plans(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    texts = [(r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
    found = {}
    for r in repair.repaired(frame).orderBy("position").collect():
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    plan = {r.conv_id: r for r in repair.plans(frame).collect()}
    for conv in {r[0] for r in rows}:
        counts, made = plainly([t for t in texts if t[0] == conv])
        assert found.get(conv, []) == made
        assert tuple(plan[conv])[1:] == counts[:-1]


def test_conversations_without_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    none = frame.where("false")
    every = spark.createDataFrame([(4,), (4,), (None,)], "c long")
    found = {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(none, every).collect()}
    zeros = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found == {4: zeros, None: zeros}
    assert repair.repair_digests(none).count() == repair.plans(none).count() == repair.repaired(none).count() == 0
    assert repair.damage(none).count() == 0


def test_names_of_the_columns(spark):
    frame = spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "assistant", "So.")],
                                  "`the id` string, n int, `who.is` string, cost string")
    got = repair.repair_digests(frame, conv_id="the id", turn="n", role="who.is", text="cost").collect()
    assert got[0]["the id"] == "x" and got[0].audit == "KK"
    assert repair.repaired(frame, "the id", "n", "who.is", "cost").columns == ["the id", "position", "who.is", "cost"]

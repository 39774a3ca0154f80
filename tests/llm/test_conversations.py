import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from shoplens.llm.conversations import SuffixPath, _FINAL, damaged, repair_summaries, repair_turns

SCHEMA = "conv_id long, turn long, role string, text string, kind string, conversation string, segment string, part string, digest string"
SPACE = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        here += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest())
    return sorted(rows, key=key)


def best(turns):
    """Least (cost, audit, repaired) over all edits, by plain recursion from the front."""
    seen, faults = set(), []
    for _, role, text in turns:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def go(i, before, inserted):
        options = []
        if i == len(turns) and before in ("", "a"):
            options.append((0, "", ()))
        after = lambda new: (before in ("", "s", "a") and new == "u") or (before == "u" and new == "a") or (before == "" and new == "s")

        def take(cost, letter, new, body, j, count):
            if new is None or after(new):
                rest = go(j, before if new is None else new, count)
                if rest is not None:
                    options.append((cost + rest[0], letter + rest[1], (() if body is None else (body,)) + rest[2]))

        if inserted < 3:
            take(5, "I", "u", "user:", i, inserted + 1)
            take(5, "I", "a", "assistant:", i, inserted + 1)
        if i < len(turns):
            _, role, text = turns[i]
            extra = 5 if faults[i] == "truncated" else 0
            take(2, "D", None, None, i + 1, 0)
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a"):
                    take(extra, "K", role[0], f"{role}:{text}", i + 1, 0)
                take(1 + extra, "R", "u", f"user:{text}", i + 1, 0)
                take(1 + extra, "R", "a", f"assistant:{text}", i + 1, 0)
        return min(options, default=None)

    cost, audit, body = go(0, "", 0)
    return faults, cost, audit, "\n".join(body)


def brute(damaged_rows):
    out = []
    for conv, rows in damaged_rows.items():
        rows = in_order(rows)
        faults, cost, audit, body = best(rows)
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def generated(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "s", "User"])
            text = rng.choice([f"Text {turn}.", f"Text {turn}.", "Same!", "cut off", "", " \n", None, "Ü?\x0b ", f"open {turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 7, None]), role, text))
    return rows + rows[:5]


def found(spark, rows, segment=512):
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in repair_summaries(damaged(df), segment=segment).collect()), key=str)


@pytest.mark.parametrize("segment, longest", [(512, 9), (3, 14), (1, 6)])
def test_equals_brute_force(spark, segment, longest):
    rows = generated(segment, 150, longest)
    rows += [(None, 1, "user", "No id."), (None, None, "assistant", "None."), (9000, None, None, None), (9001, 1 << 62, "user", "Far."), (9001, -5, "user", "Near.")]
    assert found(spark, rows, segment) == brute(after_damage(rows))


def test_every_short_signature():
    path = SuffixPath(_FINAL)
    symbols = "suaoSUAOx"
    for signature in sorted("".join(p) for n in range(5) for p in product(symbols, repeat=n)):
        path.follow(signature)
        turns = []
        for n, c in enumerate(reversed(signature)):
            text = "" if c == "x" else f"t{n}" if c.isupper() else f"t{n}."
            turns.append((n, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), text))
        audit, cost, _ = path.audit(0)
        assert (cost, audit) == best(turns)[1:3], signature


def test_nodes_are_shared():
    path = SuffixPath(_FINAL)
    for signature in sorted(["aus", "ausx", "aus", "auau", "auaus", "x"]):
        path.follow(signature)
    assert path.made == 8  # auau, s, s, x, x


def test_one_long_conversation(spark):
    rng = random.Random(3)
    rows = [(1, n, rng.choice(["user", "assistant", "assistant"]), rng.choice([f"T {n}.", f"T {n}.", f"cut {n}", "Same."])) for n in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = found(spark, rows, 16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert split == found(spark, rows, 100000)


def test_many_equal_rows_in_one_turn(spark):
    rows = [(1, 3, "user", "Hi.")] * 1500 + [(1, 4, "assistant", "Yes.")]
    (row,) = found(spark, rows)
    copies = len(after_damage(rows)[1]) - sum(r[0] == 4 for r in after_damage(rows)[1])
    assert row[3] == max(copies - 1, 0)
    assert row[7].startswith("KD" if copies > 1 else "")


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (2, 0, "user", ""), (3, 0, "system", "Be."), (3, 1, "tool", "A."), (3, 2, "tool", "B.")]
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in repair_turns(df).collect())
    assert got == [(1, 0, "user", "Hello.", "R"), (1, 1, "assistant", "Why?", "R"), (3, 0, "system", "Be.", "K"), (3, 1, "user", "A.", "R"), (3, 2, "assistant", "B.", "R")]
    assert found(spark, rows[:0]) == [] and repair_turns(df.limit(0)).collect() == []

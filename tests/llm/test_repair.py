"""Cheapest repairs against trying every edit, and long conversations in blocks against an unbroken one."""

import hashlib
import itertools
import random
import re
import zlib

from skein.llm import repair as R

BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(turns):
    """Turns of one number stand by fingerprint."""
    mark = lambda t: hashlib.sha256(f"{len(t[2].encode())}\n{t[2]}\n{t[3]}".encode()).digest()
    return sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, mark(t)))


def faults(turns):
    out, seen = [], set()
    for _, _, role, text in turns:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(turns, found):
    """(cost, audit, lines) by trying every edit of every turn, and up to two insertions at every place."""
    places = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (_, _, role, text), fault in zip(turns, found, strict=True):
        cut = fault == "truncated"
        options = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            options += [(cut, "K", (role, text)), (2 + cut, "R", ("user", text)), (2 + cut, "R", ("assistant", text))]
        choices.append(options)
    winner = None
    for edits in itertools.product(*choices):
        cost = sum(e[0] for e in edits)
        if winner and cost > winner[0]:
            continue
        for inserted in itertools.product(places, repeat=len(turns) + 1):
            total = cost + 2 * sum(map(len, inserted))
            if winner and total > winner[0]:
                continue
            audit, lines = "", []
            for i, extra in enumerate(inserted):
                audit += "I" * len(extra)
                lines += [(r, "") for r in extra]
                if i < len(edits):
                    audit += edits[i][1]
                    lines += [edits[i][2]] if edits[i][2] else []
            if all(r for r, _ in lines) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)):
                got = (total, audit, "\n".join(f"{r}:{t}" for r, t in lines))
                winner = min(winner or got, got)
    return winner


def figures(turns):
    found = faults(turns)
    numbers = [t[1] for t in turns if t[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [t[2][:1] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal)


def test_every_edit_of_small_conversations(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 3)):
            number = rng.choice((turn, turn, turn + 2, None))
            rows.append((conv, number, rng.choice(("user", "assistant", "system", "user", "assistant", "tool", "", None)), rng.choice(("Yes.", "No", "Why?", "", None, " \t", "Yes.", "é!  "))))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS cost", "2 AS print", "3 AS kind")
    for block in (R.BLOCK, 1, 2):
        got = {r.conv_id: r for r in R.repair_damaged(df, block).collect()}
        assert set(got) == {r[0] for r in rows}
        for conv, r in got.items():
            turns = in_order([t for t in damaged(rows) if t[0] == conv])
            cost, audit, text = best(turns, faults(turns))
            assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), (conv, turns)
            assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == figures(turns), (conv, turns)


def test_a_long_conversation_in_blocks(spark):
    rng = random.Random(8)
    rows = [(7, i // 2 * 3, rng.choice(("user", "assistant", "system")), f"{rng.choice(('Yes', 'No', 'x' * 5000))} {i // 5}{rng.choice(('.', '', '?'))}") for i in range(900)]
    rows += [(7, 4, "user", "Yes.")] * 50
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    one = R.repair_damaged(df).collect()
    many = R.repair_damaged(df, 7).collect()
    assert one == many and len(one) == 1
    r, turns = one[0], in_order(damaged(rows))
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == figures(turns)
    # Replaying the audit costs what it should and gives roles of the grammar.
    found, i, state, cost, lines = faults(turns), 0, 0, 0, []
    for letter in r.audit:
        if letter == "I":
            role, state = R.NEXT[state]
            lines.append(f"{role}:")
            cost += 2
            continue
        (_, _, role, text), fault = turns[i], found[i]
        i += 1
        if letter == "D":
            cost += 3
            continue
        assert fault not in ("blank", "duplicate")
        cost += (fault == "truncated") + 2 * (letter == "R")
        role, state = (role, R.STEPS[state, role[0]]) if letter == "K" else R.NEXT[state]
        lines.append(f"{role}:{text}")
    assert i == len(turns) and cost == r.cost and state in (0, 3)
    assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_conversations_that_vanish_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kind = "conv_id long, turn long, role string, text string"
    (r,) = R.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], kind)).collect()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert R.repair_damaged(spark.createDataFrame([], kind)).count() == 0

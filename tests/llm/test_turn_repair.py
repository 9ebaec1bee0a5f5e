import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from postpulse.llm import queries
from postpulse.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind string, first string"
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, edits, repaired rows) of (role, text, fault) rows by a search over whole strings."""
    best = {0: (0, "", [])}     # state -> least (cost, edits); equal strings give equal rows

    def better(into, state, entry):
        if state not in into or entry[:2] < into[state][:2]:
            into[state] = entry

    def insert(states):
        for _ in range(3):
            for state, (c, e, out) in list(states.items()):
                role, to = ("assistant", 3) if state == 2 else ("user", 2)
                better(states, to, (c + 5, e + "I", out + [(role, "")]))
        return states

    for role, text, fault in rows:
        after = {}
        for state, (c, e, out) in insert(best).items():
            better(after, state, (c + 2, e + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            new, to = ("assistant", 3) if state == 2 else ("user", 2)
            better(after, to, (c + 1 + more, e + "R", out + [(new, text)]))
            if role[:1] == "s" and state == 0:
                better(after, 1, (c + more, e + "K", out + [(role, text)]))
            elif role[:1] == "u" and state != 2:
                better(after, 2, (c + more, e + "K", out + [(role, text)]))
            elif role[:1] == "a" and state == 2:
                better(after, 3, (c + more, e + "K", out + [(role, text)]))
        best = after
    return min(insert(best)[s] for s in (0, 3) if s in best)


def plain(rows):
    """Reports of (conv_id, turn, role, text, copies) rows."""
    held = defaultdict(list)
    for conv, turn, role, text, copies in rows:
        held[conv] += [(turn is not None, turn or 0, role, text)] * copies
    out = []
    for conv, got in held.items():
        got.sort()
        seen, faulty, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for *_, role, text in got:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = ("blank" if not body else "duplicate" if (role, text) in seen else
                     "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            faulty.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [t for known, t, *_ in got if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[:1] for r, *_ in faulty]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, audit, fixed = cheapest(faulty)
        assert GOOD.fullmatch("".join(r[:1] for r, _ in fixed))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, sha))
    return sorted(out, key=str)


def broken(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub(r"[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out.append((conv, turn, role, text, {0: 0, 3: 2}.get(fault, 1)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def run(spark, rows):
    df = queries.damaged(frame(spark, rows).repartition(3))
    return sorted((tuple(r) for r in tr.repair(spark, df, copies_col="copies").collect()), key=str)


@pytest.mark.parametrize("seed", range(8))
def test_block_tables_give_the_least_cheapest_edits(seed):
    rng = random.Random(seed)
    for _ in range(400):
        symbols = bytes(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(0, 23)))
        rows = [("x" if s == tr.GONE else "sua?"[s % 4], str(i),
                 "blank" if s == tr.GONE else "truncated" if s >= 4 else None)
                for i, s in enumerate(symbols)]
        cost, audit, fixed = cheapest(rows)
        assert tr.tables().repair(symbols) == (cost, audit)
        speller = tr.Speller(audit)
        spelled = [x for role, text, _ in rows for x in speller.row(role, text)] + list(speller.rest())
        assert spelled == fixed


def test_every_short_conversation():
    import itertools
    for n in range(5):
        for symbols in itertools.product(range(9), repeat=n):
            rows = [("sua?"[s % 4], "t", "blank" if s == 8 else "truncated" if s >= 4 else None)
                    for s in symbols]
            assert tr.tables().repair(bytes(symbols)) == cheapest(rows)[:2]


def conversations(seed, n, rng_turns=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, rng_turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "s", None])
            text = rng.choice(["Good.", "Why?", "no end", " \t\n", "Ünïcode! ", "", "Same. ", None])
            rows.append((conv, turn + rng.choice([0, 0, 0, 3]), role, text))
    return rows


def test_reports_equal_a_search_over_whole_strings(spark):
    rows = conversations(1, 300)
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (2**53 + 1, None, "user", "A."),
             (2**53 + 3, None, "user", "B."), (2**53 + 3, None, "assistant", "B."),
             (2**53 + 3, -4, "user", "x " * 100_000), (77, 2, "user", "Good."), (77, 2, "user", "Good.")]
    rows += [(900, 5, "user", "Same row.")] * 1000
    assert run(spark, rows) == plain(broken(rows))
    assert run(spark, []) == []
    # a conversation whose rows are all dropped
    gone = next(i for i in range(10_000, 20_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "x")]) == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("limits", [{"keep_rows": 12}, {"keep_chars": 40}])
def test_large_conversations_take_the_exact_other_way(spark, limits):
    rows = conversations(2, 40, 30)
    rows += [(900, t % 300, "user" if t % 2 else "assistant", f"Turn {t % 170}.") for t in range(700)]
    rows += [(None, None, "user", "Hi."), (None, 1, "assistant", "Yes.")] * 20
    df = queries.damaged(frame(spark, rows).repartition(3))
    report = tr.repair(spark, df, copies_col="copies", **limits)
    assert sorted((tuple(r) for r in report.collect()), key=str) == plain(broken(rows))


def test_repaired_turns_are_the_digested_ones(spark):
    rows = conversations(3, 60)
    df = queries.damaged(frame(spark, rows))
    report = tr.repair(spark, df, copies_col="copies")
    lines = defaultdict(list)
    for r in tr.repaired_turns(df, report, copies_col="copies").collect():
        lines[r.conv_id].append((r.position, f"{r.role}:{r.text}"))
    for r in report.collect():
        text = "\n".join(x for _, x in sorted(lines[r.conv_id]))
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256

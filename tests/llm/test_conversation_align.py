"""Conversation repair against exhaustive search over edits, and the operator on odd tables."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from obsframe.llm.conversation_align import align_segment, audits, best_whole, damage, damaged_and_repaired, join_segments, numbered_turns, repair_conversations

BLANKS = " \t\n\v\f\r"


def cheapest(codes):
    """Least cost and audit by trying every edit at every turn; ``codes`` is a list of (initial, fault)."""
    @lru_cache(None)
    def go(i, state):  # states: 0 nothing, s, u, a
        best = [(0, "")] if i == len(codes) and state in ("", "a") else []
        moves = {"": "u", "s": "u", "u": "a", "a": "u"}
        if i < len(codes):
            initial, fault = codes[i]
            c, s = go(i + 1, state)
            best.append((c + 4, "D" + s))
            if fault not in (1, 2):
                for role in [moves[state]] + (["s"] if state == "" else []):
                    if role == initial or role != "s":
                        c, s = go(i + 1, role)
                        best.append((c + (0 if role == initial else 3) + (3 if fault == 3 else 0), ("K" if role == initial else "R") + s))
        return best_insert(i, state, best)

    def best_insert(i, state, best):
        # at most two insertions in a row can help: a third comes back to the state after the first
        moves = {"": "u", "s": "u", "u": "a", "a": "u"}
        if depth[0] < 2:
            depth[0] += 1
            c, s = go.__wrapped__(i, moves[state])
            depth[0] -= 1
            best.append((c + 3, "I" + s))
        return min(best, default=(10 ** 9, ""))

    depth = [0]
    return go(0, "")


def dynamic(codes):
    """The same by a plain table over (turn, state), strings compared whole."""
    states, moves = ["", "s", "u", "a"], {"": "u", "s": "u", "u": "a", "a": "u"}
    ahead = {q: (0, "") if q in ("", "a") else (10 ** 9, "") for q in states}

    def insertions(at):
        for _ in range(3):
            for q in states:
                c, s = at[moves[q]]
                at[q] = min(at[q], (c + 3, "I" + s))
        return at

    ahead = insertions(ahead)
    for initial, fault in reversed(codes):
        now = {}
        for q in states:
            options = [(ahead[q][0] + 4, "D" + ahead[q][1])]
            if fault not in (1, 2):
                for role in [moves[q]] + (["s"] if q == "" else []):
                    if role == initial or role != "s":
                        c, s = ahead[role]
                        options.append((c + (0 if role == initial else 3) + (3 if fault == 3 else 0), ("K" if role == initial else "R") + s))
            now[q] = min(options)
        ahead = insertions(now)
    return ahead[""]


@pytest.mark.parametrize("seed", range(6))
def test_segment_against_a_table_of_states(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.choice([1, 2, 3, 5, 9, 14, 40])
        codes = [(rng.choice("ssuuuaaax"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]
        text = "".join(i + str(f) for i, f in codes)
        want = dynamic(codes)
        assert best_whole(list(align_segment(text, True))) == want
        cut = rng.randint(1, n)  # two segments give what one gives
        if cut < n:
            two = join_segments(list(align_segment(text[:2 * cut], True)), list(align_segment(text[2 * cut:], False)))
            assert best_whole(two) == want


def test_dynamic_table_against_every_edit():
    rng = random.Random(9)
    for _ in range(60):
        codes = tuple((rng.choice("suax"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 4)))
        assert dynamic(codes)[0] == cheapest(codes)[0]


def expected(rows):
    """What the query returns, by plain loops over one table of (conv, turn, role, text)."""
    said = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        mine.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes = set(), []
        for _, role, text in mine:
            bare = text.rstrip(BLANKS)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append((role[:1], fault))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = dynamic(codes)
        repaired, i, last = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else mine[i][1:]
            i += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            repaired.append(f"{role}:{text}")
        out[conv] = (gaps, *(sum(f == k for _, f in codes) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_query_on_the_tables(spark, folder):
    df = spark.read.parquet(f"{folder}/conversations.parquet")
    got = found(damaged_and_repaired(df))
    want = expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert got == want


@pytest.fixture(scope="module")
def odd_turns(spark):
    rng = random.Random(4)
    rows = [(None, None, None, None), (None, 1, "user", "x."), (None, None, "user", None), (1, None, None, ""), (1, 3, "", "a."), (1, 3, "tool", "b"), (2, 0, "système", "é."),
            (5, 0, "user", "long " * 50000), (6, 1, "user", "a?\n \t"), (6, 2, "assistant", "b."), (6, 2, "assistant", "b."), (6, 9, "assistant", " ")]
    rows += [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "c!", "", "d. "]) + str(rng.randint(0, 400)) + rng.choice(["", "."])) for i in range(900)]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                                 "conv_id long, turn long, role string, text string, audit string, cost int, conv string")


def test_odd_rows_and_a_long_conversation(odd_turns):
    got = found(damaged_and_repaired(odd_turns))
    want = expected([tuple(r)[:4] for r in odd_turns.collect()])
    assert got == want


def test_segments_do_not_change_the_result(odd_turns):
    numbered = numbered_turns(damage(odd_turns))
    whole = {r["__c"]: (r["cost"], r["audit"], r["illegal"]) for r in audits(numbered).collect()}
    assert whole == {r["__c"]: (r["cost"], r["audit"], r["illegal"]) for r in audits(numbered, 7).collect()}


def test_repaired_turns_follow_the_grammar(odd_turns):
    _, turns = repair_conversations(odd_turns)
    said = {}
    for r in turns.collect():
        said.setdefault(r["__c"], []).append((r["place"], r["role"][:1]))
    for mine in said.values():
        roles = "".join(x for _, x in sorted(mine))
        assert [p for p, _ in sorted(mine)] == list(range(len(mine)))
        assert roles.removeprefix("s").replace("ua", "") == "" and roles != "s"


def test_empty_table(odd_turns):
    assert damaged_and_repaired(odd_turns.limit(0)).collect() == []

"""Conversation repair against brute force over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest import MEDIUM, SMALL

from tidemark.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\f\r"


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        if not text.strip(WHITE):
            out.append(1)
        elif (role, text) in seen:
            out.append(2)
        else:
            out.append(0 if text.rstrip(WHITE)[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(turns, faults):
    """Least (cost, audit, repaired) over all edits with at most two inserts a gap."""
    best = None
    gaps = [["", "I", "II"]] * (len(turns) + 1)
    choices = [["D"] if f in (1, 2) else ["K", "R", "D"] for f in faults]
    for inserts in itertools.product(*gaps):
        if sum(map(len, inserts)) > 3:
            continue
        for letters in itertools.product(*choices):
            audit = inserts[0] + "".join(x + y for x, y in zip(letters, inserts[1:]))
            cost = 5 * audit.count("I") + audit.count("R") + 2 * audit.count("D") + 5 * sum(
                x != "D" and f == 3 for x, f in zip(letters, faults))
            if best and (cost, audit) >= best[:2]:
                continue
            rows, fixed = iter(turns), []      # (initials allowed, role or None, text)
            for x in audit:
                role, text = (None, "") if x == "I" else next(rows)
                if x != "D":
                    fixed.append((role if x == "K" else None, text))
            for free in itertools.product("ua", repeat=sum(r is None for r, _ in fixed)):
                names = iter(free)
                out = [(r if r is not None else {"u": "user", "a": "assistant"}[next(names)], t)
                       for r, t in fixed]
                if LEGAL.fullmatch("".join(r[:1] if r else "?" for r, _ in out)):
                    best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def plain(turns):
    """cost, audit and repaired text by a shortest path over (turn, place in the pattern)."""
    faults = faults_of(turns)
    moves = {("^", "s"): "s", ("^", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(0, "^"): (0, "", ())}
    for i in range(len(turns) + 1):
        for _ in range(2):
            for q in "^sua":
                if (i, q) in best:
                    x = "a" if q == "u" else "u"
                    cost, audit, out = best[i, q]
                    way = cost + 5, audit + "I", out + ({"u": "user:", "a": "assistant:"}[x],)
                    best[i, moves[q, x]] = min(best.get((i, moves[q, x]), way), way)
        if i == len(turns):
            break
        role, text = turns[i]
        extra = 5 if faults[i] == 3 else 0
        for q in "^sua":
            if (i, q) not in best:
                continue
            cost, audit, out = best[i, q]
            ways = [(q, (cost + 2, audit + "D", out))]
            if faults[i] not in (1, 2):
                x = "a" if q == "u" else "u"
                name = {"u": "user", "a": "assistant"}[x]
                ways.append((moves[q, x], (cost + 1 + extra, audit + "R", out + (f"{name}:{text}",))))
                if (q, role[:1]) in moves:
                    ways.append((moves[q, role[:1]],
                                 (cost + extra, audit + "K", out + (f"{role}:{text}",))))
            for after, way in ways:
                best[i + 1, after] = min(best.get((i + 1, after), way), way)
    cost, audit, out = min(best[len(turns), q] for q in "^a" if (len(turns), q) in best)
    return cost, audit, "\n".join(out)


def random_turns(r, n):
    return [(r.choice(["user", "assistant", "system", "tool", "user", "assistant"]),
             r.choice(["yes.", "no", " ", f"{r.random()}!", f"{r.random()}.", "what? \n"]))
            for _ in range(n)]


def parsed(turns):
    parser = cr.Parser()
    for (role, _), fault in zip(turns, faults_of(turns)):
        parser.read(role[:1], fault)
    cost, audit = parser.end()
    return cost, audit, "\n".join(cr.repaired_lines(audit, iter(turns)))


def test_short_conversations_against_all_edits():
    r = random.Random(1)
    for _ in range(150):
        turns = random_turns(r, r.randint(0, 4))
        assert parsed(turns) == cheapest(turns, faults_of(turns)), turns


def test_longer_conversations_against_a_shortest_path():
    r = random.Random(2)
    for _ in range(400):
        turns = random_turns(r, r.randint(0, 60))
        assert parsed(turns) == plain(turns), turns


def test_a_very_long_conversation_takes_few_distinct_steps():
    turns = random_turns(random.Random(3), 200_000)
    parser = cr.Parser()
    for (role, _), fault in zip(turns, faults_of(turns)):
        parser.read(role[:1], fault)
    cost, audit = parser.end()
    assert len(parser.known) < 500 and sum(x != "I" for x in audit) == len(turns)


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(key.encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out[conv] += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def expected(rows):
    want = {}
    for conv, turns in damaged(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [t[1:] for t in turns]
        faults = faults_of(pairs)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au")
                      for (a, _), (b, _) in zip(pairs, pairs[1:]))
        cost, audit, text = plain(pairs)
        want[conv] = (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit,
                      hashlib.sha256(text.encode()).hexdigest())
    return want


def query_rows(df):
    names = ("conv_id", "gaps", *cr.FAULTS, "illegal", "cost", "audit", "repaired_sha256")
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_query_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = query_rows(cr.op11_conversation_repair(spark, folder))
    assert got == expected(rows) and len(got) > 10


ODD = [(None, None, "user", "hello."), (None, 1, None, "x."), (1, 5, "user", None),
       (1, 5, "assistant", "same."), (1, 5, "assistant", "same."), (1, None, "system", "s."),
       (2, 9, "", "no role."), (2, 11, "user", "word " * 100_000 + "end."), (2, 12, "assistant", ""),
       (3, 1, "üser", "ß!\t")]


def test_odd_rows(spark, tmp_path):
    r = random.Random(4)
    rows = ODD + [(c, r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", None]),
                   r.choice(["a.", "b", None, "", "c!"])) for c in [None, *range(10, 200)]
                  for _ in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = df.selectExpr("*", *[f"'x' AS {c}" for c in (
        "conv", "present", "fault", "initial", "audit", "cost", "way", "copy", "own", "gaps")])
    extra.write.parquet(str(tmp_path / "conversations.parquet"))
    assert query_rows(cr.op11_conversation_repair(spark, str(tmp_path))) == expected(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    assert cr.op11_conversation_repair(spark, str(tmp_path)).collect() == []


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("c", 1, "user", "hi."), ("c", 2, "user", "again.")],
                               "c string, n int, who string, said string")
    told, rows = cr.repair(df, "c", "n", "who", "said")
    assert [(r.conv_id, r.cost, r.audit) for r in told.collect()] == [("c", 1, "KR")]
    want = hashlib.sha256(b"user:hi.\nassistant:again.").hexdigest()
    assert [tuple(r) for r in cr.repaired_hashes(told, rows).collect()] == [("c", want)]

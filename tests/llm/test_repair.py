import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tidewater.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, kind int, audit string"


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, must go, truncated) by Dijkstra's search over whole audits."""
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, out, lines = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit, lines
        state = i, out[-1:] if out else ""
        if state in done:  # a later audit is dearer or follows in order
            continue
        done.add(state)
        fits = lambda c: bool(re.fullmatch("s?(ua)*u?", out + c))
        for role in ("user", "assistant"):
            if fits(role[0]):
                heapq.heappush(queue, (cost + 3, audit + "I", i, out + role[0], (*lines, role + ":")))
        if i < len(rows):
            role, text, gone, truncated = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, out, lines))
            if not gone:
                if role and fits(role[:1]):
                    heapq.heappush(queue, (cost + 3 * truncated, audit + "K", i + 1, out + role[:1], (*lines, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if fits(to[0]):
                        heapq.heappush(queue, (cost + 3 + 3 * truncated, audit + "R", i + 1, out + to[0], (*lines, f"{to}:{text}")))


def brute(table):
    out = {}
    for conv_id in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv_id):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            end = text.strip(" \t\n\v\f\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
            if fault:
                n[fault] += 1
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = cheapest(faults)
        out[conv_id] = (gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_search_over_audits(spark, seed):
    r = random.Random(seed)
    table = [
        (c if c % 40 else None, r.choice([None, *range(9)]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["a.", "b?", "c", " \t", "d! \n", "é.x", "", None, "long. " * 500]))
        for c in range(120)
        for _ in range(r.randrange(1, 8))
    ]
    rows = repair.damaged(spark.createDataFrame([(*t, 7, "x") for t in table], SCHEMA))
    got = {x.conv_id: tuple(x)[1:] for x in repair.repair(rows).select("conv_id", *repair.COUNTS, "cost", "audit", "repaired_sha256").collect()}
    assert got == brute(table)


def test_long_conversations(spark):
    n = 30_000
    table = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(n)]
    rows = spark.createDataFrame([(*t, 7, "x") for t in table], SCHEMA)
    out = repair.repair(rows.selectExpr("conv_id", "turn", "role", "text", "false AS gone")).first()
    assert out.audit == "K" * n and out.cost == 0 and out.gaps == 0
    assert out.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in table).encode()).hexdigest()


def test_equal_costs_take_the_first_letters():
    assert repair.solve("") == ("", 0)
    assert repair.solve("u") == ("KI", 3)
    assert repair.solve("uu") == ("KR", 3)
    assert repair.solve("d" * 5) == ("DDDDD", 20)
    assert repair.solve("sua") == ("KKK", 0)
    assert repair.solve("xs")[1] == 6


def test_empty_table_and_dropped_rows(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = repair.repair(repair.damaged(spark.createDataFrame([(dropped, 0, "user", "a", 1, "")], SCHEMA))).first()
    assert tuple(out) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())

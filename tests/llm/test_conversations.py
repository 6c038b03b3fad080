import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from sourcewell.llm import conversations
from sourcewell.llm.conversations import END, START, costs, damage, edits, repair, repaired_rows
from sourcewell.llm.oracles import repair_sql

SCHEMA = "conv_id long, turn long, role string, text string, block int, said string"


def cheapest(rows):
    """rows of (role, text, fault): least cost, least audit of that cost, and its lines; by trying edits, cheapest first."""
    heap, best = [(0, "", 0, ())], None
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        initials = "".join(r[:1] for r, _ in out)
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best or (cost, audit, out), (cost, audit, out))
            continue
        for role in ("user", "assistant"):
            if len(audit) <= 2 * len(rows) + 1:
                heapq.heappush(heap, (cost + 2, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1]:  # a role without an initial adds nothing that the pattern could see
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, (role, text))))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, (*out, (to, text))))
    return best


def brute(rows, hurt=True):
    """The contract in plain Python, from (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if hurt else 9
        role, text = " " if role is None else role, " " if text is None else text
        own = found.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    result = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        told, seen = [], set()
        for _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        turns = {t for t, *_ in own if t is not None}
        count = [sum(f == x for *_, f in told) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, out = cheapest(told)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        result.append((str(conv), max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, sha))
    return sorted(result)


def result(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def made(rng, conv, n):
    turn = lambda i: rng.choice([i, i, i, i + rng.randint(0, 3), None])
    text = lambda: rng.choice(["Fine.", "Fine.", "Is it? \n", "cut off", "", " \t", None, "é!", f"{rng.random()}."])
    return [(conv, turn(i), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]), text(), 7, "clash") for i in range(n)]


def test_edits_are_the_cheapest_and_least(spark):
    rng = random.Random(12)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "x", rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(0, 5))]
        kinds = {"system": 1, "user": 2, "assistant": 3, "tool": 0}
        symbols = bytes(kinds[r] + {"": 0, "truncated": 8, "blank": 4}[f] for r, _, f in rows)
        cost, audit, _ = cheapest(rows)
        assert costs(symbols, END)[START] == cost
        assert "".join(e for _, e, _ in edits(symbols, END, START)) == audit


def test_long_conversations_need_few_vectors():
    rng = random.Random(3)
    symbols = bytes(rng.choice([0, 1, 2, 3, 3, 2, 10, 11, 4]) for _ in range(50_000))
    cost, state, rows = 0, START, 0
    for row, edit, state in edits(symbols, END, START):
        cost += {"K": 0, "R": 2, "D": 3, "I": 2}[edit] + (edit in "KR" and symbols[row] >> 3)
        rows += row >= 0
    assert rows == len(symbols) and cost == costs(symbols, END)[START] and not END[state]


def test_parts_compose():
    rng = random.Random(4)
    for _ in range(100):
        symbols = bytes(rng.choice([0, 1, 2, 3, 10, 11, 4]) for _ in range(30))
        cut = rng.randint(0, 30)
        tail = costs(symbols[cut:], END)
        first = list(edits(symbols[:cut], tail, START, last=False))
        state = first[-1][2] if first else START
        both = "".join(e for _, e, _ in first) + "".join(e for _, e, _ in edits(symbols[cut:], END, state))
        assert both == "".join(e for _, e, _ in edits(symbols, END, START))


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_query_equals_brute_force_and_sql(spark, parts):
    rng = random.Random(7)
    rows = [r for c in range(60) for r in made(rng, rng.choice([c, c, None]), rng.randint(1, 6))]
    rows += rows[:8] + made(rng, 1000, 40) + [(2000, t, "user", "Same.", 0, "") for t in [5] * 9 + [None] * 9]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # more parts: more conversations that go on in the next one
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(repair(damage(df)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert got == sorted((str(r[0]), *r[1:]) for r in con.execute(repair_sql()).fetchall())
    if parts == 1:
        sizes = Counter(r[0] for r in rows)
        small = {c for c in sizes if sizes[c] <= 5}
        want = brute([r for r in rows if r[0] in small])
        assert len(want) > 20 and [r for r in got if r[0] in {str(c) for c in small}] == want


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(1, i // 3, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", "No", f"{i}."]), 0, "") for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = result(repair(df.coalesce(1)))
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert conversations._first_pass(conversations._prepared(df), False).where("not whole").select("block").distinct().count() > 6
        assert result(repair(df)) == whole
        out = repaired_rows(df).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.place for r in out] == list(range(len(out))) and "".join(r.edit for r in out) == whole[0][7]
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in out if r.edit != "D"))


def test_empty_and_dropped(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, None, None, None, 0, "") for i in range(40)] + [(None, None, None, None, 0, "")]
    got = result(repair(damage(spark.createDataFrame(rows, SCHEMA))))
    assert got == brute(rows) and len(got) == 41
    gone = [r for r in got if not r[7]]
    assert gone and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "w " * 2_000_000 + "?", 0, ""), (1, 1, "assistant", "Yes.", 0, "")]
    assert result(repair(spark.createDataFrame(rows, SCHEMA))) == brute(rows, hurt=False)

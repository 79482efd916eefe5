import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from wardspark.llm import conversations as C

PROPER = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    """Fault of every (turn, role, text) row, in order."""
    seen, found = set(), []
    for _, role, text in rows:
        shown = text.strip(C.BLANKS)
        if not shown:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def every_edit(rows, most_inserts=2):
    """Cheapest (cost, initials, lines) of all edits, one by one."""
    put = [()] + [p for n in range(1, most_inserts + 1) for p in product(("user", "assistant"), repeat=n)]
    best = None

    def options(row, fault):
        yield 4, "D", None
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            yield more, "K", (row[1], row[2])
            for role in ("user", "assistant"):
                yield 3 + more, "R", (role, row[2])

    choices = []
    for row, fault in zip(rows, faults(rows)):
        choices += [[(3 * len(p), "I" * len(p), [(r, "") for r in p]) for p in put],
                    [(c, i, [line] if line else []) for c, i, line in options(row, fault)]]
    choices.append([(3 * len(p), "I" * len(p), [(r, "") for r in p]) for p in put])
    for chosen in product(*choices):
        lines = [line for _, _, part in chosen for line in part]
        if PROPER.fullmatch("".join(r[:1] for r, _ in lines)):
            option = (sum(c for c, _, _ in chosen), "".join(i for _, i, _ in chosen), lines)
            best = min(best, option) if best else option
    return best


def dijkstra(rows):
    """Cheapest edits by a search over (rows done, state) in order of cost and initials."""
    fault = faults(rows)
    after = {"": "su", "s": "u", "u": "a", "a": "u"}  # last initial: those that may follow
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, initials, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, initials, list(lines)
        for role in ("user", "assistant"):
            if role[0] in after[last]:
                heapq.heappush(heap, (cost + 3, initials + "I", i, role[0], (*lines, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, initials + "D", i + 1, last, lines))
            if fault[i] in ("", "truncated"):
                more = 3 * (fault[i] == "truncated")
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(heap, (cost + more, initials + "K", i + 1, role[0], (*lines, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in after[last]:
                        heapq.heappush(heap, (cost + 3 + more, initials + "R", i + 1, new[0], (*lines, (new, text))))


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def by_repair(rows, **limits):
    repair = C.Repair(**limits)
    for (_, role, text), fault in zip(rows, faults(rows)):
        repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    return repair.finish()


def draw_rows(draw, n):
    roles = draw.choice([["user", "assistant"], ["system", "user", "assistant"], ["tool", "user", "assistant", " ", "system"], ["tool"]])
    texts = draw.choice([["a.", "b?", "c!"], ["a", "b.", "", " ", "c"], [f"{k}." for k in range(50)], [f"{k}" for k in range(50)]])
    return [(t, draw.choice(roles), draw.choice(texts)) for t in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_of_all_edits(seed):
    draw = random.Random(seed)
    rows = draw_rows(draw, draw.randrange(4))
    cost, initials, lines = every_edit(rows)
    assert by_repair(rows) == (cost, initials, digest(lines)), rows


@pytest.mark.parametrize("seed", range(300))
def test_long_ones_against_a_search(seed):
    draw = random.Random(seed)
    rows = draw_rows(draw, draw.randrange(60))
    cost, initials, lines = dijkstra(rows)
    for limits in ({}, {"most_pending": 2}, {"most_bytes": 1}):
        assert by_repair(rows, **limits) == (cost, initials, digest(lines)), rows


def test_memory_is_bounded():
    """Ordinary conversations are emitted at once; two phases of one price are folded."""
    repair = C.Repair()
    for n in range(20_000):
        repair.row(("user", "assistant")[n % 2], f"{n}.", False, False)
    assert repair.most_held < 20
    cost, initials, _ = repair.finish()
    assert (cost, initials) == (0, "K" * 20_000)
    repair = C.Repair(most_pending=100)
    for n in range(20_001):
        repair.row("tool", f"{n}.", False, False)
    assert repair.most_held <= 101
    want = hashlib.sha256("\n".join(f"{('user', 'assistant')[n % 2]}:{n + 1}." for n in range(20_000)).encode())
    assert repair.finish() == (60_004, "D" + "R" * 20_000, want.hexdigest())


def damaged(rows):
    """conv_id -> rows after damage, in order."""
    found = {}
    for conv, turn, role, text in rows:
        plain = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = plain(role), plain(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        found.setdefault(conv, []).extend([(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {conv: sorted(rows, key=order) for conv, rows in found.items()}


def brute(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        turns = {t for t, _, _ in mine if t is not None}
        fault, initials = faults(mine), [r[:1] for _, r, _ in mine]
        cost, edits, lines = dijkstra(mine)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in C.LEGAL for a, b in zip(initials, initials[1:])), cost, edits, digest(lines),
        )
    return out


def test_damaged_conversations(spark):
    draw = random.Random(4)
    texts = ["yes.", "no!", "why?", "cut off", "", " \n", "été ", "tab.\t\x0b", "nb.\xa0", None, "long " * 3000 + "."]
    rows = []
    for conv in [None, *range(150)]:
        roles = ["system", *["user", "assistant"] * 12]
        for turn in range(draw.randrange(1, 25)):
            role = draw.choice([*[roles[turn]] * 6, "user", "tool", "", None])
            text = draw.choice([*texts, *[f"{draw.random()}."] * 10])
            rows.append((conv, draw.choice([*[turn] * 8, None, turn // 2]), role, text))
    rows += rows[5:15]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumn("copies", F.lit("x")).withColumn("blank", F.lit(3)).repartition(7)
    got = {r.conv_id: tuple(r[1:]) for r in C.repair_damaged(frame).collect()}
    assert got == brute(rows)
    assert any(r[6] == "" and r[7] == EMPTY for r in got.values())


def test_one_hot_conversation_over_batches(spark):
    """A conversation of many batches, with one text that recurs in a third of its turns."""
    rows = [(1, t, ("user", "assistant")[t % 2], "again." if t % 3 == 0 else f"{t}.") for t in range(30_000)]
    rows += [(2, t, "user", "x.") for t in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r[1:]) for r in C.repair_damaged(frame).collect()}
    want = {}
    for conv, mine in damaged(rows).items():
        fault = faults(mine)
        repair = C.Repair()
        for (_, role, text), f in zip(mine, fault):
            repair.row(role, text, f in ("blank", "duplicate"), f == "truncated")
        want[conv] = (fault.count("duplicate"), repair.finish())
    assert {c: (r[2], r[5:]) for c, r in got.items()} == want


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    out = C.repair_damaged(frame)
    assert out.collect() == [] and out.columns[0] == "conv_id"

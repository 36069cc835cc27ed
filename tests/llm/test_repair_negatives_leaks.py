"""Conversation repair, hard negatives and decontamination against brute force, with the odd cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import decontaminate, negatives, repair

# --- conversation repair ---------------------------------------------------------------------------------------------

SPACES, NEXT, NAME = " \t\n\x0b\x0c\r", {"0": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
TURNS = "conv_id long, turn long, role string, text string, key string, pos int, seg string"


def brute_repair(rows):
    """The digest of one conversation's rows (turn, role, text), in order, by the least (cost, edits) of every state, forward."""
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.strip(SPACES)
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))

    def closed(states):
        changed = True
        while changed:
            changed = False
            for q, (cost, edits, lines) in list(states.items()):
                n, v = NEXT[q], (cost + 3, edits + "I", [*lines, NAME[NEXT[q]] + ":"])
                if n not in states or v[:2] < states[n][:2]:
                    states[n], changed = v, True
        return states

    states = closed({"0": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def put(q, v, new=new):
            if q not in new or v[:2] < new[q][:2]:
                new[q] = v

        for q, (cost, edits, lines) in states.items():
            put(q, (cost + 4, edits + "D", lines))
            if fault not in ("b", "d"):
                more = 3 * (fault == "t")
                if role[:1] == NEXT[q] or (role[:1] == "s" and q == "0"):
                    put(role[:1], (cost + more, edits + "K", [*lines, f"{role}:{text}"]))
                put(NEXT[q], (cost + 3 + more, edits + "R", [*lines, f"{NAME[NEXT[q]]}:{text}"]))
        states = closed(new)
    cost, edits, lines = min(states[q] for q in ("0", "a") if q in states)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def damaged(conv, turn, role, text):
    told = lambda v: " " if v is None else str(v)
    kind, role, text = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20, told(role), told(text)
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def brute_conversations(rows):
    found = {}
    for conv, *row in rows:
        found.setdefault(conv, []).extend(damaged(conv, *row))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1][:64], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest())
    return {c: brute_repair(sorted(v, key=order)) for c, v in found.items()}


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(4)
    texts = ["Hi.", "Hello", "what?", " ", "", "A. \n", "x" * 70 + "1.", "x" * 70 + "0.", None, "yes! ", "no...\x0c", "漢字。", "ends. " + "so " * 20_000]
    rows = []
    for c in range(150):
        for t in range(r.randrange(1, 14)):
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ü", "sys"]), r.choice(texts)))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (-7, None, None, None)]
    return rows + [(900, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(3000)]  # a hot one


def test_repair(stored, conversations, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_BITS", 4)
    want = brute_conversations(conversations)
    for parts in (1, 5):
        df = stored([(*r, "k", 1, "s") for r in conversations], TURNS, parts)
        got = repair.repair_digests(repair.damage(df), df).collect()
        assert {x[0]: tuple(x[1:]) for x in got} == {c: w[:8] for c, w in want.items()} and len(got) == len(want)
    lines = {}
    for x in repair.repair(repair.damage(df)).collect():
        lines.setdefault(x.conv_id, {})[x.place] = f"{x.role}:{x.text}"
    assert {c: [v[k] for k in sorted(v)] for c, v in lines.items()} == {c: w[8] for c, w in want.items() if w[8]}


def test_repair_of_nothing(stored):
    empty = stored([], TURNS, 1)
    assert repair.repair_digests(repair.damage(empty), empty).count() == 0 == repair.repair(empty).count()
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = stored([(dropped, 0, "user", "gone.", "", 0, "")], TURNS, 1)
    assert [tuple(x) for x in repair.repair_digests(repair.damage(df), df).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_block_tables_agree_with_single_steps():
    r, tables, single = random.Random(9), repair.block_tables(), repair.BlockTables(1)
    assert len(tables.vectors) < 100
    for _ in range(300):
        symbols = "".join(r.choice("012345678") for _ in range(r.randrange(0, 23)))
        vector, off = tables.back(symbols, tables.last)
        other, other_off = single.back(symbols, single.last)
        assert [x + off for x in tables.vectors[vector]] == [x + other_off for x in single.vectors[other]]
        assert [tables.tell(symbols, tables.last, q) for q in range(4)] == [single.tell(symbols, single.last, q) for q in range(4)]


# --- hard negatives --------------------------------------------------------------------------------------------------


def brute_negatives(rows, low=80):
    known = [(i, [math.floor(256 * x) for x in e], label) for i, e, label, *_ in rows if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    for i, v, label in known:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, w, other in known if j != i and len(w) == len(v))
            for s, p, _ in [x for x in scored if x[2]][:5]:
                window = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s]
                out += [(i, p, rank, n, clamp(-s), clamp(-t)) for rank, (t, n, _) in enumerate(window[:5], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, row string, part int, windows int"


def test_negatives(stored, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(0, 1, (3, 6))
    rows = [(i, [float(x) for x in centres[i % 3] * r.choice([0.1, 1, 2]) + r.normal(0, 0.6, 6)], int(r.integers(0, 3))) for i in range(700)]
    rows += [(1000, rows[100][1], 0), (1001, rows[100][1], 1), (1002, rows[100][1], 1), (1100, [0.0] * 6, 1), (1200, None, 1), (1300, [1.0, None], 1), (1400, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (100, rows[100][1], rows[100][2])]
    rows += [(1500, [float("inf")] * 6, 2), (1600, [0.5, 0.25], 1), (1601, [0.5, 0.5], 1), (1602, [0.5, 0.2], 2), (1700, [], 1), (1800, [1.0] * 6, None)]
    rows += [(2000, [9e9, -3e12, 1.0], 1), (2001, [8e9, -3e12, 0.0], 1), (2002, [9e9, -2.7e12, 5.0], 0), (2003, [9e9, -2.7e12, 5.5], 0), (2004, [1e30, 0.0, 0.0], 1), (2005, [0.9e30, 0.0, 0.0], 0), (2006, [-1e30, 0.0, 7.0], 0)]
    table = stored([(*x, "x", 1, 2) for x in rows], VECTORS, 3)
    monkeypatch.setattr(negatives, "BLOCK", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    got = sorted(tuple(x) for x in negatives.mine_negatives(table, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_negatives(rows) and len(got) > 40
    assert negatives.mine_negatives(stored([], VECTORS, 1), F.col("vec_id") % 100 == 0).count() == 0
    one_label = stored([(x[0], x[1], 1, "x", 1, 2) for x in rows[:200]], VECTORS)
    assert negatives.mine_negatives(one_label, F.col("vec_id") % 100 == 0).count() == 0


def test_threshold_stops_early_without_loss():
    r = np.random.default_rng(3)
    v = np.floor(r.normal(0, 20, (2000, 8)))
    v[:40] *= 12
    lists, ids, a = np.argsort(v, axis=0, kind="stable").T.astype(np.uint16), np.arange(2000), np.floor(r.normal(0, 60, 8))
    score = v @ a
    top = float(np.sort(score)[-3])
    found, met = negatives.threshold_search(a, -1, v, ids, lists, [(-np.inf, np.inf), (0.8 * top, top)], 5)
    want = sorted((-s, i) for i, s in enumerate(score))
    assert found[0] == [(i, -s) for s, i in want[:5]]
    assert found[1] == [(i, -s) for s, i in want if 0.8 * top <= -s <= top][:5]
    assert met < 2000


# --- decontamination -------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, row string, row_ int, spans string, items int"


def tokens(text):
    return TOKEN.findall((text or "").translate(FOLD))


def brute_leaks(docs, items, window=10):
    windows = {}
    for i, text in items:
        w = tokens(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, found = tokens(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])] - {None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(8)
    word = lambda n=40: f"w{r.randrange(n)}"
    items = [(k, " ".join(word() for _ in range(r.choice([3, 8, 10, 14, 40])))) for k in range(30)]
    items += [(30, "é Ünder-score 漢字"), (31, None), (32, " .,;"), (33, items[3][1]), (3, items[3][1]), (None, " ".join(word() for _ in range(12))), (34, "the " * 15), (35, items[5][1].upper().replace(" ", "\n-- "))]
    docs = []
    for i in range(200):
        parts = [" ".join(word() for _ in range(r.randrange(0, 60)))]
        for _ in range(r.choice([0, 0, 1, 3])):
            w = tokens(r.choice(items)[1])
            a = r.randrange(0, max(1, len(w) - 5))
            parts.append(" ".join(w[a : a + r.choice([5, 9, 10, 11, 50])]))
            parts.append(" ".join(word() for _ in range(r.randrange(0, 8))))
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, " ?"), (5, docs[5][1]), (None, items[0][1]), (203, "the " * 400), (204, " ".join(word() for _ in range(5000)) + " " + " ".join(t or "" for _, t in items)), (205, "x É, ÜNDER score;漢字")]
    return docs, items


def test_leaks(stored, leaks, monkeypatch):
    docs, items = leaks
    table, bench = stored([(*d, "r", 1, "s", 2) for d in docs], DOCS, 3), stored(items, "item_id long, text string", 1)
    want = brute_leaks(docs, items)
    found = lambda: sorted((tuple(x) for x in decontaminate.find_contaminated(table, bench).collect()), key=repr)
    assert found() == want
    monkeypatch.setattr(decontaminate, "SHARD", 300)  # documents in pieces
    assert found() == want
    monkeypatch.setattr(decontaminate, "BLOCK", 60)  # items in several blocks
    assert found() == want
    left = decontaminate.remove_contaminated(table, bench)
    assert left.columns == table.columns
    assert sorted(map(repr, (x.doc_id for x in left.collect()))) == sorted(repr(x[0]) for x in want if not x[5])


def test_longest_matches(stored, leaks):
    docs, items = leaks
    items = [x for x in items if x[0] is not None][:20]
    table, bench = stored([(*d, "r", 1, "s", 2) for d in docs if d[0] is not None], DOCS, 2), stored(items, "item_id long, text string", 1)
    texts = {i: tokens(t) for i, t in docs}
    got = decontaminate.longest_matches(table, bench).collect()
    assert len(got) > 10
    for x in got:
        w = tokens(items[int(x.item_id)][1])[x.item_at :]
        assert texts[x.doc_id][x.doc_at : x.doc_at + x.length] == w[: x.length]
        longer = w[: x.length + 1]
        assert len(longer) == x.length or not any(t[k : k + len(longer)] == longer for t in texts.values() for k in range(len(t)))


def test_leaks_of_nothing(stored, leaks):
    docs, bench = stored([], DOCS, 1), stored(leaks[1], "item_id long, text string", 1)
    assert decontaminate.find_contaminated(docs, bench).count() == 0
    some = stored([(1, "a b c", "r", 1, "s", 2)], DOCS, 1)
    assert [tuple(x) for x in decontaminate.find_contaminated(some, bench.limit(0)).collect()] == [(1, 3, 0, 0, hashlib.sha256().hexdigest(), False)]


def test_suffix_order():
    r = random.Random(1)
    for n, k in ((0, 1), (1, 1), (50, 2), (400, 3), (300, 1)):
        ids = np.array([r.randrange(k) for _ in range(n)], np.int64)
        assert decontaminate.suffix_order(ids).tolist() == sorted(range(n), key=lambda i: ids[i:].tolist())

"""Cheapest repair of conversations' structure, by block tables after the Four Russians.

A repaired conversation's roles read (system? (user assistant)+)?, by their first letters. Keeping a row costs 0, setting its
role 3, deleting it 4, inserting an empty user or assistant row 3; a row whose text is cut off adds 3 unless it is deleted;
blank rows and repeats of an earlier role and text must go. Ties go to the ASCII-least list of edits (D < I < K < R).

The rules are an automaton of four states (nothing yet, after s, after u, after a). What the rest of a conversation costs from
each state is a vector; less its least entry it is one of a few dozen, whatever the conversation. So for every such
vector and every block of BLOCK symbols (a row's letter and fault) a table holds the vector before the block and what
was taken off. Conversations are worked from their end, a lookup a block, in segments of at most SEGMENT rows; the
vectors at the segments' ends are kept, and each block is expanded backward from its end when its edits are told, which
is what makes ties exact: an edit is the least whose cost and whose rest add up to the optimum.

Rows are sorted by range over the whole table, so that a conversation of any size is spread over tasks while faults are found;
its segments, then its texts, pass a task in order as a stream. Nothing of a conversation is held there but one segment's
symbols and the list of its edits, which is part of the result; the order in which its texts are joined is the one thing that
can't be divided.

Null roles and texts count as one space (a text without words, a role that can't be kept). Rows go by turn, nulls first;
of equal turns by role, the text's first 64 characters and its hash, so the result doesn't depend on the order of the
table, and repeated rows lie together. A null conv_id is a conversation of its own. Roles other than s..., u..., a... have no
letter that may be kept. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, drop_stash, received, share, stash

BLOCK, SEGMENT_BITS = 4, 12
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, S, U, A = range(4)
_NEXT = (U, U, A, U)  # the role that may follow, other than a first system
_SPACE = " \t\n\x0b\x0c\r"
_NONE, _BLANK, _AGAIN, _CUT = range(4)


def kept(state: int, letter: int) -> int | None:
    """The state after a row of this letter (0 s, 1 u, 2 a, 3 other) is kept."""
    if letter == 0:
        return S if state == START else None
    return letter + 1 if letter < 3 and _NEXT[state] == letter + 1 else None


class BlockTables:
    """Symbols are digits: 2 * letter + cut off, 8: must go. A vector is known by its number."""

    SYMBOLS = 9

    def __init__(self, block: int = BLOCK):
        self.block, self.vectors, self.number = block, [], {}
        self.last, _ = self._known((0, 2 * INSERT, INSERT, 0))
        self.step: list[list[tuple[int, int]]] = []  # by vector after, symbol: vector before, what was taken off
        self.edits: list[list[list[tuple[str, int]]]] = []  # by vector after, symbol, state: edits up to the row and with it, state after
        while len(self.step) < len(self.vectors):
            after = self.vectors[len(self.step)]
            before = [self._before(after, x) for x in range(self.SYMBOLS)]
            self.step.append([self._known(b) for b in before])
            self.edits.append([[self._told(before[x], after, x, q) for q in range(4)] for x in range(self.SYMBOLS)])
        # by vector after and block: all symbols of the block at once, last one first
        step = np.array(self.step)
        vector = np.repeat(np.arange(len(self.vectors))[:, None], self.SYMBOLS**block, 1)
        off = np.zeros_like(vector)
        blocks = list(product(range(self.SYMBOLS), repeat=block))
        digits = np.array(blocks)
        for k in reversed(range(block)):
            off += step[vector, digits[:, k], 1]
            vector = step[vector, digits[:, k], 0]
        self.jump, self.off = vector.astype(np.int32), off.astype(np.int32)
        self.blocks = {"".join(map(str, b)): i for i, b in enumerate(blocks)}

    def _known(self, costs) -> tuple[int, int]:
        least = min(costs)
        v = tuple(c - least for c in costs)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v], least

    @staticmethod
    def _options(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, state after) of what may be done with a row."""
        yield "D", DELETE, state
        if symbol < 8:
            more, to = TRUNCATED * (symbol & 1), kept(state, symbol >> 1)
            if to is not None:
                yield "K", more, to
            yield "R", REROLE + more, _NEXT[state]

    def _before(self, after, symbol: int) -> list[int]:
        base = [min(cost + after[to] for _, cost, to in self._options(symbol, q)) for q in range(4)]
        u, a = min(base[U], INSERT + base[A]), min(base[A], INSERT + base[U])
        return [min(base[START], INSERT + u), min(base[S], INSERT + u), u, a]

    def _told(self, before, after, symbol: int, state: int) -> tuple[str, int]:
        """The least edits in ASCII order among the cheapest, up to this row and with it."""
        edits = ""
        while True:
            due = before[state]
            choices = [(edit, to) for edit, cost, to in self._options(symbol, state) if cost + after[to] == due]
            if INSERT + before[_NEXT[state]] == due:
                choices.append(("I", None))
            edit, to = min(choices, key=lambda c: c[0])
            edits += edit
            if edit != "I":
                return edits, to
            state = _NEXT[state]

    def back(self, symbols: str, vector: int) -> tuple[int, int]:
        """The vector before the symbols, and what was taken off, from the one after them."""
        off, at = 0, len(symbols)
        while at >= self.block:
            b = self.blocks[symbols[at - self.block : at]]
            off += int(self.off[vector, b])
            vector, at = int(self.jump[vector, b]), at - self.block
        for x in reversed(symbols[:at]):
            vector, o = self.step[vector][int(x)]
            off += o
        return vector, off

    def tell(self, symbols: str, vector: int, state: int) -> list[tuple[str, int]]:
        """(edits, state after) of each row, from the vector after the symbols and the state before them."""
        ends, at = [vector], len(symbols)
        while at >= self.block:
            vector, at = int(self.jump[vector, self.blocks[symbols[at - self.block : at]]]), at - self.block
            ends.append(vector)
        out = []
        for begin, after in zip(range(at - self.block, len(symbols), self.block), reversed(ends)):
            part = [int(x) for x in symbols[max(0, begin) : begin + self.block]]
            afters = [after]
            for x in reversed(part[1:]):
                afters.append(self.step[afters[-1]][x][0])
            for x, v in zip(part, reversed(afters)):
                edits, state = self.edits[v][x][state]
                out.append((edits, state))
        return out if len(symbols) else []

    def close(self, state: int) -> str:
        """What is inserted behind the last row."""
        return {U: "I", S: "II"}.get(state, "")


@lru_cache(1)
def block_tables() -> BlockTables:
    return BlockTables()


_SYMBOL = str.maketrans({f"{4 * letter + fault:x}": str(8 if fault in (_BLANK, _AGAIN) else 2 * letter + (fault == _CUT)) for letter in range(4) for fault in range(4)})
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in their order over the whole table: key, pos, seg, turn, role, text, code, digest; stored."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    letter = F.coalesce(*(F.when(F.substring("role", 1, 1) == x, i) for i, x in enumerate("sua")), F.lit(3))
    fault = F.when(end == "", _BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), _NONE).otherwise(_CUT)
    known = rows.select(_key().alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    known = known.select("*", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("digest"), F.monotonically_increasing_id().alias("salt"))
    order = ("key", F.asc_nulls_first("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), "digest", "salt")
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order)
    pos = F.monotonically_increasing_id()  # the place in the order: partitions, then rows
    dealt = dealt.select("key", pos.alias("pos"), "turn", "role", "text", "digest", letter.alias("letter"), fault.alias("fault"))
    return stash(dealt).withColumn("seg", F.shiftright("pos", SEGMENT_BITS))


def _key():
    return F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))


def _segments(rows: DataFrame) -> DataFrame:
    """key, seg, codes (a hexadecimal digit for each row: 4 * letter + fault), min_turn, max_turn, n_turns."""
    first = rows.filter(F.col("fault") != _BLANK).groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    told = rows.select("key", "seg", "pos", "turn", "letter", "fault").join(first, "pos", "left")
    again = F.when((F.col("fault") != _BLANK) & F.col("first").isNull(), _AGAIN).otherwise(F.col("fault"))
    code = F.lower(F.hex(4 * F.col("letter") + again))
    gathered = F.array_sort(F.collect_list(F.struct("pos", code.alias("code"))))  # a segment's rows at most
    codes = F.array_join(F.transform(gathered, lambda x: x["code"]), "")
    return told.groupBy("key", "seg").agg(codes.alias("codes"), F.min("turn").alias("min_turn"), F.max("turn").alias("max_turn"), F.size(F.collect_set("turn")).cast("long").alias("n_turns"))


def _backward(shared):
    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, key, vector, off = received(shared), None, 0, 0
        for frame in frames:
            ends, costs = [], []
            for k, codes in zip(frame["key"], frame["codes"]):
                if k != key:
                    key, vector, off = k, tables.last, 0
                ends.append(vector)
                vector, o = tables.back(codes.translate(_SYMBOL), vector)
                off += o
                costs.append(off + tables.vectors[vector][START])
            yield frame.assign(vector=ends, cost=costs)

    return back


class _Conversation:
    """What is known of a conversation while its segments and rows pass."""

    def __init__(self, key: str, cost: int):
        self.key, self.cost, self.state, self.audit, self.rows, self.place = key, cost, START, [], iter(()), 0
        self.letter, self.turns, self.counts, self.hash = None, None, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), hashlib.sha256()

    def segment(self, tables: BlockTables, r) -> None:
        told = [edits for edits, _ in tables.tell(r.codes.translate(_SYMBOL), int(r.vector), self.state)]
        self.audit += told
        self.rows = iter(told)
        for x in r.codes:
            letter, fault = divmod(int(x, 16), 4)
            if fault:
                self.counts[("blank", "duplicate", "truncated")[fault - 1]] += 1
            self.counts["illegal"] += self.letter is not None and (self.letter, letter) not in _LEGAL
            self.letter = letter
        if not pd.isna(r.min_turn):
            low, high, n = int(r.min_turn), int(r.max_turn), int(r.n_turns)
            self.turns = (low, high, n) if self.turns is None else (self.turns[0], high, self.turns[2] + n - (low == self.turns[1]))

    def lines(self, edits: str, role: str = "", text: str = "") -> Iterator[tuple[int, str, str, str]]:
        """(place, edit, role, text) of the rows that the edits of a row leave, in order."""
        for e in edits:
            if e != "D":
                self.state = kept(self.state, "sua".index(role[0])) if e == "K" else _NEXT[self.state]
                yield self.place, e, role if e == "K" else "user" if self.state == U else "assistant", "" if e == "I" else text
                self.place += 1


def _forward(shared, give_rows: bool):
    """A stream of segments (pos -1) and their rows, by key and segment: the repaired rows, or a digest for each conversation."""

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, now, out = received(shared), None, []

        def put(edits: str, *row) -> None:
            for place, edit, role, text in now.lines(edits, *row):
                if give_rows:
                    out.append((now.key, place, edit, role, text))
                else:
                    now.hash.update((("\n" if place else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))

        def close() -> None:
            if now is not None:
                edits = tables.close(now.state)
                put(edits)
                if not give_rows:
                    t = now.turns
                    out.append((now.key, t[1] - t[0] + 1 - t[2] if t else 0, *now.counts.values(), now.cost, "".join(now.audit) + edits, now.hash.hexdigest()))

        columns = [c.split(" ")[0] for c in (_LINES if give_rows else _DIGEST).split(", ")]
        for frame in frames:
            for r in frame.itertuples(index=False):
                if now is None or r.key != now.key:
                    close()
                    now = _Conversation(r.key, 0 if pd.isna(r.cost) else int(r.cost))
                if r.pos < 0:
                    now.segment(tables, r)
                else:
                    put(next(now.rows), r.role, r.text)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return forward


_LINES = "key string, place long, edit string, role string, text string"
_DIGEST = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _run(conversations: DataFrame, give_rows: bool) -> DataFrame:
    spark = conversations.sparkSession
    shared = share(spark, block_tables())  # of fixed size
    rows = _ordered(conversations)
    with batches_of(spark):
        segments = _segments(rows).repartition("key").sortWithinPartitions("key", F.desc("seg"))
        ends = stash(segments.mapInPandas(_backward(shared), "key string, seg long, codes string, min_turn long, max_turn long, n_turns long, vector int, cost long"))
        heads = ends.withColumn("pos", F.lit(-1).cast("long"))
        stream = rows.select("key", "seg", "pos", "role", "text").unionByName(heads, allowMissingColumns=True)
        stream = stream.repartition("key").sortWithinPartitions("key", "seg", "pos")
        out = stash(stream.mapInPandas(_forward(shared, give_rows), _LINES if give_rows else _DIGEST))
    drop_stash(rows)
    drop_stash(ends)
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit (K kept, R role set, I inserted), role, text. Conversations that are
    deleted whole have none."""
    names = conversations.select("conv_id", _key().alias("key")).distinct()
    return names.join(_run(conversations, True), "key").select("conv_id", "place", "edit", "role", "text")


def repair_digests(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Per conversation, those of `every` (a table with conv_id) that have no rows included: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, and the SHA-256 of the repaired rows as role:text, joined by newlines."""
    names = (every if every is not None else conversations).select("conv_id", _key().alias("key")).distinct()
    out = names.join(_run(conversations, False), "key", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes out its full stops
    and marks, 3 repeats it, 4 makes its role user. Nulls count as one space. conv_id, turn, role, text."""
    told = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


#: crc32 bit by bit; states z, s, u, a hold the least (cost, audit, lines) of all rows so far, one row a round.
ORACLE = """
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
d AS MATERIALIZED (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(id, ''), lambda c: ascii(c)::BIGINT), lambda h, c: list_reduce([xor(h, c)] || range(8), lambda b, i: xor(b >> 1, 3988292384::BIGINT * (b & 1)))), 4294967295::BIGINT) % 20 AS kind FROM k),
m AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 64), substr(text, 1, 64), sha256(length(role)::VARCHAR || ':' || role || ':' || text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM m),
r AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS c, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM o),
w(conv_id, i, z, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}, NULL::STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR[]), {'cost': 3::BIGINT, 'audit': 'I', 'lines': ['user:']}, {'cost': 6::BIGINT, 'audit': 'II', 'lines': ['user:', 'assistant:']} FROM r
  UNION ALL
  SELECT conv_id, i, z, s, u, list_min([a, {'cost': u.cost + 3, 'audit': u.audit || 'I', 'lines': u.lines || ['assistant:']}]) FROM (
    SELECT conv_id, i, z, s, a, list_min(list_filter([u, CASE WHEN z IS NOT NULL THEN {'cost': z.cost + 3, 'audit': z.audit || 'I', 'lines': z.lines || ['user:']} END, CASE WHEN s IS NOT NULL THEN {'cost': s.cost + 3, 'audit': s.audit || 'I', 'lines': s.lines || ['user:']} END, {'cost': a.cost + 3, 'audit': a.audit || 'I', 'lines': a.lines || ['user:']}], lambda x: x IS NOT NULL)) AS u FROM (
      SELECT conv_id, i, {'cost': z.cost + 4, 'audit': z.audit || 'D', 'lines': z.lines} AS z,
        list_min(list_filter([CASE WHEN s IS NOT NULL THEN {'cost': s.cost + 4, 'audit': s.audit || 'D', 'lines': s.lines} END, CASE WHEN stays AND c = 's' THEN {'cost': z.cost + p, 'audit': z.audit || 'K', 'lines': z.lines || [line]} END], lambda x: x IS NOT NULL)) AS s,
        list_min([{'cost': u.cost + 4, 'audit': u.audit || 'D', 'lines': u.lines}] || CASE WHEN stays THEN list_transform(list_filter([z, s, a], lambda x: x IS NOT NULL), lambda x: {'cost': x.cost + p + CASE c WHEN 'u' THEN 0 ELSE 3 END, 'audit': x.audit || CASE c WHEN 'u' THEN 'K' ELSE 'R' END, 'lines': x.lines || [CASE c WHEN 'u' THEN line ELSE 'user:' || text END]}) ELSE [] END) AS u,
        list_min([{'cost': a.cost + 4, 'audit': a.audit || 'D', 'lines': a.lines}] || CASE WHEN stays THEN [{'cost': u.cost + p + CASE c WHEN 'a' THEN 0 ELSE 3 END, 'audit': u.audit || CASE c WHEN 'a' THEN 'K' ELSE 'R' END, 'lines': u.lines || [CASE c WHEN 'a' THEN line ELSE 'assistant:' || text END]}] ELSE [] END) AS a
      FROM (SELECT w.conv_id, r.i, z, s, u, a, c, text, role || ':' || text AS line, f NOT IN ('b', 'd') AS stays, CASE f WHEN 't' THEN 3 ELSE 0 END AS p FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1)))),
l AS (SELECT conv_id, list_min([z, a]) AS best FROM w QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r) GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN n ON q.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN l ON q.conv_id IS NOT DISTINCT FROM l.conv_id
"""

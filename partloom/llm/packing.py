"""Packing token streams into sequences of bounded length, by dynamic programming that keeps the documents' order.

Each input partition is one stream: its documents in their order, nothing shuffled. The stream is held a segment at a
time (SEGMENT tokens, or one document where that is longer). Windows may be cut at document ends (no penalty), after
sentence ends, or anywhere (on a grid inside long sentences); the cuts minimise padding + penalties + a charge for each
window. For cut i and an earlier cut j within the capacity

    cost[i] = min_j(cost[j] + position[j]) + capacity - position[i] + penalty[i] + charge,

so the best j is the front of a monotone queue. A window whose length is a power of two needs no padding; those
transitions are looked up by position. The last, unfinished window of a segment opens the next one.

Nulls: a null text is an empty document (its end id alone); a null doc_id is kept. Repeated rows are documents of
their own. Very long documents are spread over as many sequences as they need. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
SEGMENT, GRID, LEAST, MEMO = 1 << 18, 128, 512, 600_000

#: ASCII without the apostrophe, and the letters of Latin-1: text on which lower-casing and cutting between letters and
#: other characters commute with the tokenizer's own normalizing and cutting.
_PLAIN = re.compile(r"[\x00-\x26\x28-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
_PIECE = re.compile(r"[a-z\xDF-\xF6\xF8-\xFF]+|[^\x20\x09-\x0Da-z\xDF-\xF6\xF8-\xFF]+")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for the UTF-8 bytes of each character up to 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    letter = {b: chr(b) for b in seen} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_LETTERS = _byte_letters()


class _Missing(dict):
    """piece -> ids as little-endian bytes, in two generations: a piece of the older one comes back when it is asked for, so frequent
    ones stay. Remembers the pieces that both lack."""

    def __init__(self):
        super().__init__()
        self.lacking: set[str] = set()
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        raw = self.older.get(piece, b"")
        if raw:
            self[piece] = raw
        else:
            self.lacking.add(piece)
        return raw

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


def encoder_of(path: str) -> WordEncoder:
    """One encoder for each Python worker: its memo serves the worker's later partitions too."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("partloom_encoders", {})
    return kept.setdefault(path, None) or kept.__setitem__(path, WordEncoder(path)) or kept[path]


class WordEncoder:
    """Ids of the tokenizer file for whole texts, from a memo of pieces that the tokenizer never joins.

    The tokenizer drops white space and never lets a token span it, so a text's ids are those of its chunks in turn.
    Plain text is cut further, between letters and the rest. A full memo lets go of what wasn't asked for lately, which changes no result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.memo = _Missing()
        # Whether a word of plain letters is no more to this tokenizer than its bytes are to its model.
        self.model = self.tokenizer.model
        letters = [chr(c) for c in range(256) if chr(c).islower() and _PLAIN.fullmatch(chr(c))]
        probe = [*letters, "".join(letters), *(a + b for a in letters for b in "as\xe9")]
        self.direct = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe] == [self._word(w) for w in probe]

    def _word(self, word: str) -> list[int]:
        word = word.lower()
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(_LETTERS))]

    def _learn(self) -> None:
        words = [w for w in self.memo.lacking if w.isalpha() and _PLAIN.fullmatch(w)]
        other = list(self.memo.lacking.difference(words))
        self.memo.lacking.clear()
        for at in range(0, len(words), 4096):  # letters only: each word is one piece, whose last token ends a word
            some = words[at : at + 4096]
            coded = chain.from_iterable(map(self._word, some)) if self.direct else self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids
            ids = np.array(list(coded), "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                other += some
                continue
            raw, begin = ids.tobytes(), 0
            for word, stop in zip(some, (stops * 4).tolist()):
                self.memo[word] = raw[begin:stop]
                begin = stop
        for piece, coded in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False) if other else ()):
            self.memo[piece] = np.array(coded.ids, "<u4").tobytes()

    @staticmethod
    def pieces(text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _PIECE.findall(text.lower())
        return _CHUNK.findall(text)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.memo) > MEMO // 2:
            self.memo.age()
        cut = [self.pieces(t) for t in texts]
        coded = [list(map(self.memo.__getitem__, pieces)) for pieces in cut]
        if self.memo.lacking:
            self._learn()
        for pieces, found in zip(cut, coded):
            if b"" in found:
                found = map(self.memo.__getitem__, pieces)
            yield np.frombuffer(b"".join(found), "<u4")


def choose_cuts(position: list[int], penalty: list[float], capacity: int, charge: float, least: int) -> list[int]:
    """Indices of the cuts of least cost; position starts at 0, rises, and no gap exceeds capacity.

    Windows of a power of two, from least on, need no padding.
    """
    n = len(position)
    cost, back = [0.0] * n, [0] * n
    free = [1 << k for k in range(capacity.bit_length()) if least <= 1 << k < capacity]
    at = {p: i for i, p in enumerate(position)}
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for i in range(1, n):
        here = position[i]
        while position[queue[0][1]] < here - capacity:
            queue.popleft()
        key, j = queue[0]
        best = key + capacity - here
        for p in free:
            k = at.get(here - p)
            if k is not None and cost[k] < best:
                best, j = cost[k], k
        best += penalty[i] + charge
        cost[i], back[i] = best, j
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    cuts, i = [], n - 1
    while i:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


def pack_stream(documents, capacity: int, is_stop: np.ndarray, sentence: float, inside: float, charge: float, segment: int = SEGMENT):
    """documents: (doc_id, ids) in order. Yields windows: lists of (doc_id, start, ids of the piece, document's length)."""
    held: list[tuple] = []
    total = 0

    def windows(last: bool):
        nonlocal held, total
        if not total:
            return
        ids = np.concatenate([p[2] for p in held])
        ends = np.cumsum([len(p[2]) for p in held])
        cost = np.full(total + 1, inside)
        spot = np.zeros(total + 1, bool)
        spot[::GRID] = True
        if last:  # the tail may be cut into powers of two
            spot[[total - (1 << k) for k in range(total.bit_length())]] = True
        soft = np.flatnonzero(is_stop[ids]) + 1
        spot[soft], cost[soft] = True, sentence
        spot[ends], cost[ends] = True, 0.0
        position = np.flatnonzero(spot)
        cuts = choose_cuts(position.tolist(), cost[position].tolist(), capacity, charge, LEAST if not last else 1)
        cuts = position[cuts].tolist()
        if not last:
            cuts.pop()  # the last window isn't full yet
        begin = 0
        pieces = deque(held)
        for cut in cuts:
            window, need = [], cut - begin
            while need:
                doc, start, ids, size = pieces[0]
                take = min(need, len(ids))
                window.append((doc, start, ids[:take], size))
                need -= take
                if take == len(ids):
                    pieces.popleft()
                else:
                    pieces[0] = (doc, start + take, ids[take:], size)
            begin = cut
            yield window
        held, total = list(pieces), total - begin

    for doc, ids in documents:
        held.append((doc, 0, ids, len(ids)))
        total += len(ids)
        if total >= segment:
            yield from windows(False)
    yield from windows(True)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, sentence: float = 24.0, inside: float = 96.0, charge: float = 32.0) -> DataFrame:
    """One row per piece, SCHEMA above. sequence_id is the partition's number and the window's number in it.

    tokenizer_path: a tokenizers file whose end-of-word suffix is </w>. Penalties and the charge are in tokens.
    """
    small_batches(docs.sparkSession)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer_path)
        stops = [encoder.tokenizer.token_to_id(t) for t in (".</w>", "!</w>", "?</w>", "!!</w>", ".\"</w>", "...</w>")]
        is_stop = np.isin(np.arange(max(encoder.ends.size, end_id + 1)), [i for i in stops if i is not None])
        first = TaskContext.get().partitionId() << 32

        def documents():
            for frame in frames:
                texts = [t or "" for t in frame["text"]]
                ids = frame["doc_id"].tolist()
                for at in range(0, len(texts), 200):
                    for doc, coded in zip(ids[at : at + 200], encoder(texts[at : at + 200])):
                        yield doc, np.append(coded, np.uint32(end_id))

        rows: list[tuple] = []
        stream = pack_stream(documents(), capacity, is_stop, sentence, inside, charge)
        for number, window in enumerate(stream):
            offset, size = 0, sum(len(p[2]) for p in window)
            for doc, start, ids, whole in window:
                rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), whole, first + number, offset, size))
                offset += len(ids)
            if len(rows) >= 20_000:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(pack, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    return frame.assign(doc_id=pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], dtype="Int64"))

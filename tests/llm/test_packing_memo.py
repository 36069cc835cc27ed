"""The encoder's memo of pieces: its size changes no ids, and a corpus of many rare words doesn't drive out what comes again."""

import random

import pytest

pytest.importorskip("tokenizers")
from partloom.llm import packing as P  # noqa: E402
from partloom.llm.queries import tokenizer_path  # noqa: E402


def test_memo_size_changes_no_ids_and_holds_many_words(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(240_000)]
    texts = [" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)]
    big = P.WordEncoder(tokenizer_path())
    first = [x.tobytes() for i in range(0, len(texts), 10) for x in big(texts[i : i + 10])]
    learned = []
    monkeypatch.setattr(P.WordEncoder, "_learn", lambda self, learn=P.WordEncoder._learn: (learned.append(len(self.memo.lacking)), learn(self)))
    again = [x.tobytes() for i in range(0, 20, 10) for x in big(texts[i : i + 10])]
    assert again == first[:20] and not learned
    monkeypatch.setattr(P, "MEMO", 5000)
    small = P.WordEncoder(tokenizer_path())
    assert [x.tobytes() for i in range(0, 40, 10) for x in small(texts[i : i + 10])] == first[:40]

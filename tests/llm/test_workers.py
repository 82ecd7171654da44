"""What Python workers hold between tasks."""

import pyarrow as pa

from territoria.llm import common, packing, queries


def test_words_at_hand_stay_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    words, alone = packing.Words(queries.tokenizer()), []
    monkeypatch.setattr(words, "tokenizer", Spy(words.tokenizer, alone))
    for k in range(20):
        text = "the same words " + " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(20))
        assert packing.encoded([text], words) == [Spy(words.tokenizer.own, []).ids(text)]
        assert len(words.known) <= 50 + 23
    assert sum("same" in x.split() for x in alone) == 1  # frequent words are encoded once


class Spy:
    def __init__(self, own, seen):
        self.own, self.seen = own, seen

    def encode(self, text, **options):
        self.seen.append(text)
        return self.own.encode(text, **options)

    def ids(self, text):
        return b"".join(x.to_bytes(4, "little") for x in self.own.encode(text, add_special_tokens=False).ids)


def test_workers_give_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(common, "_trim", lambda: done.append)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    out = common.giving_back(lambda batches: (b.slice(1) for b in batches))(iter([batch, batch]))
    assert next(out).num_rows == 1 and not done
    assert len(list(out)) == 1 and done == [0]


def test_words_used_again_stay_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    words, alone = packing.Words(queries.tokenizer()), []
    monkeypatch.setattr(words, "tokenizer", Spy(words.tokenizer, alone))
    for k in range(40):
        often = "these are often used" if k % 2 else ""
        text = f"{often} " + " ".join(f"w{chr(97 + k // 20)}{chr(97 + k % 20)}{chr(97 + j)}" for j in range(10))
        assert packing.encoded([text], words) == [words.alone(text)]
        assert len(words.known) <= 50
    assert sum("often" in x.split() for x in alone) <= 2  # once, and again at most if the memory filled before its second use


def test_words_skip_what_was_done_with_their_text():
    words = packing.Words(queries.tokenizer())
    allowed = [c for c in map(chr, range(0x1F650)) if not packing.OTHER.search(c) and c not in packing.ODD_SPACE]
    texts = [f"{a}b{c}1{c}{c} {c} {c},! {c}'s{c.upper()}x" for c in allowed for a in ("", "é'") if len(c.upper()) == 1 and not packing.OTHER.search(c.upper())]
    assert len(texts) >= 1300
    assert packing.encoded(texts, words) == [words.alone(x) for x in texts]
    assert "whole" in words.__dict__
    fresh = packing.Words(queries.tokenizer())
    packing.encoded(texts, fresh)
    assert "whole" not in fresh.__dict__  # none of them needed the tokenizer with its normalizer

import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import packing
from tests.llm.tables import no_documents, odd_documents


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(60, 90))
def test_windows_hold_each_size_once_within_capacity(sizes, capacity):
    parts = packing.windows(sizes, capacity)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= capacity for p in parts)


def test_differencing_balances():
    parts = packing.differencing([8, 7, 6, 5, 4], 2)
    sizes = [8, 7, 6, 5, 4]
    assert abs(sum(sizes[i] for i in parts[0]) - sum(sizes[i] for i in parts[1])) <= 2


def stated_ids(texts):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_odd_documents_round_trip(spark):
    docs = odd_documents(spark).coalesce(1)
    pieces = packing.pack(docs, packing.default_tokenizer(), capacity=128).collect()
    want = sorted((str(r.doc_id), ids) for r, ids in zip(docs.select("doc_id", "text").collect(), stated_ids([r.text for r in docs.select("text").collect()])))
    assert sum(p.length for p in pieces) == sum(len(i) for _, i in want)
    by = {}
    for p in pieces:
        by.setdefault((str(p.doc_id), p.doc_tokens), []).append((p.start, list(struct.unpack(f"<{p.length}I", p.ids))))
    for d, ids in want:
        found = sorted(by[(d, len(ids))])
        copies = sum(1 for x in want if x[0] == d and len(x[1]) == len(ids))
        whole = {}
        for start, part in found:
            for k, x in enumerate(part):
                whole.setdefault(start + k, []).append(x)
        assert sorted(whole) == list(range(len(ids)))
        assert all(len(v) == copies for v in whole.values())
        assert [v[0] for _, v in sorted(whole.items())] == ids
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 128
    digests = packing.digest(packing.pack(docs, packing.default_tokenizer(), capacity=128)).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(p.ids) for p in pieces)
    assert packing.pack(no_documents(spark), packing.default_tokenizer()).count() == 0


def test_words_give_the_tokenizer_s_ids():
    texts = ["Hello WORLD, it's 3.14!", "a<|endoftext|>b <|startoftext|>", "Çà été ÄÖ ß naïve x", "tab\tnew\nline\x0b\x0c", "...!? don't 'tis x2y", None, "日本語 テキスト", "\x1codd\x85space here"]
    got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in packing.WordTokenizer(packing.default_tokenizer()).ids(texts)]
    assert got == [x[:-1] for x in stated_ids(texts)]


def test_little_padding(spark):
    rows = [(i, "word " * (50 + i * 37 % 900)) for i in range(400)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), packing.default_tokenizer()).collect()
    used = sum(p.length for p in pieces)
    assert used >= 0.97 * 2048 * len({p.sequence_id for p in pieces})


class Odd:
    """A tokenizer for which words aren't apart: the ids depend on what stands before."""

    def get_vocab(self):
        return {"a</w>": 0, "b": 1000}

    def encode_batch_fast(self, texts, add_special_tokens):
        assert add_special_tokens is False
        return [type("E", (), {"ids": [(i + ord(c)) % 1000 for i, c in enumerate(t)]}) for t in texts]


def test_another_kind_of_tokenizer_gets_whole_texts(monkeypatch):
    import tokenizers

    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_file": staticmethod(lambda path: Odd())}))
    words = packing.WordTokenizer("x")
    assert not words.by_word
    texts = ["one two", None, "", "a\tb <| c"]
    assert list(words.ids(texts)) == [struct.pack(f"<{len(t or '')}I", *((i + ord(c)) % 1000 for i, c in enumerate(t or ""))) for t in texts]


def test_the_given_tokenizer_is_looked_up_by_word():
    assert packing.WordTokenizer(packing.default_tokenizer()).by_word

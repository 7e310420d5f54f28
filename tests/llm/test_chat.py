import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import chat

TEXT = st.text(alphabet="ab\\<|>\nimstartend_é ", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>"]), TEXT), min_size=1, max_size=8))
def test_examples_read_back_exactly(turns):
    examples = list(chat.expand(1, turns))
    assert [e for e in examples if e.is_last] == examples[-1:]
    assert list(chat.read_back(examples[-1].formatted)) == turns
    replies = [t for r, t in turns if r == "assistant"]
    masked = [chat.unescape(e.formatted[e.loss_start : e.loss_end]) for e in examples if turns[-1][0] == "assistant" or not e.is_last]
    assert masked == replies
    k = 0
    for i, (role, _) in enumerate(turns):
        if role == "assistant":
            assert list(chat.read_back(examples[k].formatted)) == turns[: i + 1]
            k += 1
    parts = list(chat.pieces(1, turns))
    assert len(parts) == len(turns) and "".join(p.piece for p in parts) == examples[-1].formatted
    assert [p.start for p in parts] == [sum(len(q.piece) for q in parts[:i]) for i in range(len(parts))]
    (row,) = chat.digests(iter(parts))
    assert row[5] == sum(len(e.formatted) for e in examples)
    assert row[1] == len(turns) and row[3] == sum(map(len, replies))
    assert row[2] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert row[4] == hashlib.sha256("".join(replies).encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, "user", "n"), (2, 0, None, ""), (3, None, "assistant", "late"), (3, 0, "user", "q" * 100_000), (4, 0, "system", "s")]
    frame = spark.createDataFrame([(*r, "1", "2") for r in rows], "conv_id long, turn long, role string, text string, formatted string, example string")
    got = {r.conv_id: r for r in chat.conversation_digests(frame).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1, 3: 2, 4: 1}
    assert got[1].loss_chars == 2 and got[4].loss_chars == 0
    examples = chat.format_examples(frame)
    assert examples.where("conv_id = 1").count() == 2
    assert chat.conversation_digests(frame.limit(0)).count() == 0
    pieces = chat.format_pieces(frame)
    assert pieces.count() == len(rows)
    for e in examples.where("conv_id IS NOT NULL").collect():
        own = sorted(pieces.where(f"conv_id = {e.conv_id} AND start < {len(e.formatted)}").collect(), key=lambda p: p.start)
        assert "".join(p.piece for p in own) == e.formatted
        assert (own[-1].example, own[-1].loss_start, own[-1].loss_end, own[-1].is_last) == (e.example, e.loss_start, e.loss_end, e.is_last)


def test_a_long_conversation_is_linear():
    turns = (("assistant" if i % 2 else "user", "x" * 1000) for i in range(100_000))
    (row,) = chat.digests(chat.pieces(7, turns))
    each = [1000 + len(chat.START) + len(chat.END) + 2 + len(r) for r in ("user", "assistant")]
    assert row[1] == 100_000 and row[3] == 50_000_000 and row[5] == sum(each) * 50_000 * 50_001 // 2

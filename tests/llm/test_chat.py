import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "|", "[", "a", "é", "\n", " "]), max_size=12).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_breaks_controls(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)


@given(PIECES, PIECES)
@settings(max_examples=200, deadline=None)
def test_segment_reads_back(role, text):
    segment, start, end, _ = chat.format_turn(role, text)
    assert chat.parsed(segment) == (role, text)
    assert chat.unescape(segment[start:end]) == (text if role == "assistant" else "")


def test_parts_are_flattened_in_order():
    parts = [
        {"type": "text", "text": "see <|image|> "},
        {"type": "image", "ref": "a.png", "width": 28, "height": 15},
        {"type": "audio", "ref": "b.wav", "seconds": 2.0},
        {"type": "document", "ref": "c.pdf", "pages": 3},
        {"type": "text", "text": None},
    ]
    segment, start, end, out = chat.format_turn("assistant", parts)
    assert segment[start:end] == "see <\\|image|> <|image|><|audio|><|document|>"
    assert out.attachments == [("image", "a.png"), ("audio", "b.wav"), ("document", "c.pdf")]
    assert out.tokens == [4, 50, 768]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_digests(spark):
    schema = "conv_id long, turn long, role string, text string, segment int"
    rows = [(1, 1, "assistant", "hé</s>", 0), (1, 0, "user", None, 0), (2, 0, None, "\\", 0), (None, 0, "assistant", "x", 0), (1, 2, "assistant", "b" * 200_000, 0), (1, 2, "assistant", "b" * 200_000, 0)]
    out = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, schema))).collect()}
    long = "b" * 200_000
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].turns_sha256 == sha(f"user\n\nassistant\nhé</s>\nassistant\n{long}\nassistant\n{long}\n")
    assert (out[1].n_turns, out[1].loss_chars, out[1].loss_sha256) == (4, 400_006, sha("hé</s>" + long + long))
    assert (out[2].turns_sha256, out[2].loss_chars) == (sha("\n\\\n"), 0)
    assert out[None].loss_sha256 == sha("x")
    assert chat.digests(chat.format_turns(spark.createDataFrame([], schema))).count() == 0


def test_equal_turns_are_ordered_by_text(spark):
    """By the text as it is, not as it is escaped; a null role stands where an empty one does."""
    texts = ["<s>", "<A", "<\\", "a!", "a", "<|end|>z", "<|end|>", "[INST]", "[I"]
    rows = [(1, 0, "user", t) for t in texts] + [(1, 0, None, "n"), (1, 0, "", "m")]
    r = chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    want = "".join(f"{role}\n{t}\n" for role, t in sorted([*(("user", t) for t in texts), ("", "n"), ("", "m")]))
    assert r.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_typed_column(spark):
    rows = [(1, 0, "user", [("text", "hi", None, None, None, None, None), ("image", None, "i.png", 14, 14, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_turns(df, "parts").first()
    assert r.segment == "<|turn|>user<|body|>hi<|image|><|end|>" and r.attachments[0].ref == "i.png" and r.expanded_tokens == [1]


@pytest.mark.parametrize("control", chat.CONTROLS)
def test_controls_over_several_parts(control):
    """No split of a control string over text parts, with other parts around, gets it into the body."""
    for a in range(len(control) + 1):
        for b in range(a, len(control) + 1):
            texts = [control[:a], control[a:b], control[b:]]
            for parts in ([{"type": "text", "text": t} for t in texts], [{"text": texts[0]}, {"type": "text", "text": None}, {"text": texts[1]}, {"text": texts[2] + "z"}, {"type": "image", "ref": "i"}, {"text": control}]):
                segment, start, end, _ = chat.format_turn("assistant", parts)
                body = segment[start:end].replace(chat.PLACEHOLDERS["image"], "", 1) if len(parts) > 3 else segment[start:end]
                assert not any(c in body for c in chat.CONTROLS)
                assert chat.unescape(body) == "".join(p.get("text") or "" for p in parts)

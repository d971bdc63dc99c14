import hashlib

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import chat_format as C
from graphloom.llm.queries import op7_chat_format

PATH = public_tokenizers.path("byte_bpe_50k.json")
pieces = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "[", "<\\/s>", " ", "\n", "a", "é", "🙂", "INST]"]), max_size=12).map("".join)


@given(pieces)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert C.unescape(C.escape(text)) == text
    assert not any(c in C.escape(text) for c in C.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|im_sep|>", "a\nb"]), pieces), max_size=5))
def test_rendering_reads_back(turns):
    formatted, spans = C.render(turns)
    assert C.read_back(formatted) == turns
    assert [C.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def digest(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(C.render(turns)[0])


COLUMNS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def test_conversations_table(spark, sf):
    want = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op7_chat_format(spark, sf).collect()}
    assert got == {c: digest(t) for c, t in want.items()}


def test_odd_conversations(spark):
    rows = [
        (1, 1, "assistant", None), (1, 0, None, "x"), (2, None, "user", "  lead"), (2, 0, "assistant", " é🙂\n"), (2, 0, "assistant", " é🙂\n"), (2, 1, "assistant", "<|im_end|>\\<|im_end|>"),
        (None, 0, "assistant", "no id"), (3, 0, "assistant", "long " * 5000), (4, 0, "tool", ""),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in C.digests(C.format_conversations(table, PATH)).collect()}
    want = {1: [(None, "x"), ("assistant", None)], 2: [("user", "  lead"), ("assistant", " é🙂\n"), ("assistant", " é🙂\n"), ("assistant", "<|im_end|>\\<|im_end|>")]}
    want |= {None: [("assistant", "no id")], 3: [("assistant", "long " * 5000)], 4: [("tool", "")]}
    assert out == {c: digest(t) for c, t in want.items()}
    assert C.format_conversations(table.limit(0), PATH).count() == 0
    for r in C.format_conversations(table, PATH).collect():
        assert len(r.ids) == len(r.loss) == len(r.starts) == len(r.ends)
        assert r.starts == sorted(r.starts) and max(r.ends) == len(r.formatted)

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import chat_format as C
from ledgerloom.llm.queries import op8_chat_format

PIECES = ["<|", "|>", "|", "<", ">", "\\", "\n", "</s>", "[INST]", "[/INST]", "<|end|>", "<|user|>\n", "end", "é", "<s>", "[", "]", "/", "<<SYS>>", "s"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    out = C.render(turns)
    assert C.parse(out) == turns
    for _, a, b in C.spans(out):
        assert not any(c in out[a:b] for c in C.CONTROLS)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_both_levels_unescape(text):
    assert C.unescape(C.escape(text)) == text == C.unescape(C.escape(text, 1))


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r is not None, r or "", x is not None, x or "") for c, t, r, x in rows if c == conv))
        turns = [(t[3], t[5]) for t in turns]
        told = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(C.render(turns))))
    return sorted(out, key=str)


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, "x" * 200_000), (None, 0, "assistant", "\\<|end|>\n"), (3, 5, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, n_turns int").repartition(4)
    assert sorted((tuple(r) for r in C.digests(C.formatted(df)).collect()), key=str) == expected(rows)
    assert C.digests(C.formatted(df.where("conv_id > 9"))).count() == 0


def test_op8(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert sorted((tuple(r) for r in op8_chat_format(spark, d).collect()), key=str) == expected(rows)

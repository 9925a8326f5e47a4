import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm.chat_format import GrammarError, format_conversations, format_turns, parse, render

odd = st.lists(st.sampled_from(["\\", "#", "###", "### ", "</turn>", "</turn>\n", ": ", ":", "\n", "user", "é", "</tu", "rn>", "\\n", "c"]), max_size=12).map("".join)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(odd, odd), max_size=4))
def test_round_trip(turns):
    made = "".join(render(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in parse(made)] == turns
    for r, t in turns:
        text, a, b = render(r, t)
        assert "###" in t or "</turn>" in t or text[a:b] == t


def test_errors():
    for bad in ("x", "### user", "### user: a", "### user: a ### b</turn>\n", "### user: a</turn>b"):
        with pytest.raises(GrammarError):
            list(parse(bad))


def test_table(spark):
    rows = [(1, 1, "assistant", "b\\### x"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "</turn>\n"), (None, None, "assistant", "é"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {x.conv_id: tuple(x)[1:] for x in format_conversations(df).collect()}
    assert got[1] == (4, sha("user\na\nuser\na\nassistant\nb\\### x\nassistant\n\n"), 7, sha("b\\### x"), 2 * (4 + 4 + 2 + 1 + 9) + (4 + 9 + 2 + 8 + 9) + (4 + 9 + 2 + 9))
    assert got[2][:2] == (1, sha("\n</turn>\n\n")) and got[None] == (1, sha("assistant\né\n"), 1, sha("é"), 4 + 9 + 2 + 1 + 9)
    assert sorted(x.loss_to - x.loss_from for x in format_turns(df).collect() if x.loss_to is not None) == [0, 1, 8]
    assert format_conversations(df.limit(0)).collect() == []

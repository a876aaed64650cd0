import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bundlelens.llm import chat


def test_language():
    out, spans = chat.render("{% for m in messages %}{% if loop.first %}<{% endif %}{{ m.a ~ '-' }}{% generation %}{{ m['b']|upper }}{% endgeneration %}{% if loop.last %}>{% else %},{% endif %}{% endfor %}{# gone #}", messages=[{"a": 1, "b": "x"}, {"a": None, "b": "yz"}])
    assert out == "<1-X,-YZ>" and [out[a:b] for a, b in spans] == ["X", "YZ"]
    assert chat.render("{% set n = 2 * 3 + 1 %}{{ n }}{{ 'a' if n > 6 and not false else 'b' }}{% if n == 1 %}1{% elif n == 7 %}7{% else %}?{% endif %}")[0] == "7a7"
    assert chat.render("{{ x|default('none') }}{{ 'b' in 'abc' }}{{ ' q '|trim }}")[0] == "noneTrueq"


def test_folds_constants():
    assert chat.fold(chat.parse("a{{ 'b' ~ 'c'|upper }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == chat.Node("block", (chat.Node("text", ("abCd",)),))


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ __import__ }}", "{{ x|system }}", "{% for x %}{% endfor %}", "{% if 1 %}", "{% endif %}", "{% while 1 %}", "{{ 1 + }}", "{{ f(1) }}"])
def test_sandbox_rejects(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_members_reach_no_attributes():
    assert chat.render("{{ x['__class__'] }}|{{ x.upper }}", x="text")[0] == "|"


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\n### b", "\\"]), st.text(alphabet="ab#\\</turn>\n: é", max_size=40) | st.sampled_from([chat.PLANTED, "</turn>\n", "####", "<</turn>"]))))
def test_round_trip(turns):
    out, spans = chat.render(chat.TEMPLATE, messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(out) == turns
    assert "".join(chat.unescape(out[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    assert out.count("###") == len(turns) and out.count(chat.TURN_END) == len(turns)


def brute(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b" * 50_000), (1, 0, "user", "a"), (2, 0, "system", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, None, None), (3, 2, "assistant", "é😀\n</turn>")]
    spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: tuple(r)[1:5] for r in chat.op10_chat_format(spark, str(tmp_path)).collect()}
    want = {1: [("user", "a"), ("assistant", "b" * 50_000)], 2: [("assistant", "x"), ("assistant", "x"), ("system", "")], None: [("", "")], 3: [("assistant", "é😀\n</turn>")], -7: [("user", chat.PLANTED), ("assistant", chat.PLANTED)]}
    assert found == {k: brute(v) for k, v in want.items()}


def test_formatted_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    row = chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", "hi")], schema)).first()
    assert row.formatted == "### assistant\nhi</turn>\n" and [tuple(x) for x in row.spans] == [(14, 16)]
    assert chat.digests(spark.createDataFrame([], schema)).count() == 0

"""BPE and chat formatting: exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rollspark.llm import bpe, chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = bpe.Vocabulary(PATH)
ENCODER = bpe.Encoder(VOCABULARY)
DECODER = bpe.Decoder(VOCABULARY)
REFERENCE = Tokenizer.from_file(PATH)


def ids_of(text):
    return ENCODER.encode([text])[0].tolist()


def check(text):
    expected = REFERENCE.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == expected
    import numpy as np

    got = DECODER.decode(np.array(expected, np.int32), np.array([0, len(expected)]))
    assert got.to_pylist() == [REFERENCE.decode(expected, skip_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_any_text(text):
    check(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a" * 3000, "ab" * 999, "<|endoftext|>", "x<|endoftext|> y<|endo", "don't we'll\n\n  x", "é" * 500, "  \t 1234567 .,;!?"],
)
def test_odd_texts(text):
    check(text)


def test_words_of_syllables():
    rng = random.Random(3)
    parts = ["th", "er", "ing", "tion", "ou", "e", " ", ".", "A", "ñ", "ss"]
    for _ in range(300):
        check("".join(rng.choice(parts) for _ in range(40)))


def test_prefix_states_are_shared_and_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    encoder = bpe.Encoder(VOCABULARY)
    for n in range(20):
        text = " ".join(f"word{i}ing" for i in range(n, n + 15))
        assert encoder.encode([text])[0].tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


def test_frames(spark, odd_docs):
    rows = bpe.decode(bpe.encode(odd_docs, PATH), PATH).select("text", "ids", "decoded").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert list(r["ids"]) == REFERENCE.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    empty = bpe.decode(bpe.encode(odd_docs.limit(0), PATH), PATH)
    assert empty.count() == 0
    odd = spark.createDataFrame([([220, 999999, None, -1, 233],), (None,), ([],)], "ids array<int>")
    texts = [r["decoded"] for r in bpe.decode(odd, PATH).collect()]
    assert texts[1:] == ["", ""] and texts[0].endswith(VOCABULARY.bytes[233].decode("utf-8", "replace"))


def test_frames_of_many_rows(spark):
    """More rows in a batch than are given out together, with null and odd arrays among them."""
    texts = [None if i % 50 == 0 else f"row {i} wörd" * (i % 4) for i in range(5000)]
    rows = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1), PATH)
    rows = rows.withColumn("ids", F.expr("if(n % 77 = 3, null, ids)"))
    for r in bpe.decode(rows, PATH).collect():
        none = r["n"] % 77 == 3
        assert r["ids"] == (None if none else REFERENCE.encode(texts[r["n"]] or "", add_special_tokens=False).ids)
        assert r["decoded"] == ("" if none else texts[r["n"]] or "")


# -- chat --------------------------------------------------------------------


def rendered(source, **names):
    return list(chat.compile_template(source)(**names))


def text_of(source, **names):
    return "".join(t for t, _ in rendered(source, **names))


@pytest.mark.parametrize(
    "source,expected",
    [
        ("a{{ 1 + 2 }}b", "a3b"),
        ("{{ 'x' ~ 2 }}{# gone #}{{ \"y\\n\" }}", "x2y\n"),
        ("{% if 1 > 2 %}no{% elif 2 == 2 %}yes{% else %}no{% endif %}", "yes"),
        ("{% for x in xs %}{{ loop.index }}{{ x.a }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"),
        ("{% set z = xs[1]['a'] %}{{ z | upper }}", "Q"),
        ("{{ missing }}{{ xs.a }}{{ none }}", ""),
        ("{% if 'p' == xs[0].a and not missing %}{{ -1 + 3 }}{% endif %}", "2"),
        ("{{ xs.__class__ }}{{ xs[0].keys }}", ""),
    ],
)
def test_language(source, expected):
    assert text_of(source, xs=[{"a": "p"}, {"a": "q"}]) == expected


@pytest.mark.parametrize("source", ["{{ }}", "{{ a b }}", "{% if x %}", "{% for x %}{% endfor %}", "{{ x | eval }}", "{{ f(1) }}", "{% import os %}", "{% endif %}", "{{ 'x }}"])
def test_what_is_not_in_the_language(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_constants_are_folded():
    tree = chat.folded(chat.parse("a{{ 1 + 1 }}{% if true %}b{{ 'c' | upper }}{% endif %}{% if false %}{{ x }}{% endif %}d"))
    assert tree == [("text", "a2bCd")]
    assert chat.fold(chat._Expression("x or true and false").whole()) == ("or", ("name", "x"), ("const", False))


def test_generation_is_marked():
    source = "{% for m in ms %}<{% generation %}{{ m.t }}!{% endgeneration %}>{% endfor %}"
    pieces = rendered(source, ms=iter([{"t": "a"}, {"t": "b"}]))
    assert "".join(t for t, loss in pieces if loss) == "a!b!" and "".join(t for t, _ in pieces) == "<a!><b!>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet="\\#</turn>: \nab", max_size=30)), max_size=5))
def test_turns_are_read_back(turns):
    out = [t for t, _ in rendered(chat.CHAT, messages=({"role": r, "text": t} for r, t in turns))]
    assert list(chat.turns_of(iter(out))) == turns


def test_escapes_leave_no_control_string():
    for text in ["### ", "</turn>", "\\### x</turn>\\", "#### #</turn></turn>"]:
        safe = chat.escape(text)
        assert not any(c in safe for c in chat.CONTROLS) and chat.unescape(safe) == text


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "b </turn> \\"), (1, 0, "user", "a"), (1, 2, "assistant", None),
        (None, 0, "user", "lonely"), (2, None, None, "### x"), (2, 0, "assistant", "tie 2"), (2, 0, "assistant", "tie 1"),
        (3, 0, "user", "w " * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", chat.F.lit(1))
    got = {r["conversation"]: r for r in chat.read_back(chat.render(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\na\nassistant\nb </turn> \\\nassistant\n\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len("b </turn> \\"), sha("b </turn> \\"))
    assert got[2]["turns_sha256"] == sha("\n### x\nassistant\ntie 1\nassistant\ntie 2\n") and got[2]["loss_sha256"] == sha("tie 1tie 2")
    assert got[3]["loss_sha256"] == sha("") and got[3]["formatted_chars"] > 100_000
    pieces = chat.render(df).filter("conversation = 1").orderBy("piece").collect()
    assert got[1]["formatted_chars"] == sum(len(p["text"]) for p in pieces)
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


@pytest.mark.parametrize(
    ("source", "shown"),
    [
        ("a {%- if true -%} b {%- endif -%} c", "abc"),
        ("a {{- x -}} b", "aXb"),
        ("a {{- x }} b", "aX b"),
        ("a\n {# note -#}\n b", "a\n b"),
        ("{%- for y in 'pq' -%} {{ y }} {%- endfor -%}\n", "pq"),
        ("  {{- -1 -}}  ", "-1"),
        ("{% if false %}{{ 1 % 0 }}{% endif %}z", "z"),
    ],
)
def test_trim_marks(source, shown):
    assert "".join(t for t, _ in rendered(source, x="X")) == shown


def test_a_zero_divisor_is_an_error_only_where_it_is_rendered():
    made = chat.compile_template("a{{ 1 % 0 }}")
    with pytest.raises(ZeroDivisionError):
        list(made())

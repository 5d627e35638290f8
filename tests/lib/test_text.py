"""Text functions on single values."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("function", "given_", "want"),
    [
        (T.tokens, "rebuild_auth", ["rebuild_auth", "rebuild", "auth"]),
        (T.tokens, "HTTPAdapter x 9", ["httpadapter", "http", "adapter"]),
        (T.tokens, "decode decoded decoding raises tries", ["decod", "decod", "decod", "rais", "try"]),
        (T.tokens, "", []),
        (T.hashing_tokens, "openLink a", ["openlink", "open", "link", "a"]),
        (T.identifier_terms, "where is `Session.send` in a session", ["session.send"]),
        (T.identifier_terms, "what does rebuild_auth do in HTTPAdapter and openLink", ["openlink", "rebuild_auth"]),
        (T.identifier_terms, "connect", ["connect"]),
        (T.identifier_terms, "see app.py", []),
        (T.module_name, "src/pkg/__init__.py", "pkg"),
        (T.module_name, "pkg/mod.ipynb", "pkg.mod"),
        (T.approx_tokens, "12345678", 3),
        (T.normalize_citations, "see 【 app.py:11-13 】", "see [app.py:11-13]"),
        (T.sentences, "One. Two? `three` x.\n\nfour e.g. five", ["One.", "Two?", "`three` x.", "four e.g. five"]),
        (T.claimed_names, "`Session.send(x)` and `ab` in `a.py` [`x.py:1-2`] or `None`", ["send"]),
        (T.intent, "What does connect call?", "callees"),
        (T.intent, "what breaks if I change it", "callers"),
        (T.intent, "how is it done", "related"),
        (T.imported_names, "import a.b as c, d\nfrom x import (y, z as w)\n  import q.r", ["c", "d", "y", "w", "r"]),
        (T.lines, "a\r\nb\rc\n\nd\n", ["a", "b", "c", "", "d"]),
        (T.lines, "a b\x1cc", ["a", "b", "c"]),
        (T.slug, "  My Repo!! ", "my-repo"),
        (T.slug, "!!!", "repo"),
        (T.repository_name, "https://github.com/own.er/na-me.git", "own.er/na-me"),
        (T.repository_name, "https://example.com/a/b", None),
        (T.gold_name, "eval\\hard.jsonl", "hard"),
        (T.windows_safe, "a/con.txt", False),
        (T.windows_safe, "a/b c.py", True),
        (T.windows_safe, "a/b?.py", False),
        (T.windows_safe, "a//b", False),
        (T.windows_safe, "x" * 240, False),
        (T.retry_after, "7.5s", 8.0),
        (T.retry_after, "1m2.3s", 62.8),
        (T.retry_after, "soon", None),
        (T.is_refusal, "I couldn’t find this here", True),
    ],
)
def test_values(spark, function, given_, want):
    assert value(spark, function(F.lit(given_))) == want


def test_stream_lines(spark):
    rows = [("ollama", '{"message": {"content": "a"}}', "a"), ("other", 'data: {"choices": [{"delta": {"content": "b"}}]}', "b"), ("other", "data: [DONE]", ""), ("other", ": ping", ""), ("ollama", "", "")]
    got = spark.createDataFrame(rows, "p string, line string, want string").select(T.stream_token("line", "p").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_null_text_is_empty(spark):
    none = F.lit(None).cast("string")
    for function in (T.tokens, T.hashing_tokens, T.identifier_terms, T.lines, T.citations, T.sentences, T.claimed_names, T.imported_names, T.rewrites):
        assert value(spark, function(none)) == []


def test_render(spark):
    assert value(spark, T.render("{{x}} {a}-{b}{a}", a=F.lit("1"), b=F.lit(2))) == "{x} 1-21"


def test_globs_cross_slashes():
    import re

    for glob, path, fits in (("tests/*", "tests/a/b.py", True), ("*.py", "a/b.py", True), ("a?c", "abc", True), ("[ab].py", "c.py", False), ("[!ab].py", "c.py", True), ("a.py", "aXpy", False)):
        assert bool(re.match(T.glob_pattern(glob), path)) == fits


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n\r\t\x0b\x1c\x85 é", max_size=20))
def test_lines_split_as_python_does(spark, text):
    assert value(spark, T.lines(F.lit(text))) == text.splitlines()


def test_capitals_are_those_of_sql(spark):
    """Character by character: ß has one capital, and ligatures none."""
    import duckdb

    every = "".join(chr(i) for i in range(1, 0x1F000) if not 0xD800 <= i < 0xE000)
    found = spark.createDataFrame([(every, "Straße ﬁx")], "every string, few string").select(T.capitals("every"), T.capitals("few")).first()
    assert found[1] == "STRAẞE ﬁX"
    assert found[0] == duckdb.execute("SELECT upper(?)", [every]).fetchone()[0]


def test_runs_of_texts_hold_their_identifiers():
    import pyarrow as pa

    from lodestar.functions import words

    texts = ["left out", "9abc 12 9_a é9b", None, "", "a\x00bb naïve x" + "y" * 80, "ends", "begins 7", "!", "parseURLs\tClasses is_of 3D"]
    row, runs = words.word_runs(pa.array(texts, pa.string()).slice(1))
    got = [[] for _ in texts[1:]]
    for i, run in zip(row, runs.to_pylist(), strict=True):
        if word := run.lstrip("0123456789"):
            got[i].append(word)
    assert got == [words._WORD.findall(t or "") for t in texts[1:]]
    for nothing in ([], [None], ["", "é !"]):
        assert len(words.word_runs(pa.array(nothing, pa.string()))[0]) == 0


@given(st.from_regex("[A-Za-z_][A-Za-z0-9_]{0,12}", fullmatch=True))
def test_words_without_inner_ones_and_endings_take_no_other_way(word):
    from lodestar.functions import words

    for drop in (False, True):
        kept = [t for t in words.pieces(word) if t[1:] and not (drop and t in words._STOP)]
        plain = []
        for token in kept:
            for ending, by in words._ENDINGS:
                token = ending.sub(by, token)
            plain.append(token)
        assert list(words.search_tokens(word, drop)) == plain

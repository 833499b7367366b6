"""Scalar scorers, snippets and segments."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import plain

words = st.text("abcdé ", max_size=14)


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_edit_distance_and_jaro(a, b):
    assert plain.edit_distance(a, b) == slow_distance(a, b)
    assert 0 <= plain.jaro(a, b) <= 1
    assert plain.jaro(a, a) == 1
    assert plain.jaro_winkler(a, b) >= plain.jaro(a, b)


def test_known_similarities():
    assert round(plain.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(plain.jaro("dixon", "dicksonx"), 4) == 0.7667
    assert plain.edit_similarity("", "") == 1.0
    assert plain.jaro("", "a") == 0.0


def test_subsequence_rewards_starts_and_runs():
    assert plain.subsequence("abc", "a-b-c") > plain.subsequence("abc", "xaxbxcx")
    assert plain.subsequence("abc", "abc") > plain.subsequence("abc", "a b c x")
    assert plain.subsequence("abc", "acb") == 0
    assert plain.subsequence("", "abc") == 0


def test_wanted_query():
    q = plain.wanted("  Find Cache. Intent: explain. ")
    assert (q.lower, q.compact, q.terms) == ("find cache", "findcache", ("find", "cache"))
    assert not q.path_like and q.symbol_like
    assert plain.wanted("src/a_b.rs").path_like and plain.wanted("a::b").symbol_like


def test_path_scores_prefer_the_named_file():
    q = plain.wanted("request factry")
    good, bad = plain.path_score(q, "src/infra/http_request_factory.rs"), plain.path_score(q, "src/app/runner.rs")
    assert good >= plain.FUZZY_LEAST > bad
    assert plain.path_score(plain.wanted("..."), "a/b") == 0


def test_line_and_definition_bonus():
    q = plain.wanted("retry_loop")
    assert plain.is_definition("  pub(crate) fn retry_loop()") and not plain.is_definition("a fn b")
    score, line = plain.segment_score(q, "section 1", "nothing here\n  fn retry_loop() {}\nmore")
    assert line == "fn retry_loop() {}" and score > 1
    assert plain.segment_score(plain.wanted("zzzz"), "section 1", "") is None
    assert 0 <= plain.structural_bonus("retry_loop", "src/retry_loop.rs", "section 1: retry_loop", line) <= 0.12
    assert plain.signal(float("nan"), 2) == 0 and plain.signal(9, 2) == 1 and plain.signal(1, 0) == 0


def test_snippets():
    text = "  one   two \n\n three " + "x " * 300 + "needle end " + "y " * 300
    out = plain.snippet(text, "Needle", highlight=False)
    assert out.startswith("...") and out.endswith("...") and "needle" in out and len(out) == 246
    lit = plain.snippet(text, "needle needle2")
    assert lit.count(plain.LIT) == 1 and re.sub(r"\x1b\[[0-9;]*m", "", lit) == out
    assert plain.snippet("a  b\n\nc", "") == "a b\nc"
    assert plain.snippet("", "x") == "" and plain.simple_snippet("x" * 161) == "x" * 160 + "..."
    assert plain.lit("aab", ["ab", "a"]) == f"{plain.LIT}a{plain.UNLIT}{plain.LIT}ab{plain.UNLIT}"
    assert plain.shortened("a " * 200) == ("a " * 200)[:217] + "..."


def test_segments():
    made = plain.segments("# Title\n\nBody one.\n\nplain block.\nsecond line\n\nLast heading")
    assert [(p.label, p.text) for p in made] == [("section 1: Title", "Title\n\nBody one."), ("section 2", "plain block.\nsecond line"), ("section 3: Last heading", "Last heading")]
    assert [(p.label, p.text) for p in plain.segments("   ")] == [("section 1", "")]
    assert [p.label for p in plain.segments("One\n\x0c  \x0cTwo.", "pdf")] == ["page 1: One", "page 2"]
    assert plain.segments("a\r\n\r\nb", "pptx")[0].label == "slide 1: a"
    assert plain.segments("x", "xlsx")[0].label == "sheet 1: x"


def test_heading_rules():
    assert plain.is_heading("# a\nb") and plain.is_heading("Title")
    assert not plain.is_heading("A sentence.") and not plain.is_heading("123") and not plain.is_heading("é" * 41) and not plain.is_heading("a\nb") and not plain.is_heading("")


def test_significant_terms():
    assert plain.significant("The cache of 42 é x src") == ["cache", "é"]
    assert plain.Terms(2).add(["a", "a", "b", "c"]).words == ["a", "b"]

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from rollspark.functions import text as X

# (text, code): the rules in order, and what each leaves alone.
CODE = [
    ("a\n```python\nx = 1\n```\nb", "x = 1"),
    ("```python\nx = 1", "x = 1"),
    ("```python\n  \n```\nrest", "python"),  # an empty python fence falls to the next rule
    ("```python3\nx\n```", "3\nx"),
    ("```py\nx\n```", "py\nx"),
    ("```js\ny\n```\n```python\nx\n```", "x"),
    ("```\nx\n```", "x"),
    ("```Python\nx\n```", "Python\nx"),
    ("  x = 1\n ", "x = 1"),
    ("``````", "``````"),
    ("", ""),
    ("```python\na\n```\n```python\nb\n```", "a"),
]


@pytest.mark.parametrize("text,code", CODE)
def test_extract_code(one, text, code):
    assert one("t string", text)(X.extract_code(F.col("t"))) == code


def test_extract_code_strips_like_python(spark):
    rows = [(chr(c), f"{chr(c)}x{chr(c)}") for c in range(1, 0x3001) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(rows, "c string, t string")
    got = {r["c"]: r["code"] for r in df.select("c", X.extract_code(F.col("t")).alias("code")).collect()}
    assert all(got[c] == t.strip() for c, t in rows)


def run(script):
    done = subprocess.run([sys.executable, "-I", "-c", script], capture_output=True, text=True, timeout=20)
    return done.stdout + done.stderr


def test_script_drops_blank_lines_and_keeps_indentation(one):
    test = "\n  \nfor i in range(2):\n    assert f(i) == i\n\t\nassert f(3) == 3\n"
    script = one("c string, t string", "def f(x):\n    return x", test)(X.build_script(F.col("c"), F.col("t")))
    assert "\n    for i in range(2):\n        assert f(i) == i\n    assert f(3) == 3\n" in script
    assert X.PASS_MARK in run(script)


def test_script_of_an_empty_test_passes_if_the_code_runs(one):
    script = one("c string, t string", "x = 1", "  \n ")(X.build_script(F.col("c"), F.col("t")))
    assert X.PASS_MARK in run(script)


def test_script_reports_a_failure(one):
    script = one("c string, t string", "x = 1", "assert x == 2")(X.build_script(F.col("c"), F.col("t")))
    output = run(script)
    assert X.FAIL_MARK in output and "AssertionError" in output and X.PASS_MARK not in output


@pytest.mark.parametrize(
    "stdout,stderr,timed_out,problem,expected",
    [
        ("__ALL_PASSED__\n", "", False, None, (1.0, "All tests passed.")),
        ("", "noise __ALL_PASSED__", False, None, (1.0, "All tests passed.")),
        ("__ALL_PASSED__", "", True, None, (0.0, "Timed out.")),
        ("", "", False, "e" * 700, (0.0, "e" * 600)),
        ("  a", "b  ", False, None, (0.0, "ab")),
        (" " + "é" * 700, "", False, None, (0.0, "é" * 600)),
    ],
)
def test_verdict(spark, stdout, stderr, timed_out, problem, expected):
    schema = "o string, e string, t boolean, p string"
    reward, feedback = X.verdict(F.col("o"), F.col("e"), F.col("t"), F.col("p"))
    row = spark.createDataFrame([(stdout, stderr, timed_out, problem)], schema).select(reward, feedback).first()
    assert tuple(row) == expected


def test_feedback_with_and_without_a_demonstration(one):
    feedback = X.build_feedback(F.col("c"), F.col("e"), F.col("d"))
    head = "Your code:\n```python\nbad\n```\n\nError: boom\n\n"
    schema = "c string, e string, d string"
    assert one(schema, "bad", "boom", None)(feedback) == head + "Identify and fix the mistake."
    shown = one(schema, "bad", "boom", "good")(feedback)
    assert shown == head + "Here is a working solution:\n```python\ngood\n```\n\nWrite a corrected version."


def test_prompts(one):
    value = one("f string, p string", "feedback", "problem\n")
    rendered = "<start_of_turn>user\nproblem\n<end_of_turn>\n<start_of_turn>model\n"
    assert value(X.render_prompt(F.col("p"))) == rendered
    assert value(X.render_prompt(F.col("p"), None)) == "problem\n"
    asked = value(X.teacher_prompt(F.col("f"), F.col("p"), None))
    assert asked == "feedback\n\nNow write the corrected code for:\nproblem\n"

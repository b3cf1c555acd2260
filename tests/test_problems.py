
import pytest
from pyspark.sql import functions as F

from rollspark.sources import problems as P

MBPP = "problem_id string, prompt string, code string, test_list array<string>"
FUNCTION = "problem_id string, prompt string, test string, entry_point string"


def test_mbpp(spark):
    rows = [
        ("1", "Add.", "def add(a, b):\n    return a", ["assert add(1, 2) == 3", "assert add(0, 0) == 0"]),
        ("2", "None.", "def f():", []),
        ("3", "Wrapped.", "x", ["assert set(f(1)) == {1}"]),
        ("4", "Twice.", "x", ["assert one assert two(3)"]),
    ]
    got = P.normalize_mbpp(spark.createDataFrame(rows, MBPP)).orderBy("problem_id").collect()
    assert [r["entry"] for r in got] == ["add", "solution", "set", "one "]
    assert got[0]["prompt"] == "Add.\ndef add(a, b):"
    assert got[0]["test"] == "assert add(1, 2) == 3\nassert add(0, 0) == 0"
    assert got[1]["test"] == ""


def test_mbpp_without_assertion_is_an_error(spark):
    rows = spark.createDataFrame([("1", "p", "c", ["check(f)"])], MBPP)
    with pytest.raises(Exception, match="no assertion"):
        P.normalize_mbpp(rows).collect()


def test_humaneval(spark):
    rows = [("1", "p", "def check(c):\n    pass", "f"), ("2", "p", "assert f()", "f"), ("3", "p", None, "f")]
    got = P.normalize_humaneval(spark.createDataFrame(rows, FUNCTION)).orderBy("problem_id").collect()
    assert [r["test"] for r in got] == ["def check(c):\n    pass\ncheck(f)", "assert f()", None]
    bare = spark.createDataFrame([("1", "p")], "problem_id string, prompt string")
    for normalize in (P.normalize_humaneval, P.normalize_plain):
        row = normalize(bare).first()
        assert (row["test"], row["entry"]) == ("", "solution")


def plain(spark, n, source):
    return spark.range(n).select(
        F.col("id").cast("string").alias("problem_id"), F.lit(source).alias("source"), F.lit("p").alias("prompt")
    )


@pytest.mark.parametrize(
    "n,first,second,expected",
    [
        (10, 50, 50, (8, 2)),
        (10, 3, 50, (3, 7)),  # the second source fills up
        (10, 50, 1, (8, 1)),  # the first does not
        (1, 5, 5, (1, 0)),
        (0, 5, 5, (0, 0)),
        (10, 0, 5, (0, 5)),
    ],
)
def test_weighted_mix(spark, n, first, second, expected):
    mixed = P.weighted_mix(plain(spark, first, "a"), plain(spark, second, "b"), n, 42).collect()
    got = [sum(r["source"] == s for r in mixed) for s in "ab"]
    assert tuple(got) == expected
    assert sorted(r["position"] for r in mixed) == list(range(sum(expected)))
    assert len({(r["source"], r["problem_id"]) for r in mixed}) == sum(expected)


@pytest.mark.parametrize("n", [0, 3, 500])
def test_pool_sample(spark, n):
    got = P.sample_pool(plain(spark, 50, "pool").repartition(3), n).collect()
    assert sorted(r["draw_no"] for r in got) == list(range(n))
    again = P.sample_pool(plain(spark, 50, "pool").repartition(11), n).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    if n == 500:
        assert len({r["problem_id"] for r in got}) > 45


def test_pool_sample_in_pieces(spark, monkeypatch):
    pool = plain(spark, 3, "pool")
    whole = sorted(map(tuple, P.sample_pool(pool, 400).collect()))
    monkeypatch.setattr(P, "SPLIT_ROWS", 20)
    assert sorted(map(tuple, P.sample_pool(pool, 400).collect())) == whole


def test_pool_sample_of_nothing(spark):
    assert P.sample_pool(plain(spark, 0, "pool"), 5).count() == 0


def test_dispatch(spark, tmp_path):
    functions = spark.createDataFrame([(str(i), "p", "def check(c): pass", "f") for i in range(5)], FUNCTION)
    functions.write.parquet(str(tmp_path / "functions"))
    (tmp_path / "functions.jsonl").write_text('{"problem_id": "1", "prompt": "p"}\n')
    mbpp = spark.createDataFrame([("m", "p", "def f():", ["assert f()"])], MBPP)
    pool = plain(spark, 4, "builtin").withColumns({"test": F.lit(""), "entry": F.lit("f")})
    sources = {"humaneval": str(tmp_path / "functions"), "mbpp": mbpp, "bigcodebench": functions, "builtin": pool}

    def load(name, sources=sources, **kwargs):
        return P.load_problems(spark, name, sources, 3, **kwargs)

    assert {r["source"] for r in load("humaneval").collect()} == {"humaneval"}
    assert [r["problem_id"] for r in load("mbpp").collect()] == ["m"]
    assert load("mix").count() == load("humaneval_mbpp_mix").count() == 3
    assert "check(f)" not in load("bigcodebench").first()["test"]
    assert load("builtin").count() == 3
    missing = load("humaneval", {"humaneval": str(tmp_path / "functions.jsonl")}).first()
    assert (missing["test"], missing["entry"]) == ("", "solution")
    with pytest.raises(ValueError, match="misspelled"):
        load("misspelled")
    assert load("misspelled", on_error="fallback").count() == 3
    gone = {**sources, "humaneval": str(tmp_path / "gone")}
    with pytest.raises(Exception):
        load("humaneval", gone)
    assert load("humaneval", gone, on_error="fallback").count() == 3


def test_size_position_and_reshuffle(spark):
    rows = plain(spark, 20, "a")
    assert P.problem_count(rows).first()["n_problems"] == 20
    order = [r["problem_id"] for r in P.reshuffle(rows, 42, 1).orderBy("position").collect()]
    other = [r["problem_id"] for r in P.reshuffle(rows, 42, 2).orderBy("position").collect()]
    assert sorted(order) == sorted(other) and order != other
    assert P.problem_at(rows, 3, "42:1").first()["problem_id"] == order[3]
    assert P.problem_at(rows, -1, "42:1").first()["problem_id"] == order[-1]
    assert P.problem_at(rows, 20, "42:1").count() == 0


def test_one_position_keeps_one_block(spark):
    rows = plain(spark, 500, "s")
    plan = P.problem_at(rows, 7, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" in plan and P.problem_at(rows, 7, 3).count() == 1


def test_broken_lines_of_a_source(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"problem_id": "1", "prompt": "p", "test": null}\n{"problem_id": "2", "pro')
    schema = FUNCTION if not isinstance(FUNCTION, str) else spark.createDataFrame([], FUNCTION).schema
    with pytest.raises(Exception, match="(?i)malformed"):
        P.read_rows(spark, str(path), schema).collect()
    assert [r["test"] for r in P.read_rows(spark, str(path), schema, "skip").collect()] == [""]
    assert [r["test"] for r in P.read_rows(spark, str(path), schema, "skip", null_defaults=False).collect()] == [None]
    kept = P.read_rows(spark, str(path), schema, "keep").collect()
    assert [r["broken_line"] is None for r in kept] == [True, False]


def test_broken_rows_fall_back_when_they_are_read(spark, tmp_path):
    pool = P.normalize_plain(spark.createDataFrame([("a", "pa"), ("b", "pb")], "problem_id string, prompt string"), "builtin")
    good = [(str(i), f"p{i}", "def f():\n  pass", ["assert f() == 1"]) for i in range(30)]
    kind = "problem_id string, prompt string, code string, test_list array<string>"
    load = lambda rows, how, name="mbpp": P.load_problems(spark, name, {"mbpp": rows, "humaneval": fine, "builtin": pool}, 5, on_error=how)
    fine = spark.createDataFrame([("h", "p", "assert x", "f")], "problem_id string, prompt string, test string, entry_point string")
    for broken in ([("x", "p", "c", ["print()"])], [("x", None, "c", [])], [("x", "p", None, [])], [("x", "p", "c", None)], [("x", "p", "c", ["assert f()", None])]):
        rows = spark.createDataFrame(good + broken, kind)
        got = load(rows, "fallback")
        assert got.count() == 5 and {r["source"] for r in got.collect()} == {"builtin"}
        assert {r["source"] for r in load(rows, "fallback", "mix").collect()} == {"builtin"}
    whole = spark.createDataFrame(good + [("x", "p", "c", [])], kind)
    assert {r["source"] for r in load(whole, "fallback").collect()} == {"mbpp"}
    with pytest.raises(Exception, match="holds no assertion"):
        P.normalize_mbpp(spark.createDataFrame(good + [("x", "p", "c", ["print()"])], kind)).collect()
    null_test = spark.createDataFrame([("h", "p", None, "f")], "problem_id string, prompt string, test string, entry_point string")
    assert {r["source"] for r in P.load_problems(spark, "humaneval", {"humaneval": null_test, "builtin": pool}, 3, on_error="fallback").collect()} == {"builtin"}


def test_broken_lines_fall_back(spark, tmp_path):
    pool = P.normalize_plain(spark.createDataFrame([("a", "pa")], "problem_id string, prompt string"), "builtin")
    path = tmp_path / "rows.jsonl"
    path.write_text('{"problem_id": "1", "prompt": "p", "test": "t", "entry_point": "f"}\n{"problem_id": "2", "pro')
    for name in ("humaneval", "bigcodebench"):
        got = P.load_problems(spark, name, {name: str(path), "builtin": pool}, 3, on_error="fallback")
        assert {r["source"] for r in got.collect()} == {"builtin"} and got.count() == 3
        with pytest.raises(Exception, match="MALFORMED|alformed"):
            P.load_problems(spark, name, {name: str(path), "builtin": pool}, 3).collect()

import time

from rollspark.operators.verify import ForkServer, judge_script, verify_completions

CASES = [
    ("pass", "```python\ndef f(x):\n    return x\n```", "assert f(1) == 1", 1.0),
    ("no tests", "x = 1", "", 1.0),
    ("wrong", "def f(x):\n    return 0", "assert f(1) == 1", 0.0),
    ("syntax", "def f(x:", "assert f(1) == 1", 0.0),
    ("top level", "raise ValueError('boom')", "assert True", 0.0),
    ("exit", "def f(x):\n    raise SystemExit(0)", "f(1)", 0.0),
    ("spoof", "print('__ALL_PASSED__')", "assert False", 0.0),
    ("slow", "import time\ntime.sleep(30)", "assert True", 0.0),
    ("busy", "while True:\n    pass", "assert True", 0.0),
    ("environment", "import os", "assert not os.environ.get('HOME')", 1.0),
    ("long output", "print('x' * (1 << 25))", "assert True", 1.0),
    ("much memory", "x = bytearray(1200 << 20)", "assert True", 1.0),
    ("long script", "x = '" + "y" * 200_000 + "'", "assert len(x) == 200000", 1.0),
    ("no text", "import sys\nsys.stdout.buffer.write(b'\\xff')", "assert True", 0.0),
    ("line ends", "print('a\\r\\nb\\rc')", "assert False", 0.0),
    ("null test", "x = 2", None, 1.0),
    ("null text", None, "assert True", 1.0),
    ("code ends late", "x = 1\ny = 2", "assert y == 2", 1.0),
    ("code ends early", "x = 1", "\ny = 2assert y == 2", 0.0),
    ("nul", "x = '\0'", "assert True", 0.0),
]


def test_verdicts(spark):
    rows = [(i, name, text, test) for i, (name, text, test, _) in enumerate(CASES * 2)]
    df = spark.createDataFrame(rows, "id int, name string, text string, test string")
    judged = verify_completions(df, seconds=5.0)
    assert judged.columns == ["id", "name", "text", "test", "reward", "feedback"]
    got = judged.collect()
    assert len(got) == len(rows)
    rewards = {name: reward for name, _, _, reward in CASES}
    assert all(r["reward"] == rewards[r["name"]] for r in got), [(r["name"], r["reward"], r["feedback"]) for r in got]
    feedback = {r["name"]: r["feedback"] for r in got}
    assert feedback["pass"] == "All tests passed."
    assert feedback["wrong"].startswith("__FAILED__") and "AssertionError" in feedback["wrong"]
    assert "SyntaxError" in feedback["syntax"] and "boom" in feedback["top level"]
    assert feedback["slow"] == feedback["busy"] == "Timed out."
    assert feedback["exit"] == ""
    assert "null byte" in feedback["nul"]
    assert "can't decode" in feedback["no text"]
    assert feedback["line ends"].startswith("a\nb\nc\n")


def test_limits_are_parameters():
    script = "x = bytearray(1 << 32)\nprint('done')"
    reward, feedback = judge_script(script, "done", 5.0, memory_bytes=1 << 30)
    assert reward == 0.0 and "MemoryError" in feedback
    assert judge_script("print('x' * (1 << 22))\nprint('done')", "done", 5.0, file_bytes=1 << 20)[0] == 0.0


def test_children_do_not_outlive_the_script(tmp_path):
    mark = tmp_path / "alive"
    child = f"import time; time.sleep(2); open({str(mark)!r}, 'w')"
    script = f"import subprocess, sys\nsubprocess.Popen([sys.executable, '-c', {child!r}])\nprint('done')"
    assert judge_script(script, "done", 5.0)[0] == 1.0
    time.sleep(3)
    assert not mark.exists()


def test_long_output_is_cut_from_the_end_of_the_feedback():
    reward, feedback = judge_script("print('x' * 5000)", "absent", 5.0)
    assert (reward, feedback) == (0.0, "x" * 600)


def test_one_interpreter_runs_many_scripts():
    """Scripts leave nothing behind for one another; one that kills the interpreter costs only itself."""
    with ForkServer() as server:
        first = None
        for i in range(300):
            assert judge_script(f"import sys\nassert not hasattr(sys, 'mark')\nsys.mark = {i}\nprint('done')", "done", 5.0, server=server)[0] == 1.0
            first = first or server.process.pid
        assert server.process.pid == first
        assert judge_script("import os, signal\nos.kill(os.getppid(), signal.SIGKILL)\nimport time\ntime.sleep(20)", "done", 5.0, server=server)[0] == 0.0
        assert judge_script("while True: pass", "done", 0.5, server=server) == (0.0, "Timed out.")
        assert judge_script("print('done')", "done", 5.0, server=server)[0] == 1.0
        assert judge_script("import atexit\natexit.register(print, 'done')", "done", 5.0, server=server)[0] == 1.0
        assert judge_script("import threading, time\nthreading.Timer(0.2, print, ['done']).start()", "done", 5.0, server=server)[0] == 1.0
    assert server.process is None

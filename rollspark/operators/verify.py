"""E3. Run completions against their tests in separate interpreters.

The only operator that leaves Spark expressions for work on single rows, and
opt-in: it executes the code it is given. Each distinct script runs once, with
an empty environment, in its own folder and process group, under a limit on
time, and on memory and file size if they are given. A task starts one interpreter, which
forks itself for each script, so that a script does not wait for one to start. The pass mark is random per run, so that printing
a known text earns nothing; this is a hurdle, not a sandbox. Run it on
executors that hold nothing worth stealing.
"""

from __future__ import annotations

import io
import json
import os
import resource
import select
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollspark.functions.text import FEEDBACK_CHARS, PASS_TEXT, TIMEOUT_TEXT, build_script, extract_code
from rollspark.session import fresh_dir

SECONDS = 10.0  # fixed value: time limit of a script
# A script may take its whole time limit; a task may take so long if all of its scripts do,
# and a round has so many tasks, so that the scheduler's list stays short.
TASK_SECONDS = 600.0
ROUND_TASKS = 50_000
CHUNK = 1 << 16

_RESULT = pa.schema([("script_key", pa.string()), ("reward", pa.float64()), ("feedback", pa.string())])


# Runs in the interpreter that a task starts: forks for each line that comes in, tells the
# child's process number, and when it has ended. The child is all that the script sees of it.
SERVER = """
import atexit, gc, io, json, linecache, os, re, resource, signal, sys, threading, traceback, types

def run(job):
    os.setsid()
    for kind, most in job["limits"]:
        resource.setrlimit(kind, (most, most))
    os.chdir(job["work"])
    for number, path, how in ((0, os.devnull, os.O_RDONLY), (1, job["out"], os.O_WRONLY), (2, job["err"], os.O_WRONLY)):
        opened = os.open(path, how)
        os.dup2(opened, number)
        os.close(opened)
    sys.argv[:] = [job["script"]]
    main = types.ModuleType("__main__")
    main.__file__, main.__builtins__ = job["script"], __builtins__
    sys.modules["__main__"] = main
    try:
        try:
            with open(job["script"], encoding="utf-8", newline="") as file:
                code = compile(file.read(), job["script"], "exec", dont_inherit=True)
            exec(code, main.__dict__)
        finally:
            threading._shutdown()
            atexit._run_exitfuncs()
    except SystemExit as end:
        if end.code is not None and not isinstance(end.code, int):
            print(end.code, file=sys.stderr)
    except BaseException as problem:
        trace = problem.__traceback__.tb_next
        sys.excepthook(type(problem), problem.with_traceback(trace), trace)
    finally:
        for stream in (sys.stdout, sys.stderr):
            try:
                stream.flush()
            except (OSError, ValueError, AttributeError):
                pass

asks, tells = os.fdopen(int(sys.argv[1]), "r", encoding="utf-8"), os.fdopen(int(sys.argv[2]), "w", encoding="utf-8")
gc.freeze()
while line := asks.readline():
    child = os.fork()
    if not child:
        try:
            asks.close()
            tells.close()
            run(json.loads(line))
        finally:
            os._exit(0)
    print(child, file=tells, flush=True)
    os.waitpid(child, 0)
    print("ended", file=tells, flush=True)
"""


class ForkServer:
    """One interpreter with an empty environment that runs a script in a fork of itself."""

    def __init__(self) -> None:
        self.process: subprocess.Popen | None = None

    def __enter__(self) -> ForkServer:
        return self

    def __exit__(self, *_) -> None:
        if self.process is not None:
            self._tell.close()
            os.close(self._hear)
            self.process.kill()
            self.process.wait()
            self.process = None

    def _start(self) -> None:
        asks, tell = os.pipe()
        hear, tells = os.pipe()
        try:
            self.process = subprocess.Popen(
                [sys.executable, "-I", "-c", SERVER, str(asks), str(tells)],
                stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, cwd="/", env={},
                start_new_session=True, pass_fds=(asks, tells),
            )
        finally:
            os.close(asks)
            os.close(tells)
            # Heard without a buffer that would hide what has come from ``select``.
            self._tell, self._hear, self._left = os.fdopen(tell, "w", encoding="utf-8"), hear, b""

    def _heard(self, seconds: float | None = None) -> bytes | None:
        """The next line of the interpreter; None if none comes in time, empty if it has ended."""
        until = None if seconds is None else time.monotonic() + seconds
        while b"\n" not in self._left:
            ready, _, _ = select.select([self._hear], [], [], None if until is None else max(0.0, until - time.monotonic()))
            if not ready:
                return None
            more = os.read(self._hear, 1 << 12)
            if not more:
                return b""
            self._left += more
        line, _, self._left = self._left.partition(b"\n")
        return line

    def run(self, job: dict, seconds: float) -> bool:
        """Whether the script ended in time. Its whole process group is gone afterwards."""
        if self.process is None or self.process.poll() is not None:
            self.__exit__()
            self._start()
        print(json.dumps(job), file=self._tell, flush=True)
        child = int(self._heard() or 0)
        if not child:
            self.__exit__()
            raise OSError("the interpreter has ended")
        ended = self._heard(seconds)
        try:
            os.killpg(child, signal.SIGKILL)
        except ProcessLookupError:
            if ended is None:  # it has not made its group yet
                os.kill(child, signal.SIGKILL)
        if ended == b"" or ended is None and self._heard() == b"":
            self.__exit__()  # the next script gets a new one
        return ended is not None


def _limits(seconds: float, memory_bytes: int | None, file_bytes: int | None) -> list[tuple[int, int]]:
    limits = {resource.RLIMIT_CPU: int(seconds) + 1, resource.RLIMIT_CORE: 0}
    limits |= {resource.RLIMIT_AS: memory_bytes} if memory_bytes is not None else {}
    limits |= {resource.RLIMIT_FSIZE: file_bytes} if file_bytes is not None else {}
    return [(int(kind), most) for kind, most in limits.items()]


def _read(streams, mark: str) -> tuple[bool, str]:
    """Whether the mark stands in what the streams hold on end, and the beginning of that without blanks around it.

    Read as text is: UTF-8 or an error, all line ends as newlines. Output of any
    length is looked through, but not held.
    """
    found, tail, head, more = False, "", "", False
    for stream in streams:
        stream.seek(0)
        text = io.TextIOWrapper(stream, encoding="utf-8")
        while chunk := text.read(CHUNK):
            found = found or mark in tail + chunk
            tail = (tail + chunk)[-len(mark) :]
            if len(head) < FEEDBACK_CHARS:
                head = (head + chunk).lstrip()
                more = len(head) > 2 * CHUNK
                head = head[: 2 * CHUNK]
            else:
                more = more or bool(chunk.strip())
        text.detach()
    return found, (head if more else head.rstrip())[:FEEDBACK_CHARS]


def judge_script(
    script: str,
    mark: str,
    seconds: float,
    memory_bytes: int | None = None,
    file_bytes: int | None = None,
    server: ForkServer | None = None,
) -> tuple[float, str]:
    """(reward, feedback) of one script that prints ``mark`` when its tests pass."""
    if server is None:
        with ForkServer() as own:
            return judge_script(script, mark, seconds, memory_bytes, file_bytes, own)
    with tempfile.TemporaryDirectory(ignore_cleanup_errors=True) as home:
        # As a file, for a script may be longer than a message; not in its own working folder.
        job = {name: os.path.join(home, name) for name in ("script", "work", "out", "err")}
        job["limits"] = _limits(seconds, memory_bytes, file_bytes)
        try:
            os.mkdir(job["work"])
            for name, text in (("script", script), ("out", ""), ("err", "")):
                with open(job[name], "w", encoding="utf-8", newline="") as file:
                    file.write(text)
            in_time = server.run(job, seconds)
        except (OSError, ValueError, subprocess.SubprocessError) as problem:
            return 0.0, str(problem)[:FEEDBACK_CHARS]
        if not in_time:
            return 0.0, TIMEOUT_TEXT
        with open(job["out"], "rb") as out, open(job["err"], "rb") as err:
            try:
                passed, shown = _read((out, err), mark)
            except UnicodeDecodeError as problem:
                return 0.0, str(problem)[:FEEDBACK_CHARS]
        return (1.0, PASS_TEXT) if passed else (0.0, shown)


def _runner(seconds: float, memory_bytes: int | None, file_bytes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ForkServer() as server:
            for batch in batches:
                verdicts = [
                    (row["script_key"], *judge_script(row["script"], row["mark"], seconds, memory_bytes, file_bytes, server))
                    for row in batch.to_pylist()
                ]
                columns = list(zip(*verdicts)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)

    return run


def verify_completions(
    completions: DataFrame,
    seconds: float = SECONDS,
    task_seconds: float = TASK_SECONDS,
    memory_bytes: int | None = None,
    file_bytes: int | None = None,
) -> DataFrame:
    """Add reward and feedback to completions (text, test).

    ``memory_bytes`` and ``file_bytes`` limit what each script may use; without
    them a script has what its executor has. Output that is no UTF-8 earns 0.
    A task gets as many scripts as take ``task_seconds`` if all use up their
    time, and tasks run in rounds of ROUND_TASKS.

    Equal (code, test) pairs run once, wherever they come from. Scripts and then
    verdicts are written to the shared folder: the number of tasks follows the
    number of scripts, a lost executor does not run code again that was already
    judged, and all readers see one verdict.
    """
    spark = completions.sparkSession
    code, test = F.coalesce(extract_code(F.col("text")), F.lit("")), F.coalesce("test", F.lit(""))
    # The length keeps apart pairs that only differ in where the code ends.
    script_key = F.sha2(F.concat(F.length("_code"), F.lit(":"), F.col("_code"), test), 256)
    coded = completions.withColumn("_code", code).withColumn("script_key", script_key)
    pairs = coded.groupBy("script_key", F.col("_code").alias("code"), test.alias("test")).agg(
        F.count(F.lit(1)).alias("n")
    )
    scripts_path, verdicts_path = fresh_dir(spark, "scripts"), fresh_dir(spark, "verdicts")
    pairs.write.parquet(scripts_path)

    scripts = spark.read.parquet(scripts_path)
    tasks = max(spark.sparkContext.defaultParallelism, -(-scripts.count() // max(1, int(task_seconds / seconds))))
    rounds = -(-tasks // ROUND_TASKS)
    script = build_script(F.col("code"), F.col("test"), F.col("mark")).alias("script")
    schema = "script_key string, reward double, feedback string"
    run = _runner(seconds, memory_bytes, file_bytes)
    for turn in range(rounds):
        part = scripts.filter(F.pmod(F.xxhash64("script_key"), F.lit(rounds)) == turn)
        marked = part.repartition(-(-tasks // rounds), "script_key").withColumn("mark", F.uuid())
        marked.select("script_key", "mark", script).mapInArrow(run, schema).write.mode("append").parquet(verdicts_path)

    # Both sides are tables, so adaptive execution splits a script that very many completions share.
    verdicts = spark.read.schema(schema).parquet(verdicts_path)
    return coded.drop("_code").join(verdicts, "script_key").drop("script_key")

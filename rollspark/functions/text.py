"""Text rules of the reward stage as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Every character that counts as white space when text is stripped.
WHITESPACE = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    ]
)
FENCE = "```"
PYTHON_FENCE = "```python"

# Verdict texts and limits.
PASS_TEXT = "All tests passed."
TIMEOUT_TEXT = "Timed out."
FEEDBACK_CHARS = 600
PASS_MARK = "__ALL_PASSED__"
FAIL_MARK = "__FAILED__"

# Wording of the feedback to a failed completion.
FEEDBACK_HEAD = "Your code:\n```python\n"
FEEDBACK_ERROR = "\n```\n\nError: "
FEEDBACK_DEMO = "\n\nHere is a working solution:\n```python\n"
FEEDBACK_DEMO_END = "\n```\n\nWrite a corrected version."
FEEDBACK_NO_DEMO = "\n\nIdentify and fix the mistake."
RETRY_BRIDGE = "\n\nNow write the corrected code for:\n"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def _fenced_body(text: Column, fence: str) -> Column:
    """Stripped text between the first ``fence`` and the next closing fence; null without one."""
    at = F.instr(text, fence)
    rest = F.substr(text, at + F.lit(len(fence)))
    return F.when(at > 0, strip(F.substring_index(rest, FENCE, 1)))


def extract_code(text: Column) -> Column:
    """E1. First non-empty of: python fence, any fence, the whole text."""
    tagged = _fenced_body(text, PYTHON_FENCE)
    plain = _fenced_body(text, FENCE)
    return F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(plain, F.lit("")), strip(text))


def test_lines(test: Column) -> Column:
    """Non-blank lines of a test text, relative indentation kept."""
    return F.filter(F.split(strip(test), "\n", -1), lambda line: strip(line) != "")


def build_script(code: Column, test: Column, mark: Column | str = PASS_MARK) -> Column:
    """E2. Script that runs the code, then its tests, and prints ``mark`` if they pass."""
    mark = mark if isinstance(mark, Column) else F.lit(mark)
    # The frame around the test lines.
    body = F.transform(test_lines(test), lambda line: F.concat(F.lit("    "), line))
    passed = F.concat(F.lit("    print('"), mark, F.lit("')"))
    handler = F.lit(
        "except Exception as exc:\n    import traceback\n"
        f"    print('{FAIL_MARK}')\n    traceback.print_exc()"
    )
    frame = F.array(code, F.lit(""), F.lit("try:"))
    return F.array_join(F.concat(frame, body, F.array(passed, handler)), "\n")


def verdict_passed(output: Column, timed_out: Column, launch_error: Column, mark: Column | str = PASS_MARK) -> Column:
    mark = mark if isinstance(mark, Column) else F.lit(mark)
    return launch_error.isNull() & ~timed_out & F.contains(output, mark)


def verdict(
    stdout: Column, stderr: Column, timed_out: Column, launch_error: Column, mark: Column | str = PASS_MARK
) -> tuple[Column, Column]:
    """E4. (reward, feedback) from what a script printed."""
    output = F.concat(stdout, stderr)
    passed = verdict_passed(output, timed_out, launch_error, mark)
    reward = F.when(passed, F.lit(1.0)).otherwise(F.lit(0.0))
    feedback = (
        F.when(launch_error.isNotNull(), F.left(launch_error, F.lit(FEEDBACK_CHARS)))
        .when(timed_out, F.lit(TIMEOUT_TEXT))
        .when(passed, F.lit(PASS_TEXT))
        .otherwise(F.left(strip(output), F.lit(FEEDBACK_CHARS)))
    )
    return reward, feedback


def build_feedback(failed: Column, error: Column, demo: Column) -> Column:
    """E5. Feedback on a failed completion; ``demo`` is null when no solution is known."""
    ending = F.when(
        demo.isNotNull(), F.concat(F.lit(FEEDBACK_DEMO), demo, F.lit(FEEDBACK_DEMO_END))
    ).otherwise(F.lit(FEEDBACK_NO_DEMO))
    return F.concat(F.lit(FEEDBACK_HEAD), failed, F.lit(FEEDBACK_ERROR), error, ending)


@dataclass(frozen=True)
class ChatTemplate:
    """Texts around one user turn."""

    # Turn marks of the default chat format.
    user_open: str = "<start_of_turn>user\n"
    user_close: str = "<end_of_turn>\n"
    reply_open: str = "<start_of_turn>model\n"


def render_prompt(prompt: Column, template: ChatTemplate | None = ChatTemplate()) -> Column:
    """E7. One user turn and the opening of the reply; unchanged without a template."""
    if template is None:
        return prompt
    return F.concat(F.lit(template.user_open), prompt, F.lit(template.user_close + template.reply_open))


def teacher_prompt(feedback: Column, prompt: Column, template: ChatTemplate | None = ChatTemplate()) -> Column:
    """E6. Feedback, then the problem again, rendered as a chat turn."""
    return render_prompt(F.concat(feedback, F.lit(RETRY_BRIDGE), prompt), template)

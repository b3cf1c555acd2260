import pytest
from pyspark.sql import functions as F

from rollspark.functions import tokens as T

SCHEMA = "ids array<int>, pl int"


@pytest.mark.parametrize("n,expected", [(2, [1, 2]), (9, [1, 2, 3])])
def test_truncate_prompt(one, n, expected):
    assert one(SCHEMA, [1, 2, 3], 0)(T.truncate_prompt(F.col("ids"), n)) == expected


@pytest.mark.parametrize(
    "ids,pl,expected",
    [
        ([5, 0, 7, 8, 0, 9, 0], 2, [5, 0, 7, 8, 0]),  # the end token of the prompt does not count
        ([5, 6, 0, 8], 2, [5, 6, 0]),  # first response token
        ([5, 6, 7], 1, [5, 6, 7]),
        ([0, 0], 2, [0, 0]),
        ([0, 1], 0, [0]),
        ([0, 1], 5, [0, 1]),
        ([], 0, []),
    ],
)
def test_cut_at_eos(one, ids, pl, expected):
    assert one(SCHEMA, ids, pl)(T.cut_at_eos(F.col("ids"), F.col("pl"), 0)) == expected


@pytest.mark.parametrize(
    "length,pl,response,loss",
    [(4, 2, [0, 0, 1, 1], [0, 0, 1, 1]), (3, 0, [1, 1, 1], [0, 1, 1]), (2, 5, [0, 0], [0, 0]), (0, 0, [], [])],
)
def test_masks(one, length, pl, response, loss):
    value = one("n int, pl int", length, pl)
    assert value(T.response_mask(F.col("n"), F.col("pl"))) == response
    assert value(T.loss_mask(F.col("n"), F.col("pl"))) == loss
    assert value(T.response_tokens(F.col("n"), F.col("pl"))) == sum(loss)


@pytest.mark.parametrize(
    "lp,length,pl,expected",
    [([-1.0, -2.0, -3.0], 5, 3, [-1.0, -2.0]), ([-1.0], 5, 3, [-1.0]), (None, 5, 3, []), ([-1.0], 2, 3, [])],
)
def test_align_logprobs(one, lp, length, pl, expected):
    value = one("lp array<double>, n int, pl int", lp, length, pl)
    assert value(T.align_logprobs(F.col("lp"), F.col("n"), F.col("pl"))) == expected


@pytest.mark.parametrize(
    "pl,limit,ids,new_pl",
    [
        (4, 0, list(range(10)), 4),
        (4, None, list(range(10)), 4),
        (8, 6, list(range(4, 10)), 4),
        (3, 6, list(range(4, 10)), 0),
        (3, 10, list(range(10)), 3),
    ],
)
def test_training_window(one, pl, limit, ids, new_pl):
    value = one(SCHEMA, list(range(10)), pl)
    window, prompt_len = T.training_window(F.col("ids"), F.col("pl"), limit)
    assert value(window) == ids
    assert value(prompt_len) == new_pl


def test_positions_and_padding(spark):
    masks = [[1, 1, 1], [0, 0, 1, 1], [], None, [1, 0, 1], [0]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "i int, mask array<int>").coalesce(1)
    got = df.select("i", T.mask_positions("mask").alias("p"), T.is_unpadded(F.col("mask")).alias("whole")).collect()
    assert [r["p"] for r in sorted(got)] == [[0, 1, 2], [0, 0, 0, 1], [], None, [0, 0, 1], [0]]
    assert [r["whole"] for r in sorted(got)] == [True, False, True, None, False, False]


def test_padded_rows_can_be_refused(spark):
    df = spark.createDataFrame([([1, 2], [1, 1]), ([3], [0])], "ids array<int>, mask array<int>")
    checked = df.select(T.require_unpadded(F.col("ids"), F.col("mask")).alias("ids"))
    assert checked.filter(F.size("mask") == 2).first()["ids"] == [1, 2]
    with pytest.raises(Exception, match="must not be padded"):
        checked.collect()

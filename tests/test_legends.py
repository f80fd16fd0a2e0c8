"""Legends of equal size and equal area against cutoffs worked out by hand."""

import pytest

from terrafacet.operators import legends


def cutoffs(spark, legend, values):
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    return [(r.k, r.cutoff) for r in sorted(legend(frame, "v").collect())]


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (range(1, 24), [*zip(range(1, 11), (3, 6, 9, 11, 13, 15, 17, 19, 21, 23))]),
        # 1 stands alone and takes on 2, which has two records; 10 is the maximum
        ([1, 2, *range(2, 11)], [*zip(range(1, 9), range(2, 10)), (10, 10)]),
        ([5, 5, 5], [(1, 5), (10, 5)]),
        ([], []),
    ],
)
def test_equal_size(spark, values, want):
    assert cutoffs(spark, legends.equal_size, values) == want


@pytest.mark.parametrize(
    ("values", "want"),
    [
        # the first class holds one record more than a step
        (range(1, 21), [3, 5, 7, 9, 11, 13, 15, 17, 19, 20]),
        # 1 is a class of its own; a step of a sixth less fills the ten classes
        ([1] * 50 + [*range(2, 12)], [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]),
        ([1] * 3 + [2] * 4, [1, 2]),
        ([float("nan"), 7], [7]),
        ([], []),
    ],
)
def test_equal_area(spark, values, want):
    assert cutoffs(spark, legends.equal_area, values) == [*zip(range(1, 11), want)]

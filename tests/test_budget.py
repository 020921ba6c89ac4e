"""Admission under budgets against the plain loop."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest

from recallbase.operators import budget

SCHEMA = "id long, at timestamp_ntz, cost long, block int, day string, row string"


def plain(rows, daily, monthly):
    out, days, months = Counter(), Counter(), Counter()
    paid = [r for r in rows if r[2] is not None and r[2] > 0]
    out.update((r[0], True) for r in rows if r[2] is None or r[2] <= 0)
    for i, at, cost in sorted(paid, key=lambda r: (r[1] is not None, r[1] or datetime.datetime.min, r[0], r[2])):
        d = at and at.date()
        m = at and (at.year, at.month)
        fits = (not daily or days[d] + cost <= daily) and (not monthly or months[m] + cost <= monthly)
        if fits:
            days[d] += cost
            months[m] += cost
        out[i, fits] += 1
    return out


def got(spark, rows, daily, monthly, block):
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(3)
    return Counter((r.id, r.granted) for r in budget.reserve(df, daily, monthly, block).collect())


def requests(seed, n, days, most):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 20)
    return [(i, start + datetime.timedelta(minutes=rng.randrange(days * 1440)), int(most ** rng.random()) + 1) for i in range(n)]


@pytest.mark.parametrize(("daily", "monthly"), [(3000, 20_000), (3000, None), (None, 9000), (None, None), (900, 40_000)])
def test_is_the_plain_loop(spark, daily, monthly):
    rows = requests(1, 500, 25, 700)
    want = plain(rows, daily, monthly)
    assert got(spark, rows, daily, monthly, 40) == want
    if daily or monthly:
        refused = {i for i, ok in want if not ok}
        assert refused and any(ok and i > min(refused) for i, ok in want)  # small ones still fit behind a refusal


def test_one_day_with_all_rows_has_many_blocks(spark):
    rows = [(i, datetime.datetime(2024, 5, 5, 12), c) for i, _, c in requests(2, 600, 1, 300)]
    df = budget.in_blocks_of_time(spark.createDataFrame(rows, "id long, at timestamp_ntz, cost long"), 50)
    sizes = Counter(r.block for r in df.collect())
    assert len(sizes) >= 10 and max(sizes.values()) <= 150
    assert got(spark, rows, 7000, 6500, 50) == plain(rows, 7000, 6500)


def test_awkward_requests(spark):
    t = datetime.datetime(2024, 1, 31, 23, 59, 59)
    rows = [(1, t, 5), (1, t, 5), (1, t, 4), (2, t, 11), (3, t, 0), (4, t, None), (5, t, -3), (6, None, 8), (7, None, 8), (8, t + datetime.timedelta(seconds=1), 10), (9, t, 1)]
    assert got(spark, rows, 10, 15, 3) == plain(rows, 10, 15)
    assert not got(spark, [], 10, 15, 3)

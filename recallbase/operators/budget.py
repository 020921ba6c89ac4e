"""Admission under a daily and a monthly budget, in order, where a refused request uses nothing.

Whether a request fits depends on all those before it, but only near a limit. Requests lie in blocks by time and id, so a day that
holds all rows has as many blocks as its rows ask for. In a round every chain (a day; then a month, for what its limit
touches) adds up its blocks: up to the first block in which a limit is passed all requests fit. Only that block is
walked, in one task. What is left of the budget afterwards is all there will be, so requests that cost more are refused
at once, and the next round goes on behind the block with those that are left, which near a limit are few. All chains
take their rounds together.

Days come first, as if there were no monthly limit. That settles every month up to the request where its limit is passed;
from there on the month is one chain with both limits.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallbase.operators.shared import cut, small

#: Requests in a block, about.
BLOCK = 20_000
#: A limit that isn't there.
NONE = 1 << 62

_WALKED = "row long, granted boolean, chain timestamp_ntz, outer_left long, day timestamp_ntz, day_left long"


def in_blocks_of_time(requests: DataFrame, size: int | None = None) -> DataFrame:
    """requests with `block`, numbers of ranges of (at, id, cost) that ascend with them, and `row`, a number of its own for each."""
    parts = max(1, -(-requests.count() // (size or BLOCK)))
    ranged = requests.repartitionByRange(parts, "at", "id", "cost") if parts > 1 else requests.coalesce(1)
    return cut(ranged.withColumn("block", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))


def admitted(rows: DataFrame, state: DataFrame, daily: int) -> DataFrame:
    """row of the requests (row, chain, day, block, at, id, cost above 0) that fit. state: chain, outer_left, day, day_left, where each chain begins; earlier days are over."""
    found = []
    order = Window.partitionBy("chain").orderBy("day", "block").rowsBetween(Window.unboundedPreceding, -1)
    of_day = Window.partitionBy("chain", "day").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "id", "cost"], kind="stable")
        outer, inner, granted = int(part["outer_left"].iloc[0]), int(part["left"].iloc[0]), []
        for cost in part["cost"].tolist():
            fits = cost <= outer and cost <= inner
            granted.append(fits)
            if fits:
                outer, inner = outer - cost, inner - cost
        return pd.DataFrame({"row": part["row"], "granted": granted, "chain": part["chain"], "outer_left": outer, "day": part["day"], "day_left": inner})

    rest = rows
    while True:
        left = F.when(F.col("day") == F.col("_day"), F.col("_day_left")).otherwise(daily)
        now = rest.join(small(state.withColumnsRenamed({"day": "_day", "day_left": "_day_left"})), "chain").where(F.col("_day").isNull() | (F.col("day") >= F.col("_day")))
        rest = cut(now.withColumn("left", left).where(F.col("cost") <= F.least("outer_left", "left")).select(*rows.columns, "outer_left", "left"))
        sums = rest.groupBy("chain", "day", "block", "outer_left", "left").agg(F.sum("cost").alias("total"))
        told = sums.withColumn("before", F.coalesce(F.sum("total").over(order), F.lit(0))).withColumn("day_before", F.coalesce(F.sum("total").over(of_day), F.lit(0)))
        over = (F.col("before") + F.col("total") > F.col("outer_left")) | (F.col("day_before") + F.col("total") > F.col("left"))
        first = F.min(F.when(over, F.struct("day", "block", "before", "day_before")))
        crossing = cut(told.groupBy("chain").agg(first.alias("x")).where("x is not null").select("chain", F.col("x.day").alias("x_day"), F.col("x.block").alias("x_block"), "x.before", "x.day_before"))  # a row per chain
        met = rest.join(small(crossing), "chain", "left")
        place, at = F.struct("day", "block"), F.struct(F.col("x_day").alias("day"), F.col("x_block").alias("block"))
        found.append(met.where(F.col("x_day").isNull() | (place < at)).select("row"))
        if crossing.isEmpty():
            return reduce(DataFrame.unionByName, found)
        block = met.where(place == at).select("chain", "day", "at", "id", "row", "cost", (F.col("outer_left") - F.col("before")).alias("outer_left"), (F.col("left") - F.col("day_before")).alias("left"))
        walked = cut(block.groupBy("chain").applyInPandas(walk, _WALKED))
        found.append(walked.where("granted").select("row"))
        state = cut(walked.select("chain", "outer_left", "day", "day_left").distinct())  # one for each chain that was walked
        rest = met.where(place > at).select(*rows.columns)


def reserve(requests: DataFrame, daily: int | None = None, monthly: int | None = None, block: int | None = None) -> DataFrame:
    """id, granted of requests (id, at, cost): in order of at, then id, each gets its cost if it fits what is left of its day and of its month. None: no limit.

    Costs are whole numbers (millionths of a currency, tokens), so sums don't depend on their order; repeated requests
    count each for itself, those of one time and id in order of their cost. A cost that is null or not above 0
    is granted and uses nothing. A request without a time counts to the first day of 1700.
    """
    rows = requests.select("id", F.col("at").cast("timestamp_ntz").alias("at"), F.col("cost").cast("long").alias("cost"))
    never = F.lit("1700-01-01 00:00:00").cast("timestamp_ntz")
    day, month = (F.coalesce(F.date_trunc(unit, "at").cast("timestamp_ntz"), never) for unit in ("day", "month"))
    paid = in_blocks_of_time(rows.where("cost > 0").withColumn("day", day).withColumn("month", month), block)
    day_limit, month_limit = daily or NONE, monthly or NONE
    by_day = paid.withColumn("chain", F.col("day"))
    fresh = lambda chain, outer: chain.select("chain", F.lit(outer).alias("outer_left"), F.lit(None).cast("timestamp_ntz").alias("day"), F.lit(day_limit).alias("day_left"))
    granted = cut(admitted(by_day.drop("month"), fresh(by_day.select("chain").distinct(), NONE), day_limit)).withColumn("_in", F.lit(True))
    if month_limit < NONE:
        marked = cut(paid.join(granted, "row", "left"))
        sums = marked.where("_in").groupBy("month", "day", "block").agg(F.sum("cost").alias("total"))
        order = Window.partitionBy("month").orderBy("day", "block")
        told = sums.withColumn("after", F.sum("total").over(order)).withColumn("of_day", F.sum("total").over(Window.partitionBy("month", "day").orderBy("block")))
        over = F.min(F.when(F.col("after") > month_limit, F.struct("day", "block", (F.col("after") - F.col("total")).alias("spent"), (F.col("of_day") - F.col("total")).alias("of_day"))))
        edge = cut(told.groupBy("month").agg(over.alias("x")).where("x is not null").select("month", F.col("x.day").alias("x_day"), F.col("x.block").alias("x_block"), "x.spent", "x.of_day"))  # a row per month
        met = marked.join(small(edge), "month", "left")
        settled = F.col("x_day").isNull() | (F.struct("day", "block") < F.struct(F.col("x_day").alias("day"), F.col("x_block").alias("block")))
        open_rows = met.where(~settled).select("row", "id", "at", "cost", "day", F.col("month").alias("chain"), "block")
        state = edge.select(F.col("month").alias("chain"), (month_limit - F.col("spent")).alias("outer_left"), F.col("x_day").alias("day"), (day_limit - F.col("of_day")).alias("day_left"))
        granted = met.where(settled & F.col("_in")).select("row").unionByName(admitted(open_rows, state, day_limit)).withColumn("_in", F.lit(True))
    paid_for = paid.select("row", "id").join(granted, "row", "left").select("id", F.coalesce("_in", F.lit(False)).alias("granted"))
    return paid_for.unionByName(rows.where("cost is null or cost <= 0").select("id", F.lit(True).alias("granted")))

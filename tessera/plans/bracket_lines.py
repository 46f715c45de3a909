"""Lines through brackets: a user's events in order are frames, each bracketed about its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lines
from tessera.operators.windows import dealt, running
from tessera.plans.catalogue import register
from tessera.plans.tables import events, r6

_B = """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, epoch_us(ts) / 3.6e9 AS t, 40 + event_id % 60 AS wide FROM events),
b AS (SELECT user_id, n, t - wide AS lo, t + wide AS hi FROM e)
"""


def brackets(spark: SparkSession, d: str) -> DataFrame:
    """user_id, n (place of the event), lo and hi in hours."""
    e = events(spark, d).select("user_id", "t", "event_id", F.lit(1).alias("_one"))
    f = running(dealt(e, key=["user_id"], by="t"), key=["user_id"], order=["t", "event_id"], sums={"k": "_one"})
    t, wide = F.col("t") / 3.6e9, 40 + F.col("event_id") % 60
    return f.select("user_id", (F.col("k") - 1).alias("n"), (t - wide).alias("lo"), (t + wide).alias("hi"))


@register(_B + """,
p AS (SELECT a.user_id, max((b.lo - a.hi) / (b.n - a.n)) AS low, min((b.hi - a.lo) / (b.n - a.n)) AS high FROM b a JOIN b ON a.user_id = b.user_id AND a.n < b.n GROUP BY 1)
SELECT user_id, count(*) AS brackets, any_value(low <= high) AS feasible, round(any_value(CASE WHEN low <= high THEN low END), 6) AS period_low, round(any_value(CASE WHEN low <= high THEN high END), 6) AS period_high FROM b JOIN p USING (user_id) GROUP BY 1
""")
def feasible_periods(spark: SparkSession, d: str) -> DataFrame:
    """The least and greatest period of the lines that meet all of a user's brackets, if there are any."""
    f = lines.feasible_lines(brackets(spark, d), key="user_id", n="n", lo="lo", hi="hi").where("slack is not null")
    fits = F.col("slack") == 0
    return f.select("user_id", "brackets", fits.alias("feasible"), r6(F.when(fits, F.col("period_low"))).alias("period_low"), r6(F.when(fits, F.col("period_high"))).alias("period_high"))


@register()
def bracket_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line nearest to the middles of a user's brackets among those that meet them all, widened where none does."""
    return lines.feasible_lines(brackets(spark, d), key="user_id", n="n", lo="lo", hi="hi")


@register(_B + """,
a AS (SELECT user_id, count(*) // 2 AS centre FROM b GROUP BY 1), k AS (SELECT user_id, n, centre - n AS k, lo, hi FROM b JOIN a USING (user_id)),
m AS (SELECT user_id, n, abs(k) AS far, lo + k * CASE WHEN k > 0 THEN 9.0 ELSE 12.0 END AS early, hi + k * CASE WHEN k > 0 THEN 12.0 ELSE 9.0 END AS late FROM k),
r AS (SELECT user_id, max(early) OVER w AS e, min(late) OVER w AS l, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS c FROM m WINDOW w AS (PARTITION BY user_id ORDER BY far, n)),
g AS (SELECT *, CASE WHEN e <= l THEN 1 ELSE 0 END AS met FROM r)
SELECT user_id, round(arg_max(e, met * 1000000000 + i), 6) AS low, round(arg_max(l, met * 1000000000 + i), 6) AS high, cast(CASE WHEN sum(met) > 0 THEN sum(met) ELSE any_value(c) END AS BIGINT) AS used FROM g GROUP BY 1
""")
def projected_brackets(spark: SparkSession, d: str) -> DataFrame:
    """A user's brackets moved by whole periods of 9 to 12 hours to the middle event and intersected."""
    b = brackets(spark, d)
    at = b.groupBy("user_id").agg(F.floor(F.count("*") / 2).alias("at"))
    p = lines.projected(b.join(at, "user_id"), key="user_id", index="n", lo="lo", hi="hi", at="at", period=(9.0, 12.0))
    return p.select("user_id", r6("low").alias("low"), r6("high").alias("high"), "used")

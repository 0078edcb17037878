"""Event, interval, position, recording, series and rule tables derived from the
given tables, as Spark frames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ordering

# Event names of the derived point events, in list order, and the target list.
POINTS = ("signup", "view", "click", "purchase", "error", "stopped", "lowSpeed")
TARGETS = ("rendezVous",)

_SECONDS = (
    "(datediff(to_date(ts), date'1970-01-01') * 86400L"
    " + hour(ts) * 3600 + minute(ts) * 60 + second(ts))"
)
_DAYS = "datediff(to_date(ts), date'2024-01-01')"
_OF_DAY = "hour(ts) * 3600 + minute(ts) * 60 + second(ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq",
        "event_type AS lle",
        f"CAST({_SECONDS} AS BIGINT) AS time",
        "concat('v', CAST(user_id AS STRING)) AS vessel",
        "CAST(NULL AS STRING) AS area",
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = ordering.neighbour_value(
        points(spark, sf_dir),
        F.col("time"),
        F.struct("time", "seq"),
        ordering.int_slices("time", 18),
        ["vessel"],
        "nxt",
        following=True,
    )
    return (
        following
        .where("nxt IS NOT NULL AND lle IN ('purchase', 'view', 'signup')")
        .selectExpr(
            "seq",
            "CASE lle WHEN 'purchase' THEN 'rendezVous' WHEN 'view' THEN 'stopped'"
            " ELSE 'lowSpeed' END AS hle",
            "CASE WHEN lle = 'purchase' THEN array(vessel, concat(vessel, 'b'))"
            " ELSE array(vessel) END AS vessels",
            "CASE WHEN seq % 3 = 0 THEN 'near' ELSE 'true' END AS value",
            "time AS stime",
            "least(nxt, time + 1800) AS etime",
        )
    )


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        points(spark, sf_dir)
        .where("lle = 'click'")
        .selectExpr(
            "time",
            "vessel",
            "-4.5D + (seq % 100) / 100.0D AS lon",
            "48.0D + (seq % 70) / 100.0D AS lat",
        )
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"CAST(floor({_DAYS} / 5) AS BIGINT) + 1 AS video",
        f"40 * CAST(floor(({_DAYS} % 5 * 86400 + {_OF_DAY}) / 40) AS BIGINT) AS time",
        "concat('id', CAST(user_id % 6 AS STRING)) AS id",
        "event_type AS kind",
        "event_id AS seq",
    )


# One statement per recording row. Members of a group activity repeat an id now
# and then, some verbs are unknown, and some statements hold two atoms.
_STATEMENT_SPARK = """
CASE kind
 WHEN 'click' THEN concat('happensAt( ', element_at(array('walking','active','inactive','running','abrupt','flying'), CAST(seq % 6 AS INT) + 1), '( ', id, ' ), ', time, ' )',
   CASE WHEN seq % 7 = 0 THEN concat('happens( active( id9 ), ', time, ' )') ELSE '' END)
 WHEN 'view' THEN concat('holdsAt( orientation( ', id, ' )=', seq % 360, ', ', time, ' )')
 WHEN 'signup' THEN concat('holdsAt( appearance( ', id, ' )=', element_at(array('appear','disappear','visible'), CAST(seq % 3 AS INT) + 1), ', ', time, ' )')
 WHEN 'error' THEN concat('holdsAt( coord( ', id, ' )=( ', seq % 384, ', ', seq % 288, ' ), ', time, ' )')
 ELSE concat('happensAt( ', element_at(array('interacting','moving','fighting','leaving_object'), CAST(seq % 4 AS INT) + 1), '( grp_ID', seq % 3, ', [ ', id,
   CASE WHEN seq % 11 <> 0 THEN concat(', id', seq % 6) ELSE '' END, CASE WHEN seq % 2 = 1 AND seq % 11 <> 0 THEN ', id7' ELSE '' END, ' ]), ', time, ' )')
END
"""
_STATEMENT_DUCK = """
CASE kind
 WHEN 'click' THEN concat('happensAt(', list_extract(['walking','active','inactive','running','abrupt','flying'], CAST(seq % 6 AS INT) + 1), '(', id, '),', "time", ')',
   CASE WHEN seq % 7 = 0 THEN concat('happens(active(id9),', "time", ')') ELSE '' END)
 WHEN 'view' THEN concat('holdsAt(orientation(', id, ')=', seq % 360, ',', "time", ')')
 WHEN 'signup' THEN concat('holdsAt(appearance(', id, ')=', list_extract(['appear','disappear','visible'], CAST(seq % 3 AS INT) + 1), ',', "time", ')')
 WHEN 'error' THEN concat('holdsAt(coord(', id, ')=(', seq % 384, ',', seq % 288, '),', "time", ')')
 ELSE concat('happensAt(', list_extract(['interacting','moving','fighting','leaving_object'], CAST(seq % 4 AS INT) + 1), '(grp_ID', seq % 3, ',[', id,
   CASE WHEN seq % 11 <> 0 THEN concat(',id', seq % 6) ELSE '' END, CASE WHEN seq % 2 = 1 AND seq % 11 <> 0 THEN ',id7' ELSE '' END, ']),', "time", ')')
END
"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, seq, statement), white space removed, as the statement scan gives it."""
    return recordings(spark, sf_dir).select(
        "video",
        "seq",
        F.regexp_replace(F.expr(_STATEMENT_SPARK), r"\s", "").alias("statement"),
    )


def statement_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, seq, kind, text): statements with their white space, as recorded."""
    return recordings(spark, sf_dir).select(
        "video", "seq", "kind", F.expr(_STATEMENT_SPARK).alias("text")
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, tp, fp): one rule per brand, counted before the part lookup."""
    per_part = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("fp"),
        )
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("rule_id"))
    return (
        per_part.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("rule_id")
        .agg(F.sum("tp").cast("bigint").alias("tp"), F.sum("fp").cast("bigint").alias("fp"))
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS model_id",
        "CAST(l_linenumber AS BIGINT) AS time",
        "l_returnflag AS alive",
        "l_linestatus AS necrotic",
        "CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS apoptotic",
    )


SENSORS = ("click", "view", "purchase", "signup", "error")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per event type as text, with an activity and the hour."""
    hour = f"{_SECONDS} - {_SECONDS} % 3600"
    counts = [
        F.sum(F.when(F.col("event_type") == s, 1).otherwise(0)).cast("string").alias(s) for s in SENSORS
    ]
    activity = F.concat(F.lit("act"), (F.min("user_id") % 4).cast("string")).alias("activity")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.expr(f"CAST({hour} AS BIGINT)").alias("time"))
        .agg(*counts, activity)
    )


def coastline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ring, pos, x, y): a zigzag shore, one vertex per supplier, 50 to a ring."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(floor((s_suppkey - 1) / 50) AS BIGINT) AS ring",
        "s_suppkey AS pos",
        "-4.6D + s_suppkey / 80.0D AS x",
        "48.2D + ((s_suppkey * 37) % 20) / 100.0D AS y",
    )


# The same tables as SQL for DuckDB, to be put in front of a query.
DUCK = {
    "points": """SELECT event_id AS seq, event_type AS lle, CAST(floor(epoch(ts)) AS BIGINT) AS time,
 concat('v', CAST(user_id AS VARCHAR)) AS vessel FROM events""",
    "intervals": """SELECT seq, CASE lle WHEN 'purchase' THEN 'rendezVous' WHEN 'view' THEN 'stopped' ELSE 'lowSpeed' END AS hle,
 vessel AS v1, CASE WHEN lle = 'purchase' THEN concat(vessel, 'b') END AS v2,
 CASE WHEN seq % 3 = 0 THEN 'near' ELSE 'true' END AS value, time AS stime, least(nxt, time + 1800) AS etime
 FROM (SELECT *, lead(time) OVER (PARTITION BY vessel ORDER BY time, seq) AS nxt FROM points) q
 WHERE nxt IS NOT NULL AND lle IN ('purchase', 'view', 'signup')""",
    "coords": """SELECT time, vessel, -4.5E0 + (seq % 100) / 100E0 AS lon, 48E0 + (seq % 70) / 100E0 AS lat
 FROM points WHERE lle = 'click'""",
    "recordings": """SELECT CAST(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5) AS BIGINT) + 1 AS video,
 40 * CAST(floor((datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 5 * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 40) AS BIGINT) AS time,
 concat('id', CAST(user_id % 6 AS VARCHAR)) AS id, event_type AS kind, event_id AS seq FROM events""",
    "statements": f"SELECT video, seq, {_STATEMENT_DUCK} AS statement FROM recordings",
    "rules": """SELECT p_brand AS rule_id, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS tp,
 CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS fp
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "series": """SELECT l_orderkey AS model_id, CAST(l_linenumber AS BIGINT) AS time, l_returnflag AS alive,
 l_linestatus AS necrotic, CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS apoptotic FROM lineitem""",
    "wide": """SELECT CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 3600 AS time,
 CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS VARCHAR) AS click,
 CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS VARCHAR) AS "view",
 CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS VARCHAR) AS purchase,
 CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS VARCHAR) AS signup,
 CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS VARCHAR) AS error,
 concat('act', CAST(MIN(user_id) % 4 AS VARCHAR)) AS activity FROM events GROUP BY 1""",
    "coastline": """SELECT CAST(floor((s_suppkey - 1) / 50) AS BIGINT) AS ring, s_suppkey AS pos, -4.6E0 + s_suppkey / 80E0 AS x,
 48.2E0 + ((s_suppkey * 37) % 20) / 100E0 AS y FROM supplier""",
}

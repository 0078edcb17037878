"""Wide sensor rows and code matrices to atoms, row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import atoms as A

# The codes of the body-worn sensor recordings.
CODE_LABELS = """
0 none
1 stand
2 walk
4 sit
5 lie
101 relaxing
102 coffee_time
103 early_morning
104 cleanup
105 sandwich_time
201 unlock
202 stir
203 lock
204 close
205 reach
206 open
207 sip
208 clean
209 bite
210 cut
211 spread
212 release
213 move
301 bottle
302 salami
303 bread
304 sugar
305 dishwasher
306 switch
307 milk
308 drawer3
309 spoon
310 knife_cheese
311 drawer2
312 table
313 glass
314 cheese
315 chair
316 door1
317 door2
318 plate
319 drawer1
320 fridge
321 cup
322 knife_salami
323 lazychair
401 unlock
402 stir
403 lock
404 close
405 reach
406 open
407 sip
408 clean
409 bite
410 cut
411 spread
412 release
413 move
501 Bottle
502 salami
503 bread
504 sugar
505 dishwasher
506 switch
507 milk
508 drawer3
509 spoon
510 knife_cheese
511 drawer2
512 table
513 glass
514 cheese
515 chair
516 door1
517 door2
518 plate
519 drawer1
520 fridge
521 cup
522 knife_salami
523 lazychair
406516 open_door1
406517 open_door2
404516 close_door1
404517 close_door2
406520 open_fridge
404520 close_fridge
406505 open_dishwasher
404505 close_dishwasher
406519 open_drawer1
404519 close_drawer1
406511 open_drawer2
404511 close_drawer2
406508 open_drawer3
404508 close_drawer3
408512 clean_table
407521 drink_fromCup
405506 toggle_switch
"""
# One-based matrix columns of the seven labels.
MATRIX_COLUMNS = {
    "locomotion": 244,
    "activity": 245,
    "left_verb": 246,
    "left_object": 247,
    "right_verb": 248,
    "right_object": 249,
    "gesture": 250,
}
NONE = "none"


def code_dictionary(spark: SparkSession) -> DataFrame:
    """(code, label), a table of fixed size."""
    lines = F.explode(F.split(F.lit(CODE_LABELS.strip()), "\n")).alias("line")
    pair = F.split("line", " ")
    return spark.range(1).select(lines).select(pair[0].alias("code"), pair[1].alias("label"))


def label_lookup(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replaces the codes in ``columns`` by labels; an unknown code gives null.

    Whether the dictionary is broadcast follows from its measured size.
    """
    out = df
    for c in columns:
        labels = dictionary.select(F.col("code").alias(c), F.col("label").alias(f"_{c}"))
        out = out.join(labels, c, "left")
    return out.select(
        *[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def unknown_codes(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which some code has no label."""
    return labelled.where(F.array_contains(F.array(*[F.col(c).isNull() for c in columns]), True))


def _named(label: str) -> Column:
    return F.col(label) != NONE


def locomotion_atom() -> Column:
    return F.when(
        _named("locomotion"), A.render(A.HAPPENS, "locomotion", F.array("subject"), "time")
    )


def arm_atom(side: str) -> Column:
    verb, thing = f"{side}_verb", f"{side}_object"
    return F.when(
        _named(verb) & _named(thing), A.render(A.HAPPENS, verb, F.array("subject", thing), "time")
    )


def gesture_atom() -> Column:
    words = F.split("gesture", "_")
    return F.when(
        _named("gesture"),
        A.render(
            A.HAPPENS,
            F.get(words, F.lit(0)),
            F.array(F.col("subject"), F.get(words, F.lit(1))),
            "time",
        ),
    )


def activity_atom() -> Column:
    return F.when(_named("activity"), A.render(A.HOLDS, "activity", F.array("subject"), "time"))


def matrix_atoms(labelled: DataFrame) -> DataFrame:
    """Adds ``atoms``: the distinct atoms of a labelled row, in a fixed order."""
    every = F.array(
        locomotion_atom(), arm_atom("left"), arm_atom("right"), gesture_atom(), activity_atom()
    )
    return labelled.withColumn("atoms", F.array_distinct(F.array_compact(every)))


def text_lines(rows: DataFrame) -> DataFrame:
    """``time atom atom …`` as one text column."""
    return rows.select(
        *[c for c in rows.columns if c != "atoms"],
        F.concat(F.col("time").cast("string"), F.lit(" "), F.array_join("atoms", " ")).alias("line"),
    )


def sensor_events(wide: DataFrame, sensors: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per sensor that is not ``0``: (keys, sensor, value)."""
    return wide.unpivot(list(keys), list(sensors), "sensor", "value").where(F.col("value") != "0")


def sensor_documents(
    wide: DataFrame, sensors: Sequence[str], activity: str = "activity", time: str = "time"
) -> DataFrame:
    """(time, annotation, narrative) per wide row, sensors from last to first.

    The lists are built inside the row; nothing is shuffled.
    """
    def fired(s: str) -> Column:
        text = F.concat(F.lit(f"{A.HAPPENS}({s},"), F.col(time).cast("string"), F.lit(")"))
        return F.when(F.col(s) != "0", text)

    label = F.concat(
        F.lit(f"{A.HOLDS}("), F.col(activity), F.lit(","), F.col(time).cast("string"), F.lit(")")
    )
    return wide.select(
        F.col(time).alias("time"),
        F.array(label).alias(A.ANNOTATION),
        F.array_compact(F.array(*[fired(s) for s in reversed(sensors)])).alias(A.NARRATIVE),
    )

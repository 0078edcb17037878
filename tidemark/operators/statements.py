"""Recording statements to atoms: split, recognise, expand, shift in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FRAME_STEP
from tidemark.functions import atoms as A
from tidemark.operators import ordering
from tidemark.session import Stage, keep

# Names a statement may use, and the labels activities are given.
MOVEMENTS = ("walking", "active", "inactive", "running", "abrupt")
ACTIVITY_LABELS = {
    "interacting": "meeting",
    "moving": "moving",
    "fighting": "fighting",
    "leaving_object": "leavingObject",
}
INSTANT_APPEARANCES = ("appear", "disappear")
ORDERED_PAIR_ACTIVITY = "leaving_object"

_WORD, _PERSON, _NUMBER = "[A-Za-z0-9_]*", "id[0-9]+", "[0-9]+"
_HAPPENS = "happens(?:At)?"
PATTERNS = {
    "activity": rf"{_HAPPENS}\((?:{'|'.join(ACTIVITY_LABELS)})\({_WORD},"
    rf"\[(?:{_PERSON}(?:,{_PERSON})*)?\]\),{_NUMBER}\)",
    "movement": rf"{_HAPPENS}\((?:{'|'.join(MOVEMENTS)})\({_PERSON}\),{_NUMBER}\)",
    "orientation": rf"holdsAt\(orientation\({_PERSON}\)={_NUMBER},{_NUMBER}\)",
    "appearance": rf"holdsAt\(appearance\({_PERSON}\)={_WORD},{_NUMBER}\)",
    "coord": rf"holdsAt\(coord\({_PERSON}\)=\({_NUMBER},{_NUMBER}\),{_NUMBER}\)",
}
_ANY = "|".join(PATTERNS.values())


def atom_texts(statement: str | Column = "statement") -> Column:
    """All known atoms in a statement, in order."""
    return F.regexp_extract_all(statement, F.lit(f"({_ANY})"), F.lit(1))


def recognised(statement: Column, texts: Column) -> Column:
    """Whether the atoms make up the whole statement, with nothing between them."""
    return (statement != "") & (F.length(F.array_join(texts, "")) == F.length(statement))


def rejected_statements(statements: DataFrame) -> DataFrame:
    """Non-empty statements that no pattern covers, and lone leaving persons."""
    lone = F.exists(
        "_texts", lambda a: a.contains(f"({ORDERED_PAIR_ACTIVITY}(") & ~a.contains(",id")
    )
    kept = recognised(F.col("statement"), F.col("_texts")) & ~lone
    return (
        statements.where(F.col("statement") != "")
        .withColumn("_texts", atom_texts())
        .where(~kept)
        .drop("_texts")
    )


def parse_statements(statements: DataFrame) -> DataFrame:
    """One row per atom of every recognised statement.

    Adds place (within the statement), kind, name, persons, values and time to
    the columns of ``statements``; unrecognised statements are left out.
    """
    # A filter before the generator, given or inferred from it, would repeat the
    # matching; the outer form with a null test behind it does not.
    whole = F.when(recognised(F.col("statement"), F.col("_texts")), F.col("_texts"))
    split = (
        statements.withColumn("_texts", atom_texts())
        .withColumn("_texts", whole)
        .select("*", F.posexplode_outer("_texts").alias("place", "_text"))
        .where(F.col("place").isNotNull())
    )
    # Tokens between single delimiters: functor, name, person or group, and then
    # a fixed layout per kind, counted from both ends.
    tokens = split.withColumn("_t", F.split("_text", r"[(),=\[\]]"))

    def token(i: int) -> Column:
        return F.get("_t", F.lit(i))

    name = token(1)
    kind = (
        F.when(name.isin(*ACTIVITY_LABELS), F.lit("activity"))
        .when(name.isin(*MOVEMENTS), F.lit("movement"))
        .otherwise(name)
    )
    members = F.array_remove(F.slice("_t", F.lit(5), F.size("_t") - 8), "")
    values = (
        F.when(name == "coord", F.array(token(5), token(6)))
        .when(name.isin("orientation", "appearance"), F.array(token(4)))
        .otherwise(F.array().cast("array<string>"))
    )
    return tokens.select(
        *[c for c in statements.columns if c != "statement"],
        "place",
        name.alias("name"),
        kind.alias("kind"),
        F.when(name.isin(*ACTIVITY_LABELS), members).otherwise(F.array(token(2))).alias("persons"),
        values.alias("values"),
        F.get("_t", F.size("_t") - 2).try_cast("bigint").alias("time"),
    )


def activity_label(name: Column) -> Column:
    """The label an activity is learnt under."""
    out = F.lit(None).cast("string")
    for activity, label in ACTIVITY_LABELS.items():
        out = F.when(name == activity, F.lit(label)).otherwise(out)
    return out


def person_pairs(name: Column, persons: Column) -> Column:
    """All ordered pairs of the members of one statement, by position.

    Each two members in both orders, one after the other. An object is left by the first member and concerns the second only.
    """
    listed = F.transform(persons, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    both_ways = F.transform(
        listed,
        lambda a: F.flatten(
            F.transform(
                F.filter(listed, lambda b: b["i"] > a["i"]),
                lambda b: F.array(F.array(a["p"], b["p"]), F.array(b["p"], a["p"])),
            )
        ),
    )
    every = F.flatten(both_ways)
    first_two = F.when(F.size(persons) >= 2, F.array(F.slice(persons, 1, 2)))
    return F.when(name == ORDERED_PAIR_ACTIVITY, first_two).otherwise(every)


def recording_atoms(parsed: DataFrame) -> DataFrame:
    """Parsed statements as atoms: role, functor (null for the flat form), name, args.

    Group activities become one annotation atom per ordered pair of members,
    everything else one narrative atom.
    """
    kind, values = F.col("kind"), F.col("values")
    kept = parsed.withColumnRenamed("name", "_name")
    given = F.col("_name")
    value = F.get(values, F.lit(0))
    arguments = (
        F.when(kind == "activity", person_pairs(given, F.col("persons")))
        .when(kind.isin("orientation", "coord"), F.array(F.concat("persons", "values")))
        .otherwise(F.array("persons"))
    )
    functor = (
        F.when(kind == "activity", F.lit(A.HOLDS))
        .when(kind == "movement", F.lit(A.HAPPENS))
        .when((kind == "appearance") & value.isin(*INSTANT_APPEARANCES), F.lit(A.HAPPENS))
        .when(kind == "appearance", F.lit(A.HOLDS))
    )
    name = (
        F.when(kind == "activity", activity_label(given))
        .when(kind == "appearance", value)
        .when(kind == "coord", F.lit("coords"))
        .otherwise(given)
    )
    role = F.when(kind == "activity", F.lit(A.ANNOTATION)).otherwise(F.lit(A.NARRATIVE))
    return kept.select(
        "*",
        role.alias("role"),
        functor.alias("functor"),
        name.alias("name"),
        F.posexplode_outer(arguments).alias("pair", "args"),
    ).where(F.col("pair").isNotNull()).drop("_name", "persons", "values")


def render_recording(time: str | Column = "time") -> Column:
    """Text of a recording atom at ``time``."""
    return F.when(F.col("functor").isNull(), A.flat("name", "args", time)).otherwise(
        A.render("functor", "name", "args", time)
    )


def video_offsets(times: DataFrame, gap: int = FRAME_STEP) -> DataFrame:
    """(video, offset): sum over earlier videos of their last time plus ``gap``."""
    lengths = times.groupBy("video").agg((F.max("time") + gap).alias("length"))
    running = ordering.running_sum(
        lengths, F.col("length"), ["video"], ordering.int_slices("video", 12), name="until"
    )
    return running.select("video", (F.col("until") - F.col("length")).alias("offset"))


def shift_videos(atoms: DataFrame, gap: int = FRAME_STEP, stage: Stage = keep) -> DataFrame:
    """Moves every video behind the one before it; ``time`` is the shifted time.

    The offsets are one row per video. Staged, they join straight from a scan:
    broadcast if small, else with a shuffle that can split a video holding most
    atoms.
    """
    offsets = stage(video_offsets(atoms.select("video", "time"), gap))
    return (
        atoms.join(offsets, "video").withColumn("time", F.col("time") + F.col("offset")).drop("offset")
    )


def count_interpretations(atoms: DataFrame) -> DataFrame:
    """Size per video and in total (video null): times x pairs of ids.

    ``atoms`` has (video, time, id). A video with at most one id counts its
    times. Both distinct counts are partial before the shuffle.
    """
    per_video = atoms.groupBy("video").agg(
        F.countDistinct("time").alias("times"), F.countDistinct("id").alias("ids")
    )
    pairs = F.expr("times * (ids * (ids - 1) div 2)")
    sized = per_video.select(
        "video", F.when(F.col("ids") > 1, pairs).otherwise(F.col("times")).alias("size")
    )
    return sized.rollup("video").agg(F.sum("size").alias("size"))

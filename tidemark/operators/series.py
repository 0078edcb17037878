"""Multi-variable series to observation atoms and numbered model blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordering

# The variables of a series, in the order of their atoms.
VARIABLES = ("alive", "necrotic", "apoptotic")


def observations(series: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """``obs(variable,value,time)`` atoms: (keys, time, place, atom). No shuffle."""
    entries = F.array(
        *[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in VARIABLES]
    )
    return series.select(*keys, "time", F.posexplode(entries).alias("place", "_e")).select(
        *keys,
        "time",
        "place",
        F.format_string("obs(%s,%s,%s)", "_e.variable", "_e.value", F.col("time").cast("string")).alias("atom"),
    )


def with_inferred(observed: DataFrame, inferred: DataFrame | None) -> DataFrame:
    """Observed atoms together with atoms inferred elsewhere, if any."""
    return observed if inferred is None else observed.unionByName(inferred)


def number_models(
    models: DataFrame, order: Sequence[str], slices: Sequence[Column], name: str = "model"
) -> DataFrame:
    """Distinct models with consecutive numbers from 1 in ``order``."""
    return ordering.number_rows(models.select(*order).distinct(), order, slices, name=name)


def state_changes(
    series: DataFrame, by: Sequence[str], slices: Sequence[Column], order: Sequence[str] = ("time",)
) -> DataFrame:
    """Rows whose state differs from the row before them in the same series."""
    state = F.struct(*VARIABLES)
    walked = ordering.neighbour_value(series, state, F.struct(*order), slices, by, "_before")
    return walked.where(~state.eqNullSafe(F.col("_before"))).drop("_before")


def model_block_lines(atoms: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of the model blocks: (model, section, time, place, line).

    A block is ``begin(model(n)).``, the label, one line per atom by time, and
    ``end(model(n)).``. Lines stay separate rows, so that a long series does not
    become one value; order them by (model, section, time, place) to print them.
    ``models`` has keys, label and model.
    """
    number = F.col("model").cast("string")
    frame = F.array(
        F.struct(F.lit(0).alias("section"), F.concat(F.lit("begin(model("), number, F.lit(")).")).alias("line")),
        F.struct(F.lit(1).alias("section"), F.concat("label", F.lit(".")).alias("line")),
        F.struct(F.lit(3).alias("section"), F.concat(F.lit("end(model("), number, F.lit(")).")).alias("line")),
    )
    outer = models.select("model", F.explode(frame).alias("_f")).select(
        "model",
        "_f.section",
        F.lit(0).cast("bigint").alias("time"),
        F.lit(0).alias("place"),
        "_f.line",
    )
    inner = atoms.join(models.select(*keys, "model"), list(keys)).select(
        "model", F.lit(2).alias("section"), "time", "place", F.concat("atom", F.lit(".")).alias("line")
    )
    return outer.unionByName(inner)

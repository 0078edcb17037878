"""Event atoms: kept as columns (functor, name, args, time) until rendered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config

HAPPENS, HOLDS = "happensAt", "holdsAt"
ANNOTATION, NARRATIVE = "annotation", "narrative"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head(functor, name, args) -> Column:
    """``functor(name(arg,...),``: all of an atom but its time."""
    constant = isinstance(functor, str) and functor in (HAPPENS, HOLDS)
    functor = F.lit(functor) if constant else _col(functor)
    return F.concat(functor, F.lit("("), term(name, args), F.lit(","))


def render(functor, name, args, time) -> Column:
    """``functor(name(arg,...),time)``."""
    return F.concat(head(functor, name, args), _col(time).cast("string"), F.lit(")"))


def term(name, args) -> Column:
    """``name(arg,...)``."""
    return F.concat(_col(name), F.lit("("), F.concat_ws(",", _col(args)), F.lit(")"))


def flat(name, args, time) -> Column:
    """``name(arg,...,time)``, the form without a functor."""
    return F.concat(
        _col(name), F.lit("("), F.concat_ws(",", _col(args), _col(time).cast("string")), F.lit(")")
    )


def capitalised(name) -> Column:
    """Upper-cases the first letter and leaves the rest as it is."""
    name = _col(name)
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def head_mln(name, args) -> Column:
    """``HappensAt(Name_arg_arg,``: all of an atom in the spelling with upper-case predicates but its time."""
    return F.concat(F.lit("HappensAt("), F.concat_ws("_", capitalised(name), _col(args)), F.lit(","))


def render_mln(name, args, time) -> Column:
    """``HappensAt(Name_arg_arg,time)``, the spelling with upper-case predicates."""
    return F.concat(head_mln(name, args), _col(time).cast("string"), F.lit(")"))


def point_args(lle="lle", vessel="vessel", area="area") -> Column:
    """Arguments of a point event: the vessel, and the area where there is one."""
    return F.when(
        _col(lle).isin(*config.AREA_EVENTS), F.array(_col(vessel), _col(area))
    ).otherwise(F.array(_col(vessel)))


def interval_functor(hle, targets: Sequence[str]) -> Column:
    return F.when(_col(hle).isin(*targets), F.lit(HOLDS)).otherwise(F.lit(HAPPENS))


def interval_args(vessels="vessels", value="value") -> Column:
    """Vessels, followed by the value unless it is ``true``."""
    vessels, value = _col(vessels), _col(value)
    return F.when(value != "true", F.array_append(vessels, value)).otherwise(vessels)


def mirrored(hle="hle", vessels="vessels") -> Column:
    """The vessel lists an interval speaks about: both orders when symmetric."""
    hle, vessels = _col(hle), _col(vessels)
    return F.when(
        hle.isin(*config.SYMMETRIC_INTERVALS), F.array(vessels, F.reverse(vessels))
    ).otherwise(F.array(vessels))


def position_in(name, names: Sequence[str]) -> Column:
    """Zero-based place of a name in a list, null when it is not listed."""
    place = F.lit(None).cast("int")
    for i, listed in reversed(list(enumerate(names))):
        place = F.when(_col(name) == listed, F.lit(i)).otherwise(place)
    return place


def role(functor, name, point_events: Sequence[str], target_events: Sequence[str]) -> Column:
    """annotation, narrative, or null for an atom that belongs to neither."""
    functor, name = _col(functor), _col(name)
    return F.when((functor == HOLDS) & name.isin(*target_events), F.lit(ANNOTATION)).when(
        (functor == HAPPENS) & name.isin(*point_events), F.lit(NARRATIVE)
    )

"""Allow and block verdicts on addresses: rules first, a logistic model on hashed character n-grams for the rest."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``place`` is a host with a path behind it; the rule holds for the host and its subdomains below that path."""

    place: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, below = self.place.partition("/")
        return ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{below}"))


@dataclass(frozen=True)
class Settings:
    """Learning: n-gram lengths, buckets, at most ``most`` labelled addresses, steps, step size and decay."""

    lengths: tuple[int, ...] = (3, 4)
    buckets: int = 1024
    most: int = 2000
    steps: int = 24
    rate: float = 20.0
    decay: float = 1e-4
    threshold: float = 0.5


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ?, # or the end, with A-Z lower-cased; empty without :// and for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// and for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The place of the longest rule that fits, the first in text order of equally long ones; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.place), r.place))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(r.fits(host, path), F.lit(r.place)) for r in ordered])


def verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    return F.coalesce(F.lit(None).cast("string"), *[F.when(rule == r.place, F.lit(r.verdict)) for r in rules])


def features(host: Column, path: Column, how: Settings) -> Column:
    """Buckets of all character n-grams of host and path, each marked as the one or the other, ends included."""

    def of(text: Column, mark: str, n: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - (n - 1)))
        gram = lambda i: F.pmod(F.xxhash64(F.concat(F.lit(mark), F.substr(framed, i, F.lit(n)))), F.lit(how.buckets)).cast("int")
        return F.coalesce(F.transform(places, gram), F.array().cast("array<int>"))

    return F.flatten(F.array(*[of(t, m, n) for t, m in ((host, "h"), (path, "p")) for n in how.lengths]))


def probability(found: Column, weights: Sequence[float], bias: float) -> Column:
    """The model's probability of allowing; the n-grams' weights are averaged. Without n-grams only the bias speaks."""
    table = F.from_json(F.lit(json.dumps(list(weights))), "array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.get(table, i))
    return 1.0 / (1.0 + F.exp(-(F.lit(bias) + total / F.greatest(F.size(found), F.lit(1)))))


def train(labelled: DataFrame, how: Settings = Settings()) -> tuple[list[float], float]:
    """Weights and bias from (host, path, label), label 1 allow and 0 block, by gradient steps.

    At most ``how.most`` distinct addresses are learnt from, those with the least hash. Every step is one aggregate over
    them; only ``buckets`` sums reach the driver. Both labels weigh alike, whatever their numbers. Without any address
    all weights are zero.
    """
    chosen = (
        labelled.where("label is not null").groupBy("host", "path").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("host", "path"), "host", "path").limit(how.most)
        .select("label", features(F.col("host"), F.col("path"), how).alias("found"))
    )
    rows = stage(chosen.coalesce(2), "urls")
    numbers = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    weights, bias = [0.0] * how.buckets, 0.0
    if not numbers:
        return weights, bias
    share = reduce(lambda a, kv: a.when(F.col("label") == kv[0], F.lit(1.0 / (len(numbers) * kv[1]))), list(numbers.items())[1:],
                   F.when(F.col("label") == list(numbers)[0], F.lit(1.0 / (len(numbers) * numbers[list(numbers)[0]]))))
    scale = [1e-3] * (how.buckets + 1)
    for _ in range(how.steps):
        error = (F.col("label") - probability(F.col("found"), weights, bias)) * share
        parts = rows.select(error.alias("e"), "found").select(
            "e", F.explode(F.concat(F.array(F.lit(-1)), "found")).alias("i"), F.greatest(F.size("found"), F.lit(1)).alias("n")
        )
        sums = parts.groupBy("i").agg(F.sum(F.when(F.col("i") < 0, F.col("e")).otherwise(F.col("e") / F.col("n"))).alias("g")).collect()
        for i, g in ((r[0], r[1]) for r in sums):
            # Steps shrink with what a weight has moved already, so that rare n-grams learn as well as common ones.
            scale[i] += g * g
            if i < 0:
                bias += how.rate / 4 * g / scale[i] ** 0.5
            else:
                weights[i] = (1 - how.decay) * weights[i] + how.rate * g / scale[i] ** 0.5
    return weights, bias


def judged(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, how: Settings = Settings()) -> DataFrame:
    """``pages`` with host, path, rule, probability and verdict of the column url; columns of those names are replaced.

    Where no rule fits, the verdict is the model's. It learns from ``labelled`` (url, label), or, without it, from the
    addresses of ``pages`` that a rule judges. Null and malformed addresses have an empty host and path, fit no rule and
    get the verdict of the bias. Equal addresses get equal verdicts.
    """
    split = lambda frame: frame.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = split(pages).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        named = verdict_of(F.col("rule"), rules)
        known = rows.where("rule is not null").select("host", "path", (named == "allow").cast("int").alias("label"))
    else:
        known = split(labelled).select("host", "path", F.col("label").cast("int").alias("label"))
    weights, bias = train(known, how)
    chance = probability(features(F.col("host"), F.col("path"), how), weights, bias)
    return rows.withColumn("probability", chance).withColumn(
        "verdict",
        F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("probability") >= how.threshold, F.lit("allow")).otherwise(F.lit("block"))),
    )

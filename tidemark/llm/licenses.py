"""Licence notices by ordered signature rules on the word stream of a text, all in column expressions."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but words, A-Z not yet lower-cased.
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, with the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    """A pattern over lower-case words with one space between; it is tried where ``keyword`` occurs."""

    label: str
    keyword: str
    pattern: str
    confidence: float


# Families with versions: label, keywords, names, versions. L is a licence by either spelling.
_VERSIONED = """
apache | apache | apache (?:software )?L | 1 0, 1 1, 2 0
gpl | gpl, general public | (?:gnu )?gpl; (?:gnu )?general public L | 1 0, 2 0, 3 0
lgpl | lgpl, lesser general, library general | (?:gnu )?lgpl; (?:gnu )?(?:lesser|library) general public L | 2 0, 2 1, 3 0
agpl | agpl, affero | (?:gnu )?agpl; (?:gnu )?affero (?:gnu )?(?:general )?public L | 1 0, 3 0
gfdl | gfdl, free documentation | (?:gnu )?gfdl; (?:gnu )?free documentation L | 1 1, 1 2, 1 3
mpl | mpl, mozilla public | mpl; mozilla public L | 1 0, 1 1, 2 0
epl | epl, eclipse public | epl; eclipse public L | 1 0, 2 0
cddl | cddl, common development | cddl; common development and distribution L | 1 0, 1 1
cpl | cpl, common public | cpl; common public L | 1 0
eupl | eupl, european union public | eupl; european union public L | 1 0, 1 1, 1 2
cecill | cecill | cecill(?: free software)?(?: L)?(?: agreement)? | 1 0, 1 1, 2 0, 2 1
artistic | artistic | artistic L | 1 0, 2 0
boost | boost, bsl | bsl; boost software L | 1 0
zpl | zpl, zope public | zpl; zope public L | 1 1, 2 0, 2 1
psf | psf, python software | psf(?: L)?; python software foundation L | 2 0
php | php license, php licence | php L | 3 0, 3 01
lppl | lppl, latex project | lppl; latex project public L | 1 0, 1 1, 1 2, 1 3
ofl | ofl, open font | (?:sil )?ofl; (?:sil )?open font L | 1 0, 1 1
osl | osl, open software | osl; open software L | 1 0, 1 1, 2 0, 2 1, 3 0
afl | afl, academic free | afl; academic free L | 1 1, 1 2, 2 0, 2 1, 3 0
apsl | apsl, apple public | apsl; apple public source L | 1 0, 1 1, 1 2, 2 0
sspl | sspl, server side public | sspl; server side public L | 1 0
busl | busl, business source | busl; business source L | 1 1
elastic | elastic | elastic L | 1 0, 2 0
odbl | odbl, open database | odbl; open database L | 1 0
odc-by | odc, open data commons | odc by; open data commons attribution L | 1 0
mulan-psl | mulan | mulan psl; mulan permissive software L | 1 0, 2 0
upl | upl, universal permissive | upl; universal permissive L | 1 0
qpl | qpl, q public | qpl; q public L | 1 0
ecl | ecl, educational community | ecl; educational community L | 1 0, 2 0
wtfpl | wtfpl, what the | wtfpl; do what the fuck you want to public L | 1 0, 2 0
"""

# Families without versions: label, keyword, patterns with their confidence.
_PLAIN = """
mit | mit | 0.9 mit L; 0.9 L under the mit L; 0.8 mit x11 L; 0.9 spdx L identifier mit; 0.8 opensource org licenses mit
mit | permission is hereby | 0.95 permission is hereby granted free of charge to any person obtaining a copy; 0.7 the above copyright notice and this permission notice shall be included
isc | isc license, isc licence, isc | 0.9 isc L; 0.9 spdx L identifier isc
isc | permission to use | 0.9 permission to use copy modify and or distribute this software for any purpose
bsd | bsd | 0.7 bsd(?: style| like)? L; 0.9 spdx L identifier bsd; 0.8 opensource org licenses bsd L
bsd-0-clause | clause | 0.95 (?:0|zero) clause bsd(?: L)?
bsd-1-clause | clause | 0.95 (?:1|one) clause bsd(?: L)?; 0.95 bsd (?:1|one) clause(?: L)?
bsd-2-clause | clause | 0.95 (?:2|two) clause bsd(?: L)?; 0.95 bsd (?:2|two) clause(?: L)?
bsd-2-clause | bsd | 0.95 (?:simplified|free) bsd(?: L)?
bsd-3-clause | clause | 0.95 (?:3|three) clause bsd(?: L)?; 0.95 bsd (?:3|three) clause(?: L)?
bsd-3-clause | bsd | 0.95 (?:new|modified|revised) bsd(?: L)?
bsd-4-clause | clause | 0.95 (?:4|four) clause bsd(?: L)?; 0.95 bsd (?:4|four) clause(?: L)?
bsd | redistribution and use | 0.9 redistribution and use in source and binary forms with or without modification are permitted; 0.6 redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice
zlib | zlib | 0.9 zlib(?: libpng)? L; 0.9 spdx L identifier zlib
zlib | as is without | 0.7 this software is provided as is without any express or implied warranty
unlicense | unlicense | 0.9 (?:the )?unlicense(?: org)?
unlicense | public domain | 0.95 this is free and unencumbered software released into the public domain
public-domain | public domain | 0.7 (?:in|into|to) the public domain; 0.8 public domain dedication
cc0 | cc0 | 0.9 cc0(?: 1 0)?(?: universal)?; 0.9 creativecommons org publicdomain zero 1 0
ncsa | ncsa | 0.9 (?:university of illinois )?ncsa(?: open source)? L
postgresql | postgresql license, postgresql licence | 0.9 postgresql L
openssl | openssl license, openssl licence | 0.9 openssl(?: ssleay)? L
ruby | ruby license, ruby licence | 0.9 ruby L
vim | vim license, vim licence | 0.9 vim L
curl | curl license, curl licence | 0.9 curl L
json | json license, json licence | 0.9 json L
x11 | x11 | 0.9 x11 L
w3c | w3c | 0.9 w3c(?: software)?(?: notice and)? L
sleepycat | sleepycat | 0.9 sleepycat L
ms-pl | microsoft public, ms pl | 0.9 microsoft public L; 0.8 ms pl
ms-rl | microsoft reciprocal, ms rl | 0.9 microsoft reciprocal L; 0.8 ms rl
pddl | pddl, public domain dedication | 0.9 pddl; 0.9 public domain dedication and L
beerware | beerware, beer ware | 0.9 (?:the )?beer ?ware L
commons-clause | commons clause | 0.9 commons clause(?: L)?
eiffel | eiffel | 0.9 eiffel forum L
fair | fair license, fair licence | 0.9 fair L
ipa | ipa font | 0.9 ipa font L
nokia | nokia open | 0.9 nokia open source L
apache | apache | 0.8 apache(?: software)? L; 0.7 apache software foundation; 0.9 www apache org licenses
gpl | general public | 0.8 (?:gnu )?general public L
gpl | gpl | 0.7 (?:gnu )?gpl
lgpl | lgpl | 0.7 (?:gnu )?lgpl
agpl | agpl | 0.7 (?:gnu )?agpl
mpl | mozilla public | 0.8 mozilla public L
epl | eclipse public | 0.8 eclipse public L
cddl | common development | 0.8 common development and distribution L
eupl | european union public | 0.8 european union public L
creative-commons | creative commons | 0.6 creative commons(?: L)?
proprietary | all rights | 0.5 all rights reserved
proprietary | proprietary | 0.5 proprietary and confidential
"""

_CC_PARTS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
_CC_KINDS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_LICENCE = "licen[sc]e[ds]?"


def _spelled(pattern: str) -> str:
    return re.sub(r"\bL\b", _LICENCE, pattern)


def signature_rules() -> list[Rule]:
    """All rules, the more telling first: versions with "or later" or "only", versions, SPDX names, then names alone."""
    first, second, third = [], [], []
    for line in _VERSIONED.strip().splitlines():
        label, keywords, names, versions = _fields(line)
        name = "|".join(_spelled(n.strip()) for n in names.split(";"))
        for keyword in (k.strip() for k in keywords.split(",")):
            for version in (v.strip() for v in versions.split(",")):
                major, minor = version.split(" ")
                number = f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}"
                glued = f"{major}(?: {minor})?" if minor == "0" else f"{major} ?{minor}"
                said = f"(?:{name})(?: agreement)?(?: as published by the free software foundation)?(?: (?:either )?(?:version|ver|v))? v?{number}"
                full = f"{label}-{major}.{minor}"
                if label in ("gpl", "lgpl", "agpl", "gfdl"):
                    later = "(?: of the (?:license|licence))?(?: or (?:at your option )?(?:any )?later(?: version)?| plus)"
                    first.append(Rule(f"{full}-or-later", keyword, said + later, 0.98))
                    first.append(Rule(f"{full}-only", keyword, f"{said} only", 0.98))
                second.append(Rule(full, keyword, said, 0.95))
                if " " not in keyword:
                    third.append(Rule(full, keyword, f"spdx {_LICENCE} identifier {keyword} {number}(?: only| or later)?", 0.99))
                    second.append(Rule(full, keyword, f"{keyword}v?{glued}", 0.9))
    for kind in _CC_KINDS:
        words = " ".join(_CC_PARTS[p] for p in kind.split(" "))
        for version in _CC_VERSIONS:
            full = f"cc-{kind.replace(' ', '-')}-{version.replace(' ', '.')}"
            number = version.replace(" 0", "(?: 0)?")
            second.append(Rule(full, "creative commons", f"creative commons {words} {number}(?: (?:international|unported|generic))?", 0.95))
            second.append(Rule(full, "creativecommons", f"creativecommons org licenses {kind} {version}", 0.95))
            second.append(Rule(full, f"cc {kind}", f"cc {kind} {number}", 0.95))
    for line in _PLAIN.strip().splitlines():
        label, keywords, patterns = (x.strip() for x in line.split(" | ", 2))
        for keyword in (k.strip() for k in keywords.split(",")):
            for pattern in patterns.split(";"):
                confidence, _, said = pattern.strip().partition(" ")
                third.append(Rule(label, keyword, _spelled(said), float(confidence)))
    return [*first, *second, *third]


def _fields(line: str) -> tuple[str, str, str, str]:
    """Names may hold the mark between fields inside brackets."""
    label, keywords, rest = line.split(" | ", 2)
    names, _, versions = rest.rpartition(" | ")
    return label.strip(), keywords.strip(), names.strip(), versions.strip()


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(ord, label, keyword, pattern, confidence); as large as the code's list, so it may go to every task."""
    text = json.dumps([{"ord": i, **asdict(r)} for i, r in enumerate(rules)])
    kind = "array<struct<ord:int,label:string,keyword:string,pattern:string,confidence:double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrase(words: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase, and the first and last word it starts at."""
    parts = F.split(words, f"(?<= ){phrase}(?= )", -1)
    there = F.contains(words, F.lit(f" {phrase} "))
    n = F.when(there, F.size(parts) - 1).otherwise(0)
    first = F.when(there, _spaces(F.get(parts, F.lit(0))) - 1)
    last = F.when(there, n_words - len(phrase.split(" ")) - (_spaces(F.element_at(parts, -1)) - 1))
    return n.cast("bigint"), first.cast("bigint"), last.cast("bigint")


def _words_of(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """(row, doc_id, n_words, words): words only where a keyword occurs, as one string with a space at either end."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), F.lower(text).alias("low"))
    # Lower-casing beyond A-Z can only let more texts pass here.
    stems = sorted({k.split(" ")[0] for k in keywords})
    gate = F.lit(False)
    for stem in stems:
        gate = gate | F.contains("low", F.lit(stem))
    parted = F.concat(F.lit(" "), F.trim(F.regexp_replace("text", _APART, " ")), F.lit(" "))
    found = found.select("doc_id", gate.alias("gate"), parted.alias("words"))
    n_words = F.when(F.length("words") > 2, _spaces(F.col("words")) - 1).otherwise(0).cast("bigint")
    words = F.when(F.col("gate") & (n_words > 0), F.translate("words", _UPPER, _LOWER))
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", n_words.alias("n_words"), words.alias("words"))


def detections(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(row, ord, label, confidence, start, stop) of the rules' matches in (row, words) that none other contains.

    A rule is tried where its keyword stands. Of overlapping matches those that lie inside another go, and of equal
    places the rule that comes first stays. Places are characters of the word string.
    """
    keywords = sorted({r.keyword for r in rules})
    # A keyword may be the beginning of a word, like a name with its version behind it.
    hits = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("words"), F.concat(F.lit(" "), k)))
    tried = rows.where("words is not null").select("row", "words", F.explode(hits).alias("keyword")).join(
        F.broadcast(rule_table(rows.sparkSession, rules)), "keyword"
    )
    bounded = F.concat(F.lit("(?<= )(?:"), F.col("pattern"), F.lit(")(?= )"))
    tried = tried.select("row", "words", "ord", "label", "confidence", bounded.alias("pattern")).where(F.expr("words rlike pattern"))
    matched = F.expr("transform(arrays_zip(split(words, pattern, -1), regexp_extract_all(words, pattern, 0)), x -> struct(length(x['0']) as gap, length(x['1']) as size))")
    tried = tried.select("row", "ord", "label", "confidence", F.posexplode(matched).alias("pos", "m")).where("m.size is not null")
    walk = Window.partitionBy("row", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.gap") + F.col("m.size")).over(walk)
    tried = tried.select("row", "ord", "label", "confidence", (stop - F.col("m.size")).alias("start"), stop.alias("stop"))
    over = Window.partitionBy("row").orderBy("start", F.desc("stop"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    return tried.withColumn("reach", F.max("stop").over(over)).where("reach is null or reach < stop").drop("reach")


def license_scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    ``n_base`` counts the places of the phrases in ``PHRASES``; ``labels`` adds the rules' labels to theirs. ``score`` is
    the greatest confidence of a match that stands, 0.5 if only phrases do and 0 without either. Null and empty texts
    have no words, no labels and score 0. Rows are told apart by a row number, so repeated rows and ids, and null ids,
    each give their own row. Other columns are not read.
    """
    rules = signature_rules() if rules is None else rules
    keywords = sorted({r.keyword for r in rules} | set(PHRASES))
    rows = stage(_words_of(docs.select("doc_id", "text"), keywords), "words")
    matched = detections(rows.select("row", "words"), rules).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("confidence").alias("confidence")
    )
    places = {label: _phrase(F.col("words"), F.col("n_words"), p) for p, label in PHRASES.items()}
    number = sum((F.coalesce(n, F.lit(0).cast("bigint")) for n, _, _ in places.values()), F.lit(0).cast("bigint"))
    base = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for label, (n, _, _) in places.items()]))
    counted = rows.select(
        "row",
        "doc_id",
        "n_words",
        number.alias("n_base"),
        F.least(*[f for _, f, _ in places.values()]).alias("first_word"),
        F.greatest(*[l for _, _, l in places.values()]).alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"),
    )
    none = F.array().cast("array<string>")
    return counted.join(matched, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("found", none)))).alias("labels"),
        F.coalesce("confidence", F.when(F.size("base") > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )

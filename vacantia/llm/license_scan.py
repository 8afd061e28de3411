"""Licence notices in texts, by Dice coefficient over word bigrams.

The units of comparison are every line and, for notices that span lines, every paragraph
of two or more lines. A unit is normalised (A-Z lower-cased, everything but ASCII letters
and digits is a space) and reduced to its set of word bigrams. A template of ``t``
bigrams can reach the coefficient ``d`` only with units of ``t d / (2 - d)`` to
``t (2 - d) / d`` bigrams; only those are compared. Before that, texts and units are ruled out that hold
none of the templates' marker words: so many of a template's bigrams contain one of its
markers that a unit without them cannot reach the coefficient. Every row is scanned on
its own, inside the JVM and without a shuffle.

Rules: a null or empty text has no notice. A unit of one word has no bigram and matches
nothing. Of the templates that fit a unit the best one is its match, or all that fit it
equally well. Repeated rows are scanned one by one; other columns are not read.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices, as they are usually quoted. Fixed values.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
}
#: A notice that differs in one word of eight still counts.
LEAST_DICE = Fraction(4, 5)


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, least: Fraction) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach ``least`` with ``size`` bigrams."""
    fewest, most = size * least / (2 - least), size * (2 - least) / least
    return -(-fewest.numerator // fewest.denominator), most.numerator // most.denominator


def marker_words(templates: list[list[str]], least: Fraction) -> list[str]:
    """Words of which a unit must hold one to reach ``least`` with any of the templates.

    With ``c`` common bigrams needed at least, a unit lacks ``len(bigrams) - c`` of them
    at most, so it holds one of any ``len(bigrams) - c + 1``. Words that serve many
    templates come first, and long words, since they are rare.
    """
    needed = []
    for bigrams in templates:
        fewest, _ = size_bounds(len(bigrams), least)
        common = least * (fewest + len(bigrams)) / 2
        needed.append(len(bigrams) + common.numerator // -common.denominator + 1)
    holding = [[set(b.split()) for b in bigrams] for bigrams in templates]
    words = {w for pairs in holding for pair in pairs for w in pair}
    chosen: set[str] = set()

    def covered(extra: str | None = None) -> int:
        own = chosen | {extra}
        return sum(min(n, sum(1 for pair in pairs if pair & own)) for n, pairs in zip(needed, holding, strict=True))

    while covered() < sum(needed):
        chosen.add(max(words - chosen, key=lambda w: ((covered(w) - covered()) * len(w) ** 2, w)))
    return sorted(chosen)


def _holds_any(lower_text: Column, words: list[str]) -> Column:
    """Whether one of ``words`` stands in a lower-cased text as a word of its own."""
    return F.rlike(lower_text, F.lit(f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"))


def units_of(text: Column) -> Column:
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, "\n[ \t\r]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    return F.concat(lines, paragraphs)


def words_of(unit: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.split(F.trim(F.regexp_replace(F.translate(unit, upper, lower), "[^a-z0-9]+", " ")), " ")


def bigrams_of(words: Column) -> Column:
    """The distinct word bigrams of a unit; empty without two words."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    joined = F.zip_with(
        F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.array_distinct(joined)


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    least_dice: Fraction = LEAST_DICE,
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``matches``: an array of ``(licence, unit, dice)``, by unit and licence.

    ``unit`` counts the lines of the text from 0, then its paragraphs of several lines.
    The templates become part of the plan, so they are meant to be a list of this kind,
    not a table.
    """
    at_least, bound = F.lit(least_dice.numerator), F.lit(least_dice.denominator)
    chosen = TEMPLATES if templates is None else templates
    wanted_sets = [(name, b) for name, texts in chosen.items() for t in texts if (b := template_bigrams(t))]
    markers = marker_words([b for _, b in wanted_sets], least_dice)
    raw, low = F.coalesce(F.col(text), F.lit("")), "lower text of the scan"
    none = F.array().cast("array<string>")
    words = F.transform(
        units_of(raw), lambda u: F.when(_holds_any(F.lower(u), markers), words_of(u)).otherwise(none)
    )
    sets = F.when(_holds_any(F.col(low), markers), F.transform(words, bigrams_of))

    def against(name: str, wanted: list[str]):
        fewest, most = size_bounds(len(wanted), least_dice)
        literal = F.array(*[F.lit(b) for b in wanted])

        def match(unit: Column, place: Column) -> Column:
            both = F.size(F.array_intersect(unit, literal))
            total = F.size(unit) + F.lit(len(wanted))
            reaches = F.size(unit).between(fewest, most) & (2 * both * bound >= at_least * total)
            return F.when(reaches, F.struct(F.lit(name).alias("licence"), place.alias("unit"), (2.0 * both / total).alias("dice")))

        return match

    tests = [against(name, b) for name, b in wanted_sets]
    kind = "array<struct<licence:string,unit:int,dice:double>>"
    if not tests:
        return docs.withColumn("matches", F.array().cast(kind))

    def tried(unit: Column, place: Column) -> Column:
        return F.filter(F.array(*[test(unit, place) for test in tests]), lambda m: m.isNotNull())

    # Few units are of a size that any template allows; the others are ruled out at once.
    spans = [size_bounds(len(b), least_dice) for _, b in wanted_sets]
    tested = F.transform(
        sets, lambda unit, place: F.when(_any(F.size(unit), spans), tried(unit, place)).otherwise(F.array().cast(kind))
    )
    # The licences that fit a unit best; several if they fit equally well.
    best = F.transform(tested, lambda found: F.filter(found, lambda m: m["dice"] == F.array_max(found["dice"])))
    matches = F.coalesce(F.flatten(best), F.array().cast(kind))
    return docs.withColumn(low, F.lower(raw)).withColumn("matches", matches).drop(low)


def _any(size: Column, spans: list[tuple[int, int]]) -> Column:
    joined: list[list[int]] = []
    for low, high in sorted(spans):
        if joined and low <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    test = F.lit(False)
    for low, high in joined:
        test = test | size.between(low, high)
    return test

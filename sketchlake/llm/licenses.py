"""Licence families of statements: a trained classifier, confirmed by templates; DataFrame functions only.

A text falls into statements: sentences, with wrapped lines joined, ended by a
blank line at the latest. A multinomial logistic regression over the presence of
word 1- and 2-grams is fitted, when first used, to TRAINING_ROWS statements made of
customary phrases and names of licences, of pieces of the licences' own sentences, and of
sentences that only talk about licences or deny one. Its temperature is set on held-out
statements, and so is the threshold of the unknown class: the lowest at which at most
FALSE_KNOWN of the held-out statements without a licence pass. A prediction must be
confirmed by a template of the family whose 2-grams the statement contains to at least
``contained``. Held-out statements state licences in other phrases than the training's.

Only statements with one of a few strings are classified. Every template needs one: the
strings are chosen such that the 2-grams of it without any of them are fewer than
``contained`` of all, so no statement that could be confirmed is left out.

The model is a sparse table of a few thousand (gram, class, weight) rows, whatever the
corpus. Equal statements are classified once.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchlake.llm.runtime import checkpoint, store

UNKNOWN = "unknown"
TRAINING_ROWS, ROUNDS, PENALTY, MIN_WEIGHT, FALSE_KNOWN = 4800, 200, 3e-4, 1e-3, 0.005
#: Copies of the table of classified statements, so that one that very many documents have is many keys.
SALTS = 16
_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*\+?"
#: Strings that mark statements about licences; spaces stand for any white space. What templates need beyond is added by rule.
NEEDED = ("licen", "spdx", "copyright", "permission", "public domain", "creative commons", "cc0", "cc by", "gpl", "lizen")

#: Customary notices and the distinctive sentences of the licences, lower-case.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "spdx-license-identifier apache-2.0",
        "unless required by applicable law or agreed to in writing",
    ),
    "MIT": (
        "released under the mit license", "this project is distributed under the terms of the mit license", "spdx-license-identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice",
    ),
    "GPL-3.0": ("licensed under the gnu general public license version 3", "spdx-license-identifier gpl-3.0", "spdx-license-identifier gpl-3.0-only", "spdx-license-identifier gpl-3.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "released under gnu gpl v3"),
    "GPL-2.0": ("licensed under the gnu general public license version 2", "spdx-license-identifier gpl-2.0", "spdx-license-identifier gpl-2.0-only", "spdx-license-identifier gpl-2.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "released under gnu gpl v2"),
    "LGPL-3.0": ("licensed under the gnu lesser general public license version 3", "spdx-license-identifier lgpl-3.0", "spdx-license-identifier lgpl-3.0-only", "spdx-license-identifier lgpl-3.0-or-later", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    "AGPL-3.0": ("licensed under the gnu affero general public license version 3", "spdx-license-identifier agpl-3.0", "spdx-license-identifier agpl-3.0-only", "spdx-license-identifier agpl-3.0-or-later", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    "BSD-3-Clause": (
        "licensed under the bsd 3-clause license", "licensed under the 3-clause bsd license", "distributed under the new bsd license", "spdx-license-identifier bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ),
    "BSD-2-Clause": (
        "licensed under the bsd 2-clause license", "licensed under the 2-clause bsd license", "distributed under the simplified bsd license", "spdx-license-identifier bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification",
    ),
    "MPL-2.0": ("subject to the terms of the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under mpl 2.0", "spdx-license-identifier mpl-2.0"),
    "CC-BY-4.0": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license", "spdx-license-identifier cc-by-4.0"),
    "CC-BY-SA-4.0": ("licensed under cc by-sa 4.0", "licensed under a creative commons attribution-sharealike 4.0 international license", "spdx-license-identifier cc-by-sa-4.0"),
    "CC-BY-NC-4.0": ("licensed under cc by-nc 4.0", "licensed under a creative commons attribution-noncommercial 4.0 international license", "spdx-license-identifier cc-by-nc-4.0"),
    "CC-BY-ND-4.0": ("licensed under cc by-nd 4.0", "licensed under a creative commons attribution-noderivatives 4.0 international license", "spdx-license-identifier cc-by-nd-4.0"),
    "CC0-1.0": ("dedicated to the public domain under cc0 1.0 universal", "placed in the public domain under the creative commons cc0 waiver", "released under cc0 1.0", "spdx-license-identifier cc0-1.0"),
    "ISC": ("licensed under the isc license", "spdx-license-identifier isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "Unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense", "spdx-license-identifier unlicense"),
}
#: Short names, as identifiers, badges and single lines give them.
SHORT: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache-2.0",), "MIT": ("mit",), "GPL-3.0": ("gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gplv3", "gpl v3", "gnu gplv3"), "GPL-2.0": ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gplv2", "gpl v2", "gnu gplv2"),
    "LGPL-3.0": ("lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "lgplv3", "lgpl v3"), "AGPL-3.0": ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "agplv3", "agpl v3"), "BSD-3-Clause": ("bsd-3-clause",), "BSD-2-Clause": ("bsd-2-clause",), "MPL-2.0": ("mpl-2.0",),
    "CC-BY-4.0": ("cc-by-4.0",), "CC-BY-SA-4.0": ("cc-by-sa-4.0",), "CC-BY-NC-4.0": ("cc-by-nc-4.0",), "CC-BY-ND-4.0": ("cc-by-nd-4.0",), "CC0-1.0": ("cc0-1.0",), "ISC": ("isc",), "Unlicense": ("unlicense",),
}
_SHORT_STATED = ("spdx-license-identifier {}", "license {}", "licence {}", "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "distributed under {}", "lizenz {}")
#: Other lines that state a licence by themselves.
_LINES = {"Apache-2.0": ("apache license version 2.0",), "MIT": ("mit-lizenz",), "GPL-3.0": ("gpl-3.0",), "GPL-2.0": ("gpl-2.0",), "LGPL-3.0": ("lgpl-3.0",), "AGPL-3.0": ("agpl-3.0",)}
TEMPLATES = {family: (*dict.fromkeys((*ts, *(p.format(n) for n in SHORT[family] for p in _SHORT_STATED), *_LINES.get(family, ()))),) for family, ts in TEMPLATES.items()}

#: Other names of the licences, for training.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license version 2.0", "apache 2.0 license", "apache license 2.0", "apache software license 2.0", "apache license v2.0"),
    "MIT": ("mit license", "mit licence", "mit software license", "expat mit license"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl v3", "gnu general public license v3.0", "gpl version 3", "gnu general public licence version 3 or later", "gpl v3 license"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl v2", "gnu general public license v2.0", "gpl version 2", "gnu general public licence version 2 or later", "gpl v2 license"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lgpl v3", "lesser general public license v3.0", "lgpl version 3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu agpl v3", "affero general public license v3.0", "agpl version 3"),
    "BSD-3-Clause": ("bsd 3-clause license", "3-clause bsd license", "new bsd license", "modified bsd license", "three-clause bsd license"),
    "BSD-2-Clause": ("bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "two-clause bsd license", "freebsd license"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license v 2.0", "mpl 2.0", "mozilla public license 2.0"),
    "CC-BY-4.0": ("cc by 4.0", "cc by 4.0 license", "creative commons attribution 4.0 international license", "creative commons attribution 4.0 license", "creative commons attribution 4.0"),
    "CC-BY-SA-4.0": ("cc by-sa 4.0", "cc by-sa 4.0 license", "creative commons attribution-sharealike 4.0 international license", "creative commons attribution-sharealike 4.0", "creative commons attribution share-alike 4.0"),
    "CC-BY-NC-4.0": ("cc by-nc 4.0", "cc by-nc 4.0 license", "creative commons attribution-noncommercial 4.0 international license", "creative commons attribution-noncommercial 4.0", "creative commons attribution non-commercial 4.0"),
    "CC-BY-ND-4.0": ("cc by-nd 4.0", "cc by-nd 4.0 license", "creative commons attribution-noderivatives 4.0 international license", "creative commons attribution-noderivatives 4.0", "creative commons attribution no-derivatives 4.0"),
    "CC0-1.0": ("cc0 1.0 universal", "creative commons cc0", "creative commons zero cc0 1.0", "cc0 1.0", "cc0 waiver"),
    "ISC": ("isc license", "isc licence", "internet systems consortium isc license"),
    "Unlicense": ("unlicense", "unlicense license"),
}
_STATED = ("licensed under the {}", "licensed under {}", "this work is licensed under the {}", "this work is licensed under a {}", "released under the {}", "released under {}", "this software is distributed under the {}", "you can redistribute it under the terms of the {}", "available under the {}", "this project is published under the terms of the {}", "code is covered by the {}", "the content is made available under {}", "subject to the {}", "license {}", "dedicated under {}", "use of this file is governed by the {}")
_DENIED = ("this is not licensed under the {}", "not released under the {}", "it was never licensed under the {}", "no longer available under the {}", "cannot be distributed under the {}", "the {} does not apply", "we rejected the {}", "neither the {} nor others apply", "this program is not licensed under the {}", "unlike projects under the {} ours is closed", "the history of the {} is long", "a talk about the {} was given", "is the {} a good choice", "the {} was written by lawyers", "compare the {} with others")
#: Sentences that state no licence of a known family.
_TALK = ("all rights reserved copyright holder", "the driver lost the licence last year", "a fishing license costs ten", "copyright law was changed by parliament", "the license plate was blue", "ask the office for a new license", "licensed under proprietary terms contact sales", "see the license file for details", "the public domain is a matter of debate", "no license is granted", "their copyright claim was rejected by the court", "licensed physicians may apply version 3", "the general public was licensed to enter", "a creative commons of ideas", "permission was refused by the director", "the permission is granted free of charge to visitors", "redistribution of land was planned", "source and binary forms of stars", "the software is distributed by mail", "leaflets were distributed under the bridge", "a gnu grazed in the park", "they endorse the plan", "distributed under the terms of the contract", "licensed under the terms of the agreement", "the above copyright notice", "version 2.0 of the plan", "apache helicopters flew by", "mit press published it", "mozilla released a browser", "the bsd conference met", "released under embargo", "the license of the pub was renewed", "you may not use this road")


def grams(text: str) -> set[str]:
    words = re.findall(_WORD, text.lower())
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def pairs(text: str) -> set[str]:
    """The pairs of neighbouring words, or the word if it is the only one."""
    return {g for g in grams(text) if " " in g} or grams(text)


def _third(phrases: tuple[str, ...], held_out: bool) -> tuple[str, ...]:
    """Every third phrase for calibration, the others for training."""
    return tuple(p for i, p in enumerate(phrases) if (i % 3 == 2) == held_out)


def statements(n: int, seed: int, held_out: bool = False) -> list[tuple[str, str]]:
    """Labelled statements: phrases that state, deny or talk of a licence, and pieces of the licences' sentences, among other words.

    Held-out ones state licences in other phrases than the rest.
    """
    dice = random.Random(seed)
    stated, short = (_third(p, held_out) for p in (_STATED, _SHORT_STATED))
    filler = lambda k: " ".join("".join(dice.choice("aeioustrnlmdc") for _ in range(dice.randint(1, 8))) for _ in range(dice.randint(0, k)))
    bodies = [(family, t.split()) for family, ts in TEMPLATES.items() for t in ts if len(t.split()) > 9]
    out = []
    for i in range(n):
        family = dice.choice(list(NAMES))
        if i % 4 == 0:
            words = dice.choice(stated).format(dice.choice(NAMES[family])).split()
            if len(words) > 6 and dice.random() < 0.2:
                words[dice.randint(0, 1)] = filler(1)
        elif i % 4 == 1:
            if dice.random() < 0.6:  # identifiers
                words = dice.choice(short).format(dice.choice(SHORT[family])).split()
            elif family in _LINES and dice.random() < 0.35:
                words = dice.choice(_LINES[family]).split()
            else:
                family, words = dice.choice(bodies)
                keep = dice.randint(-(-7 * len(words) // 10), len(words))
                at = dice.randint(0, len(words) - keep)
                words = [w if dice.random() > 0.03 else filler(1) for w in words[at : at + keep]]
        elif i % 4 == 2:
            words, family = dice.choice(_DENIED).format(dice.choice(NAMES[family])).split(), UNKNOWN
        else:
            words, family = dice.choice((*_TALK, "", "licensed copyright")).split(), UNKNOWN
            if dice.random() < 0.3:  # pieces don't make a licence
                whole = dice.choice([dice.choice(bodies)[1], dice.choice(dice.choice(list(NAMES.values()))).split()])
                words = whole[: dice.randint(1, max(1, min(4, len(whole) // 3)))]
            elif dice.random() < 0.3:
                words += dice.choice(_TALK).split()
        out.append((f"{filler(6)} {' '.join(words)} {filler(6)}", family))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float]:
    """Classes, the weights of each gram per class, the intercepts, all divided by the temperature, and the threshold of the unknown class."""
    rows = statements(TRAINING_ROWS, 5)
    classes = [UNKNOWN, *TEMPLATES]
    known = [*(t for ts in TEMPLATES.values() for t in ts), *_TALK, *(p.format(n) for p in (*_STATED, *_DENIED) for ns in NAMES.values() for n in ns)]
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*map(grams, known))))}

    def matrix(of: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(of), len(vocabulary)), np.float32)
        for i, (text, _) in enumerate(of):
            x[i, [vocabulary[g] for g in grams(text) if g in vocabulary]] = 1
        return x, np.array([classes.index(c) for _, c in of])

    x, y = matrix(rows)
    weight, bias = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    truth = np.eye(len(classes), dtype=np.float32)[y]
    speed_w, speed_b = np.zeros_like(weight), np.zeros_like(bias)
    for _ in range(ROUNDS):  # gradient descent with momentum
        z = x @ weight + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed_w = 0.9 * speed_w - 2.0 * (x.T @ (p - truth) / len(y) + PENALTY * weight)
        speed_b = 0.9 * speed_b - 2.0 * (p - truth).mean(0)
        weight, bias = weight + speed_w, bias + speed_b
    x, y = matrix(statements(TRAINING_ROWS // 2, 6, held_out=True))
    z = (x @ weight + bias).astype(np.float64)

    def softmax(t: float) -> np.ndarray:
        s = np.exp((z - z.max(1, keepdims=True)) / t)
        return s / s.sum(1, keepdims=True)

    t = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(softmax(t)[np.arange(len(y)), y] + 1e-300).mean())
    p = softmax(t)
    wrong = np.sort(np.where(p[:, 1:].max(1) > p[:, 0], p[:, 1:].max(1), 0.0)[y == 0])
    threshold = float(max(0.5, wrong[int(np.ceil((1 - FALSE_KNOWN) * len(wrong))) - 1] + 1e-6))
    weight = weight.astype(np.float64) / t
    return classes, {g: np.where(np.abs(weight[i]) >= MIN_WEIGHT, weight[i], 0.0) for g, i in vocabulary.items()}, bias.astype(np.float64) / t, threshold


def uncovered(template: str, needed: tuple[str, ...]) -> set[str]:
    """The pairs of words of a template without any of the needed strings."""
    return {p for p in pairs(template) if not any(n in p for n in needed)}


@lru_cache(maxsize=8)
def needed_strings(contained: float) -> tuple[str, ...]:
    """NEEDED, and the longest words of templates of which too many pairs have none of these."""
    needed = NEEDED
    for ts in TEMPLATES.values():
        for t in ts:
            while len(bare := uncovered(t, needed)) >= contained * len(pairs(t)):
                needed += (max({w for p in bare for w in p.split()}, key=lambda w: (len(w), w)),)
    return needed


def _may(text: Column, strings: tuple[str, ...]) -> Column:
    either = "|".join(s.replace(" ", r"\s+") for s in strings)
    return F.coalesce(text.rlike(f"(?i:{either})"), F.lit(False))


#: What a statement says before a choice of short names, and the choice, at its end.
_NAMED = r"\(*[\w.+-]+(?: [\w.+-]+){0,3}\)*"
_CHOICE = rf"(?i)((?:(?:spdx-)?licen[sc]e-identifier:?|licen[sc]ed under(?: the)?|released under(?: the)?|licen[sc]e:)) ({_NAMED}(?: (?:or|and|with) {_NAMED})+)[.;*/ ]*$"


def split_statements(text: Column) -> Column:
    """Sentences, each with its white space made single spaces; a blank line ends one too, and the end of a line with an identifier."""
    parted = F.regexp_replace(text, r"(-(?i:identifier):[^\n]*+)\n", "$1\n\n")  # what begins with a rare sign is found fast
    return F.transform(F.split(parted, r"(?<=[.!?;])\s+|\n[ \t\r]*\n\s*", -1), lambda s: F.regexp_replace(s, r"\s+", " "))


def choices(statements: Column) -> Column:
    """The statements, a choice of short names being one for each."""
    lead = lambda s: F.regexp_extract(s, _CHOICE, 1)
    each = lambda s: F.split(F.regexp_replace(F.regexp_extract(s, _CHOICE, 2), "[()]", ""), r"(?i)\s+(?:or|and|with)\s+", -1)
    return F.flatten(F.transform(statements, lambda s: F.when(s.rlike(_CHOICE), F.transform(each(s), lambda x: F.concat(lead(s), F.lit(" "), x))).otherwise(F.array(s))))


def gram_array(statement: Column) -> Column:
    """The distinct words and pairs of neighbouring words; the words are taken once, not once for each pair."""
    words = F.regexp_extract_all(F.lower(statement), F.lit(_WORD), F.lit(0))
    two = F.filter(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))), lambda p: p.isNotNull())
    return F.array_distinct(F.concat(words, two))


def classify_statements(found: DataFrame, known: float | None = None, contained: float = 0.6) -> DataFrame:
    """``sid, predicted, probability, containment, family`` of statements given as ``sid, statement`` (distinct sids).

    ``predicted`` is the classifier's class and ``probability`` its calibrated probability; ``family`` is that class
    if it is known and confirmed by a template, else ``unknown``. ``known`` is the model's own threshold by default.
    """
    spark = found.sparkSession
    classes, weight, bias, threshold = model()
    known = threshold if known is None else known
    found = found.select("sid", F.explode_outer(gram_array(F.col("statement"))).alias("gram"))
    table = F.broadcast(spark.createDataFrame([(g, w.tolist()) for g, w in weight.items()], "gram string, weights array<double>"))  # as many rows as the model has grams
    shapes = [(g, f"{c}/{k}", len(own)) for c, ts in TEMPLATES.items() for k, t in enumerate(ts) for own in [pairs(t)] for g in own]
    shapes = F.broadcast(spark.createDataFrame(shapes, "gram string, template string, size int"))
    scored = found.join(table, "gram", "left").groupBy("sid").agg(F.array(*[F.sum(F.coalesce(F.col("weights")[i], F.lit(0.0))) + F.lit(float(b)) for i, b in enumerate(bias)]).alias("z"))
    top = F.array_max("z")
    scored = scored.select(
        "sid", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("z", top).cast("int")).alias("predicted"),
        (1 / F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - top))).alias("probability"),
    )
    held = found.join(shapes, "gram").groupBy("sid", "template", "size").agg(F.count("*").alias("n"))
    held = held.groupBy("sid", F.regexp_replace("template", "/.*", "").alias("predicted")).agg(F.max(F.col("n") / F.col("size")).alias("containment"))
    both = scored.join(held, ["sid", "predicted"], "left").withColumn("containment", F.coalesce("containment", F.lit(0.0)))
    confirmed = (F.col("predicted") != UNKNOWN) & (F.col("probability") >= known) & (F.col("containment") >= contained)
    return both.select("sid", "predicted", "probability", "containment", F.when(confirmed, F.col("predicted")).otherwise(UNKNOWN).alias("family"))


def scan_licenses(docs: DataFrame, known: float | None = None, contained: float = 0.6) -> DataFrame:
    """``doc_id, n_paragraphs, families, license, confidence`` of every document.

    ``n_paragraphs`` counts statements that speak of licences (one of NEEDED) or are confirmed; ``families`` are the confirmed
    ones, sorted; ``license`` is the most probable of them (the last by name on ties), ``unknown`` if
    there are only unconfirmed statements, null if there are none. Null ids and texts give
    a row without a licence; repeated rows a row each, and equal ids are told apart by row. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    needed = needed_strings(contained)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    hit = texts.where(_may(F.col("text"), needed)).select("doc_id", choices(F.filter(split_statements(F.col("text")), lambda s: _may(s, needed))).alias("own"))
    # the row's number is written with it, so that no later read of it differs
    hit = store(hit.select("doc_id", F.monotonically_increasing_id().alias("uid"), "own"))
    lines = hit.select("uid", F.explode("own").alias("statement")).withColumn("sid", F.xxhash64("statement"))
    distinct = lines.groupBy("sid").agg(F.min("statement").alias("statement"))
    judged = checkpoint(classify_statements(distinct, known, contained).select("sid", "probability", "family"))
    copies = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = lines.select("uid", "sid", _may(F.col("statement"), NEEDED).alias("marked"), F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt")).join(copies, ["sid", "salt"])
    ok = F.col("family") != UNKNOWN
    per_row = of.groupBy("uid").agg(
        F.sum((F.col("marked") | ok).cast("long")).alias("n"), F.sort_array(F.collect_set(F.when(ok, F.col("family")))).alias("families"), F.max(F.when(ok, F.struct("probability", F.col("family").alias("name")))).alias("best")
    )
    some = hit.select("doc_id", "uid").join(per_row, "uid", "left").select("doc_id", "n", "families", "best.name", "best.probability")
    none = texts.where(~_may(F.col("text"), needed)).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("families", "array<string>"), ("name", "string"), ("probability", "double"))])
    return some.unionByName(none).select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.when(F.col("n") > 0, F.coalesce("name", F.lit(UNKNOWN))).alias("license"),
        F.round("probability", 6).alias("confidence"),
    )

"""License scans: a trained classifier of paragraphs, confirmed by comparison with templates.

A paragraph is a stretch of lines with words of the lexicon, with at most one other line between two of them, up to a
blank one, without comment marks: notices are wrapped. Each line is judged by itself first, since lists of licences
have one a line; where no line of a paragraph is confirmed, the lines joined are judged, and if they are confirmed they
count as one licence line in place of their own.

Sparse word 1- and 2-grams feed a multinomial logistic regression over licence families and "none", trained here, on
the driver, from the templates below, sentences that grant nothing, and alterations of both. What decides is set on
wordings that a first fit has not seen: one template of each family that has several, every third sentence, and
notices of families that the model doesn't know. A temperature fits its probabilities to them, and two thresholds
are chosen that tell best known families, none, and unknown ones: a paragraph is "none" if that is probable enough,
else of its best family if that is, and else "unknown". A family is confirmed if the paragraph holds at least CONFIRM
of the 2-grams of one of its templates; unconfirmed ones are "unknown" too. The last fit is over all wordings.

Every feature has a word of the lexicon, so that paragraphs without any are "none" by the model itself and
are passed over by one regular expression. Scoring uses DataFrame functions only; the model's tables have as
many rows as the templates have n-grams.

Rows: null and empty texts have no paragraphs. Rows that share a doc_id, or have none, are told apart by a 128-bit print
of the text; rows that share the text too get the same result. Very long texts and paragraphs are read whole. Other
columns of the input, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import empty_safe_text, staged

#: Usual wordings of licence notices, by family.
TEMPLATES = {
    "MIT": (
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL": (
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "MPL-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": (
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "SPDX-License-Identifier: CC0-1.0",
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without written permission of the publisher.",
    ),
}
#: Notices of families that the model doesn't know. They only help to set what decides.
UNSEEN = (
    "SPDX-License-Identifier: ISC",
    "ISC License",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "SPDX-License-Identifier: Zlib",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "SPDX-License-Identifier: EPL-2.0",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This package is free software; you can redistribute it under the terms of the Artistic License 2.0.",
    "This software is licensed under the terms of the Ruby license.",
    "Licensed under the Open Software License version 3.0.",
)
#: Sentences with words of the lexicon that grant no licence.
OTHERS = (
    "You need a driving license to rent a car in this city.",
    "The license plate of the van was missing.",
    "The painter took some poetic license with the facts.",
    "He studied at MIT before he moved to Boston.",
    "Apache helicopters flew over the valley at noon.",
    "The general public was invited to the opening.",
    "Permission to build was granted by the council last week.",
    "Version 2.0 of the program was released in May.",
    "She is a licensed physician and works in the public hospital.",
    "The author has reserved a room for all of us.",
    "A copy of the report was published by the foundation.",
    "Use of the software is free for students of the academy.",
    "The commons is open to creative people of all ages.",
    "Without restriction, the herd grew until the pasture was bare.",
    "Attribution of the painting to the master is disputed.",
    "The gnu is a large antelope of the African plains.",
    "The Mozilla browser was the subject of the lecture.",
    "Copyright law was changed after a long debate.",
    "Rights and duties of the members are listed below.",
    "Source and binary stars were observed in two forms.",
    "A marriage license was issued to the couple on Friday.",
    "The bar lost its liquor license after the fight.",
    "Students released the pigeons under the domain of the palace.",
    "His copyright claim was waived by the international court.",
)
#: Words that are common in any text and make no paragraph worth a look.
COMMON = frozenset(
    "a an and any all are as at be been by can for free from has have in into is it later may no not of on or part person "
    "that the this to under use was with work without you version following file files forms form met published "
    "publication public general related rights terms code source copy charge deal except extent foundation author "
    "international conditions provided program library written possible law obtaining associated documentation binary v s "
    "only identifier including limitation modify merge publish distribute sell copies permit persons whom furnished do "
    "so subject either your option above notice shall included substantial portions obtain http www org should received "
    "along must retain list if one distributed".split()
)
CONFIRM = 0.75
#: What a line of a comment starts and ends with.
MARKS = r"^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--)?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$"
#: Alterations of each template and each other sentence.
ALTERED = 24
NONE, UNKNOWN = "none", "unknown"


def tokens(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fitted(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression. y: the class, or -1 for rows that are left out."""
    x, y = x[y >= 0], y[y >= 0]
    weight, bias = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    bias[0] = 2.0
    onehot = np.eye(classes)[y]
    for _ in range(150):
        d = (probabilities(x @ weight + bias) - onehot) / len(y)
        weight -= 8.0 * (x.T @ d + 1e-5 * weight)
        bias -= 2.0 * d.sum(0)
    return weight, bias


def decided(p: np.ndarray, none: float, sure: float) -> np.ndarray:
    """The class of each row of probabilities; -1 is unknown."""
    best = 1 + p[:, 1:].argmax(1)
    return np.where(p[:, 0] >= none, 0, np.where(p[np.arange(len(p)), best] >= sure, best, -1))


@cache
def model() -> dict:
    """Weights by n-gram and class, bias, temperature, thresholds, lexicon, 2-grams of the templates, and how many of the
    held-out wordings of known families, none and unknown families are told.
    """
    rng = np.random.Generator(np.random.PCG64(11))
    labels = [NONE, *TEMPLATES]
    lexicon = sorted({t for family in TEMPLATES.values() for x in family for t in tokens(x)} - COMMON - set("0123456789"))
    inside = set(lexicon)

    def features(words: list[str]) -> set[str]:
        return {g for g in grams(words) if inside & set(g.split())}

    filler = [w for s in OTHERS for w in tokens(s)]

    def altered(words: list[str]) -> list[str]:
        kept = [w for w in words if rng.random() > 0.08]
        pad = lambda: list(rng.choice(filler, int(rng.integers(0, 6))))
        return [*pad(), *kept, *pad()]

    # class (-1: a family that is not known), held out, words
    rows = [(k, len(TEMPLATES[f]) > 2 and i == 1, altered(tokens(x))) for k, f in enumerate(labels[1:], 1) for i, x in enumerate(TEMPLATES[f]) for _ in range(ALTERED)]
    rows += [(0, i % 3 == 1, altered(tokens(x))) for i, x in enumerate(OTHERS) for _ in range(ALTERED)]
    rows += [(0, i % 3 == 1, list(rng.choice(filler, 12))) for i in range(ALTERED * 10)]
    rows += [(-1, True, altered(tokens(x))) for x in UNSEEN for _ in range(ALTERED)]
    vocabulary = sorted({g for k, _, w in rows if k >= 0 for g in features(w)})
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (_, _, w) in enumerate(rows):
        x[i, [at[g] for g in features(w) if g in at]] = 1
    y, out = np.array([k for k, *_ in rows]), np.array([held for _, held, _ in rows])
    weight, bias = fitted(x, np.where(out, -1, y), len(labels))
    z, truth = x[out] @ weight + bias, y[out]
    seen = truth >= 0
    temperature = min((0.25 * k for k in range(1, 21)), key=lambda t: -np.log(probabilities(z[seen] / t)[np.arange(seen.sum()), truth[seen]] + 1e-12).mean())
    p = probabilities(z / temperature)

    def told(none: float, sure: float) -> list[float]:
        got = decided(p, none, sure)
        return [float((got == truth)[kind].mean()) for kind in (truth > 0, truth == 0, truth < 0)]

    grid = np.linspace(0.05, 0.95, 19)
    none, sure = max(((float(a), float(b)) for a in grid for b in grid), key=lambda t: sum(told(*t)))
    shares = dict(zip(("known", "none", "unknown"), told(none, sure), strict=True))
    weight, bias = fitted(x, y, len(labels))
    templates = [(f, k, sorted(g for g in grams(tokens(t)) if " " in g)) for f, family in TEMPLATES.items() for k, t in enumerate(family)]
    return {"labels": labels, "lexicon": lexicon, "weights": {g: weight[i].tolist() for g, i in at.items()}, "bias": bias.tolist(), "temperature": temperature, "none": none, "sure": sure, "templates": templates, "told": shares}


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of fixed rows."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def line_id() -> Column:
    """A 128-bit print of the line."""
    return F.unhex(F.md5("line"))


def classified(lines: DataFrame) -> DataFrame:
    """id, family, probability of each distinct ``line`` (with its ``line_id``); family is none, unknown or confirmed."""
    spark, m = lines.sparkSession, model()
    words = F.array_remove(F.split(F.lower("line"), "[^a-z0-9]+", -1), "")
    each = staged(lines.groupBy("id").agg(F.first("line").alias("line")), "license-lines").withColumn("w", words)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    each = each.withColumn("pairs", F.array_distinct(pairs)).withColumn("grams", F.array_union("w", "pairs"))
    weights = literal(spark, [{"gram": g, "w": w} for g, w in m["weights"].items()], "gram: string, w: array<double>")
    k = len(m["labels"])
    z = each.select("id", F.explode("grams").alias("gram")).join(weights, "gram").groupBy("id").agg(F.array(*[F.sum(F.get("w", F.lit(i))) for i in range(k)]).alias("z"))
    templates = literal(spark, [{"family": f, "t": i, "size": len(g), "pair": p} for f, i, g in m["templates"] for p in g], "family: string, t: int, size: int, pair: string")
    hits = each.select("id", F.explode("pairs").alias("pair")).join(templates, "pair").groupBy("id", "family", "t").agg((F.count(F.lit(1)) / F.max("size")).alias("part"))
    same = hits.groupBy(F.col("id").alias("id_"), F.col("family").alias("f_")).agg(F.max("part").alias("part"))
    bias, labels = m["bias"], F.array(*[F.lit(x) for x in m["labels"]])
    scored = each.select("id").join(z.withColumnRenamed("id", "z_id"), F.col("id") == F.col("z_id"), "left")
    full = F.array(*[(F.coalesce(F.get("z", F.lit(i)), F.lit(0.0)) + bias[i]) / m["temperature"] for i in range(k)])
    scored = scored.withColumn("z", full).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    scored = scored.withColumns({"total": total, "best": F.array_max(F.slice("z", 2, k - 1))})
    scored = scored.withColumns({"none": F.exp(F.get("z", F.lit(0)) - F.col("top")) / F.col("total"), "probability": F.exp(F.col("best") - F.col("top")) / F.col("total"), "family": F.get(labels, F.array_position(F.slice("z", 2, k - 1), F.col("best")).cast("int"))})
    scored = scored.join(same, (F.col("id") == F.col("id_")) & (F.col("family") == F.col("f_")), "left")
    sure = (F.col("probability") >= m["sure"]) & (F.coalesce("part", F.lit(0.0)) >= CONFIRM)
    family = F.when(F.col("none") >= m["none"], NONE).when(sure, F.col("family")).otherwise(UNKNOWN)
    return scored.select("id", family.alias("family"), F.when(F.col("none") >= m["none"], F.col("none")).otherwise(F.col("probability")).alias("probability"))


def interesting(line: Column) -> Column:
    """Whether a line has a word of the lexicon."""
    return line.rlike(rf"(?i)(?<![a-z0-9])(?:{'|'.join(model()['lexicon'])})(?![a-z0-9])")


def bare(line: Column) -> Column:
    """A line without comment marks."""
    return F.regexp_replace(line, MARKS, "")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, tx, par_no, line_no, line, family, probability of what the model calls a licence or unknown.

    Lines with a word of the lexicon form a stretch if at most one line, not a blank one, is between them. line_no is
    that in the text; -1 is a stretch as a whole, which stands for its lines.
    """
    text = empty_safe_text(docs)
    each = docs.select("doc_id", F.unhex(F.md5(text)).alias("tx"), F.split(text, "\n", -1).alias("__all"))
    each = each.withColumn("__at", F.filter(F.transform("__all", lambda x, i: F.when(interesting(x), i)), lambda i: i.isNotNull()))
    each = each.where(F.size("__at") > 0).select("doc_id", "tx", "__all", F.explode(F.transform("__at", lambda i, k: F.struct(i.alias("i"), (i - F.get("__at", k - 1)).alias("far")))).alias("x"))
    gap = F.when(F.col("x.far") == 2, bare(F.get("__all", F.col("x.i") - 1)))
    each = each.select("doc_id", "tx", F.col("x.i").alias("line_no"), F.col("x.far").alias("far"), gap.alias("gap"), bare(F.get("__all", F.col("x.i"))).alias("line")).dropDuplicates(["doc_id", "tx", "line_no"])
    near = (F.col("far") == 1) | (F.col("far") == 2) & F.col("gap").rlike(r"[^\x20\x09-\x0D]")
    each = each.withColumn("par_no", F.count_if(~F.coalesce(near, F.lit(False))).over(W.partitionBy("doc_id", "tx").orderBy("line_no")))
    each = staged(each, "license-stretches")
    # The lines of a stretch follow each other, so what is gathered is one notice.
    joined = each.groupBy("doc_id", "tx", "par_no").agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list(F.struct("line_no", "gap", "line", "far"))).alias("parts")).where("c > 1")
    pieces = F.transform("parts", lambda x, k: F.concat_ws(" ", F.when(k > 0, x["gap"]), x["line"]))
    joined = staged(joined.select("doc_id", "tx", "par_no", F.lit(-1).alias("line_no"), F.array_join(pieces, " ").alias("line")), "license-joined")
    found = each.select("doc_id", "tx", "par_no", "line_no", "line").unionByName(joined).withColumn("id", line_id())
    known = staged(classified(found).where(F.col("family") != NONE), "license-known").withColumnRenamed("id", "i_")
    judged = found.join(known, F.col("id") == F.col("i_")).drop("i_", "id")
    sure, whole = F.col("family") != UNKNOWN, F.col("line_no") < 0
    par = W.partitionBy("doc_id", "tx", "par_no")
    judged = judged.withColumns({"by_line": F.count_if(sure & ~whole).over(par), "by_par": F.count_if(sure & whole).over(par)})
    return judged.where(F.when((F.col("by_line") == 0) & (F.col("by_par") > 0), whole).otherwise(~whole)).drop("by_line", "by_par")


def by_document(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (lines with a word), n_licence, n_unknown and families (sorted, comma-joined) of every row."""
    text = empty_safe_text(docs)
    base = docs.select("doc_id", F.unhex(F.md5(text)).alias("tx"), F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"))
    found = scanned(docs)
    by = found.groupBy(F.col("doc_id").alias("d_"), F.col("tx").alias("x_")).agg(
        F.count_if(F.col("family") != UNKNOWN).alias("n_licence"), F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))), ",").alias("families")
    )
    out = base.join(by, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("tx") == F.col("x_")), "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_licence", F.lit(0)).cast("long").alias("n_licence"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))

"""License scans: sparse TF-IDF cosine to license notices and headers, trigram cosine to full texts, then inheritance from the nearest ancestor directory.

DataFrame functions only. A text is compared with the notices sentence by
sentence (a header may stand anywhere), once by lines and once with wrapped
lines joined, and as a whole with notices and full license texts. Inverse
document frequencies come from the notices; words outside them count as the
rarest. Only texts that speak of licensing or hold one of the anchors, heavy
words without which no template sentence is reached, are compared at all. The
scan is narrow; only directories are shuffled.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Cuts, read

# fixed values: identifiers and notices of licenses
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
}

FREE = "you can redistribute it and/or modify it under the terms of the GNU"
BY = "as published by the Free Software Foundation"
#: Sentences of standard file headers, and those by which texts without a short header are known. An SPDX tag needs no template.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "This source code is licensed under the Apache License, Version 2.0 found in the LICENSE file in the root directory of this source tree."),
    ("Apache-2.0 OR MIT", "Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0> or the MIT license <LICENSE-MIT or http://opensource.org/licenses/MIT>, at your option."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", f"This program is free software; {FREE} General Public License {BY}; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", f"This program is free software; {FREE} General Public License version 2 {BY}."),
    ("GPL-3.0", f"This program is free software: {FREE} General Public License {BY}, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", f"This program is free software: {FREE} General Public License {BY}, version 3."),
    ("AGPL-3.0", f"This program is free software: {FREE} Affero General Public License {BY}, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", f"This program is free software: {FREE} Affero General Public License {BY}, version 3."),
    ("LGPL-2.1", f"This library is free software; {FREE} Lesser General Public License {BY}; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", f"This library is free software: {FREE} Lesser General Public License {BY}, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]
#: Full texts of licenses.
BODIES = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

#: Least cosine of a sentence that is a header, and of a whole text that is a license file.
HEADER, FILE = 0.75, 0.5
#: Ends of sentences and lines.
ENDS = r"[.!?;]?[ \t]*\n|[.!?;][ \t]+"
#: A line that names a copyright holder.
HOLDER = r"(?:^|\n)[^A-Za-z0-9\n]*(?:[Cc]opyright|COPYRIGHT)[ \t:]+(?:\([cC]\)|©|[0-9]{4}|[A-Z])[^\n]*(?=\n|$)"
#: Ends of sentences over wrapped lines: also at lines without words, and around lines of copyright holders.
JOINED = HOLDER + r"""|(?<![ ]v)[.!?]["')\]]*(?:[ \t\r]*\n|[ \t]+)|\n[^A-Za-z0-9\n]*(?=\n)"""
#: A text without any of these words, and without anchors, holds no license.
SPEAKS = r"licen[sc]\w*|sublicense|permission|redistribut\w*|unencumbered"
#: Words that most texts hold.
COMMON = frozenset("a an and are as at be by can file found form in is it library of on or that the this to use v with work 2 3".split())
SPDX = r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9][A-Za-z0-9.+-]*\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9.+-]+\)?)*)"


class Model:
    """Unit TF-IDF vectors of (name, text), idf of their words and of others, and the anchors of the first `anchored` for a threshold."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float, anchored: int):
        self.names = [name for name, _ in templates]
        words = dict(enumerate(Counter(re.findall("[a-z0-9]+", text.lower())) for _, text in templates))
        df = Counter(w for c in words.values() for w in c)
        self.idf = {w: math.log((1 + len(words)) / (1 + n)) + 1 for w, n in sorted(df.items())}
        self.rare = math.log(1 + len(words)) + 1
        self.vectors, anchors = {}, set()
        for name, c in words.items():
            v = {w: n * self.idf[w] for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors[name] = {w: x / norm for w, x in v.items()}
            if name >= anchored:
                continue
            left = 1.0
            # words that every text is searched for come first, words that most texts hold last
            for w in sorted(self.vectors[name], key=lambda w: (not re.fullmatch(SPEAKS, w), w in COMMON, -self.vectors[name][w], w)):
                if left < threshold**2:
                    break
                if not re.fullmatch(SPEAKS, w):
                    anchors.add(w)
                left -= self.vectors[name][w] ** 2
        self.anchors = sorted(anchors)


def _best(text: Column, model: Model) -> Column:
    """struct(score, license) of the nearest template of a text, in one pass over its sorted words."""
    words = F.array_sort(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))
    names = model.names
    # literals that the optimizer reads once, as maps of so many words would be slow to build
    zeros = F.from_json(F.lit(json.dumps([0.0] * len(names))), "array<double>")
    idf = F.from_json(F.lit(json.dumps(model.idf)), "map<string,double>")
    products = F.from_json(F.lit(json.dumps({w: [v.get(w, 0.0) * x for v in model.vectors.values()] for w, x in model.idf.items()})), "map<string,array<double>>")

    def add(acc, w):
        # squares are summed as runs of equal words end
        same = w == acc["word"]
        weight = F.coalesce(F.try_element_at(idf, w), F.lit(model.rare))
        run = F.when(same, acc["run"] + weight).otherwise(weight)
        squares = F.when(same, acc["squares"]).otherwise(acc["squares"] + acc["run"] * acc["run"])
        dots = F.when(F.map_contains_key(products, w), F.zip_with(acc["dots"], F.coalesce(F.try_element_at(products, w), zeros), lambda a, b: a + b)).otherwise(acc["dots"])
        return F.struct(w.alias("word"), run.alias("run"), squares.alias("squares"), dots.alias("dots"))

    def finish(acc):
        norm = F.nullif(F.sqrt(acc["squares"] + acc["run"] * acc["run"]), F.lit(0.0))
        scores = F.zip_with(acc["dots"], F.array(*map(F.lit, names)), lambda d, n: F.struct(F.round(d / norm, 6).alias("score"), n.alias("license")))
        return F.array_max(scores)

    start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"), zeros.alias("dots"))
    return F.aggregate(words, start, add, finish)


def _grams(text: Column) -> Column:
    """Distinct hashes of three consecutive words, without the lines of copyright holders."""
    words = F.transform(F.regexp_extract_all(F.regexp_replace(text, HOLDER, "\n"), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    three = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda k: F.xxhash64(F.array_join(F.slice(w, k, F.lit(3)), " ")))
    return F.element_at(F.transform(F.array(words), lambda w: F.array_distinct(three(w))), 1)


def _grams_of(text: str) -> list[int]:
    """The same of a string."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = re.findall("[A-Za-z0-9]+", re.sub(HOLDER, "\n", text))
    found = {xxh64_intdigest(" ".join(words[k : k + 3]).lower().encode(), 42) for k in range(max(1, len(words) - 2))}
    return np.array(sorted(found), np.uint64).view(np.int64).tolist()


def _body(text: Column, bodies: dict[str, str]) -> Column:
    """struct(score, license) of the nearest full text, by the cosine of sets of trigrams."""
    known = [{"license": name, "grams": _grams_of(body)} for name, body in bodies.items()]
    known = F.from_json(F.lit(json.dumps(known)), "array<struct<license:string,grams:array<bigint>>>")
    score = lambda g, b: F.round(F.size(F.array_intersect(g, b["grams"])) / F.sqrt(F.size(g) * F.size(b["grams"])), 6)
    best = lambda g: F.array_max(F.transform(known, lambda b: F.struct(score(g, b).alias("score"), b["license"].alias("license"))))
    return F.element_at(F.transform(F.array(_grams(text)), best), 1)


def license_scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, header: float = HEADER, file: float = FILE, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", headers: list[tuple[str, str]] = HEADERS, bodies: dict[str, str] = BODIES) -> DataFrame:
    """Finds the license of each file.

    Returns one row for each input row: id_col, path_col, own_license and
    own_score, is_license_file, license (its own, else that of the nearest
    ancestor directory with a license file) and license_dir (that directory;
    null if its own). Its own license is that of the nearest full text with a
    cosine of `file` at least, else the expression of its first SPDX tag
    (without -only, -or-later and +), else that of its best header with a
    cosine of `header` at least; else null. A license file is near a full
    text, or holds a license and is as a whole near a notice of templates. A
    BSD text with the clause on endorsement is BSD-3-Clause. Of several
    license files in a directory the one with the best score counts, ties to
    the smaller id, then name. Ties between templates go to the later name. A
    null or empty text has no license of its own; a null path inherits
    nothing; rows with null or repeated ids are scanned like any other. Other
    columns are not read. An empty table gives no rows.
    """
    cuts = Cuts(files.sparkSession, "licenses")
    notices = sorted(templates.items())
    sentence, whole = Model(notices + headers, header, len(notices)), Model(notices, file, len(notices))
    gate = rf"(?i)\b(?:{'|'.join([SPEAKS, *sentence.anchors])})\b"
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    speaks = F.col("text").rlike(gate)
    heads = F.filter(F.array_union(F.split("text", ENDS), F.split("text", JOINED)), lambda s: s.rlike(gate))
    found = F.when(speaks, F.filter(F.transform(heads, lambda s: _best(s, sentence)), lambda x: x["score"] >= header))
    tag = F.regexp_replace(F.regexp_extract("text", SPDX, 1), r"(?:-only|-or-later|\+)(?![A-Za-z0-9.+-])", "")
    tag = F.when(speaks & (tag != ""), F.struct(F.lit(1.0).alias("score"), tag.alias("license")))
    scanned = rows.withColumn("found", found).withColumn("body", F.when(speaks, _body(F.col("text"), bodies)))
    body = F.when(F.col("body.score") >= file, F.col("body"))
    scanned = scanned.withColumn("body", body).withColumn("own", F.coalesce(F.col("body"), tag, F.array_max("found")))
    name = F.col("own.license")
    affero = (name == "GPL-3.0") & F.col("body").isNotNull() & F.substring("text", 1, 300).rlike("(?i)affero")
    endorse = (name == "BSD-2-Clause") & F.exists("found", lambda x: x["license"] == "BSD-3-Clause")
    own_license = F.when(affero, "AGPL-3.0").when(endorse, "BSD-3-Clause").otherwise(name)
    entire = F.when(F.col("own").isNotNull(), _best(F.col("text"), whole))
    scanned = scanned.withColumn("own", F.when(F.col("own").isNotNull(), F.struct(F.col("own.score").alias("score"), own_license.alias("license")))).withColumn("entire", F.greatest(entire["score"], F.col("body.score")))
    is_file = F.coalesce(F.col("entire") >= file, F.lit(False))
    directory = F.regexp_replace("path", "/[^/]*$", "")
    scanned = cuts.write(scanned.select("id", "path", directory.alias("dir"), F.col("own.license").alias("own_license"), F.col("own.score").alias("own_score"), is_file.alias("is_license_file"), F.col("entire").alias("file_score")))

    of_dir = scanned.filter("is_license_file and dir is not null").groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("file_score"), F.col("id").isNull(), "id", "own_license")).alias("license"))
    of_dir = cuts.write(of_dir.withColumnRenamed("dir", "license_dir"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    dirs = scanned.filter("dir is not null").select("dir").distinct().withColumn("license_dir", F.explode(ancestors))
    nearest = dirs.join(of_dir, "license_dir").groupBy("dir").agg(F.max_by(F.struct("license_dir", "license"), F.length("license_dir")).alias("from"))
    nearest = cuts.write(nearest.select("dir", "from.license_dir", F.col("from.license").alias("inherited")))
    joined = scanned.join(nearest, "dir", "left")
    inherits = F.col("own_license").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.col("path").alias(path_col),
        "own_license",
        "own_score",
        "is_license_file",
        F.coalesce("own_license", "inherited").alias("license"),
        F.when(inherits, F.col("license_dir")).alias("license_dir"),
    )


def op2_license_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    # documents stand in a tree by source and language
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return license_scan(docs.select("doc_id", "text", path.alias("path")))

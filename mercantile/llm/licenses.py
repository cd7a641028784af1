"""License scans by sparse TF-IDF cosine, and inheritance along directories by path joins.

Templates are one-sentence notices, whole headers and whole license files. Texts and templates
are sparse TF-IDF vectors over words; the terms and weights come from the templates, and words
unknown to them count with the largest weight, so long prose never resembles a notice. The whole
text is compared with the license files first. Else, for each template, a window of as many words
slides by single words over all places that hold a cue, whatever the lines and lengths. A window
resembles a template from a cosine of 0.7, if it also holds the template's distinguishing terms
(name and version) and none that tell another license. The best one is the document's license;
"all rights reserved" counts only where nothing else is found. Notices that are denied ("is not
released under ...") do not count, and all identifiers of an SPDX expression do. A document is a license file if
such windows hold most of its words, or by its file name.

A document without a license of its own inherits that of the nearest directory above it that
holds a license file: its path's ancestors are joined with the license files' directories, and
the longest one wins. Only license files' directories are joined, reduced to one per directory
first, and ancestors are at most as many as a path is deep.

Null and empty texts have no license of their own. A null path inherits nothing. Of several
license files in a directory the best score wins, then the first by license name. Repeated
rows give repeated results; very long texts are searched whole; an empty table gives no rows. Columns of
``keep`` that are named as results are replaced by them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import hot_join, hot_limit, map_text, materialise

COSINE = 0.7
FILE_SHARE = 0.6
#: License, terms and identifier of tags.
SPDX = (
    *((n, n.lower(), n) for n in ("MIT", "ISC")),
    *((n, n.lower().replace("-", " "), n) for n in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0")),
    *((f"{k}-{v}", f"{k.lower()} {v}", f"{k}-{v}{end}") for k, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for end in ("", "-only", "-or-later")),
)
#: License, terms that a text must hold, notice. Several rows of a license are several templates.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT", "mit license", "Released under the MIT License."),
    ("MIT", "permission granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("ISC", "permission fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "apache 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    *((f"{n}-{v}.0", f"license {v}", f"This work is licensed under the GNU {k}General Public License, version {v}.") for n, k, v in (("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser ", 3), ("AGPL", "Affero ", 3))),
    ("LGPL-3.0", "license 3", "Licensed under the GNU Lesser General Public License, version 3."),
    *((f"{n}-{v}", f"license {v.removesuffix('.0')}", f"is free software: you can redistribute it and/or modify it under the terms of the GNU {k}General Public License as published by the Free Software Foundation, either version {v.removesuffix('.0')} of the License, or (at your option) any later version.") for n, k, v in (("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0"), ("AGPL", "Affero ", "3.0"))),
    ("BSD-3-Clause", "redistribution endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "redistribution disclaimer", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *((f"CC-{k.upper()}-4.0", "cc 4.0", f"Licensed under CC {k.upper()} 4.0.") for k in ("by", "by-sa", "by-nc", "by-nc-sa", "by-nd")),
    ("CC0-1.0", "cc0 1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("proprietary", "rights reserved", "All rights reserved."),
    *((n, f"spdx {t}", f"SPDX-License-Identifier: {x}") for n, t, x in SPDX),
)
MIT = """MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: License, terms, and file of the whole text in license_texts. The first HEAD words are a template of their own.
FILES = (("Apache-2.0", "apache 2.0", "Apache-2.0"), ("GPL-2.0", "license 2", "GPL-2"), ("GPL-3.0", "license 3", "GPL-3"), ("LGPL-2.1", "lesser 2.1", "LGPL-2.1"), ("LGPL-3.0", "lesser 3", "LGPL-3"), ("MPL-2.0", "mozilla 2.0", "MPL-2.0"), ("CC0-1.0", "universal 1.0", "CC0-1.0"), ("BSD-3-Clause", "redistribution endorse", "BSD"))
HEAD = 120
#: The cosine from which a whole text is a license file, without a look at its parts.
WHOLE = 0.9
#: Terms that tell another license where a notice's template does not have them.
OTHERS = frozenset(("lesser", "affero", "library", "nc", "sa", "nd"))
#: Words that deny a notice which they stand in, or shortly before in its sentence.
DENIALS, BEFORE = frozenset("not never neither nor no isn wasn aren".split()), 4
#: Words of a window that are searched for denials.
DENIED = 30
#: The expression of an SPDX tag: identifiers with operators and brackets.
_TAG = re.compile(r"spdx-license-identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+-]*\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9][a-z0-9.+-]*\)*)*)", re.I)
_STOP = re.compile(r"[.;:!?](?:\s|$)|\n")
KNOWN_TAGS = {x.lower(): n for n, _, x in SPDX}
_WORD = re.compile(r"[0-9a-z]+(?:\.[0-9]+)*")
#: A line can only resemble a template if it holds one of these.
_CUE = re.compile(r"licen[sc]e|rights reserved|permission is|redistribution|public domain|creative commons|\bcc0?\b|spdx", re.I)


class Templates:
    def __init__(self, rows=TEMPLATES):
        top = Path(__file__).parent / "license_texts"
        full = [("MIT", "permission granted", MIT), *((n, t, (top / f).read_text(errors="replace")) for n, t, f in FILES)]
        texts = [(n, t, _WORD.findall(x.lower())) for n, t, x in [*rows, *full]]
        first = len(rows)
        texts += [(n, t, w[:HEAD]) for n, t, w in texts[first + 1 :]]
        docs = [Counter(w) for _, _, w in texts]
        seen = Counter(w for d in docs for w in d)
        self.names = [n for n, _, _ in texts]
        self.must = [t.split() for _, t, _ in texts]
        self.size = [len(w) for _, _, w in texts]
        self.full = range(first, first + len(full))
        #: Whole files name other licenses; notices and beginnings that do are of those.
        self.never = [() if k in self.full else [w for w in OTHERS if w not in d] for k, d in enumerate(docs)]
        self.idf = {w: 1 + math.log((1 + len(docs)) / (1 + c)) for w, c in seen.items()}
        self.unknown = 1 + math.log(1 + len(docs))
        self.vectors = [self.vector(d) for d in docs]

    def vector(self, words: Counter) -> dict[str, float]:
        v = {w: (1 + math.log(c)) * self.idf.get(w, self.unknown) for w, c in words.items()}
        n = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / n for w, x in v.items()}

    def fits(self, k: int, count) -> bool:
        return all(count.get(w) for w in self.must[k]) and not any(count.get(w) for w in self.never[k])

    def whole(self, words: list[str]) -> tuple[float, str]:
        """The license file that the whole text resembles most."""
        count = Counter(words)
        v = self.vector(count)
        return max(((min(1.0, sum(x * v.get(w, 0.0) for w, x in self.vectors[k].items())), self.names[k]) for k in self.full if self.fits(k, count)), default=(0.0, ""))

    def denied(self, k: int, words: list[str], at: int, sentence: list[int]) -> bool:
        """Whether the window of template k at a word is denied. ``sentence``: the number of each word's."""
        if not DENIALS.isdisjoint(words[max(0, at - BEFORE) : at]) and any(words[i] in DENIALS and sentence[i] == sentence[at] for i in range(max(0, at - BEFORE), at)):
            return True
        return any(w in DENIALS and w not in self.vectors[k] for w in words[at : at + min(self.size[k], DENIED)])

    def slide(self, k: int, words: list[str], idf: list[float], sentence: list[int], first: int, last: int) -> tuple[float, int]:
        """Best cosine, and where, of the windows of template k that start from ``first`` to ``last``."""
        size, vector, count = min(self.size[k], len(words)), self.vectors[k], {}
        square = dot = 0.0
        best = (0.0, -1)

        def turn(i: int, by: int) -> None:
            nonlocal square, dot
            w = words[i]
            c = count.get(w, 0)
            was = (1 + math.log(c)) * idf[i] if c else 0.0
            count[w] = c = c + by
            now = (1 + math.log(c)) * idf[i] if c else 0.0
            square += now * now - was * was
            if t := vector.get(w):
                dot += t * (now - was)

        for i in range(first, first + size):
            turn(i, 1)
        for at in range(first, last + 1):
            if at > first:
                turn(at - 1, -1)
                turn(at + size - 1, 1)
            if dot > 0 and (cosine := dot / math.sqrt(square)) >= COSINE and cosine > best[0] + 1e-9 and self.fits(k, count) and not self.denied(k, words, at, sentence):
                best = (min(1.0, cosine), at)
        return best


def own_license(text: str, templates: Templates) -> tuple[str | None, float, float, list[tuple[str, float]]]:
    """License, cosine, the share of the words that stand in license statements, and all licenses that
    are found, each with its best cosine."""
    none = None, 0.0, 0.0, []
    if not _CUE.search(text):
        return none
    text = text.lower()
    found = [(m.start(), m[0]) for m in _WORD.finditer(text)]
    starts, words = [a for a, _ in found], [w for _, w in found]
    if not words:
        return none
    cosine, name = templates.whole(words)
    if cosine >= WHOLE:
        return name, cosine, 1.0, [(name, cosine)]
    hits = [(cosine, name, 0, len(words))] if cosine >= COSINE else []
    held = np.full(len(words), bool(hits))
    for tag in _TAG.finditer(text):
        named = [KNOWN_TAGS[x] for x in re.split(r"[\s()]+", tag[1]) if x in KNOWN_TAGS]
        a, b = bisect_right(starts, tag.start()) - 1, bisect_right(starts, tag.end() - 1)
        hits += [(1.0, name, a, b) for name in named]
        held[a:b] |= bool(named)
    stops = [m.start() for m in _STOP.finditer(text)]
    sentence = [bisect_right(stops, a) for a in starts]
    idf = [templates.idf.get(w, templates.unknown) for w in words]
    cues = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in _CUE.finditer(text)})
    for k, name in enumerate(templates.names):
        size = min(templates.size[k], len(words))
        ranges: list[list[int]] = []
        for c in cues:
            a, b = max(0, c - size + 1), min(c, len(words) - size)
            if ranges and a <= ranges[-1][1] + 1:
                ranges[-1][1] = max(b, ranges[-1][1])
            else:
                ranges.append([a, b])
        for a, b in ranges:
            cosine, at = templates.slide(k, words, idf, sentence, a, b)
            if at >= 0:
                hits.append((cosine, name, at, at + size))
                held[at : at + size] = True
    if not hits:
        return none
    cosine, name, *_ = max(hits, key=lambda h: (h[1] != "proprietary", round(h[0], 9), h[1]))
    # where windows meet, the better one tells; an expression's licenses share theirs
    every: dict[str, float] = {}
    taken: list[tuple[float, int, int]] = []
    for c, n, a, b in sorted(hits, key=lambda h: (-round(h[0], 9), h[1])):
        if all(b <= x or y <= a or (c == best and (a, b) == (x, y)) for best, x, y in taken):
            every.setdefault(n, c)
            taken.append((c, a, b))
    return name, cosine, float(held.mean()), sorted(every.items())


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("cosine", T.DoubleType())]))
OUT = T.StructType([T.StructField("own_license", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("share", T.DoubleType()), T.StructField("found", FOUND)])


def licenses(files: DataFrame, *, keep: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """One row for each file: ``keep``, own_license, cosine, license (own or inherited), origin
    ('own', 'inherited' or null), license_dir (of the license file inherited from), and in ``found`` all
    licenses of the text with their cosines, such as those of an expression in a tag."""
    names = [*OUT.fieldNames(), "license", "origin", "license_dir"]
    keep = [c for c in keep if c not in names and c != "__path"]

    def make():
        templates = Templates()
        kind = pa.list_(pa.struct([("license", pa.string()), ("cosine", pa.float64())]))

        def fn(byte, off):
            raw = byte.tobytes()
            got = [own_license(raw[a:b].decode(), templates) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            return [pa.array([g[0] for g in got], pa.string()), pa.array(np.array([g[1] for g in got], float)), pa.array(np.array([g[2] for g in got], float)), pa.array([[{"license": n, "cosine": c} for n, c in g[3]] for g in got], kind)]

        return fn

    src = files.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{path}`").alias("__path"), F.col(f"`{text}`").alias("__body"))
    seen = materialise(map_text(src, "__body", [*keep, "__path"], OUT, make))
    folder = F.regexp_replace("__path", "/?[^/]*$", "")
    named = F.col("__path").rlike(r"(?i)(^|/)(licen[sc]e|copying)[^/]*$")
    grants = seen.where(F.col("own_license").isNotNull() & (named | (F.col("share") >= FILE_SHARE)) & F.col("__path").isNotNull())
    grants = grants.groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own_license").alias("l"))).alias("best")).select("dir", F.col("best.l").alias("granted"))
    # only directories of files that need one; each once
    without = F.col("own_license").isNull() & F.col("__path").isNotNull()
    need = materialise(seen.where(without).groupBy(folder.alias("__dir")).agg(F.count("*").alias("n")))
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    chains = need.select("__dir", "n", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("dir"))
    nearest = chains.join(grants, "dir").groupBy("__dir", "n").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "granted")).alias("best"))
    nearest = nearest.select("__dir", "n", F.col("best.dir").alias("license_dir"), F.col("best.granted").alias("__granted"))
    # files that need none stay where they are
    inherit = hot_join(seen.where(without).withColumn("__dir", folder), nearest, "__dir", "n", F.monotonically_increasing_id(), hot_limit(need, "n"), counted=need, how="left")
    out = inherit.drop("__dir").unionByName(seen.where(~without), allowMissingColumns=True)
    origin = F.when(F.col("own_license").isNotNull(), "own").when(F.col("__granted").isNotNull(), "inherited")
    return out.select(*keep, "own_license", "cosine", F.coalesce("own_license", "__granted").alias("license"), origin.alias("origin"), "license_dir", "found")


def query(spark, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source, below it one for each hundred ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", F.concat(F.lit("d"), F.expr("doc_id div 100")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses(docs.select("doc_id", "text", path.alias("path")), keep=["doc_id"])

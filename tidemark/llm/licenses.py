"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance down the directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise

#: Header forms by identifier; a parameter of the scan.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the 3-Clause BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    **{f"CC-{part}-{version}": (f"Licensed under CC {part} {version}.",) for part in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("4.0", "3.0", "2.0")},
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Proprietary": ("All rights reserved.",),
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
#: Full texts, and the notices and titles of licences too long to stand here, added to the header forms.
for _name, _text in (
    ("MIT", _MIT),
    ("BSD-3-Clause", _BSD),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: " + _GNU.format("Lesser General Public License")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
):
    TEMPLATES[_name] += (_text,)
#: What other licenses' files say too: any other license in a text outranks these.
GENERIC = frozenset({"Proprietary"})
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|copyright)[^/]*$"
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


#: A line that tells the identifier itself.
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)")
_NEGATED = re.compile(r"\b(?:not|never|nor)(?: \w+){0,2} (?:released|licensed|distributed|available|under)\b")
_VERSION = re.compile(r"\b(?:(?:version|v) ?|gplv?)(\d+(?:\.\d+)*)\b")
AMBIGUOUS = "ambiguous"


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def required(name: str, own: list[str], after: list[str], whole: frozenset[str] | set[str]) -> str:
    """The license that a match tells, by the terms that tell relatives apart: versions, lesser, affero, the parts of CC, endorse.

    `own` are the matching words, `after` those behind them, `whole` the terms of the text. Where a version is due and there is
    none, AMBIGUOUS.
    """
    text = " ".join(own)
    version = _VERSION.search(text) or _VERSION.search(" ".join(own[-2:] + after))
    number = version[1] if version else None
    full = lambda v: v if "." in v else f"{v}.0"
    if re.match("A?L?GPL-", name):
        kind = "AGPL" if "affero" in own else "LGPL" if "lesser" in own or "library general public" in text else "GPL"
        return f"{kind}-{full(number)}" if number else AMBIGUOUS
    if name.startswith("CC-BY"):
        part = [w for w in own[own.index("cc") + 1 :] if w in ("by", "nc", "sa", "nd")] if "cc" in own else []
        number = next((w for w in own + after[:2] if re.fullmatch(r"[1-4]\.\d", w)), None)
        return f"CC-{'-'.join(part).upper()}-{number}" if part and number else AMBIGUOUS
    if name.startswith("BSD-"):
        told = re.search(r"\b([234]) clause\b", text)
        return f"BSD-{told[1] if told else 3 if 'endorse' in whole else 2}-Clause"
    if name.split("-")[0] in ("Apache", "MPL") and number:
        return f"{name.split('-')[0]}-{full(number)}"
    return name


class Matcher:
    """Cosines of a text's lines, word windows and the whole text with the templates, under the corpus's inverse document frequencies.

    A template's windows have as many words as it and run over line ends, so that wrapped paragraphs and comment
    blocks are found.

    Words of no template have the weight of an unseen word. Each template has anchors, its heaviest terms without
    which no text reaches the threshold (Cauchy-Schwarz); lines without any anchor are passed over.
    """

    def __init__(self, templates: dict[str, tuple[str, ...]], df: dict[str, int], n: int, threshold: float):
        self.idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1
        self.other, self.threshold = math.log(1 + n) + 1, threshold
        self.weight = {w: self.idf(w) for forms in templates.values() for f in forms for w in terms(f)}
        self.forms, self.anchors, self.windows, self.at_anchor = [], set(), [], {}
        for name, forms in templates.items():
            for f in forms:
                v = self.vector(Counter(terms(f)))
                self.forms.append((name, v))
                self.windows.append((name, v, len(terms(f))))
                rest = 1.0
                for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
                    if math.sqrt(max(rest, 0)) < threshold:
                        break
                    self.anchors.add(w)
                    self.at_anchor.setdefault(w, []).append(len(self.forms) - 1)
                    rest -= x * x

    def vector(self, tf: Counter) -> dict[str, float]:
        raw = {w: (1 + math.log(c)) * self.weight.get(w, self.other) for w, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()} if norm else {}

    def best(self, words: list[str]) -> tuple[float, str | None]:
        if self.anchors.isdisjoint(words):
            return 0.0, None
        v = self.vector(Counter(words))
        score, name = max((sum(x * v.get(w, 0.0) for w, x in f.items()), name) for name, f in self.forms)
        return score, name

    def slide(self, words: list[str]) -> Iterator[tuple[float, str, int, int]]:
        """score, name, start and end of every window of a template's length that reaches the threshold."""
        starts: dict[int, list[list[int]]] = {}
        for p, w in enumerate(words):
            for k in self.at_anchor.get(w, ()):
                size = self.windows[k][2]
                a, z = max(0, p - size + 1), min(p, len(words) - size)
                if a <= z:
                    spans = starts.setdefault(k, [])
                    if spans and a <= spans[-1][1] + 1:
                        spans[-1][1] = z
                    else:
                        spans.append([a, z])
        for k, spans in starts.items():
            name, form, size = self.windows[k]
            for a, z in spans:
                if sum(form.get(w, 0.0) ** 2 for w in set(words[a : z + size])) < self.threshold**2 - 1e-9:
                    continue  # Cauchy-Schwarz
                tf: Counter = Counter()
                dot = square = 0.0
                for at in range(a, z + size):
                    for w, step in ((words[at], 1), (words[at - size], -1))[: 1 + (at - size >= a)]:
                        x, y = self.weight.get(w, self.other), form.get(w, 0.0)
                        for sign in (-1, 1):
                            if c := tf[w]:
                                t = (1 + math.log(c)) * x
                                dot, square = dot + sign * t * y, square + sign * t * t
                            if sign < 0:
                                tf[w] += step
                    if at >= a + size - 1 and dot >= (self.threshold - 1e-9) * math.sqrt(square):
                        yield min(1.0, dot / math.sqrt(square)), name, at - size + 1, at + 1

    def scan(self, text: str | None) -> tuple[str | None, float, int, float]:
        """License, score and line (-1: the whole text) of the best match, and the share of words in lines or windows that match.

        A match of a license that isn't GENERIC outranks all that are, one that is AMBIGUOUS comes last; a match that is negated
        is none. The line of an SPDX identifier outranks all. See `required` for relatives.
        """
        every, of, met = [], [], []  # words, their lines, matches (score, name, start, end, line)
        spdx = None
        for i, line in enumerate((text or "").split("\n")):
            words = terms(line)
            if spdx is None and (told := _SPDX.search(line)):
                spdx = (told[1], i)
                met.append((1.0, None, len(every), len(every) + len(words), i))
            s, x = self.best(words)
            if s >= self.threshold:
                met.append((s, x, len(every), len(every) + len(words), i))
            every += words
            of += [i] * len(words)
        if every and not self.anchors.isdisjoint(every):
            met += [(s, x, a, z, of[a]) for s, x, a, z in self.slide(every)]
            s, x = self.best(every)
            if s >= self.threshold:
                met.append((s, x, 0, len(every), -1))
        best, name, at, said, whole = (-1, 0.0), None, None, set(), set(every) if met else set()
        for s, x, a, z, line in met:
            if x is None:
                said.update(range(a, z))
                continue
            if _NEGATED.search(" ".join(every[max(0, a - 4) : z])):
                continue
            x = required(x, every[a:z], every[z : z + 8], whole)
            rank = 0 if x == AMBIGUOUS else 1 if x in GENERIC else 2
            said.update(range(a, z))
            if name is None or (rank, s) > (best[0], best[1] + (1e-9 if best[0] == rank else 0)):
                best, name, at = (rank, s), x, line
        share = len(said) / len(every) if every else 0.0
        if spdx:
            return spdx[0], 1.0, spdx[1], share
        return name, round(best[1], 6) if name else 0.0, -2 if at is None else at, share


def detect(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8) -> DataFrame:
    """file_id, path, license, score, line, share of each file's own text; document frequencies are those of all files."""
    templates = templates or TEMPLATES
    vocabulary = frozenset(w for forms in templates.values() for f in forms for w in terms(f))
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for b in batches:
            df[""] += b.num_rows
            for t in b.column(0):
                df.update(vocabulary.intersection(terms(t.as_py())))
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(df), pa.string()), "n": pa.array(list(df.values()), pa.int64())})

    # one row per template term, whatever the input
    df = {r.term: r.n for r in rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = df.pop("", 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, df, n, threshold)
        for b in batches:
            got = list(zip(*(matcher.scan(t.as_py()) for t in b.column(2)))) or [()] * 4
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(got, kinds)]], names=["file_id", "path", "license", "score", "line", "share"])

    return rows.mapInArrow(run, "file_id long, path string, license string, score double, line int, share double")


def license_scan(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.8, file_share: float = 0.5) -> DataFrame:
    """One row per file: file_id, path, license, method, score, from_path.

    method is `file` for a licence file (by name, or at least `file_share` of its words lie in matching lines),
    `header` for another file whose own text matches, `inherited` for one that takes the license of the licence file
    in the nearest directory above it or its own, else `none` with a null license. Of several licence files in a
    directory that of the highest score, then the least path counts; of several licenses in a file the best match
    (in a line, a window over line ends or the whole), then the first line, GENERIC ones last, `ambiguous` behind them: a text
    of a family whose version or kind isn't told. Versions and relatives are told apart by required terms, SPDX lines count as they are, a
    negated match doesn't. Directories are joined by path: each distinct directory is listed with its ancestors, so
    that what grows with a directory's files is one lookup per file. Null and empty texts match nothing, null paths
    lie in the root, repeated rows are each returned, an empty table gives an empty result; other columns than
    file_id, path and text aren't read.
    """
    found = materialise(detect(files, templates, threshold).withColumn("dir", F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*)/[^/]*$", 1)), "licenses")
    licence = F.col("license").isNotNull() & (F.col("license") != AMBIGUOUS) & (F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)) | (F.col("share") >= file_share))
    first = F.min(F.struct((-F.col("score")).alias("low"), F.col("path").alias("from_path"), F.col("license").alias("dir_license")))
    given = found.where(licence).groupBy("dir").agg(first.alias("g")).select(F.col("dir").alias("above"), "g.from_path", "g.dir_license", (-F.col("g.low")).alias("dir_score"))
    dirs = materialise(found.groupBy("dir").agg(F.count(F.lit(1)).alias("n")), "dirs")
    parts = F.split("dir", "/")
    ups = dirs.select("dir", "n", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))).alias("a")).select("dir", "n", "a.depth", "a.above")
    # the root and the top folders lie above most directories: they are dealt out, see attach
    above = materialise(ups.groupBy("above").agg(F.count(F.lit(1)).alias("below")).join(given, "above", "left"), "above")
    near = attach(ups.select("dir", "depth", "above"), above, ["above"], "below", F.col("dir")).where("dir_license is not null").groupBy("dir").agg(F.max_by(F.struct("from_path", "dir_license", "dir_score"), "depth").alias("g"))
    facts = materialise(dirs.join(near, "dir", "left").select("dir", "n", "g.from_path", "g.dir_license", "g.dir_score"), "inherited")
    out = attach(found, facts, ["dir"], "n", F.col("file_id"))
    method = F.when(licence, "file").when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.withColumn("method", method).select("file_id", "path", F.coalesce("license", "dir_license").alias("license"), "method", F.when(F.col("method") == "inherited", F.col("dir_score")).when(F.col("license").isNotNull(), F.col("score")).otherwise(0.0).alias("score"), F.when(F.col("method") == "inherited", F.col("from_path")).when(F.col("license").isNotNull(), F.col("path")).alias("from_path"))

"""Licence scans: Dice coefficient over word bigrams against licence templates.

Lines, paragraphs, the whole text, and runs of a template's length inside it are compared. An
inverted index of the templates' bigrams finds the units that share enough of them; size bounds
leave out templates whose number of bigrams can't reach the wanted coefficient. Templates are
notices of a line or a paragraph and full licence texts.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skylattice.llm.common import LOWER_WORD, TO_LOWER, arrow_map, byte_table, gram_hashes, pieces, span_hashes, text_buffer, whole, word_bounds

# Notices and parts of licences as their publishers word them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


#: Full licence texts, one in each file of the folder, named by it.
FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")


def templates_in(folder: str = FOLDER) -> dict[str, str]:
    """The notices, and the full texts of a folder (-full: the whole text)."""
    found = dict(NOTICES)
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                found[f"{name[:-4]}-full"] = f.read()
    return found


TEMPLATES = templates_in()


class Templates:
    """Bigram sets and lengths of the templates; their bigrams' hashes, and under each the numbers
    of the templates that have it."""

    def __init__(self, templates: dict[str, str], least: float):
        self.names = sorted(templates)
        self.least = least
        self.sets, self.lengths = [], []
        for n in self.names:
            data = TO_LOWER[np.frombuffer(templates[n].encode(), np.uint8)]
            starts, ends, _ = word_bounds(data, np.array([0, len(data)]), LOWER_WORD)
            self.sets.append(set(gram_hashes(span_hashes(data, starts, ends), 2).tolist()))
            self.lengths.append(len(starts))
        self.bigrams = np.array(sorted(set().union(*self.sets)), np.uint64)
        place = {g: i for i, g in enumerate(self.bigrams.tolist())}
        pairs = np.array(sorted((place[g], t) for t, own in enumerate(self.sets) for g in own), np.int64).reshape(-1, 2)
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.bigrams) + 1))
        # fewest shared bigrams with which a template, and any, can be reached
        self.needed = np.array([least / (2 - least) * len(s) if s else np.inf for s in self.sets])
        self.fewest = self.needed.min(initial=np.inf)

    def compared(self, unit: set[int]) -> list[tuple[float, str]]:
        """(Dice, name) of the templates that the unit reaches."""
        low, high = self.least / (2 - self.least), (2 - self.least) / self.least
        found = []
        for name, own in zip(self.names, self.sets):
            if own and low * len(own) <= len(unit) <= high * len(own):
                dice = 2 * len(own & unit) / (len(own) + len(unit))
                if dice >= self.least:
                    found.append((dice, name))
        return found

    def runs(self, grams: np.ndarray, at: np.ndarray, shared: np.ndarray, ends: np.ndarray) -> list[tuple[int, float, str]]:
        """(first bigram, Dice, name) of each text's best run of each template that it reaches.

        at: places in ``bigrams`` of the bigrams numbered ``shared``; ends: past the last bigram of
        the text that each of them is in. A run begins with a shared bigram, has as many words as
        the template or ends with the text; of those that can reach ``least`` the best is the first
        of the highest Dice, by different bigrams: so repeats of a few don't hide a whole match."""
        many = self.first[at + 1] - self.first[at]
        owner = self.owners[np.repeat(self.first[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        place, end = np.repeat(shared, many), np.repeat(ends, many)
        found, before = [], None
        for t in np.unique(owner).tolist():
            own = owner == t
            p, e = place[own], end[own]
            count = np.searchsorted(p, np.minimum(p + self.lengths[t] - 1, e)) - np.arange(len(p))
            good = np.flatnonzero(count >= self.needed[t] - 1e-9)
            if not len(good):
                continue
            if before is None:
                before = _before(grams)
            # of a run from i, bigrams that stood last before i are new to it
            shared_before = before[p]
            for text in np.unique(e[good]).tolist():
                best = (0.0, 0)
                for k in good[e[good] == text].tolist():
                    i = int(p[k])
                    both = int(np.count_nonzero(shared_before[k : k + count[k]] < i))
                    if both < self.needed[t] - 1e-9:
                        continue
                    size = int(np.count_nonzero(before[i : min(i + self.lengths[t] - 1, text)] < i))
                    best = max(best, (2 * both / (len(self.sets[t]) + size), -i))
                if best[0] >= self.least:
                    found.append((-best[1], best[0], self.names[t]))
        return found


def _before(grams: np.ndarray) -> np.ndarray:
    """Where each bigram stood last before its place; -1 where it didn't."""
    order = np.argsort(grams, kind="stable")
    again = np.flatnonzero(grams[order][1:] == grams[order][:-1])
    before = np.full(len(grams), -1, np.int64)
    before[order[again + 1]] = order[again]
    return before


_BLANK = byte_table((0x20, 0x20), (0x09, 0x09), (0x0D, 0x0D))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Byte offsets where units of each kind begin. A paragraph begins after a line of nothing but
    blanks (space, tab, carriage return)."""
    feed = np.flatnonzero(data == 0x0A)
    filled = np.concatenate(([0], np.cumsum(~_BLANK[data] & (data != 0x0A))))
    after = feed[1:][filled[feed[1:]] == filled[feed[:-1] + 1]] + 1
    return {"line": np.union1d(feed + 1, offsets), "paragraph": np.union1d(after, offsets), "text": offsets}


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, dice, licenses and n_lines of every document.

    Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters; two texts
    are compared by their sets of word bigrams. Units are the lines, the paragraphs (between
    lines of blanks), the whole text, and for each template the run of its number of words (or up
    to the text's end) that begins with one of its bigrams and has the highest coefficient, the
    first of such. license is the template of the highest Dice coefficient
    (rounded to 6 digits; of equal ones the first by name), licenses all that a unit reaches
    with ``least`` or more, by name and comma-joined, n_lines the lines that reach one. Where
    nothing is found, and for null and empty texts, license is null, dice 0 and licenses empty.
    Only doc_id and text are read; repeated rows are judged each; an empty table gives an empty
    result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES, least))

    def run(batches):
        known = sent.value
        for batch in batches:
            for part in pieces(batch):
                data, offsets = text_buffer(part.column("text"))
                lower = TO_LOWER[data]
                starts, ends, _ = word_bounds(lower, offsets, LOWER_WORD)
                grams = gram_hashes(span_hashes(lower, starts, ends), 2)
                at = np.minimum(np.searchsorted(known.bigrams, grams), len(known.bigrams) - 1)
                shared = np.concatenate(([0], np.cumsum(known.bigrams[at] == grams)))
                n = part.num_rows
                best, names, lines = [(0.0, None)] * n, [set() for _ in range(n)], np.zeros(n, np.int64)
                for kind, cuts in _cuts(data, offsets).items():
                    first = np.searchsorted(starts, cuts)
                    a, b = first[:-1], np.maximum(first[1:] - 1, first[:-1])  # bigrams of a unit
                    a, b = np.minimum(a, len(grams)), np.minimum(b, len(grams))
                    for i in np.flatnonzero(shared[b] - shared[a] >= known.fewest - 1e-9).tolist():
                        found = known.compared(set(grams[a[i] : b[i]].tolist()))
                        if not found:
                            continue
                        d = int(np.searchsorted(offsets, cuts[i], "right")) - 1
                        names[d].update(name for _, name in found)
                        lines[d] += kind == "line"
                        best[d] = min([best[d], *found], key=lambda x: (-x[0], x[1] or ""))
                first = np.searchsorted(starts, offsets)
                hits = np.flatnonzero(known.bigrams[at] == grams)
                text = np.searchsorted(first, hits, "right") - 1
                inside = hits + 1 < first[text + 1]
                hits, text = hits[inside], text[inside]
                many = np.bincount(text, minlength=n)[text] >= known.fewest - 1e-9
                for i, dice, name in known.runs(grams, at[hits[many]], hits[many], first[text[many] + 1] - 1):
                    d = int(np.searchsorted(first, i, "right")) - 1
                    names[d].add(name)
                    best[d] = min([best[d], (dice, name)], key=lambda x: (-x[0], x[1] or ""))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x[1] for x in best], pa.string()), pa.array([round(x[0], 6) for x in best]), pa.array([",".join(sorted(x)) for x in names], pa.string()), pa.array(lines)],
                    ["doc_id", "license", "dice", "licenses", "n_lines"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", whole()), run, f"doc_id {kind}, license string, dice double, licenses string, n_lines long")


def oracle(templates: dict[str, str] | None = None, least: float = 0.8) -> str:
    """DuckDB SQL for the same rows."""
    values = ", ".join("('%s', '%s')" % (n, t.replace("'", "''")) for n, t in sorted((templates or TEMPLATES).items()))
    low = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low % 'u'}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    all_grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    grams = f"list_distinct({all_grams})"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        units AS (SELECT r, 'line' AS kind, unnest(string_split(text, chr(10))) AS u FROM d
                  UNION ALL SELECT r, 'paragraph', unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n([ \\t\\r]*\\n)*')) FROM d
                  UNION ALL SELECT r, 'text', text FROM d),
        ug AS (SELECT id, r, kind, g, len(g) AS na FROM (SELECT row_number() OVER () AS id, r, kind, {grams} AS g FROM (SELECT r, kind, {words} AS w FROM units) x) y WHERE len(g) > 0),
        t AS (SELECT name, nw, g, len(g) AS nb FROM (SELECT name, len(w) AS nw, {grams} AS g FROM (SELECT name, {words} AS w FROM (VALUES {values}) v(name, u)) x) y),
        tg AS (SELECT name, nb, nw, unnest(g) AS b FROM t),
        ub AS (SELECT id, r, kind, na, unnest(g) AS b FROM ug),
        m AS (SELECT id, r, kind, name, 2.0::DOUBLE * count(*) / (na + nb) AS dice FROM ub JOIN tg USING (b) GROUP BY id, r, kind, name, na, nb HAVING 2.0::DOUBLE * count(*) / (na + nb) >= {least}),
        dg AS (SELECT r, {all_grams} AS g FROM (SELECT r, {words} AS w FROM (SELECT r, text AS u FROM d) x) y),
        h AS (SELECT r, name, nb, nw, i FROM (SELECT r, unnest(g) AS b, unnest(range(1, len(g) + 1)) AS i FROM dg) x JOIN tg USING (b)),
        c AS (SELECT *, count(*) OVER (PARTITION BY r, name ORDER BY i RANGE BETWEEN CURRENT ROW AND nw - 2 FOLLOWING) AS c FROM h),
        k AS (SELECT r, name, nb, i, list_distinct(g[i:i + nw - 2]) AS g FROM c JOIN dg USING (r) WHERE c >= {least / (2 - least)!r} * nb - 1e-9),
        w AS (SELECT r, name, 2.0::DOUBLE * count(*) / (na + nb) AS dice FROM (SELECT r, name, nb, i, len(g) AS na, unnest(g) AS b FROM k) x JOIN (SELECT name, b FROM tg) y USING (name, b) GROUP BY r, name, i, na, nb HAVING 2.0::DOUBLE * count(*) / (na + nb) >= {least}),
        every AS (SELECT r, name, dice FROM m UNION ALL SELECT r, name, dice FROM w),
        best AS (SELECT r, name, dice FROM every QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, name) = 1),
        allm AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM every GROUP BY r),
        ln AS (SELECT r, count(DISTINCT id) AS n_lines FROM m WHERE kind = 'line' GROUP BY r)
        SELECT doc_id, name AS license, round(coalesce(dice, 0), 6) AS dice, coalesce(licenses, '') AS licenses, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
        FROM d LEFT JOIN best USING (r) LEFT JOIN allm USING (r) LEFT JOIN ln USING (r)"""

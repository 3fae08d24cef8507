"""Licence scans: Dice coefficient over word bigrams of normalised text against templates.

Every line, every paragraph and the whole text of a document is a segment.  A segment of a
distinct bigrams can reach Dice >= t with a template of b only if t / (2 - t) <= a / b <= (2 - t) / t;
other templates are pruned before anything is compared.  Where one segment reaches templates of
several licences (versions of one notice differ in a word), only the nearest licence counts.
What these segments leave is searched by windows within the same size bounds, which begin and end with a
bigram of the template: they find a notice inside a longer line or paragraph.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.arrays import distinct, mix, prefix_hash, runs, slices, span_hash, spread, utf8

#: Texts of public licences, in parts that several of them share; fixed values.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_TEXTS = {"MIT": _MIT, "BSD-2-Clause": f"{_BSD}\n{_BSD_END}", "BSD-3-Clause": f"{_BSD}\n{_BSD_THIRD}\n{_BSD_END}", "ISC": _ISC}
#: Notices of public licences; fixed values.
_NOTICES = {
    "MIT": ("Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}

#: What a short form calls a licence, and the sentences around it.
_CALLED = {
    "MIT": ("the MIT License", "MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "BSD-2-Clause", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "BSD-3-Clause", "the New BSD License"),
    "ISC": ("the ISC License", "ISC"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "EPL 2.0"),
    "Unlicense": ("the Unlicense", "The Unlicense License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "a Creative Commons Zero 1.0 Universal License"),
}
for _short, _long, _versions in (("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",))):
    for _v in _versions:
        _full = _v if "." in _v else f"{_v}.0"
        _CALLED[f"{_short}-{_full}"] = (*(f"the GNU {_long} Public License{x}" for x in (f", version {_v}", f", version {_full}", f" v{_v}", f" v{_full}")), f"the GNU {_short} v{_v}", f"the {_short}v{_v}", f"{_short}v{_v}", f"{_short} {_full}")
for _short, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _CALLED[f"CC-{_short}-{_v}"] = (f"CC {_short} {_v}", f"a CC {_short} {_v} License", f"the CC {_short} {_v} License", *(f"{a} Creative Commons {_long} {_v}{x} License" for a in ("a", "the") for x in (f" {_port}", "")))
_SENTENCES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.")

#: Notices, whole texts and short forms by SPDX name.
TEMPLATES = {k: tuple(dict.fromkeys((*_NOTICES.get(k, ()), *((_TEXTS[k].replace("\n", " "),) if k in _TEXTS else ()), *(x.format(c) for c in _CALLED.get(k, ()) for x in _SENTENCES), f"SPDX-License-Identifier: {k}"))) for k in {**_NOTICES, **_CALLED}}

#: Bytes of a normalised word: ASCII letters and digits, and all of UTF-8's multi-byte characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and kind (0 line, 1 paragraph of several lines, 2 whole text of several paragraphs)."""
    n_text = len(offs) - 1
    s0, e0, d0 = runs(data != 10, offs)
    blank = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_WORD[data], out=blank[1:])
    full = blank[e0] > blank[s0]
    s0, e0, d0 = s0[full], e0[full], d0[full]
    if not len(s0):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    newline = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=newline[1:])
    first = np.ones(len(s0), bool)  # a new paragraph after an empty line
    first[1:] = (d0[1:] != d0[:-1]) | (newline[s0[1:]] - newline[e0[:-1]] > 1)
    p = np.flatnonzero(first)
    last = np.append(p[1:], len(s0)) - 1
    many = last > p
    p, last = p[many], last[many]
    t = np.flatnonzero(np.bincount(d0[first], minlength=n_text) > 1)
    return np.concatenate([s0, s0[p], offs[t]]), np.concatenate([e0, e0[last], offs[t + 1]]), np.concatenate([d0, d0[p], t]), np.repeat([0, 1, 2], [len(s0), len(p), len(t)])


def _bigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start of the first word and end of the second, for the word bigrams of each text."""
    s, e, d = runs(_WORD[data], offs)
    h = span_hash(prefix_hash(data, lower=True), s, e)
    same = np.flatnonzero(d[1:] == d[:-1])
    return mix(mix(h[same]) + h[same + 1]), s[same], e[same + 1]


class Templates:
    def __init__(self, texts: Mapping[str, tuple[str, ...]]):
        self.names = [k for k, v in texts.items() for _ in v]
        data, offs = utf8(pa.array([t for v in texts.values() for t in v], pa.large_string()))
        h, s, _ = _bigrams(data, offs)
        self.h, bounds = distinct(h, np.searchsorted(offs, s, "right") - 1, len(self.names))
        self.size = np.diff(bounds)
        self.sets = [self.h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        self.of = np.repeat(np.arange(len(self.names)), self.size)
        order = np.argsort(self.h, kind="stable")
        self.h, self.of = self.h[order], self.of[order]


#: Windows whose bigrams are looked at together, and how many times the bigrams of the largest set that can match a window may have.
CELLS, REPEATS = 1 << 21, 2


def _before(h: np.ndarray) -> np.ndarray:
    """Place of the last equal value before each; -1 if there is none."""
    order = np.argsort(h, kind="stable")
    out = np.full(len(h), -1)
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


def _windows(h: np.ndarray, free: np.ndarray, t: Templates, threshold: float) -> list[tuple[float, int, int, int]]:
    """(dice, first, last, template): the best window of each template that reaches threshold, over bigrams h of one text that are free.

    A window begins and ends with a bigram of its template and holds no bigram that isn't free; with repeats it has up to
    REPEATS times the bigrams of the largest set that can match.  Its Dice is exact: of equal bigrams in a window the
    first counts.  Ties go to the earliest, then the shortest.  Of windows that overlap, those of the largest Dice stay.
    """
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    at = np.flatnonzero(free & np.isin(h, t.h))
    if not len(at):
        return []
    j = np.searchsorted(t.h, h[at])
    n = np.searchsorted(t.h, h[at], "right") - j
    hit, which = np.repeat(at, n), t.of[spread(j, n)]
    distinct_hits = np.bincount(np.unique(np.stack([which.astype(np.int64), h[hit].view(np.int64)]), axis=1)[0].astype(np.int64), minlength=len(t.size))
    # of a window of a bigrams, threshold * (a + b) / 2 are the template's, and a >= low * b
    found = []
    barrier = np.concatenate([[0], np.cumsum(~free)])
    before = _before(h)
    for k in np.flatnonzero((distinct_hits >= np.ceil(threshold * t.size * (1 + low) / 2 - 1e-9)) & (t.size > 0)).tolist():
        pos, b = hit[which == k], int(t.size[k])
        limit = int(REPEATS * high * b) + 1
        reach = np.searchsorted(pos, pos + limit)
        wide = int((reach - np.arange(len(pos))).max())
        own_before = _before(h[pos])
        best: tuple[float, int, int, int] | None = None
        step = max(1, CELLS // (limit + wide))
        for a in range(0, len(pos), step):
            i = np.arange(a, min(a + step, len(pos)))[:, None]
            m = np.minimum(i + np.arange(wide), len(pos) - 1)
            ends = pos[m]
            both = np.cumsum(own_before[m] < i, axis=1)
            inside = np.minimum(pos[i] + np.arange(limit), len(h) - 1)
            size = np.take_along_axis(np.cumsum(before[inside] < pos[i], axis=1), np.minimum(ends - pos[i], limit - 1), 1)
            bad = (i + np.arange(wide) >= reach[i]) | (barrier[ends + 1] != barrier[pos[i]])
            dice = np.where(bad, 0, 2 * both / (size + b))
            to = dice.argmax(1)
            top = dice[np.arange(len(i)), to]
            x = int(top.argmax())
            if top[x] >= threshold - 1e-12:
                now = (-float(top[x]), int(pos[i[x, 0]]), int(ends[x, to[x]]), k)
                best = now if best is None else min(best, now)
        if best:
            found.append(best)
    kept: list[tuple[float, int, int, int]] = []
    for w in sorted(found):
        if not any(x[0] < w[0] and x[1] <= w[2] and w[1] <= x[2] for x in kept):
            kept.append(w)
    return [(-d, a, b, k) for d, a, b, k in kept]


def license_scans(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, dice, segment_start, segment_end (UTF-8 byte offsets): the best segment for each licence found.

    Words are runs of ASCII letters and digits or non-ASCII characters, A-Z lower-cased.  A null or
    empty text, or one of fewer than two words, gives no row.  Ties go to the earliest, then the shortest segment.
    A window counts where no segment reaches threshold, and of overlapping windows those of the largest Dice.
    A segment counts for the licence of its nearest template; where several licences are equally near, for each.
    Rows with a repeated id are scanned one by one.  Templates are a parameter held in memory.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    t = Templates(templates)
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, 1):
            h, at, to = _bigrams(data, offs)
            known = np.isin(h, t.h)
            s, e, d, _ = _segments(data, offs)
            # bigrams of a segment are those that start in it and end in it; starts and ends both grow
            first, last = np.searchsorted(at, s), np.searchsorted(to, e, "right")
            hits = np.concatenate([[0], np.cumsum(known)])
            # n distinct bigrams at most, so the Dice of a segment is bounded by its hits before sorting it
            some = np.flatnonzero((last > first) & (hits[np.maximum(last, first)] - hits[first] > 0))
            found: dict[tuple[int, int], tuple[float, int, int]] = {}
            free = np.ones(len(h), bool)
            for i in some.tolist():
                a = np.unique(h[first[i] : last[i]])
                size = len(a)
                fits = (size >= low * t.size) & (size <= high * t.size)
                if not fits.any():
                    continue
                j = np.searchsorted(t.h, a)
                n = np.searchsorted(t.h, a, "right") - j
                both = np.bincount(t.of[spread(j, n)], minlength=len(t.size))
                dice = np.where(fits, 2 * both / (size + t.size), 0)
                if dice.max() >= threshold:
                    free[first[i] : last[i]] = False
                for k in np.flatnonzero((dice >= threshold) & (dice == dice.max())).tolist():
                    key = (int(d[i]), k)
                    best = (-float(dice[k]), int(s[i] - offs[d[i]]), int(e[i] - offs[d[i]]))
                    found[key] = min(found.get(key, best), best)
            row_of = np.searchsorted(offs, at, "right") - 1
            for row in np.unique(row_of[known & free]).tolist():
                lo, hi = np.searchsorted(row_of, row), np.searchsorted(row_of, row, "right")
                for dice, a, b, k in _windows(h[lo:hi], free[lo:hi], t, threshold):
                    best = (-dice, int(at[lo + a] - offs[row]), int(to[lo + b] - offs[row]))
                    found[row, k] = min(found.get((row, k), best), best)
            by_name: dict[tuple[int, str], tuple[float, int, int]] = {}
            for (row, k), best in found.items():
                key = (row, t.names[k])
                by_name[key] = min(by_name.get(key, best), best)
            ids = rows.column(0).take(pa.array([r for r, _ in by_name], pa.int64()))
            v = list(by_name.values())
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n in by_name], pa.string()), pa.array([-x[0] for x in v], pa.float64()), pa.array([x[1] for x in v], pa.int64()), pa.array([x[2] for x in v], pa.int64())], ["id", "license", "dice", "segment_start", "segment_end"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(scan, f"id {id_type}, license string, dice double, segment_start long, segment_end long").withColumnRenamed("id", id_col)

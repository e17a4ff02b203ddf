"""Licences by sparse TF-IDF cosine to templates, inherited from the nearest ancestor directory.

Templates are notices, usual headers, and whole licence texts (of the long ones, their heads). Term weights are counts
times the inverse document frequency over the templates; words that no template has weigh as the rarest do. In a text
that speaks of licensing, the run of words nearest to a template decides, wherever it stands and whatever stands around
it, over line ends too, if its cosine is at least ``MIN_RUN_COSINE`` and it has most of the template's words. Without
such a run, notices as a whole count: every line that speaks of licensing is one, neighbouring ones are one block. A text may
hold several licences: runs that share no word, and each part of an SPDX expression or of a list, written as a header of
its own and compared alike. A file without a licence takes that of the nearest directory above it that holds a licence file; directories and their
ancestors meet in joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import materialise, ship

MIN_COSINE = 0.55
MIN_RUN_COSINE = 0.85
#: Share of a template's words that a run must have; a run is at most RUN times as long as its template.
MIN_WORDS = 0.8
RUN = 2
#: Licences that are told apart, with the names by which notices call them.
_NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GNU GPL v3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GNU GPL v2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"),
    "MPL-1.1": ("Mozilla Public License, version 1.1",),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "Eclipse Public License v1.0", "Eclipse Public License 1.0"),
    "EUPL-1.2": ("European Union Public Licence, version 1.2", "EUPL, Version 1.2"),
    "CDDL-1.0": ("Common Development and Distribution License, version 1.0", "Common Development and Distribution License 1.0"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, version 2.0"),
    "ISC": ("ISC License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
} | {
    f"CC-{code}-4.0": (f"CC {code} 4.0", f"CC-{code}-4.0", f"Creative Commons {words} 4.0 International License")
    for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution ShareAlike"), ("BY-ND", "Attribution NoDerivatives"), ("BY-NC", "Attribution NonCommercial"),
                        ("BY-NC-SA", "Attribution NonCommercial ShareAlike"), ("BY-NC-ND", "Attribution NonCommercial NoDerivatives"))
}
#: Lines by which a licence's text or its usual header is known, and notices of another form.
_LINES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0", "Licensed under Apache 2.0", "License: Apache-2.0"),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT", "MIT License", "License: MIT"),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal"),
    "BSD-3-Clause": ("nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "ISC": ("Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted",),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
} | {
    f"{short}-{v}": (
        f"under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version {v.removesuffix('.0')} of the License",
        f"under the terms of the GNU {name} Public License as published by the Free Software Foundation, version {v.removesuffix('.0')} of the License",
        f"GNU {name.upper()} PUBLIC LICENSE Version {v.removesuffix('.0')}, {date}",
        f"SPDX-License-Identifier: {short}-{v}-only",
        f"SPDX-License-Identifier: {short}-{v}-or-later",
    )
    for short, v, name, date in (("GPL", "3.0", "General", "29 June 2007"), ("GPL", "2.0", "General", "June 1991"), ("LGPL", "3.0", "Lesser General", "29 June 2007"),
                                 ("LGPL", "2.1", "Lesser General", "February 1999"), ("AGPL", "3.0", "Affero General", "19 November 2007"))
}


# Licence texts, as published by their stewards, without names and years.
_DISCLAIMED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_REDISTRIBUTED = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
_NOT_ENDORSED = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_WHOLE: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_REDISTRIBUTED} {_DISCLAIMED}",
    "BSD-3-Clause": f"{_REDISTRIBUTED} {_NOT_ENDORSED} {_DISCLAIMED}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You
can obtain one at http://mozilla.org/MPL/2.0/.""",
} | {
    licence: f"{title} {date} Copyright (C) Free Software Foundation, Inc. {_VERBATIM} {preamble}"
    for licence, title, date, preamble in (
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007", "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
        ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007", "Preamble The GNU Affero General Public License is a free, copyleft license for software and other "
         "kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
        ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 "
         "of the GNU General Public License, supplemented by the additional permissions listed below."),
        ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991", "Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, "
         "the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
        ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999", "Preamble The licenses for most software are designed to take away your freedom to share and change it. "
         "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    )
}
# End of fixed values.


def _notices(licence: str) -> tuple[str, ...]:
    names, lines = _NAMES.get(licence, ()), _LINES.get(licence, ())
    said = [f"{how} {'' if n.startswith(('CC', 'GPLv', 'LGPLv', 'AGPLv')) else 'the '}{n}" for n in names for how in ("Licensed under", "Released under")]
    spdx = [] if any("SPDX" in x for x in lines) else [f"SPDX-License-Identifier: {licence}"]
    return tuple(dict.fromkeys([*said, *lines, *spdx, *([_WHOLE[licence]] if licence in _WHOLE else [])]))


TEMPLATES: dict[str, tuple[str, ...]] = {licence: _notices(licence) for licence in sorted(_NAMES.keys() | _LINES.keys() | _WHOLE.keys())}
_CUE = re.compile(r"licen[sc]e|spdx|copyright|public domain|all rights reserved|hereby granted|redistribution and use|provided .{0,8}as.is", re.I)
_TERM = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
#: A negation and what may stand between it and the licence: up to three words of its sentence.
_NEGATION = re.compile(r"(?:\b(?:not|never|no longer|cannot|neither)|n't)(?:[\s,]+[^\s.;:!?]+){0,3}[\s\"'(]*$")
NEGATION_CHARS = 80
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*[A-Za-z0-9.+)])", re.I)
#: The rest of a sentence that says by which licences something goes; a full stop inside a word (2.0) does not end it.
_STATEMENT = re.compile(r"\b(?:licen[sc]ed|released|available|distributed|offered) under((?:[^\n.;]|\.(?=\w))*)|\blicen[sc]es?:((?:[^\n.;]|\.(?=\w))*)", re.I)
_ITEM = re.compile(r"\b(?:and/or|and|or)\b|/|,(?!\s*v(?:ersion|\.)?\s*[0-9])", re.I)
_FILLER = re.compile(r"^(?:.*\bunder\b)?\s*(?:(?:the|terms|conditions|of|either|both|a|dual|following|under)\s+)*", re.I | re.S)
_GNU = re.compile(r"\b(?:gnu\s+)?([al]?)gpl[ -]?(?:v|version\s)?\s?([23](?:\.1)?)(?:\.0)?(?:\+|-only|-or-later)?(?![\w.]*\d)", re.I)
#: Licences whose texts include or take up others'.
_INCLUDES = {"BSD-3-Clause": {"BSD-2-Clause"}, "LGPL-3.0": {"GPL-3.0"}, "AGPL-3.0": {"GPL-3.0"}, "LGPL-2.1": {"GPL-2.0"}}
_LICENCE = re.compile("licen[sc]e", re.I)
#: An SPDX identifier of several parts.
_ID = re.compile(r"[A-Za-z]+(?:-[A-Za-z0-9.]+)+")
_LICENSE_FILE = r"(?i)^(un)?licen[sc]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


class Templates:
    """Unit vectors of the templates."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        bags = [(name, terms(t)) for name, ts in templates.items() for t in ts]
        df = Counter(w for _, bag in bags for w in bag)
        self.idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
        self.rare = math.log(1 + len(bags)) + 1
        self.vectors = [(name, self._unit(bag)) for name, bag in bags]
        self.bags = [bag for _, bag in bags]
        #: Per term the templates of which a near enough run must hold it or another of their few heaviest terms.
        self.anchors: dict[str, list[int]] = {}
        for k, (_, v) in enumerate(self.vectors):
            left = 1.0
            for w in sorted(v, key=lambda w: (-v[w], w)):
                if left < MIN_RUN_COSINE**2:
                    break
                self.anchors.setdefault(w, []).append(k)
                left -= v[w] ** 2

    def _unit(self, bag: Counter) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.rare) for w, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    def best(self, text: str) -> tuple[float, str]:
        """(cosine, name) of the nearest template; the first by name among equals. Templates of two words only count as
        runs: one word of theirs (German ``mit``) would bring a foreign line near.
        """
        v = self._unit(terms(text))
        scored = [(round(sum(x * t.get(w, 0.0) for w, x in v.items()), 9), name) for (name, t), bag in zip(self.vectors, self.bags, strict=True) if bag.total() > 2]
        return min(scored, key=lambda s: (-s[0], s[1]), default=(0.0, ""))

    def best_run(self, text: str) -> tuple[float, str] | None:
        """(cosine, name) of the run of words nearest to a template; the longest template, then the first by name among equals."""
        found = min(((-c, -self.bags[k].total(), self.vectors[k][0]) for c, k, _, _ in self._near(_TERM.findall(text.lower()))), default=None)
        return found and (-found[0], found[2])

    def runs(self, text: str) -> tuple[list[tuple[float, str]], bool]:
        """(cosine, name) of each licence by its nearest run, nearest first, and whether a licence is named only to be denied.

        A run counts if it shares no word with a nearer one. A run after a negation in its sentence denies its licence there.
        """
        text = text.lower()
        places = [m.span() for m in _TERM.finditer(text)]
        taken, found, denied = np.zeros(len(places), bool), {}, False
        ranked = sorted((-c, -self.bags[k].total(), self.vectors[k][0], first, last) for c, k, first, last in self._near([text[a:b] for a, b in places]))
        for c, _, name, first, last in ranked:
            if taken[first:last].any():
                continue
            taken[first:last] = True
            at = places[first][0]
            if _NEGATION.search(text[max(0, at - NEGATION_CHARS) : at]):
                denied = True
            else:
                found.setdefault(name, -c)
        return [(c, name) for name, c in found.items()], denied

    def _near(self, words: list[str]) -> Iterator[tuple[float, int, int, int]]:
        """(cosine, template, first word, end) of the best near enough run from each word."""
        at: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            for k in self.anchors.get(word, ()):
                at.setdefault(k, []).append(i)
        for k, places in at.items():
            bag, v = self.bags[k], self.vectors[k][1]
            seen: dict[tuple[str, ...], list] = {}  # the same notice again and again
            for first, last in _stretches(places, RUN * bag.total(), len(words)):
                near = tuple(words[first:last])
                if len(near) < MIN_WORDS * bag.total() or sum(v[w] ** 2 for w in bag.keys() & set(near)) < MIN_RUN_COSINE**2 - 1e-9:
                    continue
                if near not in seen:
                    seen[near] = self._runs(near, k)
                for c, i, j in seen[near]:
                    yield c, k, first + i, first + j

    def _runs(self, near: tuple[str, ...], k: int) -> list[tuple[float, int, int]]:
        """(cosine, first word, end) of the best run from each word: one that begins and ends with words of the template, has
        enough of them, is not too long and is near enough.

        A near enough run holds an anchor, so runs without one do no harm.
        """
        bag, v = self.bags[k], self.vectors[k][1]
        length, out = bag.total(), []
        code: dict[str, int] = {}
        w = np.array([code.setdefault(x, len(code)) for x in near])
        weight, part = np.array([self.idf.get(x, self.rare) for x in code]), np.array([v.get(x, 0.0) for x in code])
        wanted = np.array([bag.get(x, 0) for x in code])
        before = np.zeros(len(code), np.int64)  # occurrences of each word before the run
        nth = np.zeros(len(near), np.int64)
        for i, x in enumerate(w.tolist()):
            nth[i], before[x] = before[x], before[x] + 1
        before[:] = 0
        inside, dots, squares, least = wanted[w] > 0, weight[w] * part[w], weight[w] ** 2, MIN_WORDS * length
        for i, x in enumerate(w.tolist()):
            if inside[i]:
                run = w[i : i + RUN * length]
                n = nth[i : i + len(run)] - before[run]
                has = np.cumsum(n < wanted[run])
                if has[-1] >= least:
                    c = np.cumsum(dots[i : i + len(run)]) / np.sqrt(np.cumsum(squares[i : i + len(run)] * (2 * n + 1)))
                    c[(has < least) | ~inside[i : i + len(run)]] = 0.0
                    j = int(c.argmax())
                    if (best := round(float(c[j]), 9)) >= MIN_RUN_COSINE:
                        out.append((best, i, i + j + 1))
            before[x] += 1
        return out


def _stretches(places: list[int], reach: int, n: int) -> Iterator[tuple[int, int]]:
    """The words at most ``reach`` from one of the places, overlapping ones as one, so that every run is seen whole and once."""
    first = last = None
    for p in places:
        if last is not None and p - reach + 1 <= last:
            last = min(n, p + reach)
            continue
        if last is not None:
            yield first, last
        first, last = max(0, p - reach + 1), min(n, p + reach)
    if last is not None:
        yield first, last


def blocks(text: str) -> list[str]:
    """Each notice line, and each run of two and more neighbouring ones as a whole."""
    if not _CUE.search(text):
        return []
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        if _CUE.search(line):
            run.append(line)
        elif run:
            out += run + (["\n".join(run)] if len(run) > 1 else [])
            run = []
    return out


def expressions(text: str) -> list[str]:
    """The SPDX expressions of a text, in order, each once, with single blanks."""
    return list(dict.fromkeys(" ".join(m[1].split()) for m in _EXPRESSION.finditer(text)))


def _headers(expression: str) -> list[str]:
    """A header for each licence of an SPDX expression; exceptions are left out, older forms are written as today's."""
    out, words = [], expression.replace("(", " ").replace(")", " ").split()
    for before, w in zip(["", *words], words, strict=False):
        if w.upper() not in ("AND", "OR", "WITH") and before.upper() != "WITH":
            if re.fullmatch(r"[AL]?GPL-[0-9.]+\+?", w, re.I):
                w = w[:-1] + "-or-later" if w.endswith("+") else f"{w}-only"
            out.append(f"SPDX-License-Identifier: {w}")
    return out


def _said(text: str) -> list[str]:
    """A notice for each licence that a sentence lists."""
    out = []
    for m in _STATEMENT.finditer(text):
        if _NEGATION.search(text[max(0, m.start() - NEGATION_CHARS) : m.start()].lower()):
            continue
        for item in _ITEM.split(m[1] if m[1] is not None else m[2]):
            if item := _FILLER.sub("", item).strip():
                if _ID.fullmatch(item):
                    out += _headers(item)
                    continue
                item = _GNU.sub(lambda g: f"GNU {({'a': 'Affero ', 'l': 'Lesser '}).get(g[1].lower(), '')}General Public License version {g[2]}", item)
                out.append(f"Licensed under the {item}" + ("" if _LICENCE.search(item) else " License"))
    return list(dict.fromkeys(out))


def detect(text: str | None, templates: Templates, least: float = MIN_COSINE) -> tuple[str | None, float, int, list[str], str | None]:
    """(licence or None, cosine of its run or else the best of a block, number of notice blocks, all licences by name, SPDX
    expression or None).

    The licence is that of the nearest run. All licences are those of runs that share no word, of the parts of SPDX
    expressions and of lists ("under MIT and Apache 2.0"), but for those that another one's text includes. A licence that is
    only denied ("not under the MIT License") is none. Several expressions are joined by AND.
    """
    text = text or ""
    found = blocks(text)
    if not found:
        return None, 0.0, 0, [], None
    near, denied = templates.runs(text)
    stated = expressions(text)
    listed = [run for part in [*(h for e in stated for h in _headers(e)), *_said(text)] if (run := templates.best_run(part))]
    spdx = " AND ".join(f"({e})" if len(stated) > 1 and " " in e else e for e in stated) or None
    if near or listed:
        score, name = near[0] if near else min(listed, key=lambda r: (-r[0], r[1]))
        names = {n for _, n in near} | {n for _, n in listed}
        names -= {i for n in names for i in _INCLUDES.get(n, ())} - {n for _, n in listed} - {name}
        return name, score, len(found), sorted(names), spdx
    score, name = min((templates.best(b) for b in found), key=lambda s: (-s[0], s[1]), default=(0.0, None))
    named = name if score >= least and not denied else None
    return named, score, len(found), [named] if named else [], spdx


def _batches(batches: Iterator[pa.RecordBatch], templates: Templates, least: float) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.string())
    for b in batches:
        rows = [detect(t, templates, least) for t in b.column(b.num_columns - 1).to_pylist()]
        arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*b.schema.names[:-1], "own", "cosine", "n_notices", "all", "expression"])


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _ancestors(path: Column) -> Column:
    """The directory itself and all above it, the root as the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.when(path == "", F.lit(0)).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = MIN_COSINE, licence_file: Column | None = None) -> DataFrame:
    """files: id, path, text. One row per row: id, path, own (the nearest licence), cosine, n_notices, license (own or
    inherited), inherited_from (a directory, null for own or none), licenses (all, by name, own or inherited; empty for
    none), expression (SPDX, as the text itself has it, or null).

    ``licence_file``: a condition on files, whose licences their directories pass on; by default the usual names of such
    files. Null and empty texts hold no notice and inherit; a null path is a file of the root. Of several licence files
    in a directory the one with the smallest path, then licence, counts. Repeated rows stay rows; an empty table gives
    none; other columns are ignored, whatever their names. Texts are read once: what they hold is written to the shared
    folder. Inheritance is settled once a directory, so a directory with very many files costs a partial aggregate and a
    join that can be split.
    """
    ship(files.sparkSession)
    held = Templates(templates)
    path = F.regexp_replace(F.coalesce("path", F.lit("")), "^/+", "")
    flag = F.element_at(F.split(path, "/"), -1).rlike(_LICENSE_FILE) if licence_file is None else licence_file
    kind = files.schema["id"].dataType.simpleString()
    src = files.select("id", path.alias("path"), flag.alias("flag"), "text")
    found = src.mapInArrow(lambda it: _batches(it, held, least), f"id {kind}, path string, flag boolean, own string, cosine double, n_notices bigint, all array<string>, expression string")
    found = materialise(found.withColumn("dir", directory(F.col("path"))), "licences")
    of_dir = found.filter("flag AND own IS NOT NULL").groupBy("dir").agg(F.min(F.struct("path", "own", "all")).alias("given")).withColumnRenamed("dir", "above")
    dirs = found.filter("own IS NULL").select("dir").distinct()
    near = (
        dirs.select("dir", F.explode(_ancestors(F.col("dir"))).alias("above"))
        .join(of_dir, "above")
        .groupBy("dir")
        .agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("near"))
    )
    # Both sides are exchanged for the reversed directory, so adaptive execution can split a very large one.
    turned = near.select(F.reverse("dir").alias("_turned"), "near")
    out = found.withColumn("_turned", F.reverse("dir")).join(turned, "_turned", "left")
    takes = F.col("own").isNull()
    return out.select(
        "id", "path", "own", "cosine", "n_notices", F.when(takes, F.col("near.given.own")).otherwise(F.col("own")).alias("license"),
        F.when(takes, F.col("near.above")).alias("inherited_from"),
        F.when(takes, F.coalesce("near.given.all", F.array().cast("array<string>"))).otherwise(F.col("all")).alias("licenses"), "expression",
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """``documents`` as files, a directory per source and hundred ids; one that holds a licence, by its own cosine, is a
    licence file of its directory. One row per row, with doc_id for id; null sources and ids have places of their own.
    """
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"))
    path = F.concat_ws("/", folder, F.concat(F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return scan(files, licence_file=F.lit(True)).withColumnRenamed("id", "doc_id")

"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a text are its lines, its blocks of lines without a blank one between them, and the whole text, so that a
notice is found among prose and a wrapped licence is found as one. A unit is normalised (lower case, words of letters
and digits, `licence` as `license`, `v3` and `3.0` as `3`, copyright lines left out) and becomes the set of its word
bigrams. Dice(A, B) = 2 |A and B| / (|A| + |B|) can reach THRESHOLD only if |A| is between t / (2 - t) and (2 - t) / t
of |B|: size bounds prune the templates before an inverted index from bigrams to templates counts what is shared.

A licence inside a longer unit (a notice within a line, a whole licence in a file of other text, on one line or many) is
found by windows: a template that shares enough bigrams with the text is compared with each window that begins at a
shared bigram, is at most as long as the template and ends at a shared one. Of windows that overlap the one that shares
most counts, then the nearest, then the first, and only if by this order it is before the units that it overlaps. The long licences have their openings as templates, so that
their whole texts are told by their first paragraphs.

The templates are fixed, so nothing is shuffled and a lost task is simply run again; whole texts are scanned, line by
line, and memory follows the longest text.

Defined results: a text that is null, empty or without a match has a null license, dice 0 and 0 hits; of equal values
the earliest unit counts, then the template's name; repeated rows are scanned each; columns other than the id and the
text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

THRESHOLD = 0.8

#: Licences (fixed values): id -> names in short notices, and whether use is free for any purpose.
NAMES = {
    "MIT": (["MIT License"], True),
    "Apache-2.0": (["Apache License Version 2.0", "Apache License 2.0"], True),
    "BSD-2-Clause": (["BSD 2-Clause License", "Simplified BSD License"], True),
    "BSD-3-Clause": (["BSD 3-Clause License", "New BSD License"], True),
    "ISC": (["ISC License"], True),
    "MPL-2.0": (["Mozilla Public License Version 2.0"], False),
    "GPL-2.0": (["GNU General Public License Version 2"], False),
    "GPL-3.0": (["GNU General Public License Version 3"], False),
    "LGPL-2.1": (["GNU Lesser General Public License Version 2.1"], False),
    "LGPL-3.0": (["GNU Lesser General Public License Version 3"], False),
    "AGPL-3.0": (["GNU Affero General Public License Version 3"], False),
    "CC0-1.0": (["CC0 1.0", "Creative Commons Zero 1.0"], True),
    "CC-BY-4.0": (["CC BY 4.0", "Creative Commons Attribution 4.0 International License"], True),
    "CC-BY-SA-4.0": (["CC BY-SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International License"], False),
    "CC-BY-NC-4.0": (["CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License"], False),
    "CC-BY-ND-4.0": (["CC BY-ND 4.0", "Creative Commons Attribution NoDerivatives 4.0 International License"], False),
}
#: Sentences around a name (fixed values).
NOTICES = (
    "Licensed under {}",
    "Licensed under the {}",
    "Released under {}",
    "Released under the {}",
    "This work is licensed under {}",
    "This work is licensed under the {}",
    "This work is licensed under a {}",
    "Distributed under the terms of the {}",
)
#: Longer texts (fixed values).
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Parts of longer texts (fixed values).
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
_GNU_REST = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details. You should have received a copy of the GNU {2} along with this {0}{5}"
_GNU_ENDS = ("", ". If not, see https://www.gnu.org/licenses/.", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")
_GNU_KINDS = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}
_CC_KINDS = {"CC-BY-4.0": ("Attribution", "by"), "CC-BY-SA-4.0": ("Attribution-ShareAlike", "by-sa"), "CC-BY-NC-4.0": ("Attribution-NonCommercial", "by-nc"), "CC-BY-ND-4.0": ("Attribution-NoDerivatives", "by-nd")}
_CC = "This work is licensed under {0} Creative Commons {1} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{2}/4.0/"
#: Further texts of a licence: with its disclaimer, with all paragraphs of its notice.
MORE_TEXTS = [
    ("MIT", f"{TEXTS['MIT']} {_AS_IS}"),
    ("MIT", f"MIT License {TEXTS['MIT']} {_AS_IS}"),
    ("ISC", f"{TEXTS['ISC']} {_ISC_AS_IS}"),
    ("ISC", f"ISC License {TEXTS['ISC']} {_ISC_AS_IS}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    *((key, text.format(what, mark, name, mark, version, end)) for key, (name, version) in _GNU_KINDS.items() for what in ("program", "library") for mark in ":;" for text, ends in ((_GNU, _GNU_ENDS[:1]), (f"{_GNU} {_GNU_REST}", _GNU_ENDS)) for end in ends),
    *((key, _CC.format(article, name, mark) + end) for key, (name, mark) in _CC_KINDS.items() for article in ("the", "a") for end in ("", " or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.")),
]

#: How the long licences begin.
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_SHARE = "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public {0} intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."
OPENINGS = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 {_VERBATIM} Preamble {_SHARE.format('License is')}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_VERBATIM} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 {_VERBATIM} [This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.] Preamble {_SHARE.format('Licenses are')}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_VERBATIM} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_VERBATIM} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("CC0-1.0", "CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN \"AS-IS\" BASIS."),
    ("CC0-1.0", "Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\")."),
    *((key, f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License (\"Public License\"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions.") for key, (name, _) in _CC_KINDS.items()),
]

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_DIGIT = re.compile("[0-9]")
#: A line that only tells a copyright: the word with a mark or year, or a mark alone.
_COPYRIGHT = re.compile(r"[\W_]*(copyright[\W_]*(\(c\)|©|[0-9]{4})|\(c\)|©).*", re.IGNORECASE)
_MARKED = re.compile(r"copyright|\(c\)|©", re.IGNORECASE)
#: Ordinary words (fixed values): pairs of these alone never make up enough of a template, see tests/llm/test_license_texts.py.
ORDINARY = frozenset("a all an and any as at be by can for from if in is it may not of on or shall so that the this to under use was with you".split())


def words_of(text: str) -> list[str]:
    """Normalised words."""
    words = _WORD.findall(text.lower().replace("licence", "license"))
    if not _DIGIT.search(text):
        return words
    out = []
    for word in words:
        while word.endswith(".0"):
            word = word[:-2]
        if len(word) > 1 and word[0] == "v" and word[1:].replace(".", "").isdigit():
            out += ["version", word[1:]]
        else:
            out.append(word)
    return out


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


@functools.cache
def templates() -> tuple[list[tuple[str, int, int]], dict[tuple[str, str], list[int]]]:
    """(licence, number of distinct bigrams, of all bigrams) of each template, and the templates that have each bigram."""
    texts = [(key, notice.format(name)) for key, (names, _) in NAMES.items() for name in names for notice in NOTICES]
    texts += [(key, f"SPDX-License-Identifier: {key}") for key in NAMES] + list(TEXTS.items()) + MORE_TEXTS + OPENINGS
    lengths: dict[tuple, int] = {}
    for key, text in texts:
        words = words_of(text)
        own = key, frozenset(bigrams(words))
        lengths[own] = max(len(words) - 1, lengths.get(own, 0))
    sets = sorted(lengths, key=lambda x: (x[0], sorted(x[1])))
    index: dict[tuple[str, str], list[int]] = {}
    for i, (_, own) in enumerate(sets):
        for pair in own:
            index.setdefault(pair, []).append(i)
    return [(own[0], len(own[1]), lengths[own]) for own in sets], index


@functools.cache
def telling() -> frozenset[str]:
    """The words of the templates that aren't ordinary: a unit without one of them is near no template."""
    return frozenset(word for pair in templates()[1] for word in pair) - ORDINARY


def best_match(text: str, threshold: float = THRESHOLD) -> tuple[float, str, int] | None:
    """(dice, licence, shared bigrams) of the nearest template of one unit, if it is near enough."""
    known, index = templates()
    words = words_of(text)
    if telling().isdisjoint(words):
        return None
    pairs = bigrams(words)
    n = len(pairs)
    if not n or threshold * n > max(size for _, size, _ in known) * (2 - threshold) + 1e-9:
        return None
    shared = Counter(i for pair in pairs for i in index.get(pair, ()))
    fits = [(-2 * k / (n + known[i][1]), known[i][0], k) for i, k in shared.items() if threshold * known[i][1] <= (2 - threshold) * n + 1e-9 and threshold * n <= (2 - threshold) * known[i][1] + 1e-9]
    if not fits or -min(fits)[0] < threshold:
        return None
    dice, key, k = min(fits)
    return -dice, key, k


def units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each line with text, each block of several lines, and the whole, with the next of equal ones left out."""
    start, block, last, lines = 0, None, 0, 0
    for line in text.split("\n"):
        end = start + len(line)
        if line.strip():
            yield start, end
            block, last, lines = (start if block is None else block), end, lines + 1
        else:
            if lines > 1:
                yield block, last
            block, lines = None, 0
        start = end + 1
    if lines > 1:
        yield block, last
    if block != 0 or last != len(text):
        yield 0, len(text)


def least_shared(size: int, threshold: float) -> int:
    """How many of a template's bigrams a near text shares at least: with s shared it has s or more, so its coefficient is 2 s / (s + size) at most."""
    return math.ceil(threshold * size / (2 - threshold) - 1e-9)


def hopeful(words: list[str], threshold: float) -> bool:
    """Whether any part of the words can be near a template."""
    if telling().isdisjoint(words):
        return False
    known, index = templates()
    pairs = {pair for pair in zip(words, words[1:], strict=False) if pair in index}
    shared = Counter(i for pair in pairs for i in index[pair])
    return any(n >= least_shared(known[i][1], threshold) for i, n in shared.items())


def placed_words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Normalised words with where each begins and ends; lines that only tell a copyright are left out."""
    words, starts, ends, at = [], [], [], 0
    for line in text.split("\n"):
        if not _COPYRIGHT.fullmatch(line):
            for m in _WORD.finditer(line):
                for word in words_of(m[0]):
                    words.append(word)
                    starts.append(at + m.start())
                    ends.append(at + m.end())
        at += len(line) + 1
    return words, starts, ends


def windows(pairs: list, threshold: float) -> list[tuple[float, str, int, int, int]]:
    """(dice, licence, first, last, shared bigrams) of the windows that don't overlap, those that share most first."""
    known, index = templates()
    at: dict[int, list[int]] = {}
    for place, pair in enumerate(pairs):
        for i in index.get(pair, ()):
            at.setdefault(i, []).append(place)
    # (-shared, least that -dice can be, start, licence, last, template, whether it is -dice itself)
    queue: list[tuple[int, float, int, str, int, int, bool]] = []
    for i, places in at.items():
        key, size, length = known[i]
        least = least_shared(size, threshold)
        if len(places) < least:
            continue
        inside: dict = {}
        stop = 0
        for start in places:
            while stop < len(places) and places[stop] < start + length:
                inside[pairs[places[stop]]] = inside.get(pairs[places[stop]], 0) + 1
                stop += 1
            shared = len(inside)
            if shared >= least:
                queue.append((-shared, -2 * shared / (shared + size), start, key, places[stop - 1], i, False))
            inside[pairs[start]] -= 1
            if not inside[pairs[start]]:
                del inside[pairs[start]]
    heapq.heapify(queue)
    taken, out = bytearray(len(pairs)), []
    while queue:
        shared, value, start, key, last, i, exact = heapq.heappop(queue)
        if 1 in taken[start : last + 1]:
            continue
        if exact:
            taken[start : last + 1] = b"\1" * (last + 1 - start)
            out.append((-value, key, start, last, -shared))
        elif (dice := -2 * shared / (len(set(pairs[start : last + 1])) + known[i][1])) >= threshold:
            heapq.heappush(queue, (shared, -dice, start, key, last, i, True))
    return out


def scan_text(text: str, threshold: float = THRESHOLD) -> list[tuple[float, str, int, int]]:
    """(dice, licence, start, end) of each unit that is near a template, and of each window that tells more."""
    if not hopeful(words_of(text), threshold) and not (_MARKED.search(text) and hopeful(placed_words(text)[0], threshold)):
        return []
    hits = []
    for start, end in units(text):
        own = text[start:end]
        if "\n" in own:
            own = "\n".join(x for x in own.split("\n") if not _COPYRIGHT.fullmatch(x))
        if found := best_match(own, threshold):
            hits.append((*found, start, end))
    words, starts, ends = placed_words(text)
    told = np.zeros(len(words))  # by the units that hold a word: bigrams shared, and the coefficient to decide between equal ones
    for dice, _, n, start, end in hits:
        own = slice(*np.searchsorted(starts, (start, end)))
        told[own] = np.maximum(told[own], n + dice / 2)
    for dice, key, first, last, n in windows(list(zip(words, words[1:], strict=False)), threshold):
        if n + dice / 2 > told[first : last + 2].max():
            hits.append((dice, key, n, starts[first], ends[last + 1]))
    return [(dice, key, start, end) for dice, key, _, start, end in hits]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, license, permissive, dice, span_start, span_end, n_hits): the nearest licence of each text and where it is, in characters."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            found = [scan_text(x, threshold) if x else [] for x in texts]
            best = [min(x, key=lambda h: (-h[0], h[2], h[1])) if x else (0.0, None, None, None) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([b[1] for b in best], pa.string()), pa.array([None if b[1] is None else NAMES[b[1]][1] for b in best], pa.bool_()), pa.array([b[0] for b in best]), pa.array([b[2] for b in best], pa.int64()), pa.array([b[3] for b in best], pa.int64()), pa.array([len(x) for x in found], pa.int64())],
                ["id", "license", "permissive", "dice", "span_start", "span_end", "n_hits"],
            )

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, license string, permissive boolean, dice double, span_start bigint, span_end bigint, n_hits bigint"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the nearest licence of every whole text."""
    return scan(table(spark, sf_dir, "documents"))

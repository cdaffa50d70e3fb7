"""Licence scans by conditional compression.

Runs of neighbouring lines around lines that speak of rights are candidate blocks. A block is read in windows of bounded size that
overlap by half. Each is compressed by itself and with each licence's wordings as a raw zstandard dictionary, under the same
parameters and in lower case; licences that make it smaller lead, and no other is looked for in that window. Leading licences are
confirmed by their wording: the name (with version) or the standard header must stand in the window word for word, over as
many lines as it takes, the first sentence of a text with few words changed; the words that differ from the closest wording are
given. Every licence of a block counts. The BSD licences, whose texts begin alike, are told apart by the clauses that follow.
Confirmed licences are ranked by the reduction of the text around them.
"""

from __future__ import annotations

import bisect
import difflib
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quillsieve.llm.arrow import slices

#: Share of a wording that has to be found.
COVERAGE = 0.6
#: Letters on either side of a name that are compressed with it, and words there that are compared with a wording.
WINDOW = 256
REACH = 12
#: Letters from one window in which licences are looked for to the next; a window has twice as many.
STRIDE = 128
#: Bytes that a licence must save in a window to lead there, by itself or more than half of the licences.
GAIN = 2
#: Plain prose before every window: short windows alone are too small for a compressor to save anything.
FILLER = (
    b"in the morning the old man took his boat down to the river and looked for a quiet place under the trees. he had bread, "
    b"cheese and a bottle of cold tea with him, and by noon he had caught seven fish, three of them too small to keep. "
)
#: Bytes saved from which a first sentence is looked for that does not stand word for word, and its share of changed words.
SENTENCE_GAIN = 40
CHANGED = 0.16
#: A name counts if a line that speaks of rights is at most so many lines away.
NEIGHBOURS = 4
LEVEL = 19
#: Different windows and blocks that a task remembers.
MEMO_BLOCKS = 20_000

# What a line that speaks of rights holds, in lower case.
CUES = (
    "licen",
    "copyright",
    "(c) ",
    "©",
    "rights reserved",
    "public domain",
    "permission is",
    "permission to use",
    "redistribution and use",
    "creative commons",
    "cc by",
    "cc-by",
    "cc0",
    "spdx-",
)
WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def gnu_names(name: str, short: str, version: str) -> tuple[str, ...]:
    """What stands for a licence of the GNU family: names with the version, SPDX ids and the standard headers."""
    dotted = version if "." in version else f"{version}.0"
    header = f"{name} as published by the Free Software Foundation"
    titles = [f"{name}{between}{v}" for v in dict.fromkeys((version, dotted)) for between in (", version ", " v", " ")]
    shorts = [f"{short}{between}{v}" for v in dict.fromkeys((version, dotted)) for between in ("v", " v", " version ")]
    return (
        *titles,
        *shorts,
        *[f"{short}-{dotted}{end}" for end in ("", "-only", "-or-later")],
        f"{header}, either version {version}",
        f"{header}; either version {version}",
        f"{header}, version {version}",
        f"version {version} of the {name}",
    )


# Licences with the names that must stand in a block.
NAMES = {
    "MIT": ("MIT License", "MIT Licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-2.0": gnu_names("GNU General Public License", "GPL", "2"),
    "GPL-3.0": gnu_names("GNU General Public License", "GPL", "3"),
    "LGPL-2.1": gnu_names("GNU Lesser General Public License", "LGPL", "2.1"),
    "LGPL-3.0": gnu_names("GNU Lesser General Public License", "LGPL", "3"),
    "AGPL-3.0": gnu_names("GNU Affero General Public License", "AGPL", "3"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL-2.0"),
    "EPL-2.0": (
        "Eclipse Public License, version 2.0",
        "Eclipse Public License v2.0",
        "Eclipse Public License - v 2.0",
        "Eclipse Public License 2.0",
        "EPL-2.0",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "BSD-4-Clause": ("BSD 4-Clause License", "Original BSD License", "BSD-4-Clause"),
    "ISC": ("ISC License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "BSL-1.0"),
    "Unlicense": ("free and unencumbered software released into the public domain", "The Unlicense"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0", "waived all copyright and related or neighboring rights"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC-BY-NC-SA-4.0"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "CC-BY-NC-ND-4.0"),
    "all-rights-reserved": ("All rights reserved",),
}
# Wordings around a name.
CARRIERS = (
    "{}",
    "Licensed under {}",
    "Licensed under the {}",
    "Released under {}",
    "Released under the {}",
    "This work is licensed under the {}",
    "Distributed under the terms of the {}",
    "SPDX-License-Identifier: {}",
)
SPDX_TAG = "spdx-license-identifier"
SPDX_JOINS = frozenset(("or", "and"))
# Texts of licences that do not name the licence. Their first sentence must stand in a block.
WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met"
)
CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: This "
    "product includes software developed by the organization.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.",
)
SENTENCES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
    ),
    "BSD-2-Clause": (BSD,),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    ),
}
# What follows on the first sentences.
REST = {
    "MIT": (
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        ", provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": ": " + " ".join([*CLAUSES[:2], WARRANTY]),
    "BSD-3-Clause": ": " + " ".join([*CLAUSES[:2], CLAUSES[3], WARRANTY]),
    "BSD-4-Clause": ": " + " ".join([*CLAUSES, WARRANTY]),
}
NONE: dict[int, int] = {}
#: Words after a first sentence in which its text is looked for.
TEXT_WORDS = 400


def parameters() -> zstandard.ZstdCompressionParameters:
    """The same with and without a dictionary."""
    return zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=4096, dict_size=8192, write_checksum=False)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Template:
    """A licence's wordings: as a dictionary for compression, and as words with the words that must be there."""

    def __init__(self, licence: str, names: tuple[str, ...], sentences: tuple[str, ...], rest: str):
        self.licence = licence
        lines = [carrier.format(name) for name in names for carrier in CARRIERS]
        self.wordings = [(words_of(line), words_of(name)) for name in names for line in [c.format(name) for c in CARRIERS]]
        self.texts = [words_of(s + more) for s in sentences or (BSD,) if rest for more in ("", rest)]
        self.sentences = [words_of(s) for s in sentences]
        texts = [s + rest for s in sentences or (BSD,) if rest]
        content = ("\n".join([*texts, *lines])).lower().encode()
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(dict_data=known, compression_params=parameters())

    def size(self, data: bytes) -> int:
        return len(self.compressor.compress(data))


def templates() -> list[Template]:
    return [Template(licence, names, SENTENCES.get(licence, ()), REST.get(licence, "")) for licence, names in NAMES.items()]


def difference(wording: list[str], words: list[str]) -> tuple[float, str]:
    """Share of the wording that is found in order, and what differs in the part of the block that it spans."""
    match = difflib.SequenceMatcher(None, wording, words, autojunk=False)
    blocks = [b for b in match.get_matching_blocks() if b.size]
    if not blocks:
        return 0.0, ""
    found = sum(b.size for b in blocks)
    lost = [w for tag, i, j, _, _ in match.get_opcodes() if tag in ("delete", "replace") for w in wording[i:j]]
    begin, end = blocks[0].b, blocks[-1].b + blocks[-1].size
    new = [
        w
        for tag, _, _, k, m in match.get_opcodes()
        if tag in ("insert", "replace") and k >= begin and m <= end
        for w in words[k:m]
    ]
    return found / len(wording), " ".join([f"-{w}" for w in lost] + [f"+{w}" for w in new])


class Scanner:
    """Finds every template whose name stands in a text, and ranks the templates by what they save around it."""

    def __init__(self, known: list[Template]):
        self.known = known
        self.alone = zstandard.ZstdCompressor(compression_params=parameters())
        self.at = {t.licence: at for at, t in enumerate(known)}
        self.wordings: dict[tuple[int, tuple[str, ...]], list[list[str]]] = {}
        for at, template in enumerate(known):
            for wording, name in template.wordings:
                self.wordings.setdefault((at, tuple(name)), []).append(wording)
        self.sentences = {(at, tuple(s)) for at, t in enumerate(known) for s in t.sentences}
        self.starts: dict[str, list[tuple[int, list[str]]]] = {}
        for at, name in [*self.wordings, *self.sentences]:
            self.starts.setdefault(name[0], []).append((at, list(name)))
        #: ids that may follow the tag; "MIT" and "ISC" alone are names nowhere else
        self.spdx = {name[0]: at for at, name in self.wordings if len(name) == 1}
        self.spdx |= {t.licence.lower(): at for at, t in enumerate(known) if t.licence != "all-rights-reserved"}
        for word, at in self.spdx.items():
            self.wordings.setdefault((at, (word,)), [[SPDX_TAG, word], [word]])
        self.memo: dict[str, list[int]] = {}
        self.near: dict[tuple, tuple | None] = {}

    def savings(self, window: str) -> list[int]:
        """Bytes that each template saves."""
        saved = self.memo.get(window)
        if saved is None:
            if len(self.memo) >= MEMO_BLOCKS:
                self.memo.clear()
            data = FILLER + window.lower().encode("utf-8", "surrogatepass")
            alone = len(self.alone.compress(data))
            saved = self.memo[window] = [alone - t.size(data) for t in self.known]
        return saved

    def leads(self, text: str, cues: list[tuple[int, int]]) -> dict[int, dict[int, int]]:
        """By number of the window, the templates that save enough in it and how much, for all windows near the cues."""
        numbers = {k for a, b in cues for k in range(max(0, a - STRIDE) // STRIDE, max(a, b - 1) // STRIDE + 1)}
        return {k: self.leading(text[k * STRIDE : (k + 2) * STRIDE]) for k in numbers}

    def leading(self, window: str) -> dict[int, int]:
        saved = self.savings(window)
        # a dictionary costs some bytes where it does not help
        usual = min(0, sorted(saved)[len(saved) // 2])
        return {at: gain - usual for at, gain in enumerate(saved) if gain - usual >= GAIN}

    def changed_sentences(self, words: list[str], leads: list[dict[int, int]]) -> list[tuple[int, int, int]]:
        """``first word, word after the last, template`` of first sentences with few words changed, where their template saves much.
        ``leads``: those of the window of each word."""
        found = []
        first = 0
        while first < len(words):
            until = first + 1
            while until < len(words) and leads[until] is leads[first]:
                until += 1
            for at, gain in leads[first].items() if leads[first] else ():
                for sentence in self.known[at].sentences if gain >= SENTENCE_GAIN else ():
                    near = words[first : until + len(sentence) + REACH]
                    match = difflib.SequenceMatcher(None, sentence, near, autojunk=False)
                    blocks = [b for b in match.get_matching_blocks() if b.size > 1 or b.size == len(sentence)]
                    if blocks and blocks[0].b < until - first:
                        begin, end = blocks[0].b, blocks[-1].b + blocks[-1].size
                        same = sum([b.size for b in blocks])
                        if len(sentence) + end - begin - 2 * same <= CHANGED * len(sentence):
                            found.append((first + begin, first + end, at))
            first = until
        return found

    def finds(self, words: list[str], leads: list[dict[int, int]]) -> list[tuple[int, int, int]]:
        """``first word, word after the last, template`` of the names of leading templates; one inside a longer one is a part of
        it. ``leads``: those of the window of each word."""
        found = self.changed_sentences(words, leads)
        for i, word in enumerate(words):
            for at, name in self.starts.get(word, ()) if leads[i] else ():
                if at in leads[i] and words[i : i + len(name)] == name:
                    found.append((i, i + len(name), at))
            if word == SPDX_TAG:
                at = i + 1
                while at < len(words):
                    if self.spdx.get(words[at], -1) in leads[at]:
                        found.append((at, at + 1, self.spdx[words[at]]))
                    at += 3 if words[at + 1 : at + 2] == ["with"] else 1
                    if at >= len(words) or words[at] not in SPDX_JOINS:
                        break
                    at += 1
        kept, reach = [], -1
        for find in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
            if find[1] > reach:
                kept.append(find)
                reach = find[1]
        return kept

    def closest(self, wordings: list[list[str]], near: list[str]) -> tuple[int, float, str] | None:
        """``words found, coverage, differing words`` of the wording with most words found."""
        best = None
        for wording in wordings:
            share, differs = difference(wording, near)
            candidate = round(share * len(wording)), share, differs
            if share >= COVERAGE and (best is None or candidate[:2] > best[:2]):
                best = candidate
        return best

    def ranked(self, at: int, window: str) -> tuple[int, int]:
        """The template's place by the reduction of the window, and the bytes that it saves."""
        saved = self.savings(window)
        return 1 + sum([s > saved[at] for s in saved]), saved[at]

    def text_at(self, at: int, words: list[str]) -> tuple[int, tuple[int, float, str] | None, int]:
        """The licence of a text from its first sentence on, what is found of it, and the words that it takes up."""
        if self.known[at].licence == "BSD-2-Clause":
            spoken = " ".join(words)
            if "advertising materials mentioning features" in spoken:
                at = self.at["BSD-4-Clause"]
            elif "endorse or promote products" in spoken:
                at = self.at["BSD-3-Clause"]
        key = (at, hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest())
        if key not in self.near:
            if len(self.near) >= MEMO_BLOCKS:
                self.near.clear()
            best, size = None, 0
            for text in self.known[at].texts:
                near = words[: len(text) + REACH + len(text) // 5]
                close = self.closest([text], near)
                if close and (best is None or close[:2] > best[:2]):
                    last = [b for b in difflib.SequenceMatcher(None, text, near, autojunk=False).get_matching_blocks() if b.size][-1]
                    best, size = close, last.b + last.size
            self.near[key] = best, size
        best, size = self.near[key]
        return at, best, size

    def scan(self, text: str, cued: bool = True) -> list[tuple[int, int, int, tuple[str, int, int, float, str]]]:
        """``line, begin, end, (licence, rank, saved, coverage, differs)`` of every licence, begin and end as letters.

        One of each licence and line, the longest name and then the closest wording. With ``cued``, only near lines that
        hold a cue.
        """
        places = [(m.start(), m.end()) for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        breaks = [m.start() for m in re.finditer("\n", text)]
        lines = [bisect.bisect_left(breaks, a) for a, _ in places]
        cues = [n for n, line in enumerate(text.split("\n")) if speaks(line.lower())] if cued else []
        ends = [-1, *breaks, len(text)]
        near = [(ends[max(0, n - NEIGHBOURS)] + 1, ends[min(len(ends) - 1, n + NEIGHBOURS + 1)]) for n in cues]
        leads = self.leads(text, near if cued else [(0, len(text))])
        found = self.finds(words, [leads.get(a // STRIDE, NONE) for a, _ in places])
        anchors = [f[0] for f in found if (f[2], tuple(words[f[0] : f[1]])) not in self.wordings]
        best: dict[tuple[int, str], tuple] = {}
        for first, after, at in found:
            line, last = lines[first], lines[after - 1]
            if cued:
                next_cue = bisect.bisect_left(cues, line - NEIGHBOURS)
                if next_cue == len(cues) or cues[next_cue] > last + NEIGHBOURS:
                    continue
            name = tuple(words[first:after])
            if (at, name) not in self.wordings:  # a first sentence
                follows = bisect.bisect_right(anchors, first)
                until = min(first + TEXT_WORDS, anchors[follows] if follows < len(anchors) else len(words))
                at, close, size = self.text_at(at, words[first:until])
                end = first + size
            else:
                low = max(bisect.bisect_left(lines, line), first - REACH)
                high = min(bisect.bisect_right(lines, last), after + REACH)
                close, end = self.closest_name(at, name, tuple(words[low:high])), after
            if close is None:
                continue
            order, key = (after - first, *close[:2]), (line, self.known[at].licence)
            if key not in best or order > best[key][0]:
                best[key] = order, first, after, end, at, close
        out = []
        for (line, licence), (_, first, after, end, at, (_, share, differs)) in best.items():
            a, b = places[first][0], places[max(end, after) - 1][1]
            begin = text.rfind("\n", 0, a) + 1
            stop = text.find("\n", b)
            stop = len(text) if stop < 0 else stop
            rank, saved = self.ranked(at, text[max(begin, a - WINDOW) : min(stop, b + WINDOW)])
            out.append((line, begin, stop, (licence, rank, saved, share, differs)))
        return out

    def closest_name(self, at: int, name: tuple[str, ...], near: tuple[str, ...]) -> tuple[int, float, str] | None:
        key = (at, name, near)
        if key not in self.near:
            if len(self.near) >= MEMO_BLOCKS:
                self.near.clear()
            self.near[key] = self.closest(self.wordings[at, name], list(near))
        return self.near[key]


def identify_all(block: str, known: list[Template]) -> list[tuple[str, int, int, float, str]]:
    """``licence, rank, bytes saved, coverage, differing words`` of every licence that a block confirms, in order."""
    return [found for *_, found in sorted(Scanner(known).scan(block, cued=False))]


def identify(block: str, known: list[Template]) -> tuple[str, int, int, float, str] | None:
    """The licence of a block that saves most, and the first one of those; None if no licence is confirmed."""
    return max(identify_all(block, known), key=lambda f: f[2], default=None)


def speaks(lower: str) -> bool:
    return any([cue in lower for cue in CUES])


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed licence and line: ``id, line, licence, rank, saved, coverage, differs, block``.

    ``line`` is where the name or text begins and counts from 0, ``block`` the lines from there to its end, ``rank`` is the licence's place by the reduction of its window, ``saved`` the bytes, ``coverage`` the share of
    the closest wording that the block holds and ``differs`` the wording's words that it lacks (``-``) and its own between
    (``+``). Equal reductions have one rank. A null or empty text, or one without a licence, has no row. Lines of any length are scanned whole. Rows
    that repeat give rows that repeat. An empty table gives an empty one. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates())
        for batch in batches:
            for part, texts in slices(batch):
                rows: list[tuple] = []
                for row, text in enumerate(texts):
                    if speaks(text.lower()):
                        for number, begin, end, found in scanner.scan(text):
                            rows.append((row, number, *found, text[begin:end].strip()))
                if rows:
                    at, line, licence, rank, saved, coverage, differs, found = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            id_col: part.column(0).take(pa.array(at)),
                            "line": pa.array(line, pa.int64()),
                            "licence": pa.array(licence, pa.string()),
                            "rank": pa.array(rank, pa.int32()),
                            "saved": pa.array(saved, pa.int64()),
                            "coverage": pa.array(coverage, pa.float64()),
                            "differs": pa.array(differs, pa.string()),
                            "block": pa.array(found, pa.string()),
                        }
                    )

    schema = (
        f"`{id_col}` {kind}, line bigint, licence string, rank int, saved bigint, coverage double, differs string, block string"
    )
    return df.select(id_col, text_col).mapInArrow(run, schema)

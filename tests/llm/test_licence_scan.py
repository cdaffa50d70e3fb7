"""Licences in lines of any length, in any case and over several lines."""

from __future__ import annotations

import random
import textwrap

import pytest

from quillsieve.llm import licenses

KNOWN = licenses.templates()


@pytest.mark.parametrize("size", [1_000, 13_000, 33_000, 330_000])
@pytest.mark.parametrize(
    "phrase, licence",
    [
        ("Released under the MIT License.", "MIT"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("All rights reserved.", "all-rights-reserved"),
    ],
)
def test_long_lines(size, phrase, licence):
    rnd = random.Random(size)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(size // 6)]
    words.insert(len(words) // 2, phrase)
    assert licenses.identify(" ".join(words), KNOWN)[0] == licence


@pytest.mark.parametrize(
    "line, licence",
    [
        ("MIT License", "MIT"),
        ("License: MIT License", "MIT"),
        ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "Apache-2.0"),
        ("ISC License", "ISC"),
    ],
)
def test_short_and_upper_case_lines(line, licence):
    assert licenses.identify(line, KNOWN)[0] == licence


def wrapped(text, prefix="# ", width=50):
    return "\n".join(prefix + line for line in textwrap.wrap(text, width))


BSD_3 = licenses.BSD + licenses.REST["BSD-3-Clause"]
BSD_2 = licenses.BSD + licenses.REST["BSD-2-Clause"]
MIT = licenses.SENTENCES["MIT"][0] + licenses.REST["MIT"]
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version."
)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dual licensed under the MIT License and the Apache License, Version 2.0", {"MIT", "Apache-2.0"}),
        (wrapped(GPL), {"GPL-3.0"}),
        ("// SPDX-License-Identifier: MIT", {"MIT"}),
        ("SPDX-License-Identifier: ISC", {"ISC"}),
        ("/* SPDX-License-Identifier: (GPL-3.0-only OR MIT) */", {"GPL-3.0", "MIT"}),
        ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note AND BSD-3-Clause", {"GPL-2.0", "BSD-3-Clause"}),
        ("license: GPL-3.0-only", {"GPL-3.0"}),
        (wrapped(MIT), {"MIT"}),
        (wrapped(MIT, "", 30), {"MIT"}),
        (wrapped(licenses.SENTENCES["ISC"][0] + licenses.REST["ISC"], " * "), {"ISC"}),
        (wrapped(BSD_3), {"BSD-3-Clause"}),
        (wrapped(BSD_2), {"BSD-2-Clause"}),
        (wrapped(BSD_2) + "\n\n" + wrapped(BSD_3), {"BSD-2-Clause", "BSD-3-Clause"}),
        ("Licensed under the Apache License,\nVersion 2.0", {"Apache-2.0"}),
        ("Licensed under the Apache License, Version 1.1.", set()),
    ],
)
def test_blocks(spark, text, want):
    assert {found[0] for found in licenses.identify_all(text, KNOWN)} == want
    df = spark.createDataFrame([(1, "Some text.\n" + text + "\nMore text.")], "doc_id bigint, text string")
    rows = licenses.scan_licenses(df).collect()
    assert {r.licence for r in rows} == want and len(rows) == len(want)
    assert all(r.coverage >= licenses.COVERAGE and r["line"] >= 1 for r in rows)


@pytest.mark.parametrize(
    "text, licence, differs",
    [
        (MIT.replace("hereby ", ""), "MIT", "-hereby"),
        (MIT.replace("free of charge, ", ""), "MIT", "-free -of -charge"),
        (BSD_3.replace("modification,", "modifications,"), "BSD-3-Clause", "-modification +modifications"),
    ],
)
def test_compression_finds_texts_with_changed_words(text, licence, differs):
    for block in (text, wrapped(text)):
        found = licenses.identify_all(block, KNOWN)
        assert [(f[0], f[4]) for f in found] == [(licence, differs)]
    other = "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is granted"
    assert licenses.identify(other, KNOWN) is None


def test_only_licences_that_save_bytes_are_looked_for(monkeypatch):
    scanner = licenses.Scanner(KNOWN)
    line = "Released under the MIT License."
    assert [f[0] for *_, f in scanner.scan(line)] == ["MIT"]
    monkeypatch.setattr(scanner, "leading", lambda window: {})
    assert scanner.scan(line) == []


def test_every_name_saves_bytes_in_short_and_long_windows():
    scanner = licenses.Scanner(KNOWN)
    rnd = random.Random(5)
    for at, template in enumerate(KNOWN):
        for size, letters in ((0, "a"), (40, "abcdefghijklmnopqrstuvwxyz"), (160, "abcdefghijklmnopqrstuvwxyz"), (160, "etaoinsréèçüöä")):
            words = ["".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(size // 6)]
            for name in licenses.NAMES[template.licence]:
                half = len(words) // 2
                window = " ".join([*words[:half], name, *words[half:]])
                assert at in scanner.leading(window), window

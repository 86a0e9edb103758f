"""License scans at the ends of texts, with words between, and with the common wordings."""

import random

import pytest

from ledgerlens.llm import licenses

LONG = [x for x, text in licenses.TEMPLATES.items() if len(text.split()) > 30]


def found_share(make, runs=1000):
    """Share of the texts in which the scan finds the template that holds at least 0.8 of it."""
    rng, scanner, hits = random.Random(8), licenses.Scanner(licenses.TEMPLATES), 0
    for i in range(runs):
        name = LONG[i % len(LONG)]
        words = [x.decode() for x in licenses.folded_words(licenses.TEMPLATES[name].encode())]
        whole = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        made = make(rng, words)
        assert len(whole & {tuple(made[k : k + 5]) for k in range(len(made) - 4)}) >= 0.8 * len(whole)
        head = [f"w{rng.randrange(10**6)}" for _ in range(40 + i)]
        hits += name in {x[0] for x in scanner(" ".join(head + made).encode())}
    return hits / runs


def changed(rng, words, made=None):
    """As many words changed as the containment of 0.8 allows."""
    whole, words = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}, made or words
    for k in rng.sample(range(len(words)), len(words)):
        new = [*words[:k], "zzz", *words[k + 1 :]]
        if len(whole & {tuple(new[i : i + 5]) for i in range(len(new) - 4)}) >= 0.8 * len(whole):
            words = new
    return words


def stretched(rng, words):
    """The same, with words between two parts of the template."""
    more = len(words)
    k = rng.randrange(1, len(words))
    return changed(rng, words, words[:k] + [f"v{rng.randrange(10**6)}" for _ in range(more)] + words[k:])


@pytest.mark.parametrize("make", [changed, stretched])
def test_nearly_all_are_found_at_the_end_of_a_text(make):
    assert found_share(make) >= 0.998


def test_windows_hold_every_run():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for kind in scanner.classes.values():
        for size in range(kind.spread, kind.spread + 3 * kind.step + 5):
            blocks = -(-size // licenses.BLOCK)
            if kind.step == 1:
                continue
            starts = list(range(0, max(1, blocks - kind.width // licenses.BLOCK + 1), kind.step // licenses.BLOCK))
            starts.append(max(0, blocks - kind.width // licenses.BLOCK))
            for first in range(size - kind.spread + 1):
                assert any(s * licenses.BLOCK <= first and first + kind.spread <= s * licenses.BLOCK + kind.width for s in starts)


BSD_3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GNU = """This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version.
This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {1} for more details."""
KNOWN = [
    ("Licensed under the MIT License.", "mit-notice"), ("This project is distributed under the MIT licence", "mit-notice"), ("licensed under CC BY 4.0", "cc-by-4.0-notice"), ("License: CC BY-SA 4.0", "cc-by-sa-4.0-notice"),
    ("Text is available under the Creative Commons Attribution-ShareAlike License 3.0;", "cc-by-sa-3.0-notice"), ("see http://creativecommons.org/licenses/by-nc-nd/3.0/", "cc-by-nc-nd-3.0-notice"),
    ("released under the GPL-2.0", "gpl-2.0-notice"), ("Released under the GNU General Public License version 2", "gpl-2.0-notice"), ("licensed under the LGPL v2.1", "lgpl-2.1-notice"), ("Licensed under the GNU Affero General Public License v3.0", "agpl-3.0-notice"),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0-notice"), ("licensed under the Eclipse Public License 2.0", "epl-2.0-notice"), ("Released under CC0 1.0", "cc0-1.0-notice"), ("Licensed under Apache 2.0", "apache-2.0-notice"),
    ("licensed under the BSD 3-Clause License", "bsd-3-clause-notice"), (BSD_3, "bsd-3-clause"), (BSD_3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "bsd-3-clause"), (BSD_3[: BSD_3.index("3. ")], "bsd-2-clause"),
    (GNU.format("program", "General Public License", 2), "gpl-2.0"), (GNU.format("program", "General Public License", 3), "gpl-3.0"), (GNU.format("library", "Lesser General Public License", "2.1"), "lgpl-2.1"),
    (GNU.format("library", "Lesser General Public License", 3), "lgpl-3.0"), (GNU.format("program", "Affero General Public License", 3), "agpl-3.0"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.", "cc0-1.0"), ("She was licensed under the law of that time and the old school", None),
]


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.common())


@pytest.mark.parametrize("line,name", KNOWN)
def test_common_wordings(scanner, line, name):
    text = "Some words before it stand here. " + line + " And some words after it."
    assert [x[0] for x in scanner(text.encode())] == ([name] if name else [])


def test_first_templates_are_all_reported(scanner):
    for name, text in licenses.TEMPLATES.items():
        assert name in {x[0] for x in scanner(text.encode())}


def test_many_licenses_in_one_text():
    import time

    from ledgerlens.llm.license_texts import LINES

    scanner = licenses.Scanner(licenses.common())
    line = licenses.TEMPLATES["mit-notice"]
    start = time.time()
    found = scanner(" and then some other words. ".join([line] * 20_000).encode())
    assert time.time() - start < 60
    assert len(found) == 20_000 and {x[0] for x in found} == {"mit-notice"}
    # Equal to comparing each match with all kept ones.
    texts = [*list(LINES.values())[:60], *licenses.TEMPLATES.values()] * 2
    words = licenses.folded_words(" ".join(texts).encode())
    shingles, near, kinds = licenses._hashes(words), {}, {}
    for kind, at, name in scanner._candidates(shingles):
        near.setdefault(name, set()).add(at)
        kinds[name] = kind
    every = [x for name, starts in near.items() for x in scanner._verify(words, name, sorted(starts), kinds[name])]
    extra = lambda x: x[0] in licenses.TEXTS or x[0] in licenses.LINES
    kept = []
    for x in sorted(every, key=lambda x: (-round(x[3] * len(scanner.shingles[x[0]])), -x[3], x[0], x[1])):
        if not any((extra(x) or extra(y)) and 2 * (min(x[2], y[2]) - max(x[1], y[1]) + 1) >= min(x[2] - x[1], y[2] - y[1]) + 1 for y in kept):
            kept.append(x)
    assert scanner._best(every) == kept and len(kept) < len(every)


def test_clashing_columns_give_way(spark):
    from ledgerlens.llm.common import tuned

    tuned(spark)
    docs = spark.createDataFrame([(1, licenses.TEMPLATES["mit-notice"], "x", 2)], "doc_id long, text string, license string, Containment int")
    out = licenses.scan_licenses(docs)
    assert out.columns == ["doc_id", "license", "first_word", "last_word", "containment"]
    assert [r["license"] for r in out.collect()] == ["mit-notice"]

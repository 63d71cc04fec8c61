import random
import textwrap

import pytest

from lexloom.llm import license_scan as L

GNU = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {what}.  If not, see <https://www.gnu.org/licenses/>."""
CASES = [(key, GNU.format(what=what, name=name, version=version)) for key, (name, version) in L._GNU_KINDS.items() for what in ("program", "library")] + L.MORE_TEXTS


@pytest.mark.parametrize("key", sorted({k for k, _ in CASES}))
def test_each_text_is_its_own(key):
    for own, text in CASES:
        if own != key:
            continue
        comment = "/*\n" + textwrap.indent("\n\n".join(textwrap.fill(x, 70) for x in ["Copyright (c) 2020 A. Person", *text.split("\n\n")]), " * ", lambda _: True) + "\n */"
        dice, found, *_ = min(L.scan_text("int x;\n\n" + comment + "\n\nint main() { return 0; }"), key=lambda h: (-h[0], h[2], h[1]))
        assert (found, dice > 0.9) == (key, True), (text, found, dice)


def best(text):
    return min(L.scan_text(text), key=lambda h: (-h[0], h[2], h[1]))


PROSE = "The boat went up the river in the morning and nobody knew what was on it. "
STANDARD = [(k, t) for k, t in [*L.TEXTS.items(), *L.MORE_TEXTS, *L.OPENINGS] if len(t) > 150]


@pytest.mark.parametrize("key", sorted(L.NAMES))
def test_texts_within_longer_ones(key):
    known = [(k, t) for k, t in STANDARD if k == key]
    for _, text in known[:: -(-len(known) // 12)]:
        for before, after in (("", PROSE * 30), (PROSE * 30, ""), (PROSE * 9, PROSE * 40), ("\n".join([PROSE] * 5) + "\n", "\n" + "\n".join([PROSE] * 5))):
            for body in (text, textwrap.fill(text, 60), text.upper()):
                whole = f"{before}{body} {after}"
                dice, found, start, end = best(whole)
                assert (found, dice > 0.95) == (key, True), (dice, found, whole[start:end], text)
                assert abs(start - len(before)) < 20 and abs(end - len(before) - len(body)) < 20


def test_notices_within_a_line():
    for key, (names, _) in L.NAMES.items():
        for name in names:
            for notice in L.NOTICES:
                dice, found, start, end = best(f"{PROSE}{notice.format(name)}; {PROSE}")
                assert found == key and dice >= 0.9 and end - start < len(notice.format(name)) + 5
    many = L.scan_text(" ".join([PROSE + "Released under the MIT License."] * 500))
    assert len(many) == 500 and {h[:2] for h in many} == {(1.0, "MIT")}
    assert L.scan_text(PROSE * 2_000 + "the license of the software is of no use to any person") == []


def test_windows_against_all_of_them():
    """Against every window of every template, on texts made of pieces of templates."""
    rnd = random.Random(4)
    known, index = L.templates()
    sets = [set() for _ in known]
    for pair, ids in index.items():
        for i in ids:
            sets[i].add(pair)
    for _ in range(40):
        words = []
        for _ in range(rnd.randint(1, 3)):
            words += PROSE.lower().replace(".", "").split()[: rnd.randint(0, 15)]
            words += [w for w in L.words_of(rnd.choice(list(L.NOTICES)).format(rnd.choice(list(L.NAMES.values()))[0][0])) if rnd.random() < 0.95]
        pairs = list(zip(words, words[1:], strict=False))
        expected = []
        for (key, size, length), own in zip(known, sets, strict=True):
            for a in range(len(pairs)):
                if pairs[a] in own:
                    inside = [b for b in range(a, min(a + length, len(pairs))) if pairs[b] in own]
                    window = set(pairs[a : inside[-1] + 1])
                    dice = 2 * len(window & own) / (len(window) + size)
                    if dice >= L.THRESHOLD:
                        expected.append((-len(window & own), -dice, a, key, inside[-1]))
        taken, out = set(), []
        for shared, dice, a, key, b in sorted(expected):
            if not taken & set(range(a, b + 1)):
                taken |= set(range(a, b + 1))
                out.append((-dice, key, a, b, -shared))
        assert L.windows(pairs, L.THRESHOLD) == out


def test_odd_tables(spark):
    rows = [(1, "x", 0.5, PROSE * 20_000 + "Released under the MIT License."), (1, "x", 0.5, None), (None, None, None, "\n" * 1_000)]
    df = spark.createDataFrame(rows, "doc_id long, license string, dice double, text string")
    assert sorted(((r.doc_id or 0, r.license, r.n_hits) for r in L.scan(df).collect()), key=str) == [(0, None, 0), (1, "MIT", 1), (1, None, 0)]
    assert L.scan(df.limit(0)).collect() == []


def test_every_licence_has_a_text_and_telling_words_lose_none():
    assert {k for k, _ in L.MORE_TEXTS} | set(L.TEXTS) == set(L.NAMES)
    for _, text in [*L.MORE_TEXTS, *L.OPENINGS]:
        pairs = L.bigrams(L.words_of(text))
        plain = {p for p in pairs if set(p) <= L.ORDINARY}
        assert 2 * len(plain) / (len(plain) + len(pairs)) < L.THRESHOLD

import random

import zstandard

from evidara.llm import licenses


def filler(rnd, n):
    return " ".join("".join(rnd.choice("the of and er tion ing on re".split()) for _ in range(2)) for _ in range(n)) + "."


def test_every_notice_and_text_is_found_exactly():
    s, rnd = licenses.Scanner(), random.Random(1)
    for t in licenses.templates():
        text = f"{filler(rnd, 30)}\n{t.text}\n{filler(rnd, 20)}"
        found = s.scan(text)
        assert [f[0] for f in found if not f[4]] == [t.license] or t.license in [f[0] for f in found], (t, found)
        hit = next(f for f in found if f[0] == t.license)
        assert hit[4] == []
        if t.name:
            assert text[hit[1] : hit[2]] == t.text and len(found) == 1, (t, found)


def test_other_versions_and_plain_words_are_not_confirmed():
    s = licenses.Scanner()
    for text in ["Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-XY 4.0.", "He had a fishing licence and her permission to go.", "", None, "copyright", "The license of poets is old and well known to all readers of verse."]:
        assert s.scan(text) == [], text


def test_wrapped_and_changed_texts():
    s = licenses.Scanner()
    words = licenses.TEXTS["MIT"].split()
    words[20] = "programs"
    lines = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    found = s.scan(f"Some intro.\n\nCopyright (c) 2020 Someone\n{lines}\n\nA tail without it. é")
    assert [f[0] for f in found] == ["MIT"]
    assert set(found[0][4]) == {"+programs", "-documentation"} or found[0][4]


def test_short_forms_expressions_and_negation():
    s = licenses.Scanner()
    names = lambda t: [f[0] for f in s.scan(t)]
    for text, want in [
        ("Licensed under Apache 2.0", ["Apache-2.0"]), ("It uses the Apache-2.0 license", ["Apache-2.0"]), ("GPLv3", ["GPL-3.0"]), ("License: MIT", ["MIT"]),
        ("SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0"]), ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR Apache-2.0", ["MIT", "BSD-3-Clause", "Apache-2.0"]),
        ("not licensed under the MIT License", []), ("This isn't released under the MIT License.", []), ("It is no longer licensed under GPLv3.", []),
        ("He got a license at MIT.", []), ("License: MITRE", []), ("SPDX-License-Identifier: MIT-feh", []),
    ]:
        assert names(text) == want, text


def test_compression_ranks_as_by_hand():
    """The ranking of a block by every template, one by one, against the scanner's."""
    s, rnd = licenses.Scanner(), random.Random(6)
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
    for t in rnd.sample(s.known, 25):
        block = t.text + " " + filler(rnd, 3)
        alone, sizes = len(plain.compress(block.encode())), {}
        for i, other in enumerate(s.known):
            d = zstandard.ZstdCompressionDict(other.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[i] = (alone - len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False).compress(block.encode()))) / alone
        want = sorted(((v, i) for i, v in sizes.items() if v >= licenses.MIN_SAVED), key=lambda x: (-x[0], x[1]))
        assert s.ranked(block) == want


def test_places_of_whole_texts_equal_every_window():
    """A text with at most the allowed changes is found, and its differences are the least over all windows."""
    rnd = random.Random(7)
    words = licenses.Template("ISC", licenses.TEXTS["ISC"], ()).words
    whole = licenses.Whole(words)
    for changes in range(whole.most + 4):
        block = [rnd.choice("abcdefg") for _ in range(40)] + list(words) + [rnd.choice("abcdefg") for _ in range(40)]
        for at in rnd.sample(range(len(words)), changes):
            block[40 + at] = "zzz"
        least = min(len(licenses.differences(block[a : a + len(words)], words)[0]) for a in range(len(block) - len(words) + 1))
        got = whole.places(block)
        assert bool(got) == (least <= whole.most) and (not got or min(len(g[0]) for g in got) == least), changes


def test_table(spark):
    rows = [(1, "x\nReleased under the MIT License."), (2, None), (3, "nothing"), (None, "All rights reserved."), (1, "x\nReleased under the MIT License.")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start int, license string")
    got = sorted(((r.doc_id, r.license, r.start, r.end) for r in licenses.find_licenses(df).collect()), key=str)
    assert got == [(1, "MIT", 2, 33), (1, "MIT", 2, 33), (None, "Proprietary", 0, 20)]
    assert licenses.find_licenses(df.limit(0)).count() == 0


def test_compression_ranks_the_right_text_first():
    s = licenses.Scanner()
    for spdx, text in licenses.TEXTS.items():
        assert s.known[s.ranked(text)[0][1]].license == spdx


def test_notices_within_lines_of_any_length():
    s, rnd = licenses.Scanner(), random.Random(4)
    for notice, lic in [("Released under the MIT License.", "MIT"), ("All rights reserved.", "Proprietary")]:
        for n in (2, 6, 12, 18, 30, 60):
            text = f"{filler(rnd, n)} {notice} {filler(rnd, n)}"
            assert [(f[0], text[f[1] : f[2]]) for f in s.scan(text)] == [(lic, notice)], text
    text = f"{filler(rnd, 30)} Released under\nthe MIT License. {filler(rnd, 30)}"
    assert [(f[0], text[f[1] : f[2]]) for f in s.scan(text)] == [("MIT", "Released under\nthe MIT License.")]


def wrapped(text, n):
    words = text.split()
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_adjacent_texts_are_all_found():
    s, rnd = licenses.Scanner(), random.Random(5)
    changed = {}
    for spdx, text in licenses.TEXTS.items():
        words = text.split()
        if len(words) > 60 and spdx != "Apache-2.0":
            words[2] = "changed"
        changed[spdx] = " ".join(words)
    for n in (3, 11, 500):
        text = "\n".join(wrapped(x, n) for x in [*changed.values(), changed["MIT"]])
        found = s.scan(f"{filler(rnd, 40)}\n{text}\n{filler(rnd, 40)}")
        assert sorted(f[0] for f in found) == sorted([*changed, "MIT"])
        assert all(f[4] == ["+changed", "-" + licenses.TEXTS[f[0]].lower().split()[2].strip(",")] for f in found if f[0] in ("MIT", "ISC", "GPL-3.0")), found


def test_several_notices_of_a_line():
    s = licenses.Scanner()
    assert sorted(f[0] for f in s.scan("Licensed under the MIT License, released under ISC License.")) == ["ISC", "MIT"]


def test_notices_within_sentences_of_any_length():
    """No mark ends the notice, and the words around it are of its own sentence."""
    s, rnd = licenses.Scanner(), random.Random(9)
    for notice, lic in [("is released under the MIT License", "MIT"), ("Copyright 2020 someone all rights reserved", "Proprietary"), ("License: ISC", "ISC"), ("Distributed under the terms of the GNU Lesser General Public License, version 2.1", "LGPL-2.1")]:
        for n in (0, 5, 13, 14, 28, 60, 240):
            text = f"{filler(rnd, n)[:-1]} {notice} {filler(rnd, n)[:-1]}".strip()
            assert [f[0] for f in s.scan(text)] == [lic], text
    assert [f[0] for f in s.scan("This tool, " + "word " * 20 + "is released under the MIT License")] == ["MIT"]


def test_dictionaries_choose_whatever_confirms():
    """Templates chosen by compression against all of them, over texts with changed words and several notices."""
    s, rnd = licenses.Scanner(), random.Random(11)
    every = licenses.Scanner()
    every.chosen = lambda window, groups: [g for g, _, _ in groups]
    for _ in range(40):
        parts = []
        for t in rnd.sample(s.known, 4):
            w = t.text.split()
            for _ in range(rnd.randint(0, max(0, len(w) // 12))):
                w[rnd.randrange(len(w))] = "other"
            parts += [filler(rnd, rnd.randint(0, 60)), " ".join(w)]
        text = rnd.choice(["\n", " "]).join(parts)
        got, want = ({(f[0], f[1], f[2]) for f in x.scan(text)} for x in (s, every))
        assert got == want, text


def test_overlaps_are_settled_as_by_all_pairs():
    rnd = random.Random(12)
    for _ in range(300):
        found = [(rnd.choice("ABC"), a := rnd.randrange(60), a + rnd.randint(1, 8), rnd.random(), ["+x"] * rnd.randint(0, 2)) for _ in range(rnd.randint(0, 25))]
        want: list = []
        for f in sorted(found, key=lambda f: (len(f[4]), f[1] - f[2], -f[3])):
            if not any(f[1] < g[2] and g[1] < f[2] and (f[0] == g[0] or len(g[4]) < len(f[4])) for g in want):
                want.append(f)
        assert licenses.Scanner.settled(found) == want


def test_many_notices_take_time_in_proportion():
    import time

    s = licenses.Scanner()
    took = []
    for n in (2_000, 8_000):
        text = "\n".join(["Released under the MIT License.", "All rights reserved.", "words of another kind"] * (n // 2))
        begun = time.process_time()
        assert len(s.scan(text)) == n
        took.append(time.process_time() - begun)
    assert took[1] < 8 * took[0]

from __future__ import annotations

import itertools
import random
import textwrap

from helpers import prose
from larkspur.llm import license_scan as L


def test_every_template_is_found():
    rng = random.Random(1)
    scanner = L.Scanner()
    for name, template in scanner.templates.items():
        for text in (template, prose(rng, 50) + ".\n" + template + "\n" + prose(rng, 40), prose(rng, 20) + ". " + template):
            found = scanner.scan(text)
            assert [x["license"] for x in found] == [name]
            assert found[0]["differences"] == [] and template in text[found[0]["start"] : found[0]["end"]]


def test_differences_and_offsets():
    scanner = L.Scanner()
    text = "é uno. This work is licensed under the GNU General Public Licence, version 3. fin"
    (found,) = scanner.scan(text)
    assert found["license"] == "GPL-3.0" and found["differences"] == ["-license", "+licence"]
    assert text[found["start"] : found["end"]].startswith("This") and found["saved"] > 0
    assert scanner.scan("Licensed under CC BY-NC 4.0.")[0]["license"] == "CC-BY-NC-4.0"
    assert scanner.scan("Licensed under CC BY-NC 4.0. Released under the MIT License.")[1]["license"] == "MIT"


def test_cues_alone_are_nothing():
    scanner = L.Scanner()
    for text in ("the driving license of my aunt expired in may", "licensed premises", "copyright law is hard", ""):
        assert scanner.scan(text) == []


def test_against_every_template(spark):
    """The three templates that save most hold the one with the fewest differences: ranking loses none."""
    rng = random.Random(2)
    every = L.Scanner(winners=len(L.TEMPLATES))
    three = L.Scanner()
    templates = list(every.templates.values())
    rows = [(i, " ".join([prose(rng, rng.randint(0, 60)), rng.choice([*templates, "x"]), prose(rng, rng.randint(0, 30))]), None) for i in range(200)]
    rows += [(300, None, ""), (301, "", ""), (None, "All rights reserved.", ""), (302, "x" * 1_000_000 + " All rights reserved. " + "y " * 100_000, ""), (302, "All rights reserved.", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = L.scan_licenses(df).collect()
    assert len(got) == len(rows)
    for i, text, _ in rows[:200]:
        row = next(r for r in got if r.doc_id == i)
        assert [(x.license, x.start, x.end) for x in row.found] == [(x["license"], x["start"], x["end"]) for x in every.scan(text)] == [(x["license"], x["start"], x["end"]) for x in three.scan(text)]
    assert sorted(str(r.licenses) for r in got if r.doc_id in (None, 300, 301, 302)) == ["['proprietary']"] * 3 + ["[]"] * 2
    assert L.scan_licenses(df.where("false")).count() == 0


def test_every_template_in_every_case():
    scanner = L.Scanner()
    for name, template in scanner.templates.items():
        for text in (template.upper(), template.title(), template.lower(), template.replace(" ", "  ")):
            found = scanner.scan("Uno dos. " + text)
            assert [(x["license"], x["differences"]) for x in found] == [(name, [])], text
            assert found[0]["saved"] > 0


def test_every_template_in_wrapped_lines():
    rng = random.Random(4)
    scanner = L.Scanner()
    for name, template in scanner.templates.items():
        for width in (40, 72):
            for sign in ("", "# ", " * ", "// ", "-- "):
                notice = "\n".join(sign + line for line in textwrap.wrap(template, width))
                for text in (notice, prose(rng, 30) + "\n\n" + notice + "\n\n" + prose(rng, 30), sign + "Copyright Uno Dos.\n" + sign.rstrip() + "\n" + notice):
                    (found,) = scanner.scan(text)
                    assert (found["license"], found["differences"]) == (name, []), text
                    assert notice.removeprefix(sign) in text[found["start"] : found["end"]]


def test_cues_in_one_sentence_share_a_block():
    text = "uno " * 200 + "license " + "dos " * 200 + "copyright " + "tres " * 200
    assert len(L.candidate_blocks(text)) == 1
    assert L.candidate_blocks("una license.\n\nuna license") == [(0, 12), (14, 25)]


def test_several_licenses_in_one_sentence():
    scanner = L.Scanner()
    text = "Released under the MIT License and licensed under CC BY 4.0."
    found = scanner.scan(text)
    assert [(x["license"], x["differences"], text[x["start"] : x["end"]]) for x in found] == [("MIT", [], "Released under the MIT License"), ("CC-BY-4.0", [], "licensed under CC BY 4.0.")]
    for (a, one), (b, two) in itertools.permutations([(k, scanner.templates[k]) for k in scanner.short], 2):
        got = [x["license"] for x in scanner.scan(one.rstrip(".") + " and " + two)]
        assert got == [a, b], (one, two)


def test_families_of_near_equal_templates():
    """More templates than three save as many bytes: each is found by its own wording."""
    templates = {f"X-{v}": f"This program may be used under the terms of the Example Public License, version {v}." for v in range(12)}
    scanner = L.Scanner(templates)
    for v in range(12):
        assert [(x["license"], x["differences"]) for x in scanner.scan(templates[f"X-{v}"])] == [(f"X-{v}", [])]
    (row,) = scanner.scan("Si no. " + templates["X-7"].replace("program", "work"))
    assert row["license"] == "X-7" and row["differences"] == ["-program", "+work"]


def test_many_in_one_block():
    scanner = L.Scanner()
    found = scanner.scan("uno dos licensed under CC BY 4.0 tres " * 2000)
    assert [x["license"] for x in found] == ["CC-BY-4.0"] * 2000


def test_other_licenses_are_not_the_nearest():
    """A word that tells licenses apart is never tolerated, though one word in five may differ."""
    scanner = L.Scanner()
    one = lambda text: [(x["license"], x["nearest"]) for x in scanner.scan(text)]
    for text, name in {
        "Released under the terms of the GNU Affero General Public License, version 3.": "AGPL-3.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0", "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    }.items():
        assert [x[0] for x in one(text.replace("Released under the terms of the GNU A", "This work is licensed under the GNU A"))] == [name]
    for text in ("This work is licensed under the GNU Verbatim General Public License, version 3.", "This work is licensed under the GNU General Public License, version 4.", "Licensed under CC BY-XY 4.0.", "Licensed under the Apache License, Version 1.1.", "Released under the XMIT License.", "Released not under the MIT License."):
        assert {x[0] for x in one(text)} <= {L.UNKNOWN}, text
        assert one(text) == [] or one(text)[0][1] in scanner.templates
    assert one("Released under the MIT Licence.")[0][0] == "MIT" and one("This thing is licensed under the GNU General Public License, v 3.")[0][0] == "GPL-3.0"


def test_whole_texts():
    """Texts over several paragraphs, wrapped and commented, with names and years round them, and what one has beyond another."""
    scanner = L.Scanner()
    for name in scanner.long:
        text = scanner.templates[name]
        for sign in ("", "# ", " * "):
            notice = "\n".join(sign + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, 75), ""])
            found = scanner.scan(f"{sign}Copyright (c) 1999 Uno Dos. All rights reserved.\n{sign}\n{notice}\n\nTres cuatro.")
            assert [(x["license"], x["differences"]) for x in found if x["license"] != "proprietary"] == [(name, [])], (name, found)
    two, three = scanner.templates["BSD-2-Clause-text"], scanner.templates["BSD-3-Clause-text"]
    assert [x["license"] for x in scanner.scan(two)] == ["BSD-2-Clause-text"] and [x["license"] for x in scanner.scan(three)] == ["BSD-3-Clause-text"]
    (found,) = scanner.scan(three.replace("the copyright holder nor", "Uno Dos nor").replace("reproduce", "keep"))
    assert found["license"] == "BSD-3-Clause-text" and "+keep" in found["differences"]


def test_templates_without_a_cue():
    templates = {"weather": "You may share these maps with anybody who asks for them politely on a rainy day."}
    scanner = L.Scanner(templates)
    for text in ("uno. You may share these maps with anybody who asks for them politely on a rainy day. dos", "you may share the maps with anybody who asks for them kindly on a rainy day"):
        assert [x["license"] for x in scanner.scan(text)] == ["weather"]
    rng = random.Random(3)
    words = templates["weather"].split(" ")
    for _ in range(200):  # whichever words are lost, the rest brings the block up
        lost = set(rng.sample(range(len(words)), 3))
        assert scanner.scan(" ".join(w for i, w in enumerate(words) if i not in lost)), lost
    assert L.Scanner({}).scan("All rights reserved.") == []


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_against_every_stretch():
    """Independent brute force: a template is confirmable if some stretch of the text lacks and adds at most a fifth of its words."""
    rng = random.Random(12)
    scanner = L.Scanner()
    texts = []
    for name in scanner.short:
        for _ in range(6):
            words = L.words(scanner.templates[name])
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(words))
                words[i : i + rng.randint(0, 1)] = [rng.choice(["uno", "dos", "the", "license"])] * rng.randint(0, 1)
            texts.append(" ".join([*(["tres"] * rng.randint(0, 2)), *words, "cuatro"]))
    for text in texts:
        own = text.split(" ")
        able = set()
        for name in scanner.short:
            words = scanner.words[name]
            most = 0.2 * len(words)
            spans = ((a, b) for a in range(len(own)) for b in range(a + 1, min(len(own), a + len(words) + int(most)) + 1))
            if any(max(len(words), b - a) - common(words, own[a:b]) <= most for a, b in spans):
                able.add(name)
        found = scanner.scan(text)
        assert {x["nearest"] for x in found} <= able, text
        if able and L._CUE.search(text):
            assert found, text
        for x in found:
            if x["license"] != L.UNKNOWN:
                assert not any(L.key(w[1:]) for w in x["differences"] if w[1:] not in L.SAME), x


def licenses(text):
    return [(L.license_of(x["license"]), text[x["start"] : x["end"]]) for x in L.Scanner().scan(text)]


def test_what_turns_the_sense_round_before_a_stretch():
    for text in ("This is not released under the MIT License.", "Not released under the MIT License.", "It was never licensed under the Apache License, Version 2.0.", "This isn't licensed under GPLv3."):
        assert [x for x, _ in licenses(text)] == [L.UNKNOWN], text
    assert [x for x, _ in licenses("Not released under the MIT License or the Apache License, Version 2.0.")] == [L.UNKNOWN] * 2
    for text in ("Do not edit. Released under the MIT License.", "Not only released under the MIT License.", "This may not be sold by anybody else and is released under the MIT License."):
        assert [x for x, _ in licenses(text)] == ["MIT"], text


def test_alternatives_and_lists():
    mit, apache = "MIT License", "Apache License, Version 2.0"
    assert licenses(f"Released under the {mit} or the {apache}.") == [("MIT", f"Released under the {mit}"), ("Apache-2.0", apache)]
    assert licenses(f"Licensed under the {apache} or the {mit}.") == [("Apache-2.0", f"Licensed under the {apache}"), ("MIT", mit)]
    assert [x for x, _ in licenses(f"Dual licensed under the {mit} and the {apache}.")] == ["MIT", "Apache-2.0"]
    assert [x for x, _ in licenses(f"Released under the {mit}, the {apache}, or CC BY 4.0.")] == ["MIT", "Apache-2.0", "CC-BY-4.0"]
    assert [x for x, _ in licenses(f"Released under the {mit}. The {apache} is long.")] == ["MIT"]
    assert [x for x, _ in licenses("Licensed under MIT/Apache-2.0")] == ["MIT", "Apache-2.0"]


def test_short_names_and_spdx_expressions():
    expected = {
        "licensed under GPLv3": ["GPL-3.0"], "Licensed under the GPL v2.": ["GPL-2.0"], "licensed under GPLv3+": ["GPL-3.0-or-later"], "License: BSD-3-Clause": ["BSD-3-Clause"], "SPDX-License-Identifier: MIT": ["MIT"],
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)\n": ["MIT", "Apache-2.0"], "# SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"], "Distributed under the terms of the LGPL v2.1 license.": ["LGPL-2.1"],
        "the MIT course licensed many patents": [], "driving license: mitigated": [], "license MIT": [],
    }
    for text, names in expected.items():
        assert [x for x, _ in licenses(text)] == names, text


def test_rows_name_licenses_without_the_wording(spark):
    (row,) = L.scan_licenses(spark.createDataFrame([(1, "SPDX-License-Identifier: MIT OR Apache-2.0")], "doc_id long, text string")).collect()
    assert row["licenses"] == ["Apache-2.0", "MIT"] and [x["license"] for x in row["found"]] == ["MIT", "Apache-2.0"]

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsense.llm import license_scan as L
from colsense.llm.license_texts import RIVALS, templates


TEMPLATES = templates()
WORDS = {name: re.findall(r"\w+", text.lower()) for name, _, text, _ in TEMPLATES}
DECIDING = {name: set(deciding.split()) for name, _, _, deciding in TEMPLATES}


def plain_alignment(own, words):
    """Best local alignment over the full table, cell by cell: matched template words, and places and words in the text."""
    table = [[(0, None)] * (len(words) + 1) for _ in range(len(own) + 1)]
    best, at = 0, (0, 0)
    for i in range(1, len(own) + 1):
        for j in range(1, len(words) + 1):
            same = own[i - 1] == words[j - 1]
            steps = [(table[i - 1][j - 1][0] + (2 if same else -1), (i - 1, j - 1)), (table[i - 1][j][0] - 1, (i - 1, j)), (table[i][j - 1][0] - 1, (i, j - 1))]
            value, back = max(steps, key=lambda x: x[0])
            table[i][j] = (value, back) if value > 0 else (0, None)
            if value > best:
                best, at = value, (i, j)
    matched, inside = [], set()
    i, j = at
    while table[i][j][0]:
        _, (a, b) = table[i][j]
        if (a, b) == (i - 1, j - 1) and own[a] == words[b]:
            matched.append(a)
            inside.add(b)
        i, j = a, b
    return matched, inside, j, at[1]


def every_alignment(text):
    """Templates of up to 120 words whose best alignment in ``text`` is a match: name -> matched words."""
    words = re.findall(r"\w+", text.lower())
    out = {}
    for name, own in WORDS.items():
        if len(own) > 120 or not DECIDING[name] <= set(words) or len(set(own) & set(words)) < 0.5 * len(set(own)):
            continue
        matched, inside, start, end = plain_alignment(own, words)
        decided = {own[i] for i in matched} - ({own[i] for i in range(len(own)) if i not in matched} if len(own) <= L.SHORT else set())
        rival = any(w in RIVALS and k not in inside for k, w in enumerate(words[start:end], start))
        if len(matched) >= L.COVERAGE * len(own) and DECIDING[name] <= decided and not rival:
            out[name] = len(matched)
    return out


def planted():
    rng = random.Random(4)
    filler = ["zor%d" % i for i in range(200)] + "the of and in is this to work license".split()
    texts = []
    for name, _, template, _ in TEMPLATES:
        words = template.split()
        if len(words) > 120:
            continue
        for edits in (0, len(words) // 20):
            mine = list(words)
            for _ in range(edits):
                at = rng.randrange(len(mine))
                mine[at : at + 1] = rng.choice(([], ["zor1"], [mine[at], "zor2"]))
            texts.append((name, " ".join(rng.choices(filler, k=30)) + "\n" + " ".join(mine) + "\n" + " ".join(rng.choices(filler, k=30))))
    return texts


def test_finds_what_full_alignment_finds():
    index = L.index_of()
    for name, text in planted():
        full = every_alignment(text)
        got = L.matches(index, text)
        if full:
            assert {m["template"] for m in got} <= set(full)
            best = max(full.values())
            assert any(full[m["template"]] == best for m in got), (name, full, got)
        else:
            assert got == []


def test_spans_and_copies():
    line = "Licensed under the Apache License, Version 2.0."
    text = ("nothing here. " + line + " ") * 300
    got = L.matches(L.index_of(), text)
    assert len(got) == 300 and {m["licence"] for m in got} == {"Apache-2.0"}
    assert all(text[m["start"] : m["end"]] == line[:-1] for m in got)
    assert L.matches(L.index_of(), "İ" * 9 + " Released under the MIT License.")[0]["licence"] == "MIT"


def test_clean_text_has_none():
    index = L.index_of()
    for text in [None, "", " ", "the license of the work", "under the license", "word " * 50_000, "this is the work of the hand and the law of the land"]:
        assert L.matches(index, text) == []


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(200):
        shared = rng.integers(1, 50, L.GRAM + L.WINDOW - 1)
        a = np.concatenate([rng.integers(0, 50, 9), shared, rng.integers(0, 50, 4)])
        b = np.concatenate([rng.integers(0, 50, 3), shared, rng.integers(0, 50, 8)])
        assert set(L.fingerprints(a)[1].tolist()) & set(L.fingerprints(b)[1].tolist())


def test_query_over_odd_rows(spark, tmp_path):
    rows = [(1, "x. Released under the MIT License."), (1, "x. Released under the MIT License."), (2, None), (None, ""), (3, "Licensed under CC BY-NC 4.0.\nand This work is licensed under the GNU General Public License, version 3.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Matches", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_matches, r.licences) for r in L.query(spark, str(tmp_path)).collect()))
    assert got == [(False, 1, 1, ["MIT"]), (False, 1, 1, ["MIT"]), (False, 2, 0, []), (False, 3, 2, ["CC-BY-NC-4.0", "GPL-3.0"]), (True, 0, 0, [])]
    assert L.scan(docs).columns == ["doc_id", "text", "matches"]
    assert L.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_table_lines(spark, sf):
    """Every planted line of the table is found, and nothing in texts without one."""
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in L.query(spark, sf).collect():
        assert r.licences == sorted({lines[x] for x in lines if x in docs[r.doc_id]}), r.doc_id


def test_copies_back_to_back():
    index = L.index_of()
    for name, _, line, _ in TEMPLATES:
        if len(re.findall(r"\w+", line)) > 25:
            continue
        for n in (2, 3, 4, 10):
            for gap in ("\n", " zor1\n", " zor1 zor2 "):
                text = gap.join([line] * n)
                got = [m for m in L.matches(index, text) if m["template"] == name]
                assert len(got) == n and all(m["coverage"] == 1 for m in got), (name, n, gap)


def test_short_templates_with_one_edit():
    """Every one-word substitution, deletion and insertion of a short template gives what full alignment gives."""
    index = L.index_of()
    around = "zor1 zor2 the zor3 of this work zor4 ".split()
    for name, _, line, _ in TEMPLATES[::3]:
        own = re.findall(r"\w+", line)
        if len(own) > 25:
            continue
        for at in range(len(own)):
            for new in ([], ["zor9"], [own[at], "zor9"]):
                text = " ".join(around + own[:at] + new + own[at + 1 :] + around)
                full = every_alignment(text)
                got = {m["template"]: round(m["coverage"] * len(WORDS[m["template"]])) for m in L.matches(index, text)}
                assert bool(got) == bool(full) and set(got) <= set(full), (name, text, full, got)
                if full:
                    assert max(got.values()) == max(full.values()), (name, text, full, got)


def test_short_copies_with_edits_between_each_word():
    text = "zor1 Released zor2 under zor3 the MIT zor4 License. Released under MIT License. Released under the MIT License"
    assert [m["template"] for m in L.matches(L.index_of(), text)] == ["mit-released"] * 3


@pytest.mark.parametrize(
    ("text", "licences"),
    [
        ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
        ("Licensed under CC BY 9.0.", []),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 1.", ["GPL-1.0"]),
        ("This work is licensed under the GNU General Public License, version 7.", []),
        ("Licensed under the Apache License, Version 2.1.", []),
        ("Licensed under the BSD 3-Clause License.", ["BSD-3-Clause"]),
        ("SPDX-License-Identifier: MIT-0", ["MIT-0"]),
        ("SPDX-License-Identifier: AGPL-3.0-or-later", ["AGPL-3.0"]),
    ],
)
def test_what_decides_a_licence(text, licences):
    assert [m["licence"] for m in L.matches(L.index_of(), text)] == licences


def test_whole_licences():
    """Whole texts are named, also with a tenth of the words changed, and at once with many lines around."""
    rng = random.Random(8)
    for name, licence, text, _ in TEMPLATES:
        if name.endswith("-whole") and len(text) < 20_000:
            for edits in (0, len(text.split()) // 10):
                words = text.split()
                for _ in range(edits):
                    at = rng.randrange(len(words))
                    if not re.search(r"\d|ersion|esser|ffero", words[at]):
                        words[at] = "zor"
                got = L.matches(L.index_of(), "zor words " * 50 + " ".join(words) + " zor" * 50)
                assert licence in {m["licence"] for m in got}, (name, edits, got)


def test_many_matches_in_one_text():
    for line in ("Released under the MIT License.\n", "Licensed under CC BY-NC 4.0.\n"):
        text = line * 4000
        began = time.perf_counter()
        got = L.matches(L.index_of(), text)
        assert len(got) == 4000 and time.perf_counter() - began < 0.3


def test_very_long_text_through_the_query(spark, tmp_path):
    text = "word and other words of no licence " * 30_000 + "Licensed under CC BY-SA 4.0. " + "more words " * 30_000
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = L.query(spark, str(tmp_path)).head()
    assert row.licences == ["CC-BY-SA-4.0"] and text[row.matches[0].start : row.matches[0].end] == "Licensed under CC BY-SA 4.0"

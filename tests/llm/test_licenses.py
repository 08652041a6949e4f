"""Exact phrases against a word scan, and notices with edits."""

from __future__ import annotations

import random
import re

from conftest_llm import WORDS, by_id

from techfolio.llm import licenses


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_word_scan(spark, docs_of):
    rng = random.Random(4)
    parts = ["MIT", "License", "mit license", "Apache", "apache-license", "general", "public", "license", "é", "mit,license", "x", "İ", "\n", "3", ""]
    texts = {k: rng.choice([" ", ". ", "_"]).join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for k in range(200)} | {900: None, 901: "", None: "MIT License", 902: "MIT license " * 5000}
    got = by_id(licenses.scan(docs_of(texts)))
    assert len(got) == len(texts)
    for key, text in texts.items():
        r = got[key]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text), text
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_notices_with_edits(spark, docs_of):
    rng = random.Random(8)
    filler = lambda: " ".join(rng.choice(WORDS) for _ in range(30))
    texts, wanted = {}, {}
    for label, notices in licenses.NOTICES.items():
        for notice in notices:
            exact = [m.span() for m in re.finditer(r"\[.*?\]", notice)]
            free = [at for at in range(1, len(notice) - 1) if not any(low - 1 <= at <= high for low, high in exact)]
            edited, k = list(notice), licenses.allowed_edits(notice)
            for at in rng.sample(free, k):
                edited[at] = rng.choice("aeiou")
            texts[len(texts)] = f"{filler()} {licenses.plain(''.join(edited))} {filler()}"
            wanted[len(wanted)] = label
    texts[500] = filler()
    got = by_id(licenses.scan(docs_of(texts)))
    assert [(k, label) for k, label in wanted.items() if label not in got[k]["labels"].split(",")] == []
    for k in wanted:
        for span in got[k]["found"]:
            assert span["edits"] <= max(licenses.allowed_edits(x) for x in licenses.NOTICES[span["label"]])
    assert got[500]["labels"] == "" and got[500]["score"] == 0
    assert licenses.scan(docs_of({})).count() == 0


def test_names_take_no_edits(spark, docs_of):
    cases = {
        "SPDX-License-Identifier: MPL-2.0": "mpl", "SPDX-License-Identifier: EPL-2.0": "epl", "SPDX-License-Identifier: LGPL-3.0": "lgpl",
        "SPDX-License-Identifier: AGPL-3.0-only": "agpl", "SPDX-License-Identifer: MIT": "mit", "SPDX-License-Identifier: WTFPL": "",
        "Licensed under the ISC License": "isc", "Released under the ISC License": "isc", "Licensed under the MPL license": "mpl",
        "Licensed under the pmit license": "", "licensed under CC BY-ND 4.0": "cc-by-nd", "licensed under CC BY 4.0": "cc-by", "licenced under the MIT licence": "mit",
        "Under the terms of the GNU Lesser General Public License": "gpl,lgpl",
    }
    got = by_id(licenses.scan(docs_of(dict(enumerate(cases)))))
    assert {text: got[k]["labels"] for k, text in enumerate(cases)} == cases


def distance(pattern, text):
    """Fewest edits that turn ``pattern`` into some stretch of ``text``."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(pattern, 1):
            last, row[i] = row[i], min(last + (x != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def test_edits_equal_an_edit_distance():
    scanner = licenses._scanner(tuple(sorted(licenses.NOTICES.items())))
    rng, notice = random.Random(9), "permission is hereby granted free of charge to any person obtaining a copy"
    k = licenses.allowed_edits(notice)
    for n in range(60):
        edited = list(notice)
        for _ in range(rng.randint(0, k + 3)):
            at = rng.randrange(2, len(edited) - 2)
            edited[at : at + 1] = rng.choice([[], [rng.choice("aeiou")], [edited[at], rng.choice("xyz")]])
        norm = f" alpha {''.join(edited)} beta ".replace("  ", " ")
        found = [x for x in scanner.find(norm) if x[0] == "mit"]
        if distance(notice, norm) <= k:
            assert found and min(x[3] for x in found) >= distance(notice, norm), norm
        else:
            assert not found, norm


def test_long_text_of_notices_is_linear():
    import time

    scanner = licenses._scanner(tuple(sorted(licenses.NOTICES.items())))
    text = "Licensed under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy; words between. " * 8000
    began = time.process_time()
    row = next(licenses._scan(scanner, 1, text))
    assert len(row[-1]) == 16000 and row[2] == 8000 and row[6] == "mit"
    assert time.process_time() - began < 15


def test_repeated_rows(spark, docs_of):
    got = licenses.scan(docs_of([(1, "MIT License"), (1, "MIT License"), (None, None)])).collect()
    assert sorted(r["n_base"] for r in got) == [0, 1, 1]

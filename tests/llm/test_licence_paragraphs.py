"""Licence notices as they stand in files: wrapped, in comments, next to prose."""

import random
import re
import textwrap

import numpy as np
import pytest
from corpusmill.llm import licences

LONG = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts if len(t) > 120]


def test_wrapped_notices(spark):
    rows, want = [], {}
    for k, (family, text) in enumerate(LONG):
        for j, lead in enumerate(("", " * ", "# ", "// ", "dnl ")):
            body = "\n".join(lead + x for x in textwrap.wrap(text, 60))
            rows.append((10 * k + j, f"A tool for counting birds.\n{lead.rstrip()}\n{body}\n\nint main;"))
            want[10 * k + j] = family
    out = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.families for d, r in out.items()} == want
    assert {r.n_licence for r in out.values()} == {1}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_line_notice_within_prose(spark, end):
    prose = "The birds came back in the spring and stayed for a year."
    text = end.join([prose, "Released under the MIT License.", prose, "", prose])
    (r,) = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_paragraphs, r.n_licence, r.families) == (2, 1, "MIT")


def plain_scan(text, model):
    """n_paragraphs, n_signal, n_licence, families, top probability of a text, one paragraph after the other; no word gates what is classified."""
    leader, word = re.compile(licences.LEADER.replace("(?md)", "(?m)")), re.compile(licences.gate_pattern(model.gate), re.A)
    blocks = [b for b in re.split(licences.BREAK, leader.sub("", text or "")) if b.strip(" \t\r\n\x0b\x0c")]
    signal, names, top, n = 0, set(), None, 0
    for block in blocks:
        signal += bool(word.search(block))
        sure = []
        spdx = [x for ln in block.split("\n") if (m := re.search(licences.SPDX, ln)) for x in re.split(licences.OPERATOR, ln[m.end() :])]
        for part in {block, *block.split("\n"), *("SPDX-License-Identifier: " + x for x in spdx)}:
            grams = licences.ngrams(part)
            if not grams & set(model.weights):
                continue
            z = np.array(model.logits(grams))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            best = int(np.argmax(z))
            name, named = model.families[best], bool(grams & set(licences.NEEDS.get(model.families[best], ())))
            shares = [len(grams & shape) / len(shape) for f, shape in model.templates if f == best and (named or licences.told_by_itself(shape, name))]
            if name != licences.UNKNOWN and p[best] >= 0.5 and max(shares, default=0) >= 0.6 and not grams & set(licences.DENIALS) and not grams & set(licences.BARS.get(name, ())):
                sure.append((name, round(float(p[best]), 6)))
        if sure:
            n, names = n + 1, names | {f for f, _ in sure}
            top = max([top or 0, *(p for _, p in sure)])
    return len(blocks), signal, n, ",".join(sorted(names)), top


def test_scan_against_plain(spark, small):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    notices = [t for ts in licences.TEMPLATES.values() for t in ts] + licences.OTHERS
    for k in range(150):
        some = [" ".join(w for w in t.split() if rng.random() > 0.12 * (k % 4)) for t in rng.sample(notices, 3)]
        texts.append("\n\n".join("\n".join(rng.choice(("", " * ", "# ")) + x for x in textwrap.wrap(t, rng.choice((40, 70, 500)))) for t in some))
    texts += [None, "", "\n\n", "license", "license " * 20_000, "GNU General Public License", "This work is licensed under the GNU General Public License, version 4."]
    model = licences.train()
    out = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    for r in out:
        want = plain_scan(texts[r.doc_id], model)
        assert (r.n_paragraphs, r.n_signal, r.n_licence, r.families) == want[:4], texts[r.doc_id]
        assert (r.top_probability is None) == (want[4] is None) and abs((r.top_probability or 0) - (want[4] or 0)) < 1e-5
    assert {r.families for r in out if r.doc_id >= len(texts) - 7} == {""} and sum(r.n_licence for r in out) > 150


def test_families_on_paragraphs_held_out():
    """Variants of another seed: licences by their family, the unknown class as such, and probabilities that are true."""
    model, right, sure = licences.train(), [], []
    for grams, k in licences.examples(99):
        z = np.array(model.logits(grams))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        right.append(int(np.argmax(z)) == k)
        sure.append(p.max())
    assert np.mean(right) > 0.95 and abs(np.mean(right) - np.mean(sure)) < 0.03
    assert "unknown" == model.families[int(np.argmax(model.bias))]


def test_no_notice_denies_itself():
    notices = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    assert [t for f, t in notices if licences.ngrams(t) & {*licences.DENIALS, *licences.BARS.get(f, ())}] == []
    assert [t for f, t in notices if not licences.ngrams(t) & set(licences.NEEDS.get(f, ())) and len(licences.ngrams(t)) < licences.LONG and f not in ("MIT", "BSD", "Zlib", "Unlicense", "Apache-2.0")] == []


# Notices and near notices that the templates do not hold in these words, with the families they grant.
STRANGE = {
    "This text is under CC BY 4.0.": "CC-BY", "CC0 1.0 Universal": "CC0", "Apache-2.0": "Apache-2.0", "Published under the GNU GPL v3.": "GPL-3.0", "License: GPLv3": "GPL-3.0",
    "Attribution-ShareAlike 4.0": "", "Creative Commons Attribution-ShareAlike 4.0": "CC-BY-SA", "Creative Commons Attribution-NoDerivatives 4.0 International": "CC-BY-ND", "The text is available under CC BY-SA 4.0, the code is not.": "CC-BY-SA",
    "Licensed under the Business Source License 1.1": "BUSL-1.1", "This code is NOT licensed under the MIT License.": "", "It isn't licensed under the Apache License, Version 2.0.": "", "No longer licensed under the MIT License.": "",
    "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only": "LGPL", "// SPDX-License-Identifier: BSD-2-Clause": "BSD", "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "# SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)": "BSD,GPL-2.0",
    "All rights reserved for the King.": "", "Copyright 2019 Acme Inc. All rights reserved.": "Proprietary", "Licensed under the Green Field License.": "", "Released under the Foo Public License, version 3.": "", "This work is licensed under the GNU General Public License, version 4.": "",
    "Copyright (c) 2020 J. Doe. Licensed under the MIT license.": "MIT", "This program is licensed under the GNU Affero General Public License v3 (version 3).": "AGPL-3.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "CC-BY-NC-SA", "https://creativecommons.org/licenses/by/4.0/legalcode": "CC-BY",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)": "BSL-1.0", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below.": "OFL-1.1",
    "The museum licenses its pictures by hand, on version 2.0 of a form.": "", "Er kam mit dem Zug, und die Commons tagten.": "", "You need a fishing license and permission of the owner.": "",
}


def test_notices_from_elsewhere(spark):
    lines = list(STRANGE)
    model = licences.train()
    out = {lines[r.doc_id]: r for r in licences.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert {t: r.families for t, r in out.items() if r.families != STRANGE[t]} == {}
    assert {t: plain_scan(t, model)[3] for t in lines} == STRANGE


def test_gate_lets_all_pass_that_can_be_confirmed():
    """Random parts of templates: where enough of one is left to confirm it, a gate word is left too."""
    model, rng, n = licences.train(), random.Random(8), 0
    word = re.compile(licences.gate_pattern(model.gate), re.A)
    for _ in range(4000):
        f, shape = rng.choice(model.templates)
        text = rng.choice(licences.TEMPLATES[model.families[f]]).split()
        some = " ".join(w for w in text if rng.random() < rng.choice((0.5, 0.8, 0.95)))
        if word.search(some):
            continue
        n, grams = n + 1, licences.ngrams(some)
        named = grams & set(licences.NEEDS[model.families[f]])
        assert not any(len(grams & s) >= 0.6 * len(s) for k, s in model.templates if named or licences.told_by_itself(s, model.families[k]))
    assert n > 20

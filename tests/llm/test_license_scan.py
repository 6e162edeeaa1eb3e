import math
import re
from collections import Counter

from levelstream.llm import license_scan as L

APACHE = "Licensed under the Apache License, Version 2.0."
GPL = "This work is licensed under the GNU General Public License, version 3."


def brute(rows):
    """(license, score) of the best passage of each text, by loops over all windows that hold a licence word."""
    term = lambda t: re.findall(r"[^\W_]+(?:\.[^\W_]+)*", t.lower())
    wordings = [Counter(term(w)) for _, w in L.TEMPLATES]
    df = Counter(w for _, _, t in rows for w in set(term(t or "")))
    weight = lambda w: math.log(len(rows) / max(1, df[w])) + 1
    vector = lambda c: {w: k * weight(w) for w, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for doc, _, text in rows:
        words, found = term(text or ""), []
        for k, (c, (name, _)) in enumerate(zip(wordings, L.TEMPLATES, strict=True)):
            u, length = vector(c), sum(c.values())
            for start in range(0, len(words), max(1, length // 8)):
                window = words[start : start + length]
                if not any(re.search(L.ANCHOR, w) for w in window) or not c.keys() & set(L.NAMING) <= set(window):
                    continue
                v = vector(Counter(window))
                score = round(sum(x * u.get(w, 0) for w, x in v.items()) / norm(u) / norm(v), 9)
                if score >= L.SIMILAR:
                    found.append((len(window), score, -k, -start, name))
        near = [x for x in found if x[1] >= max(y[1] for y in found) - L.MARGIN]
        out[doc] = (max(near)[4], max(near)[1]) if near else None
    return out


def test_against_brute_force_and_inheritance(spark):
    prose = "the quick brown fox\nruns over the lazy dog\n" * 5
    rows = [
        (1, "a/LICENSE", prose + "\n" + APACHE), (2, "a/b/x.txt", prose), (3, "a/b/COPYING", GPL), (4, "a/b/c/d/y.txt", prose), (5, "other/z.txt", prose), (6, "a/b/c/own.txt", prose + "\nReleased under the MIT License.\n" + prose),
        (7, None, APACHE), (8, "top.txt", None), (9, "a/empty", ""), (10, "other/w.txt", "a licence to print money was once said to be held"),
    ]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, license string")).collect()}
    for doc, want in brute(rows).items():
        if want:
            assert (got[doc].license, got[doc].origin) == (want[0], "own") and abs(got[doc].score - want[1]) < 1e-8, doc
        else:
            assert got[doc].origin in (None, "inherited")
    assert {d: (r.license, r.origin) for d, r in got.items()} == {
        1: ("Apache-2.0", "own"), 2: ("GPL-3.0", "inherited"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"), 5: (None, None), 6: ("MIT", "own"), 7: ("Apache-2.0", "own"), 8: (None, None), 9: ("Apache-2.0", "inherited"), 10: (None, None),
    }


def test_long_line_and_edges(spark):
    line = "word " * 300 + APACHE + " word" * 300
    rows = [(1, "p/q", line), (1, "p/q", line), (None, None, None)]
    got = sorted((r.doc_id or 0, r.license or "") for r in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert [g[0] for g in got] == [0, 1, 1]
    assert L.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_statements_within_lines_and_over_line_breaks(spark):
    rest = "one may print and bind and sell or lend what one likes where nobody minds it much"
    rows = [
        (1, "a/1", "word " * 300 + APACHE + " word" * 300, "Apache-2.0"), (2, "b/2", "Copyright 2020 Jane Roe of Somewhere. All rights reserved.", "Proprietary"),
        (3, "c/3", "This project is licensed under the MIT License - see the file for details", "MIT"), (4, "d/4", f"{rest} Licensed under the Apache License, Version 2.0 (the License); {rest}", "Apache-2.0"),
        (5, "e/5", f"GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n{rest}", "GPL-2.0"), (6, "f/6", f"Apache License\nVersion 2.0, January 2004\n{rest}", "Apache-2.0"),
        (7, "g/7", f"{rest}\nThis work is licensed under the GNU\nGeneral Public License,\nversion 3 {rest}", "GPL-3.0"), (8, "h/8", rest, None), (9, "i/9", f"{rest} All rights\nreserved. {rest}", "Proprietary"),
    ]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")).collect()}
    assert {d: r.license for d, r in got.items()} == {r[0]: r[3] for r in rows}
    assert all(got[d].score > 0.99 for d in (1, 2, 3, 4, 5, 7, 9))


def test_names_headings_identifiers_and_whole_texts(spark):
    prose = "one may print and bind and sell or lend what one likes where nobody minds it much " * 3
    whole = {name: max((w for n, w in L.TEMPLATES if n == name), key=len) for name, _ in L.TEMPLATES}
    rows = [
        ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("# SPDX-License-Identifier: GPL-2.0-only\nx = 1", "GPL-2.0"), ("// SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0"),
        ("Mozilla Public License Version 2.0", "MPL-2.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
        (whole["ISC"].split(", provided")[0], "ISC"), (whole["BSD-2-Clause"], "BSD-2-Clause"), (whole["BSD-3-Clause"], "BSD-3-Clause"), (whole["MIT"], "MIT"), (whole["Zlib"], "Zlib"),
        ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"), ("Released under the Foo License", None), ("All rights reserved.", "Proprietary"),
        ("GNU Lesser General Public License version 2.1", "LGPL-2.1"), ("This file is GPL-3.0 licensed", "GPL-3.0"), ("mit Lizenz und ohne Permission", None),
    ]
    made = [(i, f"d{i}/f", t if i % 2 else f"{t}\n{prose}") for i, (t, _) in enumerate(rows)] + [(100 + i, None, prose) for i in range(20)]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(made, "doc_id long, path string, text string")).collect()}
    assert {i: got[i].license for i in range(len(rows))} == {i: want for i, (_, want) in enumerate(rows)}
    for doc, want in brute(made).items():
        if want and got[doc].score < 1:
            assert (got[doc].license, got[doc].origin) == (want[0], "own") and abs(got[doc].score - want[1]) < 1e-8, doc


def test_every_wording_is_known_within_prose_and_unlike_ones_are_not(spark):
    prose = "one may print and bind and sell or lend what one likes where nobody minds it much " * 3
    rows = [
        ("License: GPL v2 or later", "GPL-2.0"), ("Eclipse Public License - v1.0", "EPL-1.0"), ("Artistic License 2.0", "Artistic-2.0"), ("SIL Open Font License, Version 1.1", "OFL-1.1"), ("under the CDDL 1.1", "CDDL-1.1"),
        ("this is under the WTFPL", "WTFPL"), ("Licensed under CC BY 3.0", "CC-BY-3.0"), ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"), ("GPLv3+ code", "GPL-3.0"), ("EPL-2.0", "EPL-2.0"),
        ("SPDX-License-Identifier: (GPL-2.0-only OR MIT)", "GPL-2.0 OR MIT"), ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\nimport x", "Apache-2.0 WITH LLVM-exception"), ("SPDX-License-Identifier: MIT. Next", "MIT"),
        ("all rights reserved to the teacher in this school", None), ("this code is not licensed under the MIT License", None), ("It is not released under the Apache License, Version 2.0 today", None), ("a simple story of a license to drive", None),
        ("This License explicitly affirms your unlimited permission to run the unmodified Program. The output from running a covered work is covered by this License only if the output, given its content, constitutes a covered work.", "GPL-3.0"),
    ] + [(w, n) for n, w in L.TEMPLATES]
    assert len({n for n, _ in L.TEMPLATES}) > 60
    made = [(i, f"d{i}/f", f"{prose}\n{t}\n{prose}") for i, (t, _) in enumerate(rows)] + [(10**6 + i, None, f"{prose} {i}") for i in range(200)]
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame(made, "doc_id long, path string, text string")).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(rows) if got[i] != rows[i][1]} == {}


def test_short_statement_speaks_for_no_folder(spark):
    rows = [(1, "a/x", "Licensed under the MIT License."), (2, "a/y", "prose"), (3, "b/LICENSE", "Licensed under the MIT License."), (4, "b/y", "prose"), (5, "c/x", "this is not licensed under the MIT License at all"), (6, "c/y", "prose")]
    got = {r.doc_id: (r.license, r.origin) for r in L.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: (None, None), 3: ("MIT", "own"), 4: ("MIT", "inherited"), 5: (None, None), 6: (None, None)}

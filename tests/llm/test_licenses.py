import re

from broodline.llm import licenses

TEXTS = {
    1: "Some prose here.\nLicensed under the Apache License, Version 2.0.", 2: "nothing at all", 3: None, 4: "",
    5: "It is. released under the MIT licence! Released under the MIT License.", 6: "Released under the MIT License",
    7: "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", 8: "x " * 5000,
    9: "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.\nReleased under the MIT License.",
    10: "This work is licensed under the GNU General Public License, version 2.",
}


def brute(text):
    found = []
    for segment in re.split(licenses.SEGMENT_END, (text or "").lower()):
        pairs = set(licenses.pairs_of(segment))
        best = []
        for name, notices in licenses.TEMPLATES.items():
            for t in notices:
                want = set(licenses.pairs_of(t))
                both = len(pairs & want)
                if pairs and 200 * both >= 80 * (len(pairs) + len(want)):
                    best.append((-2 * both / (len(pairs) + len(want)), name))
        found += sorted(best)[:1]
    top = min(found) if found else (0.0, None)
    return len(found), ",".join(sorted({n for _, n in found})), top[1], round(-top[0], 6)


def test_matches_brute_force(spark, clashing, empty):
    rows = [*TEXTS.items(), (1, TEXTS[1])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute(TEXTS[r.doc_id]), r
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(clashing).count() == clashing.count()


def test_plan_has_no_python_and_no_shuffle(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)


def wrapped(text, width):
    words, lines = text.split(), [""]
    for w in words:
        if len(lines[-1]) + len(w) > width:
            lines.append("")
        lines[-1] += w + " "
    return "\n".join(lines)


def test_notices_and_bodies_across_lines_and_in_sentences(spark):
    mit, isc, two, three = (licenses.BODIES[n][0] for n in ("mit", "isc", "bsd-2-clause", "bsd-3-clause"))
    gnu = licenses.BODIES["gpl-3.0"]
    rows = {
        1: (mit, 1, "mit"), 2: (wrapped(mit, 70), 1, "mit"), 3: ("Copyright A. B.\n\n" + wrapped(isc, 70), 1, "isc"),
        4: (wrapped(two, 70), 1, "bsd-2-clause"), 5: (wrapped(three, 60), 1, "bsd-3-clause"),
        6: (wrapped(" ".join(gnu), 70), 2, "gpl-3.0"),
        7: ("This tool is released under the MIT License.", 1, "mit"),
        8: ("The photographs in this article are licensed under CC BY-SA 4.0.", 1, "cc-by-sa-4.0"),
        9: ("Some prose. This work is licensed\nunder the GNU General Public\nLicense, version 3. More prose.", 1, "gpl-3.0"),
        10: (f"Released under the MIT License.\n{wrapped(mit, 70)}\nAll rights\nreserved.", 3, "mit,proprietary"),
        11: ("Permission is hereby granted to any person who asks, and the software is free of charge.", 0, ""),
        12: ("of the software " * 3000 + wrapped(mit, 50) + " under the terms" * 3000, 1, "mit"),
        13: ("Released under the MIT\nLicense. " * 200, 200, "mit"),
    }
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, *_) in rows.items()], "doc_id long, text string"))
    for r in got.collect():
        assert (r.n_matches, r.licences) == rows[r.doc_id][1:], r
        assert r.dice == (1.0 if r.n_matches else 0.0), r

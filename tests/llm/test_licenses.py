import re

from tracewell.llm import licenses

DDL = "doc_id long, text string, row long, id string, gram long"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = sorted((i, label) for label, p in licenses.BASE for n in [len(p.split())] for i in range(len(words)) if words[i : i + n] == p.split())
    return len(words), hits


TEXTS = [
    None,
    "",
    "Licensed under CC BY-NC 4.0.",
    "ALL RIGHTS, reserved! all rights reserved",
    "This work is licensed under the GNU General Public License, version 3.",
    "general public general public license license",
    "cc  éby cc,by",
    "cc",
    "x " * 30_000 + "cc by " * 2000 + "All rights reserved",
    "licensed under the new apache license version 2.0",
    "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files",
    "Straße ÀÉ all rights ÀÉ reserved",
]


def test_against_brute_force(spark):
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None, None, None), (None, "cc by", None, None, None)]
    got = licenses.scan(spark.createDataFrame(rows, DDL)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hits = brute("cc by" if r.doc_id is None else TEXTS[r.doc_id])
        assert r.n_words == n and sorted((s["first"], s["label"]) for s in r.spans if s["exact"]) == hits, r.doc_id
    labels = {r.doc_id: {s["label"] for s in r.spans} for r in got}
    assert labels[9] == {"apache-2.0"} and "mit" in labels[10] and labels[4] == {"gpl", "gpl-3.0"} and labels[11] == set()
    assert licenses.scan(spark.createDataFrame([], DDL)).count() == 0

import pytest

from tracewell.llm import licenses
from tracewell.llm.queries import op6_licenses

DDL = "doc_id long, text string"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: text, and all labels that it has
CASES = [
    ("Licensed under CC BY 4.0.", {"cc-by", "cc-by-4.0"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by", "cc-by-nc"}),
    ("CC BY-SA 4.0", {"cc-by"}),
    ("Licensed under CC BY-SA 4.0", {"cc-by", "cc-by-sa"}),
    ("licensed under CC BY-ND 4.0", {"cc-by", "cc-by-nd"}),
    ("licensed under CC BY-NC-SA 4.0", {"cc-by", "cc-by-nc-sa"}),
    ("licensed under CC BY-NC-ND 4.0", {"cc-by", "cc-by-nc-nd"}),
    ("licensed under CC BY-NC 3.0", {"cc-by"}),
    ("licensed under CC BY-XX 4.0", {"cc-by"}),
    ("licensed under cc by", {"cc-by"}),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", {"cc-by-nc"}),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc-by-4.0"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa"}),
    ("Licensed under the GNU General Public License, version 3", {"gpl", "gpl-3.0"}),
    ("Licensed under the GNU General Public License, version 2", {"gpl", "gpl-2.0"}),
    ("Licensed under the GNU Lesser General Public License, version 3", {"gpl", "lgpl-3.0"}),
    ("Licensed under the GNU Affero General Public License, version 3", {"gpl", "agpl-3.0"}),
    (GPL.format(3), {"gpl", "gpl-3.0"}),
    (GPL.format(2), {"gpl", "gpl-2.0"}),
    (GPL.format(1), {"gpl"}),
    ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
    ("Licensed under the Apache License, Version 1.1", set()),
    (MIT, {"mit"}),
    (MIT.replace("obtaining", "who is obtaining"), {"mit"}),
    (MIT + ". All rights reserved.", {"mit", "reserved"}),
    ("Released under the MIT License.", {"mit"}),
    (" ".join(sorted(MIT.split())), set()),
    ("public license general", set()),
    ("", set()),
    (None, set()),
]


@pytest.fixture(scope="module")
def labels(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(100 + i, "word " * 3000 + (t or "") + " word" * 3000) for i, (t, _) in enumerate(CASES)], DDL)
    return {r.doc_id: {s["label"] for s in r.spans} for r in licenses.scan(docs).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_full_label_sets(labels, case):
    assert labels[case] == CASES[case][1]
    assert labels[100 + case] == CASES[case][1]


def test_no_free_label_for_restricted_texts(spark):
    found = op6_licenses(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    restricted = found.where("lower(text) like '%by-nc%' or lower(text) like '%by-sa%'")
    assert restricted.count() > 0
    free = restricted.where("array_contains(split(labels, ','), 'cc-by-4.0') and not regexp_like(lower(text), 'cc by 4')")
    assert free.count() == 0

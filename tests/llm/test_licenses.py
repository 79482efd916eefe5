import re

from wardspark.llm import licenses as L

from .conftest import HARD

SAMPLE = "/root/testdata/sf0.01"
PROSE = ["Ofhaoued that heingth eaha inea thhaeain it thatea.", "Tiorble ndlyen eslyen, under the table of it."] * 30


def scan(docs):
    return {(r.doc_id, r.paragraph): r for r in L.scan_licenses(docs).collect()}


def test_notices_and_prose(make_docs):
    texts = [
        "Some text here.\nReleased under the MIT License.\nMore text.", "Licensed under CC BY-NC 4.0.", "LICENSED UNDER CC BY 4.0",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
        "All rights reserved.", "It is licensed under the terms of a contract.", "The general public was under the bridge.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Permission is hereby granted free of charge to any person obtaining a copy of this software",
        *HARD, *PROSE,
    ]
    got = scan(make_docs(texts, extra=True))
    found = {k: r.family for k, r in got.items() if r.confirmed}
    assert found == {
        (0, 1): "mit", (1, 0): "cc-by-nc", (2, 0): "cc-by", (3, 0): "gpl", (4, 0): "apache", (8, 0): "bsd", (9, 0): "mit",
    }
    assert all(0.5 <= r.probability <= 1 and 0 <= r.notice_share <= 1 for r in got.values())


MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    'the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and '
    'to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
)
GPL = (
    'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public '
    'License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any '
    'later version.'
)
BSD = (
    'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
    'following conditions are met:'
)


def test_wrapped_notices(make_docs):
    """Notices as they stand in files: wrapped, in comments, between other paragraphs."""
    import textwrap

    def wrapped(text, lead="", width=76, end="\n"):
        return end.join(lead + line for line in textwrap.wrap(text, width))

    texts, want = [], {}
    for lead in ("", "# ", " * ", "// ", "   "):
        for family, text in (("mit", MIT), ("gpl", GPL), ("bsd", BSD)):
            end = "\r\n" if lead == "// " else "\n"
            want[len(texts)] = family
            texts.append(end.join(["Some prose before.", lead.rstrip(), wrapped(text, lead, 76, end), lead.rstrip(), "And after it."]))
    texts += ["Copies of the software\nare sold by any person\nwithout a licence", *PROSE]
    got = scan(make_docs(texts))
    assert {k[0]: r.family for k, r in got.items() if r.confirmed} == want
    assert all(k[1] > 0 for k in got)


def test_given_documents_against_a_search(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    got = {(k[0], r.family) for k, r in scan(docs).items() if r.confirmed}
    names = {"mit": "the MIT License", "apache": "the Apache License", "gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC"}
    want = {
        (r.doc_id, f) for r in docs.select("doc_id", "text").collect() for f, n in names.items()
        if re.search(rf"(?i)licensed? under [^\n]*{n}|released under {n}", r.text or "")
    }
    assert want and got == want


def test_repeats_nulls_empty(make_docs):
    rows = [(None, "Released under the MIT License", None)] * 2 + [(5, "Released under the MIT License", None)] * 2
    got = L.scan_licenses(make_docs(rows + [(9 + i, t, None) for i, t in enumerate(PROSE)])).collect()
    assert sorted((r.doc_id or 0, r.family) for r in got) == [(0, "mit"), (5, "mit")]
    assert L.scan_licenses(make_docs([])).collect() == []

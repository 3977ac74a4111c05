import re

from corpuskit.llm import license_sentences as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""


def test_rules_in_order(spark):
    rows = [
        (1, f"Intro.\n{MIT}\nReleased under the MIT License."),
        (2, "x. Licensed under the Apache License, Version 2.0.\nNoise here. You may not use this file except in compliance with the License. End"),
        (3, "Licensed under CC BY-NC 4.0.\nLICENSED  UNDER cc-by-nc 4.0!"),
        (4, "This work is licensed under the GNU General Public License, version 3. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        (5, None),
        (6, "nothing"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS left0")
    got = {r.doc_id: (r.licenses, r.unmatched) for r in L.scan(docs).collect()}
    assert got == {1: ("MIT", 0), 2: ("Apache-2.0", 0), 3: ("CC-BY-NC-4.0", 0), 4: ("GPL-3.0-only", 1), 5: ("", 0), 6: ("", 0)}
    ids = {r.doc_id: r.sentence_ids for r in L.scan(docs).collect()}
    assert ids[1] == "mit-grant,mit-condition,mit-notice" and ids[3] == "cc-by-nc-4.0-notice,cc-by-nc-4.0-notice"


# Published notices as they are wrapped in files.
WRAPPED = {
    "Apache-2.0": '''# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law''',
    "MIT": '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL''',
    "BSD-2-Clause": '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
''',
    "GPL-3.0-or-later": '''    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.''',
    "ISC": '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.''',
    "MPL-2.0": '''/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */''',
    "Unlicense": "This is free and unencumbered software released into\nthe public domain.\n\nAnyone is free",
    "CC-BY-4.0": "This work is licensed under a Creative Commons\r\nAttribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under\nCC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under\nCC BY-ND 4.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General\nPublic License, version 3.",
    "GPL-2.0-only": "Licensed under the GNU General\nPublic License, version 2.",
    "Proprietary": "(c) Somebody. All rights\nreserved.",
}
WRAPPED["BSD-3-Clause"] = WRAPPED["BSD-2-Clause"] + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
WRAPPED["GPL-2.0-or-later"] = WRAPPED["GPL-3.0-or-later"].replace("software:", "software;").replace("version 3", "version 2").replace("program.  If", "program; if")


def test_published_texts_as_they_are_wrapped(spark):
    assert set(WRAPPED) == {name for name, _ in L.RULES}
    for wrap in ("\n", "\r\n", "\n// "):
        docs = spark.createDataFrame([(i, "Some project\n\n" + text.replace("\n", wrap), name) for i, (name, text) in enumerate(WRAPPED.items())], "doc_id long, text string, name string")
        got = {r.doc_id: (r.licenses, r.unmatched) for r in L.scan(docs).collect()}
        assert got == {i: (name, 0) for i, name in enumerate(WRAPPED)}


def test_words_run_on_is_no_sentence(spark):
    docs = spark.createDataFrame([(1, "It is not licensed under CC BY 4.0 at all.\nAll rights reserved by law")], "doc_id long, text string")
    assert L.scan(docs).first().sentence_ids == ""


def test_consumed_runs_do_not_meet(spark):
    docs = spark.createDataFrame([(1, "one. two. one. three")], "doc_id long, text string")
    got = L.scan(docs, {"one": "1", "two": "2", "three": "3"}, [("A", ["2", "1"]), ("B", ["1", "3"])]).first()
    assert (got.licenses, got.unmatched) == ("A", 2)


def test_odd_documents(spark, odd_docs, no_docs):
    assert L.scan(odd_docs).count() == 9 and L.scan(no_docs).count() == 0
    assert not re.search("Python|Arrow|Exchange", L.scan(odd_docs)._jdf.queryExecution().toString())

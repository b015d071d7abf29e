"""Every known sentence as its licence writes it, and texts beyond any limit."""

import re

from lorekeep.llm import license_table as table
from lorekeep.llm import licenses

TEXTS = [(name, s) for name, all_ in table.TEXTS.items() for s in all_]


def scan(spark, rows):
    return licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()


def test_every_sentence_is_found_in_its_usual_form(spark):
    ends = ("", ".", ".\n\nOther words follow. And more.", ". Next", ":\n")
    rows = [(n, f"{s}{end}") for n, s in TEXTS for end in ends]
    # in lines, as headers are set, with comment marks
    rows += [(n, "\n".join(f"// {x}" for x in re.findall(r".{1,60}(?:\s|$)", s)) + ".\nint main;\n") for n, s in TEXTS]
    got = scan(spark, rows)
    assert all(any(a in s.lower() for a in licenses.ANCHORS) for _, s in TEXTS)
    # a line of a wrapped sentence may be a notice of its own
    assert [(r.doc_id, r.sentence_ids) for r in got if r.doc_id not in r.sentence_ids.split(",") or r.sentence_ids.count(r.doc_id) > 1] == []


def test_every_name_is_found_in_notices_and_tags(spark):
    assert len(table.NAMES) >= 70
    rows = []
    for licence, names in table.NAMES.items():
        for name in names:
            the = "" if name.startswith("The ") else "the "
            rows += [(licence, f"This project is licensed under {the}{name}."), (licence, f"Some words.\nReleased under {the}{name}.\nMore words"), (licence, f"License: {name}\n"), (licence, f"It is distributed under the terms of {the}{name}. Then text")]
        rows += [(licence, f"# SPDX-License-Identifier: {licence}\nimport os\n"), (licence, f"SPDX-License-Identifier: {licence}")]
    got = scan(spark, rows)
    assert [(r.doc_id, r.licenses, r.sentence_ids) for r in got if (r.licenses, r.sentence_ids, r.n_sentences) != (r.doc_id, r.doc_id, 1)] == []


def test_rules_need_their_order(spark):
    one = {n: all_[0] for n, all_ in table.TEXTS.items()}
    rows = [(licence, ". ".join(one[i] for i in ids) + ".") for licence, ids in table.ORDERED]
    got = scan(spark, rows)
    assert all(r.doc_id in r.licenses.split(",") for r in got)
    back = [(licence, ". ".join(one[i] for i in reversed(ids)) + ".") for licence, ids in table.ORDERED if len(ids) > 1]
    assert all(r.doc_id not in r.licenses.split(",") for r in scan(spark, back))


def test_decoration_of_any_length_changes_nothing(spark):
    grant, condition = table.TEXTS["mit-grant"][0], table.TEXTS["mit-condition"][0]
    stars = "*" * 3000
    rows = [("MIT", f"{stars}\n" + grant.replace(" ", "  ***  " * 9) + f":\n{stars}\n" + condition.replace(" ", " " * 50) + f".{stars}"), ("MIT", "\n".join(f" * {x}" for x in grant.split()) + f":\n *\n * {condition}."), ("", "x" * 50_000 + " software. " + "y " * 50_000)]
    assert [(r.doc_id, r.licenses) for r in scan(spark, rows)] == [(n, n) for n, _ in rows]


def test_a_line_that_is_its_sentence_counts_once(spark):
    rows = [("1", "Released under the MIT License\n"), ("2", "Released under the MIT License\nReleased under the MIT License"), ("3", "\nAll rights reserved\n\nAll rights reserved.")]
    assert [(r.doc_id, str(r.n_sentences)) for r in scan(spark, rows)] == [("1", "1"), ("2", "2"), ("3", "2")]


MIT = """MIT License

Copyright (c) 2020 Ada Example. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2021, The Example Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
APACHE = """/*
 * Copyright 2019 Example Inc. All Rights Reserved.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */
"""
WTFPL = """            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
                    Version 2, December 2004

 Everyone is permitted to copy and distribute verbatim or modified
 copies of this license document, and changing it is allowed as long
 as the name is changed.

            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
   TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

  0. You just DO WHAT THE FUCK YOU WANT TO.
"""


def test_whole_licence_texts(spark):
    rows = [("MIT", MIT), ("BSD-2-Clause", BSD + BSD_END), ("BSD-3-Clause", BSD + BSD_NAME + BSD_END), ("Apache-2.0", APACHE), ("WTFPL", WTFPL), ("proprietary", "Copyright 2022 Example Inc. All rights reserved.\nDo not copy."), ("WTFPL", "It is licensed under the Do What The Fuck You Want To Public License.")]
    assert [(r.doc_id, r.licenses) for r in scan(spark, rows)] == [(n, n) for n, _ in rows]

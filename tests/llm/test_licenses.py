from tests.llm.common import LONG, empty_documents, frame, odd_documents
from wordframe.llm import licenses as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions. The above copyright notice and this permission notice shall be
 * included in all copies or substantial portions of the Software. """


def scan(spark, texts):
    return [r for r in L.scanned(frame(spark, texts)).orderBy("doc_id").collect()]


def test_sequences_and_rules(spark):
    rows = scan(spark, ["Foo bar. Released under the MIT License. Baz. All rights reserved.", MIT,
                        "Licensed%%% under&&& the$$$ Apache,### License,*** Version### 2.0.***", "LICENSED!! UNDER!! CC!! BY-NC!! 4.0.",
                        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
                        "released under the mit licenses of old", "x\nReleased under the MIT License\nY"])
    assert [r["licenses"] for r in rows] == ["MIT,Proprietary", "MIT", "Apache-2.0", "CC-BY-NC-4.0", "", "", "MIT"]
    assert rows[0]["sequence"] == "<-><MitRef><-><AllRights>" or rows[0]["sequence"].count("<MitRef>") == 1
    assert rows[1]["sequence"] == "<MitGrant><MitNotice>" and rows[4]["n_left"] == 1 and rows[5]["n_known"] == 0


def test_a_longer_rule_wins(spark):
    by_id = {i: s for s, i in L.SENTENCES.items()}
    text = ". ".join(by_id[i] for i in ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")) + ". "
    short = ". ".join(by_id[i] for i in ("BsdGrant", "BsdSource", "BsdBinary")) + ". "
    rows = scan(spark, [text, short, text + " Words between. " + short])
    assert [r["licenses"] for r in rows] == ["BSD-3-Clause", "BSD-2-Clause", "BSD-3-Clause,BSD-2-Clause"]


GPL = """{c}Copyright (C) 2020  A. Author
{c}
{c}This program is free software; you can redistribute it and/or modify
{c}it under the terms of the GNU General Public License as published by
{c}the Free Software Foundation; either version {v} of the License, or
{c}(at your option) any later version.
{c}
{c}This program is distributed in the hope that it will be useful,
{c}but WITHOUT ANY WARRANTY; without even the implied warranty of
{c}MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{c}GNU General Public License for more details.
{c}
{c}You should have received a copy of the GNU General Public License along
{c}with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD = """Copyright 2020 A. Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{e}
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
{e}
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
{e}
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.

"""
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
WHOLE_MIT = """MIT License

Copyright (c) 2020 A. Author

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
APACHE = """# Copyright 2020 A. Author
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def test_wrapped_canonical_texts(spark):
    gpl = [GPL.format(c=c, v=v) for c in ("", " * ", "# ") for v in (2, 3)] + [
        GPL.format(c="", v=3).replace("Author\n\n", "Author\n").replace("\n", "\r\n")]
    bsd = [BSD.replace("{e}\n", e) + third + DISCLAIMER for e in ("\n", "") for third in ("", THIRD)]
    bsd += [bsd[1].replace("1. ", "  (1) ").replace("2. ", "  (2) ").replace("3. ", "  (3) ")]
    rows = scan(spark, [*gpl, *bsd, WHOLE_MIT, APACHE])
    assert [r["licenses"] for r in rows] == ["GPL-2.0-or-later", "GPL-3.0-or-later"] * 3 + ["GPL-3.0-or-later"] + [
        "BSD-2-Clause", "BSD-3-Clause"] * 2 + ["BSD-3-Clause", "MIT", "Apache-2.0"]
    assert [r["n_known"] for r in rows] == [4] * 7 + [3, 4, 3, 4, 4, 4, 4] and all(r["n_left"] == 0 for r in rows)


def test_every_rule_uses_known_identifiers():
    assert {s for _, rule in L.RULES for s in rule} <= set(L.SENTENCES.values())


def test_odd_and_empty_tables(spark):
    odd = L.scanned(odd_documents(spark)).toPandas()
    assert len(odd) == 12 and (odd.licenses == "").all() and odd.n_sentences.min() == 0
    assert odd[odd.text.isna()].sequence.tolist() == [""]
    assert scan(spark, [LONG + ". Released under the MIT License."])[0]["licenses"] == "MIT"
    assert L.scanned(empty_documents(spark)).count() == 0

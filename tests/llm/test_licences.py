"""Licence notices as they are laid out in files."""

import pytest

from threadloom.llm import licenses

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_and_commented_notices(spark, mark):
    texts = ["\n".join(mark + line for line in t.split("\n")) for t in (GPL, APACHE)]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.sentence, r.sentences) for r in rows) == [(0, "GPL-3.0-or-later", 0, 3), (1, "Apache-2.0", 0, 4)]


def test_common_licences(spark):
    wanted = ["BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-or-later", "GPL-2.0-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "Unlicense", "EPL-2.0", "BSL-1.0", "Zlib", "CC0-1.0"]
    rules = [next(ids for name, ids in licenses.RULES if name == x) for x in wanted]
    texts = [".\n".join(licenses.SENTENCES[i] for i in ids) + "." for ids in rules] + ["// SPDX-License-Identifier: LGPL-2.1-only"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.license for r in sorted(rows, key=lambda r: r.doc_id)] == [*wanted, "LGPL-2.1-only"]

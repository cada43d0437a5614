import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import licenses


def slow(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({label for _, label in places}))


TEXTS = [None, "", "CC BY cc-by CC,BY. ccby", "all rights reserved all rights reserved", "GNU General Public License, all  rights\nreserved", "cc by cc by cc by", "É all rights reserved é", "x\x7fy_z cc\u00a0by", "general public general public license"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_places(text):
    assert licenses.scan(text)[:5] == slow(text)


@pytest.mark.parametrize(
    "text,postfix",
    [
        ("MIT", ["mit"]), ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]), ("(MIT OR Apache-2.0) AND ISC", ["mit", "apache-2.0", "or", "isc", "and"]),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"]), ("MIT OR", ["mit"]), ("(MIT", None), ("", None), ("OR MIT", None), ("MIT trailing words", ["mit"]), ("MIT)", ["mit"]),
    ],
)
def test_expressions(text, postfix):
    assert licenses.parse(text) == postfix


def test_tags_are_evaluated():
    labels = lambda t: licenses.scan(t)[5]
    assert labels("// SPDX-License-Identifier: GPL-2.0-only OR MIT\nx") == "mit"
    assert labels("SPDX-License-Identifier: LGPL-2.1 AND Apache-2.0") == "apache,lgpl"
    assert labels("This is under the MIT License and CC BY-NC 4.0") == "cc-by,cc-by-nc,mit"


def test_long_expressions_are_read_whole():
    labels = lambda t: licenses.scan(t)[5]
    many = " AND ".join(["MIT"] * 400)
    assert labels(f"SPDX-License-Identifier: {many} AND MPL-2.0\nAND GPL-2.0") == "mit,mpl"
    assert labels(f"SPDX-License-Identifier: ({many} AND GPL-2.0) more words") == "gpl,mit"
    assert labels("SPDX-License-Identifier:" + " " * 1500 + "MIT") == "mit"


def test_odd_rows(odd, empty):
    rows = licenses.scanned(odd).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 and r["n_words"] == slow(r["text"])[0] for r in rows)
    assert licenses.scanned(empty).count() == 0
    clash = odd.select("*", *[F.lit("mine").alias(c) for c in ("labels", "Score", "scan", "_l")])
    assert licenses.scanned(clash).columns == [*odd.columns, "scan", "_l", *licenses.FIELDS]


def test_many_tags_are_each_read_once():
    import time

    one = "SPDX-License-Identifier:mit and "
    begun = time.monotonic()
    assert licenses.scan(one * 30_000)[5] == "mit" and time.monotonic() - begun < 10
    assert set(licenses.scan(one * 3 + "License-Expression: (gpl-2.0 or apache-2.0) with x and")[5].split(",")) == {"mit", "apache"}

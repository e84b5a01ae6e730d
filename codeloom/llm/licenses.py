"""License scans by canonical digest lookup.

Texts are brought to a canonical form: lower case, equivalent spellings, copyright lines
and punctuation removed, white space folded. The digest of the whole canonical text is
hash-joined with the digests of known licences. The same lookup serves each line of a
document for notices that a text carries inside.

Defined cases: null, empty and wholly removed texts match nothing; texts of any length are
digested whole; several known texts of one digest name the first in code point order; rows
repeat as they come; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spellings that count as the same, in canonical form.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("centre", "center"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("non-infringement", "noninfringement"), ("per cent", "percent"),
    ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

#: Texts of known licences and of the notices by which works refer to them.
KNOWN = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)
#: Licences whose whole texts the folder ``known`` holds, with the lines of their titles.
WHOLE = (
    ("Apache-2.0", 3), ("Artistic-1.0-Perl", 1), ("BSD-2-Clause", 0), ("BSD-3-Clause", 0), ("CC0-1.0", 2), ("GFDL-1.2", 2), ("GFDL-1.3", 2), ("GPL-1.0", 2), ("GPL-2.0", 2),
    ("GPL-3.0", 2), ("LGPL-2.0", 2), ("LGPL-2.1", 2), ("LGPL-3.0", 2), ("MPL-1.1", 2), ("MPL-2.0", 2), ("Unlicense", 0), ("Zlib", 0),
)
#: Usual titles of texts that have none of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License", "The BSD License"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
}
#: What follows the last line of this in a text tells how to apply the licence and may be left out.
END = "END OF TERMS AND CONDITIONS"


BULLET = re.compile(r"^\s*(?:[*-]|\d\.)\s+(?=Redistributions|Neither)")


def _listed(lines: list[str]) -> list[list[str]]:
    """The lines with the conditions of a BSD licence numbered and not numbered."""
    n = iter(range(1, len(lines) + 1))
    plain = [BULLET.sub("", x) for x in lines]
    return [lines] if plain == lines else [plain, [f"{next(n)}. {y}" if x != y else x for x, y in zip(lines, plain)]]


def _forms(name: str, text: str, titles: int = 0) -> list[str]:
    """A text with and without its title, other usual titles, its appendix and numbers, and with either scheme of web addresses."""
    lines = [x for x in text.split("\n") if x.strip()]
    bodies = _listed(lines[titles:])
    ends = [i for i, x in enumerate(bodies[0]) if x.strip() == END]
    bodies += [b for i in ends for b in (bodies[0][: i + 1], bodies[0][:i])]
    heads = [[], *([lines[:titles]] if titles else []), *([t] for t in TITLES.get(name, ()))]
    forms = ["\n".join([*h, *b]) for h in heads for b in bodies]
    return list(dict.fromkeys(x for f in forms for x in (f, f.replace("http://", "https://"), f.replace("https://", "http://"))))


def _whole_texts() -> tuple:
    """(name, kind, text) of each form of each known whole text."""
    read = [(name, pkgutil.get_data(__package__, f"known/{name}.txt").decode("utf-8"), titles) for name, titles in WHOLE]
    short = [(name, text, 0) for name, kind, text in KNOWN if kind == "text"]
    return tuple((name, "text", form) for name, text, titles in short + read for form in _forms(name, text, titles))


KNOWN += _whole_texts()
#: Rows of a table of known texts that may be broadcast.
MAX_KNOWN = 100_000

#: A line that only says whose the rights are.
COPYRIGHT_LINE = re.compile(r"^[^a-z0-9]*(?:copyright\b(?!\s+(?:holder|owner|notice|law|licen))|\(c\)|©)|^[^a-z0-9]*all rights reserved[^a-z0-9]*$")
WORDS = re.compile(r"[^\W_]+")
_SINGLE = {a: b for a, b in SPELLINGS if " " not in a and "-" not in a}
_SEVERAL = [(f" {' '.join(WORDS.findall(a))} ", f" {b} ") for a, b in SPELLINGS if " " in a or "-" in a]


def _spelled(words: list[str]) -> str:
    return " ".join([_SINGLE.get(w, w) for w in words])


def _joined(line: str) -> str:
    """Spellings of several words, which can't be told word by word."""
    out = f" {line} "
    for a, b in _SEVERAL:
        while a in out:
            out = out.replace(a, b)
    return out.strip()


def canonical_lines(text: str | None) -> list[str]:
    """Canonical form of each line that has one."""
    out = []
    for line in (text or "").lower().split("\n"):
        if not COPYRIGHT_LINE.search(line) and (words := WORDS.findall(line)):
            out.append(_spelled(words))
    return out


def canonical(text: str | None) -> str:
    """The canonical form of a whole text."""
    return _joined(" ".join(canonical_lines(text)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def known_digests(known=KNOWN) -> dict[str, tuple[str, str]]:
    """(license, kind) of the digest of each known canonical text."""
    if len(known) > MAX_KNOWN:
        raise ValueError("too many known texts to broadcast")
    out: dict[str, tuple[str, str]] = {}
    for name, kind, text in known:
        d = digest(canonical(text))
        out[d] = min(out.get(d, (name, kind)), (name, kind))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN) -> DataFrame:
    """Each row with the digest of its whole canonical text, the licence of that digest, and those that its lines name."""
    table = known_digests(known)
    names = {d: k[0] for d, k in table.items()}

    def run(batches):
        for batch in batches:
            whole, lines = [], []
            for text in batch.column(1):
                parts = canonical_lines(text.as_py())
                c = _joined(" ".join(parts))
                whole.append(digest(c) if c else None)
                lines.append(sorted({names[d] for p in parts if (d := digest(_joined(p))) in names}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.string()), pa.array(lines, pa.list_(pa.string()))], names=["id", "digest", "line_licenses"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    rows = picked.mapInArrow(run, f"id {picked.schema[0].dataType.simpleString()}, digest string, line_licenses array<string>")
    # a fixed list with a checked bound
    digests = docs.sparkSession.createDataFrame([(d, *k) for d, k in table.items()], "digest string, license string, kind string")
    found = rows.join(F.broadcast(digests), "digest", "left")
    return found.select(F.col("id").alias(id_col), "digest", "license", "kind", "line_licenses")


def oracle(known=KNOWN) -> str:
    """The scan of ``documents`` as DuckDB SQL, with line licences joined by commas."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    words = lambda x: f"list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    single = "CASE w " + " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in _SINGLE.items()) + " ELSE w END"
    joined = "' ' || c || ' '"
    for a, b in _SEVERAL:
        joined = f"replace(replace({joined}, {text(a)}, {text(b)}), {text(a)}, {text(b)})"
    known_rows = ", ".join(f"({text(d)}, {text(n)}, {text(k)})" for d, (n, k) in known_digests(known).items())
    gone = "(regexp_matches(l, '^[^a-z0-9]*(copyright|\\(c\\)|©)') AND NOT regexp_matches(l, '^[^a-z0-9]*copyright([a-z0-9_]|\\s+(holder|owner|notice|law|licen))')) OR regexp_matches(l, '^[^a-z0-9]*all rights reserved[^a-z0-9]*$')"
    return f"""
WITH known(digest, license, kind) AS (VALUES {known_rows}),
lines AS (SELECT rid, doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS l, generate_subscripts(string_split(lower(coalesce(text, '')), chr(10)), 1) AS i FROM (SELECT row_number() OVER () AS rid, * FROM documents)),
words AS (SELECT rid, doc_id, i, array_to_string(list_transform({words("l")}, lambda w: {single}), ' ') AS c FROM lines WHERE NOT ({gone})),
canon AS (SELECT rid, i, trim({joined}) AS c FROM words WHERE c <> ''),
named AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM canon JOIN known ON sha256(c) = digest GROUP BY rid),
whole AS (SELECT rid, trim({joined}) AS w FROM (SELECT rid, string_agg(c, ' ' ORDER BY i) AS c FROM words WHERE c <> '' GROUP BY rid))
SELECT d.doc_id, sha256(w) AS digest, license, kind, coalesce(line_licenses, '') AS line_licenses
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d LEFT JOIN whole USING (rid) LEFT JOIN named USING (rid) LEFT JOIN known ON known.digest = sha256(w)"""

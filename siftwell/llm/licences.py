"""Licence scans by canonical digest.

A text is brought to a canonical form - case, punctuation and copyright lines gone,
equivalent spellings made one - and the digest of the whole form is hash-joined to
the digests of known licences. Single lines that are a known notice are told too.

Published files differ in more than that: a text that has no known digest is looked up
again by its body, the canonical form without titles, rights-reserved lines and list
numbers. Full texts of further licences are in ``licence_texts``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import prepare, utf8

#: Spellings that count as one.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "http": "https", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
LICENCES = {
    "MIT": f"MIT License\n\nCopyright (c) <year> <holders>\n\n{_MIT}",
    "MIT-body": _MIT,
    "ISC": f"{_ZERO}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}",
    "0BSD": f"{_ZERO}.\n\n{_ISC_END}",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:MIT": "Released under the MIT License.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:spdx-MIT": "SPDX-License-Identifier: MIT",
    "notice:spdx-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
}

#: Licences with a file of their full text.
TEXTS = Path(__file__).parent / "licence_texts"
#: Lines that a text may open with, or lack, in canonical form.
TITLES = {
    "mit license", "the mit license", "the mit license mit", "mit license mit", "expat license", "isc license", "the isc license", "isc license isc", "the isc license isc", "internet systems consortium license",
    "bsd zero clause license", "zero clause bsd", "zero clause bsd license", "0bsd", "bsd license", "the bsd license", "new bsd license", "modified bsd license", "revised bsd license", "simplified bsd license", "freebsd license",
    "bsd 2 clause license", "bsd 2 clause simplified license", "the 2 clause bsd license", "2 clause bsd license", "the bsd 2 clause license", "bsd 3 clause license", "the bsd 3 clause license", "bsd 3 clause new or revised license",
    "the 3 clause bsd license", "3 clause bsd license", "apache license", "the apache license", "version 2 0 january 2004", "apache license version 2 0 january 2004", "apache license version 2 0", "https www apache org licenses",
    "gnu general public license", "gnu library general public license", "gnu lesser general public license", "gnu free documentation license", "version 1 february 1989", "version 2 june 1991", "version 2 1 february 1999",
    "version 3 29 june 2007", "version 1 2 november 2002", "version 1 3 3 november 2008", "mozilla public license", "mozilla public license version 1 1", "mozilla public license version 2 0", "mozilla public license 2 0", "the unlicense", "unlicense",
    "creative commons legal code", "cc0 1 0 universal", "creative commons zero v1 0 universal", "attribution sharealike 4 0 international", "creative commons attribution sharealike 4 0 international",
    "boost software license version 1 0 august 17th 2003", "boost software license version 1 0", "sil open font license", "sil open font license version 1 1 26 february 2007", "version 1 1 26 february 2007", "zlib license", "the zlib license", "zlib libpng license",
}
#: Where an appendix on applying a licence starts, which many copies leave out.
_APPENDIX = {
    "GPL-1.0": "Appendix: How to Apply These", "GPL-2.0": "How to Apply These", "GPL-3.0": "How to Apply These", "LGPL-2.0": "How to Apply These", "LGPL-2.1": "How to Apply These", "Apache-2.0": "APPENDIX: How to apply",
    "Unlicense": "For more information", "GFDL-1.2": "ADDENDUM:", "GFDL-1.3": "ADDENDUM:", "MPL-2.0": "Exhibit A - Source Code Form License Notice", "MPL-1.1": "EXHIBIT A -",
}
_END = "END OF TERMS AND CONDITIONS"
_NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"), "MIT": ("Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",), "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",), "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",), "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",), "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public",), "CC-BY-4.0": ("Licensed under CC BY 4.0.",), "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",), "CC0-1.0": ("Released under CC0 1.0.",),
}
_SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-2.0 OFL-1.1 Unlicense Zlib"


def full_texts() -> dict[str, list[str]]:
    """The texts of each licence looked up by body: with and without its appendix."""
    out = {name: [text] for name, text in LICENCES.items() if not name.startswith("notice:") and name != "MIT-body"}
    for file in sorted(TEXTS.glob("*.txt")):
        text = file.read_text("utf-8")
        name = file.stem.split("~")[0]  # name~layout: another published layout
        forms = out.setdefault(name, [])
        forms.append(text)
        mark = _APPENDIX.get(name)
        if mark and mark in text:
            terms = text[: text.rindex(mark)]
            forms += [terms, terms.rstrip().removesuffix(_END)]
    return out


def all_notices() -> dict[str, str]:
    """Lines that are a known notice, by name; several lines may have one name."""
    lines = {canonical(f"SPDX-License-Identifier: {x}"): f"notice:spdx-{x}" for x in _SPDX.split()}
    lines |= {canonical(t): f"notice:{name}" for name, texts in _NOTICES.items() for t in texts}
    return lines | {canonical(t): n for n, t in sorted(LICENCES.items(), reverse=True) if n.startswith("notice:")}


#: Typographic characters that separate words as ASCII punctuation does.
_MARKS = " ©«­®»‐-‧‰-⁞"
_WORD = f"[^\\x00-/:-`{{-\\x7f{_MARKS}]+"
_WORDS = re.compile(_WORD)
_COPYRIGHT = "^[^a-z©]*(copyright|©|c\\))( |\\t|:|\\(|[0-9]|$)"
_IS_COPYRIGHT = re.compile(_COPYRIGHT)


def canonical_lines(text: str) -> list[str]:
    """The canonical form of each line that is left; ``text`` has no A-Z any more."""
    out, get = [], EQUIVALENT.get
    for line in text.split("\n"):
        if _IS_COPYRIGHT.match(line):
            continue
        words = _WORDS.findall(line)
        if words:
            out.append(" ".join([get(w, w) for w in words]))
    return out


_NUMBER = re.compile("^[ \\t]*[(]?[0-9]{1,2}[.)](?=[ \\t\\r]|$)")
#: A line that starts with the word copyright but goes on as a sentence does.
_SENTENCE = re.compile("^[ \\t]*copyright[ \\t]+(holders?|owners?|notices?|laws?|licen[cs]es?|and|or|of|in|on|the|interests?|statements?|disclaimers?|permission|treaty|status|rights?)\\b")
_RESERVED = re.compile("^all rights reserved(?: |$)")
_ADDRESS = re.compile("^(51 franklin st|59 temple place|675 mass ave)")
_PARTIES = (
    (re.compile("neither the name of .{1,120}? nor the names of its contributors"), "neither the name of the copyright holder nor the names of its contributors"),
    (re.compile("this software is provided by .{1,120}? as is and any express"), "this software is provided by the copyright holders and contributors as is and any express"),
    (re.compile("in no event shall .{1,120}? be liable for any direct indirect"), "in no event shall the copyright holder or contributors be liable for any direct indirect"),
)


def body(lower: str) -> str:
    """The form by which published files are looked up; ``lower`` has no A-Z any more."""
    out, get = [], EQUIVALENT.get
    for line in lower.split("\n"):
        if _IS_COPYRIGHT.match(line) and not _SENTENCE.match(line):
            continue
        form = " ".join([get(w, w) for w in _WORDS.findall(_NUMBER.sub("", line))])
        if form and form not in TITLES and not _RESERVED.match(form) and not _ADDRESS.match(form):
            out.append(form)
    whole = " ".join(out)
    if "redistribution and use in source" in whole:
        for pattern, usual in _PARTIES:
            whole = pattern.sub(usual, whole)
    return whole


def bodies(texts: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(digest, licence) of known bodies; equal ones keep the first name in order."""
    out: dict[str, str] = {}
    for name, forms in sorted(texts.items()):
        for text in forms:
            out.setdefault(digest(body(_lower(text))), name)
    return sorted(out.items())


def _lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "replace")


def canonical(text: str) -> str:
    return " ".join(canonical_lines(_lower(text)))


def digest(form: str) -> str:
    return hashlib.sha256(form.encode("utf-8", "replace")).hexdigest()


def known(texts: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(digest, licence) of known texts; equal forms keep the first name in order."""
    out: dict[str, str] = {}
    for name, text in sorted((texts or LICENCES).items()):
        out.setdefault(digest(canonical(text)), name)
    return sorted(out.items())


def _scan(notices: dict[str, str]):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, told, cores = [], [], []
            for text in batch.column(1).to_pylist():
                lower = text.lower().decode("utf-8", "replace")
                lines = canonical_lines(lower)
                cores.append(digest(body(lower)))
                digests.append(digest(" ".join(lines)))
                told.append(",".join(sorted({notices[x] for x in lines if x in notices})))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array(told), pa.array(cores)], names=["doc_id", "text_digest", "notices", "body_digest"])

    return scanned


def scan(spark: SparkSession, docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: digest of the whole canonical form,
    the licence with that digest, else with that of its body (null: none known), and
    known notices among its lines. ``texts`` replace the known texts and notices.

    Null, empty and wordless texts have the digest of nothing and no licence; repeated
    rows stay repeated; other columns are ignored; no rows give no rows.
    """
    prepare(spark)
    notices = {canonical(t): n for n, t in sorted(texts.items(), reverse=True) if n.startswith("notice:")} if texts else all_notices()
    full = {n: [t] for n, t in texts.items() if not n.startswith("notice:")} if texts else full_texts()
    table = spark.createDataFrame(known(texts), "text_digest string, _whole string")
    cores = spark.createDataFrame(bodies(full), "body_digest string, _body string")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    scanned = raw.mapInArrow(_scan(notices), "doc_id long, text_digest string, notices string, body_digest string")
    met = scanned.join(F.broadcast(table), "text_digest", "left").join(F.broadcast(cores), "body_digest", "left")
    return met.select("doc_id", "text_digest", F.coalesce("_whole", "_body").alias("licence"), "notices")


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in sorted(EQUIVALENT.items()))
    digests = ", ".join(f"('{d}', '{n}')" for d, n in known())
    notices = ", ".join(f"('{canonical(t)}', '{n}')" for n, t in sorted(LICENCES.items()) if n.startswith("notice:"))
    word = f"[^\\x00-/:-`{{-\\x7f{_MARKS}]+"
    return f"""
WITH k(text_digest, licence) AS (VALUES {digests}), nt(form, notice) AS (VALUES {notices}),
l AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), '{upper}', '{lower}'), chr(10)), lambda x: NOT regexp_matches(x, '{_COPYRIGHT}')) ls FROM documents),
c AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: array_to_string(list_transform(regexp_extract_all(x, '{word}'), lambda w: coalesce(MAP {{{pairs}}}[w], w)), ' ')), lambda x: x <> '') ls FROM l),
n AS (SELECT doc_id, string_agg(DISTINCT notice, ',' ORDER BY notice) notices FROM (SELECT doc_id, unnest(ls) form FROM c) JOIN nt USING (form) GROUP BY doc_id)
SELECT c.doc_id, sha256(array_to_string(ls, ' ')) text_digest, licence, coalesce(notices, '') notices
FROM c LEFT JOIN n ON c.doc_id = n.doc_id LEFT JOIN k ON k.text_digest = sha256(array_to_string(ls, ' '))"""

"""License scans by canonical digest lookup.

A text and a known licence are the same if they agree after: ASCII lower case; copyright
and all-rights-reserved lines out; every run of ASCII punctuation and space to one space;
equivalent spellings to one. The SHA-256 digests of that form are hash-joined with the
digests of the known licences. Units are a document's entire text and each entire line of
it (licence notices stand on lines of their own).

The catalogue has a fixed size, so it is broadcast. Word counts survive the spelling step
(one word for one word) and phrases change them by what a licence has of them, so units
whose count no licence can have are dropped before these steps.

Defined results: a null or empty text has no unit that matches; repeated rows are counted
once each in `n_units`; rows with a null id are reported under the null id.
"""

from __future__ import annotations

import hashlib
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that count as the same word, from the licence matching guidelines in public use.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}

# Phrases that count as another, after the spellings.
PHRASES = {"sub license": "sublicense", "sub licenses": "sublicenses", "sub licensed": "sublicensed", "sub licensing": "sublicensing", "non commercial": "noncommercial", "per cent": "percent", "copyright owner": "copyright holder", "copyright owners": "copyright holders"}

# Permissive licences, by their public identifiers.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = {
    "MIT": "MIT License\n\nCopyright (c) <year> <holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS + "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "ISC License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + _BSD_START + _BSD_END,
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END,
    "Zlib": "zlib License\n\nCopyright (c) <year> <holder>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n" + _AS_IS.replace("AND ", "", 1).replace("PURPOSE AND ", "PURPOSE, ") + "TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS + "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
}

# Title lines that the texts above also have; none is one of them.
TITLES = {
    "MIT": ["", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero-Clause License (0BSD)"],
    "BSD-2-Clause": ["", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "Zlib": ["", "The zlib License", "zlib License (Zlib)"],
    "BSL-1.0": ["", "Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}

# Titles that the texts in files may lack, the last line of terms, and addresses inside them.
FULL_TITLES = {
    "Apache-2.0": r"\s*Apache License\s+Version 2\.0, January 2004\s+https?://www\.apache\.org/licenses/\s*",
    "GPL-2.0": r"\s*GNU GENERAL PUBLIC LICENSE\s+Version 2, June 1991\s*", "GPL-3.0": r"\s*GNU GENERAL PUBLIC LICENSE\s+Version 3, 29 June 2007\s*",
    "LGPL-3.0": r"\s*GNU LESSER GENERAL PUBLIC LICENSE\s+Version 3, 29 June 2007\s*",
    "MPL-2.0": r"\s*Mozilla Public License,? [Vv]ersion 2\.0\s+=*\s*", "CC0-1.0": r"\s*Creative Commons Legal Code\s*",
}
TERMS_END = r"END OF TERMS AND CONDITIONS"
LATER_ADDRESS = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
EARLIER_ADDRESSES = ["59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA"]

# The names under which notices speak of a licence.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
    **{f"CC-{k}-{v}": [f"CC {k} {v}", f"CC-{k}-{v}"] for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "3.0", "4.0")},
}
#: Notices are every start with every name; "the" may stand between.
STARTS = ["Licensed under", "This work is licensed under", "This software is licensed under", "This project is licensed under", "Released under", "Distributed under", "Available under", "Published under", "SPDX-License-Identifier:"]

LINES = r"^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|©|<|\[|[0-9]{4}|by )|\(c\)|©|all rights reserved)[^\n]*$"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def squeezed(text: Column) -> Column:
    """All of the canonical form but the spellings."""
    lower = F.translate(text, _UPPER, _SMALL)
    return F.trim(F.regexp_replace(F.regexp_replace(lower, f"(?md){LINES}", ""), BETWEEN, " "))


def respelled(canonical: Column, spellings: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in (spellings or SPELLINGS).items() for x in pair])
    words = F.array_join(F.transform(F.split(canonical, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    # every word gets spaces of its own, so that phrases may follow one another
    apart = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in PHRASES.items():
        apart = F.replace(apart, F.lit(_apart(a)), F.lit(_apart(b)))
    return F.trim(F.replace(apart, F.lit("  "), F.lit(" ")))


def _apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def _squeezed_here(text: str) -> str:
    lower = text.translate(str.maketrans(_UPPER, _SMALL))
    return re.sub(BETWEEN, " ", re.sub(f"(?m){LINES}", "", lower)).strip(" ")


def canonical_here(text: str) -> str:
    """The canonical form of one known licence, for the catalogue."""
    out = _apart(" ".join(SPELLINGS.get(w, w) for w in _squeezed_here(text).split(" ")))
    for a, b in PHRASES.items():
        out = out.replace(_apart(a), _apart(b))
    return out.replace("  ", " ").strip(" ")


def _word_counts(canonical: str) -> set[int]:
    """The numbers of words that units of this canonical form may have before phrases are replaced."""
    words = canonical.split(" ")
    longer = [b for a, b in PHRASES.items() if a.count(" ") > b.count(" ")]
    return {len(words) + k for k in range(sum(w in longer for w in words) + 1)}


def _resource_texts() -> dict[str, str]:
    """The full texts that are shipped as files beside this module."""
    folder = resources.files(__package__) / "license_texts"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def text_variants() -> list[tuple[str, str]]:
    """(licence, text): every full text with its usual titles and none, addresses, and with or without what follows its terms."""
    out = []
    for k, text in TEXTS.items():
        title, rest = text.split("\n", 1)
        out += [(k, text), *((k, f"{t}\n{text if k == 'Unlicense' else rest}") for t in TITLES[k])]
    out += [(k, t.replace("and/or distribute", "and distribute")) for k, t in out if k == "ISC"]
    for k, text in _resource_texts().items():
        end = re.search(TERMS_END, text)
        forms = [text, text[: end.end()], text[: end.start()]] if end else [text]
        forms += [t[m.end() :] for t in forms for m in [re.match(FULL_TITLES.get(k, r"(?!)"), t)] if m]
        forms += [t.replace(LATER_ADDRESS, a) for t in forms if LATER_ADDRESS in t for a in EARLIER_ADDRESSES]
        out += [(k, re.sub("https?://", scheme, t)) for t in forms for scheme in ("http://", "https://")] + [(k, t) for t in forms]
    return list(dict.fromkeys(out))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the catalogue: full texts and notices."""
    notices = [(k, f"{start} {the}{name}") for k, names in NAMES.items() for name in names for start in STARTS for the in ("", "the ")]
    return [*text_variants(), *notices]


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, n_words, digest); its size is that of the fixed catalogue."""
    rows = sorted({(k, len(c.split(" ")), hashlib.sha256(c.encode()).hexdigest()) for k, t in texts or known_texts() if (c := canonical_here(t))})
    return spark.createDataFrame(rows, "license_id string, n_words int, digest string")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, scope, license_id, n_units): the entire texts (scope 'text') and entire lines ('line') that are a known licence."""
    known = known_digests(docs.sparkSession, texts)
    lengths = sorted({n for _, t in texts or known_texts() for n in _word_counts(canonical_here(t))})
    body = F.col(text_col)
    units = docs.where(body.isNotNull()).select(
        F.col(id_col).alias("id"),
        F.explode(F.concat(F.array(F.struct(F.lit("text").alias("scope"), body.alias("unit"))), F.transform(F.split(body, "\n"), lambda x: F.struct(F.lit("line").alias("scope"), x.alias("unit"))))).alias("u"),
    )
    shaped = units.select("id", "u.scope", squeezed(F.col("u.unit")).alias("squeezed")).where(
        (F.col("squeezed") != "") & (F.length("squeezed") - F.length(F.translate("squeezed", " ", "")) + 1).isin(lengths)
    )
    hashed = shaped.select("id", "scope", F.sha2(respelled(F.col("squeezed")), 256).alias("digest"))
    return hashed.join(F.broadcast(known), "digest").groupBy("id", "scope", "license_id").agg(F.count(F.lit(1)).alias("n_units"))

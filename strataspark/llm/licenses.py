"""Licence scans by sentence rules.

A text's sentences are normalised and mapped to the identifiers of known licence sentences; the sequence of
identifiers is then matched against ordered rules, each a licence and the identifiers it consists of. The first rule
that fits at a place wins, so longer rules stand before their beginnings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

_REF = r"(?:(?:this|the) [a-z ,]+ (?:is|are) )?(?:made |dual[- ])?(?:licen[sc]ed|released|distributed|available|provided) (?:to you )?under (?:the terms (?:and conditions )?of )?(?:an? |the |version )*"
_TAIL = r"(?: \((?:the )?[a-z -]*licen[sc]e\)| \([a-z0-9. -]+\))?(?:[,;:] .*| \(see .*| see .*)?"
_ITEM_HEAD = r"(?:\d\. |- )?"
_VERSION = r",? (?:version |v\.? ?)?"
#: Identifier and pattern of a normalised sentence: lower case, no comment signs, single spaces, without the full stop
#: at its end. Groups are parts of the licence's name: x, v (a version) and o (or later).
SENTENCES = (
    ("spdx", r"spdx-license-identifier: ?(?P<x>[a-z0-9.+() -]+?)"),
    ("apache-ref", rf"{_REF}apache (?:software )?licen[sc]e{_VERSION}(?P<v>[12](?:\.[01])?){_TAIL}"),
    ("apache-comply", r"you may not use this file except in compliance with the license"),
    ("apache-obtain", r"you may obtain a copy of the license at(?: https?://\S+)?"),
    ("apache-basis", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-ref", rf"{_REF}(?:mit|expat) licen[sc]e(?: \(mit\))?{_TAIL}"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit-notice", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", r"the software is provided as is, without warranty of any kind.*"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim.*"),
    ("bsl-ref", rf"{_REF}boost software licen[sc]e(?:{_VERSION}1\.0)?{_TAIL}"),
    ("bsl-title", r"boost software licen[sc]e - version 1\.0(?: - .*)?"),
    ("bsl-grant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("bsl-notice", r"the copyright notices in the software and this entire statement, including the above license grant.*must be included in all copies of the software.*"),
    ("bsl-liability", r"in no event shall the copyright holders or anyone distributing the software be liable for any damages.*"),
    ("isc-ref", rf"{_REF}isc licen[sc]e{_TAIL}"),
    ("isc-grant", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that.*"),
    ("0bsd-grant", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-warranty", r"the software is provided as is and the author disclaims all warranties.*"),
    ("isc-liability", r"in no event shall the author be liable for any special, direct, indirect, or consequential damages.*"),
    ("bsd-ref", rf"{_REF}(?:(?P<v>[0234])[- ]clause )?bsd licen[sc]e{_TAIL}"),
    ("bsd-ref", rf"{_REF}bsd (?P<v>[0234])[- ]clause licen[sc]e{_TAIL}"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification, are permitted.*"),
    ("bsd-source", rf"{_ITEM_HEAD}redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", rf"{_ITEM_HEAD}redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-advert", rf"{_ITEM_HEAD}all advertising materials mentioning features or use of this software must display.*"),
    ("bsd-endorse", rf"{_ITEM_HEAD}neither the names? of .* may be used to endorse or promote products.*"),
    ("bsd-warranty", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("bsd-liability", r"in no event shall .* be liable for any direct, indirect, incidental.*"),
    ("zlib-ref", rf"{_REF}zlib(?:/libpng)? licen[sc]e{_TAIL}"),
    ("zlib-warranty", r"this software is provided as-is, without any express or implied warranty"),
    ("zlib-liability", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib-origin", rf"{_ITEM_HEAD}the origin of this software must not be misrepresented; .*"),
    ("zlib-credit", r"if you use this software in a product, an acknowledge?ment in the product documentation would be appreciated but is not required"),
    ("zlib-altered", rf"{_ITEM_HEAD}altered source versions must be plainly marked as such, .*"),
    ("zlib-notice", rf"{_ITEM_HEAD}this notice may not be removed or altered from any source distribution"),
    ("gnu-ref", rf"{_REF}gnu (?P<x>(?:lesser |library |affero )?general public) licen[sc]e(?:{_VERSION}(?P<v>[123](?:\.[01])?))?(?: only)?(?P<o>,? or (?:\(at your option\) )?(?:any )?later(?: version)?|\+)?{_TAIL}"),
    ("gnu-ref", rf"{_REF}(?P<x>[al]?gpl)[- ]?v?(?P<v>[123](?:\.[01])?)(?P<o>,? or later|\+)?{_TAIL}"),
    ("gnu-free", r"(?:this program|this library|.* ) ?is free software[;:] you can redistribute it and/or modify it under the terms of the gnu (?P<x>(?:lesser |library |affero )?general public) license as published by the free software foundation(?:[;,] (?:either )?version (?P<v>[123](?:\.[01])?) of the license)?(?P<o>,? or \(at your option\) any later version)?.*"),
    ("gnu-hope", r"(?:this program|this library|.* ) ?is distributed in the hope that it will be useful, but without any warranty.*"),
    ("gnu-see", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("gnu-copy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license.*"),
    ("mpl-ref", rf"(?:{_REF}mozilla public licen[sc]e|this source code form is subject to the terms of the mozilla public license){_VERSION}(?P<v>[12]\.[01]){_TAIL}"),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file, you can obtain one at.*"),
    ("epl-ref", rf"(?:{_REF})?eclipse public licen[sc]e{_VERSION}(?P<v>[12]\.0){_TAIL}"),
    ("epl-made", rf"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e{_VERSION}(?P<v>[12]\.0).*"),
    ("cddl-ref", rf"{_REF}common development and distribution licen[sc]e{_VERSION}(?P<v>1\.[01]){_TAIL}"),
    ("artistic-ref", rf"{_REF}artistic licen[sc]e{_VERSION}(?P<v>[12]\.0){_TAIL}"),
    ("eupl-ref", rf"{_REF}(?:european union public licen[sc]e|eupl){_VERSION}(?P<v>1\.[12]){_TAIL}"),
    ("ofl-ref", rf"(?:this font software is licensed under the |{_REF})sil open font licen[sc]e{_VERSION}(?P<v>1\.[01]){_TAIL}"),
    ("psf-ref", rf"{_REF}python software foundation licen[sc]e(?:{_VERSION}2)?{_TAIL}"),
    ("cc-ref", rf"(?:(?:this|the) [a-z ]+ (?:is|are) )?(?:licensed|released|distributed|available) under (?:a |the )?(?:cc|creative commons) (?P<x>by(?:-nc)?(?:-sa|-nd)?|zero|0)(?: (?:(?P<v>[1234]\.0)|license|international))*{_TAIL}"),
    ("cc0-waived", r"to the extent possible under law, .* has waived all copyright and related or neighboring rights to .*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-free", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.*"),
    ("wtfpl", r"do what the fuck you want to public license(?:,? version 2)?"),
)
#: Licence (SPDX identifiers; LicenseRef- where the text names no version) and its identifiers; {x} stands for the name
#: that the first sentence's parts make. First fit wins, so longer rules stand before their beginnings.
RULES = (
    ("{x}", ("apache-ref", "apache-comply", "apache-obtain", "apache-basis", "apache-see")),
    ("{x}", ("apache-ref", "apache-comply")),
    ("{x}", ("apache-ref",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT-0", ("mit-grant", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-ref",)),
    ("BSL-1.0", ("bsl-title", "bsl-grant", "bsl-notice", "mit-warranty", "bsl-liability")),
    ("BSL-1.0", ("bsl-grant", "bsl-notice", "mit-warranty", "bsl-liability")),
    ("BSL-1.0", ("bsl-grant", "bsl-notice", "mit-warranty")),
    ("BSL-1.0", ("bsl-title",)),
    ("BSL-1.0", ("bsl-ref",)),
    ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-ref",)),
    ("0BSD", ("0bsd-grant", "isc-warranty", "isc-liability")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("{x}", ("bsd-ref",)),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-credit", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-ref",)),
    ("{x}", ("gnu-free", "gnu-hope", "gnu-see", "gnu-copy")),
    ("{x}", ("gnu-free", "gnu-hope", "gnu-see")),
    ("{x}", ("gnu-free",)),
    ("{x}", ("gnu-ref",)),
    ("{x}", ("mpl-ref", "mpl-copy")),
    ("{x}", ("mpl-ref",)),
    ("{x}", ("epl-made",)),
    ("{x}", ("epl-ref",)),
    ("{x}", ("cddl-ref",)),
    ("{x}", ("artistic-ref",)),
    ("{x}", ("eupl-ref",)),
    ("{x}", ("ofl-ref",)),
    ("PSF-2.0", ("psf-ref",)),
    ("{x}", ("cc-ref",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("Unlicense", ("unlicense", "unlicense-free")),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    ("{x}", ("spdx",)),
    ("{x}", ("notice",)),
)
_PATTERNS = tuple((k, re.compile(p)) for k, p in SENTENCES)
_BY_FIRST: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _name, _rule in RULES:
    _BY_FIRST.setdefault(_rule[0], []).append((_name, _rule))
_V = r"(?:,? ?(?:version |v\.? ?|-)?(?P<v>\d(?:\.\d)?)(?![\w.]*\w))?"
_LICENCE = r"(?: (?:public )?licen[sc]es?)?"
#: Names of licences in notices, after "the" and such words: SPDX prefix and pattern; v is a version, o: or later.
_NAMED = tuple((k, re.compile(p + r"(?![\w-])")) for k, p in (
    ("MIT", rf"(?:mit|expat)(?:/x11)?{_LICENCE}(?: \(mit\))?"),
    ("Apache", rf"(?:apache|asl)(?: software)?{_LICENCE}{_V}{_LICENCE}"),
    ("GPL", rf"(?:gnu )?(?P<x>[al]?gpl)(?:[- ]?(?:version |v\.? ?)?(?P<v>\d(?:\.\d)?))?(?:-only)?(?P<o>\+|,? or (?:\(at your option\) )?(?:any )?later(?: version)?|-or-later)?{_LICENCE}"),
    ("GPL", rf"gnu (?P<x>(?:lesser |library |affero )?general public) licen[sc]e{_V}(?:-only)?(?P<o>\+|,? or (?:\(at your option\) )?(?:any )?later(?: version)?|-or-later)?"),
    ("BSD", rf"(?:(?:the )?(?P<v>[0234])[- ]clause )?bsd{_LICENCE}"),
    ("BSD", rf"bsd[- ](?P<v>[0234])(?:[- ]clause)?{_LICENCE}"),
    ("ISC", rf"isc{_LICENCE}"),
    ("Zlib", rf"zlib(?:/libpng)?{_LICENCE}"),
    ("BSL-1.0", rf"(?:boost software licen[sc]e|bsl){_V}{_LICENCE}"),
    ("MPL", rf"(?:mozilla public licen[sc]e|mpl){_V}{_LICENCE}"),
    ("EPL", rf"(?:eclipse public licen[sc]e|epl){_V}{_LICENCE}"),
    ("EUPL", rf"(?:european union public licen[sc]e|eupl){_V}{_LICENCE}"),
    ("Unlicense", r"unlicen[sc]e(?: licen[sc]e)?"),
    ("WTFPL", rf"wtfpl{_LICENCE}"),
    ("CC0-1.0", rf"(?:creative commons (?:cc0|zero)|cc0|cc zero)(?:[ -]1\.0)?(?: universal)?{_LICENCE}"),
    ("CC", rf"(?:creative commons|cc)[ -](?P<x>(?:attribution|by)(?:[ -](?:noncommercial|nc))?(?:[ -](?:sharealike|share alike|sa|noderivatives|noderivs|nd))?){_V}(?: international| unported)?{_LICENCE}"),
))
_CC_PARTS = {"attribution": "BY", "by": "BY", "noncommercial": "NC", "nc": "NC", "share": "SA", "sharealike": "SA", "sa": "SA", "noderivatives": "ND", "noderivs": "ND", "nd": "ND"}
#: What leads to names in a notice, and what may stand between two of them.
_LEADS = re.compile(r"\b(?:licen[sc]ed|released|distributed|available|provided|published) (?:to you )?under (?:(?:either|both|any)(?: of)? )?(?:the terms (?:and conditions )?of (?:either )?)?|\blicen[sc]e(?: is)?: ?|\b(?:uses?|carries|has|is|are|both|under) (?=.{1,80}[- ]licen[sc]e)")
_AND = re.compile(r",? (?:and|or|and/or) (?:under )?|, ?(?:and/or )?| ?/ ?")
_THE = re.compile(r"(?:(?:a|an|the|version|terms|of) )*")
_DENIED = re.compile(r"\b(?:not|never|isnt|arent|wasnt|longer|formerly|previously|unless|if)\b[^,;]*$")
#: A text without any of these, or cc or a gpl as a word, has no known sentence: each pattern has one. They are single words or
#: parts of one, so that a line break can't stand within.
_HINTS = ("licen", "permission", "redistribut", "warrant", "liab", "mpl", "public", "advertising", "endorse", "commons", "gpl", "eupl", "misrepresented", "acknowledg", "altered", "waived", "free", "wtfpl", "cc0", "epl")
_CC = re.compile(r"\bcc\b")
_LEADERS = re.compile(r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|\(\*)?[ \t]*")
_ENDS = re.compile(r"(?<=[.!?;])\s+(?=[A-Z(\d*-])|(?<=:)(?<![Ii]dentifier:)(?<!IDENTIFIER:)\s+(?=[(\d*-])|(?<=:)(?<![Ii]dentifier:)(?<!IDENTIFIER:)[ \t]*\n\s*(?=[A-Z])|\n\s*\n")
#: The number, letter or sign of a list item.
_ITEM = re.compile(r"\(?(?:\d{1,2}|[a-z])[.)]|[-*•]")


def normalised(sentence: str) -> str:
    """Lower case, single spaces, without quotes and the full stop at its end."""
    return " ".join(re.sub(r"[\"'`“”‘’]", "", sentence.lower()).split()).rstrip(".!;: ")


def sentence_ids(text: str | None) -> list[tuple[str, str]]:
    """(identifier, variable part) of each known sentence of text, in order; other sentences are (\"\", \"\"), notices have one for each name."""
    if not _hinted((text or "").lower()):
        return []
    out = []
    for paragraph in re.split(r"\n\s*\n", _LEADERS.sub("", text)):
        # a paragraph is read as running text first; lines that stand alone are tried each where that finds nothing
        for run in _ENDS.split(paragraph):
            if _ITEM.fullmatch(run.strip().lower()):
                continue
            found = _known(run)
            if found is None and "\n" in run:
                for line in run.split("\n"):
                    out += _known(line) or [("", "")]
            else:
                out += found or [("", "")]
    return out


def _hinted(low: str) -> bool:
    return any(h in low for h in _HINTS) or "cc" in low and _CC.search(low) is not None


def _known(sentence: str) -> list[tuple[str, str]] | None:
    s = normalised(sentence)
    if not _hinted(s):
        return None
    first, _, rest = s.partition(" ")
    if rest and first != "-" and _ITEM.fullmatch(first):
        s = rest
    names = notices(s)
    if len(names) < 2:
        for k, p in _PATTERNS:
            if m := p.fullmatch(s):
                return [(k, _part(k, m.groupdict(), sentence))]
    return [("notice", name) for name in names] or None


def _name_at(s: str, at: int) -> tuple[str, int] | None:
    """SPDX name and end of the longest name of a licence at a place of a normalised sentence."""
    found = max(((m.end(), k, m) for k, p in _NAMED if (m := p.match(s, at))), key=lambda f: f[0], default=None)
    if found is None:
        return None
    end, kind, m = found
    g = m.groupdict()
    v = g.get("v")
    dotted = v if v is None or "." in v else f"{v}.0"
    if kind == "GPL":
        family = _GNU[g["x"]]
        return (f"{family}-{dotted}-{'or-later' if g['o'] else 'only'}" if v else f"LicenseRef-{family}"), end
    if kind == "BSD":
        return ("LicenseRef-BSD" if v is None else "0BSD" if v == "0" else f"BSD-{v}-Clause"), end
    if kind == "CC":
        kind = "-".join(["CC", *(_CC_PARTS[w] for w in re.split(r"[ -]", g["x"]) if w in _CC_PARTS)])
    if "v" in g and kind != "BSL-1.0":
        return (f"{kind}-{dotted}" if v else f"LicenseRef-{kind}"), end
    return kind, end


def notices(s: str) -> list[str]:
    """The SPDX names of all licences that a normalised sentence puts something under, in order.

    They stand after words such as 'licensed under', 'license:' or 'uses the', or before 'licensed', as a list with commas, and, or. A
    short name alone counts with 'licence', a version or the end of the sentence or clause after it; denied ones don't count.
    """
    out, at = [], 0
    for lead in _LEADS.finditer(s):
        if lead.start() < at or _DENIED.search(s, max(0, lead.start() - 60), lead.start()):
            continue
        names, k = [], lead.end()
        while (named := _name_at(s, k := _THE.match(s, k).end())) is not None:
            names.append(named[0])
            end = named[1]
            joint = _AND.match(s, end)
            if joint is None:
                break
            k = joint.end()
        if not names:
            continue
        said, rest = s[lead.end() : end], s[end : end + 12]
        under = "under" in lead[0] or ":" in lead[0]
        adjective = re.match(r"[- ]licen[sc]e(?:d|s)?\b", rest)
        if adjective or "licen" in said or under and (re.search(r"\d", said) or not rest or rest[0] in ",;:("):
            out += names
            at = end
    return out


_FAMILIES = {"apache-ref": "Apache", "mpl-ref": "MPL", "epl-ref": "EPL", "epl-made": "EPL", "cddl-ref": "CDDL", "artistic-ref": "Artistic", "eupl-ref": "EUPL", "ofl-ref": "OFL"}
_GNU = {"general public": "GPL", "lesser general public": "LGPL", "library general public": "LGPL", "affero general public": "AGPL", "gpl": "GPL", "lgpl": "LGPL", "agpl": "AGPL"}
_SPDX = re.compile(r"(?i)spdx-license-identifier:\s*([a-z0-9.+() -]+)")


def _part(kind: str, parts: dict, sentence: str) -> str:
    """The licence's name as the parts of a sentence give it; empty for sentences that name none."""
    v = parts.get("v")
    dotted = v if v is None or "." in v else f"{v}.0"
    if kind == "spdx":
        return " ".join(_SPDX.search(sentence)[1].split()).rstrip(".-")
    if kind in _FAMILIES:
        return f"{_FAMILIES[kind]}-{dotted}"
    if kind in ("gnu-ref", "gnu-free"):
        family = _GNU[parts["x"]]
        return f"{family}-{dotted}-{'or-later' if parts['o'] else 'only'}" if v else f"LicenseRef-{family}"
    if kind == "bsd-ref":
        return "LicenseRef-BSD" if v is None else "0BSD" if v == "0" else f"BSD-{v}-Clause"
    if kind == "cc-ref":
        own = parts["x"].upper()
        return "CC0-1.0" if own in ("ZERO", "0") else f"CC-{own}-{v}" if v else f"LicenseRef-CC-{own}"
    return ""


def matched(ids: list[tuple[str, str]]) -> list[tuple[str, int]]:
    """(licence, number of identifiers) of a sequence of identifiers, in order; each place takes the first rule that fits there.

    Unknown sentences may lie between the identifiers of a rule; places that no rule fits are passed over.
    """
    ids = [i for i in ids if i[0]]
    known = tuple(k for k, _ in ids)
    out, at = [], 0
    while at < len(ids):
        name, n = next(((name, len(rule)) for name, rule in _BY_FIRST.get(known[at], ()) if known[at : at + len(rule)] == rule), (None, 1))
        if name is not None:
            out.append((name.format(x=ids[at][1]), n))
        at += n
    return out


def licences(ids: list[tuple[str, str]]) -> list[str]:
    """The licences of a sequence of identifiers, in order."""
    return [name for name, _ in matched(ids)]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licences (array, in order of appearance), sentences (array of known identifiers), n_unmatched.

    n_unmatched counts known sentences that no rule used. Null, empty and blank texts have none of these. Texts of any length are
    scanned whole, and of rules that fit at one place the first counts. Rows are scanned
    one by one: repeated rows repeat, a null id stays null; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found, sentences, rest = [], [], []
            for t in batch.column(1).to_pylist():
                ids = sentence_ids(t)
                fits = matched(ids)
                found.append([name for name, _ in fits])
                sentences.append([k for k, _ in ids if k])
                rest.append(len(sentences[-1]) - sum(n for _, n in fits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(sentences, pa.list_(pa.string())), pa.array(rest, pa.int64())], names=["doc_id", "licences", "sentences", "n_unmatched"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, licences array<string>, sentences array<string>, n_unmatched bigint")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    s = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return s.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentences", ",").alias("sentences"), F.size("licences").cast("bigint").alias("n_licences"), "n_unmatched")

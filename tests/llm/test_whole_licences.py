"""Whole licence texts with numbered conditions, unknown lines within them, and notices without the word licence."""

import pytest

from strataspark.llm import licenses

GRANT = "Copyright (c) 1998, The Holder\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n{gap}"
CONDITIONS = {
    "source": "Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
    "binary": "Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
    "advert": "All advertising materials mentioning features or use of this software must\n   display the following acknowledgement: This product includes software\n   developed by The Holder.",
    "endorse": "Neither the name of the copyright holder nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.",
}
END = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL
DAMAGES (INCLUDING PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE), EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def bsd(names, mark, gap, join):
    return GRANT.format(gap=gap) + join.join(mark.format(k + 1) + CONDITIONS[n] for k, n in enumerate(names)) + END


@pytest.mark.parametrize("mark", ["{}. ", "({}) ", "{}) ", "- ", "* ", ""])
@pytest.mark.parametrize(("gap", "join"), [("\n", "\n"), ("", "\n"), ("\n", "\n\n"), ("", " ")])
@pytest.mark.parametrize("names", ["source binary", "source binary endorse", "source binary advert endorse"])
def test_bsd_texts(mark, gap, join, names):
    names = names.split()
    assert licenses.licences(licenses.sentence_ids(bsd(names, mark, gap, join))) == [f"BSD-{len(names)}-Clause"]


def test_unknown_lines_within_a_licence():
    text = bsd(["source", "binary"], "{}. ", "\n", "\n\nA line of the packager.\n\n")
    ids = licenses.sentence_ids(text)
    assert ("", "") in ids[1:-1] and licenses.licences(ids) == ["BSD-2-Clause"] and sum(n for _, n in licenses.matched(ids)) == 5


@pytest.mark.parametrize(("text", "names"), [
    ("Released under CC BY 4.0.", ["CC-BY-4.0"]), ("Released under Creative\nCommons BY 4.0.", ["CC-BY-4.0"]), ("Access to a soccer ball.", []),
    ("This is free and unencumbered software released into the public\ndomain.", ["Unlicense"]),
])
def test_notices_by_their_hints(text, names):
    assert licenses.licences(licenses.sentence_ids(text)) == names
    for k, p in licenses.SENTENCES:
        assert licenses._hinted(p.replace("licen[sc]e", "license")) or k == "spdx", k

"""Short licence notices as people write them, with one name or several."""

import pytest

from strataspark.llm import licenses


@pytest.mark.parametrize(("text", "names"), [
    ("The code is MIT licensed.", ["MIT"]),
    ("License: MIT", ["MIT"]),
    ("Licence: BSD-3-Clause", ["BSD-3-Clause"]),
    ("This project uses the Apache-2.0 license.", ["Apache-2.0"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
    ("Licensed under the MIT license and the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ("Licensed under the MIT License, or the Apache License 2.0, as you like.", ["MIT", "Apache-2.0"]),
    ("It is licensed under the GNU GPLv3", ["GPL-3.0-only"]),
    ("All of it is released under the GNU LGPL v2.1 or later.", ["LGPL-2.1-or-later"]),
    ("Licensed under the Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("Its texts are available under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
    ("Text is CC-BY-NC-ND 4.0 licensed; see below.", ["CC-BY-NC-ND-4.0"]),
    ("It is dual-licensed under the terms of the Mozilla Public License 2.0 and the GNU General Public License v2 or later.", ["MPL-2.0", "GPL-2.0-or-later"]),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["(MIT OR Apache-2.0)"]),
    ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT\nint x;", ["(GPL-2.0-only WITH Linux-syscall-note) OR MIT"]),
    ("This code isn't licensed under the MIT license.", []),
    ("It was formerly licensed under the GPL version 2.", []),
    ("The talk was provided under MIT supervision.", []), ("He has a license for the apache helicopter.", []), ("The boost is provided under pressure.", []),
    ("A driver's license: mitigated.", []), ("Data released under gplates names; the license is free.", []),
])
def test_notices(text, names):
    assert licenses.licences(licenses.sentence_ids(text)) == names


def test_time_of_long_sentences():
    for part in ("licensed under the ", "license: mit, ", "is a licence ", "not licensed under mit ", "the the ", "uses ", "cc by "):
        licenses.sentence_ids(part * 40_000)

"""A license that differs from a template by its name or version isn't taken for it."""

import pytest

from tallyframe.llm import licenses

NOTICE = licenses.TEMPLATES["GPL-3.0-notice"]


@pytest.mark.parametrize("text, name", [
    ("Released under the BSD License.", "BSD-line"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0-line"),
    ("Licensed under CC BY-ND 4.0.", None),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-line"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-line"),
    (NOTICE.replace("version 3", "version 2"), "GPL-2.0-notice"),
    (NOTICE.replace("version 3", "version 9"), None),
    (NOTICE.replace("GNU General", "GNU Affero General"), "AGPL-3.0-notice"),
    (NOTICE.replace("GNU General", "GNU Library General").replace("version 3", "version 2"), None),
    (licenses.TEMPLATES["BSD-2-Clause"], "BSD-2-Clause"),
    (licenses.TEMPLATES["BSD-3-Clause"], "BSD-3-Clause"),
    (NOTICE, "GPL-3.0-notice"),
])
def test_license_is_told_by_name_and_version(text, name):
    assert [x[0] for x in licenses.Scanner(licenses.TEMPLATES)(text)] == ([name] if name else [])

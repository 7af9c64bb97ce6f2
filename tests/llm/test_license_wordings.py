"""Wordings that stand in the tables' documents and in files, each with the labels of the templates that accept it."""

import pytest

from plumbline.llm import license_scan
from plumbline.llm.license_templates import _BSD, _MIT

FSF = "it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
HOPE = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
plain = lambda markup: markup.replace("[[", "").replace("]]", "").replace("{{holder:12}}", "the authors").replace("{{holder:15}}", "Some Body")
CASES = [
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("Released under the MIT License.", {"mit"}),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
    ("All rights reserved.", set()),
    ("This work is licensed under the GNU General Public License.", set()),
    ("Distributed under the GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
    ("licensed under the GNU Affero General Public License v3.0 or later", {"agpl-3.0"}),
    ("Released under the GPLv2.", {"gpl-2.0"}),
    ("redistribute " + FSF.format("", 3) + HOPE, {"gpl-3.0"}),
    ("redistribute " + FSF.format("Lesser", 3), {"lgpl-3.0"}),
    ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", {"mpl-2.0"}),
    ("SPDX-License-Identifier: ISC", {"isc"}),
    ("Released under CC0 1.0 Universal", {"cc0-1.0"}),
    ("To the extent possible under law, Some Body has waived all copyright and related or neighboring rights to this work.", {"cc0-1.0"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa-4.0"}),
    (plain(_MIT), {"mit"}),
    (plain(_BSD), {"bsd"}),
    (" ".join(plain(_MIT).split()[:33]), set()),
    (" ".join(plain(_BSD).split()[:22]), set()),
]


@pytest.mark.parametrize("text,labels", CASES)
def test_wordings(text, labels):
    automaton = license_scan.Automaton()
    found = license_scan.scan_texts([text], automaton)[0]
    assert {label for *_, label in found["matches"]} == labels


def test_the_whole_notice_is_covered():
    text = FSF.format("", 3) + HOPE
    found = license_scan.scan_texts([text], license_scan.Automaton())[0]
    assert max(n for _, n, _ in found["matches"]) == found["n_words"] - 1

"""The license scan's templates: notices, grants by name and SPDX tags, as (label, markup)."""

from __future__ import annotations

_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall {{holder:12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
    "[[ [[3]] all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{holder:15}} ]] "
    "[[ [[3]] [[4]] neither the name of {{holder:15}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission ]] "
    "this software is provided by {{holder:12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall {{holder:12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC = (
    "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and {{holder:12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall {{holder:12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_APACHE = (
    "apache license version 2 0 [[the license]] [[you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license]]"
)
_MPL = "mozilla public license [[version]] [[v]] 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0]]"
_UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
_CC0 = "to the extent possible under law {{holder:15}} waived all copyright and related or neighboring rights to"

_LEADS = ("licensed under", "released under", "distributed under")
_UNDER = "under the [[terms [[and conditions]] of the]]"


def _gnu() -> list[tuple[str, str]]:
    """The GNU licenses by full and short name, with the notice of the Free Software Foundation as an optional region."""
    out = []
    for stem, short, versions in (("", "gpl", ("2 0", "3 0")), ("lesser", "lgpl", ("2 1", "3 0")), ("library", "lgpl", ("2 0",)), ("affero", "agpl", ("3 0",))):
        name = f"gnu {stem} general public license"
        notice = (
            f"[[this {{{{program:4}}}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for more details "
            f"[[you should have received a copy of the {name} along with {{{{program:4}}}} if not see [[http]] [[https]] www gnu org licenses]]]]"
        )
        for version in versions:
            main, minor = version.split()
            number = f"{main} [[0]]" if minor == "0" else version
            tail = f"[[of the license]] [[only]] [[or at your option any later version]] [[or [[any]] later [[version]]]] {notice}"
            label = f"{short}-{main}.{minor}"
            for form in (f"version {number}", f"v {number}", f"v{number}"):
                full = f"{name} [[{short}]] [[as published by the free software foundation]] [[either]] {form} {tail}"
                out += [(label, f"{lead} {rest}") for lead in (*_LEADS, _UNDER) for rest in (full, f"[[gnu]] {short} {form} {tail}")]
            out += [(label, f"{lead} [[gnu]] {rest} {tail}") for lead in (*_LEADS, _UNDER) for rest in (f"{short} {number}", f"{short}v{number}")]
            out.append((label, f"spdx license identifier {short} {version} [[only]] [[or later]]"))
    return out


def _cc() -> list[tuple[str, str]]:
    """The Creative Commons licenses by code, name and both."""
    words = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    out = []
    for code in ("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd"):
        name = " ".join(["attribution", *(words[c] for c in code.split()[1:])])
        label = f"cc-{code.replace(' ', '-')}-4.0"
        rest = "[[international]] [[public]] [[license]]"
        apart = name.replace("noncommercial", "non commercial").replace("sharealike", "share alike").replace("noderivatives", "no derivatives")
        for lead in _LEADS:
            out.append((label, f"{lead} [[the]] [[a]] [[creative commons]] [[{name}]] cc {code} 4 0 {rest}"))
            out += [(label, f"{lead} [[the]] [[a]] creative commons {n} [[cc {code}]] 4 0 {rest}") for n in dict.fromkeys((name, apart))]
        out.append((label, f"spdx license identifier cc {code} 4 0"))
    return out


#: Every template begins with two mandatory words, by which its places are found.
TEMPLATES = (
    *(("apache-2.0", f"{lead} the {_APACHE}") for lead in _LEADS),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("mit", "under the mit license"),
    ("mit", _MIT),
    ("mit", "spdx license identifier mit"),
    ("bsd", _BSD),
    *(("bsd", f"under the [[{n} clause]] [[new]] [[modified]] [[revised]] [[simplified]] bsd [[{n} clause]] [[style]] license") for n in (2, 3)),
    *(("bsd", f"spdx license identifier bsd {n} clause") for n in (2, 3, 4)),
    ("isc", "under the isc license"),
    ("isc", _ISC),
    ("isc", "spdx license identifier isc"),
    ("mpl-2.0", f"subject to the terms of the {_MPL}"),
    *(("mpl-2.0", f"{lead} {_MPL}") for lead in (*_LEADS, _UNDER)),
    ("mpl-2.0", "spdx license identifier mpl 2 0"),
    *(("epl-2.0", f"{lead} eclipse public license [[version]] [[v]] 2 0") for lead in (*_LEADS, _UNDER)),
    ("epl-2.0", "spdx license identifier epl 2 0"),
    ("unlicense", _UNLICENSE),
    ("unlicense", "spdx license identifier unlicense"),
    ("cc0-1.0", _CC0),
    *(("cc0-1.0", f"{lead} [[the]] [[a]] [[creative commons]] [[zero]] cc0 [[1 0]] [[universal]] [[public domain dedication]] [[license]]") for lead in _LEADS),
    ("cc0-1.0", "spdx license identifier cc0 1 0"),
    *_cc(),
    *_gnu(),
    ("copyright", "copyright c {{year:2}} [[by]] {{holder:6}} all rights reserved"),
)

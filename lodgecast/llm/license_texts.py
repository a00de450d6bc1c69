"""Known licences as (name, text): fixed values, published licence texts and common notices.

Long texts are the files of ``licenses``, named like their licence.
"""

from __future__ import annotations

import re
from importlib.resources import files

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""

ZERO_BSD = ISC.replace(
    ", provided that the above copyright notice and this permission notice\nappear in all copies", ""
)

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_2 = _BSD_HEAD + _BSD_TAIL
BSD_3 = (
    _BSD_HEAD
    + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.
"""
    + _BSD_TAIL
)

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event
will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
the original software.

3. This notice may not be removed or altered from any source distribution."""

_SHORT = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
)

FILES = (
    "Apache-2.0", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "GFDL-1.2", "GFDL-1.3",
    "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "OFL-1.1",
    "Unlicense", "WTFPL",
)

# What follows the terms in a published text, and is often left out of copies.
_APPENDIX = (
    "   APPENDIX: How to apply", "        Appendix: How to Apply", "            How to Apply These Terms",
    "           How to Apply These Terms", "ADDENDUM: How to use",
)
_RULE = "=" * 71  # between the parts of a Creative Commons text
_BLANKS = (re.compile(r"Copyright \(C\)\s+_[_\s]*"), re.compile(r"(?<=\. )All\s+Rights\s+Reserved"))


def _variants(text: str) -> list[str]:
    """A published text as it is copied: whole, without its appendix, without the frame around it."""
    found = [text, text.replace("   Copyright [yyyy] [name of copyright owner]\n", "")]
    found += [text.partition(a)[0] for a in _APPENDIX if f"\n{a}" in text]
    found += [x.rpartition("END OF TERMS AND CONDITIONS")[0] for x in found if "END OF TERMS AND CONDITIONS" in x]
    if _RULE in text:
        title, _, terms, _ = text.split(_RULE)
        found += [terms, title + terms]
    if _BLANKS[0].search(text):
        # A form to fill in, inside the text: a wrap may make a copyright line of its parts, or not.
        flat = [" ".join(text.split())]
        for blank in _BLANKS:
            flat += [blank.sub(" ", x) for x in flat]
        found += flat
    return list(dict.fromkeys(found))


def _published() -> list[tuple[str, str]]:
    folder = files(__package__).joinpath("licenses")
    texts = [(name, folder.joinpath(f"{name}.txt").read_text("utf-8")) for name in FILES]
    return [(name, x) for name, text in texts for x in _variants(text)]


# Each licence with its SPDX identifiers and the names that notices call it by.
_GNU = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
NAMES: dict[str, tuple[list[str], list[str]]] = {
    "MIT": (["MIT"], ["the MIT License", "MIT License", "MIT", "the MIT License (MIT)"]),
    "ISC": (["ISC"], ["the ISC License", "ISC"]),
    "0BSD": (["0BSD"], ["the BSD Zero Clause License", "the 0BSD License", "0BSD"]),
    "BSD-2-Clause": (["BSD-2-Clause"], ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"]),
    "BSD-3-Clause": (["BSD-3-Clause"], ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "BSD-3-Clause"]),
    "Zlib": (["Zlib"], ["the zlib License", "zlib"]),
    "Apache-2.0": (["Apache-2.0"], ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0", "Apache 2.0"]),
    "MPL-1.1": (["MPL-1.1"], ["the Mozilla Public License 1.1", "the Mozilla Public License, version 1.1", "MPL 1.1"]),
    "MPL-2.0": (["MPL-2.0"], ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "MPL 2.0"]),
    "EPL-1.0": (["EPL-1.0"], ["the Eclipse Public License 1.0", "the Eclipse Public License v1.0", "the Eclipse Public License, version 1.0", "EPL 1.0"]),
    "EPL-2.0": (["EPL-2.0"], ["the Eclipse Public License 2.0", "the Eclipse Public License v2.0", "the Eclipse Public License, version 2.0", "EPL 2.0"]),
    "BSL-1.0": (["BSL-1.0"], ["the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL 1.0"]),
    "OFL-1.1": (["OFL-1.1"], ["the SIL Open Font License, Version 1.1", "the SIL Open Font License 1.1", "OFL 1.1"]),
    "GFDL-1.2": (["GFDL-1.2", "GFDL-1.2-only"], ["the GNU Free Documentation License, version 1.2", "GFDL 1.2"]),
    "GFDL-1.3": (["GFDL-1.3", "GFDL-1.3-only"], ["the GNU Free Documentation License, version 1.3", "GFDL 1.3"]),
    "Unlicense": (["Unlicense"], ["the Unlicense", "Unlicense"]),
    "WTFPL": (["WTFPL"], ["the WTFPL", "WTFPL"]),
    "CC0-1.0": (["CC0-1.0"], ["CC0 1.0", "CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal License"]),
}
for _family, _versions in (("GPL", "1 2 3"), ("LGPL", "2 2.1 3"), ("AGPL", "3")):
    for _v in _versions.split():
        _id = f"{_family}-{_v if '.' in _v else _v + '.0'}"
        _title = "Library General Public License" if _id == "LGPL-2.0" else _GNU[_family]
        _plain = [f"the GNU {_title}, version {_v}", f"the GNU {_title} v{_v}", f"the GNU {_title} v{_v}.0", f"the GNU {_family}, version {_v}", f"the GNU {_family}v{_v}", f"{_family} {_v}", f"{_family}v{_v}"]
        NAMES[_id] = [_id, f"{_id}-only"], _plain
        _later = [f"{n} or {_x}" for n in _plain[:2] for _x in ("later", "any later version", "(at your option) any later version")]
        NAMES[f"{_id}-or-later"] = [f"{_id}-or-later"], _later
for _part, _title in _CC.items():
    for _v, _kind in (("3.0", "Unported"), ("4.0", "International")):
        NAMES[f"CC-{_part}-{_v}"] = [f"CC-{_part}-{_v}"], [
            f"CC {_part} {_v}", f"a Creative Commons {_title} {_v} {_kind} License", f"the Creative Commons {_title} {_v} {_kind} License"
        ]

_VERBS = [f"{who}{how} under" for who in ("", "This work is ", "This project is ", "This software is ") for how in ("licensed", "released")]
_VERBS += ["distributed under", "this software is distributed under"]


def notices(names: dict[str, tuple[list[str], list[str]]] = NAMES) -> list[tuple[str, str]]:
    """Notices of every licence: its SPDX line, and "Licensed under ..." and the like."""
    lines = [(one, f"SPDX-License-Identifier: {x}") for one, (ids, _) in names.items() for x in ids]
    lines += [(one, f"{verb} {x}.") for one, (_, called) in names.items() for x in called for verb in _VERBS]
    return lines


_NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

KNOWN = (*_SHORT, *_NOTICES, *_published(), *notices())

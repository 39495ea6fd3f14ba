"""Licence templates: whole licences, notices, and the lines by which works name a licence.

A template is (name, licence, text, deciding words).  The deciding words tell
the licence from its relatives; a match must have all of them.  Whole licences
stand in the folder ``licenses``; names of families are combined by rule.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

#: Words that make another licence of a text if they stand in it unasked.
RIVALS = frozenset("nc nd sa noncommercial noderivatives noderivs sharealike lesser library affero".split())

#: Public notices and texts.
_NOTICES = (
    ("mit-text", "MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ""),
    ("apache-2.0-notice", "Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache 2 0"),
    ("gpl-3.0-notice", "GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""", "3"),
    ("bsd-3-text", "BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""", ""),
    ("isc-text", "ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""", ""),
    ("mpl-2.0-notice", "MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "mozilla 2 0"),
    ("unlicense-text", "Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ""),
    ("cc0-line", "CC0-1.0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""", "waived"),
    ("bsd-2-text", "BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES""", ""),
    ("gpl-2.0-notice", "GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "2"),
    ("lgpl-2.1-notice", "LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", "lesser 2 1"),
    ("lgpl-3.0-notice", "LGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", "lesser 3"),
    ("agpl-3.0-notice", "AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""", "affero 3"),
    ("zlib-text", "Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""", ""),
    ("bsl-1.0-line", "BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1 0"),
    ("epl-2.0-line", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse 2 0"),
    ("eupl-1.2-line", "EUPL-1.2", "Licensed under the EUPL, Version 1.2.", "eupl 1 2"),
    ("artistic-2.0-line", "Artistic-2.0", "This program is licensed under the Artistic License 2.0.", "artistic 2 0"),
    ("unlicense-line", "Unlicense", "This work is released under the Unlicense.", "unlicense"),
)

#: Whole licences: file, licence, deciding words.
_WHOLE = (
    ("Apache-2.0", "Apache-2.0", "2 0"), ("Artistic", "Artistic-1.0", ""), ("CC0-1.0", "CC0-1.0", ""), ("GFDL-1.2", "GFDL-1.2", "1 2"), ("GFDL-1.3", "GFDL-1.3", "1 3"),
    ("GPL-1", "GPL-1.0", "1"), ("GPL-2", "GPL-2.0", "2"), ("GPL-3", "GPL-3.0", "3"), ("LGPL-2", "LGPL-2.0", "2"), ("LGPL-2.1", "LGPL-2.1", "lesser 2 1"), ("LGPL-3", "LGPL-3.0", "lesser 3"),
    ("MPL-1.1", "MPL-1.1", "1"), ("MPL-2.0", "MPL-2.0", "2 0"),
)

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_KINDS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic", "1.0": "Generic"}
_GNU = {"GPL": ("GNU General Public License", ("1", "2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",)), "GFDL": ("GNU Free Documentation License", ("1.2", "1.3"))}
#: Licences that lines name as "the X License", with the words that decide.
_NAMED = {
    "MIT": ("MIT License", "mit"), "ISC": ("ISC License", "isc"), "BSD-2-Clause": ("BSD 2-Clause License", "bsd 2"), "BSD-3-Clause": ("BSD 3-Clause License", "bsd 3"),
    "Apache-2.0": ("Apache License, Version 2.0", "apache 2 0"), "Apache-1.1": ("Apache License, Version 1.1", "apache 1 1"), "Apache-1.0": ("Apache License, Version 1.0", "apache 1 0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "mozilla 2 0"), "MPL-1.1": ("Mozilla Public License, Version 1.1", "mozilla 1 1"),
}
_TAGGED = "MIT MIT-0 ISC Unlicense Zlib BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-2.0 BSL-1.0 EPL-2.0 EUPL-1.2 CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later".split()


def _plain(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[str, str, str, str], ...]:
    """Return all templates."""
    out = list(_NOTICES)
    for verb in ("Licensed", "Released"):
        out += [(f"{licence.lower()}-{verb.lower()}", licence, f"{verb} under the {name}.", deciding) for licence, (name, deciding) in _NAMED.items()]
    for licence, (name, versions) in _GNU.items():
        for version in versions:
            own = "gnu general public " if licence == "GPL" else "gnu " + {"LGPL": "lesser ", "AGPL": "affero ", "GFDL": "documentation "}[licence]
            full = version if "." in version else version + ".0"
            out.append((f"{licence.lower()}-{full}-line", f"{licence}-{full}", f"This work is licensed under the {name}, version {version}.", own + _plain(version)))
    for version, kind in _CC_KINDS.items():
        for short, name in _CC.items():
            licence = f"CC-{short}-{version}"
            out.append((f"{licence.lower()}-line", licence, f"Licensed under CC {short} {version}.", f"cc {_plain(short)} {_plain(version)}"))
            out.append((f"{licence.lower()}-full", licence, f"This work is licensed under a Creative Commons {name} {version} {kind} License.", f"commons {_plain(name)} {_plain(version)}"))
    for tag in _TAGGED:
        out.append((f"spdx-{tag.lower()}", tag.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {tag}", f"spdx identifier {_plain(tag)}"))
    folder = resources.files(__package__) / "licenses"
    out += [(f"{name.lower()}-whole", licence, (folder / f"{name}.txt").read_text(encoding="utf-8"), deciding) for name, licence, deciding in _WHOLE]
    return tuple(out)

"""Standard notices of common licenses beyond the first set: texts, and short lines in the usual wordings.

Wordings of one license have names that differ after "#" only; what is reported ends there.
"""

from __future__ import annotations

_GNU = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
)
_GPL, _LGPL, _LIBRARY, _AGPL = "General Public License", "Lesser General Public License", "Library General Public License", "Affero General Public License"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "{2}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_4 = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"

TEXTS = {
    **{f"{name}#{i}": _GNU.format(what=what, mark=mark, kind=kind, either=either, version=version) for name, kind, version, whats in (
        ("gpl-2.0", _GPL, "2", ("program", "file")), ("gpl-3.0", _GPL, "3", ("file", "software")), ("lgpl-2.0", _LIBRARY, "2", ("library",)), ("lgpl-2.1", _LGPL, "2.1", ("library", "program")),
        ("lgpl-3.0", _LGPL, "3", ("library", "program")), ("agpl-3.0", _AGPL, "3", ("program", "file")),
    ) for i, (what, mark, either) in enumerate((w, m, e) for w in whats for m, e in ((":", ", either"), (";", ";")))},
    "gpl-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "agpl-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation.",
    "bsd-2-clause#plain": _BSD.format("", ""),
    "bsd-3-clause#numbers": (_BSD + _BSD_3).format("1. ", "2. ", "3. "),
    "bsd-3-clause#plain": (_BSD + _BSD_3).format("", "", ""),
    "bsd-4-clause": _BSD.format("1. ", "2. ") + _BSD_4,
    "epl-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0",
    "epl-2.0#v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "cc0-1.0": "has waived all copyright and related or neighboring rights to",
    "cc0-1.0#software": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "cc0-1.0#deed": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "wtfpl": "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "gfdl-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
}

#: Names in running text, as they follow a verb below. Words are compared without case and punctuation.
_NAMES: dict[str, list[str]] = {
    "mit": ["the MIT License", "the MIT Licence", "an MIT License", "MIT License terms", "the terms of the MIT", "the Expat License"],
    "isc": ["the ISC License", "the terms of the ISC"],
    "unlicense": ["the Unlicense License", "the terms of the Unlicense"],
    "zlib": ["the zlib License", "the zlib/libpng License"],
    "bsl-1.0": ["the Boost Software License", "the BSL 1.0"],
    "apache-2.0": ["the Apache License, Version 2.0", "Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "the Apache 2.0", "Apache 2.0", "the Apache License v2.0", "the Apache Software License 2.0", "the Apache License", "an Apache 2.0 license"],
    "bsd-2-clause": ["the BSD 2-Clause", "BSD 2-Clause", "the 2-Clause BSD", "a 2-clause BSD", "the Simplified BSD License", "the two-clause BSD"],
    "bsd-3-clause": ["the BSD 3-Clause", "BSD 3-Clause", "the 3-Clause BSD", "a 3-clause BSD", "the New BSD License", "the Modified BSD License", "the Revised BSD License", "the three-clause BSD"],
    "bsd": ["the BSD License", "a BSD-style License", "the BSD Licence"],
    "mpl-1.1": ["the Mozilla Public License 1.1", "the Mozilla Public License, Version 1.1", "the MPL 1.1"],
    "mpl-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, Version 2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License v2.0", "Mozilla Public License 2.0", "the MPL 2.0", "MPL 2.0"],
    "epl-1.0": ["the Eclipse Public License 1.0", "the Eclipse Public License v1.0", "the Eclipse Public License, Version 1.0", "the EPL 1.0"],
    "epl-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License v2.0", "the Eclipse Public License v. 2.0", "the Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "the EPL 2.0", "EPL 2.0"],
    "cc0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "the CC0 1.0", "a CC0 1.0", "the CC0 License", "Creative Commons Zero", "the Creative Commons Zero", "the CC0 Public Domain Dedication", "the Creative Commons CC0"],
    "wtfpl": ["the WTFPL License", "the terms of the WTFPL"],
}
for _name, _full, _short, _versions in (("gpl", _GPL, "GPL", ("2.0", "3.0")), ("lgpl", _LGPL, "LGPL", ("2.1", "3.0")), ("agpl", _AGPL, "AGPL", ("3.0",)), ("gfdl", "Free Documentation License", "GFDL", ("1.2", "1.3"))):
    _NAMES[_name] = [f"the GNU {_full}", f"the GNU {_short}", f"the {_short} License"] + ([f"the {_full}"] if len(_full.split()) > 3 or _name == "gfdl" else [])
    for _v in _versions:
        _NAMES[f"{_name}-{_v}"] = [
            f"{a} {b}" for v in dict.fromkeys((_v, _v.removesuffix(".0"))) for a in (f"the GNU {_full}", f"GNU {_full}", f"the GNU {_short}", f"GNU {_short}", f"the {_short}", _short)
            for b in (f"v{v}", f"version {v}", f"v. {v}", v)
        ]

#: What comes before a name.
_VERBS = ("licensed under", "licenced under", "released under", "distributed under", "available under", "published under", "provided under", "covered by", "subject to", "governed by", "under the terms of", "under the conditions of", "in accordance with")

_PARTS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = "apache-2.0 bsd-2-clause bsd-3-clause bsd-4-clause mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cc0-1.0 bsl-1.0 gpl-2.0 gpl-3.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 agpl-3.0".split()


def _lines():
    """(license, line)"""
    for name, forms in _NAMES.items():
        for form in forms:
            for verb in _VERBS:
                yield name, f"{verb} {form}"
    for part, full in _PARTS.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            name = f"cc-{part}-{v}"
            for before in ("under", "under a", "under the", "license", "licence", ""):
                yield name, f"{before} CC {part} {v}"
                yield name, f"{before} Creative Commons {part} {v}"
            for long in {full, full.replace("NonCommercial", "Non-Commercial"), full.replace("ShareAlike", "Share Alike"), full.replace("NoDerivatives", "NoDerivs"), full.replace("NonCommercial", "Non-Commercial").replace("ShareAlike", "Share Alike")}:
                yield name, f"Creative Commons {long} {v}"
                yield name, f"Creative Commons {long} License {v}"
                yield name, f"Creative Commons {long} {v} {'International' if v == '4.0' else 'Unported' if v == '3.0' else 'Generic'} License"
            yield name, f"creativecommons.org/licenses/{part}/{v}"
            yield name, f"SPDX-License-Identifier: cc-{part}-{v}"
    yield "cc0-1.0", "creativecommons.org/publicdomain/zero/1.0"
    yield "cc0-1.0", "Creative Commons CC0 1.0 Universal"
    yield "cc0-1.0", "CC0 1.0 Universal Public Domain Dedication"
    yield "public-domain-mark-1.0", "creativecommons.org/publicdomain/mark/1.0"
    for name in _SPDX:
        for end in ("", *(("-only", "-or-later", "+") if "gpl" in name else ())):
            yield name, f"SPDX-License-Identifier: {name}{end}"
    for http in ("http", "https"):
        for name in ("mit", "isc"):
            yield name, f"{http}://opensource.org/licenses/{name}"
            yield name, f"{http}://www.opensource.org/licenses/{name}"
    yield "mit", "The MIT License (MIT) Copyright"
    yield "apache-2.0", "www.apache.org/licenses/LICENSE-2.0"
    for name in ("gpl", "lgpl", "agpl"):
        yield name, f"https://www.gnu.org/licenses/{name}"
    for name in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"):
        yield name, f"www.gnu.org/licenses/{name}"


#: By "license-notice#number".
LINES = {f"{name}-notice#{i}": line for i, (name, line) in enumerate(_lines())}

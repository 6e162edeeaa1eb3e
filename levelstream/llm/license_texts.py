"""Wordings of licences for the licence scan: names, titles, notices for source files, and whole short texts.

Long licences are given by their title with the opening sentences and by their notice, which their files begin and
end with.
"""

from __future__ import annotations

#: Names of licences by SPDX identifier.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "MIT": ("MIT License",),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL-2.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0"),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License, version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Zlib": ("zlib License",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
}

#: Licences whose name is a family and a version: family, its other names, SPDX stem, versions. A
#: version that ends in .0 is also written without it where the family is marked so.
FAMILIES = (
    ("GNU General Public License", ("GPL", "GNU GPL"), "GPL", ("2.0", "3.0"), True),
    ("GNU Lesser General Public License", ("LGPL", "GNU LGPL"), "LGPL", ("2.1", "3.0"), True),
    ("GNU Library General Public License", (), "LGPL", ("2.0",), True),
    ("GNU Affero General Public License", ("AGPL", "GNU AGPL"), "AGPL", ("3.0",), True),
    ("GNU Free Documentation License", ("GFDL",), "GFDL", ("1.1", "1.2", "1.3"), False),
    ("Apache License", (), "Apache", ("1.0", "1.1", "2.0"), False),
    ("Mozilla Public License", ("MPL",), "MPL", ("1.0", "1.1", "2.0"), False),
    ("Eclipse Public License", ("EPL",), "EPL", ("1.0", "2.0"), False),
    ("Eclipse Distribution License", (), "EDL", ("1.0",), False),
    ("Common Public License", (), "CPL", ("1.0",), False),
    ("Common Development and Distribution License", ("CDDL",), "CDDL", ("1.0", "1.1"), False),
    ("European Union Public Licence", ("EUPL",), "EUPL", ("1.0", "1.1", "1.2"), False),
    ("Artistic License", (), "Artistic", ("1.0", "2.0"), False),
    ("SIL Open Font License", ("OFL", "SIL OFL"), "OFL", ("1.0", "1.1"), False),
    ("Academic Free License", ("AFL",), "AFL", ("2.1", "3.0"), False),
    ("Open Software License", ("OSL",), "OSL", ("2.1", "3.0"), False),
    ("Educational Community License", (), "ECL", ("1.0", "2.0"), False),
    ("LaTeX Project Public License", ("LPPL",), "LPPL", ("1.2", "1.3c"), False),
    ("Mulan Permissive Software License", ("MulanPSL",), "MulanPSL", ("1.0", "2.0"), False),
    ("CeCILL Free Software License", ("CeCILL",), "CECILL", ("2.0", "2.1"), False),
    ("Q Public License", ("QPL",), "QPL", ("1.0",), False),
    ("Zope Public License", ("ZPL",), "ZPL", ("2.0", "2.1"), False),
    ("Open Database License", ("ODbL",), "ODbL", ("1.0",), False),
    ("Open Data Commons Attribution License", (), "ODC-By", ("1.0",), False),
    ("Universal Permissive License", ("UPL",), "UPL", ("1.0",), False),
    ("Server Side Public License", ("SSPL",), "SSPL", ("1.0",), False),
    ("Business Source License", ("BUSL",), "BUSL", ("1.1",), False),
    ("Elastic License", (), "Elastic", ("2.0",), False),
    ("PHP License", (), "PHP", ("3.0", "3.01"), False),
)

#: Licences known by a name alone.
PLAIN = {
    "GPL-2.0": ("GPLv2",),
    "GPL-3.0": ("GPLv3",),
    "LGPL-2.1": ("LGPLv2.1",),
    "LGPL-3.0": ("LGPLv3",),
    "AGPL-3.0": ("AGPLv3",),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"),
    "MIT-0": ("MIT No Attribution License",),
    "BSD-4-Clause": ("BSD 4-Clause License", "Original BSD License"),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL license", "under the WTFPL"),
    "Unlicense": ("The Unlicense", "Unlicense license"),
    "MS-PL": ("Microsoft Public License", "Ms-PL license"),
    "MS-RL": ("Microsoft Reciprocal License",),
    "NCSA": ("University of Illinois NCSA Open Source License", "NCSA License"),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License", "PSF License"),
    "OpenSSL": ("OpenSSL License",),
    "Ruby": ("Ruby License",),
    "Vim": ("Vim License",),
    "Beerware": ("Beer-Ware License", "Beerware License"),
    "W3C": ("W3C Software License", "W3C Software Notice and License"),
    "X11": ("X11 License",),
    "Sleepycat": ("Sleepycat License",),
    "PDDL-1.0": ("Public Domain Dedication and License", "Open Data Commons Public Domain Dedication License"),
}

#: The parts of Creative Commons licences, their versions, and how long names write the parts.
CC_PARTS = ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}

#: Words of names and version numbers. A passage names a licence only with all of them that its wording has.
NAMING = (
    "apache mit gnu gpl gpl2 gpl3 lgpl agpl lesser library affero gfdl documentation mozilla mpl eclipse epl bsd isc boost zlib cc cc0 by sa nc nd commons attribution sharealike noncommercial noderivatives zero "
    "new modified simplified original unlicense common development cddl european union eupl artistic sil font ofl academic afl osl educational community latex lppl mulan mulanpsl cecill qpl q zope zpl database odbl data "
    "universal upl server sspl business source busl elastic php wtfpl fuck microsoft reciprocal illinois ncsa postgresql python psf openssl ruby vim beer ware beerware w3c x11 sleepycat dedication pl "
    "acknowledgement substantial 2 3 4 gplv2 gplv3 lgplv2.1 lgplv3 agplv3 "
    "1.0 1.1 1.2 1.3 1.3c 2.0 2.1 2.5 3.0 3.01 4.0 v1.0 v1.1 v1.2 v1.3 v1.3c v2 v2.0 v2.1 v2.5 v3 v3.0 v3.01 v4.0"
).split()
_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_TWO_CLAUSES = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_THIRD_CLAUSE = """
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""

#: Titles, openings, notices and whole texts, by SPDX identifier.
TEXTS = (
    ("MIT", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-2-Clause", _TWO_CLAUSES + _DISCLAIMER),
    ("BSD-2-Clause", _TWO_CLAUSES),
    ("BSD-3-Clause", _TWO_CLAUSES + _THIRD_CLAUSE + _DISCLAIMER),
    ("BSD-3-Clause", _TWO_CLAUSES + _THIRD_CLAUSE),
    ("Zlib", """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
This notice may not be removed or altered from any source distribution.
"""),
    ("BSL-1.0", """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction
and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.
"""),
    ("Unlicense", """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain.
"""),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Apache-2.0", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.
"""),
    ("Apache-2.0", """
Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
Sections 1 through 9 of this document.
"""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", """
GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
"""),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.
"""),
    ("GPL-2.0", """
GNU GENERAL PUBLIC LICENSE Version 2, June 1991
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
"""),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", """
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.
"""),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
License for more details.
"""),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License
for more details.
"""),
    ("MPL-2.0", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""),
    ("MPL-2.0", """
Mozilla Public License Version 2.0
1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of,
or owns Covered Software.
"""),
    ("EPL-2.0", """
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright (CC0 1.0 Universal)"),
    ("Apache-2.0", """
Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a
perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare
Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works
in Source or Object form.
"""),
    ("Apache-2.0", """
Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a
perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent
license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work
"""),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0", """
All rights granted under this License are granted for the term of copyright on the Program, and are irrevocable provided
the stated conditions are met. This License explicitly affirms your unlimited permission to run the unmodified Program.
The output from running a covered work is covered by this License only if the output, given its content, constitutes a
covered work. This License acknowledges your rights of fair use or other equivalent, as provided by copyright law.
"""),
    ("GPL-3.0", """
You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you
conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating
that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices
of the absence of any warranty; and give all recipients a copy of this License along with the Program.
"""),
    ("GPL-2.0", """
The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU
General Public License is intended to guarantee your freedom to share and change free software--to make sure the
software is free for all its users.
"""),
    ("GPL-2.0", """
You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that
you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty; keep
intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of
the Program a copy of this License along with the Program.
"""),
    ("AGPL-3.0", """
The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically
designed to ensure cooperation with the community in the case of network server software.
"""),
    ("EPL-1.0", """
THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION
OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.
"""),
    ("Artistic-2.0", """
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
Preamble This license establishes the terms under which a given free software Package may be copied, modified,
distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the
development of that Package while still keeping the Package available as open source and free software.
"""),
    ("OFL-1.1", """
Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy,
merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the
following conditions
"""),
    ("WTFPL", """
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Everyone is permitted to copy and distribute
verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
"""),
    ("0BSD", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""),
    ("BSD-4-Clause", _TWO_CLAUSES + """
All advertising materials mentioning features or use of this software must display the following acknowledgement: This
product includes software developed by the organization.
""" + _THIRD_CLAUSE),
    ("PostgreSQL", """
Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and
without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the
following two paragraphs appear in all copies.
"""),
    ("Beerware", """
wrote this file. As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and
you think this stuff is worth it, you can buy me a beer in return. THE BEER-WARE LICENSE
"""),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited"),
    ("Proprietary", "All rights reserved"),
)


def _family_names():
    """(SPDX identifier, name): each family with each of its versions, as "2.0", "v2.0" and "version 2.0"."""
    for family, others, stem, versions, short in FAMILIES:
        for version in versions:
            numbers = (version, version.removesuffix(".0")) if short and version.endswith(".0") else (version,)
            for name in (family, *others):
                for number in numbers:
                    yield from ((f"{stem}-{version}", f"{name} {mark}{number}") for mark in ("", "v", "version "))


def _commons_names():
    """(SPDX identifier, name) of the Creative Commons licences by parts and version."""
    for parts in CC_PARTS:
        words = "-".join(CC_WORDS[p] for p in parts.split("-"))
        for version in CC_VERSIONS:
            yield from ((f"CC-{parts}-{version}", name) for name in (f"CC {parts} {version}", f"Creative Commons {words} {version}"))


_SENTENCES = tuple((spdx, wording.format(name)) for spdx, names in NAMES.items() for name in names for wording in ("licensed under the {}", "released under the {}", "{}"))
_PLAIN = tuple((spdx, name) for spdx, names in PLAIN.items() for name in names)
#: (SPDX identifier, wording): the texts, names alone and in the usual sentences, and names by rule; the first of equal wordings.
TEMPLATES = tuple({w.lower(): (spdx, w) for spdx, w in reversed((*TEXTS, *_SENTENCES, *_PLAIN, *_family_names(), *_commons_names()))}.values())[::-1]

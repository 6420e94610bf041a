"""Statements, headers, distinctive paragraphs and short bodies of common licences, as their publishers word them."""

from __future__ import annotations

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE '
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE_HEAD = "This is free and unencumbered software released into the public domain."
_UNLICENSE_GRANT = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_UNLICENSE_WAIVER = (
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
)


def _gnu(program: str, licence: str, version: str) -> str:
    """The notice that the GNU licences ask for."""
    return (
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the {licence} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"{program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {licence} for more details. "
        f"You should have received a copy of the {licence} along with this program. If not, see"
    )


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
#: Licences, their identifier's words and the names under which works are released.
_NAMES = (
    ("Apache-2.0", ("Apache 2.0",), ("Apache License, Version 2.0", "Apache 2.0 License")),
    ("BSD-2-Clause", ("BSD 2 Clause",), ("BSD 2-Clause License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3 Clause",), ("BSD 3-Clause License", "New BSD License")),
    ("CC-BY-4.0", ("CC BY 4.0",), ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY NC 4.0",), ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY SA 4.0",), ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC0-1.0", ("CC0 1.0",), ("CC0 1.0 Universal",)),
    ("AGPL-3.0", ("AGPL 3.0 only", "AGPL 3.0 or later"), (f"{_AGPL}, version 3", "AGPLv3")),
    ("GPL-2.0", ("GPL 2.0 only", "GPL 2.0 or later"), (f"{_GPL}, version 2", "GPLv2")),
    ("GPL-3.0", ("GPL 3.0 only", "GPL 3.0 or later"), (f"{_GPL}, version 3", "GPLv3")),
    ("LGPL-2.1", ("LGPL 2.1 only", "LGPL 2.1 or later"), (f"{_LGPL}, version 2.1", "LGPLv2.1")),
    ("LGPL-3.0", ("LGPL 3.0 only", "LGPL 3.0 or later"), (f"{_LGPL}, version 3", "LGPLv3")),
    ("ISC", ("ISC",), ("ISC License",)),
    ("MIT", ("MIT",), ("MIT License",)),
    ("MPL-2.0", ("MPL 2.0",), ("Mozilla Public License, version 2.0",)),
    ("Unlicense", ("Unlicense",), ("Unlicense",)),
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    *[(k, f"SPDX-License-Identifier: {i}") for k, ids, _ in _NAMES for i in ids],
    *[(k, f"{how} under the {n}") for k, _, names in _NAMES for n in names for how in ("Released", "Licensed", "This work is licensed")],
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("BSD-2-Clause", "\n".join((_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY))),
    ("BSD-2-Clause", _BSD_HEAD),
    ("BSD-2-Clause", "\n".join((_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_END))),
    ("BSD-3-Clause", "\n".join((_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES))),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-3-Clause", "\n".join((_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _BSD_END))),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("GPL-2.0", _gnu("This program", _GPL, "2").replace("free software:", "free software;")),
    ("GPL-2.0", f"{_GPL.upper()} Version 2, June 1991"),
    ("GPL-3.0", _gnu("This program", _GPL, "3")),
    ("GPL-3.0", f"{_GPL.upper()} Version 3, 29 June 2007"),
    ("AGPL-3.0", _gnu("This program", _AGPL, "3")),
    ("AGPL-3.0", f"{_AGPL.upper()} Version 3, 19 November 2007"),
    ("LGPL-2.1", _gnu("This library", _LGPL, "2.1").replace("free software:", "free software;")),
    ("LGPL-2.1", f"{_LGPL.upper()} Version 2.1, February 1999"),
    ("LGPL-3.0", _gnu("This library", _LGPL, "3")),
    ("LGPL-3.0", f"{_LGPL.upper()} Version 3, 29 June 2007"),
    ("ISC", _ISC_GRANT),
    ("ISC", "\n".join((_ISC_GRANT, _ISC_END))),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_NOTICE),
    ("MIT", "\n".join((_MIT_GRANT, _MIT_NOTICE, _MIT_END))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", _UNLICENSE_HEAD),
    ("Unlicense", "\n".join((_UNLICENSE_HEAD, _UNLICENSE_GRANT))),
    ("Unlicense", "\n".join((_UNLICENSE_HEAD, _UNLICENSE_GRANT, _UNLICENSE_WAIVER))),
)

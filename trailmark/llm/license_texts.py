"""Wording of public licences and of the notices that name them, as template markup.

``<<optional>> ... <</optional>>`` may be absent, ``<<one:a|b>>`` stands for one of its alternatives, ``<<any:N>>`` for
up to N words.  Punctuation and case don't count.
"""

_UNDER = "<<one:licensed|released|distributed|available|provided>> under the <<optional>>terms of the<</optional>> <<optional>>terms and conditions of the<</optional>>"
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<optional>>1<</optional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>>2<</optional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "<<optional>>3<</optional>> Neither the name of <<any:12>> nor the names of <<one:its|the|their>> <<optional>>copyright holders or<</optional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<any:12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL <<any:12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"""
_NO_EVENT = """IN NO EVENT SHALL <<any:12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(name: str, version: str) -> str:
    """The notice that the licence's own text asks for."""
    return f"""This <<one:program|library|file|software|package>> is free software <<optional>>you can redistribute it and or modify it<</optional>> under the terms of the GNU {name} General Public License as published by the Free Software Foundation
<<one:either version|version>> {version} of the License <<optional>>only<</optional>> <<optional>>or at your option any later version<</optional>>""".replace("", "")


def _creative(kind: str) -> str:
    return f"licensed under <<one:a|the>> Creative Commons {kind} <<one:4 0|3 0|2 0>> <<one:International|Unported|Generic>> <<one:License|Licence>>"


TEMPLATES: dict[str, str] = {
    "0bsd-text": f"{_ISC_GRANT}. {_ISC_TAIL}",
    "agpl-3.0-notice": _gnu("Affero", "3"),
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<one:http|https>>://www.apache.org/licenses/LICENSE-2.0 <<optional>>txt<</optional>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-2.0-notice": f"{_UNDER} Apache <<one:License|Licence>> <<optional>>Version<</optional>> 2.0",
    "boost-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following""",
    "boost-1.0-notice": "Distributed under the Boost Software License, Version 1.0",
    "bsd-2-clause-text": f"{_BSD_HEAD} {_BSD_TAIL}",
    "bsd-3-clause-text": f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}",
    "bsd-notice": f"{_UNDER} <<optional>><<one:new|modified|simplified>><</optional>> <<optional>><<one:2|3|two|three>> clause<</optional>> BSD <<optional>><<one:2|3|two|three>> clause<</optional>> <<optional>>style<</optional>> <<one:License|Licence>>",
    "cc-by-nc-4.0-notice": "licensed under <<optional>>a Creative Commons<</optional>> CC BY NC 4.0 <<optional>>International License<</optional>>",
    "cc-by-nd-notice": _creative("Attribution NoDerivatives"),
    "cc-by-nc-notice": _creative("Attribution <<one:NonCommercial|Non Commercial>>"),
    "cc-by-nc-sa-notice": _creative("Attribution <<one:NonCommercial|Non Commercial>> <<one:ShareAlike|Share Alike>>"),
    "cc-by-notice": _creative("Attribution"),
    "cc-by-sa-notice": _creative("Attribution <<one:ShareAlike|Share Alike>>"),
    "cc0-notice": "To the extent possible under law, <<any:12>> waived all copyright and related or neighboring rights to",
    "cddl-notice": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License <<optional>>v<</optional>> <<one:2 0|1 0>>",
    "gpl-2.0-notice": _gnu("", "2"),
    "gpl-3.0-notice": _gnu("", "3"),
    "gpl-short-notice": f"{_UNDER} GNU General Public License <<optional>><<one:version|v>><</optional>> <<one:2|3|v2|v3>> <<optional>>0<</optional>> <<optional>>of the license<</optional>> <<optional>>or any later version<</optional>>",
    "isc-text": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TAIL}",
    "lgpl-2.1-notice": _gnu("Lesser", "2.1"),
    "lgpl-3.0-notice": _gnu("Lesser", "3"),
    "mit-0-text": f"{_MIT_GRANT}. {_AS_IS} AND NONINFRINGEMENT. {_NO_EVENT}",
    "mit-text": f"""<<optional>>the MIT License <<optional>>MIT<</optional>><</optional>> <<optional>>Copyright <<any:16>><</optional>> {_MIT_GRANT}, subject to the following conditions:
The above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the Software. <<optional>>{_AS_IS} AND NONINFRINGEMENT. {_NO_EVENT}<</optional>>""",
    "mit-notice": f"<<optional>>this <<any:3>> is<</optional>> {_UNDER} MIT <<one:License|Licence>>",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<one:http|https>>://mozilla.org/MPL/2.0""",
    "ofl-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "spdx-line": "SPDX License Identifier <<one:MIT|ISC|Unlicense|Zlib|Apache 2 0|BSD 2 Clause|BSD 3 Clause|BSL 1 0|GPL 2 0|GPL 3 0|LGPL 2 1|LGPL 3 0|AGPL 3 0|MPL 2 0|CC0 1 0|CC BY 4 0>>",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "wtfpl-text": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE <<any:60>> 0. You just DO WHAT THE FUCK YOU WANT TO",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<optional>>1<</optional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<optional>>2<</optional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<optional>>3<</optional>> This notice may not be removed or altered from any source distribution.""",
}

"""Licence wording to look for."""

#: Phrases of the base scan and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.'


def _gnu(what: str, name: str, version: str) -> str:
    """The notice that the GNU licences ask for."""
    return (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
            f"either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")


def _cc(name: str, version: str = "4.0 International") -> str:
    return f"This work is licensed under a Creative Commons {name} {version} License."


#: Label, the words that tell this licence from others, and the notice or licence as published.
TEMPLATES = [
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "mit license", "Licensed under the terms of the MIT license."),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "apache license", "Licensed under the terms of the Apache License."),
    ("apache-2", "apache license version 2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "apache license version 2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl-3", "gnu general public license version 3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "gnu general public license version 2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License."),
    ("gpl", "gnu general public license", _gnu("program", "General Public License", "3")),
    ("lgpl", "gnu lesser general public license", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "gnu lesser general public license", _gnu("library", "Lesser General Public License", "2.1")),
    ("lgpl", "gnu lesser general public license", _gnu("program", "Lesser General Public License", "3")),
    ("agpl", "gnu affero general public license", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "gnu affero general public license", _gnu("program", "Affero General Public License", "3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification", _BSD_CONDITIONS + " " + _BSD_WARRANTY),
    ("bsd", "redistribution and use in source and binary forms with or without modification", _BSD_CONDITIONS),
    ("bsd-3", "neither the name of", _BSD_CONDITIONS + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY),
    ("bsd", "bsd license", "Licensed under the terms of the BSD license."),
    ("mpl-2", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("isc", "isc license", "Licensed under the terms of the ISC license."),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("bsl-1", "boost software license", "Distributed under the Boost Software License, Version 1.0."),
    ("unlicense", "free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "cc0 1 0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal."),
    ("cc-by", "creative commons attribution 4", _cc("Attribution")),
    ("cc-by", "creative commons attribution 3", _cc("Attribution", "3.0 Unported")),
    ("cc-by-sa", "attribution sharealike", _cc("Attribution-ShareAlike")),
    ("cc-by-nd", "attribution noderivatives", _cc("Attribution-NoDerivatives")),
    ("cc-by-nc", "attribution noncommercial 4", _cc("Attribution-NonCommercial")),
    ("cc-by-nc-sa", "attribution noncommercial sharealike", _cc("Attribution-NonCommercial-ShareAlike")),
    ("cc-by-nc-nd", "attribution noncommercial noderivatives", _cc("Attribution-NonCommercial-NoDerivatives")),
    ("cc-by-nc", "cc by nc", "Content is available under the CC BY-NC license."),
]

#: Words that deny what follows.
DENIALS = ["not", "never", "cannot", "nor", "neither", "without"]

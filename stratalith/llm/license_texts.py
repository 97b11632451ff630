"""Templates of license_scans beside its short notices: standard headers, SPDX lines, and the full texts in licenses/, named by SPDX id."""

from __future__ import annotations

import pkgutil

FULL = ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "ISC", "LGPL-2.1-only", "LGPL-3.0-only", "MIT", "MPL-2.0", "Unlicense")
GNU = (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"))
IDS = ("0BSD", "AGPL-3.0-or-later", "AGPL-3.0-only", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense")
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)
OTHERS = (
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", APACHE[0]),
    ("Apache-2.0", "\n\n".join(APACHE)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def _gnu(name: str, version: str, later: bool) -> tuple[str, str]:
    """The grant alone, and the header of three paragraphs."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    grant = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {which}."
    hope = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    return grant, f"{grant}\n\n{hope}\n\nYou should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."


def templates() -> list[tuple[str, str]]:
    """SPDX id and text of each; full texts also without their title, as grants are often quoted."""
    out = [(f"{ident}-{'or-later' if later else 'only'}", text) for ident, name, version in GNU for later in (False, True) for text in _gnu(name, version, later)]
    out += [(ident, f"SPDX-License-Identifier: {ident}") for ident in IDS] + [(f"{ident}-only", f"SPDX-License-Identifier: {ident}") for ident, _, _ in GNU]
    for ident in FULL:
        text = (pkgutil.get_data(__package__, f"licenses/{ident}.txt") or b"").decode()
        out.append((ident, text))
        # of short licences each long paragraph too: the grant and the disclaimer stand alone in plain text
        if ident in ("MIT", "ISC", "0BSD"):
            out += [(ident, p) for p in text.split("\n\n") if p.startswith("Permission")]
    return out + list(OTHERS)

"""Known licence sentences and rules: names of public licences, the notices made of them, and sentences of their texts."""

from __future__ import annotations

import re

# SPDX identifiers and the names that notices give these licences.
NAMES = {
    "MIT": ["MIT License", "MIT", "Expat License", "X11 License"],
    "MIT-0": ["MIT No Attribution License", "MIT No Attribution", "MIT-0"],
    "Apache-1.1": ["Apache Software License, Version 1.1", "Apache License 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0", "Apache 2.0", "Apache Software License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License", "Original BSD License", "BSD-4-Clause"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD"],
    "ISC": ["ISC License", "ISC"],
    "Zlib": ["zlib License", "zlib/libpng License", "Zlib"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License", "BSL-1.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "GPL-1.0-only": ["GNU General Public License, version 1", "GPL-1.0-only"],
    "GPL-1.0-or-later": ["GNU General Public License, version 1 or later", "GPL-1.0-or-later"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL v2", "GPL-2.0-only", "GPL-2.0"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GNU General Public License v2 or later", "GNU GPL v2 or later", "GPLv2 or later", "GPL-2.0-or-later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL v3", "GPL-3.0-only", "GPL-3.0"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GNU General Public License v3 or later", "GNU GPL v3 or later", "GPLv3 or later", "GPL-3.0-or-later"],
    "LGPL-2.0-only": ["GNU Library General Public License, version 2", "LGPL-2.0-only"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1-only", "LGPL-2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later", "GNU Lesser General Public License v2.1 or later", "LGPLv2.1 or later", "LGPL-2.1-or-later"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0-only", "LGPL-3.0"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later", "GNU Lesser General Public License v3 or later", "LGPLv3 or later", "LGPL-3.0-or-later"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "GNU Affero General Public License v3 or later", "AGPLv3 or later", "AGPL-3.0-or-later"],
    "GFDL-1.3-only": ["GNU Free Documentation License, Version 1.3", "GFDL-1.3-only"],
    "GFDL-1.3-or-later": ["GNU Free Documentation License, Version 1.3 or later", "GFDL-1.3-or-later"],
    "MPL-1.1": ["Mozilla Public License Version 1.1", "Mozilla Public License 1.1", "MPL 1.1", "MPL-1.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-1.0": ["Eclipse Public License v1.0", "Eclipse Public License 1.0", "EPL-1.0"],
    "EPL-2.0": ["Eclipse Public License v2.0", "Eclipse Public License v. 2.0", "Eclipse Public License 2.0", "EPL-2.0"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License 1.0", "CDDL-1.0"],
    "CDDL-1.1": ["Common Development and Distribution License, Version 1.1", "Common Development and Distribution License 1.1", "CDDL-1.1"],
    "CPL-1.0": ["Common Public License Version 1.0", "Common Public License 1.0", "CPL-1.0"],
    "EUPL-1.1": ["European Union Public Licence 1.1", "EUPL-1.1"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "European Union Public Licence v1.2", "EUPL-1.2"],
    "MS-PL": ["Microsoft Public License", "MS-PL"],
    "MS-RL": ["Microsoft Reciprocal License", "MS-RL"],
    "Artistic-1.0": ["Artistic License 1.0", "Artistic-1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic-2.0"],
    "PSF-2.0": ["Python Software Foundation License", "Python Software Foundation License Version 2", "PSF-2.0"],
    "Python-2.0": ["Python License 2.0", "Python-2.0"],
    "Ruby": ["Ruby License", "Ruby"],
    "PHP-3.01": ["PHP License, version 3.01", "PHP License 3.01", "PHP-3.01"],
    "PostgreSQL": ["PostgreSQL License", "PostgreSQL"],
    "OpenSSL": ["OpenSSL License", "OpenSSL"],
    "OSL-3.0": ["Open Software License version 3.0", "Open Software License 3.0", "OSL-3.0"],
    "AFL-3.0": ["Academic Free License version 3.0", "Academic Free License 3.0", "AFL-3.0"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA"],
    "UPL-1.0": ["Universal Permissive License v1.0", "Universal Permissive License 1.0", "UPL-1.0"],
    "BlueOak-1.0.0": ["Blue Oak Model License 1.0.0", "BlueOak-1.0.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL-1.1"],
    "LPPL-1.3c": ["LaTeX Project Public License, version 1.3c", "LaTeX Project Public License 1.3c", "LPPL-1.3c"],
    "Vim": ["Vim License", "Vim"],
    "W3C": ["W3C Software Notice and License", "W3C"],
    "HPND": ["Historical Permission Notice and Disclaimer", "HPND"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "ODbL-1.0": ["Open Database License 1.0", "Open Database License", "ODbL 1.0", "ODbL-1.0"],
    "ODC-By-1.0": ["Open Data Commons Attribution License v1.0", "ODC-By-1.0"],
    "PDDL-1.0": ["Open Data Commons Public Domain Dedication and License 1.0", "PDDL-1.0"],
    "BUSL-1.1": ["Business Source License 1.1", "BUSL-1.1"],
    "SSPL-1.0": ["Server Side Public License, version 1", "SSPL-1.0"],
    "Elastic-2.0": ["Elastic License 2.0", "Elastic-2.0"],
    "CECILL-2.1": ["CeCILL Free Software License Agreement v2.1", "CECILL-2.1"],
    "MulanPSL-2.0": ["Mulan PSL v2", "MulanPSL-2.0"],
    "RPL-1.5": ["Reciprocal Public License 1.5", "RPL-1.5"],
}
#: What stands before a name in a notice, in normalised form; in the table it is the word `under`.
LEAD = r"^(?:(?:this (?:work|project|software|program|library|package|file|code|document)|it|all code|the code) is )?(?:dual )?(?:licensed|released|distributed|published|available|provided)(?: for use)? under (?:the |an? )?(?:terms of )?(?:the |an? )?|^licen[sc]e(?:d under)? (?:the )?"
# Sentences of public licence texts.
GPL = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version"
GPL_ONLY = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, version {2}"
TEXTS = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-0-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-header": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl3-later": [GPL.format(x, "General Public License", y, 3) for x, y in ((":", ","), (";", ","), (";", ";"))],
    "gpl2-later": [GPL.format(x, "General Public License", y, 2) for x, y in ((":", ","), (";", ","), (";", ";"))],
    "agpl3-later": [GPL.format(x, "Affero General Public License", y, 3) for x, y in ((":", ","), (";", ","))],
    "lgpl3-later": [GPL.format(x, "Lesser General Public License", y, 3) for x, y in ((":", ","), (";", ","))],
    "gpl3-only": [GPL_ONLY.format(x, "General Public License", 3) for x in ":;"],
    "gpl2-only": [GPL_ONLY.format(x, "General Public License", 2) for x in ":;"],
    "agpl3-only": [GPL_ONLY.format(x, "Affero General Public License", 3) for x in ":;"],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib-origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "mpl2-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "epl2-header": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"],
    "bsl-grant": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"],
    "reserved": ["All rights reserved"],
}
#: (licence, identifiers in order) of the texts above; a licence may have several rules.
ORDERED = [
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT-0", ["mit-0-grant", "mit-warranty"]),
    ("Apache-2.0", ["apache-header", "apache-comply"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "gpl-warranty"]),
    ("GPL-3.0-only", ["gpl3-only", "gpl-warranty"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-warranty"]),
    ("AGPL-3.0-only", ["agpl3-only", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "lgpl-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-grant", "zlib-origin"]),
    ("Unlicense", ["unlicense-grant"]),
    ("MPL-2.0", ["mpl2-header"]),
    ("EPL-2.0", ["epl2-header"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("WTFPL", ["wtfpl-title"]),
    ("proprietary", ["reserved"]),
]
#: What holds only where no licence does.
ELSE = "proprietary"


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Normalised sentence to identifier; a licence's own name is the identifier of the notices that name it.
SENTENCES = {plain(s): name for name, texts in TEXTS.items() for s in texts}
SENTENCES |= {"under " + plain(re.sub("^The ", "", name)): licence for licence, names in NAMES.items() for name in names}
SENTENCES |= {plain(f"SPDX-License-Identifier: {licence}"): licence for licence in NAMES}
SENTENCES = {re.sub(LEAD, "under ", s): name for s, name in SENTENCES.items()}
#: (licence, identifiers in order).
RULES = [(licence, [licence]) for licence in NAMES] + ORDERED

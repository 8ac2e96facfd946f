"""Licence names and text signatures, from which the scan's rules are built.

Every value here is fixed: identifiers of the public licence list, the names people write for
them, and phrases of the licence texts.
"""

from __future__ import annotations

# Identifier, then the names it goes by (a space stands for any white space).
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit licen[cs]e", "expat licen[cs]e", "mit/x11 licen[cs]e"),
    "MIT-0": ("mit no attribution licen[cs]e", "mit-0 licen[cs]e"),
    "X11": ("x11 licen[cs]e",),
    "ISC": ("isc licen[cs]e", "internet systems consortium licen[cs]e"),
    "0BSD": ("zero[- ]clause bsd licen[cs]e", "0bsd licen[cs]e"),
    "BSD-2-Clause": ("2[- ]clause bsd licen[cs]e", "bsd[- ]2[- ]clause licen[cs]e",
                     "simplified bsd licen[cs]e", "freebsd licen[cs]e"),
    "BSD-3-Clause": ("3[- ]clause bsd licen[cs]e", "bsd[- ]3[- ]clause licen[cs]e",
                     "(?:new|revised|modified) bsd licen[cs]e"),
    "BSD-4-Clause": ("4[- ]clause bsd licen[cs]e", "original bsd licen[cs]e"),
    "BSD": ("bsd licen[cs]e", "bsd[- ]style licen[cs]e"),
    "Apache-1.1": ("apache(?: software)? licen[cs]e,? (?:version |v)?1\\.1",),
    "Apache-2.0": ("apache(?: software)? licen[cs]e,? (?:version |v)?2(?:\\.0)?", "asl 2\\.0 licen[cs]e"),
    "Apache": ("apache(?: software)? licen[cs]e",),
    "GPL-1.0": ("(?:gnu )?general public licen[cs]e,? (?:version |v)1(?:\\.0)?", "gpl ?v1 licen[cs]e"),
    "GPL-2.0": ("(?:gnu )?general public licen[cs]e,? (?:version |v)2(?:\\.0)?", "gplv2 licen[cs]e"),
    "GPL-3.0": ("(?:gnu )?general public licen[cs]e,? (?:version |v)3(?:\\.0)?", "gplv3 licen[cs]e"),
    "GPL": ("(?:gnu )?general public licen[cs]e", "gnu gpl licen[cs]e", "gpl licen[cs]e"),
    "LGPL-2.0": ("(?:gnu )?library general public licen[cs]e", "lgplv2 licen[cs]e"),
    "LGPL-2.1": ("(?:gnu )?lesser general public licen[cs]e,? (?:version |v)2\\.1", "lgplv2\\.1 licen[cs]e"),
    "LGPL-3.0": ("(?:gnu )?lesser general public licen[cs]e,? (?:version |v)3(?:\\.0)?", "lgplv3 licen[cs]e"),
    "LGPL": ("(?:gnu )?lesser general public licen[cs]e", "lgpl licen[cs]e"),
    "AGPL-3.0": ("(?:gnu )?affero general public licen[cs]e(?:,? (?:version |v)3(?:\\.0)?)?", "agplv3 licen[cs]e"),
    "GFDL": ("(?:gnu )?free documentation licen[cs]e", "gfdl licen[cs]e"),
    "MPL-1.1": ("mozilla public licen[cs]e,? (?:version |v)?1\\.1", "mpl 1\\.1 licen[cs]e"),
    "MPL-2.0": ("mozilla public licen[cs]e,? (?:version |v)?2\\.0", "mpl 2\\.0 licen[cs]e"),
    "MPL": ("mozilla public licen[cs]e",),
    "EPL-1.0": ("eclipse public licen[cs]e,? (?:version |v|- v ?)?1\\.0",),
    "EPL-2.0": ("eclipse public licen[cs]e,? (?:version |v|- v ?)?2\\.0",),
    "EPL": ("eclipse public licen[cs]e",),
    "CDDL-1.0": ("common development and distribution licen[cs]e",),
    "CPL-1.0": ("common public licen[cs]e",),
    "CPAL-1.0": ("common public attribution licen[cs]e",),
    "EUPL-1.1": ("european union public licen[cs]e,? (?:version |v\\.?)?1\\.1",),
    "EUPL-1.2": ("european union public licen[cs]e(?:,? (?:version |v\\.?)?1\\.2)?",),
    "OSL-3.0": ("open software licen[cs]e",),
    "AFL-3.0": ("academic free licen[cs]e",),
    "Artistic-1.0": ("artistic licen[cs]e,? (?:version |v)?1(?:\\.0)?",),
    "Artistic-2.0": ("artistic licen[cs]e,? (?:version |v)?2(?:\\.0)?",),
    "Artistic": ("artistic licen[cs]e",),
    "BSL-1.0": ("boost software licen[cs]e",),
    "BUSL-1.1": ("business source licen[cs]e",),
    "SSPL-1.0": ("server side public licen[cs]e",),
    "Elastic-2.0": ("elastic licen[cs]e",),
    "Zlib": ("zlib licen[cs]e", "zlib/libpng licen[cs]e"),
    "Libpng": ("libpng licen[cs]e",),
    "Unlicense": ("the unlicense",),
    "WTFPL": ("do what the f[u*]ck you want to public licen[cs]e",),
    "Beerware": ("beer-?ware licen[cs]e",),
    "PSF-2.0": ("python software foundation licen[cs]e", "psf licen[cs]e"),
    "PHP-3.01": ("php licen[cs]e",),
    "Ruby": ("ruby licen[cs]e",),
    "Vim": ("vim licen[cs]e",),
    "OpenSSL": ("openssl licen[cs]e",),
    "OFL-1.1": ("sil open font licen[cs]e", "open font licen[cs]e"),
    "MS-PL": ("microsoft public licen[cs]e",),
    "MS-RL": ("microsoft reciprocal licen[cs]e",),
    "NCSA": ("university of illinois/ncsa open source licen[cs]e", "ncsa licen[cs]e"),
    "PostgreSQL": ("postgresql licen[cs]e",),
    "UPL-1.0": ("universal permissive licen[cs]e",),
    "ECL-2.0": ("educational community licen[cs]e",),
    "IPL-1.0": ("ibm public licen[cs]e",),
    "LPPL-1.3c": ("latex project public licen[cs]e",),
    "CECILL-2.1": ("cecill free software licen[cs]e", "cecill licen[cs]e"),
    "MulanPSL-2.0": ("mulan permissive software licen[cs]e",),
    "NPL-1.1": ("netscape public licen[cs]e",),
    "QPL-1.0": ("q public licen[cs]e",),
    "RPL-1.5": ("reciprocal public licen[cs]e",),
    "Sleepycat": ("sleepycat licen[cs]e",),
    "SISSL": ("sun industry standards source licen[cs]e",),
    "W3C": ("w3c software (?:notice and )?licen[cs]e",),
    "ZPL-2.1": ("zope public licen[cs]e",),
    "ODbL-1.0": ("open (?:data commons open )?database licen[cs]e",),
    "ODC-By-1.0": ("open data commons attribution licen[cs]e",),
    "PDDL-1.0": ("public domain dedication and licen[cs]e",),
    "OGL-UK-3.0": ("open government licen[cs]e",),
    "CC0-1.0": ("cc0(?: 1\\.0)?(?: universal)?(?: licen[cs]e)?", "creative commons zero(?: licen[cs]e)?"),
    "BlueOak-1.0.0": ("blue oak model licen[cs]e",),
    "OpenRAIL": ("open(?: and responsible|)[ -]?rail[- ]?m? licen[cs]e", "bigscience open ?rail-m licen[cs]e"),
}
# Parts of Creative Commons licences, and their versions.
CC_PARTS = {"BY": "attribution", "BY-SA": "attribution[- ]share ?alike",
            "BY-ND": "attribution[- ]no ?deriv(?:ative)?s?",
            "BY-NC": "attribution[- ]non[- ]?commercial",
            "BY-NC-SA": "attribution[- ]non[- ]?commercial[- ]share ?alike",
            "BY-NC-ND": "attribution[- ]non[- ]?commercial[- ]no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Addresses of licence texts.
ADDRESSES = {
    "Apache-2.0": "apache\\.org/licenses/license-2\\.0", "MIT": "opensource\\.org/licenses?/mit",
    "BSD-3-Clause": "opensource\\.org/licenses?/bsd-3-clause",
    "BSD-2-Clause": "opensource\\.org/licenses?/bsd-2-clause",
    "ISC": "opensource\\.org/licenses?/isc", "GPL-2.0": "gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0",
    "GPL-3.0": "gnu\\.org/licenses/gpl(?:-3\\.0)?", "LGPL-3.0": "gnu\\.org/licenses/lgpl(?:-3\\.0)?",
    "LGPL-2.1": "gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1",
    "AGPL-3.0": "gnu\\.org/licenses/agpl(?:-3\\.0)?", "MPL-2.0": "mozilla\\.org/(?:en-us/)?mpl/2\\.0",
    "EPL-2.0": "eclipse\\.org/legal/epl-2\\.0", "Unlicense": "unlicense\\.org",
    "CC0-1.0": "creativecommons\\.org/publicdomain/zero/1\\.0", "WTFPL": "wtfpl\\.net",
    "BSL-1.0": "boost\\.org/license_1_0", "OFL-1.1": "scripts\\.sil\\.org/ofl",
    "ODbL-1.0": "opendatacommons\\.org/licenses/odbl", "PDDL-1.0": "opendatacommons\\.org/licenses/pddl",
}
# Phrases of licence texts.
PHRASES = {
    "MIT": ("permission is hereby granted, free of charge, to any person obtaining a copy",
            "the above copyright notice and this permission notice shall be included in all copies"),
    "ISC": ("permission to use, copy, modify, and(?:/or)? distribute this software for any purpose "
            "with or without fee is hereby granted",),
    "BSD": ("redistribution and use in source and binary forms, with or without modification",
            "redistributions of source code must retain the above copyright notice",
            "redistributions in binary form must reproduce the above copyright notice"),
    "BSD-3-Clause": ("neither the name of .{1,80}? nor the names of its contributors may be used",),
    "BSD-4-Clause": ("all advertising materials mentioning features or use of this software",),
    "Apache-2.0": ("you may not use this file except in compliance with the license",
                   "terms and conditions for use, reproduction, and distribution"),
    "GPL": ("under the terms of the gnu general public licen[cs]e",
            "this program is free software[;:,] you can redistribute it",
            "either version \\d(?:\\.\\d)? of the licen[cs]e, or \\(at your option\\) any later version"),
    "LGPL": ("under the terms of the gnu lesser general public licen[cs]e",
             "this library is free software[;:,] you can redistribute it"),
    "AGPL-3.0": ("under the terms of the gnu affero general public licen[cs]e",
                 "interacting with it remotely through a computer network"),
    "MPL-2.0": ("subject to the terms of the mozilla public licen[cs]e, v\\. 2\\.0",),
    "MPL": ("subject to the terms of the mozilla public licen[cs]e",),
    "Zlib": ("altered source versions must be plainly marked as such",
             "the origin of this software must not be misrepresented"),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "BSL-1.0": ("boost software license - version 1\\.0",),
    "Beerware": ("you can buy me a beer in return",),
    "WTFPL": ("you just do what the f[u*]ck you want to",),
    "OFL-1.1": ("the font software may be modified, altered, or added to",),
    "CC0-1.0": ("to the extent possible under law, .{1,80}? waived all copyright",),
    "public-domain": ("(?:is|are|been) (?:hereby )?(?:placed |released )?(?:in(?:to)? )?the public domain",
                      "dedicated to the public domain"),
    "proprietary": ("all rights reserved", "proprietary and confidential",
                    "unauthorized (?:copying|reproduction|use|distribution)",
                    "may not be (?:copied|reproduced|distributed) without"),
    "warranty-disclaimer": ("provided \"?as is\"?,? without warranty of any kind",
                            "without even the implied warranty of merchantability"),
}

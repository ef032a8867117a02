"""License scans of texts: ordered signature rules behind a keyword filter."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, pieces, small_batches

# Label, a keyword that every signature of the family contains, its names, and its identifiers.
FAMILIES = [
    ("mit", "mit", r"mit(?: |/x11 |-style )?licen[cs]e|mit/x11|expat licen[cs]e \(mit\)", "mit"),
    ("x11", "x11", r"x11 licen[cs]e", "x11"),
    ("isc", "isc", r"isc licen[cs]e", "isc"),
    ("apache", "apache", r"apache licen[cs]e,? ?(?:version|v\.?) ?2(?:\.0)?|apache(?: software)? licen[cs]e|apache[- ]2\.0", r"apache-[12]\.[01]"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,? ?(?:version|v\.?) ?1\.1", r"apache-1\.1"),
    ("bsd", "bsd", r"bsd licen[cs]e|bsd-style licen[cs]e|berkeley licen[cs]e \(bsd\)", "bsd"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[cs]e|bsd 2-clause licen[cs]e", "bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd licen[cs]e|bsd 3-clause licen[cs]e", "bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause) bsd licen[cs]e|bsd 4-clause licen[cs]e", "bsd-4-clause"),
    ("0bsd", "bsd", r"zero[- ]clause bsd|bsd zero[- ]clause licen[cs]e", "0bsd"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", r"gpl-[123]\.0(?:-only|-or-later|\+)? general public"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:as published by .{0,60})?(?:version|v\.?) ?2(?:\.0)?", r"gpl-2\.0 general public"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:as published by .{0,60})?(?:version|v\.?) ?3(?:\.0)?", r"gpl-3\.0 general public"),
    ("gpl", "gpl", r"gnu gpl|gpl(?:v[123]| licen[cs]e| version [123])", r"gpl-[123]\.0(?:-only|-or-later|\+)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e", "lesser general"),
    ("lgpl", "lgpl", r"gnu lgpl|lgpl(?:v[23]| licen[cs]e| version [23])", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public licen[cs]e", "library general"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "affero"),
    ("agpl", "agpl", r"gnu agpl|agpl(?:v3| licen[cs]e| version 3)", r"agpl-3\.0(?:-only|-or-later)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e(?:,? (?:version|v\.?) ?[12]\.[01])?", "mozilla"),
    ("mpl", "mpl", r"mpl[- ]?(?:v\.?)?[12]\.[01]", r"mpl-[12]\.[01]"),
    ("epl", "eclipse", r"eclipse public licen[cs]e(?:,? (?:version|v\.?) ?[12]\.0)?", "eclipse"),
    ("epl", "epl", r"epl[- ]?(?:v\.?)?[12]\.0", r"epl-[12]\.0"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?", "eclipse-distribution"),
    ("cddl", "development and distribution", r"common development and distribution licen[cs]e(?:,? (?:version|v\.?) ?1\.[01])?", "development and distribution"),
    ("cddl", "cddl", r"cddl(?:[- ]?(?:v\.?)?1\.[01]| licen[cs]e)", r"cddl-1\.[01]"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?", "common public"),
    ("artistic", "artistic", r"artistic licen[cs]e(?:,? (?:version|v\.?)? ?[12]\.0)?", r"artistic-[12]\.0"),
    ("zlib", "zlib", r"zlib licen[cs]e|zlib/libpng licen[cs]e", "zlib"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?", "boost"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[cs]e", "what the fuck"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?", "wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?:[- ]?1\.0)?(?: universal)?", r"cc0-1\.0"),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?:,? ?(?:v\.?)?1\.0)?", "creative commons"),
    ("cc-by", "creative commons", r"creative commons attribution(?: licen[cs]e)?(?:,? (?:version )?[1-4]\.[05])?(?: international)?", "creative commons"),
    ("cc-by", "cc by", r"cc by(?: [1-4]\.[05])?", r"cc by"),
    ("cc-by", "cc-by", r"cc-by(?:-[1-4]\.[05])?(?![\w-])", r"cc-by-[1-4]\.[05]"),
    ("cc-by-sa", "sharealike", r"creative commons attribution[- ]sharealike(?: [1-4]\.[05])?", "sharealike"),
    ("cc-by-sa", "cc by-sa", r"cc by-sa(?: [1-4]\.[05])?", "cc by-sa"),
    ("cc-by-sa", "cc-by-sa", r"cc-by-sa(?:-[1-4]\.[05])?", r"cc-by-sa-[1-4]\.[05]"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution[- ]non-?commercial(?: [1-4]\.[05])?", "noncommercial"),
    ("cc-by-nc", "cc by-nc", r"cc by-nc(?: [1-4]\.[05])?", "cc by-nc"),
    ("cc-by-nd", "noderiv", r"creative commons attribution[- ]noderiv(?:ative)?s(?: [1-4]\.[05])?", "noderivs"),
    ("cc-by-nd", "cc by-nd", r"cc by-nd(?: [1-4]\.[05])?", "cc by-nd"),
    ("psf", "python software foundation", r"python software foundation licen[cs]e", "python software foundation"),
    ("php-3.01", "php", r"php licen[cs]e(?:,? (?:version|v\.?) ?3\.0?1)?", r"php-3\.0?1"),
    ("ruby", "ruby", r"ruby(?:'s)? licen[cs]e", "ruby"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?:,? (?:version|v\.?) ?1\.1)?", "open font"),
    ("eupl", "european union", r"european union public licen[cs]e(?:,? (?:version|v\.?) ?1\.[12])?", "european union"),
    ("eupl", "eupl", r"eupl(?:[- ]?(?:v\.?)?1\.[12])?", r"eupl-1\.[12]"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", "microsoft public"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa (?:open source )?licen[cs]e", "ncsa"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?:,? (?:version|v\.?) ?1\.[123])?", "free documentation"),
    ("odbl", "open database", r"open database licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?", "open database"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", "open data commons"),
    ("sspl", "server side public", r"server side public licen[cs]e(?:,? (?:version|v\.?) ?1)?", "server side public"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?:,? (?:version|v\.?) ?1\.1)?", "business source"),
    ("elastic", "elastic", r"elastic licen[cs]e(?:,? (?:version|v\.?) ?2(?:\.0)?)?", r"elastic-2\.0"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?:-m|\+\+)?(?: licen[cs]e)?", "openrail"),
    ("llama", "llama", r"llama ?[0-9.]* community licen[cs]e", "llama"),
]
# What stands around a family's name or identifier (priority, weight of the evidence, pattern).
FRAMES = [
    (90, 1.0, r"(?:is |are |be |code |work )?licen[cs]ed (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{names})"),
    (85, 0.95, r"(?:released|distributed|published|provided|made available|available|issued|shared|offered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{names})"),
    (80, 0.9, r"(?:subject to|governed by|in compliance with|according to|in accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{names})"),
    (75, 0.9, r"(?:copy|text|terms|conditions) of (?:the )?(?:{names})"),
    (100, 1.0, r"(?:spdx-)?licen[cs]e(?:-identifier)?:? ?(?:=|:) ?[\"']?(?:{ids}|{names})[\"']?"),
    (70, 0.8, r"(?:permitted|allowed|granted|covered) (?:by|under) (?:the )?(?:{names})"),
    (50, 0.7, r"(?:the )?(?:{names})"),
]
# Signatures that belong to no family (label, keyword, priority, weight, pattern).
OTHERS = [
    ("proprietary", "rights reserved", 60, 0.6, r"(?:all )?rights reserved"),
    ("proprietary", "confidential", 65, 0.7, r"(?:proprietary and|strictly) confidential"),
    ("proprietary", "without permission", 65, 0.7, r"(?:may|must) not be (?:copied|reproduced|distributed|used) without (?:prior )?(?:written )?permission"),
    ("proprietary", "without permission", 66, 0.7, r"(?:no part|none) of this .{0,60} without permission"),
    ("public-domain", "public domain", 60, 0.8, r"(?:in|into|to|dedicated to) the public domain"),
    ("public-domain", "public domain", 55, 0.6, r"public domain"),
    ("mit", "permission is hereby granted", 95, 1.0, r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use, copy", 95, 1.0, r"permission to use, copy, modify, and(?:/or)? distribute this software"),
    ("bsd", "redistribution and use", 95, 1.0, r"redistribution and use in source and binary forms"),
    ("unlicense", "free and unencumbered", 95, 1.0, r"free and unencumbered software released into the public domain"),
    ("zlib", "'as-is', without any", 95, 1.0, r"provided 'as-is', without any express or implied warranty"),
    ("bsl-1.0", "boost software", 95, 1.0, r"boost software license - version 1\.0"),
    ("apache", "apache.org/licenses", 88, 1.0, r"https?://(?:www\.)?apache\.org/licenses(?:/license-2\.0)?"),
    ("gpl", "gnu.org/licenses", 87, 0.9, r"https?://(?:www\.)?gnu\.org/licenses(?:/gpl)?"),
    ("cc", "creativecommons.org", 88, 0.9, r"https?://creativecommons\.org/(?:licenses|publicdomain)/[a-z0-9./-]*"),
    ("osi", "opensource.org/licenses", 60, 0.7, r"https?://(?:www\.)?opensource\.org/licenses/[a-z0-9.-]*"),
    ("mpl", "mozilla.org/mpl", 88, 1.0, r"https?://(?:www\.)?mozilla\.org/mpl/[0-9./]*"),
]
# Signatures of single licenses in their own words: headers, notices, grants, clauses and references.
NOTICES = [
    ("mit", "the software is provided", 92, 0.8, r"the software is provided [\"']as is[\"'], without warranty of any kind, express or implied"),
    ("mit", "shall be included in all copies", 92, 0.9, r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies"),
    ("mit", "hereby granted, without written agreement", 91, 0.8, r"permission is hereby granted, without written agreement and without (?:license or )?royalty fees"),
    ("mit-0", "mit no attribution", 93, 1.0, r"mit no attribution(?: licen[cs]e)?"),
    ("mit-0", "mit-0", 93, 1.0, r"mit-0"),
    ("x11", "x consortium", 92, 0.9, r"(?:except as contained in this notice, the name of )?(?:the )?x consortium (?:shall not be used in advertising|licen[cs]e)"),
    ("isc", "internet systems consortium", 90, 0.7, r"copyright .{0,60}internet systems consortium"),
    ("isc", "provided that the above copyright notice", 89, 0.8, r"for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("hpnd", "historical permission notice", 93, 1.0, r"historical permission notice and disclaimer"),
    ("apache", "licensed under the apache", 96, 1.0, r"licensed under the apache license, version 2\.0 \(the [\"']?license[\"']?\)"),
    ("apache", "you may not use this file except in compliance", 97, 1.0, r"you may not use this file except in compliance with the license"),
    ("apache", "contributor license agreements", 90, 0.8, r"one or more contributor license agreements"),
    ("apache", "unless required by applicable law", 91, 0.8, r"unless required by applicable law or agreed to in writing, software distributed under the license"),
    ("apache", "grant of patent license", 88, 0.7, r"grant of patent license\. subject to the terms and conditions of this license"),
    ("apache", "apache software foundation", 80, 0.5, r"licensed to the apache software foundation"),
    ("apache-1.0", "developed by the apache group", 93, 0.9, r"this product includes software developed by the apache group"),
    ("apache-1.1", "developed by the apache software foundation", 94, 0.9, r"this product includes software developed by the apache software foundation"),
    ("bsd-2-clause", "this list of conditions", 90, 0.7, r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither the name of", 94, 0.95, r"neither the name of .{1,80} nor the names of (?:its|any|the) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials", 95, 1.0, r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-2-clause", "the views and conclusions contained", 91, 0.8, r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd", "regents of the university of california", 85, 0.7, r"regents of the university of california"),
    ("bsd", "use of this source code is governed by a bsd", 96, 1.0, r"use of this source code is governed by a bsd(?:-style)? licen[cs]e"),
    ("bsd-3-clause-clear", "clear bsd", 93, 1.0, r"clear bsd licen[cs]e"),
    ("bsd-3-clause-clear", "to any party's patent rights", 93, 0.9, r"no express or implied licenses to any party's patent rights are granted"),
    ("bsd-patent", "bsd-2-clause-patent", 94, 1.0, r"bsd-2-clause-patent"),
    ("bsd-patent", "plus patent", 93, 0.95, r"bsd[- +]+plus patents?"),
    ("bsd-source-code", "bsd source code attribution", 94, 1.0, r"bsd source code attribution"),
    ("0bsd", "free public", 92, 0.9, r"free public licen[cs]e 1\.0\.0"),
    ("gpl", "it under the terms of the gnu general public license", 97, 1.0, r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", "either version 2", 98, 1.0, r"general public license as published by the free software foundation[;,] either version 2 of the license, or \(at your option\) any later version"),
    ("gpl-3.0-or-later", "either version 3", 98, 1.0, r"general public license as published by the free software foundation[;,] either version 3 of the license, or \(at your option\) any later version"),
    ("gpl-2.0-only", "version 2 only", 96, 0.9, r"(?:gpl|general public license),? (?:as published by the free software foundation,? )?version 2 only"),
    ("gpl", "you should have received a copy of the gnu general", 92, 0.9, r"you should have received a copy of the gnu general public license"),
    ("gpl", "without even the implied warranty", 88, 0.6, r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license"),
    ("gpl-2.0", "51 franklin", 84, 0.6, r"free software foundation, inc\.,? 51 franklin"),
    ("gpl-2.0", "59 temple", 84, 0.6, r"59 temple place"),
    ("gpl-3.0", "29 june 2007", 93, 0.9, r"gnu general public license,? version 3, 29 june 2007"),
    ("gpl-2.0", "june 1991", 93, 0.9, r"gnu general public license,? version 2, june 1991"),
    ("gpl-classpath", "classpath exception", 95, 1.0, r"gpl.{0,40}classpath exception"),
    ("gpl-classpath", "linking this library statically", 95, 0.9, r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-font", "font exception", 93, 0.9, r"gpl.{0,40}font exception"),
    ("gpl-gcc", "gcc runtime library exception", 95, 1.0, r"gcc runtime library exception"),
    ("gpl-autoconf", "autoconf exception", 93, 0.9, r"autoconf exception"),
    ("gpl-bison", "bison exception", 93, 0.9, r"bison exception"),
    ("gpl-bison", "bison parser", 92, 0.8, r"special exception.{0,40}bison parser"),
    ("lgpl-2.1", "gnu lesser general public license", 96, 1.0, r"gnu lesser general public license as published by the free software foundation[;,] either version 2\.1"),
    ("lgpl-2.1", "february 1999", 93, 0.9, r"gnu lesser general public license,? version 2\.1, february 1999"),
    ("lgpl-3.0", "lesser general public license", 95, 0.9, r"lesser general public license,? (?:version|v\.?) ?3(?:\.0)?"),
    ("lgpl-2.0", "gnu library general public", 94, 0.95, r"gnu library general public licen[cs]e(?: as published by the free software foundation)?"),
    ("agpl-3.0", "19 november 2007", 94, 0.95, r"gnu affero general public license,? version 3, 19 november 2007"),
    ("agpl-3.0", "remote network interaction", 90, 0.8, r"remote network interaction; use with the gnu general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla", 97, 1.0, r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("mpl-1.1", "subject to the mozilla public license version", 97, 1.0, r"the contents of this file are subject to the mozilla public license version 1\.[01]"),
    ("mpl-2.0", "if a copy of the mpl was not distributed", 95, 0.95, r"if a copy of the mpl was not distributed with this file"),
    ("mpl-2.0", "incompatible with secondary licenses", 92, 0.9, r"incompatible with secondary licenses"),
    ("npl", "netscape public", 92, 0.95, r"netscape public licen[cs]e(?:,? (?:version|v\.?) ?1\.[01])?"),
    ("epl-2.0", "eclipse public license 2.0", 96, 1.0, r"terms of the eclipse public license 2\.0"),
    ("epl-1.0", "eclipse public license v1.0", 96, 1.0, r"terms of the eclipse public license v1\.0"),
    ("epl", "eclipse.org", 90, 0.9, r"https?://(?:www\.)?eclipse\.org/(?:legal|org/documents)/epl-[a-z0-9.-]*"),
    ("cddl-1.0", "opensolaris", 92, 0.8, r"usr/src/opensolaris\.license|opensolaris\.org/os/licensing"),
    ("cddl", "subject to the terms of the common development", 95, 1.0, r"subject to the terms of the common development and distribution license"),
    ("ibm-pl", "ibm public", 92, 0.95, r"ibm public licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?"),
    ("apsl", "apple public source", 94, 1.0, r"apple public source licen[cs]e(?:,? (?:version|v\.?) ?[12]\.[012])?"),
    ("artistic-1.0", "the artistic license 1.0", 93, 1.0, r"the artistic license 1\.0"),
    ("artistic-1.0", "under which a package may be copied", 85, 0.8, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "artistic license 2.0", 93, 1.0, r"artistic license 2\.0"),
    ("perl", "same terms as perl", 94, 0.95, r"(?:under|with) the same terms as perl(?: itself| 5)?"),
    ("python-2.0", "beopen", 90, 0.8, r"beopen\.com (?:license agreement|open source license)"),
    ("cnri-python", "cnri", 88, 0.7, r"cnri (?:open source )?licen[cs]e agreement"),
    ("zpl", "zope public", 93, 1.0, r"zope public licen[cs]e(?:,? \(?zpl\)?)?(?:,? (?:version|v\.?) ?[12]\.[01])?"),
    ("zlib", "altered source versions must be plainly marked", 94, 1.0, r"altered source versions must be plainly marked as such"),
    ("zlib", "the origin of this software must not be misrepresented", 94, 1.0, r"the origin of this software must not be misrepresented"),
    ("libpng", "libpng", 80, 0.8, r"libpng licen[cs]e(?: version 2)?|this code is released under the libpng license"),
    ("ijg", "independent jpeg group", 88, 0.85, r"based in part on the work of the independent jpeg group"),
    ("curl", "daniel stenberg", 85, 0.7, r"copyright \(c\) .{0,20}daniel stenberg"),
    ("openssl", "openssl toolkit", 92, 0.95, r"developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "ssleay", 90, 0.9, r"original ssleay licen[cs]e"),
    ("ssleay", "written by eric young", 90, 0.9, r"cryptographic software written by eric young"),
    ("bsl-1.0", "distributed under the boost", 96, 1.0, r"distributed under the boost software license, version 1\.0"),
    ("bsl-1.0", "license_1_0.txt", 93, 0.95, r"(?:accompanying file|copy at) .{0,40}license_1_0\.txt"),
    ("unlicense", "unlicense.org", 94, 1.0, r"https?://(?:www\.)?unlicense\.org/?"),
    ("unlicense", "anyone is free to copy, modify", 93, 0.95, r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "you just do what the fuck", 95, 1.0, r"you just do what the fuck you want to"),
    ("beerware", "beer-ware", 94, 1.0, r"the beer-ware licen[cs]e"),
    ("beerware", "buy me a beer", 90, 0.8, r"you can buy me a beer in return"),
    ("postcardware", "postcardware", 85, 0.8, r"postcardware"),
    ("blessing", "may you do good and not evil", 94, 0.95, r"may you do good and not evil"),
    ("json", "shall be used for good, not evil", 95, 1.0, r"the software shall be used for good, not evil"),
    ("jsr", "java specification request", 70, 0.5, r"java specification request .{0,40}licen[cs]e"),
    ("cc0-1.0", "waived all copyright and related", 95, 1.0, r"waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "publicdomain/zero", 95, 1.0, r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-pdm", "publicdomain/mark", 93, 0.9, r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by-4.0", "licenses/by/4.0", 95, 1.0, r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-3.0", "licenses/by/3.0", 95, 1.0, r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-2.0", "licenses/by/2.0", 95, 1.0, r"creativecommons\.org/licenses/by/2\.0"),
    ("cc-by-sa-4.0", "licenses/by-sa/4.0", 95, 1.0, r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-sa-3.0", "licenses/by-sa/3.0", 95, 1.0, r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-nc-4.0", "licenses/by-nc/4.0", 95, 1.0, r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nd-4.0", "licenses/by-nd/4.0", 95, 1.0, r"creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-nc-sa", "licenses/by-nc-sa", 95, 1.0, r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]"),
    ("cc-by-nc-nd", "licenses/by-nc-nd", 95, 1.0, r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]"),
    ("cc-by-nc-sa", "by-nc-sa", 90, 0.9, r"cc[- ]by-nc-sa(?:[- ][1-4]\.[05])?"),
    ("cc-by-nc-nd", "by-nc-nd", 90, 0.9, r"cc[- ]by-nc-nd(?:[- ][1-4]\.[05])?"),
    ("cc-by-sa", "share alike", 84, 0.8, r"attribution[- ]share alike(?: [1-4]\.[05])?(?: unported| international)?"),
    ("cc-sampling", "sampling plus", 85, 0.8, r"creative commons sampling plus"),
    ("gfdl", "no invariant sections", 94, 0.95, r"with no invariant sections, (?:with )?no front-cover texts"),
    ("gfdl", "terms of the gnu free documentation", 96, 1.0, r"copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("ofl-1.1", "reserved font name", 93, 0.95, r"with reserved font name"),
    ("ofl-1.1", "scripts.sil.org/ofl", 94, 1.0, r"scripts\.sil\.org/ofl"),
    ("bitstream-vera", "bitstream vera", 90, 0.9, r"bitstream vera(?: fonts)? (?:copyright|licen[cs]e|is a trademark)"),
    ("ubuntu-font", "ubuntu font licence", 93, 1.0, r"ubuntu font licence(?: version 1\.0)?"),
    ("ncsa", "all rights to use, copy, modify", 60, 0.3, r"all rights to use, copy, modify"),
    ("ncsa", "llvm release license", 92, 0.9, r"llvm release license"),
    ("apache-llvm", "llvm exceptions", 97, 1.0, r"apache license v2\.0 with llvm exceptions|llvm exceptions to the apache 2\.0 license"),
    ("apache-llvm", "llvm-exception", 97, 1.0, r"apache-2\.0 with llvm-exception"),
    ("ms-pl", "ms-pl", 90, 0.95, r"ms-pl"),
    ("ms-rl", "microsoft reciprocal", 93, 1.0, r"microsoft reciprocal licen[cs]e(?: \(ms-rl\))?"),
    ("ms-limited", "microsoft limited", 88, 0.8, r"microsoft limited public licen[cs]e"),
    ("eupl", "licensed under the eupl", 96, 1.0, r"licensed under the eupl(?:,? (?:version|v\.?) ?1\.[12])?"),
    ("cecill", "cecill", 92, 0.95, r"cecill(?:-[bc])?(?: free software)? licen[cs]e(?: agreement)?|governed by the cecill(?:-[bc])? license"),
    ("mulan", "mulan psl", 94, 1.0, r"mulan psl ?v[12]"),
    ("mulan", "mulan permissive", 94, 1.0, r"mulan permissive software licen[cs]e"),
    ("upl-1.0", "universal permissive", 94, 1.0, r"universal permissive licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?"),
    ("afl", "academic free", 93, 1.0, r"academic free licen[cs]e(?:,? (?:version|v\.?) ?[123]\.[012])?"),
    ("osl", "open software license", 92, 1.0, r"open software license(?:,? (?:version|v\.?) ?[123]\.[01])?"),
    ("ecl-2.0", "educational community", 93, 1.0, r"educational community licen[cs]e(?:,? (?:version|v\.?) ?[12]\.0)?"),
    ("qpl", "q public", 92, 1.0, r"q public licen[cs]e(?:,? (?:version|v\.?) ?1\.0)?"),
    ("lppl", "latex project public", 94, 1.0, r"latex project public licen[cs]e(?:,? (?:version|v\.?) ?1\.[0-3][abc]?)?"),
    ("w3c", "w3c software", 93, 0.95, r"w3c software (?:and document )?(?:notice and )?licen[cs]e"),
    ("ogl", "open government licence", 93, 1.0, r"open government licence(?: v[123]\.0)?"),
    ("pddl", "public domain dedication and license", 93, 1.0, r"(?:open data commons )?public domain dedication and license"),
    ("cdla", "community data license agreement", 93, 1.0, r"community data license agreement(?: - (?:permissive|sharing))?"),
    ("sleepycat", "sleepycat", 90, 0.9, r"sleepycat (?:public )?licen[cs]e|oracle berkeley db.{0,30}sleepycat"),
    ("vim", "vim license", 88, 0.9, r"vim license"),
    ("tcl", "tcl/tk license", 88, 0.9, r"tcl/tk license"),
    ("sgi-b", "sgi free software", 92, 0.95, r"sgi free software licen[cs]e b"),
    ("imagemagick", "imagemagick license", 90, 0.95, r"imagemagick license"),
    ("ftl", "freetype project", 90, 0.9, r"freetype project licen[cs]e|portions of this software are copyright .{0,20} the freetype project"),
    ("icu", "unicode, inc.", 85, 0.7, r"unicode, inc\. licen[cs]e agreement"),
    ("icu", "icu license", 88, 0.9, r"icu license"),
    ("naist", "nara institute of science", 88, 0.85, r"nara institute of science and technology"),
    ("nasa", "nasa open source", 93, 1.0, r"nasa open source agreement(?:,? (?:version|v\.?) ?1\.3)?"),
    ("sspl-1.0", "sspl", 88, 0.95, r"sspl(?:[- ]?(?:v\.?)?1(?:\.0)?)?"),
    ("commons-clause", "commons clause", 94, 1.0, r"[\"']?commons clause[\"']? licen[cs]e condition|commons clause"),
    ("busl-1.1", "change date", 80, 0.5, r"change date: ?.{1,40} change license"),
    ("elastic", "elastic license 2.0", 95, 1.0, r"elastic license 2\.0(?: \(elv2\))?"),
    ("elastic", "elv2", 90, 0.9, r"elv2"),
    ("polyform", "polyform", 93, 1.0, r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[cs]e(?: 1\.0\.0)?"),
    ("hippocratic", "hippocratic", 90, 0.95, r"hippocratic licen[cs]e"),
    ("anti-996", "anti 996", 90, 0.95, r"anti 996 licen[cs]e"),
    ("bigscience-rail", "bigscience rail", 93, 1.0, r"bigscience rail licen[cs]e(?: v1\.0)?"),
    ("gemma", "gemma terms", 92, 0.95, r"gemma terms of use"),
    ("nvidia", "nvidia software license", 90, 0.9, r"nvidia software license agreement"),
    ("intel-simplified", "intel simplified software", 92, 0.95, r"intel simplified software licen[cs]e"),
    ("oracle-bcl", "oracle binary code", 92, 0.95, r"oracle binary code licen[cs]e agreement"),
    ("sun-bcl", "sun microsystems, inc. binary", 90, 0.9, r"sun microsystems, inc\. binary code license agreement"),
    ("public-domain", "released into the public domain", 82, 0.8, r"(?:has been |is |hereby )?released into the public domain"),
    ("public-domain", "no rights reserved", 80, 0.7, r"no rights reserved"),
    ("proprietary", "unpublished rights reserved", 75, 0.8, r"unpublished rights reserved under the copyright laws"),
    ("proprietary", "trade secret", 70, 0.7, r"(?:contains|valuable) (?:proprietary information and )?trade secrets? (?:of|and)"),
    ("proprietary", "end user license agreement", 78, 0.8, r"end user license agreement"),
    ("proprietary", "internal use only", 72, 0.7, r"(?:for )?internal use only"),
    ("proprietary", "distribution is", 74, 0.8, r"(?:re)?distribution is (?:strictly )?prohibited"),
    ("proprietary", "unauthorized copying", 76, 0.8, r"unauthorized copying of this (?:file|work|material),? via any medium is strictly prohibited"),
    ("freeware", "freeware", 60, 0.6, r"(?:this (?:program|software) is |as )freeware"),
    ("shareware", "shareware", 60, 0.6, r"(?:this (?:program|software) is |as )shareware"),
]
# Words in a row, and their label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


class Rule(NamedTuple):
    label: str
    keyword: bytes
    priority: int
    weight: float
    pattern: re.Pattern[bytes]


@lru_cache(maxsize=1)
def rules() -> dict[bytes, list[Rule]]:
    """All rules by keyword: every frame around every family, and those of no family."""
    found = defaultdict(list)
    edge = r"(?<![0-9a-z\x80-\xff]){}(?![0-9a-z\x80-\xff])"

    def add(label: str, keyword: str, priority: int, weight: float, pattern: str) -> None:
        spaced = edge.format(f"(?:{pattern})").replace("[- ]", r"[-\s]").replace(" ?", r"\s*").replace(" ", r"\s+")
        found[keyword.encode()].append(Rule(label, keyword.encode(), priority, weight, re.compile(spaced.encode("latin-1"))))

    for label, keyword, names, ids in FAMILIES:
        more = 5 * bool(re.search(r"\d|-", label))  # the closer signature goes first
        for priority, weight, frame in FRAMES:
            add(label, keyword, priority + more, weight, frame.replace("{names}", names).replace("{ids}", ids))
    for x in (*OTHERS, *NOTICES):
        add(*x)
    return dict(found)


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int
    weight: float


def settle(found: list[Detection]) -> list[Detection]:
    """Detections by falling priority, then length, without those that lie inside one that was kept.

    The kept ones that no other kept one holds have rising starts and ends, so one lookup finds the one that could hold the
    next."""
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    for x in sorted(set(found), key=lambda x: (-x.priority, x.start - x.end, x.start, x.label)):
        at = bisect_right(starts, x.start)
        if at and ends[at - 1] >= x.end:
            continue
        kept.append(x)
        # What lies inside the new one holds nothing more than it does.
        low, high = bisect_left(starts, x.start), bisect_right(ends, x.end)
        starts[low : max(low, high)], ends[low : max(low, high)] = [x.start], [x.end]
    return sorted(kept)


# For keywords that not every signature of theirs contains, what all contain.
_GATES = {b"noncommercial": b"commercial", b"without permission": b"permission"}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes with one space for each run of white space, as keywords have it, and the texts' offsets in them."""
    space = _SPACE[data]
    keep = ~space
    keep[:1] = True
    keep[1:] |= ~space[:-1]
    return np.where(space, np.uint8(32), data)[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[offsets]


def detect(text: bytes, keywords: list[bytes] | None = None) -> list[Detection]:
    """What the rules find in a lower-cased text; keywords: those that it is known to contain."""
    found = []
    plain = squeezed(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))[0] if keywords is None else b""
    for keyword in rules() if keywords is None else keywords:
        if keywords is not None or _GATES.get(keyword, keyword) in plain:
            for rule in rules()[keyword]:
                found += [Detection(*m.span(), rule.label, rule.priority, rule.weight) for m in rule.pattern.finditer(text)]
    return settle(found)


def _places(data: bytes, word: bytes) -> Iterator[int]:
    at = data.find(word)
    while at >= 0:
        yield at
        at = data.find(word, at + 1)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of doc_id, text (null: empty): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where a phrase's words stand in a row, first_word and last_word are the first and last of
    these places. labels holds the base labels and those of the settled detections; score is the strongest evidence, 0.6
    for a base phrase alone and 0 for none. Repeated rows give repeated results."""
    small_batches(docs.sparkSession)
    phrases = [(tuple(x.encode() for x in words.split()), label) for words, label in PHRASES]
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, "text")):
            words = Words(batch.column(1))
            data, n = words.data.tobytes(), batch.num_rows
            word = lambda i: data[words.first[i] : words.last[i]]  # noqa: B023, E731
            base: dict[int, list[tuple[int, str]]] = defaultdict(list)
            for at in _places(data, b"license"):
                i = int(np.searchsorted(words.first, at))
                if i == len(words.first) or words.first[i] != at or words.last[i] != at + 7:
                    continue
                doc = int(words.of[i])
                for phrase, label in phrases:
                    j = i - len(phrase) + 1
                    if j >= words.bounds[doc] and all(word(j + k) == x for k, x in enumerate(phrase)):
                        base[doc].append((j - int(words.bounds[doc]), label))
            gate: dict[int, list[bytes]] = defaultdict(list)
            plain, starts = squeezed(words.data, words.offsets)
            for keyword in rules():
                places = np.fromiter(_places(plain, _GATES.get(keyword, keyword)), np.int64)
                for doc in np.unique(np.searchsorted(starts, places, side="right") - 1).tolist():
                    gate[doc].append(keyword)
            cols: list[list] = [[0] * n, [None] * n, [None] * n, [""] * n, [""] * n, [0.0] * n]
            for doc in base.keys() | gate.keys():
                here, found = base.get(doc, []), detect(data[words.offsets[doc] : words.offsets[doc + 1]], gate.get(doc, []))
                if here:
                    cols[0][doc], cols[1][doc], cols[2][doc] = len(here), min(here)[0], max(here)[0]
                own = {x for _, x in here}
                cols[3][doc], cols[4][doc] = ",".join(sorted(own)), ",".join(sorted(own | {x.label for x in found}))
                cols[5][doc] = max([0.6 * bool(here), *(x.weight for x in found)])
            out = [batch.column(0), np.diff(words.bounds), *cols]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=list(names))

    shape = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, shape)

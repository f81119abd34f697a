"""Signature rules for licence statements, in order.

A rule is read against the words of a text: A-Z lowered, everything that is no letter, digit
or non-ASCII character turned into one blank. Lines are ``level label: pattern`` under the keyword that
the text must hold for the patterns to be tried. Levels, the stronger first: 4 wording of a licence
or notice, 3 identifier or address, 2 name with its version or variant, 1 bare name or hint.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LEVELS = {4: 0.99, 3: 0.95, 2: 0.8, 1: 0.55}

_SIGNATURES = r"""
[permission is hereby granted]
4 mit: permission is hereby granted free of charge to any person obtaining a copy of this software
4 mit: the above copyright notice and this permission notice shall be included in all copies
4 mit-0: to deal in the software without restriction .{0,200}subject to no conditions
4 bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software
4 ofl-1.1: permission is hereby granted free of charge to any person obtaining a copy of the font software
4 unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
4 ncsa: permission is hereby granted .{0,120}deal with the software without restriction
[to use copy modify]
4 curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
4 isc: permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
4 0bsd: permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided
4 hpnd: permission to use copy modify and distribute this software and its documentation for any purpose
4 x11: permission to use copy modify distribute and sell this software
4 postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
[redistribution and use]
4 bsd: redistribution and use in source and binary forms with or without modification are permitted
4 bsd-4-clause: redistribution and use in source and binary forms .{0,900}all advertising materials mentioning features
4 bsd-3-clause: redistribution and use in source and binary forms .{0,900}neither the names? of
4 bsd-1-clause: redistribution and use of this software in source form
4 freebsd-doc: redistribution and use in source sgml docbook and compiled forms
[neither the name]
4 bsd-3-clause: neither the names? of .{1,120}nor the names of (?:its|their|any) contributors may be used to endorse or promote
[advertising materials]
4 bsd-4-clause: all advertising materials mentioning features or use of this software must display
[provided as is]
4 warranty: the software is provided as is without warranty of any kind
4 warranty: this software is provided as is without (?:any )?express or implied warranty
4 warranty: this software is provided as is without warranty of any kind
4 zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
[origin of this software]
4 zlib: the origin of this software must not be misrepresented you must not claim that you wrote the original software
[gnu]
4 gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
4 lgpl: this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
4 gpl: you should have received a copy of the gnu general public licen[sc]e
4 lgpl: you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
4 agpl: you should have received a copy of the gnu affero general public licen[sc]e
4 gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
3 gpl: (?:https? )?(?:www )?gnu org licenses gpl(?: [123] 0)?(?: html| txt)?
3 lgpl: (?:https? )?(?:www )?gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?
3 agpl: (?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
3 gfdl: (?:https? )?(?:www )?gnu org licenses fdl(?: 1 [123])?(?: html| txt)?
2 gpl-3.0-or-later: gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
2 gpl-2.0-or-later: gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
2 gpl-3.0: gnu general public licen[sc]e(?: as published by the free software foundation)? v(?:ersion)? ?3(?: 0)?
2 gpl-2.0: gnu general public licen[sc]e(?: as published by the free software foundation)? v(?:ersion)? ?2(?: 0)?
2 gpl-1.0: gnu general public licen[sc]e v(?:ersion)? ?1(?: 0)?
2 gpl-3.0: gnu gpl v(?:ersion )?3(?: 0)?
2 gpl-2.0: gnu gpl v(?:ersion )?2(?: 0)?
2 lgpl-3.0: gnu lesser general public licen[sc]e v(?:ersion)? ?3(?: 0)?
2 lgpl-2.1: gnu lesser general public licen[sc]e v(?:ersion)? ?2 1
2 lgpl-2.0: gnu library general public licen[sc]e v(?:ersion)? ?2(?: 0)?
2 agpl-3.0: gnu affero general public licen[sc]e v(?:ersion)? ?3(?: 0)?
2 gfdl-1.3: gnu free documentation licen[sc]e v(?:ersion)? ?1 3
2 gfdl-1.2: gnu free documentation licen[sc]e v(?:ersion)? ?1 2
2 gfdl-1.1: gnu free documentation licen[sc]e v(?:ersion)? ?1 1
2 classpath-exception: gnu classpath exception
2 gpl-linking-exception: gnu gpl with(?: a)? linking exception
2 gcc-exception: gnu compiler collection runtime library exception
1 lgpl: gnu lesser general public licen[sc]e
1 lgpl: gnu library general public licen[sc]e
1 agpl: gnu affero general public licen[sc]e
1 gfdl: gnu free documentation licen[sc]e
1 gpl: gnu gpl
1 lgpl: gnu lgpl
1 agpl: gnu agpl
1 all-permissive: gnu all permissive licen[sc]e
[gpl]
2 gpl-3.0-or-later: gpl(?: v| version )? ?3(?: 0)? or later
2 gpl-2.0-or-later: gpl(?: v| version )? ?2(?: 0)? or later
2 gpl-3.0: gplv3
2 gpl-2.0: gplv2
2 lgpl-3.0: lgplv3
2 lgpl-2.1: lgplv2 1
2 agpl-3.0: agplv3
2 gpl-3.0: gpl v(?:ersion )?3
2 gpl-2.0: gpl v(?:ersion )?2
2 lgpl-3.0: lgpl v(?:ersion )?3
2 lgpl-2.1: lgpl v(?:ersion )?2 1
1 gpl: (?:under|of) the gpl
1 lgpl: (?:under|of) the lgpl
1 agpl: (?:under|of) the agpl
[general public licen]
1 gpl: (?:the )?general public licen[sc]e v(?:ersion)? ?[123]
1 cecill: cea cnrs inria .{0,80}general public licen[sc]e
1 igpl: (?:microsoft|ibm|adobe) general public licen[sc]e
[apache]
4 apache-2.0: licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance
4 apache-1.1: this product includes software developed by the apache software foundation
3 apache-2.0: (?:https? )?(?:www )?apache org licenses license 2 0(?: html| txt)?
2 apache-2.0: apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?
2 apache-2.0: apache(?: software)? licen[sc]e v2(?: 0)?
2 apache-1.1: apache(?: software)? licen[sc]e(?: version| v)? 1 1
2 apache-1.0: apache(?: software)? licen[sc]e(?: version| v)? 1 0
2 apache-2.0: apache 2(?: 0)? licen[sc]ed?
2 llvm-exception: apache licen[sc]e v2 0 with llvm exceptions?
1 apache: apache software licen[sc]e
1 apache: licensed to the apache software foundation
[mit license]
2 mit: (?:released|licensed|distributed|available) under the(?: terms of the)? mit license
2 mit-0: mit license no attribution
2 mit-modern-variant: mit license modern variant
1 mit: the mit license
1 expat: mit license expat
[mit licen]
1 mit: mit licen[sc]ed?
1 mit-or-apache-2.0: mit licen[sc]e or (?:the )?apache licen[sc]e
[opensource org]
3 mit: (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php| html)?
3 bsd-3-clause: (?:https? )?(?:www )?opensource org licenses bsd 3 clause
3 bsd-2-clause: (?:https? )?(?:www )?opensource org licenses bsd 2 clause
3 bsd: (?:https? )?(?:www )?opensource org licenses bsd license(?: php)?
3 apache-2.0: (?:https? )?(?:www )?opensource org licenses apache 2 0
3 isc: (?:https? )?(?:www )?opensource org licenses isc
3 mpl-2.0: (?:https? )?(?:www )?opensource org licenses mpl 2 0
3 gpl-3.0: (?:https? )?(?:www )?opensource org licenses gpl 3 0
3 gpl-2.0: (?:https? )?(?:www )?opensource org licenses gpl 2 0
3 lgpl: (?:https? )?(?:www )?opensource org licenses lgpl(?: 2 1| 3 0)?
3 artistic-2.0: (?:https? )?(?:www )?opensource org licenses artistic(?: license)? 2 0
3 epl: (?:https? )?(?:www )?opensource org licenses epl(?: 1 0| 2 0)?
3 zlib: (?:https? )?(?:www )?opensource org licenses zlib
3 cddl-1.0: (?:https? )?(?:www )?opensource org licenses cddl(?: 1 0| 1)?
[cc by]
2 cc-by-nc-nd: cc by nc nd(?: [1234] [05])?
2 cc-by-nc-sa: cc by nc sa(?: [1234] [05])?
2 cc-by-nc: cc by nc(?: [1234] [05])?
2 cc-by-nd: cc by nd(?: [1234] [05])?
2 cc-by-sa: cc by sa(?: [1234] [05])?
2 cc-by-4.0: cc by 4 0
2 cc-by-3.0: cc by 3 0
2 cc-by-2.5: cc by 2 5
2 cc-by-2.0: cc by 2 0
2 cc-by-1.0: cc by 1 0
[cc0]
2 cc0-1.0: cc0 1 0(?: universal)?
1 cc0: cc0
[creative commons]
4 cc: this work is licensed under a creative commons licen[sc]e
2 cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?
2 cc-by-nc-sa: creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
2 cc-by-nc: creative commons attribution non ?commercial(?: [1234] [05])?
2 cc-by-nd: creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?
2 cc-by-sa: creative commons attribution share ?alike(?: [1234] [05])?
2 cc-by-4.0: creative commons attribution 4 0(?: international)?
2 cc-by-3.0: creative commons attribution 3 0(?: unported| [a-z]+)?
2 cc-by: creative commons attribution(?: licen[sc]e)?
2 cc0-1.0: creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
2 cc-pd: creative commons public domain(?: dedication| mark)?
2 cc-sampling: creative commons sampling(?: plus)?
1 cc: creative commons licen[sc]e
1 cc: licensed under creative commons
[creativecommons org]
3 cc-by-nc-nd: creativecommons org licenses by nc nd(?: [1234] [05])?
3 cc-by-nc-sa: creativecommons org licenses by nc sa(?: [1234] [05])?
3 cc-by-nc: creativecommons org licenses by nc(?: [1234] [05])?
3 cc-by-nd: creativecommons org licenses by nd(?: [1234] [05])?
3 cc-by-sa: creativecommons org licenses by sa(?: [1234] [05])?
3 cc-by: creativecommons org licenses by(?: [1234] [05])?
3 cc0-1.0: creativecommons org publicdomain zero(?: 1 0)?
3 cc-pd: creativecommons org publicdomain mark(?: 1 0)?
[spdx license identifier]
3 mit: spdx license identifier mit
3 mit-0: spdx license identifier mit 0
3 apache-2.0: spdx license identifier apache 2 0
3 apache-1.1: spdx license identifier apache 1 1
3 llvm-exception: spdx license identifier apache 2 0 with llvm exception
3 gpl-2.0-or-later: spdx license identifier gpl 2 0 or later
3 gpl-2.0: spdx license identifier gpl 2 0(?: only)?
3 gpl-3.0-or-later: spdx license identifier gpl 3 0 or later
3 gpl-3.0: spdx license identifier gpl 3 0(?: only)?
3 linux-syscall-note: spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note
3 lgpl-2.1-or-later: spdx license identifier lgpl 2 1 or later
3 lgpl-2.1: spdx license identifier lgpl 2 1(?: only)?
3 lgpl-3.0-or-later: spdx license identifier lgpl 3 0 or later
3 lgpl-3.0: spdx license identifier lgpl 3 0(?: only)?
3 agpl-3.0: spdx license identifier agpl 3 0(?: only| or later)?
3 bsd-2-clause: spdx license identifier bsd 2 clause
3 bsd-2-clause-patent: spdx license identifier bsd 2 clause patent
3 bsd-3-clause: spdx license identifier bsd 3 clause
3 bsd-3-clause-clear: spdx license identifier bsd 3 clause clear
3 bsd-4-clause: spdx license identifier bsd 4 clause
3 0bsd: spdx license identifier 0bsd
3 isc: spdx license identifier isc
3 mpl-2.0: spdx license identifier mpl 2 0
3 mpl-1.1: spdx license identifier mpl 1 1
3 epl-1.0: spdx license identifier epl 1 0
3 epl-2.0: spdx license identifier epl 2 0
3 cddl-1.0: spdx license identifier cddl 1 0
3 cddl-1.1: spdx license identifier cddl 1 1
3 eupl-1.2: spdx license identifier eupl 1 2
3 eupl-1.1: spdx license identifier eupl 1 1
3 cc0-1.0: spdx license identifier cc0 1 0
3 cc-by-4.0: spdx license identifier cc by 4 0
3 cc-by-sa: spdx license identifier cc by sa [1234] [05]
3 cc-by-nc: spdx license identifier cc by nc [1234] [05]
3 unlicense: spdx license identifier unlicense
3 wtfpl: spdx license identifier wtfpl
3 zlib: spdx license identifier zlib
3 bsl-1.0: spdx license identifier bsl 1 0
3 artistic-2.0: spdx license identifier artistic 2 0
3 ofl-1.1: spdx license identifier ofl 1 1
3 postgresql: spdx license identifier postgresql
3 python-2.0: spdx license identifier (?:python 2 0|psf 2 0)
3 ncsa: spdx license identifier ncsa
3 busl-1.1: spdx license identifier busl 1 1
3 sspl-1.0: spdx license identifier sspl 1 0
3 x11: spdx license identifier x11
3 proprietary: spdx license identifier licenseref [a-z0-9]+
1 spdx: spdx license identifier
[mozilla]
4 mpl-2.0: this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
3 mpl-2.0: (?:https? )?(?:www )?mozilla org mpl 2 0
3 mpl-1.1: (?:https? )?(?:www )?mozilla org mpl mpl 1 1(?: html)?
2 mpl-2.0: mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
2 mpl-1.1: mozilla public licen[sc]e(?: version| v)? ?1 1
2 mpl-1.0: mozilla public licen[sc]e(?: version| v)? ?1 0
1 mpl: mozilla public licen[sc]e
[bsd]
2 bsd-2-clause: (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[sc]e
2 bsd-3-clause: (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e
2 bsd-4-clause: (?:bsd 4 clause|4 clause bsd|original bsd) licen[sc]e
2 0bsd: (?:zero clause bsd|bsd zero clause|0 clause bsd) licen[sc]e
1 bsd: bsd style licen[sc]e
1 bsd: bsd licen[sc]ed?
1 bsd: licensed under (?:the )?bsd
[eclipse]
4 epl-1.0: this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0
4 epl-2.0: this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v 2 0|2 0)
2 epl-2.0: eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?
2 epl-1.0: eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?
2 edl-1.0: eclipse distribution licen[sc]e(?: version| v)? ?1 0
1 epl: eclipse public licen[sc]e
[common development]
2 cddl-1.1: common development and distribution licen[sc]e(?: cddl)?(?: version| v)? ?1 1
2 cddl-1.0: common development and distribution licen[sc]e(?: cddl)?(?: version| v)? ?1 0
1 cddl: common development and distribution licen[sc]e
[common public]
2 cpl-1.0: common public licen[sc]e(?: version| v)? ?1 0
1 cpl: common public licen[sc]e
2 cpal-1.0: common public attribution licen[sc]e(?: version| v)? ?1 0
[european union]
2 eupl-1.2: european union public licen[sc]e(?: eupl)?(?: version| v)? ?1 2
2 eupl-1.1: european union public licen[sc]e(?: eupl)?(?: version| v)? ?1 1
1 eupl: european union public licen[sc]e
[boost]
3 bsl-1.0: (?:https? )?(?:www )?boost org license 1 0 txt
2 bsl-1.0: boost software licen[sc]e(?: version)? 1 0
1 bsl: boost software licen[sc]e
[artistic]
2 artistic-2.0: artistic licen[sc]e(?: version| v)? ?2(?: 0)?
2 artistic-1.0: artistic licen[sc]e(?: version| v)? ?1(?: 0)?
2 perl: (?:same terms as|under the terms of) perl(?: 5)? .{0,40}artistic
1 artistic: artistic licen[sc]e
[public domain]
4 unlicense: this is free and unencumbered software released into the public domain
4 public-domain: the author disclaims copyright to this source code .{0,60}public domain
4 pddl: public domain dedication and licen[sc]e
2 public-domain: (?:dedicated|released|placed) (?:in|to|into) the public domain
2 public-domain: dedicates? .{0,60}to the public domain
1 public-domain: in the public domain
[unlicense]
3 unlicense: (?:https? )?(?:www )?unlicense org
1 unlicense: the unlicense
[wtfpl]
3 wtfpl: (?:www )?wtfpl net
1 wtfpl: wtfpl(?: version 2| v2)?
[what the fuck]
4 wtfpl: do what the fuck you want to public licen[sc]e
[open font]
2 ofl-1.1: sil open font licen[sc]e(?: version)? 1 1
2 ofl-1.0: sil open font licen[sc]e(?: version)? 1 0
1 ofl: open font licen[sc]e
[open database]
4 odbl-1.0: made available under the open database licen[sc]e
2 odbl-1.0: open database licen[sc]e(?: odbl)?(?: version| v)? ?1 0
1 odbl: open database licen[sc]e
[opendatacommons]
3 odbl-1.0: opendatacommons org licenses odbl(?: 1 0)?
3 odc-by-1.0: opendatacommons org licenses by(?: 1 0)?
3 pddl: opendatacommons org licenses pddl(?: 1 0)?
[open data commons]
2 odc-by-1.0: open data commons attribution licen[sc]e(?: v?1 0)?
1 odc: open data commons
[open government]
2 ogl-3.0: open government licen[sc]e(?: version| v)? ?3(?: 0)?
2 ogl-2.0: open government licen[sc]e(?: version| v)? ?2(?: 0)?
1 ogl: open government licen[sc]e
[python software foundation]
2 python-2.0: python software foundation licen[sc]e(?: version)? 2
1 python: python software foundation licen[sc]e
[server side public]
2 sspl-1.0: server side public licen[sc]e(?: version| v)? ?1
1 sspl: server side public licen[sc]e
[business source]
2 busl-1.1: business source licen[sc]e(?: version)? 1 1
1 busl: business source licen[sc]e
[elastic license]
2 elastic-2.0: elastic license(?: version| v)? ?2(?: 0)?
1 elastic: elastic license
[commons clause]
4 commons-clause: commons clause license condition v1 0
1 commons-clause: commons clause
[microsoft]
2 ms-pl: microsoft public licen[sc]e(?: ms pl)?
2 ms-rl: microsoft reciprocal licen[sc]e(?: ms rl)?
1 ms-lpl: microsoft limited public licen[sc]e
[academic free]
2 afl-3.0: academic free licen[sc]e(?: version| v)? ?3 0
2 afl-2.1: academic free licen[sc]e(?: version| v)? ?2 1
1 afl: academic free licen[sc]e
[open software license]
2 osl-3.0: open software license(?: version| v)? ?3 0
1 osl: open software license
[isc licen]
1 isc: isc licen[sc]ed?
[zlib]
2 zlib: zlib libpng licen[sc]e
1 zlib: zlib licen[sc]e
[cecill]
2 cecill-2.1: cecill(?: version| v)? ?2 1
2 cecill-b: cecill b
2 cecill-c: cecill c
1 cecill: cecill
[openrail]
2 creativeml-openrail-m: creativeml open ?rail m
2 bigscience-openrail-m: bigscience open ?rail m
1 openrail: openrail(?: m| [a-z]+)?
[rail license]
2 bigscience-rail-1.0: bigscience(?: bloom)? rail license(?: v?1 0)?
1 rail: rail license
[affero]
1 agpl: affero general public licen[sc]e
[all rights reserved]
1 all-rights-reserved: (?:copyright )?(?:c |© )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}all rights reserved
[proprietary]
2 proprietary: proprietary and confidential
2 proprietary: this (?:software|document|file) is proprietary
1 proprietary: proprietary licen[sc]e
[non commercial]
2 non-commercial: for non commercial (?:use|purposes)(?: only)?
2 non-commercial: free for non commercial use
[noncommercial]
2 non-commercial: for noncommercial (?:use|purposes)(?: only)?
[personal use only]
2 personal-use: (?:free )?for personal use only
[license agreement]
2 eula: end user license agreement
1 agreement: license agreement
"""


class Rule(NamedTuple):
    number: int
    keyword: str
    level: int
    label: str
    pattern: str


def worded(pattern: str) -> str:
    return re.sub(r" (\??)", lambda m: "(?:  )?" if m[1] else "  ", pattern)


def read_rules(text: str) -> list[Rule]:
    """The rules of ``text``. In it a blank parts two words, and `` ?`` joins or parts them; in a text that is
    searched each word has a blank on both sides, so that neighbouring matches never share one."""
    rules, keyword = [], ""
    for line in filter(None, text.splitlines()):
        if line.startswith("["):
            keyword = line[1:-1]
        else:
            level, label, pattern = line.split(" ", 2)
            rules.append(Rule(len(rules), worded(keyword), int(level), label[:-1], worded(pattern)))
    return rules


#: The given phrases with their labels. They are found whatever else covers them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
RULES = read_rules(_SIGNATURES)

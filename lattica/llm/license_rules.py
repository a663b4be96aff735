"""Signatures of licences and notices, over lower-case words joined by single spaces.

Each rule: label, priority (0 to 100, also its confidence), keyword that a text must have as a word, regular expression. Of two
detections of which one contains the other, that of higher priority stays, then the longer, then the earlier rule.
"""

from __future__ import annotations

#: Whatever a rule matches holds one of these; a text without any is not looked at further.
STEMS = [
    "licen", "copy", "gpl", "software", "cc", "commons", "bsd", "apache", "mpl", "cddl", "eupl", "cecill", "odbl", "gfdl", "ofl", "wtfpl", "beerware",
    "domain", "rights", "droits", "rechte", "derechos", "propriet", "unauthorized", "permission", "permitted", "commercial", "derivative", "eula", "evaluation",
    "patent", "warranty", "endorse", "rail", "llama", "spdx", "lizenz", "domaine", "dominio", "gemeinfrei", "vorbehalten", "reservados", "interdite", "prohibida", "comercial", "kommerziell", "mulan", "jpeg",
    "perl", "agreement", "gutenberg", "wikimedia", "gemma", "training", "mining", "confidential", "internal", "personal", "educational", "shareware", "freeware",
]

_NUMBER = {"1": "(?:1|one|i)", "2": "(?:2|two|ii)", "3": "(?:3|three|iii)", "4": "(?:4|four|iv)"}
_V = "(?:v|version|v ersion)?"
_LIC = "licen[sc]es?"

#: (label, priority, keyword, expression), most specific first within a family.
_WRITTEN = [
    # MIT and its relatives
    ("mit", 95, "permission", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", 90, "software", "the software is provided as is without warranty of any kind express or implied"),
    ("mit", 92, "license", "(?:under|subject to) the(?: terms of the)? mit license"),
    ("mit", 90, "license", "(?:the )?mit(?: x11)? license"),
    ("mit", 85, "licence", "(?:the )?mit(?: x11)? licence"),
    ("mit", 88, "licensed", "(?:is |are )?licensed under(?: the)? mit"),
    ("mit", 84, "mit", "mit licensed"),
    ("mit", 82, "expat", "expat license"),
    ("mit-0", 93, "mit", "mit 0 license"),
    ("mit-0", 94, "attribution", "mit no attribution license"),
    ("x11", 86, "x11", "x11 license"),
    ("isc", 95, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", 88, "isc", "(?:the )?isc license"),
    ("ntp", 86, "ntp", "ntp license"),
    ("hpnd", 86, "historical", "historical permission notice and disclaimer"),
    # Apache
    ("apache-2", 96, "apache", "licensed under the apache license version 2(?: 0)?"),
    ("apache-2", 94, "apache", "apache license version 2(?: 0)?"),
    ("apache-2", 92, "apache", "apache(?: software)?(?: license)? v?2(?: 0)?"),
    ("apache-2", 90, "apache", "apache 2(?: 0)? license"),
    ("apache-2", 90, "apache", "www apache org licenses license 2 0"),
    ("apache-1.1", 93, "apache", "apache(?: software)? license(?: version)? 1 1"),
    ("apache-1.0", 93, "apache", "apache(?: software)? license(?: version)? 1 0"),
    ("apache", 70, "apache", "(?:the )?apache(?: software)? license"),
    ("apache", 65, "apache", "licensed to the apache software foundation"),
    # Boost, zlib and other short permissive licences
    ("bsl-1.0", 92, "boost", "boost software license(?: version)?(?: 1 0)?"),
    ("bsl-1.0", 94, "boost", "distributed under the boost software license"),
    ("zlib", 94, "software", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 86, "zlib", "(?:the )?zlib(?: libpng)? license"),
    ("libpng", 86, "libpng", "libpng license"),
    ("unlicense", 95, "unlicense", "(?:the )?unlicense"),
    ("unlicense", 96, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 95, "wtfpl", "wtfpl"),
    ("beerware", 90, "beer", "beer ?ware license"),
    ("beerware", 88, "beerware", "beerware"),
    ("curl", 85, "curl", "curl license"),
    ("ncsa", 88, "ncsa", "university of illinois ncsa open source license"),
    ("ncsa", 80, "ncsa", "ncsa license"),
    ("upl-1.0", 88, "universal", "universal permissive license"),
    ("afl", 86, "academic", "academic free license"),
    ("ecl-2.0", 88, "educational", "educational community license"),
    ("blueoak", 88, "blue", "blue oak model license"),
    ("postgresql", 88, "postgresql", "(?:the )?postgresql license"),
    ("python-2.0", 88, "python", "python(?: software foundation)? license"),
    ("psf", 88, "psf", "psf license(?: agreement)?"),
    ("ruby", 80, "ruby", "ruby license"),
    ("php-3.01", 88, "php", "php license(?: version)?(?: 3 0?1)?"),
    ("openssl", 88, "openssl", "openssl license"),
    ("vim", 84, "vim", "vim license"),
    ("zpl-2.1", 86, "zope", "zope public license"),
    ("w3c", 86, "w3c", "w3c software(?: notice and)? license"),
    ("unicode", 86, "unicode", "unicode license agreement"),
    ("icu", 84, "icu", "icu license"),
    ("json", 90, "evil", "the software shall be used for good not evil"),
    # BSD
    ("bsd", 94, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 93, "endorse", "neither the name of .{1,80}? may be used to endorse or promote products"),
    ("bsd-4-clause", 93, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause", 91, "bsd", "(?:new|modified|revised) bsd(?: license)?"),
    ("bsd-2-clause", 91, "bsd", "(?:simplified|freebsd) bsd(?: license)?"),
    ("bsd-0-clause", 91, "bsd", "(?:zero clause bsd|0bsd|bsd zero clause)"),
    ("bsd-2-clause-patent", 94, "bsd", "bsd (?:2 clause )?plus patent"),
    ("bsd", 75, "bsd", "(?:the )?bsd(?: style)? license"),
    ("bsd", 74, "bsd", "licensed under(?: the)?(?: terms of the)? bsd"),
    ("bsd", 70, "bsd", "bsd licence"),
    # GNU, unversioned
    ("gpl", 80, "gnu", "gnu general public licen[sc]e"),
    ("gpl", 72, "gpl", "(?:under|licensed under|released under)(?: the)?(?: gnu)? gpl"),
    ("gpl", 68, "gpl", "gpl licensed"),
    ("lgpl", 82, "gnu", "gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", 74, "lgpl", "(?:the )?(?:gnu )?lgpl"),
    ("agpl", 84, "gnu", "gnu affero general public licen[sc]e"),
    ("agpl", 82, "affero", "affero general public licen[sc]e"),
    ("agpl", 76, "agpl", "(?:the )?(?:gnu )?agpl"),
    ("gfdl", 84, "gnu", "gnu free documentation licen[sc]e"),
    ("gfdl", 80, "gfdl", "gfdl"),
    ("gpl-classpath-exception", 92, "classpath", "gpl .{0,40}?classpath exception"),
    ("gcc-exception", 92, "gcc", "gcc runtime library exception"),
    ("gpl", 78, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", 66, "warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    # Other copyleft
    ("mpl-2.0", 95, "mozilla", "subject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("mpl-2.0", 93, "mozilla", "mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", 93, "mozilla", "mozilla public license(?: version| v)? ?1 1"),
    ("mpl", 75, "mozilla", "mozilla public license"),
    ("mpl-2.0", 88, "mpl", "mpl(?: v| version)? ?2(?: 0)?"),
    ("mpl-1.1", 88, "mpl", "mpl(?: v| version)? ?1 1"),
    ("epl-2.0", 93, "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", 93, "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl", 75, "eclipse", "eclipse public license"),
    ("edl-1.0", 88, "eclipse", "eclipse distribution license"),
    ("cpl-1.0", 86, "common", "common public license"),
    ("ipl-1.0", 86, "ibm", "ibm public license"),
    ("cddl-1.0", 92, "cddl", "cddl(?: v| version)? ?1 0"),
    ("cddl-1.1", 92, "cddl", "cddl(?: v| version)? ?1 1"),
    ("cddl", 80, "cddl", "cddl"),
    ("cddl", 86, "development", "common development and distribution license"),
    ("eupl-1.2", 92, "eupl", "eupl(?: v| version)? ?1 2"),
    ("eupl-1.1", 92, "eupl", "eupl(?: v| version)? ?1 1"),
    ("eupl", 86, "european", "european union public licen[sc]e"),
    ("osl-3.0", 86, "open", "open software license(?: version| v)? ?3(?: 0)?"),
    ("artistic-2.0", 92, "artistic", "artistic license(?: version)? ?2(?: 0)?"),
    ("artistic", 80, "artistic", "artistic license"),
    ("ms-pl", 88, "microsoft", "microsoft public license"),
    ("ms-rl", 88, "microsoft", "microsoft reciprocal license"),
    ("cecill", 84, "cecill", "cecill(?: [abc])?"),
    ("sleepycat", 86, "sleepycat", "sleepycat license"),
    ("sspl", 92, "server", "server side public license"),
    ("busl-1.1", 92, "business", "business source license"),
    ("elastic-2.0", 90, "elastic", "elastic license(?: 2(?: 0)?)?"),
    ("commons-clause", 90, "commons", "commons clause"),
    ("polyform", 86, "polyform", "polyform [a-z]+ license"),
    ("parity", 84, "parity", "parity public license"),
    # Content, data and fonts
    ("ofl-1.1", 93, "sil", "sil open font license(?: version)?(?: 1 1)?"),
    ("ofl-1.1", 86, "ofl", "ofl(?: 1 1)?"),
    ("odbl", 92, "odbl", "odbl"),
    ("odbl", 92, "database", "open (?:data commons open )?database license"),
    ("odc-by", 92, "commons", "open data commons attribution license"),
    ("pddl", 92, "commons", "open data commons public domain dedication"),
    ("cdla", 88, "community", "community data license agreement"),
    ("ogl-uk", 88, "government", "open government licen[sc]e"),
    ("cc", 60, "commons", "creative commons(?: licen[sc]e)?"),
    ("cc0", 96, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 94, "commons", "creative commons zero"),
    ("cc0", 92, "waived", "waived all copyright and related or neighboring rights"),
    ("public-domain", 85, "domain", "(?:in|into|to|is) the public domain"),
    ("public-domain", 88, "dedicated", "dedicated to the public domain"),
    ("public-domain", 70, "domain", "public domain"),
    ("llama-community", 90, "llama", "llama [0-9 ]*community license"),
    ("openrail", 90, "openrail", "(?:creativeml )?openrail(?: m)?"),
    ("rail", 88, "rail", "responsible ai license"),
    # Notices that are not licences
    ("all-rights-reserved", 80, "rights", "all rights reserved"),
    ("all-rights-reserved", 80, "droits", "tous droits réservés"),
    ("all-rights-reserved", 80, "rechte", "alle rechte vorbehalten"),
    ("all-rights-reserved", 80, "derechos", "todos los derechos reservados"),
    ("copyright", 55, "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]"),
    ("copyright", 45, "copyright", "copyright(?: c)? by"),
    ("copyright", 40, "copyrighted", "copyrighted (?:material|work)"),
    ("proprietary", 80, "proprietary", "proprietary and confidential"),
    ("proprietary", 76, "proprietary", "proprietary (?:license|software)"),
    ("proprietary", 78, "unauthorized", "unauthorized (?:copying|reproduction|distribution) .{0,60}?(?:prohibited|forbidden)"),
    ("proprietary", 78, "permission", "(?:may not be|no part of .{1,60}? may be) (?:reproduced|copied|distributed) .{0,80}?permission"),
    ("non-commercial", 76, "commercial", "(?:for )?non commercial use only"),
    ("non-commercial", 72, "commercial", "not for commercial use"),
    ("no-derivatives", 72, "derivative", "no derivative works"),
    ("eula", 80, "eula", "eula"),
    ("eula", 82, "agreement", "end user licen[sc]e agreement"),
    ("trial", 70, "evaluation", "(?:for )?evaluation (?:purposes|use) only"),
    ("patent", 70, "patent", "patent (?:pending|license grant)"),
    ("copyleft", 60, "copyleft", "copyleft"),
    ("dual-license", 74, "dual", "dual licensed"),
    # The same in other languages
    ("mit", 86, "licence", "(?:sous|selon) (?:la )?licence mit"),
    ("mit", 86, "licencia", "(?:bajo|segun|según) (?:la )?licencia mit"),
    ("mit", 86, "lizenz", "(?:unter|gemäß) (?:der )?mit lizenz"),
    ("apache-2", 90, "licence", "(?:sous|selon) (?:la )?licence apache(?: version)? 2(?: 0)?"),
    ("apache-2", 90, "licencia", "(?:bajo|según) (?:la )?licencia apache(?: versión)? 2(?: 0)?"),
    ("apache-2", 90, "lizenz", "(?:unter|gemäß) (?:der )?apache lizenz(?: version)? 2(?: 0)?"),
    ("gpl", 80, "licence", "licence publique générale gnu"),
    ("gpl", 80, "licencia", "licencia pública general(?: de)? gnu"),
    ("cc", 62, "licence", "(?:sous )?licence creative commons"),
    ("cc", 62, "licencia", "(?:bajo )?licencia creative commons"),
    ("cc", 62, "lizenz", "(?:unter )?creative commons lizenz"),
    ("public-domain", 84, "domaine", "(?:dans le|du) domaine public"),
    ("public-domain", 84, "dominio", "(?:de|en el|del) dominio público"),
    ("public-domain", 84, "gemeinfrei", "gemeinfrei(?:e|er|es)?"),
    ("all-rights-reserved", 78, "vorbehalten", "rechte vorbehalten"),
    ("all-rights-reserved", 78, "reservados", "derechos reservados"),
    ("all-rights-reserved", 78, "interdite", "(?:toute )?reproduction(?: même partielle)? interdite"),
    ("all-rights-reserved", 78, "prohibida", "prohibida (?:la|su) reproducción(?: total| parcial| total o parcial)?"),
    ("non-commercial", 74, "commerciale", "(?:pas d )?utilisation commerciale(?: interdite)?"),
    ("non-commercial", 74, "kommerzielle", "nicht kommerzielle nutzung"),
    ("non-commercial", 74, "comercial", "uso no comercial"),
    # Further licences by name
    ("mulan-psl-2.0", 88, "mulan", "mulan (?:psl|permissive software license)(?: v?2)?"),
    ("cc0", 93, "cc0", "cc0 public domain dedication"),
    ("fsf-all-permissive", 88, "copying", "copying and distribution of this file with or without modification are permitted"),
    ("gnu-all-permissive", 84, "verbatim", "verbatim copying and distribution of this (?:entire article|license document)"),
    ("tcl", 84, "tcl", "tcl tk license"),
    ("freetype", 86, "freetype", "freetype (?:project )?license"),
    ("ijg", 86, "jpeg", "independent jpeg group"),
    ("imagemagick", 86, "imagemagick", "imagemagick license"),
    ("intel", 84, "intel", "intel open source license"),
    ("sgi-b-2.0", 84, "sgi", "sgi free software license b"),
    ("miros", 84, "miros", "miros licen[cs]e"),
    ("nasa-1.3", 86, "nasa", "nasa open source agreement"),
    ("nokia", 84, "nokia", "nokia open source license"),
    ("qpl-1.0", 86, "public", "q public license"),
    ("rpl-1.5", 86, "reciprocal", "reciprocal public license"),
    ("rpsl-1.0", 84, "realnetworks", "realnetworks public source license"),
    ("apsl-2.0", 88, "apple", "apple public source license"),
    ("watcom-1.0", 84, "watcom", "sybase open watcom public license"),
    ("lppl", 88, "latex", "latex project public license"),
    ("cpal-1.0", 86, "attribution", "common public attribution license"),
    ("ecos-2.0", 84, "ecos", "ecos license"),
    ("efl-2.0", 84, "eiffel", "eiffel forum license"),
    ("entessa", 84, "entessa", "entessa public license"),
    ("fair", 84, "fair", "fair license"),
    ("frameworx-1.0", 84, "frameworx", "frameworx open license"),
    ("motosoto", 84, "motosoto", "motosoto open source license"),
    ("multics", 84, "multics", "multics license"),
    ("naumen", 84, "naumen", "naumen public license"),
    ("oclc-2.0", 84, "oclc", "oclc research public license"),
    ("simpl-2.0", 84, "simple", "simple public license"),
    ("vsl-1.0", 84, "vovida", "vovida software license"),
    ("wxwindows", 86, "wxwindows", "wxwindows library licen[cs]e"),
    ("xnet", 84, "xnet", "x net license"),
    ("artistic-1.0-perl", 88, "perl", "(?:same terms as|under the terms of) perl(?: itself)?"),
    ("glide", 84, "glide", "3dfx glide source code general public license"),
    ("hippocratic-2.1", 86, "hippocratic", "hippocratic license"),
    ("anti-996", 86, "996", "anti 996 license"),
    ("jsr-spec", 80, "specification", "java specification participation agreement"),
    ("etalab-2.0", 86, "licence", "licence ouverte(?: etalab)?(?: open licence)?(?: 2 0)?"),
    ("dl-de-by-2.0", 86, "datenlizenz", "datenlizenz deutschland(?: namensnennung| zero)?(?: version)?(?: 2 0)?"),
    ("gutenberg", 88, "gutenberg", "project gutenberg (?:license|ebook)"),
    ("wikimedia-terms", 80, "wikimedia", "wikimedia (?:foundation )?terms of use"),
    ("bigscience-rail", 90, "bigscience", "bigscience(?: bloom)?(?: open)? rail(?: license)?"),
    ("gemma-terms", 88, "gemma", "gemma terms of use"),
    ("no-training", 82, "training", "(?:may not|must not|shall not) be used (?:for|in) (?:the )?training"),
    ("no-training", 80, "mining", "text and data mining (?:is|rights are) reserved"),
    ("confidential", 72, "confidential", "confidential and not for distribution"),
    ("internal-use", 72, "internal", "for internal use only"),
    ("personal-use", 72, "personal", "for personal(?: and)? non ?commercial use"),
    ("educational-use", 70, "educational", "for educational (?:purposes|use) only"),
    ("shareware", 72, "shareware", "this (?:program|software) is shareware"),
    ("freeware", 70, "freeware", "(?:this (?:program|software) is )?freeware"),
    ("unknown-license", 30, "license", "(?:released|distributed|available|licensed) under (?:the|a|an) [^ ]+(?: [^ ]+)? license"),
    ("unknown-license", 20, "licensed", "licensed under"),
    ("unknown-license", 18, "license", "see (?:the )?license(?: file)?(?: for details)?"),
]


def rules() -> list[dict]:
    """All rules in order: those written out above, and those of families that follow from versions, clauses and parts."""
    out = [*_WRITTEN]
    for n in ("1", "2", "3"):
        number = f"{_V} ?{_NUMBER[n]}(?: 0)?"
        for later, name in (("", f"gpl-{n}"), (" (?:or(?: at your option)?(?: any)? (?:later|newer|above)(?: version)?|plus)", f"gpl-{n}-or-later")):
            high = 92 + 3 * bool(later)
            out += [(name, high, "gnu", f"gnu general public {_LIC} ?{number}{later}"), (name, high - 2, "gpl", f"(?:gnu )?gpl ?{number}{later}")]
        out += [(f"gpl-{n}", 91, f"gplv{n}", f"gplv{n}(?: 0)?"), (f"gpl-{n}-or-later", 94, "later", f"gpl {n} 0 or later"), (f"gpl-{n}-only", 94, "only", f"gpl {n} 0 only")]
    for n in ("2", "2 1", "3"):
        name = f"lgpl-{n.replace(' ', '.')}"
        out += [(name, 93, "gnu", f"gnu (?:lesser|library) general public {_LIC} ?{_V} ?{n}(?: 0)?"), (name, 91, "lgpl", f"lgpl ?{_V} ?{n}(?: 0)?"), (name, 92, f"lgplv{n.split()[0]}", f"lgplv{n}(?: 0)?"), (f"{name}-or-later", 95, "lgpl", f"lgpl ?{_V} ?{n}(?: 0)? or (?:any )?later")]
    for n in ("1", "3"):
        out += [(f"agpl-{n}", 94, "affero", f"(?:gnu )?affero general public {_LIC} ?{_V} ?{n}(?: 0)?"), (f"agpl-{n}", 92, "agpl", f"agpl ?{_V} ?{n}(?: 0)?"), (f"agpl-{n}", 93, f"agplv{n}", f"agplv{n}(?: 0)?")]
    for n in ("0", "1", "2", "3", "4"):
        word = _NUMBER.get(n, "(?:0|zero)")
        out += [(f"bsd-{n}-clause", 92, "bsd", f"bsd {word} clause(?: license)?"), (f"bsd-{n}-clause", 92, "clause", f"{word} clause bsd(?: license)?")]
    parts = {"by": "attribution", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s", "by sa": "attribution share ?alike", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
    for short, long in parts.items():
        name, high = "cc-" + short.replace(" ", "-"), 82 + len(short)
        out += [(name, high, "cc", f"cc {short}"), (name, high, "commons", f"creative commons {long}"), (name, high + 1, "commons", f"creative commons {short}")]
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out += [(f"{name}-{v.replace(' ', '.')}", high + 3, "cc", f"cc {short} {v}"), (f"{name}-{v.replace(' ', '.')}", high + 4, "creativecommons", f"creativecommons org licenses {short} {v}"), (f"{name}-{v.replace(' ', '.')}", high + 4, "commons", f"creative commons {long} {v}")]
    spdx = ["mit", "apache 2 0", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "epl 2 0", "isc", "zlib", "unlicense", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "bsl 1 0", "eupl 1 2", "ofl 1 1"]
    out += [(f"spdx:{x.replace(' ', '-')}", 98, "spdx", f"spdx license identifier {x}") for x in spdx]
    return [{"rule": k, "label": a, "priority": b, "keyword": c, "pattern": f"(?<= )(?:{d})(?= )"} for k, (a, b, c, d) in enumerate(out)]

"""Hand-written signatures of licences, over text lower-cased and reduced to words with one space between.

A family is (label, names, tags, addresses): patterns of its name, of its machine-readable tag and of its address, all as
they read after the reduction (`CC-BY-SA-4.0` is `cc by sa 4 0`). PHRASES are sentences of the licence texts themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

#: The contract's own phrases; they are never suppressed.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

FAMILIES = (
    ("mit", r"(?:mit|expat) licen[sc]e", r"mit(?: 0| cmu| modern variant)?", r"opensource org licenses? mit"),
    ("apache-2.0", r"apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?", r"apache 2 0", r"apache org licenses license 2 0"),
    ("apache-1.1", r"apache (?:software )?licen[sc]e (?:version |v )?1(?: [01])?", r"apache 1 [01]", r"apache org licenses license 1 [01]"),
    ("gpl-3.0", r"gnu (?:general public licen[sc]e|gpl) (?:version |v )?v?3(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl-2.0", r"gnu (?:general public licen[sc]e|gpl) (?:version |v )?v?2(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-1.0", r"gnu (?:general public licen[sc]e|gpl) (?:version |v )?v?1(?: 0)?", r"gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0"),
    ("gpl", r"gnu (?:general public licen[sc]e|gpl)", r"gpl", r"gnu org licenses gpl"),
    ("lgpl-3.0", r"gnu (?:lesser general public licen[sc]e|lgpl) (?:version |v )?v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", r"gnu (?:lesser general public licen[sc]e|lgpl) (?:version |v )?v?2 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-2.0", r"gnu library general public licen[sc]e(?: version 2)?", r"lgpl 2 0(?: only| or later)?", r"gnu org licenses old licenses lgpl 2 0"),
    ("lgpl", r"gnu (?:lesser general public licen[sc]e|lgpl)", r"lgpl", r"gnu org licenses lgpl"),
    ("agpl-3.0", r"gnu (?:affero general public licen[sc]e|agpl)(?: (?:version |v )?v?3(?: 0)?)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl"),
    ("gfdl-1.3", r"gnu free documentation licen[sc]e(?: version 1 [123])?", r"gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[sc]e", r"bsd 2 clause(?: patent| views)?", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e", r"bsd 3 clause(?: clear| lbnl)?", r"opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd) licen[sc]e", r"bsd 4 clause(?: uc)?", r"spdx org licenses bsd 4 clause"),
    ("bsd", r"bsd(?: style)? licen[sc]e", r"bsd", r"opensource org licenses? bsd licen[sc]e"),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0 clause bsd) licen[sc]e", r"0bsd", r"opensource org licenses? 0bsd"),
    ("isc", r"isc licen[sc]e", r"isc", r"opensource org licenses? isc"),
    ("mpl-2.0", r"mozilla public licen[sc]e (?:version |v )?v?2(?: 0)?", r"mpl 2 0", r"mozilla org mpl 2 0"),
    ("mpl-1.1", r"mozilla public licen[sc]e (?:version |v )?v?1 [01]", r"mpl 1 [01]", r"mozilla org mpl mpl 1 1"),
    ("mpl", r"mozilla public licen[sc]e", r"mpl", r"mozilla org mpl"),
    ("epl-2.0", r"eclipse public licen[sc]e (?:version |v )?v?2(?: 0)?", r"epl 2 0", r"eclipse org legal epl 2 0"),
    ("epl-1.0", r"eclipse public licen[sc]e (?:version |v )?v?1(?: 0)?", r"epl 1 0", r"eclipse org legal epl v10"),
    ("edl-1.0", r"eclipse distribution licen[sc]e(?: version 1 0)?", r"edl 1 0", r"eclipse org org documents edl"),
    ("cddl-1.0", r"common development and distribution licen[sc]e(?: version 1 [01])?", r"cddl 1 [01]", r"opensource org licenses? cddl"),
    ("cpl-1.0", r"common public licen[sc]e(?: version 1 0)?", r"cpl 1 0", r"opensource org licenses? cpl1 0"),
    ("ipl-1.0", r"ibm public licen[sc]e(?: version 1 0)?", r"ipl 1 0", r"opensource org licenses? ipl 1 0"),
    ("artistic-2.0", r"artistic licen[sc]e (?:version |v )?2(?: 0)?", r"artistic 2 0", r"perlfoundation org artistic licen[sc]e 2 0"),
    ("artistic-1.0", r"artistic licen[sc]e(?: (?:version |v )?1(?: 0)?)?", r"artistic 1 0(?: perl| cl8)?", r"opensource org licenses? artistic 1 0"),
    ("bsl-1.0", r"boost software licen[sc]e(?: version 1 0)?", r"bsl 1 0", r"boost org license 1 0"),
    ("busl-1.1", r"business source licen[sc]e(?: (?:version )?1 1)?", r"busl 1 1", r"mariadb com bsl11"),
    ("sspl-1.0", r"server side public licen[sc]e(?: (?:version |v )?1)?", r"sspl 1 0", r"mongodb com licensing server side public licen[sc]e"),
    ("elastic-2.0", r"elastic licen[sc]e(?: (?:version )?2(?: 0)?)?", r"elastic 2 0", r"elastic co licensing elastic licen[sc]e"),
    ("unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", r"wtfpl", r"wtfpl net"),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib(?: acknowledgement)?", r"opensource org licenses? zlib"),
    ("libpng", r"libpng licen[sc]e(?: version 2)?", r"libpng(?: 2 0)?", r"libpng org pub png src libpng licen[sc]e"),
    ("openssl", r"openssl(?: and ssleay)? licen[sc]e", r"openssl", r"openssl org source licen[sc]e"),
    ("php-3.01", r"php licen[sc]e(?: version 3 0[01]?)?", r"php 3 0[01]?", r"php net licen[sc]e"),
    ("python-2.0", r"python (?:software foundation )?licen[sc]e(?: (?:agreement|version 2))?", r"(?:psf|python) 2 0", r"docs python org 3 licen[sc]e"),
    ("ruby", r"ruby licen[sc]e", r"ruby", r"ruby lang org en about licen[sc]e"),
    ("postgresql", r"postgresql licen[sc]e", r"postgresql", r"opensource org licenses? postgresql"),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", r"ncsa", r"opensource org licenses? ncsa"),
    ("w3c", r"w3c software (?:notice and )?licen[sc]e", r"w3c(?: 20150513)?", r"w3 org consortium legal copyright software"),
    ("x11", r"x11 licen[sc]e", r"x11", r"spdx org licenses x11"),
    ("curl", r"curl licen[sc]e", r"curl", r"curl se docs copyright"),
    ("icu", r"icu licen[sc]e", r"icu", r"source icu project org repos icu licen[sc]e"),
    ("unicode", r"unicode (?:inc )?licen[sc]e(?: agreement)?", r"unicode (?:dfs 201[56]|3 0)", r"unicode org copyright"),
    ("ofl-1.1", r"(?:sil )?open font licen[sc]e(?: version 1 [01])?", r"ofl 1 [01](?: rfn| no rfn)?", r"scripts sil org ofl"),
    ("eupl-1.2", r"european union public licen[sc]e(?: (?:version |v )?1 [012])?", r"eupl 1 [012]", r"joinup ec europa eu .{0,40}eupl"),
    ("cecill-2.1", r"cecill(?: (?:b|c))?(?: free software)? licen[sc]e(?: agreement)?", r"cecill (?:2 [01]|b|c)", r"cecill info licences"),
    ("ms-pl", r"microsoft public licen[sc]e", r"ms pl", r"opensource org licenses? ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", r"ms rl", r"opensource org licenses? ms rl"),
    ("osl-3.0", r"open software licen[sc]e(?: (?:version |v )?[123](?: [01])?)?", r"osl [123] [01]", r"opensource org licenses? osl 3 0"),
    ("afl-3.0", r"academic free licen[sc]e(?: (?:version |v )?[123](?: [012])?)?", r"afl [123] [012]", r"opensource org licenses? afl 3 0"),
    ("upl-1.0", r"universal permissive licen[sc]e(?: (?:version |v )?1 0)?", r"upl 1 0", r"oss oracle com licenses upl"),
    ("vim", r"vim licen[sc]e", r"vim", r"vimhelp org uganda"),
    ("beerware", r"beer ?ware licen[sc]e", r"beerware", r"people freebsd org phk"),
    ("blueoak-1.0.0", r"blue oak model licen[sc]e(?: 1 0 0)?", r"blueoak 1 0 0", r"blueoakcouncil org licen[sc]e"),
    ("mulan-2.0", r"mulan (?:psl|permissive software licen[sc]e)(?: v?2)?", r"mulanpsl [12] 0", r"license coscl org cn mulanpsl"),
    ("odbl-1.0", r"open (?:data commons open )?database licen[sc]e", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e", r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", r"public domain dedication and licen[sc]e", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("cc0-1.0", r"(?:cc0(?: 1 0)?(?: universal)?(?: licen[sc]e)?|creative commons zero)", r"cc0 1 0", r"creativecommons org publicdomain zero"),
    ("cc-by-4.0", r"(?:cc by|creative commons attribution)(?: licen[sc]e)?(?: (?:version )?[1234] [05])?", r"cc by [1234] [05]", r"creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa-4.0", r"(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)?(?: (?:version )?[1234] [05])?", r"cc by sa [1234] [05]", r"creativecommons org licenses by sa"),
    ("cc-by-nd-4.0", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: licen[sc]e)?(?: [1234] [05])?", r"cc by nd [1234] [05]", r"creativecommons org licenses by nd"),
    ("cc-by-nc-4.0", r"(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)?(?: (?:version )?[1234] [05])?", r"cc by nc [1234] [05]", r"creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa-4.0", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: licen[sc]e)?(?: [1234] [05])?", r"cc by nc sa [1234] [05]", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd-4.0", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: licen[sc]e)?(?: [1234] [05])?", r"cc by nc nd [1234] [05]", r"creativecommons org licenses by nc nd"),
    ("openrail", r"(?:bigscience )?(?:creativeml )?open ?rail(?: \+?\+?m)? licen[sc]e", r"(?:creativeml )?openrail m?", r"huggingface co spaces .{0,30}licen[sc]e"),
    ("fair", r"fair licen[sc]e", r"fair", r"opensource org licenses? fair"),
    ("proprietary", r"proprietary (?:and confidential|software licen[sc]e|licen[sc]e)", r"licenseref proprietary", r"end user licen[sc]e agreement"),
    ("public-domain", r"(?:in|into|to) the public domain", r"licenseref public domain", r"creativecommons org publicdomain mark"),
)
PHRASES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", r"permission is hereby granted free of charge .{0,200}without restriction including without limitation"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", r"neither the name of .{1,60} nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", r"distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", r"as published by the free software foundation either version 3 of the license .{0,200}affero"),
    ("gpl", r"but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("epl-1.0", r"the accompanying materials are provided under the terms of this eclipse public license"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("cc0-1.0", r"has waived all copyright and related or neighboring rights"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("proprietary", r"unauthorized copying of this (?:file|document|work) .{0,40}(?:is )?strictly prohibited"),
    ("all-rights-reserved", r"copyright .{0,60}all rights reserved"),
    ("all-rights-reserved", r"all rights reserved"),
    ("proprietary", r"may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
    ("non-commercial", r"for (?:personal|research|academic) and non ?commercial use only"),
)


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int  # 1 to 4
    keyword: str  # a text without it can't match
    pattern: str
    weight: float


def _literal(pattern: str) -> str:
    """The longest run of plain characters outside groups, classes and optional parts of a pattern: its keyword."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        nxt = pattern[i + 1] if i + 1 < len(pattern) else ""
        if depth or c in "()[]?*+{}|.\\^$" or nxt in ("?", "*", "{"):
            runs.append(run)
            run = ""
            if c == "{":
                while pattern[i] != "}":
                    i += 1
        else:
            run += c
        i += 1
    return max([*runs, run], key=len).strip()


def _keywords(pattern: str) -> list[str]:
    """Keywords of which any match of a pattern holds one: its literal, or where all of it lies in groups, that of each alternative of the first."""
    if found := _literal(pattern):
        return [found]
    alternatives, depth = [""], 0
    for c in pattern[len("(?:"):]:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
        if c == "|" and not depth:
            alternatives.append("")
        else:
            alternatives[-1] += c
    return [_literal(a) for a in alternatives]


def signatures() -> list[Signature]:
    """All rules in order: base phrases, licence texts, tags, addresses, grants, names.

    A tag, address or grant outranks a bare name, so that the name within it is not told again.
    """
    out = [Signature(label, 4, phrase, phrase, 0.9) for label, phrase in BASE]
    out += [Signature(label, 4, _literal(p), p, 1.0) for label, p in PHRASES]
    for label, name, tag, address in FAMILIES:
        out.append(Signature(label, 4, "license identifier", f"spdx license identifier {tag}", 1.0))
        out.append(Signature(label, 3, _literal(address), address, 0.9))
        grant = rf"(?:licen[sc]ed|released|distributed|available|provided) under (?:the |a |an )?(?:terms of (?:the )?)?{name}"
        out.append(Signature(label, 3, _literal(name) or "under", grant, 0.95))
        out += [Signature(label, 2, keyword, name, 0.6) for keyword in _keywords(name)]  # equal places of one label count once
    return out

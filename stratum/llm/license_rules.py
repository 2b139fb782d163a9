"""Licence signature rules: sentences of the licences themselves, and names in sentence forms.

A rule is a regex over the normalised words of a text (lower case, one space
around each word), with a keyword that the text must hold before the regex is
tried, a label, a priority and a weight.  Rules are ordered: names in the order
given, forms from the most to the least telling.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The phrases every scan looks for, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword that is a word of every form of the name, name as words (a regex), identifier as words.
NAMES = (
    ("mit", "mit", "mit", "mit"),
    ("mit-0", "mit", "mit (?:0|no attribution)", "mit 0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version| v)? (?:v1|1) 1", "apache 1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version| v)? (?:v2|2)(?: 0)?", "apache 2 0"),
    ("gpl-2", "general", "(?:gnu )?general public license(?: version| v)? (?:v2|2)(?: 0)?", "gpl 2 0"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version| v)? (?:v2|2)(?: 0)?", "gpl 2 0 only"),
    ("gpl-3", "general", "(?:gnu )?general public license(?: version| v)? (?:v3|3)(?: 0)?", "gpl 3 0"),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?: version| v)? (?:v3|3)(?: 0)?", "gpl 3 0 or later"),
    ("gpl-3", "gplv3", "(?:gnu )?gplv3", "gplv3"),
    ("gpl-2", "gplv2", "(?:gnu )?gplv2", "gplv2"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version| v)? (?:v2|2) 1", "lgpl 2 1"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version| v)? (?:v3|3)(?: 0)?", "lgpl 3 0"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public license", "lgpl"),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?: version| v)? (?:v3|3)(?: 0)?", "agpl 3 0"),
    ("agpl-3", "affero", "(?:gnu )?affero general public license", "agpl"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause"),
    ("bsd", "bsd", "bsd(?: style)?", "bsd"),
    ("isc", "isc", "isc", "isc"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 1", "mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("mpl-2", "mpl", "mpl(?: version| v)? 2(?: 0)?", "mpl 2"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("cddl-1", "cddl", "cddl(?: version| v)? 1(?: [01])?", "cddl 1 0"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "cc", "cc by(?: [1-4] [05])?", "cc by 4 0"),
    ("cc-by", "attribution", "creative commons attribution(?: [1-4] [05])?(?: international)?", "cc by 3 0"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?", "cc by sa 4 0"),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa 3 0"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?", "cc by nd 4 0"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] [05])?", "cc by nc 4 0"),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by nc 3 0"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd 4 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?", "wtfpl"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("boost-1", "boost", "boost software license(?: version| v)? 1(?: 0)?", "bsl 1 0"),
    ("artistic-2", "artistic", "artistic license(?: version| v)? 2(?: 0)?", "artistic 2 0"),
    ("ofl-1.1", "ofl", "(?:sil )?ofl(?: version| v)? 1 1", "ofl 1 1"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: version| v)? 1 1", "ofl 1 1"),
    ("eupl-1.2", "eupl", "eupl(?: version| v)? 1 2", "eupl 1 2"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa", "ncsa"),
    ("afl-3", "academic", "academic free license(?: version| v)? 3(?: 0)?", "afl 3 0"),
    ("odbl-1", "database", "open database license", "odbl 1 0"),
    ("odc-by", "commons", "open data commons attribution", "odc by 1 0"),
    ("pddl", "pddl", "(?:odc )?pddl", "pddl 1 0"),
    ("gfdl", "documentation", "(?:gnu )?free documentation license", "gfdl 1 3"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("python-2", "python", "python(?: software foundation)?(?: license)?(?: version)? 2", "psf 2 0"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("x11", "x11", "x11", "x11"),
    ("w3c", "w3c", "w3c(?: software)?", "w3c"),
    ("public-domain", "domain", "public domain(?: dedication)?", "public domain"),
    ("all-rights-reserved", "reserved", "all rights reserved", "all rights reserved"),
)

#: Label, keyword, what a licence's own text, header or notice says, as words (a regex), weight.
BODIES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "substantial", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 0.9),
    ("mit", "noninfringement", "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable", 0.7),
    ("mit", "sublicense", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 0.9),
    ("x11", "advertising", "the name of the x consortium shall not be used in advertising or otherwise to promote the sale", 1.0),
    ("isc", "fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?: provided)?", 1.0),
    ("isc", "tortious", "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", 0.7),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", 0.9),
    ("bsd-2-clause", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.8),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.8),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,12}(?:nor the names of (?:its|their) contributors )?may be used to endorse or promote products derived from this software", 1.0),
    ("bsd-3-clause", "endorse", "may not be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd", "exemplary", "shall the (?:copyright (?:holders?|owner) (?:or|and) contributors|regents or contributors|authors?) be liable for any direct indirect incidental special exemplary or consequential damages", 0.8),
    ("0bsd", "zero", "zero clause bsd", 0.9),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2", "apache", "www apache org licenses license 2 0", 0.95),
    ("apache-2", "apache", "apache license version 2 0", 0.8),
    ("apache-2", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 0.9),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 0.8),
    ("gpl-2", "published", "under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2 of the license", 1.0),
    ("gpl-3", "published", "under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3 of the license", 1.0),
    ("lgpl-2.1", "published", "under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1 of the license", 1.0),
    ("lgpl-3", "published", "under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3 of the license", 1.0),
    ("agpl-3", "published", "under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3 of the license", 1.0),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with this (?:program|library|software|file)", 0.8),
    ("lgpl", "received", "you should have received a copy of the gnu lesser general public license along with this (?:program|library|software|file)", 0.8),
    ("agpl-3", "received", "you should have received a copy of the gnu affero general public license along with this (?:program|library|software|file)", 0.8),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.7),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 0.8),
    ("gpl-2", "exception", "as a special exception the copyright holders (?:of this library )?give you permission to link", 0.6),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 0.9),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v ?1 0", 1.0),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license (?:v ?)?2 0", 1.0),
    ("cddl-1", "development", "the contents of this file are subject to the terms of the common development and distribution license", 0.9),
    ("cddl-1", "development", "common development and distribution license(?: version)? 1 0", 0.9),
    ("boost-1", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("boost-1", "boost", "distributed under the boost software license version 1 0", 1.0),
    ("zlib", "held", "in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "dedicate", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain", 0.9),
    ("wtfpl", "fuck", "do what the fuck you want to public license", 1.0),
    ("cc0", "neighboring", "has waived all copyright and related or neighboring rights to", 1.0),
    ("cc0", "dedicated", "has dedicated the work to the public domain by waiving all of (?:his or her|their) rights", 0.9),
    ("cc-by", "commons", "this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international |unported )?license", 1.0),
    ("cc-by-sa", "commons", "this work is licensed under a creative commons attribution share ?alike (?:[1-4] [05] )?(?:international |unported )?license", 1.0),
    ("cc-by-nc", "commons", "this work is licensed under a creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international |unported )?license", 1.0),
    ("cc-by-nd", "commons", "this work is licensed under a creative commons attribution no ?deriv(?:ative)?s (?:[1-4] [05] )?(?:international |unported )?license", 1.0),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl-1.1", "font", "reserved font name", 0.6),
    ("postgresql", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("hpnd", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 0.9),
    ("ncsa", "deal", "to deal with the software without restriction including without limitation the rights to use copy", 0.9),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 1.0),
    ("python-2", "psf", "psf is making python available to licensee on an as is basis", 1.0),
    ("python-2", "psf", "this license agreement is between the python software foundation psf and the individual or organization", 1.0),
    ("artistic-2", "artistic", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed artistic license 2 0", 0.9),
    ("ms-pl", "accept", "if you use the software you accept this license if you do not accept the license do not use the software", 0.8),
    ("w3c", "w3c", "w3c software (?:and document )?notice and license", 1.0),
    ("eupl-1.2", "eupl", "licensed under the eupl version 1 2", 1.0),
    ("odbl-1", "database", "made available under the open database license", 1.0),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited", 0.9),
    ("proprietary", "confidential", "proprietary and confidential", 0.6),
    ("proprietary", "consent", "may not be reproduced (?:or )?(?:distributed )?(?:or transmitted )?(?:in any form )?without the (?:prior )?(?:express )?written consent", 0.6),
    ("public-domain", "domain", "(?:placed|dedicated|released) (?:to|in|into) the public domain", 0.9),
)

#: A name without one of these words is a product's, too: it only counts within a sentence form.
TELLING = ("license", "public", "commons", "clause", "dedication", "domain", "reserved", "cc", "cc0", "unlicense", "wtfpl", "gpl", "gplv2", "gplv3", "lgpl", "agpl", "cddl", "eupl", "pddl", "ofl", "gfdl", "odbl")

GRANT = "(?:licensed|released|distributed|published|available|provided|made available|dual licensed)"
WORK = "(?:this|the) (?:software|work|project|program|file|document|text|code|library|content|data)"
#: Sentence form, priority, weight.  {name} and {id} are the licence's.
FORMS = (
    ("spdx license identifier {id}", 4, 1.0),
    ("%s (?:is|are) %s under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?" % (WORK, GRANT), 4, 1.0),
    ("%s under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {name}(?: licen[cs]e)?" % GRANT, 3, 0.95),
    ("subject to(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {name}(?: licen[cs]e)?", 3, 0.9),
    ("licen[cs]e {name}", 2, 0.8),
    ("{name} licen[cs]ed?", 2, 0.8),
)


def forms_of(name: str) -> list[str]:
    """The shortest forms of a name: without what is optional, each alternative by itself."""
    name = re.sub(r"\(\?:[^()]*\)\?", "", name).replace(" ?", " ")
    group = re.search(r"\(\?:([^()]*)\)", name)
    if group is None:
        return [name.strip()]
    return [f for x in group[1].split("|") for f in forms_of(name[: group.start()] + x + name[group.end() :])]


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def default_rules() -> tuple[Rule, ...]:
    rules = []
    for label, keyword, name, ident in NAMES:
        for form, priority, weight in FORMS:
            gate = ident.split()[0] if "{id}" in form else keyword
            pattern = "(?<= )(?:" + form.replace("{name}", f"(?:{name})").replace("{id}", ident) + ")(?= )"
            rules.append(Rule(len(rules), label, gate, pattern, priority, weight))
    for label, keyword, body, weight in BODIES:
        rules.append(Rule(len(rules), label, keyword, f"(?<= )(?:{body})(?= )", 4, weight))
    for label, keyword, name, _ in NAMES:
        if all(set(form.split()) & set(TELLING) for form in forms_of(name)):
            rules.append(Rule(len(rules), label, keyword, f"(?<= )(?:{name})(?= )", 1, 0.5))
    return tuple(rules)

"""Rules of the license scan.

A text is scanned in a plain form: lower case in A-Z, words of letters, digits and non-ASCII
characters, two blanks between words and around the whole. A rule's expression stands for whole words
and takes one blank on either side, so matches of one rule never share a blank. All expressions keep
to what Java and RE2 read alike.

Signatures of three sorts, each written out by hand below: sentences of license texts, notices that put
a file under a license, and short names run together with a version. Beside them stand the names of
families, each in the forms in which a license is named. A form says how sure the wording is: 1 for
sentences, notices, tags, addresses and statements, 2 for a name, 3 for a short name beside a version.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import count

# Identifier, words of the full name, words of the short name, words of the tag, words of the address.
FAMILIES = (
    ("gpl-1.0", "gnu general public license version 1", "gpl v?1", "gpl 1 0( only| or later)?", "gnu org licenses (old licenses )?gpl 1 0"),
    ("gpl-2.0", "gnu general public license version 2", "gpl v?2( 0)?", "gpl 2 0( only| or later)?", "gnu org licenses (old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu general public license version 3", "gpl v?3( 0)?", "gpl 3 0( only| or later)?", "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", "gnu library general public license( version 2)?", "lgpl v?2( 0)?", "lgpl 2 0( only| or later)?", "gnu org licenses (old licenses )?lgpl 2 0"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", "lgpl v?2 1", "lgpl 2 1( only| or later)?", "gnu org licenses (old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu lesser general public license version 3", "lgpl v?3( 0)?", "lgpl 3 0( only| or later)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "gnu affero general public license( version 3)?", "agpl v?3( 0)?", "agpl 3 0( only| or later)?", "gnu org licenses agpl( 3 0)?"),
    ("gfdl-1.3", "gnu free documentation license( version 1 3)?", "gfdl( 1 3)?", "gfdl 1 3( only| or later)?", "gnu org licenses fdl( 1 3)?"),
    ("apache-1.1", "apache (software )?license version 1 1", "apache 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache (software )?license version 2( 0)?", "apache v?2( 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("mit", "mit (open source )?license", "mit licensed", "mit", "opensource org licenses mit( license php)?"),
    ("mit-0", "mit no attribution license", "mit zero license", "mit 0", "opensource org licenses mit 0"),
    ("bsd-2-clause", "(bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license", "bsd 2 clause", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license", "bsd 3 clause", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "(bsd 4 clause|4 clause bsd|original bsd) license", "bsd 4 clause", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "(bsd )?zero clause( bsd)? license", "0bsd", "0bsd", "opensource org licenses 0bsd"),
    ("isc", "isc license", "isc licensed", "isc", "opensource org licenses isc( license txt)?"),
    ("mpl-1.1", "mozilla public license version 1 1", "mpl v?1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla public license( version)? 2 0", "mpl v?2( 0)?", "mpl 2 0", "mozilla org( en us)? mpl 2 0"),
    ("epl-1.0", "eclipse public license( version)?( v)? 1 0", "epl v?1 0", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse public license( version)?( v)? 2 0", "epl v?2 0", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1.0", "common development and distribution license( version 1 0)?", "cddl( v?1 0)?", "cddl 1 0", "opensource org licenses cddl( 1 0)?"),
    ("cpl-1.0", "common public license( version 1 0)?", "cpl v?1 0", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("artistic-1.0", "artistic license( version)? 1 0", "artistic 1 0", "artistic 1 0", "opensource org licenses artistic license 1 0"),
    ("artistic-2.0", "artistic license( version)? 2 0", "artistic 2 0", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("bsl-1.0", "boost software license( version 1 0)?", "boost 1 0", "bsl 1 0", "boost org license 1 0 txt"),
    ("zlib", "zlib( libpng)? license", "zlib licensed", "zlib", "opensource org licenses zlib"),
    ("libpng", "png reference library license( version)? 2", "libpng 2 0", "libpng( 2 0)?", "libpng org pub png src libpng license txt"),
    ("unlicense", "the unlicense", "unlicensed into the public domain", "unlicense", "unlicense org"),
    ("wtfpl", "do what the fuck you want to public license", "wtfpl( v?2)?", "wtfpl", "wtfpl net"),
    ("ms-pl", "microsoft public license", "ms pl license", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft reciprocal license", "ms rl license", "ms rl", "opensource org licenses ms rl"),
    ("eupl-1.1", "european union public licen[cs]e( version| v)? 1 1", "eupl v?1 1", "eupl 1 1", "joinup ec europa eu software page eupl 1 1"),
    ("eupl-1.2", "european union public licen[cs]e( version| v)? 1 2", "eupl v?1 2", "eupl 1 2", "joinup ec europa eu collection eupl eupl text eupl 1 2"),
    ("ofl-1.1", "(sil )?open font license( version)?( 1 1)?", "ofl v?1 1", "ofl 1 1", "scripts sil org ofl"),
    ("python-2.0", "python software foundation license( version 2)?", "psf license", "python 2 0", "docs python org [23] license html"),
    ("php-3.01", "php license( version)? 3 01", "php v?3 01", "php 3 01", "php net license 3 01 txt"),
    ("ruby", "ruby license", "ruby licensed", "ruby", "ruby lang org en about license txt"),
    ("postgresql", "postgresql license", "postgresql licensed", "postgresql", "opensource org licenses postgresql"),
    ("openssl", "openssl license", "openssl licensed", "openssl", "openssl org source license html"),
    ("vim", "vim license", "vim licensed", "vim", "vimdoc sourceforge net htmldoc uganda html"),
    ("odbl-1.0", "open (data commons open )?database license( v1 0)?", "odbl( v?1 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("pddl-1.0", "public domain dedication and license", "pddl( v?1 0)?", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("cc0-1.0", "creative commons (cc0|zero)( 1 0)?( universal)?", "cc0( 1 0)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
)
CC_TERMS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(ative)?s", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(ative)?s"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Names without a version.
PLAIN = (
    ("gpl", "gnu (general public license|gpl)"), ("lgpl", "gnu (lesser|library) general public license"), ("apache", "apache (software )?license"),
    ("bsd", "bsd (style )?license"), ("mpl", "mozilla public license"), ("epl", "eclipse public license"), ("cc", "creative commons license"),
    ("public-domain", "(in|into|to) the public domain"), ("copyleft", "copyleft license"), ("proprietary", "proprietary license"),
)
# Sentences that stand in the text of a license, priority 1 where only one license has them.
BODIES = (
    (1, "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (1, "mit", "the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    (2, "isc", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    (1, "isc", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (1, "0bsd", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    (2, "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (1, "bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided"),
    (1, "bsd-3-clause", "nor the names of( its| the)? contributors may be used to endorse or promote products derived from this software"),
    (1, "bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software"),
    (1, "bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (1, "apache-1.1", "this product includes software developed by the apache software foundation"),
    (1, "apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http(s)? www apache org licenses license 2 0"),
    (1, "openssl", "this product includes software developed by the openssl project"),
    (1, "unlicense", "this is free and unencumbered software released into the public domain"),
    (1, "zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    (1, "bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (1, "ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    (1, "wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    (1, "postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    (1, "cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    (1, "json", "the software shall be used for good not evil"),
    (1, "beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    (1, "ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    (1, "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v(ersion)? 2 0"),
    (1, "mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    (1, "epl-1.0", "made available under the terms of the eclipse public license v(ersion)? 1 0"),
    (1, "epl-2.0", "made available under the terms of the eclipse public license( v(ersion)?)? 2 0"),
    (1, "cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    (1, "artistic-2.0", "this package is free software you can redistribute it and or modify it under the terms of the artistic license( version)? 2 0"),
    (1, "agpl-3.0", "notwithstanding any other provision of this license if you modify the program your modified version must prominently offer all users interacting with it remotely"),
)
# Label, name and version of the licenses that files are put under by the words of their publisher.
NOTICES = (
    ("gpl-1.0", "gnu general public license", "1"), ("gpl-2.0", "gnu general public license", "2"), ("gpl-3.0", "gnu general public license", "3"),
    ("lgpl-2.0", "gnu (library|lesser) general public license", "2"), ("lgpl-2.1", "gnu lesser general public license", "2 1"), ("lgpl-3.0", "gnu lesser general public license", "3"),
    ("agpl-3.0", "gnu affero general public license", "3"),
)
# Short names run together with a version, or beside the word "version".
GLUED = (
    ("gpl-1.0", "gplv1"), ("gpl-1.0", "gpl version 1"), ("gpl-2.0", "gplv2( 0)?"), ("gpl-2.0", "gpl2"), ("gpl-2.0", "gpl version 2( 0)?"),
    ("gpl-3.0", "gplv3( 0)?"), ("gpl-3.0", "gpl3"), ("gpl-3.0", "gpl version 3( 0)?"), ("lgpl-2.0", "lgplv2( 0)?"), ("lgpl-2.0", "lgpl version 2( 0)?"),
    ("lgpl-2.1", "lgplv2 1"), ("lgpl-2.1", "lgpl version 2 1"), ("lgpl-3.0", "lgplv3( 0)?"), ("lgpl-3.0", "lgpl3"), ("lgpl-3.0", "lgpl version 3( 0)?"),
    ("agpl-3.0", "agplv3( 0)?"), ("agpl-3.0", "agpl3"), ("agpl-3.0", "agpl version 3( 0)?"), ("apache-2.0", "apachev2( 0)?"), ("apache-2.0", "apache2( 0)?"),
    ("apache-2.0", "asl 2( 0)?"), ("apache-2.0", "asl2( 0)?"), ("apache-2.0", "apache version 2( 0)?"), ("mpl-1.1", "mplv1 1"), ("mpl-2.0", "mplv2( 0)?"), ("mpl-2.0", "mpl2( 0)?"),
    ("epl-1.0", "eplv1( 0)?"), ("epl-2.0", "eplv2( 0)?"), ("eupl-1.2", "euplv1 2"), ("cc0-1.0", "cc zero"), ("bsd-2-clause", "bsd2( clause)?"), ("bsd-3-clause", "bsd3( clause)?"),
)
LATER = "( or( at your option)?( any)? later( version)?)?"
#: Says nothing where a license is named too.
RESERVED = "all-rights-reserved"
#: A text in which no word begins so, and none holds "licen", matches no rule.
STEMS = (
    "gpl", "lgpl", "agpl", "gfdl", "apache", "bsd", "0bsd", "mpl", "epl", "cddl", "cpl", "artistic", "boost", "bsl", "libpng", "wtfpl", "eupl", "ofl",
    "psf", "php", "odbl", "pddl", "cc", "creative", "vimdoc", "public", "copyleft", "reserved", "mozilla", "eclipse", "openssl", "png", "gnu",
    "permission", "redistribution", "contributors", "endorse", "advertising", "liable", "unencumbered", "asl", "evil", "dedicated", "stuff",
)
#: How a license is stated in prose.
STATEMENT = "((re)?licensed|released|distributed|available|published|provided|shared|offered) under( the)?( terms of)?( the)?"


#: Words that say little about which license is meant.
COMMON = ("license", "licenses", "licensed", "version", "public", "general", "org", "the", "and", "of", "under", "identifier", "legal", "source", "free", "software", "commons", "attribution")


@dataclass(frozen=True)
class Signature:
    number: int
    priority: int
    label: str
    #: Words that every match holds, the telling ones first; a text without one of them is not tried.
    keywords: tuple[str, ...]
    regex: str


def _spaced(words: str) -> str:
    """The expression with two blanks between words, inside the one blank on either side."""
    return " " + words.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?").replace("(", "(?:").replace("(?:?:", "(?:") + " "


def _keywords(words: str) -> tuple[str, ...]:
    """The words outside brackets that nothing makes optional."""
    while "(" in words:
        words = re.sub(r"\(( ?)[^()]*?( ?)\)\??", r"\1|\2", words)
    words = re.sub(r"\S+ \?\S+", "|", words)  # two words that may be written as one
    words = re.sub(r"\S*\?\S*", "|", words)  # a word with a letter that may be missing has two forms
    found = dict.fromkeys(re.findall(r"(?<![a-z0-9|\[\]])[a-z0-9]+(?![a-z0-9?|\[\]])", words))
    return tuple(sorted(found, key=lambda w: (w in COMMON, -len(w))))


def signatures() -> tuple[Signature, ...]:
    """All rules, in the order in which they win."""
    number = count()
    out = []

    def add(priority: int, label: str, words: str) -> None:
        out.append(Signature(next(number), priority, label, _keywords(words), _spaced(words)))

    families = list(FAMILIES)
    for code, name in CC_TERMS.items():
        for version in CC_VERSIONS:
            v, tag = version.replace(".", " "), code.replace("-", " ")
            families.append((f"cc-{code}-{version}", f"creative commons {name}( {v})?( international| unported| generic)? {v}" if version != "4.0" else f"creative commons {name}( 4 0)? international", f"cc {tag} {v}", f"cc {tag} {v}", f"creativecommons org licenses {tag} {v}"))
    for label, name, short, tag, address in families:
        add(1, label, f"spdx license identifier {tag}")
        add(1, label, address)
        add(1, label, f"{STATEMENT} {name}")
        add(1, label, f"{STATEMENT} {short}")
        add(2, label, name)
        add(3, label, short)
    for priority, label, words in BODIES:
        add(priority, label, words)
    for label, name, v in NOTICES:
        add(1, label, f"{name} as published by the free software foundation( either)? version {v}( 0)?( of the license)?{LATER}")
        add(1, label, f"{name} version {v}( 0)?( only)? as published by the free software foundation")
        add(1, label, f"{name} v ?{v}( 0)?( only)?{LATER}")
    for label, words in GLUED:
        add(1, label, f"{STATEMENT} {words}{LATER}")
        add(3, label, f"{words}{LATER}")
    add(2, RESERVED, "all rights reserved")
    for label, name in PLAIN:
        add(2, label, name)
        add(1, label, f"{STATEMENT} {name}")
    return tuple(out)

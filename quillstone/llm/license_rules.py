"""Licence signatures in a small notation, written out into ordered regular expressions.

A signature is a row of words; most are sentences of a licence's own text, or say which
licence holds.  ``[x]`` is a word that may be missing, ``a|b`` a
choice, ``*`` any one word, and a word may hold regular-expression syntax.  In the
text to be searched each word stands between two blanks of its own, so a word ``w``
becomes ``" w "`` and neighbouring matches never share a character.
"""

from __future__ import annotations

from dataclasses import dataclass

#: label ; keyword ; how the licence is named
NAMES = """
0bsd ; bsd ; bsd zero clause [license]
0bsd ; 0bsd ; 0bsd [license]
aal ; attribution ; attribution assurance license
afl-3.0 ; academic ; academic free license [version|v] 3 [0]
agpl-1.0 ; affero ; affero general public license [version|v] 1 [0]
agpl-3.0 ; affero ; affero general public license [version|v] 3 [0]
agpl-3.0 ; agpl ; [gnu] agpl [version|v] 3|v3 [0] [only|or] [later]
agpl-3.0 ; agplv3 ; agplv3
apache-1.0 ; apache ; apache [software] license [version|v] 1 0
apache-1.1 ; apache ; apache [software] license [version|v] 1 1
apache-2.0 ; apache ; apache [software] license [version|v] 2 [0]
apache-2.0 ; apache ; apache [license] v2 [0]
apache-2.0 ; apache ; apache 2 0 [license]
apsl-2.0 ; apple ; apple public source license [version|v] 2 [0]
artistic-1.0 ; artistic ; artistic license [version|v] 1 [0]
artistic-2.0 ; artistic ; artistic license [version|v] 2 [0]
beerware ; beer ; beer ware license
bsd-1-clause ; bsd ; bsd 1 clause [license]
bsd-2-clause ; bsd ; bsd 2 clause [license]
bsd-2-clause ; bsd ; 2 clause bsd [license]
bsd-2-clause ; bsd ; simplified bsd [license]
bsd-2-clause ; freebsd ; freebsd license
bsd-3-clause ; bsd ; bsd 3 clause [license]
bsd-3-clause ; bsd ; 3 clause bsd [license]
bsd-3-clause ; bsd ; new|modified|revised bsd [license]
bsd-4-clause ; bsd ; bsd 4 clause [license]
bsd-4-clause ; bsd ; original bsd [license]
bsl-1.0 ; boost ; boost software license [version|v] [1] [0]
busl-1.1 ; business ; business source license [version|v] [1] [1]
cddl-1.0 ; cddl ; cddl 1 0
cddl-1.0 ; development ; common development and distribution license [version|v] 1 0
cddl-1.1 ; development ; common development and distribution license [version|v] 1 1
cecill-2.1 ; cecill ; cecill [free] [software] [license] [agreement] [v|version] 2 1
cpal-1.0 ; attribution ; common public attribution license [version|v] [1] [0]
cpl-1.0 ; common ; common public license [version|v] [1] [0]
curl ; curl ; curl license
ecl-2.0 ; educational ; educational community license [version|v] 2 [0]
efl-2.0 ; eiffel ; eiffel forum license [version|v] 2
elastic-2.0 ; elastic ; elastic license [version|v] 2 [0]
epl-1.0 ; eclipse ; eclipse public license [version|v] 1 [0]
epl-2.0 ; eclipse ; eclipse public license [version|v] 2 [0]
eudatagrid ; datagrid ; eu datagrid software license
eupl-1.1 ; european ; european union public licen[cs]e [version|v] 1 1
eupl-1.2 ; european ; european union public licen[cs]e [version|v] 1 2
fair ; fair ; fair license
frameworx-1.0 ; frameworx ; frameworx [open] license
gfdl-1.1 ; documentation ; gnu free documentation license [version|v] 1 1
gfdl-1.2 ; documentation ; gnu free documentation license [version|v] 1 2
gfdl-1.3 ; documentation ; gnu free documentation license [version|v] 1 3
gpl-1.0 ; general ; [gnu] general public license [version|v] 1 [0]
gpl-2.0 ; general ; [gnu] general public license [version|v] 2|v2 [0]
gpl-2.0 ; gplv2 ; [gnu] gplv2
gpl-2.0 ; gpl ; [gnu] gpl [version|v] 2|v2 [0]
gpl-3.0 ; general ; [gnu] general public license [version|v] 3|v3 [0]
gpl-3.0 ; gplv3 ; [gnu] gplv3
gpl-3.0 ; gpl ; [gnu] gpl [version|v] 3|v3 [0]
hpnd ; historical ; historical permission notice and disclaimer
icu ; icu ; icu license
ijg ; jpeg ; independent jpeg group license
ipl-1.0 ; ibm ; ibm public license [version|v] [1] [0]
isc ; isc ; isc license
json ; json ; json license
lgpl-2.0 ; library ; [gnu] library general public license [version|v] 2 [0]
lgpl-2.1 ; lesser ; [gnu] lesser general public license [version|v] 2|v2 1
lgpl-3.0 ; lesser ; [gnu] lesser general public license [version|v] 3|v3 [0]
lgpl-3.0 ; lgpl ; [gnu] lgpl [version|v] 3|v3 [0]
lgpl-2.1 ; lgpl ; [gnu] lgpl [version|v] 2|v2 1
lgpl-2.1 ; lgplv2 ; [gnu] lgplv2 1
lgpl-3.0 ; lgplv3 ; [gnu] lgplv3
libpng ; libpng ; libpng license
lppl-1.3c ; latex ; latex project public license [version|v] [1] [3c]
lpl-1.02 ; lucent ; lucent public license [version|v] [1] [02]
miros ; miros ; miros licen[cs]e
mit ; mit ; mit license
mit ; expat ; expat license
mit-0 ; mit ; mit no attribution [license]
motosoto ; motosoto ; motosoto open source license
mpl-1.0 ; mozilla ; mozilla public license [version|v] 1 0
mpl-1.1 ; mozilla ; mozilla public license [version|v] 1 1
mpl-2.0 ; mozilla ; mozilla public license [version|v] 2|v2 [0]
mpl-2.0 ; mpl ; mpl [version|v] 2|v2 0
ms-pl ; microsoft ; microsoft public license
ms-rl ; microsoft ; microsoft reciprocal license
mulan-psl-2.0 ; mulan ; mulan permissive software license [v2|version] [2]
nasa-1.3 ; nasa ; nasa open source agreement [version|v] [1] [3]
naumen ; naumen ; naumen public license
ncsa ; illinois ; university of illinois ncsa open source license
nokia ; nokia ; nokia open source license
ntp ; ntp ; ntp license
odbl-1.0 ; database ; open database license [version|v] [1] [0]
odc-by-1.0 ; commons ; open data commons attribution license
ofl-1.1 ; sil ; sil open font license [version|v] [1] [1]
openrail ; responsible ; open responsible ai license
openssl ; openssl ; openssl license
osl-3.0 ; open ; open software license [version|v] 3 [0]
pddl-1.0 ; domain ; public domain dedication and license
php-3.01 ; php ; php license [version|v] 3 01
postgresql ; postgresql ; postgresql licen[cs]e
psf-2.0 ; python ; python software foundation license [version|v] [2]
qpl-1.0 ; public ; q public license [version|v] [1] [0]
rpl-1.5 ; reciprocal ; reciprocal public license [version|v] 1 5
ruby ; ruby ; ruby license
simpl-2.0 ; simple ; simple public license [version|v] [2] [0]
sissl ; standards ; sun industry standards source license
sleepycat ; sleepycat ; sleepycat license
spl-1.0 ; sun ; sun public license [version|v] [1] [0]
sspl-1.0 ; server ; server side public license [version|v] [1] [0]
tcl ; tcl ; tcl tk license
unlicense ; unlicense ; the unlicense
upl-1.0 ; permissive ; universal permissive license [version|v] [1] [0]
vim ; vim ; vim license
vsl-1.0 ; vovida ; vovida software license [version|v] [1] [0]
w3c ; w3c ; w3c software [notice] [and] license
watcom-1.0 ; watcom ; sybase open watcom public license
wtfpl ; wtfpl ; wtfpl
wxwindows ; wxwindows ; wxwindows library licen[cs]e
x11 ; x11 ; x11 license
xnet ; net ; x net license
zlib ; zlib ; zlib license
zpl-2.1 ; zope ; zope public license [version|v] 2 1
llama-community ; llama ; llama [2|3] community license
proprietary ; rights ; all rights reserved
public-domain ; domain ; released|dedicated|placed into|to|in the public domain
commons-clause ; commons ; commons clause license condition
"""

#: Families that are named without a version: a weaker signature of its own label.
FAMILIES = """
agpl ; affero ; [gnu] affero general public license
apache ; apache ; apache [software] license
bsd ; bsd ; bsd [style] license
cc ; creative ; creative commons license
cddl ; development ; common development and distribution license
epl ; eclipse ; eclipse public license
gfdl ; documentation ; gnu free documentation license
gpl ; general ; [gnu] general public license
lgpl ; lesser ; [gnu] lesser general public license
mpl ; mozilla ; mozilla public license
"""

#: Identifiers as files state them, in words; the label is the identifier.
IDENTIFIERS = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0
BUSL-1.1 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later
HPND ISC JSON LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01
PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 UPL-1.0 Unlicense Vim W3C WTFPL X11 Zlib ZPL-2.1
"""
#: Exceptions that follow ``WITH`` in an expression; the label is the identifier.
EXCEPTIONS = """
Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 Font-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 GPL-CC-1.0 LLVM-exception Linux-syscall-note
OpenJDK-assembly-exception-1.0 OpenSSL-exception Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1
"""
#: How an identifier is stated ; priority ; score ; for which identifiers
IDENTIFIER_STATEMENTS = """
spdx license identifier {name} ; 90 ; 1.0 ; all
license|licence|licenses|licensed {name} ; 45 ; 0.75 ; distinctive
"""
#: Identifiers without a number that are no everyday words.
DISTINCTIVE = ("ISC", "MIT", "PostgreSQL", "Unlicense", "WTFPL", "Zlib")

#: label ; keyword ; a sentence of the licence's own text, or of the notice that it asks for
TEXTS = """
0bsd ; hereby ; permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted the software is provided as is
afl-3.0 ; academic ; licensed under the academic free license version 3 0
agpl-3.0 ; affero ; under the terms of the gnu affero general public license as published by the free software foundation either version 3
agpl-3.0 ; affero ; you should have received a copy of the gnu affero general public license
apache-1.1 ; apache ; this product includes software developed by the apache software foundation
apache-2.0 ; compliance ; you may not use this file except in compliance with the license
apache-2.0 ; apache ; www apache org licenses license 2 0
apache-2.0 ; governing ; see the license for the specific language governing permissions and limitations under the license
artistic ; perl ; you can redistribute it and or modify it under the same terms as perl itself
artistic-2.0 ; artistic ; you can redistribute it and or modify it under the terms of the artistic license 2 0
beerware ; whatever ; as long as you retain this notice you can do whatever you want with this stuff
bsd ; redistribution ; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd ; redistributions ; redistributions of source code must retain the [above] copyright notice this list of conditions and the following disclaimer
bsd ; redistributions ; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause ; endorse ; neither the name of [*] [*] [*] [*] [*] [*] [*] nor the names of its|any contributors may be used to endorse or promote products derived from this software
bsd-3-clause ; endorse ; the name of the author may not be used to endorse or promote products derived from this software
bsd-4-clause ; advertising ; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsl-1.0 ; hereby ; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
busl-1.1 ; production ; the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
cc0-1.0 ; waived ; to the extent possible under law [*] [*] [*] [*] [*] [*] waived all copyright and related or neighboring rights
cddl-1.0 ; development ; the contents of this file are subject to the terms of the common development and distribution license
epl-1.0 ; eclipse ; made available under the terms of the eclipse public license v1 0
epl-2.0 ; eclipse ; made available under the terms of the eclipse public license [v] 2 0
gfdl ; documentation ; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl ; verbatim ; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl ; received ; you should have received a copy of the gnu general public license
gpl-2.0 ; foundation ; under the terms of the gnu general public license as published by the free software foundation [either] version 2
gpl-3.0 ; foundation ; under the terms of the gnu general public license as published by the free software foundation [either] version 3
hpnd ; hereby ; permission to use copy modify [and] distribute [and] [sell] this software and its documentation for any purpose [is] [hereby] [granted] without fee is hereby granted provided that
ijg ; jpeg ; this software is based in part on the work of the independent jpeg group
isc ; hereby ; permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
json ; evil ; the software shall be used for good not evil
lgpl ; received ; you should have received a copy of the gnu lesser general public license
lgpl-2.1 ; lesser ; under the terms of the gnu lesser general public license as published by the free software foundation [either] version 2 1
lgpl-3.0 ; lesser ; under the terms of the gnu lesser general public license as published by the free software foundation [either] version 3
mit ; hereby ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit ; furnished ; to permit persons to whom the software is furnished to do so subject to the following conditions
mit ; notice ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 ; furnished ; to permit persons to whom the software is furnished to do so the software is provided as is
mpl-1.1 ; mozilla ; the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 ; mozilla ; this source code form is subject to the terms of the mozilla public license v 2 0
ms-pl ; patents ; if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent license
ncsa ; endorse ; neither the names of [*] [*] [*] [*] [*] [*] [*] nor the names of its contributors may be used to endorse or promote products derived from this software
ofl-1.1 ; font ; this font software is licensed under the sil open font license version 1 1
openssl ; openssl ; this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 ; php ; this product includes php software freely available from
postgresql ; agreement ; for any purpose without fee and without a written agreement is hereby granted
unlicense ; unencumbered ; this is free and unencumbered software released into the public domain
upl-1.0 ; hereby ; subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
wtfpl ; fuck ; do what the fuck you want to
x11 ; advertising ; except as contained in this notice the name of [*] [*] [*] [*] [*] [*] shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
zlib ; liable ; in no event will the authors be held liable for any damages arising from the use of this software
zlib ; misrepresented ; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib ; altered ; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
"""

#: Sentences around a name, strongest first: how ; priority ; score
STATEMENTS = """
spdx license identifier {name} ; 90 ; 1.0
licensed|released|distributed|published|available under [the] [terms] [of] [the] {name} ; 80 ; 0.95
subject to [the] [terms] [of] [the] {name} ; 70 ; 0.9
"""
TEXT_RULE, NAME_RULE, FAMILY_RULE, BASE_RULE = (60, 0.85), (50, 0.8), (20, 0.6), (0, 0.7)

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: A text without any of these words (in lower case), and without the pattern, has no signature and no base phrase.
GATE_WORDS = (
    "licen", "reserved", "commons", "domain", "gpl", "spdx", "apache", "bsd", "wtfpl", "cecill", "cc0", "mpl", "cddl", "permission notice", "agreement", "attribution", "openrail",
    "hereby", "redistribut", "endorse", "advertising", "openssl", "php", "jpeg", "perl", "evil", "waived", "furnished", "permission", "fuck", "liable", "misrepresented", "whatever", "governing",
)
GATE_PATTERN = r"(?i)cc[^0-9a-z]+by|permission[^0-9a-z]+notice"


@dataclass(frozen=True)
class Rule:
    order: int
    signature: str
    label: str
    keyword: str
    regex: str
    priority: int
    score: float
    base: bool


def regex(signature: str) -> str:
    """The regular expression of a signature; valid for Java and RE2 alike."""
    out = ""
    for word in signature.split():
        optional = word.startswith("[") and word.endswith("]")
        word = word[1:-1] if optional else word
        word = "[^ ]+" if word == "*" else f"(?:{word})" if "|" in word else word
        out += f"(?: {word} )?" if optional else f" {word} "
    return out


def creative_commons() -> list[tuple[str, str, str]]:
    """The licences of this family: every set of conditions in every version, in short and in long."""
    long = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
    out = [("cc0-1.0", "cc0", "cc0 [1] [0]"), ("cc0-1.0", "creative", "creative commons zero [v1|1] [0]")]
    for terms in ("by", "by nc", "by nd", "by sa", "by nc nd", "by nc sa"):
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{terms.replace(' ', '-')}-{version.replace(' ', '.')}"
            names = " ".join(long[t] for t in terms.split())
            out += [(label, "cc", f"cc {terms} {version}"), (label, "creative", f"creative commons {names} {version}")]
            out.append((label, "creative", f"creative commons {names} [{'license' if ' ' not in terms else 'international'}] {version}"))
    return out


def _rows(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" ; ")] for line in table.strip().split("\n")]


def rules() -> list[Rule]:
    """All rules in their order: base phrases, each name's sentences and the name alone, identifiers, sentences of the licences' texts, families."""
    out: list[Rule] = []

    def add(label: str, keyword: str, signature: str, priority: int, score: float, base: bool = False) -> None:
        out.append(Rule(len(out), signature, label, keyword, regex(signature), priority, score, base))

    for phrase, label in BASE:
        add(label, phrase.split()[0], phrase, *BASE_RULE, base=True)
    for label, keyword, name in [*_rows(NAMES), *creative_commons()]:
        for how, priority, score in _rows(STATEMENTS):
            add(label, keyword, how.replace("{name}", name), int(priority), float(score))
        add(label, keyword, name, *NAME_RULE)
    for how, priority, score, which in _rows(IDENTIFIER_STATEMENTS):
        for name in IDENTIFIERS.split():
            if which == "all" or name in DISTINCTIVE or any(c.isdigit() for c in name):
                words = name.lower().replace("-", " ").replace(".", " ")
                add(name.lower(), words.split()[0], how.replace("{name}", words), int(priority), float(score))
    for label, keyword, sentence in _rows(TEXTS):
        add(label, keyword, sentence, *TEXT_RULE)
    for label, keyword, name in _rows(FAMILIES):
        add(label, keyword, name, *FAMILY_RULE)
    return out


def operands() -> dict[str, str]:
    """What may stand in an expression, in lower case, and its label; ``+`` is "or later" where that has an identifier."""
    known = {x.lower(): x.lower() for x in (IDENTIFIERS + EXCEPTIONS).split()}
    return known | {f"{x}+": known.get(f"{x}-or-later", x) for x in known}

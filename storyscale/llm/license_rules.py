"""Ordered license signatures: written by hand over canonical words (lower case, one space between).

Priority 0 is a machine-readable tag, 1 a grant or a distinctive sentence of a license text, 2 a
license's name, 3 a general notice. A rule's keyword is a literal part of everything it matches, from
the start of a word on. A version is in a label only where the text names it; a name without one gets the family's label
(``apache-any``). Identifiers count one by one in a compound expression (``MIT OR Apache-2.0``).

Shorthands in the rules: ``{2.0}`` a version however it is joined to the name (2, v2, 2.0, version
2.0; a last zero may lack), ``{+}`` a plus behind it, ``{L}`` license in either spelling, ``{U}`` a
grant's opening words. Identifiers and the kinds of Creative Commons make rules by themselves.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str  #: literal that each match contains
    regex: str  #: over canonical words; no capturing groups, whole words


#: Phrases whose places are counted and labelled in any case.
BASE = (
    Rule("cc-by", 2, "cc by", "cc by"),
    Rule("gpl", 2, "general public license", "general public license"),
    Rule("reserved", 3, "all rights reserved", "all rights reserved"),
)

#: Identifiers of machine-readable tags.
TAGS = """mit mit-0 0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-3-clause-clear
bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0 cc-by-2.0 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 cddl-1.1
cdla-permissive-2.0 cdla-sharing-1.0 cpl-1.0 ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
gpl-3.0-or-later isc lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0
odc-by-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql python-2.0 ruby sspl-1.0 unlicense upl-1.0 vim wtfpl x11 zlib""".split()

#: label | priority | keyword | regex
_RULES = """
mit|1|mit|{U}mit(?: {L})?
mit|1|expat|{U}expat {L}
mit|1|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|1|the above copyright notice and this permission notice|the above copyright notice and this permission notice shall be included in all copies
mit|2|mit licen|mit {L}d?
mit|2|licen|{L} mit
mit|2|expat|expat {L}
mit|2|mit x11|mit x11(?: {L})?
mit-0|2|mit no attribution|mit no attribution(?: {L})?
x11|2|x11 licen|x11 {L}
x11|1|x consortium|the name of the x consortium shall not be used in advertising
isc|1|isc|{U}isc {L}
isc|1|permission to use copy|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|2|isc licen|isc {L}
hpnd|1|permission to use copy|permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted
apache-1.1|2|apache|apache(?: software)?(?: {L})?{1.1}
apache-2.0|1|apache|{U}apache(?: software)?(?: {L})?{2.0}
apache-any|1|apache|{U}apache(?: software)? {L}
apache-2.0|2|apache|apache(?: software)?(?: {L})?{2.0}
apache-2.0|2|asl|asl{2.0}
apache-2.0|1|apache org licenses|apache org licenses {L} 2 0
apache-any|2|apache|apache(?: software)? {L}
apache-any|1|you may not use this file|you may not use this file except in compliance with the {L}
apache-any|1|warranties or conditions of any kind|(?:distributed )?on an as is basis without warranties or conditions of any kind
apache-any|3|contributor licen|contributor {L} agreements?
bsd|1|bsd|{U}(?:a )?bsd(?: style)? {L}
bsd|1|redistribution and use|redistribution and use in source and binary forms with or without modification are permitted
bsd|2|bsd|bsd(?: style| like)? {L}
bsd|2|berkeley|berkeley software distribution {L}
bsd-1-clause|2|bsd|(?:bsd 1 clause|1 clause bsd|one clause bsd)(?: {L})?
bsd-2-clause|1|bsd|{U}(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: {L})?
bsd-2-clause|2|bsd|(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: {L})?
bsd-2-clause|2|freebsd|freebsd {L}
bsd-2-clause|3|redistributions of source code|redistributions of source code must retain the above copyright notice
bsd-3-clause|1|bsd|{U}(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?
bsd-3-clause|2|bsd|(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?
bsd-3-clause|1|neither the name|neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse
bsd-4-clause|1|all advertising materials|all advertising materials mentioning features or use of this software must display
bsd-4-clause|2|bsd|(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: {L})?
0bsd|2|bsd|(?:zero clause bsd|bsd zero clause)(?: {L})?
0bsd|2|0bsd|0bsd(?: {L})?
bsd-patent|2|bsd|bsd(?: 2 clause)? plus patents?(?: {L})?
gpl-1.0|2|gpl|(?:gnu )?gpl{1.0}
gpl-1.0|2|general public|(?:gnu )?general public {L}{1.0}
gpl-2.0|1|gpl|{U}(?:gnu )?gpl{2.0}
gpl-2.0|1|general public|{U}(?:gnu )?general public {L}{2.0}
gpl-2.0|2|gpl|(?:gnu )?gpl{2.0}(?: only)?
gpl-2.0|2|general public|(?:gnu )?general public {L}{2.0}(?: only)?
gpl-2.0-or-later|1|gpl|(?:gnu )?gpl{2.0} or (?:any )?(?:later|newer|higher)(?: version)?
gpl-2.0-or-later|1|gpl|(?:gnu )?gpl{2.0}{+}
gpl-2.0-or-later|1|general public|(?:gnu )?general public {L}{2.0} or (?:any )?(?:later|newer|higher)(?: version)?
gpl-2.0-or-later|1|general public|(?:gnu )?general public {L}{2.0}{+}
gpl-2.0-or-later|1|either version 2|either version 2(?: 0)? of the {L} or at your option any later version
gpl-3.0|1|gpl|{U}(?:gnu )?gpl{3.0}
gpl-3.0|1|general public|{U}(?:gnu )?general public {L}{3.0}
gpl-3.0|2|gpl|(?:gnu )?gpl{3.0}(?: only)?
gpl-3.0|2|general public|(?:gnu )?general public {L}{3.0}(?: only)?
gpl-3.0-or-later|1|gpl|(?:gnu )?gpl{3.0} or (?:any )?(?:later|newer|higher)(?: version)?
gpl-3.0-or-later|1|gpl|(?:gnu )?gpl{3.0}{+}
gpl-3.0-or-later|1|general public|(?:gnu )?general public {L}{3.0} or (?:any )?(?:later|newer|higher)(?: version)?
gpl-3.0-or-later|1|general public|(?:gnu )?general public {L}{3.0}{+}
gpl-3.0-or-later|1|either version 3|either version 3(?: 0)? of the {L} or at your option any later version
gpl-any|1|gpl|{U}(?:gnu )?gpl(?: {L})?
gpl-any|1|general public|{U}(?:gnu )?general public {L}
gpl-any|2|gpl|(?:gnu gpl|gpl {L}d?|gpled)
gpl-any|2|general public|gnu general public {L}
gpl-any|1|free software|this program is free software you can redistribute it and or modify it
gpl-any|1|without even the implied|without even the implied warranty of merchantability or fitness for a particular purpose
gpl-any|1|received a copy|you should have received a copy of the gnu general public {L}
gpl-any|1|gnu org licenses gpl|gnu org licenses gpl
gpl-2.0|1|gnu org licenses|gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0|1|gnu org licenses|gnu org licenses gpl 3 0
lgpl-2.1|1|gnu org licenses|gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0|1|gnu org licenses|gnu org licenses lgpl 3 0
agpl-3.0|1|gnu org licenses|gnu org licenses agpl 3 0
gpl-exception|2|exception|(?:gcc runtime library|classpath|linking|font embedding|autoconf|bison) exception
gpl-any|3|copyleft|copyleft (?:{L}|software)
lgpl-2.0|2|library general public|(?:gnu )?library general public {L}{2.0}
lgpl-any|2|library general public|(?:gnu )?library general public {L}
lgpl-2.0|2|lgpl|(?:gnu )?lgpl{2.0}
lgpl-2.1|1|lgpl|{U}(?:gnu )?lgpl{2.1}
lgpl-2.1|2|lgpl|(?:gnu )?lgpl{2.1}(?: only)?
lgpl-2.1|2|lesser general public|(?:gnu )?lesser general public {L}{2.1}(?: only)?
lgpl-2.1-or-later|1|lgpl|(?:gnu )?lgpl{2.1} or (?:any )?(?:later|newer|higher)(?: version)?
lgpl-2.1-or-later|1|lgpl|(?:gnu )?lgpl{2.1}{+}
lgpl-2.1-or-later|1|lesser general public|(?:gnu )?lesser general public {L}{2.1} or (?:any )?(?:later|newer|higher)(?: version)?
lgpl-2.1-or-later|1|either version 2 1|either version 2 1 of the {L} or at your option any later version
lgpl-3.0|1|lgpl|{U}(?:gnu )?lgpl{3.0}
lgpl-3.0|2|lgpl|(?:gnu )?lgpl{3.0}(?: only)?
lgpl-3.0|2|lesser general public|(?:gnu )?lesser general public {L}{3.0}(?: only)?
lgpl-3.0-or-later|1|lgpl|(?:gnu )?lgpl{3.0} or (?:any )?(?:later|newer|higher)(?: version)?
lgpl-3.0-or-later|1|lgpl|(?:gnu )?lgpl{3.0}{+}
lgpl-any|1|lgpl|{U}(?:gnu )?lgpl(?: {L})?
lgpl-any|2|lgpl|(?:the |gnu )?lgpl(?: {L}d?)?
lgpl-any|2|lesser general public|(?:gnu )?lesser general public {L}
lgpl-any|1|this library is free|this library is free software you can redistribute it and or modify it
agpl-1.0|2|affero|affero general public {L}{1.0}
agpl-3.0|1|agpl|{U}(?:gnu )?agpl{3.0}
agpl-3.0|2|agpl|(?:gnu )?agpl{3.0}(?: only)?
agpl-3.0|2|affero|(?:gnu )?affero (?:general public {L}|gpl){3.0}(?: only)?
agpl-3.0-or-later|1|agpl|(?:gnu )?agpl{3.0} or (?:any )?(?:later|newer|higher)(?: version)?
agpl-3.0-or-later|1|agpl|(?:gnu )?agpl{3.0}{+}
agpl-3.0-or-later|1|affero|(?:gnu )?affero general public {L}{3.0} or (?:any )?(?:later|newer|higher)(?: version)?
agpl-any|2|agpl|(?:the |gnu )?agpl(?: {L}d?)?
agpl-any|2|affero|(?:gnu )?affero (?:general public {L}|gpl)
agpl-any|1|interacting with it remotely|all users interacting with it remotely through a computer network
gfdl-1.1|2|gfdl|(?:gnu )?gfdl{1.1}
gfdl-1.2|2|free documentation|(?:gnu )?free documentation {L}{1.2}
gfdl-1.3|2|free documentation|(?:gnu )?free documentation {L}{1.3}
gfdl-1.3|2|gfdl|(?:gnu )?gfdl{1.3}
gfdl-any|2|free documentation|(?:gnu )?free documentation {L}
gfdl-any|1|no invariant sections|with no invariant sections no front cover texts
gfdl-any|2|gfdl|(?:the |gnu )?gfdl
mpl-1.0|2|mozilla|mozilla public {L}{1.0}
mpl-1.1|2|mozilla|mozilla public {L}{1.1}
mpl-1.1|2|mpl|mpl{1.1}
mpl-2.0|1|mozilla|{U}mozilla public {L}{2.0}
mpl-2.0|2|mozilla|mozilla public {L}{2.0}
mpl-2.0|2|mpl|mpl{2.0}
mpl-2.0|1|source code form is subject|this source code form is subject to the terms of the mozilla public {L}{2.0}
mpl-any|1|source code form is subject|this source code form is subject to the terms of the mozilla public {L}
mpl-any|1|covered code|the contents of this file are subject to the mozilla public {L}(?: version \\d \\d)?.{0,200}? covered code
mpl-any|2|mozilla|mozilla public {L}
mpl-any|2|mpl|mpl {L}d?
npl|2|netscape|netscape public {L}
epl-1.0|2|eclipse|eclipse public {L}{1.0}
epl-1.0|2|epl|epl{1.0}
epl-2.0|2|eclipse|eclipse public {L}{2.0}
epl-2.0|2|epl|epl{2.0}
epl-any|1|accompanying materials|this program and the accompanying materials are made available under the terms of the eclipse public {L}
epl-any|2|eclipse|eclipse public {L}
edl-1.0|2|eclipse|eclipse distribution {L}{1.0}
edl-any|2|eclipse|eclipse distribution {L}
cddl-1.0|2|cddl|cddl{1.0}
cddl-1.1|2|cddl|cddl{1.1}
cddl-1.0|2|common development|common development and distribution {L}{1.0}
cddl-any|2|common development|common development and distribution {L}
cddl-any|2|cddl|cddl(?: {L})?
cpl-1.0|2|common public|common public {L}{1.0}
cpl-any|2|common public|common public {L}
ipl-1.0|2|ibm public|ibm public {L}{1.0}
ipl-any|2|ibm public|ibm public {L}
cpal-1.0|2|common public attribution|common public attribution {L}{1.0}
cpal-any|2|common public attribution|common public attribution {L}
eupl-1.1|2|eupl|eupl{1.1}
eupl-1.2|2|eupl|eupl{1.2}
eupl-any|2|european union public|european union public {L}
artistic-1.0|2|artistic|artistic {L}{1.0}
artistic-2.0|2|artistic|artistic {L}{2.0}
artistic-any|2|artistic|artistic {L}
artistic-any|1|same terms as perl|under the same terms as perl itself
zlib|2|zlib|(?:zlib libpng|zlib) {L}
zlib|1|altered source versions|altered source versions must be plainly marked as such
zlib|1|provided as is without any express|this software is provided as is without any express or implied warranty
libpng|2|libpng|libpng {L}
boost-1.0|2|boost software|boost software {L}{1.0}
boost-1.0|1|boost org|boost org {L} 1 0
boost-any|2|boost|boost(?: software)? {L}
boost-any|1|any person or organization obtaining|permission is hereby granted free of charge to any person or organization obtaining a copy of the software
unlicense|1|free and unencumbered|this is free and unencumbered software released into the public domain
unlicense|2|unlicense|(?:the )?unlicense
wtfpl|2|wtfpl|wtfpl(?: {L})?
wtfpl|2|want to public|do what the f\\w* you want to public {L}
beerware|2|beer|beer ?ware {L}
beerware|1|buy me a beer|you can buy me a beer in return
json|1|good not evil|the software shall be used for good not evil
python-2.0|2|python software foundation|python software foundation {L}{2.0}
psf-any|2|python software foundation|python software foundation {L}
psf-any|2|psf|psf {L}
postgresql|2|postgresql|postgresql {L}
openssl|2|openssl|openssl {L}
openssl|1|developed by the openssl project|this product includes software developed by the openssl project
openldap|2|openldap|openldap public {L}
php-3.01|2|php|php {L}{3.01}
php-any|2|php|php {L}
ruby|2|ruby|ruby {L}
perl|2|perl|perl {L}
tcl|2|tcl|tcl tk {L}
vim|2|vim|vim {L}
curl|2|curl|curl {L}
icu|2|icu|icu {L}
unicode|2|unicode|unicode (?:inc )?{L}(?: agreement)?
ncsa|2|ncsa|ncsa open source {L}
w3c|2|w3c|w3c software(?: notice and)? {L}
sleepycat|2|sleepycat|sleepycat {L}
qpl-1.0|2|q public|q public {L}{1.0}
qpl-any|2|q public|q public {L}
lppl-any|2|latex project public|latex project public {L}
ecl-2.0|2|educational community|educational community {L}(?: version)? 2 0
ms-pl|2|microsoft public|microsoft public {L}
ms-pl|2|ms pl|ms pl
ms-rl|2|microsoft reciprocal|microsoft reciprocal {L}
ofl-1.1|2|open font|(?:sil )?open font {L}{1.1}
ofl-any|2|open font|(?:sil )?open font {L}
ofl-any|2|sil ofl|sil ofl
osl-3.0|2|open software|open software {L}{3.0}
osl-any|2|open software|open software {L}
afl-3.0|2|academic free|academic free {L}{3.0}
afl-any|2|academic free|academic free {L}
upl-1.0|2|universal permissive|universal permissive {L}{1.0}
upl-any|2|universal permissive|universal permissive {L}
mulan-2.0|2|mulan|mulan(?: permissive software {L}|psl){2.0}
bsl-1.1|2|business source|business source {L}{1.1}
bsl-any|2|business source|business source {L}
sspl-1.0|2|sspl|sspl{1.0}
sspl-any|2|server side public|server side public {L}
sspl-any|2|sspl|(?:the )?sspl(?: {L})?
cecill-2.0|2|cecill|cecill{2.0}
cecill-2.1|2|cecill|cecill{2.1}
cecill-b|2|cecill|cecill b(?: {L})?
cecill-c|2|cecill|cecill c(?: {L})?
cecill-any|2|cecill|cecill(?: free software)?(?: {L})?
blueoak-1.0.0|2|blueoak|blueoak 1 0 0
blueoak-1.0.0|2|blue oak|blue oak model {L} 1 0 0
blueoak-any|2|blue oak|blue oak model {L}
elastic-2.0|2|elastic|elastic {L}{2.0}
elastic-any|2|elastic|elastic {L}
commons-clause|2|commons clause|commons clause(?: {L})?
polyform|2|polyform|polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter)(?: {L})?
odbl-1.0|2|odbl|odbl{1.0}
odbl-any|2|database licen|(?:open data commons )?open database {L}
odc-by|2|open data commons|open data commons attribution {L}
odc-by|2|odc by|odc by
pddl-1.0|2|dedication and licen|(?:open data commons )?public domain dedication and {L}{1.0}
pddl-any|2|dedication and licen|(?:open data commons )?public domain dedication and {L}
pddl-1.0|2|pddl|pddl{1.0}
cdla-permissive|2|community data|community data {L} agreement permissive(?: version)?(?: \\d 0)?
cdla-sharing|2|community data|community data {L} agreement sharing(?: version)?(?: \\d 0)?
ogl-3.0|2|open government|open government {L}{3.0}
ogl-any|2|open government|open government {L}
cc0-1.0|1|cc0|{U}cc0{1.0}(?: universal)?
cc0-1.0|2|cc0|cc0{1.0}(?: universal)?
cc0-any|2|cc0|cc0(?: {L})?
cc0-any|2|creative commons|creative commons (?:zero|public domain dedication)
cc0-any|1|waived all copyright|waived all copyright and related or neighbou?ring rights
cc0-1.0|1|creativecommons org|creativecommons org publicdomain zero 1 0
cc-any|3|creative commons|(?:under )?(?:a |the )?creative commons(?: \\w+){0,6}? {L}
openrail-m|2|openrail|(?:creativeml |bigscience |bigcode )?openrail m(?: {L})?
openrail|2|openrail|(?:creativeml |bigscience |bigcode )?openrail(?: {L})?
rail|2|responsible ai|responsible ai {L}
llama|2|llama|llama \\d (?:\\d )?community {L}(?: agreement)?
gemma|2|gemma|gemma terms of use
public-domain|2|public domain|(?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain|2|public domain|(?:this|the) (?:work|file|text|software|document|book|code|image) is (?:hereby )?in the public domain
public-domain|3|public domain|public domain (?:work|text|book|dedication|mark)
public-domain|2|no known copyright|no known copyright restrictions
proprietary|2|proprietary|(?:confidential and proprietary|proprietary and confidential)
proprietary|3|proprietary|proprietary {L}
proprietary|2|unauthori|unauthori[sz]ed (?:copying|reproduction|distribution|use|duplication) (?:of this (?:file|work|document|material)|is (?:strictly )?prohibited)
proprietary|2|be reproduced|(?:may not|no part of this \\w+ may) be reproduced (?:stored |copied |distributed |or |transmitted )*(?:in any form|without)
proprietary|2|trade secret|contains? trade secrets?
proprietary|3|end user licen|end user {L} agreement
permission-required|2|prior written|without (?:the )?(?:express |specific )?prior written (?:permission|consent)
permission-required|3|permission|by permission of the (?:author|publisher|copyright holder)
used-with-permission|3|with permission|(?:used|reprinted|reproduced) with permission
no-commercial|3|commercial use|for non commercial use only
no-commercial|3|noncommercial use|for noncommercial use only
no-commercial|3|commercial use|not for commercial use
no-warranty|3|as is|provided as is(?: and)? without(?: any)? warrant(?:y|ies)
no-warranty|3|no warrant|(?:there is|with|comes with) (?:absolutely )?no warranty
no-warranty|3|liab|in no event shall (?:the )?(?:authors?|copyright holders?|regents|contributors)(?: or (?:copyright holders|contributors))? be liable
copyright-notice|3|copyright|copyright(?: c)? (?:19|20)\\d\\d(?: (?:19|20)\\d\\d)*
copyright-notice|3|copyright|copyright (?:c|by) \\S+
copyright-notice|3|all copyrights|all copyrights (?:are )?(?:reserved|belong)
some-reserved|3|some rights reserved|some rights reserved
open-source|3|open source licen|(?:an )?open source {L}
license-file|3|licen|see (?:the )?{L}(?: file| txt| md)? for (?:details|more information|terms)
license-file|3|licen|subject to the (?:terms|{L})(?: and conditions)?(?: of| in)? the {L}
license-file|3|copying|see (?:the )?(?:file )?copying for (?:details|more information|terms)
license-mention|3|licensed under|licensed under the terms
license-mention|3|dual licensed|dual licensed
"""

_GRANT = "(?:licensed|released|distributed|available|provided|published|shared|offered|covered|governed) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


#: Stands for a plus behind the version of a GPL, at the end of its last word: "or any later version".
SIGN = "⁺"
#: Where a raw text has it; no word begins behind it.
SIGNED = r"(?i)\b([al]?gpl(?:[ -]?v(?:ersion)?)?[ -]?\d(?:\.\d)?|general public licen[cs]e,? (?:v(?:ersion)? ?)?\d(?:\.\d)?)\+(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"


def _version(m: re.Match) -> str:
    major, minor = m[1].split(".")
    return f"(?: version| v)? ?v?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")


#: Kinds of Creative Commons licenses: the part of the identifier, and the same written out.
KINDS = {"": "", "-sa": " share ?alike", "-nc": " non ?commercial", "-nd": " no ?deriv(?:ative)?s?(?: works)?", "-nc-sa": " non ?commercial share ?alike", "-nc-nd": " non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _creative_commons() -> list[str]:
    """Rules of each kind, with each version and without one: the identifier, the name written out, and the address."""
    out = []
    for kind, written in KINDS.items():
        label, tag = f"cc-by{kind}", f"cc by{kind.replace('-', ' ')}"
        ported = "(?: international| unported| generic)?(?: {L})?"
        for v in CC_VERSIONS:
            out += [f"{label}-{v}|1|cc by|{{U}}(?:a )?{tag}{{{v}}}", f"{label}-{v}|2|cc by|{tag}{{{v}}}", f"{label}-{v}|2|creative commons attribution|creative commons attribution{written}{{{v}}}{ported}"]
            out.append(f"{label}-{v}|1|creativecommons org|creativecommons org licenses {tag[3:]} {v.replace('.', ' ')}")
        out.append(f"{label}-any|2|creative commons attribution|creative commons attribution{written}{ported}")
        if kind:
            out.append(f"{label}-any|2|cc by|{tag}")
    return out


#: Identifiers that mean a license wherever they stand: with a version or clauses, but for names of programs.
PLAIN = tuple(t for t in TAGS if re.search(r"\d", t) and t not in ("php-3.01", "python-2.0", "x11"))
#: Identifiers that mean one beside another identifier, or in an address or a field.
NAMED = (*PLAIN, "mit", "isc", "zlib", "unlicense", "ncsa", "postgresql")


def _canonical(tag: str) -> str:
    return tag.replace("-", " ").replace(".", " ")


def _identifiers() -> list[Rule]:
    """Identifiers by themselves, in fields and addresses, and on either side of ``and`` and ``or``."""
    every = "|".join(sorted(map(_canonical, NAMED), key=len, reverse=True))
    ends = sorted({_canonical(t).split()[-1] for t in NAMED}, key=lambda w: (-len(w), w))
    behind = "|".join(f"(?<= {w} )" for w in ends)
    out = [Rule(t, 2, _canonical(t), _canonical(t)) for t in PLAIN]
    for t in NAMED:
        c = _canonical(t)
        out.append(Rule(t, 1, c, f"(?:opensource org|spdx org) licenses? {c}"))
        out.append(Rule(t, 2, c, f"{c}(?= (?:and|or) (?:{every}) )"))
        out.append(Rule(t, 2, c, f"(?:{behind})(?:and|or) {c}"))
        if t not in PLAIN:
            out.append(Rule(t, 2, c, f"licen[cs]e {c}"))
    return out


def _rules() -> tuple[Rule, ...]:
    out = [Rule(t, 0, "spdx license identifier", "spdx license identifier " + _canonical(t)) for t in TAGS]
    for line in (*_RULES.strip().split("\n"), *_creative_commons()):
        label, priority, keyword, regex = line.split("|", 3)
        regex = re.sub(r"\{(\d\.\d+)\}", _version, regex.replace("{L}", "licen[cs]e").replace("{U}", _GRANT).replace("{+}", SIGN))
        out.append(Rule(label, int(priority), keyword, regex))
    return tuple(dict.fromkeys((*out, *_identifiers())))


RULES = _rules()


def _roots() -> tuple[str, ...]:
    """Keywords that hold no other keyword: a text without any of these has no match of any rule."""
    every = sorted({r.keyword for r in (*RULES, *BASE)}, key=lambda k: (len(k), k))
    out: list[str] = []
    for k in every:
        if not any(f" {r}" in f" {k}" for r in out):
            out.append(k)
    return tuple(sorted(out))


ROOTS = _roots()


def root_of(rule: Rule) -> str:
    return next(r for r in ROOTS if f" {r}" in f" {rule.keyword}")


def roots_regex() -> str:
    """One regular expression of all roots, told apart by their first letters first; no root begins with another."""
    rest: dict[str, list[str]] = {}
    for r in ROOTS:
        rest.setdefault(r[0], []).append(r[1:])
    return "|".join(f"{c}(?:{'|'.join(x)})" for c, x in rest.items())

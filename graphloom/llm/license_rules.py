"""Signature rules of the license scan: one rule a line, as label | priority | keyword | pattern.

A text is matched as its words (A-Z lower-cased, everything but letters, digits and non-ASCII characters is a space) with one space between words, so
"Version 2.0" reads "version 2 0". A pattern matches whole words. <n> stands for up to n words of any kind. The keyword is part of every match of its pattern, so a
text without it need not be searched. Priorities: 4 an identifier or a name with its version, 3 a name, 2 a sentence that only this license has, 1 a general notice.
"""

from __future__ import annotations

RULES = r"""
apache-2.0 | 4 | apache license | (?:the )?apache license <2>version 2(?: 0)?
apache-2.0 | 4 | apache 2 0 | apache 2 0(?: license)?
apache-2.0 | 4 | apache2 0 | apache2 0
apache-2.0 | 4 | apache software license | apache software license <1>(?:version )?2 0
apache-2.0 | 4 | org licenses license 2 0 | apache org licenses license 2 0
apache-1.1 | 4 | apache software license | apache software license version 1 1
apache-1.0 | 4 | apache software license | apache software license version 1 0
apache | 3 | apache license | (?:under )?(?:the )?apache license
apache | 3 | apache software license | apache software license
apache-2.0 | 2 | permissions and limitations under the license | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | 2 | except in compliance with the license | you may not use this (?:file|work|software) except in compliance with the license
apache-2.0 | 2 | licensed to the apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements
apache-1.1 | 2 | developed by the apache | this product includes software developed by the apache (?:software foundation|group)
mit | 4 | spdx license identifier mit | spdx license identifier mit
mit | 3 | mit license | (?:the |under the |under )?mit license
mit | 3 | mit licence | (?:the )?mit licence
mit | 3 | expat license | (?:the )?expat license
mit | 3 | licensed under mit | licensed under mit
mit | 3 | mit licensed | mit licensed
mit | 3 | licenses mit | opensource org licenses mit(?: license)?
x11 | 3 | x11 license | (?:the )?x11 license
mit-0 | 4 | mit no attribution | mit no attribution(?: license)?
mit-0 | 4 | mit 0 | spdx license identifier mit 0
mit | 2 | to deal in the software without restriction | permission is hereby granted free of charge to any person obtaining a copy <20>to deal in the software without restriction
mit | 2 | shall be included in all copies or substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
x11 | 2 | name of the x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
bsd-2-clause | 4 | bsd 2 clause | bsd 2 clause(?: license| simplified)?
bsd-2-clause | 4 | 2 clause bsd | 2 clause bsd(?: license)?
bsd-2-clause | 4 | simplified bsd | simplified bsd(?: license)?
bsd-2-clause | 4 | freebsd license | freebsd license
bsd-3-clause | 4 | bsd 3 clause | bsd 3 clause(?: license| new| revised)?
bsd-3-clause | 4 | 3 clause bsd | 3 clause bsd(?: license)?
bsd-3-clause | 4 | new bsd | new bsd license
bsd-3-clause | 4 | modified bsd | modified bsd license
bsd-3-clause | 4 | revised bsd | revised bsd license
bsd-4-clause | 4 | bsd 4 clause | bsd 4 clause(?: license| original)?
bsd-4-clause | 4 | original bsd license | original bsd license
0bsd | 4 | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
0bsd | 4 | 0bsd | 0bsd
0bsd | 4 | bsd 0 clause | bsd 0 clause
bsd | 3 | bsd license | (?:the |under the |under )?bsd license
bsd | 3 | bsd licence | (?:the )?bsd licence
bsd | 3 | bsd style license | (?:the )?bsd style license
bsd | 3 | berkeley software distribution | berkeley software distribution license
bsd | 2 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 2 | used to endorse or promote products | neither the name <12>may be used to endorse or promote products derived from this software
bsd-4-clause | 2 | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledgement
0bsd | 2 | use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
isc | 4 | spdx license identifier isc | spdx license identifier isc
isc | 3 | isc license | (?:the )?isc license
isc | 3 | internet systems consortium | internet systems consortium license
isc | 2 | use copy modify and distribute this software | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
gpl-1.0 | 4 | general public license | gnu general public license <3>version 1(?: 0)?
gpl-2.0 | 4 | general public license | (?:gnu )?general public license <3>(?:version|v) 2(?: 0)?
gpl-2.0 | 4 | general public license v2 | (?:gnu )?general public license v2(?: 0)?
gpl-2.0 | 4 | gnu gpl | gnu gpl(?: version| v)? 2(?: 0)?
gpl-2.0 | 4 | gplv2 | (?:gnu )?gplv2(?: 0)?
gpl-2.0 | 4 | gpl 2 0 | gpl 2 0(?: only| or later)?
gpl-2.0-or-later | 4 | general public license | general public license <12>either version 2 of the license or at your option any later version
gpl-3.0 | 4 | general public license | (?:gnu )?general public license <3>(?:version|v) 3(?: 0)?
gpl-3.0 | 4 | general public license v3 | (?:gnu )?general public license v3(?: 0)?
gpl-3.0 | 4 | gnu gpl | gnu gpl(?: version| v)? 3(?: 0)?
gpl-3.0 | 4 | gplv3 | (?:gnu )?gplv3(?: 0)?
gpl-3.0 | 4 | gpl 3 0 | gpl 3 0(?: only| or later)?
gpl-3.0-or-later | 4 | general public license | general public license <12>either version 3 of the license or at your option any later version
gpl | 3 | general public license | (?:the )?gnu general public license
gpl | 3 | general public licence | (?:the )?(?:gnu )?general public licence
gpl | 3 | gnu gpl | (?:the )?gnu gpl
gpl | 3 | under the gpl | under the gpl
gpl | 3 | org licenses gpl | gnu org licenses gpl(?: html)?
gpl | 3 | org copyleft gpl | gnu org copyleft gpl(?: html)?
gpl | 2 | as published by the free software foundation | as published by the free software foundation
gpl | 2 | redistribute it and or modify it under the terms | this program is free software you can redistribute it and or modify it under the terms
gpl-linking-exception | 2 | linking this library | linking this library statically or dynamically with other modules
gpl-classpath-exception | 3 | classpath exception | classpath exception
gpl-gcc-exception | 3 | gcc runtime library exception | gcc runtime library exception
gpl-font-exception | 2 | embed this font | if you create a document which uses this font and embed this font
lgpl-2.0 | 4 | library general public license | (?:gnu )?library general public license <3>(?:version |v )?2(?: 0)?
lgpl-2.1 | 4 | lesser general public license | (?:gnu )?lesser general public license <3>(?:version|v) 2 1
lgpl-2.1 | 4 | lgplv2 1 | lgplv2 1
lgpl-2.1 | 4 | lgpl 2 1 | lgpl 2 1(?: only| or later)?
lgpl-3.0 | 4 | lesser general public license | (?:gnu )?lesser general public license <3>(?:version|v) 3(?: 0)?
lgpl-3.0 | 4 | lgplv3 | lgplv3
lgpl-3.0 | 4 | lgpl 3 0 | lgpl 3 0(?: only| or later)?
lgpl | 3 | lesser general public license | (?:the )?(?:gnu )?lesser general public license
lgpl | 3 | library general public license | (?:the )?(?:gnu )?library general public license
lgpl | 3 | gnu lgpl | (?:the )?gnu lgpl
lgpl | 3 | under the lgpl | under the lgpl
agpl-3.0 | 4 | affero general public license | (?:gnu )?affero general public license <3>(?:version|v) 3(?: 0)?
agpl-3.0 | 4 | agplv3 | agplv3
agpl-3.0 | 4 | agpl 3 0 | agpl 3 0(?: only| or later)?
agpl-1.0 | 4 | affero general public license | affero general public license version 1
agpl | 3 | affero general public license | (?:the )?(?:gnu )?affero general public license
agpl | 3 | gnu agpl | (?:the )?gnu agpl
agpl | 2 | interacting with it remotely through a computer network | interacting with it remotely through a computer network
gfdl-1.1 | 4 | free documentation license | (?:gnu )?free documentation license version 1 1
gfdl-1.2 | 4 | free documentation license | (?:gnu )?free documentation license version 1 2
gfdl-1.3 | 4 | free documentation license | (?:gnu )?free documentation license version 1 3
gfdl | 3 | free documentation license | (?:the )?(?:gnu )?free documentation license
gfdl | 3 | gnu fdl | gnu fdl
gfdl | 2 | no invariant sections | no invariant sections <3>no front cover texts
mpl-1.0 | 4 | mozilla public license | mozilla public license <2>(?:version |v )?1 0
mpl-1.1 | 4 | mozilla public license | mozilla public license <2>(?:version |v )?1 1
mpl-2.0 | 4 | mozilla public license | mozilla public license <2>(?:version |v )?2 0
mpl-2.0 | 4 | mpl 2 0 | mpl 2 0
mpl-1.1 | 4 | mpl 1 1 | mpl 1 1
mpl | 3 | mozilla public license | (?:the )?mozilla public license
mpl | 2 | terms of the mozilla public | this source code form is subject to the terms of the mozilla public
npl | 3 | netscape public license | (?:the )?netscape public license
epl-1.0 | 4 | eclipse public license | eclipse public license <2>(?:version |v )?1 0
epl-1.0 | 4 | eclipse public license v10 | eclipse public license v10
epl-2.0 | 4 | eclipse public license | eclipse public license <2>(?:version |v )?2 0
epl-2.0 | 4 | epl 2 0 | epl 2 0
epl | 3 | eclipse public license | (?:the )?eclipse public license
edl | 3 | eclipse distribution license | (?:the )?eclipse distribution license
cddl-1.0 | 4 | common development and distribution license | common development and distribution license <2>(?:version |v )?1 0
cddl-1.1 | 4 | common development and distribution license | common development and distribution license <2>(?:version |v )?1 1
cddl | 3 | common development and distribution license | (?:the )?common development and distribution license
cddl | 3 | cddl | cddl
cpl-1.0 | 4 | common public license | common public license <2>(?:version |v )?1 0
cpl | 3 | common public license | (?:the )?common public license
ipl-1.0 | 3 | ibm public license | (?:the )?ibm public license(?: version 1 0)?
apsl | 3 | apple public source license | (?:the )?apple public source license
eupl-1.1 | 4 | european union public licen | european union public licen[cs]e <2>(?:version |v )?1 1
eupl-1.2 | 4 | european union public licen | european union public licen[cs]e <2>(?:version |v )?1 2
eupl | 3 | european union public licen | (?:the )?european union public licen[cs]e
eupl | 3 | eupl | eupl
cecill | 3 | cecill | (?:licence )?cecill(?: [abc])?
artistic-1.0 | 4 | artistic license | artistic license <1>1 0
artistic-2.0 | 4 | artistic license | artistic license <1>2 0
artistic | 3 | artistic license | (?:the )?artistic license
artistic | 2 | same terms as perl itself | under the same terms as perl itself
zlib | 3 | zlib license | (?:the )?zlib license
zlib | 3 | zlib libpng license | (?:the )?zlib libpng license
zlib | 2 | altered source versions must be plainly marked | altered source versions must be plainly marked as such
libpng | 3 | png reference library license | png reference library license
boost-1.0 | 4 | boost software license | boost software license <2>1 0
boost | 3 | boost software license | (?:the )?boost software license
unlicense | 3 | the unlicense | the unlicense
unlicense | 3 | unlicense org | unlicense org
unlicense | 2 | unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | 3 | wtfpl | wtfpl
wtfpl | 3 | do what the fuck you want to | do what the fuck you want to public license
beerware | 3 | beer ware license | (?:the )?beer ware license
beerware | 3 | beerware | beerware(?: license)?
postgresql | 3 | postgresql licen | (?:the )?postgresql licen[cs]e
php-3.01 | 4 | php license | php license <1>3 01
php | 3 | php license | (?:the )?php license
psf-2.0 | 3 | python software foundation license | python software foundation license(?: version 2)?
psf | 3 | psf license | (?:the )?psf license(?: agreement)?
python | 3 | python license | (?:the )?python license
ruby | 3 | ruby license | (?:the )?ruby license
openssl | 3 | openssl license | (?:the )?openssl license
openssl | 2 | developed by the openssl project | software developed by the openssl project
curl | 3 | curl license | (?:the )?curl license
ncsa | 3 | university of illinois ncsa open source license | university of illinois ncsa open source license
ncsa | 3 | ncsa open source license | (?:the )?ncsa open source license
w3c | 3 | w3c software | w3c software (?:notice and license|and document license)
w3c-document | 3 | w3c document license | w3c document license
vim | 3 | vim license | (?:the )?vim license
tcl | 3 | tcl tk license | tcl tk license
sleepycat | 3 | sleepycat license | (?:the )?sleepycat license
qpl-1.0 | 3 | q public license | (?:the )?q public license(?: version 1 0)?
ms-pl | 3 | microsoft public license | (?:the )?microsoft public license
ms-rl | 3 | microsoft reciprocal license | (?:the )?microsoft reciprocal license
osl-3.0 | 4 | open software license | open software license <2>3 0
osl | 3 | open software license | (?:the )?open software license
afl-3.0 | 4 | academic free license | academic free license <2>3 0
afl | 3 | academic free license | (?:the )?academic free license
upl-1.0 | 3 | universal permissive license | (?:the )?universal permissive license
mulan | 3 | mulan permissive software license | mulan permissive software license
mulan | 3 | mulan psl | mulan psl(?: v2)?
bsl-1.1 | 4 | business source license | business source license <1>1 1
bsl | 3 | business source license | (?:the )?business source license
sspl-1.0 | 3 | server side public license | (?:the )?server side public license
elastic-2.0 | 4 | elastic license 2 0 | elastic license 2 0
elastic | 3 | elastic license | (?:the )?elastic license
commons-clause | 3 | commons clause | commons clause(?: license condition)?
polyform | 3 | polyform | polyform (?:noncommercial|small business|shield|perimeter|strict|free trial) license
ofl-1.1 | 4 | open font license | (?:sil )?open font license <2>1 1
ofl | 3 | open font license | (?:the )?(?:sil )?open font license
odbl-1.0 | 4 | open database license | open database license <2>1 0
odbl | 3 | open database license | (?:the )?open database license
odbl | 3 | odbl | odbl
odc-by | 3 | open data commons attribution | open data commons attribution(?: license)?
pddl | 3 | public domain dedication and license | (?:open data commons )?public domain dedication and license
cdla-permissive | 3 | community data license agreement permissive | community data license agreement permissive
cdla-sharing | 3 | community data license agreement sharing | community data license agreement sharing
ogl-uk | 3 | open government licen | (?:uk )?open government licen[cs]e(?: v[123](?: 0)?)?
etalab | 3 | etalab | (?:licence ouverte )?etalab
dl-de-by | 3 | datenlizenz deutschland | datenlizenz deutschland(?: namensnennung)?(?: version)?(?: 2 0)?
openrail-m | 3 | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: license)?
llama-community | 3 | llama | llama(?: [23])?(?: [123])? community license(?: agreement)?
cc0-1.0 | 4 | cc0 1 0 | cc0 1 0(?: universal)?
cc0 | 3 | cc0 | cc0
cc0 | 3 | creative commons zero | creative commons zero
cc0 | 3 | publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
cc-pdm | 3 | publicdomain mark | creativecommons org publicdomain mark(?: 1 0)?
cc-by-1.0 | 4 | cc by 1 0 | cc by 1 0
cc-by-2.0 | 4 | cc by 2 0 | cc by 2 0
cc-by-2.5 | 4 | cc by 2 5 | cc by 2 5
cc-by-3.0 | 4 | cc by 3 0 | cc by 3 0
cc-by-4.0 | 4 | cc by 4 0 | cc by 4 0
cc-by-4.0 | 4 | creative commons attribution 4 0 | creative commons attribution 4 0(?: international)?
cc-by-3.0 | 4 | creative commons attribution 3 0 | creative commons attribution 3 0(?: unported)?
cc-by-sa-2.0 | 4 | cc by sa 2 0 | cc by sa 2 0
cc-by-sa-2.5 | 4 | cc by sa 2 5 | cc by sa 2 5
cc-by-sa-3.0 | 4 | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-4.0 | 4 | cc by sa 4 0 | cc by sa 4 0
cc-by-sa | 3 | cc by sa | cc by sa
cc-by-nc-2.0 | 4 | cc by nc 2 0 | cc by nc 2 0
cc-by-nc-3.0 | 4 | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-4.0 | 4 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc | 3 | cc by nc | cc by nc
cc-by-nd-3.0 | 4 | cc by nd 3 0 | cc by nd 3 0
cc-by-nd-4.0 | 4 | cc by nd 4 0 | cc by nd 4 0
cc-by-nd | 3 | cc by nd | cc by nd
cc-by-nc-sa-3.0 | 4 | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 4 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa | 3 | cc by nc sa | cc by nc sa
cc-by-nc-nd-3.0 | 4 | cc by nc nd 3 0 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 4 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-nd | 3 | cc by nc nd | cc by nc nd
cc-by-sa | 3 | attribution sharealike | (?:creative commons )?attribution sharealike(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-sa | 3 | attribution share alike | (?:creative commons )?attribution share alike(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc | 3 | attribution noncommercial | (?:creative commons )?attribution noncommercial(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc | 3 | attribution non commercial | (?:creative commons )?attribution non commercial(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nd | 3 | attribution noderiv | (?:creative commons )?attribution noderiv(?:s|atives)(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc-sa | 3 | attribution noncommercial sharealike | (?:creative commons )?attribution noncommercial sharealike(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc-nd | 3 | attribution noncommercial noderiv | (?:creative commons )?attribution noncommercial noderiv(?:s|atives)(?: [1-4] [05])?(?: international| unported| generic)?
cc-by | 3 | org licenses by | creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa | 3 | org licenses by sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc | 3 | org licenses by nc | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 3 | org licenses by nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa | 3 | org licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 3 | org licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
creative-commons | 2 | creative commons | (?:the )?creative commons(?: attribution)?(?: public)? licen[cs]e
creative-commons | 2 | creative commons | licencia creative commons
creative-commons | 2 | creative commons | licence creative commons
creative-commons | 2 | creative commons | creative commons lizenz
public-domain | 2 | public domain | (?:is |are |released |placed )?in(?:to)? the public domain
public-domain | 2 | dominio publico | (?:en el )?dominio publico
public-domain | 2 | domaine public | (?:dans le )?domaine public
public-domain | 2 | gemeinfrei | gemeinfrei
reserved | 2 | tous droits | tous droits réservés
reserved | 2 | todos los derechos | todos los derechos reservados
reserved | 2 | alle rechte vorbehalten | alle rechte vorbehalten
proprietary | 2 | proprietary and confidential | proprietary and confidential
proprietary | 2 | unauthorized copying | unauthorized copying of this (?:file|work|document|software) <6>is strictly prohibited
proprietary | 2 | may not be reproduced | (?:may|must) not be reproduced <8>without <4>(?:permission|consent)
proprietary | 2 | no part of this publication | no part of this publication may be reproduced
proprietary | 2 | end user license agreement | (?:this )?end user license agreement
proprietary | 2 | commercial license | (?:under a |a )?commercial license
warranty-disclaimer | 1 | without warranty of any kind | (?:is provided as is )?without warranty of any kind(?: express or implied)?
warranty-disclaimer | 1 | fitness for a particular purpose | merchantability <2>fitness for a particular purpose
warranty-disclaimer | 1 | without any warranty | without any warranty
copyright | 1 | copyright | copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
copyright | 1 | copyright | copyright <2>by
copyright | 1 | copyright notice | (?:the above )?copyright notice
license-notice | 1 | licensed under | (?:is |are )?licensed under
license-notice | 1 | released under | released under <3>licen[cs]e
license-notice | 1 | spdx license identifier | spdx license identifier [^ ]+
license-notice | 1 | distributed under the terms | distributed under the terms of
license-notice | 1 | this work is licensed | this work is licensed
license-notice | 1 | see the license file | see the license file
license-notice | 1 | lizenziert unter | lizenziert unter
license-notice | 1 | sous licence | sous licence
license-notice | 1 | bajo licencia | bajo licencia
license-notice | 1 | bajo la licencia | bajo la licencia
"""

#: Phrases whose places are always counted, and their labels; no other rule suppresses them.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: How sure a detection of each priority is.
CONFIDENCE = {4: 0.95, 3: 0.85, 2: 0.7, 1: 0.3}


def parsed() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) of each rule."""
    lines = [tuple(p.strip() for p in line.split("|", 3)) for line in RULES.strip().splitlines()]
    return [(label, int(priority), keyword, pattern) for label, priority, keyword, pattern in lines]

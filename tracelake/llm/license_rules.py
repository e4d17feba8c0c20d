"""Signature rules for license texts, in order: label | priority | weight | keyword | pattern.

Patterns run on a text reduced to its words: lower-cased runs of letters and digits with one space
between them ("GPL-3.0" reads "gpl 3 0"). They are tried only where the keyword stands in the text
as whole words (a keyword ending in * may go on). Priority 4 is a sentence of a license's own text,
3 a name with its version or a tag, 2 a name without version, 1 a general remark. Weight (percent)
is how sure the rule is alone. In patterns, ``~`` stands for up to three words.
"""

RULES = r"""
mit | 4 | 99 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 4 | 95 | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 4 | 90 | without restriction including without limitation | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit | 3 | 95 | spdx license identifier | spdx license identifier mit
mit | 3 | 90 | mit | (?:released|licensed|distributed|available|published|provided) under ~mit licen[cs]e
mit | 2 | 85 | mit | mit licen[cs]ed?
mit | 2 | 80 | expat | expat licen[cs]e
mit | 2 | 80 | licen* | licen[cs]e mit
mit | 2 | 70 | mit | opensource org licenses mit(?: license)?(?: php| html)?
mit-0 | 3 | 92 | mit | mit no attribution(?: licen[cs]e)?
mit-0 | 3 | 92 | mit 0 | (?:licen[cs]e|spdx license identifier|under) ~mit 0
x11 | 2 | 75 | x11 | x11 licen[cs]e
x11 | 4 | 85 | x consortium | the name of the x consortium shall not be used in advertising
isc | 4 | 95 | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 3 | 92 | spdx license identifier isc | spdx license identifier isc
isc | 2 | 80 | isc | isc licen[cs]e
0bsd | 3 | 90 | 0bsd | (?:licen[cs]e|identifier|under) ~0bsd
0bsd | 2 | 80 | zero clause bsd | zero clause bsd(?: licen[cs]e)?
bsd-2-clause | 3 | 92 | bsd 2 clause | bsd 2 clause(?: licen[cs]e)?
bsd-2-clause | 3 | 90 | 2 clause bsd | 2 clause bsd(?: licen[cs]e)?
bsd-2-clause | 2 | 85 | simplified bsd | simplified bsd(?: licen[cs]e)?
bsd-2-clause | 2 | 80 | freebsd | freebsd (?:documentation )?licen[cs]e
bsd-3-clause | 4 | 95 | to endorse or promote products | neither the name ~(?:\S+ ){0,12}may be used to endorse or promote products derived from this software
bsd-3-clause | 3 | 92 | bsd 3 clause | bsd 3 clause(?: licen[cs]e)?
bsd-3-clause | 3 | 90 | 3 clause bsd | 3 clause bsd(?: licen[cs]e)?
bsd-3-clause | 2 | 85 | new bsd | new bsd(?: licen[cs]e)?
bsd-3-clause | 2 | 85 | modified bsd | modified bsd(?: licen[cs]e)?
bsd-3-clause | 2 | 80 | revised bsd | revised bsd(?: licen[cs]e)?
bsd-4-clause | 4 | 92 | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 3 | 90 | bsd 4 clause | bsd 4 clause(?: licen[cs]e)?
bsd-4-clause | 2 | 80 | original bsd | original bsd licen[cs]e
bsd | 4 | 85 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | 2 | 70 | bsd | bsd(?: style| like)? licen[cs]e[ds]?
bsd | 2 | 65 | bsd | (?:under|licen[cs]e) (?:the )?bsd
apache-2.0 | 4 | 98 | apache org licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 4 | 96 | apache license version 2 0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 4 | 80 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 3 | 95 | apache | apache (?:software )?licen[cs]e ?(?:v|version|ver)? ?2(?: 0)?
apache-2.0 | 3 | 92 | apache 2 0 | apache 2 0(?: licen[cs]e)?
apache-2.0 | 3 | 90 | asl 2 0 | asl 2 0
apache-2.0 | 3 | 90 | apachev2 | apachev2
apache-1.1 | 3 | 92 | apache | apache (?:software )?licen[cs]e (?:v|version )?1 1
apache-1.1 | 3 | 92 | apache 1 1 | apache 1 1
apache-1.0 | 3 | 90 | apache | apache (?:software )?licen[cs]e (?:v|version )?1 0
apache | 2 | 75 | apache | apache (?:software )?licen[cs]e
gpl-1.0 | 3 | 90 | gpl 1 0 | (?:gnu )?gpl 1 0(?: or later| only)?
gpl-1.0 | 3 | 90 | general public license | (?:gnu )?general public license (?:v|version )1(?: 0)?
gpl-2.0 | 4 | 96 | either version 2 of the license or | free software foundation either version 2 of the license or ~(?:any )?later version
gpl-2.0 | 3 | 95 | general public license | (?:gnu )?general public licen[cs]e ?(?:gpl )?(?:v|version )2(?: 0)?(?: only)?
gpl-2.0 | 3 | 93 | gpl 2 0 | (?:gnu )?gpl 2 0(?: only| or later)?
gpl-2.0 | 3 | 92 | gplv2 | (?:gnu )?gplv2(?: 0)?(?: only| or later)?
gpl-2.0 | 3 | 90 | gpl | (?:gnu )?gpl (?:v|version )2(?: 0)?
gpl-2.0 | 3 | 88 | gpl v2 | (?:gnu )?gpl v2
gpl-3.0 | 4 | 96 | either version 3 of the license or | free software foundation either version 3 of the license or ~(?:any )?later version
gpl-3.0 | 3 | 95 | general public license | (?:gnu )?general public licen[cs]e ?(?:gpl )?(?:v|version )3(?: 0)?(?: only)?
gpl-3.0 | 3 | 93 | gpl 3 0 | (?:gnu )?gpl 3 0(?: only| or later)?
gpl-3.0 | 3 | 92 | gplv3 | (?:gnu )?gplv3(?: 0)?(?: only| or later)?
gpl-3.0 | 3 | 90 | gpl | (?:gnu )?gpl (?:v|version )3(?: 0)?
gpl-3.0 | 3 | 88 | gpl v3 | (?:gnu )?gpl v3
gpl | 4 | 75 | this program is free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | 4 | 70 | you should have received a copy | you should have received a copy of the gnu general public licen[cs]e
gpl | 4 | 80 | the licenses for most software | the licenses for most software ~are designed to take away your freedom
gpl | 2 | 75 | gnu general public | gnu general public licen[cs]e
gpl | 2 | 65 | gpl | (?:gnu )?gpl(?:ed| licen[cs]ed?)?
gpl-classpath-exception | 3 | 90 | classpath exception | (?:with )?(?:gnu )?classpath exception(?: 2 0)?
gpl-font-exception | 3 | 88 | font exception | (?:with )?(?:gpl )?font exception
gcc-exception | 3 | 88 | gcc runtime library exception | gcc runtime library exception(?: version)?(?: 3 1)?
bison-exception | 4 | 85 | bison parser skeleton | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
lgpl-2.0 | 3 | 93 | library general public license | (?:gnu )?library general public licen[cs]e(?: version 2(?: 0)?)?
lgpl-2.0 | 3 | 90 | lgpl 2 0 | (?:gnu )?lgpl 2 0(?: only| or later)?
lgpl-2.1 | 3 | 95 | lesser general public license | (?:gnu )?lesser general public licen[cs]e ?(?:v|version )2 1
lgpl-2.1 | 3 | 93 | lgpl 2 1 | (?:gnu )?lgpl 2 1(?: only| or later)?
lgpl-2.1 | 3 | 92 | lgplv2 1 | (?:gnu )?lgplv2 1
lgpl-2.1 | 4 | 94 | either version 2 1 of the license or | free software foundation either version 2 1 of the license or ~(?:any )?later version
lgpl-3.0 | 3 | 95 | lesser general public license | (?:gnu )?lesser general public licen[cs]e ?(?:v|version )3(?: 0)?
lgpl-3.0 | 3 | 93 | lgpl 3 0 | (?:gnu )?lgpl 3 0(?: only| or later)?
lgpl-3.0 | 3 | 92 | lgplv3 | (?:gnu )?lgplv3
lgpl | 2 | 80 | lesser general public | (?:gnu )?lesser general public licen[cs]e
lgpl | 2 | 70 | lgpl | (?:gnu )?lgpl
agpl-3.0 | 3 | 95 | affero general public license | (?:gnu )?affero general public licen[cs]e ?(?:v|version )3(?: 0)?
agpl-3.0 | 3 | 93 | agpl 3 0 | (?:gnu )?agpl 3 0(?: only| or later)?
agpl-3.0 | 3 | 92 | agplv3 | (?:gnu )?agplv3
agpl-1.0 | 3 | 88 | affero general public license | affero general public licen[cs]e ?(?:v|version )1(?: 0)?
agpl | 2 | 80 | affero general public | (?:gnu )?affero general public licen[cs]e
agpl | 2 | 72 | agpl | (?:gnu )?agpl
sspl-1.0 | 3 | 93 | server side public license | server side public licen[cs]e(?: v1| version 1)?
sspl-1.0 | 3 | 85 | sspl | sspl(?: v1| 1 0)?
gfdl-1.1 | 3 | 90 | gnu free documentation license | gnu free documentation licen[cs]e version 1 1
gfdl-1.2 | 3 | 92 | gnu free documentation license | gnu free documentation licen[cs]e version 1 2
gfdl-1.3 | 3 | 92 | gnu free documentation license | gnu free documentation licen[cs]e version 1 3
gfdl | 2 | 80 | free documentation license | (?:gnu )?free documentation licen[cs]e
gfdl | 2 | 75 | gfdl | gfdl(?: 1 [123])?
gfdl | 4 | 85 | with no invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl-1.0 | 3 | 90 | mozilla public license | mozilla public licen[cs]e ?(?:v|version )?1 0
mpl-1.1 | 3 | 93 | mozilla public license | mozilla public licen[cs]e ?(?:v|version )?1 1
mpl-2.0 | 3 | 95 | mozilla public license | mozilla public licen[cs]e ?(?:v|version )?2 0
mpl-2.0 | 4 | 97 | this source code form is subject to | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0 | 3 | 90 | mpl 2 0 | mpl 2 0
mpl-1.1 | 3 | 88 | mpl 1 1 | mpl 1 1
mpl | 2 | 78 | mozilla public | mozilla public licen[cs]e
epl-1.0 | 3 | 93 | eclipse public license | eclipse public licen[cs]e ?(?:v|version )? ?1 0
epl-2.0 | 3 | 94 | eclipse public license | eclipse public licen[cs]e ?(?:v|version )? ?2 0
epl-1.0 | 3 | 88 | epl 1 0 | epl 1 0
epl-2.0 | 3 | 88 | epl 2 0 | epl 2 0
epl | 2 | 78 | eclipse public | eclipse public licen[cs]e
edl-1.0 | 3 | 88 | eclipse distribution license | eclipse distribution licen[cs]e(?: v 1 0| 1 0)?
cddl-1.0 | 3 | 92 | common development and distribution license | common development and distribution licen[cs]e(?: cddl)?(?: version 1 0| v1 0| 1 0)
cddl-1.1 | 3 | 92 | common development and distribution license | common development and distribution licen[cs]e(?: cddl)?(?: version 1 1| v1 1| 1 1)
cddl | 2 | 78 | common development and distribution | common development and distribution licen[cs]e
cddl | 2 | 72 | cddl | cddl(?: 1 [01])?
cpl-1.0 | 3 | 90 | common public license | common public licen[cs]e(?: version| v)? 1 0
cpl-1.0 | 2 | 75 | common public license | common public licen[cs]e
ipl-1.0 | 2 | 80 | ibm public license | ibm public licen[cs]e(?: version)?(?: 1 0)?
cpal-1.0 | 2 | 85 | common public attribution license | common public attribution licen[cs]e(?: version)?(?: 1 0)?
eupl-1.1 | 3 | 92 | european union public | european union public licen[cs]e ?(?:v|version )? ?1 1
eupl-1.2 | 3 | 93 | european union public | european union public licen[cs]e ?(?:v|version )? ?1 2
eupl | 2 | 80 | european union public | european union public licen[cs]e
eupl | 2 | 75 | eupl | eupl(?: v?1 [012])?
osl-3.0 | 3 | 90 | open software license | open software licen[cs]e ?(?:v|version )? ?3 0
osl | 2 | 75 | open software license | open software licen[cs]e
afl-3.0 | 3 | 90 | academic free license | academic free licen[cs]e ?(?:v|version )? ?3 0
afl | 2 | 78 | academic free license | academic free licen[cs]e
artistic-1.0 | 3 | 88 | artistic license | artistic licen[cs]e ?(?:v|version )? ?1 0
artistic-2.0 | 3 | 92 | artistic license | artistic licen[cs]e ?(?:v|version )? ?2 0
artistic | 2 | 78 | artistic license | artistic licen[cs]e
perl | 4 | 88 | same terms as perl | (?:under the )?same terms as perl(?: itself)?
ms-pl | 2 | 85 | microsoft public license | microsoft public licen[cs]e(?: ms pl)?
ms-pl | 2 | 75 | ms pl | ms pl
ms-rl | 2 | 85 | microsoft reciprocal license | microsoft reciprocal licen[cs]e(?: ms rl)?
apsl-2.0 | 2 | 85 | apple public source license | apple public source licen[cs]e(?: version)?(?: 2 0)?
bsl-1.0 | 3 | 93 | boost software license | boost software licen[cs]e ?(?:version )?(?:1 0)?
bsl-1.0 | 3 | 90 | boost org license 1 0 | (?:www )?boost org license 1 0 txt
busl-1.1 | 3 | 93 | business source license | business source licen[cs]e(?: version)?(?: 1 1)?
busl-1.1 | 3 | 88 | busl 1 1 | busl 1 1
elastic-2.0 | 3 | 92 | elastic license | elastic licen[cs]e(?: version)?(?: v?2(?: 0)?)?
confluent-community-1.0 | 3 | 88 | confluent community license | confluent community licen[cs]e(?: agreement)?(?: version)?(?: 1 0)?
polyform-noncommercial | 3 | 90 | polyform noncommercial | polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform-small-business | 3 | 90 | polyform small business | polyform small business licen[cs]e(?: 1 0 0)?
polyform-shield | 3 | 90 | polyform shield | polyform shield licen[cs]e(?: 1 0 0)?
commons-clause | 3 | 90 | commons clause | commons clause(?: licen[cs]e condition)?(?: v1 0)?
commons-clause | 4 | 85 | the right to sell the software | does not grant to you the right to sell the software
prosperity | 3 | 88 | prosperity public license | prosperity public licen[cs]e(?: 3 0 0)?
parity | 3 | 88 | parity public license | parity public licen[cs]e(?: 7 0 0)?
zlib | 3 | 88 | zlib | zlib(?: libpng)? licen[cs]e
zlib | 4 | 92 | altered source versions must be | altered source versions must be plainly marked as such
zlib | 4 | 85 | the origin of this software | the origin of this software must not be misrepresented
libpng | 2 | 80 | libpng | libpng licen[cs]e
unlicense | 4 | 97 | free and unencumbered software | free and unencumbered software released into the public domain
unlicense | 2 | 85 | unlicense | (?:the )?unlicense
wtfpl | 3 | 90 | wtfpl | wtfpl(?: 2| version 2)?
wtfpl | 4 | 95 | the fuck you want to | do what the fuck you want to public licen[cs]e
beerware | 3 | 88 | beer ware license | beer ware licen[cs]e
postgresql | 2 | 85 | postgresql licen* | postgresql licen[cs]e
python-2.0 | 2 | 85 | python software foundation license | python software foundation licen[cs]e(?: version 2)?
psf-2.0 | 2 | 82 | psf licen* | psf licen[cs]e(?: 2 0)?
php-3.01 | 2 | 82 | php license | php licen[cs]e(?: version)?(?: 3 01| v3 01)?
ruby | 2 | 78 | ruby license | ruby licen[cs]e
ruby | 4 | 80 | same terms as ruby | same terms as ruby(?: itself)?
openssl | 2 | 85 | openssl license | openssl licen[cs]e
openssl | 4 | 88 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 4 | 82 | cryptographic software written by | this product includes cryptographic software written by
w3c | 2 | 82 | w3c | w3c(?: software)?(?: notice and)?(?: document)? licen[cs]e
curl | 2 | 75 | curl licen* | curl licen[cs]e
vim | 2 | 78 | vim license | vim licen[cs]e
icu | 2 | 78 | icu license | icu licen[cs]e
unicode | 2 | 80 | unicode license | unicode licen[cs]e(?: agreement)?(?: v3)?
ofl-1.1 | 3 | 93 | sil open font license | sil open font licen[cs]e(?: version)?(?: v?1 1)?
ofl-1.1 | 2 | 80 | open font license | open font licen[cs]e
ofl-1.1 | 3 | 82 | ofl 1 1 | ofl 1 1
lppl-1.3c | 3 | 90 | latex project public license | latex project public licen[cs]e(?: version)?(?: 1 3c?)?
lppl | 2 | 75 | lppl | lppl(?: 1 3[ac]?)?
qpl-1.0 | 2 | 82 | q public license | q public licen[cs]e(?: version)?(?: 1 0)?
sleepycat | 2 | 82 | sleepycat license | sleepycat licen[cs]e
nasa-1.3 | 2 | 85 | nasa open source agreement | nasa open source agreement(?: version)?(?: 1 3)?
ncsa | 2 | 85 | ncsa open source license | (?:university of illinois )?ncsa open source licen[cs]e
ecl-2.0 | 2 | 85 | educational community license | educational community licen[cs]e(?: version)?(?: 2 0)?
upl-1.0 | 2 | 85 | universal permissive license | universal permissive licen[cs]e(?: upl)?(?: version| v)?(?: 1 0)?
mulanpsl-2.0 | 2 | 85 | mulan permissive software license | mulan permissive software licen[cs]e ?(?:v2|version 2)?
bluoak-1.0.0 | 2 | 85 | blue oak model license | blue oak model licen[cs]e(?: 1 0 0)?
fair | 2 | 65 | fair license | (?:the )?fair licen[cs]e
hpnd | 2 | 80 | historical permission notice and disclaimer | historical permission notice and disclaimer
json | 4 | 92 | shall be used for good not evil | the software shall be used for good not evil
cecill-2.1 | 2 | 88 | cecill | cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: v?(?:ersion )?2 [01])?
etalab-2.0 | 2 | 85 | licence ouverte | licence ouverte(?: open licence)?(?: version)?(?: 2 0)?
ogl-uk-3.0 | 3 | 90 | open government licen* | open government licen[cs]e ?(?:v|version )? ?3 0
ogl-uk | 2 | 80 | open government licen* | open government licen[cs]e
dl-de-by-2.0 | 2 | 85 | datenlizenz deutschland | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
odbl-1.0 | 3 | 92 | open database license | open database licen[cs]e(?: odbl)?(?: v?1 0)?
odbl-1.0 | 2 | 80 | odbl | odbl(?: 1 0)?
odc-by-1.0 | 3 | 90 | open data commons attribution | open data commons attribution licen[cs]e(?: v?1 0)?
odc-by-1.0 | 2 | 82 | odc by | odc by(?: 1 0)?
pddl-1.0 | 3 | 90 | public domain dedication and license | public domain dedication and licen[cs]e(?: pddl)?(?: v?1 0)?
pddl-1.0 | 2 | 75 | pddl | pddl(?: 1 0)?
cdla-permissive-2.0 | 3 | 90 | community data license agreement | community data licen[cs]e agreement permissive(?: version)?(?: 2 0| 1 0)?
cdla-sharing-1.0 | 3 | 90 | community data license agreement | community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?
openrail | 3 | 88 | openrail | (?:bigscience |creativeml )?(?:big ?code )?openrail(?: m)?(?: licen[cs]e)?
rail-1.0 | 3 | 85 | bigscience rail license | bigscience rail licen[cs]e(?: v?1 0)?
llama-community | 3 | 88 | llama | llama (?:2|3|3 1|3 2|3 3|4) community licen[cs]e(?: agreement)?
gemma-terms | 3 | 80 | gemma terms of use | gemma terms of use
cc0-1.0 | 4 | 95 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | 3 | 92 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | 3 | 90 | creative commons zero | creative commons zero(?: v?1 0)?(?: universal)?
cc-by-nc-nd | 4 | 96 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa | 4 | 96 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc | 4 | 95 | creativecommons org licenses by nc | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | 4 | 95 | creativecommons org licenses by nd | creativecommons org licenses by nd [1-4] [05]
cc-by-sa | 4 | 95 | creativecommons org licenses by sa | creativecommons org licenses by sa [1-4] [05]
cc-by | 4 | 94 | creativecommons org licenses by | creativecommons org licenses by [1-4] [05]
cc-by-nc-nd-4.0 | 3 | 96 | cc by nc nd | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 3 | 96 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd | 3 | 92 | cc by nc nd | cc by nc nd(?: [12] [05])?
cc-by-nc-sa-4.0 | 3 | 96 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 3 | 96 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa | 3 | 92 | cc by nc sa | cc by nc sa(?: [12] [05])?
cc-by-nc-4.0 | 3 | 95 | cc by nc | cc by nc 4 0
cc-by-nc-3.0 | 3 | 95 | cc by nc | cc by nc 3 0
cc-by-nc | 3 | 90 | cc by nc | cc by nc(?: [12] [05])?
cc-by-nd-4.0 | 3 | 95 | cc by nd | cc by nd 4 0
cc-by-nd-3.0 | 3 | 95 | cc by nd | cc by nd 3 0
cc-by-nd | 3 | 90 | cc by nd | cc by nd(?: [12] [05])?
cc-by-sa-4.0 | 3 | 95 | cc by sa | cc by sa 4 0
cc-by-sa-3.0 | 3 | 95 | cc by sa | cc by sa 3 0
cc-by-sa-2.5 | 3 | 95 | cc by sa | cc by sa 2 5
cc-by-sa | 3 | 90 | cc by sa | cc by sa(?: [12] 0)?
cc-by-4.0 | 3 | 94 | cc by | cc by 4 0
cc-by-3.0 | 3 | 94 | cc by | cc by 3 0
cc-by-2.5 | 3 | 94 | cc by | cc by 2 5
cc-by-2.0 | 3 | 94 | cc by | cc by 2 0
cc-by-nc-nd | 2 | 90 | noncommercial* | (?:creative commons )?attribution noncommercial (?:no derivatives|noderivatives|noderivs)(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-nd | 2 | 88 | non commercial* | (?:creative commons )?attribution non commercial (?:no derivatives|noderivatives|noderivs)(?: [1-4] [05])?
cc-by-nc-sa | 2 | 90 | sharealike | (?:creative commons )?attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-sa | 2 | 90 | share alike | (?:creative commons )?attribution non ?commercial share alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc | 2 | 85 | creative commons attribution | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa | 2 | 88 | creative commons attribution | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nd | 2 | 85 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by | 2 | 82 | creative commons attribution | creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-sampling | 2 | 75 | creative commons sampling | creative commons sampling(?: plus)?(?: 1 0)?
creative-commons | 1 | 60 | creative commons | creative commons(?: licen[cs]ed?)?
public-domain-mark | 3 | 85 | public domain mark | public domain mark(?: 1 0)?
public-domain | 4 | 85 | public domain | (?:hereby )?(?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | 2 | 70 | public domain | (?:is|are) (?:now )?in the public domain
public-domain | 1 | 50 | public domain | public domain
free-art-1.3 | 2 | 85 | free art license | free art licen[cs]e(?: 1 3)?
free-art-1.3 | 2 | 82 | licence art libre | licence art libre(?: 1 3)?
against-drm | 2 | 75 | against drm | against drm licen[cs]e
reserved | 3 | 80 | all rights reserved | all rights reserved
reserved | 3 | 80 | alle rechte vorbehalten | alle rechte vorbehalten
reserved | 3 | 80 | tous droits réservés | tous droits réservés
reserved | 3 | 80 | todos los derechos reservados | todos los derechos reservados
reserved | 2 | 70 | rights reserved | (?:some|no other) rights reserved
proprietary | 4 | 92 | proprietary and confidential | (?:this \S+ is )?(?:confidential and proprietary|proprietary and confidential)
proprietary | 4 | 85 | strictly prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution) ~(?:\S+ ){0,8}(?:is )?strictly prohibited
proprietary | 4 | 85 | written permission | (?:may not|must not|shall not|no part) ~(?:\S+ ){0,14}without (?:the )?(?:prior |express |explicit ){0,2}written permission
proprietary | 4 | 82 | written consent | (?:may not|must not|shall not|no part) ~(?:\S+ ){0,14}without (?:the )?(?:prior |express |explicit ){0,2}written consent
proprietary | 2 | 78 | proprietary license | proprietary licen[cs]e(?: agreement)?
proprietary | 2 | 70 | unlicensed | licen[cs]e unlicensed
commercial | 2 | 75 | commercial license | (?:under a |a )?commercial licen[cs]e(?: agreement)?
eula | 2 | 80 | end user license agreement | end user licen[cs]e agreement
eula | 2 | 65 | eula | eula
noncommercial | 2 | 78 | non commercial use only | (?:for )?(?:personal and )?non commercial use only
noncommercial | 2 | 78 | noncommercial use only | (?:for )?(?:personal and )?noncommercial use only
noncommercial | 2 | 75 | for research purposes only | for (?:academic and )?research purposes only
noncommercial | 2 | 75 | academic use only | (?:for )?academic use only
evaluation | 2 | 72 | evaluation purposes only | for evaluation purposes only
shareware | 1 | 60 | shareware | shareware
freeware | 1 | 60 | freeware | freeware
export-control | 4 | 70 | export administration regulations | export administration regulations
dual | 2 | 65 | dual licensed | dual licensed(?: under)?
dual | 2 | 60 | at your option | (?:either|any) ~(?:\S+ ){0,10}at your option
unknown-spdx | 1 | 55 | spdx license identifier | spdx license identifier \S+(?: \S+){0,2}
unknown-license | 1 | 45 | licen* | licen[cs]ed under (?:the |a |an )?(?:\S+ ){0,4}licen[cs]e(?: (?:v|version )?[1-9](?: [0-9])?)?
unknown-license | 1 | 40 | licen* | (?:under|subject to) the terms (?:and conditions )?of ~licen[cs]e
unknown-license | 1 | 35 | see the license | see (?:the )?licen[cs]e(?: file)?(?: txt| md)?
unknown-license | 1 | 35 | licen* | licen[cs]e (?:terms|agreement|notice|text|file)
copyright | 1 | 40 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | 1 | 30 | copyright | copyright (?:holders?|owners?|notice)
copyright | 1 | 25 | © | © ?(?:19|20)[0-9]{2}
"""

"""Licence scans by ordered signature rules [operator 6].

A text is lower-cased and read as words joined by single blanks, so that line breaks, comment signs and
punctuation don't matter.  Rules are regexes over that, written by hand, licence by licence, in six kinds that are
their order of priority: a tag, a grant ("licensed under the ..."), a notice at the head of a file, a clause of a
licence's text, its title, a plain mention.  Of the detections one that lies within another of the same or a higher
priority is suppressed ("general public license" within "lesser general public license"); equal spans go to the
earlier rule.

A rule is tried only where its literals stand in the text.  These are read off the rule itself (`literals`): sets of
strings such that every match has one of each set.  One pass with an automaton over all literals finds which are there.

The base phrases are counted apart from the rules, and their labels always stay.

Defined results: a null text is empty; a text without detections has empty label strings, null places and score
0; repeated rows give a row each; an empty table gives no rows; whole texts are read, however long; other columns are
carried along untouched, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from re import _constants as sre
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BASE = (((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl"))

#: Kinds of rules, in order of priority, with the weight of a detection as evidence.
KINDS = {"tag": 1.0, "grant": 0.95, "notice": 0.9, "clause": 0.9, "title": 0.8, "mention": 0.6}

#: Short forms in the rules below.
SHORT = {
    "<lic>": r"licen[cs]e",
    "<under>": r"(?:licen[cs]ed|relicen[cs]ed|released|distributed|redistributed|available|provided|published|covered|governed|use) (?:to you )?(?:under|by) (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?(?:gnu )?",
    "<terms>": r"(?:subject to|accept|agree to|under|according to) the (?:terms|terms and conditions|conditions|provisions) of (?:the )?(?:gnu )?",
    "<spdx>": r"spdx license identifier ",
    "<or>": r"(?: only| or later)?",
}

#: Every line is a kind and a regex over lower-cased words joined by blanks.
RULES = {
    "mit": r"""
        tag <spdx>mit
        tag license (?:type )?mit
        grant <under>mit(?: x11| expat| style)?(?: open source)?(?: <lic>)?
        grant <terms>mit(?: x11)? <lic>
        grant (?:is|are|as) mit licen[cs]ed
        notice use of this source code is governed by an mit style <lic> that can be found in the <lic> file
        notice (?:see|read)(?: the)? (?:licen[cs]e|copying)(?: file| md| txt)? for the mit <lic>
        clause permission is hereby granted free of charge to any person obtaining a copy of this (?:software|work|library|program)
        clause to deal in the (?:software|work|materials) without restriction including without limitation the rights to use copy modify merge publish distribute
        clause to use copy modify merge publish distribute sublicense and or sell copies of the (?:software|work)
        clause the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
        clause in no event shall the (?:authors|copyright holders|authors or copyright holders) be liable for any claim damages or other liability
        title the mit <lic>(?: mit)?
        title expat <lic>
        mention mit(?: x11| expat)?(?: open source)? licen[cs]ed?""",
    "mit-0": r"""
        tag <spdx>mit 0
        title mit no attribution
        mention mit 0 <lic>""",
    "x11": r"""
        tag <spdx>x11
        grant <under>x11 <lic>
        clause except as contained in this notice the name (?:of the x consortium|s of the above copyright holders) shall not be used in advertising
        clause in no event shall the x consortium be liable for any claim damages or other liability
        mention x11 <lic>""",
    "isc": r"""
        tag <spdx>isc
        grant <under>(?:isc|internet (?:systems|software) consortium)(?: <lic>)?
        grant <terms>(?:isc|internet (?:systems|software) consortium)(?: <lic>)?
        clause permission to use copy modify and or distribute this software(?: for any purpose with or without fee is hereby granted)?
        clause permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
        clause the (?:author|authors|isc) disclaims? all warranties with regard to this software including all implied warranties of merchantability and fitness
        clause in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        title isc <lic> isc
        mention (?:isc|internet (?:systems|software) consortium) <lic>""",
    "0bsd": r"""
        tag <spdx>0bsd
        title (?:bsd zero clause|zero clause bsd|bsd 0 clause) <lic>
        clause permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
        mention 0bsd""",
    "apache-1.1": r"""
        tag <spdx>apache 1 1
        grant <under>apache(?: software)?(?: <lic>)?(?: version)? 1 1
        clause the end user documentation included with the redistribution if any must include the following acknowledge?ment this product includes software developed by
        clause products derived from this software may not be called apache nor may apache appear in their name
        title (?:the )?apache software <lic> version 1 1""",
    "apache-2.0": r"""
        tag <spdx>apache 2 0
        tag license (?:type )?apache 2(?: 0)?
        grant <under>apache(?: software)?(?: <lic>)?(?: version| v)? ?2(?: 0)?(?: <lic>)?
        grant <terms>apache(?: software)?(?: <lic>)?(?: version| v)? ?2(?: 0)?(?: <lic>)?
        notice licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        notice you may (?:not use this file except in compliance with|obtain a copy of) the license(?: at)?
        notice unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        notice www apache org licenses license 2 0
        clause without warranties or conditions of any kind either express or implied
        clause each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
        clause you must give any other recipients of the work or derivative works a copy of this license
        clause you must cause any modified files to carry prominent notices stating that you changed the files
        clause if the work includes a notice text file as part of its distribution
        title apache <lic>(?: version| v)? 2 0(?: january 2004)?
        mention (?:apache|asl)(?: <lic>)?(?: version| v)? ?2(?: 0)?(?: <lic>)?""",
    "apache": r"""
        grant <under>apache(?: software)? <lic>
        grant <terms>apache(?: software)? <lic>
        mention apache(?: software)? licen[cs]ed?""",
    "bsd-2-clause": r"""
        tag <spdx>bsd 2 clause
        grant <under>(?:simplified bsd|freebsd|2 clause bsd|two clause bsd|bsd 2 clause)(?: <lic>)?
        title (?:the )?(?:simplified bsd|freebsd|2 clause bsd|two clause bsd|bsd 2 clause|bsd two clause)(?: <lic>)
        mention (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)""",
    "bsd-3-clause": r"""
        tag <spdx>bsd 3 clause
        grant <under>(?:modified bsd|revised bsd|new bsd|3 clause bsd|three clause bsd|bsd 3 clause)(?: <lic>)?
        clause may be used to endorse or promote products derived from this software without (?:specific )?prior written permission
        clause neither the names? of (?:the )?(?:copyright holders?|university|author|authors|project|company|organization)(?: nor the names of (?:its|their|the) contributors)? may be used to endorse or promote products
        title (?:the )?(?:modified bsd|revised bsd|new bsd|3 clause bsd|three clause bsd|bsd 3 clause|bsd three clause) <lic>
        mention (?:bsd 3 clause|3 clause bsd|three clause bsd|modified bsd|new bsd)""",
    "bsd-4-clause": r"""
        tag <spdx>bsd 4 clause
        grant <under>(?:original bsd|old bsd|4 clause bsd|four clause bsd|bsd 4 clause)(?: <lic>)?
        clause all advertising materials mentioning features or use of this software must display the following acknowledge?ment
        clause this product includes software developed by the university of california berkeley and its contributors
        title (?:the )?(?:original bsd|4 clause bsd|four clause bsd|bsd 4 clause) <lic>""",
    "bsd": r"""
        grant <under>bsd(?: style| like)?(?: <lic>)?
        notice use of this source code is governed by a bsd style <lic> that can be found in the <lic> file
        clause redistribution and use in source and binary forms with or without modification
        clause redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        clause redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
        clause this software is provided by (?:the )?(?:copyright holders?|author|authors|regents|copyright owner|project)(?: and contributors)? as is and any express or implied warranties
        clause in no event shall the (?:copyright (?:holders?|owner)|author|authors|regents)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages
        mention bsd(?: style| like)? licen[cs]ed?""",
    "gpl-1.0": r"""
        tag <spdx>gpl 1 0<or>
        grant <under>(?:general public <lic>|gpl)(?:v| v| version)? ?1(?: 0)?""",
    "gpl-2.0": r"""
        tag <spdx>gpl 2 0<or>
        grant <under>(?:general public <lic>|gpl)(?: as published by the free software foundation)?(?: either)?(?:v| v| version)? ?2(?: 0)?
        grant <terms>(?:general public <lic>|gpl)(?: as published by the free software foundation)?(?: either)?(?:v| v| version)? ?2(?: 0)?
        notice (?:either )?version 2 of the <lic> or at your option any later version
        notice write to the free software foundation inc (?:51 franklin st(?:reet)?|59 temple place|675 mass ave)
        clause activities other than copying distribution and modification are not covered by this license they are outside its scope
        clause you may copy and distribute verbatim copies of the program s source code as you receive it in any medium
        clause if the modified program normally reads commands interactively when run you must cause it when started running for such interactive use
        clause you are not required to accept this license since you have not signed it
        clause each time you redistribute the program or any work based on the program the recipient automatically receives a license
        title gnu general public <lic> version 2(?: june 1991)?
        mention (?:gnu )?(?:general public <lic>|gpl)(?:v| v| version)? ?2(?: 0)?(?: <lic>)?""",
    "gpl-3.0": r"""
        tag <spdx>gpl 3 0<or>
        grant <under>(?:general public <lic>|gpl)(?: as published by the free software foundation)?(?: either)?(?:v| v| version)? ?3(?: 0)?
        grant <terms>(?:general public <lic>|gpl)(?: as published by the free software foundation)?(?: either)?(?:v| v| version)? ?3(?: 0)?
        notice (?:either )?version 3 of the <lic> or at your option any later version
        clause the gnu general public license is a free copyleft license for software and other kinds of works
        clause to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement
        clause you may convey verbatim copies of the program s source code as you receive it in any medium
        clause you may not propagate or modify a covered work except as expressly provided under this license
        clause no covered work shall be deemed part of an effective technological measure
        title gnu general public <lic> version 3(?: 29 june 2007)?
        mention (?:gnu )?(?:general public <lic>|gpl)(?:v| v| version)? ?3(?: 0)?(?: <lic>)?""",
    "gpl": r"""
        grant <under>(?:general public <lic>|gpl)
        grant <terms>(?:general public <lic>|gpl)
        notice this (?:program|file|software|package) is free software you can redistribute it and or modify it under the terms of the gnu general public license
        notice this (?:program|file|software|package) is distributed in the hope that it will be useful but without any warranty
        notice you should have received a copy of the gnu general public license along with this
        clause the licenses for most software are designed to take away your freedom to share and change it
        clause everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
        title gnu general public <lic>
        mention gnu gpl|gpl licen[cs]ed?|general public <lic>""",
    "lgpl-2.0": r"""
        tag <spdx>lgpl 2 0<or>
        title gnu library general public <lic> version 2
        mention (?:library general public <lic>|lgpl)(?:v| v| version)? ?2(?: 0)?""",
    "lgpl-2.1": r"""
        tag <spdx>lgpl 2 1<or>
        grant <under>(?:lesser general public <lic>|lgpl)(?: as published by the free software foundation)?(?: either)?(?:v| v| version)? ?2 1
        grant <terms>(?:lesser general public <lic>|lgpl)(?: as published by the free software foundation)?(?: either)?(?:v| v| version)? ?2 1
        clause you may opt to apply the terms of the ordinary gnu general public license instead of this license to a given copy of the library
        clause a program that contains no derivative of any portion of the library but is designed to work with the library
        title gnu lesser general public <lic> version 2 1(?: february 1999)?
        mention (?:lesser general public <lic>|lgpl)(?:v| v| version)? ?2 1""",
    "lgpl-3.0": r"""
        tag <spdx>lgpl 3 0<or>
        grant <under>(?:lesser general public <lic>|lgpl)(?: as published by the free software foundation)?(?: either)?(?:v| v| version)? ?3(?: 0)?
        grant <terms>(?:lesser general public <lic>|lgpl)(?: as published by the free software foundation)?(?: either)?(?:v| v| version)? ?3(?: 0)?
        clause this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
        clause you may convey a covered work under sections 3 and 4 of this license without being bound by section 3 of the gnu gpl
        title gnu lesser general public <lic> version 3(?: 29 june 2007)?
        mention (?:lesser general public <lic>|lgpl)(?:v| v| version)? ?3(?: 0)?""",
    "lgpl": r"""
        grant <under>(?:(?:lesser|library) general public <lic>|lgpl)
        grant <terms>(?:(?:lesser|library) general public <lic>|lgpl)
        notice this (?:library|program|file|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
        notice you should have received a copy of the gnu (?:lesser|library) general public license along with this
        notice this library is distributed in the hope that it will be useful but without any warranty
        title gnu (?:lesser|library) general public <lic>
        mention gnu lgpl|lgpl|(?:lesser|library) general public <lic>""",
    "agpl-3.0": r"""
        tag <spdx>agpl 3 0<or>
        grant <under>(?:affero general public <lic>|agpl)
        grant <terms>(?:affero general public <lic>|agpl)
        notice you should have received a copy of the gnu affero general public license along with this
        clause your modified version must prominently offer all users interacting with it remotely through a computer network
        clause the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community
        title gnu affero general public <lic>
        mention gnu agpl|agpl(?:v| v| version)? ?3|affero general public <lic>""",
    "fdl": r"""
        tag <spdx>gfdl 1 [123]<or>
        grant <under>(?:free documentation <lic>|gfdl)
        clause permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
        clause with no invariant sections no front cover texts and no back cover texts
        mention gnu (?:free documentation <lic>|fdl)|gfdl""",
    "mpl-1.1": r"""
        tag <spdx>mpl 1 1
        grant <under>(?:mozilla public <lic>|mpl)(?: version| v)? 1 1
        notice the contents of this file are subject to the mozilla public license version 1 [01]
        notice software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations
        title mozilla public <lic> version 1 1
        mention mpl 1 1""",
    "mpl-2.0": r"""
        tag <spdx>mpl 2 0
        grant <under>(?:mozilla public <lic>|mpl)(?:v| v| version)? ?2(?: 0)?
        notice this source code form is subject to the terms of the mozilla public license v 2 0
        notice if a copy of the mpl was not distributed with this file you can obtain one at
        clause this source code form is incompatible with secondary licenses
        title mozilla public <lic> version 2 0
        mention mozilla public <lic> 2 0|mpl(?:v| v)? ?2(?: 0)?""",
    "mpl": r"""
        grant <under>(?:mozilla public <lic>|mpl)
        grant <terms>(?:mozilla public <lic>|mpl)
        mention mozilla public <lic>|mpl licen[cs]ed""",
    "epl-1.0": r"""
        tag <spdx>epl 1 0
        grant <under>(?:eclipse public <lic>|epl)(?: version| v)? ?1(?: 0)?
        clause the accompanying program is provided under the terms of this eclipse public license
        title eclipse public <lic>(?: version| v)? 1 0""",
    "epl-2.0": r"""
        tag <spdx>epl 2 0
        grant <under>(?:eclipse public <lic>|epl)(?: version| v)? ?2(?: 0)?
        notice this program and the accompanying materials are made available under the terms of the eclipse public license
        title eclipse public <lic>(?: version| v)? 2 0""",
    "epl": r"""
        grant <under>eclipse public <lic>
        mention eclipse public <lic>""",
    "cddl-1.0": r"""
        tag <spdx>cddl 1 [01]
        grant <under>(?:common development and distribution <lic>|cddl)
        grant <terms>(?:common development and distribution <lic>|cddl)
        notice when distributing covered code include this cddl header notice in each file
        mention common development and distribution <lic>|cddl""",
    "cpl-1.0": r"""
        tag <spdx>cpl 1 0
        grant <under>common public <lic>
        clause the accompanying program is provided under the terms of this common public license
        mention common public <lic>""",
    "ipl-1.0": r"""
        tag <spdx>ipl 1 0
        mention ibm public <lic>""",
    "artistic-2.0": r"""
        tag <spdx>artistic 2 0
        grant <under>artistic <lic> 2 0
        clause this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
        title (?:the )?artistic <lic> 2 0""",
    "artistic": r"""
        tag <spdx>artistic 1 0(?: perl| cl8)?
        grant <under>(?:perl )?artistic <lic>
        grant under the same terms as perl itself
        clause the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
        clause you may make and give away verbatim copies of the source form of the standard version of this package without restriction
        mention artistic <lic>""",
    "zlib": r"""
        tag <spdx>zlib
        grant <under>zlib(?: libpng)?(?: <lic>)?
        clause this software is provided as is without any express or implied warranty
        clause in no event will the authors be held liable for any damages arising from the use of this software
        clause permission is granted to anyone to use this software for any purpose including commercial applications
        clause the origin of this software must not be misrepresented you must not claim that you wrote the original software
        clause altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        clause this notice may not be removed or altered from any source distribution
        mention zlib(?: libpng)? <lic>""",
    "libpng": r"""
        tag <spdx>libpng(?: 2 0)?
        clause the png reference library is supplied as is
        clause the contributing authors and group 42 inc disclaim all warranties expressed or implied
        mention libpng <lic>""",
    "boost-1.0": r"""
        tag <spdx>bsl 1 0
        grant <under>boost software(?: <lic>)?
        grant <terms>boost software(?: <lic>)?
        notice distributed under the boost software license version 1 0 see accompanying file
        clause permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
        clause unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
        mention boost software <lic>""",
    "unlicense": r"""
        tag <spdx>unlicense
        grant <under>unlicense
        clause this is free and unencumbered software released into the public domain
        clause anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
        clause we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
        mention (?:the )?unlicense""",
    "wtfpl": r"""
        tag <spdx>wtfpl
        clause everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
        clause you just do what the fuck you want to
        mention wtfpl|do what the fuck you want to public <lic>""",
    "public-domain": r"""
        grant (?:this (?:software|file|code|work|program|library) (?:is|has been)|is hereby|hereby) (?:placed|released|dedicated) (?:in|into|to) the public domain
        notice (?:the )?authors? (?:hereby )?disclaims? copyright to this source code""",
    "cc0-1.0": r"""
        tag <spdx>cc0 1 0
        grant <under>(?:cc0|creative commons (?:cc0|zero))
        clause affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights
        clause to the extent possible under law (?:the author s|the person who associated cc0 with this work) ha(?:s|ve) (?:dedicated|waived) all copyright and related (?:or|and) neighboring rights
        title cc0 1 0 universal
        mention cc0(?: 1 0)? <lic>|creative commons zero""",
    "cc-by-4.0": r"""
        tag <spdx>cc by 4 0
        grant <under>(?:creative commons attribution|cc by) 4 0
        notice creativecommons org licenses by 4 0
        mention (?:creative commons attribution|cc by)(?: international)? 4 0""",
    "cc-by-3.0": r"""
        tag <spdx>cc by 3 0
        notice creativecommons org licenses by 3 0
        mention (?:creative commons attribution|cc by)(?: unported)? 3 0""",
    "cc-by-sa-4.0": r"""
        tag <spdx>cc by sa 4 0
        notice creativecommons org licenses by sa 4 0
        mention (?:creative commons attribution share ?alike|cc by sa) 4 0""",
    "cc-by-sa-3.0": r"""
        tag <spdx>cc by sa 3 0
        notice creativecommons org licenses by sa 3 0
        mention (?:creative commons attribution share ?alike|cc by sa) 3 0""",
    "cc-by-sa": r"""
        grant <under>(?:creative commons attribution share ?alike|cc by sa)
        mention creative commons attribution share ?alike|cc by sa""",
    "cc-by-nc": r"""
        notice creativecommons org licenses by nc
        mention creative commons attribution non ?commercial|cc by nc""",
    "cc-by-nd": r"""
        notice creativecommons org licenses by nd
        mention creative commons attribution no ?deriv(?:ative)?s|cc by nd""",
    "cc-by": r"""
        grant <under>(?:creative commons attribution|cc by)
        mention creative commons attribution|cc by <lic>""",
    "python-2.0": r"""
        tag <spdx>(?:python|psf) 2 0
        grant <under>(?:python software foundation|psf)(?: <lic>)?
        grant <terms>(?:python software foundation|psf)(?: <lic>)?
        clause psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly
        clause psf is making python available to licensee on an as is basis
        mention (?:python software foundation|psf) <lic>""",
    "php-3.01": r"""
        tag <spdx>php 3 0[01]?1?
        grant <under>php <lic>
        notice this source file is subject to version 3 0[01]?1? of the php license
        clause products derived from this software may not be called php nor may php appear in their name
        clause this product includes php software freely available from
        mention php <lic>""",
    "ruby": r"""
        tag <spdx>ruby
        grant <under>ruby <lic>
        clause you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices
        mention ruby(?: s)? <lic>""",
    "openssl": r"""
        tag <spdx>openssl
        grant <under>openssl <lic>
        clause this product includes software developed by the openssl project for use in the openssl toolkit
        clause products derived from this software may not be called openssl nor may openssl appear in their names
        clause this product includes cryptographic software written by eric young
        mention openssl <lic>""",
    "curl": r"""
        tag <spdx>curl
        clause except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
        mention curl <lic>""",
    "ntp": r"""
        tag <spdx>ntp
        clause permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies""",
    "hpnd": r"""
        tag <spdx>hpnd
        clause permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
        title historical permission notice and disclaimer""",
    "unicode": r"""
        tag <spdx>unicode dfs 201[56]
        clause to deal in the data files or software without restriction
        title unicode (?:inc )?license agreement data files and software""",
    "postgresql": r"""
        tag <spdx>postgresql
        grant <under>postgresql <lic>
        clause permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
        clause in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages including lost profits
        mention postgresql <lic>""",
    "ms-pl": r"""
        tag <spdx>ms pl
        grant <under>microsoft public(?: <lic>)?
        mention microsoft public <lic>|ms pl <lic>""",
    "ms-rl": r"""
        tag <spdx>ms rl
        mention microsoft reciprocal <lic>|ms rl <lic>""",
    "osl-3.0": r"""
        tag <spdx>osl 3 0
        notice this source file is subject to the open software license
        mention open software <lic>(?: version| v)? ?3 0|osl 3 0""",
    "afl-3.0": r"""
        tag <spdx>afl 3 0
        notice this source file is subject to the academic free license
        mention academic free <lic>""",
    "ofl-1.1": r"""
        tag <spdx>ofl 1 1
        grant <under>(?:sil )?open font <lic>
        clause permission is hereby granted free of charge to any person obtaining a copy of the font software
        clause neither the font software nor any of its individual components in original or modified versions may be sold by itself
        clause the font software is provided as is without warranty of any kind
        mention sil open font <lic>|open font <lic>|ofl 1 1""",
    "eupl-1.2": r"""
        tag <spdx>eupl 1 2
        grant <under>(?:european union public <lic>|eupl)
        mention european union public <lic>|eupl(?: v| version)? ?1 2""",
    "cecill-2.1": r"""
        tag <spdx>cecill 2 1
        notice this software is governed by the cecill <lic> under french law
        mention cecill <lic>""",
    "ecl-2.0": r"""
        tag <spdx>ecl 2 0
        grant <under>educational community <lic>
        mention educational community <lic>""",
    "odbl": r"""
        tag <spdx>odbl 1 0
        grant <under>(?:open (?:data commons open )?database <lic>|odbl)
        mention open (?:data commons open )?database <lic>|odbl""",
    "vim": r"""
        tag <spdx>vim
        clause vim is charityware you can use and copy it as much as you like
        mention vim <lic>""",
    "json": r"""
        tag <spdx>json
        clause the software shall be used for good not evil""",
    "beerware": r"""
        tag <spdx>beerware
        clause as long as you retain this notice you can do whatever you want with this stuff if we meet some day
        mention beer ?ware <lic>""",
    "bsl-1.1": r"""
        tag <spdx>busl 1 1
        grant <under>business source <lic>
        clause the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
        mention business source <lic>""",
    "sspl-1.0": r"""
        tag <spdx>sspl 1 0
        grant <under>server side public <lic>
        clause if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
        mention server side public <lic>""",
    "elastic-2.0": r"""
        tag <spdx>elastic 2 0
        grant <under>elastic(?: <lic>)?(?: 2 0)?
        grant <terms>elastic(?: <lic>)?(?: 2 0)?
        clause you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features
        mention elastic <lic>(?: 2 0)?""",
    "proprietary": r"""
        notice this (?:software|file|document|program) (?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential)
        notice unauthori[sz]ed copying of this file via any medium is strictly prohibited
        notice all rights reserved no part of this (?:software|file|document|publication|book) may be reproduced""",
}


# ---- what a rule needs -------------------------------------------------------------------------------------------

_MOST = 24  # alternatives that a literal may have


def _whole(items) -> set[str] | None:
    """The strings that a sequence matches, if they are few."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            some = {chr(arg)}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            some = {chr(c) for _, c in arg}
        elif op is sre.SUBPATTERN:
            some = _whole(arg[-1])
        elif op is sre.BRANCH:
            parts = [_whole(x) for x in arg[1]]
            some = None if None in parts else set().union(*parts)
        elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
            some = _whole(arg[2])
            some = None if some is None else some | {""}
        else:
            some = None
        if some is None or len(out) * len(some) > _MOST:
            return None
        out = {a + b for a in out for b in some}
    return out


def _shortest(some: set[str]) -> frozenset[str]:
    """Without strings that hold another one."""
    return frozenset(x for x in some if not any(y != x and y in x for y in some))


def _needed(items) -> list[frozenset[str]]:
    """Sets of strings: whatever the sequence matches has one of each."""
    out, run = [], {""}
    for item in items:
        op, arg = item
        some = _whole([item])
        if some is not None and len(run) * len(some) <= _MOST:
            run = {a + b for a in run for b in some}
            continue
        out.append(_shortest(run))
        run = {""} if some is None else some
        if some is None and op is sre.SUBPATTERN:
            out += _needed(arg[-1])
        elif some is None and op is sre.BRANCH:
            parts = [max(_needed(x), key=lambda y: min(map(len, y)), default=frozenset({""})) for x in arg[1]]
            out.append(_shortest(set().union(*parts)))
        elif some is None and op is sre.MAX_REPEAT and arg[0] > 0:
            out += _needed(arg[2])
    return [x for x in [*out, _shortest(run)] if min(len(y.strip()) for y in x) > 1]


def literals(pattern: str) -> list[frozenset[str]]:
    """Sets of strings: every match of a regex has one of each set."""
    return _needed(_parser.parse(pattern))


@cache
def rules() -> list[tuple[re.Pattern, str, int, float]]:
    """Pattern, label, priority, weight, in order: by kind, then as written."""
    out = []
    for label, lines in RULES.items():
        for line in lines.strip().split("\n"):
            kind, pattern = line.strip().split(" ", 1)
            for short, long in SHORT.items():
                pattern = pattern.replace(short, long)
            out.append((re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), label, list(KINDS).index(kind), KINDS[kind], pattern))
    return [r[:4] for r in sorted(out, key=lambda r: r[2])]


@cache
def _automaton() -> tuple[ahocorasick.Automaton, list[tuple[int, frozenset[int]]]]:
    """All literals, each with the numbers of the sets that it is in; rules with the numbers of the sets that they need."""
    numbers: dict[frozenset[str], int] = {}
    needs = [(i, frozenset(numbers.setdefault(x, len(numbers)) for x in literals(pattern.pattern))) for i, (pattern, *_) in enumerate(rules())]
    within: dict[str, list[int]] = {}
    for some, n in numbers.items():
        for x in some:
            within.setdefault(x, []).append(n)
    out = ahocorasick.Automaton()
    for x, ns in within.items():
        out.add_word(x, tuple(ns))
    out.make_automaton()
    return out, needs


def detections(text: bytes, gated: bool = True) -> list[tuple[int, int, int, str, float]]:
    """(start, end, priority, label, weight) of what stays of the rules' matches in blank-joined words."""
    decoded, every = text.decode("utf-8", "replace"), rules()
    automaton, needs = _automaton()
    there = {n for ns in {ns for _, ns in automaton.iter(decoded)} for n in ns} if gated else set()
    found = []
    for i, need in needs:
        if not gated or need <= there:
            pattern, label, priority, weight = every[i]
            found += [(m.start(), m.end(), priority, label, weight) for m in pattern.finditer(decoded)]
    return suppressed(found)


def suppressed(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Without what lies within a kept detection of the same or a higher priority.

    The kept ones that lie in no other are held by start, so by end as well; a detection needs a look at one of them.
    """
    kept, starts, ends = [], [], []
    for i in sorted(range(len(found)), key=lambda i: (found[i][2], found[i][0] - found[i][1], found[i][0], i)):
        s, e = found[i][:2]
        at = bisect_right(starts, s)
        if at and ends[at - 1] >= e:
            continue
        kept.append(found[i])
        at -= bool(at and starts[at - 1] == s)
        upto = bisect_right(ends, e, at)
        starts[at:upto], ends[at:upto] = [s], [e]
    return sorted(kept)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Word number and label of each place where a base phrase stands."""
    out, at = [], -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return sorted(out)
        out += [(at - len(p) + 1, label) for p, label in BASE if at + 1 >= len(p) and tuple(words[at - len(p) + 1 : at + 1]) == p]


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the spans found of one text."""
    words = text.translate(C.ALNUM_TEXT).split()
    joined = b" ".join(words)
    base = base_places(words) if b"license" in joined else []
    found = detections(joined)
    base_labels = sorted({label for _, label in base})
    labels = sorted({*base_labels, *(d[3] for d in found)})
    score = max([0.6 * bool(base), *(d[4] for d in found)])
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(base_labels), ",".join(labels), score, [{"start": d[0], "end": d[1], "label": d[3]} for d in found]


_OUT = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))}


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string>>"


def license_scan(docs: DataFrame, carry=("doc_id",)) -> DataFrame:
    """row (a struct of the carried columns), the columns of scan() and the spans in blank-joined words."""

    def run(texts: pa.Array) -> list[pa.Array]:
        found = list(zip(*(scan(t.as_py()) for t in texts), strict=True)) or [()] * len(_OUT)
        return [pa.array(c, k) for c, k in zip(found, _OUT.values(), strict=True)]

    C.short_batches(docs.sparkSession)
    rows = docs.select(F.struct(*carry).alias("row"), C.per_text(run, _SCHEMA)(C.text_bytes()).alias("found"))
    return rows.select("row", "found.*")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(C.table(spark, sf_dir, "documents")).select("row.doc_id", *[c for c in _OUT if c != "spans"])

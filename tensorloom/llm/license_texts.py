"""Licence notices and texts as templates, and the phrases of the base.

Markup: words between <<beginOptional>> and <<endOptional>> may be absent; a
<<var;name=...;original=...;...>> stands for other words, `words=m-n` for any m to n of
them, `match=a|b` for one of those given. All other words have to stand there, in order;
case, punctuation and white space don't count.
"""

from __future__ import annotations

# Phrases of the base and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Spellings that count as one in templates, as the public matching guidelines for licences list them.
SPELLINGS = {"license": ["licence"], "licenses": ["licences"], "licensed": ["licenced"], "sublicense": ["sublicence", "relicense"], "noninfringement": ["noninfringment"], "merchantability": ["merchantibility"], "holder": ["owner"], "holders": ["owners"]}

# Public licence notices and texts.
TEMPLATES = [
    ("gpl-3", """<<beginOptional>>licensed under<<endOptional>> the GNU General Public License <<var;name=as;original=;match=version 3|v3|3|as published by the Free Software Foundation either version 3 of the License|as published by the Free Software Foundation version 3 of the License>>
        <<beginOptional>>0<<endOptional>> <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"""),
    ("gpl-2", """<<beginOptional>>licensed under<<endOptional>> the GNU General Public License <<var;name=as;original=;match=version 2|v2|2|as published by the Free Software Foundation either version 2 of the License|as published by the Free Software Foundation version 2 of the License>>
        <<beginOptional>>0<<endOptional>> <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"""),
    ("lgpl", """the GNU <<var;name=kind;original=Lesser;match=Lesser|Library>> General Public License"""),
    ("agpl-3", """the GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation either<<endOptional>> <<var;name=version;original=version 3;match=version 3|v3>>"""),
    ("mpl-2", """subject to the terms of the Mozilla Public License <<beginOptional>>v<<endOptional>> <<var;name=version;original=v 2.0;match=version 2|v2|2>> <<beginOptional>>0<<endOptional>>"""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<var;name=url;original=http://www.apache.org/licenses/LICENSE-2.0;words=1-12>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("cc-by", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution <<beginOptional>>4.0<<endOptional>> <<beginOptional>>3.0<<endOptional>> <<beginOptional>>International<<endOptional>> License"""),
    ("cc-by-sa", """Creative Commons Attribution <<var;name=kind;original=ShareAlike;match=ShareAlike|Share Alike>>"""),
    ("cc-by-nc", """Creative Commons Attribution <<var;name=kind;original=NonCommercial;match=NonCommercial|Non Commercial>>"""),
    ("cc0", """<<var;name=name;original=CC0 1.0;match=CC0 1.0|CC0|Creative Commons Zero>> <<beginOptional>>Universal<<endOptional>> <<var;name=act;original=Public Domain Dedication;match=Public Domain Dedication|public domain|license>>"""),
    ("mit", """<<beginOptional>>The MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> <<beginOptional>>Copyright <<var;name=copyright;original=(c) year holders;words=1-20>><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=files;original=this software and associated documentation files;words=1-8>> (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of <<var;name=copies;original=the Software;words=1-5>>.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        <<var;name=rights;original=NONINFRINGEMENT;match=NONINFRINGEMENT|NON INFRINGEMENT>>. IN NO EVENT SHALL <<var;name=holders;original=THE AUTHORS OR COPYRIGHT HOLDERS;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, <<beginOptional>>and<<endOptional>><<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holder;original=THE AUTHOR;words=1-8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<beginOptional>>THIS SOFTWARE IS PROVIDED BY <<var;name=holder;original=THE COPYRIGHT HOLDERS AND CONTRIBUTORS;words=1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES<<endOptional>>"""),
    ("bsd-3", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<beginOptional>>3<<endOptional>> Neither the name of <<var;name=holder;original=the copyright holder;words=1-12>> nor the names of <<var;name=whose;original=its;match=its|their|the>> contributors may be used to endorse or promote products derived from this software
        without specific prior written permission."""),
    ("unlicense", """This is free and unencumbered software released into the public domain."""),
    ("all-rights-reserved", """All rights reserved"""),
]

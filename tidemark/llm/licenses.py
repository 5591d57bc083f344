"""License scan: ordered signature rules with a keyword prefilter and containment suppression.

A rule is a regular expression over the lower-cased text, written in words: in a phrase a space stands for any run of
separators, `a|b` in braces for alternatives, `?` after a word for an optional one and `#3.0` for a version, said as
"version 3.0", "v 3.0" or "v3.0", or without its 0. Versions of names and abbreviations and identifiers behind the SPDX mark have
patterns of their own. Each rule names a keyword, words
that stand in all that it matches; a document runs only the rules whose keyword it contains, between any separators. Detections that overlap are resolved by priority: one that lies
within a detection of at least its priority is dropped. The four base phrases are matched on words and always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import ALNUM, blocks, lower_ascii, prefix_hash, span_hash, words

#: Phrase, label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_SEP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_NOT_IN_WORD, _WORD_ENDS = r"(?<![^\x00-\x2f\x3a-\x60\x7b-\x7f])", r"(?![^\x00-\x2f\x3a-\x60\x7b-\x7f])"
#: After a bare major version: it isn't the beginning of another version.
_NO_MINOR = r"(?!\.[1-9]|\.0[0-9])"
#: After a version with its point: it isn't the beginning of a longer one.
_NO_MORE = r"(?!\.[0-9])"
#: Between a name and a version without the word.
_BESIDE = r"[ ,(-]+"
#: What lets later versions in.
_LATER = "(?:" + "|".join(_SEP + x.replace(" ", _SEP) for x in ("or later", "or newer", "or any later version", "or at your option any later version")) + r"|\+)"
#: What stands in an expression of identifiers before one that isn't the first: the same line, up to the next mark.
_EXPRESSION = r"(?:(?!spdx)[^\n])*?[ \t)]+(?:and|or|with)[ \t(]+"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    confidence: float
    pattern: str


def _version(version: str, minor: bool = False) -> str:
    """The regular expression of a version in words; `minor`: as digits with a point alone, without the word."""
    first, *rest = version.split(".")
    if minor:
        return re.escape(version) + _NO_MORE
    tail = f"{_NO_MINOR}(?:{_SEP}0)?" if rest == ["0"] else "".join(_SEP + x for x in rest)
    return f"(?:version{_SEP}|v{_SEP}|v){first}{tail}"


def _words(text: str) -> str:
    """A phrase in the notation above, without its ends."""
    out = ""
    for i, w in enumerate(text.split()):
        optional = w.endswith("?")
        w = w.rstrip("?")
        w = _version(w[1:]) if w[0] == "#" else "(?:" + "|".join(map(re.escape, w[1:-1].split("|"))) + ")" if w[0] == "{" else re.escape(w)
        out += (f"(?:{_SEP}{w})?" if optional else f"{_SEP}{w}") if i else w
    return out


def _phrase(text: str) -> str:
    """The regular expression of a phrase in the notation above."""
    return f"{_NOT_IN_WORD}{_words(text)}{_WORD_ENDS}"


def _versions(name: str, version: str, short: bool = False) -> Iterator[tuple[str, str]]:
    """Patterns of a name with a version, and whether each means that version alone ("") or later ones too ("+").

    After a full name a version says so, or stands beside it with its point (a bare number may be that of a section); after an
    abbreviation it may be any number, and be written together with it.
    """
    if short:
        said = (f"(?:{_SEP})?" + _version(version).replace("|v)", "|v|)"),)
    else:
        said = (_SEP + _version(version), _BESIDE + _version(version, True))
    for v in said:
        yield f"{_NOT_IN_WORD}{_words(name)}{v}(?:{_SEP}only)?{_WORD_ENDS}", ""
        yield f"{_NOT_IN_WORD}{_words(name)}{v}{_LATER}{_WORD_ENDS}", "+"


def _identifier(words: str) -> Iterator[str]:
    """Patterns of a short identifier behind its mark: as the first of an expression, and as a later one (a group of its own)."""
    yield _phrase(f"spdx license identifier {words}")
    yield f"{_NOT_IN_WORD}{_words('spdx license identifier')}{_EXPRESSION}({_words(words)}){_WORD_ENDS}"


# Licences with versions: label stem, keyword, name phrases, abbreviations, versions.
_VERSIONED = (
    ("gpl", "general public", ("gnu general public {license|licence}", "general public {license|licence}"), ("gpl", "gnu gpl"), ("1.0", "2.0", "3.0")),
    ("lgpl", "lesser general", ("gnu lesser general public {license|licence}", "lesser general public {license|licence}"), ("lgpl", "gnu lgpl"), ("2.1", "3.0")),
    ("lgpl", "library general", ("gnu library general public {license|licence}",), (), ("2.0",)),
    ("agpl", "affero", ("gnu affero general public {license|licence}", "affero general public {license|licence}"), ("agpl", "gnu agpl"), ("1.0", "3.0")),
    ("gfdl", "free documentation", ("gnu free documentation {license|licence}",), ("gfdl",), ("1.1", "1.2", "1.3")),
    ("apache", "apache", ("apache software? {license|licence}",), (), ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla public", ("mozilla public {license|licence}",), ("mpl",), ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public", ("eclipse public {license|licence}",), ("epl",), ("1.0", "2.0")),
    ("cddl", "common development", ("common development and distribution {license|licence}",), ("cddl",), ("1.0", "1.1")),
    ("cpl", "common public", ("common public {license|licence}",), (), ("1.0",)),
    ("eupl", "european union public", ("european union public {license|licence}",), ("eupl",), ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", ("artistic {license|licence}", "perl artistic {license|licence}"), (), ("1.0", "2.0")),
    ("afl", "academic free", ("academic free {license|licence}",), (), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", "open software", ("open software {license|licence}",), (), ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("bsl", "boost software", ("boost software {license|licence}",), (), ("1.0",)),
    ("busl", "business source", ("business source {license|licence}",), ("busl",), ("1.1",)),
    ("sspl", "server side public", ("server side public {license|licence}",), ("sspl",), ("1.0",)),
    ("ofl", "open font", ("sil open font {license|licence}", "open font {license|licence}"), ("ofl",), ("1.0", "1.1")),
    ("odbl", "open database", ("open database {license|licence}",), ("odbl",), ("1.0",)),
    ("cecill", "cecill", ("cecill free? software? license?",), (), ("1.0", "2.0", "2.1")),
    ("zpl", "zope public", ("zope public {license|licence}",), (), ("1.1", "2.0", "2.1")),
    ("psf", "python software foundation", ("python software foundation {license|licence}",), (), ("2.0",)),
    ("php", "php licen", ("php {license|licence}",), (), ("3.0", "3.01")),
    ("qpl", "q public", ("q public {license|licence}",), (), ("1.0",)),
    ("ms-pl", "microsoft public", ("microsoft public {license|licence}",), (), ("1.0",)),
    ("ms-rl", "microsoft reciprocal", ("microsoft reciprocal {license|licence}",), (), ("1.0",)),
    ("nposl", "non-profit open", ("non profit open software {license|licence}",), (), ("3.0",)),
    ("upl", "universal permissive", ("universal permissive {license|licence}",), ("upl",), ("1.0",)),
)

# Creative Commons: elements in words, label.
_CC = (
    ("attribution noncommercial noderivatives", "by nc nd", "cc-by-nc-nd"), ("attribution noncommercial sharealike", "by nc sa", "cc-by-nc-sa"), ("attribution noncommercial", "by nc", "cc-by-nc"),
    ("attribution noderivatives", "by nd", "cc-by-nd"), ("attribution sharealike", "by sa", "cc-by-sa"), ("attribution", "by", "cc-by"),
)
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Single rules, written by hand: label, priority, keyword, confidence, phrase.
_SINGLE = (
    ("mit", 55, "mit licence", 0.85, "mit licence"),
    ("mit", 60, "mit licen", 0.9, "{the|an} mit {license|licence}"),
    ("mit", 60, "mit licen", 0.95, "released under the mit {license|licence}"),
    ("mit", 60, "mit licen", 0.95, "licensed under the mit {license|licence}"),
    ("mit", 70, "permission is hereby granted", 0.95, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 70, "permission to use", 0.9, "permission to use copy modify and {or|distribute} distribute? this software for any purpose"),
    ("isc", 60, "isc licen", 0.9, "isc {license|licence}"),
    ("bsd", 70, "redistribution and use", 0.95, "redistribution and use in source and binary forms"),
    ("bsd", 40, "bsd", 0.7, "bsd {license|licence|licensed|style}"),
    ("bsd-2-clause", 60, "bsd", 0.9, "{2|two|simplified} clause? bsd"),
    ("bsd-2-clause", 60, "bsd", 0.9, "bsd {2|two} clause"),
    ("bsd-3-clause", 60, "bsd", 0.9, "{3|three|new|modified|revised} clause? bsd"),
    ("bsd-3-clause", 60, "bsd", 0.9, "bsd {3|three} clause"),
    ("bsd-4-clause", 60, "bsd", 0.9, "{4|four|original} clause? bsd"),
    ("bsd-4-clause", 60, "bsd", 0.9, "bsd {4|four} clause"),
    ("0bsd", 60, "zero", 0.9, "zero clause bsd"),
    ("zlib", 60, "zlib", 0.9, "zlib {license|licence}"),
    ("zlib", 70, "as-is", 0.8, "this software is provided as is without any express or implied warranty"),
    ("unlicense", 70, "unencumbered", 0.95, "free and unencumbered software released into the public domain"),
    ("public-domain", 30, "public domain", 0.6, "public domain"),
    ("public-domain", 50, "public domain", 0.8, "{dedicated|released|placed} {to|into|in} the public domain"),
    ("cc0", 70, "cc0", 0.9, "cc0 1? 0? universal?"),
    ("wtfpl", 60, "what the", 0.9, "do what the fuck you want to public license"),
    ("proprietary", 40, "all rights reserved", 0.6, "all rights reserved"),
    ("proprietary", 50, "proprietary", 0.7, "proprietary and confidential"),
    ("proprietary", 50, "unauthorized", 0.7, "unauthorized {copying|reproduction|distribution} of this {file|software|document|material}"),
    ("proprietary", 40, "may not be reproduced", 0.7, "may not be reproduced"),
    ("eula", 40, "end user license", 0.8, "end user license agreement"),
    ("copyright", 20, "copyright", 0.5, "copyright {c|19|20}"),
    ("copyright", 10, "copyright", 0.4, "copyright"),
    ("gpl", 70, "free software foundation", 0.9, "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", 75, "lesser general", 0.9, "under the terms of the gnu lesser general public license"),
    ("apache-2.0", 70, "apache license", 0.95, "licensed under the apache license #2.0"),
    ("apache-2.0", 70, "apache.org", 0.9, "www apache org licenses license 2 0"),
    ("mpl", 70, "mozilla.org", 0.9, "mozilla org mpl"),
    ("gpl", 60, "gnu.org/licenses", 0.7, "gnu org licenses"),
    ("cc", 30, "creative commons", 0.6, "creative commons"),
    # what licences say of themselves: sentences that only they hold
    ("mit", 55, "substantial portions", 0.8, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 45, "noninfringement", 0.6, "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-0", 65, "mit no attribution", 0.9, "mit no attribution"),
    ("x11", 60, "x consortium", 0.9, "except as contained in this notice the name of the x consortium shall not be used"),
    ("bsd", 65, "source code must retain", 0.9, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 65, "binary form must reproduce", 0.9, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 72, "endorse or promote", 0.9, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 72, "advertising materials", 0.9, "all advertising materials mentioning features or use of this software must display the following {acknowledgement|acknowledgment}"),
    ("bsd", 40, "holders and contributors", 0.6, "provided by the copyright holders and contributors as is"),
    ("isc", 66, "author disclaims", 0.8, "the author disclaims all warranties with regard to this software"),
    ("hpnd", 65, "its documentation", 0.7, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("zlib", 72, "altered source", 0.9, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 72, "origin of this software", 0.9, "the origin of this software must not be misrepresented"),
    ("libpng", 65, "libpng", 0.9, "libpng license"),
    ("bsl-1.0", 70, "accompanying documentation", 0.9, "obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", 66, "boost.org", 0.9, "boost org license 1 0 txt"),
    ("unlicense", 60, "unlicense", 0.9, "{the|this} unlicense"),
    ("unlicense", 66, "unlicense.org", 0.9, "unlicense org"),
    ("unlicense", 66, "relinquishment in perpetuity", 0.9, "relinquishment in perpetuity of all present and future rights"),
    ("wtfpl", 55, "wtfpl", 0.9, "wtfpl"),
    ("beerware", 65, "beer", 0.8, "buy me a beer in return"),
    ("beerware", 60, "beer", 0.8, "beer ware {license|licence}"),
    ("json", 65, "not evil", 0.9, "the software shall be used for good not evil"),
    ("postgresql", 62, "postgresql", 0.9, "postgresql {license|licence}"),
    ("ncsa", 62, "university of illinois", 0.9, "university of illinois ncsa open source {license|licence}"),
    ("curl", 60, "curl license", 0.8, "curl license"),
    ("openssl", 62, "openssl license", 0.9, "openssl license"),
    ("openssl", 66, "openssl toolkit", 0.9, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 66, "eric young", 0.9, "this product includes cryptographic software written by eric young"),
    ("ijg", 66, "independent jpeg", 0.9, "this software is based in part on the work of the independent jpeg group"),
    ("ftl", 62, "freetype", 0.9, "freetype project? license"),
    ("vim", 60, "vim license", 0.9, "vim license"),
    ("ruby", 60, "ruby license", 0.9, "ruby license"),
    ("sleepycat", 62, "sleepycat", 0.9, "sleepycat {license|licence|software}"),
    ("w3c", 62, "w3c", 0.9, "w3c software {notice|license|and}"),
    ("unicode", 62, "unicode", 0.9, "unicode license agreement"),
    ("icu", 60, "icu license", 0.9, "icu license"),
    ("naist", 60, "nara institute", 0.8, "nara institute of science and technology"),
    ("blueoak-1.0.0", 65, "blue oak", 0.9, "blue oak model license"),
    ("mulan-psl-2.0", 65, "mulan", 0.9, "mulan permissive software {license|licence}"),
    ("fair", 58, "fair license", 0.7, "fair license"),
    ("ecl-2.0", 64, "educational community", 0.9, "educational community {license|licence}"),
    ("intel", 60, "intel open source", 0.9, "intel open source {license|licence}"),
    ("ipl-1.0", 64, "ibm public", 0.9, "ibm public {license|licence}"),
    ("apsl", 62, "apple public source", 0.9, "apple public source {license|licence}"),
    ("npl", 62, "netscape public", 0.9, "netscape public {license|licence}"),
    ("sissl", 62, "sun industry", 0.9, "sun industry standards source {license|licence}"),
    ("rpl", 62, "reciprocal public", 0.9, "reciprocal public {license|licence}"),
    ("rpsl", 62, "realnetworks", 0.9, "realnetworks public source {license|licence}"),
    ("nokia", 62, "nokia open source", 0.9, "nokia open source {license|licence}"),
    ("lucent", 62, "lucent public", 0.9, "lucent public {license|licence}"),
    ("sgi-b", 62, "sgi free software", 0.9, "sgi free software {license|licence} b?"),
    ("cua", 62, "cua office", 0.9, "cua office public {license|licence}"),
    ("watcom", 62, "sybase open watcom", 0.9, "sybase open watcom public {license|licence}"),
    ("entessa", 62, "entessa", 0.9, "entessa public {license|licence}"),
    ("frameworx", 62, "frameworx", 0.9, "frameworx open {license|licence}"),
    ("vsl", 62, "vovida", 0.9, "vovida software {license|licence}"),
    ("xnet", 60, "x net license", 0.8, "x net license"),
    ("motosoto", 62, "motosoto", 0.9, "motosoto open source {license|licence}"),
    ("ngpl", 62, "nethack", 0.9, "nethack general public {license|licence}"),
    ("wxwindows", 62, "wxwindows", 0.9, "wxwindows library {license|licence}"),
    ("latex", 62, "latex project", 0.9, "latex project public {license|licence}"),
    ("artistic", 66, "collection of files", 0.7, "package means the collection of files distributed by the copyright holder"),
    ("elastic-2.0", 64, "elastic license", 0.9, "elastic license"),
    ("polyform-noncommercial", 64, "polyform", 0.9, "polyform noncommercial license"),
    ("polyform-small-business", 64, "polyform", 0.9, "polyform small business license"),
    ("polyform-strict", 64, "polyform", 0.9, "polyform strict license"),
    ("commons-clause", 64, "commons clause", 0.9, "commons clause"),
    ("commons-clause", 70, "right to sell", 0.9, "does not grant to you the right to sell the software"),
    ("hippocratic", 64, "hippocratic", 0.9, "hippocratic {license|licence}"),
    ("openrail", 64, "rail", 0.9, "{creativeml|bigcode|bigscience} open? rail m? license?"),
    ("openrail", 60, "responsible ai", 0.9, "responsible ai {license|licence|licenses|licences}"),
    ("llama", 62, "llama", 0.9, "llama 2? 3? community license agreement?"),
    ("gemma", 62, "gemma terms", 0.9, "gemma terms of use"),
    ("redis-sal", 62, "redis source available", 0.9, "redis source available {license|licence}"),
    ("confluent", 62, "confluent community", 0.9, "confluent community {license|licence}"),
    ("timescale", 62, "timescale license", 0.9, "timescale license agreement?"),
    ("gpl", 72, "any later version", 0.8, "either version 2 of the license or at your option any later version"),
    ("gpl", 72, "any later version", 0.8, "either version 3 of the license or at your option any later version"),
    ("lgpl", 74, "version 2.1 of the license", 0.8, "either version 2 1 of the license or at your option any later version"),
    ("gpl", 68, "without any warranty", 0.6, "hope that it will be useful but without any warranty"),
    ("gpl", 66, "received a copy", 0.8, "you should have received a copy of the gnu general public license"),
    ("lgpl", 72, "received a copy", 0.8, "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", 72, "received a copy", 0.8, "you should have received a copy of the gnu library general public license"),
    ("agpl", 72, "received a copy", 0.8, "you should have received a copy of the gnu affero general public license"),
    ("gpl", 64, "franklin", 0.5, "51 franklin {street|st} fifth floor boston"),
    ("gpl", 64, "temple place", 0.5, "59 temple place suite 330 boston"),
    ("gpl", 64, "mass ave", 0.5, "675 mass ave cambridge"),
    ("gpl", 62, "verbatim copies", 0.6, "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-classpath", 72, "linking this library", 0.9, "linking this library statically or dynamically with other modules is making a combined work"),
    ("gcc-exception", 72, "runtime library exception", 0.9, "gcc runtime library exception"),
    ("llvm-exception", 72, "llvm exception", 0.9, "llvm {exception|exceptions}"),
    ("agpl", 72, "interacting with it remotely", 0.8, "all users interacting with it remotely through a computer network"),
    ("apache", 66, "express or implied", 0.8, "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", 66, "specific language governing", 0.8, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache", 66, "asf", 0.8, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 66, "apache software foundation", 0.7, "this product includes software developed by the apache software foundation"),
    ("mpl-2.0", 72, "subject to the terms of the mozilla", 0.95, "this source code form is subject to the terms of the mozilla public license #2.0"),
    ("mpl-2.0", 68, "incompatible with secondary", 0.9, "incompatible with secondary licenses"),
    ("mpl-1.1", 70, "contents of this file", 0.8, "the contents of this file are subject to the mozilla public license #1.1"),
    ("mpl", 72, "the mpl", 0.9, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", 70, "eclipse.org", 0.9, "eclipse org legal epl {v10|v20|2} 0? html?"),
    ("epl", 68, "accompanying materials", 0.8, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", 70, "contents of this file", 0.8, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("ms-pl", 66, "microsoft public", 0.8, "microsoft public license ms pl"),
    ("ms-limited", 66, "microsoft limited", 0.9, "microsoft limited public license"),
    ("ms-reference", 66, "microsoft reference source", 0.9, "microsoft reference source license"),
    ("cc", 40, "creative commons", 0.8, "licensed under a creative commons"),
    ("cc-by-nc", 50, "non-commercial", 0.5, "creative commons attribution non commercial"),
    ("cc-by-nc-sa", 56, "non-commercial", 0.6, "creative commons attribution non commercial share alike"),
    ("cc-by-nc-nd", 56, "non-commercial", 0.6, "creative commons attribution non commercial no {derivatives|derivs}"),
    ("cc-by-sa", 52, "share alike", 0.6, "creative commons attribution share alike"),
    ("cc-by-nd", 52, "creative commons", 0.6, "creative commons attribution no {derivatives|derivs}"),
    ("cc-sampling", 56, "sampling", 0.8, "creative commons sampling plus?"),
    ("cc-pdm", 66, "public domain mark", 0.9, "public domain mark"),
    ("cc0", 72, "creativecommons.org", 0.95, "creativecommons org publicdomain zero 1 0"),
    ("cc0", 68, "waived all copyright", 0.9, "has waived all copyright and related or neighboring rights"),
    ("cc0", 66, "public domain dedication", 0.9, "cc0 1 0 universal public domain dedication"),
    ("gfdl", 68, "invariant sections", 0.9, "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", 70, "document under the terms", 0.8, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("odbl", 66, "opendatacommons.org", 0.9, "opendatacommons org licenses odbl"),
    ("odc-by", 66, "open data commons attribution", 0.9, "open data commons attribution license"),
    ("pddl", 66, "public domain dedication and license", 0.9, "open data commons public domain dedication and license"),
    ("cdla-permissive", 66, "community data", 0.9, "community data license agreement permissive"),
    ("cdla-sharing", 66, "community data", 0.9, "community data license agreement sharing"),
    ("ogl-uk", 66, "open government", 0.9, "open government {license|licence}"),
    ("etalab", 64, "ouverte", 0.9, "{licence|license} ouverte etalab?"),
    ("dl-de-by", 66, "datenlizenz deutschland", 0.9, "datenlizenz deutschland namensnennung"),
    ("dl-de-zero", 66, "datenlizenz deutschland", 0.9, "datenlizenz deutschland zero"),
    ("gutenberg", 66, "project gutenberg", 0.9, "project gutenberg {license|licence|tm}"),
    ("ofl", 70, "reserved font name", 0.9, "with reserved font name"),
    ("ofl", 66, "scripts.sil.org", 0.9, "scripts sil org ofl"),
    ("ubuntu-font", 66, "ubuntu font", 0.9, "ubuntu font {license|licence}"),
    ("bitstream-vera", 66, "bitstream vera", 0.9, "bitstream vera is a trademark of bitstream"),
    ("arphic", 66, "arphic", 0.9, "arphic public {license|licence}"),
    ("design-science", 66, "design science", 0.9, "design science {license|licence}"),
    ("free-art", 66, "free art", 0.9, "free art {license|licence}"),
    ("against-drm", 66, "against drm", 0.9, "against drm {license|licence}"),
    ("gpl-notice-es", 66, "licencia pública", 0.8, "licencia pública general {de|gnu} gnu?"),
    ("gpl-notice-fr", 66, "licence publique", 0.8, "licence publique générale gnu"),
    ("gpl-notice-de", 66, "öffentlichen", 0.6, "allgemeinen öffentlichen gnu lizenz"),
    ("eupl", 66, "eupl", 0.9, "licensed under the eupl"),
    ("cecill-b", 66, "cecill-b", 0.9, "cecill b"),
    ("cecill-c", 66, "cecill-c", 0.9, "cecill c"),
    ("proprietary", 55, "trade secret", 0.8, "contains confidential? and? trade secret information"),
    ("proprietary", 50, "without the", 0.7, "without the {prior|express} {express|prior|written} written? {permission|consent} of"),
    ("proprietary", 52, "strictly prohibited", 0.7, "{copying|distribution|reproduction|use} is strictly prohibited"),
    ("proprietary", 45, "internal use only", 0.6, "for internal use only"),
    ("proprietary", 50, "licensed materials", 0.8, "licensed materials property of"),
    ("proprietary", 50, "transferable", 0.5, "{non|not} exclusive {non|not} transferable license"),
    ("proprietary", 55, "reverse engineer", 0.8, "{may|shall|must} not reverse engineer decompile or disassemble"),
    ("noncommercial", 45, "non-commercial", 0.6, "for non commercial {use|purposes} only"),
    ("noncommercial", 45, "noncommercial", 0.6, "for noncommercial {use|purposes} only"),
    ("academic", 45, "purposes only", 0.6, "for {academic|research|educational} and? or? research? purposes only"),
    ("evaluation", 45, "evaluation purposes", 0.7, "for evaluation purposes only"),
    ("shareware", 45, "shareware", 0.7, "this is shareware"),
    ("freeware", 45, "freeware", 0.7, "{is|as} freeware"),
    ("freely-distributable", 40, "be freely", 0.6, "may be freely {distributed|copied|used}"),
    ("royalty-free", 40, "royalty-free", 0.6, "{worldwide|perpetual|irrevocable} royalty free"),
    ("patent-grant", 45, "patent license", 0.6, "perpetual worldwide non exclusive no charge royalty free irrevocable patent license"),
    ("dual-license", 45, "dual licensed", 0.7, "dual licensed under"),
    ("dual-license", 45, "at your", 0.6, "at your {choice|option} {of|under|either}"),
    ("cla", 40, "contributor license", 0.5, "contributor license agreement"),
    ("dco", 40, "certificate of origin", 0.6, "developer certificate of origin"),
    ("terms-of-use", 30, "terms of", 0.4, "terms of {use|service}"),
    ("copyright", 15, "rights reserved", 0.4, "some rights reserved"),
    ("unknown-license", 8, "see", 0.3, "see the? {license|copying|licence} file"),
    ("unknown-license", 8, "distributed under", 0.3, "distributed under the {terms|conditions} of"),
    ("unknown-license", 5, "licensed under", 0.3, "licensed under"),
    ("unknown-license", 5, "spdx-license-identifier", 0.5, "spdx license identifier"),
)


def rules() -> list[Rule]:
    """All rules, in the order in which equal priorities are resolved."""
    out = []
    for stem, keyword, names, short, versions in _VERSIONED:
        for name in names:
            out.append(Rule(stem, 50, keyword, 0.85, _phrase(name)))
        for v in versions:
            number = v.replace(".", " ")
            for name in names:
                out += [Rule(f"{stem}-{v}{mark}", 65 + 5 * bool(mark), keyword, 0.95, p) for p, mark in _versions(name, v)]
            for abbreviation in short:
                out += [Rule(f"{stem}-{v}{mark}", 55 + 5 * bool(mark), abbreviation.split()[-1], 0.8, p) for p, mark in _versions(abbreviation, v, True)]
            family = stem.replace("-", " ")
            for p in _identifier(f"{family} {number}"):
                out.append(Rule(f"{stem}-{v}", 80, "spdx license identifier", 0.99, p))
            for p in (*_identifier(f"{family} {number} or later"), f"{_NOT_IN_WORD}{_words(f'spdx license identifier {family} {number}')}\\+"):
                out.append(Rule(f"{stem}-{v}+", 80, "spdx license identifier", 0.99, p))
    for name, short, label in _CC:
        out.append(Rule(label, 50 + len(short), "creative commons", 0.85, _phrase(f"creative commons {name}")))
        out.append(Rule(label, 40 + len(short), "cc", 0.7, _phrase(f"cc {short}")))
        for v in _CC_VERSIONS:
            number = v.replace(".", " ")
            out.append(Rule(f"{label}-{v}", 60 + len(short), "creative commons", 0.95, _phrase(f"creative commons {name} {number}")))
            out.append(Rule(f"{label}-{v}", 60 + len(short), "cc", 0.9, _phrase(f"cc {short} {number}")))
            out.append(Rule(f"{label}-{v}", 60 + len(short), "creativecommons.org", 0.95, _phrase(f"creativecommons org licenses {short} {number}")))
    for label, priority, keyword, confidence, phrase in _SINGLE:
        out.append(Rule(label, priority, keyword, confidence, _phrase(phrase)))
    known = {r.label for r in out if r.keyword == "spdx license identifier"}
    for label in sorted({r.label for r in out if "+" not in r.label} - known - {"unknown-license"}):
        out += [Rule(label, 80, "spdx license identifier", 0.99, p) for p in _identifier(re.sub(r"[-.]", " ", label))]
    return out


class Scanner:
    def __init__(self, table: list[Rule] | None = None):
        self.rules = rules() if table is None else table
        self.compiled = [re.compile(r.pattern) for r in self.rules]
        self.by_keyword: dict[bytes, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.by_keyword.setdefault(re.sub(_SEP, " ", r.keyword).encode(), []).append(i)

    @staticmethod
    def spaced(low: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
        """A lower-cased block with each run of separators as one space, and where its documents start."""
        word = ALNUM[low]
        keep = word.copy()
        keep[1:] |= word[:-1]
        place = np.zeros(len(low) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        return np.where(word, low, np.uint8(32))[keep].tobytes(), place[off]

    def prefilter(self, block: bytes, off: np.ndarray) -> dict[int, list[int]]:
        """For each document of a block from `spaced`, the rules whose keyword it holds."""
        out: dict[int, list[int]] = {}
        for keyword, ids in self.by_keyword.items():
            at = block.find(keyword)
            while at >= 0:
                doc = int(np.searchsorted(off, at, "right")) - 1
                end = int(off[doc + 1])
                if at + len(keyword) <= end:
                    out.setdefault(doc, []).extend(ids)
                    at = block.find(keyword, end)
                else:
                    at = block.find(keyword, at + 1)
        return out

    def detect(self, text: str, ids: list[int]) -> list[tuple[int, int, Rule]]:
        """Detections left after suppression, by place. `text` is lower-cased."""
        found = [(self.rules[i], *m.span(m.re.groups), i) for i in ids for m in self.compiled[i].finditer(text)]
        found.sort(key=lambda x: (-x[0].priority, -(x[2] - x[1]), x[1], x[3]))
        # a tree over the starts holds the furthest end of what is kept up to each: that contains b if anything does
        place = {a: i for i, a in enumerate(sorted({a for _, a, _, _ in found}), 1)}
        furthest, kept = [0] * (len(place) + 1), []
        for rule, a, b, _ in found:
            i = place[a]
            while i and furthest[i] < b:
                i &= i - 1
            if not i:
                kept.append((a, b, rule))
                i = place[a]
                while i < len(furthest):
                    furthest[i] = max(furthest[i], b)
                    i += i & -i
        return sorted(kept, key=lambda x: (x[0], x[1]))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,priority:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    phrases = []
    for phrase, label in BASE:
        b = np.frombuffer(phrase.encode(), np.uint8)
        s, e, _ = words(b, np.array([0, len(b)]), ALNUM)
        phrases.append((label, span_hash(prefix_hash(b), s, e), phrase.split()))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, b, off in blocks(batch.column("text")):
            low = lower_ascii(b)
            s, e, first = words(low, off, ALNUM)
            h = span_hash(prefix_hash(low), s, e)
            doc_of = np.repeat(np.arange(hi - lo), np.diff(first))
            n = hi - lo
            count, least, most = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            raw = low.tobytes()
            for label, hs, ws in phrases:
                at = np.flatnonzero(h[: len(h) - len(hs) + 1] == hs[0]) if len(h) >= len(hs) else np.zeros(0, np.int64)
                for k in range(1, len(hs)):
                    at = at[(h[at + k] == hs[k]) & (doc_of[at + k] == doc_of[at])]
                for i in at.tolist():
                    if all(raw[s[i + k] : e[i + k]].decode() == w for k, w in enumerate(ws)):
                        d = int(doc_of[i])
                        place = i - int(first[d])
                        count[d] += 1
                        least[d], most[d] = min(least[d], place), max(most[d], place)
                        labels[d].add(label)
            hits = scanner.prefilter(*scanner.spaced(low, off))
            rest, score, spans = [set(x) for x in labels], np.zeros(n), [[] for _ in range(n)]
            for d, rule_ids in hits.items():
                left = 1.0
                for a, z, rule in scanner.detect(raw[off[d] : off[d + 1]].decode(), rule_ids):
                    rest[d].add(rule.label)
                    left *= 1 - rule.confidence
                    spans[d].append({"start": a, "end": z, "label": rule.label, "priority": rule.priority})
                score[d] = 1 - left
            score = np.where(count > 0, np.maximum(score, 0.9), score)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, n), pa.array(np.diff(first).astype(np.int64)), pa.array(count), pa.array(least, mask=none), pa.array(most, mask=none), pa.array([",".join(sorted(x)) for x in labels]), pa.array([",".join(sorted(x)) for x in rest]), pa.array(score), pa.array(spans, kind)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )


def scan(docs: DataFrame) -> DataFrame:
    """License labels of each document (doc_id, text); one pass, no shuffle. Detections are spans in code points.

    Null and empty texts have no words and no labels (empty strings, score 0, null places); repeated rows are scanned each.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)

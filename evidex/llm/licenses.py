"""Licence recognition by sentences, in DataFrame functions only.

Texts lose their comment marks, wrapped lines are joined, and sentences end at full stops, blank lines and SPDX tags. Each is
lower-cased and reduced to letters, digits, dots and plus signs. The known sentences in it have identifiers, the more
special ones named first; the identifiers of a text, in order, are matched against ordered rules. The first rule that
matches names a licence and leaves a mark in place of its identifiers, so that those around them stay apart. Sentences that
speak of licences but are not known are counted. Everything happens within a row: nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_version = r"(?: a?l?gpl)?(?: as published by the free software foundation)?(?: either)?(?: the)?(?: in)?(?: its)? ?(?:v(?:ersion)? ?)?"
#: Identifiers and patterns of known sentences, as normalised; those that come first are looked for first.
SENTENCES = [
    ("Negated", r"\b(?:not|never|no longer) (?:[a-z]+ ){0,2}(?:licensed|available|released|distributed|covered|provided) (?:[a-z]+ ){0,2}(?:under|by) (?:(?:[ac-z0-9][a-z0-9.+]*|b[a-tv-z][a-z]*) ?){1,8}"),
    ("ClasspathException", r"\bclasspath exception(?: 2\.0)?"),
    ("GplDetails", r"see the gnu (?:affero |lesser |library )?general public license for more details"),
    ("GplCopy", r"you should have received a copy of the gnu (?:affero |lesser |library )?general public license"),
    ("AgplPlus3", r"\bagpl ?(?:version ?|v ?)?3(?:\.0)?\+"),
    ("LgplPlus3", r"\blgpl ?(?:version ?|v ?)?3(?:\.0)?\+"),
    ("LgplPlus21", r"\blgpl ?(?:version ?|v ?)?2\.1\+"),
    ("GplPlus3", r"\bgpl ?(?:version ?|v ?)?3(?:\.0)?\+"),
    ("GplPlus2", r"\bgpl ?(?:version ?|v ?)?2(?:\.0)?\+"),
    ("AgplRef3", rf"gnu affero general public license{_version}3(?:\.0)?|\bagpl ?(?:version ?|v ?)?3(?:\.0)?\b"),
    ("AgplRef", r"gnu affero general public license|\bagpl\b"),
    ("LgplRef3", rf"gnu lesser general public license{_version}3(?:\.0)?|\blgpl ?(?:version ?|v ?)?3(?:\.0)?\b"),
    ("LgplRef21", rf"gnu lesser general public license{_version}2\.1|\blgpl ?(?:version ?|v ?)?2\.1\b"),
    ("LgplRef2", rf"gnu (?:lesser|library) general public license{_version}2(?:\.0)?|\blgpl ?(?:version ?|v ?)?2(?:\.0)?\b"),
    ("LgplRef", r"gnu (?:lesser|library) general public license|\blgpl\b"),
    ("GplRef3", rf"gnu general public license{_version}3(?:\.0)?|\bgpl ?(?:version ?|v ?)?3(?:\.0)?\b"),
    ("GplRef2", rf"gnu general public license{_version}2(?:\.0)?|\bgpl ?(?:version ?|v ?)?2(?:\.0)?\b"),
    ("GplRef", r"gnu general public license|\bgpl\b"),
    ("GplLater", r"or at your option any later version|or any later version|\bor later\b"),
    ("ApacheRef2", r"apache (?:software )?licen[cs]e ?(?:version )?v? ?2(?:\.0)?|\bapache ?(?:version ?|v)?2\.0\b(?: licen[cs]e)?|\bapache 2 licen[cs]e|\basl ?2\.0\b"),
    ("ApacheCompliance", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("MitRef", r"\bmit license|\bmit licence"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included"),
    ("IscGrant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("BsdRef4", r"\bbsd (?:4|four) clause\b|\b(?:4|four) clause bsd\b|\b(?:original|old) bsd\b"),
    ("BsdRef3", r"\bbsd (?:3|three) clause\b|\b(?:3|three) clause bsd\b|\b(?:new|modified|revised) bsd\b"),
    ("BsdRef2", r"\bbsd (?:2|two) clause\b|\b(?:2|two) clause bsd\b|\bsimplified bsd\b|\bfreebsd licen[cs]e"),
    ("BsdRef", r"\bbsd (?:style )?licen[cs]e"),
    ("BsdGrant", r"redistribution and use in source and binary forms"),
    ("BsdSource", r"redistributions of source code must retain"),
    ("BsdBinary", r"redistributions in binary form must reproduce"),
    ("BsdAdvert", r"all advertising materials mentioning features or use of this software must display"),
    ("BsdNames", r"neither the names? of [a-z0-9.+ ]*may be used to endorse|the names? of [a-z0-9.+ ]*may not be used to endorse"),
    ("CcByNcSaRef", r"\bcc by nc sa|creative commons attribution non ?commercial share ?alike"),
    ("CcByNcNdRef", r"\bcc by nc nd|creative commons attribution non ?commercial no ?deriv[a-z]*"),
    ("CcByNcRef", r"\bcc by nc|creative commons attribution non ?commercial"),
    ("CcBySaRef", r"\bcc by sa|creative commons attribution share ?alike"),
    ("CcByNdRef", r"\bcc by nd|creative commons attribution no ?deriv[a-z]*"),
    ("CcByRef", r"\bcc by\b|creative commons attribution"),
    ("Cc0Ref", r"\bcc0\b|public domain dedication"),
    ("MplRef2", r"mozilla public license ?(?:version|v)? ?2\.0|\bmpl ?v?2\.0"),
    ("MplRef11", r"mozilla public license ?(?:version|v)? ?1\.1|\bmpl ?v?1\.1"),
    ("EplRef2", r"eclipse public license ?(?:version|v)? ?2(?:\.0)?"),
    ("EplRef1", r"eclipse public license ?(?:version|v)? ?1(?:\.0)?"),
    ("CddlRef", r"common development and distribution license"),
    ("BoostRef", r"boost software license"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("UnlicenseRef", r"free and unencumbered software released into the public domain"),
    ("WtfplRef", r"do what the fuck you want to public license"),
    ("ArtisticRef2", r"artistic license ?(?:version |v)?2(?:\.0)?"),
    ("OflRef", r"sil open font license"),
    ("EuplRef", r"european union public licen[cs]e"),
    ("PsfRef", r"python software foundation license"),
    ("AsIs", r"provided(?: by [a-z0-9.+ ]*)? as is"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"\bcopyright (?:c |[0-9])|^copyright"),
]
#: Licences and the sequences of identifiers that show them, in the order in which they are tried.
RULES = [
    ("Apache-2.0", r"<ApacheRef2>(<ApacheCompliance>)?(<ApacheCopy>)?"),
    ("AGPL-3.0-or-later", r"<AgplRef3><GplLater>|<AgplPlus3>"),
    ("AGPL-3.0", r"<AgplRef3>"),
    ("AGPL", r"<AgplRef>(<GplLater>)?"),
    ("LGPL-3.0-or-later", r"<LgplRef3><GplLater>|<LgplPlus3>"),
    ("LGPL-3.0", r"<LgplRef3>"),
    ("LGPL-2.1-or-later", r"<LgplRef21><GplLater>|<LgplPlus21>"),
    ("LGPL-2.1", r"<LgplRef21>"),
    ("LGPL-2.0-or-later", r"<LgplRef2><GplLater>"),
    ("LGPL-2.0", r"<LgplRef2>"),
    ("LGPL", r"<LgplRef>(<GplLater>)?"),
    ("GPL-3.0-or-later", r"<GplRef3><GplLater>|<GplPlus3>"),
    ("GPL-3.0", r"<GplRef3>"),
    ("GPL-2.0-or-later", r"<GplRef2><GplLater>|<GplPlus2>"),
    ("GPL-2.0", r"<GplRef2>"),
    ("GPL", r"<GplRef>(<GplLater>)?"),
    ("MIT", r"<MitGrant>(<MitNotice>)?(<AsIs>)?"),
    ("MIT", r"<MitRef>"),
    ("ISC", r"<IscGrant>(<AsIs>)?"),
    ("BSD-4-Clause", r"<BsdGrant>(<BsdSource>)?(<BsdBinary>)?<BsdAdvert>(<BsdNames>)?(<AsIs>)?"),
    ("BSD-3-Clause", r"<BsdGrant>(<BsdSource>)?(<BsdBinary>)?<BsdNames>(<AsIs>)?"),
    ("BSD-2-Clause", r"<BsdGrant>(<BsdSource>)?(<BsdBinary>)?(<AsIs>)?"),
    ("BSD-4-Clause", r"<BsdRef4>"),
    ("BSD-3-Clause", r"<BsdRef3>"),
    ("BSD-2-Clause", r"<BsdRef2>"),
    ("BSD", r"<BsdRef>"),
    ("Classpath-exception-2.0", r"<ClasspathException>"),
    ("MPL-2.0", r"<MplRef2>"),
    ("MPL-1.1", r"<MplRef11>"),
    ("EPL-2.0", r"<EplRef2>"),
    ("EPL-1.0", r"<EplRef1>"),
    ("CDDL", r"<CddlRef>"),
    ("BSL-1.0", r"<BoostRef>"),
    ("Zlib", r"(<AsIs>)?<ZlibGrant>"),
    ("Unlicense", r"<UnlicenseRef>"),
    ("WTFPL", r"<WtfplRef>"),
    ("Artistic-2.0", r"<ArtisticRef2>"),
    ("OFL", r"<OflRef>"),
    ("EUPL", r"<EuplRef>"),
    ("PSF", r"<PsfRef>"),
    ("CC-BY-NC-SA", r"<CcByNcSaRef>"),
    ("CC-BY-NC-ND", r"<CcByNcNdRef>"),
    ("CC-BY-NC", r"<CcByNcRef>"),
    ("CC-BY-SA", r"<CcBySaRef>"),
    ("CC-BY-ND", r"<CcByNdRef>"),
    ("CC-BY", r"<CcByRef>"),
    ("CC0-1.0", r"<Cc0Ref>"),
]
#: SPDX identifiers and the licences that they name here, where these differ.
SPDX = {
    **{x: x for x in "Apache-2.0 MIT MIT-0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC MPL-2.0 MPL-1.1 EPL-2.0 EPL-1.0 BSL-1.0 Zlib Unlicense WTFPL Artistic-2.0 CC0-1.0 X11 NCSA PostgreSQL MS-PL OSL-3.0 AFL-3.0".split()},
    **{f"{x}{end}": f"{x}{to}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end, to in (("", ""), ("-only", ""), ("-or-later", "-or-later"), ("+", "-or-later"))},
    **{f"{x}-{v}": x for x in ("CC-BY", "CC-BY-SA", "CC-BY-ND", "CC-BY-NC", "CC-BY-NC-SA", "CC-BY-NC-ND") for v in ("2.0", "2.5", "3.0", "4.0")},
    **{x: x for x in "Classpath-exception-2.0 LLVM-exception GCC-exception-2.0 GCC-exception-3.1 Bison-exception-2.2 Autoconf-exception-3.0 Font-exception-2.0 Linux-syscall-note".split()},
    "CDDL-1.0": "CDDL", "CDDL-1.1": "CDDL", "OFL-1.1": "OFL", "EUPL-1.1": "EUPL", "EUPL-1.2": "EUPL", "PSF-2.0": "PSF", "Python-2.0": "PSF",
}
TAG = "spdx license identifier"
#: A sentence without any of these speaks of no licence, and is left out at once.
HINT = r"licen[cs]|copyright|permission|redistribut|public domain|creative commons|\bcc[ -]by|\bcc0|rights reserved|as is|as-is|later version|endorse|advertising materials|gpl|\bmpl|\bbsd\b|apache.?(?:v|version.)?2|\basl.?2|classpath.exception"
#: Steps from a lower-cased text to sentences parted by END: pattern and what takes its place, $1 being its first group.
END = "\x01"
STEPS = [
    ("\r\n", "\n"),
    (r"\n[\x20\t]*(?://+|/?\*+/?|#+|--+|;+|%+|<!--+|dnl\b|rem\b)[\x20\t]*", "\n"),
    (r"\n[\x20\t]*(?:\n[\x20\t]*)+", END),
    (r"(spdx-license-identifier:[^\n\x01]*)", f"{END}$1{END}"),
    (r"\bv\.[\x20]?([0-9])", "v $1"),
    (r"([.!?])[\x20\t\n]+", f"$1{END}"),
]


def spdx_patterns() -> list[tuple[str, str]]:
    """(identifier, pattern) of the SPDX identifiers as normalised, the longest first."""
    plain = {k: re.sub("[^a-z0-9.+]+", " ", k.lower()) for k in SPDX}
    return [(f"Spdx:{k}", rf"\b{re.escape(plain[k]).replace(chr(92) + ' ', ' ')}( |$)") for k in sorted(SPDX, key=lambda k: (-len(plain[k]), k))]


def spdx_names() -> dict[str, list[str]]:
    """The identifiers of SPDX sentences that name each licence."""
    out: dict[str, list[str]] = {}
    for k, name in SPDX.items():
        out.setdefault(name, []).append(f"Spdx:{k}")
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's rows: doc_id, sentence_ids, licenses (each once, in the order of the rules, comma-joined) and n_unknown.

    A text without known sentences, or without any (null, empty), has empty strings; n_unknown counts the sentences that speak
    of licences otherwise. Exceptions to a licence are named like licences. What a text says not to be licensed under is no
    licence (`Negated`). Texts of any length are read whole. Repeated rows give repeated results; a null doc_id stays null; no
    rows give none. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    text = F.concat(F.lit("\n"), F.col("text"))
    for pattern, to in STEPS:
        text = F.regexp_replace(text, pattern, to)
    # the long way is for texts that speak of licences at all
    d = d.select("doc_id", F.when(F.col("text").rlike(HINT), F.split(text, END)).alias("s"))
    d = d.select("doc_id", F.transform(F.filter("s", lambda x: x.rlike(HINT)), lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9.+]+", " "))).alias("s"))

    def marked(x: Column, patterns: list[tuple[str, str]]) -> Column:
        for name, pattern in patterns:
            x = F.regexp_replace(x, pattern, f" <{name}> ")
        return F.regexp_extract_all(x, F.lit("<[^>]+>"), F.lit(0))

    named = F.transform("s", lambda x: F.when(x.contains(TAG), marked(x, spdx_patterns())).otherwise(marked(x, SENTENCES)))
    d = d.select("doc_id", F.coalesce(named, F.array().cast("array<array<string>>")).alias("s"))
    d = d.select("doc_id", F.size(F.filter("s", lambda x: F.size(x) == 0)).cast("long").alias("n_unknown"), F.transform(F.flatten("s"), lambda x: F.regexp_replace(x, "[<>]", "")).alias("ids"))
    d = d.withColumn("rest", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    found = []
    for k, (name, pattern) in enumerate(RULES):
        d = d.withColumns({f"r{k}": F.when(F.col("rest").rlike(pattern), name), "rest": F.regexp_replace("rest", pattern, "<>")})
        found.append(F.col(f"r{k}"))
    tagged = [F.when(F.arrays_overlap("ids", F.array(*map(F.lit, ks))), name) for name, ks in spdx_names().items()]
    licenses = F.array_join(F.array_distinct(F.filter(F.array(*found, *tagged), lambda x: x.isNotNull())), ",")
    return d.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), licenses.alias("licenses"), "n_unknown")


def oracle_sql() -> str:
    """The same in SQL: sentences are named and rules applied in as many steps."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def nested(x: str, steps: list[tuple[str, str]]) -> str:
        for pattern, to in steps:
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
        return x

    def marked(patterns: list[tuple[str, str]]) -> str:
        return f"regexp_extract_all({nested('x', [(p, f' <{k}> ') for k, p in patterns])}, '<[^>]+>')"

    steps, last = [], "t0"
    for k, (name, pattern) in enumerate(RULES):
        steps.append(f"t{k + 1} AS (SELECT * EXCLUDE (rest, found), CASE WHEN regexp_matches(rest, {quoted(pattern)}) AND NOT list_contains(found, {quoted(name)}) THEN list_append(found, {quoted(name)}) ELSE found END AS found, regexp_replace(rest, {quoted(pattern)}, '<>', 'g') AS rest FROM t{k})")
        last = f"t{k + 1}"
    tagged = ", ".join(f"CASE WHEN list_has_any(ids, [{', '.join(map(quoted, ks))}]) AND NOT list_contains(found, {quoted(name)}) THEN {quoted(name)} END" for name, ks in spdx_names().items())
    return rf"""
WITH a AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), {quoted(HINT)}) THEN list_filter(string_split({nested("chr(10) || lower(text)", STEPS)}, {quoted(END)}), lambda x: regexp_matches(x, {quoted(HINT)})) ELSE CAST([] AS VARCHAR[]) END AS s FROM documents),
b AS (SELECT doc_id, list_transform(s, lambda x: trim(regexp_replace(x, '[^a-z0-9.+]+', ' ', 'g'))) AS s FROM a),
c AS (SELECT doc_id, list_transform(s, lambda x: CASE WHEN contains(x, {quoted(TAG)}) THEN {marked(spdx_patterns())} ELSE {marked(SENTENCES)} END) AS s FROM b),
n AS (SELECT doc_id, CAST(len(list_filter(s, lambda x: len(x) = 0)) AS BIGINT) AS n_unknown, list_transform(flatten(s), lambda x: regexp_replace(x, '[<>]', '', 'g')) AS ids FROM c),
t0 AS (SELECT *, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM n),
{", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_concat(found, list_filter([{tagged}], lambda x: x IS NOT NULL)), ','), '') AS licenses, n_unknown FROM {last}
"""

"""Licence scans by sentence rules (DataFrame functions only).

Texts are cut into sentences and normalised: lower case, runs of other
characters than letters, digits, dot, plus and hyphen to one space, no articles,
"licence" as "license", "version 2" as "v2".  A normalised sentence is looked up
whole in the table of ``WHOLE`` sentences.  One that is not there gives, in text
order, the names of licences that are written out in it (a table of ``NAMES``,
longest first) and the sentences that vary (``VARYING``).  What follows a denial
("is not, and never was, licensed under ...") up to "but" names nothing.

A tag ("SPDX-License-Identifier: ...") is read by its grammar: identifiers joined
by AND and OR, in parentheses, WITH exceptions, "+" or "-or-later".  What follows
the expression is no part of it.

The sequence of identifiers is matched against ordered licence ``RULES``; what a
rule matches is consumed, so that a full text is not also read as its parts.
Each text is cut twice, at line ends and across them, because licence texts are
wrapped; a colon ends a sentence only at a line's end, so tags stay whole.  The
licences of both readings are united.

Texts and sentences are read further if they hold a word that every known
sentence or name has, or one that speaks of licences: sentences that speak of
them and are not known are counted.

Edge cases: a null text has no sentences; repeated sentences and rows count
each by themselves; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents

# Words that speak of licences, as they begin.
SPEAKS_WORDS = ("license", "licence", "copyright", "permission", "warrant", "redistribut", "spdx", "public domain", "endorse or promote", "liable")
SPEAKS = "(?i)" + "|".join(SPEAKS_WORDS)

# How licences are written out, normalised.
_PLAIN = {
    "MIT": ("mit license", "mit licenses", "license mit", "mit licensed", "mit-license", "expat license", "mit x11 license"),
    "ISC": ("isc license", "license isc"),
    "Zlib": ("zlib license", "license zlib", "zlib libpng license"),
    "Unlicense": ("unlicense", "license unlicense"),
    "BSL-1.0": ("boost software license v1.0", "boost software license", "bsl-1.0"),
    "Apache-2.0": ("apache license v2.0", "apache license v2", "apache license 2.0", "apache software license v2.0", "apache-2.0", "apache 2.0", "apache v2.0"),
    "Apache": ("apache license", "license apache"),
    "BSD-3-Clause": ("bsd 3-clause license", "bsd 3-clause", "3-clause bsd license", "3-clause bsd", "bsd-3-clause", "new bsd license", "modified bsd license", "revised bsd license", "three-clause bsd license"),
    "BSD-2-Clause": ("bsd 2-clause license", "bsd 2-clause", "2-clause bsd license", "2-clause bsd", "bsd-2-clause", "simplified bsd license", "freebsd license", "two-clause bsd license"),
    "BSD": ("bsd license", "license bsd", "bsd-style license"),
    "MPL-2.0": ("mozilla public license v2.0", "mozilla public license 2.0", "mozilla public license v. 2.0", "mpl-2.0", "mpl 2.0"),
    "MPL-1.1": ("mozilla public license v1.1", "mozilla public license 1.1", "mpl-1.1", "mpl 1.1"),
    "EPL-2.0": ("eclipse public license v2.0", "eclipse public license 2.0", "eclipse public license - v 2.0", "eclipse public license - v2.0", "epl-2.0"),
    "EPL-1.0": ("eclipse public license v1.0", "eclipse public license 1.0", "eclipse public license - v 1.0", "eclipse public license - v1.0", "epl-1.0"),
    "CC0-1.0": ("cc0 1.0 universal", "cc0 1.0", "cc0-1.0", "creative commons zero v1.0", "dedicated to public domain"),
}

# Rules that build names: families with versions; what follows a name and means "or later".
_GNU = (("GPL", "general", ("1", "2", "3")), ("LGPL", "lesser general", ("2.1", "3")), ("LGPL", "library general", ("2",)), ("AGPL", "affero general", ("3",)))
LATER = r"(?:\+| or at your option any later version| or any later version| or later| or newer)"
_CC = (("BY", "attribution"), ("BY-SA", "attribution-sharealike"), ("BY-NC", "attribution-noncommercial"), ("BY-ND", "attribution-noderivatives"), ("BY-NC-SA", "attribution-noncommercial-sharealike"), ("BY-NC-ND", "attribution-noncommercial-noderivatives"))
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _names() -> dict[str, str]:
    """name as normalised -> licence."""
    out = {n: k for k, names in _PLAIN.items() for n in names}
    for short, word, versions in _GNU:
        full, low = f"gnu {word} public license", short.lower()
        out[full] = out[f"gnu {low}"] = out[f"{low} license"] = short
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            for w in {v, v if "." in v else f"{v}.0"}:
                for base in (f"{full} v{w}", f"{full} {w}", f"{full} as published by free software foundation either v{w} of license", f"{full} as published by free software foundation v{w} of license", f"{full} as published by free software foundation v{w}", f"{full} either v{w} of license", f"{full} either v{w}", f"v{w} of {full}", f"gnu {low} v{w}", f"{low} v{w}", f"{low}v{w}", f"{low} {w}", f"{low}-{w}"):
                    out[base] = name
            out[f"{name.lower()}-or-later"], out[f"{name.lower()}-only"] = f"{name}-or-later", f"{name}-only"
    for code, word in _CC:
        for v in _CC_VERSIONS:
            for base in (f"cc {code.lower()} {v}", f"cc-{code.lower()}-{v}", f"cc-{code.lower()} {v}", f"creative commons {word} {v}", f"creative commons {word} v{v}", f"creative commons {word} license v{v}", f"creative commons {word} {v} international", f"creative commons {word} {v} unported"):
                out[base] = f"CC-{code}-{v}"
    return out


NAMES = _names()

# Known licence sentences that stand by themselves, normalised.
WHOLE = {
    "see gnu general public license for more details": "GPL_SEE",
    "see gnu lesser general public license for more details": "GPL_SEE",
    "see gnu affero general public license for more details": "GPL_SEE",
    "you should have received a copy of gnu general public license along with this program": "GPL_COPY",
    "you should have received a copy of gnu lesser general public license along with this library": "GPL_COPY",
    "you should have received a copy of gnu affero general public license along with this program": "GPL_COPY",
    "you may not use this file except in compliance with license": "APACHE2_USE",
    "this is free and unencumbered software released into public domain": "UNLICENSE_GRANT",
    "all rights reserved": "COPYRIGHT",
}

# Known licence sentences that vary.
VARYING = (
    ("APACHE2_USE", r"you may not use this file except in compliance with license"),
    ("APACHE2_COPY", r"you may obtain a copy of license at"),
    ("APACHE2_ASIS", r"unless required by applicable law or agreed to in writing"),
    ("GPL_FREE", r"you can redistribute it and or modify it under terms of gnu"),
    ("GPL_NOWARRANTY", r"distributed in hope that it will be useful but without any warranty"),
    ("MIT_GRANT", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MIT_NOTICE", r"above copyright notice and this permission notice shall be included"),
    ("ISC_GRANT", r"permission to use copy modify and or distribute this software for any purpose"),
    ("BOOST_GRANT", r"permission is hereby granted free of charge to any person or organization obtaining a copy of software"),
    ("UNLICENSE_GRANT", r"free and unencumbered software released into public domain"),
    ("ASIS", r"(software|work) is provided as.is|provided by copyright holders and contributors as.is"),
    ("BSD_REDIST", r"redistribution and use in source and binary forms"),
    ("BSD_SOURCE", r"redistributions of source code must retain"),
    ("BSD_BINARY", r"redistributions in binary form must reproduce"),
    ("BSD_ENDORSE", r"endorse or promote products derived"),
    ("NO_LIABILITY", r"in no event shall .* be liable"),
    ("COPYRIGHT", r"copyright (c )?[0-9]{4}|all rights reserved"),
)

_TEXT_RULES = (
    ("Apache-2.0", r"(Apache-2\.0;)(APACHE2_USE;)?(APACHE2_COPY;)?((Apache-2\.0;)?APACHE2_ASIS;)?|APACHE2_USE;APACHE2_COPY;(Apache-2\.0;)?(APACHE2_ASIS;)?"),
    ("BSD-3-Clause", r"(BSD(-3-Clause)?;)?(COPYRIGHT;)*BSD_REDIST;BSD_SOURCE;BSD_BINARY;BSD_ENDORSE;(ASIS;)?(NO_LIABILITY;)?"),
    ("BSD-2-Clause", r"(BSD(-2-Clause)?;)?(COPYRIGHT;)*BSD_REDIST;BSD_SOURCE;BSD_BINARY;(ASIS;)?(NO_LIABILITY;)?"),
    ("MIT", r"(MIT;)(COPYRIGHT;)*MIT_GRANT;(MIT_NOTICE;)?(ASIS;)?(NO_LIABILITY;)?|MIT_GRANT;(MIT_NOTICE;)?(ASIS;)?(NO_LIABILITY;)?"),
    ("ISC", r"(ISC;)?(COPYRIGHT;)*ISC_GRANT;(ASIS;)?(NO_LIABILITY;)?"),
    ("BSL-1.0", r"(BSL-1\.0;)?BOOST_GRANT;(ASIS;)?(NO_LIABILITY;)?"),
    ("Unlicense", r"UNLICENSE_GRANT;(ASIS;)?(NO_LIABILITY;)?"),
)
LICENCES = tuple(sorted({*NAMES.values(), *(f"{n}-or-later" for n in NAMES.values() if re.search(r"GPL-[0-9.]+$", n))}, key=lambda n: (-len(n), n)))
#: Ordered rules over identifier sequences (identifiers end in ";").
RULES = (*_TEXT_RULES, *((n, (r"(GPL_FREE;)?" if "GPL" in n else "") + re.escape(n).replace(r"\-", "-") + ";" + (r"(GPL_NOWARRANTY;)?(GPL_SEE;)?(GPL_COPY;)?" if "GPL" in n else "")) for n in LICENCES))

# What denies the licence that it is followed by.
DENIED = r"(^| )(not|never|no longer|neither|nor|cannot be|isn t|aren t|wasn t|weren t) ((be|been|being|is|are|was|were|and|or|not|never|has|have|had|nor|currently|yet|made|a|an|itself) )*(released|licensed|distributed|available|published|offered|covered|governed|provided) (by|under|as)( .*?)?( but |$)"

#: An identifier of a tag, and an expression of them.
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+\-]*[A-Za-z0-9+])?"  # a full stop after it is none of it
_TERM = rf"\(*{_ID}( +(WITH|with) +{_ID})?\)*"
EXPRESSION = rf"{_TERM}( +(AND|OR|and|or) +{_TERM})*"
TAG = rf"[Ss][Pp][Dd][Xx]-[Ll]icen[sc]e-[Ii]dentifier:?[ \t]*({EXPRESSION})"
#: identifier in lower case -> licence; others keep no name.
IDENTIFIERS = {n.lower(): n for n in LICENCES} | {n.lower().removesuffix("-or-later") + "+": n for n in LICENCES if n.endswith("-or-later")}

#: Every name and sentence has one of these, and so has the text it stands in.
NEEDED = (*SPEAKS_WORDS[:6], "licens", "licenc", "gpl", "commons", "apache", "bsd", "mpl", "epl-", "bsl-", "domain", "rights reserved", "endorse", "liable", "provided", "hope that")
_CC_GATE = r"(^|[^a-z])cc[^a-z0-9]*(by|0)"

# longest first, so that a name is not cut short; words are two spaces apart, so that neighbours can match
_WRITTEN = "|".join(re.escape(n).replace(r"\ ", "  ").replace(r"\-", "-") for n in sorted(NAMES, key=lambda n: (-len(n), n)))
_WIDE_LATER = LATER.replace(" ", "  ")
NAME = f" (?:{_WRITTEN}){_WIDE_LATER}? "


def _gate(low: Column) -> Column:
    """A lower-case text holds a word that everything worth reading holds."""
    return reduce(or_, (F.contains(low, F.lit(w)) for w in NEEDED)) | low.rlike(_CC_GATE)


def _normal(s: Column) -> Column:
    s = F.regexp_replace(F.lower(s), r"[^a-z0-9.+\-]+", " ")
    s = F.regexp_replace(s, r"[.\-]+( |$)", " ")
    s = F.regexp_replace(F.concat(F.lit(" "), F.replace(s, F.lit(" "), F.lit("  ")), F.lit(" ")), r" (the|a) ", " ")
    s = F.btrim(F.regexp_replace(s, " +", " "))
    return F.regexp_replace(F.regexp_replace(s, "licence", "license"), r"(^| )(version|ver|v)[. ]+([0-9])", "$1v$3")


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def _tagged(s: Column) -> Column:
    """The licences of a sentence's tag, in order."""
    e = F.regexp_replace(F.regexp_extract(s, TAG, 1), rf" +(WITH|with) +{_ID}|[()]", "")
    return F.transform(F.split(F.lower(e), r" +(?:and|or) +"), lambda x: F.coalesce(F.element_at(_table(IDENTIFIERS), F.btrim(x)), F.lit("UNKNOWN")))


def _read(s: Column) -> Column:
    """The identifiers of a normalised sentence in text order, each once."""
    wide = F.concat(F.lit("  "), F.replace(s, F.lit(" "), F.lit("  ")), F.lit("  "))
    entry = lambda at, i, name: F.struct(at.cast("int").alias("at"), i.alias("i"), name.alias("name"))
    found = F.array_distinct(F.regexp_extract_all(wide, F.lit(NAME), F.lit(0)))
    base = F.transform(found, lambda m: F.struct(m.alias("m"), F.element_at(_table(NAMES), F.regexp_replace(F.btrim(F.replace(m, F.lit("  "), F.lit(" "))), LATER + "$", "")).alias("name")))
    later = lambda x: F.when(x["m"].rlike(_WIDE_LATER + " $") & x["name"].rlike("GPL-[0-9.]+$"), F.concat(x["name"], F.lit("-or-later"))).otherwise(x["name"])
    names = F.transform(base, lambda x: entry(F.position(x["m"], wide), F.lit(0), later(x)))
    varying = F.array(*[entry(F.regexp_instr(wide, F.lit(p.replace(" ", "  "))), F.lit(i + 1), F.lit(n)) for i, (n, p) in enumerate(VARYING)])
    every = F.array_sort(F.filter(F.concat(names, varying), lambda x: x["at"] > 0))
    return F.array_distinct(F.transform(every, lambda x: x["name"]))


def _identifiers(s: Column) -> Column:
    whole = F.element_at(_table(WHOLE), s)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(_read(s))


def _sequence(text: Column, across: bool) -> Column:
    flat = F.regexp_replace(text, r":[ \t\r]*\n", ":\n\n")
    flat = F.regexp_replace(F.regexp_replace(flat, r"([^\n])[ \t\r]*\n[ \t\r]*([^\s])", "$1 $2"), r"[ \t\r]*\n[ \t\r]*", "\n") if across else flat
    cut = F.filter(F.split(F.regexp_replace(flat, r"([.!?;])[ \t\r]+", "$1\n"), "\n"), lambda s: _gate(F.lower(s)))
    # normalised once: what a lambda is given is a value, not an expression
    read = F.transform(cut, lambda s: F.struct(s.rlike(SPEAKS).alias("speaks"), F.when(s.rlike(TAG), _tagged(s)).alias("tag"), F.btrim(F.regexp_replace(_normal(s), DENIED, " ")).alias("s")))
    named = F.transform(read, lambda x: F.struct(x["speaks"].alias("speaks"), F.coalesce(x["tag"], _identifiers(x["s"])).alias("ids")))
    named = F.transform(named, lambda x: F.when((F.size(x["ids"]) == 0) & x["speaks"], F.array(F.lit("UNKNOWN"))).otherwise(x["ids"]))
    return F.array_join(F.transform(F.flatten(named), lambda n: F.concat(n, F.lit(";"))), "")


def licensed(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (sorted names), sentence_ids of both readings and
    n_unknown (sentences that speak of licences but are not known)."""
    # a text that says nothing about licences is read no further
    rows = docs.select("doc_id", F.when(_gate(F.lower("text")), F.col("text")).alias("t"))
    rows = rows.select("doc_id", *[F.when(F.col("t").isNull(), F.lit("")).otherwise(_sequence(F.col("t"), a)).alias(n) for n, a in (("by_line", False), ("across", True))])
    # rules in turn over the value of one array: (what is left of both readings, names found)
    start = F.struct(F.regexp_replace("by_line", "UNKNOWN;", "").alias("a"), F.regexp_replace("across", "UNKNOWN;", "").alias("b"), F.array().cast("array<string>").alias("f"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f"(^|;)({p})").alias("p")) for n, p in RULES])
    hit = lambda s, r: F.regexp_like(s, r["p"])
    step = lambda s, r: F.when(hit(s["a"], r) | hit(s["b"], r), F.struct(F.regexp_replace(s["a"], r["p"], F.lit("$1")).alias("a"), F.regexp_replace(s["b"], r["p"], F.lit("$1")).alias("b"), F.array_append(s["f"], r["name"]).alias("f"))).otherwise(s)
    none = F.array().cast("array<string>")
    names = F.when((F.col("by_line") == "") & (F.col("across") == ""), none).otherwise(F.array_sort(F.array_distinct(F.aggregate(rules, start, step)["f"])))
    unknown = F.regexp_count("by_line", F.lit("UNKNOWN;"))
    return rows.select("doc_id", names.alias("licenses"), "by_line", "across", unknown.cast("long").alias("n_unknown"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licensed(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"), F.col("by_line").alias("sentence_ids"), "n_unknown")


def _sql_table(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in entries.items()) + "}"


def _sql_sequence(flat: str) -> str:
    gate = " OR ".join(f"contains(lower(s), '{w}')" for w in NEEDED) + f" OR regexp_matches(lower(s), '{_CC_GATE}')"
    cut = rf"list_filter(string_split(regexp_replace({flat}, '([.!?;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), lambda s: {gate})"
    n = r"regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+\-]+', ' ', 'g'), '[.\-]+( |$)', ' ', 'g')"
    n = rf"trim(regexp_replace(regexp_replace(' ' || replace({n}, ' ', '  ') || ' ', ' (the|a) ', ' ', 'g'), ' +', ' ', 'g'))"
    n = rf"regexp_replace(replace({n}, 'licence', 'license'), '(^| )(version|ver|v)[. ]+([0-9])', '\1v\3', 'g')"
    tag = rf"list_transform(regexp_split_to_array(lower(regexp_replace(regexp_extract(s, '{TAG}', 1), ' +(WITH|with) +{_ID}|[()]', '', 'g')), ' +(?:and|or) +'), lambda k: coalesce(identifiers[trim(k)], 'UNKNOWN'))"
    read = f"list_transform({cut}, lambda s: {{'speaks': regexp_matches(s, '{SPEAKS}'), 'tag': CASE WHEN regexp_matches(s, '{TAG}') THEN {tag} END, 's': trim(regexp_replace({n}, '{DENIED}', ' ', 'g'))}})"
    wide = "'  ' || replace(y.s, ' ', '  ') || '  '"
    name = f"names[regexp_replace(trim(replace(m, '  ', ' ')), '{LATER}$', '')]"
    name = f"{name} || CASE WHEN regexp_matches(m, '{_WIDE_LATER} $') AND regexp_matches({name}, 'GPL-[0-9.]+$') THEN '-or-later' ELSE '' END"
    names = f"list_transform(list_distinct(regexp_extract_all({wide}, '{NAME}')), lambda m: {{'at': strpos({wide}, m), 'i': 0, 'name': {name}}})"
    varying = ", ".join(f"{{'at': CASE WHEN regexp_matches({wide}, '{p}') THEN strpos({wide}, regexp_extract({wide}, '{p}')) ELSE 0 END, 'i': {i + 1}, 'name': '{n}'}}" for i, (n, p) in enumerate((n, p.replace(" ", "  ")) for n, p in VARYING))
    ordered = f"list_transform(list_sort(list_filter(list_concat({names}, [{varying}]), lambda x: x.at > 0)), lambda x: x.name)"
    once = f"list_transform([{ordered}], lambda o: list_filter(o, lambda v, i: list_position(o, v) = i))[1]"
    ids = f"coalesce(y.tag, CASE WHEN whole[y.s] IS NOT NULL THEN [whole[y.s]] ELSE {once} END)"
    named = f"list_transform(list_transform({read}, lambda y: {{'speaks': y.speaks, 'ids': {ids}}}), lambda y: CASE WHEN len(y.ids) = 0 AND y.speaks THEN 'UNKNOWN;' ELSE array_to_string(list_transform(y.ids, lambda k: k || ';'), '') END)"
    return f"array_to_string({named}, '')"


def _sql() -> str:
    broken = r"regexp_replace(t, ':[ \t\r]*\n', ':' || chr(10) || chr(10), 'g')"
    across = rf"regexp_replace(regexp_replace({broken}, '([^\n])[ \t\r]*\n[ \t\r]*([^\s])', '\1 \2', 'g'), '[ \t\r]*\n[ \t\r]*', chr(10), 'g')"
    sql = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_sql_table(NAMES)} AS names, {_sql_table(WHOLE)} AS whole, {_sql_table(IDENTIFIERS)} AS identifiers FROM documents),
q AS (SELECT doc_id, {_sql_sequence(broken)} AS by_line, {_sql_sequence(across)} AS across FROM d),
n0 AS (SELECT doc_id, by_line, replace(by_line, 'UNKNOWN;', '') AS a, replace(across, 'UNKNOWN;', '') AS b, []::VARCHAR[] AS f FROM q)"""
    for i, (name, p) in enumerate(RULES):
        w = f"(^|;)({p})"
        sql += rf""",
n{i + 1} AS MATERIALIZED (SELECT doc_id, by_line, regexp_replace(a, '{w}', '\1', 'g') AS a, regexp_replace(b, '{w}', '\1', 'g') AS b,
  CASE WHEN regexp_matches(a, '{w}') OR regexp_matches(b, '{w}') THEN list_append(f, '{name}') ELSE f END AS f FROM n{i})"""
    return sql + f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(f)), ',') AS licenses, len(list_distinct(f))::BIGINT AS n_licenses, by_line AS sentence_ids,
  (length(by_line) - length(replace(by_line, 'UNKNOWN;', ''))) // 8 AS n_unknown FROM n{len(RULES)}"""


OP10_SQL = _sql()

"""Licence scans by sentence rules: known sentences in a known order make a licence.

A text is normalised: lower case, all ASCII punctuation and typographic quotation marks are blanks, runs of
blanks one blank, lines trimmed; so comment signs, list marks and indents go. Its pieces end at line ends and at full
stops, exclamation and question marks that white space follows. A sentence may be wrapped: it is a run of whole pieces
with only line ends between them, no full stop and no empty line. Sentences that a rule knows become identifiers, the
longest first, then the next after its end. The identifiers of a document, in order and with gaps for all
other sentences removed, are matched against the ordered rules: a rule matches where its identifiers follow
one another. Of matches that overlap the longest wins, then the first rule; so a long text is not reported
again as its own short form.

Everything is built-in array and string functions in one projection of the scan: no join, no shuffle. All
steps are linear in the text.

Nulls and ties: a null or empty text has no matches; a null id is kept; repeated rows are scanned each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentence, identifier. Sentences of public licence texts and notices, each up to its full stop.
SENTENCES = {
    "this work is licensed under the gnu general public license, version 3": "gpl3-notice",
    "licensed under cc by-nc 4.0": "cc-by-nc-notice",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "licensed under the apache license, version 2.0": "apache2-notice",
    "licensed under the apache license, version 2.0 (the license)": "apache2-head",
    "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license": "apache2-use",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at http://www.apache.org/licenses/LICENSE-2.0": "apache2-copy",
    "you may obtain a copy of the license at https://www.apache.org/licenses/LICENSE-2.0": "apache2-copy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied": "apache2-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit-grant",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-notice-kept",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice-kept",
    "the above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the software": "mit-notice-kept",
    "the software is provided as is, without warranty of any kind": "as-is",
    "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "as-is",
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "mit-no-liability",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd-permit",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "either version 3 of the license, or (at your option) any later version": "gpl3-later",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "gpl3-grant",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-no-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version": "lgpl21-grant",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "lgpl3-grant",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "agpl3-grant",
    "this source code form is subject to the terms of the mozilla public license, v": "mpl-terms",
    "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/MPL/2.0/": "mpl2-copy",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "unlicense-free",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "cc-by-nc-4-notice",
    "gnu general public license": "gpl-title",
    "gnu library general public license": "lgpl2-title",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "gnu free documentation license": "gfdl-title",
    "version 1, february 1989": "february-1989",
    "version 2, june 1991": "june-1991",
    "version 2.1, february 1999": "february-1999",
    "version 3, 29 june 2007": "june-2007",
    "version 3, 19 november 2007": "november-2007",
    "version 1.2, november 2002": "november-2002",
    "version 1.3, 3 november 2008": "november-2008",
    "mozilla public license version 1.1": "mpl11-title",
    "mozilla public license version 2.0": "mpl2-title",
    "the \"artistic license\"": "artistic-title",
    "the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the package in a more-or-less customary fashion, plus the right to make reasonable modifications": "artistic-intent",
    "creative commons legal code": "cc-title",
    "cc0 1.0 universal": "cc0-title",
}
#: Beginning and middle of sentences that name a holder between them, and what they are. Up to GAP signs, wrapped or with a
#: full stop as of a company's name, lie between the two, and the sentence's end is free.
HOLDERS = (
    ("neither the name", "be used to endorse or promote products derived", "bsd-names"),
    ("the name", "not be used to endorse or promote products derived", "bsd-names"),
)
GAP = 240
#: Fixed values, in order: rule, licence, identifiers.
RULES = (
    ("apache-2.0-header", "Apache-2.0", ("apache2-head", "apache2-use", "apache2-copy")),
    ("apache-2.0-header-full", "Apache-2.0", ("apache2-use", "apache2-copy", "apache2-as-is", "apache2-see")),
    ("apache-2.0-header-short", "Apache-2.0", ("apache2-use", "apache2-copy")),
    ("mit-full", "MIT", ("mit-grant", "mit-notice-kept", "as-is", "mit-no-liability")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice-kept", "as-is")),
    ("mit-grant-as-is", "MIT", ("mit-grant", "as-is")),
    ("isc", "ISC", ("isc-grant", "isc-as-is")),
    ("0bsd", "0BSD", ("0bsd-grant", "isc-as-is")),
    ("bsd-4-text", "BSD-4-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
    ("bsd-4-clauses", "BSD-4-Clause", ("bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
    ("bsd-4-short", "BSD-4-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-advert")),
    ("bsd-3-text", "BSD-3-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-3-source", "BSD-Source-Code", ("bsd-permit", "bsd-source", "bsd-names")),
    ("bsd-3-clauses", "BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-2-text", "BSD-2-Clause", ("bsd-permit", "bsd-source", "bsd-binary")),
    ("bsd-2-clauses", "BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("gpl-3-or-later", "GPL-3.0-or-later", ("gpl-grant", "gpl3-later")),
    ("gpl-3-header", "GPL-3.0-or-later", ("gpl3-grant", "gnu-no-warranty", "gpl-see")),
    ("gpl-3-grant", "GPL-3.0-or-later", ("gpl3-grant",)),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl2-grant", "gnu-no-warranty", "gpl-see")),
    ("gpl-2-grant", "GPL-2.0-or-later", ("gpl2-grant",)),
    ("lgpl-2.1-grant", "LGPL-2.1-or-later", ("lgpl21-grant",)),
    ("lgpl-3-grant", "LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("agpl-3-grant", "AGPL-3.0-or-later", ("agpl3-grant",)),
    ("mpl-2-header", "MPL-2.0", ("mpl-terms", "mpl2-copy")),
    ("unlicense", "Unlicense", ("unlicense-head", "unlicense-free")),
    ("gpl-3-notice", "GPL-3.0", ("gpl3-notice",)),
    ("cc-by-nc-4-notice", "CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("cc-by-nc-4-work", "CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("cc-by-4-work", "CC-BY-4.0", ("cc-by-4-notice",)),
    ("cc-by-sa-4-work", "CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("gpl-1-whole", "GPL-1.0", ("gpl-title", "february-1989")),
    ("gpl-2-whole", "GPL-2.0", ("gpl-title", "june-1991")),
    ("gpl-3-whole", "GPL-3.0", ("gpl-title", "june-2007")),
    ("lgpl-2-whole", "LGPL-2.0", ("lgpl2-title", "june-1991")),
    ("lgpl-2.1-whole", "LGPL-2.1", ("lgpl-title", "february-1999")),
    ("lgpl-3-whole", "LGPL-3.0", ("lgpl-title", "june-2007")),
    ("agpl-3-whole", "AGPL-3.0", ("agpl-title", "november-2007")),
    ("gfdl-1.2-whole", "GFDL-1.2", ("gfdl-title", "november-2002")),
    ("gfdl-1.3-whole", "GFDL-1.3", ("gfdl-title", "november-2008")),
    ("mpl-1.1-whole", "MPL-1.1", ("mpl11-title",)),
    ("mpl-2-whole", "MPL-2.0", ("mpl2-title",)),
    ("artistic-whole", "Artistic-1.0", ("artistic-title", "artistic-intent")),
    ("cc0-whole", "CC0-1.0", ("cc-title", "cc0-title")),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("apache-2-notice", "Apache-2.0", ("apache2-notice",)),
)

#: Blanks: white space but line ends, ASCII punctuation, typographic quotation marks.
SIGNS = "\\t\\r!-/:-@\\[-`{-~“”‘’"
BLANKS = f"[ {SIGNS}]+"
#: Steps of a normalisation, in order: pattern or text, replacement. Single spaces are left alone, as most are. A line end
#: becomes two, a sentence's end or empty lines become a line of one full stop, so every piece has line ends of its own
#: on both sides.
STEPS = (
    ("pattern", "[.!?][\"')\\]”’]?[\"')\\]”’]?[ \\t\\r\\n]", "\n\n"),
    ("pattern", f"[{SIGNS}]{BLANKS[:-1]}*| {BLANKS}", " "),
    ("text", " \n", "\n"),
    ("text", "\n ", "\n"),
    ("text", "\n", "\n\n"),
    ("pattern", "\\n{4,}", "\n.\n"),
)


def normalised_text(sentence: str) -> str:
    """A known sentence, normalised."""
    return re.sub(BLANKS, " ", sentence.lower()).strip()


def sentence_pattern(known: dict[str, str]) -> str:
    """All known sentences, wrapped or not, the longest first, then those that name a holder; a sentence lies between line ends."""
    words = sorted(map(normalised_text, known), key=lambda s: (-len(s), s))
    wrapped = lambda s: "(?: |\\n\\n)".join(map(re.escape, s.split(" ")))
    named = [f"{wrapped(begin)}(?s:.{{0,{GAP}}}?){wrapped(middle)}[^\\n]*" for begin, middle, _ in HOLDERS]
    return "\\n(" + "|".join([*map(wrapped, words), *named]) + ")\\n"


def holder_of(sentence: Column) -> Column:
    """What a sentence with a holder's name is; the first beginning that fits."""
    return F.coalesce(*[F.when(F.startswith(F.regexp_replace(sentence, "\\n\\n", " "), F.lit(begin)), name) for begin, _, name in HOLDERS])


def best_at(rules) -> Column:
    """For each place of identifiers the longest rule that matches there, then the first; null where none does."""
    ranked = sorted(enumerate(rules), key=lambda x: (-len(x[1][2]), x[0]))

    def at(i: Column) -> Column:
        return F.coalesce(*[
            F.when(
                F.slice("identifiers", i + 1, len(ids)) == F.array(*map(F.lit, ids)),
                F.struct(i.alias("at"), F.lit(rule).alias("rule"), F.lit(licence).alias("licence"), F.lit(len(ids)).alias("length"), F.lit(order).alias("order")),
            )
            for order, (rule, licence, ids) in ranked
        ])

    places = F.when(F.size("identifiers") > 0, F.sequence(F.lit(0), F.size("identifiers") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, at)


def beaten(m: Column, reach: int) -> Column:
    """Whether an overlapping match is longer, or as long and of an earlier rule or, of the same rule, earlier in the text."""

    def wins(o: Column) -> Column:
        overlap = (o["at"] < m["at"] + m["length"]) & (m["at"] < o["at"] + o["length"])
        return o.isNotNull() & overlap & (F.struct(-o["length"], o["order"], o["at"]) < F.struct(-m["length"], m["order"], m["at"]))

    # Matches that overlap start at most a rule's length away.
    return F.exists(F.slice("every", F.greatest(m["at"] + 1 - reach, F.lit(1)), 2 * reach + 1), wins)


def licence_matches(docs: DataFrame, known: dict[str, str] = SENTENCES, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, sentences (how many pieces that are not blank), identifiers (in order) and matches (rule, licence, at, length).

    at is the match's place among the identifiers, from 0. known and rules are small fixed lists.
    """
    names = {normalised_text(k): v for k, v in known.items()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    plain = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    for kind, what, by in STEPS:
        plain = F.replace(plain, F.lit(what), F.lit(by)) if kind == "text" else F.regexp_replace(plain, what, by)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat(F.lit("\n"), F.trim(plain), F.lit("\n")).alias("plain"))
    found = F.regexp_extract_all("plain", F.lit(sentence_pattern(known)), F.lit(1))
    rows = rows.select(
        "doc_id",
        F.size(F.filter(F.split("plain", "\n"), lambda s: (s != "") & (s != "."))).cast("long").alias("sentences"),
        F.transform(found, lambda s: F.coalesce(table[F.regexp_replace(s, "\\n\\n", " ")], holder_of(s))).alias("identifiers"),
    )
    rows = rows.withColumn("every", best_at(rules))
    reach = max(len(ids) for _, _, ids in rules)
    kept = F.filter("every", lambda m: m.isNotNull() & ~F.coalesce(beaten(m, reach), F.lit(False)))
    matches = F.transform(kept, lambda m: F.struct(m["at"].alias("at"), m["length"].alias("length"), m["rule"].alias("rule"), m["licence"].alias("licence")))
    return rows.select("doc_id", "sentences", "identifiers", matches.alias("matches"))

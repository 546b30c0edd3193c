"""Licence scan by sentence rules, in DataFrame operations only.

A text is cut into sentences (at line ends, and at white space after . ! ? ; or :), and each is normalised: lower case,
every run of other characters than letters and digits a space. Known licence sentences have numbers as identifiers; a text
becomes the sequence of them, with ~ for any other sentence. Licence rules are sequences of identifiers, tried in the given
order at each place, so a rule that stands earlier takes its sentences before a shorter one can.

Before the cut, known sentences that run over several lines, and the full sentences of genuine notices, are put on a line of
their own in their short form. The number of sentences is that of the text as it is. `sql()` has no such step: it misses
wrapped and full sentences, and agrees where a text has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier and normalised sentence.
SENTENCES = (
    (1, "this work is licensed under the gnu general public license version 3"),
    (2, "licensed under cc by nc 4 0"),
    (3, "licensed under the apache license version 2 0"),
    (4, "released under the mit license"),
    (5, "all rights reserved"),
    (6, "licensed under the mit license"),
    (7, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (8, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (9, "the software is provided as is without warranty of any kind express or implied"),
    (10, "redistribution and use in source and binary forms with or without modification are permitted"),
    (11, "redistributions of source code must retain the above copyright notice"),
    (12, "redistributions in binary form must reproduce the above copyright notice"),
    (13, "this program is free software"),
    (14, "you can redistribute it and or modify it under the terms of the gnu general public license"),
    (15, "you may not use this file except in compliance with the license"),
    (16, "you may obtain a copy of the license at"),
    (17, "this work is licensed under a creative commons attribution 4 0 international license"),
    (18, "licensed under cc by 4 0"),
    (19, "licensed under cc by sa 4 0"),
    (20, "this work is dedicated to the public domain"),
    (21, "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (22, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (23, "this source code form is subject to the terms of the mozilla public license v"),
    (24, "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    (25, "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (26, "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    (27, "either version 2 of the license or at your option any later version"),
    (28, "either version 2 1 of the license or at your option any later version"),
    (29, "either version 3 of the license or at your option any later version"),
    (30, "this is free and unencumbered software released into the public domain"),
    (31, "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    (32, "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    (33, "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    (34, "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    (35, "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    (36, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (37, "this software is provided as is without any express or implied warranty"),
    (38, "in no event will the authors be held liable for any damages arising from the use of this software"),
    (39, "licensed under cc by nd 4 0"),
    (40, "you can redistribute it and or modify it under the terms of the gnu general public license version 3"),
    (41, "you can redistribute it and or modify it under the terms of the gnu lesser general public license version 3"),
    (42, "the author disclaims copyright to this source code"),
)
#: Rules in order: the licence's name and the sentences, in a row.
RULES = (
    ("MIT", (7, 8, 9)),
    ("MIT", (7, 8)),
    ("BSD-3-Clause", (10, 11, 12, 21)),
    ("BSD-2-Clause", (10, 11, 12)),
    ("Apache-2.0", (3, 15, 16)),
    ("GPL-3.0", (13, 40)),
    ("GPL-2.0", (13, 14, 27)),
    ("GPL-3.0", (13, 14, 29)),
    ("LGPL-2.1", (25, 28)),
    ("LGPL-3.0", (13, 41)),
    ("LGPL-3.0", (25, 29)),
    ("AGPL-3.0", (13, 26)),
    ("GPL-2.0", (14, 27)),
    ("GPL-3.0", (14, 29)),
    ("MPL-2.0", (23, 24)),
    ("Zlib", (37, 38)),
    ("Apache-2.0", (3, 15)),
    ("MIT", (7,)),
    ("BSD-2-Clause", (10,)),
    ("ISC", (22,)),
    ("BSL-1.0", (36,)),
    ("MPL-2.0", (23,)),
    ("LGPL-3.0", (41,)),
    ("LGPL", (25,)),
    ("AGPL-3.0", (26,)),
    ("GPL-3.0", (40,)),
    ("GPL", (14,)),
    ("GPL-3.0", (1,)),
    ("CC-BY-NC-4.0", (2,)),
    ("Apache-2.0", (3,)),
    ("MIT", (4,)),
    ("MIT", (6,)),
    ("Unlicense", (30,)),
    ("CC-BY-4.0", (17,)),
    ("CC-BY-ND-4.0", (31,)),
    ("CC-BY-SA-4.0", (32,)),
    ("CC-BY-NC-4.0", (33,)),
    ("CC-BY-NC-SA-4.0", (34,)),
    ("CC-BY-NC-ND-4.0", (35,)),
    ("CC-BY-4.0", (18,)),
    ("CC-BY-SA-4.0", (19,)),
    ("CC-BY-ND-4.0", (39,)),
    ("CC0-1.0", (20,)),
    ("public domain", (42,)),
    ("proprietary", (5,)),
)

#: Full normalised sentences of the notices, by the identifier of the sentence that stands for them.
FULL = (
    (7, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    (9, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (10, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (11, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (12, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    (3, "licensed under the apache license version 2 0 the license"),
    (14, "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (25, "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    (40, "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (40, "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    (41, "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (26, "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    (24, "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    (36, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    (37, "this software is provided as is without any express or implied warranty"),
)
#: Sentences that stand in numbered lists.
LISTED = (11, 12, 21)

_CUT = r"\s*\n\s*|[.!?;:]+\s+"


_GAP = r"(?:(?![.!?;:]\s|\n[^\S\n]*\n)[^a-zA-Z0-9])+"


def _pattern(identifier: int, sentence: str, full: bool) -> str:
    """A known sentence in a text, over any number of lines, between the places where sentences are cut. A full one may follow other words."""
    number = r"(?:[0-9]+[.)]\s+)?" if identifier in LISTED else ""
    start = "(?<![a-zA-Z0-9])" if full else r"(?:^|(?<=\n)|(?<=[.!?;:]\s))[^a-zA-Z0-9]*"
    return rf"(?i){start}{number}{_GAP.join(sentence.split())}(?=[^a-zA-Z0-9]*?(?:\n|$|[.!?;:]\s))"


def _unwrapped(text: str) -> str:
    """SQL: the text with known sentences on lines of their own, longer ones first. Only texts that have a sentence's words in a row are searched for it."""
    short = dict(SENTENCES)
    every = sorted((*((i, s, True) for i, s in FULL), *((i, s, False) for i, s in SENTENCES)), key=lambda x: -len(x[1]))
    known = ", ".join(f"struct(' {s} ' AS words, r'{_pattern(i, s, full)}' AS pattern, '\\n{short[i]}\\n' AS line)" for i, s, full in every)
    flat = f"concat(' ', regexp_replace(lower({text}), '[^a-z0-9]+', ' '), ' ')"
    found = f"filter(array({known}), s -> contains(flat, s.words))"
    return f"aggregate(transform(array({flat}), flat -> {found})[0], {text}, (done, s) -> regexp_replace(done, s.pattern, s.line))"


def _mark(identifier: int) -> str:
    return f",{identifier},"


def _known() -> str:
    """SQL: what stands for a normalised sentence."""
    return "CASE s " + " ".join(f"WHEN '{s}' THEN '{_mark(i)}'" for i, s in SENTENCES) + " ELSE '~' END"


def _rules() -> tuple[str, str]:
    """A pattern for the rules' sequences, in their order, and SQL for the licence of a matched one."""
    sequences = [("".join(map(_mark, ids)), name) for name, ids in RULES]
    return "|".join(s for s, _ in sequences), "CASE m " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in sequences) + " END"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, matches, licences), one row per row of docs, without a shuffle.

    sentence_ids: the identifiers of the known sentences, in order. matches: array of the licence of each matched rule, in
    order. licences: the different ones, sorted. A null or empty text has no sentence, one of any length is scanned as a
    whole; other columns are ignored, null and repeated ids are rows like others; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = lambda text: F.expr(f"filter(split({text}, r'{_CUT}'), x -> x rlike '[a-zA-Z0-9]')")
    marks = F.expr(f"array_join(transform(transform(_sentences, x -> trim(regexp_replace(lower(x), '[^a-z0-9]+', ' '))), s -> {_known()}), '')")
    pattern, name = _rules()
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text")).withColumn("_lines", F.expr(_unwrapped("_text")))
    out = out.select("doc_id", F.size(cut("_text")).cast("long").alias("n_sentences"), cut("_lines").alias("_sentences")).select("doc_id", "n_sentences", marks.alias("_marks"))
    matched = F.expr(f"transform(regexp_extract_all(_marks, '({pattern})', 1), m -> {name})")
    ids = F.expr("transform(regexp_extract_all(_marks, '([0-9]+)', 1), x -> cast(x AS int))")
    out = out.select("doc_id", "n_sentences", ids.alias("sentence_ids"), matched.alias("matches"))
    return out.withColumn("licences", F.array_sort(F.array_distinct("matches")))


def digest(scanned: DataFrame) -> DataFrame:
    """Flat columns of the scan: identifiers and licences joined by commas."""
    return scanned.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("matches").cast("long").alias("n_matches"), F.array_join("licences", ",").alias("licences"))


def sql() -> str:
    """The digest for DuckDB."""
    pattern, name = _rules()
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s*\\n\\s*|[.!?;:]+\\s+'), lambda x: regexp_matches(x, '[a-zA-Z0-9]')) AS sentences FROM documents
), marked AS (
  SELECT doc_id, len(sentences)::BIGINT AS n_sentences,
    coalesce(list_aggregate(list_transform(list_transform(sentences, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda s: {_known()}), 'string_agg', ''), '') AS marks FROM cut
), matched AS (
  SELECT *, list_transform(regexp_extract_all(marks, '({pattern})', 1), lambda m: {name}) AS matches FROM marked
)
SELECT doc_id, n_sentences, array_to_string(regexp_extract_all(marks, '[0-9]+'), ',') AS sentence_ids, len(matches)::BIGINT AS n_matches, array_to_string(list_sort(list_distinct(matches)), ',') AS licences FROM matched
"""

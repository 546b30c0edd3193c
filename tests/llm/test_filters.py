"""Quality, language, licences, URLs against brute force, planted cases and held-out accuracy."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm import language, licences, quality, urls


def test_quality_counts():
    rng = random.Random(2)
    for _ in range(300):
        own = [rng.choice("ab cd e* || É\n \n\n \t").strip(" ") or "x" for _ in range(rng.randint(0, 40))]
        text = rng.choice([" ", "\n", " \n"]).join(own)
        got = quality.judge(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = set()
        for i in range(len(words) - 2):
            if triples[tuple(words[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
        assert got["n_repeat_words"] == len(covered)
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
        assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))


PROSE = "The committee met on Tuesday to discuss the budget, and the roof.\n" + "\n".join(f"Line{i} tells of thing{i}, item{i} and place{i}." for i in range(20))


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("Home | About | Contact | News", "navigation"),
        ("word### other$$$ third%%%", "symbols"),
        ("BUY NOW!! BEST PRICE!! ONLY TODAY!! HURRY UP!!", "shouting"),
        ("Please accept all cookies", "boilerplate"),
        ("----------", "punctuation"),
        ("one two three four five six seven eight", "punctuation"),
        ("A normal sentence, with an end.", None),
        ("Short heading", None),
        ("NASA AND ESA AGREE ON MARS", None),
        ("see a/b | c for all the rest of it.", None),
        ("एक दो तीन चार पाँच छह सात आठ।", None),
        ("ایک دو تین چار پانچ چھ سات آٹھ۔", None),
        ("一 二 三 四 五 六 七 八。", None),
        ("एक दो तीन चार पाँच छह सात आठ", "punctuation"),
        ("КУПИ СЕЙЧАС!! ЛУЧШАЯ ЦЕНА!! ТОЛЬКО СЕГОДНЯ!!", "shouting"),
        ("Tous droits réservés", "boilerplate"),
        ("Zum Inhalt springen", "boilerplate"),
    ],
)
def test_lines(line, rule):
    assert quality.bad_line(line.split()) == rule


def test_quality_verdicts(spark):
    nav = "\n".join(f"item{i} | thing{i} | other{i} | more{i}" for i in range(30))
    texts = [None, "", "few words here", PROSE, nav, PROSE + "\nHome | About | News", "w " * 400]
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept boolean")
    assert [r.kept for r in quality.quality(docs).orderBy("doc_id").collect()] == [False, False, False, True, False, True, False]
    cleaned = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert cleaned == {3: PROSE, 5: PROSE}
    assert quality.quality(docs.limit(0)).count() == 0


def test_long_text_is_judged():
    assert quality.judge(" ".join(f"w{i}." for i in range(300_000)))["n_repeat_words"] == 0


def texts_of(rng, lang, n):
    parts = {"aa": ["ing", "the", "tion", "er"], "bb": ["schen", "ung", "ei", "der"], "cc": ["eau", "que", "é", "ment"]}[lang]
    return [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 40))) for _ in range(n)]


def test_language(spark):
    rng = random.Random(4)
    rows = [(t, lang) for lang in ("aa", "bb", "cc") for t in texts_of(rng, lang, 60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, lang, "s", 0.5) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, score double")
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", language.held_out())
    held = found.where("held").collect()
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 < r.score <= 1 for r in held)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the thing", "aa"), (2, "der ung", "bb"), (3, None, "aa"), (4, "text", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["aa", "bb"]
    for text in (None, "", "12 34!", " \n"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("thing")[0] == "aa" and model.predict("ungder")[0] == "bb"
    assert model.predict("the " * 200_000)[0] == "aa"
    empty = language.fit(docs.limit(0))
    assert empty.predict("the") == ("und", 0.0)
    assert language.identify(docs, empty).where("lang_pred = 'und'").count() == 4


def plain_model(rows):
    """Log frequencies by plain counting; words and n-grams of all languages, none left out."""
    import math

    letters = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    counts = {}
    for text, lang in rows:
        for w in letters(text):
            for k in range(5):
                for g in [w] if k == 0 else [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)] if k > 1 else list(w):
                    counts.setdefault(k, {}).setdefault(g, Counter())[lang] += 1
    languages = sorted({lang for t, lang in rows if letters(t)})
    sums = {k: Counter() for k in range(5)}
    for k, own in counts.items():
        for c in own.values():
            sums[k].update(c)

    def log(k, g):
        return [math.log((counts[k][g][x] + 0.5) / (sums[k][x] + 0.5 * len(counts[k]))) for x in languages]

    def of_word(w):
        if w in counts[0]:
            return log(0, w)
        for k in range(4, 0, -1):
            own = [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)] if k > 1 else list(w)
            found = [log(k, g) for g in own if g in counts[k]]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(languages)

    def predict(text):
        found = letters(text)
        if not found:
            return "und", 0.0
        total = [sum(x) for x in zip(*map(of_word, found), strict=True)]
        scaled = [t / len(found) * min(len(found), 20) for t in total]
        best = total.index(max(total))
        return languages[best], 1 / sum(math.exp(x - scaled[best]) for x in scaled)

    return predict


def test_language_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(t, lang) for lang in ("aa", "bb", "cc") for t in texts_of(rng, lang, 20)]
    rows += [("the² Ⅷ x1y", "aa"), (None, "bb"), ("12", "cc"), ("der the eau", "bb"), ("der the eau", None)]
    asked = [t for t, _ in rows] + ["² ½", "Ⅷ", "unger q", "日本", "thé_er 4x", "", "É" * 5000]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    plain = plain_model([(t, lang) for t, lang in rows if lang])
    found = language.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), language.fit(docs)).collect()
    for r in found:
        lang, score = plain(asked[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, asked[r.doc_id]
    assert [r.lang_pred for r in sorted(found) if r.doc_id in (len(rows), len(rows) + 1)] == ["und", "und"]


def test_keep_identified(spark):
    docs = spark.createDataFrame([(1, "the thing", "aa", 7), (2, "der ung", None, 7), (3, None, "aa", 7), (4, "² 12", "bb", 7), (2, "der ung", None, 7)], "doc_id long, text string, lang string, lang_pred int")
    model = language.fit(spark.createDataFrame([(1, "the thing the", "aa"), (2, "der ung der", "bb")], "doc_id long, text string, lang string"))
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.lang, r.lang_pred) for r in kept.collect()) == [(1, "aa", 7), (2, "bb", 7), (2, "bb", 7)]
    assert [r.doc_id for r in language.keep_identified(docs, model, languages=["aa"]).collect()] == [1]
    assert language.keep_identified(docs.limit(0), model).count() == 0
    assert language.keep_identified(docs.drop("lang"), model).count() == 3


def test_counts_of_all_languages_are_kept(spark):
    """A word that is frequent in one language keeps its counts in the others, also where it is rare there."""
    docs = spark.createDataFrame([(1, "a a a b b c", "x"), (2, "b b b c c a", "y")], "doc_id long, text string, lang string")
    model = language.fit(docs, max_entries=2)
    assert len(model.words) == 2
    assert model.table[model.words.get("a")].tolist()[1] > -2.5  # one of six words, not none


def test_backoff():
    import numpy as np

    model = language.Model(["x", "y"], {"known": 0}, {"unkn": 1, "q": 2}, np.array([[0.0, -1.0], [-5.0, -1.0], [-1.0, -9.0]]))
    assert model.word("known").tolist() == [0, -1]
    assert model.word("unknown").tolist() == [-5, -1]  # a longer n-gram goes before a shorter one
    assert model.word("zqz").tolist() == [-1, -9]
    assert model.word("zzz").tolist() == [0, 0]


def test_training_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"), F.lit("aa").alias("lang"))
    model = language.fit(docs, max_training=300, max_entries=1)
    assert len(model.words) == 1 and len(model.ngrams) == 1


def test_rare_languages_are_learnt(spark):
    """One row in a thousand is in another language, far fewer than the bound takes of all rows."""
    rare = F.col("id") % 1000 == 7
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(rare, "zzq vvx").otherwise("a word").alias("text"), F.when(rare, "rr").when(F.col("id") == 5, "one").otherwise("aa").alias("lang"))
    model = language.fit(docs, max_training=100)
    assert model.languages == ["aa", "one", "rr"] and model.predict("zzq")[0] == "rr"
    assert [language.share(x, 10) for x in ([3, 100], [1, 2, 100], [4], [100] * 20)] == [7, 7, 4, 1]


def test_model_is_compact():
    """A model of the full size, sent to a worker, takes 12 bytes a name; names are found as in a dict."""
    import pickle

    rows = {f"name{i}é": i for i in range(language.MAX_ENTRIES)}
    names = pickle.loads(pickle.dumps(language.Names(rows)))
    assert language.MAX_ENTRIES == 200_000 and language.MAX_TRAINING == 20_000
    assert len(names) == len(rows) and all(names.get(x) == i for x, i in list(rows.items())[::97])
    assert names.get("other") is None and language.Names({}).get("") is None
    assert len(pickle.dumps(names)) < 13 * len(rows)


def test_held_out(spark):
    from zlib import crc32

    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", language.held_out()).collect()
    assert all(r.h == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_licences(spark):
    texts = [
        "Some text.\nReleased under the MIT License.\nMore. All rights reserved.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The licence is not named here.",
        None,
        "",
        "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0. You may not use this file except in compliance with the License.",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licences string")
    rows = licences.scan(docs).orderBy("doc_id").collect()
    assert [r.matches for r in rows] == [["MIT", "proprietary"], ["MIT"], [], [], [], ["Apache-2.0"]]
    assert [r.sentence_ids for r in rows] == [[4, 5], [7, 8], [], [], [], [3, 15]]
    assert rows[0].licences == ["MIT", "proprietary"] and rows[0].n_sentences == 4


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""


GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BSD3 = (
    BSD
    + """

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
)
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
LGPL = GPL.replace("program", "library").replace("the GNU General", "the GNU Lesser General")
LGPL21 = GPL2.replace("the GNU General", "the GNU Lesser General").replace("version 2 ", "version 2.1 ")
AGPL = GPL.replace("the GNU General", "the GNU Affero General")
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy."
CC_BY_ND = "This work is licensed under a Creative Commons\nAttribution-NoDerivatives 4.0 International License."
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software."""
GENUINE = {"MIT": MIT, "BSD-2-Clause": BSD, "Apache-2.0": APACHE, "GPL-3.0": GPL, "GPL-2.0": GPL2, "ISC": ISC, "BSD-3-Clause": BSD3, "MPL-2.0": MPL, "LGPL-3.0": LGPL, "LGPL-2.1": LGPL21, "AGPL-3.0": AGPL, "Unlicense": UNLICENSE, "CC-BY-ND-4.0": CC_BY_ND, "Zlib": ZLIB}


def test_genuine_licences(spark):
    """Notices as they are wrapped in files, on one line, and between other text; sentences of another paragraph aren't joined."""
    expected = {}
    for name, text in GENUINE.items():
        for own in (text, "Some prose before it.\n\n" + text + "\n\nAnd after it.", "word " * 20_000 + "\n" + text):
            expected[own] = [name]
        if "#" not in text and "*" not in text:
            expected[" ".join(text.split())] = [name]
    expected |= {"Text.\nReleased under the\nMIT License. More.": ["MIT"], "All rights\n\nreserved": [], "Released. Under the MIT license": []}
    rows = licences.scan(spark.createDataFrame(list(enumerate(expected)), "doc_id long, text string")).collect()
    texts = list(expected)
    for r in rows:
        assert r.licences == expected[texts[r.doc_id]], texts[r.doc_id][-400:]
    by_text = {texts[r.doc_id]: r.sentence_ids for r in rows}
    assert by_text[MIT] == [7, 8, 9] and by_text[BSD3] == [10, 11, 12, 21] and by_text[GPL2] == [13, 14, 27] and by_text[APACHE] == [3, 15, 16]
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_url_parts(spark):
    cases = {
        "http://A.Example.NET/en/1?q#f": ("a.example.net", "/en/1", "example.net/en/"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/"),
        "https://x.org/fr/y": ("x.org", "/fr/y", "org/fr/"),
        "https://net/": ("net", "/", "net/"),
        "https://notnet/": ("notnet", "/", None),
        "https://x.net": ("x.net", "", None),
        "https://x.net?a=/": ("x.net", "", None),
        "no scheme": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "a://b://c/d": ("b:", "//c/d", None),
        "http://ÄX.org/fr/": ("Äx.org", "/fr/", "org/fr/"),
    }
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    rows = urls.judge(pages).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in rows] == list(cases.values())
    assert all(r.verdict == ("block" if r.rule in ("net/", "example.com/de/") else "allow") for r in rows if r.rule)


def test_url_model(spark):
    """URLs without a rule are judged by those with one."""
    rng = random.Random(6)
    name = lambda parts: "".join(rng.choices(parts, k=3))
    good, bad = ["lib", "arc", "doc"], ["win", "xxx", "spm"]
    pages = [f"http://{name(good)}.org/fr/{i}" for i in range(200)] + [f"http://{name(bad)}.net/{i}" for i in range(200)]
    asked = [f"http://{name(good)}.com/a" for _ in range(40)] + [f"http://{name(bad)}.com/a" for _ in range(40)]
    rows = urls.judge(spark.createDataFrame(list(enumerate(pages + asked)), "page_id long, url string")).where("page_id >= 400").collect()
    right = sum((r.verdict == "allow") == (r.page_id < 440) for r in rows)
    assert right >= 72


def test_urls_without_examples(spark):
    rows = urls.judge(spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")).collect()
    assert [r.verdict for r in rows] == ["allow", "allow"]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0

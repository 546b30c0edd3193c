"""Line-first quality rules: lines are judged and removed first, then documents that lose too much text are rejected.

Rules of lines, in this order:

* navigation: separators stand between the words, or the line is a short menu phrase;
* symbols: too many of the characters # * $ % & | < > for its words;
* shouting: almost only capital letters, over several words, with marks of exclamation;
* boilerplate: known phrases of web pages, in several languages, make up most of the line;
* punctuation: a line of several words without any punctuation mark or digit, or of marks alone.

Letters, capitals, marks and digits are Unicode's, in any script.

A document is rejected if the base rule fails (under 50 words, or over half of the words in repeated windows of three),
or if the removed lines hold more than MAX_LOST of its word characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import chunks, text_rows

MIN_WORDS = 50
#: Share of a document's word characters in removed lines from which on it is rejected.
MAX_LOST = 0.3

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_CAPITAL, _LETTER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{L}")
_ASCII_MARK, _MARK = re.compile(r"[!-/:-@\[-`{-~0-9]"), regex.compile(r"[\p{P}\p{Nd}$+<=>^`|~]")

#: Words that stand between the entries of a menu.
SEPARATORS = frozenset(["|", "||", "›", "»", ">", ">>", "•", "·", "→", "/"])
#: Phrases of web pages.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here", "enable javascript", "follow us on", "log in",
    "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to our newsletter",
    "terms of service", "terms of use", "use of cookies", "we use cookies", "lorem ipsum",
    "alle cookies akzeptieren", "alle rechte vorbehalten", "nach oben", "hier klicken", "javascript aktivieren", "folgen sie uns",
    "datenschutzerklärung", "mehr lesen", "jetzt anmelden", "zum inhalt springen", "newsletter abonnieren", "nutzungsbedingungen",
    "accepter tous les cookies", "tous droits réservés", "haut de page", "cliquez ici", "activer javascript", "suivez-nous",
    "politique de confidentialité", "lire la suite", "se connecter", "aller au contenu", "abonnez-vous à notre newsletter", "mentions légales",
    "aceptar todas las cookies", "todos los derechos reservados", "volver arriba", "haga clic aquí", "activar javascript", "síguenos en",
    "política de privacidad", "leer más", "iniciar sesión", "saltar al contenido", "suscríbete a nuestro boletín", "términos de uso",
)


def bad_line(words: list[str]) -> str | None:
    """The first rule that a line of words breaks; None if it breaks none."""
    n = len(words)
    between = sum(w in SEPARATORS for w in words)
    if between >= 2 and between * 5 >= n:
        return "navigation"
    line = " ".join(words)
    characters = len(line) - n + 1
    if len(_SYMBOL.findall(line)) * 10 > characters:
        return "symbols"
    if n >= 4 and line.count("!") * 4 >= n and (letters := len(_LETTER.findall(line))) >= 12 and len(_CAPITAL.findall(line)) * 10 > letters * 7:
        return "shouting"
    lowered = line.lower() if n <= 12 else ""
    if n <= 12 and sum(len(p) for p in BOILERPLATE if p in lowered) * 2 > characters:
        return "boilerplate"
    if not _LETTER.search(line) or n >= 8 and not _ASCII_MARK.search(line) and not _MARK.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """How many words lie in a window of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    codes: dict[str, int] = {}
    at = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    pairs = at[:-2] * len(codes) + at[1:-1]
    if len(codes) >= 1 << 20:  # three codes don't fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs * len(codes) + at[2:], return_inverse=True, return_counts=True)
    often = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : len(words) - 2 + i] |= often
    return int(covered.sum())


def judge(text: str | None) -> dict:
    """All counts of a text, its lines without the failing ones, and the verdict."""
    text = text or ""
    lines = text.split("\n")
    words_of = [_WORD.findall(x) for x in lines]
    words = [w for line in words_of for w in line]
    repeated = repeated_words(words)
    seen: set[str] = set()
    duplicates = lost = removed = 0
    kept_lines = []
    characters = sum(map(len, words))
    for line, own in zip(lines, words_of, strict=True):
        if own:
            duplicates += line in seen
            seen.add(line)
            if bad_line(own):
                removed += 1
                lost += sum(map(len, own))
                continue
        kept_lines.append(line)
    failed = len(words) < MIN_WORDS or 100 * repeated > 50 * len(words)
    return {
        "n_words": len(words), "word_chars": characters, "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": duplicates, "n_repeat_words": repeated,
        "base_failed": failed, "n_bad_lines": removed, "lost_chars": lost, "kept": not failed and lost <= MAX_LOST * characters, "clean_text": "\n".join(kept_lines) if removed else text,
    }


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bad_lines long, lost_chars long, kept boolean"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts and the verdict of every row of docs, without a shuffle.

    A null or blank text has no words and fails; a text of any length is judged as a whole. Null or repeated ids are rows
    like others; other columns are ignored; an empty table gives no rows.
    """
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [judge(x) for x in batch.column("text").to_pylist()]
            arrays = [pa.array([x[n] for x in found], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    return text_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, _SCHEMA)


def clean(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The kept rows of docs, all columns, with the failing lines taken out of their texts; count_col, if there is such a column, gets the new number of characters.

    Null and blank texts go; a text of any length is judged as a whole; ids and other columns don't matter, whatever their
    names; repeated rows are judged alike; an empty table stays empty.
    """
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            found = [judge(x) for x in batch.column(text_col).to_pylist()]
            kept = batch.filter(pa.array([x["kept"] for x in found]))
            texts = [x["clean_text"] for x in found if x["kept"]]
            at = names.index(text_col)
            kept = kept.set_column(at, kept.schema.field(at), pa.array(texts, kept.schema.field(at).type))
            if count_col in names:
                at = names.index(count_col)
                kept = kept.set_column(at, kept.schema.field(at), pa.array(list(map(len, texts)), kept.schema.field(at).type))
            yield kept

    return text_rows(docs).mapInArrow(run, schema)


def sql() -> str:
    """The counts and the verdict over `documents` for DuckDB."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = " + ".join(f"CASE WHEN contains(lowered, '{p}') THEN {len(p)} ELSE 0 END" for p in BOILERPLATE)
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)
), often AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS k FROM often) GROUP BY doc_id
), cut AS (
  SELECT doc_id, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own FROM (SELECT doc_id, unnest(lines) AS line FROM split)
), counted AS (
  SELECT doc_id, len(own) AS n, len(list_filter(own, lambda x: list_contains({listed(sorted(SEPARATORS))}, x))) AS between_, array_to_string(own, ' ') AS line, lower(array_to_string(own, ' ')) AS lowered FROM cut
), measured AS (
  SELECT *, length(line) - n + 1 AS characters, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '\p{{L}}')) AS letters,
    len(regexp_extract_all(line, '!')) AS marks, len(regexp_extract_all(line, '\p{{Lu}}')) AS upper_, {phrases} AS known FROM counted
), judged AS (
  SELECT doc_id, characters, CASE WHEN between_ >= 2 AND between_ * 5 >= n THEN true WHEN symbols * 10 > characters THEN true WHEN n >= 4 AND letters >= 12 AND marks * 4 >= n AND upper_ * 10 > letters * 7 THEN true
    WHEN n <= 12 AND known * 2 > characters THEN true ELSE letters = 0 OR n >= 8 AND NOT regexp_matches(line, '[\p{{P}}\p{{Nd}}$+<=>^`|~]') END AS bad FROM measured
), lost AS (
  SELECT doc_id, count(*) FILTER (bad) AS n_bad, coalesce(sum(characters) FILTER (bad), 0) AS chars FROM judged GROUP BY doc_id
), base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(n_bad, 0)::BIGINT AS n_bad_lines, coalesce(chars, 0)::BIGINT AS lost_chars
  FROM split LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= {MAX_LOST}::DOUBLE * word_chars AS kept FROM base
"""

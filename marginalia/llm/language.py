"""Language identification by words first, then by shorter and shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. Any other word is scored by the longest
character n-grams of it that the model knows: if none of length N_GRAM is known, those one shorter are tried, and so on;
a word without any known character is no evidence.

The model is fitted on about MAX_TRAINING labelled documents: all of the rarer languages and of each other one about as many,
chosen by a hash, so every language is learnt at any size. It holds at most MAX_ENTRIES words and as many n-grams; both bounds
are parameters, so the model's size doesn't grow with the data and can be sent to every worker.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import chunks, materialise, release, text_rows, trim

#: Labelled documents to fit on, about.
MAX_TRAINING = 20_000
#: Words of all languages together in a model; as many n-grams.
MAX_ENTRIES = 200_000
#: The longest n-gram.
N_GRAM = 4
#: Words after which more evidence doesn't raise the score.
FULL_EVIDENCE = 20
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_LETTER = r"\p{L}"
_CACHE = 100_000


def words_of(text: str | None) -> Counter:
    """Counts of a text's runs of letters, lower-cased. Other numbers than digits, such as ² or Ⅷ, are no letters."""
    lowered = (text or "").lower()
    counts = Counter(_WORD.findall(lowered))
    if not lowered.isascii():
        for odd in [w for w in counts if not w.isalpha()]:
            n = counts.pop(odd)
            for part in "".join(c if c.isalpha() else " " for c in odd).split():
                counts[part] += n
    return counts


def grams(word: str, n: int) -> list[str]:
    """All character n-grams of a word between spaces; a single character stands for itself."""
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Names:
    """Names and their rows, in 12 bytes each: sorted hashes of 64 bits."""

    def __init__(self, rows: dict[str, int]) -> None:
        pairs = sorted((xxhash.xxh3_64_intdigest(name), row) for name, row in rows.items())
        self.hashes, self.rows = array("Q", (h for h, _ in pairs)), array("i", (row for _, row in pairs))

    def __len__(self) -> int:
        return len(self.rows)

    def get(self, name: str) -> int | None:
        own = xxhash.xxh3_64_intdigest(name)
        at = bisect_left(self.hashes, own)
        return self.rows[at] if at < len(self.hashes) and self.hashes[at] == own else None


@dataclass
class Model:
    """Log frequencies: `words` and `ngrams` name rows of `table`, which has a column for each language."""

    languages: list[str]
    words: Names | dict[str, int]
    ngrams: Names | dict[str, int]
    table: np.ndarray
    _index: dict[str, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None

    def word(self, word: str) -> np.ndarray:
        """Log frequencies of a word, zeros if nothing of it is known."""
        if (known := self.words.get(word)) is not None:
            return self.table[known]
        for n in range(N_GRAM, 0, -1):
            found = [at for g in grams(word, n) if (at := self.ngrams.get(g)) is not None]
            if found:
                return self.table[found].mean(axis=0)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its score between 0 and 1; (UNKNOWN, 0) for a text without letters or a model without languages."""
        counts = words_of(text)
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        if self._rows is None or len(self._index) + len(counts) > len(self._rows):
            self._index, self._rows = {}, np.zeros((max(_CACHE, 2 * len(counts)), len(self.languages)))
        at = np.fromiter((self._row(w) for w in counts), np.int64, len(counts))
        weights = np.fromiter(counts.values(), np.float64, len(counts))
        total = weights @ self._rows[at]
        n = weights.sum()
        scaled = total / n * min(n, FULL_EVIDENCE)
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(scaled - scaled[best]).sum())

    def _row(self, word: str) -> int:
        at = self._index.get(word)
        if at is None:
            at = self._index[word] = len(self._index)
            self._rows[at] = self.word(word)
        return at


#: Different words, or n-grams, that a worker counts before it hands them on.
TALLIED = 100_000


def _tallied(entries: Iterator[tuple[tuple, int]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Sums of (key, n), in parts."""
    tally: Counter = Counter()

    def out() -> pa.RecordBatch:
        columns = list(zip(*tally, strict=True)) or [()] * len(types)
        batch = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(tally.values(), pa.int64())], [*names, "n"])
        tally.clear()
        return batch

    for key, n in entries:
        tally[key] += n
        if len(tally) >= TALLIED:
            yield out()
    yield out()
    trim()


def _counts(labelled: DataFrame) -> DataFrame:
    """(lang, kind, gram, n), stored: words (kind 0) and n-grams (their length) of labelled(text, lang). N-grams are made from the different words, after these are counted."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((text, lang) for b in chunks(batches, "text") for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True))
        return _tallied((((lang, word), n) for text, lang in rows for word, n in words_of(text).items()), ["lang", "gram"], [pa.string()] * 2)

    def ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True))
        return _tallied((((lang, k, g), n) for lang, word, n in rows for k in range(1, N_GRAM + 1) for g in grams(word, k)), ["lang", "kind", "gram"], [pa.string(), pa.int32(), pa.string()])

    found = materialise(text_rows(labelled).mapInArrow(words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "words")
    parts = found.mapInArrow(ngrams, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    every = materialise(found.select("lang", F.lit(0).alias("kind"), "gram", "n").unionAll(parts), "grams")
    release(found)
    return every


def share(sizes: list[int], limit: int) -> int:
    """The largest number of rows, 1 at least, such that so many of each size, or all of it, are at most limit together."""
    left, count = limit, len(sizes)
    for n in sorted(sizes):
        if n * count > left:
            return max(1, left // count)
        left, count = left - n, count - 1
    return max(sizes, default=1)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_training: int = MAX_TRAINING, max_entries: int = MAX_ENTRIES) -> Model:
    """Fits a model on rows with a text and a language, on about max_training of them if there are more, at least one of each language. Of the words, and of the n-grams, the most frequent of each language are kept, about max_entries in all, each with its counts in all languages. Null and empty texts and null languages teach nothing; a table without any gives a model without languages."""
    usable = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    usable = usable.where(F.col("text").rlike(_LETTER)).withColumn("place", F.xxhash64("id", "lang", "text"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()
    if sum(r.n for r in sizes) > max_training:
        each = share([r.n for r in sizes], max_training)
        chosen = usable.sparkSession.createDataFrame([(r.lang, r.n, r.first) for r in sizes], "lang string, n long, first long")
        # the first of each language takes part in any case
        usable = usable.join(F.broadcast(chosen), "lang").where((F.pmod(F.col("place"), F.col("n")) < each) | (F.col("place") == F.col("first")))
    counted = _counts(usable.select("text", "lang"))
    totals = {(r.lang, r.kind): r.n for r in counted.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for lang, kind in totals})
    each = max(1, max_entries // max(1, len(languages)))
    rank = F.row_number().over(Window.partitionBy("lang", F.col("kind") == 0).orderBy(F.desc("n"), "kind", "gram"))
    names_kept = counted.withColumn("rank", rank).where(F.col("rank") <= each).select("kind", "gram").distinct()
    kept = counted.join(names_kept, ["kind", "gram"], "left_semi").select("lang", "kind", "gram", "n")
    column = {lang: i for i, lang in enumerate(languages)}
    names: tuple[dict[str, int], dict[str, int]] = ({}, {})
    places, counts = [], []
    for r in kept.toLocalIterator():
        own = names[r.kind > 0]
        places.append((own.setdefault(r.gram, len(own)), column[r.lang], r.kind > 0))
        counts.append(r.n)
    release(counted)
    words, ngrams = names
    table = np.zeros((len(words) + len(ngrams), len(languages)), np.float32)
    for (row, at, is_gram), n in zip(places, counts, strict=True):
        table[row + len(words) * is_gram, at] = n
    ngrams = {g: row + len(words) for g, row in ngrams.items()}
    for kind in range(N_GRAM + 1):
        rows = list(words.values()) if not kind else [row for g, row in ngrams.items() if len(g) == kind]
        sums = np.array([totals.get((lang, kind), 0) for lang in languages], float)
        table[rows] = np.log((table[rows] + 0.5) / (sums + 0.5 * max(1, len(rows))))
    return Model(languages, Names(words), Names(ngrams), table)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per row of docs, without a shuffle. A text that is null or has no letter is `und` with score 0; a text of any length is scored as a whole. Null and repeated ids are rows like others, other columns are ignored, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches, "text"):
            found = [own.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return text_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept out of training: the CRC-32 of its id as text leaves 2 when divided by 4. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang", min_score: float = 0.5, languages: Collection[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text is in one of the languages (all of the model's by default) with at least min_score.

    lang_col: a column whose nulls get the language found, if docs has it; None for none. Null texts and texts without
    letters go; ids and other columns don't matter; repeated rows are judged alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    named = lang_col if lang_col in names and docs.schema[lang_col].dataType.simpleString() == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches, text_col):
            found = [own.predict(x) for x in batch.column(text_col).to_pylist()]
            keep = [lang != UNKNOWN and score >= min_score and (languages is None or lang in languages) for lang, score in found]
            if named is not None:
                at = names.index(named)
                filled = pc.coalesce(batch.column(at), pa.array([lang for lang, _ in found], batch.schema.field(at).type))
                batch = pa.RecordBatch.from_arrays([filled if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return text_rows(docs).mapInArrow(run, docs.schema)

"""Quality rules: counts of words, symbols and repetition, and divergence from language references.

A document's histograms of character classes and of common words are compared with references
of the languages by Jensen-Shannon distance (base 2, 0 to 1); the nearest reference counts.  The
common words of a language are the most frequent ones of all its documents, and a reference is the
sum of the histograms of all of them.  Texts too short for a
histogram are guarded: that comparison is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.arrays import SPACE, U64, mix, prefix_hash, runs, shingles, slices, span_hash, sum_by, utf8, words
from engram.llm.tables import discard, stage

#: Words of each language in the histogram, and the least share of its words that one of them has.
COMMON, MIN_SHARE = 32, 0.001
#: Common words of some languages, for other operators; fixed values.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as be by this are from or have an at not but they his her you which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son elle",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
SYMBOLS = b"#*$%&|<>"
#: Character classes in the order of the histogram: a code point counts by its first byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "symbol", "other", "beyond_ascii")
_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _CLASS[0x0A] = 3, 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[list(SYMBOLS)] = 6
_CLASS[128:] = 8
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: A histogram of characters needs so many bytes, one of words so many words.
    min_bytes: int = 40
    min_common: int = 60
    #: Far by characters alone, or a little by characters and clearly by words.
    max_class_distance: float = 0.25
    near_class_distance: float = 0.12
    max_word_distance: float = 0.33


def common_hashes() -> np.ndarray:
    """Sorted hashes of the common words."""
    listed = sorted({w for v in COMMON_WORDS.values() for w in v.split()})
    data, offs = utf8(pa.array(listed, pa.large_string()))
    s, e, _ = words(data, offs)
    return np.sort(span_hash(prefix_hash(data, lower=True), s, e))


def histograms(data: np.ndarray, offs: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (the last: all other words) by text."""
    texts = len(offs) - 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.repeat(np.arange(texts), np.diff(offs))
    k = len(CLASSES)
    classes = np.bincount(doc[lead] * k + _CLASS[data[lead]], minlength=texts * k).reshape(texts, k)
    s, e, d = words(data, offs)
    h = span_hash(prefix_hash(data, lower=True), s, e)
    at = np.searchsorted(common, h)
    which = np.where(np.append(common, U64(0))[at] == h, at, len(common))
    v = len(common) + 1
    return classes, np.bincount(d * v + which, minlength=texts * v).reshape(texts, v)


def js_distance(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distance of each row to its nearest reference; 0 without references, 1 for a row without counts."""
    if not len(references):
        return np.zeros(len(counts))
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    best = np.ones(len(counts))
    for r in references:
        q = r / max(r.sum(), 1)
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
            b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
        best = np.minimum(best, np.sqrt(np.clip((a + b) / 2, 0, 1)))
    return best


def repetition(data: np.ndarray, offs: np.ndarray, window: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: words, words in windows found twice or more, lines (with a word) equal to an earlier one."""
    texts = len(offs) - 1
    h = prefix_hash(data)
    s, e, d = words(data, offs)
    n_words = sum_by(d, texts)
    w, at = shingles(span_hash(h, s, e), d, texts, window)
    full = n_words[at] >= window
    w, at = w[full], at[full]
    _, back, n = np.unique(mix(w + at.astype(U64) * U64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    first = np.cumsum(n_words) - n_words
    starts = np.arange(len(at)) - np.searchsorted(at, at) + first[at]
    hit = starts[n[back] > 1]
    step = np.zeros(len(d) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + window, -1)
    n_repeat = sum_by(d[np.cumsum(step[:-1]) > 0], texts)
    ls, le, ld = runs(data != 10, offs)
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = solid[le] > solid[ls]
    ls, le, ld = ls[full], le[full], ld[full]
    _, one = np.unique(mix(span_hash(h, ls, le) + ld.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    return n_words, n_repeat, sum_by(ld, texts) - sum_by(ld[one], texts)


@dataclass
class LanguageReferences:
    """Sorted hashes of the common words of all languages, and the two histograms of each language."""

    common: np.ndarray
    classes: np.ndarray
    words: np.ndarray


def common_words(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the COMMON most frequent words (A-Z lower-cased) of each language, for rows (lang, text).

    Tasks count by language and word and hand on partial sums; only words with MIN_SHARE of a language's words are
    ranked, so COMMON a language come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, 1):
            s, e, d = words(data, offs)
            h = span_hash(prefix_hash(data, lower=True), s, e)
            langs, own = np.unique(np.array(rows.column(0).to_pylist(), object), return_inverse=True)
            order = np.lexsort((h, own[d]))
            lang, h = own[d][order], h[order]
            first = np.ones(len(h), bool)
            first[1:] = (lang[1:] != lang[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(first)
            n = np.diff(np.append(at, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(langs[lang[at]], pa.string()), pa.array(h[at].view(np.int64)), pa.array(n, pa.int64())], ["lang", "word", "n"])

    sums = stage(rows.mapInArrow(count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    # a table of known size, a row a language: where it is small, no word is shuffled by its language
    total = stage(sums.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    often = sums.join(total, "lang").where(F.col("n") >= F.col("total") * MIN_SHARE)
    best = often.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= COMMON)
    got = best.select("word").distinct().toPandas()["word"].to_numpy(np.int64).view(U64)
    discard(sums, total)
    return np.sort(got)


def fit_references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageReferences:
    """References of every language of the labelled rows, from all their texts.

    The driver gets one row of counts for each language, however few its rows are, as wide as there are common words.
    Rows without language or text are left out; without any, the references are empty.
    """
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    common = common_words(rows)
    k, v = len(CLASSES), len(common) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for rows, data, offs in slices(batches, 1):
            c, w = histograms(data, offs, common)
            both = np.hstack([c, w])
            langs = np.array(rows.column(0).to_pylist(), object)
            for lang in set(langs):
                own = both[langs == lang].sum(0)
                total[lang] = total[lang] + own if lang in total else own
            if len(total) > 10_000:
                yield from emit(total)
                total = {}
        yield from emit(total)

    def emit(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *[pa.array([t[i] for t in total.values()], pa.int64()) for i in range(k + v)]], names)

    names = ["lang", *[f"c{i}" for i in range(k + v)]]
    sums = rows.mapInArrow(count, ", ".join(f"{n} {'string' if n == 'lang' else 'long'}" for n in names)).groupBy("lang").agg(*[F.sum(n).alias(n) for n in names[1:]])
    m = sums.orderBy("lang").toPandas()[names[1:]].to_numpy(np.float64)
    return LanguageReferences(common, m[:, :k], m[:, k:])


def quality_rules(docs: DataFrame, references: LanguageReferences, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts of the base rules, base_failed, the two distances and kept, for every whole text.

    A null or empty text has no words: base_failed is true and kept false.  A distance that a guard
    leaves out is null.  Null ids and repeated rows stay; other columns are left out.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    common = references.common

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, 1):
            n_words, n_repeat, n_dup = repetition(data, offs)
            at = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offs]).astype(np.int64)
            chars = at(((data & 0xC0) != 0x80) & ~SPACE[data])
            classes, common_words = histograms(data, offs, common)
            js_c, js_w = js_distance(classes, references.classes), js_distance(common_words, references.words)
            failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
            use_c, use_w = np.diff(offs) >= rules.min_bytes, n_words >= rules.min_common
            kept = ~failed & ~(use_c & (js_c > rules.max_class_distance)) & ~(use_w & (js_c > rules.near_class_distance) & (js_w > rules.max_word_distance))
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), long(n_words), long(chars), long(at(_IS_SYMBOL[data])), long(n_dup), long(n_repeat), pa.array(failed), pa.array(js_c, pa.float64(), mask=~use_c), pa.array(js_w, pa.float64(), mask=~use_w), pa.array(kept)], names)

    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    types = [id_type, *["long"] * 5, "boolean", "double", "double", "boolean"]
    return rows.mapInArrow(judge, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))).withColumnRenamed("id", id_col)

"""Language identification by hierarchical discrimination.

Hashed byte n-grams of a whole text go first to linear classifiers of language families, then,
within the family, to one-versus-one linear support vector machines of its languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.arrays import slices
from engram.llm.tables import discard, stage, unused

#: Families of languages; fixed values.  A language that isn't listed joins the family whose texts are nearest to its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("an", "ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "indo-aryan": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
    "austronesian": ("ceb", "fil", "id", "jv", "mg", "ms", "su", "tl"),
    "sinitic": ("yue", "zh"),
    "bantu": ("rw", "sw", "xh", "zu"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BINS = 2048
#: Texts scored at once, so that their feature matrix stays small.
ROWS = 128
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Root frequencies of hashed byte 2- and 3-grams (A-Z folded), of length 1 in each row."""
    texts, n = len(offs) - 1, len(data)
    doc = np.repeat(np.arange(texts), np.diff(offs))
    c = _FOLD[data]
    x = np.zeros((texts, BINS), np.float32)
    for k in (2, 3):
        if n < k:
            continue
        h = np.full(n - k + 1, k, np.uint32)
        for j in range(k):
            h = h * np.uint32(0x01000193) + c[j : n - k + 1 + j] * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(21)
        same = doc[: n - k + 1] == doc[k - 1 :]
        x += np.bincount((doc[: n - k + 1] * BINS + h)[same], minlength=texts * BINS).reshape(texts, BINS).astype(np.float32)
    total = x.sum(1, keepdims=True)
    return np.sqrt(x / np.maximum(total, 1))


def chunks(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, size: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for a in range(0, rows.num_rows, size):
        b = min(a + size, rows.num_rows)
        yield rows.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def _ridge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights w (the last for a constant) with the least |w|^2 + sum((y - xw)^2 / cost): solved in the rows or in the features, whichever are fewer.

    Rows are taken up in blocks, so beside x there is one matrix of the smaller side.
    """
    n, k = x.shape[0], x.shape[1] + 1
    block = lambda i: np.hstack([x[i : i + k].astype(np.float64), np.ones((len(x[i : i + k]), 1))])
    if n <= k:
        a = block(0)
        return a.T @ np.linalg.solve(a @ a.T + np.diag(cost), y)
    gram, right = np.eye(k), np.zeros(k)
    for i in range(0, n, k):
        a, c = block(i), cost[i : i + k]
        gram += a.T @ (a / c[:, None])
        right += a.T @ (y[i : i + k] / c)
    return np.linalg.solve(gram, right)


def linear_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights (the last for a constant) of a squared-hinge machine: Newton steps over the rows inside the margin, classes weighted alike."""
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    w, inside = np.zeros(x.shape[1] + 1), np.ones(len(x), bool)
    for _ in range(20):
        w = _ridge(x[inside], y[inside], penalty / share[inside])
        at = np.concatenate([x[i : i + BINS] @ w[:-1] for i in range(0, len(x), BINS)]) + w[-1] if len(x) else np.zeros(0)
        now = y * at < 1
        if (now == inside).all():
            break
        inside = now
    return w


@dataclass
class LanguageModel:
    langs: list[str]
    families: list[str]
    #: The family of each language.
    family_of: list[str]
    #: For families and for languages: (index, index, weights) by pair.
    family_pairs: list[tuple[int, int, np.ndarray]]
    lang_pairs: list[tuple[int, int, np.ndarray]]

    @staticmethod
    def fit(x: np.ndarray, lang: list[str]) -> LanguageModel:
        langs = sorted(set(lang))
        own = np.array([langs.index(v) for v in lang], np.int64)
        mean = np.stack([x[own == i].mean(0, dtype=np.float64) for i in range(len(langs))]) if langs else np.zeros((0, BINS))
        listed = [i for i, v in enumerate(langs) if v in FAMILY]
        near = [FAMILY[langs[listed[int((mean[listed] @ m).argmax())]]] if listed else "other" for m in mean]
        family_of = [FAMILY.get(v, near[i]) for i, v in enumerate(langs)]
        families = sorted(set(family_of))
        fam = np.array([families.index(family_of[i]) for i in own], np.int64)

        def machines(group: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
            out = []
            for a, b in pairs:
                rows = (group == a) | (group == b)
                out.append((a, b, linear_svm(x[rows], group[rows] == a)))
            return out

        siblings = [(a, b) for a, b in combinations(range(len(langs)), 2) if family_of[a] == family_of[b]]
        return LanguageModel(langs, families, family_of, machines(fam, list(combinations(range(len(families)), 2))), machines(own, siblings))

    @staticmethod
    def _vote(x: np.ndarray, pairs: list[tuple[int, int, np.ndarray]], members: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
        """The member with the most wins (then the larger margins, then the lower index) and how sure its weakest win is."""
        wins = np.full((len(x), size), -np.inf)
        wins[:, members] = 0
        sure = np.ones((len(x), size))
        for a, b, w in pairs:
            if a in members and b in members:
                p = 1 / (1 + np.exp(-4 * np.clip(x @ w[:-1] + w[-1], -8, 8)))
                wins[:, a] += (p >= 0.5) + p * 1e-3
                wins[:, b] += (p < 0.5) + (1 - p) * 1e-3
                sure[:, a], sure[:, b] = np.minimum(sure[:, a], p), np.minimum(sure[:, b], 1 - p)
        best = wins.argmax(1)
        return best, sure[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam, score = self._vote(x, self.family_pairs, list(range(len(self.families))), len(self.families))
        out, score = np.zeros(len(x), np.int64), score.copy()
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(fam == f)
            members = [i for i, v in enumerate(self.family_of) if v == name]
            if len(rows):
                out[rows], sure = self._vote(x[rows], self.lang_pairs, members, len(self.langs))
                score[rows] *= sure
        return [self.langs[i] for i in out], score


def fit_language_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None, per_language: int = 400, max_rows: int = 25_600) -> LanguageModel:
    """A model of the languages in lang_col, from about per_language rows of each, drawn by a hash of key.

    Rows without language or text are left out.  max_rows bounds the sample: where the languages are so many that
    per_language of each are more, all give proportionately fewer, and one of which no row is drawn isn't learned.
    The rows' features (not their texts) come to the driver: about max_rows x 8 kB at most.
    """
    key = F.monotonically_increasing_id() if key is None else key
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a small table with a known size, however many languages there are
    counts = stage(rows.groupBy("lang").count(), "languages")
    asked = counts.agg(F.sum(F.least("count", F.lit(per_language)))).first()[0] or 0
    rate = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")) * min(1.0, max_rows / max(asked, 1))
    u = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.join(counts.select("lang", rate.alias("rate")), "lang").where(u < F.col("rate")).select("lang", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, 1):
            for part, d, o in chunks(batch, data, offs):
                x = features(d, o)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["lang", "x"])

    got = drawn.mapInArrow(extract, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    discard(counts)
    keep = got.groupby("lang").head(2 * per_language)
    if not len(keep):
        return LanguageModel([], [], [], [], [])
    return LanguageModel.fit(np.stack([np.frombuffer(b, np.float32) for b in keep["x"]]), keep["lang"].tolist())


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The columns of docs and the predicted language and score (0 to 1) of every whole text.

    A text that is null or has no letter is "und" with score 0, as is every text if the model knows no language.
    A model of one language gives that language with score 1.  Repeated rows are predicted alike;
    names of docs that clash with the two new columns raise ValueError.
    """
    if {lang_out, score_out} & set(docs.columns):
        raise ValueError("docs has columns of the output's names")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, at):
            for part, d, o in chunks(batch, data, offs):
                raw = d.tobytes()
                letter = np.array([bool(_LETTER(raw[a:b].decode("utf-8"))) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)], bool)
                if model.langs:
                    lang, score = model.predict(features(d, o))
                else:
                    lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                lang = [v if ok else UNKNOWN for v, ok in zip(lang, letter.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0), pa.float64())], [*part.schema.names, lang_out, score_out])

    return docs.mapInArrow(predict, f"{fields}, `{lang_out}` string, `{score_out}` double")


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds == fold


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float, text_col: str = "text") -> DataFrame:
    """Rows of docs whose language is known with min_score at least."""
    lang, score = unused(docs.columns, "_lang_pred"), unused(docs.columns, "_lang_score")
    out = identify_language(docs, model, text_col, lang, score)
    return out.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])

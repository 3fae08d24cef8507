"""Secret scans with DataFrame functions only.

Base patterns (assignments, access keys, hex runs) give the base spans.  The method adds spans
of kind "random": runs of 20 or more token characters whose encoding can be inferred (hex,
base32 or base64; two kinds of characters at least) go through a battery of randomness tests:

* chi-squared uniformity over cells of the alphabet (vowels, common and rare consonants, ...),
* runs of one kind of character (capital, small letter, digit, sign): too few speak against randomness,
* lag-1 serial correlation of the symbol values.

Fisher's method combines the three p-values under "the symbols are random".  A token below
MIN_RANDOM_P is not random.  For the others, ORDINARY_TAIL bounds by length how often an ordinary
name gets so large a value: the p-value under "this is a name".  The Benjamini-Hochberg procedure
over the candidates of a document then reports tokens such that at most FALSE_REPORTS of the
reports are expected to be names.  Short tokens look random more easily, so they need a larger
value, all the more in a document of many candidates.

Arrays are scanned by blocks of about the root of their length, so nothing grows with the square
of a text's matches or of a token's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.tables import unused

#: Kinds in their order, and the patterns of the base kinds; fixed values.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
PATTERNS = (ASSIGN, ACCESS, HEX, CANDIDATE)
#: Alphabets in order of value, and the cells whose shares are tested.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
CELLS = {
    "hex": ("0123", "4567", "89ab", "cdef"),
    "base32": ("AEIOU", "TNSRLD", "BCFGHJKMPQVWXYZ", "234567"),
    "base64": ("aeiou", "tnsrld", "bcfghjkmpqvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789+/"),
}
#: Tokens whose symbols would be at least as uneven with this probability, if they were random, aren't random.
MIN_RANDOM_P = 0.03
#: (length, bound): of names shorter than length, at most bound / p get a combined value above p (measured; see the tests).
ORDINARY_TAIL = ((24, 6e-4), (32, 3e-5), (1 << 30, 1e-6))
FALSE_REPORTS = 0.05
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: it is bound as the element of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(x: Column) -> Column:
    """A non-empty array in blocks of about the root of its size."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / s).cast("int")), lambda b: F.slice(x, b * s + 1, s))
    return _let(F.ceil(F.sqrt(F.size(x))).cast("int"), cut)


def _scan(x: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Running values of f (a sum or a maximum; 0 to start with) over a non-empty array of int."""
    more = lambda acc, v: F.concat(acc, F.array(f(F.element_at(acc, -1), v)))
    total = lambda block: F.aggregate(block, F.lit(0), f)

    def over(blocks: Column) -> Column:
        before = F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), more)
        within = lambda start: F.transform(blocks, lambda block, i: F.slice(F.aggregate(block, F.array(F.get(start, i)), more), F.lit(2), F.size(block)))
        return F.flatten(_let(before, within))

    return _let(_blocks(x), over)


def _positions(found: Column, text: Column, pattern: str, kind: int) -> Column:
    """Spans in code points from the matches and what stands between them, all in order."""

    def spans(x: Column) -> Column:
        ends = _scan(F.zip_with(x["found"], F.slice(x["gaps"], F.lit(1), F.size(x["found"])), lambda m, g: F.length(g) + F.length(m)), lambda a, b: a + b)
        return F.zip_with(x["found"], ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))

    none = F.expr(f"cast(array() as {_SPAN})")
    return F.when(F.size(found) > 0, _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), spans)).otherwise(none)


def _upper(z: Column) -> Column:
    """P(Z > |z|) of a standard normal (polynomial approximation, error below 1e-7)."""

    def tail(x: Column) -> Column:
        t, density = x["t"], 0.3989422804014327 * F.exp(-x["z"] * x["z"] / 2)
        return density * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))

    return _let(F.abs(z), lambda z: _let(F.struct(z.alias("z"), (1 / (1 + 0.2316419 * z)).alias("t")), tail))


def _encoding(token: Column) -> Column:
    """hex, base32 or base64 for a token of two kinds of characters at least, one of them letters; else null."""
    mixed = token.rlike("[A-Za-z]") & ~token.rlike("^([A-Z]+|[a-z]+)=*$")
    return F.when(~mixed, F.lit(None)).when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")


def randomness_p(token: Column) -> Column:
    """The combined p-value of a token under "its symbols are random"; null where no encoding can be inferred."""

    def of(x: Column) -> Column:
        body = F.translate(F.regexp_replace(x["token"], "=+$", ""), "-_", "+/")
        out = F.lit(None).cast("double")
        for enc in ALPHABETS:
            out = F.when(x["enc"] == enc, _let(F.lower(body) if enc == "hex" else body, _battery_of(enc))).otherwise(out)
        return F.when(x["enc"].isNotNull(), out)

    return _let(F.struct(token.alias("token"), _encoding(token).alias("enc")), of)


def _kinds(enc: str) -> tuple[str, list[float]]:
    """The kind of each symbol of an alphabet (u, l, d, s), and their shares."""
    kind = "".join("u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s" for c in ALPHABETS[enc])
    return kind, [kind.count(k) / len(kind) for k in sorted(set(kind))]


def _battery_of(enc: str) -> Callable[[Column], Column]:
    return lambda body: _battery(body, enc)


def _battery(body: Column, enc: str) -> Column:
    """The combined p-value of a body of 20 or more symbols of an alphabet."""
    alphabet, cells = ALPHABETS[enc], CELLS[enc]
    kind, shares = _kinds(enc)
    n = F.length(body).cast("double")
    # runs are counted by leaving one character of each
    runs = F.translate(body, alphabet, kind)
    for k in sorted(set(kind)):
        runs = F.regexp_replace(runs, f"{k}+", k)
    symbols = F.transform(F.split(body, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("s"), zero.alias("ss"), zero.alias("sp"), zero.alias("last"))
    sums = F.aggregate(symbols, start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["ss"] + v * v).alias("ss"), (acc["sp"] + acc["last"] * v).alias("sp"), v.alias("last")))
    counts = [n - F.length(F.translate(body, c, "")) for c in cells]
    chi = sum((F.pow(k - n * (len(c) / len(alphabet)), F.lit(2.0)) / (n * (len(c) / len(alphabet))) for k, c in zip(counts, cells, strict=True)), F.lit(0.0))
    change = 1 - sum(p * p for p in shares)
    both = sum(p * (1 - p) ** 2 for p in shares) - change**2
    first = F.instr(F.lit(alphabet), F.substring(body, 1, 1)) - 1.0

    def combined(x: Column) -> Column:
        n, df, mean = x["n"], len(cells) - 1, x["sums"]["s"] / x["n"]
        z1 = (F.pow(x["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
        z2 = (x["runs"] - 0.5 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * both)
        var = x["sums"]["ss"] - n * mean * mean
        cov = x["sums"]["sp"] - mean * (2 * x["sums"]["s"] - x["first"] - x["sums"]["last"]) + (n - 1) * mean * mean
        above = lambda z: _let(z, lambda z: _let(_upper(z), lambda q: F.when(z >= 0, q).otherwise(1 - q)))
        p3 = F.when(var > 1e-9, 2 * _upper(cov / var * F.sqrt(n))).otherwise(0.0)
        half = -F.aggregate(F.array(above(z1), above(-z2), p3), F.lit(0.0), lambda acc, p: acc + F.ln(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0))))
        return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return _let(F.struct(n.alias("n"), chi.alias("chi"), F.length(runs).cast("double").alias("runs"), sums.alias("sums"), first.alias("first")), combined)


def _reported(tested: Column) -> Column:
    """Of candidates (start, kind, end, p) those that Benjamini-Hochberg reports, by their p-values as names."""
    n = lambda x: x["end"] - x["start"]
    bound = lambda x: F.when(n(x) < ORDINARY_TAIL[0][0], ORDINARY_TAIL[0][1]).when(n(x) < ORDINARY_TAIL[1][0], ORDINARY_TAIL[1][1]).otherwise(ORDINARY_TAIL[2][1])
    named = F.transform(tested, lambda x: F.struct(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")).alias("span"), F.when(x["p"] < MIN_RANDOM_P, 1.0).otherwise(bound(x) / x["p"]).alias("q")))

    def cut(x: Column) -> Column:
        # the largest q that is at most its rank's share of the allowed rate
        low = F.transform(F.array_sort(F.transform(x, lambda c: c["q"])), lambda q, i: F.when(q <= (i + 1) * (FALSE_REPORTS / F.size(x)), q).otherwise(-1.0))
        return _let(F.array_max(low), lambda most: F.transform(F.filter(x, lambda c: c["q"] <= most), lambda c: c["span"]))

    return _let(named, cut)


def _apart(new: Column, base: Column) -> Column:
    """The spans of new (disjoint, in order) that overlap none of base; both arrays are not empty."""
    # a span overlaps if, of the base spans that start before its end, one ends after its start
    event = lambda at, ask, start, end: F.struct(at.alias("at"), F.lit(ask).alias("ask"), start.alias("start"), end.alias("end"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b["start"], 1, b["start"], b["end"])), F.transform(new, lambda x: event(x["end"], 0, x["start"], x["end"]))))

    def free(e: Column) -> Column:
        reach = _scan(F.transform(e, lambda x: F.when(x["ask"] == 1, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        asked = F.zip_with(e, reach, lambda x, r: F.struct(x["ask"].alias("ask"), x["start"].alias("start"), x["end"].alias("end"), r.alias("reach")))
        clear = F.filter(asked, lambda x: (x["ask"] == 0) & (x["reach"] <= x["start"]))
        return F.transform(clear, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))

    return _let(events, free)


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def find_secrets(docs: DataFrame, text_col: str = "text", base_out: str = "_base", spans_out: str = "_spans") -> DataFrame:
    """The columns of docs and two more: base and all spans, arrays of (start, kind, end) in code points, by start, then kind.

    A null text counts as empty and has no spans.  Rows are treated one by one, so null or repeated
    ids and ties play no part.  Names of docs that clash with the two new columns raise ValueError.
    """
    if {base_out.lower(), spans_out.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError("docs has columns of the output's names")
    taken = [*docs.columns, base_out, spans_out]
    step = lambda name: unused(taken, name)
    found, spans, tested, kept = step("_found"), step("_at"), step("_tested"), step("_kept")
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    matches = lambda pattern, group=0: F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    df = docs.withColumn(found, F.struct(*[matches(p).alias(f"m{k}") for k, p in enumerate(PATTERNS)], matches(ASSIGN, 2).alias("v0")))
    m = lambda k: F.col(found)[f"m{k}"]
    df = df.withColumn(spans, F.struct(*[_positions(m(k), t, p, k).alias(f"p{k}") for k, p in enumerate(PATTERNS)]))
    at = lambda k: F.col(spans)[f"p{k}"]
    long_enough = F.filter(at(0), lambda s, i: F.length(F.get(F.col(found)["v0"], i)) >= 6)
    df = df.withColumn(base_out, F.array_sort(F.concat(F.when(F.size(at(0)) > 0, long_enough).otherwise(at(0)), at(1), at(2))))
    with_p = F.zip_with(at(3), m(3), lambda s, token: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), randomness_p(token).alias("p")))
    df = df.withColumn(tested, F.when(F.size(at(3)) > 0, F.filter(with_p, lambda x: x["p"].isNotNull())))
    df = df.withColumn(kept, F.when(F.size(tested) > 0, _reported(F.col(tested))))
    clear = F.when(F.size(base_out) > 0, _apart(F.col(kept), F.col(base_out))).otherwise(F.col(kept))
    df = df.withColumn(spans_out, F.when(F.size(kept) > 0, F.array_sort(F.concat(base_out, clear))).otherwise(F.col(base_out)))
    return df.drop(found, spans, tested, kept)


def secret_scans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every whole text; see find_secrets for odd rows."""
    df = find_secrets(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")), "_text")
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    return df.select(F.col("_id").alias(id_col), *[count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with each span of a non-empty array (sorted; overlapping ones as one) replaced by mask."""

    def gaps(x: Column) -> Column:
        s, reach = x["spans"], x["reach"]  # reach: the furthest end so far
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))
        opened = F.transform(first, lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get(reach, i - 1)).alias("start"), F.get(s, i)["start"].alias("end")))
        return F.concat(opened, F.array(F.struct(F.element_at(reach, -1).alias("start"), F.length(text).alias("end"))))

    def pieces(block: Column) -> Column:
        # a block's stretch of the text is cut out first, so that no piece is sought from the text's start
        at = F.get(block, F.lit(0))["start"]
        cut = lambda x: F.transform(block, lambda g: F.substr(x["text"], g["start"] - x["at"] + 1, g["end"] - g["start"]))
        return _let(F.struct(F.substr(text, at + 1, F.element_at(block, -1)["end"] - at).alias("text"), at.alias("at")), cut)

    reach = _scan(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    kept = _let(F.struct(spans.alias("spans"), reach.alias("reach")), gaps)
    return F.array_join(F.flatten(F.transform(_let(kept, _blocks), pieces)), mask)


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by mask; length_col, if there, is set anew for changed texts.

    A null text stays null; names of columns play no part.
    """
    base, spans = (unused(docs.columns, x) for x in ("_base", "_spans"))
    new = unused([*docs.columns, base, spans], "_new")
    df = find_secrets(docs, text_col, base, spans)
    t = F.col(f"`{text_col}`")
    df = df.withColumn(new, F.when(F.size(spans) > 0, _masked(t, F.col(spans), mask)))
    out = {text_col: F.coalesce(F.col(new), t)}
    if length_col and length_col in docs.columns:
        out[length_col] = F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`"))
    return df.select(*[(out[c] if c in out else F.col(f"`{c}`")).alias(c) for c in docs.columns])

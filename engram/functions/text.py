"""Text functions as column expressions: tokens, keywords, markdown sections, chats, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.expressions import let

TOKEN = r"[a-zA-Z][a-zA-Z0-9_-]+"
#: Words that make no trigger keyword; fixed values.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need must "
    "in on at to for of with by from as into through during before after above below between under again further then once "
    "and but or nor not so yet both either neither each every all any few more most other some such no only own same than "
    "too very just also i me my we our you your he she it they them their its this that these those "
    "what which who whom when where why how if because while although though unless until about up out off over down"
).split()
#: Words that make no keyword of a learned trigger; fixed values.
LEARNED_STOP_WORDS = (
    "a an the is are was were be been have has had do does did will would in on at to for of with by from "
    "and but or not so yet i me my we you he she it they this that what which who how if"
).split()
#: Words that make no keyword of a mined trigger; fixed values.
MINED_STOP_WORDS = "the a an is are was to for of in on and or with by from this that".split()


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens in order."""
    return F.array_distinct(raw_tokens(F.lower(text)))


def _plain(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(stop))


def keywords(text: Column) -> Column:
    return _plain(tokens(text), STOP_WORDS)


def _marked(words: Column) -> Column:
    """Acronyms, technical terms and capitalised words."""
    capital = lambda w: w.rlike("^[A-Z]")
    return F.filter(words, lambda w: ((w == F.upper(w)) & (F.length(w) >= 2)) | w.rlike("[_-]") | capital(w))


def first_sentence(text: Column) -> Column:
    return F.substring_index(text, ".", 1)


def trigger_keywords(heading: Column, body: Column) -> Column:
    """All words of the heading, the marked words of the body, all words of its first sentence: distinct, in that order."""
    found = F.concat(raw_tokens(heading), _marked(raw_tokens(body)), raw_tokens(F.lower(first_sentence(body))))
    return F.array_distinct(_plain(F.transform(found, lambda w: F.lower(w)), STOP_WORDS))


def is_chat(text: Column) -> Column:
    """Whether two of the first 20 lines at least are chat turns."""
    head = F.slice(F.split(text, "\n", 21), 1, 20)
    return F.size(F.filter(head, lambda s: s.startswith("[user]:") | s.startswith("[assistant]:"))) >= 2


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def user_turns(text: Column) -> Column:
    own = F.filter(F.split(text, "\n", -1), lambda s: s.startswith("[user]:"))
    return F.transform(own, lambda s: strip(F.substr(s, F.lit(8))))


def chat_keywords(turns: Column) -> Column:
    """Marked words of all user turns, then all words of the first turn: distinct, in that order."""
    found = F.concat(_marked(raw_tokens(F.array_join(turns, " "))), raw_tokens(F.lower(F.coalesce(F.get(turns, F.lit(0)), F.lit("")))))
    return F.array_distinct(_plain(F.transform(found, lambda w: F.lower(w)), STOP_WORDS))


def section_parts(text: Column) -> Column:
    """Array of (heading, body): parts at "## " lines with a body; a first line "# " is the heading of what precedes them."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def step(acc: Column, s: Column) -> Column:
        title = acc["open"] & (acc["heading"] == "") & s.startswith("# ")
        new = F.struct(strip(F.substr(s, F.lit(3))).alias("heading"), (acc["skip"] + 1).alias("skip"), F.lit(True).alias("open"))
        return F.when(title, new).otherwise(F.struct(acc["heading"].alias("heading"), acc["skip"].alias("skip"), F.lit(False).alias("open")))

    def headed(x: Column) -> Column:
        """Heading and body of x: first (the heading line's own) and rest (the lines after it)."""
        head = F.aggregate(x["rest"], F.struct(x["first"].alias("heading"), F.lit(0).alias("skip"), F.lit(True).alias("open")), step)
        body = lambda y: F.struct(y["head"]["heading"].alias("heading"), strip(F.array_join(F.slice(y["rest"], y["head"]["skip"] + 1, F.size(y["rest"])), "\n")).alias("body"))
        return let(body, head=head, rest=x["rest"])

    def part(x: Column) -> Column:
        """Heading and body of the lines x["own"]; "# " lines before any body give the heading while there is none."""
        own, h2 = x["own"], F.get(x["own"], F.lit(0)).startswith("## ")
        first = F.when(h2, strip(F.substr(F.get(own, F.lit(0)), F.lit(4)))).otherwise("")
        return let(headed, first=first, rest=F.when(h2, F.slice(own, F.lit(2), F.size(own))).otherwise(own))

    def parts(x: Column) -> Column:
        marks = F.concat(F.array_compact(F.transform(x["lines"], lambda s, i: F.when((i == 0) | s.startswith("## "), i))), F.array(F.size(x["lines"])))
        cut = lambda y: F.transform(F.slice(y["marks"], F.lit(1), F.size(y["marks"]) - 1), lambda i, k: let(part, own=F.slice(y["lines"], i + 1, F.get(y["marks"], k + 1) - i)))
        return let(cut, marks=marks, lines=x["lines"])

    return F.filter(let(parts, lines=lines), lambda p: p["body"] != "")


def markdown_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, section (from 0), heading, body of section_parts().

    Lines of a document are folded in order inside its row, so a document is never spread over rows.
    """
    df = docs.select(F.col(id_col), section_parts(F.col(text_col)).alias("_parts"))
    return df.select(id_col, F.posexplode("_parts").alias("section", "_p")).select(id_col, "section", "_p.heading", "_p.body")


#: ASCII punctuation that answers lose; fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word character on either side keeps an article from being one.
_ARTICLE = r"(^|[^\p{L}\p{N}\p{M}_])(?:an|a|the)(?=$|[^\p{L}\p{N}\p{M}_])"


def normalize_answer(text: Column) -> Column:
    """Lower case, without articles, punctuation and spare white space."""
    bare = F.translate(F.regexp_replace(F.lower(text), _ARTICLE, "$1"), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda w: w != "")


def document_text(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(": "), text)).otherwise(text)

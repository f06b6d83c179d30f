"""Text functions as column expressions. Lengths are in code points; white space is the ASCII set and the no-break space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B\x{A0}]"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def truncate(text: Column, most: int) -> Column:
    """text if it has at most so many characters, else its head, cut at the last space if that lies beyond three fifths, and an ellipsis."""
    head = F.regexp_replace(F.substring(text, 1, most - 1), WS + "+$", "")
    space = F.char_length(head) - F.instr(F.reverse(head), " ")  # 0-based, or the length if there is none
    cut = F.when((F.instr(head, " ") > 0) & (space > 0.6 * most), F.left(head, space)).otherwise(head)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"[ \t\n\r\f\x0B\x{A0},;:–—-]+$", ""), F.lit("…")))


def sanitize(text: Column) -> Column:
    """Dashes of all kinds as spaced en dashes, those between digits unspaced; straight quotes."""
    dashes = F.regexp_replace(text, f"{WS}*[—―]{WS}*", " – ")
    spaced = F.regexp_replace(dashes, f"(?<![0-9])({WS}*–{WS}*)|({WS}*–{WS}*)(?![0-9])", " – ")
    return F.translate(spaced, "“”‘’", "\"\"''")


#: Where a sentence ends: after . ! or ? before a capital, digit, quote or bracket.
CUT = r"(?<=[.!?]) +(?=[A-Z0-9\"'“(])"


def cut(collapsed: Column) -> Column:
    """The sentences of a collapsed text. A split makes its pattern anew for each text, so texts of one sentence are told by a search."""
    return F.when(collapsed.rlike(CUT), F.split(collapsed, CUT)).when(collapsed.isNotNull(), F.array(collapsed))


def sentences(text: Column) -> Column:
    """The collapsed text, cut where a sentence ends."""
    return F.split(collapse(text), CUT)


def first_sentence(text: Column, most: int = 240) -> Column:
    return truncate(F.element_at(sentences(text), 1), most)


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _shorter(x: Column, n: int) -> Column:
    return F.left(x, F.char_length(x) - n)


def _ends(x: Column, longer_than: int, *endings: str) -> Column:
    """Whether x is longer than that and has one of the endings."""
    found = x.endswith(endings[0])
    for e in endings[1:]:
        found = found | x.endswith(e)
    return (F.char_length(x) > longer_than) & found


def stem(word: Column) -> Column:
    """A light English stem: plural, -ing or -ed, final e, doubled consonant. Each step is worked out once, as nested CASEs outgrow a method."""
    steps = (
        lambda x: F.when(_ends(x, 4, "ies"), F.concat(_shorter(x, 3), F.lit("y"))).when(_ends(x, 4, "ses", "xes", "zes", "ches", "shes"), _shorter(x, 2)).when(_ends(x, 3, "s") & ~x.endswith("ss"), _shorter(x, 1)).otherwise(x),
        lambda x: F.when(_ends(x, 4, "ing"), _shorter(x, 3)).when(_ends(x, 4, "ed"), _shorter(x, 2)).otherwise(x),
        lambda x: F.when(_ends(x, 4, "e"), _shorter(x, 1)).otherwise(x),
        lambda x: F.when(F.right(x, F.lit(2)).isin([c * 2 for c in "bdgklmnprt"]), _shorter(x, 1)).otherwise(x),
    )
    for f in steps:
        word = bound(word, f)
    return word


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Tokens between white space that hold a letter or digit."""
    return F.size(F.filter(F.split(F.lower(text), WS + "+"), lambda w: w.rlike("[a-z0-9]")))


def normal_quote(text: Column) -> Column:
    """Lower case, everything else but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def quote_parts(quote: Column, least: int = 16) -> Column:
    """The normalised parts between ellipses that are long enough to be looked for."""
    return F.filter(F.transform(F.split(quote, r"…|\.\.\."), normal_quote), lambda p: F.char_length(p) >= least)


def quote_in(parts: Column, normal_text: Column) -> Column:
    """Whether every part is found; false without parts."""
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(normal_text, p))


def slug(text: Column, most: int = 40) -> Column:
    """Lower-case words joined by hyphens, cut to length, without hyphens at the ends."""
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most)), "-+$", "")


def escape_markup(text: Column) -> Column:
    """Backslashes before the characters that chat markup interprets."""
    return F.regexp_replace(text, r"([\\*_~`|>])", r"\\$1")


def join_names(names: Column, conjunction: str = "and") -> Column:
    """a / a and b / a, b and c."""
    n = F.size(names)
    return F.when(n == 0, "").when(n == 1, names[0]).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(f" {conjunction} "), F.element_at(names, -1)))


def paragraphs(text: Column) -> Column:
    """What blank lines separate, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(p)), lambda p: p != "")


def folded(text: Column) -> Column:
    """Only the letters and digits, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def paragraph_with(text: Column, quote: Column) -> Column:
    """The first paragraph that has the quote's letters and digits in a row, whatever is between them; null if none has, or there are none."""
    return bound(folded(quote), lambda want: F.when(want != "", F.get(F.filter(paragraphs(text), lambda p: F.contains(folded(p), want)), F.lit(0))))


def day(at: Column) -> Column:
    """An instant's date, or unknown for the beginning of time, which stands for none."""
    return F.when(at.isNull() | (F.unix_micros(at) == 0), "unknown").otherwise(F.date_format(at, "yyyy-MM-dd"))


def parsed_date(text: Column) -> Column:
    """A date as feeds and pages write it: an ISO instant or day, or an RFC 822 date; null rather than an error."""
    trimmed = F.trim(text)
    named = F.regexp_replace(trimmed, "^[A-Za-z]{3}, +", "")
    return F.coalesce(F.try_to_timestamp(trimmed), F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(named, F.lit("d MMM yyyy")))

"""Text functions as Column expressions: they stay in generated code, beside the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. White space as the specification's language sees it: Unicode spaces and the four ASCII separators.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: The ligature that is spelled out before comparing, and its spelling.
LIGATURE = ("և", "եւ")
#: Letters whose capital form is several letters, and the single capital that SQL has for each (ẞ for ß, else
#: the title form if that is one letter, or the letter itself).
WIDE = "".join(c for c in map(chr, range(0xD800)) if len(c.upper()) > 1) + "".join(c for c in map(chr, range(0xE000, 0x10000)) if len(c.upper()) > 1)
WIDE_CAPITALS = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in WIDE)
#: What marks a personal e-mail address and a telephone number in corpus statistics.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+"
PHONE = r"(\+374|00374|0)\s?\p{Nd}{2}\s?\p{Nd}{2}\s?\p{Nd}{2}\s?\p{Nd}{2}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: inside a higher-order function a plain column is computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """White space off both ends; the built-in trim takes spaces alone."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def _composed(text: Column, compatible: bool) -> Column:
    """NFC or, if ``compatible``, NFKC by the ICU library that is part of Spark; ASCII, which has no other form, stays as it is.

    Spark takes what ``reflect`` calls for non-deterministic: select the column before an aggregate takes it.
    """
    plain = F.coalesce(F.octet_length(text) == F.char_length(text), F.lit(True))
    return F.when(plain, text).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(compatible)))


def nfc(text: Column) -> Column:
    return _composed(text, False)


def release_view(text: Column, normalise: bool = True) -> Column:
    """NFC, no blanks at line ends, at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(nfc(text) if normalise else text, r"(?dm)[ \t]+$", ""), r"\n{3,}", "\n\n")


def nfkc(text: Column) -> Column:
    """Compatibility and composed forms folded."""
    return _composed(text, True)


def signature_view(text: Column, normalise: bool = True) -> Column:
    """What two texts share if they differ in form, case, punctuation, digits and spacing alone.

    Compatibility forms are folded first, unless ``normalise`` is false.
    """
    spelled = F.replace(text, F.lit(LIGATURE[0]), F.lit(LIGATURE[1]))
    low = F.lower(nfkc(spelled) if normalise else spelled)
    return collapse(F.regexp_replace(F.regexp_replace(low, r"\p{P}", ""), r"\p{Nd}", "0"))


def words(text: Column) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def ngrams(tokens: Column, n: int, short: bool = False) -> Column:
    """Distinct n-grams, joined by spaces. Fewer tokens give none, or with ``short`` the whole sequence as one."""

    def grams(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        rest = F.array(F.array_join(w, " ")) if short else F.array().cast("array<string>")
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(rest)

    return let(tokens, grams)


def word_runs(text: Column, n: int) -> Column:
    """Every run of n words of a text in signature view, repeated ones as well; a shorter text is one run.

    ``\\G`` ties each match to the end of the one before and nothing is tried twice, so long words cost no more than their length.
    """

    def runs(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(rf"\G(?=([^ ]++(?: [^ ]++){{{n - 1}}}))[^ ]++ ?"), F.lit(1))
        return let(found, lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(t)))

    return let(text, runs)


def char_ngrams(text: Column, n: int, step: int = 16) -> Column:
    """Distinct runs of n characters, or the whole text where it is shorter.

    The text is cut into overlapping pieces of n - 1 + ``step`` characters first, since a substring is found by counting
    characters from the start.
    """

    def grams(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{n},{n - 1 + step}}})).{{1,{step}}}"), F.lit(1))
        runs = lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - n + 1), lambda i: F.substring(p, i, F.lit(n)))
        every = F.flatten(F.transform(pieces, runs))
        return F.when(F.char_length(t) >= n, F.array_distinct(every)).otherwise(F.array(t))

    return let(text, grams)


def clean_document(title: Column, body: Column, min_len: int = 100, normalise: bool = True) -> Column:
    """Title, line break, body in release view; null if either is blank or the whole is shorter than ``min_len``."""
    whole = release_view(F.concat(strip(title), F.lit("\n"), strip(body)), normalise)
    return let(whole, lambda text: F.when((strip(title) != "") & (strip(body) != "") & (F.char_length(text) >= min_len), text))


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value.cast("string")), F.lit(""))


def iso(ts: Column) -> Column:
    """ISO form of a timestamp; microseconds show only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def month_of(date: Column, earliest: str = "1998-01") -> Column:
    """First seven characters, compared as text; shorter, missing and too early ones are ``unknown``."""
    month = F.substring(date, 1, 7)
    return F.when((F.char_length(date) >= 7) & (month >= earliest), month).otherwise("unknown")


def source_or_unknown(source: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))


def paragraphs(text: Column, sep: str = "\n\n") -> Column:
    """Parts between separators that are not blank."""
    return F.filter(F.split(text, sep, -1), lambda p: strip(p) != "")


def final_number(text: Column) -> Column:
    """Last number of a text without thousands commas, per cent sign and closing dot; no sign. Null if none."""
    found = F.regexp_extract_all(F.replace(text, F.lit("−"), F.lit("-")), F.lit(r"(\d[\d,]*(?:\.\d+)?%?)"), F.lit(1))
    return F.rtrim(F.replace(F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")), F.lit("%"), F.lit("")), F.lit("."))


def final_token(text: Column) -> Column:
    """Last line that is not blank, stripped; empty if there is none."""
    return F.coalesce(strip(F.try_element_at(F.filter(F.split(text, "\n", -1), lambda x: strip(x) != ""), F.lit(-1))), F.lit(""))


def choice_letter(text: Column) -> Column:
    """First letter, as one capital, of what follows the last colon; null if nothing does."""
    last = strip(F.element_at(F.split(text, ":", -1), -1))
    first = F.substring(F.regexp_replace(last, r"^[()]+|[()]+\z", ""), 1, 1)
    return F.nullif(F.when(F.char_length(F.upper(first)) > 1, F.translate(first, WIDE, WIDE_CAPITALS)).otherwise(F.upper(first)), F.lit(""))


#: How an answer letter is given, said and boxed.
ANSWER_GIVEN = r"^\(?([A-J])\)?$"
ANSWER_SAID = r"(?i)answer is \(?([A-J])\)?"
ANSWER_BOXED = r"boxed\{?\(?([A-J])\)?\}?"


def final_answer(output: Column, expected: Column) -> Column:
    """The answer letter: of ``expected`` where that is given, else from the last 400 characters of the output."""
    given = F.nullif(F.regexp_extract(strip(expected), ANSWER_GIVEN, 1), F.lit(""))
    tail = F.right(output, F.lit(400))
    said = F.nullif(F.regexp_extract(tail, ANSWER_SAID, 1), F.lit(""))
    boxed = F.nullif(F.regexp_extract(tail, ANSWER_BOXED, 1), F.lit(""))
    return F.when(F.coalesce(expected, F.lit("")) != "", given).otherwise(F.coalesce(said, boxed))


def post_think(output: Column, cap: int = 1200) -> Column:
    """What follows the first closing thought tag, or the last 500 characters; at most ``cap`` characters."""
    mark = "</think>"
    at = F.instr(output, mark)
    return F.left(F.when(at > 0, strip(F.substring(output, at + len(mark), F.char_length(output)))).otherwise(F.right(output, F.lit(500))), F.lit(cap))


def snippet(text: Column, n: int = 1000) -> Column:
    return F.left(collapse(text), F.lit(n))


def csv_safe(text: Column, n: int = 200) -> Column:
    return F.translate(F.left(text, F.lit(n)), '"\n', "' ")


def last_score(text: Column) -> Column:
    """The last of the digits 1 to 5, as a number; null if none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit("([1-5])"), F.lit(1)), F.lit(-1)).cast("int")


def benchmark_text(question: Column, options: Column, keep_breaks: bool = False) -> Column:
    """Question and options in one line, as contamination indices hold them."""
    text = F.concat_ws(" ", question, F.array_join(options, " "))
    return text if keep_breaks else F.replace(text, F.lit("\n"), F.lit(" "))

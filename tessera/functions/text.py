"""Cleaning and standardising cell values, as Column expressions of built-in functions only."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, the Unicode kinds included: inside a character class, and as one.
SPACES = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BLANK = f"[{SPACES}]"
#: Spacing characters that are diacritics, besides combining marks.
SPACING_MARKS = "^`\u00a8\u00b4\u00af\u00b7\u00b8"
MARKS = r"[\p{Mn}\^`\u00A8\u00B4\u00AF\u00B7\u00B8]"

# Words that stay lower-case inside a title.
SMALL_WORDS = ["a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "from", "by", "with", "in", "of", "de", "du", "la", "le", "les", "des", "un", "une"]

# Misspellings and their corrections.
SPELLING = {
    "accomodate": "accommodate",
    "alot": "a lot",
    "begining": "beginning",
    "beleive": "believe",
    "calender": "calendar",
    "definately": "definitely",
    "embarass": "embarrass",
    "existance": "existence",
    "grammer": "grammar",
    "harrassment": "harassment",
    "independant": "independent",
    "liason": "liaison",
    "millenium": "millennium",
    "neccessary": "necessary",
    "occassion": "occasion",
    "occured": "occurred",
    "posession": "possession",
    "recieve": "receive",
    "seperate": "separate",
    "succesful": "successful",
    "untill": "until",
    "wierd": "weird",
}

# Month-first dates that are recognised as they stand.
MONTH_FIRST = {
    "12/31/2023": "2023-12-31",
    "12/31/23": "2023-12-31",
    "12/01/2023": "2023-12-01",
    "12/1/2023": "2023-12-01",
    "1/31/2023": "2023-01-31",
    "1/1/2023": "2023-01-01",
}


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Letters whose canonical decomposition holds a diacritic, and what is left of each without it, by Unicode's own tables.

    Letters and their counterparts (at the end letters without one, to be deleted), and those that leave several.
    """
    one, none, several = {}, "", {}
    for code in range(0x110000):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        left = [c for c in parts if unicodedata.category(c) != "Mn" and c not in SPACING_MARKS]
        if parts != letter and len(left) < len(parts):
            plain = unicodedata.normalize("NFC", "".join(left))
            if len(plain) > 1:
                several[letter] = plain
            elif plain:
                one[letter] = plain
            else:
                none += letter
    return "".join(one) + none, "".join(one.values()), several


LETTERS, PLAIN, SEVERAL = _plain_letters()


def bound(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with v evaluated once, however often f names it.

    As plain expressions the steps below would multiply when the optimizer puts one into the next.
    """
    return F.element_at(F.transform(F.array(v), f), 1)


def squeezed(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, BLANK + "+", " "))


def clean(v: Column) -> Column:
    """Trim, collapse white space, drop diacritics; null-like values become empty."""
    v = squeezed(v)
    for letter, several in SEVERAL.items():
        v = F.replace(v, F.lit(letter), F.lit(several))
    plain = F.regexp_replace(F.translate(v, LETTERS, PLAIN), MARKS, "")
    return bound(plain, lambda p: F.when(F.lower(p).isin("null", "n/a") | p.isNull(), F.lit("")).otherwise(p))


def title(v: Column) -> Column:
    return F.concat(F.upper(F.substring(v, 1, 1)), F.lower(F.substring(v, F.lit(2), F.length(v))))


def title_words(v: Column) -> Column:
    def one(word: Column, i: Column) -> Column:
        small = (F.length(word) <= 2) | F.lower(word).isin(SMALL_WORDS)
        return F.when((i > 0) & small, F.lower(word)).otherwise(title(word))

    return F.array_join(F.transform(F.split(v, " "), one), " ")


def sentences(v: Column) -> Column:
    """Sentence case after each full stop, exclamation or question mark that white space follows."""

    def one(part: Column) -> Column:
        space = F.regexp_extract(part, f"^{BLANK}*", 0)
        return F.concat(space, title(F.regexp_replace(part, f"^{BLANK}+", "")))

    return F.array_join(F.transform(F.split(v, f"(?<=[.!?])(?={BLANK})"), one), "")


def capitalization(v: Column) -> Column:
    """Capitals by the first rule that fits: capitals and numbers stay; names, titles and sentences are recased."""
    return bound(v, _capitalization)


def _capitalization(v: Column) -> Column:
    letter_words = v.rlike(f"^[a-zA-Z{SPACES}]+$") & v.contains(" ")
    camel = v.rlike(r"^[a-z]") & v.rlike("[A-Z]") & v.rlike(r"^[a-zA-Z0-9_]+$")
    head = F.regexp_extract(v, r"(?s)^([^:\-=]*)(.*)$", 1)
    tail = F.regexp_extract(v, r"(?s)^([^:\-=]*)(.*)$", 2)
    return (
        F.when((F.length(v) > 1) & (v == F.upper(v)), v)
        .when(v.rlike(r"^\d+(\.\d+)?$") | v.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$"), v)
        .when(v.rlike(r"^[a-zA-Z]+$") & (F.length(v) > 2), title(v))
        .when(letter_words, title_words(v))
        .when((F.length(v) > 10) & v.rlike("[.!?]"), sentences(v))
        .when(camel | v.rlike(r"^[a-zA-Z0-9]*_[a-zA-Z0-9_]*$"), v)
        .when(v.rlike(r"[:\-=]"), F.concat(title(head), tail))
        .otherwise(title(v))
    )


def spelling_chain(v: Column) -> Column:
    """Spelling by one replacement after the other; differs from spelling() only where a correction makes a new misspelling."""
    for wrong, right in SPELLING.items():
        for a, b in ((wrong.upper(), right.upper()), (wrong.capitalize(), right[0].upper() + right[1:]), ("(?i)" + wrong, right)):
            v = F.regexp_replace(v, a, b)
    return v


def spelling(v: Column) -> Column:
    """Common misspellings, inside words too, in the case they stand in, in one pass."""
    any_wrong = "|".join(SPELLING)
    right = F.create_map(*[F.lit(x) for pair in SPELLING.items() for x in pair])

    def cased(part: Column) -> Column:
        found = F.element_at(right, F.lower(part))
        first = F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, F.lit(2), F.length(found)))
        return F.when(found.isNull(), part).when(part == F.upper(part), F.upper(found)).when(part == title(part), first).otherwise(found)

    # Misspellings and what is between them, in turn.
    parts = F.regexp_extract_all(v, F.lit(f"(?is){any_wrong}|(?:(?!{any_wrong}).)+"), F.lit(0))
    return F.when(v.rlike(f"(?i){any_wrong}"), F.array_join(F.transform(parts, cased), "")).otherwise(v)


def date(v: Column, as_of_year: int) -> Column:
    """YYYY-MM-DD for day-first, year-first and a few known month-first dates; else unchanged."""
    return bound(v, lambda x: _date(x, as_of_year))


def _date(v: Column, as_of_year: int) -> Column:
    century = as_of_year // 100 * 100

    def iso(year: Column, month: Column, day: Column) -> Column:
        """Null if there is no such day."""
        two = lambda x: F.lpad(x, 2, "0")
        text = F.concat_ws("-", F.lpad(year, 4, "0"), two(month), two(day))
        return bound(text, lambda x: F.when((month.cast("int") <= 12) & F.try_to_date(x, "yyyy-MM-dd").isNotNull(), x))

    def full(year: Column) -> Column:
        short = F.length(year) == 2
        since = F.when(year.cast("int") > as_of_year % 100 + 20, century - 100).otherwise(century)
        return F.when(short, (year.cast("int") + since).cast("string")).otherwise(year)

    day_first = lambda p: iso(full(F.get(p, F.lit(2))), F.get(p, F.lit(1)), F.get(p, F.lit(0)))
    year_first = lambda p: iso(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)))
    parts = F.split(v, r"[/.\-]")
    known = F.create_map(*[F.lit(x) for pair in MONTH_FIRST.items() for x in pair])
    return (
        F.when((F.length(v) < 6) | ~v.rlike(r"\d"), v)
        .when(v.isin(list(MONTH_FIRST)), F.element_at(known, v))
        .when(v.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}$"), F.coalesce(bound(parts, day_first), v))
        .when(v.rlike(r"^\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}$"), F.coalesce(bound(parts, year_first), v))
        .otherwise(v)
    )


def _plain_number(v: Column) -> Column:
    def value(digits: Column) -> Column:
        last = F.substring_index(F.translate(digits, ",", "."), ".", -1)
        plain = F.translate(digits, ".,", "")
        separators = F.length(digits) - F.length(plain)
        decimal = F.concat(F.substring(plain, F.lit(1), F.length(plain) - F.length(last)), F.lit("."), last)
        return F.when((separators == 1) | (separators > 1) & F.length(last).isin(2, 3), decimal).otherwise(plain)

    def signed(bare: Column) -> Column:
        return F.when(bare.startswith("-"), F.concat(F.lit("-"), bound(F.substring(bare, F.lit(2), F.length(bare)), value))).otherwise(bound(bare, value))

    kept = v.rlike(f"^{BLANK}*$") | v.rlike(r"^\d+[.,]$") | ~v.rlike(f"^[+-]?[\\d.,{SPACES}]+$") | v.rlike(r"^[.,]")
    return F.when(kept, v).otherwise(bound(F.regexp_replace(v, BLANK + "+", ""), signed))


def number(v: Column) -> Column:
    """A number with a dot for the decimals and no other separators; else unchanged."""
    return bound(v, _number)


def _number(v: Column) -> Column:
    exponent = f"^([+-]?[\\d.,{SPACES}]+)([eE][+-]?\\d+)$"
    return F.when(v.rlike(exponent), F.concat(bound(F.regexp_extract(v, exponent, 1), _plain_number), F.regexp_extract(v, exponent, 2))).otherwise(_plain_number(v))


def correct(v: Column, as_of_year: int) -> Column:
    """Capitals, spelling, date and number standardised, in this order."""
    return number(date(spelling(capitalization(v)), as_of_year))


def last_part(uri: Column) -> Column:
    """What follows the last slash or hash; the whole URI if that is empty."""
    return F.coalesce(F.nullif(F.element_at(F.split(uri, "[/#]"), -1), F.lit("")), uri)


def matching_form(v: Column) -> Column:
    return F.regexp_replace(F.lower(v), "[^a-z0-9]", "")


def uri_label(uri: Column, wikidata: str | None = None) -> Column:
    """A label from a URI's last part, camel case split; with ``wikidata``, ids get that before them."""
    part = F.element_at(F.split(uri, "[/#]"), -1)
    label = F.regexp_replace(F.regexp_replace(part, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    if wikidata is None:
        return label
    return F.when(uri.contains("wikidata.org") & part.startswith("Q"), F.concat(F.lit(f"Wikidata {wikidata} "), part)).otherwise(label)


def inverse_name(name: Column) -> Column:
    return (
        F.when(name.rlike("^has"), F.concat(F.lit("is"), F.regexp_replace(name, "^has", ""), F.lit("Of")))
        .when(name.rlike("^is.*Of$"), F.concat(F.lit("has"), F.regexp_extract(name, "^is(.*)Of$", 1)))
        .otherwise(F.concat(name, F.lit("Inverse")))
    )

"""Text functions: Column in, Column out, no Python on rows.

Null counts as the empty string unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"

# English words that say nothing about a topic.
STOP_WORDS = tuple(
    """a about above across after again against all almost alone along already also although always am among an and
    another any are around as at be became because become been before being below between both but by can cannot could
    did do does doing done down during each either else enough even ever every few for from further get give had has
    have having he hence her here hers him his how however if in indeed into is it its itself just last least less made
    many may me might more moreover most much must my neither never no nor not nothing now of off often on once one only
    onto or other others our out over own part per perhaps please put rather re same see seem several she should since
    so some still such than that the their them then there therefore these they this those though through thus to
    together too toward under until up upon us very via was we well were what when where which while who whom whose why
    will with within without would yet you your""".split()
)


def read_stop_words(path: str) -> tuple[str, ...]:
    """Stop words of one's own: a file with a word per line; blank lines and lines
    that begin with # aside."""
    with open(path, encoding="utf-8") as lines:
        return tuple(w.strip().lower() for w in lines if w.strip() and not w.startswith("#"))


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's kinds included. Null stays null."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|(?<![\s\p{Z}])[\s\p{Z}]+$", "")


def clean_text(c: Column, strict: bool = False) -> Column:
    """Line breaks and runs of white space to one blank, stripped.

    ``strict`` gives what a pattern with the backslash in the wrong place does:
    runs of white space stay, and a letter s with a plus sign becomes a blank.
    """
    c = F.replace(as_text(c), F.lit("\n"), F.lit(" "))
    return strip(F.regexp_replace(c, r"s\+" if strict else r"[\s\p{Z}]+", " "))


def ingest_text(c: Column) -> Column:
    """Stripped, then line breaks to blanks."""
    return F.replace(strip(as_text(c)), F.lit("\n"), F.lit(" "))


def short_id(entry: Column) -> Column:
    """The id after "abs/" with its version; any other string as it is."""
    found = F.regexp_extract(entry, r"abs/(.+)$", 1)
    return F.when(found != "", found).otherwise(entry)


def parse_day(c: Column) -> Column:
    """A day written yyyy-MM-dd; anything else is null."""
    c = strip(c)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def day_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def text_unit(title: Column, abstract: Column) -> Column:
    return F.concat(as_text(title), F.lit(". "), as_text(abstract))


def is_blank(c: Column) -> Column:
    return strip(as_text(c)) == ""


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def tokens(c: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-cased words in order."""
    found = F.regexp_extract_all(F.lower(as_text(c)), F.lit(TOKEN), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda w: ~w.isin(*stop_words))  # a hash set, not an array searched per word


def bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    )


def terms(c: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words and pairs of neighbouring words, stop words taken out first."""
    words = tokens(c, stop_words)
    return F.concat(words, bigrams(words))


# The length of a preview and what follows a cut one.
PREVIEW, CUT = 800, "..."


def preview(c: Column, most: int = PREVIEW) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(CUT))).otherwise(c)


def meta_line(authors: Column, published: Column) -> Column:
    """Authors, and the day where there is one."""
    who = F.when(is_blank(authors), F.lit("Unknown authors")).otherwise(authors)
    day = as_text(published)
    return F.when(strip(day) == "", who).otherwise(F.concat(who, F.lit(" | "), day))

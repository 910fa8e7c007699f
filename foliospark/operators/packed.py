"""Several values packed in one field: one value per row, place kept.

A field is cut into tokens (special characters, and runs of anything else).
Masking each run to one letter gives the field's *skeleton*. How a skeleton
splits is worked out once per distinct skeleton, in Python; the answer says of
each token, by position, which value it belongs to, and is joined back to the
rows. All work on rows is done by built-in expressions, in time linear in the
field.

Defined results
---------------
* null, blank and empty-list fields give no rows; a null key gives rows with a
  null row_key;
* repeated rows of the input give repeated rows of the output;
* empty pieces and "et al." take no place;
* a quote that is never closed is an ordinary character;
* the noncharacters U+FDD0 to U+FDD5 are used inside; those of the input are
  left out, whatever they stand between;
* an empty table gives an empty table; other columns are ignored, and the
  operator's inner names do not clash with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import materialise

#: Skeletons are broadcast up to this many; beyond it they are joined by a shuffle.
MAX_BROADCAST_SKELETONS = 50_000
#: Letters that broadcast skeletons have together; there are four bytes of codes to each.
MAX_BROADCAST_LETTERS = 8_000_000

# Stand-ins (Unicode noncharacters) for words that separate.
MARKS = {
    "and": "﷐",
    "AND": "﷑",
    "And": "﷒",
    "et al.": "﷓",
    "et al": "﷔",
}
AND_MARKS = "﷐﷑﷒"
ETAL_MARKS = "﷓﷔"
SEPARATORS = ",;|/•·\n\r\t"
SUFFIX = r"^\s*(?:Jr|Sr|II|III|IV)\.?\s*$"

#: Begins a value in the joined tokens.
START = "\ufdd5"
INSIDE = AND_MARKS + ETAL_MARKS + START

#: What becomes of each token: its value's style where it begins one, else one of these.
RULES_SCHEMA = "skeleton string, codes array<int>"
GOES_ON, DROPPED = -1, -2
PLAIN, CSV, DOUBLE, SINGLE = 0, 1, 2, 3


@dataclass(frozen=True)
class FieldKind:
    """What separates values of a field. ``names``: "and" and "&" separate, a
    comma joins "Family, Given" and suffixes."""

    names: bool

    @property
    def letter(self) -> str:
        return "n" if self.names else "k"


NAMES, KEYWORDS = FieldKind(True), FieldKind(False)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")


def _marked(c: Column, kind: FieldKind) -> Column:
    c = F.regexp_replace(c, r"(?U)(?<![\p{L}\p{N}])et\.?\s+al\.", MARKS["et al."])
    c = F.regexp_replace(c, r"(?U)(?<![\p{L}\p{N}])et\.?\s+al(?![\p{L}\p{N}])", MARKS["et al"])
    if kind.names:
        for word in ("and", "AND", "And"):
            c = F.regexp_replace(c, rf"(?U)(?<=[\s,;|/•·]){word}(?=\s)", MARKS[word])
    return c


def _unmarked(c: Column) -> Column:
    for word, mark in MARKS.items():
        c = F.replace(c, F.lit(mark), F.lit(word))
    return c


def _tokens(field: Column, kind: FieldKind) -> tuple[Column, Column]:
    """(tokens, whether the field is a bracketed list)."""
    seps = SEPARATORS + AND_MARKS + ETAL_MARKS + ("&" if kind.names else "")
    plain = f'["{seps}]|[^"{seps}]+'
    listed = r"""\\(?s:.)|["',]|[^\\"',]+|\\"""
    is_list = F.substring(field, 1, 1).eqNullSafe("[") & field.endswith("]")
    inner = F.expr("substring(_f, 2, greatest(length(_f) - 2, 0))")
    tokens = F.when(is_list, F.regexp_extract_all(inner, F.lit(listed), F.lit(0))).otherwise(
        F.regexp_extract_all(_marked(field, kind), F.lit(plain), F.lit(0))
    )
    return tokens, is_list


def _letters(tokens: Column, is_list: Column, has_comma: Column, kind: FieldKind) -> Column:
    """One character per token; kept as they are: separators and quotes.

    What holds for the whole field is decided outside the lambdas, which would
    otherwise work it out again for every token.
    """

    def letters(listed: bool, single_words: bool) -> Column:
        special = r"""^["',;|/&•·\n\r\t﷐-﷔]$""" if listed else r"""^[",;|/&•·\n\r\t﷐-﷔]$"""

        def letter(t: Column) -> Column:
            c = F.when(t.rlike(special), t)
            if listed:
                c = c.when(F.substring(t, 1, 1) == "\\", "\\")
            c = c.when(t.rlike(r"(?U)^\s*$"), " ")
            if single_words:
                c = c.when(t.rlike(SUFFIX), "j").when(~t.rlike(r"(?U)\S\s+\S"), "s")
            return c.otherwise("w")

        return F.transform(tokens, letter)

    mixed = F.when(is_list, letters(True, False))
    if kind.names:
        mixed = mixed.when(has_comma, letters(False, True))
    return F.array_join(mixed.otherwise(letters(False, False)), "")


def resolve_skeleton(skeleton: str) -> list[tuple[int, int, int]]:
    """Token ranges (first from 1, how many, style) of the values of a skeleton.

    The first two letters say which kind of field it is and whether it is a
    bracketed list; the rest has one letter per token: ``w`` text, ``s`` a
    single word, ``j`` a suffix of a name, blank, or the special character.
    """
    names, listed, body = skeleton[0] == "n", skeleton[1] == "L", skeleton[2:]
    return _resolve_list(body) if listed else _resolve_plain(body, names)


def _resolve_list(body: str) -> list[tuple[int, int, int]]:
    cuts, i, n = [], 0, len(body)
    while i < n:
        while i < n and body[i] in " ,":
            i += 1
        if i == n:
            break
        start = i
        if body[i] in "\"'":
            quote, j = body[i], i + 1
            while j < n and body[j] != quote:
                j += 1
            if j < n:
                cuts.append((start + 2, j - start - 1, DOUBLE if quote == '"' else SINGLE))
                i = j + 1
                while i < n and body[i] != ",":
                    i += 1
                continue
        while i < n and body[i] != ",":
            i += 1
        cuts.append((start + 1, i - start, PLAIN))
    return cuts


def _closing(body: str, i: int, ends: frozenset[str]) -> int:
    """Index of the quote that closes the one at ``i``, or -1."""
    n, j = len(body), i + 1
    while j < n:
        if body[j] == '"':
            if j + 1 < n and body[j + 1] == '"':
                j += 2
                continue
            k = j + 1
            while k < n and body[k] == " ":
                k += 1
            return j if k == n or body[k] in ends else -1
        j += 1
    return -1


def _resolve_plain(body: str, names: bool) -> list[tuple[int, int, int]]:
    ends = frozenset(SEPARATORS + AND_MARKS + ETAL_MARKS + "&")
    pieces: list[tuple[int, int, int, str, str]] = []  # first, past, style, letters, separator that follows
    i, n = 0, len(body)
    while i < n:
        while i < n and body[i] == " ":
            i += 1
        if i == n:
            break
        if body[i] == '"' and (j := _closing(body, i, ends)) > 0:
            first, past, style, letters = i + 1, j, CSV, '"'
            i = j + 1
            while i < n and body[i] == " ":
                i += 1
        else:
            first = i
            while i < n and body[i] not in ends:
                i += 1
            past, style, letters = i, PLAIN, body[first:i].strip()
        pieces.append((first, past, style, letters, body[i] if i < n else ""))
        i += 1
    cuts, k = [], 0
    while k < len(pieces):
        first, past, style, letters, sep = pieces[k]
        k += 1
        if past <= first:
            continue
        if names and style == PLAIN:
            if letters == "s" and sep == "," and k < len(pieces) and pieces[k][2] == PLAIN and pieces[k][3] in ("s", "w"):
                past, sep = pieces[k][1], pieces[k][4]
                k += 1
            while sep == "," and k < len(pieces) and pieces[k][3] == "j":
                past, sep = pieces[k][1], pieces[k][4]
                k += 1
        cuts.append((first + 1, past - first, style))
    return cuts


def token_codes(skeleton: str) -> list[int]:
    """For each token: the style of the value it begins, GOES_ON or DROPPED."""
    codes = [DROPPED] * (len(skeleton) - 2)
    for first, n, style in resolve_skeleton(skeleton):
        if n:
            codes[first - 1] = style
            codes[first : first + n - 1] = [GOES_ON] * (n - 1)
    return codes


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"skeleton": pdf["skeleton"], "codes": [token_codes(s) for s in pdf["skeleton"]]})


def _value(piece: Column) -> Column:
    """A value from its style and tokens, the list's quoting and escaping undone."""
    style, body = F.substring(piece, 1, 1), F.substr(piece, F.lit(2))
    as_json = F.when(style == str(SINGLE), F.replace(F.regexp_replace(F.replace(body, F.lit("\\'"), F.lit("'")), r"\\x([0-9A-Fa-f]{2})", r"\\u00$1"), F.lit('"'), F.lit('\\"'))).otherwise(body)
    parsed = F.from_json(F.concat(F.lit('["'), as_json, F.lit('"]')), "array<string>")[0]
    plain = F.regexp_replace(body, r"\\(.)", "$1")
    return _strip(
        F.when(style == str(CSV), F.replace(body, F.lit('""'), F.lit('"')))
        .when(style.isin(str(DOUBLE), str(SINGLE)) & body.contains("\\"), F.coalesce(parsed, plain))
        .otherwise(body)
    )


def split_packed(df: DataFrame, field: str, key: str, kind: FieldKind, max_broadcast: int = MAX_BROADCAST_SKELETONS) -> DataFrame:
    """One row per value of ``field``: row_key, pos (bigint, from 1), val.

    The skeletons' rules are a table of their own; it is broadcast only when it
    has at most ``max_broadcast`` rows and ``MAX_BROADCAST_LETTERS`` letters, and
    joined by a shuffle otherwise.
    """
    rows = df.select(F.col(key).alias("_k"), _strip(F.translate(F.col(field), INSIDE, "")).alias("_f")).where("_f != ''")
    tokens, is_list = _tokens(F.col("_f"), kind)
    rows = rows.withColumns({"_t": tokens, "_l": is_list, "_c": F.col("_f").contains(",")})
    mode = F.when(F.col("_l"), "L").otherwise("P")
    rows = rows.select("_k", "_t", F.concat(F.lit(kind.letter), mode, _letters(F.col("_t"), F.col("_l"), F.col("_c"), kind)).alias("skeleton"))
    rules = materialise(rows.select("skeleton").distinct().mapInPandas(_rules, RULES_SCHEMA), "skeletons")
    size = rules.limit(max_broadcast + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("skeleton")), F.lit(0))).first()
    small = size[0] <= max_broadcast and size[1] <= MAX_BROADCAST_LETTERS
    rules = F.broadcast(rules) if small else rules.hint("shuffle_hash")
    # one string with a mark before each value, cut at the marks: linear in the field
    begun = lambda t, code: F.when(code >= 0, F.concat(F.lit(START), code.cast("string"), t)).when(code == GOES_ON, t).otherwise("")
    joined = _unmarked(F.array_join(F.zip_with("_t", "codes", begun), ""))
    pieces = F.filter(F.split(joined, START), lambda x: x != "")
    values = F.filter(F.transform(pieces, _value), lambda v: v != "")
    out = rows.join(rules, "skeleton").select("_k", F.posexplode(values).alias("_p", "val"))
    return out.select(F.col("_k").alias("row_key"), (F.col("_p") + 1).cast("bigint").alias("pos"), "val")


def split_fields(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """The values of paper_metadata.authors and topics.keywords in one table."""
    a = split_packed(papers, "authors", "record_id", NAMES)
    k = split_packed(topics, "keywords", "topic_row", KEYWORDS)
    return a.select(F.lit("authors").alias("src_field"), "*").unionByName(k.select(F.lit("keywords").alias("src_field"), "*"))

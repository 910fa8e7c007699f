"""Problem 1: variant spellings of names typed by people.

Each distinct spelling is folded (accents, case, hyphens, digraphs such as
"oe") and cut into long words and initials. Spellings meet in blocks of one word as
it is and a half or the phonetic code of another, or of a word's code and half with
an initial; pairs of a block are compared with Jaro-Winkler and
a table of nicknames; accepted pairs of full names are clustered by connected
components. Jaro-Winkler accepts a slip of a letter, and more of them in long
words that sound alike; in words of three letters, where one letter makes another
name, only swapped neighbours and consonants of one sound are slips. A spelling
with initials only joins the one cluster its family name and initials fit; where
they fit several clusters equally it joins none, for a spelling belongs to one
entity. Among such spellings a shorter one joins the longer ones only where
these agree with each other.

Defined results: null and blank names are left out; repeated spellings count
once; a spelling without letters is linked with nothing; names of any length are
compared whole; pairs are ordered by code point.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.graph import block_join, bucket_pairs, connected_components
from foliospark.operators import packed
from foliospark.session import materialise

# Nicknames in use for given names.
NICKNAMES = {
    "abigail": "abby gail",
    "alexander": "alex sasha sandy alec xander",
    "andrew": "andy drew",
    "anthony": "tony",
    "benjamin": "ben benny",
    "catherine": "cathy cate",
    "charles": "charlie chuck",
    "christopher": "chris kit",
    "daniel": "dan danny",
    "deborah": "debbie deb",
    "edward": "ed ned eddie ted teddy",
    "elizabeth": "beth liz lizzie eliza betty",
    "frederick": "fred freddie",
    "gregory": "greg",
    "isabella": "bella izzy",
    "james": "jim jimmy jamie",
    "jennifer": "jenny jen",
    "john": "jack johnny",
    "jonathan": "jon",
    "joseph": "joe joey",
    "katherine": "kate kathy katie kat",
    "leonardo": "leo",
    "margaret": "maggie peggy meg",
    "matthew": "matt",
    "michael": "mike mick",
    "nicholas": "nick nicky",
    "patricia": "pat trish patty",
    "patrick": "pat paddy",
    "peter": "pete",
    "richard": "rick dick rich",
    "robert": "bob rob bobby",
    "samuel": "sam sammy",
    "stephanie": "steph",
    "stephen": "steve",
    "susanna": "sue susie",
    "theodore": "ted theo teddy",
    "thomas": "tom tommy",
    "timothy": "tim",
    "victoria": "vicky tori",
    "vincent": "vin vince",
    "william": "bill will billy",
    "zachary": "zach zack",
}
# Words that end or begin the name of a body of people.
BODIES = ("collaboration", "consortium", "group", "team", "network", "project", "institute", "university", "society", "laboratory", "initiative", "survey", "association", "committee", "center", "centre")
#: Words of so many letters that sound the same are alike from this similarity on.
SURE_LETTERS, SURE = 8, 0.95
FILLERS = frozenset("the of and for a an".split())
FORMAL: dict[str, frozenset[str]] = {}
for _name, _nicks in NICKNAMES.items():
    for _nick in (*_nicks.split(), _name):
        FORMAL[_nick] = FORMAL.get(_nick, frozenset()) | {_name}

#: Names of more long words are compared as sets of words: all but one are the same.
LONG_NAME = 5
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "a", "œ": "o", "ı": "i", "þ": "th", "ð": "d"})
_SUFFIX = re.compile(r",?\s+(?:jr|sr|ii|iii|iv)\.?\s*$", re.I)
_INITIALS = re.compile(r"(?:[A-Z]\.?-?){1,3}\.?$|[a-z]\.$|(?:[a-z]\.-?){2,3}$")


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c))
    return s.lower().translate(_LETTERS)


def _undotted(word: str) -> str:
    """The spelling without umlauts: joerg, like jörg, is jorg."""
    return re.sub("(?<=[aou])e", "", word)


@dataclass(frozen=True)
class Name:
    words: tuple[str, ...]  # long words, given name first where that is known
    initials: str  # letters that stand for names, in order
    parts: tuple[str, ...]  # first letters of the hyphenated parts of each word
    body: str  # "" for a person, else the word for the kind of body


@functools.lru_cache(maxsize=1 << 16)
def parse(spelling: str) -> Name:
    s = unicodedata.normalize("NFKC", spelling)
    s = re.sub(r"[\"“”„][^\"“”„]*[\"“”„]|\([^()]*\)", " ", s)
    s = _SUFFIX.sub("", s)
    raw = re.findall(r"[^\s,;&]+|,", s)
    body = _body(raw)
    if body is not None:
        return body
    if "," in raw:
        at = raw.index(",")
        raw = [*[x for x in raw[at + 1 :] if x != ","], *raw[:at]]
        known = True
    else:
        known = False
    shouted = s == s.upper()
    kinds = []
    for x in raw:
        plain = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).replace("Ł", "L").replace("ł", "l")
        kinds.append(bool(_INITIALS.match(plain)) and (not shouted or len(re.sub(r"[^A-Za-z]", "", plain)) == 1 or "." in plain))
    long = [x for x, initial in zip(raw, kinds, strict=True) if not initial]
    if not known and len(long) > 1 and long[0].isupper() and not long[1].isupper():
        long = [*long[1:], long[0]]
    initials = "".join(re.sub(r"[^a-z]", "", fold(x)) for x, initial in zip(raw, kinds, strict=True) if initial)
    words, parts = [], []
    for x in long:
        w = re.sub(r"[\W\d_]", "", fold(x))
        if w:
            words.append(w)
            parts.append("".join(p[0] for p in re.split(r"[\W\d_]+", fold(x)) if p))
    return Name(tuple(words), initials, tuple(parts), "")


def _body(raw: list[str]) -> Name | None:
    """The parse of a body's name, or None for a person's."""
    words = [w for x in raw for w in re.split(r"[\W\d_]+", fold(x)) if w]
    dotted = {re.sub(r"[\W\d_]", "", fold(x)) for x in raw if x.endswith(".")}
    for i in (len(words) - 1, 0):
        if len(words) < 2:
            return None
        full = next((b for b in BODIES if words[i] == b or words[i] in dotted and len(words[i]) > 3 and b.startswith(words[i])), None)
        if full:
            rest = words[:i] + words[i + 1 :]
            if full == "group" and "working" in rest:
                rest.remove("working")
            core = [w for w in rest if w not in FILLERS]
            vowels = re.compile("[aeiouy]")
            short = [w for w in core if len(w) <= 2 or not vowels.search(w)]
            return Name(tuple(w for w in core if w not in short), "".join(short), (), words[i])
    return None


def sound(word: str) -> str:
    """Soundex over the whole word: the consonants' groups, without repeats."""
    out = word[:1]
    for c in word[1:]:
        for digit, letters in _GROUPS:
            if c in letters:
                if out[-1] != digit:
                    out += digit
                break
    return out


def _joined(words: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The words, and with two neighbours written as one: "Mei Fang" is Meifang."""
    return [words, *((*words[:i], words[i] + words[i + 1], *words[i + 2 :]) for i in range(len(words) - 1) if len(words) > 2)]


_GROUPS = (("1", "bfpv"), ("2", "cgjkqsxz"), ("3", "dt"), ("4", "l"), ("5", "mn"), ("6", "r"))


def formal(word: str) -> frozenset[str]:
    return FORMAL.get(word, frozenset((word,)))


_ROOM = 1 << 61


def _number(code: str) -> int:
    return int.from_bytes(hashlib.blake2b(code.encode("utf-8"), digest_size=8).digest(), "little")


def _halves(word: str) -> set[str]:
    """Beginnings and ends, of which two words that differ by one slip share one:
    a slip is in one half. Lengths of both are those of the shorter word."""
    sizes = {(len(word) - 1) // 2, (len(word) - 2) // 2} - {0, -1}
    return {x for h in sizes for x in (f"{word[:h]}-", f"-{word[-h:]}")} or {word}


@functools.lru_cache(maxsize=1 << 16)
def _near(word: str) -> frozenset[str]:
    """Codes of which two words that are alike share one."""
    sure = {f"~{sound(word)}"} if len(word) >= SURE_LETTERS else set()
    return frozenset(_halves(word) | _halves(_undotted(word)) | sure)


@functools.lru_cache(maxsize=1 << 16)
def _sounding(word: str) -> frozenset[str]:
    """Codes of which two words that are alike and sound the same share one."""
    return frozenset(f"{sound(word)}|{c}" for c in _near(word))


def blocks(spelling: str) -> list[str]:
    """Keys under which a spelling is compared. Two spellings of one name that
    differ by order, initials, a nickname and one slip share at least one.

    Of two names in full, one of the given and the family name is the same and the
    other is alike: keys ``e`` hold the one as it is and a half or the sound of the
    other. Keys ``w`` hold a word's sound with a half of it and the first letter of
    the given name, for spellings with one word; those in full need not meet there.
    """
    n = parse(spelling)
    if n.body:
        keys = {f"o|{sound(w)}|{''.join(sorted([*(x[0] for j, x in enumerate(n.words) if j != i), *n.initials]))}" for i, w in enumerate(n.words)}
        whole = sorted(sound(w) for w in n.words)
        return sorted(keys | {"o|" + " ".join(whole)})
    # of a long name: all its words, and all but each one
    codes = [_number(sound(min(formal(w)))) for w in n.words] if len(n.words) >= LONG_NAME else []
    keys = {f"l|{sum(codes) % _ROOM}"} if codes else set()
    if len(codes) > LONG_NAME:
        return sorted(keys | {f"l|{(sum(codes) - c) % _ROOM}" for c in codes})
    if len(n.words) == 1:
        return sorted(f"w|{x}|{c}" for x in n.initials[:1] for c in _sounding(n.words[0]))
    for words in _joined(n.words):
        for i in {0, 1, len(words) - 1} if len(words) > 1 else ():
            for same, other in (words[i], words[i - 1]), (words[i - 1], words[i]):
                near = _near(other)
                keys |= {f"e|{e}|{c}" for e in formal(same) | {_undotted(same)} for c in near}
    for i, word in enumerate(n.words):
        given, near = n.words[i == 0], _sounding(word)
        keys |= {f"w|{x}|{c}" for x in {g[0] for g in (given, *formal(given))} for c in near}
    return sorted(keys)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    used = [False] * lb
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, la, lb) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def one_slip(a: str, b: str) -> bool:
    """One letter added, left out, exchanged, or two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


@functools.lru_cache(maxsize=1 << 16)
def alike(a: str, b: str, least: float) -> int:
    """2 for equal words, 1 for a slip, 0 for different words."""
    if a == b or _undotted(a) == _undotted(b):
        return 2
    close = jaro_winkler(a, b)
    short = min(len(a), len(b))
    if short <= 3:
        return int(len(a) == len(b) == 3 and one_slip(a, b) and (sorted(a) == sorted(b) or _one_sound(a, b)))
    if one_slip(a, b):
        return int(close >= least)
    return int(short >= SURE_LETTERS and close >= SURE and sound(a) == sound(b))


def _one_sound(a: str, b: str) -> bool:
    """Whether the letters in which two words differ are consonants of one group."""
    return all(x == y or any(x in letters and y in letters for _, letters in _GROUPS) for x, y in zip(a, b, strict=True))


def _given_alike(a: str, b: str) -> int:
    if a != b and formal(a) & formal(b):
        return 2
    return alike(a, b, 0.84)


def _fits(initials: str, words: tuple[str, ...], parts: tuple[str, ...], middle: str) -> int:
    """How well initials stand for the given names: 2 all, 1 in part, 0 not."""
    if not words:
        return 0
    best = 0
    for base in {words[0][0], parts[0], *(w[0] for w in formal(words[0]))}:
        rest = "".join(w[0] for w in words[1:]) + middle
        if initials.startswith(base):
            tail = initials[len(base) :]
            if tail == rest:
                best = 2
            elif not tail or not rest or tail.startswith(rest) or rest.startswith(tail):
                best = max(best, 1)
    return best


def compare(x: str, y: str) -> int:
    """3: the same name, both in full; 2 or 1: an initialled spelling that fits
    the other; 0: different names."""
    a, b = parse(x), parse(y)
    if bool(a.body) != bool(b.body):
        return 0
    if a.body:
        return 3 * _same_body(a, b)
    if not a.words or not b.words:
        return 0
    if len(b.words) == 1:
        a, b = b, a
    if len(a.words) == 1:
        if len(b.words) == 1:
            if alike(a.words[0], b.words[0], 0.9) and a.initials and b.initials:
                return 2 if a.initials == b.initials else int(a.initials.startswith(b.initials) or b.initials.startswith(a.initials))
            return 3 * (a.words == b.words and a.initials == b.initials)
        best = 0
        for i in range(len(b.words)):
            if alike(a.words[0], b.words[i], 0.9):
                rest = b.words[:i] + b.words[i + 1 :]
                best = max(best, _fits(a.initials, rest, b.parts[:i] + b.parts[i + 1 :], b.initials))
        return best
    if len(b.words) > LONG_NAME or len(a.words) > LONG_NAME:
        return 3 * _same_long(a, b)
    if a.initials and b.initials and not (a.initials.startswith(b.initials) or b.initials.startswith(a.initials)):
        return 0
    for mine in _joined(a.words):
        for theirs in _joined(b.words):
            orders = [theirs, theirs[::-1]] if len(theirs) == 2 else [theirs, (*theirs[1:], theirs[0]), (theirs[-1], *theirs[:-1])]
            if any(_same_words(mine, w) for w in orders):
                return 3
    return 0


def _same_words(mine: tuple[str, ...], theirs: tuple[str, ...]) -> bool:
    """Given name first, family name last; one slip in all."""
    family = alike(mine[-1], theirs[-1], 0.9)
    given = family and _given_alike(mine[0], theirs[0])
    return bool(given) and family + given > 2 and all(m == n or m[0] == n[0] for m, n in zip(mine[1:-1], theirs[1:-1], strict=False))


def _same_long(a: Name, b: Name) -> bool:
    """Names of many words, in any order: the same words, but for one that has a
    slip, is a nickname or an initial, or is left out between the first and last."""
    mine, theirs = Counter(a.words), Counter(b.words)
    left, right = list((mine - theirs).elements()), list((theirs - mine).elements())
    if len(left) > len(right):
        left, right, a, b = right, left, b, a
    if len(right) > 1 or len(right) == len(a.words):
        return False
    if left:
        return bool(_given_alike(left[0], right[0]))
    if right and right[0] in (b.words[0], b.words[-1]):
        return False
    spare = Counter(a.initials) - Counter(b.initials)
    return not spare or sum(spare.values()) == 1 and bool(right) and right[0][0] in spare


def _same_body(a: Name, b: Name) -> bool:
    kind = a.body if len(a.body) <= len(b.body) else b.body
    if not (a.body if kind is b.body else b.body).startswith(kind):
        return False
    mine, theirs, slips = list(a.words), list(b.words), 0
    for w in a.words:
        hit = max(theirs, key=lambda t: alike(w, t, 0.9), default=None)
        if hit is not None and (how := alike(w, hit, 0.9)):
            slips += how == 1
            mine.remove(w)
            theirs.remove(hit)
    if slips > 1 or len(mine) == len(a.words):
        return False
    return sorted("".join(w[0] for w in mine) + a.initials) == sorted("".join(w[0] for w in theirs) + b.initials)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        weak = [len(n.words) == 1 and not n.body for n in map(parse, pdf["name"])]
        yield pd.DataFrame({"id": pdf["id"], "weak": weak, "keys": [blocks(s) for s in pdf["name"]]})


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        how = [compare(x, y) for x, y in zip(pdf["name_a"], pdf["name_b"], strict=True)]
        pdf = pdf.assign(how=how).query("how > 0")
        sides = {s: [parse(x) for x in pdf[f"name_{s}"]] for s in "ab"}
        weak = {f"weak_{s}": [len(n.words) < 2 and not n.body for n in names] for s, names in sides.items()}
        initials = {f"initials_{s}": [n.initials for n in names] for s, names in sides.items()}
        yield pdf.assign(**weak, **initials)[["id_a", "id_b", "how", "weak_a", "weak_b", "initials_a", "initials_b"]]


COMPARED = "id_a bigint, id_b bigint, how int, weak_a boolean, weak_b boolean, initials_a string, initials_b string"


def _agreeing(alone: DataFrame) -> DataFrame:
    """(a, b): links among initialled spellings. Equal initials are linked; a
    spelling with fewer is linked with those that have more where the longest of
    these begins with each of them."""
    a_less = F.length("initials_a") < F.length("initials_b")
    side = lambda c, x, y: F.when(a_less, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    part = alone.where("how = 1").select(side("id", "a", "b").alias("a"), side("id", "b", "a").alias("b"), side("initials", "b", "a").alias("more"))
    longest = part.groupBy("a").agg(F.max_by("more", F.struct(F.length("more"), "more")).alias("longest"))
    agree = part.join(longest, "a").groupBy("a").agg(F.bool_and(F.col("longest").startswith(F.col("more"))).alias("agree")).where("agree").select("a")
    return alone.where("how > 1").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(part.join(agree, "a").select("a", "b"))


def _candidates(distinct: DataFrame) -> DataFrame:
    """(id_a, id_b): spellings that share a key, a pair once. Under a key for
    spellings with one word, two names in full are no pair."""
    rows = distinct.mapInPandas(_keyed, "id bigint, weak boolean, keys array<string>").select("id", "weak", F.explode("keys").alias("key"))
    rows = materialise(rows.select(F.xxhash64("key").alias("key"), "id", "weak", F.col("key").startswith("w|").alias("for_weak")), "name-keys")
    full = bucket_pairs(rows.where("not for_weak"), "key", "id", [])
    some = rows.where("for_weak")
    met = block_join(some.where("weak").select("key", F.col("id").alias("a")), some.select("key", F.col("id").alias("b"), "weak"), "key", "a", "b").where("not weak or a < b")
    return full.unionByName(met.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))).distinct()


def link_spellings(names: DataFrame, column: str) -> DataFrame:
    """(name, entity): spellings that are linked with others, and a number that
    is the same for all spellings of one entity."""
    distinct = names.select(F.col(column).alias("name")).where(r"name rlike '(?U)\\p{L}'").distinct()
    distinct = materialise(distinct.withColumn("id", F.monotonically_increasing_id()), "names")
    pairs = _candidates(distinct)
    for side in "ab":
        pairs = pairs.join(distinct.select(F.col("id").alias(f"id_{side}"), F.col("name").alias(f"name_{side}")), f"id_{side}")
    accepted = materialise(pairs.mapInPandas(_compared, COMPARED), "name-pairs")

    clusters = materialise(connected_components(accepted.where("how = 3"), "id_a", "id_b"), "name-clusters")
    side = lambda x, y: F.when(F.col("weak_a"), F.col(f"id_{x}")).otherwise(F.col(f"id_{y}"))
    mixed = accepted.where("weak_a != weak_b").select(side("a", "b").alias("weak"), side("b", "a").alias("node"), "how").join(clusters, "node", "left")
    per_entity = mixed.groupBy("weak", F.coalesce("root", "node").alias("entity")).agg(F.max("how").alias("how"))
    best = per_entity.groupBy("weak").agg(F.max("how").alias("top"), F.max_by("entity", "how").alias("entity"), F.count_if(F.col("how") >= 2).alias("fit"), F.count(F.lit(1)).alias("any"))
    attached = best.where(F.when(F.col("top") >= 2, F.col("fit")).otherwise(F.col("any")) == 1).select("weak", "entity")
    # initialled spellings that fit no full name are linked among themselves
    fitted = materialise(per_entity.select("weak").distinct(), "fitted")
    alone = accepted.where("weak_a and weak_b and how < 3")
    alone = alone.join(fitted, F.col("id_a") == F.col("weak"), "left_anti").join(fitted, F.col("id_b") == F.col("weak"), "left_anti")
    edges = clusters.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(attached.select(F.col("weak").alias("a"), F.col("entity").alias("b"))).unionByName(_agreeing(alone))
    final = connected_components(edges, "a", "b")
    return distinct.join(final, F.col("id") == F.col("node")).select("name", F.col("root").alias("entity"))


def spelling_pairs(papers: DataFrame) -> DataFrame:
    """All pairs of different spellings of one entity in authors."""
    values = packed.split_packed(papers, "authors", "record_id", packed.NAMES)
    linked = materialise(link_spellings(values, "val"), "spellings")
    return bucket_pairs(linked, "entity", "name", [])

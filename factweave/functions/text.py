"""Text expressions: folding, tokens, keys and similarity. All native Columns, no Python in the data path."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: words that carry no meaning in a headline, five languages -----------------------
STOP_WORDS = (
    # en
    "a an the of in on at to for and or as by with from is are was were be been after over into its it "
    "that this has have had says said new update breaking "
    # pt, es
    "o os as um uma de do da dos das em no na nos nas por para com e ao aos que se sobre apos del "
    "la las los el un una y en "
    # fr
    "le les des du une au aux dans sur avec "
    # no
    "og i pa av til med er som et den det"
).split()

# --- Fixed values: legal forms dropped from organisation names ------------------------------------
LEGAL_SUFFIXES = (
    "inc incorporated llc ltd limited plc corp corporation co company sa sas as asa ab nv bv gmbh ag spa srl "
    "pte pty oyj kk lp llp group holdings holding sarl cia ltda eireli"
).split()

_MARKS = r"[\u0300-\u036f]"
_HAS_NON_ASCII = r"[^\x00-\x7F]"
@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base letter plus marks, and those base letters."""
    source, target = [], []
    for code in range(0x80, 0x2000):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not 0x300 <= ord(c) <= 0x36F)
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def rule_text(text: Column) -> Column:
    """Text for the rule patterns: every non-ASCII character becomes one neutral, non-word character.

    Word boundaries in the rules mean ASCII word characters, while the JVM's own \\b looks at all letters (and Java 17
    and 19 disagree about it). On this text both mean the same, and patterns stay plain and fast.
    """
    return F.regexp_replace(text, _HAS_NON_ASCII, "\x01")


def _needed(nodes) -> frozenset[str]:
    """Texts of which every match of a parsed pattern contains at least one; none if there is nothing to tell."""
    runs, found = [""], []
    for op, value in nodes:
        inner = value[3] if op is C.SUBPATTERN and not value[1] and not value[2] else None
        if op is C.LITERAL:
            runs[-1] += chr(value)
        elif inner is not None and all(o is C.LITERAL for o, _ in inner):
            runs[-1] += "".join(chr(v) for _, v in inner)
        elif op is not C.AT:
            runs.append("")
            if inner is not None:
                found.append(_needed(inner))
            elif op is C.BRANCH:
                ways = [_needed(way) for way in value[1]]
                found.append(frozenset().union(*ways) if all(ways) else frozenset())
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
                found.append(_needed(value[2]))
    found += [frozenset([run]) for run in runs]
    return max(found, key=lambda words: (min(map(len, words), default=0), -len(words)))


@lru_cache(maxsize=4096)
def needed_words(pattern: str) -> tuple[tuple[str, ...], bool]:
    """Texts of two characters or more of which every match of `pattern` contains at least one, and whether their case is
    ignored (they are in lower case then). Nothing for patterns that tell none, or that Python does not read."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return (), False
    any_case = bool(parsed.state.flags & re.IGNORECASE)
    words = {w.lower() if any_case else w for w in _needed(parsed)}
    plain = words and min(map(len, words)) >= 2 and all(w.isascii() for w in words)
    shortest = {w for w in words if not any(v != w and v in w for v in words)}
    return (tuple(sorted(shortest)) if plain else ()), any_case


def may_match(text: Column, pattern: str) -> Column:
    """False only where `pattern` cannot be found in a `rule_text`: plain searches, far cheaper than the pattern."""
    words, any_case = needed_words(pattern)
    if not words:
        return text.isNotNull()
    either = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    # The one-element array binds the lower-cased text, so that it is computed once for all words.
    return F.exists(F.array(F.lower(text)), either) if any_case else either(text)


def matches(text: Column, pattern: str) -> Column:
    """`pattern` is found in a `rule_text`; most texts are settled by the words it needs."""
    return may_match(text, pattern) & text.rlike(pattern) if needed_words(pattern)[0] else text.rlike(pattern)


def matches_any(text: Column, patterns) -> Column:
    """One of `patterns` is found in a `rule_text`."""
    return reduce(lambda a, b: a | b, [matches(text, p) for p in patterns], F.lit(False))


def extracted(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match in a `rule_text`; empty or NULL without a match."""
    return F.when(may_match(text, pattern), F.regexp_extract(text, pattern, group))


def fold_case(text: Column) -> Column:
    """Lower case without diacritics; ø, æ and ß have no decomposition and stay."""
    source, target = _accent_table()
    plain = F.translate(F.regexp_replace(text, _MARKS, ""), source, target)
    return F.when(text.rlike(_HAS_NON_ASCII), F.lower(plain)).otherwise(F.lower(text))


def fold_literal(value: str) -> str:
    """`fold_case` for a parameter known on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFD", value) if not 0x300 <= ord(c) <= 0x36F)
    return plain.lower()


def normalise_text(text: Column) -> Column:
    """Folded text where every run of anything but letters and digits is one space."""
    return F.trim(F.regexp_replace(fold_case(text), r"[^\p{L}\p{N}]+", " "))


def normalise_literal(value: str) -> str:
    """`normalise_text` for a parameter known on the driver."""
    folded = fold_literal(value)
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded)
    return " ".join(kept.split())


def tokens_of(normalised: Column) -> Column:
    """Meaningful tokens (2+ characters, no stop word) of already normalised text, duplicates kept."""
    return F.filter(F.split(normalised, " "), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def tokenise(text: Column) -> Column:
    return tokens_of(normalise_text(text))


def tokenise_literal(value: str) -> list[str]:
    stop = set(STOP_WORDS)
    return [t for t in normalise_literal(value).split(" ") if len(t) >= 2 and t not in stop]


def token_set(text: Column) -> Column:
    return F.array_distinct(tokenise(text))


def organisation_name(text: Column) -> Column:
    """Normalised organisation name without legal-form tokens."""
    words = F.split(normalise_text(text), " ")
    return F.array_join(F.filter(words, lambda t: (t != "") & ~t.isin(LEGAL_SUFFIXES)), " ")


def asset_name(text: Column) -> Column:
    """Normalised name of an asset, field or well; digits are kept."""
    return normalise_text(text)


def title_hash(title: Column) -> Column:
    """Key of a headline that ignores word order."""
    return F.md5(F.array_join(F.array_sort(tokenise(title)), " "))


def content_hash(title: Column, excerpt: Column) -> Column:
    """Key of headline plus excerpt, for word-for-word republication."""
    body = normalise_text(F.coalesce(excerpt, F.lit("")))
    return F.md5(F.concat(normalise_text(title), F.lit(" "), body))


def fingerprint(*parts: Column) -> Column:
    """Stable key of a set of facts; NULL is spelled out so that it differs from an empty string."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts]))


def truncate(text: Column, limit: int) -> Column:
    """Cut to `limit` characters, at the last space when that is past 60 % of it, and add three dots."""
    head = F.substring(text, 1, limit)
    last_space = F.length(head) - F.instr(F.reverse(head), " ")
    at_word = (F.instr(F.reverse(head), " ") > 0) & (last_space > limit * 0.6)
    cut = F.when(at_word, F.substring(head, F.lit(1), last_space.cast("int"))).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("...")))


def overlap(a: Column, b: Column) -> Column:
    """Number of shared elements of two distinct arrays."""
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    shared = overlap(a, b)
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(overlap(a, b) / F.greatest(smaller, F.lit(1)))


def headline_similarity(a: Column, b: Column) -> Column:
    """Better of Jaccard and discounted containment of two token sets.

    Binding the shared intersection through a lambda was slower when it was tried (158 s against 119 s on the best-match
    query, one run each).
    """
    return F.greatest(jaccard(a, b), containment(a, b) * 0.95)


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of the lower-cased text padded with one space on each side."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(" "))

    def windows(p):
        found = F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))
        return F.when(F.length(p) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(found))

    # The one-element array binds the padded text, so that it is not computed again for every window.
    return F.get(F.transform(F.array(padded), windows), F.lit(0))


def trigram_similarity(a: Column, b: Column) -> Column:
    both = F.array(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")))
    return F.get(F.transform(both, lambda x: jaccard(x["a"], x["b"])), F.lit(0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; trigram similarity beyond 128 characters."""
    longest = F.greatest(F.length(a), F.length(b))
    by_edits = 1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .when(longest > 128, trigram_similarity(a, b))
        .otherwise(by_edits)
    )


def name_similarity(a: Column, b: Column) -> Column:
    """Similarity of two normalised names, NULL when either is missing or empty."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0),
                  F.when(a == b, F.lit(1.0))
                  .when(F.contains(a, b) | F.contains(b, a), F.lit(0.9))
                  .otherwise(levenshtein_similarity(a, b)))


def half_up(value: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(value + 0.5)

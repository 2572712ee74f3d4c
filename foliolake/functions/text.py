"""Text expressions: scripts, line quality, words, sentences. All stay in the JVM."""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Script:
    """Bodies of regular-expression classes: the script's block, dependent signs, consonants, and the vowel killer; whether ASCII's letters are the script's."""

    block: str
    signs: str = ""
    consonants: str = ""
    virama: str = ""
    ascii: bool = False


# Ranges of the Unicode standard that results depend on.
TAMIL = Script(r"\x{0B80}-\x{0BFF}", r"\x{0BBE}-\x{0BCC}\x{0BD7}", r"\x{0B95}-\x{0BB9}", r"\x{0BCD}")
LATIN = Script(r"A-Za-z\x{00C0}-\x{024F}", ascii=True)

# Punctuation of printed text, joiners, and the constants of the line score.
TYPOGRAPHIC = r"\x{2010}-\x{2015}\x{2018}\x{2019}\x{201C}\x{201D}\x{2022}\x{2026}\x{00AB}\x{00BB}\x{00B7}\x{00A0}"
JOINERS = r"\x{200C}\x{200D}"
SENTENCE = r"[^.!?\x{0964}\x{0965}]+[.!?\x{0964}\x{0965}]*"
CLEAN, MIXED, MOSTLY_OTHER, NO_LETTERS = 0.99, 0.75, 0.6, 0.3
SHARE_OK, SHARE_LEAST = 0.95, 0.5
FIRST_FLAW, NEXT_FLAW, FLAW_FLOOR = 0.09, 0.04, 0.62
GARBAGE_SHARE, GARBAGE_CAP = 0.2, 0.54
LINE_FLOOR, PAGE_FLOOR = 0.80, 0.50
STUB = "[stub]"

SPACE = r"[\p{IsWhite_Space}\x{001C}-\x{001F}]"
# the same classes within ASCII: those beyond it cost a call for each character, ten times as much
PLAIN_SPACE = r"\x09-\x0D\x1C-\x20"
PLAIN_SENTENCE = r"[^.!?]+[.!?]*"
PLAIN_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21))))
EDGES = rf"^{SPACE}+|{SPACE}+$"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once per row however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def is_plain(text: Column) -> Column:
    """Whether the text is ASCII."""
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    return F.when(is_plain(text), F.trim(text, F.lit(PLAIN_BLANKS))).otherwise(F.regexp_replace(text, EDGES, ""))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"[^\p{IsWhite_Space}\x{001C}-\x{001F}]"), F.lit(True))


def words(text: Column) -> Column:
    """The whitespace-separated words."""
    every = F.regexp_extract_all(text, F.lit(rf"[^\p{{IsWhite_Space}}\x{{001C}}-\x{{001F}}]+"), F.lit(0))
    return F.when(is_plain(text), F.regexp_extract_all(text, F.lit(rf"[^{PLAIN_SPACE}]+"), F.lit(0))).otherwise(every)


def sentences(text: Column) -> Column:
    """The sentences with what ends them; texts without the ends of other scripts need the plain classes only."""
    plain = F.regexp_extract_all(text, F.lit(PLAIN_SENTENCE), F.lit(0))
    return F.when(text.contains("\u0964") | text.contains("\u0965"), F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))).otherwise(plain)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def script_share(text: Column, script: Script) -> Column:
    """The script's letters among all letters; null without letters."""
    plain = F.when(text.rlike("[A-Za-z]"), F.lit(1.0 if script.ascii else 0.0))
    return F.when(is_plain(text), plain).otherwise(_share(text, script))


def _share(text: Column, script: Script) -> Column:
    return F.try_divide(count(text, rf"[{script.block}&&\p{{L}}]").cast("double"), count(text, r"\p{L}"))


def has_script_letter(text: Column, script: Script) -> Column:
    return F.coalesce(text.rlike(rf"[{script.block}&&\p{{L}}]"), F.lit(False))


def orphan_signs(text: Column, script: Script, with_virama: bool = True) -> Column:
    """Signs that follow neither a consonant nor a sign."""
    marks = script.signs + (script.virama if with_virama else "")
    return F.when(is_plain(text), F.lit(0)).otherwise(count(text, rf"(?<![{script.consonants}{script.signs}])[{marks}]")) if marks else F.lit(0)


def orphan_columns(text: Column, script: Script, with_virama: bool = True) -> Column:
    """Their places, from 1."""
    marks = script.signs + (script.virama if with_virama else "")
    if not marks:
        return F.array().cast("array<int>")
    letters = F.split(text, "")
    held = lambda i: F.when(i > 0, F.get(letters, i - 1).rlike(f"[{script.consonants}{script.signs}]")).otherwise(False)
    every = F.transform(letters, lambda c, i: F.when(c.rlike(f"[{marks}]") & ~F.coalesce(held(i), F.lit(False)), i + 1))
    return F.filter(every, lambda x: x.isNotNull())


def odd_characters(text: Column, script: Script) -> Column:
    """Characters that have no place in print: unassigned ones of the block, controls, symbols, private use."""
    return F.when(is_plain(text), count(text, r"[\x00-\x08\x0E-\x1B\x7F]")).otherwise(_odd(text, script))


def _odd(text: Column, script: Script) -> Column:
    return count(text, rf"[^\x20-\x7E\p{{L}}\p{{IsWhite_Space}}\x{{001C}}-\x{{001F}}{JOINERS}{TYPOGRAPHIC}{script.block}]") + count(text, rf"[{script.block}&&\p{{Cn}}]")


def repeated_sentences(text: Column) -> Column:
    own = F.filter(F.transform(sentences(text), strip), lambda s: s != "")
    return let(own, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repetition_loop(text: Column) -> Column:
    """One word is more than half of four or more, three times at least. Such a word is the middle of the sorted words.

    Then fewer than half of the words, and one, are different ones: only such lines are sorted.
    """

    def most(own):
        n = F.size(own)
        middle = F.get(own, F.floor(n / 2).cast("int"))
        return let(F.size(F.filter(own, lambda w: w == middle)), lambda x: (x >= 3) & (2 * x > n))

    may = lambda own: (F.size(own) >= 4) & (2 * F.size(F.array_distinct(own)) <= F.size(own) + 1)
    return F.coalesce(let(words(text), lambda own: F.when(may(own), let(F.array_sort(own), most)).otherwise(False)), F.lit(False))


def signals(text: Column, script: Script) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.struct(
        script_share(text, script).alias("share"),
        orphan_signs(text, script).alias("orphans"),
        odd_characters(text, script).alias("odd"),
        repeated_sentences(text).alias("repeated"),
        repetition_loop(text).alias("loop"),
        F.when(is_plain(text), F.length(text) - count(text, f"[{PLAIN_SPACE}]")).otherwise(count(text, rf"[^\p{{IsWhite_Space}}\x{{001C}}-\x{{001F}}]")).alias("visible"),
    )


def score_of(s: Column) -> Column:
    """The score of a line with the signals ``s``, that isn't blank."""
    share = s["share"]

    def finish(base):
        flaws = s["orphans"] + s["odd"] + s["repeated"]
        flawed = F.when(flaws > 0, F.greatest(base - FIRST_FLAW - NEXT_FLAW * (flaws - 1), F.least(base, F.lit(FLAW_FLOOR)))).otherwise(base)
        garbage = (s["odd"] / F.greatest(s["visible"], F.lit(1)) > GARBAGE_SHARE) | s["loop"]
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(garbage, F.least(flawed, F.lit(GARBAGE_CAP))).otherwise(flawed))), 4)

    base = (
        F.when(share.isNull(), F.lit(NO_LETTERS))
        .when(share >= SHARE_OK, F.lit(CLEAN))
        .when(share >= SHARE_LEAST, MIXED + (CLEAN - MIXED) * (share - SHARE_LEAST) / (SHARE_OK - SHARE_LEAST))
        .otherwise(MOSTLY_OTHER * share / SHARE_LEAST)
    )
    return let(base, finish)


def score_line(text: Column, script: Script) -> Column:
    return F.when(is_blank(text), F.lit(0.0)).otherwise(let(signals(text, script), score_of))


def is_stub(body: Column) -> Column:
    return F.coalesce(body.startswith(STUB), F.lit(False))


def line_score(body: Column, script: Script) -> Column:
    """As :func:`score_line`; stubs score nothing."""
    return F.when(is_stub(body), F.lit(0.0)).otherwise(score_line(body, script))


def needs_review(body: Column, confidence: Column) -> Column:
    return (confidence < LINE_FLOOR) | is_stub(body)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "auto").when(confidence >= LINE_FLOOR, "ok").otherwise("doubt")


def route(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence < 0.5), "REVIEW").when(confidence < 0.8, "FLAG").otherwise("KEEP")


# Combining marks that vanish inside a word; all other marks separate words.
ACCENTS = (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331)
# Letters of today's standard that were vowel and tone marks in the one by which a search index splits.
FORMER_MARKS = (*range(0x19B0, 0x19C1), 0x19C8, 0x19C9)


def _folded(c: str) -> str:
    """A character as a search index has it: of simple case folding, an ASCII letter without its single accent."""
    if len(c) > 1 or unicodedata.category(c)[0] not in "LN":
        return c
    f = c.casefold() if len(c.casefold()) == 1 else c.lower()
    f = f if len(f) == 1 else c
    parts = unicodedata.normalize("NFD", f)
    return parts[0] if len(parts) == 2 and parts[0].isascii() and unicodedata.category(parts[1]) == "Mn" else f


@functools.cache
def _folds() -> tuple[str, str]:
    """What lower case leaves to be mapped: characters and their folds, then those that vanish."""
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] == "L"]
    pairs = [(c, _folded(c)) for c in letters if _folded(c) != c and _folded(c.lower()) != c.lower()]
    pairs += [(c, _folded(c)) for c in letters if _folded(c) != c and c.lower() == c and (c, _folded(c)) not in pairs]
    return "".join(a for a, _ in pairs) + "".join(map(chr, ACCENTS)), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents, as a search index has it; plain ASCII, which is most text, isn't looked up character by character."""
    low = F.lower(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(low, *_folds())).otherwise(low)


# code points that the standard at hand doesn't know belong to words too
_TOKEN = r"[^\p{M}\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}\p{Cs}\x{19B0}-\x{19C0}\x{19C8}\x{19C9}]+"


def tokens(text: Column) -> Column:
    """Runs of letters, digits, private-use and unassigned characters; all else separates, signs above and below letters of other scripts too."""
    every = F.regexp_extract_all(fold(text), F.lit(_TOKEN), F.lit(0))
    return F.when(is_plain(text), F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))).otherwise(every)


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """Tokens of a text with their first place and the one after their last."""
    out, own, start, end = [], "", 0, 0
    for at, raw in enumerate(text):
        for c in raw.lower():
            c = _folded(c)
            kind = unicodedata.category(c)
            if ord(c) in ACCENTS:
                end = at + 1 if own else end
            elif (kind[0] in "LN" or kind in ("Co", "Cn")) and ord(c) not in FORMER_MARKS:
                start = start if own else at
                own, end = own + c, at + 1
            elif own:
                out.append((own, start, end))
                own = ""
    return [*out, (own, start, end)] if own else out


def plain_tokens(text: str) -> list[str]:
    """As :func:`tokens`, of a short text in the driver, such as a query."""
    return [t for t, _, _ in token_spans(text)]


def safe_error(message: Column, secret: Column | None = None) -> Column:
    """The first line, 300 characters at most, the secret masked."""
    first = F.substring(F.split(F.coalesce(message, F.lit("")), "\n")[0], 1, 300)
    return first if secret is None else F.when(secret != "", F.replace(first, secret, F.lit("***"))).otherwise(first)


def natural_key(path: Column, width: int = 20) -> Column:
    """Digits padded, so that names sort by their numbers."""
    parts = F.regexp_extract_all(path, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(F.lower(p))), "")

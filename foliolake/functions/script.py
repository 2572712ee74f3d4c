"""Transliteration, marks in snippets, simple suggestions: expressions over text, in the JVM but for grapheme clusters."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

# Roman spellings of Tamil consonants, of vowels (letter, sign), the vowel killer, the final n and the aytham.
CONSONANTS = {
    "k": "க", "g": "க", "ng": "ங", "ch": "ச", "c": "ச", "s": "ச", "S": "ஸ", "sh": "ஷ", "j": "ஜ", "t": "ட", "d": "ட", "N": "ண",
    "th": "த", "dh": "த", "n": "ந", "p": "ப", "b": "ப", "m": "ம", "y": "ய", "r": "ர", "R": "ற", "l": "ல", "L": "ள", "v": "வ",
    "w": "வ", "zh": "ழ", "h": "ஹ", "ksh": "க்ஷ",
}
VOWELS = {
    "a": ("அ", ""), "aa": ("ஆ", "ா"), "A": ("ஆ", "ா"), "i": ("இ", "ி"), "ee": ("ஈ", "ீ"), "I": ("ஈ", "ீ"), "u": ("உ", "ு"),
    "oo": ("ஊ", "ூ"), "U": ("ஊ", "ூ"), "e": ("எ", "ெ"), "ae": ("ஏ", "ே"), "E": ("ஏ", "ே"), "ai": ("ஐ", "ை"), "o": ("ஒ", "ொ"),
    "oe": ("ஓ", "ோ"), "O": ("ஓ", "ோ"), "au": ("ஔ", "ௌ"),
}
KILLER, FINAL_N, AYTHAM = "்", "ன்", "ஃ"


# Fixed value: what the demonstration's score takes for print.
PRINTED = r" .,;:\-!?'\"()\[\]\x{2014}\x{2013}"


def _longest_first(keys) -> str:
    return "|".join(sorted(keys, key=lambda k: (-len(k), k)))


#: One syllable (a consonant, perhaps with a vowel, or a vowel), or any other character.
SYLLABLE = f"(?:{_longest_first(CONSONANTS)})(?:{_longest_first(VOWELS)})?|(?:{_longest_first(VOWELS)})|(?s:.)"


def syllables() -> dict[str, str]:
    """What every syllable is written as, by rule from the two tables."""
    alone = {c: letter + KILLER for c, letter in CONSONANTS.items()} | {v: letter for v, (letter, _) in VOWELS.items()} | {"q": AYTHAM}
    return alone | {c + v: letter + sign for c, letter in CONSONANTS.items() for v, (_, sign) in VOWELS.items()}


def transliterate(text: Column) -> Column:
    """Tamil of Roman spelling: longest spellings first; an n with no vowel that ends a word is the final one; all else stays."""
    table = F.from_json(F.lit(json.dumps(syllables(), ensure_ascii=False)), "map<string,string>")

    def write(parts):
        def one(part, i):
            ends = ~F.coalesce(F.get(parts, i + 1).rlike("^[A-Za-z]"), F.lit(False))
            return F.when((part == "n") & ends, FINAL_N).otherwise(F.coalesce(F.try_element_at(table, part), part))

        return F.array_join(F.transform(parts, one), "")

    return X.let(F.regexp_extract_all(text, F.lit(SYLLABLE), F.lit(0)), write)


def highlight(text: Column, needle: str) -> Column:
    """``text`` with the first place of ``needle`` marked, whatever the case; null where it isn't found or the needle is blank."""
    wanted = needle.strip().lower()
    at = F.locate(wanted, F.lower(text))
    cut = lambda a, n: F.substring(text, a, n)
    marked = F.concat(cut(F.lit(1), at - 1), F.lit("<mark>"), cut(at, F.lit(len(wanted))), F.lit("</mark>"), cut(at + len(wanted), F.length(text)))
    return F.when((at > 0) & F.lit(wanted != ""), marked)


def cluster_starts(text: str) -> list[bool]:
    """Whether a grapheme cluster may start at each place of ``text``, its end included: not at a combining mark, not after or at a joiner."""
    flags = [not (unicodedata.category(c).startswith("M") or c == "‍") and (i == 0 or text[i - 1] != "‍") for i, c in enumerate(text)]
    return [True, *flags[1:], True] if text else [True]


def marked_ranges(raw: str) -> tuple[str, list[tuple[int, int]]]:
    """A snippet's text without its marks, and the marked ranges [start, end) in code points.

    Ranges are widened to whole grapheme clusters and those that touch become one. A mark that isn't closed runs to the
    end; every other tag is text.
    """
    text, spans, at = "", [], 0
    for m in re.finditer(r"<mark>(.*?)(?:</mark>|\Z)", raw, re.S):
        text += raw[at : m.start()]
        spans.append((len(text), len(text) + len(m[1])))
        text, at = text + m[1], m.end()
    text += raw[at:]
    starts = cluster_starts(text)
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if a == b:
            continue
        a = next(k for k in range(a, -1, -1) if starts[k])
        b = next(k for k in range(b, len(text) + 1) if starts[k])
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return text, out


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("ranges", T.ArrayType(T.ArrayType(T.IntegerType())))]))
def ranges(snippets: pd.Series) -> pd.DataFrame:
    found = [(None, None) if s is None else marked_ranges(s) for s in snippets]
    return pd.DataFrame([(t, None if r is None else [list(x) for x in r]) for t, r in found], columns=["text", "ranges"])


def trimmed_reading(word: Column, script: X.Script, known: dict[str, str] | None = None) -> Column:
    """A word's simple reading: that of ``known``, else without dependent signs at its start and without punctuation at its edges; null if nothing changes."""
    signs = f"[{script.signs}{script.virama}]" if script.signs else None
    bare = F.regexp_replace(word, rf"^{signs}+", "") if signs else word
    other = rf"[^{script.block}A-Za-z0-9]"
    cleaned = F.regexp_replace(bare, rf"^{other}+|{other}+$", "")
    if known:
        cleaned = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), word), cleaned)
    return F.when((cleaned != "") & (cleaned != word), cleaned)


def plain_candidates(word: Column, script: X.Script, most: int = 3) -> Column:
    """Made-up candidates for a demonstration: without the first orphan sign, without marks at the ends, without the last character."""
    orphan = F.get(X.orphan_columns(word, script), 0)
    unsigned = F.when(orphan.isNotNull(), F.concat(F.substring(word, F.lit(1), orphan - 1), F.substring(word, orphan + 1, F.length(word))))
    trimmed = F.regexp_replace(word, r"^[.,;:\-\x{2014}\x{2013}!?]+|[.,;:\-\x{2014}\x{2013}!?]+$", "")
    shorter = F.when(F.length(word) > 3, F.substring(word, F.lit(1), F.length(word) - 1))
    return F.slice(F.array_distinct(F.filter(F.array(unsigned, trimmed, shorter), lambda c: (c != "") & (c != word))), 1, most)


def demo_score(text: Column, script: X.Script) -> Column:
    """The demonstration's line score: coarser constants than :func:`text.score_line`, two decimals, no loops or repeats."""
    share = X.script_share(text, script)
    odd = X.count(text, rf"[^{script.block}\p{{Nd}}{PRINTED}]")
    flaws = X.orphan_signs(text, script) + odd
    flawed = F.greatest(F.lit(0.62), 0.90 - 0.07 * F.greatest(F.lit(0), flaws - 1))
    return (
        F.when(share.isNull(), F.when(text.rlike(r"\p{Nd}"), 0.3).otherwise(0.0))
        .when(share < 0.5, F.round(share * 0.6, 2))
        .when((flaws == 0) & (share >= 0.9), 0.99)
        .otherwise(F.round(F.when(share < 0.9, F.least(flawed, F.lit(0.54))).otherwise(flawed), 2))
    )

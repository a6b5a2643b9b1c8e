"""Tokenizers and text helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that counts as white space (RE2 and Java notation).
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The English stop words of the word analyzer.
ENGLISH_STOP_WORDS = frozenset(
    "a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and another any anyhow anyone anything"
    " anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call"
    " can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything"
    " everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter"
    " hereby herein hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less ltd made many may me"
    " meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off"
    " often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she"
    " should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the their them themselves then thence"
    " there thereafter thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve"
    " twenty two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever whether which while"
    " whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves".split()
)
# The stop words of grounding and claims.
GROUNDING_STOP_WORDS = tuple("a an and are as at be by for from in is it of on or that the this to was were with".split())


def words(text: Column) -> Column:
    """Non-empty parts between white space; an empty array for a null or blank text."""
    return F.coalesce(F.array_remove(F.split(text, SPACE + "+"), ""), F.array().cast("array<string>"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def right_stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def content_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII tokens of three or more signs that aren't grounding stop words; empty for null."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9_%-]{3,})")), F.lower)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*GROUNDING_STOP_WORDS)))


def sentences(text: Column) -> Column:
    """Non-empty stripped parts of a text, cut after ``.``, ``!`` or ``?`` and white space."""
    parts = F.split(stripped(F.coalesce(text, F.lit(""))), f"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def general_format(value: Column) -> Column:
    """Six significant digits without trailing zeros, scientific outside 1e-4 to 1e6."""
    exponent = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(value))).cast("int"))
    digits = F.greatest(F.lit(0), 5 - exponent)
    rounded = F.round(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", rounded), "0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", value / F.pow(F.lit(10.0), exponent.cast("double"))), "0+$", ""), r"\.$", "")
    power = F.concat(F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when((exponent < -4) | (exponent >= 6), F.concat(mantissa, F.lit("e"), power)).otherwise(fixed)


_WORD = re.compile(r"\w\w+")


def word_terms(text: str) -> list[str]:
    """Words of two or more signs without English stop words, and the pairs of those that are left next to each other."""
    kept = [w for w in _WORD.findall(text.lower()) if w not in ENGLISH_STOP_WORDS]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]


def character_terms(text: str) -> list[str]:
    """Runs of three to five signs inside words that are padded with a blank on both sides; a shorter padded word gives one run."""
    out: list[str] = []
    for word in text.lower().split():
        padded = f" {word} "
        size = len(padded)
        for n in (3, 4, 5):
            if n >= size:
                out.append(padded)
                break
            out += [padded[i : i + n] for i in range(size - n + 1)]
    return out

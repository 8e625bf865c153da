"""Clean-up of extracted text: the Swedish repairs, one column expression each, and all in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L = "[a-zA-ZäöåÄÖÅ]"
# Literal repairs, then words that belong apart, in the order of their application.
REPAIRS = (("Företagsnamnetsregistreringsdatum", "Företagsnamnets registreringsdatum"), ("Objektetsregis treringsdatum", "Objektets registreringsdatum"))
APART = (
    ("uppdatera", "dina|din"), ("våra", "register"), ("myndigheter", "att"), ("kontakt", "med"), ("räkenskapsåret", "behöver"), ("Bolagsverket", "har"),
    ("registrerat", "detta|följande"), ("Företagets", "första"), ("Sammanställning", "av"), ("Bildat", "datum"), ("Detta", "är"), ("privat", "aktiebolag"),
    ("Jämtlands", "län"), ("Östersund", "kommun"), ("Carl", "Johan"), ("Nils", "Olof"),
)


def merge_letter(text: Column) -> Column:
    """'word c word' becomes one word, unless the first already ends with c."""
    return F.regexp_replace(text, rf"({L}+({L}) \2 {L}{{2,}})|({L}{{2,}}) ({L}) ({L}{{2,}})", "$1$3$4$5")


def fuse(text: Column) -> Column:
    """Two adjacent words of two and three letters or more become one."""
    return F.regexp_replace(text, rf"({L}{{2,}}) ({L})({L}{{2,}})", "$1$2$3")


def repair(text: Column) -> Column:
    """The literal repairs of REPAIRS, wherever they occur; null stays null."""
    for wrong, right in REPAIRS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def split_words(text: Column) -> Column:
    """The words of APART set apart, in any case. Null stays null; a text without any of them, which a cheap search tells, is left as it is."""
    pairs = [(first + second).lower() for first, more in APART for second in more.split("|")]
    folded = F.translate(F.lower(F.upper(F.translate(text, "İ", "i"))), "ſ", "s")
    held = F.exists(F.array(folded), lambda t: _any(t, pairs))
    out = text
    for first, second in APART:
        out = F.regexp_replace(out, f"(?iu)({first})({second})", f"{first} $2" if first == "uppdatera" else "$1 $2")
    return F.when(held, out).otherwise(text)


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def split_long(text: Column) -> Column:
    """Runs of 20 letters or more are cut before the last 8, if what is before them ends in ets, ens or ats."""
    return F.regexp_replace(text, rf"({L}{{9,}}(?:ets|ens|ats))({L}{{8}})(?!{L})", "$1 $2")


def swedish(text: Column) -> Column:
    """All repairs in order."""
    return split_long(split_words(repair(fuse(merge_letter(text)))))

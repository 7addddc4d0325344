"""Text scalars as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter and the letters that are written as it
LETTERS = {
    "ٲ": "ٵأ",
    "ا": "ٳإٱ",
    "ء": "۽ٴ",
    "ت": "ٿټٺٹ",
    "ث": "ٽ",
    "چ": "ڇڄڃ",
    "ح": "ځ",
    "خ": "ڿڅڂ",
    "د": "ډڈۮ",
    "ذ": "ڐڏڎڍڌڊڋ",
    "ر": "ږڕڔړڒ",
    "ژ": "ۯڙڗ",
    "س": "ښ",
    "ش": "ۺڜڛ",
    "ص": "ڝ",
    "ض": "ۻڞ",
    "ظ": "ڟ",
    "غ": "ۼڠ",
    "ف": "ڦڥڤڣڢڡ",
    "ق": "ڨڧٯ",
    "ک": "ؼػڪګڬڭكڮ",
    "گ": "ڰڱڲڳڴ",
    "ل": "ڵڶڷڸ",
    "م": "۾",
    "ن": "ڽڼڻںڹ",
    "و": "ؤٷٶۏۋۊۉۈۇۆۅۄ",
    "ھ": "ۿ",
    "ه": "ەۂہۀ",
    "ة": "ۃ",
    "ی": "ئؠؿؾؽيىٸۍێۑېۓے",
}
#: letters and digits that are folded, and what they become
FOLD_FROM = "".join(LETTERS.values()) + "".join(chr(0x660 + d) for d in range(10))
FOLD_TO = "".join(to * len(those) for to, those in LETTERS.items()) + "".join(chr(0x6F0 + d) for d in range(10))
#: Marks that are removed
DIACRITICS = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}\x{06DA}\x{06E5}\x{06ED}\x{0640}]"
#: Stop words of the default list
STOP_WORDS = ("از", "به", "با", "در", "را", "و", "که", "این", "آن", "برای", "the", "of", "in", "and")
STOP_MARKS = r"[.!؟?,،؛;:|]"
#: Fixed value: a segment that matches is noise. The range from the blank to the low line takes in capitals and most marks.
NOISE = r"^[۰-۹0-9 -_)(*&^%$#@!~]+$|^.*خخ+.*$|^.*(ههه )+.*$|^.*##+.*$|^WORDorEXP$"


def normalize_text(text: Column) -> Column:
    """Letter variants folded, diacritics removed, the zero-width non-joiner a blank."""
    return F.translate(F.regexp_replace(text, DIACRITICS, ""), FOLD_FROM + "‌", FOLD_TO + " ")


def remove_stopwords(text: Column) -> Column:
    """Marks become blanks, then stop words and runs of blanks go."""
    marks = F.regexp_replace(text, STOP_MARKS, " ")
    words = F.filter(F.split(marks, r"\s+"), lambda w: ~w.isin(*STOP_WORDS) & (w != ""))
    return F.array_join(words, " ")


def token_type(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9۰-۹]+$"), "Integer")
        .when(token.rlike("^[A-Za-z]+$"), "EnglishWord")
        .when(token.rlike("^[آ-یءأؤئ]+$"), "PersianWord")
        .when(token.rlike("^[آ-یءأؤئ]+(‌[آ-یءأؤئ]+)+$"), "CompoundWord")
        .otherwise("Other")
    )


def tokenize(text: Column) -> Column:
    """Words of the kinds PersianWord, CompoundWord and Integer, between blanks."""
    plain = F.regexp_replace(text, STOP_MARKS, " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: token_type(w).isin("PersianWord", "CompoundWord", "Integer"))


def noise_free(segment: Column) -> Column:
    """The segment, or nothing (an empty text) if it is noise."""
    return F.when(segment.rlike(NOISE), "").otherwise(segment)


def read_pattern(path: str) -> str:
    """A regular expression kept in a text file, normalised as texts are."""
    with open(path, encoding="utf-8") as f:
        pattern = f.read().strip("\n")
    return re.sub(DIACRITICS.replace(r"\x{", r"\u").replace("}", ""), "", pattern).translate(str.maketrans(FOLD_FROM + "\u200c", FOLD_TO + " "))


def remove_patterns(text: Column, words: str, marks: str) -> Column:
    """The text without what ``words`` matches, and with blanks for what ``marks`` matches; both may come from :func:`read_pattern`."""
    return F.regexp_replace(F.regexp_replace(text, words, ""), marks, " ")


def list_to_csv(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")

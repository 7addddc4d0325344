"""Problem 2: visually identical text with different characters.

Every text is brought to one form inside Arrow partitions by SQL that DuckDB runs over the batch:
``translate`` for one-to-one forms, ``nfc_normalize`` for accents and ``regexp_replace`` for blanks, invisible
characters and joiners. The mapping tables are made by rule from the Unicode database; only the look-alike letters
are listed.

Defined results: a null text stays null and an empty one stays empty; a text of blanks and invisible characters becomes
empty; length is not limited; a post delivered more than once counts once, with its earliest delivery (ties: the
smallest text); other columns, whatever their names, are kept by :func:`with_consistent_text` and ignored elsewhere.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cyrillic and Greek letters that look like Latin ones, pair by pair.
LOOKALIKE_CYRILLIC = "аеорсухіѕјԁһԛԝАВЕКМНОРСТУХІЅЈ"
LOOKALIKE_CYRILLIC_AS = "aeopcyxisjdhqwABEKMHOPCTYXISJ"
LOOKALIKE_GREEK = "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LOOKALIKE_GREEK_AS = "oABEZHIKMNOPTYX"
# Arabic letters that join only to the letter before them.
RIGHT_JOINING = "اأإآٱدذرزژوؤڈڑةەۀ"
BLANKS = "\t\n\x0b\x0c\r\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
INVISIBLE = "\xad͏؜ᅟᅠ᠎​‎‏﻿ㅤ" + "".join(
    map(chr, [*range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)])
)
#: Arabic-Indic digits whose shape is the same in both sets (4, 5 and 6 differ).
SAME_DIGITS = (0, 1, 2, 3, 7, 8, 9)


def _compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """Width and presentation forms and the text they stand for: of one character, and of several."""
    one, many = {}, {}
    for lo, hi in ((0xFB00, 0xFB06), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFFEE)):
        for cp in range(lo, hi + 1):
            plain = unicodedata.normalize("NFKC", chr(cp))
            if plain != chr(cp):
                (one if len(plain) == 1 else many)[chr(cp)] = plain
    return one, many


def _precomposed(letters: str, latin: str) -> dict[str, str]:
    """Accented letters over a look-alike base: the same accent over the Latin letter."""
    as_latin, out = dict(zip(letters, latin, strict=True)), {}
    for cp in [*range(0x370, 0x530)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in as_latin:
            plain = unicodedata.normalize("NFC", as_latin[parts[0]] + parts[1:])
            if len(plain) == 1:
                out[chr(cp)] = plain
    return out


ONE, MANY = _compatibility()
CYRILLIC = dict(zip(LOOKALIKE_CYRILLIC, LOOKALIKE_CYRILLIC_AS, strict=True))
GREEK = dict(zip(LOOKALIKE_GREEK, LOOKALIKE_GREEK_AS, strict=True))
TO_LATIN = CYRILLIC | GREEK | _precomposed(LOOKALIKE_CYRILLIC, LOOKALIKE_CYRILLIC_AS) | _precomposed(LOOKALIKE_GREEK, LOOKALIKE_GREEK_AS)
PLAIN = {c: " " for c in BLANKS if c != " "} | {chr(0x660 + d): chr(0x6F0 + d) for d in SAME_DIGITS} | {"ك": "ک", "‐": "-", "‑": "-"}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _own(lo: int, hi: int, folded: dict[str, str]) -> str:
    """The letters of a script that look like no Latin letter, as the inside of a character class."""
    return "".join(chr(c) for c in range(lo, hi) if unicodedata.category(chr(c))[0] == "L" and chr(c) not in folded)


_LATIN_OWN = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123)]) if c not in (LOOKALIKE_CYRILLIC_AS + LOOKALIKE_GREEK_AS))
_ARABIC = r"[\x{0620}-\x{064A}\x{066E}-\x{06D3}\x{06D5}\x{06FA}-\x{06FF}]"
_JOINS_ON = rf"[\x{{0620}}-\x{{065F}}\x{{066E}}-\x{{06D3}}]"


ZW = "\u200c"


@functools.cache
def _unsettled() -> str:
    """The SQL that picks the rows of ``batch`` (k, t) whose text may not be in its consistent form."""
    zw = ZW
    settled = r"\x{21}-\x{7E}\x{200C} ،؛؟«»…\x{0621}-\x{0642}\x{0644}-\x{0648}پچژکگی\x{06F0}-\x{06F9}\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}"
    misplaced = rf"(?:^|[^\x{{0620}}-\x{{065F}}\x{{0670}}\x{{066E}}-\x{{06D3}}]|[{RIGHT_JOINING}]){zw}|{zw}(?:$|[^\x{{0620}}-\x{{064A}}\x{{066E}}-\x{{06D5}}])"
    return f"SELECT k, t FROM batch WHERE regexp_matches(t, '[^{settled}]|  |^ | $|{misplaced}')"


@functools.lru_cache(maxsize=256)
def _statement(present: str) -> str:
    """The SQL over the table ``rough`` (k, t) that gives (k, u).

    present: the characters of :data:`PLAIN`, :data:`INVISIBLE` and :data:`MANY` that occur in the batch, as ``translate``
    builds its table anew for every row.
    """
    zw = ZW
    plain, invisible, several = ("".join(c for c in present if c in x) for x in (PLAIN, INVISIBLE, MANY))
    steps = ["s0 AS (SELECT k, t FROM rough)"]

    def step(expression: str) -> None:
        prev = f"s{len(steps) - 1}"
        steps.append(f"s{len(steps)} AS (SELECT k, {expression} AS t FROM {prev})")

    has_many = r"[\x{FB00}-\x{FB06}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFC}\x{FF01}-\x{FFEE}]"
    spread = "t"
    for c in several:
        spread = f"replace({spread}, {_q(c)}, {_q(MANY[c])})"
    if several:
        step(f"CASE WHEN regexp_matches(t, '[{several}]') THEN {spread} ELSE t END")
    step(rf"CASE WHEN regexp_matches(t, '{has_many}') THEN translate(t, {_q(''.join(ONE))}, {_q(''.join(ONE.values()))}) ELSE t END")
    # one character for one, and invisible characters out
    if plain or invisible:
        step(f"CASE WHEN regexp_matches(t, '[{plain}{invisible}]') THEN translate(t, {_q(plain + invisible)}, {_q(''.join(PLAIN[c] for c in plain))}) ELSE t END")
    cyr, gre = _own(0x400, 0x530, TO_LATIN), _own(0x386, 0x400, TO_LATIN)
    back_c = "".join(dict(zip(LOOKALIKE_CYRILLIC_AS, LOOKALIKE_CYRILLIC, strict=True)).keys())
    back_ct = "".join(dict(zip(LOOKALIKE_CYRILLIC_AS, LOOKALIKE_CYRILLIC, strict=True)).values())
    back_g = "".join(dict(zip(LOOKALIKE_GREEK_AS, LOOKALIKE_GREEK, strict=True)).keys())
    back_gt = "".join(dict(zip(LOOKALIKE_GREEK_AS, LOOKALIKE_GREEK, strict=True)).values())
    word = (
        f"CASE WHEN regexp_matches(w, '[{cyr}]') AND NOT regexp_matches(w, '[{_LATIN_OWN}{gre}]') THEN translate(w, {_q(back_c)}, {_q(back_ct)}) "
        f"WHEN regexp_matches(w, '[{gre}]') AND NOT regexp_matches(w, '[{_LATIN_OWN}{cyr}]') THEN translate(w, {_q(back_g)}, {_q(back_gt)}) "
        f"ELSE translate(w, {_q(''.join(TO_LATIN))}, {_q(''.join(TO_LATIN.values()))}) END"
    )
    step(rf"CASE WHEN regexp_matches(t, '[\x{{0370}}-\x{{052F}}]') THEN array_to_string(list_transform(string_split(t, ' '), lambda w: {word}), ' ') ELSE t END")
    step("nfc_normalize(t)")
    # Arabic letters whose shape depends on what follows
    step(f"CASE WHEN regexp_matches(t, '[ۀە]') THEN replace(regexp_replace(replace(t, 'ۀ', 'هٔ'), 'ە({_ARABIC})', 'ه{zw}\\1', 'g'), 'ە', 'ه') ELSE t END")
    step(
        rf"CASE WHEN regexp_matches(t, '[يى]') THEN regexp_replace(regexp_replace(regexp_replace(t, 'ي({_JOINS_ON})', 'ی\1', 'g'), 'ي({_JOINS_ON})', 'ی\1', 'g'), 'ى($|[^\x{{0620}}-\x{{065F}}\x{{066E}}-\x{{06D5}}])', 'ی\1', 'g') ELSE t END"
    )
    # a non-joiner is seen only between a letter that joins on and another letter
    step(
        rf"CASE WHEN contains(t, '{zw}') THEN regexp_replace(regexp_replace(regexp_replace(t, '{zw}+', '{zw}', 'g'), '(^|[^\x{{0620}}-\x{{065F}}\x{{0670}}\x{{066E}}-\x{{06D3}}]|[{RIGHT_JOINING}]){zw}', '\1', 'g'), '{zw}($|[^\x{{0620}}-\x{{064A}}\x{{066E}}-\x{{06D5}}])', '\1', 'g') ELSE t END"
    )
    step("trim(CASE WHEN contains(t, '  ') THEN regexp_replace(t, ' +', ' ', 'g') ELSE t END)")
    return "WITH " + ", ".join(steps) + f" SELECT k, t AS u FROM s{len(steps) - 1}"


_PRESENT = re.compile("[" + re.escape("".join([*PLAIN, *INVISIBLE, *MANY])) + "]")


def connect():
    """A DuckDB connection that stays within one task's share of memory."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
    con.execute("SET preserve_insertion_order = true")
    return con


def consistent_array(con, texts: pa.Array) -> pa.Array:
    """The consistent form of every text of one Arrow array, in order."""
    batch = pa.table({"k": pa.array(range(len(texts)), pa.int64()), "t": texts.cast(pa.string())})
    con.register("batch", batch)
    rough = con.sql(_unsettled()).to_arrow_table()
    con.unregister("batch")
    if not len(rough):
        return batch.column("t").combine_chunks()
    present = set(_PRESENT.findall("".join(rough.column("t").to_pylist())))
    con.register("rough", rough)
    out = con.sql(_statement("".join(sorted(present)))).to_arrow_table().sort_by("k")
    con.unregister("rough")
    changed = np.zeros(len(texts), bool)
    changed[out.column("k").to_numpy()] = True
    return pc.replace_with_mask(batch.column("t").combine_chunks(), pa.array(changed), out.column("u").combine_chunks().cast(pa.string()))


def consistent(texts: list[str | None]) -> list[str | None]:
    """The same for a Python list, for tests and small tables."""
    return consistent_array(connect(), pa.array(texts, pa.string())).to_pylist()


def with_consistent_text(df: DataFrame, column: str, into: str = "consistent_text") -> DataFrame:
    """``df`` with the consistent form of ``column`` added as ``into`` (an existing column of that name is replaced)."""
    kept = df.drop(into)
    schema = kept.withColumn(into, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for b in batches:
            new = consistent_array(con, b.column(b.schema.get_field_index(column)))
            if isinstance(new, pa.ChunkedArray):
                new = new.combine_chunks()
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=[*b.schema.names, into])

    return kept.mapInArrow(run, schema)


def first_delivery(df: DataFrame, id_col: str, columns: list[str], time_col: str | None) -> DataFrame:
    """One row per id: the earliest delivery, ties by the smallest content. Rows without an id are no posts."""
    order = ([F.col(time_col).alias("_t")] if time_col else []) + [F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]
    picked = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col)).agg(F.min(F.struct(*order)).alias("_m"))
    return picked.select(id_col, *[F.col(f"_m._c{i}").alias(c) for i, c in enumerate(columns)])


def lookalike_classes(df: DataFrame, id_col: str, text_col: str, time_col: str | None = None) -> DataFrame:
    """(id, look, stored): 128-bit digests of the consistent and of the stored text of every post with text.

    Posts of one ``look`` read the same; those that differ in ``stored`` are written differently. Texts are dropped
    before the rows are moved, so that only digests are shuffled.
    """
    cols = [F.col(id_col), F.col(text_col).alias("_text")] + ([F.col(time_col)] if time_col else [])
    texts = df.select(*cols)
    marked = with_consistent_text(texts, "_text").select(
        id_col,
        *([time_col] if time_col else []),
        F.when(F.col("consistent_text") != "", F.unhex(F.md5("consistent_text"))).alias("look"),
        F.when(F.col("_text") != "", F.unhex(F.md5("_text"))).alias("stored"),
    )
    once = first_delivery(marked, id_col, ["look", "stored"], time_col)
    return once.where(F.col("look").isNotNull() & F.col("stored").isNotNull())


def lookalike_pairs(classes: DataFrame, id_col: str) -> DataFrame:
    """Pairs (seq_a < seq_b) of posts that look the same and are stored differently.

    Written forms are paired first and their posts joined to them after, so a form with very many posts meets only
    the other forms of its look, never itself.
    """
    forms = classes.groupBy("look").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("look")
    members = classes.join(forms, "look")
    variants = members.select("look", "stored").distinct()
    a, b = variants.alias("a"), variants.alias("b")
    links = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.stored") < F.col("b.stored"))).select(F.col("a.look").alias("look"), F.col("a.stored").alias("sa"), F.col("b.stored").alias("sb"))
    left = members.select("look", F.col("stored").alias("sa"), F.col(id_col).alias("ia"))
    right = members.select("look", F.col("stored").alias("sb"), F.col(id_col).alias("ib"))
    return links.join(left, ["look", "sa"]).join(right, ["look", "sb"]).select(F.least("ia", "ib").alias("seq_a"), F.greatest("ia", "ib").alias("seq_b"))

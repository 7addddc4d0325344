"""Problem 6: garbled text from wrong character encoding.

A smoothed character bigram model is trained on all clean records. Each suspicious record is then tried with every
candidate chain (encode with the code page that was wrongly used, decode with the right one) on the spans that such a chain
can have produced; a span's gain is the rise of its log-likelihood with one character of context on both sides. The
likeliest chain of a span is accepted if its gain is over a margin that is validated on held-out clean records: those
records as they are must stay under it, and the same records garbled by every chain must pass it. Accepted text is tried
again until nothing is accepted, so that text garbled several times is restored step by step. A record with replacement characters is affected, but lost.

Characters are classes of the model by rule (one for all blanks and one for all invisible characters, own classes for Latin, Arabic, Cyrillic and punctuation, one for each other
block), so the model has the same bounded size over any collection.

Defined results: null and empty texts are not affected; text length is not limited; a post delivered more than once
counts once, by its earliest delivery; rows without an id are ignored; an empty table, or one without clean records, gives a
model of equal probabilities; extra columns are ignored; of chains with equal gain the first in :data:`CHAINS` holds.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstloom.llm.consistent import TO_LATIN
from burstloom.session import materialise

#: code pages that UTF-8 text was read in
PAGES = ("cp1252", "cp1256", "mac_roman", "cp1251", "koi8_r", "cp437", "cp850", "cp866", "iso8859_6", "cp1250")
#: (read in, written in)
CHAINS = tuple((p, "utf-8") for p in PAGES) + (("cp1252", "cp1256"), ("cp1252", "cp1251"), ("cp1256", "cp1251"))
#: one in so many clean records is held out to validate the margin
HELD_OUT = 50
BINS = 400
#: margin where no clean or no garbled held-out record is there to validate one: about two characters' worth
UNVALIDATED = 8.0
#: suspicious records of one task
ROWS_A_TASK = 5_000



def _pairs(page: str) -> str:
    """The first two characters of any UTF-8 sequence that was read in a code page."""
    read = lambda lo, hi: re.escape("".join(codecs.decode(bytes([b]), page, "ignore") or chr(b) for b in range(lo, hi)))
    return f"[{read(0xC2, 0xF5)}][{read(0x80, 0xC0)}]"


_SUSPICIOUS = re.compile(
    _pairs("cp1250") + r"|[\uFFFD\u0080-\u0084\u0086-\u009F]"
    r"|[\u00C0-\u00FF][\u00C0-\u00FF\u02C6\u02DC\u00A1\u00AA\u00BA\u2018-\u201E]"
    r"|[\u00C2-\u00F4][\u00A0-\u00BF\u0152-\u0192\u02C6\u02DC\u2013-\u203A\u20AC\u2122]"
    r"|[\u0637\u0638\u0639\u063A\u0622-\u0649][\u00A1-\u00A9\u00AC\u00AE-\u00BA\u00BC-\u00BE\u0152\u0153\u0192\u02C6\u2018-\u2022\u2026\u2030\u2039\u203A\u20AC\u2122\u0679\u0688\u0691\u06BA\u06BE]"
    r"|[\u00E2\u00EF\u00F0\u064B-\u0652][\u0080-\u00BF\u0178\u2018-\u203A\u20AC\u0637\u0638\u06BA]"
    r"|[\u00FF\u0178\u2044\u20AC\u2039\u203A\uF8FF\u00AC\u221A\u00D4\u201A][\u00C0-\u00FF\u0131\u0152-\u0192\u02C6-\u02DD\u2013-\u203A\u2044\u20AC\u2122\u2126\u2202-\u2265\u25CA\uFB01\uFB02\u03A9\u03C0\u00A0-\u00BF]"
    r"|[\u0400-\u042F\u0433\u0440\u0432\u045F][\u00A0-\u00BF\u0402-\u040F\u0452-\u045F\u0490\u0491\u2013-\u203A\u20AC\u2116\u2122]"
    r"|[\u2500-\u25A0]|[\u0622-\u0649][\u00E0-\u00FF]|[\u00E0-\u00FF][\u0621-\u06D2]|\u0622[\u00AB\u00BB\u061B]"
    r"|\u0442[\u0410\u0411]|[\u0410-\u044F][\u00B0\u00B2\u00B7\u00F7\u221A\u2248\u2264\u2265]"
)


#: every suspicious sequence has one of these, and few clean texts have any
_SIGN = re.compile(r"[\u061B\u0080-\u0084\u0086-\u009F\u00A1-\u00AC\u00AE-\u05FF\u0679\u0688\u0691\u06BA\u06BE\u2010-\u202E\u2030-\u205F\u2100-\u25FF\u20AC\uF8FF\uFB01\uFB02\uFFFD]")


def suspicious(text: str) -> bool:
    """Whether a text has a sequence that some chain can have produced; a superset of the affected ones."""
    return _SIGN.search(text) is not None and _SUSPICIOUS.search(text) is not None


# ---- the model ----------------------------------------------------------------------------------------------

_OWN = ((0x0, 0x250), (0x2C0, 0x2E0), (0x400, 0x460), (0x600, 0x700), (0x2000, 0x2070))
_SIZE = sum(b - a for a, b in _OWN) + 64


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.int32)
    first = sum(b - a for a, b in _OWN)
    points = np.arange(0x110000)
    table[:] = first + np.where(points >= 0x10000, 63, np.minimum(points >> 10, 62))
    at = 0
    for a, b in _OWN:
        table[a:b] = np.arange(at, at + b - a)
        at += b - a
    table[[0xA0, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = table[0x20]
    table[[0xAD, 0x200E, 0x200F, 0x2060, 0xFEFF]] = table[0x200B]
    return table


def class_numbers(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, at, t, held) that are not clean or held out, and at the end the pair counts of all other rows of the task (kind ``pairs``)."""
    total = np.zeros(_SIZE * _SIZE, np.int64)
    names = ["id", "at", "t", "kind", "i", "n"]
    kinds: list[pa.DataType] = []
    for b in batches:
        kinds = [c.type for c in b.columns[:3]]
        texts, held = b.column(2).to_pylist(), b.column(3).to_pylist()
        bad = [suspicious(t) for t in texts]
        c = class_numbers("\n".join(t for t, x, h in zip(texts, bad, held, strict=True) if not x and not h))
        if len(c) > 1:
            total += np.bincount(c[:-1].astype(np.int64) * _SIZE + c[1:], minlength=len(total))
        at = [i for i, (x, h) in enumerate(zip(bad, held, strict=True)) if x or h]
        rest = b.take(pa.array(at, pa.int64()))
        none = pa.nulls(len(rest), pa.int64())
        yield pa.RecordBatch.from_arrays([*rest.columns[:3], pa.array(["bad" if bad[i] else "held" for i in at], pa.string()), none, none], names=names)
    at = np.flatnonzero(total)
    if kinds:
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), k) for k in kinds), pa.array(["pairs"] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=names)


def train(pairs: DataFrame) -> np.ndarray:
    """Log-probabilities (class x class) with Witten-Bell smoothing, from pair counts (i, n)."""
    rows = pairs.groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SIZE * _SIZE)
    counts[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
    counts = counts.reshape(_SIZE, _SIZE)
    single = (counts.sum(0) + 0.1) / (counts.sum() + 0.1 * _SIZE)
    kinds, seen = (counts > 0).sum(1, keepdims=True), counts.sum(1, keepdims=True)
    return np.log((counts + (kinds + 1) * single) / (seen + kinds + 1)).astype(np.float32)


def log_likelihood(model: np.ndarray, text: str) -> float:
    c = class_numbers(text)
    return float(model[c[:-1], c[1:]].sum())


#: a character beyond ASCII and the Arabic letters, digits and signs; a restored text without one was garbled once
_ODD = re.compile("[\x80-\u05ff\u0700-\u1fff\u2010-\u25ff]")
_FOLD = {ord(a): b for a, b in TO_LATIN.items()}


def as_stored(model: np.ndarray, text: str) -> float:
    """Log-likelihood of a text as it is, or with its look-alike letters in Latin if that is likelier: they are no garbling."""
    folded = text.translate(_FOLD)
    own = log_likelihood(model, text)
    return own if folded == text else max(own, log_likelihood(model, folded))


# ---- chains -------------------------------------------------------------------------------------------------


@functools.cache
def _byte_of(page: str) -> dict[int, int]:
    """Code point -> code point of the byte it stands for; bytes without a character stand for themselves."""
    out = {}
    for byte in range(128, 256):
        out[byte] = byte
    for byte in range(128, 256):
        try:
            c = ord(codecs.decode(bytes([byte]), page))
        except UnicodeDecodeError:
            continue
        out[c] = byte
    for byte in range(128, 256):  # Latin-1 signs that are other characters of the page are not bytes of it
        if page not in ("cp1252", "cp1250") and byte >= 0xA0 and codecs.encode(chr(byte), page, "ignore") == b"":
            out.pop(byte, None)
    return out


_SEQUENCE = "(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})"
_RUN = re.compile(f"{_SEQUENCE}+(?:[\\x09-\\x7e]{{1,3}}{_SEQUENCE}+)*")
_HIGH = re.compile("[\x80-\xff]+(?:[\\x09-\\x40\\x5b-\\x60\\x7b-\\x7e]{1,3}[\x80-\xff]+)*")


@functools.cache
def _bytes_table(page: str) -> np.ndarray:
    """Code point -> byte of the page it stands for; 0x100 for characters beyond ASCII that the page has not."""
    table = np.full(0x110000, 0x100, np.uint32)
    table[:128] = np.arange(128)
    for c, byte in _byte_of(page).items():
        table[c] = byte
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans(points: np.ndarray, chain: tuple[str, str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, restored) of the parts of a text that the chain can have produced."""
    page, right = chain
    as_bytes = _bytes_table(page)[points]
    if not ((as_bytes & 0x180) == 0x80).any():
        return
    for m in (_RUN if right == "utf-8" else _HIGH).finditer(as_bytes.astype("<u4").tobytes().decode("utf-32-le")):
        try:
            yield m.start(), m.end(), m.group().encode("latin-1").decode(right)
        except UnicodeDecodeError:
            continue


def _gains(model: np.ndarray, text: str) -> Iterator[tuple[float, int, int, int, str]]:
    """(gain, -chain number, start, end, restored) of every span of every chain that gains anything."""
    points = code_points(text)
    classes = _classes()[points]
    along = np.concatenate([[0.0], np.cumsum(model[classes[:-1], classes[1:]], dtype=np.float64)]) if len(classes) else np.zeros(1)
    foldable = any(c in TO_LATIN for c in set(text))
    for order, chain in enumerate(CHAINS):
        for a, b, new in spans(points, chain):
            left, right = text[a - 1] if a else "\n", text[b] if b < len(text) else "\n"
            if a and b < len(text) and not foldable:
                own = along[b] - along[a - 1]
            else:
                own = as_stored(model, left + text[a:b] + right)
            gain = log_likelihood(model, left + new + right) - own
            if gain > 0:
                yield float(gain), -order, a, b, new


def is_affected(model: np.ndarray, margin: float, text: str) -> bool:
    """Whether :func:`restore` finds anything; the chains are left as soon as one span passes the margin."""
    return "�" in text or any(g[0] > margin for g in _gains(model, text))


def best_spans(model: np.ndarray, text: str) -> list[tuple[float, int, int, str]]:
    """(gain, start, end, restored): for overlapping spans of several chains the one that gains most, if it gains at all."""
    found = sorted(_gains(model, text), reverse=True)
    taken: list[tuple[float, int, int, str]] = []
    for gain, _, a, b, new in found:
        if all(b <= x or a >= y for _, x, y, _ in taken):
            taken.append((gain, a, b, new))
    return taken


def restore(model: np.ndarray, margin: float, text: str) -> tuple[bool, str]:
    """(affected, text with every accepted span restored, again and again until none is accepted: every step raises the likelihood)."""
    affected = "�" in text
    while True:
        accepted = sorted((a, b, new) for gain, a, b, new in best_spans(model, text) if gain > margin)
        if not accepted:
            break
        affected, at, parts = True, 0, []
        for a, b, new in accepted:
            parts += [text[at:a], new]
            at = b
        text = "".join([*parts, text[at:]])
        if not _ODD.search(text):
            break
    return affected, text


def garble(text: str, chain: tuple[str, str]) -> str | None:
    """``text`` as it looks after the chain's mistake, or None if it can't be written so."""
    page, right = chain
    try:
        raw = text.replace("ی", "ي").replace("ک", "ك").encode(right) if right != "utf-8" else text.encode(right)
    except UnicodeEncodeError:
        return None
    back = {b: c for c, b in _byte_of(page).items() if c != b} | {b: b for c, b in _byte_of(page).items() if c == b and codecs.decode(bytes([b]), page, "ignore") in ("", chr(b))}
    return "".join(chr(b) if b < 128 else chr(back[b]) if b in back else "�" for b in raw)


def validate(held: DataFrame, column: str, model) -> float:
    """The margin: over the gains of held-out clean records (all but 0.05 %), a sixth of the way to those of one garbled word of each (all but 1 %)."""

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        hist = np.zeros((2, BINS), np.int64)
        for b in batches:
            for k, t in enumerate(x for x in b.column(0).to_pylist() if x):
                hist[0, min(BINS - 1, int(max([0.0, *(g[0] for g in best_spans(m, t))])))] += 1
                foreign = [w for w in t.split() if len(w) > 3 and not w.isascii()]
                if foreign:
                    chain = CHAINS[k % len(CHAINS)]
                    bad = garble(foreign[k % len(foreign)], chain)
                    if bad and "�" not in bad:
                        hist[1, min(BINS - 1, int(max([0.0, *(g[0] for g in best_spans(m, f" {bad} "))])))] += 1
        kind, at = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(hist[kind, at])], names=["k", "i", "n"])

    hist = np.zeros((2, BINS))
    for r in held.select(column).mapInArrow(gains, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
        hist[r["k"], r["i"]] = r["n"]
    if not hist[1].sum() or not hist[0].sum():
        return UNVALIDATED
    clean = int(np.searchsorted(np.cumsum(hist[0]), hist[0].sum() * 0.9995)) + 1
    bad = int(np.searchsorted(np.cumsum(hist[1]), hist[1].sum() * 0.01))
    return float(clean + max(bad - clean, 0) / 6)


def garbled_rows(df: DataFrame, id_col: str, text_col: str, time_col: str | None = None, restoring: bool = True) -> DataFrame:
    """(id, restored): the affected records; ``restored`` is null where characters are lost, and everywhere without ``restoring``."""
    time = F.col(time_col).cast("timestamp_ntz") if time_col else F.lit(None).cast("timestamp_ntz")
    texts = df.where(F.col(id_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("id"), time.alias("at"), F.col(text_col).alias("t"))
    held_out = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0
    # one pass over the texts: clean ones leave only their pair counts, the few others are kept
    sifted = materialise(texts.withColumn("held", held_out).mapInArrow(_sift, texts.withColumns({"kind": F.lit(""), "i": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}).schema))
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(train(sifted.where("kind = 'pairs'").select("i", "n")))
    held = sifted.where("kind = 'held'").select("t")
    margin = validate(held, "t", shared)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            keep, out = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                affected, new = restore(model, margin, t) if restoring else (is_affected(model, margin, t), "�")
                if affected:
                    keep.append(i)
                    out.append(None if "�" in new else new)
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(out, pa.string())], names=["id", "at", "restored"])

    bad = sifted.where("kind = 'bad'").select("id", "at", "t")
    schema = bad.drop("t").withColumn("restored", F.lit(None).cast("string")).schema
    tasks = max(sc.defaultParallelism, bad.count() // ROWS_A_TASK)
    found = bad.repartition(tasks, "id", "at").mapInArrow(judge, schema)
    if time_col is None:
        return found.groupBy(F.col("id").alias(id_col)).agg(F.min("restored").alias("restored"))
    # a later delivery counts only if it is the earliest one of its post
    firsts = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(time_col).cast("timestamp_ntz")).alias("at"))
    once = found.groupBy("id", "at").agg(F.min("restored").alias("restored"))
    return once.join(firsts, ["id", "at"], "left_semi").select(F.col("id").alias(id_col), "restored")

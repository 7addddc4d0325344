"""Problem 1: several values packed in one field.

A field is cut into marks, quoted spans and words. Quoted spans are atomic; commas, semicolons, bars, slashes, ampersands, plus signs,
tabs and line ends always part; blanks between plain words never do; blanks, and the word «و» between blanks, beside a number or a quoted
label may part. The candidate labels of a field are the edges of a lattice whose inner nodes are those places; edges over places that
must part are left out. Where a lattice has one path its labels are certain. Expectation-maximisation starts from the certain labels of the
whole column, then each round spreads the weight of every other field over its paths by the current frequencies
(forward-backward) and adds the expected labels. A Viterbi pass over the final frequencies chooses the split.

A label unseen so far is weighed by its length, and one that holds a number or a quoted label beside other words also by the share of
such labels among the quoted ones, whose extent is certain: in a column where titles hold numbers («part 5») a blank beside a number
may stay inside a label, in one where none does it parts.

Defined results: a null or blank field has no labels; empty pieces take no place; a repeated label counts again; brackets around a whole
field are dropped, others belong to the label; a quote that is not closed before a mark or blank is an ordinary
character; a doubled quote inside quotes stands for one; fields of any length are handled; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstloom.session import materialise

MARKS = ",;|/&+،؛\t\n\r"
BLANK = re.compile(r"[^\S\t\n\r]")
QUOTES = {'"': '"', "'": "'", "«": "»", "“": "”"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}
AND = "و"
NUMBER = re.compile(r"^[-+]?\d+(?:[.\-٫/]\d+)*$")
#: what an unseen label of no length weighs, and one that is a number
UNSEEN, UNSEEN_NUMBER = 1e-9, 1e-3
#: labels of mixed kind that count as seen in any column
MIXED_PRIOR = 1e-9
#: copies of the chosen split of a field that very many rows may have
SALTS = 16
#: different fields that a task remembers
REMEMBERED = 200_000


def _unbracket(s: str) -> str:
    s = s.strip()
    while len(s) > 1 and s[0] in BRACKETS and s[-1] == BRACKETS[s[0]]:
        depth = 0
        for i, c in enumerate(s):
            depth += (c == s[0]) - (c == BRACKETS[s[0]])
            if depth == 0 and i < len(s) - 1:
                return s
        s = s[1:-1].strip()
    return s


def _closing(s: str, at: int) -> int:
    """The place of the quote that closes the one at ``at``, or -1."""
    close = QUOTES[s[at]]
    i = at + 1
    while i < len(s):
        if s[i] == close:
            if i + 1 < len(s) and s[i + 1] == close:
                i += 2
                continue
            rest = s[i + 1 : i + 2]
            if not rest or rest in MARKS or rest.isspace():
                return i
        i += 1
    return -1


def atoms(field: str) -> list[list[tuple[str, bool]]]:
    """The field as groups between marks; a group is its (text, whether number or quoted) pieces between blanks."""
    s = _unbracket(field)
    groups: list[list[tuple[str, bool]]] = [[]]
    i = 0
    while i < len(s):
        c = s[i]
        if c in MARKS:
            groups.append([])
            i += 1
        elif c.isspace():
            i += 1
        elif c in QUOTES and (end := _closing(s, i)) > 0:
            inner = s[i + 1 : end].replace(QUOTES[c] * 2, QUOTES[c]).strip()
            if inner:
                groups[-1].append((inner, True))
            i = end + 1
        else:
            j = i
            while j < len(s) and s[j] not in MARKS and not s[j].isspace():
                j += 1
            groups[-1].append((s[i:j], bool(NUMBER.match(s[i:j]))))
            i = j
    return [g for g in groups if g]


def lattice(field: str | None) -> list[tuple[int, int, int, str, bool]]:
    """(group, from, to, label, joined): the edges of the field's lattice. ``joined`` marks a label over a place that may part.

    The nodes are the starts of numbers, quoted labels and plain stretches; «و» beside a number or a quoted label is a node that
    can be passed by an edge without a label.
    """
    out: list[tuple[int, int, int, str, bool]] = []
    for g, parts in enumerate(atoms(field) if field else []):
        nodes: list[tuple[str, bool]] = []  # text, is «و»
        plain: list[str] = []
        for k, (text, firm) in enumerate(parts):
            beside = (k > 0 and parts[k - 1][1]) or (k + 1 < len(parts) and parts[k + 1][1])
            link = not firm and text == AND and beside and 0 < k < len(parts) - 1
            if firm or link:
                if plain:
                    nodes.append((" ".join(plain), False))
                    plain = []
                nodes.append((text, link))
            else:
                plain.append(text)
        if plain:
            nodes.append((" ".join(plain), False))
        for k, (text, link) in enumerate(nodes):
            out.append((g, k, k + 1, "" if link else text, False))
            if k + 1 < len(nodes) and not link and not nodes[k + 1][1]:
                out.append((g, k, k + 2, f"{text} {nodes[k + 1][0]}", True))
            elif k + 2 < len(nodes) and nodes[k + 1][1]:
                out.append((g, k, k + 3, f"{text} {nodes[k + 1][0]} {nodes[k + 2][0]}", True))
    return out


def is_mixed(label: str) -> bool:
    """Whether a label holds a number beside other words."""
    parts = label.split()
    return len(parts) > 1 and any(NUMBER.match(x) for x in parts)


def certain_labels(field: str | None) -> list[tuple[str, bool]]:
    """(label, whether quoted) of the groups between marks that can be read in one way only."""
    out = []
    for parts in atoms(field) if field else []:
        if len(parts) == 1:
            out.append((parts[0][0], parts[0][1] and not NUMBER.match(parts[0][0])))
        elif not any(firm for _, firm in parts):
            out.append((" ".join(t for t, _ in parts), False))
    return out


def _forward_backward(edges: list, weight) -> list[tuple[str, float]]:
    """Expected number of each label over the paths of one field's lattice."""
    groups: dict[int, list] = {}
    for e in edges:
        groups.setdefault(e[0], []).append(e)
    out = []
    for es in groups.values():
        last = max(e[2] for e in es)
        w = {(e[1], e[2]): weight(e[3], e[4]) for e in es}
        top = [0.0] + [-math.inf] * last
        for b in range(1, last + 1):
            ins = [top[a] + w[a, b] for a in (b - 1, b - 2, b - 3) if (a, b) in w]
            hi = max(ins)
            top[b] = hi + math.log(sum(math.exp(x - hi) for x in ins))
        low = [-math.inf] * last + [0.0]
        for a in range(last - 1, -1, -1):
            ins = [w[a, b] + low[b] for b in (a + 1, a + 2, a + 3) if (a, b) in w]
            hi = max(ins)
            low[a] = hi + math.log(sum(math.exp(x - hi) for x in ins))
        out += [(e[3], math.exp(top[e[1]] + w[e[1], e[2]] + low[e[2]] - top[last])) for e in es if e[3]]
    return out


def _viterbi(edges: list, weight) -> list[str]:
    """The labels of the best path, group by group."""
    groups: dict[int, list] = {}
    for e in edges:
        groups.setdefault(e[0], []).append(e)
    out = []
    for g in sorted(groups):
        by_end: dict[int, list] = {}
        for e in groups[g]:
            by_end.setdefault(e[2], []).append(e)
        best: dict[int, tuple[float, list[str]]] = {0: (0.0, [])}
        for b in range(1, max(by_end) + 1):
            best[b] = max(((best[e[1]][0] + weight(e[3], e[4]), best[e[1]][1] + ([e[3]] if e[3] else [])) for e in by_end[b]), key=lambda x: x[0])
        out += best[max(by_end)][1]
    return out


def _weights(frequency: dict[str, float], mixed: float = MIXED_PRIOR):
    """Log-weight of an edge from the shares of labels; ``mixed`` is the share of quoted labels that hold a number beside other words."""

    def weight(label: str, joined: bool) -> float:
        if not label:
            return 0.0
        unseen = (UNSEEN_NUMBER if NUMBER.match(label) else UNSEEN) * 0.5 ** min(len(label), 60)
        return math.log(frequency.get(label, 0.0) + unseen * (mixed if joined else 1.0))

    return weight


_EDGE = "array<struct<g:int,a:int,b:int,label:string,joined:boolean>>"


def packed_labels(df: DataFrame, key: str, fields: list[str], rounds: int = 2) -> DataFrame:
    """(key, field, pos, value): the labels of several fields of every row, position from 1; each field has frequencies of its own.

    One pass over the rows splits the fields that can be read in one way and gives their labels; only the others are grouped by their
    text and weighed by a table of frequencies that is joined to their edges, so neither the labels nor the fields of a column meet in one place.
    """
    pieces = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("text")) for name in fields]))
    rows = df.select(F.col(key), pieces.alias("_p")).select(key, "_p.field", "_p.text").where("text is not null")
    schema = rows.withColumns({"values": F.lit(None).cast("array<string>"), "certain": F.lit(None).cast("array<struct<label:string,quoted:boolean,mixed:boolean>>")}).schema

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for b in batches:
            if len(known) > REMEMBERED:
                known.clear()
            for text in set(b["text"]) - known.keys():
                edges = lattice(text)
                values = None if any(e[4] for e in edges) else [e[3] for e in edges if e[3]]
                known[text] = values, [{"label": x, "quoted": q, "mixed": is_mixed(x)} for x, q in certain_labels(text)]
            out = b.copy()
            out["values"], out["certain"] = [known[t][0] for t in b["text"]], [known[t][1] for t in b["text"]]
            yield out

    read_rows = materialise(rows.mapInPandas(read, schema))
    plain = read_rows.where("values is not null").select(key, "field", F.posexplode("values").alias("pos", "value"))
    open_rows = read_rows.where("values is null").select(key, "field", "text")
    seen = read_rows.select("field", F.explode("certain").alias("c")).select("field", "c.*")
    base = materialise(seen.groupBy("field", "label").agg(F.count("*").cast("double").alias("c"), F.count_if("quoted").alias("quoted"), F.count_if(F.col("quoted") & F.col("mixed")).alias("mixed")))
    # a row per field name
    shares = base.groupBy("field").agg(((F.sum("mixed") + F.lit(MIXED_PRIOR)) / (F.sum("quoted") + F.lit(1.0))).alias("share"))
    texts = open_rows.groupBy("field", "text").agg(F.count("*").alias("n"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["edges"] = [[dict(zip(("g", "a", "b", "label", "joined"), e, strict=True)) for e in lattice(x)] for x in b["text"]]
            yield b

    lattices = materialise(texts.mapInPandas(build, f"field string, text string, n long, edges {_EDGE}").join(F.broadcast(shares), "field", "left"))
    exploded = lattices.select("field", "text", "n", "share", F.explode("edges").alias("e")).select("field", "text", "n", "share", "e.*")

    def of(b: pd.DataFrame) -> Iterator[tuple]:
        for field, text, n, share, es in zip(b["field"], b["text"], b["n"], b["share"], b["es"], strict=True):
            weight = _weights({e["label"]: e["p"] for e in es}, MIXED_PRIOR if pd.isna(share) else share)
            yield field, text, n, [(e["g"], e["a"], e["b"], e["label"], e["joined"]) for e in es], weight

    def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(field, label, x * n) for field, _, n, edges, weight in of(b) for label, x in _forward_backward(edges, weight)]
            yield pd.DataFrame(found, columns=["field", "label", "c"]).astype({"c": "float64"})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(field, text, _viterbi(edges, weight)) for field, text, _, edges, weight in of(b)], columns=["field", "text", "values"])

    def weighed(m: DataFrame) -> DataFrame:
        total = F.sum("c").alias("total")
        p = m.join(F.broadcast(m.groupBy("field").agg(total)), "field").select("field", "label", (F.col("c") / F.col("total")).alias("p"))
        joined = exploded.join(p, ["field", "label"], "left")
        return joined.groupBy("field", "text").agg(F.first("n").alias("n"), F.first("share").alias("share"), F.collect_list(F.struct("g", "a", "b", "label", "joined", F.coalesce("p", F.lit(0.0)).alias("p"))).alias("es"))

    model = base.select("field", "label", "c")
    for _ in range(rounds):
        more = weighed(model).mapInPandas(expected, "field string, label string, c double")
        model = materialise(base.select("field", "label", "c").unionByName(more).groupBy("field", "label").agg(F.sum("c").alias("c")))
    chosen = weighed(model).mapInPandas(choose, "field string, text string, values array<string>")
    # a field that very many rows have is dealt over SALTS copies of its split
    salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = open_rows.withColumn("salt", F.pmod(F.hash(key), F.lit(SALTS)))
    split = dealt.join(salted, ["field", "text", "salt"]).select(key, "field", F.posexplode("values").alias("pos", "value"))
    return plain.unionByName(split).withColumn("pos", F.col("pos") + 1)

"""Leaks between composed, decomposed and multi-character forms of the same words."""

import unicodedata

import numpy as np

from burstloom.llm import leaks
from burstloom.llm.words import bare_list

WORDS = ["آب", "مؤمن", "مسئول", "أحمد", "café", "ёлка", "Ångström", "слой", "لآلی", "می\u200cرود", "نیمه", "کتاب", "خانه"]


def test_forms_of_a_word_are_one():
    text = " ".join(WORDS)
    forms = [text, unicodedata.normalize("NFD", text), text.replace("لآ", "ﻵ"), text.replace("ی", "ي").replace("ک", "ك"), text.replace(" ", "\u00a0 \u200b"), text.upper()]
    assert {tuple(bare_list(t)) for t in forms} == {tuple(bare_list(text))}
    assert len(bare_list(text)) == len(WORDS)


def test_all_ligatures_are_spread():
    assert bare_list("ﬁne ﻻ ﻵ ﻼ oﬀice") == bare_list("fine لا لآ لا office")


def test_leaks_in_other_forms(spark):
    text = " ".join(WORDS)
    docs = [(1, f"one two {text}, three"), (2, "x " + unicodedata.normalize("NFD", text)), (3, text.replace("لآ", "ﻵ").upper()), (4, " ".join(WORDS[:11]) + " other " + " ".join(WORDS[11:])), (5, "\n".join(WORDS))]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, text + " end"), (8, text)], "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(d, i) for d in (1, 2, 3, 5) for i in (7, 8)]


def test_filter_knows_every_shingle(spark):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{rng.integers(10**6)}" for _ in range(40))) for i in range(50)]
    held = leaks.item_words(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 12)
    table = leaks.shingle_filter(held)
    hs = np.array([h for r in held.collect() for h in r["hs"]], np.int64).view(np.uint64)
    for at in leaks._places(hs, len(table) << 6):
        assert ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all()

"""Problems 2, 3 and 6: texts."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstloom.llm import consistent, garbled, neardup
from burstloom.session import materialise

ZW = "‌"
SAME = [
    ("ﺩﺭ ﻻﻟﻪ", "در لاله"),
    ("ｔｈｅ　cat​ ", "the cat"),
    ("fо́o ӧ", "fóo ö"),
    ("نيمه", "نیمه"),
    ("گاە " + ZW + "رس", "گاه رس"),
    ("می" + ZW + "شود", "می" + ZW + "شود"),
    ("کار" + ZW + "خانه", "کارخانه"),
    ("١٢٣", "۱۲۳"),
    ("آب", "آب"),
    ("ab­c﻿", "abc"),
    ("Россия", "Россия"),
    ("​  ", ""),
]


@pytest.mark.parametrize("stored,plain", SAME)
def test_consistent(stored, plain):
    assert consistent.consistent([stored]) == [plain]


@pytest.mark.parametrize("a,b", [("٤", "۴"), ("مي", "می"), ("café", "cafe"), ("Cat", "cat"), ("می" + ZW + "شود", "میشود")])
def test_visible_differences_stay(a, b):
    x, y = consistent.consistent([a, b])
    assert x != y


def test_consistent_is_stable_and_keeps_nulls():
    texts = [s for s, _ in SAME] + [None, "", "x" * 200_000]
    once = consistent.consistent(texts)
    assert once[-3] is None and once[-2] == "" and len(once[-1]) == 200_000
    assert consistent.consistent(once) == once


def _posts(spark, rows):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "seq long, posts_windowing string, loaded_at long")
    return df.withColumn("loaded_at", F.col("loaded_at").cast("timestamp").cast("timestamp_ntz")).withColumns({c: F.lit(1) for c in ("look", "stored", "cls", "ws", "restored", "id", "t")})


def test_lookalike_pairs(spark):
    rows = [(1, "نيمه"), (2, "نیمه"), (3, "نیمه"), (3, "later"), (4, None), (5, ""), (6, "​"), (7, "other"), (None, "نیمه")]
    classes = consistent.lookalike_classes(_posts(spark, rows), "seq", "posts_windowing", "loaded_at")
    assert sorted(map(tuple, consistent.lookalike_pairs(classes, "seq").collect())) == [(1, 2), (1, 3)]
    none = consistent.lookalike_classes(_posts(spark, rows).where("seq < 0"), "seq", "posts_windowing", "loaded_at")
    assert consistent.lookalike_pairs(none, "seq").collect() == []


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(10, 40))] for _ in range(25)]
    rows = []
    for words in base:
        for _ in range(3):
            new = words[:]
            for _ in range(rng.randrange(0, 3)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(9999)}"
            rng.shuffle(new)
            rows.append((len(rows), " ".join(new)))
    rows += [(900, "🔥"), (901, "🔥"), (902, "🔥🔥"), (903, None), (904, ""), (905, rows[0][1].upper())]
    members, links = neardup.near_duplicates(_posts(spark, rows), "seq", "posts_windowing", "loaded_at", recall=0.9999)
    got = set(map(tuple, neardup.all_pairs(members, links, "seq").collect()))
    want = {(900, 901)}
    sets = {i: set(t.lower().split()) for i, t in rows if t and "🔥" not in t}
    for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2):
        if len(a & b) >= 0.7 * len(a | b):
            want.add((i, j))
    assert got == want
    groups = neardup.duplicate_groups(members, links, "seq").collect()
    assert len(groups) == len([t for _, t in rows if t])


def _edited(seed, posts=700):
    """Posts of 12 to 40 words with 1 to 7 words changed, so that similarities lie on both sides of 0.7."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < posts:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(12, 40))]
        for _ in range(rng.randrange(1, 5)):
            new = words[:]
            for at in rng.sample(range(len(new)), rng.randrange(0, 7)):
                new[at] = f"x{rng.randrange(9999)}"
            rng.shuffle(new)
            rows.append((len(rows), " ".join(new)))
    return rows


def _similar(rows, threshold=0.7):
    sets = [(i, set(t.split())) for i, t in rows]
    at = {}
    for i, ws in sets:
        for w in ws:
            at.setdefault(w, []).append(i)
    by = dict(sets)
    met = {(min(p), max(p)) for held in at.values() for p in itertools.combinations(held, 2)}
    return {(i, j): s for i, j in met if (s := len(by[i] & by[j]) / len(by[i] | by[j])) >= threshold}


def test_recall_of_the_production_setting(spark):
    rows = _edited(11)
    want = _similar(rows)
    members, links = neardup.near_duplicates(_posts(spark, rows), "seq", "posts_windowing", "loaded_at")
    got = set(map(tuple, neardup.all_pairs(members, links, "seq").collect()))
    assert got <= set(want)
    assert len(got) >= 0.97 * len(want)
    near = {p for p, s in want.items() if s < 0.75}
    assert len(near) > 50 and len(got & near) >= 0.9 * len(near)


def test_split_band_hashes_give_the_same_pairs(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([w for w in base if rng.random() < 0.97] + [f"y{rng.randrange(40)}"])) for i in range(150)] + [(1000 + i, t) for i, t in _edited(12, 60)]
    df = _posts(spark, rows)
    pairs = []
    for block, sampled in ((20_000, 64), (10, 1)):
        sets = materialise(neardup.word_sets(df, "seq", "posts_windowing", "loaded_at"))
        hot = neardup.hot_keys(sets, 5, 17, 7, block, sampled)
        assert bool(hot) == (block == 10)
        pairs.append(sorted(map(tuple, neardup.similar_classes(sets, 0.7, 5, 0.95, block=block, sampled=sampled).collect())))
    assert pairs[0] == pairs[1] and len(pairs[0]) > 1000


def test_bitmaps_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    for size in (3, 20, 60, 200, 300):
        for _ in range(40):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            changed = int(rng.integers(0, max(1, int(size * 0.35)) + 1))
            b = np.concatenate([a[changed:], rng.integers(0, 2**63, changed, dtype=np.uint64)])
            x, y = (neardup.marks(s, np.array([0]), np.array([len(s)])) for s in (a, b))
            common = len(np.intersect1d(a, b))
            for threshold in (0.5, 0.7, 0.9):
                if common >= threshold * (2 * size - common):
                    assert neardup.may_be_similar(x, y, threshold).all()
    far = [neardup.marks(rng.integers(0, 2**63, 25, dtype=np.uint64), np.array([0]), np.array([25])) for _ in range(2)]
    assert not neardup.may_be_similar(*far, 0.7).any()


def test_near_duplicates_leave_out_and_empty(spark):
    df = _posts(spark, [(1, "a b c"), (2, "a b c"), (3, "c b a")])
    out = df.where("seq = 2").select("seq")
    members, links = neardup.near_duplicates(df, "seq", "posts_windowing", "loaded_at", leave_out=out)
    assert set(map(tuple, neardup.all_pairs(members, links, "seq").collect())) == {(1, 3)}
    members, links = neardup.near_duplicates(df.where("seq < 0"), "seq", "posts_windowing", "loaded_at")
    assert neardup.all_pairs(members, links, "seq").collect() == []


def test_bands_reach_the_recall():
    for rows, recall in ((3, 0.9), (5, 0.99)):
        b = neardup.bands_for(0.7, rows, recall)
        assert 1 - (1 - 0.7**rows) ** b >= recall > 1 - (1 - 0.7**rows) ** (b - 1)


@pytest.mark.parametrize("chain", [c for c in garbled.CHAINS if c[1] == "utf-8"][:4])
def test_garbling_round_trip(chain):
    text = "سلام بر مردم خوب شهر"
    bad = garbled.garble(text, chain)
    if "�" in bad:
        pytest.skip("bytes without a character")
    found = [new for _, _, new in garbled.spans(garbled.code_points(bad), chain)]
    assert "".join(found).replace(" ", "") == text.replace(" ", "")


@pytest.mark.parametrize("chain", garbled.CHAINS)
def test_suspicious_is_a_superset(chain):
    words = "سلام رسید این هم باید دید مردم شهر گفتگو پنجره چای ژاله آب مسئله میشود café müller straße Ñandú naïve “quoted” Россия съезд ёлка".split()
    for w in words:
        bad = garbled.garble(w, chain)
        assert bad is None or bad == w or garbled.suspicious(f"the {bad} text")
    assert not garbled.suspicious("مردم شهر بزرگ، امروز در بازار «کتاب» تازه خریدند؛ و 12 نفر") or chain[0] == "cp1256"


def test_text_garbled_four_times_is_restored():
    clean = "مردم شهر بزرگ امروز در بازار کتاب تازه خریدند و به خانه رفتند"
    c = garbled.class_numbers("\n".join([clean] * 50))
    counts = np.bincount(c[:-1].astype(np.int64) * garbled._SIZE + c[1:], minlength=garbled._SIZE**2).reshape(garbled._SIZE, -1) + 1e-3
    model = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    bad = "بازار"
    for _ in range(4):
        bad = garbled.garble(bad, ("cp1252", "utf-8"))
    assert "�" not in bad and garbled.restore(model, 4.0, f"مردم {bad} شهر") == (True, "مردم بازار شهر")


def test_garbled_posts(spark):
    clean = "مردم شهر بزرگ امروز در بازار کتاب تازه خریدند و به خانه رفتند"
    words = clean.split()
    rng = random.Random(1)
    rows = [(i, " ".join(rng.sample(words, 8))) for i in range(300)]
    rows += [(i, "the old river near Tøråsen and “café” © 2017") for i in range(300, 340)]
    bad = {1000: garbled.garble("بازار کتاب", ("cp1252", "utf-8")), 1001: "مردم " + garbled.garble("امروز", ("cp1256", "utf-8")) + " شهر", 1002: "شهر م�دم", 1003: garbled.garble("مردم شهر بزرگ", ("cp1252", "cp1256"))}
    rows += list(bad.items()) + [(2000, None), (2001, ""), (None, bad[1000])]
    df = _posts(spark, rows)
    got = {r["seq"]: r["restored"] for r in garbled.garbled_rows(df, "seq", "posts_windowing", "loaded_at").collect()}
    assert set(got) == set(bad)
    assert got[1000] == "بازار کتاب" and got[1001] == "مردم امروز شهر" and got[1002] is None
    quick = garbled.garbled_rows(df, "seq", "posts_windowing", "loaded_at", restoring=False)
    assert {r["seq"] for r in quick.collect()} == set(bad)
    assert garbled.garbled_rows(df.where("seq < 0"), "seq", "posts_windowing", "loaded_at").collect() == []


def test_model_is_a_distribution(spark):
    pairs = spark.createDataFrame([(5, 10), (6, 2)], "i long, n long")
    assert np.allclose(np.exp(garbled.train(pairs).astype(float)).sum(1), 1, atol=1e-3)

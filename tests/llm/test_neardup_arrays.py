"""p3_found: band rows are shuffled as arrays of their bucket, and the word sets of a batch are found at once."""

import numpy as np
import pyarrow as pa
import xxhash

from burstloom.llm import neardup


def test_sets_of_a_batch_are_those_of_its_texts():
    known = neardup._WordHashes(size=3)
    texts = ["a b a", "🔥", "  B  c", "🔥🔥", "c-d, c", "x" * 70, "🔥"]
    for batch in (texts, texts[1:2], texts[::-1], []):
        flat, sizes = known.sets(pa.array(batch, pa.string()))
        ends = np.cumsum(sizes).tolist()
        got = [set(flat[b - n : b].tolist()) for b, n in zip(ends, sizes.tolist(), strict=True)]
        words = {"a b a": "ab", "  B  c": "bc", "c-d, c": "cd", "x" * 70: ["x" * 70]}
        assert got == [{xxhash.xxh64_intdigest(w) for w in words.get(t, ["\x00" + t])} for t in batch]
        assert [len(s) for s in got] == sizes.tolist() and len(flat) == sum(sizes)


def test_band_rows_are_dealt_as_arrays():
    rng = np.random.default_rng(2)
    sets = pa.record_batch([pa.array(np.arange(300)), pa.array([rng.integers(0, 40, 6).tolist() for _ in range(300)], pa.list_(pa.int64()))], names=["cls", "ws"])
    plain = pa.Table.from_batches(neardup._banding(2, 5, 7, {})([sets]))
    common = max(set(plain["key"].to_pylist()), key=plain["key"].to_pylist().count)
    for hot in ({}, {common: 3}):
        flat = pa.Table.from_batches(neardup._banding(2, 5, 7, hot)([sets]))
        dealt = list(neardup._dealing(neardup._banding(2, 5, 7, hot), 8)([sets]))
        assert sum(map(len, dealt)) == 8 < len(flat)
        rows, home = [], {}
        for b in dealt:
            for bucket, width, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                assert width == (4 if hot else 3)
                for r in np.frombuffer(data, np.int64).reshape(-1, width).tolist():
                    rows.append((r + [0])[:4])
                    assert home.setdefault(r[0], bucket) == bucket
        assert sorted(rows) == sorted(map(list, zip(*(c.to_pylist() for c in flat.columns), strict=True)))
        met = {p for b in neardup._meeting(0.3)(sorted(dealt, key=lambda b: b.column(0)[0].as_py())) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        by: dict = {}
        for key, cls, mark, side in rows:
            by.setdefault(key, []).append((cls, np.uint64(mark % 2**64), side))
        want = {(min(a, b), max(a, b)) for x in by.values() for a, m, s in x for b, n, t in x if a != b and (s != t or s == 0) and neardup.may_be_similar(np.array([m]), np.array([n]), 0.3)[0]}
        assert met == want and len(met) > 100

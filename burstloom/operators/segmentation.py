"""Segmentation of token sequences by the sum of segment scores.

The score of a split is the sum of independent segment scores, so the best split of a prefix always extends the best
split of a shorter one. The fold below keeps one state (score, start of the last segment) per prefix and follows the back pointers at the
end; ties keep the whole prefix first and then the longest last segment. Spans are scored once per distinct text by joins; the fold itself
runs over Arrow batches of posts, since a higher-order function would copy its state for every token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstloom.operators.ngram import CORPUS_MASS, Scorer, length_scorer
from burstloom.session import local_scratch, materialise, release

#: known texts that a task looks up in its memory; more are joined
MOST_KNOWN = 4_000_000


def segment_spans(posts: DataFrame, top: int = 5) -> DataFrame:
    """(post_id, i, n, seg_text): every span of up to ``top`` tokens."""
    starts = posts.select("post_id", "tokens", F.posexplode("tokens").alias("i", "_t"))
    spans = starts.select("post_id", "tokens", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(top), F.size("tokens") - F.col("i")))).alias("n"))
    return spans.select("post_id", "i", "n", F.array_join(F.slice("tokens", F.col("i") + 1, F.col("n")), " ").alias("seg_text"))


def segment_posts(posts: DataFrame, scores: DataFrame, top: int = 5) -> DataFrame:
    """(post_id, segs): the best split of every post; distinct spans were scored once and come back by one join.

    Spans travel to their scores and to their posts as numbers: two hashes of their text and their place.
    """
    key = [F.xxhash64("seg_text").alias("h"), F.hash("seg_text").alias("g")]
    spans = segment_spans(posts, top).select("post_id", (F.col("i") * top + F.col("n") - 1).cast("int").alias("at"), *key)
    known = spans.join(scores.select(*key, "score"), ["h", "g"]).select("post_id", "at", "score")
    by_post = known.groupBy("post_id").agg(F.collect_list("at").alias("at"), F.collect_list("score").alias("score"))
    return _solve(posts.select("post_id", "tokens").join(by_post, "post_id", "left"), top)


def _solve(held: DataFrame, top: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, out = b.column(0), []
            for i, tokens in enumerate(b.column(1).to_pylist()):
                tokens = tokens or []
                flat = np.zeros(len(tokens) * top)
                if b.column(2)[i].is_valid:
                    flat[b.column(2)[i].values.to_numpy()] = b.column(3)[i].values.to_numpy()
                score = flat.tolist()
                best, back = [0.0], [0]
                for end in range(1, len(tokens) + 1):
                    s, where = -np.inf, 0
                    for j in range(max(0, end - top), end):
                        x = best[j] + score[j * top + end - j - 1]
                        if x > s:
                            s, where = x, j
                    best.append(s)
                    back.append(where)
                at, segs = len(tokens), []
                while at:
                    segs.append(" ".join(tokens[back[at] : at]))
                    at = back[at]
                out.append(segs[::-1])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.string()))], names=["post_id", "segs"])

    return held.select("post_id", "tokens", "at", "score").mapInArrow(run, "post_id long, segs array<string>")


def top_beam(spans: DataFrame, width: int = 20) -> DataFrame:
    """The ``width`` best scored spans of every post, ties by place."""
    from pyspark.sql import Window

    order = Window.partitionBy("post_id").orderBy(F.desc("score"), "i", "n")
    return spans.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width)


def beam_of_posts(posts: DataFrame, scorer: Scorer = length_scorer, top: int = 5, width: int = 20) -> DataFrame:
    """(post_id, rank, seg_text, score): what :func:`top_beam` keeps of all spans scored by length norm x ``scorer``.

    A post's spans are scored and cut where the post is read, so none is shuffled. The stand-in scorer needs the word lengths only; any
    other gets every distinct span of a batch once.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b in batches:
            lists = b.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            bounds, flat = bounds - bounds[0], lists.flatten()
            end = np.repeat(bounds[1:], np.diff(bounds))
            at, words = np.arange(len(flat)), flat.to_pylist()
            score, valid = np.zeros((len(flat), top)), at[:, None] + np.arange(1, top + 1) <= end[:, None]
            if scorer is length_scorer:
                lens = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(float)
                least, most = lens.copy(), lens.copy()
                for n in range(1, top + 1):
                    if n > 1:
                        least[: 1 - n] = np.minimum(least[: 1 - n], lens[n - 1 :])
                        most[: 1 - n] = np.maximum(most[: 1 - n], lens[n - 1 :])
                    score[:, n - 1] = (1.0 if n == 1 else (n - 1) / n) * (least / most)
            else:
                texts = [" ".join(words[i : i + n + 1]) for i, n in zip(*np.nonzero(valid), strict=True)]
                distinct = list(dict.fromkeys(texts))
                of = dict(zip(distinct, scorer(distinct), strict=True)) if distinct else {}
                norm = np.array([1.0, *((n - 1) / n for n in range(2, top + 1))])
                score[valid] = [of[t] for t in texts]
                score *= norm
            i, n = np.nonzero(valid)
            score = score[valid]
            key = np.where(np.isnan(score), -np.inf, -score)
            spans = np.concatenate([[0], np.cumsum(valid.sum(1))])[bounds]
            post, rank, chosen = [], [], []
            for k in range(len(lists)):
                best = np.argsort(key[spans[k] : spans[k + 1]], kind="stable")[:width] + spans[k]
                chosen.append(best)
                rank.append(np.arange(1, len(best) + 1, dtype=np.int32))
                post.append(len(best))
            chosen = np.concatenate(chosen) if chosen else np.zeros(0, int)
            rank = np.concatenate(rank) if rank else np.zeros(0, np.int32)
            texts = [" ".join(words[x : x + y + 1]) for x, y in zip(i[chosen].tolist(), n[chosen].tolist(), strict=True)]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(lists)), np.array(post, int))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(rank), pa.array(texts, pa.string()), pa.array(score[chosen])], names=["post_id", "rank", "seg_text", "score"])

    return posts.where("tokens is not null").select("post_id", "tokens").mapInArrow(run, "post_id long, rank int, seg_text string, score double")


def segment_by_parts(posts: DataFrame, grams: DataFrame, kb: DataFrame, top: int = 5, mass: float = CORPUS_MASS, most: int = MOST_KNOWN) -> DataFrame | None:
    """(post_id, segs): the best split of every post by the stickiness of its spans, to nine digits; None if the known texts are too many.

    A span's score comes from its own count, the counts of its parts, which are spans of the same post, and its knowledge-base value. The
    known texts become a tree of word numbers in the shared folder that tasks map into memory, so no span is shuffled.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    folder = local_scratch(posts.sparkSession, "texts")
    if folder is None:
        return None
    known = grams.select("seg_text", F.col("cnt").cast("double").alias("cnt")).join(kb.select("seg_text", "anchor_q"), "seg_text", "full")
    known = materialise(known.where("seg_text <> '' and (coalesce(cnt, 0) <> 0 or coalesce(anchor_q, 0) <> 0)").where(F.size(F.split("seg_text", " ")) <= top).select("seg_text", F.coalesce("cnt", F.lit(0.0)).alias("cnt"), F.coalesce("anchor_q", F.lit(0.0)).alias("q")))
    if known.count() > most:
        release(known)
        folder.drop()
        return None
    path = folder.path

    def plant(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("seg_text", pa.string()), ("cnt", pa.float64()), ("q", pa.float64())])).combine_chunks()
        text = pa.concat_arrays(table.column(0).chunks) if table.num_rows else pa.array([], pa.string())
        split = pc.split_pattern(text, " ")
        words = split.flatten().unique()
        number = pc.index_in(split.flatten(), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        at = split.offsets.to_numpy().astype(np.int64)
        size = np.diff(at)
        cnt, q = (table.column(i).to_numpy() for i in (1, 2))
        node, before = np.zeros(len(text), np.int64), 0
        for n in range(1, top + 1):
            deep = size >= n
            keys = node[deep] * max(1, len(words)) + number[at[:-1][deep] + n - 1]
            found, place = np.unique(keys, return_inverse=True)
            node[deep] = place
            values = np.zeros((2, len(found)))
            ends = size[deep] == n
            values[0, place[ends]], values[1, place[ends]] = cnt[deep][ends], q[deep][ends]
            np.save(f"{path}/keys{n}.npy", found)
            np.save(f"{path}/values{n}.npy", values)
        with pa.OSFile(f"{path}/words.arrow", "wb") as f, pa.ipc.new_file(f, pa.schema([("w", words.type)])) as out:
            out.write_batch(pa.record_batch([words], names=["w"]))
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    known.coalesce(1).mapInArrow(plant, "done long").collect()
    release(known)

    def run(batches):
        words = pa.ipc.open_file(pa.memory_map(f"{path}/words.arrow")).get_batch(0).column(0)
        keys = [np.load(f"{path}/keys{n}.npy", mmap_mode="r") for n in range(1, top + 1)]
        values = [np.load(f"{path}/values{n}.npy", mmap_mode="r") for n in range(1, top + 1)]
        for b in batches:
            lists = b.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            bounds, flat = bounds - bounds[0], lists.flatten()
            total, length = len(flat), np.diff(bounds)
            once = flat.dictionary_encode()
            of = pc.index_in(once.dictionary.cast(words.type), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            number = of[once.indices.to_numpy()] if total else np.zeros(0, np.int64)
            end = np.repeat(bounds[1:], length)
            cnt, q = np.zeros((total, top)), np.zeros((total, top))
            start, node = np.arange(total), np.zeros(total, np.int64)
            for n in range(1, top + 1):
                stays = start + n <= end[start]
                start, node = start[stays], node[stays]
                stays = number[start + n - 1] >= 0
                start, node = start[stays], node[stays]
                if not len(start) or not len(keys[n - 1]):
                    break
                key = node * len(words) + number[start + n - 1]
                place = np.minimum(np.searchsorted(keys[n - 1], key), len(keys[n - 1]) - 1)
                stays = keys[n - 1][place] == key
                start, node = start[stays], place[stays]
                cnt[start, n - 1], q[start, n - 1] = values[n - 1][0][node], values[n - 1][1][node]
            score = np.zeros((total, top))
            for n in range(1, top + 1):
                f, products = cnt[:, n - 1], np.zeros(total)
                if n == 1:
                    c = 2 * f * f / (f * f + mass * mass)
                else:
                    for k in range(1, n):
                        products[:-k] += cnt[:-k, k - 1] * cnt[k:, n - k - 1]
                    below = f * f + products / (n - 1)
                    c = np.divide(2 * f * f, below, out=np.zeros(total), where=below != 0)
                    c[(f == 0) & (products == 0)] = 2.0
                score[:, n - 1] = np.rint((1.0 if n == 1 else (n - 1) / n) * c * np.exp(q[:, n - 1]) * 1e9) / 1e9
            # all posts of the batch take their next token at once, the longest first; a prefix's best split is at its token's place + 1
            order = np.argsort(-length, kind="stable")
            place, sizes = bounds[:-1][order] + order, length[order]
            best, back = np.zeros(total + len(length)), np.zeros(total + len(length), np.int64)
            for e in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
                m = int(np.searchsorted(-sizes, -e, side="right"))
                at, tokens = place[:m], bounds[:-1][order[:m]]
                low = max(0, e - top)
                options = np.stack([best[at + j] + score[tokens + j, e - j - 1] for j in range(low, e)])
                first = options.argmax(0)
                best[at + e], back[at + e] = options[first, np.arange(m)], first + low
            texts, starts, out = flat.to_pylist(), back.tolist(), []
            for k, (lo, size) in enumerate(zip(bounds[:-1].tolist(), length.tolist(), strict=True)):
                segs, e = [], size
                while e:
                    j = starts[lo + k + e]
                    segs.append(" ".join(texts[lo + j : lo + e]))
                    e = j
                out.append(segs[::-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["post_id", "segs"])

    return posts.select("post_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(run, "post_id long, segs array<string>")

"""Near duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its shingles of five words; similarity is the weighted Jaccard of two such multisets
(sum of the smaller counts over sum of the larger), and texts are linked from 0.8 on.

Signature: every shingle has independent Poisson processes over the weight axis, which is cut hierarchically at
0, 1, 2, 4, 8, ...  A point of a process is an arrival time, a position on the weight axis and a component.  Points
below the shingle's count take part; each component keeps its earliest.  Two multisets agree in a component
with probability equal to their weighted Jaccard.  Points come in order of time, so only those before the
current limit are made, and the limit is raised until every component is settled.

Documents with the same word sequence are one text from the start.  Texts that agree in a whole band meet; in a
bucket of two that is the candidate, in larger ones (dealt into blocks) each text first gives its two most similar
partners and the edges of a spanning forest over estimated similarity, so these candidates grow in proportion to
members.  Candidates are verified on the full multisets, and linked texts form classes by connected components.
Then all texts of a bucket that are in different classes are compared by their full multisets: each block of the
texts outside the bucket's major class meets each block of the bucket in a task of its own, which returns links only.
No step gathers a bucket, group or class whole in one task beyond two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, text_of, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
CUT = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / COMPONENTS) ** 0.5  # five standard errors of the estimate below
BLOCK = 1024  # texts compared with each other in one task
SALTS = 16
PARTNERS = 2
BLOCK_WORDS = 1 << 19  # words of the texts whose multisets are held in one block
SLOTS = 1 << 25  # bits of the filter that picks the texts to verify

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
MUL1, MUL2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASE = 0x100000001B3
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SEGMENT_WORDS, GIANT = 20_000, 4096
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + STEP
    x = (x ^ (x >> U(30))) * MUL1
    x = (x ^ (x >> U(27))) * MUL2
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {"up": powers(BASE, 1 << 12), "down": powers(BASE_INVERSE, 1 << 12)}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word (run without ASCII white space) of the lower-cased text."""
    return byte_word_hashes(np.frombuffer(text.lower().encode(), np.uint8))


def key_of(words: np.ndarray) -> bytes:
    """Digest of a sequence of word hashes."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def byte_word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes without ASCII white space."""
    out = [segment_hashes(data[start:end]) for start, end in segments(data)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of at most a few hundred kilobytes that end at white space (longer only if one word is)."""
    size, start = 1 << 18, 0
    while start < len(data):
        end = min(len(data), start + size)
        while end < len(data) and not SPACE[data[end]]:
            gap = np.flatnonzero(SPACE[data[end : end + size]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + size)
        yield start, end
        start = end


def segment_hashes(data: np.ndarray) -> np.ndarray:
    solid = np.concatenate([[False], ~SPACE[data], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    while len(_POWERS["up"]) <= len(data):
        n = 2 * len(_POWERS["up"])
        _POWERS["up"], _POWERS["down"] = powers(BASE, n), powers(BASE_INVERSE, n)
    sums = np.concatenate([[U(0)], np.cumsum((data.astype(np.uint64) + U(1)) * _POWERS["up"][: len(data)], dtype=np.uint64)])
    raw = (sums[last] - sums[first]) * _POWERS["down"][first]
    out = mix(raw ^ (last - first).astype(np.uint64))
    for i in np.flatnonzero(last - first > GIANT):
        out[i] = int.from_bytes(hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(words: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts; a text of 1 to ``size`` words is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n < size:
        out = np.full(1, U(n))
        for w in words:
            out = mix(out ^ w)
    else:
        out = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            out = (out ^ words[i : n - size + 1 + i]) * MUL1 + STEP
        out = mix(out)
    return np.unique(out, return_counts=True)


def bag_minhash(items: np.ndarray, counts: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """Signature of a multiset: for each of ``m`` components its earliest arrival time, as 64-bit numbers."""
    return bag_minhashes([(items, counts)], m)[0]


def bag_minhashes(bags: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """Signatures of several multisets, one a row; the processes of all of them advance together."""
    out = np.zeros((len(bags), m), np.uint64)
    sizes = np.array([len(x) for x, _ in bags])
    if not sizes.sum():
        return out
    items, counts = np.concatenate([x for x, _ in bags]), np.concatenate([n for _, n in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    seeds, owners, rates, lows, tops = [mix(items)], [owner], [np.ones(len(items))], [np.zeros(len(items))], [counts.astype(float)]
    many = np.flatnonzero(counts > 1)
    level, low = 1, 1
    while len(many):  # the weight axis doubles: interval [low, 2 low) has rate low
        seeds.append(mix(items[many] ^ U((level * int(MUL2)) & 0xFFFFFFFFFFFFFFFF)))
        owners.append(owner[many])
        rates.append(np.full(len(many), float(low)))
        lows.append(np.full(len(many), float(low)))
        tops.append(counts[many].astype(float))
        level, low = level + 1, low * 2
        many = many[counts[many] > low]
    seed, of, rate, low_of, top_of = (np.concatenate(x) for x in (seeds, owners, rates, lows, tops))
    best = np.full(len(bags) * m, np.inf)
    limit = m * (np.log(m) + 2) / np.maximum(np.bincount(of, rate, len(bags)), 1.0)
    time, draw, point = arrivals(seed, rate, np.zeros(len(seed)), np.zeros(len(seed), np.uint64))
    open_ = np.flatnonzero(sizes)
    alive = np.arange(len(seed))
    while len(open_):
        ready = alive[time[alive] <= limit[of[alive]]]
        while len(ready):
            here = point[ready]
            component = (mix(here ^ MUL1) % U(m)).astype(np.int64)
            position = low_of[ready] + rate[ready] * unit(mix(here ^ MUL2))
            ok = position < top_of[ready]
            np.minimum.at(best, of[ready][ok] * m + component[ok], time[ready][ok])
            time[ready], draw[ready], point[ready] = arrivals(seed[ready], rate[ready], time[ready], draw[ready])
            ready = ready[time[ready] <= limit[of[ready]]]
        open_ = open_[best.reshape(-1, m)[open_].max(axis=1) > limit[open_]]
        limit[open_] *= 2
        alive = alive[np.isin(of[alive], open_)]
    filled = sizes > 0
    out[filled] = best.view(np.uint64).reshape(-1, m)[filled]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def arrivals(seed: np.ndarray, rate: np.ndarray, time: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next point of each process: its time, the number of points so far and its random number."""
    point = mix(seed + (draw + U(1)) * STEP)
    return time - np.log(unit(point)) / rate, draw + U(1), mix(point ^ STEP)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    rows = signature.reshape(BANDS, ROWS)
    key = mix(np.arange(BANDS, dtype=np.uint64) * MUL2)
    for i in range(ROWS):
        key = mix(key ^ rows[:, i])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as sorted items and counts."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    total = int(a[1].sum()) + int(b[1].sum()) - low
    return low / total if total else 1.0


def together(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts in groups of about ``size`` characters."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


# Steps in Spark


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _key, _n, _bands, _sig``: key of the word sequence, words, band keys, 16 bits of each component."""
    small_batches(df.sparkSession)

    def run(it):
        for b, texts in batches(it, "_text"):
            keys, sizes, bands, sigs = [], [], [], []
            for group in together(texts):
                hashes = [word_hashes(t) for t in group]
                for words, signature in zip(hashes, bag_minhashes([shingles(w) for w in hashes])):
                    keys.append(key_of(words))
                    sizes.append(len(words))
                    bands.append(band_keys(signature) if len(words) else np.zeros(0, np.int64))
                    sigs.append((mix(signature) >> U(48)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["_id", "_key", "_n", "_bands", "_sig"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return picked.mapInArrow(run, f"_id {id_type}, _key binary, _n long, _bands array<long>, _sig binary")


def salt(col: str, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def salted_join(hot: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join whose left side may hold one key many times: that side is salted by ``spread``, the other repeated."""
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hot.withColumn("_salt", salt(spread)).join(repeated, [key, "_salt"]).drop("_salt")


def forest_pairs(ids: np.ndarray, sigs: np.ndarray, cut: float) -> set[tuple[int, int]]:
    """Candidate pairs of one block: the most similar partners of each text and a maximum spanning forest."""
    g = len(ids)
    best, link, done = np.full(g, -1.0), np.full(g, -1), np.zeros(g, bool)
    out = set()
    at = 0
    for _ in range(g):
        done[at] = True
        alike = (sigs == sigs[at]).mean(axis=1)
        alike[at] = -1
        near = np.argpartition(-alike, min(PARTNERS, g - 1) - 1)[:PARTNERS]
        out.update((at, int(j)) for j in near if alike[j] >= cut)
        if link[at] >= 0 and best[at] >= cut:
            out.add((at, int(link[at])))
        better = (alike > best) & ~done
        best[better], link[better] = alike[better], at
        at = int(np.where(done, -2.0, best).argmax())
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in out}


def groups_in_order(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys from sorted batches."""
    now, rows = None, []
    for row in chain.from_iterable(b.to_pylist() for b in it):
        key = tuple(row[k] for k in keys)
        if key != now and rows:
            yield rows
            rows = []
        now = key
        rows.append(row)
    if rows:
        yield rows


def bucket_members(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs ``a, b`` of buckets of two, and ``_id, _n, _band, _size`` of larger ones; ``texts`` has ``_id, _n, _bands``."""
    bands = texts.select("_id", "_n", F.explode("_bands").alias("_band"))
    groups = bands.groupBy("_band").agg(F.count(F.lit(1)).alias("_size"), F.min("_id").alias("a"), F.max("_id").alias("b"))
    groups = written(groups.filter("_size > 1"), "near-dedup-buckets")
    twos = groups.filter("_size = 2").select("a", "b").distinct()
    members = salted_join(bands, groups.filter("_size > 2").select("_band", "_size"), "_band", "_id")
    return twos, written(members.select("_id", "_n", "_band", "_size"), "near-dedup-members")


def pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def candidate_pairs(twos: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` (a < b): the first candidates among texts that meet in a band, in proportion to members."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    placed = members.select("_id", "_band", F.pmod(F.xxhash64("_id", "_band"), blocks).cast("int").alias("_block")).join(texts.select("_id", "_sig"), "_id")
    ordered = placed.repartition(parts, "_band", "_block").sortWithinPartitions("_band", "_block", "_id")

    def run(it):
        for rows in groups_in_order(it, ["_band", "_block"]):
            if len(rows) > 1:
                yield pair_batch(list(forest_pairs(np.array([r["_id"] for r in rows]), np.stack([np.frombuffer(r["_sig"], "<u2") for r in rows]), CUT)))

    return twos.unionByName(ordered.mapInArrow(run, "a long, b long")).distinct()


def labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the ``_class`` that their ``_id`` is in: its own if it is alone."""
    return rows.join(classes, "_id", "left").withColumn("_class", F.coalesce("class_id", "_id")).drop("class_id")


def mixed_members(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the buckets with several classes: ``_id, _band, _class, _minor, _lines, _blocks``.

    ``_minor``: not in the class of most members; ``_lines, _blocks``: into how many blocks those, and all, are dealt.
    """
    rows = labelled(members, classes)
    each = rows.groupBy("_band", "_class").agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_w"))
    buckets = each.groupBy("_band").agg(F.sum("_k").alias("_k"), F.sum("_w").alias("_w"), F.max(F.struct("_k", "_w", "_class")).alias("_most"))
    blocks = lambda k, w: F.ceil(F.greatest(k / BLOCK, w / BLOCK_WORDS)).cast("int")
    k, w = F.col("_k"), F.col("_w")
    buckets = buckets.filter("_k > _most._k").select(
        "_band", F.col("_most._class").alias("_main"), blocks(k - F.col("_most._k"), w - F.col("_most._w")).alias("_lines"), blocks(k, w).alias("_blocks")
    )
    met = salted_join(rows, written(buckets, "near-dedup-mixed"), "_band", "_id")
    return written(met.select("_id", "_band", "_class", (F.col("_class") != F.col("_main")).alias("_minor"), "_lines", "_blocks"), "near-dedup-open")


def block_links(minor: list[dict], others: list[dict], band: int) -> set[tuple[int, int]]:
    """Links of each of ``minor`` to ``others``, one for each other class.  Pairs that share an earlier band meet there."""
    ids, of, bands = (np.array([r[c] for r in others]) for c in ("_id", "_class", "_bands"))
    owner = np.repeat(np.arange(len(others)), [len(r["_items"]) // 8 for r in others])
    items = np.frombuffer(b"".join(r["_items"] for r in others), np.uint64)
    counts = np.frombuffer(b"".join(r["_counts"] for r in others), "<u4").astype(np.int64)
    totals = np.bincount(owner, counts, len(others))
    kinds, at = np.unique(items, return_inverse=True)
    out = set()
    for r in minor:
        mine = np.array(r["_bands"])
        nth = int(np.flatnonzero(mine == band)[0])
        wanted = (of != r["_class"]) & ~(bands[:, :nth] == mine[:nth]).any(axis=1)
        if not wanted.any():
            continue
        x, n = np.frombuffer(r["_items"], np.uint64), np.frombuffer(r["_counts"], "<u4").astype(np.int64)
        place = np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)
        hit = kinds[place] == x
        own = np.zeros(len(kinds), np.int64)
        own[place[hit]] = n[hit]
        low = np.bincount(owner, np.minimum(own[at], counts), len(others))
        linked = np.flatnonzero(wanted & (low / (totals + n.sum() - low) >= SIMILARITY))
        _, first = np.unique(of[linked], return_index=True)
        out.update((min(r["_id"], j), max(r["_id"], j)) for j in ids[linked[first]].tolist())
    return out


def rest_links(members: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``a, b``: links between the classes of every bucket, from the full multisets; ``members`` by ``mixed_members``.

    Of two texts in different classes one at least is outside the bucket's major class; these meet all others.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.join(texts.select("_id", "_bands"), "_id").join(bags_of(members.select("_id").distinct(), docs, texts), "_id")
    deal = lambda n, *seed: F.pmod(F.xxhash64("_id", "_band", *seed), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["_id", "_band", "_class", "_bands", "_items", "_counts"]
    whole = rows.select(*own, each("_lines").alias("_line"), deal("_blocks").alias("_block"), F.lit(False).alias("_minor"))
    minor = rows.filter("_minor").select(*own, deal("_lines", F.lit(1)).alias("_line"), each("_blocks").alias("_block"), F.lit(True).alias("_minor"))
    place = ["_band", "_line", "_block"]
    ordered = whole.unionByName(minor).repartition(parts, *place).sortWithinPartitions(*place, "_minor", "_id")

    def run(it):
        for rows in groups_in_order(it, place):
            others = [r for r in rows if not r["_minor"]]
            if 0 < len(others) < len(rows):
                yield pair_batch(list(block_links(rows[len(others) :], others, rows[0]["_band"])))

    return ordered.mapInArrow(run, "a long, b long").distinct()


def linked_classes(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``_id, class_id`` of the texts that are linked to others."""
    twos, members = bucket_members(texts)
    pairs = written(likely(candidate_pairs(twos, members, texts), texts), "near-dedup-pairs")
    classes = components(verified(pairs, docs, texts))
    rest = written(rest_links(mixed_members(members, classes), texts, docs), "near-dedup-rest")
    return components(classes.select(F.col("_id").alias("a"), F.col("class_id").alias("b")).unionByName(rest))


def likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in the share that verified pairs reach (five standard errors of leeway)."""
    sig = lambda end: texts.select(F.col("_id").alias(end), F.col("_sig").alias(f"_{end}"))
    both = pairs.join(sig("a"), "a").join(sig("b"), "b")

    def run(it):
        for b in it:
            if b.num_rows:
                x, y = (np.stack([np.frombuffer(s, "<u2") for s in b.column(c).to_pylist()]) for c in ("_a", "_b"))
                keep = pa.array((x == y).mean(axis=1) >= CUT)
                yield b.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def id_filter(ids: DataFrame) -> np.ndarray:
    """One bit for each of SLOTS hash values, set if an id has it: 4 MB whatever the number of ids."""
    slot = F.pmod(F.xxhash64("_id"), F.lit(SLOTS))
    words = ids.select(F.shiftright(slot, 6).alias("w"), (slot % 64).cast("int").alias("b")).distinct()
    one = F.when(F.col("b") < 63, F.expr("shiftleft(1L, b)")).otherwise(F.lit(-(2**63)))
    table = words.groupBy("w").agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(SLOTS >> 6, np.uint64)
    out[table["w"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def bags_of(needed: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``_id, _items, _counts``: the full multisets of the texts of ``docs`` (``_id, _text``) with an id of ``needed``.

    ``texts`` has the key of the text that stands for each id.
    """
    filter_of = docs.sparkSession.sparkContext.broadcast(id_filter(needed))

    def bags(it):
        # the filter lets every needed text pass and few others; texts stay where they are, only bags move on
        for b in it:
            slot = b.column("_slot").to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((filter_of.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & U(1) == 1))
            words = [word_hashes(t) for t in b.column("_text").to_pylist()]
            found = [shingles(w) for w in words]
            columns = [b.column("_id"), pa.array(list(map(key_of, words)), pa.binary()), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "_items", "_counts"])

    slotted = docs.select("_id", "_text", F.pmod(F.xxhash64("_id"), F.lit(SLOTS)).alias("_slot"))
    own = needed.join(texts.select("_id", "_key"), "_id")
    made = slotted.mapInArrow(bags, "_id long, _key binary, _items binary, _counts binary").join(own, ["_id", "_key"], "left_semi")
    return written(made.dropDuplicates(["_id"]).drop("_key"), "near-dedup-bags")


def verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of the pairs that reach the similarity, from the full multisets of ``docs`` (``_id, _text``)."""
    made = bags_of(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), docs, texts)
    bag = lambda end: made.select(F.col("_id").alias(end), F.struct("_items", "_counts").alias(f"_{end}"))

    def run(it):
        for b in it:
            for i in range(0, b.num_rows, 64):
                some = b.slice(i, 64)
                x, y = ([(np.frombuffer(r["_items"], np.uint64), np.frombuffer(r["_counts"], "<u4")) for r in some.column(c).to_pylist()] for c in ("_a", "_b"))
                scores = np.array([overlap(p, q) for p, q in zip(x, y)])
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(scores)], names=["a", "b", "similarity"]).filter(pa.array(scores >= SIMILARITY))

    return pairs.join(bag("a"), "a").join(bag("b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """``_id, class_id``: the smallest id that each linked text is connected to, by alternating star contraction.

    Each round points every text at the smallest text around it; hubs are salted.  Rounds go on until nothing
    changes (their number grows with the logarithm of the longest chain) and each is written, not cached.
    """
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "near-dedup-links")
    before = fingerprint(edges)
    while True:
        around = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        lowest = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = salted_join(around.filter("y > x"), lowest, "x", "y").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = salted_join(large, low, "v", "u").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
        after = written(small.select("e.*").filter("v <> u").distinct(), "near-dedup-links")
        state, edges = fingerprint(after), after
        if state == before:
            return edges.select(F.col("v").alias("_id"), F.col("u").alias("class_id"))
        before = state


def fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and two combined hashes of them; equal sets have equal fingerprints."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, class_id, n_equal``.

    ``class_id`` is the smallest id of the document's class (its own if it is alone), ``n_equal`` the documents
    with the same words in the same order.  Texts without a word (null, empty, white space) are equal to each other.  Ids are whole numbers; rows
    without an id get null classes; repeated rows give repeated rows; an empty table gives no rows; other columns
    are not read.  Where unlike texts share an id, one of them (always the same) is compared with other texts for it, and
    all texts that have this id as their smallest are in its class.
    """
    docs = df.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    made = written(signatures(docs, "_id", "_text"), "near-dedup-signatures")
    keyed = made.select("_id", "_key", salt("_id").alias("_salt"))
    parts = keyed.groupBy("_key", "_salt").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_count"))
    groups = parts.groupBy("_key").agg(F.min("_first").alias("_first"), F.sum("_count").alias("n_equal"))
    firsts = groups.filter("_first IS NOT NULL").select("_key", F.col("_first").alias("_id"))
    # of unlike texts that share an id, the one with the smallest key stands for it: in signatures and multisets alike
    chosen = made.join(firsts, ["_key", "_id"], "left_semi").filter("_n > 0").groupBy("_id").agg(
        F.min_by(F.struct("_key", "_n", "_bands", "_sig"), "_key").alias("_one"))
    texts = written(chosen.select("_id", "_one.*"), "near-dedup-texts")
    classes = linked_classes(texts, docs.filter("_id IS NOT NULL"))
    answer = groups.join(classes.withColumnRenamed("_id", "_first"), "_first", "left")
    answer = answer.select("_key", F.coalesce("class_id", "_first").alias("class_id"), "n_equal")
    answer = parts.select("_key", "_salt").join(answer, "_key")
    out = keyed.join(answer, ["_key", "_salt"])
    return out.select(F.col("_id").alias(id_col), F.when(F.col("_id").isNotNull(), F.col("class_id")).alias("class_id"), "n_equal")


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, lengthened where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all columns: one document of each class (its smallest id), and rows without id.

    Rows that repeat an id with the same words give one row.  Where rows share the smallest id of a class but have unlike
    texts, each of these texts stays: an id alone doesn't make two texts copies.  An empty table gives no rows; clashing
    names of other columns do no harm.
    """
    mark, words = fresh_names(df, "_mark", "_words")
    stay = near_duplicates(df, id_col, text_col).select(F.col(id_col).cast("long").alias(mark), "class_id").filter(F.col(mark) == F.col("class_id")).select(mark).distinct()
    same = F.sha2(F.trim(F.regexp_replace(F.lower(text_of(text_col)), "[ \\t\\n\\x0B\\f\\r]+", " ")), 256)
    named = df.filter(F.col(id_col).isNotNull()).withColumn(mark, F.col(id_col).cast("long")).join(stay, mark, "left_semi")
    named = named.withColumn(words, same).dropDuplicates([mark, words]).select(*df.columns)
    return named.unionByName(df.filter(F.col(id_col).isNull()))

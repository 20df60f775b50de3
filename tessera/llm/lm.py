"""Scores of texts under language models of the training documents.

Base model: words with add-0.1 smoothing.  Counts cover all training documents; the most frequent words (at most
``HOT``, whatever the corpus) are sent to the tasks, all others meet their counts in a shuffle join.

Attention model: one causal self-attention layer over subword ids, in numpy.  It gives the distribution of the next
id's class, starting from how often each class follows the last id; within its class the id has its share of the
counts after the last id, smoothed by its share of the class.  Id and pair
counts cover all training documents, and the averaging rounds together train the layer once on each of them: tasks
train on their own windows and their parameters are averaged.  Classes and class counts are made from all pairs; the most frequent
pairs (at most ``PAIRS``) are sent to the tasks, all others meet the texts' pairs in a shuffle join.  Texts are scored in overlapping windows, many at once under a causal mask; a window's first ids are
context only, so each id is scored exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, text_of, to_batch, values_of, written
from .near_dedup import SPACE, byte_word_hashes
from .packing import loaded
from .word_bpe import chunks

HOT = 1 << 19  # as many words at most are sent to the tasks
WINDOW, CONTEXT, WIDTH, CLASSES = 32, 8, 16, 32
BUCKETS = 4096  # rows of the input embedding; ids share them by a hash
PROFILE = 16  # hashed neighbours that classes are found from
PAIRS = 1 << 19  # as many pairs at most are sent to the tasks
PAIR_SMOOTHING, CLASS_SMOOTHING = 5.0, 5.0
ROUNDS = 3  # averaging rounds; every training document trains in one of them
BATCH, RATE = 256, 1e-2
AT_ONCE = 128  # windows computed together: their arrays stay in the cache
STRIDE = WINDOW - CONTEXT


# The base model


def lower_bytes(text: str | bytes) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased."""
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def joined_words(texts: list[str]):
    """Word hashes of some texts at a time, and the number of the text that each word is of."""
    for some in groups_of(texts, 1 << 16):
        raw = [texts[i].encode() for i in some]
        data = lower_bytes(b"\n".join(raw))
        solid = np.concatenate([[False], ~SPACE[data]])
        starts = np.flatnonzero(solid[1:] > solid[:-1])
        edges = np.cumsum([len(r) + 1 for r in raw])
        yield byte_word_hashes(data), some[0] + np.searchsorted(edges, starts, side="right")


def tallied(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row and key once, with their times."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])[: len(row)])
    return row[edge], key[edge], np.diff(np.append(edge, len(row)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def key_counts(arrays):
    """Keys and counts of the keys of all arrays, in parts of which each has its keys once."""
    parts, distinct, keys, held = [], 0, [], 0
    for a in arrays:
        keys.append(a)
        held += len(a)
        if held > 2_000_000:
            parts.append(np.unique(np.concatenate(keys), return_counts=True))
            distinct += len(parts[-1][0])
            keys, held = [], 0
            if distinct > 2_000_000:
                parts = [merged(parts)]
                distinct = len(parts[0][0])
                if distinct > 1_000_000:
                    yield parts[0]
                    parts, distinct = [], 0
    if keys:
        parts.append(np.unique(np.concatenate(keys), return_counts=True))
    if parts:
        yield merged(parts) if len(parts) > 1 else parts[0]


def least_held(counts: DataFrame, column: str, most: int) -> int:
    """A count above which there are at most ``most`` rows, the smallest but for counts beyond 65536."""
    cap = 1 << 16
    table = counts.groupBy(F.least(F.col(column), F.lit(cap)).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum(column).alias("total")).toPandas()
    above = 0
    for n, rows in table.sort_values("n", ascending=False)[["n", "rows"]].itertuples(index=False):
        if above + rows > most:
            return int(n) if n < cap else int(table["total"].sum()) // most
        above += rows
    return 0


def held(counts: DataFrame, key: str, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and counts of a bounded table; each task packs its own, so that few rows reach the driver."""

    def run(it):
        table = pa.Table.from_batches(it, pa.schema([("k", pa.int64()), ("n", pa.int64())]))
        yield pa.record_batch({c: pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("k", "n")})

    rows = counts.select(F.col(key).alias("k"), F.col(column).alias("n")).mapInArrow(run, "k binary, n binary").collect()
    keys, n = (np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in ("k", "n"))
    order = np.argsort(keys)
    return keys[order], n[order]


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, c``: hash and count of every word of ``_text``; a task adds up its own before the shuffle."""

    def run(it):
        for h, c in key_counts(words for _, texts in batches(it, "_text") for words, _ in joined_words(texts)):
            yield to_batch({"h": h.view(np.int64), "c": c}, {"h": pa.int64(), "c": pa.int64()})

    return docs.select("_text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def base_scores(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``_id, _key, n_tokens, n_known, train_tokens, base_score`` of every text of ``docs``."""
    counts = written(word_counts(train), "lm-word-counts")
    ends = train.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = total["n"] + ends, total["v"] + bool(ends)
    least = least_held(counts, "c", HOT)
    hot, times = held(counts.filter(F.col("c") > least), "h", "c")  # at most HOT words
    hot = hot.view(np.uint64)
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], np.log10(times[order] + 0.1)))
    end_log = float(np.log10(ends + 0.1))

    def run(it):
        known, logs = shared.value
        for b, texts in batches(it, "_text"):
            size = len(texts)
            own, hot_n, all_n, rare = np.full(size, end_log), np.zeros(size, np.int64), np.zeros(size, np.int64), []
            for words, owner in joined_words(texts):
                order = np.argsort(words)  # words in order are found much faster
                words, owner = words[order], owner[order]
                at = np.searchsorted(known, words)
                at[at == len(known)] = 0
                is_hot = known[at] == words if len(known) else np.zeros(len(words), bool)
                own += np.bincount(owner[is_hot], logs[at[is_hot]], size)
                hot_n += np.bincount(owner[is_hot], minlength=size)
                all_n += np.bincount(owner, minlength=size)
                rare.append((owner[~is_hot], words[~is_hot]))
            row, key, times = tallied(*(np.concatenate(x) for x in zip(*rare)))
            empty = np.zeros(len(row), np.int64)
            # the texts' own rows first: hot words and the end; their keys only spread them
            h = np.concatenate([b.column("_key").to_numpy().astype(np.uint64), key])
            n, s = np.concatenate([0 * hot_n, times]), np.concatenate([own, empty.astype(float)])
            known_n, count = np.concatenate([hot_n + bool(ends), empty]), np.concatenate([all_n + 1, empty])
            rows = pa.array(np.concatenate([np.arange(size), row]))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").take(rows), b.column("_key").take(rows), pa.array(h.view(np.int64)), *map(pa.array, (n, s, known_n, count))],
                names=["_id", "_key", "h", "n", "s", "k", "t"],
            )

    schema = docs.select("_id", "_key").schema.simpleString()[7:-1] + ",h:long,n:long,s:double,k:long,t:long"
    rows = docs.select("_id", "_key", "_text").mapInArrow(run, schema)
    # most words of a text are hot; the others are rare by definition, so no key of this join is large
    met = rows.join(counts.filter(F.col("c") <= least), "h", "left")
    c = F.coalesce("c", F.lit(0))
    summed = met.groupBy("_id", "_key").agg(
        F.sum("t").alias("n_tokens"),
        F.sum(F.col("k") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("s") + F.when(F.col("n") > 0, F.col("n") * F.log10(c + 0.1)).otherwise(0.0)).alias("_sum"),
        F.count_if(F.col("t") > 0).alias("_rows"),
    )
    share = float(np.log10(tokens + 0.1 * (kinds + 1)))
    each = [(F.col(x) / F.col("_rows")).cast("long").alias(x) for x in ("n_tokens", "n_known")]
    return summed.select("_id", "_key", *each, F.lit(tokens).cast("long").alias("train_tokens"),
                         (F.col("_sum") / F.col("_rows") - (F.col("n_tokens") / F.col("_rows")) * share).alias("base_score"))


# The attention model


class PairTable:
    """Count of an id after another by open addressing; keys are last * ids + next."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.counts = np.full(size, -1, np.int64), np.zeros(size, np.float32)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):
            at = self.slot(keys[left], self.probes)
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several that want a slot the last gets it
            won = self.keys[at] == keys[left]
            self.counts[at[won]] = counts[left[won]]
            left = left[~won]
            self.probes += 1

    def __reduce__(self):
        used = self.keys >= 0
        return PairTable, (self.keys[used], self.counts[used])  # tasks get the pairs and make their own table

    def slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        first = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        return (first.astype(np.int64) + probe) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(keys), np.float32), np.arange(len(keys))
        for probe in range(self.probes):
            at = self.slot(keys[left], probe)
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.counts[at[hit]]
            left = left[~hit & (self.keys[at] >= 0)]
        return out


@dataclass
class Attention:
    """What the corpus gave and the layer's parameters.

    ``class_of`` each id; ``share`` of each id in its class; ``after`` (last id or beginning x classes): how often a
    class follows, as counts and as log probabilities; ``pairs``: how often an id follows.
    """

    class_of: np.ndarray
    share: np.ndarray
    after_count: np.ndarray
    after: np.ndarray
    pairs: PairTable
    parameters: dict[str, np.ndarray]

    @property
    def end(self) -> int:
        return len(self.class_of) - 1

    def log_in_class(self, last: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log probability of each target in its class after the last id (or -1)."""
        before = np.where(last < 0, len(self.class_of), last)
        return self.log_of_counts(before, targets, self.pairs.get(before * (self.end + 1) + targets))

    def log_of_counts(self, before: np.ndarray, targets: np.ndarray, together: np.ndarray) -> np.ndarray:
        """The same from how often each target follows ``before`` (the beginning: the number of ids)."""
        of_class = self.after_count[before, self.class_of[targets]]
        return np.log((together + PAIR_SMOOTHING * self.share[targets]) / (of_class + PAIR_SMOOTHING))


SHAPES = {"embed": (BUCKETS + 1, WIDTH), "place": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
          "o": (WIDTH, WIDTH), "out": (WIDTH, CLASSES)}


def first_parameters() -> dict[str, np.ndarray]:
    """Small fixed random numbers; with ``out`` near 0 the layer starts from the counts."""
    rng = np.random.default_rng(12345)
    scale = {"embed": 0.1, "place": 0.1, "out": 0.01}
    return {k: (rng.standard_normal(s) * scale.get(k, 0.25)).astype(np.float32) for k, s in SHAPES.items()}


def bucket_of(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


@lru_cache(maxsize=4)
def buckets(size: int) -> np.ndarray:
    """Bucket of each id; the last, and so that of -1, is the beginning's."""
    return np.append(bucket_of(np.arange(size)), BUCKETS)


def windows(streams: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets (windows x WINDOW), which of them count, and the stream each window is of.

    Inputs are the ids before each target, -1 where the text begins.  Targets of a later window count after its
    first CONTEXT places, so every id and the end count once.
    """
    sizes = np.array([len(s) + 1 for s in streams])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    flat = np.full(int((sizes + 1).sum()), end, np.int64)
    flat[starts] = -1
    for at, s in zip(starts, streams):
        flat[at + 1 : at + 1 + len(s)] = s
    number = np.maximum(1, -(-(sizes - CONTEXT) // STRIDE))
    owner = np.repeat(np.arange(len(streams)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    at = nth[:, None] * STRIDE + np.arange(WINDOW)
    inside = at < sizes[owner][:, None]
    index = starts[owner][:, None] + np.where(inside, at, 0)
    counted = inside & ((nth == 0)[:, None] | (np.arange(WINDOW) >= CONTEXT))
    return flat[index], flat[index + 1], counted, owner


MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
SCALE = np.float32(WIDTH**-0.5)
LARGEST = np.float32(60)  # exponents are kept within this, so sums of exponentials need no shift


CELLS = np.arange((BUCKETS + 1) * WIDTH).reshape(-1, WIDTH)


def hidden(model: Attention, inputs: np.ndarray, first: int = 0) -> dict:
    """The layer's hidden values of each place from ``first`` on, with what led to them.

    Queries meet keys, and values the output, in the products of their matrices: ``q`` is of the inputs themselves,
    ``mixed`` are mixed inputs.  ``a`` is the attention before it is normalised, ``by`` what normalises it.
    """
    p = model.parameters
    bucket = buckets(model.end + 1).take(inputs)
    x = p["embed"].take(bucket, axis=0)
    x += p["place"]
    own = x[:, first:]
    q = own @ (p["q"] @ p["k"].T * SCALE)
    a = q @ x.transpose(0, 2, 1)
    np.clip(a, -LARGEST, LARGEST, out=a)
    np.exp(a, out=a)
    a *= MASK[first:]
    by = 1 / (a @ np.ones((WINDOW, 1), a.dtype))  # sums along short rows are much faster as products
    mixed = a @ x
    mixed *= by
    return {"first": first, "bucket": bucket, "x": x, "q": q, "a": a, "by": by, "mixed": mixed}


def class_logits(start: np.ndarray, out: np.ndarray, values: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """Logits of the classes for rows of values and the ids before them; they start from ``start`` of the id."""
    logits = values @ out
    logits += start.take(inputs, axis=0)  # the last row is the beginning's
    return np.clip(logits, -LARGEST, LARGEST, out=logits)


def forward(model: Attention, inputs: np.ndarray, targets: np.ndarray, first: int = 0) -> tuple[np.ndarray, dict]:
    """Log probability of the class of each target from place ``first`` on, and what the backward pass needs."""
    kept, p = hidden(model, inputs, first), model.parameters
    h = kept["mixed"].reshape(-1, WIDTH) @ (p["v"] @ p["o"])
    h += kept["x"][:, first:].reshape(-1, WIDTH)
    logits = class_logits(model.after, p["out"], h, inputs[:, first:].ravel())
    cell = model.class_of.take(targets[:, first:].ravel())
    cell += np.arange(0, logits.size, CLASSES)
    own = logits.ravel().take(cell)
    e = np.exp(logits, out=logits)
    total = e @ np.ones(CLASSES, e.dtype)
    return (own - np.log(total)).reshape(kept["q"].shape[:2]), kept | {"h": h, "e": e, "total": total, "cell": cell}


def gradients(model: Attention, kept: dict, counted: np.ndarray, of: int | None = None, dx_out: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of the mean negative log probability over the counted targets, or of their sum divided by ``of``.

    Uses up ``kept["e"]``.  With ``dx_out`` the gradients of the inputs go there and those of ``embed`` are left to the caller.
    """
    p, first, x, q = model.parameters, kept["first"], kept["x"], kept["q"]
    flat = lambda t: t.reshape(-1, t.shape[-1])
    mine = counted[:, first:].ravel()
    share = mine.astype(kept["total"].dtype)
    share /= max(1, int(mine.sum()) if of is None else of)
    d = kept["e"]
    d *= (share / kept["total"])[:, None]
    d.reshape(-1)[kept["cell"]] -= share
    own, mixed = flat(x[:, first:]), flat(kept["mixed"])
    g = {"out": kept["h"].T @ d}
    dh = d @ p["out"].T
    vo = mixed.T @ dh
    g["v"], g["o"] = vo @ p["o"].T, p["v"].T @ vo
    dm = dh @ (p["v"] @ p["o"]).T
    # over a place's weights, the sum of weight x its gradient is that of the mixed value x its gradient
    through = np.einsum("ij,ij->i", dm, mixed).reshape(*q.shape[:2], 1)
    dm = dm.reshape(q.shape)
    dm *= kept["by"]
    through *= kept["by"]
    ds = dm @ x.transpose(0, 2, 1)
    ds -= through
    ds *= kept["a"]
    dq = flat(ds @ x)
    qk = own.T @ dq
    qk *= SCALE
    g["q"], g["k"] = qk @ p["k"], qk.T @ p["q"]
    dx = np.matmul(ds.transpose(0, 2, 1), q, out=dx_out)
    dx += kept["a"].transpose(0, 2, 1) @ dm
    dh += dq @ (p["q"] @ p["k"].T * SCALE).T
    dx[:, first:] += dh.reshape(q.shape)
    g["place"] = dx.sum(axis=0)
    if dx_out is None:
        g["embed"] = embed_gradients(kept["bucket"], dx)
    return g


def embed_gradients(bucket: np.ndarray, dx: np.ndarray) -> np.ndarray:
    return np.bincount(CELLS.take(bucket.ravel(), axis=0).ravel(), dx.ravel(), CELLS.size).reshape(CELLS.shape).astype(dx.dtype)


def batch_gradients(model: Attention, x: np.ndarray, y: np.ndarray, counted: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of a batch; windows of which only places after their context count are computed from there on."""
    total, of = {}, int(counted.sum())
    dx, buckets_of = np.empty((*x.shape, WIDTH), model.parameters["embed"].dtype), []
    starts, done = counted[:, :CONTEXT].any(axis=1), 0
    for some, first in ((np.flatnonzero(~starts), CONTEXT), (np.flatnonzero(starts), 0)):
        for at in range(0, len(some), AT_ONCE):
            part = some[at : at + AT_ONCE]
            kept = forward(model, x[part], y[part], first)[1]
            buckets_of.append(kept["bucket"])
            g = gradients(model, kept, counted[part], of, dx[done : done + len(part)])
            done += len(part)
            for k in g:
                total[k] = total[k] + g[k] if k in total else g[k]
    return total | {"embed": embed_gradients(np.concatenate(buckets_of), dx)}


def trained(model: Attention, streams_of) -> int:
    """Adam steps over the windows of the streams, in place; the number of ids seen."""
    first = {k: np.zeros_like(v) for k, v in model.parameters.items()}
    second = {k: np.zeros_like(v) for k, v in model.parameters.items()}
    step = seen = 0
    for streams in streams_of:
        x, y, counted, _ = windows(streams, model.end)
        order = np.random.default_rng(step).permutation(len(x))
        for at in range(0, len(x), BATCH):
            some = order[at : at + BATCH]
            step += 1
            seen += int(counted[some].sum())
            for name, g in batch_gradients(model, x[some], y[some], counted[some]).items():
                m, s = first[name], second[name]
                m *= np.float32(0.9)
                m += np.float32(0.1) * g
                s *= np.float32(0.99)
                g *= g
                g *= np.float32(0.01)
                s += g
                by = np.sqrt(s, out=g)
                by *= np.float32((1 - 0.99**step) ** -0.5)
                by += np.float32(1e-8)
                by = np.divide(m, by, out=by)
                by *= np.float32(RATE / (1 - 0.9**step))
                model.parameters[name] -= by
    return seen


def class_logs(model: Attention, start: np.ndarray, out: np.ndarray, inputs: np.ndarray, targets: np.ndarray, counted: np.ndarray, first: int) -> np.ndarray:
    """Log probability of the class of each counted target; none before ``first`` counts.

    ``start`` holds the logits that come of the id before, ``out`` makes those that come of the mixed inputs.
    """
    kept, p = hidden(model, inputs, first), model.parameters
    mine = counted[:, first:].ravel()
    logits = (p["place"] @ p["out"])[first:] + (kept["mixed"].reshape(-1, WIDTH) @ out).reshape(len(inputs), -1, CLASSES)
    logits = logits.reshape(-1, CLASSES)
    logits += start.take(inputs[:, first:].ravel(), axis=0)
    np.clip(logits, -LARGEST, LARGEST, out=logits)
    own = logits.ravel().take(np.arange(0, logits.size, CLASSES) + model.class_of.take(targets[:, first:].ravel()))
    return (own - np.log(np.exp(logits, out=logits) @ np.ones(CLASSES, logits.dtype)))[mine]


def stream_scores(model: Attention, streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each stream of ids, its end included; stream, key and times of the pairs that the model doesn't hold."""
    p, size = model.parameters, model.end + 1
    start, out = model.after + (p["embed"] @ p["out"]).take(buckets(size), axis=0), p["v"] @ p["o"] @ p["out"]
    sums, rows, keys = np.zeros(len(streams)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for group in groups_of(streams, BATCH * STRIDE * 2):
        some = [streams[i] for i in group]
        own = np.repeat(np.arange(len(group)), [len(s) + 1 for s in some])
        targets = np.concatenate([part for s in some for part in (s, [model.end])])
        before = np.concatenate([part for s in some for part in ([size], s)])
        key = before * size + targets
        together = model.pairs.get(key)
        total = np.bincount(own, model.log_of_counts(before, targets, together), len(group))
        rare = together == 0
        rows.append(group[0] + own[rare])
        keys.append(key[rare])
        x, y, counted, owner = windows(some, model.end)
        # the first window of a text counts from its beginning, later ones after their context
        for of, first in ((np.flatnonzero(counted[:, 0]), 0), (np.flatnonzero(~counted[:, 0]), CONTEXT)):
            for at in range(0, len(of), AT_ONCE):
                part = of[at : at + AT_ONCE]
                mine = counted[part]
                logs = class_logs(model, start, out, x[part], y[part], mine, first)
                total += np.bincount(np.repeat(owner[part], mine.sum(axis=1)), logs, len(group))
        sums[group] = total
    return sums / np.log(10), *tallied(np.concatenate(rows), np.concatenate(keys))


def log_probabilities(model: Attention, streams: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each stream of ids, its end included."""
    return stream_scores(model, streams)[0]


def groups_of(streams: list, size: int) -> list[list[int]]:
    """Consecutive streams (or texts) in groups of about ``size`` ids (characters)."""
    out, now, held = [], [], 0
    for i, s in enumerate(streams):
        now.append(i)
        held += len(s)
        if held >= size:
            out, now, held = [*out, now], [], 0
    return [*out, now] if now else out


# Its steps in Spark


def encoded(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``_id, _key, _held, _ids``: subword ids of each text as packed bytes."""

    def run(it):
        source = loaded(vocab_path)
        for b, texts in batches(it, "_text"):
            for some in groups_of(texts, 1 << 20):
                start, cut = some[0], [chunks(texts[i]) for i in some]
                ids = pa.array(list(map(b"".join, values_of(source.memory, cut))), pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(start, len(cut)) for c in ("_id", "_key", "_held")), ids], names=["_id", "_key", "_held", "_ids"])

    schema = docs.select("_id", "_key", "_held").schema.simpleString()[7:-1] + ",_ids:binary"
    return docs.select("_id", "_key", "_held", "_text").mapInArrow(run, schema)


def streams_in(b: pa.RecordBatch, dtype: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype).astype(np.int64) for x in b.column("_ids").to_pylist()]


def counted_rows(counts: dict[str, np.ndarray]):
    """Rows (what, at, n) of the counts that are not 0."""
    for what, c in counts.items():
        at = np.flatnonzero(c)
        yield to_batch({"what": [what] * len(at), "at": at, "n": c[at]}, {"what": pa.string(), "at": pa.int64(), "n": pa.int64()})


def gathered(rows: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Sums of the tasks' counts; their number is bounded by the vocabulary, not by the corpus."""
    table = rows.groupBy("what", "at").agg(F.sum("n").alias("n")).toPandas()
    out = {k: np.zeros(n) for k, n in sizes.items()}
    for what, part in table.groupby("what"):
        out[what][part["at"].to_numpy()] = part["n"].to_numpy()
    return out


def id_counts(train: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    """Counts of every id, and of the end as the last, in all training texts."""

    def run(it):
        out = np.zeros(size, np.int64)
        for b in it:
            if b.num_rows:
                out += np.bincount(np.concatenate(streams_in(b, dtype)), minlength=size)
                out[-1] += b.num_rows
        yield from counted_rows({"id": out})

    return gathered(train.select("_ids").mapInArrow(run, "what string, at long, n long"), {"id": size})["id"]


def pair_counts(train: DataFrame, size: int, dtype: np.dtype) -> DataFrame:
    """``at, n``: how often an id follows another (or the beginning) in all training texts."""

    def run(it):
        pairs = (np.append(size, x) * size + np.append(x, size - 1) for b in it for x in streams_in(b, dtype))
        for at, n in key_counts(pairs):
            yield to_batch({"at": at, "n": n}, {"at": pa.int64(), "n": pa.int64()})

    return train.select("_ids").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


def profile_of(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """How often each id has each hashed neighbour before it, then the same for neighbours after it, as one row of numbers."""
    last, following = keys // size, keys % size
    inner = last < size
    return np.concatenate([
        np.bincount(following[inner] * PROFILE + bucket_of(last[inner]) % PROFILE, counts[inner], size * PROFILE),
        np.bincount(last[inner] * PROFILE + bucket_of(following[inner]) % PROFILE, counts[inner], size * PROFILE),
    ])


def after_of(keys: np.ndarray, counts: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """How often each class follows each id (or the beginning), as one row of numbers."""
    size = len(class_of)
    return np.bincount(keys // size * CLASSES + class_of[keys % size], counts, (size + 1) * CLASSES)


def summed_over(pairs: DataFrame, what: str, width: int, of) -> np.ndarray:
    """Sum of ``of(keys, counts)`` over the whole pair table; its width is bounded by the vocabulary."""

    def run(it):
        out = np.zeros(width)
        for b in it:
            if b.num_rows:
                out += of(b.column("at").to_numpy(), b.column("n").to_numpy().astype(float))
        yield from counted_rows({what: out.astype(np.int64)})

    # every batch costs one pass over the whole array, so batches are made long
    return gathered(pairs.select("at", "n").mapInArrow(lambda it: run(long_batches(it)), "what string, at long, n long"), {what: width})[what]


def long_batches(it, rows: int = 1 << 19):
    """Batches of about ``rows`` rows."""
    held, count = [], 0
    for b in it:
        held.append(b)
        count += b.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def classes_of(profile: np.ndarray, size: int) -> np.ndarray:
    """Classes of ids with alike neighbours: k-means over the vocabulary; ids without any go to the last class."""
    profile = np.concatenate(profile.reshape(2, size, PROFILE), axis=1)
    mass = profile.sum(axis=1)
    used = np.flatnonzero(mass > 0)
    out = np.full(size, CLASSES - 1)
    if len(used) < CLASSES:
        out[used] = np.arange(len(used)) % (CLASSES - 1)
        return out
    overall = (profile.sum(axis=0) + 1) / (profile.sum() + profile.shape[1])
    x = np.sqrt((profile[used] + 4 * overall) / (mass[used, None] + 4))
    weight = np.sqrt(mass[used])
    centres = x[np.argsort(-mass[used], kind="stable")[: CLASSES - 1]]
    for _ in range(15):
        near = np.argmax(2 * x @ centres.T - (centres**2).sum(axis=1), axis=1)
        total = np.bincount(near, weight, CLASSES - 1)
        sums = np.stack([np.bincount(near, weight * c, CLASSES - 1) for c in x.T], axis=1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centres)
    out[used] = near
    return out


def from_counts(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray, class_of: np.ndarray | None = None, after: np.ndarray | None = None) -> Attention:
    """The model before training, from id counts and pair counts; ``class_of`` and ``after`` if those are of some pairs only."""
    size = len(ids)
    if class_of is None:
        class_of = classes_of(profile_of(keys, counts, size), size)
    smooth = ids + 0.05
    mass = np.bincount(class_of, smooth, CLASSES)
    after = (after_of(keys, counts, class_of) if after is None else after).reshape(size + 1, CLASSES)
    overall = (mass + 1e-6) / (mass + 1e-6).sum()
    log_after = np.log((after + CLASS_SMOOTHING * overall) / (after.sum(axis=1, keepdims=True) + CLASS_SMOOTHING))
    return Attention(class_of, (smooth / mass[class_of]).astype(np.float32), after.astype(np.float32), log_after.astype(np.float32),
                     PairTable(keys, counts), first_parameters())


def in_round(r: int) -> Column:
    """Whether a text trains in a round."""
    return F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(ROUNDS)) == r


def fit(train: DataFrame, vocabulary: int, dtype: np.dtype) -> tuple[Attention, DataFrame]:
    """Fit the attention model on ``_id, _ids`` rows; also ``at, n`` of the pairs that it doesn't hold."""
    spark = train.sparkSession
    size = vocabulary + 1
    ids = id_counts(train, size, dtype)
    pairs = written(pair_counts(train, size, dtype), "lm-pairs")
    least = least_held(pairs, "n", PAIRS)
    class_of = classes_of(summed_over(pairs, "profile", 2 * size * PROFILE, lambda at, n: profile_of(at, n, size)), size)
    after = summed_over(pairs, "after", (size + 1) * CLASSES, lambda at, n: after_of(at, n, class_of))
    at, times = held(pairs.filter(F.col("n") > least), "at", "n")  # at most PAIRS
    model = from_counts(ids, at, times.astype(float), class_of, after)
    edges = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])

    def run(it, shared):
        own = replace(shared.value, parameters={k: v.copy() for k, v in shared.value.parameters.items()})
        seen = trained(own, (streams_in(b, dtype) for b in it if b.num_rows))
        if seen:
            flat = np.concatenate([own.parameters[k].ravel() for k in SHAPES]).astype(np.float64)
            yield to_batch({"at": np.arange(len(flat)), "value": flat, "weight": np.full(len(flat), seen)}, {"at": pa.int64(), "value": pa.float64(), "weight": pa.int64()})

    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast(replace(model, pairs=PairTable(np.zeros(0, np.int64), np.zeros(0))))  # training needs no pairs
        some = train.filter(in_round(r)).select("_ids")
        rows = some.mapInArrow(lambda it, shared=shared: run(it, shared), "at long, value double, weight long")
        mean = F.sum(F.col("value") * F.col("weight")) / F.sum("weight")
        table = rows.groupBy("at").agg(mean.alias("value")).orderBy("at").toPandas()  # as many as parameters
        if len(table):
            flat = table["value"].to_numpy(np.float32)
            model = replace(model, parameters={k: flat[a:b].reshape(s) for (k, s), a, b in zip(SHAPES.items(), edges, edges[1:])})
    return model, pairs.filter(F.col("n") <= least)


def rare_gains(rare: DataFrame, share: np.ndarray) -> DataFrame:
    """``at, gain``: log10 that the count of a pair adds to the score of a text each time it has the pair."""
    shared = rare.sparkSession.sparkContext.broadcast(share)

    def run(it):
        for b in it:
            at = b.column("at").to_numpy()
            gain = np.log10(1 + b.column("n").to_numpy() / (PAIR_SMOOTHING * shared.value[at % len(shared.value)].astype(float)))
            yield to_batch({"at": at, "gain": gain}, {"at": pa.int64(), "gain": pa.float64()})

    return rare.select("at", "n").mapInArrow(run, "at long, gain double")


def score_texts(df: DataFrame, held_out, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` of whole texts.

    ``held_out`` is a boolean column; the models learn from the rows where it is false.  Words are runs without
    ASCII white space with A-Z lower-cased, and each text has one end.  ``score`` is the attention model's log10
    probability of the text's subword ids and end.  Null counts as empty.  Rows that repeat an id with an equal
    text give one row; unlike texts of one id, or of no id, give a row each.  Without training rows the counts are 0 and scores come from the smoothing alone; an empty
    table gives no rows.  Other columns are not read.
    """
    small_batches(df.sparkSession)
    picked = df.select(F.col(id_col).alias("_id"), F.coalesce(held_out, F.lit(False)).alias("_held"), text_of(text_col).alias("_text"))
    # 63 bits of id and text: rows that share an id, or have none, stay apart by their texts, and so are spread
    docs = picked.withColumn("_key", F.shiftrightunsigned(F.xxhash64("_id", "_text"), 1))
    base = base_scores(docs, docs.filter(~F.col("_held")))
    ids = written(encoded(docs, vocab_path), "lm-ids")
    source = loaded(vocab_path)
    vocabulary, dtype = source.tokenizer.get_vocab_size(with_added_tokens=True), source.dtype
    fitted, rare = fit(ids.filter(~F.col("_held")), vocabulary, dtype)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(it):
        for b in it:
            if b.num_rows:
                streams = streams_in(b, dtype)
                own_score, row, key, times = stream_scores(model.value, streams)
                # the text's own row first, at a key that no pair has, then its rare pairs
                own = np.arange(len(streams))
                at = np.concatenate([-1 - b.column("_key").to_numpy().astype(np.int64), key])
                n, s = np.concatenate([0 * own, times]), np.concatenate([own_score, np.zeros(len(row))])
                rows = pa.array(np.concatenate([own, row]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("_id", "_key", "_held")), pa.array(at), pa.array(n), pa.array(s)],
                                                 names=["_id", "_key", "_held", "at", "n", "s"])

    schema = ids.select("_id", "_key", "_held").schema.simpleString()[7:-1] + ",at:long,n:long,s:double"
    met = ids.mapInArrow(run, schema).join(rare_gains(rare, fitted.share), "at", "left")
    summed = F.sum(F.col("s") + F.col("n") * F.coalesce("gain", F.lit(0.0)))
    scored = met.groupBy("_id", "_key").agg(F.first("_held").alias("held_out"), (summed / F.count_if(F.col("n") == 0)).alias("score"))
    same = scored["_id"].eqNullSafe(base["_id"]) & (scored["_key"] == base["_key"])
    out = scored.join(base, same)
    return out.select(scored["_id"].alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

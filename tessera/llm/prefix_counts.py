"""Exact token counts of every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

For a prefix of a piece, the last token of its encoding is the one token that ends there and is compatible
with the last token of what stands before it; its count is one more than the count of that shorter prefix.
An automaton over the vocabulary walks a piece once and names, at each byte, just the tokens that end there.
Two tokens are compatible when encoding their joined bytes gives just these two.  One pass over a piece so
stores, for every prefix, its exact count, and truncation or budget questions are look-ups: nothing is encoded
again.

Pieces follow the split pattern of byte-level vocabularies.  The counts are those of each prefix as a text
by itself: inside white space the run so far is one piece, and an unfinished contraction is not one yet.
Special strings inside texts are one token each, the library's default.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, batches, small_batches, text_of, to_batch
from .word_bpe import ID_BITS, ID_MASK, NONE, byte_letters, merge, merge_table

# Runs of white space with what follows.  A piece never holds white space after another character, so a cut
# before each run is certain.  The control characters are white space to Python only.
CHUNK = re.compile(r"\s*\S+|\s+")
CHUNK_CONTROL = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+")
CONTROL = re.compile("[\x1c-\x1f]")
SPACE_RUN = regex.compile(r"\s+")
PIECE = regex.compile(public_tokenizers.PATTERN)
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Prefix counts for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        special = set(self.special)
        self.id_of = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.merges = merge_table(spec)
        self.single = [vocab[c] for c in letters]
        # The two parts of each token and the rank of the merge that joins them; none for single bytes.
        self.parts = {made & ID_MASK: (a, b, made >> ID_BITS) for (a, b), made in self.merges.items()}
        self.one_way = len(self.parts) == len(self.merges)
        self.right_edges: dict[int, list] = {}
        self.left_edges: dict[int, list] = {}
        self.stable = {i: merge([self.single[c] for c in b], self.merges) == [i] for i, b in self.bytes_of.items()}
        self.ending = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.ending.add_word(b.decode("latin-1"), (i, len(b)))
        self.ending.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge while ``token`` is built, each with the rank that ends its time there."""
        out, until = [], NONE
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until = self.parts[token][2]
            token = self.parts[token][side]

    def joins(self, a: int, b: int) -> bool:
        """Whether, while two tokens are built side by side, some merge reaches across their border.

        Both edges are walked up in time.  The pair at the border merges if its rank comes before the left token's edge
        moves on (equal ranks: the left one goes first) and no later than the right one's.
        """
        left = self.right_edges.get(a) or self.right_edges.setdefault(a, self.edge(a, 1))
        right = self.left_edges.get(b) or self.left_edges.setdefault(b, self.edge(b, 0))
        get, i, j = self.merges.get, 0, 0
        while True:
            x, x_until = left[i]
            y, y_until = right[j]
            made = get((x, y))
            if made is not None:
                rank = made >> ID_BITS
                if rank < x_until and rank <= y_until:
                    return True
            if x_until <= y_until:
                if x_until == NONE:
                    return False
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joined bytes of two tokens are encoded as just these two."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        if self.one_way:
            known = self.stable[a] and self.stable[b] and not self.joins(a, b)
        else:  # a token that several merges make has no one history
            known = merge([self.single[c] for c in self.bytes_of[a] + self.bytes_of[b]], self.merges) == [a, b]
        self.pairs[a, b] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Token counts of every non-empty byte prefix of one piece."""
        pairs, stable, compatible = self.pairs, self.stable, self.compatible
        counts, last, done = [0], [-1], -1
        for end, (token, size) in self.ending.iter(data.decode("latin-1")):
            if end == done:  # the one token of this prefix is found
                continue
            start = end + 1 - size
            if start:
                before = last[start]
                fits = pairs.get((before, token))
                if fits is None:
                    fits = compatible(before, token)
            else:
                fits = stable[token]
            if fits:
                counts.append(counts[start] + 1)
                last.append(token)
                done = end
        del counts[0]
        return counts

    def chunk(self, text: str) -> array:
        """Token counts of every non-empty character prefix of a chunk (no special strings)."""
        out = array("I")
        base = 0
        for piece in PIECE.findall(text):
            data = piece.encode()
            counts = self.piece(data)
            if len(data) == len(piece):
                out.extend([base + c for c in counts] if base else counts)
            else:
                at = -1
                for ch in piece:
                    at += len(ch.encode())
                    out.append(base + counts[at])
            if piece in LONG_CONTRACTIONS:
                out[-2] = base + 2
            base += counts[-1]
        if text[0].isspace() and (run := SPACE_RUN.match(text)) and run.end() > 1:
            alone = self.piece(run[0].encode())
            at = -1
            for i, ch in enumerate(run[0]):
                at += len(ch.encode())
                if i + 1 < len(text):
                    out[i] = alone[at]
        return out

    def prefixes(self, text: str) -> array:
        """Token counts of every non-empty character prefix of a whole text, special strings included."""
        out = array("I")
        base = 0
        parts = self.special_split.split(text)
        for i in range(0, len(parts), 2):
            marker = parts[i + 1] if i + 1 < len(parts) else ""
            shown = array("I")
            at = 0
            for c in chunks(parts[i] + marker[:-1]):
                counts = self.chunk(c)
                shown.extend(at + x for x in counts)
                at += counts[-1]
            own = self.total(parts[i]) if marker else at
            out.extend(base + x for x in shown)
            if marker:
                out.append(base + own + 1)
            base += own + bool(marker)
        return out

    def total(self, text: str) -> int:
        return sum(self.chunk(c)[-1] for c in chunks(text))


def chunks(text: str) -> list[str]:
    return CHUNK_CONTROL.findall(text) if CONTROL.search(text) else CHUNK.findall(text)


_LOADED: dict[str, PrefixCounter] = {}


def loaded(path: str) -> PrefixCounter:
    """The counter of a file, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def longest_prefix(tables: list, limit: int) -> int:
    """Characters of the longest prefix with at most ``limit`` tokens, from the chunks' prefix tables."""
    at = chars = 0
    for t in tables:
        if at + t[-1] > limit:
            return chars + max((i + 1 for i, c in enumerate(t) if at + c <= limit), default=0)
        at += t[-1]
        chars += len(t)
    return chars


def token_counts(df: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit, fit_chars`` of whole texts.

    ``n_bytes`` is the UTF-8 length, ``over_limit`` whether there are more than ``limit`` tokens, ``fit_chars``
    the characters of the longest prefix within the limit.  Null counts as empty: 0, 0, false, 0.  Repeated rows
    give repeated rows, an empty table none; other columns are not read.
    """
    small_batches(df.sparkSession)
    types = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_(), "fit_chars": pa.int64()}

    def run(it):
        counter = loaded(vocab_path)
        memory = Recent(lambda keys: map(counter.chunk, keys), 400_000)
        for b, texts in batches(it, "_text"):
            for start in range(0, len(texts), 50):
                some = texts[start : start + 50]
                marked = [any(s in t for s in counter.special) for t in some]
                cut = [[] if m else chunks(t) for t, m in zip(some, marked)]
                known = memory.ready(set().union(*cut))
                tables = [[counter.prefixes(t)] if m else [known[c] for c in cs] for t, m, cs in zip(some, marked, cut)]
                totals = [sum(t[-1] for t in ts) for ts in tables]
                out = to_batch(
                    {
                        "n_bytes": [len(t.encode()) for t in some],
                        "n_tokens": totals,
                        "over_limit": [n > limit for n in totals],
                        "fit_chars": [longest_prefix(ts, limit) if n > limit else len(t) for t, ts, n in zip(some, tables, totals)],
                    },
                    types,
                )
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(start, len(some)), *out.columns], names=["_id", *types])

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    schema = f"_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return picked.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def prefix_token_counts(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, counts array<int>``: the exact token count of every non-empty character prefix of each text."""
    small_batches(df.sparkSession)

    def run(it):
        counter = loaded(vocab_path)
        for b, texts in batches(it, "_text"):
            for i, t in enumerate(texts):
                counts = pa.array([list(counter.prefixes(t))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(i, 1), counts], names=["_id", "counts"])

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return picked.mapInArrow(run, f"_id {id_type}, counts array<int>").withColumnRenamed("_id", id_col)

"""Byte-pair encoding of words with forced-boundary splitting, and decoding.

A vocabulary tells which two bytes ever stand next to each other inside a token.  Where a text has two
neighbours that no token has, no merge can reach across, so that place is a certain cut: the fragments
between such cuts are encoded independently and their ids concatenated, with the same result as encoding the
whole.  Words (the pieces of the vocabulary's own split pattern) are cut the same way, for free.

``WordBpe`` reads the public file of a tokenizer: BPE over bytes with an end-of-word mark, NFC, lower case,
white space dropped.  Ids of distinct words and of distinct chunks (runs without white space) are
remembered per worker, within a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, batches, small_batches, text_of, to_batch

END = "</w>"
CONTROL = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pre = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in pre if p["type"] == "Split"))
        self.merges = merge_table(spec)
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + END] for c in letters]
        inside = bytearray(65536)
        for token in vocab:
            body = token[: -len(END)] if token.endswith(END) else token
            codes = [byte_of[c] for c in body]
            for a, b in zip(codes, codes[1:]):
                inside[a << 8 | b] = 1
        self.inside = bytes(inside)
        self.words = Recent(lambda keys: (self.encode_word(k.encode()) for k in keys), 300_000)
        self.spelt = Recent(lambda keys: (self.spelling(self.encode_word(k.encode())) for k in keys), 300_000)

    def cuts(self, word: bytes) -> list[int]:
        """Certain cuts of a word: places between two bytes that are neighbours in no token."""
        inside = self.inside
        return [i for i in range(1, len(word)) if not inside[word[i - 1] << 8 | word[i]]]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one piece: its fragments between certain cuts, concatenated; only the last has the end mark."""
        out: list[int] = []
        start, inner, merges = 0, self.inner, self.merges
        for end in self.cuts(word):
            out += merge([inner[b] for b in word[start:end]], merges)
            start = end
        return out + merge([*(inner[b] for b in word[start:-1]), self.last[word[-1]]], merges)

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space, or of any text."""
        out: list[int] = []
        for part in self.special_split.split(chunk) if self.special_split and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                pieces = self.pieces.findall(normal(part))
                known = self.words.ready(pieces)
                for piece in pieces:
                    out += known[piece]
        return out

    def spelling(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, the ids as decimal text and the decoded text, both joined by one space."""
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def spell_chunks(self, chunks: list[str]) -> Iterator[tuple[int, str, str]]:
        """``spelling`` of every chunk, put together from the spellings of its pieces; all pieces are looked up at once."""
        find, marked = self.pieces.findall, bool(self.special_split)
        pieces = [None if marked and "<" in c else find(normal(c)) for c in chunks]
        known = self.spelt.ready([p for ps in pieces if ps for p in ps])
        for chunk, ps in zip(chunks, pieces):
            if ps is None:
                yield self.spelling(self.encode_chunk(chunk))
            elif len(ps) == 1:
                yield known[ps[0]]
            elif ps:
                got = [known[p] for p in ps]
                yield sum(g[0] for g in got), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])
            else:
                yield 0, "", ""

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by one space, end marks and byte letters as they are."""
        return " ".join(map(self.tokens.__getitem__, ids))


def normal(text: str) -> str:
    """NFC, then the lower case of each character by itself (no final-sigma rule)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def chunks(text: str) -> list[str]:
    """Runs without white space.  Cuts there are certain too: no piece of the split pattern holds white space."""
    return CHUNK.findall(text) if CONTROL.search(text) else text.split()


def merge_table(spec: dict) -> dict[tuple[int, int], int]:
    """(left id, right id) -> rank and made id as one number, lower for lower ranks."""
    vocab = spec["model"]["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return {(vocab[a], vocab[b]): rank << ID_BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}


ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NONE = 1 << 62


def merge(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """Apply merges, lowest rank first and from the left, until none fits."""
    if len(ids) > 64:
        return _merge_long(ids, merges)
    ids = list(ids)
    get = merges.get
    found = [get(p, NONE) for p in zip(ids, ids[1:])]
    while found:
        best = min(found)
        if best == NONE:
            break
        i = found.index(best)
        ids[i] = best & ID_MASK
        del ids[i + 1], found[i]
        if i < len(found):
            found[i] = get((ids[i], ids[i + 1]), NONE)
        if i:
            found[i - 1] = get((ids[i - 1], ids[i]), NONE)
    return ids


def _merge_long(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """The same with a heap over a linked list, for long fragments."""
    ids = list(ids)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        m, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = m & ID_MASK, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (m := merges.get((ids[i], ids[k]))) is not None:
                heapq.heappush(heap, (m, i, ids[i], ids[k]))
        if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))) is not None:
            heapq.heappush(heap, (m, h, ids[h], ids[i]))
    return [x for x in ids if x >= 0]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The encoder of a file, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_texts(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts: ``id_col, ids array<int>``.

    Null and empty texts give an empty array; repeated rows give repeated rows; an empty table gives no
    rows.  Other columns are not read.
    """
    return _per_text(df, vocab_path, id_col, text_col, "ids array<int>", {"ids": pa.list_(pa.int32())}, _ids_of)


def encode_digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode whole texts and digest both: ``id_col, n_tokens, ids_sha256, decoded_sha256``.

    The digests are of the decimal ids joined by one space and of the decoded text in UTF-8.  Null counts as
    empty (0 tokens, digests of the empty string).
    """
    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _per_text(df, vocab_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", types, _digests_of)


def decode_ids(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids: ``id_col, text`` (null ids give empty text)."""

    def run(it):
        bpe = loaded(vocab_path)
        for b in it:
            texts = [bpe.decode(x or []) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return picked.mapInArrow(run, f"_id {id_type}, text string").withColumnRenamed("_id", id_col)


def _ids_of(bpe: WordBpe, memory: Recent, texts: list[list[str]], known: dict) -> dict:
    return {"ids": [[int(i) for c in cs for i in known[c][1].split()] for cs in texts]}


def _digests_of(bpe: WordBpe, memory: Recent, texts: list[list[str]], known: dict) -> dict:
    counts, ids, decoded = [], [], []
    for cs in texts:
        got = [v for c in cs if (v := known[c])[0]]
        counts.append(sum(v[0] for v in got))
        ids.append(hashlib.sha256(" ".join(v[1] for v in got).encode()).hexdigest())
        decoded.append(hashlib.sha256(" ".join(v[2] for v in got).encode()).hexdigest())
    return {"n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}


def _per_text(df: DataFrame, path: str, id_col: str, text_col: str, columns: str, types: dict, of: Callable) -> DataFrame:
    small_batches(df.sparkSession)

    def run(it):
        bpe = loaded(path)

        memory = Recent(bpe.spell_chunks, 350_000)
        for b, texts in batches(it, "_text"):
            for start in range(0, len(texts), 50):
                cut = [chunks(t) for t in texts[start : start + 50]]
                known = memory.ready(set().union(*cut))
                ids = b.column("_id").slice(start, len(cut))
                out = to_batch(of(bpe, memory, cut, known), types)
                yield pa.RecordBatch.from_arrays([ids, *out.columns], names=["_id", *out.schema.names])

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return picked.mapInArrow(run, f"_id {id_type}, {columns}").withColumnRenamed("_id", id_col)

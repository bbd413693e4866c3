"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

The model file (its path is a parameter) is parsed here; nothing is trained. A text is cut into words at spaces, which no
piece crosses. New words of a batch go through merge rounds together, whatever their length: their symbols lie in one flat array
with the rank of every adjacent pair; each round takes the least rank of each word by a segmented minimum, merges its
occurrences in all words at once, from the left, looks up the pairs that this made, and compacts the arrays; words without a pair
left are done. Where a merge makes a pair of less rank, that one is due first, so the occurrences after it wait for a later
round. Known words are kept in a table that is emptied when it grows too large.

Defined results: null text gives null ids, null count and null round_trip; empty text gives no ids; a literal U+2581 is
decoded as a space, as the format has it, so round_trip is false there; texts are encoded whole. Equal rows give equal
results; an empty table an empty one; other columns pass through unchanged, those named like a result are replaced.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Words in a worker's table before it is emptied; only memory depends on it.
KNOWN = 400_000
NONE = np.iinfo(np.int64).max
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, pair ranks and byte pieces of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, score, kind, norm = [], [], [], {}
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                score.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kind.append(p.get(3, 1))
            elif number == 3:
                norm = dict(_fields(value))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a BPE model")
        if norm.get(2) or norm.get(4, 1):
            raise ValueError("models that change the text before encoding aren't supported")
        self.prefix = bool(norm.get(3, 1))
        n = len(self.pieces)
        self.id = {p: i for i, p in enumerate(self.pieces) if kind[i] in (1, 4, 5)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space after another character")
        self.byte = np.full(256, -1, np.int32)
        out = [p.replace(SPACE, " ").encode() if kind[i] in (1, 4, 5) else b"" for i, p in enumerate(self.pieces)]
        for i, p in enumerate(self.pieces):
            if kind[i] == 6:
                self.byte[int(p[1:-1], 16)] = i
                out[i] = bytes([int(p[1:-1], 16)])
        order = sorted(self.id.values(), key=lambda i: (-score[i], i))
        rank = {i: r for r, i in enumerate(order)}
        keys, merged, ranks = [], [], []
        for p, i in self.id.items():
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    merged.append(i)
                    ranks.append(rank[i])
        by = np.argsort(keys)
        self.n, self.key, self.merged, self.rank = n, np.array(keys, np.int64)[by], np.array(merged, np.int32)[by], np.array(ranks, np.int64)[by]
        self.flat = np.frombuffer(b"".join(out), np.uint8)
        self.size = np.array([len(x) for x in out], np.int64)
        self.start = np.cumsum(self.size) - self.size

    # --- encoding

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs of symbols, NONE where they don't merge, and what they merge to."""
        key = np.where((a < self.n) & (b < self.n), a * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE), self.merged[at]

    def merge_rounds(self, words: list[str]) -> list[list[int]]:
        """Symbols of each word after all merges; an unknown character c is n + its code point."""
        cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        known, back = np.unique(cp, return_inverse=True)
        sym = np.array([self.id.get(chr(c), self.n + c) for c in known.tolist()], np.int64)[back] if len(cp) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank, to = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], to[inner] = self.pairs(sym[inner], sym[inner + 1])
        out: list[list[int]] = [[] for _ in words]
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            keep = np.ones(len(sym), bool)
            if done.any():
                for s, n in zip(starts[done].tolist(), length[done].tolist()):
                    out[word[s]] = sym[s : s + n].tolist()
                keep = np.repeat(~done, length)
            hit = np.flatnonzero((rank == np.repeat(least, length)) & keep)
            # of overlapping occurrences the first, third, ... merge
            run = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1)) if len(hit) else hit
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            if len(hit):
                # a merge that makes a pair of less rank comes last in its round
                own, new = rank[hit], to[hit]
                before, after = hit - 1, np.minimum(hit + 2, len(sym) - 1)
                left = sym[before]
                chained = np.append(False, hit[1:] == hit[:-1] + 2)
                left = np.where(chained, np.append(0, new[:-1]), left)
                better = ((hit > 0) & (word[before] == word[hit]) & (self.pairs(left, new)[0] < own)) | ((hit + 2 < len(sym)) & (word[after] == word[hit]) & (self.pairs(new, sym[after])[0] < own))
                if better.any():
                    group = np.flatnonzero(np.append(True, word[hit[1:]] != word[hit[:-1]]))
                    n = np.diff(np.append(group, len(hit)))
                    earlier = np.cumsum(better) - better
                    fine = earlier == np.repeat(earlier[group], n)
                    hit, new = hit[fine], new[fine]
                sym[hit] = new
                keep[hit + 1] = False
            now = (np.cumsum(keep) - 1)[hit]
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            for at in (now, now[now > 0] - 1):
                whole = at[at < len(sym) - 1]
                rank[at] = NONE
                whole = whole[word[whole] == word[whole + 1]]
                rank[whole], to[whole] = self.pairs(sym[whole], sym[whole + 1])
        return out

    def finish(self, symbols: list[int]) -> list[int]:
        """Ids, with unknown characters as bytes."""
        if max(symbols, default=0) < self.n:
            return symbols
        return list(chain.from_iterable([s] if s < self.n else self.byte[list(chr(s - self.n).encode())].tolist() for s in symbols))

    def encoder(self):
        """A function from texts to (ids, offsets) with a table of known words of its own."""
        known: dict[str, int] = {}
        flat, start, size = np.zeros(1 << 20, np.int32), np.zeros(KNOWN * 2, np.int64), np.zeros(KNOWN * 2, np.int64)
        used = 0

        def learn(new: list[str]) -> None:
            nonlocal flat, start, size, used
            for w, s in zip(new, self.merge_rounds(new)):
                ids, k = self.finish(s), len(known)
                if used + len(ids) > len(flat):
                    flat = np.concatenate([flat, np.zeros(len(flat) + len(ids), np.int32)])
                if k >= len(start):
                    start, size = np.concatenate([start, start]), np.concatenate([size, size])
                flat[used : used + len(ids)] = ids
                start[k], size[k] = used, len(ids)
                used += len(ids)
                known[w] = k

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal used
            units = [_UNIT.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
            new = [w for w in dict.fromkeys(chain.from_iterable(units)) if w not in known]
            if len(known) > KNOWN or used > 8 * KNOWN:
                known.clear()
                used, new = 0, list(dict.fromkeys(chain.from_iterable(units)))
            learn(new)
            counts = [len(u) for u in units]
            w = np.fromiter(map(known.__getitem__, chain.from_iterable(units)), np.int64, sum(counts))
            n = size[w]
            ids = flat[np.repeat(start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))]
            return ids, ends

        return encode

    # --- decoding

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of the texts, without the space that encoding puts first."""
        n = self.size[ids]
        data = self.flat[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        off = np.append(0, np.cumsum(n))[ends]
        if self.prefix:
            first = off[:-1][off[1:] > off[:-1]]
            first = first[data[first] == 32]
            keep = np.ones(len(data), bool)
            keep[first] = False
            data, off = data[keep], off - np.searchsorted(first, off)
        return data, off


@functools.cache
def model(path: str = MODEL) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with token_ids, n_tokens and round_trip (whether decoding the ids gives the text)."""
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    docs = docs.drop(*(f.name for f in added))

    def run(batches):
        m = model(path)
        enc = m.encoder()
        for whole in batches:
            _, off = C.text_buffer(whole.column(whole.schema.get_field_index("text")), lower=False)
            for lo, hi in C.steps(off):
                b = whole.slice(lo, hi - lo)
                text = b.column(b.schema.get_field_index("text"))
                buf, own = C.text_buffer(text, lower=False)
                ids, ends = enc([t or "" for t in text.to_pylist()])
                data, back = m.decode(ids, ends)
                same = np.diff(own) == np.diff(back)
                if same.all():
                    wrong = np.flatnonzero(data != buf)
                    same[np.searchsorted(own, wrong, "right") - 1] = False
                else:
                    for d in np.flatnonzero(same):
                        same[d] = np.array_equal(data[back[d] : back[d + 1]], buf[own[d] : own[d + 1]])
                null = np.array(text.is_null())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.diff(ends), mask=null), pa.array(same, mask=null)], [*b.schema.names, "token_ids", "n_tokens", "round_trip"])

    return C.arrow(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded with decoded_text, from token_ids; bytes that are no UTF-8 become U+FFFD, null ids null."""
    encoded = encoded.drop("decoded_text")

    def run(batches):
        m = model(path)
        for b in batches:
            lists = b.column(b.schema.get_field_index("token_ids"))
            counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            data, off = m.decode(ids.astype(np.int64), np.append(0, np.cumsum(counts)))
            raw = data.tobytes()
            texts = [None if not lists[k].is_valid else raw[off[k] : off[k + 1]].decode(errors="replace") for k in range(len(counts))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded_text"])

    return C.arrow(encoded).mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded_text", T.StringType())]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")

"""BPE encoding and decoding with a public word-end vocabulary (operator 4).

Method: numpy merge rounds over batches.  The symbols of many words lie in one flat array; each round looks all adjacent
pairs up by binary search over the sorted pair keys, takes the lowest rank of each word, and merges all its occurrences.
Words are encoded once: a worker keeps the letters and ids of words it has met, found by 64-bit hash in sorted arrays; every
word's letters are compared with those kept before the ids are used, and a word whose hash belongs to another is encoded anew.

Edge cases: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole; the
vocabulary's own special strings in a text become their special ids, as the tokenizers library makes them by default;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from boscage.llm._bytes import U, mix, ragged, span_hash
from boscage.llm._common import text_slices

#: Words that a worker remembers; beyond it the memory starts anew.  It bounds memory and never changes results.
REMEMBER = 1_000_000
#: The letters that follow an apostrophe in the vocabulary's pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: White space of the vocabulary's pattern.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, DIGIT, OTHER = range(4)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else one counted up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file; a worker builds it once and keeps it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name
        self.names = pa.array(names, pa.string())
        self.numbers = pa.array([str(i) for i in range(size)], pa.string())
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.classes = np.full(0x110000, 255, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U)
        self.at, self.size, self.begin, self.width = (np.zeros(0, np.int64) for _ in range(4))
        self.letters = np.zeros(0, np.uint32)
        self.ids = np.zeros(0, np.uint16 if len(self.names) <= 1 << 16 else np.int32)

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point; what hasn't been seen is looked up once."""
        out = self.classes[points]
        if (out == 255).any():
            for p in np.unique(points[out == 255]).tolist():
                kind = unicodedata.category(chr(p))[0]
                self.classes[p] = SPACE if p in SPACES else LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
            out = self.classes[points]
        return out

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no rule for a last sigma

    def split(self, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the pattern's matches: contractions, runs of letters, single numbers, runs of others."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.classify(points)
        cut = np.zeros(n + 1, bool)
        cut[rows] = True
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= cut[:n] | (kind == DIGIT)
        mark = np.flatnonzero(start & (points == 39))
        if len(mark):
            ahead = np.zeros((3, len(mark)), np.int64)
            for i in (1, 2):
                near = mark + i < n
                ahead[i, near] = points[mark[near] + i]
                ahead[i, near] *= ~cut[mark[near] + i] & (ahead[i - 1, near] > 0 if i == 2 else True)
            for c in CONTRACTIONS:
                fits = (ahead[1] == ord(c[0])) & (ahead[2] == ord(c[1]) if len(c) == 2 else True)
                at = mark[fits]
                start[at + 1] = False
                rest = at + 1 + len(c)
                rest = rest[rest < n]
                start[rest] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        real = kind[begin] != SPACE
        return begin[real], end[real]

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the flat symbols of words with `counts` symbols each; returns their ids and new counts."""
        done_ids, done_word = [], []
        word = np.repeat(np.arange(len(counts)), counts)
        none = np.int64(1 << 40)
        while len(symbols):
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(symbols)))
            over = np.repeat(best == none, size)
            if over.any():
                done_ids.append(symbols[over])
                done_word.append(word[over])
            each = np.repeat(best, size)
            hit = (rank == each) & ~over
            run = np.flatnonzero(hit)
            if len(run):  # of touching occurrences every second one, from the left
                new = np.append(True, np.diff(run) != 1)
                place = np.arange(len(run)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(run))))
                run = run[place % 2 == 0]
                symbols = symbols.copy()
                symbols[run] = self.made[rank[run]]
            keep = ~over
            keep[run + 1] = False
            symbols, word = symbols[keep], word[keep]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        of = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(counts))

    def fresh(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids) of words given by their code points end to end."""
        raw = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
        data = np.frombuffer(raw, np.uint8)
        bytes_of = np.where(flat < 0x80, 1, np.where(flat < 0x800, 2, np.where(flat < 0x10000, 3, 4)))
        counts = np.add.reduceat(bytes_of, np.cumsum(size) - size)
        symbols = self.first[data]
        tail = np.cumsum(counts) - 1
        symbols[tail] = self.last[data[tail]]
        return self.merge(symbols, counts)

    def learn(self, flat: np.ndarray, width: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new words and remember them."""
        ids, sizes = self.fresh(flat, width)
        known = np.append(self.known, hashes)
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        for name, new in (("at", len(self.ids) + np.cumsum(sizes) - sizes), ("size", sizes), ("begin", len(self.letters) + np.cumsum(width) - width), ("width", width)):
            setattr(self, name, np.append(getattr(self, name), new)[order])
        self.ids = np.append(self.ids, ids.astype(self.ids.dtype))
        self.letters = np.append(self.letters, flat.astype(np.uint32))

    def strangers(self, points: np.ndarray, start: np.ndarray, width: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of the words whose letters are not those remembered at `at`."""
        off = self.width[at] != width
        same = np.flatnonzero(~off)
        if len(same):
            size = width[same]
            place = ragged(size)
            differ = points[place + np.repeat(start[same], size)] != self.letters[place + np.repeat(self.begin[at[same]], size)]
            if differ.any():
                off[same] = np.logical_or.reduceat(differ, np.cumsum(size) - size)
        return np.flatnonzero(off)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text)."""
        parts, own, inserted = [], [], []
        for i, text in enumerate(texts):
            todo = [text or ""]
            for s in self.special:
                if text and s in text:
                    todo = [y for x in todo for y in (_between(x, s) if isinstance(x, str) else [x])]
            for x in todo:
                if isinstance(x, str):
                    parts.append(self.normal(x))
                    own.append(i)
                else:
                    inserted.append((len(parts), self.special[x[0]], i))
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        rows = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        start, end = self.split(points, rows)
        width = end - start
        hashes, index, back = np.unique(span_hash(mix(points.astype(U)), start, end), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        near = at < len(self.known)
        new[near] = self.known[at[near]] != hashes[near]
        pick = lambda i: points[np.repeat(start[i], width[i]) + ragged(width[i])]
        if new.any():
            self.learn(pick(index[new]), width[index[new]], hashes[new])
            at = np.searchsorted(self.known, hashes)
        at = at[back]
        size, begin, held = self.size[at], self.at[at], self.ids
        if len(odd := self.strangers(points, start, width, at)):
            ids, sizes = self.fresh(pick(odd), width[odd])
            size[odd], begin[odd] = sizes, len(held) + np.cumsum(sizes) - sizes
            held = np.append(held, ids.astype(held.dtype))
        ids = held[np.repeat(begin, size) + ragged(size)].astype(np.int64)
        of = np.array(own, np.int64)[np.searchsorted(rows, start, "right") - 1] if len(start) else np.zeros(0, np.int64)
        counts = np.bincount(of, weights=size, minlength=len(texts)).astype(np.int64)
        if inserted:
            part = np.repeat(np.searchsorted(rows, start, "right") - 1, size)
            where = np.searchsorted(part, [x[0] for x in inserted], "left")
            ids = np.insert(ids, where, [x[1] for x in inserted])
            counts += np.bincount([x[2] for x in inserted], minlength=len(texts))
        return ids, counts

    def joined(self, ids: np.ndarray, counts: np.ndarray, strings: pa.Array) -> pa.Array:
        """The strings of the ids of each text, joined by one space."""
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(pa.array(ids)).cast(pa.large_string())), pa.scalar(" ", pa.large_string()))


def _between(text: str, mark: str) -> list:
    out: list = []
    for i, x in enumerate(text.split(mark)):
        out += [(mark,), x] if i else [x]
    return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, column: str = "text"):
    """(batch, ids, counts) for slices of the Arrow batches."""
    own = codec(path)
    for batch in text_slices(batches, column):
        yield (batch, *own.encode(batch.column(batch.schema.get_field_index(column)).to_pylist()))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every text."""

    def run(batches):
        for batch, ids, counts in encode_batches(batches, path, text):
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], [key, "ids"])

    picked = docs.select(key, text)
    return picked.mapInArrow(run, f"`{key}` {picked.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the vocabulary's strings of the ids joined by spaces, which is its decoding.  Null ids: empty text."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            lists = batch.column(1)
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            text = own.joined(np.asarray(lists.flatten()), counts, own.names)
            yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], [key, "text"])

    picked = encoded.select(key, ids)
    return picked.mapInArrow(run, f"`{key}` {picked.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: encoded, digested, decoded and digested again."""

    def run(batches):
        own = codec(path)
        for batch, ids, counts in encode_batches(batches, path):
            digests = [[hashlib.sha256(x.as_buffer()).hexdigest() for x in own.joined(ids, counts, s)] for s in (own.numbers, own.names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), *(pa.array(d, pa.string()) for d in digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token at each place. A token
may follow another only if encoding both texts together would give exactly these two; that
table of pairs is filled as pairs are met. Where the longest token does not fit, the encoder
takes the longest token that is its prefix, and where none fits it takes back the token
before. The automaton passes over a piece twice at most, and every place is marked at most once as
a dead end, so time is linear in the text.

Nulls count as empty texts, which have no ids. A text of any length is encoded whole; rows that
repeat are encoded each. Special tokens that stand in a text become their ids, as in the
tokenizers library. The key and other columns are only carried.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Entries that a task remembers of units, words and pairs; full tables start anew.
REMEMBERED = 200_000


def _alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: the split of byte-level tokenizers that bring none of their own (contractions, letters, numbers, other signs, white space).
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def refuse_unless_byte_level(spec: dict) -> None:
    """Raise for a tokenizer file whose steps aren't those that this encoder takes."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer") or not plain:
        raise ValueError("only byte-level BPE with the usual split, no normalizer and no leading space is read")


class Bpe:
    """A byte-level BPE read from a tokenizers JSON file whose merges rank as their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_unless_byte_level(spec)
        table = _alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(table[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        own = {self.bytes[i]: i for t, i in vocab.items() if t not in self.special}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            c = vocab[left + right]
            self.merge[a, b] = c
            if self.parts[c] is None:
                self.parts[c] = (a, b)
        self.find = ahocorasick.Automaton()
        for token, i in own.items():
            self.find.add_word(token.decode("latin-1"), i)
        self.find.make_automaton()
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for token, i in own.items():
            self.shorter[i] = next((own[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in own), -1)
        self.len = [len(x) for x in self.bytes]
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(BYTE_LEVEL_SPLIT).findall
        self.units = regex.compile(r"\s*\S+|\s+").findall
        self.odd = regex.compile(r"\s |^\s|\s$").search
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}
        self.offsets = np.concatenate(([0], np.cumsum(self.len))).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between these two tokens when their bytes stand side by side.

        Merges run in the order of their ids. Taking the later of the two apart step by step
        shows the parts that met at the border at each time; a merge of such parts that ranks
        before what made them would have crossed it.
        """
        bound = 1 << 60
        while True:
            made = self.merge.get((a, b))
            if made is not None and made < bound:
                return False
            left, right = self.parts[a], self.parts[b]
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                bound, a = a, left[1]
            else:
                bound, b = b + 1, right[0]

    def _fit(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = self.compatible(a, b)
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece that the split left whole."""
        text = data.decode("latin-1")
        n, lens, fits, shorter, find = len(data), self.len, self.fits, self.shorter, self.find
        out: list[int] = []
        at, last, dead = 0, -1, None
        run = [token for _, token in find.iter_long(text)]
        if len(run) == 1 and not self.reaches(run[0]):
            run = [shorter[run[0]]]
        k, longest = 0, None
        while True:
            if k == len(run):
                # A token was shortened, so the first pass says nothing of what follows.
                if longest is None:
                    longest = array("i", bytes(4 * n))
                    for end, t in find.iter(text):
                        longest[end + 1 - lens[t]] = t  # the last end from a place on is the farthest
                run, k = (longest[at],), 0
            token = run[k]
            size = lens[token]
            pair = (last, token)
            if last < 0 or (fits[pair] if pair in fits else self._fit(last, token)):
                if dead is None or not dead[at + size]:
                    out.append(token)
                    at += size
                    if at == n:
                        return out
                    last = token
                    k += 1
                    continue
            token = shorter[token]
            while token < 0:
                if dead is None:
                    dead = bytearray(n + 1)
                dead[at] = 1
                token = out.pop()
                at -= lens[token]
                token = shorter[token]
            last = out[-1] if out else -1
            run, k = (token,), 0

    @cache  # noqa: B019  one object a process
    def reaches(self, token: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        ids = list(self.bytes[token])
        base = self._base()
        ids = [base[b] for b in ids]
        while len(ids) > 1:
            made = min((self.merge.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:])))
            if made[0] == 1 << 60:
                return False
            pair = (ids[made[1]], ids[made[1] + 1])
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(made[0])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids == [token]

    @cache  # noqa: B019
    def _base(self) -> dict[int, int]:
        return {x[0]: i for i, x in enumerate(self.bytes) if len(x) == 1}

    def _unit(self, unit: str) -> bytes:
        """Ids, four bytes each, of a run of white space with what follows it; borders before white space are never crossed."""
        ids: list[int] = []
        words = self.words
        for piece in self.split(unit):
            got = words.get(piece)
            if got is None:
                got = self.encode_bytes(piece.encode("utf-8"))
                if len(piece) < 64:
                    if len(words) >= REMEMBERED:
                        words.clear()
                    words[piece] = got
            ids += got
        return array("I", ids).tobytes()

    def _recall(self, units: list[str], known: dict[str, bytes], lead: str) -> list[bytes]:
        """The ids of lead + unit for each unit; known: those of units met before."""
        out = list(map(known.get, units))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    unit = units[i]
                    got = known.get(unit)
                    if got is None:
                        got = self._unit(lead + unit)
                        if len(unit) < 64:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[unit] = got
                    out[i] = got
        return out

    def _plain(self, text: str, out: list[bytes]) -> None:
        if self.odd(text) is None:
            first, *rest = text.split(" ")
            out += self._recall([first], self.known, "")
            out += self._recall(rest, self.spaced, " ")
        else:
            out += self._recall(self.units(text), self.known, "")

    def encode(self, text: str | None) -> np.ndarray:
        out: list[bytes] = []
        if text:
            at = 0
            for m in self.special_at.finditer(text) if self.special_at else ():
                if m.start() > at:
                    self._plain(text[at : m.start()], out)
                out.append(array("I", [self.special[m[0]]]).tobytes())
                at = m.end()
            if at < len(text):
                self._plain(text[at:] if at else text, out)
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        if not len(ids):
            return ""
        place = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
        return self.blob[place].tobytes().decode("utf-8", "replace")


@cache
def load(path: str) -> Bpe:
    """The tokenizer of a file, once for each worker process."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, column: str = "ids") -> DataFrame:
    """docs' columns in keep (all if None) and the ids as array<int>; path: a tokenizers JSON file on every node."""
    names = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in _rows(batch):
                ids = [bpe.encode(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=[*names, column])

    schema = docs.select(*names).schema.add(column, T.ArrayType(T.IntegerType()))
    source = docs if text in names else docs.select(*names, text)
    return source.mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, n: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes each whole text, decodes the ids, and hashes both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, one, two = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                one.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                two.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Token ids in bit-packed files: encoding with the tokenizers library, writing, reading back, random access.

A file holds the documents of one run of ascending doc_id:

    magic "LFTK", version u32, width u32 (bits an id), block u32 (ids a block),
    part u32, piece u32 (the file's place), n_docs u64, n_ids u64
    doc table: id i64, has_id u8, n_ids u64 a document
    block offsets: u64 for each block of ids, in bytes from the payload's start
    payload: each block's ids in width bits, the lowest bit first, padded to a whole byte
    one closing byte 0x0A

A block starts at its offset, so any block is unpacked alone and any run of ids reads only its
blocks. Spark's own writers lay down and commit the files (a row is a whole file), so a lost
task leaves none behind, and any file system that Spark reaches will do.
"""

from __future__ import annotations

import json
import io
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.llm.bpe import _alphabet

MAGIC = b"LFTK"
_HEAD = struct.Struct("<4sIIIIIQQ")
#: Ids a block, and ids after which a file ends (a longer document makes a longer file).
BLOCK, FILE_IDS = 4096, 1 << 22
#: Words that a task remembers; a full table starts anew.
REMEMBERED = 600_000


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in the given number of bits each, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    n = len(ids)
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).reshape(n * bits), bitorder="little").tobytes()


def unpack(data: bytes | memoryview | np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def build(docs: list[tuple[int | str | None, np.ndarray]], bits: int, part: int, piece: int, block: int = BLOCK) -> bytes:
    """A file, without its closing byte, of (doc_id, ids) in order. Ids that are texts lie, in UTF-8, behind the table, which holds their sizes; such a file is of version 2."""
    names = [d.encode() if isinstance(d, str) else None for d, _ in docs]
    texts = any(x is not None for x in names)
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    table = np.zeros(len(docs), [("id", "<i8"), ("has", "u1"), ("n", "<u8")])
    for i, (d, x) in enumerate(docs):
        table[i] = ((len(names[i] or b"") if texts else d or 0), d is not None, len(x))
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:-1].astype("<u8") if blocks else np.zeros(0, "<u8")
    return _HEAD.pack(MAGIC, 1 + texts, bits, block, part, piece, len(docs), len(ids)) + table.tobytes() + b"".join(x or b"" for x in names) + offsets.tobytes() + b"".join(blocks)


class TokenFile:
    """A file, read without unpacking what isn't asked for. data: its bytes, or a file that can be sought, of which ids() reads only the blocks it needs."""

    def __init__(self, data: bytes | BinaryIO):
        self.file = io.BytesIO(data) if isinstance(data, bytes | bytearray | memoryview) else data
        magic, version, self.bits, self.block, self.part, self.piece, self.n_docs, self.n_ids = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        kind = np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u8")])
        at = _HEAD.size
        table = np.frombuffer(self._read(at, kind.itemsize * self.n_docs), kind)
        at += table.nbytes
        ids = table["id"].tolist()
        if version == 2:
            sizes = [n if has else 0 for n, has in zip(ids, table["has"].tolist())]
            held, ids, b = self._read(at, sum(sizes)), [], 0
            for n in sizes:
                ids.append(held[b : b + n].decode())
                b += n
            at += len(held)
        self.doc_ids = [i if h else None for i, h in zip(ids, table["has"].tolist())]
        self.offsets = np.frombuffer(self._read(at, 8 * -(-self.n_ids // self.block)), "<u8")
        self.base = at + self.offsets.nbytes
        self.sizes = table["n"].astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], from the blocks that hold them alone."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        full = -(-self.block * self.bits // 8)
        begin = int(self.offsets[first])
        held = memoryview(self._read(self.base + begin, int(self.offsets[last]) + full - begin))
        out = [unpack(held[int(self.offsets[b]) - begin :][:full], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class WordCache(dict):
    """The tokenizers library's ids by white-space-separated word; a word not yet known is worked out when asked for.

    The tokenizer splits at white space and drops it, lower-cases character by character and
    composes no character with a space, so a text's ids are its words' ids in a row. Two things
    reach past a word: the lower case of a capital sigma depends on what stands beside it, and
    str.split() takes four control characters for white space. Texts with either go to the
    library whole.

    Words of printable ASCII and Latin-1 letters are cut by the tokenizer file's own split
    pattern, and only the pieces go to the library's model: composition leaves such words as they
    are, and pieces such as a word without its full stop recur where words don't. All other
    words, and those with an added token, take the library's whole path.
    """

    whole = re.compile("[\u03a3\x1c-\x1f]").search
    simple = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        plan = json.loads(self.library.to_str())
        self.added = re.compile("|".join(re.escape(t["content"].lower()) for t in plan["added_tokens"]) or "(?!)").search
        self.model = self.library.model
        self.cut = _pieces(plan)
        #: The byte-level alphabet: the library spells each byte of a piece as one character.
        self.letters = {b: c for c, b in _alphabet().items()}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        low = word.lower()
        if self.cut is None or self.simple(word) is None or self.added(low):
            found = np.array(self.library.encode_batch_fast([word], add_special_tokens=False)[0].ids, "<u4").tobytes()
        else:
            pieces = self.cut(low)
            found = self._piece(low) if pieces == [word] else b"".join(map(self.__getitem__, pieces))
        self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [
            np.frombuffer(b"".join(map(self.__getitem__, t.split())), "<u4")
            if self.whole(t) is None
            else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4")
            for t in texts
        ]


def _pieces(plan: dict) -> Callable[[str], list[str]] | None:
    """The tokenizer file's split of a lower-case word, if its steps are those that WordCache relies on; else None."""
    normal = [n["type"] for n in (plan["normalizer"] or {}).get("normalizers", [])]
    steps = (plan["pre_tokenizer"] or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    split, spell = steps
    if split["behavior"] != "Removed" or not split["invert"] or spell["add_prefix_space"] or spell["use_regex"]:
        return None
    return regex.compile(split["pattern"]["Regex"]).findall


@cache
def load(path: str) -> WordCache:
    return WordCache(path)


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", tasks: int | None = None) -> None:
    """Encode each whole text (null: empty), append end_id, and write the ids to out in ascending key order.

    Null keys come first; equal keys keep any order among themselves. Keys that aren't whole numbers are ordered and stored as texts.
    """
    spark = docs.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, piece, held, n = load(tokenizer), TaskContext.get().partitionId(), 0, [], 0
        bits = width(max(words.size, end_id + 1))
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                rows = batch.slice(at, 300)
                texts = ["" if t is None else t for t in rows.column(1).to_pylist()]
                for d, x in zip(rows.column(0).to_pylist(), words.encode(texts)):
                    held.append((d, np.concatenate((x, end))))
                    n += len(x) + 1
                if n >= FILE_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([build(held, bits, part, piece)], pa.binary())], names=["file"])
                    piece, held, n = piece + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([build(held, bits, part, piece)], pa.binary())], names=["file"])

    kind = "long" if docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    ordered = docs.select(F.col(key).cast(kind).alias("k"), F.col(text).alias("t")).repartitionByRange(tasks, "k").sortWithinPartitions("k")
    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("maxRecordsPerFile", 1).text(out)


def read(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """Per document of the files under path: doc_id of that kind (long or string), start (ids of all documents before), n_tokens, ids_crc32."""
    id_type = pa.int64() if kind == "long" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                f = TokenFile(data.as_py())
                crc = [zlib.crc32(f.document(i).astype("<u4").tobytes()) for i in range(f.n_docs)]
                n = f.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in (([f.part] * n, pa.int32()), ([f.piece] * n, pa.int32()), (f.doc_ids, id_type), (f.starts[:-1], pa.int64()), (f.sizes, pa.int64()), (crc, pa.int64()), ([f.n_ids if i == 0 else None for i in range(n)], pa.int64()))],
                    names=["part", "piece", "doc_id", "within", "n_tokens", "ids_crc32", "total"],
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    docs = files.mapInArrow(run, f"part int, piece int, doc_id {kind}, within long, n_tokens long, ids_crc32 long, total long")
    return docs


def _starts(files: DataFrame) -> DataFrame:
    """(part, piece, lead): the ids before each file, from (part, piece, total), one row a file."""
    parts = files.groupBy("part").agg(F.sum("total").alias("whole"))
    before = parts.withColumn("lead", F.coalesce(F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "lead")
    own = files.withColumn("own", F.coalesce(F.sum("total").over(Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(before, "part").select("part", "piece", (F.col("lead") + F.col("own")).alias("lead"))


def read_documents(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """read() with each document's global start: a running sum over the files, of which there is one row each."""
    from linkforge.session import settled

    docs = settled(read(spark, path, kind), "token-docs")
    starts = _starts(docs.where("total is not null").select("part", "piece", "total"))
    return docs.join(starts, ["part", "piece"]).select("doc_id", (F.col("lead") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """(start, ids): the ids of all documents in a row from start, for each part of the given ranges (start, stop) that lies in one file.

    Heads of files are read first, then of each file that a range meets only the blocks that hold it. Files are opened
    through pyarrow's file systems.
    """
    def opened(uri: str) -> tuple[object, TokenFile]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(uri)
        f = system.open_input_file(at)
        return f, TokenFile(f)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                f, t = opened(uri)
                with f:
                    found.append((uri, t.part, t.piece, t.n_ids))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["path", "part", "piece", "total"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, lead, total in zip(*(batch.column(i).to_pylist() for i in range(3))):
                f, t = opened(uri)
                with f:
                    for a, b in ranges:
                        lo, hi = max(a, lead), min(b, lead + total)
                        if lo < hi:
                            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([t.ids(lo - lead, hi - lead).astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    # The path column alone: no content is read.
    files = spark.read.format("binaryFile").load(path).select("path").mapInArrow(heads, "path string, part int, piece int, total long")
    placed = files.join(_starts(files.select("part", "piece", "total")), ["part", "piece"])
    met = F.exists(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges)), lambda r: (r["a"] < F.col("lead") + F.col("total")) & (r["b"] > F.col("lead")))
    return placed.where(met).select("path", "lead", "total").mapInArrow(pieces, "start long, ids array<long>")

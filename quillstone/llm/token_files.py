"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A partition is two files.  ``.bin`` holds the ids of its documents, one after the
other, as little-endian unsigned integers of 2 bytes (4 where the vocabulary does
not fit).  ``.idx`` holds, as little-endian 64-bit integers, a format number, the
bytes of an id, the number of documents n, n+1 offsets into ``.bin`` counted in
ids, the n document ids, and n flags that are 0 for a null document id.
"""

from __future__ import annotations

import json
import os
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.numbering import partitions
from quillstone.llm.staging import digest, new_path, stage
from quillstone.llm.words import _SPACE, short, utf8

FORMAT = 20240501
HEADER = 3
#: Pieces, and bytes of pieces, that a worker remembers before it starts anew (under 150 MB).
POOL_PIECES, POOL_BYTES = 500_000, 16_000_000
#: Ids that the reader takes from a file at once, unless a document is longer.
READ_IDS = 1 << 20
#: New pieces that are encoded as the lines of one text.
LINES = 256


#: Printable ASCII by kind: letters 1, digits 2, signs 3, the apostrophe 4 (contractions begin with it); other bytes 0.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x27] = 4
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
#: Whether text is cut where one kind follows another.
_CUT = np.zeros((5, 5), bool)
_CUT[1:3, 1:] = _CUT[3, 1:3] = True
_CUT[1, 1] = _CUT[2, 2] = False


def units(data: np.ndarray, offsets: np.ndarray, kinds: bool = False) -> np.ndarray:
    """Starts of pieces that a byte-level pre-tokeniser never joins.

    A piece is a run without ASCII white space with the one blank before it, or
    the rest of a white-space run (all but its last character, if text follows).
    With ``kinds`` a run is cut also between ASCII letters, digits and signs, as
    GPT-2's pattern does; after an apostrophe, which may begin a contraction, it is not.
    """
    n = len(data)
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = edge[:-1].copy()
    before, blank = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], blank[1:] = space[:-1], data[:-1] == 32
    text_next = np.zeros(n, bool)
    text_next[:-1] = ~space[1:] & ~edge[1:-1]
    begins |= space & ~before
    begins |= space & before & text_next
    begins |= ~space & before & ~blank
    if kinds and n:
        kind = _KIND[data]
        begins[1:] |= _CUT[kind[:-1], kind[1:]]
    return np.flatnonzero(begins)


def wide_space_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold white space outside ASCII, where pieces can't be told from bytes alone."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = pad[:-2], pad[1:-1], pad[2:]
    found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    found |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    found |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    found |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    found |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(offsets, np.flatnonzero(found), side="right") - 1)


def repeated(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces are equal, exactly: a number for each, and a place of each number.

    Pieces of up to 15 bytes are two integers, which also hold their length; a longer
    piece has a number of its own.
    """
    data = np.frombuffer(raw + bytes(16), np.uint8)
    words = np.lib.stride_tricks.as_strided(data, (len(raw) + 9, 8), (1, 1))
    size = ends - starts
    short = np.flatnonzero(size < 16)
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = words[starts[short]].view("<u8").ravel() & keep[np.minimum(size[short], 8)]
    high = words[np.minimum(starts[short] + 8, len(raw))].view("<u8").ravel() & keep[np.maximum(size[short] - 8, 0)] | (size[short].astype(np.uint64) << np.uint64(56))
    (a, _), (b, kinds) = pd.factorize(low), pd.factorize(high)
    of, _ = pd.factorize(a * len(kinds) + b)
    n = int(of.max()) + 1 if len(of) else 0
    codes = np.empty(len(starts), np.int64)
    codes[short] = of
    long = np.flatnonzero(size >= 16)
    codes[long] = n + np.arange(len(long))
    places = np.empty(n + len(long), np.int64)
    places[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, places


class Encoder:
    """Encodes batches of texts as the tokenizer does; each piece that repeats is encoded once.

    Pieces are known by their bytes.  New ones are encoded many to a text, one on each
    line; the bytes of the ids tell where a piece ends.  The pool of pieces is emptied when it reaches
    its bound.  Rows that hold wide white space, or the text of a token that the
    tokenizer finds before it cuts pieces (such as one that ends a text), are encoded whole.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values()]
        cuts = json.loads(model).get("pre_tokenizer") or {}
        self.kinds = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max([*vocabulary.values(), *added], default=-1) + 1, np.int64)
        for word, i in vocabulary.items():
            self.bytes_of[i] = len(word)
        for i, token in added.items():
            self.bytes_of[i] = len(token.content.encode())
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.lengths: np.ndarray = np.zeros(0, np.int64)
        self.ids: np.ndarray = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of texts without white space at their ends but one blank before, and how many each has; None if lines don't keep them apart."""
        sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        encoded = self._encode(["\n".join(texts[i : i + LINES]) + "\n" for i in range(0, len(texts), LINES)])
        ids = np.concatenate([np.array(x, np.uint32) for x in encoded])
        done, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes + 1)
        at = np.searchsorted(done, wanted)  # the line ends
        if len(ids) < 2 or at[-1] != len(ids) - 1 or (done[at] != wanted).any() or (done[at - 1] != wanted - 1).any():
            return None
        return np.delete(ids, at), np.diff(at, prepend=-1) - 1

    def _learn(self, pieces: list[bytes]) -> None:
        """Put the pieces, none of which is known, into the pool."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        inner = [t[1:] if t[:1] == " " else t for t in texts]
        plain = np.fromiter((bool(t) and t.strip() == t for t in inner), bool, len(inner)) if self.kinds else np.zeros(len(texts), bool)
        lined = self._lines(list(compress(texts, plain))) if plain.any() else None
        if lined is None:
            plain[:] = False
            lined = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        alone = self._encode(list(compress(texts, ~plain)))
        lengths = np.concatenate([lined[1], np.fromiter(map(len, alone), np.int64, len(alone))])
        order = [*compress(pieces, plain), *compress(pieces, ~plain)]
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order)), strict=True))
        self.known_bytes += sum(map(len, order))
        self.ids = np.concatenate([self.ids, lined[0], np.fromiter(chain.from_iterable(alone), np.uint32)])
        self.lengths = np.concatenate([self.lengths, lengths])

    def whole_rows(self, raw: bytes, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that must not be cut into pieces."""
        found = set(wide_space_rows(data, offsets).tolist())
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                found.add(row)
                at = raw.find(token, int(offsets[row + 1]))
        return sorted(found)

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and the number of ids of each row."""
        data, offsets = utf8(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        if len(self.known) > POOL_PIECES or self.known_bytes > POOL_BYTES:
            self._clear()
        raw = data.tobytes()
        starts = units(data, offsets, self.kinds)
        ends = np.append(starts[1:], len(raw))
        codes, places = repeated(raw, starts, ends)
        pieces = [raw[i:j] for i, j in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]
        if new := list(dict.fromkeys(p for p in pieces if p not in self.known)):
            self._learn(new)
        of = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[codes]
        first_id = np.cumsum(self.lengths) - self.lengths
        n = self.lengths[of]
        out_at = np.cumsum(n) - n
        ids = self.ids[np.repeat(first_id[of] - out_at, n) + np.arange(int(n.sum()))]
        total = np.append(out_at, len(ids))[np.searchsorted(starts, offsets)]
        counts = np.diff(total)
        for row in self.whole_rows(raw, data, offsets)[::-1]:
            exact = np.array(self._encode([raw[offsets[row] : offsets[row + 1]].decode("utf-8", "replace")])[0], np.uint32)
            ids = np.concatenate([ids[: total[row]], exact, ids[total[row] + counts[row] :]])
            counts[row] = len(exact)
        return ids, counts


def worker_encoder(model: str) -> Encoder:
    """The encoder of this Python worker; it outlives the task, so later tasks find its pool filled."""
    kept = sys.modules.setdefault("_worker_encoders", types.ModuleType("_worker_encoders")).__dict__
    if kept.get("model") != model:
        kept["model"], kept["encoder"] = model, Encoder(model)
    return kept["encoder"]


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, model: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and write the ids in ascending key order.

    Returns the manifest: one row per partition with its number, path without
    suffix, documents, ids, and ``base``, the ids of all partitions before it.
    A task writes under a name of its own, so a repeated or speculative task leaves
    the files of the successful one alone.

    Defined cases: a null or empty text is the end id alone; null keys come first;
    rows of one key are ordered by the MD5 of their texts; repeated rows are
    written each; a very long text is encoded whole and is one document of the files;
    the text of a special token is that token, as the tokenizer has it by default; an
    empty table gives an empty manifest; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    held = spark.sparkContext.broadcast(model)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = width = out = None
        counts, keys = [], []
        name = f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        where, _ = open_folder(folder)
        for batch in short(batches, 1):
            if encoder is None:
                encoder = worker_encoder(held.value)
                width = np.dtype("<u2") if max(end_id, encoder.tokenizer.get_vocab_size() - 1) < 1 << 16 else np.dtype("<u4")
                out = where.open_output_stream(name + ".bin")
            ids, n = encoder(batch.column(1))
            ends = np.cumsum(n)
            out.write(np.insert(ids, ends, end_id).astype(width).tobytes())
            counts.append(n + 1)
            keys.append(batch.column(0))
        if out is None:
            return
        out.close()
        n = np.concatenate(counts)
        key = pa.chunked_array(keys)
        known = key.is_valid().to_numpy(zero_copy_only=False)
        index = [np.array([FORMAT, width.itemsize, len(n)]), np.zeros(1), np.cumsum(n), key.fill_null(0).to_numpy(), known]
        with where.open_output_stream(name + ".idx") as f:
            f.write(np.concatenate([x.astype("<i8") for x in index]).tobytes())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [name], "docs": [len(n)], "ids": [int(n.sum())]})

    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("_md5", digest())
        .repartitionByRange(partitions(docs), "doc_id", "_md5")
        .sortWithinPartitions("doc_id", "_md5")
        .select("doc_id", "text")
    )
    manifest = stage(ordered.mapInArrow(write, "part long, path string, docs long, ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return manifest.select("*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"), F.lit(folder).alias("folder"))


def _mapped(store: pafs.FileSystem, name: str, dtype: str, start: int, count: int) -> np.ndarray:
    """``count`` integers from place ``start`` of a file: memory-mapped if the file is local."""
    size = np.dtype(dtype).itemsize
    if not count:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(name, dtype=dtype, mode="r", offset=start * size, shape=(count,))
    with store.open_input_file(name) as f:
        f.seek(start * size)
        return np.frombuffer(f.read(count * size), dtype=dtype)


def read_documents(store: pafs.FileSystem, path: str, base: int = 0) -> Iterator[tuple]:
    """(document id or None, ids of all documents before it, its ids) from one partition's files."""
    mark, width, n = _mapped(store, path + ".idx", "<i8", 0, HEADER).tolist()
    if mark != FORMAT:
        raise ValueError(f"{path}.idx is not a token index")
    offsets = np.array(_mapped(store, path + ".idx", "<i8", HEADER, n + 1))
    keys = np.array(_mapped(store, path + ".idx", "<i8", HEADER + n + 1, 2 * n))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + READ_IDS, side="right")) - 1)
        ids = _mapped(store, path + ".bin", f"<u{width}", int(offsets[i]), int(offsets[j] - offsets[i]))
        for d in range(i, j):
            yield (int(keys[d]) if keys[n + d] else None), base + int(offsets[d]), ids[offsets[d] - offsets[i] : offsets[d + 1] - offsets[i]]
        i = j


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = open_folder(row["folder"])
                out: list[tuple] = []
                for key, start, ids in read_documents(store, row["path"], row["base"]):
                    out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    n = partitions(manifest)
    return manifest.repartition(n, "part").mapInArrow(read, schema)


def token_files(docs: DataFrame, model: str, end_id: int = 0) -> DataFrame:
    """Write the documents as token files and read them back."""
    return read_token_files(write_token_files(docs, model, end_id))

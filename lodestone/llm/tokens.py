"""Token ids: text through a public tokenizer into Simple-8b files, and back.

The files are rows of a Parquet table (part, seq, before, n_ids, file), so they can stand in any store that Spark writes to and
a lost executor's half-written ones never count; ``file`` is a whole file of simple8b.py.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import simple8b
from lodestone.llm.common import column, flat, in_rows, save
from lodestone.llm.words import hashes

#: Ids in one file, from which on the next document starts another.
FILE_IDS = 1 << 20
END = 2


class Encoder:
    """Ids of whole texts. Pieces that the tokenizer's pattern always cuts apart are encoded once and remembered.

    A byte-level pattern of the kind `'s|'t|...| ?letters| ?digits| ?others|spaces` cuts before a single space or newline
    that stands between two other characters, and between an ASCII letter and an ASCII character that is none, whatever
    stands around. So a text in which white space is only that is the sequence of its pieces. Texts with other white
    space, or with the start of a special token, go to the tokenizer whole.
    """

    #: Remembered pieces; beyond it the memory starts anew.
    MOST = 600_000
    _SLOTS = 1 << 21

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: First bytes of white space other than the plain one, and of special tokens.
        self.rare = np.zeros(256, bool)
        self.rare[[9, 11, 12, 13, 0xC2, 0xE1, 0xE2, 0xE3, *(x[0] for x in self.special)]] = True
        line = self.whole(["\n", "a", " b", ","])
        if len(line[0]) != 1 or not np.array_equal(self.whole(["a\n b\n,"])[0], np.concatenate([line[1], line[0], line[2], line[0], line[3]])):
            raise ValueError("the tokenizer does not cut at newlines")
        self.newline = line[0][0]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(self._SLOTS, np.uint64), np.zeros(self._SLOTS, np.int32)
        self.n, self.first, self.size, self.ids = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts must be encoded whole."""
        plain = (data == 10) | (data == 32)
        hit = np.flatnonzero(plain[1:] & plain[:-1])
        look = np.flatnonzero(self.rare[data])
        if len(look):
            ends = np.append(data, [0, 0])
            one, two, three = data[look], ends[look + 1], ends[look + 2]
            bad = (one >= 9) & (one <= 13)
            bad |= (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80)
            bad |= (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
            bad |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
            for s in self.special:
                bad |= (one == s[0]) & (two == s[-1]) if len(s) > 1 else one == s[0]
            hit = np.append(hit, look[bad])
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, hit, side="right") - 1] = True
        full = np.flatnonzero(np.diff(offsets))
        out[full] |= plain[offsets[full]] | plain[offsets[full + 1] - 1]
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of remembered pieces, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), (h & np.uint64(self._SLOTS - 1)).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.at[slot[hit]]
            more = ~hit & (key != 0)
            left, slot = left[more], (slot[more] + 1) & (self._SLOTS - 1)
        return out

    def _learn(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Remember the pieces data[start:end], whose hashes are h: they are one text to the tokenizer, a newline before
        each that has none, so what stands between two newline ids is a piece's ids."""
        led = data[start] == 10
        size = end - start + ~led
        ahead = np.cumsum(size)
        inside = np.arange(ahead[-1]) - np.repeat(ahead - size, size)
        joined = data[np.maximum(np.repeat(start - ~led, size) + inside, 0)]
        joined[(ahead - size)[~led]] = 10
        every = self.whole([joined.tobytes().decode()])[0]
        cut = np.flatnonzero(every == self.newline)
        first, size = len(self.ids) + cut, np.diff(np.append(cut, len(every)))
        self.ids = np.concatenate([self.ids, every])
        # the newline id belongs to those pieces that begin with one
        self.first, self.size = np.append(self.first, first + ~led), np.append(self.size, size - ~led)
        number, left, slot = np.arange(self.n, self.n + len(h)), np.arange(len(h)), (h & np.uint64(self._SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]], self.at[slot[free]] = h[left[free]], number[left[free]]
            lost = self.keys[slot] != h[left]
            self.at[slot[~lost]] = number[left[~lost]]
            left, slot = left[lost], (slot[lost] + 1) & (self._SLOTS - 1)
        self.n += len(h)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        data, offsets = flat(texts)
        n, whole = len(data), self.odd(data, offsets)
        letter = (data | 32) - np.uint8(97) < 26
        start = (data == 32) | (data == 10)
        start[1:] |= letter[:-1] & ~letter[1:] & (data[1:] < 128)
        start[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(start)
        text = np.searchsorted(offsets, start, side="right") - 1
        end = np.append(start[1:], n)
        keep = ~whole[text]
        start, end, text = start[keep], end[keep], text[keep]
        h = hashes(data, start, end, None) | np.uint64(1)  # 0 stands for a free slot
        if self.n > self.MOST:
            self._forget()
        at = self._find(h)
        if len(new := np.flatnonzero(at < 0)):
            fresh, where = np.unique(h[new], return_index=True)
            self._learn(fresh, data, start[new[where]], end[new[where]])
            at[new] = self._find(h[new])
        size = self.size[at]
        ahead = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[at] - (ahead - size), size) + np.arange(ahead[-1] if len(ahead) else 0)]
        counts = np.bincount(text, weights=size, minlength=len(whole)).astype(np.int64)
        if whole.any():
            odd = iter(self.whole([t or "" for t in texts.filter(pa.array(whole)).to_pylist()]))
            parts = np.split(ids, np.cumsum(counts)[:-1])
            parts = [next(odd) if w else x for w, x in zip(whole.tolist(), parts, strict=True)]
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, counts


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for ``path``, which remembers pieces from one task to the next."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Bytes of text that one task encodes, about.
TASK_BYTES = 64_000_000
#: Parts whose places are broadcast at most, 16 bytes each.
BROADCAST_PARTS = 1_000_000


def write(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Encode ``docs`` in ascending doc_id order into files, and return the table of files (part, seq, before, n_ids, file).

    before: the ids of the part's files before it.
    Null text is empty, so it has the end id alone. Null ids come first; rows alike in doc_id come in the order of
    their text's hash. An empty table gives no file.
    """
    text = F.coalesce("text", F.lit(""))
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    # the hash of the text besides: rows that share an id, or have none, are no single task
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, before, size = encoder_of(tokenizer), TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            doc_ids, counts, ids = [d for x in held for d in x[0]], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_ids": len(ids), "file": simple8b.dump(doc_ids, counts, ids)}], schema=_FILES)

        for batch in in_rows(batches, "text", 1_500_000):
            ids, counts = encoder.encode(column(batch, "text"))
            ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
            held.append((column(batch, "doc_id").to_pylist(), counts, ids))
            size += len(ids)
            if size >= FILE_IDS:
                yield done()
                seq, before, size, held = seq + 1, before + size, 0, []
        if held:
            yield done()

    return save(rows.mapInArrow(files, "part int, seq int, before long, n_ids long, file binary"), "files")


_FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("file", pa.binary())])


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all before it.

    The files move only if there are more than BROADCAST_PARTS parts.
    """
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    small = parts.count() <= BROADCAST_PARTS
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    placed = files.join(F.broadcast(parts) if small else parts, F.col("part") == F.col("p")).select((F.col("ahead") + F.col("before")).alias("start"), "file")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(column(batch, "start").to_pylist(), column(batch, "file"), strict=True):
                doc_ids, counts, ids = simple8b.load(raw.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")

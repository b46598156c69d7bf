"""Token ids in word-aligned Simple-8b blocks.

``encode_words`` packs unsigned integers into 64-bit words: the top four bits of
a word select how many values share its lower 60 bits, selector 0 marks an
escape (the next word holds one value of up to 64 bits as it is). Encoding and
decoding are vectorised by selector; only the walk from word to word is a loop.

A token file is a table of blocks in Parquet, written by Spark's own committer,
so it can lie in any store Spark reaches and survives lost executors. A block
holds whole documents in ascending id order, about 262,144 ids or one longer
document: their ids, the count of ids of each, the number of ids before the
block in its part, and the words.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import Workspace, join_bounded
from vecloom.llm.spans import hash_spans, text_slices

#: Fixed values of Simple-8b: values a word and bits a value, for selectors 2 to 15. Selector 0 is the escape, 1 is unused.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK_IDS = 1 << 18
PARTS_TO_BROADCAST = 500_000

_U = np.uint64
_COUNT = np.array([1, 0, *[n for n, _ in PACKINGS]], dtype=np.int64)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.searchsorted(_U(1) << np.arange(64, dtype=np.uint64), values, side="right").astype(np.uint8)


_SHORT_BITS = _bit_lengths(np.arange(1 << 16, dtype=np.uint64))


def encode_words(values: np.ndarray) -> np.ndarray:
    """Pack unsigned integers into 64-bit words. The number of values must be kept beside the words."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, dtype=np.uint64)
    bits = _SHORT_BITS[values.astype(np.int64)] if int(values.max()) < 1 << 16 else _bit_lengths(values)
    bits, padded = np.concatenate([bits, np.zeros(60, np.uint8)]), np.concatenate([values, np.zeros(60, np.uint64)])
    widest = {1: bits}  # of the next k values
    for k in (2, 4, 8, 16, 32):
        w = widest[k // 2]
        widest[k] = np.maximum(w[: n + 60 - k + 1], w[k // 2 : n + 60 - k // 2 + 1])
    selector = np.full(n, 16, dtype=np.uint8)
    for s, (k, width) in enumerate(PACKINGS, 2):
        p = 1 << (k.bit_length() - 1)
        fits = np.maximum(widest[p][:n], widest[p][k - p : k - p + n]) <= width
        selector = np.minimum(selector, np.where(fits, np.uint8(s), np.uint8(16)))
    selector[selector == 16] = 0
    step, starts, i = _COUNT[selector].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts, dtype=np.int64)
    chosen = selector[at]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(chosen == 0)[:-1]])
    words = np.zeros(len(at) + int((chosen == 0).sum()), dtype=np.uint64)
    words[place[chosen == 0] + 1] = values[at[chosen == 0]]
    for s in np.unique(chosen[chosen > 0]).tolist():
        k, width = PACKINGS[s - 2]
        own = at[chosen == s]
        packed = np.full(len(own), s << 60, dtype=np.uint64)
        for j in range(k):
            packed |= padded[own + j] << _U(j * width)
        words[place[chosen == s]] = packed
    return words


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values that ``encode_words`` packed."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> _U(60)).astype(np.int64)
    heads_at = np.arange(len(words))
    if (selector == 0).any():  # what follows an escape is a raw value, which may look like anything
        i, heads = 0, []
        while i < len(words):
            heads.append(i)
            i += 2 if selector[i] == 0 else 1
        heads_at = np.array(heads, dtype=np.int64)
    chosen = selector[heads_at]
    counts = _COUNT[chosen]
    offset = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in np.unique(chosen).tolist():
        own, to = heads_at[chosen == s], offset[chosen == s]
        if s == 0:
            out[to] = words[own + 1]
            continue
        k, width = PACKINGS[s - 2]
        mask, w = _U((1 << width) - 1), words[own]
        for j in range(k):
            out[to + j] = (w >> _U(j * width)) & mask
    return out[:n]


# --- tokenising ---------------------------------------------------------------

#: White space that the plain cuts below don't foresee; texts with any are encoded whole.
_ODD_SPACE = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_KNOWN = 1_500_000


_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_STOP = np.array([chr(b) in ".,;:!?" for b in range(256)])


class PieceEncoder:
    """Encodes many texts with a byte-level BPE tokenizer, each distinct piece once.

    The tokenizer never merges across the place before a lone space, nor across a
    lone line end, nor between a letter and a stop. Cut there, texts share most of their pieces; each is encoded
    by the tokenizer once while it is among the last million or so known,
    and texts are put together from the ids of their pieces. Texts that hold
    white space of other kinds or an added token, such as an end mark, are one piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # bytes of a token: one character stands for each
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.keys, self.key_len = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.off, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts one after another, and where each ends: ids of all, and how many each text has."""
        n_docs, begins = len(ends), np.concatenate([[0], ends[:-1]])
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n_docs, np.int64)
        raw = data.tobytes()
        odd_at = [m.start() for p in (_ODD_SPACE, self.added) if p for m in p.finditer(raw)]
        odd_at = np.array(odd_at, dtype=np.int64)
        odd = np.unique(np.searchsorted(ends, odd_at, side="right")) if len(odd_at) else odd_at
        dark = data > 32
        alone = np.zeros(len(data), dtype=bool)  # white space between two bytes that are none
        alone[1:-1] = ~dark[1:-1] & dark[:-2] & dark[2:]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[:-1] = alone & ((data == 32) | (data == 10))
        cut[1:] |= alone & (data == 10)
        latin = np.zeros(len(data), dtype=bool)  # the second byte of a Latin letter with a mark
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:-1] |= (_LETTER[data[:-1]] | latin[:-1]) & _STOP[data[1:]]
        cut[begins] = True
        cut[-1] = True
        if len(odd):
            for d in odd.tolist():
                cut[begins[d] + 1 : ends[d]] = False
        at = np.flatnonzero(cut)
        start, stop = at[:-1], at[1:]
        length, key = stop - start, hash_spans(data, start, stop)
        back, unique = pd.factorize(key)
        first = np.empty(len(unique), dtype=np.int64)
        first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        where = self._known(unique, length[first])
        if (where < 0).any():
            new = np.flatnonzero(where < 0)
            new = new[np.argsort(unique[new])]
            self._learn(data, unique[new], start[first[new]], stop[first[new]], np.isin(start[first[new]], begins[odd]))
            where = self._known(unique, length[first])
        piece = where[back]
        count, off = self.count[piece].astype(np.int64), self.off[piece]
        done = np.cumsum(count)
        ids = self.ids[np.repeat(off - (done - count), count) + np.arange(done[-1])]
        doc = np.searchsorted(ends, start, side="right")
        return ids, np.bincount(doc, weights=count, minlength=n_docs).astype(np.int64)

    def _known(self, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.key_len[at] == lengths), at, -1)

    def _learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, stop: np.ndarray, odd: np.ndarray) -> None:
        if len(self.keys) > _KNOWN:
            raise _Full
        length = stop - start
        head, last = data[start] > 32, data[stop - 1] > 32
        inner = np.concatenate([[0], np.cumsum(data <= 32)])
        blanks = inner[stop] - inner[start]
        plain = ~odd & last & ((blanks == 0) & head | (blanks == 1) & (data[start] == 32))
        count, parts, order = np.zeros(len(keys), np.int32), [], []
        for group in np.array_split(np.flatnonzero(plain), max(1, int(length[plain].sum()) // 30_000)):
            if not len(group):
                continue
            width = length[group] + 1  # each piece and a line end
            done = np.cumsum(width)
            text = np.full(done[-1], 10, dtype=np.uint8)
            inside = np.ones(done[-1], dtype=bool)
            inside[done - 1] = False
            text[inside] = data[np.repeat(start[group] - (np.cumsum(length[group]) - length[group]), length[group]) + np.arange(length[group].sum())]
            ids = self.whole([text.tobytes().decode("utf-8")])[0]
            ends_at = np.cumsum(self.width[ids])
            to = np.searchsorted(ends_at, done)
            if len(ends_at) == 0 or ends_at[-1] != done[-1] or (ends_at[np.minimum(to, len(ends_at) - 1)] != done).any():
                plain[group] = False  # a vocabulary that merges over line ends
                continue
            keep = np.ones(len(ids), dtype=bool)
            keep[to] = False
            count[group] = np.diff(np.concatenate([[-1], to])) - 1
            parts.append(ids[keep])
            order.append(group)
        rest = np.flatnonzero(~plain)
        if len(rest):
            found = self.whole([data[a:b].tobytes().decode("utf-8") for a, b in zip(start[rest].tolist(), stop[rest].tolist(), strict=True)])
            count[rest] = [len(x) for x in found]
            parts += found
            order.append(rest)
        order_at = np.concatenate(order)
        off = np.zeros(len(keys), np.int64)
        off[order_at] = len(self.ids) + np.cumsum(count[order_at]) - count[order_at]
        self.ids = np.concatenate([self.ids, *parts]).astype(np.uint32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.key_len = np.insert(self.keys, at, keys), np.insert(self.key_len, at, length)
        self.off, self.count = np.insert(self.off, at, off), np.insert(self.count, at, count)

    def encode_all(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        try:
            return self.encode(data, ends)
        except _Full:
            self._forget()
            return self.encode(data, ends)


class _Full(Exception):
    """Too many pieces are known."""


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


BLOCKS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("words", T.BinaryType()),
    ]
)
_BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary())])


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        held_ids, held_docs, held_lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held_ids, held_docs, held_lengths, held
            words = encode_words(np.concatenate(held_ids))
            row = [[part], [block], [before], [held], [held_docs], [held_lengths], [words.astype("<u8").tobytes()]]
            block, before = block + 1, before + held
            held_ids, held_docs, held_lengths, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(row, _BLOCKS_ARROW, strict=True)], schema=_BLOCKS_ARROW)

        encoder = _encoder(path)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, j, data, ends in text_slices(batch.column(1)):
                ids, counts = encoder.encode_all(data, ends)
                at = np.cumsum(counts)
                ids, counts = np.insert(ids, at, end_id), counts + 1
                at = np.cumsum(counts)
                first = 0
                while first < len(at):  # whole documents until the block is full
                    base = int(at[first - 1]) if first else 0
                    last = min(len(at) - 1, int(np.searchsorted(at, base + BLOCK_IDS - held)))
                    held_ids.append(ids[base : int(at[last])])
                    held_docs += docs[i + first : i + last + 1]
                    held_lengths += counts[first : last + 1].tolist()
                    held += int(at[last]) - base
                    first = last + 1
                    if held >= BLOCK_IDS:
                        yield flush()
        if held:
            yield flush()

    return run


def write_token_file(df: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Encode every text, append ``end_id``, and write blocks in ascending id order; a null id comes first.

    Null and empty texts are one end id each. Rows that share an id (or have none)
    follow each other in the order of the first 64 characters of their texts; rows
    alike in both may lie in several parts, so many of them are no single task's. Texts are encoded whole, whatever their
    length. An empty table gives an empty file. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"head": F.substring("text", 1, 64), "salt": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("id", "head", "salt").sortWithinPartitions("id", "text").select("id", "text")
    rows.mapInArrow(_blocks(tokenizer_path, end_id), BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.array(row["lengths"], dtype=np.int64)
            ids = decode_words(np.frombuffer(row["words"], dtype="<u8"), row["n_ids"]).astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["start"] + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a token file: doc_id, start (ids before it in the whole file), n_tokens, ids_crc32."""
    from pyspark.sql import Window

    blocks = spark.read.schema(BLOCKS).parquet(folder)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = join_bounded(blocks, parts, "part", "inner", PARTS_TO_BROADCAST)
    rows = placed.select((F.col("before") + F.col("start_in_part")).alias("start"), "n_ids", "doc_ids", "lengths", "words")
    return rows.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a token file with their ids: doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_words(np.frombuffer(row["words"], dtype="<u8"), row["n_ids"]).astype(np.int64)
                cuts = np.cumsum(row["lengths"])[:-1]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": pa.array([x.tolist() for x in np.split(ids, cuts)], pa.list_(pa.int64()))})

    return spark.read.schema(BLOCKS).parquet(folder).mapInArrow(run, "doc_id long, ids array<long>")


def encode_documents(df: DataFrame, tokenizer_path: str, folder: str | None = None, **names) -> DataFrame:
    """Write the token file and read it back. Without a folder, one in the shared scratch folder is used."""
    spark = df.sparkSession
    folder = folder or f"{Workspace(spark, 'tokens').root}/file"
    write_token_file(df, folder, tokenizer_path, **names)
    return read_token_file(spark, folder)

"""Token ids in files of directly addressable codes.

A file row is a shard: the ids of consecutive documents, a directory of the documents in it, and a payload. An id
is cut into chunks of 8 bits, lowest first. Level k of the payload holds the k-th chunk of every id that has one,
a continuation bitmap (1: the id goes on in level k + 1) and a rank directory with the number of ones before each
512th bit. The place of an id in level k + 1 is the rank of its bit in level k, so any id is read by one look into
each level and no block is decoded. The shards are rows of Parquet files, so Spark's own commit makes them
appear once, on any store that Spark can write.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

MAGIC, CHUNK, RANK = b"DAC1", 8, 512
#: Ids in a shard after which it is closed; a document is never split.
SHARD_IDS = 1 << 20
#: Words whose ids a worker process remembers, from task to task.
REMEMBERED = 800_000
#: Words of characters that compose with no other, and of which no lower case is two characters.
SIMPLE = "[\\x00-\\x7f\u00a1-\u012f\u0131-\u02ff]*"
_SCHEMA = "part int, seq int, doc_ids array<long>, starts array<long>, n_ids long, payload binary"


def encode(ids: np.ndarray) -> bytes:
    """The payload of non-negative ids below 2**32."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >= (1 << CHUNK)
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK)), dtype=np.uint32)[:-1]]) if len(more) else []
        levels.append((rest.astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), np.asarray(ranks, "<u4").tobytes()))
        if not more.any():
            break
        rest = rest[more] >> CHUNK
    head = struct.pack("<4sI", MAGIC, len(levels)) + b"".join(struct.pack("<Q", len(chunks)) for chunks, _, _ in levels)
    return head + b"".join(b"".join(level) for level in levels)


class Codes:
    """Random access to a payload."""

    def __init__(self, payload: bytes):
        magic, n = struct.unpack_from("<4sI", payload)
        if magic != MAGIC:
            raise ValueError("not a token payload")
        sizes, at = struct.unpack_from(f"<{n}Q", payload, 8), 8 + 8 * n
        self.levels = []
        for size in sizes:
            chunks = np.frombuffer(payload, np.uint8, size, at)
            bits = np.frombuffer(payload, np.uint8, -(-size // 8), at + size)
            at += size + len(bits)
            ranks = np.frombuffer(payload, "<u4", -(-size // RANK), at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block = i // RANK
        ones = np.unpackbits(bits[block * RANK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK]
        return int(ranks[block]) + int(ones.sum())

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop; reads only their chunks."""
        ids, where, at = np.zeros(stop - start, np.uint32), np.arange(stop - start), start
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(where):
                break
            end = at + len(where)
            ids[where] |= chunks[at:end].astype(np.uint32) << np.uint32(CHUNK * k)
            on = np.unpackbits(bits[at >> 3 : -(-end // 8)], bitorder="little")[at & 7 :][: len(where)].astype(bool)
            if on.any():
                at = self._rank(bits, ranks, at)
            where = where[on]
        return ids


def cuts_at_white_space(definition: dict) -> bool:
    """Whether a tokenizer is known to give every text the ids of its words in turn.

    That holds if no added token has white space, if the text is changed by NFC (which composes nothing with white
    space), white space to one space, and lower case by character, if every piece that the splitting pattern
    can match is of its own words alone, and if nothing is added before or after.
    """
    steps = (definition.get("normalizer") or {}).get("normalizers", [])
    kinds = [step.get("type") for step in steps]
    spaces = [(step.get("pattern"), step.get("content")) for step in steps if step.get("type") == "Replace"]
    pre = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split = pre[0]
    pattern = (split.get("pattern") or {}).get("Regex", " ")
    # Of classes the pattern has letters, numbers, and what is neither these nor white space.
    plain = re.sub(r"\[\\p\{L\}\]\+|\[\\p\{N\}\]|\[\^\\s\\p\{L\}\\p\{N\}\]\+", "", pattern)
    return (
        kinds in (["NFC", "Replace", "Lowercase"], ["NFC", "Lowercase"], ["Lowercase"])
        and all(pair == ({"Regex": "\\s+"}, " ") for pair in spaces)
        and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
        and re.fullmatch(r"[a-z'|]*", plain) is not None
        and all(step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and not step.get("use_regex") for step in pre[1:])
        and definition.get("post_processor") is None
        and definition.get("truncation") is None
        and definition.get("padding") is None
        and definition["model"].get("type") == "BPE"
        and not definition["model"].get("dropout")
        and all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in definition["added_tokens"])
    )


class WordTable(dict):
    """Word to its ids as little-endian bytes, encoded by the library when first seen.

    Used where cuts_at_white_space holds; by any other tokenizer texts are encoded whole. Words are looked up as they
    stand, but of SIMPLE words without the mark of an added token: their ASCII letters are lower-cased before, which
    the tokenizer does itself and no composition can see, and a full stop or comma after a letter is cut off, where
    it always cuts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        definition = json.loads(self.tokenizer.to_str())
        self.by_word = cuts_at_white_space(definition)
        starts = {t["content"][:2] for t in definition["added_tokens"]}
        #: Whether an id ends a piece of the split, where the model marks ends.
        self.suffix, suffix = None, definition["model"].get("end_of_word_suffix")
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.suffix = np.zeros(max(vocabulary.values()) + 1, bool)
            self.suffix[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.marks = "|".join(map(re.escape, sorted(starts)))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, np.uint32) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        stopped = [w for w in words if w[-1:] in (".", ",") and w[-2:-1].isalpha() and re.fullmatch(SIMPLE, w) and not (self.marks and re.search(self.marks, w))]
        plain = list(({*words, *(w[:-1] for w in stopped), ".", ","} - {*stopped}) - self.keys())
        letters = [w for w in plain if w.isalpha() and re.fullmatch(SIMPLE, w)] if self.suffix is not None else []
        for k in range(0, len(letters), 256):
            self._learn_letters(letters[k : k + 256])
        rest = [w for w in plain if w not in self]
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self[word] = array("I", found.ids).tobytes()
        for word in stopped:
            self[word] = self[word[:-1]] + self[word[-1]]

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters alone, as one text: each is one piece of the split, and ends in the only id that has the suffix."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = (4 * (np.flatnonzero(self.suffix[ids]) + 1)).tolist()
        if len(ends) == len(words) and ends[-1] == 4 * len(ids):  # else they are encoded one by one
            data = ids.astype("<u4").tobytes()
            for word, a, b in zip(words, [0, *ends], ends, strict=False):
                self[word] = data[a:b]

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text: words are split and numbered in Arrow, and looked up once for all their places."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return self.whole(texts.to_pylist())
        words = pc.ascii_split_whitespace(texts)
        coded = words.values.dictionary_encode()
        simple = pc.match_substring_regex(coded.dictionary, f"^(?:{SIMPLE})$")
        if self.marks:
            simple = pc.and_(simple, pc.invert(pc.match_substring_regex(coded.dictionary, self.marks)))
        lower = pc.if_else(simple, pc.ascii_lower(coded.dictionary), coded.dictionary).dictionary_encode()
        distinct, number = lower.dictionary.to_pylist(), lower.indices.to_numpy()[coded.indices.to_numpy()]
        missing = [w for w in distinct if w not in self]
        if missing:
            if len(self) + len(missing) > REMEMBERED:
                self.clear()
                missing = distinct
            self._learn(missing)
        found = [self[w] for w in distinct]
        ids, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        many = size[number]
        ends = np.concatenate([[0], np.cumsum(many)])
        flat = ids[np.repeat(first[number] - ends[:-1], many) + np.arange(ends[-1])] if len(number) else ids[:0]
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=1)
def _word_table(path: str) -> WordTable:
    """Spark reuses worker processes, and a word's ids never change."""
    return WordTable(path)


def _writer(path: Callable[[], str], end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = _word_table(path()), TaskContext.get().partitionId(), 0
        docs, starts, held, n = [], [], [], 0
        end = np.array([end_id], np.uint32)

        def shard() -> pa.RecordBatch:
            cells = [[part], [seq], [docs], [starts], [n], [encode(np.concatenate(held))]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "seq", "doc_ids", "starts", "n_ids", "payload"])

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                for doc, ids in zip(batch.column(0).slice(k, 1000).to_pylist(), words.texts(batch.column(1).slice(k, 1000)), strict=True):
                    docs.append(doc)
                    starts.append(n)
                    held += [ids, end]
                    n += len(ids) + 1
                    if n >= SHARD_IDS:
                        yield shard()
                        docs, starts, held, n, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    return write


def write_tokens(documents: DataFrame, tokenizer_path: Callable[[], str], end_id: int = 1) -> DataFrame:
    """Encode every whole text and write the ids in ascending doc_id order; returns the written table.

    Null text is empty and has the end id alone; null ids come first; repeated rows are all written, equal ids in
    order of a hash of their text, then of the text, so many rows of one id are many ranges; a very long text is a
    shard of its own; an empty table writes no shard; other columns are ignored. The pages of the files are not
    compressed, as the codes are read where they lie.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = documents.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return materialize(rows.mapInArrow(_writer(tokenizer_path, end_id), _SCHEMA), "tokens", compression="none")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, seq, docs, starts, n, payload = (batch.column(i)[row] for i in range(6))
            codes, starts = Codes(payload.as_py()), starts.values.to_numpy()
            bounds = np.append(starts, n.as_py())
            crc = [zlib.crc32(codes.read(a, b).astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            m = len(starts)
            columns = [pa.array([part.as_py()] * m, pa.int32()), pa.array([seq.as_py()] * m, pa.int32()), docs.values, pa.array(starts), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_documents(tokens: DataFrame) -> DataFrame:
    """Per document of a token table: doc_id, start, n_tokens, ids_crc32.

    The number of ids before a shard is a sum over the shards of its file and one over the files.
    """
    shards = tokens.select("part", "seq", "n_ids")
    files = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("within")
    base = shards.select("part", "seq", within).join(files, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    read = tokens.select("part", "seq", "doc_ids", "starts", "n_ids", "payload").mapInArrow(_reader, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return read.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe))

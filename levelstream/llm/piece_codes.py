"""SentencePiece encoding with seeded merge dropout, and decoding that gives every text back.

Encoding merges characters as the model's BPE does: of all adjacent pairs whose joining is a piece, the one with
the best score, the leftmost of equals, until none is left. A candidate merge is skipped for good if a hash keyed
by the seed, the document, its copy, the part's place in the text and the candidate's three borders falls below the
dropout rate, so every place has its own draws while a rerun agrees. All parts of a batch go through this agenda
together in numpy.

A unit is a run of spaces and the characters up to the next space or line feed; no piece reaches over its borders,
nor over a pair of characters that no piece holds, so units are cut there into parts and these encoded apart. A
task remembers the cut of a unit, which no draw changes, and no ids.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPOUT, SEED = 0.1, 7
#: Units whose cut a worker process remembers, from task to task.
REMEMBERED = 250_000
#: Rows of a step of the agenda hold about so many characters.
AT_ONCE = 1 << 16
SPACE, OWN = "▁", "\ud800"  # OWN stands for a text's own U+2581, which must not decode to a space
_NEVER = np.iinfo(np.int32).max
_SPREAD, _BORDERS = 0x9E3779B97F4A7C15, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def spread(h: np.ndarray) -> np.ndarray:
    """Each number to one whose bits all depend on all of its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Model:
    """Pieces, scores and joins of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.vocab_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.byte_of = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b""] * size
        for i in plain:
            self.bytes[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_of):
            self.bytes[i] = bytes([b])
        order = sorted(plain, key=lambda i: -self.library.get_score(i))
        rank, last = {}, None
        for i in order:  # equal scores are equal ranks
            if self.library.get_score(i) != last:
                last, at = self.library.get_score(i), len(rank)
            rank[i] = at
        joins = {}
        self.inside = set()
        for piece, i in self.id_of.items():
            self.inside.update(zip(piece, piece[1:], strict=False))
            for k in range(1, len(piece)):
                a, b = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if a is not None and b is not None:
                    joins[a * size + b] = (rank[i], i)
        self.size = size
        self.char_id = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
        # An open hash table of the joins, read for whole arrays of pairs at once.
        bits = max(4, (4 * len(joins)).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64)
        self.ranks, self.joined = np.full(1 << bits, _NEVER, np.int32), np.zeros(1 << bits, np.int32)
        for key, (rank, i) in joins.items():
            slot = (key * _SPREAD % 2**64) >> int(self.shift)
            while self.slots[slot] >= 0:
                slot = (slot + 1) % (1 << bits)
            self.slots[slot], self.ranks[slot], self.joined[slot] = key, rank, i

    def parts(self, unit: str) -> list[str]:
        """The unit cut where no piece holds the two characters; a unit of letters alone stays whole."""
        if unit[1:].isalpha():
            return [unit]
        cuts = [k for k, pair in enumerate(zip(unit, unit[1:], strict=False), 1) if pair not in self.inside]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_of[b] for b in (SPACE if char == OWN else char).encode()]

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair in the table of joins, or one whose rank is never."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        slot = ((key.astype(np.uint64) * np.uint64(_SPREAD)) >> self.shift).astype(np.int64)
        # Until each has its own key or an empty slot: at most half of the slots are taken.
        wrong = np.flatnonzero((self.slots[slot] != key) & (self.slots[slot] >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
            held = self.slots[slot[wrong]]
            wrong = wrong[(held != key[wrong]) & (held >= 0)]
        return slot

    def _candidates(self, key: np.ndarray, ids: tuple, places: tuple, limit: np.uint64) -> np.ndarray:
        """Ranks of adjacent pairs with borders ``places``; skipped and impossible ones are never taken."""
        slot = self._look(*ids)
        rank = self.ranks[slot]  # of an empty slot it is never
        h = key
        for place, odd in zip(places, _BORDERS, strict=True):
            h = (h ^ (place.astype(np.uint64) + np.uint64(1))) * np.uint64(odd)
            h ^= h >> np.uint64(32)
        rank[h < limit] = _NEVER
        return rank

    def segment(self, points: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Of units of one length (code points, a row each): the ids, and where in a row a symbol starts.

        Each row has its agenda: the ranks of its pairs by the place of the left symbol. A step takes the best of
        every row at once, joins it and ranks the pairs on its two sides.
        """
        n, length = points.shape
        ids, alive = self.char_id[points], np.ones((n, length), bool)
        if length < 2 or not n:
            return ids, alive
        limit = np.uint64(int(min(dropout, 1 - 2**-53) * 2**64))
        # Flat arrays with a row of length + 1 places; the last is the border behind the unit.
        wide = length + 1
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1).ravel()
        after = np.tile(np.arange(1, wide + 1, dtype=np.int64), n)
        before = after - 2
        rows, cols = np.repeat(np.arange(n), length - 1), np.tile(np.arange(length - 1), n)
        at = rows * wide + cols
        agenda = np.full(n * wide, _NEVER, np.int32)
        agenda[at] = self._candidates(keys[rows], (ids[at], ids[at + 1]), (cols, cols + 1, cols + 2), limit)
        agenda = agenda.reshape(n, wide)
        flat, alive = agenda.reshape(-1), np.ones(n * wide, bool)
        live = np.arange(n)
        while True:
            left = agenda[live].argmin(axis=1)
            go = flat[live * wide + left] < _NEVER
            live, left = live[go], left[go]
            if not len(live):
                break
            base = live * wide
            here, right = base + left, after[base + left]
            ids[here] = self.joined[self._look(ids[here], ids[base + right])]
            alive[base + right] = False
            flat[base + right] = _NEVER
            next_ = after[base + right]
            after[here] = next_
            before[base + next_] = left
            flat[here] = _NEVER
            some = np.flatnonzero(next_ < length)
            i, r, q = here[some], next_[some], base[some]
            flat[i] = self._candidates(keys[live[some]], (ids[i], ids[q + r]), (left[some], r, after[q + r]), limit)
            some = np.flatnonzero(left > 0)
            q, r = base[some], left[some]
            p = before[q + r]
            flat[q + p] = self._candidates(keys[live[some]], (ids[q + p], ids[q + r]), (p, r, after[q + r]), limit)
        return ids.reshape(n, wide)[:, :length], alive.reshape(n, wide)[:, :length]

    def encoded(self, units: list[str], keys: list[int], dropout: float) -> list[bytes]:
        """The ids of units of one length as bytes."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), -1)
        ids, alive = self.segment(points, np.array(keys, np.uint64), dropout)
        flat = ids[alive].astype("<i4").tobytes()
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for row in np.flatnonzero((ids < 0).any(axis=1)).tolist():  # characters without a piece are bytes
            unit, whole = units[row], []
            for k in np.flatnonzero(alive[row]).tolist():
                whole += [int(ids[row, k])] if ids[row, k] >= 0 else self.fallback(unit[k])
            out[row] = np.array(whole, "<i4").tobytes()
        return out


class Encoder:
    """Text to ids and back; remembers how units are cut into parts."""

    def __init__(self, model: Model, dropout: float = DROPOUT, seed: int = SEED):
        self.model, self.dropout, self.seed = model, dropout, seed
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: Code points of the parts of all known units, the length of each part, and the parts of each unit.
        self.tables = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def units(text: str) -> list[str]:
        """Units as keys: a unit's leading space is left out, a unit that opens a line starts with its line feed."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, OWN)
        units = text.replace("\n", " \n").split(" ")
        if "" not in units:
            return units
        out, spaces = [], 0
        for unit in units:
            if not unit:
                spaces += 1
            elif unit[0] == "\n":
                if spaces:
                    out.append(" " * spaces)
                out.append(unit)
                spaces = 0
            else:
                out.append(" " * (spaces + 1) + unit if spaces else unit)
                spaces = 0
        if spaces:
            out.append(" " * spaces)
        return out

    @staticmethod
    def written(unit: str) -> str:
        """The characters of a unit's key, spaces as the model writes them."""
        if unit[0] == "\n":
            return unit
        return unit.replace(" ", SPACE) if unit[0] == " " else SPACE + unit

    def learn(self, units: set[str]) -> None:
        own = [self.model.parts(self.written(unit)) for unit in units]
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        parts = list(itertools.chain.from_iterable(own))
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        new = points, np.array(list(map(len, parts)), np.int64), np.array(list(map(len, own)), np.int64)
        self.tables = tuple(map(np.concatenate, zip(self.tables, new, strict=True)))

    def document_key(self, doc_id: int | None, copy: int, text: str) -> int:
        """What tells a document and its copies apart; a text without a doc_id stands for itself."""
        own = f"t{text}" if doc_id is None else f"d{doc_id}"
        return xxhash.xxh64_intdigest(f"{copy} {own}".encode("utf-8", "surrogatepass"), self.seed)

    def encode(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """The ids of texts; ``documents`` are the keys by which their draws differ."""
        lists = [self.units(t) for t in texts]
        missing = set().union(*lists) - self.known.keys()
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.forget()
                missing = set().union(*lists)
            self.learn(missing)
        if not any(lists):
            return [np.zeros(0, "<i4") for _ in texts]
        points, lengths, counts = self.tables
        starts, firsts = np.cumsum(lengths) - lengths, np.cumsum(counts) - counts
        unit = np.fromiter(itertools.chain.from_iterable(map(self.known.__getitem__, units) for units in lists), np.int64, sum(map(len, lists)))
        # Parts of all texts in order, and the place of each in its text.
        many = counts[unit]
        ends = np.cumsum(many)
        part = np.repeat(firsts[unit] - ends + many, many) + np.arange(ends[-1])
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, lists)])]
        sizes = np.diff(bounds)
        place = np.arange(ends[-1]) - np.repeat(bounds[:-1], sizes)
        keys = np.repeat(np.array([xxhash.xxh64_intdigest(d.to_bytes(16, "little", signed=True), self.seed) for d in documents], np.uint64), sizes)
        keys = spread(keys + place.astype(np.uint64) * np.uint64(_SPREAD))
        # A place for each character; those that still start a symbol at the end are kept.
        length = lengths[part]
        begin = np.cumsum(length) - length
        ids, alive = np.empty(begin[-1] + length[-1], np.int32), np.empty(begin[-1] + length[-1], bool)
        shown = np.empty(len(ids), np.uint32)
        order = np.argsort(length, kind="stable")
        sorted_ = length[order]
        edges = [0, *(np.flatnonzero(np.diff(sorted_)) + 1).tolist(), len(order)]
        for a, b in zip(edges, edges[1:], strict=False):
            wide = int(sorted_[a])
            size = max(1, AT_ONCE // wide)
            for k in range(a, b, size):
                rows = order[k : min(b, k + size)]
                some = points[starts[part[rows]][:, None] + np.arange(wide)]
                to = begin[rows][:, None] + np.arange(wide)
                ids[to], alive[to] = self.model.segment(some, keys[rows], self.dropout)
                shown[to] = some
        kept = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([begin, [len(ids)]])[bounds]]
        ids, shown = ids[alive], shown[alive]
        lost = np.flatnonzero(ids < 0)
        if len(lost):  # characters without a piece are bytes
            instead = [self.model.fallback(chr(c)) for c in shown[lost].tolist()]
            width = np.ones(len(ids), np.int64)
            width[lost] = list(map(len, instead))
            ids = np.repeat(ids, width)
            ids[ids < 0] = list(itertools.chain.from_iterable(instead))
            kept = np.concatenate([[0], np.cumsum(width)])[kept]
        return [ids[a:b] for a, b in itertools.pairwise(kept.tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text, without the space that encoding puts first."""
        return b"".join(map(self.model.bytes.__getitem__, ids.tolist()))[1:]


@lru_cache(maxsize=1)
def _encoder(path: str, dropout: float, seed: int) -> Encoder:
    """Spark reuses worker processes; what an encoder remembers depends on these alone."""
    return Encoder(Model(path), dropout, seed)


def encode_documents(documents: DataFrame, model_path: Callable[[], str], dropout: float = DROPOUT, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, n_tokens, ids, ids_crc32, decoded_sha256, lossless.

    The ids of the whole text, decoded again: decoded_sha256 is of the decoded text (lowercase hex, UTF-8) and
    lossless says that it is the text. The draws differ by doc_id and by the whole numbers of the
    column that ``copy`` names.
    Null text is empty and has no ids; of rows with a null doc_id the draws differ by the text; rows that repeat all
    of these get equal ids; a very long text is one row of its own; an empty table gives an empty one; other columns are
    ignored.
    """
    number = F.lit(0).cast("long") if copy is None else F.col(copy).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path(), dropout, seed)
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                docs, texts = batch.column(0).slice(k, 250).to_pylist(), [t or "" for t in batch.column(1).slice(k, 250).to_pylist()]
                copies = batch.column(2).slice(k, 250).to_pylist()
                codes = encoder.encode(texts, [encoder.document_key(*row) for row in zip(docs, copies, texts, strict=True)])
                decoded = [encoder.decode(i) for i in codes]
                columns = [
                    pa.array(docs, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(i) for i in codes], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)]), pa.int32()), pa.array(np.concatenate(codes), pa.int32())),
                    pa.array([zlib.crc32(i.tobytes()) for i in codes], pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    pa.array([d == t.encode() for d, t in zip(decoded, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_tokens", "ids", "ids_crc32", "decoded_sha256", "lossless"])

    return documents.select("doc_id", "text", number.alias("copy")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, ids array<int>, ids_crc32 long, decoded_sha256 string, lossless boolean")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_bpe)

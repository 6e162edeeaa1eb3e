"""Removal of repeated strings of 200 bytes, by a hash-compared suffix sort of what may repeat.

Of the 137 grams of 64 bytes in a 200-byte string the one with the least hash is its anchor, so equal strings have
equal anchors at equal places, and every string belongs to one anchor. An anchor's context is the bytes of all its
strings. Four steps, each a join or sum that Spark can spread:
1. Texts that occur more than once go as a whole, and one of each is compared with the others.
2. Anchors whose gram occurs once are dropped. The contexts of the others are cut from their texts and grouped by
   their bytes; those that occur more than once repeat as a whole, and one of each is compared further.
3. The contexts of a gram are sorted as suffixes from the anchor on, in a mergesort whose comparisons find the
   common extension by binary search on prefix hashes; the order and the extensions are then verified on the
   bytes. With the common extensions of neighbours, strings with an equal right part are an interval of this
   order; with an equal hash of the left part they are candidates, and their bytes are compared.
4. Where a gram has more than GROUP contexts, they are cut in two: the strings that reach far to the left, keyed by
   the bytes left of the anchor that all of them hold, and the others, keyed by the bytes to the right. Each part
   goes through steps 2 and 3 again, so equal parts are one and every part is sorted in the end.
Hashes only deal rows out. Two texts, contexts or strings count as equal after their bytes were compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, whole_groups

LENGTH, GRAM = 200, 64
GRAMS = LENGTH - GRAM + 1
#: Contexts that are sorted together; more of one gram are cut into parts.
GROUP = 2048
_PLACE = 22
_SLICE = (1 << _PLACE) - LENGTH
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes:
    """Polynomial hashes, modulo 2**64, of the substrings of a text."""

    def __init__(self, data: np.ndarray):
        self.back = _powers(_BACK, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * _powers(_BASE, max(0, len(data) - 1))[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first string's start, place of the anchor after it, number of strings, gram hash), arrays in text order."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(data) - LENGTH + 1), _SLICE):
        part = whole[at : at + _SLICE + LENGTH - 1]
        strings = len(part) - LENGTH + 1
        grams = Hashes(part).of(np.arange(len(part) - GRAM + 1), GRAM)
        grams = (grams ^ (grams >> np.uint64(29))) * _ODD
        least = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while 2 * step <= GRAMS:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if GRAMS > step:
            least = np.minimum(least[: step - GRAMS], least[GRAMS - step :])
        place = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        yield new + at, place[new] - new, np.diff(np.append(new, strings)), grams[place[new]].view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for row in range(batch.num_rows):
            data = texts[row].as_py() or b""
            for start, lead, count, gram in anchors(data):
                context = [xxhash.xxh3_64_intdigest(data[s : s + n], k + GRAMS * seed) for s, n, k in zip(start.tolist(), (count + LENGTH - 1).tolist(), lead.tolist(), strict=True)]
                n = len(start)
                columns = [pa.repeat(batch.column(0)[row], n), pa.repeat(batch.column(1)[row], n), pa.array(start), pa.array(lead.astype(np.int16)), pa.array(count.astype(np.int16)), pa.array(gram), pa.array(np.array(context, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["row_doc", "row_hash", "start", "lead", "strings", "gram", "context"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each wanted context of a document with its bytes."""
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for row in range(batch.num_rows):
            data, wanted = texts[row].as_py(), pa.array(batch.column(1)[row].values)
            for k in range(0, len(wanted), 4096):
                some = wanted.slice(k, 4096)
                start, strings = some.field("start").to_numpy(), some.field("strings").to_numpy()
                cut = [data[s : s + n + LENGTH - 1] for s, n in zip(start.tolist(), strings.tolist(), strict=True)]
                names = ["gram", "context", "lead", "strings"]
                yield pa.RecordBatch.from_arrays([*(some.field(k) for k in names), pa.array(cut, pa.binary())], [*names, "bytes"])


class Suffixes:
    """Suffixes of one byte array, from ``start`` to ``end``; hash and length compare them."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.hashes, self.start, self.length = data, Hashes(data), start, end - start

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The length of the common extension, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.length[x], self.length[y])
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.hashes.of(self.start[x], middle) == self.hashes.of(self.start[y], middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x < y, x == y); a suffix that ends goes before its extensions."""
        n = self.common(x, y)
        x_on, y_on = n < self.length[x], n < self.length[y]
        last = len(self.data) - 1
        left, right = self.data[np.minimum(self.start[x] + n, last)], self.data[np.minimum(self.start[y] + n, last)]
        return np.where(x_on & y_on, left < right, ~x_on & y_on), ~x_on & ~y_on

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Suffix numbers by group (given ascending), then suffix: mergesort, all runs of a width at once."""
        n = len(group)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
        base = np.repeat(first, np.diff(np.append(first, n)))
        width = 1
        while (rows := np.flatnonzero(size > width)).size:
            local = rows - base[rows]
            run, rank = local // width, local % width
            other = (run ^ 1) * width
            low, high = np.zeros(len(rows), np.int64), np.clip(size[rows] - other, 0, width)
            while (open_ := low < high).any():
                middle = np.where(open_, (low + high) // 2, 0)
                rival = order[np.where(open_, base[rows] + other + middle, rows)]
                less, equal = self.before(rival, order[rows])
                less |= equal & (run % 2 == 1)
                low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
            after = order.copy()
            after[base[rows] + run // 2 * 2 * width + rank + low] = order[rows]
            order = after
            width *= 2
        return order

    def verified(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order, and the common extension of each with the one before it (0 in another group).

        Both come from hashes first. The bytes of all neighbours are compared then, and where they contradict an
        extension or the order, all is done again on the bytes alone.
        """
        order = self.sort(group)
        common = np.zeros(len(order), np.int64)
        same = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        common[same] = self.common(order[same - 1], order[same])
        right = True
        for k in range(0, len(same), 1 << 13):
            rows = same[k : k + (1 << 13)]
            x, y, n = order[rows - 1], order[rows], common[rows]
            span = np.arange(int(n.max(initial=0)))
            last = len(self.data) - 1
            equal = self.data[np.minimum(self.start[x][:, None] + span, last)] == self.data[np.minimum(self.start[y][:, None] + span, last)]
            right &= bool((equal | (span >= n[:, None])).all())
            x_on, y_on = n < self.length[x], n < self.length[y]
            left, other = self.data[np.minimum(self.start[x] + n, last)], self.data[np.minimum(self.start[y] + n, last)]
            right &= bool((np.where(x_on & y_on, left < other, ~x_on)).all())
        return (order, common) if right else self.by_bytes(group)

    def by_bytes(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``verified`` returns, without hashes."""
        text = [self.data[a : a + n].tobytes() for a, n in zip(self.start.tolist(), self.length.tolist(), strict=True)]
        order = np.array(sorted(range(len(text)), key=lambda i: (group[i], text[i])), np.int64)
        common = np.zeros(len(order), np.int64)
        for k in range(1, len(order)):
            i, j = order[k - 1], order[k]
            if group[i] == group[j]:
                a, b = (np.frombuffer(text[x][: min(len(text[i]), len(text[j]))], np.uint8) for x in (i, j))
                unequal = np.flatnonzero(a != b)
                common[k] = unequal[0] if len(unequal) else len(a)
        return order, common


def repeated(data: np.ndarray, first: np.ndarray, lead: np.ndarray, strings: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each context and each place of the anchor in a string: whether that string is in another context too.

    Contexts of a group are distinct and lie in ``data`` from ``first`` on; the result has GRAMS columns.
    """
    suffixes = Suffixes(data, first + lead, first + strings + LENGTH - 1)
    order, common = suffixes.verified(group)
    found = np.zeros((len(order), GRAMS), bool)
    lead_, strings_, anchor = lead[order], strings[order], suffixes.start[order]
    for left in range(GRAMS):
        interval = np.cumsum(common < LENGTH - left)
        rows = np.flatnonzero((lead_ >= left) & (left > lead_ - strings_))
        if len(rows) < 2:
            continue
        key = suffixes.hashes.of(anchor[rows] - left, left) * _ODD + interval[rows].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        a, b = rows[by[:-1]], rows[by[1:]]
        pair = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        for k in range(0, len(pair), 1 << 16):
            x, y = a[pair[k : k + (1 << 16)]], b[pair[k : k + (1 << 16)]]
            span = np.arange(LENGTH) - left
            equal = (data[anchor[x][:, None] + span] == data[anchor[y][:, None] + span]).all(axis=1)
            found[order[x[equal]], left] = found[order[y[equal]], left] = True
            if not equal.all():  # another string of this hash may stand between two that are equal
                seen: dict[tuple[int, bytes], int] = {}
                for r in rows[np.isin(key, key[by[pair[k : k + (1 << 16)]]][~equal])].tolist():
                    own = int(group[order[r]]), data[anchor[r] - left : anchor[r] - left + LENGTH].tobytes()
                    if own in seen:
                        found[order[[r, seen[own]]], left] = True
                    seen[own] = r
    return found


def _spans(group, context, lead, flags) -> pa.RecordBatch:
    """Rows (part, context, low, high): byte spans within the context that the flagged strings cover."""
    by_start = np.zeros((len(lead), GRAMS + 1), np.int8)
    rows, left = np.nonzero(flags)
    by_start[rows, lead[rows] - left] = 1
    step = np.diff(by_start, axis=1, prepend=0)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return pa.RecordBatch.from_arrays([pa.array(group[row]), pa.array(context[row]), pa.array(low.astype(np.int32)), pa.array((high - 1 + LENGTH).astype(np.int32))], ["part", "context", "low", "high"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["part"]):
        group, context, n, lead, strings = (table.column(k).to_numpy() for k in ("part", "context", "n", "lead", "strings"))
        pieces = table.column("bytes").to_pylist()
        first = np.concatenate([[0], np.cumsum([len(b) for b in pieces])[:-1]]).astype(np.int64)
        flags = repeated(np.frombuffer(b"".join(pieces), np.uint8), first, lead.astype(np.int64), strings.astype(np.int64), np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])))
        flags[n > 1] = False  # these repeat as a whole
        yield _spans(group, context, lead.astype(np.int64), flags)


def _grouped(cut: DataFrame) -> DataFrame | None:
    """Contexts (part, context, low_reach, high_reach, lead, strings, bytes) that are equal in all, counted; written.

    None where two contexts of a part differ in their bytes and agree in the hash that names them.
    """
    keys = ["part", "context", "low_reach", "high_reach", "lead", "strings", "bytes"]
    contexts = materialize(cut.groupBy(*keys).agg(F.count("*").alias("n")), "contexts")
    if contexts.groupBy("part", "context").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
        return contexts
    discard(contexts)
    return None


def shared_strings(contexts: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(part, context, low, high): spans of the strings that also occur in another context of the part.

    ``contexts`` are distinct in a part. Strings of a part have their anchor low_reach to high_reach - 1 bytes
    after their start. Tables that the result is read from are added to ``made``.
    """
    sizes = materialize(contexts.groupBy("part").agg(F.count("*").alias("m")).where("m > 1"), "part-sizes")
    made.append(sizes)
    sized = contexts.join(sizes, "part")
    dealt = sized.where(F.col("m") <= GROUP).repartition("part").sortWithinPartitions("part")
    spans = dealt.select("part", "context", "n", "lead", "strings", "bytes").mapInArrow(_compare, "part long, context long, low int, high int")
    if sizes.where(F.col("m") > GROUP).isEmpty():
        return spans
    crowded = sized.where((F.col("m") > GROUP) & (F.col("high_reach") - F.col("low_reach") > 1))
    middle = F.floor((F.col("low_reach") + F.col("high_reach")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low_reach").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("high_reach").alias("b")))
    # The strings of the context that belong to the half have their anchor at most to at least bytes after their start.
    cut = crowded.withColumn("half", F.explode(halves)).withColumns(
        {"most": F.least(F.col("half.b") - 1, F.col("lead").cast("int")), "least": F.greatest(F.col("half.a"), (F.col("lead") - F.col("strings") + 1).cast("int"))}
    )
    cut = cut.where("least <= most").withColumn("offset", (F.col("lead") - F.col("most")).cast("int"))
    common = [F.substr("bytes", F.col("lead") - F.col("half.a") + 1, F.col("half.a")), F.substr("bytes", F.col("lead").cast("int") + 1, LENGTH + 1 - F.col("half.b"))]
    piece = F.substr("bytes", F.col("offset") + 1, F.col("most") - F.col("least") + LENGTH)
    cut = cut.select("part", "context", "offset", "half", "most", "least", F.xxhash64("part", "half.a", *common).alias("within"), piece.alias("piece"))
    seed = 0
    while True:  # until no hash names two different pieces
        named = cut.withColumn("name", F.xxhash64(F.lit(seed), "most", "piece"))
        lead, strings = F.col("most").cast("short").alias("lead"), (F.col("most") - F.col("least") + 1).cast("short").alias("strings")
        parts = _grouped(named.select(F.col("within").alias("part"), F.col("name").alias("context"), F.col("half.a").alias("low_reach"), F.col("half.b").alias("high_reach"), lead, strings, F.col("piece").alias("bytes")))
        if parts is not None:
            break
        seed += 1
    made.append(parts)
    inner = parts.where("n > 1").select("part", "context", F.lit(0).alias("low"), F.length("bytes").alias("high")).union(shared_strings(parts, made))
    inner = inner.select(F.col("part").alias("within"), F.col("context").alias("name"), "low", "high")
    outer = named.select("part", "context", "offset", "within", "name").join(inner, ["within", "name"])
    return spans.union(outer.select("part", "context", (F.col("offset") + F.col("low")).alias("low"), (F.col("offset") + F.col("high")).alias("high")))


def copies(rows: DataFrame) -> DataFrame:
    """(row_hash, text): texts that rows (row_doc, row_hash, text) hold more than once; written.

    A hash whose rows hold different texts is left out, so a row's text is in here if and only if its hash is.
    """
    often = materialize(rows.groupBy("row_hash").agg(F.count("*").alias("n")).where("n > 1").select("row_hash"), "often")
    found = rows.join(often, "row_hash").groupBy("row_hash").agg(F.min("text").alias("text"), F.max("text").alias("most"))
    found = materialize(found.where("text = most").select("row_hash", "text"), "copies")
    discard(often)
    return found


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(row_doc, row_hash, low, high): byte spans of rows (row_doc, row_hash, text) that repeated strings cover.

    The rows are distinct; those without row_doc are compared with the others and have no spans of their own.
    """
    seed, contexts = 0, None
    while contexts is None:  # until no hash names two different contexts of a gram
        found = rows.mapInArrow(lambda batches, seed=seed: _anchor_rows(batches, seed), "row_doc long, row_hash long, start long, lead short, strings short, gram long, context long")
        found = materialize(found, "anchors")
        grams = materialize(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gram").alias("gram_")), "grams")
        again = materialize(found.join(grams, F.col("gram") == F.col("gram_")).drop("gram_"), "again")
        discard(found)
        discard(grams)
        wanted = again.groupBy("row_doc", "row_hash").agg(F.collect_list(F.struct("gram", "context", "lead", "strings", "start")).alias("wanted"))
        texts = rows.alias("d").join(wanted.alias("w"), F.col("d.row_doc").eqNullSafe(F.col("w.row_doc")) & (F.col("d.row_hash") == F.col("w.row_hash")))
        cut = texts.select("d.text", "w.wanted").mapInArrow(_cut_contexts, "gram long, context long, lead short, strings short, bytes binary")
        contexts = _grouped(cut.select(F.col("gram").alias("part"), "context", F.lit(0).alias("low_reach"), F.lit(GRAMS).alias("high_reach"), "lead", "strings", "bytes"))
        seed += 1
        if contexts is None:
            discard(again)
    made: list[DataFrame] = []
    whole = contexts.where("n > 1").select("part", "context", F.lit(0).alias("low"), F.length("bytes").alias("high"))
    spans = materialize(whole.union(shared_strings(contexts, made)), "spans")
    for table in [contexts, *made]:
        discard(table)
    owned = again.where("row_doc is not null").select("row_doc", "row_hash", "start", F.col("gram").alias("part"), "context")
    spans = materialize(owned.join(spans, ["part", "context"]).select("row_doc", "row_hash", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")), "row-spans")
    discard(again)
    return spans


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """UTF-8 without the characters that lie in sorted, separate spans as a whole."""
    kept, at = [], 0
    for low, high in spans:
        while low < high and data[low] & 0xC0 == 0x80:
            low += 1
        while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
            high -= 1
        kept.append(data[at:low])
        at = high
    return b"".join([*kept, data[at:]])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, whole, spans, others): the others and what is left of the text."""
    for batch in batches:
        texts, whole, spans, out = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2), []
        for row, data in enumerate(texts):
            data, runs = data or b"", []
            found = spans[row].as_py() or ()
            if whole[row] and len(data) >= LENGTH:
                found = [{"low": 0, "high": len(data)}]
            for low, high in sorted((s["low"], s["high"]) for s in found):
                if runs and low <= runs[-1][1]:
                    runs[-1][1] = max(high, runs[-1][1])
                else:
                    runs.append([low, high])
            rest = b"".join(data[a:b] for a, b in zip([0, *(h for _, h in runs)], [*(low for low, _ in runs), len(data)], strict=True))
            out.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), without(data, runs).decode("utf-8", "surrogatepass")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays(batch.columns[3:] + made, [*batch.schema.names[3:], *MADE])


MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def remove_repeats(documents: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns ``keep`` and n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    Bytes covered by a 200-byte string that also starts anywhere else, in the same document included, are removed.
    kept_sha256 is the digest of the bytes left; kept_text is the text without the characters that are removed
    whole, so one that is cut stays. Null text is empty, texts under 200 bytes keep all; repeated rows are
    documents of their own and so remove each other, as do equal texts of any ids; equal doc_ids with different
    texts are told apart; a very long text is one row and so one task's; an empty table gives an empty one; other
    columns are ignored, and a column of ``keep`` that has the name of a made one is left out.
    """
    keep = tuple(c for c in keep if c not in MADE)
    kept = [F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    rows = documents.select("text", F.coalesce("doc_id", F.lit(0)).cast("long").alias("row_doc"), F.xxhash64("text").alias("row_hash"), *kept)
    texts = rows.select("row_doc", "row_hash", "text").where(F.octet_length("text") >= LENGTH)
    same = copies(texts)
    single = texts.join(same.select("row_hash"), "row_hash", "left_anti").select("row_doc", "row_hash", "text")
    spans = repeated_spans(single.union(same.select(F.lit(None).cast("long").alias("row_doc"), "row_hash", "text")))
    marks = spans.groupBy("row_doc", "row_hash").agg(F.collect_list(F.struct("low", "high")).alias("spans")).withColumn("whole", F.lit(False))
    none = F.lit(None).cast(marks.schema["spans"].dataType)
    marks = marks.union(same.select(F.lit(None).cast("long"), "row_hash", none, F.lit(True)))
    d, m = rows.alias("d"), marks.alias("m")
    own = (F.col("d.row_hash") == F.col("m.row_hash")) & (F.col("m.whole") | (F.col("d.row_doc") == F.col("m.row_doc")))
    joined = d.join(m, own, "left").select("d.text", "m.whole", "m.spans", *[f"d.kept_{k}" for k in range(len(keep))])
    kinds = "".join(f"kept_{k} {documents.schema[c].dataType.simpleString()}, " for k, c in enumerate(keep))
    found = joined.mapInArrow(_remove, f"{kinds}n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return found.select(*[F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)], *MADE)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("doc_id",)).drop("kept_text")

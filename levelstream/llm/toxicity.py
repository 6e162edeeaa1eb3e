"""Toxicity by a bidirectional gated recurrent network with attention, trained here in numpy.

A word is the sum of what is known of it as a word (a vector of its own if the training rows have it often) and as
characters (the mean of the vectors of its trigrams). Two recurrent layers read a window forwards and backwards,
attention pools their states, and a logistic unit scores the window. Windows of WINDOW words overlap and cover the
whole text; a document has the score of its worst window. As labels mark documents, each training round picks the
worst window of a document by the model so far and learns from that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

WINDOW, STEP = 48, 36
THRESHOLD = 0.7
#: Bounds of the training sample: documents of each label, in order of a hash of doc_id, and their windows in all.
#: A document comes with all its windows or not at all.
SAMPLE = {1: 1500, 0: 3000}
SAMPLE_WINDOWS = {1: 30_000, 0: 45_000}
#: Words and trigrams that get vectors, the most frequent of the sample.
WORDS, TRIGRAMS = 20_000, 20_000
SIZE, HIDDEN = 8, 8
#: Documents of the usual share of labels that a word or trigram counts as having besides its own.
SHRINK = 5.0
#: Documents that have a word or trigram which gets a vector, at least.
LEAST_DOCUMENTS = 4
#: Rounds at least, and steps at least (small samples get more rounds); of STUDY documents one only places the threshold.
ROUNDS, STEPS, BATCH, RATE, STUDY = 6, 300, 64, 0.02, 5
#: Vectors of words and trigrams learn at a share of the rate, as few documents speak for each; all is drawn to zero.
VECTOR_RATE, DECAY, VECTOR_DECAY = 0.1, 1e-2, 1e-4
#: False alarms that a missed document weighs as many as when the threshold is placed. Marks can be wrong, so it is not
#: the share of the labels: a document marked without reason would then outweigh ten clean ones.
MISSED = 3.0
#: Words whose features a worker process remembers, from task to task.
REMEMBERED = 100_000
_MARKS = ".,;:!?\"'()[]{}<>*_-…«»“”„"


def clean(word: str) -> str:
    return word.strip(_MARKS)


def trigrams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + 3] for i in range(max(1, len(padded) - 2))]


def window_starts(n: int) -> list[int]:
    """Starts of the windows that cover n words; one window at least."""
    return list(range(0, max(1, n - WINDOW + STEP if n > WINDOW else 1), STEP))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, the forward pass and its gradient."""

    def __init__(self, words: dict[str, int], grams: dict[str, int], seed: int = 10):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
        self.words, self.grams = words, grams
        # Row 0 is the unknown word or trigram, and stays zero.
        self.p = {"words": draw(len(words) + 1, SIZE) * 0.1, "grams": draw(len(grams) + 1, SIZE) * 0.1}
        self.p["words"][0] = self.p["grams"][0] = 0
        for way in "fb":
            self.p |= {f"w{way}": draw(2 * SIZE, 3 * HIDDEN), f"u{way}": draw(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.shift, self.scale = 0.0, 1.0

    def indices(self, word: str) -> tuple[int, list[int]]:
        return self.words.get(word, 0), [self.grams.get(g, 0) for g in trigrams(word)]

    def vectors(self, words: list[str]) -> np.ndarray:
        """The input vectors of cleaned words."""
        found = [self.indices(w) for w in words]
        bounds = np.cumsum([0, *(len(g) for _, g in found)])
        flat = self.p["grams"][np.array([i for _, g in found for i in g], np.int64)]
        means = np.add.reduceat(flat, bounds[:-1], axis=0) / np.diff(bounds)[:, None] if len(found) else np.zeros((0, SIZE))
        return np.concatenate([self.p["words"][[i for i, _ in found]], means], axis=1).astype(np.float32)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both directions."""
        return np.concatenate([vectors @ self.p[f"w{way}"] + self.p[f"c{way}"] for way in "fb"], axis=1)

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: gates (windows, WINDOW, 6 HIDDEN), mask (windows, WINDOW) of words that are there."""
        n, length = mask.shape
        states, memo = np.zeros((n, length, 2 * HIDDEN), np.float32), {}
        for k, way in enumerate("fb"):
            u, h = self.p[f"u{way}"], np.zeros((n, HIDDEN), np.float32)
            for t in range(length) if way == "f" else range(length - 1, -1, -1):
                x, s, m = gates[:, t, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)], h @ u, mask[:, t, None]
                zr = _sigmoid(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
                after = h + m * (1 - z) * (c - h)
                if keep:
                    memo[way, t] = (h, z, r, c, s[:, 2 * HIDDEN :])
                h = after
                states[:, t, HIDDEN * k : HIDDEN * (k + 1)] = h
        raw = states @ self.p["attend"]
        weight = np.exp(np.clip(raw, -30, 30)) * mask
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, weight, pooled, memo)) if keep else logit

    def gradient(self, inputs: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log loss by parameter, and by input vector."""
        logit, (states, weight, pooled, memo) = self.forward(self.project(inputs.reshape(-1, 2 * SIZE)).reshape(*mask.shape, -1), mask, keep=True)
        n, length = mask.shape
        d_logit = (_sigmoid(logit) - label) / n
        g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = np.einsum("nth,nh->nt", states, d_pooled)
        d_raw = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["attend"] = np.einsum("nt,nth->h", d_raw, states)
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_raw[:, :, None] * self.p["attend"]
        d_inputs = np.zeros_like(inputs)
        for k, way in enumerate("fb"):
            u, w = self.p[f"u{way}"], self.p[f"w{way}"]
            g[f"u{way}"], d_h, d_gates = np.zeros_like(u), np.zeros((n, HIDDEN)), np.zeros((n, length, 3 * HIDDEN), np.float32)
            for t in range(length - 1, -1, -1) if way == "f" else range(length):
                h, z, r, c, s = memo[way, t]
                d_h = d_h + d_states[:, t, HIDDEN * k : HIDDEN * (k + 1)]
                d_new, m = d_h * mask[:, t, None], mask[:, t, None]
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * s * r * (1 - r)
                d_s = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_gates[:, t] = np.concatenate([d_z, d_r, d_c], axis=1)
                g[f"u{way}"] += h.T @ d_s
                d_h = d_h * (1 - m) + d_new * z + d_s @ u.T
            flat = d_gates.reshape(-1, 3 * HIDDEN)
            g[f"w{way}"], g[f"c{way}"] = inputs.reshape(-1, 2 * SIZE).T @ flat, flat.sum(axis=0)
            d_inputs += (flat @ w.T).reshape(inputs.shape)
        return g, d_inputs


def _frequent(sets: Iterable[set[str]], labels: list[int], most: int) -> tuple[dict[str, int], np.ndarray]:
    """Items of at least LEAST_DOCUMENTS, by falling frequency, from 1 on; and the shrunken log odds of the label given each."""
    counts: dict[str, list[int]] = {}
    for items, label in zip(sets, labels, strict=True):
        for item in items:
            counts.setdefault(item, [0, 0])[label] += 1
    kept = sorted((i for i, c in counts.items() if sum(c) >= LEAST_DOCUMENTS), key=lambda i: (-sum(counts[i]), i))[:most]
    share = (np.array([labels.count(0), labels.count(1)]) + 1.0) / (len(labels) + 2.0)
    have = np.array([counts[i] for i in kept], float).reshape(-1, 2) + SHRINK * share
    odds = np.log(have[:, 1] / share[1]) - np.log(have[:, 0] / share[0])
    return {item: k + 1 for k, item in enumerate(kept)}, odds


def train(sample: list[tuple[list[list[str]], int]], seed: int = 10) -> Network:
    """A network from (windows of cleaned words, label) of documents; some empty ones are added as clean."""
    if sample:
        sample = sample + [([[]], 0)] * (1 + len(sample) // 50)
    labels = [label for _, label in sample]
    words_of = ({w for x in windows for w in x} for windows, _ in sample)
    words, word_odds = _frequent(words_of, labels, WORDS)
    grams_in = ({g for w in {w for x in windows for w in x} for g in trigrams(w)} for windows, _ in sample)
    grams, gram_odds = _frequent(grams_in, labels, TRIGRAMS)
    net = Network(words, grams, seed)
    # The first component starts at the log odds, so that the first rounds look at the right windows.
    net.p["words"][1:, 0], net.p["grams"][1:, 0] = np.clip(word_odds, -3, 3), np.clip(gram_odds, -3, 3)
    if 1 not in labels or not any(x for windows, label in sample if not label for x in windows):
        net.p["bias"][0] = 4.0 if 1 in labels else -4.0
        net.p["out"][:] = 0
        return net
    known = sorted({w for windows, _ in sample for x in windows for w in x})
    number = {w: k + 1 for k, w in enumerate(known)}
    word_of = np.array([0] + [words.get(w, 0) for w in known], np.int32)
    lists = [[0]] + [net.indices(w)[1] for w in known]
    count = np.array([len(g) for g in lists])
    begin = np.cumsum(count) - count
    flat = np.fromiter((i for g in lists for i in g), np.int32, int(count.sum()))
    del lists

    def trigrams_of(ids):
        """The trigrams of words, one after another, and the word that each belongs to."""
        n = count[ids]
        row = np.repeat(np.arange(len(ids)), n)
        return flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[ids][row]], row

    def means(values, ids):
        at, _ = trigrams_of(ids)
        return np.add.reduceat(values[at], np.cumsum(count[ids]) - count[ids], axis=0) / count[ids].reshape(-1, *[1] * (values.ndim - 1))

    owner = np.array([d for d, (windows, _) in enumerate(sample) for _ in windows])
    tokens = np.zeros((len(owner), WINDOW), np.int32)
    for row, x in enumerate(x for windows, _ in sample for x in windows):
        tokens[row, : len(x)] = [number[w] for w in x]
    label_of = np.array(labels, np.float32)

    def vectors(ids):
        """Input vectors of words; the number 0 is no word."""
        there = (ids > 0)[:, None]
        return (np.concatenate([net.p["words"][word_of[ids]], means(net.p["grams"], ids)], axis=1) * there).astype(np.float32)

    def logits(rows):
        gates = net.project(vectors(np.arange(len(count))))
        return np.concatenate([net.forward(gates[tokens[rows[k : k + 2048]]], (tokens[rows[k : k + 2048]] > 0).astype(np.float32)) for k in range(0, len(rows), 2048)])

    def worst(score):
        best = np.full(len(sample), -np.inf)
        np.maximum.at(best, owner, score)
        rows = np.flatnonzero(score == best[owner])
        return rows[np.unique(owner[rows], return_index=True)[1]]

    rng = np.random.default_rng(seed)
    everyone = np.arange(len(count))
    odds = (np.concatenate([[0], word_odds])[word_of] + means(np.concatenate([[0], gram_odds]), everyone)) * (everyone > 0)
    score = odds[tokens].max(axis=1)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second, step = {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    everything = np.arange(len(owner))
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    copies = np.array([max(1, round(weight[label])) for label in labels])
    # Of each label, in turn, one document in STUDY is kept apart from the steps.
    turn = np.zeros(len(labels), int)
    for label in (0, 1):
        turn[label_of == label] = np.arange((label_of == label).sum())
    apart = (turn % STUDY == STUDY - 1) if min(np.bincount(labels, minlength=2)) >= STUDY else np.zeros(len(labels), bool)
    per_round = -(-int(copies[~apart].sum() * 1.5) // BATCH)
    rounds = max(ROUNDS, -(-STEPS // per_round))
    for round_ in range(rounds):
        picked = worst(score)
        picked = picked[~apart[owner[picked]]]
        random = everything[rng.permutation(len(owner))]
        clean_rows = random[(label_of[owner[random]] == 0) & ~apart[owner[random]]][: len(picked) // 2]
        rows = np.concatenate([np.repeat(picked, copies[owner[picked]]), clean_rows])
        rows = rows[rng.permutation(len(rows))]
        for k in range(0, len(rows), BATCH):
            part = rows[k : k + BATCH]
            own, place = np.unique(tokens[part], return_inverse=True)
            place = place.reshape(len(part), WINDOW)
            mask = (tokens[part] > 0).astype(np.float32)
            x = vectors(own)[place]
            dropped = rng.random(mask.shape) < 0.2  # as if the word were unknown, so that its characters are learnt
            x[..., :SIZE] *= ~dropped[..., None]
            g, d_x = net.gradient(x, mask, label_of[owner[part]])
            d_x *= mask[..., None]
            d_x[..., :SIZE] *= ~dropped[..., None]
            d_own = np.zeros((len(own), 2 * SIZE), np.float32)
            np.add.at(d_own, place, d_x)
            g["words"], g["grams"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["grams"])
            np.add.at(g["words"], word_of[own], d_own[:, :SIZE])
            at, row = trigrams_of(own)
            np.add.at(g["grams"], at, d_own[row, SIZE:] / count[own][row][:, None])
            g["words"][0] = g["grams"][0] = 0
            step += 1
            for name, value in net.p.items():
                vector = name in ("words", "grams")
                d = g[name] + (VECTOR_DECAY if vector else DECAY) * value
                first[name] += 0.1 * (d - first[name])
                second[name] += 0.01 * (d * d - second[name])
                rate = RATE * (VECTOR_RATE if vector else 1) * (1 - round_ / rounds) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                value -= (rate * first[name] / (np.sqrt(second[name]) + 1e-6)).astype(np.float32)
        score = logits(everything)
    # The middle of the gap that parts the labels best, among the documents kept apart, gets the score THRESHOLD.
    judged = np.flatnonzero(apart) if apart.any() else np.arange(len(labels))
    best, truth = score[worst(score)][judged], label_of[judged]
    order = np.argsort(best, kind="stable")
    missed = np.concatenate([[0], np.cumsum(truth[order])]) * MISSED
    blamed = np.concatenate([np.cumsum((1 - truth[order])[::-1])[::-1], [0]])
    edge = np.concatenate([[best.min() - 2], best[order], [best.max() + 2]])
    cuts = np.flatnonzero(missed + blamed == (missed + blamed).min())
    cut = cuts[np.argmax(edge[cuts + 1] - edge[cuts])]
    net.shift = float((edge[cut] + edge[cut + 1]) / 2 - np.log(THRESHOLD / (1 - THRESHOLD)))
    return net


class Scorer:
    """Scores whole texts; remembers the gates of words."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.gates = np.zeros((REMEMBERED + 1, 6 * HIDDEN), np.float32)

    def _learn(self, words: set[str]):
        fresh = sorted(words)
        if not fresh:
            return
        n = len(self.number) + 1
        if len(self.gates) < n + len(fresh):  # more words in one step than are remembered
            self.gates = np.concatenate([self.gates, np.zeros((n + len(fresh) - len(self.gates), 6 * HIDDEN), np.float32)])
        self.gates[n : n + len(fresh)] = self.net.project(self.net.vectors([clean(w) for w in fresh]))
        self.number.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def windows(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Gates and masks of the windows of known words, some hundreds at a time."""
        starts = window_starts(len(words))
        for k in range(0, len(starts), 256):
            part = starts[k : k + 256]
            some = words[part[0] : part[-1] + WINDOW]
            ids = np.fromiter(map(self.number.__getitem__, some), np.int64, len(some))
            place = np.array(part)[:, None] - part[0] + np.arange(WINDOW)
            inside = place < len(ids)
            rows = np.where(inside, ids[np.minimum(place, max(0, len(ids) - 1))] if len(ids) else 0, 0)
            yield self.gates[rows], inside.astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        best, held, masks, owner = np.full(len(texts), -np.inf), [], [], []

        def flush():
            if held:
                logit = self.net.forward(np.concatenate(held), np.concatenate(masks))
                np.maximum.at(best, np.array(owner), logit)
                held.clear(), masks.clear(), owner.clear()

        lists = [text.lower().split() for text in texts]
        wanted = set().union(*lists)
        missing = wanted - self.number.keys()
        if len(self.number) + len(missing) > REMEMBERED:
            self._forget()
            missing = wanted
        self._learn(missing)
        for d, words in enumerate(lists):
            for gates, mask in self.windows(words):
                held.append(gates)
                masks.append(mask)
                owner.extend([d] * len(mask))
                if len(owner) >= 1536:
                    flush()
        flush()
        return _sigmoid(np.clip((best - self.net.shift) * self.net.scale, -40, 40))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, toxic, place, text) to a row for each window: doc_id, toxic, place, start, words."""
    for batch in batches:
        for k in range(0, batch.num_rows, 50):
            out = []
            for doc, toxic, place, text in zip(*(c.to_pylist() for c in batch.slice(k, 50).columns), strict=True):
                words = (text or "").lower().split()
                out += [(doc, toxic, place, s, " ".join(map(clean, words[s : s + WINDOW]))) for s in window_starts(len(words))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "toxic", "place", "start", "words"])


def fit(documents: DataFrame, labels: DataFrame, seed: int = 10) -> Network:
    """Train on a bounded sample of the labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    The sample is the first SAMPLE documents of each label in the order of a hash of doc_id, each with all its
    windows, as far as these are SAMPLE_WINDOWS together; a document that would exceed that is left out for the
    next. So what comes to the driver is bounded. Rows with null ids or labels other than 0 and 1, and labels without a
    document, are left out; an id with several labels counts as toxic if any says so; of several rows of an id the
    least text is taken, null as empty; ties of the hash go by doc_id; without rows of both labels, or without any,
    the score is constant; other columns are ignored.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.join(documents.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64(F.lit(10), "doc_id"), F.col("doc_id")]
    chosen = [marked.where(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in SAMPLE.items()]
    rows = [(r.doc_id, r.toxic, k) for part in chosen for k, r in enumerate(part.orderBy(*order).collect())]
    ids = documents.sparkSession.createDataFrame(rows, "doc_id long, toxic int, place long")
    texts = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    windows = materialize(texts.mapInArrow(_all_windows, "doc_id long, toxic int, place long, start long, words string"), "windows")
    taken, held = set(), {0: 0, 1: 0}
    for r in sorted(windows.groupBy("doc_id", "toxic", "place").count().collect(), key=lambda r: r.place):  # at most SAMPLE rows
        if held[r.toxic] + r["count"] <= SAMPLE_WINDOWS[r.toxic]:
            held[r.toxic] += r["count"]
            taken.add(r.doc_id)
    chosen_windows = windows
    if len(taken) < len(rows):
        chosen_windows = windows.join(F.broadcast(documents.sparkSession.createDataFrame([(d,) for d in taken], "doc_id long")), "doc_id")
    found = chosen_windows.select("doc_id", "toxic", "start", "words").toPandas().sort_values(["doc_id", "start"])
    discard(windows)
    sample: dict[int, tuple[list[list[str]], int]] = {}
    pool: dict[str, str] = {}  # one string for each word, however often it comes
    for doc, toxic, _, words in found.itertuples(index=False, name=None):
        sample.setdefault(doc, ([], toxic))[0].append([pool.setdefault(w, w) for w in words.split(" ")] if words else [])
    del found
    return train([sample[d] for d in sorted(sample)], seed)


def score(documents: DataFrame, net: Network) -> DataFrame:
    """The columns of ``documents`` and ``toxicity``: the score of the whole text, 0 to 1.

    Null and empty text get the score of an empty window; nothing but the text is an input, so rows of equal text
    get equal scores whatever their ids; a very long text is scored some hundred windows at a time; a column that
    is named toxicity already is replaced; an empty table gives an empty one.
    """
    documents = documents.drop("toxicity")
    model = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value  # one object for all tasks of a worker process
        scorer = net.scorer = getattr(net, "scorer", None) or Scorer(net)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for k in range(0, batch.num_rows, 250):
                values = scorer.scores([t or "" for t in texts.slice(k, 250).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 250).columns, pa.array(values, pa.float64())], [*batch.schema.names, "toxicity"])
        pa.default_memory_pool().release_unused()  # the worker process lives on

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.schema.fields)
    return documents.mapInArrow(run, f"{schema}toxicity double")


def query(spark, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))

import math
import random
import zlib

import numpy as np

from levelstream.llm import toxicity as T


def test_windows_cover():
    for n in (0, 1, 47, 48, 49, 83, 84, 85, 120, 121, 1000):
        starts = T.window_starts(n)
        seen = {i for s in starts for i in range(s, s + T.WINDOW)}
        assert set(range(n)) <= seen and (len(starts) == 1 or starts[-1] < n)
        assert all(b - a == T.STEP for a, b in zip(starts, starts[1:], strict=False))


def test_gradient_is_the_difference_quotient():
    rng = np.random.default_rng(1)
    net = T.Network({"a": 1}, {"<a>": 1})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, label = rng.normal(size=(3, 6, 2 * T.SIZE)), np.array([[1] * 6, [1, 1, 1, 0, 0, 0], [0] * 6], float), np.array([1.0, 0, 1])

    def loss():
        gates = net.project(x.reshape(-1, 2 * T.SIZE)).reshape(3, 6, -1)
        p = T._sigmoid(net.forward(gates, mask).astype(np.float64))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    g, d_x = net.gradient(x, mask, label)
    for name in ("wf", "uf", "cf", "wb", "ub", "cb", "attend", "out", "bias"):
        value = net.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            value[at] += 1e-3
            up = loss()
            value[at] -= 2e-3
            down = loss()
            value[at] += 1e-3
            assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3, name
    x[0, 2, 3] += 1e-3
    up = loss()
    x[0, 2, 3] -= 2e-3
    assert abs((up - loss()) / 2e-3 - d_x[0, 2, 3]) < 2e-3


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(["th", "er", "an", "ing", "on"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 300))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["vile", "Scum.", "loathe" + rng.choice(["r", "d", "th", "an"])])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = made(700, 2)
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t, _ in rows] + [(10_000, None, "en", 1), (10_001, "", "en", 1), (10_002, "\n", "en", 1)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows] + [(None, 1, 1), (99_999, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.score(docs, T.fit(docs, labels)).collect()}
    held = [(got[d].toxicity >= T.THRESHOLD, y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    right = [sum(p == bool(y) for p, y in held if y == k) / sum(y == k for _, y in held) for k in (0, 1)]
    assert min(right) > 0.9, right
    assert all(0 <= r.toxicity <= 1 for r in got.values()) and got[10_000].toxicity == got[10_001].toxicity < T.THRESHOLD
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels)).count() == 0


def test_scores_do_not_depend_on_company():
    net = T.train([([["bad", "thing"]], 1), ([["good", "thing"]], 0)] * 4)
    texts = [" ".join(random.Random(k).choices(["good", "bad", "thing"], k=100 * k)) for k in range(5)]
    together = T.Scorer(net).scores(texts)
    assert np.allclose(together, [T.Scorer(net).scores([t])[0] for t in texts], atol=1e-6)


def test_labels_of_one_kind():
    assert T.Scorer(T.train([([["a"]], 0)])).scores(["a"])[0] < 0.1 < 0.9 < T.Scorer(T.train([([["a"]], 1)])).scores(["a"])[0]


def plain_score(net, text):
    """The score by loops over single numbers, from the parameters alone."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b, strict=True))
    p, h_size, best = net.p, T.HIDDEN, -math.inf
    words = [w.strip(T._MARKS) for w in text.lower().split()]
    start = 0
    while True:
        inputs = []
        for w in words[start : start + T.WINDOW]:
            padded = "<" + w + ">"
            grams = [padded[i : i + 3] for i in range(max(1, len(padded) - 2))]
            rows = [p["grams"][net.grams.get(g, 0)] for g in grams]
            inputs.append([float(x) for x in p["words"][net.words.get(w, 0)]] + [sum(float(r[k]) for r in rows) / len(rows) for k in range(T.SIZE)])
        states = [[] for _ in inputs]
        for way in "fb":
            w, u, c = p["w" + way], p["u" + way], p["c" + way]
            h = [0.0] * h_size
            for t in range(len(inputs)) if way == "f" else reversed(range(len(inputs))):
                x = [dot(inputs[t], w[:, k]) + float(c[k]) for k in range(3 * h_size)]
                s = [dot(h, u[:, k]) for k in range(3 * h_size)]
                z = [sigmoid(x[k] + s[k]) for k in range(h_size)]
                r = [sigmoid(x[h_size + k] + s[h_size + k]) for k in range(h_size)]
                new = [math.tanh(x[2 * h_size + k] + r[k] * s[2 * h_size + k]) for k in range(h_size)]
                h = [z[k] * h[k] + (1 - z[k]) * new[k] for k in range(h_size)]
                states[t] = states[t] + h
        weight = [math.exp(min(30, max(-30, dot(state, p["attend"])))) for state in states]
        pooled = [sum(a * state[k] for a, state in zip(weight, states, strict=True)) / sum(weight) for k in range(2 * h_size)] if states else [0.0] * 2 * h_size
        best = max(best, dot(pooled, p["out"]) + float(p["bias"][0]))
        if start + T.WINDOW >= len(words):
            return sigmoid((best - net.shift) * net.scale)
        start += T.STEP


def test_scores_are_those_of_plain_loops():
    rows = made(120, 3)
    sample = []
    for _, text, toxic in rows:
        words = [T.clean(w) for w in text.lower().split()]
        sample.append(([words[s : s + T.WINDOW] for s in T.window_starts(len(words))], toxic))
    net = T.train(sample)
    texts = [t for _, t, _ in rows[:25]] + ["", "VILE", "unknown wörd, vile!"]
    got = T.Scorer(net).scores(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)
    assert got.std() > 0.05


def test_repeated_ids_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE_WINDOWS", {1: 300, 0: 300})
    long = " ".join(["vile"] + ["word"] * 3000)  # 84 windows
    rows = [(1, long, 0.5)] * 30 + [(i, f"good thing {i}", 0.5) for i in range(2, 60)] + [(None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0)] + [(i, i % 2) for i in range(2, 60)], "doc_id long, toxic int")
    net = T.fit(docs, labels)
    got = T.score(docs, net)
    assert got.columns == ["doc_id", "text", "toxicity"] and got.count() == len(rows)
    assert got.select(T._held_out(got.doc_id).alias("h")).where("h is null").count() == 0


def test_windows_of_the_sample_are_bounded_and_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "train", lambda sample, seed: seen.extend(sample))
    monkeypatch.setattr(T, "SAMPLE_WINDOWS", {1: 10, 0: 10})
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(36 * (i % 6) + 20))) for i in range(60)] * 3, "doc_id long, text string")
    T.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    for label in (0, 1):
        windows = [w for w, y in seen if y == label]
        assert 8 <= sum(map(len, windows)) <= 10
    assert all(len(w) == len(T.window_starts(36 * (len(w) - 1) + 20)) for w, _ in seen)

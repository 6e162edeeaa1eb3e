import numpy as np
import pytest

from levelstream.llm import piece_codes as P

from .conftest import made_texts

HARD = ["", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "\n\n a\n b \n", "▁", "a ▁ b▁c", "日本語 😀 x́", "\x00\x1f\ttab", "Hello world. It's 3.14!", "ſ ﬁ İ ß", "a\r\nb", "   x"]


@pytest.fixture(scope="module")
def model():
    return P.Model(P.piece_bpe())


def test_is_the_library_without_dropout(model):
    texts = [t for t in HARD if P.SPACE not in t] + [r[1] or "" for r in made_texts(5, 60)]
    got = P.Encoder(model, 0.0).encode(texts, [0] * len(texts))
    assert [g.tolist() for g in got] == [model.library.encode(t) for t in texts]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.7, 1.0])
def test_decodes_losslessly(model, dropout):
    texts = HARD + [r[1] or "" for r in made_texts(6, 40)]
    encoder = P.Encoder(model, dropout)
    assert [encoder.decode(i).decode() for i in encoder.encode(texts, [3] * len(texts))] == texts


def plain_agenda(model, part, key, dropout):
    """One unit, one candidate at a time."""
    symbols, at, skipped = [(model.id_of.get(c, -1), 1) for c in part], None, set()
    while True:
        best, where = None, 0
        for (a, n), (b, m) in zip(symbols, symbols[1:], strict=False):
            span = (where, where + n, where + n + m)
            where += n
            joined = model.id_of.get(model.pieces[a] + model.pieces[b]) if a >= 0 and b >= 0 else None
            h = key
            for x, odd in zip(span, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True):
                h = (h ^ (x + 1)) * odd % 2**64
                h ^= h >> 32
            if joined is None or h < int(dropout * 2**64):
                continue
            rank = -model.library.get_score(joined)
            if best is None or rank < best[0]:
                best = (rank, span, joined)
        if best is None:
            return [i for i, _ in symbols]
        at, out = 0, []
        for i, n in symbols:
            if best[1][0] <= at < best[1][2]:
                if at == best[1][0]:
                    out.append((best[2], best[1][2] - best[1][0]))
            else:
                out.append((i, n))
            at += n
        symbols = out
        skipped.clear()


def test_agenda_by_hand(model):
    units = ["▁internationalisation", "▁thererenationshipoftheth", "▁donaudampfschifffahrtx"]
    for unit in units:
        for key in (1, 2**63 + 5, 0x1234567890ABCDEF):
            assert np.frombuffer(model.encoded([unit], [key], 0.3)[0], "<i4").tolist() == plain_agenda(model, unit, key, 0.3)


def test_pairs_that_no_piece_holds_are_not_joined(model):
    rng = np.random.default_rng(4)
    left, right = rng.integers(-1, model.size, (2, 300_000))
    taken = model.slots[model.slots >= 0]
    left[:50_000], right[:50_000] = rng.choice(taken, 50_000) // model.size, rng.integers(0, model.size, 50_000)
    slot = model._look(left, right)
    known, key = set(taken.tolist()), left * model.size + right
    for held, k, a, b in zip(model.slots[slot].tolist(), key.tolist(), left.tolist(), right.tolist(), strict=True):
        assert held == (k if a >= 0 and b >= 0 and k in known else -1)


def test_seeds_vary_and_reruns_agree(model):
    text = " ".join(["internationally", "acknowledged", "misunderstanding"] * 8)
    one, two, three = (P.Encoder(model, 0.3, seed).encode([text], [0])[0].tolist() for seed in (1, 1, 2))
    assert one == two != three
    assert len(set(map(len, (one, three, model.library.encode(text))))) > 1


def test_documents(spark, docs, rows, no_docs):
    got = {r.doc_id: r for r in P.encode_documents(docs, P.piece_bpe).collect()}
    assert set(got) == {r[0] for r in rows} and all(r.lossless and len(r.ids) == r.n_tokens for r in got.values())
    assert P.encode_documents(no_docs, P.piece_bpe).count() == 0
    odd = spark.createDataFrame([(None, None), (1, "x"), (1, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in P.encode_documents(odd, P.piece_bpe).collect())[0] == (0, 0)


def test_every_place_document_and_copy_has_its_own_draws(spark, model):
    encoder = P.Encoder(model)
    forms = {tuple(encoder.encode([f"internationally{' internationally' * 200}"], [d])[0].tolist()) for d in range(4)}
    assert len(forms) == 4
    ids = encoder.encode(["\n".join(["internationally"] * 300)], [0])[0].tolist()
    feed = model.library.encode("\n")[-1]
    lines, line = set(), []
    for i in [*ids, feed]:
        if i == feed:
            lines.add(tuple(line))
            line = []
        else:
            line.append(i)
    assert len(lines) > 4
    text = "acknowledged misunderstanding " * 20
    rows = [(1, text, 0), (3, text, 0), (1, text, 1), (1, text, 0), (None, text, 0), (None, text + "x", 0)]
    got = [tuple(r.ids) for r in P.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, copy int").coalesce(1), P.piece_bpe, copy="copy").collect()]
    assert got[0] == got[3] and len(set(got)) == 5


def test_the_pipeline_tells_copies_apart(spark):
    import corpus_pipeline

    text = "acknowledged misunderstanding " * 20
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.pieces(spark, docs, "").collect()
    assert len({tuple(r.ids) for r in got}) == 2 and all(r.lossless for r in got)


def test_other_columns_are_ignored(spark):
    rows = [(1, "some words", "no number"), (1, "some words", None)]
    got = P.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, copy string"), P.piece_bpe).collect()
    assert got[0] == got[1] and got[0].lossless

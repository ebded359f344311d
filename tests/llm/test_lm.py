from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtrail.llm import ngram_lm as lm
from jobtrail.llm.queries import QUERIES


def test_elias_fano():
    rng = np.random.default_rng(0)
    for top, n in ((10, 40), (10**12, 500), (1, 3), (70_000, 1), (5000, 5000)):
        values = np.sort(rng.integers(0, top, n))
        ef = lm.EliasFano.encode(values)
        assert (ef.access(np.arange(n)) == values).all()
        asked = np.concatenate((values, values + 1, rng.integers(0, 2 * top, 300)))
        assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
    assert (lm.EliasFano.encode(np.empty(0, np.int64)).successor(np.array([0, 5])) == 0).all()


def test_elias_fano_is_read_whole_and_searched():
    rng = np.random.default_rng(2)
    for top, n in ((10, 40), (10**15, 500), (1, 3), (70_000, 1), (5000, 5000), (10**9, 600_000)):
        values = np.sort(rng.integers(0, top, n))
        ef = lm.EliasFano.encode(values)
        assert (ef.all() == values).all()
        asked = np.concatenate((values, values + 1, rng.integers(0, 2 * top, 300)))
        first = np.searchsorted(values, asked)
        assert (ef.find(asked) == np.where(np.append(values, -1)[first] == asked, first, -1)).all()
    none = lm.EliasFano.encode(np.empty(0, np.int64))
    assert len(none.all()) == 0 and (none.find(np.array([0, 5])) == -1).all()


def test_third_level_of_the_trie():
    """Triples are found by their history and the place of the word among the followers of the context."""
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 40, (300, 2)), axis=0)
    own, first = np.unique(pairs[:, 0], return_index=True)
    first = np.append(first, len(pairs))
    want = {}
    for place in range(len(own)):
        for u in rng.integers(1, 90, 6).tolist():
            for f in rng.integers(first[place], first[place + 1], 4).tolist():
                want[place, u, f] = int(rng.integers(1, 256))
    histories = sorted({t[:2] for t in want})
    weights = {h: 1 + i % 255 for i, h in enumerate(histories)}
    of, words = np.array(histories).T
    base = lm.raised(first, np.searchsorted(of, np.arange(len(own) + 1)))
    at = {h: b for h, b in zip(histories, base.tolist())}
    triples = sorted((at[place, u] + f - int(first[place]), code) for (place, u, f), code in want.items())
    built = lm.Trie.build(pairs[:, 0], pairs[:, 1], np.ones(len(pairs)), (of, words), np.array(list(weights.values())), *np.array(triples).T)
    trie = lm.Trie.mapped(built.stored())
    place, _ = trie.context(rng.integers(0, 45, 4000))
    u, w = rng.integers(0, 95, 4000), rng.integers(0, 45, 4000)
    history, follower = trie.history(place, u), trie.follower(place, w)
    got = trie.find_triple(place, history, follower).tolist()
    assert got == [want.get(t, 0) for t in zip(place.tolist(), u.tolist(), follower.tolist())] and any(got)
    assert [int(trie.weights[h]) if h >= 0 else 0 for h in history] == [weights.get(t, 0) for t in zip(place.tolist(), u.tolist())]
    assert trie.triples.width <= 4  # places among few followers, not words


def test_trie_and_packing():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (2000, 2)), axis=0)
    codes = rng.integers(1, 256, len(pairs)).astype(np.uint8)
    trie = lm.Trie.view(lm.Trie.build(pairs[:, 0], pairs[:, 1], codes).stored())
    want = {(a, b): c for (a, b), c in zip(pairs.tolist(), codes.tolist())}
    asked = rng.integers(0, 320, (5000, 2))
    place, kinds = trie.context(asked[:, 0])
    assert trie.find(place, asked[:, 1]).tolist() == [want.get((a, b), 0) for a, b in asked.tolist()]
    followers = Counter(a for a, _ in want)
    assert kinds.tolist() == [followers[a] for a in asked[:, 0].tolist()]
    for v in (np.array([], np.int64), np.array([0, 0]), np.array([0, 255, 256, 2**40])):
        assert lm.unpack(lm.pack(v)).tolist() == v.tolist()
    p = np.array([1, 0.5, 1e-4, 3e-9])
    assert np.abs(np.log10(lm.probability(lm.quantised(p))) - np.log10(p)).max() < 0.019


def brute(texts, shards=8):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    tokens = [(i, [w for w in (t or "").encode().lower().split()] + [None]) for i, t in texts]
    c, pairs, triples = Counter(), Counter(), Counter()
    for i, ws in tokens:
        if not held[i]:
            c.update(ws)
            pairs.update(zip([None, *ws], ws))
            triples.update(zip([None, *ws], ws, ws[1:]))
    n, v = sum(c.values()), len(c)
    unknown = (sum(x == 1 for x in c.values()) + 1) / (n + 2)
    followers, kinds, after = Counter(u for u, _ in pairs), Counter(t[:2] for t in triples), Counter()
    for t, k in triples.items():
        after[t[:2]] += k
    out = defaultdict(list)
    for i, ws in tokens:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        score = 0.0
        for at, (u, w) in enumerate(zip([None, *ws], ws)):
            p = (1 - unknown) * c[w] / n if c[w] else unknown if n else 1.0
            if c[u]:
                p = DISC(pairs[u, w], c[u]) + lm.DISCOUNT * followers[u] / c[u] * p
            h = ([None, *ws][at - 1], u)
            if at and after[h]:
                weight, count = lm.DISCOUNT * kinds[h] / after[h], triples[*h, w]
                if lm.is_spread(np.array(c[u]), np.array(c[h[0]]), shards, n):
                    p = DISC(count, c[u]) * c[u] / after[h] + weight * p
                else:
                    p = DISC(count, after[h]) + CODED(weight) * p
            score += math.log10(p)
        out[i].append((held[i], len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out


def CODED(p):
    return float(lm.probability(lm.quantised(np.array([p])))[0])


def DISC(count, total):
    return CODED((count - lm.DISCOUNT) / total) if count else 0.0


def check(rows, texts):
    want = brute(texts)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert set(got) == set(want)
    for i in want:
        for g, w in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9), i


def test_scores_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = QUERIES["op5_ngram_lm"](spark, d).collect()
    check(rows, texts)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_small_blocks_and_odd_texts(docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(lm, "PIECE_TOKENS", 50)
    texts = [(i, " ".join("abcdefg"[(i * j * j + j) % (2 + i % 6)] for j in range(i % 40))) for i in range(200)]
    texts += [(300, None), (301, ""), (302, "the the The THE end"), (303, "É é"), (303, "É é"), (None, "new words"), (304, "w " * 5000)]
    check(lm.score(docs(*texts).withColumn("block", F.lit(1)).withColumn("held", F.lit("x"))).collect(), texts)
    assert lm.score(docs()).count() == 0
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(docs((only, "a b"))).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_the_word_before_the_last_counts(docs):
    """Pairs alone cannot tell these two endings apart."""
    training = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = [(i, "a m x" if i % 2 else "b m y") for i in training] + [(held[0], "a m x"), (held[1], "a m y")]
    rows = lm.score(docs(*texts)).collect()
    check(rows, texts)
    score = {r.doc_id: r.score for r in rows}
    assert score[held[0]] > score[held[1]] + 1


def test_spread_pairs_and_wide_blocks(docs, monkeypatch):
    """Frequent contexts with many histories, histories whose followers lie in many shards, in several blocks."""
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 900)
    texts = [(i, " ".join(("the of w%d of the v%d x%d" % (i * j % 50, j % 13, i * 7 + j)) for j in range(12))) for i in range(120)]
    texts += [(i, t) for i, t in texts[:20]]
    check(lm.score(docs(*texts)).collect(), texts)


def test_blocks_of_too_many_words_for_one_key(monkeypatch):
    rng = np.random.default_rng(4)
    word = rng.integers(0, 60, 3000)
    block = lm.Block([], None, None, np.arange(60) * 7, 3000 // (1 + np.arange(60)), word, rng.permutation(word), rng.permutation(word))
    one = block.entries(5, 20_000)
    monkeypatch.setattr(lm, "KEY_BITS", 0)
    other = block.entries(5, 20_000)
    for name in lm.Entries.__dataclass_fields__:
        assert (getattr(one, name) == getattr(other, name)).all(), name
    asked = np.flatnonzero(block.context)
    for column, of in ((one.context, block.context), (one.history, block.history), (one.word, block.word)):
        assert (column[one.triple[asked]] == of[asked]).all()

"""Kernels against plain versions of themselves."""

import os
import random
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from somnolyt.llm import bpe, cnn, langid, packing, simhash, substring, toxicity

sys.path.insert(0, os.path.dirname(__file__))
import edge_rows as edge  # noqa: E402

TEXTS = st.text(alphabet=" \n\t\r\x0b\x1c\x85  　ab'stre1²É́é中<|>[]/!#Σς", max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe_of_any_text(text):
    import tiktoken
    code = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    if not hasattr(test_bpe_of_any_text, "library"):
        test_bpe_of_any_text.library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=code.ranks, special_tokens={})
    ids = code.encode(text)
    assert ids == test_bpe_of_any_text.library.encode_ordinary(text)
    assert code.decode(ids) == text.encode()


def test_merges_side_by_side_equal_single_merges():
    code, r = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), random.Random(8)
    pieces = [bytes(r.choice(b"etaoinshr \xc3\xa9") for _ in range(r.randint(1, 64))) for _ in range(800)]
    pieces = [p for p in pieces if p not in code.ranks]
    got = bpe.merge_many(pieces, code.byte_ids, code.pair_ranks)
    assert [tuple(np.frombuffer(g, "<i4").tolist()) for g in got] == [bpe.merge(p, code.ranks) for p in pieces]


def test_bpe_of_long_matches():
    import tiktoken
    code = bpe.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=code.ranks, special_tokens={})
    r = random.Random(1)
    for text in ("a" * 5000, "".join(r.choice("etaoin") for _ in range(5000)), "#" * 999, "é" * 700):
        assert code.encode(text) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_word_tokenizer_of_any_text(text):
    code = packing.word_tokenizer(P.path("word_bpe_49k.json"))
    assert code.ids(pa.array([None, text, "", text]))[3].tolist() == code.library.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_is_a_walk_over_all_cells():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_index(grid, 3)
    assert sorted(key) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def _close_fingerprints(seed):
    r, fps = random.Random(seed), {0, 1, (1 << 64) - 1}
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 25)):
            y = x
            for _ in range(r.randint(1, 5)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
            x = r.choice([x, y])
    return np.array(sorted(fps), np.uint64)


def _gray(x):
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ x >> np.uint64(s)
    return x


def test_gray_index_finds_every_pair():
    for seed in range(5):
        fps = _close_fingerprints(seed)
        fps = fps[np.argsort(_gray(fps))]
        got = set()
        for i, j in simhash.search(np.zeros(len(fps), np.int64), fps):
            got |= set(zip(i.tolist(), j.tolist()))
        want = {(i, j) for i, j in combinations(range(len(fps)), 2) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
        assert got == want


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 1])
def test_links_join_the_same_components(spark, crowded):
    from somnolyt.llm.components import stars
    fps = _close_fingerprints(11)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    star = {r.u: r.v for r in stars(simhash.links(frame, crowded=crowded)).collect()}
    got = [star.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = edge.components([int(x) for x in fps])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_stars_of_a_chain_and_a_hub(spark):
    from somnolyt.llm.components import stars
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.u: r.v for r in stars(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 50)}


def test_shards_find_every_repeated_window():
    r = random.Random(5)
    for _ in range(150):
        length, letters = r.choice([3, 5, 9, 12]), r.choice([2, 4, 50])
        base = [[str(r.randrange(letters)) for _ in range(r.randint(0, 60))] for _ in range(6)]
        docs = []
        for _ in range(8):
            d = []
            for _ in range(r.randint(0, 3)):
                b = r.choice(base)
                i = r.randrange(len(b) + 1)
                d += b[i:i + r.randint(0, 40)] + [str(r.randrange(letters)) for _ in range(r.randint(0, 5))]
            docs.append(d)
        rows = []
        for k, d in enumerate(docs):
            d = [w.encode() for w in d]
            for a, f, n in zip(*substring.passages(d, length)):
                rows.append((int(a), b" ".join(d[f:f + n + length - 1]), str(k).encode(), int(f), 1))
        spans = [[] for _ in docs]
        for _, _, tid, begin, end in substring._shard_spans(rows, length):
            spans[int(tid)].append({"begin": begin, "end": end})
        got = [substring.kept_words(d, s) for d, s in zip(docs, spans)]
        assert got == edge.without_repeats([" ".join(d) for d in docs], length)


def test_maximal_segments_are_the_textbook_ones():
    def plain(scores):
        """Repeatedly take the best remaining segment, left and right of it."""
        def solve(lo, hi):
            best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)),
                       default=(0, 0, 0, 0))
            if best[0] <= 1e-12:
                return []
            _, _, i, j = best
            return solve(lo, i) + [(i, j - 1)] + solve(j, hi)
        return solve(0, len(scores))
    r = random.Random(2)
    for _ in range(300):
        scores = [r.choice([-1, 1]) * r.uniform(0.1, 3) if r.random() < 0.4 else -0.05 for _ in range(r.randint(0, 14))]
        at = [i for i, s in enumerate(scores) if s != -0.05]
        got = toxicity.maximal_segments([scores[i] for i in at], at, 0.05)
        assert [(a, b) for a, b, _ in got] == plain(scores)
        for a, b, s in got:
            assert s == pytest.approx(sum(scores[a:b + 1]))


def test_maximal_segments_take_linear_time():
    class Counted(float):
        asked = 0

        def __add__(self, other):
            return Counted(float(self) + other)

        __radd__ = __add__

        def __sub__(self, other):
            return Counted(float(self) - other)

        def __ge__(self, other):
            Counted.asked += 1
            return float(self) >= float(other)

    r = random.Random(5)
    n = 5000
    for scores in ([1.0] * n, [r.uniform(0.1, 3) for _ in range(n)], [1 + i / n for i in range(n)], [2 - i / n for i in range(n)],
                   [r.choice([-1, 1]) * r.uniform(0.1, 3) for _ in range(n)]):
        for drift in (0.0, 0.02, 0.2, 1.0):
            Counted.asked = 0
            got = toxicity.maximal_segments([Counted(s) for s in scores], list(range(9, 10 * n, 10)), drift)
            assert Counted.asked <= 6 * n and got


def test_many_middling_passages_of_a_long_text_add_up():
    r = random.Random(6)

    def plain(n):
        return [f"plain{r.randrange(400)}" for _ in range(n)]

    def text(k):
        """24,000 tokens and k toxic words, too far apart for one segment."""
        return " ".join(w for i in range(80) for w in plain(300) + ["idiot"] * (i < k))
    sample = [(" ".join(plain(40) + ["idiot", "moron"] * (i % 4 == 0) + ["clown"] * (r.random() < (0.02, 0.5)[i % 4 == 0])),
               int(i % 4 == 0)) for i in range(600)]
    model = toxicity.train(sample)
    n, few = model.segments(text(1))
    m, many = model.segments(text(80))
    assert len(few) == 1 and len(many) == 80
    assert max(model.evidence(m, s) for _, _, s in many) == pytest.approx(model.evidence(n, few[0][2]), abs=0.1)
    assert model.probability(n, few) < 0.1 and model.probability(*model.segments(text(0))) < 0.1
    assert model.probability(m, many) > 0.9
    assert all((model.probability(*model.segments(t)) >= 0.5) == label for t, label in sample)


def _all_segmentations(word, pieces, p):
    """Probability of a word by plain recursion over its first piece."""
    done = {b"": np.ones(p.shape[1])}

    def plain(rest):
        if rest not in done:
            done[rest] = sum((p[i] * plain(rest[len(x):]) for x, i in pieces.items() if rest.startswith(x)), np.zeros(p.shape[1]))
        return done[rest]
    return plain(word)


_PIECES = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aba": 4, b" ": 5, b" ab": 6, b"bbab": 7}
_P = np.array([[.2, .1], [.3, .2], [.1, .4], [.25, .2], [.15, .1], [.3, .1], [.2, .3], [.05, .02]])


def test_forward_sums_all_segmentations():
    vocab = langid.Vocabulary(_PIECES)
    for words in ([b"a"], [b"abab", b"bbab", b"aaaa"], [b" ab"], [b"ababa", b" bbab"]):
        lattice = langid.Lattice(words, vocab)
        alpha, beta = lattice.forward(_P), lattice.backward(_P)
        for at, word in enumerate(words):
            want = _all_segmentations(word, _PIECES, _P)
            assert alpha[at, -1] == pytest.approx(want) and beta[at, 0] == pytest.approx(want)
            assert langid.rolling_log(word, vocab, _P) == pytest.approx(np.log(want))


@pytest.mark.parametrize("size", [33, 64, 200])
def test_words_of_any_length_are_summed_whole(size):
    vocab, r = langid.Vocabulary(_PIECES), random.Random(size)
    word = b" " + bytes(r.choice(b"ab") for _ in range(size))
    want = np.log(_all_segmentations(word, _PIECES, _P))
    assert langid.rolling_log(word, vocab, _P) == pytest.approx(want)
    assert np.log(langid.Lattice([word], vocab).forward(_P)[0, -1]) == pytest.approx(want)


def test_rolling_window_does_not_underflow():
    vocab = langid.Vocabulary(_PIECES)
    p = _P * np.array([1e-7, 1e-9])
    once, twice = (langid.rolling_log(b" " + b"a" * n, vocab, p) for n in (20_000, 40_000))
    assert np.isfinite(twice).all() and twice - once == pytest.approx(20_000 * np.log(p[0]), rel=1e-9)


def test_long_words_add_the_same_expected_counts():
    vocab, p, word = langid.Vocabulary(_PIECES), _P[:, 0], b" abbabaab"
    lattice, expected, long = langid.Lattice([word], vocab), np.zeros(8), np.zeros(8)
    alpha, beta = lattice.forward(p[:, None])[:, :, 0], lattice.backward(p[:, None])[:, :, 0]
    for i, j, rows, ids in lattice.steps:
        np.add.at(expected, ids, 3 / alpha[rows, -1] * alpha[rows, i] * p[ids] * beta[rows, j])
    langid.expect_long(word, 3, vocab, p, long)
    assert long == pytest.approx(expected)
    assert sum(n * len(x) for n, x in zip(long, _PIECES)) == pytest.approx(3 * len(word))


def test_text_without_spaces_is_one_word():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    vocab = langid.vocabulary(path)
    assert vocab.size == 50_256 and vocab.trie[b" the"] >= 0 and vocab.longest == 33
    text = "donaudampfschifffahrtsgesellschaft" * 30
    assert langid.words_of(text) == [text] and langid.spelled("ab") == b" ab"
    learned = {"de": {vocab.trie[b"schaft"]: .4, vocab.trie[b"fahr"]: .3}, "en": {vocab.trie[b" the"]: .5}}
    scorer = langid.Scorer(path, ["de", "en"], learned)
    (lang, score), other = scorer.score([text, "the " + text[:40] + " the"])
    assert lang == "de" and score > 0.99 and not any(len(w) > langid.MEMO_WORD for w in scorer.memo.young)
    apart = [scorer.score(["the " * 3])[0], scorer.score([text])[0]]
    assert apart[0][0] == "en" and apart[1] == (lang, score)
    logs = [np.array(scorer._logs([w])[w]) for w in ("the", text[:40], "the")]
    total = sum(logs)
    assert other[1] == pytest.approx(float(1 / np.exp(total - total.max()).sum()))


def test_language_sample_takes_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 10)
    rows = [(1, "ab" * 40_000, "x")] + [(i, "cd ef", "y") for i in range(2, 9) if i != 5]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"),
                           P.path("byte_bpe_multi_50k.tiktoken"), 1000, 999)
    assert set(learned) == {"x", "y"} and sum(learned["x"].values()) == pytest.approx(1, abs=0.01)


def test_network_scores_do_not_depend_on_neighbours_or_slabs(monkeypatch):
    r = random.Random(4)
    texts = ["", None, "a", *("".join(r.choice("ab c*#\n") for _ in range(r.randint(1, 3000))) for _ in range(20))]
    draw = np.random.default_rng(0)
    net = cnn.Network(draw.normal(0, 1, (cnn.WIDTH, 256, cnn.FILTERS)).astype(np.float32), np.zeros(cnn.FILTERS, np.float32),
                      draw.normal(0, 1, 2 * cnn.FILTERS + 2).astype(np.float32), 0.1)
    alone = [net.scores([t])[0] for t in texts]
    assert net.scores(texts) == pytest.approx(alone)
    monkeypatch.setattr(cnn, "SLAB", 4 * cnn.CELL)
    assert net.scores(texts) == pytest.approx(alone)


def test_models_without_labels_of_both_kinds():
    assert cnn.train([]) == 0.5 and cnn.train([("x", 1)]) == 1.0
    assert toxicity.train([]).probability(*toxicity.train([]).segments("x y")) < 0.01
    assert toxicity.train([("x", 1)]).probability(1, []) > 0.99
    assert langid.Scorer(P.path("byte_bpe_multi_50k.tiktoken"), [], {}).score(["x"]) == [("und", 0.0)]

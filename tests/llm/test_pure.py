"""Parts of the training-data operators that need no Spark, against brute force and round trips."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import ans, langid, media, packing, pivots, setsketch, warc
from nearfield.llm.tokens import encoder

ODD = ["", "  a  b", "a\n\nb \n c", "it's don't we'll 'tis", "x <|endoftext|> y", "日本 語 a", "tab\tx y", "end ", "\n\n", "a\n \nb", "é ñ 123 4.5,6 %%% $", "“q” a'sb  'll x", "α β γ d", "a\x1cb c", "a\x00b \x01 c\x01", "x" * 3000]


def test_ids_are_the_library_s():
    e = encoder()
    assert e.batch([*ODD, None]) == [*(e.whole(t) for t in ODD), b""]
    text = " ".join(ODD)
    assert e.batch([text]) == [e.whole(text)]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab'st \n.,é1\t<|日"), max_size=30))
def test_ids_of_any_text(text):
    e = encoder()
    assert e.batch([text]) == [e.whole(text)]


def brute_bits(texts, t):
    ctx = [defaultdict(Counter) for _ in range(4)]
    for x in texts:
        y = b"   " + x
        for i in range(3, len(y)):
            for k in range(4):
                ctx[k][y[i - k : i]][y[i]] += 1
    y, total = b"   " + t, 0.0
    for i in range(3, len(y)):
        for k in range(3, -1, -1):
            n = ctx[k].get(y[i - k : i])
            if n:
                s, d = sum(n.values()), len(n)
                if y[i] in n:
                    total -= math.log2(n[y[i]] / (s + d))
                    break
                total -= math.log2(d / (s + d))
        else:
            total += 8
    return total


@pytest.mark.parametrize("cells", [0, 12_000_000])
def test_code_lengths_are_exact(cells):
    """Of the automaton, and of trees that are too large for one and are searched."""
    texts = {"en": [b"the cat sat on the mat", b"a dog and the cat", b""], "de": ["der Hund saß und die Maus lief".encode()], "xx": [b""]}
    m = langid.fit(texts, cells)
    assert (m.cost is None) == (cells == 0)
    probe = [b"the dog sat", "ÿ日本".encode(), b"die", b"x"]
    for chunk in (3, 1 << 20):
        got = langid.code_lengths(m, probe, chunk)
        want = [[brute_bits(texts[g], t) for g in m.langs] for t in probe]
        assert np.allclose(got, want, rtol=1e-5)
    assert langid.predict(m, [None, "", "123 %%", "the cat"])[0] == ["und", "und", "und", "en"]
    assert langid.predict(langid.fit({}), ["the"]) == (["und"], [0.0])


def test_hundred_languages_keep_all_contexts():
    """More costs than an automaton may hold: nothing is left out, and every language is told apart."""
    r = random.Random(5)
    texts, probe = {}, {}
    for i in range(100):
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäöüß", k=r.randrange(2, 9))) for _ in range(60)]
        texts[f"l{i:02}"] = [" ".join(r.choices(words, k=300)).encode()]
        probe[f"l{i:02}"] = " ".join(r.choices(words, k=30))
    m = langid.fit(texts)
    assert m.cost is None
    assert langid.predict(m, list(probe.values()))[0] == list(probe)
    t = next(iter(probe.values())).encode()
    assert np.allclose(langid.code_lengths(m, [t])[0, :2], [brute_bits(texts[g], t) for g in m.langs[:2]])


@pytest.mark.parametrize("n", [1, 5, 128, 129, 131_072, 131_073])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 50_256).astype(np.uint32)
    data = ans.encode_segment(ids, [-(2**63), None, 8], [n - n // 2, 0, n // 2])
    got, docs, none, lengths = ans.decode_segment(data)
    assert (got == ids).all() and docs.tolist() == [-(2**63), 0, 8] and none.tolist() == [False, True, False] and lengths.sum() == n
    broken = bytearray(data)
    broken[-2] ^= 1
    with pytest.raises((ValueError, zlib.error, IndexError)):
        ans.decode_segment(bytes(broken))


def test_frequencies():
    f = ans.normalised(np.array([1] * 50_000 + [10**9]))
    assert f.min() >= 1 and f.sum() == 1 << ans.SCALE


def test_chunks_follow_content():
    r = random.Random(1)
    a = bytes(r.randrange(256) for _ in range(600_000))
    ends = media.cuts(a)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(a) and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST
    b = b"inserted" + a
    shared = {a[s:e] for s, e in zip([0, *ends], ends)} & {b[s:e] for s, e in zip([0, *media.cuts(b)], media.cuts(b))}
    assert sum(map(len, shared)) > 0.5 * len(a)
    assert media.cuts(b"") == [] and media.cuts(b"x") == [1]


@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "é" * 40])
def test_media_round_trip(text):
    n, data = media.payload(text)
    assert n == len((text or "").encode()) and len(data) % 64 == 0 and len(data) >= 64
    assert media.from_media(media.to_media(data)) == data


def test_warc_segments():
    html = "<p>é</p>" * 5000
    for text, segment in ((html, 1000), (html, 10**9), ("", 1000), (None, 1000), ("x" * 9000, 4096)):
        data = b"".join(warc.write_page(3, "http://a b", text, None, segment=segment))
        parsed = list(warc.parse(data))
        segments = [{"number": int(h.get("warc-segment-number", 1)), "block": b, "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else len(b), "origin": "o"} for h, b in parsed]
        random.Random(2).shuffle(segments)
        _, block, copies = warc.reassemble(segments * 2 if len(segments) > 1 else segments)
        assert copies in (1, 2)
        assert warc.payload(block)[0] == (text or "").encode()
    with pytest.raises(ValueError, match="missing"):
        warc.reassemble([s for s in segments if s["number"] != 1])
    assert warc.unframe(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unframe(b"5\r\nabc\r\n0\r\n\r\n")


def brute_shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_shingles_and_estimates():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = ["", " \n", None, "A b", "a B c", *(" ".join(r.choices(words, k=200)) for _ in range(6)), "x y z"]
    for k in (3, 5):
        for t in texts:
            assert len(setsketch.shingles(t, k)) == len(brute_shingles(t, k))
    assert (setsketch.shingles("Ab C", 3) == setsketch.shingles("ab  c", 3)).all()
    base = " ".join(r.choices(words, k=600)).split()
    errors = []
    for cut in range(5, 60, 5):
        other = base[:]
        for i in r.sample(range(600), cut):
            other[i] = f"n{i}"
        a, b = setsketch.shingles(" ".join(base), 3), setsketch.shingles(" ".join(other), 3)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        g = setsketch.registers([a, b, np.union1d(a, b)])
        assert (setsketch.merged(g[0], g[1]) == g[2]).all()
        errors.append(setsketch.estimate(g[:1], np.array([len(a)]), g[1:2], np.array([len(b)]))[0] - true)
    assert np.abs(errors).max() < setsketch.MARGIN


def test_links_against_brute_force():
    """Link counts by weight and spanning links, inside a block and between two."""
    r = np.random.default_rng(4)
    base = pivots.units(r.normal(size=(6, 16)))
    x = pivots.units(np.repeat(base, 5, 0) + 0.05 * r.normal(size=(30, 16)))
    w = r.integers(1, 4, 30).astype(float)
    ok = x @ x.T >= 0.93
    np.fill_diagonal(ok, False)
    counts, edges = defaultdict(int), set()
    rows = r.permutation(30)
    a, b = rows[:17], rows[17:]
    for c, e in (pivots.links(ok[np.ix_(a, a)], a, w[a], None, w[a]), pivots.links(ok[np.ix_(b, b)], b, w[b], None, w[b]), pivots.links(ok[np.ix_(a, b)], a, w[a], b, w[b])):
        edges |= e
        for i, n in c.items():
            counts[i] += n
    assert {i: counts[i] for i in range(30)} == {i: int(ok[i] @ w) for i in range(30)}
    assert all(ok[p, q] for p, q in edges) and len(edges) < ok.sum() / 2
    group = {i: i for i in range(30)}
    for _ in range(30):
        for p, q in edges:
            group[p] = group[q] = min(group[p], group[q])
    assert all(group[p] == group[q] for p, q in zip(*np.nonzero(ok), strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(0, 5))
def test_evolved_bins_hold_everything(sizes, seed):
    rng = random.Random(seed)
    bins = packing.evolve(sizes, 100, [], rng)
    assert sorted(x for b in bins for x in b) == list(range(len(sizes)))
    assert all(sum(sizes[x] for x in b) <= 100 for b in bins)
    plain = packing.best_fit(list(range(len(sizes))), sizes, [], 100)
    assert len(bins) <= len(plain)
    child = packing.crossover(bins, plain, sizes, 100, rng)
    assert sorted(x for b in child for x in b) == list(range(len(sizes)))


def test_the_genetic_algorithm_beats_best_fit():
    """Bins of exactly three: best fit needs more than the bound, crossover and mutation find bins that it doesn't."""
    rng, won, ran = random.Random(3), 0, 0
    for _ in range(4):
        sizes = []
        for _ in range(25):
            a, b = rng.randrange(26, 45), rng.randrange(26, 45)
            sizes += [a, b, 100 - a - b]
        plain = packing.best_fit(list(range(75)), sizes, [], 100)
        calls = []
        whole = packing.crossover
        packing.crossover = lambda *x: calls.append(1) or whole(*x)  # noqa: B023
        try:
            bins = packing.evolve(sizes, 100, [], rng, generations=60, population=8)
        finally:
            packing.crossover = whole
        assert sorted(x for b in bins for x in b) == list(range(75)) and all(sum(sizes[x] for x in b) <= 100 for b in bins)
        assert 25 <= len(bins) <= len(plain)
        won += len(bins) < len(plain)
        ran += len(calls) > 10
    assert won >= 2 and ran >= 2

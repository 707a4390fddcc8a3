"""Codings and rotation against known values and properties."""

import numpy as np
import pytest

from nearfield.functions.coding import NAMES, coding, turbo_pack, turbo_unpack
from nearfield.functions.rotation import Rotation, blocks
from nearfield.functions.similarity import block, parse

#: A vector and a center that the headers below belong to.
V = np.array([[-0.921, -0.061, 0.659, 0.67, 0.573, 0.431, 0.646, 0.001, -0.2, -0.428, 0.73, -0.704, -0.273, 0.539, -0.731, 0.436, 0.913, 0.694, 0.202]], np.float32)
CENTER = np.array([-0.98, -0.028, 0.456, 0.587, 0.975, 0.837, 0.325, 0.636, -0.448, -0.046, 0.693, -0.64, -0.5, -0.036, -0.036, 0.376, 0.629, 0.221, 0.57])
#: Norm, error, lower, upper, sum of codes.
HEADERS = [
    ("tlvq1", False, 2.5226507, 1.163828, -0.49560547, 0.7055664, 11),
    ("tlvq1", True, 1.5514041, 0.8179195, -0.60498047, 0.23901367, 13),
    ("tlvq2", False, 2.5226507, 0.6713635, -0.67089844, 0.8408203, 32),
    ("tlvq8x8", False, 2.5226507, 0.0076497365, -0.9199219, 0.9116211, 2875),
    ("tlvq8x8", True, 1.5514041, 0.0055349832, -0.6953125, 0.57470703, 2569),
]
@pytest.mark.parametrize(("name", "centered", "norm", "error", "low", "high", "total"), HEADERS)
def test_header(name, centered, norm, error, low, high, total):
    c = coding(name, 19, "l2", CENTER if centered else None)
    h = c.header(c.encode(V))[0]
    assert abs(h["norm"] - norm) < 1e-5
    assert abs(h["error"] - error) < 1e-5
    assert (h["low"], h["high"], h["sum"]) == (np.float16(low), np.float16(high), total)


BITS = {"f32": 24, "f16": 11, "tlvq1": 1, "tlvq2": 2, "tlvq4": 4, "tlvq8": 8, "tlvq1x8": 9, "tlvq2x8": 10, "tlvq4x8": 12, "tlvq8x8": 16}


@pytest.mark.parametrize("name", sorted(BITS))
@pytest.mark.parametrize("similarity", ["l2", "dot", "cos"])
def test_distances(name, similarity):
    """A distance is off by no more than its codes are: |a.b - a'.b'| <= |a||b - b'| + |b||a - a'| + |a - a'||b - b'|."""
    r = np.random.default_rng(3)
    norm = lambda x: np.linalg.norm(x, axis=1)
    for dims in (128, 135, 256):
        a, b = (r.uniform(-1, 1, (100, dims)).astype(np.float32) for _ in range(2))
        if similarity == "dot":
            a, b = (x / norm(x)[:, None] for x in (a, b))
        c = coding(name, dims, similarity)
        true = np.diag(block(a.astype(float), b.astype(float), similarity))
        if similarity == "cos":
            a, b = (x / norm(x)[:, None] for x in (a, b))
        ea, eb = (norm(x - c.decode(c.encode(x))) for x in (a, b))
        off = norm(a) * eb + norm(b) * ea + ea * eb
        off = (2 * off if similarity == "l2" else off / 2) + 1e-5 * (norm(a) + norm(b)) ** 2
        for got in (c.symmetric(c.encode(a), c.encode(b)), c.query(a, c.encode(b))):
            assert (np.abs(np.diag(got) - true) <= off).all()


@pytest.mark.parametrize("name", sorted(set(BITS) - {"tlvq1", "f32"}))
def test_codes_are_within_their_step(name):
    """Mean error of a component at most half a step, of the values' range at the coding's bits (double for the interval)."""
    x = np.random.default_rng(4).uniform(-1, 1, (50, 256)).astype(np.float32)
    c = coding(name, 256)
    assert np.abs(x - c.decode(c.encode(x))).mean() <= 2 / (2 ** BITS[name] - 1)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("dims", [1, 7, 19, 64, 135])
def test_lengths_and_round_trip(name, dims):
    x = np.random.default_rng(dims).uniform(-1, 1, (5, dims)).astype(np.float32)
    c = coding(name, dims)
    e = c.encode(x)
    assert e.shape == (5, c.byte_len())
    d = c.decode(e)
    assert d.shape == x.shape
    assert np.isfinite(d).all()
    if name in ("binary", "QuIVer"):
        assert (np.sign(d) == np.sign(x)).all()


@pytest.mark.parametrize("bits", ["1", "2", "4", "8", "1x8", "2x8", "4x8", "8x8"])
@pytest.mark.parametrize("value", [0.0, 1.0])
def test_constant_vectors_decode_exactly(bits, value):
    x = np.full((1, 256), value, np.float32)
    c = coding(f"tlvq{bits}", 256)
    assert (c.decode(c.encode(x)) == x).all()


def test_bound_never_loses_a_near_vector():
    r = np.random.default_rng(5)
    q, x = r.normal(size=(5, 64)), r.normal(size=(300, 64))
    c = coding("tlvq1", 64)
    e = c.encode(x)
    full = c.query(q, e)
    most = np.sort(full, 1)[:, 9]
    got, looked = c.bounded(q, e, most)
    assert (np.sort(got, 1)[:, :10] == np.sort(full, 1)[:, :10]).mean() > 0.95
    assert looked.mean() <= 1


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
@pytest.mark.parametrize("dims", [1, 16, 19, 130, 135])
def test_packing(bits, dims):
    x = np.random.default_rng(0).integers(0, 1 << bits, (3, dims))
    p = turbo_pack(x, bits)
    assert p.shape[1] == -(-dims * bits // 8)
    assert (turbo_unpack(p, dims, bits) == x).all()


@pytest.mark.parametrize("dims", [100, 128, 192, 256])
def test_rotation(dims):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(2, 4, dims)).astype(np.float32)
    t = Rotation(dims, 7)
    assert np.abs(t.backward(t.forward(x)) - x).max() < 1e-5
    assert np.abs(np.linalg.norm(t.forward(x), axis=1) - np.linalg.norm(x, axis=1)).max() < 1e-4
    assert np.abs((t.forward(x) * t.forward(y)).sum(1) - (x * y).sum(1)).max() < 1e-4
    assert (Rotation(dims, 7).forward(x) == t.forward(x)).all()
    assert (Rotation(dims, 8).forward(x) != t.forward(x)).any()
    assert sum(blocks(dims)) == dims


def test_names():
    assert [parse(x) for x in ("euclidean", "l2", "cosine", "cos", "dot")] == ["l2", "l2", "cos", "cos", "dot"]
    with pytest.raises(ValueError, match="similarity"):
        parse("hamming")
    assert coding("raw", 4).name == coding("raw-l2-norm", 4).name == "f32"
    with pytest.raises(ValueError, match="coding"):
        coding("quiver", 4)

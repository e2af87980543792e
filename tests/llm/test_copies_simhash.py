"""The near-copy stage takes its candidates from SimHash fingerprints."""

import random

import numpy as np
import xxhash

from quillon.llm import copies


def bits_of(text):
    return np.unpackbits(np.ascontiguousarray(copies.sketch(text)["bits"]).view(np.uint8))


def test_first_lane_is_the_simhash_of_the_different_shingles():
    text = b"a b c d e f g h a b c d e f g"
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in set(copies.shingles(text))]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    packed = np.packbits(np.unpackbits(np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) * 2 > len(hashes))
    assert copies.sketch(text)["bits"][0] == packed.view(np.int64)[0] == np.array([want], dtype=np.uint64).view(np.int64)[0]


def test_bands_and_lanes_reach_pairs_at_the_index():
    rng = random.Random(11)
    choice, missed, n = copies.bands(1 << 20), 0, 0
    while n < 150:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((60, 200)))]
        other = list(words)
        for _ in range(rng.randrange(1, 2 + len(words) // 40)):
            other[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        a, b = " ".join(words).encode(), " ".join(other).encode()
        if not copies.alike(a, b) or copies.alike(a, b, (85, 100)):
            continue
        n += 1
        differ = bits_of(a) != bits_of(b)
        reached = (~differ[choice]).all(axis=1).any() and differ[: 64 * copies.LANES_SENT].sum() <= copies.DIFFER_SENT and differ.sum() <= copies.DIFFER
        missed += not reached
    assert missed <= 1


def test_near_pairs_against_all_pairs():
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(0, 12, 200))
    component = rng.integers(0, 40, 200)
    lanes = rng.integers(-(1 << 63), 1 << 63, (2, 200))
    lanes[:, 1::3] = lanes[:, 0:-1:3][:, : len(lanes[0, 1::3])] ^ 0b1011
    found = {(int(x), int(y)) for i, j in copies.near_pairs(at, component, lanes.view(np.uint64)) for x, y in zip(i, j, strict=True)}

    def near(i, j):
        return sum(bin((int(lanes[k, i]) ^ int(lanes[k, j])) & (1 << 64) - 1).count("1") for k in range(2)) <= copies.DIFFER_SENT

    assert found == {(i, j) for i in range(200) for j in range(i + 1, 200) if at[i] == at[j] and component[i] != component[j] and near(i, j)}
    assert found


def test_bands_grow_with_the_classes():
    assert copies.bands(1000).shape == copies.bands(1 << 22).shape == (128, 16)
    assert copies.bands(1 << 24).shape[1] == 18

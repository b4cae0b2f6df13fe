"""What the pipeline's near-duplicate stage keeps in large components and crowded groups."""

import random

import numpy as np

from tablestore.llm import copies
from tablestore.llm.neardup import join_labels


def chains(roots, texts):
    """(root, id, digest, shingles): sets that change from one to the next, and new ones."""
    draw, rows = random.Random(2), []
    for root in range(roots):
        for i in range(texts):
            if i % 3 == 0:
                now = draw.sample(range(1000), 30)
            else:
                now = list(now)
                now[draw.randrange(30)] = draw.randrange(1000)
            rows.append((root, None if i == 7 else draw.randrange(10**6), f"d{root}_{i}", sorted(set(now))))
    return rows


def greedy(rows):
    kept = []
    for root, _, digest, shingles in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        mine = set(shingles)
        if all(root != r or len(mine & x) < 0.8 * len(mine | x) for r, _, x in kept):
            kept.append((root, digest, mine))
    return sorted(d for _, d, _ in kept)


def test_rounds_do_not_follow_the_texts_of_a_root(spark, monkeypatch):
    """Each round adds plans and jobs to the driver: 75 rounds of four texts took some 500 checkpoints."""
    monkeypatch.setattr(copies, "ROUND_TEXTS", 4)
    monkeypatch.setattr(copies, "CHUNK_TEXTS", 60)
    checkpoint, made = copies.checkpoint, []
    monkeypatch.setattr(copies, "checkpoint", lambda *a: made.append(a) or checkpoint(*a))
    rows = chains(2, 300)
    got = copies.representatives(spark.createDataFrame(rows, "root long, id long, digest string, shingles array<long>"), 0.8)
    assert sorted(r.digest for r in got.collect()) == greedy(rows)
    assert len(made) < 60


def test_a_crowded_group_loses_no_link(spark, monkeypatch):
    """Members whose one partner is near a pivot, or far from all of them, as found by comparing all pairs that share a group."""
    for name, value in (("HOT_GROUP", 20), ("PIVOTS", 3)):
        monkeypatch.setattr(copies, name, value)
    draw = np.random.default_rng(3)
    masks = copies.selections(copies.KEY_BITS, 21, 1)
    agreed = {64 * w + b for w in range(copies.WORDS) for b in range(64) if masks[0][w] >> b & 1}
    free = np.array(sorted(set(range(256)) - agreed))

    def edit(bits, n):
        out = bits.copy()
        out[draw.choice(free, n, replace=False)] ^= True
        return out

    centre = draw.random(256) < 0.5
    near = [edit(centre, n) for n in draw.integers(5, 30, 60)]
    apart = [edit(x, 38) for x in near[:40]]
    apart += [edit(x, 39) for x in apart[:20]]
    # and texts that have nothing to do with each other
    other = [edit(centre, 120) for _ in range(80)]
    bits = np.array([*near, *apart, *other, *(edit(x, 35) for x in other[:40])])
    fps = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    shares = np.zeros((len(bits), len(bits)), bool)
    for mask in masks:
        own = fps & np.array(mask, np.uint64)
        shares |= (own[:, None] == own[None]).all(2)
    want = shares & (np.bitwise_count(fps[:, None] ^ fps[None]).sum(2, dtype=int) <= copies.BUDGET)
    labels = np.arange(len(bits))
    join_labels(labels, *np.nonzero(want))
    rows = [(i, *row) for i, row in enumerate(fps.view(np.int64).tolist())]
    for levels in (0, 1, 3):
        monkeypatch.setattr(copies, "LEVELS", levels)
        found = copies.links(spark.createDataFrame(rows, ", ".join(["node long", *(f"{c} long" for c in copies.COLUMNS)])))
        found = np.array([(r.u, r.v) for r in found.collect()])
        got = np.arange(len(bits))
        join_labels(got, *found.T)
        assert got.tolist() == labels.tolist()

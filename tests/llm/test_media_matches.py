"""Copies of pictures that have much in common, against all pairs of pictures."""

import numpy as np
import pytest

from gridpanel.llm import media


def glyphs(count=12, side=30):
    """Flat signs on a light ground."""
    rng, out = np.random.default_rng(77), []
    for _ in range(count):
        g = np.full((side, side), 230.0)
        for _ in range(6):
            x, y, w, h = rng.integers(2, side - 10), rng.integers(2, side - 10), rng.integers(4, 9), rng.integers(4, 9)
            g[y : y + h, x : x + w] = rng.integers(0, 160)
        out.append(g)
    return out


def ordered(signs, seed):
    """All signs, in another order for each seed."""
    o = np.random.default_rng(seed).permutation(len(signs))
    return np.vstack([np.hstack([signs[o[3 * i + j]] for j in range(3)]) for i in range(4)])


def scattered(signs, seed):
    rng, out = np.random.default_rng(seed), np.full((120, 120), 230.0)
    for _ in range(12):
        y, x = rng.integers(0, 91, 2)
        out[y : y + 30, x : x + 30] = signs[rng.integers(len(signs))]
    return out


def classes(spark, pictures):
    df = spark.createDataFrame([(i, media.encode(p)) for i, p in pictures], "image_id long, image binary").repartition(8)
    return {r["image_id"]: r["class_id"] for r in media.copies(df).collect()}


@pytest.mark.parametrize("laid", [ordered, scattered])
def test_crops_of_pictures_of_the_same_signs(spark, laid):
    """120 pictures of twelve signs and a crop of each: every crop is found, and no two pictures are linked."""
    signs = glyphs()
    pictures = [(i, laid(signs, i)) for i in range(120)]
    by = classes(spark, pictures + [(1000 + i, p[12:, :-9]) for i, p in pictures])
    assert sum(by[1000 + i] == by[i] for i in range(120)) >= 0.9 * 120
    assert all(by[i] == i for i in range(120))


def test_a_logo_links_nothing(spark):
    """150 pictures with one logo and a caption, and edits of some: links are those of all pairs that are compared."""
    rng, logo = np.random.default_rng(4), glyphs(1, 24)[0]
    pictures = []
    for i in range(150):
        p = media.resized(rng.uniform(0, 255, (16, 16)), 96, 96)
        p[-24:, -24:] = logo
        pictures.append((i, p))
    edits = [(1000 + i, p[10:, :] if i % 2 else np.rot90(p)) for i, p in pictures[:40]]
    by = classes(spark, pictures + edits)
    assert [i for i, _ in edits if by[i] != i - 1000] == [] and all(by[i] == i for i in range(150))


def test_found_links_are_those_of_all_pairs(spark):
    """Recall against every pair of pictures, compared one by one, over edits that leave less and less."""
    rng = np.random.default_rng(6)
    edits = [lambda g: g + rng.normal(0, 5, g.shape), lambda g: 255 * (np.clip(g, 0, 255) / 255) ** 1.4, lambda g: media._blurred(g, 0.7), lambda g: media.resized(g, 72, 72), lambda g: g[:66, :66], lambda g: g * 0.7 + 40]
    pictures = [(i, media.resized(rng.uniform(0, 255, (14, 14)), 96, 96)) for i in range(60)]
    pictures += [(100 + i, edits[i % len(edits)](p)) for i, p in pictures]
    blobs = [(i, media._blob(*media.described(media.decode(media.encode(p))))) for i, p in pictures]
    want = {(i, j) for i, a in blobs for j, b in blobs if i < j and media.linked(a, b)}
    by = classes(spark, pictures)
    found = sum(by[i] == by[j] for i, j in want)
    assert len(want) >= 45 and found >= 0.95 * len(want)
    assert all(c == i % 100 for i, c in by.items() if c != i)


def test_a_group_of_copies_is_found_without_its_pairs(spark, monkeypatch):
    """300 tones of one picture: the first round finds them, so that few pairs are compared."""
    base = media.resized(np.random.default_rng(8).uniform(0, 255, (12, 12)), 64, 64)
    pictures = [(i, np.clip(base * (0.6 + i * 0.001) + i % 50, 0, 255)) for i in range(300)]
    compared, verified = [], media._verified
    monkeypatch.setattr(media, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    assert set(classes(spark, pictures).values()) == {0} and sum(compared) < 10 * 300


def test_parts_change_nothing(spark):
    signs = glyphs(3)
    pictures = [(i, scattered(signs, i)) for i in range(12)]
    df = spark.createDataFrame([(i, media.encode(q)) for i, p in pictures for i, q in ((i, p), (100 + i, p[8:, :]))], "image_id long, image binary")
    corners = media._corners(df.selectExpr("image_id as node", "image"), "image")
    edges = [sorted(tuple(r) for r in media.links(corners, part=part).collect()) for part in (2, 2048)]
    assert edges[0] == edges[1] and len(edges[0]) >= 12


def test_matches_and_geometry():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    b = a.copy()
    b[:, 0] ^= np.uint64(0b1011)
    i, j = media.matches(a, b, step=7)
    assert set(zip(range(40), range(40))) <= set(zip(i.tolist(), j.tolist()))
    points = np.column_stack([rng.uniform(0, 200, (40, 2)), rng.uniform(0, 6, 40), np.ones(40)])
    turned = points.copy()
    turned[:, 0], turned[:, 1], turned[:, 2] = 300 - points[:, 1], points[:, 0] + 20, (points[:, 2] + np.pi / 2) % (2 * np.pi)
    assert media.agreeing(points, turned) >= 36
    assert media.agreeing(points, turned[rng.permutation(40)]) < 12 and media.agreeing(points[:0], points[:0]) == 0
    assert not media.linked(b"", b"")


def _node(node, keys, seed):
    """A row of CORNERS: 40 corners that are alike for one seed."""
    rng = np.random.default_rng(seed)
    points = np.column_stack([rng.uniform(0, 400, (40, 2)), rng.uniform(0, 6, 40), np.ones(40)])
    return node, True, 40, keys, media._blob(points, rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64))


@pytest.mark.parametrize("part", [7, 2048])
def test_copies_that_share_only_frequent_keys(spark, part):
    """Two copies have three keys in common, a small part of their keys, and 80 other pictures have these too."""
    own = lambda i: [1000 * (i + 1) + k for k in range(30)]
    rows = [_node(i, [1, 2, 3, *own(i)], i) for i in range(80)] + [_node(i, [1, 2, 3, *own(i)], 500) for i in (90, 91)]
    rows += [_node(i, [1, *own(i)], 600) for i in (92, 93)]  # one key in common is too few
    corners = spark.createDataFrame(rows, media.CORNERS).repartition(4)
    assert [tuple(r) for r in media.links(corners, part=part).collect()] == [(90, 91)]


def test_keys_of_the_same_pictures_meet_once(spark):
    """Ten keys of the same pictures are one of weight ten; those of connected pictures and of other ones are not."""
    rows = [(k, i, i % 3) for k in range(10) for i in range(9)] + [(20, i, i % 3) for i in range(8)] + [(30, i, 0) for i in (0, 3, 6)]
    got = media._sets(spark.createDataFrame(rows, "key long, node long, root long"))
    assert sorted(map(tuple, got.collect())) == [(0, 9, 10), (20, 8, 1)]

"""Scores and fuzzy labels against plain versions that share nothing but parameters with the operators."""

import math
import random

import numpy as np
import pytest

from pagemill.llm import license_scan, quality, toxicity
from tests.llm.test_corpus_operators import alnum, awkward, prose

pytestmark = pytest.mark.usefixtures("spark")


def least_edits(notice, text):
    """The fewest edits that turn the notice into some part of the text, by dynamic programming over all its places."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_fuzzy_labels_against_all_places(spark):
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(160):
        notice = rng.choice(list(license_scan.NOTICES))
        t = list(notice)
        for _ in range(rng.randrange(0, license_scan.allowed(notice) + 3)):
            j = rng.randrange(len(t))
            way = rng.randrange(3)
            if way == 0:
                t[j] = rng.choice(letters)
            elif way == 1:
                t.insert(j, rng.choice(letters))
            elif len(t) > 3:
                del t[j]
        rows.append((i, f"{prose(rng, rng.randrange(0, 8))} {''.join(t)} {prose(rng, rng.randrange(0, 8))}"))
    rows += [(1000 + i, prose(rng, 40)) for i in range(10)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = 0
    for i, text in rows:
        flat = "".join(f"{w} " for w in alnum(text))  # each word ends with a blank
        near = sorted((k, -len(n), label) for n, label in license_scan.NOTICES.items() if (k := least_edits(n, flat)) <= license_scan.allowed(n))
        labels = {x for x in got[i].labels.split(",") if x} - {x for x in got[i].base_labels.split(",") if x}
        # one notice was put in: of those near enough, which overlap, the one with the fewest edits stands
        base = {x for x in got[i].base_labels.split(",") if x}
        assert labels | base == ({near[0][2]} if near else set()) | base, (text, near, got[i])
        assert not near or got[i].n_base or min(s.edits for s in got[i].spans) == near[0][0]
        found += bool(near)
    assert 60 < found < 160


def plain_features(text):
    w = [x.encode() for x in alnum(text)]
    out = {("word", x) for x in w} | {("stem", x[: toxicity.STEM]) for x in w}
    return out | {("pair", a, b) for a, b in zip(w, w[1:])} | {("skip", a, b) for a, b in zip(w, w[2:])} | {"bias"}


def plain_ftrl(rows, weight, rounds=6):
    """FTRL-proximal with a dictionary for each sum."""
    p = toxicity.Ftrl()
    z, n = {}, {}

    def w(f):
        l1 = 0.0 if f == "bias" else p.l1
        s = z.get(f, 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((p.beta + math.sqrt(n.get(f, 0.0))) / p.alpha + p.l2)

    for _ in range(rounds):
        for _, features, y in rows:
            now = {f: w(f) for f in features}
            g = weight[y] * (1 / (1 + math.exp(-sum(now.values()))) - y)
            for f, v in now.items():
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / p.alpha * v
                n[f] = before + g * g
    return w


def test_toxicity_against_a_plain_learner(spark):
    rng = random.Random(41)
    vocabulary = ["alpha", "alps", "beta", "gamma", "delta", "delft", "eta", "Theta", "iota"]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 + 3 * (i % 2), *[1] * 8], k=rng.randrange(0, 30)))) for i in range(120)] + [(500, None), (501, "unseen words alone"), (3, "")]
    labels = [(i, i % 2) for i in range(80)]
    got = [(r.doc_id, r.score) for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()]
    # of doc_id 3, which has two texts, the learner takes one: try both
    tried = []
    for three in (dict(rows[:120])[3], ""):
        texts = dict(rows[:120]) | {3: three}
        train = sorted(((toxicity._order(i), plain_features(texts[i]), y) for i, y in labels), key=lambda r: r[0])
        w = plain_ftrl(train, {0: 1.0, 1: 1.0})
        tried.append(sorted((i, 1 / (1 + math.exp(-sum(map(w, plain_features(t or "")))))) for i, t in rows))
    assert any(all(i == j and abs(a - b) < 1e-9 for (i, a), (j, b) in zip(sorted(got), want, strict=True)) for want in tried)
    assert np.std([s for _, s in got]) > 0.1


def plain_curve(x, y, weight):
    """Weighted logistic regression by gradient steps of halved length until none helps, on scaled measures."""
    scale = np.array([*np.maximum(x[:, :-1].std(0), 1e-6), 1.0])
    x, w, step = x / scale, np.zeros(x.shape[1]), 1.0

    def loss(v):
        s = x @ v
        return float((weight * (np.logaddexp(0, s) - y * s)).sum() + 0.5e-2 * v @ v)

    for _ in range(200_000):
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - y)) + 1e-2 * w
        while step > 1e-12 and loss(w - step * g) > loss(w) - 0.5 * step * g @ g:
            step /= 2
        if step <= 1e-12 or np.abs(g).max() < 1e-7:
            break
        w = w - step * g
        step *= 1.5
    return w / scale


def test_quality_against_a_plain_version(spark):
    import zstandard as z

    rng = random.Random(51)
    good = lambda n: " ".join(rng.choice(["the", "river", "stone", "carries", "water", "under", "bridge"]) + rng.choice(["", ",", "."]) for _ in range(n))
    bad = lambda n: " ".join(rng.choice(["BUY", "now!!", "click", "$$$", "free", "win"]) for _ in range(n))
    mixed = lambda i, n: good(n) + " " + bad(rng.randrange(n)) if i % 2 else bad(n) + " " + good(rng.randrange(n))
    rows = [(i, mixed(i, rng.randrange(5, 300))) for i in range(200)] + [(900, None), (901, ""), (902, "é" * 9000)]
    labels = [(i, i % 2) for i in range(150)]
    got = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    texts = {i: (t or "").encode() for i, t in rows}
    order = {y: sorted((i for i, v in labels if v == y), key=toxicity._order) for y in (0, 1)}
    blocks = lambda t: [t[i : i + quality.BLOCK] for i in range(0, len(t), quality.BLOCK)]
    dictionaries = []
    for y in (1, 0):
        mine = [b for i in order[y][::2] for b in blocks(texts[i])]
        dictionaries.append(quality._dictionary(mine))

    def measures(t):
        if not t:
            return [0.0, 1.0, 1.0]
        sizes = []
        for d in dictionaries:
            known = z.ZstdCompressionDict(d)
            known.precompute_compress(level=quality.LEVEL)
            c = z.ZstdCompressor(dict_data=known, compression_params=z.ZstdCompressionParameters.from_level(quality.LEVEL, source_size=quality.BLOCK, write_checksum=False, write_content_size=False, write_dict_id=False))
            sizes.append(sum(len(c.compress(b)) for b in blocks(t)))
        return [(sizes[1] - sizes[0]) / sum(sizes), min(sizes) / len(t), 1.0]

    held = [i for y in (0, 1) for i in order[y][1::2]]
    y = np.array([i % 2 for i in held], float)
    share = np.array([len(order[i % 2]) / 2 / len(order[i % 2][1::2]) for i in held])
    curve = plain_curve(np.array([measures(texts[i]) for i in held]), y, share)
    for i, t in texts.items():
        s = float(np.clip(np.array(measures(t)) @ curve, -35, 35))
        assert abs(got[i] - 1 / (1 + math.exp(-s))) < 2e-3, i
    assert np.std(list(got.values())) > 0.1


def test_base_fields_of_awkward_rows(spark):
    rows = [(i, r[1]) for i, r in enumerate(awkward())]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i].n_words == len(alnum(t)) and (got[i].n_base, got[i].first_word, got[i].base_labels) == (0, None, "")

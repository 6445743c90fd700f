"""Near-copy removal against a comparison of all pairs."""

import random

import pytest

from tidelog.llm import simhash

from . import plain
from .test_corpus import roots


def sets(rows, size=5):
    out = []
    for _, t in rows:
        w = plain.words(t) or (t or "").split()
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    return out


def brute_force(rows):
    """The smallest doc_id of each component of pairs with a resemblance of 0.8 or more."""
    s = sets(rows)
    near = [(a, b) for a in range(len(s)) for b in range(a) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    least = {}
    for (i, _), r in zip(rows, roots(len(rows), near), strict=True):
        least[r] = min(i, least.get(r, i))
    return sorted(least.values())


def kept(spark, rows):
    return sorted(r["doc_id"] for r in simhash.deduplicated(plain.frame(spark, rows)).collect())


def edited(rng, text, edits, words):
    w = text.split()
    for k, at in enumerate(rng.sample(range(len(w)), edits)):
        w[at] = words(k)
    return " ".join(w)


def small_vocabulary(n, length):
    """Long texts that all hold the same 40 words, with copies of each in its words, edited lightly and heavily."""
    rng, rows = random.Random(5), []
    words = [f"v{i}" for i in range(40)]
    for g in range(n):
        base = " ".join(rng.choice(words) for _ in range(length))
        for k in range(5):
            rows.append((1000 * (5 - k) + g, edited(rng, base, rng.randrange(length // 35), lambda _: rng.choice(words))))
    return rows


@pytest.mark.parametrize("frequent", [500_000, 0])
def test_small_vocabulary(spark, monkeypatch, frequent):
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    rows = small_vocabulary(15, 1500)
    want = brute_force(rows)
    assert 15 <= len(want) < 40
    assert kept(spark, rows) == want


def test_common_passages_and_chains(spark, monkeypatch):
    """A passage that all texts share joins none; a chain of copies is one group though its ends are far apart."""
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    rng = random.Random(6)
    passage = plain.sentence(rng, 60)
    rows = [(i, passage + " " + plain.sentence(rng, rng.randrange(5, 60))) for i in range(1, 60)]
    link = plain.sentence(rng, 120)
    for k in range(12):
        link = edited(rng, link, 2, lambda j: f"link{k}x{j}")
        rows.append((200 - k, link))
    assert kept(spark, rows) == brute_force(rows)


def planted(n, length):
    """Pairs of a text and a copy with scattered words replaced by new ones, at a resemblance of 0.8 or just above."""
    rng, rows = random.Random(8), []
    words = [f"p{i}" for i in range(2000)]
    for g in range(n):
        base = " ".join(rng.choice(words) for _ in range(length))
        rows += [(2 * g + 1, base), (2 * g + 2, edited(rng, base, (length - 4) // 45, lambda k, g=g: f"new{g}x{k}"))]
    return rows


def test_planted_new_words(spark):
    rows = planted(75, 300) + [(i + 1000, t) for i, t in planted(75, 600)]
    assert kept(spark, rows) == brute_force(rows)


def join_rows(spark, since):
    """The rows of the largest join among the queries after `since`, and the last query's number."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found, runs, last = 0, store.executionsList(), since
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        last = max(last, run)
        if run > since:
            values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if "Join" in node.name():
                    ids = [m.accumulatorId() for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "number of output rows"]
                    found = max([found, *(int(values.apply(k).replace(",", "")) for k in ids if values.contains(k))])
    return found, last


def test_group_around_the_similarity(spark, monkeypatch):
    """Copies of one text, most of them a little too far from each other: few of their pairs come out of any join."""
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    rng = random.Random(9)
    words = [f"q{i}" for i in range(2000)]
    base = " ".join(rng.choice(words) for _ in range(150))
    rows = [(i + 1, edited(rng, base, 2 + i % 8, lambda k, i=i: f"own{i}x{k}")) for i in range(400)]
    _, last = join_rows(spark, -1)
    got = kept(spark, rows)
    most, _ = join_rows(spark, last)
    assert got == brute_force(rows)
    assert 100 < len(got) < 400 and most < 20_000  # of 79,800 pairs


def test_parities(spark):
    """Two sets differ in as many shingles at least as in parities."""
    rng = random.Random(10)
    for _ in range(200):
        a, b = ({rng.getrandbits(64) for _ in range(rng.randrange(1, 400))} for _ in range(2))
        b |= set(rng.sample(sorted(a), len(a) * rng.randrange(5) // 4))
        x, y = (simhash._parities(simhash.np.array(sorted(s), simhash.np.uint64)) for s in (a, b))
        assert len(x) == simhash.PARITIES // 64 and simhash.np.bitwise_count((x ^ y).view(simhash.np.uint64)).sum() <= len(a ^ b)


def test_repeated_and_missing_ids(spark):
    """A doc_id with two texts loses only the one that is a copy; rows without an id go as copies, too."""
    rng = random.Random(7)
    a, b, c, d = (plain.sentence(rng, 80) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, a + " end"), (None, c), (None, c), (6, d), (6, d + " end")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.deduplicated(plain.frame(spark, rows)).collect())
    assert got[:3] == sorted([(0, c), (1, a), (5, b)])
    assert len(got) == 4 and got[3] in ((6, d), (6, d + " end"))

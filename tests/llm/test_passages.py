"""Passages of 50 words and more that are shorter than the strings that op6 removes."""

import random

import pytest
from tallyhouse.llm import suffix


@pytest.mark.parametrize("together", [4000, 3])
def test_passages_shorter_than_removed_strings_are_counted(spark, monkeypatch, together):
    monkeypatch.setattr(suffix, "TOGETHER", together)
    rng = random.Random(23)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 5))) for _ in range(n))
    short, few, long = words(60), words(46), words(150)
    assert 200 < len(few) < len(short) < 400 < len(long)
    texts = [f"{words(80)} {p} {words(80)}" for p in (short, short, few, few, long, long, "", "", *[short] * 8)]
    texts += [f"{short} {words(30)} {few} {words(30)} {long}", long, long, None, "", words(500), "ab " * 300]
    data = [(t or "").encode() for t in texts]
    times = {}
    for d in data:
        for i in range(len(d) - 199):
            times[d[i : i + 200]] = times.get(d[i : i + 200], 0) + 1
    want = {}
    for n, d in enumerate(data):
        spans = suffix.merged((i, i + 200) for i in range(len(d) - 199) if times[d[i : i + 200]] > 1)
        found = [k for s, e in spans if (k := len(d[s:e].split())) >= 50]
        want[n] = (len(found), sum(found))
    assert want[0][0] == 1 and want[2][0] == want[6][0] == 0  # two shared passages, one of few words, none
    got = {r["doc_id"]: r for r in suffix.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {n: (r["n_passages"], r["passage_words"]) for n, r in got.items()} == want
    assert [got[n]["n_removed"] for n in (0, 1, 2, 3, 6, 7)] == [0] * 6 and got[4]["n_removed"] >= len(long)


def test_shared_parts_lose_no_repeated_string():
    rng = random.Random(3)
    for _ in range(500):
        width, letters = rng.randint(1, 12), rng.choice([b"a", b"ab", b"abc"])
        side = lambda: bytes(rng.choice(letters) for _ in range(rng.randint(0, width - 1)))  # noqa: E731, B023
        regions = [r for r in ((rng.randint(0, 2), side(), side()) for _ in range(12)) if len(r[1]) + len(r[2]) >= width - 1]
        strings = [[(o, (g, o, x[len(x) - o :], y[: width - 1 - o])) for o in range(max(0, width - 1 - len(y)), len(x) + 1)] for g, x, y in regions]
        want = [[o for o, s in own if sum(s in (t for _, t in other) for other in strings) > 1] for own in strings]
        got = [[] for _ in regions]
        kept = suffix.shared_parts(regions, width)
        for (k, more, _), found in zip(kept, suffix.repeated_starts([r for *_, r in kept])):
            got[k] = [o + more for o in found]
        assert got == want

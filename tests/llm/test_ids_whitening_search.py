"""Token ids in files, whitening and ranked search against the library, plain linear algebra and all scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import lexical, token_ids, whitening
from tallyhouse.llm.common import tokenizer_path

RNG = random.Random(5)
TEXTS = [None, "", " ", "a", "Hello  world", "x" * 3000, "the quick brown fox " * 4000, "é日本 \n\n <|endoftext|> 12", "Hello  world", "\x00\x1f 'tis'd"]


# Token ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", -1) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "x", 0), (None, None, "x", 0), (3, "another text of 3", "x", 0), (3, "a", "x", 0), (-5, "below", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, frame string, start int").repartition(3)


def library(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [lib.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def held(rows):
    return Counter((r["doc_id"], tuple(token_ids.ids_of(r["ids"]))) for r in rows)


def test_ids_come_back_in_order(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    token_ids.write(docs, folder)
    given = docs.collect()
    want = Counter(zip([r["doc_id"] for r in given], map(tuple, library([r["text"] for r in given]))))
    rows = sorted(token_ids.read(spark, folder).collect(), key=lambda r: r["start"])
    assert held(rows) == want
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows] == sorted((i is not None, i or 0) for i, _ in want.elements())
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(token_ids.ids_of(r["ids"]))
        at += r["n_tokens"]
    sums = {(r["doc_id"], r["start"]): (r["n_tokens"], r["ids_crc32"]) for r in token_ids.digest(spark, folder).collect()}
    assert sums == {(r["doc_id"], r["start"]): (r["n_tokens"], zlib.crc32(r["ids"])) for r in rows}
    with pytest.raises(ValueError):
        token_ids.write(docs, folder)


def test_single_documents_by_seeking(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    token_ids.write(docs, folder)
    wanted = spark.createDataFrame([(3, 1), (3, 1), (6, 1), (99, 1), (-5, 1), (None, 1)], "doc_id long, n_tokens int")
    rows = token_ids.fetch(wanted, folder).collect()
    whole = {(r["doc_id"], r["start"]): r["ids"] for r in token_ids.read(spark, folder).collect() if r["doc_id"] in (3, 6, -5)}
    assert {(r["doc_id"], r["start"]): r["ids"] for r in rows} == whole and len(rows) == 5


def test_one_id_over_several_shards(spark, tmp_path):
    """Rows of one id that fill many shards are all found, and none twice."""
    rows = [(7, f"text {k}") for k in range(200)] + [(8, "after"), (6, "before")]
    folder = str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are put together
    try:
        token_ids.write(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(token_ids.manifest(folder)[1]) > 1
    got = token_ids.fetch(spark.createDataFrame([(7,), (8,)], "doc_id long"), folder).collect()
    assert held(got) == Counter(zip([7] * 200 + [8], map(tuple, library([t for i, t in rows if i > 6]))))


def test_dictionary_serves_short_documents(spark, tmp_path):
    words = [f"word{k}ish" for k in range(300)]
    rows = [(k, " ".join(RNG.choice(words) for _ in range(15))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    data = token_ids.train(df)
    assert 0 < len(data) <= token_ids.DICTIONARY and data == token_ids.train(df.repartition(5))
    size = lambda d: token_ids.frames(df, d).agg(F.sum(F.octet_length("frame"))).first()[0]
    assert size(data) < 0.8 * size(b"")
    folder = str(tmp_path / "ids")
    token_ids.write(df, folder)
    assert held(token_ids.read(spark, folder).collect()) == Counter(zip(range(3000), map(tuple, library([t for _, t in rows]))))
    # Another dictionary's shard is refused, and so is a dictionary that is not what its name tells.
    digest, shards = token_ids.manifest(folder)
    with pytest.raises(ValueError):
        token_ids.OpenShard(folder, shards[0], "0" * 64)
    (tmp_path / "ids" / f"dictionary-{digest}").write_bytes(data[:-1])
    with pytest.raises(ValueError):
        token_ids.OpenShard(folder, shards[0], digest)


def test_left_over_shards_are_not_read(spark, docs, tmp_path):
    folder = tmp_path / "ids"
    token_ids.write(docs, str(folder))
    (folder / "shard-of-a-lost-task").write_bytes(b"cut off")
    assert token_ids.read(spark, str(folder)).count() == docs.count()


def test_no_documents(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    token_ids.write(docs.where("false"), folder)
    assert token_ids.digest(spark, folder).count() == 0 and token_ids.fetch(docs, folder).count() == 0


# Whitening


def check_eigen(a, values, vectors):
    """Residuals, and each vector against a solver in doubles, within spaces of eigenvalues that lie together."""
    d, scale = len(a), np.abs(a).max()
    x = vectors.astype(float)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14 * d
    assert np.abs(a @ x - x * values.astype(float)).max() < 2e-15 * d * scale
    want, q = np.linalg.eigh(a)
    want, q = want[::-1], q[:, ::-1]
    assert np.abs(values.astype(float) - want).max() < 4e-15 * d * scale
    for places in np.split(np.arange(d), np.flatnonzero(-np.diff(want) > 1e-6 * scale) + 1):
        assert np.abs(x[:, places] @ x[:, places].T - q[:, places] @ q[:, places].T).max() < 1e-8


@pytest.mark.parametrize("spectrum", [[9, 4, 1], [5, 5, 5, 5], [1e6, 1, 1 + 1e-9, 1 - 1e-9, 1e-3], [3, 3, 2, 2, 1, 1, 0, 0], [1, 1 - 1e-7, 1 - 2e-7, 1 - 3e-7], [7], list(range(40, 0, -1)), [100] + [1 + 1e-8 * k for k in range(20)]])
def test_refined_eigenvectors(spectrum):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))[0]
    a = q @ np.diag(np.array(spectrum, float)) @ q.T
    a = (a + a.T) / 2
    check_eigen(a, *whitening.refined(a.astype(whitening.WIDE)))


def test_more_digits_than_the_start_has():
    rng = np.random.default_rng(8)
    b = rng.normal(size=(60, 24))
    a = b.T @ b
    values, vectors = whitening.refined(a.astype(whitening.WIDE))
    wide = a.astype(whitening.WIDE)
    worst = np.abs(wide @ vectors - vectors * values).max() / np.abs(a).max()
    single = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert worst < 1e-16 < 1e-8 < np.abs(single.T @ a @ single - np.diag(np.diagonal(single.T @ a @ single))).max() / np.abs(a).max()


def test_exact_gram_of_large_numbers():
    z = np.array([[2**40, 3], [-(2**41), 5], [1, 2**33]], np.int64)
    w = z.astype(object)
    assert (whitening.exact_gram(z) == w.T @ w).all() and (whitening.exact_gram(z[:0]) == 0).all()


def brute(vectors):
    usable = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for d in {len(x) for _, x in usable}:
        rows = [(i, x) for i, x in usable if len(x) == d]
        fit = np.array(sorted({tuple(x) for _, x in rows}), float)
        n, s = len(fit), fit.sum(axis=0)
        v = (fit - s / n).T @ (fit - s / n) / n
        e, q = np.linalg.eigh(v)
        e, q = e[::-1], q[:, ::-1]
        for i, x in rows:
            deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
            for k in range(min(4, d)):
                if e[k] > 1e-12 * e[0] > 0:
                    out.setdefault((i, k + 1), []).append((n, deviation, abs((np.array(x) - s / n) @ q[:, k] / math.sqrt(e[k])), e[k] / np.trace(v)))
    return out


def test_whitening_against_a_plain_solver(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(80, 8)) * np.array([3, 2, 1.5, 1, 0.5, 0.5, 0.2, 0.1])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100, rows[0][1]), (100, rows[1][1]), (0, rows[5][1]), (None, rows[2][1])] + [(200 + k, rows[3][1]) for k in range(50)]
    rows += [(300, None), (301, []), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (304, [float("inf")] + [0.0] * 7), (305, [0.0] * 8), (306, [-0.0] * 8)]
    rows += [(400 + k, [float(k), float(2 * k), 0.0]) for k in range(5)] + [(500, [1.0, 2.0, 3.0, 4.0])]  # variance in one direction; a single vector
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, x string").repartition(3)
    got, errors = {}, set()
    for r in whitening.whiten(df).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
        errors.add(r["identity_error"])
    want = brute(rows)
    assert got.keys() == want.keys() and max(errors) < 1e-12
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k])):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-12)
    signs = {}
    for r in whitening.whiten(df.repartition(1)).where("n > 50 and vec_id < 80").collect():
        signs[r["vec_id"], r["component"]] = r["whitened"]
    assert all(signs[r["vec_id"], r["component"]] == pytest.approx(r["whitened"], rel=1e-12) for r in whitening.whiten(df).where("n > 50 and vec_id between 1 and 79").collect())


def test_whitening_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).count() == 0 and whitening.whiten(df.where("false")).columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2**14 * k + k * k), float(-k)]) for k in range(40)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = [sum((40 * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    assert got == {k: w if w < 2**63 else None for k, w in enumerate(want)} and any(v is not None for v in got.values())


# Ranked search


def score_all(documents, items, k=10):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
    docs = [(i, Counter(words(t))) for i, t in documents]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    rows = []
    for item, text in set(items):
        scored = []
        for i, c, n in docs:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        rows += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(rows)


def as_rows(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("block,parts", [(4096, 2), (7, 5), (64, 1)])
def test_search_against_all_scores(spark, monkeypatch, block, parts):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "AT_ONCE", 3)
    rng = random.Random(block)
    common, rare = ["The", "of", "AND", "é日", "Ünder"], [f"w{k}" for k in range(120)]
    text = lambda n: rng.choice([" ", "-", "\n", "."]).join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n))
    documents = [(i, text(rng.randint(1, 60))) for i in range(300)] + [(i, text(5)) for i in range(40)]
    documents += [(1000, None), (1001, ""), (1002, "... --"), (None, text(9)), (None, text(9)), (2000, text(20_000))] + [(3000 + k, "w1 w2 w3") for k in range(30)] + [(3000, "w1 w2 w3")] * 4
    items = [(k, text(rng.randint(1, 70))) for k in range(30)] + [(5, text(4)), (None, "w1 w2"), (77, None), (78, ""), (79, "the"), (80, "nowhere1 nowhere2"), (81, "w1 w2 w3"), (81, "w1 w2 w3")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in documents], "doc_id long, text string, score int, rank string").repartition(parts)
    it = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, score int")
    assert as_rows(lexical.search(df, it)) == score_all(documents, [x for x in items if x[1] is not None])


def test_search_in_rounds(spark, monkeypatch):
    documents = [(k, f"a{k % 7} b{k % 5} c{k % 3} d{k % 11}") for k in range(200)]
    items = [(k, f"a{k % 7} d{k % 11} zz") for k in range(60)]
    monkeypatch.setattr(lexical, "ROUND_BYTES", 200)
    got = as_rows(lexical.search(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4))
    assert got == score_all(documents, items, 4)


def test_search_with_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).count() == 0 and lexical.search(docs, items.where("false")).count() == 0
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_masks_that_cannot_win_are_not_evaluated():
    """One mask reaches more than any other: the others' documents are not scored."""
    rows = [{"item_id": 1, "text": b"r1 r2 common"}]
    round_ = lexical.Round.of(rows)
    documents = [b"r1 r2 common"] * 10 + [b"common x y z"] * 500
    round_.weigh({0: 510, -1: 2030, **{round_.vocabulary[t]: n for t, n in ((b"r1", 10), (b"r2", 10), (b"common", 510))}})
    get = round_.vocabulary.get
    found = [[get(t) for t in lexical.terms(d) if get(t)] for d in documents]
    block = lexical.Block(list(range(510)), [len(lexical.terms(d)) for d in documents], [len(f) for f in found], [t for f in found for t in f], round_)
    best, scored = lexical.Best(10), []
    offer, best.offer = best.offer, lambda s, i: (scored.extend(i), offer(s, i))
    lexical_at_once, lexical.AT_ONCE = lexical.AT_ONCE, 1
    try:
        block.search(round_.items[0], best)
    finally:
        lexical.AT_ONCE = lexical_at_once
    assert sorted(scored) == list(range(10)) == best.ids.tolist()

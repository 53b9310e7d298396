"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with nulls, ties and empty tables."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, embedding_dedup, html, minhash, nearest, packing, pii, suffix, token_counts, toxicity
from tallyhouse.llm.common import tokenizer_path

TEXTS = [None, "", " ", "a", "Hello  world", "x" * 3000, "the quick brown fox " * 40, "é日本 \n\n <|endoftext|> 12", "the quick brown fox " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(None, "no id", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_tokens int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_bpe_equals_the_library_and_comes_back(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = bpe.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(ids).collect()} == texts
    assert {r["doc_id"]: r["decoded_sha256"] for r in bpe.round_trip(docs).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert bpe.round_trip(none).count() == 0


def test_bpe_window_is_enough():
    m = bpe.transducer(tokenizer_path("byte_bpe_50k.json")).merges
    rng = random.Random(3)
    data = "".join(rng.choice("etaoin") for _ in range(4000)).encode()
    assert list(m.stream(data)) == list(m.merge(data)) and m.merge(data[:300]) == m.merge_by_rank(data[:300])


def test_token_counts(docs, none):
    lengths = [r["n_tokens"] for r in bpe.lengths(docs).collect()]
    for r in token_counts.token_counts(docs).collect():
        n = r["n_tokens"]
        assert r["docs_within"] == sum(x <= n for x in lengths) and r["truncated_total"] == sum(min(x, n) for x in lengths) and r["tokens_total"] == sum(lengths)
    assert token_counts.token_counts(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {*range(len(TEXTS)), None}
    for parts in by_doc.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == parts[0]["doc_tokens"]
    for parts in by_seq.values():
        total = sum(r["length"] for r in parts)
        assert total <= 2048 and total & (total - 1) == 0
    assert by_doc[0][0]["doc_tokens"] == 1 and packing.pack(none).count() == 0


def test_minhash(spark, none):
    rng = random.Random(1)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(80)]
        for k in range(6):
            copy = list(words)
            for _ in range(k * 2):
                copy[rng.randrange(80)] = "new"
            rows.append((10 * i + k, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (None, "one")]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    sets = {i: set(minhash.shingles(t, 2).tolist()) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == root
    assert len(got) == len(rows) and minhash.groups(none).count() == 0



def test_suffix_array():
    rng = random.Random(5)
    for _ in range(500):
        t = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("together", [400, 5])
def test_repeated_bytes(spark, none, monkeypatch, together):
    monkeypatch.setattr(suffix, "TOGETHER", together)
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcdef gh") for _ in range(n))
    shared = some(700)
    texts = [some(rng.randint(0, 300)) + shared[rng.randint(0, 100) : rng.randint(450, 700)] + some(rng.randint(0, 300)) for _ in range(40)]
    texts += [None, "", "x" * 399, "x" * 401, "é" * 500, shared, "ab" * 600]
    data = [(t or "").encode() for t in texts]
    times = {}
    for d in data:
        for i in range(len(d) - 399):
            times[d[i : i + 400]] = times.get(d[i : i + 400], 0) + 1
    want = {}
    for n, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if times[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[n] = (sum(gone), hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest())
    got = suffix.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert together != 400 or suffix.digest(none).count() == 0


def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 16))
    m = np.repeat(base, 6, axis=0) + 0.15 * rng.standard_normal((180, 16))
    m[7] = m[6]
    rows = [(i, v.astype(float).tolist(), i % 2) for i, v in enumerate(m)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, m[0].tolist(), None), (905, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), m


def test_nearest(spark):
    df, m = vectors(spark)
    got = nearest.search(df, "vec_id % 10 = 0", k=5).collect()
    pool = np.vstack([m, m[:1]])
    ids = np.array([*range(180), 904])
    hits = 0
    for q in range(0, 180, 10):
        d = np.sqrt(((pool - m[q]) ** 2).sum(axis=1))
        want = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:5]
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(mine) == 5
        hits += len(set(mine) & set(want))
    assert hits >= 0.9 * 5 * 18
    assert nearest.search(df.where("false"), "vec_id % 10 = 0").count() == 0


def test_nearest_verifies_a_part_and_finds_most():
    rng = np.random.default_rng(4)
    m = rng.standard_normal((200, 64))[rng.integers(0, 200, 6000)] + 0.5 * rng.standard_normal((6000, 64))
    block = nearest.Block(np.arange(6000), m, nearest.directions(64))
    limit, hits = nearest.chi_square_quantile(nearest.SURE), 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        ids, dist = block.search(q, m[q], m[q] @ nearest.directions(64), 10, np.inf, limit)
        assert np.array_equal(dist, np.sort(dist)) and np.allclose(dist, d[ids])
        hits += len({*ids.tolist()} & {*np.argsort(d)[:10].tolist()})
    assert hits >= 0.9 * 600 and block.verified < 0.5 * 60 * 6000


def test_embedding_dedup_loses_no_link_between_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 10)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    m = rng.standard_normal((300, 6))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked = u @ u.T >= 0.8
    np.fill_diagonal(linked, False)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(m)] + [(1000, (2 * m[5]).tolist(), 1), (1001, m[6].tolist(), 1)]
    got = {r["vec_id"]: r for r in embedding_dedup.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.8).collect()}
    more = lambda i, j: int(linked[i, j] or i == j)
    assert {i: got[i]["n_links"] for i in range(300)} == {i: int(linked[i].sum()) + more(i, 5) + more(i, 6) for i in range(300)}
    least = list(range(300))
    for _ in range(300):
        least = [min([least[i], *(least[j] for j in np.flatnonzero(linked[i]))]) for i in range(300)]
    assert {i: got[i]["component_id"] for i in range(300)} == dict(enumerate(least))


def test_embedding_dedup(spark):
    df, m = vectors(spark)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (np.arange(180)[:, None] % 2 == np.arange(180)[None, :] % 2)
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in embedding_dedup.groups(df).collect()}
    assert {i: got[i]["n_links"] for i in range(180)} == dict(enumerate(linked.sum(axis=1).tolist()))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>Buy the best of it</div><article><h1>Head &amp; line</h1><p>It is the text of\n the page<br>and it goes on with the words that we know.</p><p>Ok.</p></article><div id=comments><p>first</p></div><footer>(c) us</footer></body></html>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (None, "u", "", "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {1: "Head & line\nIt is the text of the page and it goes on with the words that we know.\nOk.", 2: "", None: ""}


def test_pii(spark, docs):
    text = "mail a.b@c.example.com ip 10.0.0.1 or 300.1.1.1 card 4111 1111 1111 1111 call +1 (555) 010-0199 token = \"abc123def456\""
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "clean words only", "x")], "doc_id long, text string, n_chars string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    assert [got[1][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1] and got[3]["spans"] == "" and got[2]["n_ip"] == 0
    assert got[1]["spans"].startswith(f"email:5:{5 + len('a.b@c.example.com')},ip:")
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert "[EMAIL]" in red[1] and "4111" not in red[1] and red[2] is None and red[3] == "clean words only"


def test_toxicity(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + (["zzgrump", "zzfoul"] if bad else []))))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*rows, (700, None), (701, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert held and all(got[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert got[700]["score"] == got[701]["score"] < 0.5
    assert toxicity.score(df.where("false"), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


SAID = "It is the text of the page and it goes on with the words that we know."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><p title=it's>{SAID}</p></article>", SAID),
        (f"<article><p>{SAID}</p></article><ol class=commentlist><li class=comment><p>It is what I think of it and of the rest.</p></ol>", SAID),
        (f"<article><p>{SAID}</p><ol class=commentlist><li class=comment><p>It is what I think of it and of the rest.</p></ol></article>", SAID),
        (f'<article><p>{SAID}</p><p class="ad">Buy it now as it is the best of all that we have for you.</p><p>Not <span class="ad">buy</span> now.</p></article>', f"{SAID}\nNot now."),
        (f'<article><p>{SAID}</p><div class="side by-side"><p>{SAID}</p></div><ul><li>one<li class=ad>two<li>three</ul></article>', f"{SAID}\n{SAID}\none\nthree"),
        (f"<article><p>{SAID}</p></article>" + "<a b " * 50_000, SAID),
    ],
)
def test_html_by_hand(page, want):
    assert html.main_text(page) == want


def test_base_spans_equal_plain_patterns():
    """Against finditer, on random texts of the characters that matter."""
    rng = random.Random(9)
    pieces = ["a", "b.c", "@", "x-y", ".com", " ", "+", "1", "23", "456", "255", ".", "-", "(", ")", "4111 1111 1111 1111", "10.0.0.1", "é", "+1 555 010 0199"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        digits = lambda m: [int(c) for c in m.group() if c.isdigit()]
        want = [("email", m.start(), m.end()) for m in pii.EMAIL.finditer(text)]
        want += [("ip", m.start(), m.end()) for m in pii.IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in pii.CARD.finditer(text):
            d = digits(m)[::-1]
            if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
                want.append(("card", m.start(), m.end()))
        want += [("phone", m.start(), m.end()) for m in pii.PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
        assert pii.base_spans(text) == want, text


def test_packing_ids_are_the_library_s(docs):
    """ids_crc32 and offsets of every piece, with the ids that the tokenizers library gives."""
    import zlib

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    by_seq = {}
    for r in packing.pack(docs).collect():
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == parts[0]["sequence_tokens"]


def test_minhash_rounds_of_a_crowded_bucket(spark, monkeypatch):
    """A cloud of near copies around one text, with few pivots a round: groups are those of all pairs."""
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    monkeypatch.setattr(minhash, "PIVOTS_OF", 3)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 4, 9, 14])):
            copy[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    sets = [set(minhash.shingles(t, 2).tolist()) for _, t in rows]
    root = list(range(150))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(150), 2):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
                changed = True
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root)) and 1 < len(set(root)) < 100

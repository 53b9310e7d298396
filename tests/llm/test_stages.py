"""Stages of the pipeline on rows that share an id or have none, against brute force."""

import random
import zlib

import corpus_pipeline
import pytest
from tallyhouse.llm import minhash, pii, suffix, toxicity

RNG = random.Random(11)
COLUMNS = "doc_id long, text string, n_chars long"


def words(n):
    return " ".join(f"w{RNG.randrange(10**6)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t) if t is not None else None) for i, t in rows], COLUMNS)


def texts(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def expected(rows):
    return sorted((i is None, i or 0, t or "") for i, t in rows)


@pytest.mark.parametrize("parts", [1, 4])
def test_keep_one_row_of_a_group(spark, parts):
    a, b, c, d = (words(120) for _ in range(4))
    near = a + " end"
    marks = "-" * 500
    rows = [(3, a), (3, a), (7, near), (None, a), (4, b), (4, c), (5, c), (None, d), (None, d), (8, marks), (8, marks), (9, marks), (None, ""), (None, "")]
    sets = [set(minhash.shingles(t, 5).tolist()) for _, t in rows]
    alike = lambda x, y: bool(sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])) or rows[x] == rows[y] and rows[x][0] is not None
    want = []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        if not any(alike(k, x) for x in want):
            want.append(k)
    kept = minhash.keep_one(frame(spark, rows).repartition(parts))
    assert texts(kept) == expected([rows[k] for k in want])
    # A repeated row doesn't lose its text in the next stage.
    assert (3, a) in [(r["doc_id"], r["text"]) for r in suffix.remove(kept).collect()]


def test_toxic_rows_without_ids_go(spark):
    rows = [(i, words(30) + (" zzgrump zzfoul" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    extra = [(None, words(30) + " zzgrump zzfoul"), (None, words(30)), (1, words(30) + " zzgrump zzfoul"), (None, None)]
    got = toxicity.clean(frame(spark, rows + extra), labels)
    assert texts(got) == expected([(i, t) for i, t in rows + extra if "zzgrump" not in (t or "")])


@pytest.mark.parametrize("together", [400, 5])
def test_passages_of_rows_without_ids_go(spark, monkeypatch, together):
    monkeypatch.setattr(suffix, "TOGETHER", together)
    some = lambda n: "".join(RNG.choice("abcdef gh") for _ in range(n))
    shared, twice = some(700), some(900)
    cuts = [some(RNG.randint(0, 300)) + shared[RNG.randint(0, 100) : RNG.randint(450, 700)] + some(RNG.randint(0, 300)) for _ in range(24)]
    rows = [(k // 2 if k % 3 else None, t) for k, t in enumerate(cuts)]
    rows += [(50, twice), (50, twice), (50, twice[:500] + some(300)), (None, cuts[1]), (None, cuts[1]), (None, some(800)), (51, some(800)), (None, None), (52, "")]
    data = [(t or "").encode() for _, t in rows]
    times = {}
    for d in data:
        for i in range(len(d) - 399):
            times[d[i : i + 400]] = times.get(d[i : i + 400], 0) + 1
    want = []
    for (i, t), d in zip(rows, data):
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if times[d[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        want.append((i, bytes(b for b, g in zip(d, gone) if not g).decode()))
    df = frame(spark, rows)
    assert texts(suffix.remove(df)) == expected(want)
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"] - r["n_removed"]) for r in suffix.digest(df).collect())
    assert left == sorted((i is None, i or 0, len(t)) for i, t in want)


def test_personal_data_of_every_row_goes(spark):
    rows = [(1, "mail a.b@c.example.com now"), (1, "a longer text, then card 4111 1111 1111 1111 and no more"), (None, "call +1 (555) 010-0199"), (None, "write x@y.example.org"), (2, "clean words only"), (None, None)]
    want = [(1, "mail [EMAIL] now"), (1, "a longer text, then card [CARD] and no more"), (None, "call [PHONE]"), (None, "write [EMAIL]"), (2, "clean words only"), (None, None)]
    got = pii.redact(frame(spark, rows))
    assert texts(got) == expected(want) and all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got.collect())


def test_pipeline_stages_in_turn(spark, tmp_path):
    """All stages on rows that share ids or have none: what is packed is what the stages should leave."""
    clean = [words(100) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(3, clean[3]), (None, clean[4]), (None, words(100))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "doc_tokens").distinct().collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, i) for i in range(30)] + [(True, 0)]
    assert all(r["doc_tokens"] > 100 for r in got)


def test_distinct_texts_with_one_common_word_all_teach(spark):
    """Texts that share the word of least hash are no copies; true copies count once."""
    least = min((f"k{i}" for i in range(20000)), key=lambda w: zlib.crc32(w.encode()))
    rows = [(f"{least} {words(20)} zzgrump", 1) for k in range(6)] + [(f"{least} zzcopied", 1)] * 9 + [(f"{least} {words(20)}", 0) for _ in range(300)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert "zzgrump" in terms and "zzcopied" not in terms


def test_spelled_out_address_is_proposed():
    """By itself as beside other text that the prefilter knew."""
    for tail in ("", " and a dot here"):
        assert ("email", 8, 27) in pii.proposals("contact jane at example.com" + tail, [])

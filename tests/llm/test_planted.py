"""Cases planted for every stage of the pipeline, and links between vectors held against the SQL."""

import random

import corpus_pipeline
import duckdb
import numpy as np

from tallyhouse.llm import embedding_dedup, packing
from tallyhouse.llm.common import tokenizer_path
from tallyhouse.llm.queries import OP8_SQL

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_takes_what_was_planted_and_leaves_the_rest(spark, tmp_path):
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    texts = {i: words(rng.randint(60, 150)) for i in range(300)}
    toxic = {i for i in range(300) if i % 10 == 3}
    for i in toxic:
        texts[i] += " zzgrump zzfoul " + words(20)
    near = {400 + i: texts[i].rsplit(" ", 1)[0] + " end" for i in (0, 1, 2)} | {410: texts[0], 411: texts[4]}
    passage = words(70)
    shared = {20, 21, 22, 25}
    for i in shared:
        texts[i] = words(80) + " " + passage + " " + words(80)
    private = {30: "jane.doe@mail.example.org", 31: "4111 1111 1111 1111", 32: "+1 (555) 010-0199", 34: "192.168.10.44"}
    for i, x in private.items():
        texts[i] += f" reach me at {x} any time"
    texts |= near | {500: None, 501: ""}
    rows = [(i, t, "en", "hot" if i % 3 else "other", len(t) if t is not None else None) for i, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(200)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
            left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean, one, cut, safe = left
    assert clean == {i: t for i, t in texts.items() if i not in toxic}
    assert one == {i: t for i, t in clean.items() if i not in near}
    assert {i for i in cut if cut[i] != one[i]} == shared and cut.keys() == one.keys()
    for i in shared:
        assert not set(passage.split()[1:-1]) & set(cut[i].split()) and len(cut[i].split()) >= 158
    assert {i for i in safe if safe[i] != cut[i]} == private.keys() and safe.keys() == cut.keys()
    for i, x in private.items():
        head, tail = cut[i].split(x)
        assert x not in safe[i] and safe[i].startswith(head) and safe[i].endswith(tail)
    encode = packing.word_encoder(tokenizer_path("word_bpe_49k.json")).encode
    pieces = {}
    for r in docs.collect():
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
    assert pieces == {i: len(encode(t)) + 1 for i, t in safe.items()}
    run = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in run} == pieces


def test_links_between_vectors_equal_the_sql(spark, tmp_path):
    rng = np.random.default_rng(13)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((n, (centre + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])).tolist(), label))
                n += 1
    rows += [(n + k, rows[3][1], 0) for k in range(5)] + [(n + 9, [0.0] * 16, 0), (n + 10, None, 0), (n + 11, [float("nan")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = set(c.execute(OP8_SQL).fetchall())
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.groups(df, threshold=0.93).collect()}
    assert got == want and sum(x[1] > 0 for x in got) > 40 and sum(not x[3] for x in got) > 30

"""The registered queries of this subpackage.

op4_minhash and op8_embedding_dedup have SQL as exact joins of all pairs, fit for small tables only, and op13_lexical as
scores of all documents. For the others, tokenizers, learned models and suffix arrays are beyond it; tests/llm holds them
against a brute-force version instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.llm import bpe, embedding_dedup, html, lexical, minhash, nearest, packing, pii, suffix, token_counts, token_ids, toxicity, whitening
from tallyhouse.llm.common import shared_folder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"), length=400)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token_ids-{uuid.uuid4().hex}"
    token_ids.write(table(spark, sf_dir, "documents"), folder)
    return token_ids.digest(spark, folder)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = (op1_toxicity, op2_token_counts, op3_packing, op4_minhash, op5_nearest, op6_suffix_dedup, op7_pii, op8_embedding_dedup, op9_html, op10_bpe, op11_token_ids, op12_whitening, op13_lexical)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: Documents with their distinct shingles of two words, pairs with 80 % in common, and the least id that links reach.
OP4_SQL = r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), sets as (
    select doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) s from words
), shingles as (select doc_id, len(s) n, unnest(s) sh from sets),
links as (
    select a.doc_id a, b.doc_id b from shingles a join shingles b on a.sh = b.sh and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached as (select doc_id a, doc_id b from sets union select r.a, l.b from reached r join links l on r.b = l.a),
component as (select a, min(b) component_id from reached group by a)
select doc_id, len(s) n_shingles, component_id, doc_id = component_id kept from sets join component on a = doc_id
"""

OP8_SQL = """
with recursive v as (
    select vec_id, label, cast(embedding as double[]) e from embeddings
    where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
counts as (select a, count(*) n from links group by a),
reached as (select vec_id a, vec_id b from embeddings union select r.a, l.b from reached r join links l on r.b = l.a),
component as (select a, min(b) component_id from reached group by a)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept from embeddings join component on component.a = vec_id left join counts on counts.a = vec_id
"""

#: Scores of all documents that share a term with an item.
OP13_SQL = r"""
with d as (
    select row_number() over () k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents where text is not null
), n as (select k, doc_id, len(t) n from d where len(t) > 0), s as (select count(*) docs, cast(sum(n) as bigint) total from n),
i as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark
), tf as (select k, term, count(*) tf from (select k, unnest(t) term from d) where term in (select term from i) group by k, term),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) w from (select term, count(*) df from tf group by term), s),
scores as (
    select item_id, k, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) as bigint) score
    from i join tf using (term) join w using (term) join n using (k), s group by item_id, k, doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score from (
    select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scores where score > 0
) where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": OP4_SQL, "op8_embedding_dedup": OP8_SQL, "op13_lexical": OP13_SQL}

"""Toxicity by weak supervision.

Terms (words, fronts of words, and fronts that several distinct words share) that toxic examples have and clean ones lack
form learned lexicons by their source; with a list of insults, patterns of disguised spelling, and densities they make the
voters. The label model estimates the voters'
accuracies and correlations from vote counts over the whole corpus. A linear classifier of term features is trained on
its posteriors and scores every document.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import ROW, durable, hold, row_key
from tallyhouse.llm.label_model import LabelModel, logistic

#: Labelled rows of either class that are looked at to learn terms and to train the classifier: those least by a hash of doc_id.
LABELLED = 15_000
#: The least share of toxic examples that must have a term; so terms are bounded by the labelled rows looked at.
RARE = 0.004
LEXICONS = 8
WORD = re.compile(r"[^\W_]+")
FRONTS = (4, 5, 6)
#: Numbers of distinct words with one front that make terms of their own: some fronts are rare, but toxic only in numbers.
REPEATED = (2, 3, 4)
#: Common insults.
INSULTS = frozenset("idiot idiots moron morons scum worthless pathetic clown clowns loser losers trash garbage disgusting stupid dumb imbecile jerk retard bastard bitch asshole fuck fucking shit cunt whore slut".split())
DISGUISE = str.maketrans("013457@$!", "oieastasi")
DISGUISED = re.compile(r"(?<!\S)(?=\S*[A-Za-z])(?=\S*[013457@$!*])[A-Za-z013457@$!*]{4,20}(?!\S)")
SPACED = re.compile(r"(?<!\S)(?:[A-Za-z][ .*_-]){3,11}[A-Za-z](?!\S)")
VOTERS = (*(f"lexicon_{k}" for k in range(LEXICONS)), "insults", "disguised", "several", "clean")


def terms_of(text: str) -> set[str]:
    """Distinct lower-cased words, their fronts marked by ^, and fronts of k distinct words by k^."""
    words = set(WORD.findall(text.lower()))
    fronts = Counter(w[:n] for n in FRONTS for w in words if len(w) > n)
    return words | {"^" + f for f in fronts} | {f"{k}^{f}" for f, n in fronts.items() for k in REPEATED if n >= k}


def features_of(text: str, terms: dict[str, int]) -> tuple[list[int], int, int]:
    """Numbers of the terms that the text has, its distinct insults, and insults in disguise."""
    words = set(WORD.findall(text.lower()))
    found = [terms[w] for w in words.intersection(terms)]
    for n in FRONTS:
        fronts = Counter([w[:n] for w in words if len(w) > n])
        found += [terms[f] for f in map("^".__add__, fronts) if f in terms]
        found += [terms[f] for front, many in fronts.items() if many > 1 for k in REPEATED if many >= k and (f := f"{k}^{front}") in terms]
    plain = len(words & INSULTS)
    hidden = {re.sub(r"[*]", "", m.group().lower()).translate(DISGUISE) for m in DISGUISED.finditer(text)} | {re.sub(r"[ .*_-]", "", m.group()).lower() for m in SPACED.finditer(text)}
    return sorted(found), plain, len((hidden & INSULTS) - words)


def vote(found: list[int], plain: int, hidden: int, lexicon: list[int]) -> tuple[int | None, ...]:
    """Votes of VOTERS; lexicon has that of each term."""
    in_lexicon = {lexicon[t] for t in found}
    hits = len(found) + plain + hidden
    return (*((1 if k in in_lexicon else None) for k in range(LEXICONS)), 1 if plain else None, 1 if hidden else None, 1 if len(found) + plain + hidden >= 2 else None, 0 if not hits else None)


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of up to LABELLED rows of either class, of those whose crc32(doc_id as text) mod 5 is not 0."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    least = [F.xxhash64("doc_id"), F.col("doc_id")]
    return usable.where("toxic = 1").orderBy(*least).limit(LABELLED).unionByName(usable.where("toxic = 0").orderBy(*least).limit(LABELLED))


def learn_terms(examples: DataFrame) -> list[str]:
    """Terms by their reach among toxic examples, of those that clean ones hardly have.

    Copies of one text would lift all its rare words, so of examples of a class with the same set of words only one counts,
    in the totals too.
    """

    def sign(batches):
        import pyarrow as pa

        hold()
        for b in batches:
            keys = [xxhash.xxh128_digest(" ".join(sorted(set(WORD.findall((t or "").lower())))).encode("utf-8", "surrogatepass")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], ["text", "toxic", "key"])

    examples = examples.select("text", "toxic").mapInArrow(sign, "text string, toxic int, key binary").groupBy("key", "toxic").agg(F.min("text").alias("text"))
    examples = durable(examples.select("text", "toxic"))  # at most 2 * LABELLED texts
    size = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)

    def count(batches):
        import pyarrow as pa

        hold()
        seen = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[toxic].update(terms_of(text or ""))
            if sum(map(len, seen)) > 300_000:
                yield from rows(seen, pa)
                seen = (Counter(), Counter())
        yield from rows(seen, pa)

    def rows(seen, pa):
        every = list(seen[1].keys() | seen[0].keys())
        for lo in range(0, len(every), 50_000):
            part = every[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([seen[c][t] for t in part], pa.int64()) for c in (1, 0))], ["term", "toxic", "clean"])

    counts = examples.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share, base = F.col("toxic") / max(n_toxic, 1), F.col("clean") / max(n_clean, 1)
    good = counts.where((F.col("clean") <= 0.02 * F.col("toxic")) & (F.col("toxic") >= 4) & (share >= RARE) & (share >= 30 * base + 2.0 / max(n_clean, 1)))
    return apart([(r["term"], r["toxic"], r["clean"]) for r in good.orderBy(F.desc("toxic"), F.asc("clean"), "term").collect()])


def parts_of(term: str) -> tuple[int, str]:
    """(number of words, word or front) of a term; 0 for a whole word."""
    head, mark, front = term.rpartition("^")
    return (int(head or 1), front) if mark else (0, term)


def apart(counted: list[tuple[str, int, int]]) -> list[str]:
    """Terms of (term, toxic, clean) without fronts that a longer term has in just as many examples: they say the same once more."""
    said = set()
    for term, *n in counted:
        k, body = parts_of(term)
        said |= {(max(k, 1), body[:m], *n) for m in FRONTS if len(body) > m}
    return [term for term, *n in counted if not ((k := parts_of(term))[0] and (*k, *n) in said)]


def lexicon_of(terms: list[str]) -> list[int]:
    """The lexicon of each term, by its source: words, fronts, fronts of several words; the commoner half of each apart, and
    words dealt to two lexicons in either half. terms come by falling reach."""
    kinds = [min(parts_of(t)[0], 2) for t in terms]
    size, met, out = Counter(kinds), Counter(), []
    for kind in kinds:
        rest = int(2 * met[kind] >= size[kind])
        out.append(2 * rest + met[0] % 2 if kind == 0 else 4 + 2 * (kind - 1) + rest)
        met[kind] += 1
    return out


def _row(found: list[int], plain: int, hidden: int, n: int, lexicon: list[int]) -> np.ndarray:
    """Features of the classifier: a flag for each term, and bounded counts."""
    x = np.zeros(n + 4)
    x[found] = 1
    hits = len(found) + plain + hidden
    x[n:] = float(plain > 0), float(hidden > 0), min(hits, 4) / 4, min(len({lexicon[t] for t in found}), 4) / 4
    return x


def _train(rows, labels_of: dict[str, float], n: int, lexicon: list[int]) -> np.ndarray:
    """Weights for soft labels by vote pattern, over distinct feature rows."""
    counts = Counter((tuple(r["found"]), min(r["plain"], 1), min(r["hidden"], 1), labels_of[r["pattern"]]) for r in rows)
    if not counts:
        return np.zeros(n + 5)
    keys = list(counts)
    # Only terms that the sample has get a column, so the table stays narrow.
    used = sorted({t for k in keys for t in k[0]})
    place = {t: i for i, t in enumerate(used)}
    x = np.zeros((len(keys), len(used) + 4), np.float32)
    for i, (found, plain, hidden, _) in enumerate(keys):
        full = _row(list(found), plain, hidden, n, lexicon)
        x[i, [place[t] for t in found]] = 1
        x[i, len(used) :] = full[n:]
    w = logistic(x, np.array([k[3] for k in keys]), np.array([counts[k] for k in keys], float), l2=0.5)
    out = np.zeros(n + 5)
    out[used], out[n:] = w[: len(used)], w[len(used) :]
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    return row_scores(docs, labels).drop(ROW)


def row_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, and ROW where docs are numbered, else null.

    held_out: crc32(doc_id as text) mod 5 is 0; such rows teach nothing. score: chance of being toxic, 0 to 1. predicted:
    1 from 0.5 on. Null and empty texts are scored as texts without any term. A null doc_id is not held out. Without
    labels of both classes only the list of insults and the patterns speak. Repeated rows are scored one by one.
    """
    number_of = F.col(ROW) if ROW in docs.columns else F.lit(None).cast("long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number_of.alias(ROW))
    chosen = _labelled(labels)
    chosen = durable(chosen)  # at most 2 * LABELLED rows of two numbers, so it may be broadcast
    size = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    examples = docs.join(F.broadcast(chosen), "doc_id")
    terms = learn_terms(examples) if n_toxic and n_clean else []
    number, lexicon = {t: i for i, t in enumerate(terms)}, lexicon_of(terms)

    def features(batches):
        import pyarrow as pa

        hold()
        for b in batches:
            found, plain, hidden, pattern = [], [], [], []
            for text in b.column(1).to_pylist():
                f = features_of(text or "", number)
                found.append(f[0])
                plain.append(f[1])
                hidden.append(f[2])
                pattern.append("".join("-" if v is None else str(v) for v in vote(*f, lexicon)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(plain, pa.int32()), pa.array(hidden, pa.int32()), pa.array(pattern, pa.string()), b.column(2)],
                ["doc_id", "found", "plain", "hidden", "pattern", ROW],
            )

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    seen = durable(docs.mapInArrow(features, f"doc_id long, found array<int>, plain int, hidden int, pattern string, {ROW} long").withColumn("held_out", held_out))
    tally = seen.where("not held_out").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2^len(VOTERS) rows
    read = lambda p: tuple(None if c == "-" else int(c) for c in p)
    yes = [*[(0.4, 0.0)] * LEXICONS, (0.5, 0.0), (0.05, 0.0), (0.8, 0.0), (0.0, 0.02)]
    no = [*[(0.005, 0.0)] * LEXICONS, (0.005, 0.0), (0.002, 0.0), (0.003, 0.0), (0.0, 0.97)]
    model = LabelModel(0.1, yes, no, strength=200).fit([read(r["pattern"]) for r in tally], [r["n"] for r in tally])
    # One row of each labelled id, whatever number repeats it: the first by its features, so at most 2 * LABELLED rows.
    first = F.min(F.struct("found", "plain", "hidden", "pattern")).alias("r")
    sample = seen.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(first).select("r.*").collect()
    patterns = sorted({r["pattern"] for r in tally} | {r["pattern"] for r in sample})
    posterior = dict(zip(patterns, model.posterior([read(p) for p in patterns]).tolist()))
    if not sample:  # nothing labelled: every pattern once stands in
        sample = [{"found": [], "plain": int(p[LEXICONS] == "1"), "hidden": int(p[LEXICONS + 1] == "1"), "pattern": p} for p in patterns]
    weights = _train(sample, posterior, len(terms), lexicon)

    def judge(batches):
        import pyarrow as pa

        hold()
        n = len(weights) - 5
        for b in batches:
            z = []
            for found, plain, hidden in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                hits = len(found) + plain + hidden
                few = min(hits, 4) / 4, min(len({lexicon[t] for t in found}), 4) / 4
                z.append(weights[found].sum() + weights[n] * (plain > 0) + weights[n + 1] * (hidden > 0) + weights[n + 2] * few[0] + weights[n + 3] * few[1] + weights[n + 4])
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -60, 60)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), b.column(5)], ["doc_id", "held_out", "score", "predicted", ROW])

    return seen.select("doc_id", "held_out", "found", "plain", "hidden", ROW).mapInArrow(judge, f"doc_id long, held_out boolean, score double, predicted int, {ROW} long")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score() calls toxic, each judged by its own text."""
    rows = docs.withColumn(ROW, row_key())
    toxic = row_scores(rows, labels).where("predicted = 1").select(ROW).distinct()
    return rows.join(toxic, ROW, "left_anti").select(*docs.columns)

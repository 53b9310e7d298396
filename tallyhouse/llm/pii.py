"""Personal data by weak supervision.

Patterns propose spans. Six labelers vote on each: a strict pattern, a check (digit counts, Luhn), a gazetteer (domain
ends, country codes, card issuers, given names), words before it, words that speak against it, and its shape. The label model
estimates from the vote counts of the whole corpus how far each can be trusted; its posteriors train a linear classifier
of spans. Spans of the strict base patterns always stay; of the others, those that the classifier accepts are added.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import ROW, durable, hold, ids_and_texts, row_key
from tallyhouse.llm.label_model import LabelModel, logistic

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret", "person")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Looser patterns of the kinds, with the group that is the span, and a piece of text without which they can't match.
LOOSE = {
    "email": (re.compile(r"(?<![\w.+-])([A-Za-z0-9][\w.+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63})+)", re.I), re.compile(r" at |[(\[{]at[)\]}]", re.I)),
    "card": (re.compile(r"(?<![\d.-])(\d{4}[ -]?\d{6}[ -]?\d{5}|\d{4}[ -]?\d{6}[ -]?\d{4})(?![\d.-])"), re.compile(r"\d{4}")),
    "phone": (re.compile(r"(?<![\w+.-])((?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-])"), re.compile(r"\d{3}")),
    "ssn": (re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"), re.compile(r"\d-\d")),
    "iban": (re.compile(r"(?<!\w)([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"), re.compile(r"[A-Z]{2}\d\d")),
    "secret": (re.compile(r"\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_/+=-]{8,})", re.I), re.compile(r"[=:]")),
    "person": (re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? ([A-Z][\w'-]+(?: [A-Z][\w'-]+)?)"), re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\b")),
}
#: Fixed values of the gazetteers.
DOMAIN_ENDS = frozenset("com org net edu gov info io co uk de fr es it eu us".split())
GIVEN_NAMES = frozenset("james john robert michael david maria mary anna linda peter paul thomas hans julia laura sophie marie jean pierre carlos jose ana luis juan".split())
IBAN_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB GR IE IT LU NL NO PL PT SE".split())
FOR = {
    "email": re.compile(r"mail|contact|kontakt|write", re.I), "ip": re.compile(r"\bip\b|server|host|addr", re.I), "card": re.compile(r"card|visa|master|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|mobil|fax|anruf", re.I), "ssn": re.compile(r"ssn|social|security", re.I), "iban": re.compile(r"iban|konto|account|bank", re.I),
    "secret": re.compile(r"", re.I), "person": re.compile(r"name|dear|regards|sincerely", re.I),
}
AGAINST = re.compile(r"version|isbn|issn|\border\b|invoice|part no|\bserial|\bsection|\bdoi\b|figure|\bv$", re.I)
VOTERS = ("strict", "check", "gazetteer", "before", "against", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind as in BASE, then start."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at - len(LOCAL.search(text[max(done, at - 256) : at]).group())
        while start == at - 256 > done:  # a very long name: take it whole
            start = at - len(LOCAL.search(text[done:at]).group())
            break
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(("email", m.start(), m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m.group())) <= 15]
    return out


def votes(kind: str, text: str, start: int, end: int, strict: bool) -> tuple[int | None, ...]:
    """Votes of VOTERS on a span: 1 personal data, 0 not, None abstains."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    digits = "".join(DIGIT.findall(span))
    check = gazetteer = shape = None
    if kind == "card":
        check = int(luhn(digits))
        gazetteer = int(digits[:1] in "456" or digits[:2] in ("34", "37", "35") or digits[:1] == "2")
    elif kind == "phone":
        check = int(8 <= len(digits) <= 15)
        gazetteer = 1 if span.startswith("+") and digits[:1] != "0" else None
    elif kind == "ip":
        check = int(all(int(p[-3:] or 0) <= 255 for p in span.split(".")))
        gazetteer = 0 if digits[:1] == "0" else None
    elif kind == "ssn":
        check = int(span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000")
    elif kind == "iban":
        gazetteer = int(span[:2] in IBAN_COUNTRIES)
        moved = re.sub(" ", "", span[4:] + span[:4])
        check = int(int("".join(str(int(c, 36)) for c in moved)) % 97 == 1)
    elif kind == "email":
        end_label = re.split(r"[.\s)\]}]+", span)[-1].lower()
        gazetteer = 1 if end_label in DOMAIN_ENDS else (None if strict else 0)
        check = None if strict else int(bool(re.search(r"[(\[{](?:at|dot)[)\]}]", span, re.I)))
    elif kind == "secret":
        check = int(bool(digits) and bool(re.search("[A-Za-z]", span)))
    elif kind == "person":
        gazetteer = 1 if span.split()[0].lower() in GIVEN_NAMES else None
    if digits and kind not in ("email", "secret"):
        shape = 0 if len(set(digits)) <= 2 else None
    return (1 if strict else None, check, gazetteer, 1 if kind != "secret" and FOR[kind].search(before) else None, 0 if AGAINST.search(before) else None, shape)


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the looser patterns that touch no base span and, by kind as in KINDS, no earlier one."""
    taken = sorted((s, e) for _, s, e in base)
    out = []
    for kind in KINDS:
        if kind not in LOOSE:
            continue
        pattern, needs = LOOSE[kind]
        if not needs.search(text):
            continue
        for m in pattern.finditer(text):
            s, e = m.span(1)
            if not any(a < e and s < b for a, b in taken):
                out.append((kind, s, e))
                taken.append((s, e))
    return out


def _key(kind: str, v: tuple[int | None, ...]) -> str:
    return kind + ":" + "".join("-" if x is None else str(x) for x in v)


def _read(key: str) -> tuple[str, tuple[int | None, ...]]:
    kind, v = key.split(":")
    return kind, tuple(None if c == "-" else int(c) for c in v)


def _features(key: str) -> list[float]:
    kind, v = _read(key)
    return [float(kind == k) for k in KINDS] + [float(x == 1) for x in v] + [float(x == 0) for x in v]


def train(patterns: dict[str, int]) -> dict[str, float]:
    """Chance that a span is personal data, by pattern of kind and votes; counts as the whole corpus has them.

    There are at most len(KINDS) * 3^len(VOTERS) patterns.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    n = np.array([patterns[k] for k in keys], float)
    yes = [(0.6, 0.0), (0.6, 0.1), (0.5, 0.05), (0.2, 0.0), (0.0, 0.02), (0.0, 0.02)]
    no = [(0.02, 0.0), (0.15, 0.5), (0.1, 0.4), (0.03, 0.0), (0.0, 0.3), (0.0, 0.3)]
    votes_of = [_read(k)[1] for k in keys]
    model = LabelModel(0.5, yes, no, strength=50).fit(votes_of, n)
    posterior = model.posterior(votes_of)
    x = np.array([_features(k) for k in keys])
    w = logistic(x, posterior, n)
    p = 1 / (1 + np.exp(-(np.hstack([x, np.ones((len(x), 1))]) @ w)))
    return dict(zip(keys, p.tolist()))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base array, added array) of every whole text; elements are struct(kind, start, end) in code points.

    base: spans of the base patterns by kind, then start. added: what the classifier accepts besides, touching none of
    them. A null text counts as empty; null ids and repeated rows stay.
    """
    span = "array<struct<kind:string,start:long,end:long>>"
    keyed = "array<struct<kind:string,start:long,end:long,key:string>>"

    def propose(batches):
        import pyarrow as pa

        hold()
        three = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
        for b in batches:
            base, loose, keys = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                own = base_spans(text)
                base.append([dict(kind=k, start=s, end=e) for k, s, e in own])
                keys.append([_key(k, votes(k, text, s, e, True)) for k, s, e in own])
                loose.append([dict(kind=k, start=s, end=e, key=_key(k, votes(k, text, s, e, False))) for k, s, e in proposals(text, own)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(base, pa.list_(pa.struct(three))), pa.array(keys, pa.list_(pa.string())), pa.array(loose, pa.list_(pa.struct([*three, ("key", pa.string())])))],
                ["doc_id", "base", "base_keys", "loose"],
            )

    proposed = durable(ids_and_texts(docs).mapInArrow(propose, f"doc_id long, base {span}, base_keys array<string>, loose {keyed}"))
    every = proposed.select(F.explode(F.concat("base_keys", F.transform("loose", lambda x: x["key"]))).alias("key"))
    chances = train({r["key"]: r["n"] for r in every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()})
    accepted = sorted(k for k, p in chances.items() if p >= 0.5)
    good = F.array(*map(F.lit, accepted)).cast("array<string>")
    added = F.transform(F.filter("loose", lambda x: F.array_contains(good, x["key"])), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return proposed.select("doc_id", "base", added.alias("added"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def all_spans():
    """Base and added spans, by kind as in KINDS, then start."""
    both = F.concat("base", "added")
    return F.concat(*(F.array_sort(F.filter(both, _of_kind(k)), lambda a, b: (a["start"] - b["start"]).cast("int")) for k in KINDS))


def digest(found: DataFrame) -> DataFrame:
    """What find() returns, as counts of base spans, their digest, and all spans written out."""
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(all_spans()).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets, and n_chars set anew; the other columns stay.

    The spans come back to their rows by a hash of id and text, so ids may be shared or missing.
    """
    rows = docs.withColumn(ROW, row_key())
    found = find(rows.select(F.col(ROW).alias("doc_id"), "text"))
    spans = found.select(F.col("doc_id").alias(ROW), all_spans().alias("_spans")).where(F.size("_spans") > 0).dropDuplicates([ROW])

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, found in zip(texts, spans):
            if text is None or found is None or not len(found):
                out.append(text)
                continue
            at, parts = 0, []
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["end"] <= at:
                    continue
                parts += [text[at : max(at, s["start"])], f"[{s['kind'].upper()}]"]
                at = s["end"]
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    out = rows.join(spans, ROW, "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut("text", "_spans"))).drop("_spans")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)

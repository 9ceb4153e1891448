"""Personal data: fixed patterns, and terms that give away what the patterns protect.

The patterns yield the base spans. How much a term t says about a protected value e is measured
over the whole corpus: PMI(t; e) = log(N n(t, e) / (n(t) n(e))), as a share of the information of e
itself, log(N / n(e)); N, n(t), n(e) count documents, n(t, e) those with t near e. A share of 1
means that t comes with e only. Terms that surely disclose more than a threshold are generalised or,
above a second one, removed wherever they stand in a document with that value.

The share is a rise of P(e | t), and few documents make an unsure estimate of it. So a threshold
counts as passed if the lower confidence bound of the share passes it; see ``surely``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.llm.shared import Rows, documents, free_name, stored, text_or_empty, text_rows

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
ORDER = {kind: i for i, kind in enumerate((*KINDS, TERM))}
#: Words on either side of a value that count as near it.
NEAR = 5
#: Words of more letters go by a digest.
LONG_WORD = 64
#: Chance that a term below a threshold is taken to be above it.
RISK = 0.1
#: Shares of a value's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.5, 0.8
LEAST_LETTERS = 3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = regex.compile(r"\p{L}+")
#: What a generalised term is replaced by: a capital keeps the mark of a name.
GENERAL = ("<NAME>", "<WORD>")


class Span(NamedTuple):
    """Code points ``start`` to ``end``; ``action`` is empty for base spans."""

    kind: str
    start: int
    end: int
    action: str = ""


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each ``@``: its local part goes back to the last match at most."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = last = m.end()
            yield Span("email", start, end)
        at = text.find("@", end)


def ips(text: str) -> Iterator[Span]:
    """Chains of dotted numbers, four parts at a time from the left."""
    for chain in DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield Span("ip", at, end)
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield Span("card", m.start(), m.end())


def phones(text: str) -> Iterator[Span]:
    for m in PLUS.finditer(text):
        if 9 <= sum(c.isdecimal() for c in m.group()) <= 15:
            yield Span("phone", m.start(), m.end())


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns by start, then kind."""
    found = list(emails(text)) if "@" in text else []
    found += [*ips(text), *cards(text)]
    if "+" in text:
        found += phones(text)
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, ORDER[s.kind], s.end))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def value_of(span: Span, text: str) -> int:
    """A hash of the protected value: case and separators do not matter."""
    whole = text[span.start : span.end]
    if span.kind in ("card", "phone"):
        whole = "".join(c for c in whole if c.isdecimal())
    return hashed(f"{span.kind}:{whole.lower()}")


def surroundings(spans: list[Span], text: str) -> list[list[str]]:
    """The words near each span: whole words of the text, however far away and long they are."""
    places = [m.span() for m in WORD.finditer(text)] if spans else []
    starts, ends = [a for a, _ in places], [b for _, b in places]

    def words(some: list[tuple[int, int]]) -> list[str]:
        return [named(w) for a, b in some for w in WORD.findall(text[a:b].lower())]

    out = []
    for span in spans:
        before, after = bisect_right(ends, span.start), bisect_left(starts, span.end)
        out.append(words(places[max(0, before - NEAR) : before])[-NEAR:] + words(places[after : after + NEAR])[:NEAR])
    return out


def named(word: str) -> str:
    """The word, or a digest for a long one: it may stand near many values."""
    return word if len(word) <= LONG_WORD else "#" + hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


CONTEXTS = pa.schema([("doc_id", pa.int64()), ("entity", pa.int64()), ("context", pa.int64()), ("term", pa.string())])


def contexts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, entity, context, term) once for each document, protected value and word near it.

    ``context`` is a hash of all that stands near the value in this document. The term is NULL in
    one more row for each document and value.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(CONTEXTS, most=20_000)
        for doc_id, text in text_rows(batches, "doc_id", "text"):
            near: dict[int, list[str]] = {}
            spans = base_spans(text)
            for span, words in zip(spans, surroundings(spans, text), strict=True):
                near.setdefault(value_of(span, text), []).extend(words)
            for entity, found in near.items():
                context = hashed(" ".join(found))
                rows.add(doc_id, entity, context, None)
                for term in sorted({w for w in found if len(w) >= LEAST_LETTERS}):
                    rows.add(doc_id, entity, context, term)
            if len(rows.rows) >= rows.most:
                yield rows.take()
        yield rows.take()

    picked = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, entity bigint, context bigint, term string")


def document_counts(df: DataFrame, text_col: str) -> DataFrame:
    """term, n_t: documents that hold each word, over all whole texts."""
    own = F.array_distinct(F.split(F.lower(text_or_empty(text_col)), r"[^\p{L}]+"))
    word = F.col("word")
    term = F.when(F.length(word) <= LONG_WORD, word).otherwise(F.concat(F.lit("#"), F.sha2(word, 256))).alias("term")
    return df.select(F.explode(own).alias("word")).select(term).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def surely(threshold: float, n_all: Column, n_e: Column, more: Column, apart: Column, risk: float) -> Column:
    """Whether the lower confidence bound of a term's share passes a threshold.

    The share is 1 + log(P(e | t)) / log(N / n(e)), so that it passes where P(e | t) passes
    (n(e) / N) ^ (1 - threshold). The first surrounding with both only names the pair, as any rare word
    stands beside something; the evidence are ``more`` surroundings with both against ``apart``
    documents with t alone. Its chance at that probability is bounded as by Chernoff (exactly, if none
    is apart) and must be ``risk`` at most. Without a second surrounding nothing is sure.
    """
    least = F.pow(n_e / n_all, F.lit(1.0 - threshold))
    tries = more + apart
    alone = F.when(apart > 0, apart * F.log(apart / (tries * (1 - least)))).otherwise(0.0)
    sure = more * F.log(more / (tries * least)) + alone >= -math.log(risk)
    return F.when((least < 1) & (more > 0) & (more > tries * least), sure).otherwise(False)


def disclosures(df: DataFrame, near: DataFrame, text_col: str, *, risk: float, generalise: float, remove: float) -> DataFrame:
    """entity, terms: the terms that disclose it, each with its action.

    Exact copies are one surrounding, so that they add no evidence.
    """
    n_all = F.lit(df.count())
    by_context = near.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    both = by_context.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("contexts"))
    entities = both.filter("term is null").select("entity", F.col("n_te").alias("n_e"))
    # The bound of a pair with a single surrounding is zero whatever the counts of its term are.
    pairs = stored(both.filter(F.col("term").isNotNull() & (F.col("contexts") > 1)), "pairs")
    # Words are counted before they meet the pairs: a semi join would be moved below the count.
    known = pairs.join(document_counts(df, text_col), "term", "left").join(entities, "entity")
    n_t = F.greatest(F.coalesce("n_t", F.lit(0)), F.col("n_te"))
    evidence = (n_all, F.col("n_e"), F.col("contexts") - 1, n_t - F.col("n_te"), risk)
    action = F.when(surely(remove, *evidence), "remove").when(surely(generalise, *evidence), "generalise")
    return (
        known.withColumn("action", action)
        .filter("action is not null")
        .groupBy("entity")
        .agg(F.collect_set(F.struct("entity", "term", "action")).alias("terms"))
    )


def document_terms(near: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, terms: what discloses any value of the document."""
    own = near.filter("term is null").select("doc_id", "entity").join(found, "entity")
    return own.groupBy(F.col("doc_id").alias("__doc")).agg(F.flatten(F.collect_set("terms")).alias("__terms"))


def all_spans(text: str, terms: Iterable[dict] | None) -> list[Span]:
    """Base spans, and the words that disclose a value of this text, where no base span is."""
    base = base_spans(text)
    if terms is None or not len(terms) or not base:
        return base
    present = {value_of(s, text) for s in base}
    actions: dict[str, str] = {}
    for t in terms:
        if t["entity"] in present:
            actions[t["term"]] = max(actions.get(t["term"], ""), t["action"])  # "remove" comes after "generalise"
    if not actions:
        return base
    found, at = list(base), 0
    by_end = sorted(base, key=lambda s: s.end)
    for m in WORD.finditer(text):
        if not (action := actions.get(named(m.group().lower()))):
            continue
        while at < len(by_end) and by_end[at].end <= m.start():
            at += 1
        if all(s.start >= m.end() for s in by_end[at:]):
            found.append(Span(TERM, m.start(), m.end(), action))
    return in_order(found)


def sanitise(text: str, spans: list[Span]) -> str:
    """The text with base spans as ``<KIND>``, terms generalised or removed; overlaps count once."""
    out, at = [], 0
    for s in spans:
        if s.start < at:
            at = max(at, s.end)
            continue
        out.append(text[at : s.start])
        if s.kind != TERM:
            out.append(f"<{s.kind.upper()}>")
        elif s.action == "generalise":
            out.append(GENERAL[0] if text[s.start].isupper() else GENERAL[1])
        at = s.end
    return "".join([*out, text[at:]])


def with_terms(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    risk: float = RISK,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """All columns of ``df`` and last what discloses a protected value of the document."""
    near = stored(contexts(df, id_col, text_col), "contexts")
    found = disclosures(df, near, text_col, risk=risk, generalise=generalise, remove=remove)
    terms = stored(document_terms(near, found), "terms")
    return df.join(terms, df[id_col].eqNullSafe(terms["__doc"]), "left").select(
        *[df[c] for c in df.columns], terms["__terms"].alias(free_name(df, "__terms"))
    )


SPANS = pa.schema(
    [
        ("doc_id", pa.int64()),
        *((f"n_{k}", pa.int64()) for k in KINDS),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        ("n_term", pa.int64()),
    ]
)


def find_personal_data(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """One row per row of ``df``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    NULL and empty texts have no spans (base_sha256 of the empty text). Rows that repeat an id yield
    a row each; they share the terms of all their values, of which each text uses its own. Other
    columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(SPANS)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "__terms"))
            for doc_id, text, terms in zip(*columns, strict=True):
                spans = all_spans(text or "", terms)
                base = joined(s for s in spans if s.kind != TERM)
                counts = [sum(s.kind == k for s in spans) for k in (*KINDS, TERM)]
                whole = joined(spans)
                if rows.add(doc_id, *counts[:4], hashlib.sha256(base.encode()).hexdigest(), whole, counts[4], size=len(whole)):
                    yield rows.take()
        yield rows.take()

    picked = df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text"))
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_term bigint"
    return with_terms(picked, **limits).select("doc_id", "text", "__terms").mapInArrow(run, schema)


def sanitised(text: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([t if t is None else sanitise(t, all_spans(t, x)) for t, x in zip(text, terms, strict=True)], dtype=object)


def remove_personal_data(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """The rows and columns of ``df`` with personal data taken out of the text; NULL texts stay NULL."""
    found = with_terms(df, id_col=id_col, text_col=text_col, **limits)
    clean = F.pandas_udf(sanitised, "string")
    return found.withColumn(text_col, clean(F.col(text_col), F.col(found.columns[-1]))).select(*df.columns)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))

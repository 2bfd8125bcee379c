"""Personal data: base patterns, and information-theoretic sanitisation of what gives them away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct
value found is a protected entity. For the words of documents with an entity, document co-occurrence
over the whole corpus estimates disclosure: PMI(word; entity) over the entity's information content, which
is 1 when the word occurs only with the entity and 0 when it tells nothing. Words at or above
`REMOVE` are removed and those at or above `GENERALISE` are generalised to their shape, wherever
they occur: anywhere in a document, with the entity or without it.

Defined cases: a null text is an empty one, without spans; rows are judged one by one, so repeated
rows count as documents of their own; words inside base spans are no terms, and are not counted; an entity or pair found
in fewer than `SUPPORT` documents discloses nothing (one document is no co-occurrence estimate);
offsets are code points, ends exclusive; very long texts count whole; of a word tied with several
entities the highest score counts; an empty table gives no rows; other columns pass through or are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import Bloom, Words, codes_of, letters, pieces, span_hashes
from lexmill.session import free, stash

KINDS = ("email", "ip", "card", "phone")
SHORTEST, SUPPORT = 3, 2
REMOVE, GENERALISE = 0.95, 0.85
SMALL = 1 << 18  # bytes of a piece whose code points are hashed
HELD = 1 << 18  # sums a task holds before it sends them

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches end at their '@' part; the start is the first local character before it that no
    earlier match took. Found from '@' leftwards, so long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in _LOCAL_SET:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """By code point: its lower case, where that is one code point."""
    return np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)), np.uint32, 0x110000)


def words_of(texts: list[str], spans: list[list[tuple[str, int, int]]], shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, start, end) of the words (runs of letters) outside all spans of their text."""
    codes, bounds = codes_of(texts)
    words = Words(codes, bounds, ~letters())
    kept = words.ends - words.starts >= shortest
    for at, own in enumerate(spans):
        for _, a, b in own:
            lo = np.searchsorted(words.ends, bounds[at] + a, "right")
            kept[lo : np.searchsorted(words.starts, bounds[at] + b, "left")] = False
    starts, ends, doc = words.starts[kept], words.ends[kept], words.doc[kept]
    terms = span_hashes(lowered()[codes], starts, ends).view(np.int64)
    return terms, doc, starts - bounds[:-1][doc], ends - bounds[:-1][doc]


def _entity(kind: str, value: str) -> int:
    bare = value.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{bare}".encode(), digest_size=8).digest(), "little", signed=True)


NEAR = pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def detect_base(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, base, entities, terms): terms are the distinct
    words of texts with an entity. Given `terms`, in place of the last two text_sha, candidates and the
    text itself where a text has a word of them (or one that a Bloom filter of fixed size lets through),
    and sanitised_sha256, the digest of the sanitised text, where it has none."""
    ours = "text_sha string, candidates array<struct<term:long,start:long,end:long>>, held string, sanitised_sha256 string" if terms is not None else "entities array<long>, terms array<long>"
    names = [key, *(f"n_{k}" for k in KINDS), "base_sha256", "base", *(("entities", "terms") if terms is None else ("text_sha", "candidates", "held", "sanitised_sha256"))]
    held = None if terms is None else docs.sparkSession.sparkContext.broadcast(Bloom.build(terms, "term"))

    def listed(count: int, doc: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(count + 1)), pa.int32()), values)

    def run(batches):
        for batch in pieces(batches, text, SMALL):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            shown = [joined(x) for x in spans]
            columns = [pa.array([sum(k == kind for k, _, _ in x) for x in spans], pa.int64()) for kind in KINDS]
            columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown]), pa.array(shown, pa.string())]
            if held is None:
                found, doc, _, _ = words_of([t if x else "" for t, x in zip(texts, spans, strict=True)], spans)
                found, doc = _distinct(found, doc)
                columns += [pa.array([sorted({_entity(k, t[a:b]) for k, a, b in x}) for t, x in zip(texts, spans, strict=True)], pa.list_(pa.int64())), listed(len(texts), doc, pa.array(found))]
            else:
                every = words_of(texts, spans)
                some = Bloom.might_hold(held.value, every[0])
                found, doc, starts, ends = (x[some] for x in every)
                near = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (found, starts, ends)], fields=list(NEAR))
                hit = set(doc.tolist())
                columns += [pa.array([digest(t) if i in hit else None for i, t in enumerate(texts)], pa.string()), listed(len(texts), doc, near)]
                columns += [pa.array([t if i in hit else None for i, t in enumerate(texts)], pa.string())]
                columns += [pa.array([None if i in hit else digest(rewrite(t, [], x)) for i, (t, x) in enumerate(zip(texts, spans, strict=True))], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kept = docs.select(key, text)
    ddl = f"`{key}` {kept.schema[0].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, {ours}"
    return kept.mapInArrow(run, ddl)


def _distinct(terms: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term of each text once, by text."""
    order = np.lexsort((terms, doc))
    terms, doc = terms[order], doc[order]
    fresh = np.ones(len(terms), bool)
    fresh[1:] = (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])
    return terms[fresh], doc[fresh]


def _summed(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    term, at = np.unique(np.concatenate(terms), return_inverse=True)
    return term, np.bincount(at, np.concatenate(counts), len(term)).astype(np.int64)


def document_counts(docs: DataFrame, terms: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(term, n): documents of the whole corpus that hold each term of `terms`. A Bloom filter of
    fixed size keeps other words out of the shuffle; the join then makes the counts exact."""
    held = docs.sparkSession.sparkContext.broadcast(Bloom.build(terms, "term"))

    def run(batches):
        held_terms, held_counts, size = [], [], 0  # a task sends each term about once
        for batch in pieces(batches, text, SMALL):
            texts = [x or "" for x in batch.column(0).to_pylist()]
            hashes, doc, _, _ = words_of(texts, [base_spans(t) for t in texts], shortest)
            some = Bloom.might_hold(held.value, hashes)
            term, n = np.unique(_distinct(hashes[some], doc[some])[0], return_counts=True)
            held_terms.append(term)
            held_counts.append(n)
            size += len(term)
            if size > 2 * HELD:
                term, n = _summed(held_terms, held_counts)
                if len(term) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])
                    held_terms, held_counts, size = [], [], 0
                else:
                    held_terms, held_counts, size = [term], [n], len(term)
        if held_terms:
            term, n = _summed(held_terms, held_counts)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])

    return docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).join(terms.select("term"), "term", "left_semi")


def pair_counts(base: DataFrame, entities: DataFrame) -> DataFrame:
    """(term, entity, n_pair): documents that hold both, for entities in `entities` (and those that a
    Bloom filter of fixed size lets through). Pairs are summed in tasks before the shuffle."""
    held = base.sparkSession.sparkContext.broadcast(Bloom.build(entities, "entity"))

    def summed(kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        term, entity, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((term, entity))
        term, entity, n = term[order], entity[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (entity[1:] != entity[:-1])]))
        return term[heads], entity[heads], np.add.reduceat(n, heads)

    def run(batches):
        kept, size = [], 0
        for batch in batches:
            for own, terms in zip(batch.column(0), batch.column(1), strict=True):
                own, terms = own.values.to_numpy(zero_copy_only=False), terms.values.to_numpy(zero_copy_only=False)
                if not len(terms) or not len(own):
                    continue
                for entity in own[Bloom.might_hold(held.value, own)]:
                    kept.append((terms, np.full(len(terms), entity), np.ones(len(terms), np.int64)))
                    size += len(terms)
                    if size > 2 * HELD:
                        kept = [summed(kept)]
                        size = len(kept[0][0])
                        if size > HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], ["term", "entity", "n_pair"])
                            kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(kept)], ["term", "entity", "n_pair"])

    return base.select("entities", "terms").mapInArrow(run, "term long, entity long, n_pair long").groupBy("term", "entity").agg(F.sum("n_pair").alias("n_pair"))


def disclosures(docs: DataFrame, base: DataFrame, text: str = "text", support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(term, entity, disclosure) of pairs at or above `least`; base has the rows of docs with an entity
    at least."""
    entities = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = stash(entities.where(F.col("n_entity") >= support), "entities")
    pairs = stash(pair_counts(base, entities).where(F.col("n_pair") >= support), "pairs")
    terms = stash(pairs.select("term").distinct(), "terms")
    counts = document_counts(docs, terms, text)
    total = docs.count()
    content = -F.log2(F.col("n_entity") / F.lit(float(max(1, total))))
    score = F.when(content > 0, 1 + F.log2(F.col("n_pair") / F.col("n")) / content)
    return pairs.join(entities, "entity").join(counts, "term").withColumn("disclosure", score).where(F.col("disclosure") >= least).select("term", "entity", "disclosure")


def term_spans(base: DataFrame, found: DataFrame) -> DataFrame:
    """(text_sha, terms array<struct<start,end,disclosure>>) of texts with disclosing terms."""
    near = base.where("text_sha is not null").select("text_sha", "candidates").dropDuplicates(["text_sha"]).select("text_sha", F.explode("candidates").alias("c")).select("text_sha", "c.*")
    return near.join(found, "term").groupBy("text_sha").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))


def disclosing(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Base columns of each row, with its candidates, and the term spans by text_sha."""
    known = stash(detect_base(docs, key, text).where(F.size("entities") > 0).select("entities", "terms"), "pii-entities")
    found = stash(disclosures(docs, known, text).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "pii-terms")
    base = stash(detect_base(docs, key, text, found), "pii-base")
    return base, term_spans(base, found)


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", remove: float = REMOVE) -> DataFrame:
    """Base columns of each row with `spans`: base spans, then the method's (kind term); the number of
    terms, of those removed (the others are generalised), and the digest of the sanitised text."""
    base, extra = disclosing(docs, key, text)
    shown = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t.start, F.lit(":"), t.end)), ",")
    columns = [key, *(f"n_{k}" for k in KINDS), "base_sha256", F.concat_ws(",", F.nullif("base", F.lit("")), shown).alias("spans")]
    # Most rows have no candidate and so no key: they stay out of the join, which would deal them as one.
    bare = base.where("text_sha is null").withColumn("terms", F.lit(None).cast(extra.schema["terms"].dataType))
    bare = bare.select(*columns, F.lit(0).cast("long").alias("n_term"), F.lit(0).cast("long").alias("n_removed"), "sanitised_sha256")
    found = base.where("text_sha is not null").join(extra, "text_sha", "left").select(*columns, "held", "terms")
    names = bare.columns

    def run(batches):
        for batch in pieces(batches, "held"):
            told = []
            for t, terms in zip(batch.column(len(names) - 3).to_pylist(), batch.column(len(names) - 2).to_pylist(), strict=True):
                terms = [(x["start"], x["end"], x["disclosure"]) for x in terms or []]
                told.append((len(terms), sum(d >= remove for *_, d in terms), digest(rewrite(t, terms, remove=remove))))
            n, removed, sha = zip(*told, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 3], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], names)

    return found.mapInArrow(run, bare.schema).unionByName(bare)


def shape(word: str) -> str:
    """A word generalised: its length class and capitalisation only."""
    return ("X" if word[:1].isupper() else "x") + ("" if len(word) < 6 else "+")


def rewrite(text: str, terms: list[tuple[int, int, float]], spans: list[tuple[str, int, int]] | None = None, remove: float = REMOVE) -> str:
    """The text with base spans replaced by their kinds, and terms removed or generalised."""
    cuts = [(a, b, f"[{k.upper()}]") for k, a, b in (base_spans(text) if spans is None else spans)]
    cuts += [(a, b, "[…]" if d >= remove else f"[{shape(text[a:b])}]") for a, b, d in terms]
    out, at = [], 0
    for a, b, by in sorted(cuts):
        if b <= at:
            continue
        out += [text[at : max(a, at)], by]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `text` sanitised (null stays null)."""
    row, sha, terms_ = free(docs, "row", "sha", "terms")
    extra = disclosing(docs.select(F.lit(0).alias(row), text), row, text)[1].withColumnsRenamed({"text_sha": sha, "terms": terms_})
    keyed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).join(extra, sha, "left")
    given = keyed.select(*docs.columns, terms_)
    at = docs.columns.index(text)

    def run(batches):
        for batch in pieces(batches, text):
            new = [None if t is None else rewrite(t, [(x["start"], x["end"], x["disclosure"]) for x in terms or []]) for t, terms in zip(batch.column(at).to_pylist(), batch.columns[-1].to_pylist(), strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    return given.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return detect(docs)


def disclosure(n_pair: int, n_term: int, n_entity: int, total: int) -> float | None:
    """The score of one pair, for reference."""
    content = -math.log2(n_entity / total)
    return 1 + math.log2(n_pair / n_term) / content if content > 0 else None

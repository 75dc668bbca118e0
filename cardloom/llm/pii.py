"""Personal data: patterns with checks, and information-theoretic sanitisation of the terms that give them away.

The protected entities are the values that the patterns find. A term that stands near an entity discloses it as far as
PMI(term; entity) comes up to the entity's own information content: at 1, to read the term is to know the entity. All
counts are of different texts of the whole corpus, so copies weigh nothing, and P(entity | term) is smoothed towards
P(entity), so few texts prove little. Terms over the threshold become spans of their own and are generalised in
the sanitised text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, fresh, per_batch, per_partition, scratch, texts_of, words_of

#: Kinds in the order of spans that start together; the method's own kind comes last.
KINDS = ("email", "ip", "card", "phone", "term")
#: What sanitise adds.
COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans", "clean_text")
#: Words on each side of an entity, texts with a term that weigh as much as what is known without it, and the share of
#: the entity's information that a term may not reach.
WINDOW, SUPPORT, DISCLOSURE = 5, 3, 0.75
#: One text of so many is read first, to settle what is frequent.
PART = 8
#: Disclosing terms that may be broadcast, and their bytes; more are joined. Likewise hashes of repeated texts.
MOST_BROADCAST, MOST_BYTES = 100_000, 8 << 20
_BITS = 1 << 20

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match starts and ends with a run of digits, so each run is read a few times
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ANY = re.compile(rb"[@0-9]")  # without one of these a text holds no pattern
_NONE, _NO_SPANS = [0] * 5, hashlib.sha256(b"").hexdigest()
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Checked matches, leftmost and non-overlapping per kind, by start and then kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:  # the local part holds no @, so it is the run that ends at one
        run = at
        while run > end and _LOCAL.match(text, run - 1, run):
            run -= 1
        if run < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((run, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) < 4 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
        out.sort()
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def normal(word: str) -> str:
    """A term as counted: without marks at its ends, in lower case; empty if no letter is in it."""
    word = _EDGE.sub("", word).lower()
    return word if any(map(str.isalpha, word)) else ""


def entity(text: str, span: Span) -> str:
    raw = text[span[0] : span[2]]
    return f"{KINDS[span[1]]}:{raw.lower() if span[1] == 0 else raw if span[1] == 1 else _NOT_DIGIT.sub('', raw)}"


def free_words(text: str, spans: list[Span]) -> Iterator[tuple[int, int, str]]:
    """Words outside all spans, with their places."""
    i = 0
    by_end = sorted((a, b) for a, _, b in spans)
    for m in _WORD.finditer(text):
        while i < len(by_end) and by_end[i][1] <= m.start():
            i += 1
        if not any(a < m.end() and m.start() < b for a, b in by_end[i : i + 8]):
            yield m.start(), m.end(), m[0]


def beside(text: str, spans: list[Span]) -> Iterator[tuple[list[str], list[str]]]:
    """The WINDOW terms before and after each span, however far; what no span covers is cut into words once."""
    starts, terms, at = [], [], 0
    for a, _, b in [*spans, (len(text), 0, len(text))]:
        for m in _WORD.finditer(text, at, max(at, a)):
            if w := normal(m[0]):
                starts.append(m.start())
                terms.append(w)
        at = max(at, b)
    for a, _, b in spans:
        i, k = bisect_left(starts, a), bisect_left(starts, b)
        yield terms[max(0, i - WINDOW) : i], terms[k : k + WINDOW]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text")).withColumn("text_id", F.xxhash64("text"))


def _contexts(docs: DataFrame) -> DataFrame:
    """entity, term, text_id for the terms near each mention; the term is null once for each mention."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows: list[tuple[str, str | None, int]] = []
            for raw, own in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                if not _ANY.search(raw):
                    continue
                text = raw.decode()
                spans = base_spans(text)
                for span, (before, after) in zip(spans, beside(text, spans)):
                    e = entity(text, span)
                    rows += [(e, t, own) for t in {None, *before, *after}]
            es, ts, ids = zip(*rows) if rows else ((), (), ())
            return {"entity": pa.array(es, pa.string()), "term": pa.array(ts, pa.string()), "text_id": pa.array(ids, pa.int64())}

        return step

    return per_batch(_texts(docs).select("text", "text_id"), "entity string, term string, text_id long", make)


def _bitmap(terms: DataFrame) -> np.ndarray:
    """_BITS bits with those of the terms' hashes set: 128 KB whatever the number of terms."""
    bits = np.zeros(_BITS, bool)
    slots = terms.select(F.pmod(F.xxhash64("term"), F.lit(_BITS)).alias("slot"))
    rows = slots.selectExpr("slot div 64 as at", "shiftleft(1L, cast(slot % 64 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    for at, word in rows:
        bits[at * 64 : at * 64 + 64] = [word >> k & 1 for k in range(64)]
    return bits


def _slot(term: str) -> int:
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return h % _BITS


def _term_of(word: bytes, table: np.ndarray) -> str:
    """The word as a term if its bit is set, else nothing."""
    t = normal(word.decode())
    return t if t and table[_slot(t)] else ""


def disclosing(docs: DataFrame, support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """term, disclosure of the terms that give some entity away, from all documents; equal texts count as one."""
    with scratch() as kept:
        kept.append(out := Saved(_disclosing(docs, support, threshold), "disclosing"))
    return out.df


def _disclosing(docs: DataFrame, support: int, threshold: float) -> DataFrame:
    seen = Saved(_contexts(docs).distinct(), "contexts")
    pairs = Saved(seen.df.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c")), "counts").df
    seen.drop()
    mentions = pairs.filter("term is null").select(F.col("entity").alias("own"), F.col("c").alias("n_entity"))
    near = pairs.filter(F.col("term").isNotNull())
    near = Saved(near.join(mentions, F.col("entity") == F.col("own")).select("entity", "term", "c", "n_entity"), "pairs").df
    terms = near.select("term").distinct()
    if terms.isEmpty():
        return terms.select("term", F.lit(0.0).alias("disclosure")).limit(0)
    # A text's copies share the count of one among them.
    texts = _texts(docs)
    ids = Saved(texts.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")), "text_ids").df
    copies = Saved(ids.filter("n > 1"), "copies").df
    weighed = texts.join(F.broadcast(copies) if copies.count() <= MOST_BROADCAST else copies, "text_id", "left").select("text", "text_id", (1.0 / F.coalesce("n", F.lit(1))).alias("weight"))
    prior = F.col("n_entity") / F.lit(float(ids.count()))
    # Of more texts than this, a term says too little of the entity. Most words are in more already among a part of the texts, which
    # settles them: they needn't be counted in all.
    most = F.when(prior < 1, (F.col("c") + support * prior) * F.pow(prior, F.lit(threshold - 1)) - support).otherwise(-1.0)
    near = Saved(near.withColumn("most", most + 1e-6).filter("most >= c"), "possible").df
    terms = near.groupBy("term").agg(F.max("most").alias("most"))
    part = _counts(weighed.filter(F.pmod("text_id", F.lit(PART)) == 0), terms).withColumnRenamed("n_term", "seen")
    terms = Saved(terms.join(part, "term", "left").filter("coalesce(seen, 0) <= most").select("term"), "open").df
    # A term that only touches its entity is in no text as a word, so c may exceed n_term.
    given = (F.col("c") + support * prior) / (F.greatest("c", "n_term") + support)
    share = F.when(prior < 1, F.log2(given / prior) / -F.log2(prior)).otherwise(0.0)
    counted = near.join(terms, "term", "left_semi").join(_counts(weighed, terms), "term")
    return counted.withColumn("share", share).filter(F.col("share") >= threshold).groupBy("term").agg(F.max("share").alias("disclosure"))


def _counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_term: in how many of texts(text, weight) each of the terms is a word; others that share its bit may come along."""
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table, asked, met = bits.value, {}, {}
        for batch in batches:
            for raw, weight in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                for t in {asked[w] if w in asked else asked.setdefault(w, _term_of(w, table)) for w in set(words_of(raw))} - {""}:
                    met[t] = met.get(t, 0.0) + weight
                if len(asked) > 300_000:
                    asked.clear()
            if len(met) > 300_000:
                yield {"term": pa.array(met, pa.string()), "n": pa.array(met.values(), pa.float64())}
                met = {}
        yield {"term": pa.array(met, pa.string()), "n": pa.array(met.values(), pa.float64())}

    return per_partition(texts.select("text", "weight"), "term string, n double", count).groupBy("term").agg(F.round(F.sum("n")).alias("n_term"))


def _spans(raw: bytes, text: str, terms, asked: dict[bytes, bool]) -> list[Span]:
    """asked keeps which words are among the terms."""
    spans = base_spans(text) if _ANY.search(raw) else []
    if terms and any([asked[w] if w in asked else asked.setdefault(w, normal(w.decode()) in terms) for w in set(words_of(raw))]):
        spans = sorted([*spans, *((a, 4, b) for a, b, w in free_words(text, spans) if normal(w) in terms)])
    return spans


def sanitised_text(text: str, spans: list[Span]) -> str:
    """Each span's text gives way to its kind; of overlapping spans, to that of the first."""
    out, end = [], 0
    for a, k, b in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _words(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """_key and term for the different words of each text whose bit is set."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            keys, terms = [], []
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                own = [*({_term_of(w, shared.value) for w in set(words_of(text))} - {""})]
                keys += [key] * len(own)
                terms += own
            return {"_key": pa.array(keys, pa.int64()), "term": pa.array(terms, pa.string())}

        return step

    return per_batch(rows, "_key long, term string", make)


def sanitise(docs: DataFrame, support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """All columns of docs, then counts, spans and the sanitised text as columns n_email, n_ip, n_card, n_phone,
    n_term, base_sha256, spans and clean_text; columns of docs with these names are left out.

    Null texts count as empty and stay null in clean_text. Spans are in code points, ends exclusive, by start and then
    kind. Repeated rows are each treated, null ids stay. A corpus without personal data has no disclosing terms.
    """
    terms = disclosing(docs, support, threshold).select("term")
    own = COLUMNS
    keep = [c for c in docs.columns if c.lower() not in own]
    number, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    few = number <= MOST_BROADCAST and size <= MOST_BYTES
    listed = docs.select(*(F.col(f"`{c}`") for c in keep))
    if few:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in terms.collect()))
    else:  # each row gets those of its own words that disclose, by a join
        row, own_ = fresh("_key", keep), fresh("_terms", keep)
        key = F.xxhash64(*(F.col(f"`{c}`") for c in keep if dict(docs.dtypes)[c][:3] != "map"))
        met = _words(docs.select(key.alias("_key"), F.col("text").cast("string").alias("text")), _bitmap(terms)).join(terms, "term").groupBy(F.col("_key").alias(row)).agg(F.collect_set("term").alias(own_))
        listed = listed.withColumn(row, key).join(met, row, "left").drop(row)

    def make():
        asked: dict[bytes, bool] = {}

        def step(batch: pa.RecordBatch) -> dict:
            names = batch.schema.names
            own_terms = batch.column(names.index(own_)).to_pylist() if not few else None
            counts, digests, lists, texts = [], [], [], []
            column = batch.column(names.index("text"))
            for i, (raw, there) in enumerate(zip(texts_of(column), column.is_valid().to_pylist())):
                if not few or len(asked) > 300_000:
                    asked.clear()
                text = raw.decode()
                spans = _spans(raw, text, shared.value if few else frozenset(own_terms[i] or ()), asked)
                counts.append([sum(s[1] == k for s in spans) for k in range(5)] if spans else _NONE)
                digests.append(hashlib.sha256(joined([s for s in spans if s[1] < 4]).encode()).hexdigest() if spans else _NO_SPANS)
                lists.append(joined(spans))
                texts.append(None if not there else sanitised_text(text, spans) if spans else text)
            n = np.array(counts, np.int64)
            return {c: batch.column(names.index(c)) for c in keep} | {c: n[:, k] for k, c in enumerate(own[:5])} | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(lists, pa.string()), "clean_text": pa.array(texts, pa.string())}

        return step

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in own[:5]), *(f"{c} string" for c in own[5:])])
    return per_batch(listed, schema, make)

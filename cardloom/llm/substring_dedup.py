"""Substring dedup: words in windows that also start earlier are removed; each recurring window's first start stays.

Every window of WINDOW words is assigned to one of its phrases of PHRASE words, the one with the least hash (the
leftmost on ties), so equal windows share their phrase wherever they stand, and several windows in a row share one. The
words that these windows cover are the phrase's context there. Each step is over all documents:

1. Phrases are counted; those that occur twice or more are confirmed, with whether they always stand in one context.
2. The confirmed phrases come back to their documents. Documents are streamed by SHARD bytes; each shard compiles
   those of its own documents into an Aho-Corasick automaton, which locates every occurrence.
3. Equal contexts recur as a whole: all places but the first are removed. Only the first places of contexts whose
   phrase has others too, at the rims of passages, are judged window by window.
4. What is removed comes back to the documents, and the texts are cut.

Phrases are found by 64-bit hashes, where a chance equality costs work only; contexts and windows are told apart by 128
bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, per_batch, per_partition, scratch, texts_of, words_of

WINDOW, PHRASE = 20, 12
#: Bytes of text that share an automaton.
SHARD = 6_000_000
#: Letters in each alphabet of an automaton's words.
_FAN = 64
#: Words hashed at once.
_WORDS = 400_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_powers: dict[int, np.ndarray] = {}
_NO_ID = (1 << 63) - 1


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 4096), base, np.uint64))])
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Places:
    """The windows of some texts by phrase, all texts laid end to end: at is the phrase's place, low the first window's
    start, count the number of windows, text the text's number; starts are the texts' first places.
    """

    def __init__(self, texts: list[list[bytes]]):
        size = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        n = int(self.starts[-1])
        h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(texts)), np.uint64, n)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _power(b, n))]) for b in _BASES]
        inside = np.repeat(self.starts[1:], size) - np.arange(n) >= WINDOW
        if not inside.any():
            self.low = self.count = self.at = self.text = self.phrase = np.zeros(0, np.int64)
            return
        phrase = self.hashes(np.arange(n - PHRASE + 1), PHRASE)
        windows = np.lib.stride_tricks.sliding_window_view(phrase, WINDOW - PHRASE + 1)
        start = np.flatnonzero(inside)
        chosen = windows.argmin(axis=1)[start] + start
        first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        self.low, self.at = start[first], chosen[first]
        self.count = np.diff(np.r_[first, len(chosen)])
        self.text = np.searchsorted(self.starts, self.low, side="right") - 1
        self.phrase = phrase[self.at].view(np.int64)

    def hashes(self, start: np.ndarray, size, which: int = 0) -> np.ndarray:
        """Of the words from each start on; equal words give equal hashes wherever they stand."""
        if not len(start):
            return np.zeros(0, np.uint64)
        sums = self.sums[which]
        return _mixed((sums[start + size] - sums[start]) * _power(_INVERSES[which], int(start.max()) + 1)[start])

    def contexts(self, which: int = 0, x=slice(None)) -> np.ndarray:
        """Of the words that the windows of a phrase cover, and where among them it stands."""
        form = ((self.at[x] - self.low[x]) * (WINDOW + 1) + self.count[x]).astype(np.uint64)
        return _mixed(self.hashes(self.low[x], WINDOW - 1 + self.count[x], which) + form * np.uint64(_INVERSES[which])).view(np.int64)


def _chunks(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """First and end of runs of texts of some _WORDS words."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n < _WORDS):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


def _counted(rows: DataFrame) -> DataFrame:
    """phrase, n and the least and greatest context, for each batch of rows."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [words_of(t) for t in texts_of(batch.column(0))]
            parts = [(p.phrase, p.contexts()) for p in (Places(texts[k:m]) for k, m in _chunks(texts)) if len(p.phrase)]
            phrase, context = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
            order = np.argsort(phrase)
            phrase, context = phrase[order], context[order]
            first = np.flatnonzero(np.r_[True, phrase[1:] != phrase[:-1]]) if len(phrase) else np.zeros(0, np.int64)
            least, most = (f.reduceat(context, first) if len(first) else context for f in (np.minimum, np.maximum))
            return {"phrase": phrase[first], "n": np.diff(np.r_[first, len(phrase)]), "least": least, "most": most}

        return step

    return per_batch(rows.select("text"), "phrase long, n long, least long, most long", make)


def _asked(rows: DataFrame) -> DataFrame:
    """doc, text_id, phrase: the different phrases of each row."""

    def make():
        def step(batch: pa.RecordBatch):
            texts = [words_of(t) for t in texts_of(batch.column(2))]
            doc, text_id = (batch.column(c).to_numpy() for c in (0, 1))
            for k, m in _chunks(texts):
                p = Places(texts[k:m])
                order = np.lexsort((p.phrase, p.text))
                text, phrase = p.text[order], p.phrase[order]
                new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (phrase[1:] != phrase[:-1])]) if len(text) else np.zeros(0, np.int64)
                row = k + text[new]
                yield {"doc": doc[row], "text_id": text_id[row], "phrase": phrase[new]}

        return step

    return per_batch(rows.select("doc", "text_id", "text"), "doc long, text_id long, phrase long", make)


class _Letters(dict):
    """The words of phrases as short strings. Each place of a string, and the last one, has an alphabet of its own, so that
    matches begin and end with words, and no node of the automaton has more than a few children, which are searched
    one by one.
    """

    def __missing__(self, word: bytes) -> str:
        n, out, place = len(self), [], 0
        while n or not out:
            n, digit = divmod(n, _FAN)
            out.append(chr(1 + (2 * place + (n == 0)) * _FAN + digit))
            place += 1
        self[word] = code = "".join(out)
        return code


def _merged(rows: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, with adjoining ones of a row put together."""
    order = np.lexsort((low, rows))
    rows, low, count = rows[order], low[order], count[order]
    if not len(rows):
        return rows, low, count
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (low[1:] != low[:-1] + count[:-1])])
    return rows[first], low[first], np.add.reduceat(count, first)


#: A text and the facts that came with it: doc, text_id, text, then an array for each kind of fact.
Met = tuple[int, int, bytes, list[np.ndarray]]


def _beside(rows: DataFrame, facts: DataFrame, run: Callable[[Iterator[Met]], Iterable[dict]], schema: str) -> DataFrame:
    """run over each partition's rows(doc, text_id, text), each with its facts(doc, text_id, and longs).

    Both are dealt by the row's key and sorted, facts first, so that a row is met with its facts while they stream by:
    no more than a row with its facts is held here.
    """
    names = [c for c in facts.columns if c not in ("doc", "text_id")]
    left = rows.select("doc", "text_id", F.lit(1).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in names), "text")
    both = facts.select("doc", "text_id", F.lit(0).alias("kind"), *names, F.lit("").alias("text")).unionByName(left)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[Met]:
        now, held = None, []
        for batch in batches:
            doc, text_id, kind, *values = (c.to_numpy() for c in batch.columns[:-1])
            cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text_id[1:] != text_id[:-1]), True])
            texts = batch.column(batch.num_columns - 1)
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                key = int(doc[i]), int(text_id[i])
                if key != now:
                    now, held = key, []
                f = i + int(np.searchsorted(kind[i:j], 1))
                if f > i:
                    held.append([v[i:f] for v in values])
                for text in texts_of(texts.slice(f, j - f)):
                    yield *key, text, [np.concatenate(v) for v in zip(*held)] if held else [np.zeros(0, np.int64)] * len(values)

    return per_partition(both.repartition("doc", "text_id").sortWithinPartitions("doc", "text_id", "kind"), schema, lambda batches: run(met(batches)))


def _located(held: list[Met]) -> Iterator[dict]:
    """Of a shard: runs of windows to remove (a null), and the first place of each context (a, b) in the shard, with its windows'
    hashes where the phrase has other contexts too.
    """
    doc, text_id = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
    known, one = np.unique(np.concatenate([h[3][0] for h in held]), return_index=True)
    same = np.concatenate([h[3][1] for h in held])[one] == 1
    every = [words_of(h[2]) for h in held]
    letters, automaton = _Letters(), ahocorasick.Automaton(ahocorasick.STORE_INTS)
    compiled = np.zeros(len(known), bool)
    parts = []
    for i, j in _chunks(every):  # the words of each phrase, from where it first stands in this shard
        p = Places(every[i:j])
        parts.append((i, p))
        number = np.minimum(np.searchsorted(known, p.phrase), len(known) - 1)
        new = np.flatnonzero((known[number] == p.phrase) & ~compiled[number])
        for x, k in zip(new.tolist(), number[new].tolist()):
            if not compiled[k]:
                compiled[k] = True
                t = int(p.text[x])
                at = int(p.at[x] - p.starts[t])
                automaton.add_word("".join([letters[w] for w in every[i + t][at : at + PHRASE]]), k)
    if not compiled.any():
        return
    automaton.make_automaton()
    find, found = letters.get, []
    for i, p in parts:
        located = np.full(int(p.starts[-1]), -1)
        for t in range(len(p.starts) - 1):
            codes = [find(w, "\0") for w in every[i + t]]
            hits = list(automaton.iter("".join(codes)))
            if hits:
                ends, numbers = np.array(hits).T
                last = np.searchsorted(np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes))), ends + 1)
                located[p.starts[t] + last + 1 - PHRASE] = numbers
        x = np.flatnonzero(located[p.at] >= 0) if len(p.at) else np.zeros(0, np.int64)
        rim = ~same[located[p.at[x]]]
        many = p.count[x][rim]
        start = np.repeat(p.low[x][rim], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        windows = [p.hashes(start, WINDOW, w).view(np.int64) for w in (0, 1)]
        found.append((i + p.text[x], p.low[x] - p.starts[p.text[x]], p.count[x], p.contexts(0, x), p.contexts(1, x), rim, *windows))
    row, low, count, a, b, rim, wa, wb = map(np.concatenate, zip(*found))
    # of a context's places, the shard's first is to be judged; later ones go at once
    order = np.lexsort((low, doc[row], b, a))
    lead = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(order) else np.zeros(0, bool)
    head = order[lead][np.cumsum(lead) - 1]
    first = np.zeros(len(order), bool)
    first[order] = (doc[row[order]] == doc[row[head]]) & (low[order] == low[head])
    gone_row, gone_low, gone_count = _merged(row[~first], low[~first], count[~first])
    own = np.where(rim, count, 0)
    kept = np.repeat(first, own)
    offsets = pa.array(np.concatenate([np.zeros(len(gone_row) + 1, np.int64), np.cumsum(own[first])]), pa.int32())
    rows = np.concatenate([gone_row, row[first]])
    settled = np.arange(len(rows)) < len(gone_row)
    yield {
        "doc": doc[rows], "text_id": text_id[rows], "low": np.concatenate([gone_low, low[first]]), "count": np.concatenate([gone_count, count[first]]),
        "a": pa.array(np.concatenate([gone_low, a[first]]), pa.int64(), mask=settled), "b": pa.array(np.concatenate([gone_low, b[first]]), pa.int64(), mask=settled),
        "wa": pa.ListArray.from_arrays(offsets, pa.array(wa[kept])), "wb": pa.ListArray.from_arrays(offsets, pa.array(wb[kept])),
    }


def _shards(rows: Iterator[Met]) -> Iterator[dict]:
    held, size = [], 0
    for row in rows:
        if len(row[3][0]):
            held.append(row)
            size += len(row[2])
            if size >= SHARD:
                yield from _located(held)
                held, size = [], 0
    if held:
        yield from _located(held)


def _cut(with_text: bool) -> Callable[[Iterator[Met]], Iterator[dict]]:
    def put(out: list[tuple]) -> dict:
        doc, n, gone, digest, text = zip(*out)
        cols = {"doc": pa.array(doc, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return cols | ({"kept_text": pa.array(text, pa.binary()).cast(pa.string())} if with_text else {})

    def run(rows: Iterator[Met]) -> Iterator[dict]:
        out, size = [], 0
        for doc, _, text, (low, count) in rows:
            words = words_of(text)
            n = len(words)
            if len(low):
                keep = np.ones(n, bool)
                for a, b in zip(low.tolist(), (low + count - 1 + WINDOW).tolist()):
                    keep[a:b] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            kept = b" ".join(words)
            out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept if with_text else b""))
            size += 100 + len(out[-1][4])
            if size > 4_000_000:
                yield put(out)
                out, size = [], 0
        if out:
            yield put(out)

    return run


def _first() -> Column:
    return F.min(F.struct("doc", "low")).alias("first")


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with_text) kept_text for every row of docs(doc_id, text, ...).

    Null texts count as empty, texts of fewer than WINDOW words lose nothing, other columns are not read. Rows without
    a doc_id come after all others and count as one document, as do rows that share a doc_id: windows that start
    at the same place of it don't remove each other. No rows are dropped, an empty table gives none. A row is known
    by its doc_id and its text's hash, so rows that repeat are treated alike.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    with scratch() as kept:
        counts = _counted(rows).groupBy("phrase").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        known = Saved(counts.filter("n > 1").select("phrase", (F.col("least") == F.col("most")).cast("long").alias("same")), "phrases").df
        met = Saved(_asked(rows).join(known, "phrase").select("doc", "text_id", "phrase", "same"), "met")
        places = Saved(_beside(rows, met.df, _shards, "doc long, text_id long, low long, count long, a long, b long, wa array<long>, wb array<long>"), "places")
        met.drop()
        open_ = places.df.filter("a is not null")
        least = open_.groupBy("a", "b").agg(_first())
        later = (F.struct("doc", "low") > F.col("first")).alias("later")
        judged = Saved(open_.join(least, ["a", "b"]).select("doc", "text_id", "low", "count", "wa", "wb", later), "judged")
        rims = judged.df.filter("not later and size(wa) > 0")
        windows = rims.select("doc", "text_id", "low", F.posexplode(F.arrays_zip("wa", "wb"))).select("doc", "text_id", (F.col("low") + F.col("pos")).alias("low"), "col.wa", "col.wb")
        least = windows.groupBy("wa", "wb").agg(_first(), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        again = windows.join(least, ["wa", "wb"]).filter(later).select("doc", "text_id", "low", F.lit(1).cast("long").alias("count"))
        whole = judged.df.filter("later").unionByName(places.df.filter("a is null"), allowMissingColumns=True).select("doc", "text_id", "low", "count")
        runs = Saved(whole.unionAll(again), "runs")
        kept.append(runs)
    out = _beside(rows, runs.df, _cut(with_text), "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return out.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), *out.columns[1:])


def oracle_sql() -> str:
    """The same rows in DuckDB SQL, window by window; windows are compared as words."""
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d)),
least AS (SELECT k, min({{'d': doc_id, 's': s}}) AS f FROM win GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, s FROM win JOIN least USING (k) WHERE {{'d': doc_id, 's': s}} > f),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

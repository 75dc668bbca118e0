"""Toxicity: a Levenshtein automaton over a lexicon trie finds abusive terms however misspelled, and the words around
each hit tell quotation from abuse.

The lexicon is learned: terms (whole words, or stems with any ending) that stand almost only in lines of toxic
documents. Its trie and the Levenshtein automaton are walked together: a state is a set of (trie node, edits spent),
built when first met, so a word is read once, whatever the size of the lexicon. A hit's window of words gives its
context; a logistic regression weighs hits, edits, quotation and context into the document's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, fresh, per_batch, texts_of
from .learning import labelled, logistic, remainder

#: The lexicon and the weights are fitted on at most so many labelled documents, whose terms bound the lexicon.
TRAIN_DOCS = 20_000
#: A term must stand in so many different lines, of which this share is toxic.
MIN_LINES, MIN_SHARE = 4, 0.9
#: A stem must begin so many different words of toxic lines.
FAMILY = 4
WINDOW = 5
THRESHOLD = 0.7
STEMS = (4, 5, 6)
#: Words as short as this must match exactly; longer ones may have one edit, and from the second bound two.
EXACT_BELOW, TWO_FROM = 5, 9

#: Words that mark speech reported or discussed, words that address a reader, and quotation marks.
REPORTING = frozenset("said says say wrote writes write called calls quote quoted quotes word words term terms insult insults slur phrase sagte schrieb nannte wort dit écrit appelé mot dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your yours you're youre u are du dein ihr tu ton vous votre tú usted eres es".split())
QUOTES = "\"'“”„‘’«»‹›`"
#: Characters written for letters.
_AS_LETTER = str.maketrans("013457@$!", "oieastasi")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NOT_LETTER = re.compile(r"[\W\d_]+")

#: All but quoted and reported are of direct hits: those neither within quotation marks nor beside a word of reporting.
FEATURES = ("hits", "exact", "terms", "total", "edit_1", "edit_2", "stems", "addressed", "rate", "weight", "any", "quoted", "reported")
#: What is held of the context before any document is seen: quoted and reported terms tell against abuse, a reader addressed for it.
PRIOR = {"addressed": 0.5, "quoted": -1.0, "reported": -1.0}


def normal(word: str) -> str:
    """The letters of a word, lower-cased, with the usual substitutes read as letters."""
    word = _EDGE.sub("", word).lower()
    if word.isalpha():
        return word
    return _NOT_LETTER.sub("", word.translate(_AS_LETTER)) if any(map(str.isalpha, word)) else ""


class Matcher:
    """Terms within a bounded number of edits of a word, by a lazily built product of trie and Levenshtein automaton."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.whole: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        for terms, ends in ((words, self.whole), (stems, self.stem)):
            for term, weight in terms.items():
                at = 0
                for c in term:
                    at = self.child[at].setdefault(c, len(self.child))
                    if at == len(self.child):
                        self.child.append({})
                ends[at] = weight
        self.moves: list[dict[str, int]] = []
        self.states: list[frozenset[tuple[int, int]]] = []
        self.known: dict[frozenset, int] = {}
        self.starts = [self._state({(0, 0)}, k) for k in range(3)]
        self.seen: dict[str, tuple[float, int, bool] | None] = {}

    def _state(self, pairs: Iterable[tuple[int, int]], limit: int) -> int:
        """The pairs and all that skipping letters of the term reaches; -1 is the dead state."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, spent = todo.pop()
            if spent > limit or best.get(node, 99) <= spent:
                continue
            best[node] = spent
            todo += [(n, spent + 1) for n in self.child[node].values()]
        if not best:
            return -1
        key = frozenset(best.items()) | {(-1, limit)}
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        pairs, limit = [], 0
        for node, spent in self.states[state]:
            if node == -1:
                limit = spent
                continue
            for letter, n in self.child[node].items():
                pairs.append((n, spent + (letter != c)))
            pairs.append((node, spent + 1))
        if len(self.states) > 200_000:  # the automaton is rebuilt as needed, so its memory stays bounded
            keep = self.states[state]
            self.states, self.moves, self.known = [], [], {}
            self.starts = [self._state({(0, 0)}, k) for k in range(3)]
            return self._state([], 0) if not keep else self._state(pairs, limit)
        to = self._state(pairs, limit)
        self.moves[state][c] = to
        return to

    def find(self, word: str) -> tuple[float, int, bool] | None:
        """weight, edits and whether a stem matched, of the best term; None if there is none."""
        if word in self.seen:
            return self.seen[word]
        limit = 0 if len(word) < EXACT_BELOW else 1 if len(word) < TWO_FROM else 2
        found = None
        at = self.starts[limit]
        stem_node, stem_alive = 0, True
        best_stem = 0.0
        for c in word:
            if stem_alive:
                stem_node = self.child[stem_node].get(c, -1)
                stem_alive = stem_node >= 0
                if stem_alive and stem_node in self.stem:
                    best_stem = max(best_stem, self.stem[stem_node])
            if at >= 0:
                nxt = self.moves[at].get(c)
                at = self._move(at, c) if nxt is None else nxt
            elif not stem_alive:
                break
        if at >= 0:
            ends = [(spent, -self.whole[node]) for node, spent in self.states[at] if node in self.whole]
            if ends:
                spent, weight = min(ends)
                found = (-weight, spent, False)
        if best_stem and (found is None or found[1] > 0):
            found = (best_stem, 0, True)
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[word] = found
        return found


class Reader:
    """Turns texts into features; remembers for each written word whether it is a hit."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.matcher, self.written = Matcher(words, stems), {}

    def _look(self, raw: bytes):
        hit = self.matcher.find(normal(raw.decode()))
        if len(self.written) > 300_000:
            self.written.clear()
        self.written[raw] = hit
        return hit

    def features(self, text: bytes) -> tuple[float, ...]:
        written, look = self.written, self._look
        every = text.split()
        hits = [(i, h) for i, h in enumerate([written[w] if w in written else look(w) for w in every]) if h]
        if not hits:
            return (0.0,) * len(FEATURES)
        direct = stems = quoted = reported = addressed = weight = 0
        edited, exact = [0, 0, 0], {}
        for i, (w, edits, stem) in hits:
            around = [x.decode() for x in every[max(0, i - WINDOW) : i + WINDOW + 1]]
            mid = min(i, WINDOW)
            own = around[mid]
            opened = any(x[0] in QUOTES for x in around[: mid + 1])
            closed = any(x.rstrip(".,;:!?")[-1:] in QUOTES and x.rstrip(".,;:!?") for x in around[mid:])
            inside = (own[0] in QUOTES or opened) and closed
            near = {normal(x) for x in around[:mid] + around[mid + 1 :]}
            told = bool(near & REPORTING)
            quoted += inside
            reported += told
            if inside or told:
                continue
            direct += 1
            addressed += bool(near & ADDRESS)
            edited[edits] += 1
            if not edits:
                exact[normal(every[i].decode())] = w
            stems += stem
            weight = max(weight, w)
        size = math.log1p
        return (size(direct), size(edited[0]), size(len(exact)), size(sum(exact.values())), size(edited[1]), size(edited[2]), size(stems), size(addressed), direct / len(every) * 20, float(weight), float(direct > 0), size(quoted), size(reported))


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and stems, each with its log-odds. Only they reach the driver: terms that stand in MIN_LINES lines of a
    sample whose number of documents is bounded.

    A line counts once however many copies of it there are, and as toxic only if no clean document has it. Words are
    counted within a batch of lines before they are shuffled, stems from the counts of words.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            met: dict[str, list[int]] = {}
            for line, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                for word in {normal(w) for w in line.decode().split()} - {""}:
                    c = met.setdefault(word, [0, 0])
                    c[0] += 1
                    c[1] += y > 0
            return {"word": pa.array(met, pa.string()), "n": pa.array([c[0] for c in met.values()], pa.int64()), "k": pa.array([c[1] for c in met.values()], pa.int64())}

        return step

    lines = sample.select(F.explode(F.split("text", "\n")).alias("line"), "y").groupBy("line").agg(F.min("y").alias("y"))
    met = per_batch(lines, "word string, n long, k long", make).groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    met = Saved(met, "words")
    toxic, every = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    base = (toxic or 0) / max(every, 1)
    prefixes = F.filter(F.array(*(F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS)), lambda t: t.isNotNull())
    stemmed = met.df.select(F.explode(prefixes).alias("term"), "n", "k").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k") > 0).alias("family"))
    counts = met.df.select(F.col("word").alias("term"), "n", "k", F.lit(0).cast("long").alias("family")).unionAll(stemmed)
    good = counts.filter((F.col("n") >= MIN_LINES) & (F.col("k") >= MIN_SHARE * F.col("n")) & (~F.col("term").endswith("*") | (F.col("family") >= FAMILY)))
    top = good.collect()
    met.drop()
    words, stems = {}, {}
    for r in sorted(top, key=lambda r: (len(r.term), r.term)):
        # far more toxic lines than chance would give
        if r.k * math.log(1 / max(base, 1e-6)) < 6:
            continue
        weight = math.log((r.k + 0.5) / (r.n - r.k + 0.5))
        if not r.term.endswith("*"):
            words[r.term] = weight
        elif not any(r.term[:k] in stems for k in STEMS if k < len(r.term) - 1):
            stems[r.term[:-1]] = weight
    return words, stems


def _features(rows: DataFrame, lexicon: tuple[dict, dict], keep: Sequence[str], name: str = "_x") -> DataFrame:
    """The columns of keep, then another: the features of text as doubles."""

    def make():
        reader = Reader(*lexicon)

        def step(batch: pa.RecordBatch) -> dict:
            names = batch.schema.names
            x = [reader.features(t) for t in texts_of(batch.column(names.index("text")))]
            return {c: batch.column(names.index(c)) for c in keep} | {name: pa.array(x, pa.list_(pa.float64()))}

        return step

    kinds = dict(rows.dtypes)
    return per_batch(rows, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` array<double>"]), make)


class Model:
    def __init__(self, lexicon: tuple[dict[str, float], dict[str, float]], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Lexicon and weights from at most ``most`` labelled rows outside the held-out third."""
    sample = Saved(labelled(docs, labels, "toxic", most), "labelled")
    lexicon = learn_lexicon(sample.df)
    rows = sorted(_features(sample.df.select("doc_id", "text", "y"), lexicon, ("doc_id", "y")).collect())
    sample.drop()
    x = np.array([r._x for r in rows], float).reshape(-1, len(FEATURES))
    return Model(lexicon, logistic(x, np.array([float(r.y > 0) for r in rows]), prior=np.array([PRIOR.get(f, 0.0) for f in FEATURES])))


def scored(docs: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns of keep (else all), then score and predicted; columns of docs with these names are left out.

    Null texts count as empty; a text without a hit, the empty one included, has the score of the bias.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    w, x = model.weights, fresh("_x", docs.columns)
    z = sum((F.col(x)[i] * F.lit(float(w[i])) for i in range(len(FEATURES))), F.lit(float(w[-1])))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))
    rows = docs.select(*{c: F.col(f"`{c}`") for c in [*keep, "text"]}.values()).withColumn("text", F.col("text").cast("string"))
    out = _features(rows, model.lexicon, keep, x).withColumn("score", p).drop(x)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...); other columns are not read.

    A null doc_id stays null and isn't held out.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(cols, model, ("doc_id",))
    return out.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


__all__ = ["Matcher", "Model", "Reader", "fit", "learn_lexicon", "score", "scored"]

"""Language identification by unigrams over pieces, with the segmentation summed out.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece; the probability of a word
is the sum over all its segmentations into pieces, by a forward pass, and that of a text the product over its words. The
probabilities come from two rounds of expectation maximisation over the words of a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeing, table
from .tokens import tokenizer_path

UND = "und"
RUN = re.compile(r"[^\W\d_]+")
LONG = 64  # words of more letters are read one by one, with a window of the sums, so that their length doesn't matter
START = "▁"
SCALE = 12.0  # a letter's share of probability is near 1 / SCALE; scaled so, long words stay within a double's range
SMOOTH = 0.1
UNKNOWN = 1e-7
MAX_CELLS = 1 << 21  # of the kept scores of words


def piece_vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces of letters only, lower-cased, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p == START or p.removeprefix(START).isalpha())


def letter_words(text: str) -> list[str]:
    return RUN.findall(text.lower())


def pieces_at(word: str, end: int, index: dict[str, int], longest: int):
    """(start, piece) of the pieces of a marked word that end at a place; a letter that is no piece is the unknown one."""
    for start in range(max(0, end - longest), end):
        k = index.get(word[start:end], len(index) if end - start == 1 else None)
        if k is not None:
            yield start, k


def long_log_probability(word: str, index: dict[str, int], longest: int, prob: np.ndarray) -> np.ndarray:
    """The log probability of a word in each language, the forward sum over all segmentations with the last `longest` sums at hand."""
    word, size = START + word, longest + 1
    ring, logs = np.zeros((size, prob.shape[1])), np.zeros(prob.shape[1])
    ring[0] = 1
    for end in range(1, len(word) + 1):
        starts, ks = zip(*pieces_at(word, end, index, longest))
        ring[end % size] = (ring[[s % size for s in starts]] * prob[list(ks)]).sum(axis=0)
        if end % 16 == 0:
            most = ring.max(axis=0)
            ring /= most
            logs += np.log(most)
    return logs + np.log(np.maximum(ring[len(word) % size], 1e-300))


def long_expected(word: str, index: dict[str, int], longest: int, log_prob: list[float]) -> Counter:
    """Expected uses of each piece in a word, by logarithms of the sums from both ends."""

    def log_sum(terms):
        most = max(terms)
        return most + math.log(sum(math.exp(t - most) for t in terms))

    word = START + word
    ahead, back = [0.0], [-math.inf] * len(word) + [0.0]
    for end in range(1, len(word) + 1):
        ahead.append(log_sum([ahead[s] + log_prob[k] for s, k in pieces_at(word, end, index, longest)]))
    uses: Counter = Counter()
    for end in range(len(word), 0, -1):
        for s, k in pieces_at(word, end, index, longest):
            uses[k] += math.exp(ahead[s] + log_prob[k] + back[end] - ahead[-1])
            back[s] = log_sum([back[s], log_prob[k] + back[end]])
    return uses


class Lattice:
    """All segmentations of some words: an edge for every piece at every place."""

    def __init__(self, words: list[str], index: dict[str, int], longest: int):
        unknown = len(index)
        w, s, e, p = [], [], [], []
        for i, word in enumerate(words):
            word = START + word
            n = len(word)
            for a in range(n):
                for b in range(a + 1, min(n, a + longest) + 1):
                    k = index.get(word[a:b])
                    if k is None:
                        if b > a + 1:
                            continue
                        k = unknown
                    w.append(i)
                    s.append(a)
                    e.append(b)
                    p.append(k)
        w, s, e, p = (np.array(x, np.int64) for x in (w, s, e, p))
        order = np.lexsort((w, e))
        self.w, self.s, self.e, self.p = (x[order] for x in (w, s, e, p))
        self.n, self.size = len(words), np.array([len(x) + 1 for x in words])
        self.at = np.searchsorted(self.e, np.arange(1, self.size.max(initial=0) + 2))

    def _sum(self, out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        """out[rows] += values, rows ascending."""
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] += np.add.reduceat(values, first, axis=0)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, place, language]; prob[edge, language], scaled."""
        alpha = np.zeros((self.n, self.size.max(initial=0) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for lo, hi in zip(self.at, self.at[1:]):
            if hi > lo:
                k = slice(lo, hi)
                self._sum(alpha[:, self.e[lo]], self.w[k], alpha[self.w[k], self.s[k]] * prob[k])
        return alpha

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of every edge, each word weighted; prob[edge, 1]."""
        alpha = self.forward(prob)[:, :, 0]
        beta = np.zeros_like(alpha)
        total = alpha[np.arange(self.n), self.size]
        beta[np.arange(self.n), self.size] = 1
        for at in range(len(self.at) - 2, -1, -1):
            k = slice(self.at[at], self.at[at + 1])
            np.add.at(beta, (self.w[k], self.s[k]), beta[self.w[k], self.e[k]] * prob[k, 0])
        return alpha[self.w, self.s] * prob[:, 0] * beta[self.w, self.e] * (weight / np.maximum(total, 1e-300))[self.w]


class Model:
    """languages, pieces and prob[piece, language]; the last row is that of a letter outside the vocabulary."""

    def __init__(self, languages: list[str], pieces: list[str], prob: np.ndarray):
        self.languages, self.index, self.prob = languages, {p: i for i, p in enumerate(pieces)}, prob
        self.longest = max(map(len, pieces))
        self.words: dict[str, int] = {}
        self.logs = np.zeros((0, len(languages)))

    def scaled(self, lattice: Lattice, language=slice(None)) -> np.ndarray:
        return self.prob[lattice.p][:, language] * SCALE ** (lattice.e - lattice.s)[:, None]

    def learn(self, words: list[str]) -> None:
        """Keep the log probabilities of new words."""
        if len(self.words) * len(self.languages) > MAX_CELLS:
            self.words, self.logs = {}, self.logs[:0]
        new = list(dict.fromkeys(w for w in words if len(w) <= LONG and w not in self.words))
        parts = [self.logs]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            lattice = Lattice(part, self.index, self.longest)
            total = lattice.forward(self.scaled(lattice))[np.arange(lattice.n), lattice.size]
            parts.append(np.log(np.maximum(total, 1e-300)) - np.log(SCALE) * lattice.size[:, None])
        known = len(self.words)
        self.words.update((w, known + i) for i, w in enumerate(new))
        self.logs = np.concatenate(parts) if new else self.logs

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        found = [letter_words(t) if t and self.languages and any(map(str.isalpha, t)) else [] for t in texts]
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(found[stop]) <= 100_000):
                size += len(found[stop])
                stop += 1
            some = [i for i in range(at, stop) if found[i]]
            if some:
                total = np.zeros((len(some), len(self.languages)))
                words = [w for i in some for w in found[i]]
                row = np.repeat(np.arange(len(some)), [len(found[i]) for i in some])
                for lo in range(0, len(words), 100_000):
                    part = words[lo : lo + 100_000]
                    self.learn(part)
                    places = np.fromiter((self.words.get(w, -1) for w in part), np.int64, len(part))
                    logs = self.logs[np.maximum(places, 0)] if len(self.logs) else np.zeros((len(part), len(self.languages)))
                    for j in np.flatnonzero(places < 0):
                        logs[j] = long_log_probability(part[j], self.index, self.longest, self.prob)
                    owner = row[lo : lo + 100_000]
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    total[owner[first]] += np.add.reduceat(logs, first, axis=0)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for k, i in enumerate(some):
                    names[i], scores[i] = self.languages[best[k]], share[k]
            at = stop
        return names, scores


def fit(labelled: DataFrame, rows_per_language: int = 5000, rounds: int = 2, path: str | None = None) -> Model:
    """A model from rows of text, lang. Of each language about rows_per_language different texts at most, chosen by a hash of the text and weighted by
    their copies, so a text with very many copies counts for its share and costs one row.

    The driver gets the numbers of different texts by language and, each round, one number for each pair of language and piece.
    """
    pieces = piece_vocabulary(path or tokenizer_path("piece_bpe_32k.model"))
    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    counts = {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    languages = sorted(counts)
    prob = np.full((len(pieces) + 1, max(1, len(languages))), 1 / len(pieces))
    prob[-1] = UNKNOWN
    model = Model(languages, pieces, prob)
    if not languages:
        return model
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, rows_per_language / counts[k])))))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).groupBy("text", "lang").agg(F.count("*").alias("copies"))

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for t, k, copies in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), batch.column("copies").to_pylist()):
                mine = found.setdefault(k, Counter())
                for w, n in Counter(letter_words(t)).items():
                    mine[w] += n * copies
            for k, c in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    words = table(sample.mapInArrow(freeing(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        now = labelled.sparkSession.sparkContext.broadcast((languages, pieces, model.prob))

        def expect(batches, now=now):
            own = Model(*now.value)
            out = np.zeros((len(own.languages), len(own.prob)))
            for batch in batches:
                langs, found, n = np.array(batch.column("lang").to_pylist()), batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for k, name in enumerate(own.languages):
                    log_prob = np.log(own.prob[:, k]).tolist()
                    for j in (j for j in np.flatnonzero(langs == name) if len(found[j]) > LONG):
                        for p, uses in long_expected(found[j], own.index, own.longest, log_prob).items():
                            out[k, p] += uses * n[j]
                    mine = np.array([j for j in np.flatnonzero(langs == name) if len(found[j]) <= LONG], np.int64)
                    for at in range(0, len(mine), 4096):
                        i = mine[at : at + 4096]
                        lattice = Lattice([found[j] for j in i], own.index, own.longest)
                        out[k] += np.bincount(lattice.p, lattice.expected(own.scaled(lattice, [k]), n[i]), len(own.prob))
            k, p = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p), pa.array(out[k, p])], ["k", "p", "uses"])

        uses = np.full((len(pieces) + 1, len(languages)), SMOOTH)
        for r in words.mapInArrow(freeing(expect), "k long, p long, uses double").groupBy("k", "p").agg(F.sum("uses").alias("uses")).collect():
            uses[r.p, r.k] += r.uses
        prob = uses / uses[:-1].sum(axis=0)
        prob[-1] = UNKNOWN
        model = Model(languages, pieces, prob)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for every row.

    score: the posterior of the language, all languages equally likely before. Null text, no letter in it, or a model
    without languages: `und`, 0. Ties: the first language by name. Repeated rows and ids: row by row.
    """
    given = docs.sparkSession.sparkContext.broadcast((model.languages, list(model.index), model.prob))

    def run(batches):
        own = Model(*given.value)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                names, scores = own.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(freeing(run), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 modulo 3. A null id is kept from it too."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents; learnt from the rows that aren't held out."""
    model = fit(docs.where(~held_out()).select("text", "lang"))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose text has a language with a posterior of `least` or more; rows without letters go."""
    model = fit(docs.where(~held_out()).select("text", "lang"))
    given = docs.sparkSession.sparkContext.broadcast((model.languages, list(model.index), model.prob))

    def run(batches):
        own = Model(*given.value)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                names, scores = own.predict(part.column("text").to_pylist())
                yield part.filter(pa.array([n != UND and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(freeing(run), docs.schema)

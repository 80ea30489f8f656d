"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic machines in a row. The first cuts normalised text into words: a table gives each code point's class, and
a change of class (with one rule for contractions) is a transition that emits a word. The second reads a word's bytes and
annotates every transition with the change of the number of tokens: a state holds, for the last bytes read, the last
token of the byte-pair encoding up to each of them. The next byte's last token is the one that can stand beside the
token before it, so the number of tokens of every prefix follows from the state alone. The
second machine is made deterministic lazily, state by state, with bounds on the states and words that are kept.

A long text is cut into chunks that are read in parallel. The map from the state before a chunk to the state after it
and the tokens emitted has a short form, as both machines are reset where one word surely ends and another begins: what stands before the first
such place, the tokens of the middle, what stands after the last. Two neighbours' maps make one: the word that lies across them
is counted, and the outer ends stay open. This is associative, so maps are joined in a tree, a level of it at a time.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import library, tokenizer_path

#: Unicode white space (without the separators 1C to 1F, which the tokenizer keeps as characters).
SPACE = "\t-\r \x85\xa0  -     　"
#: Contractions that are words of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
END = "</w>"
MAX_STATES, MAX_WORDS = 150_000, 600_000
BLANK, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Where a word surely ends and another begins, whatever stands around: white space (which is no part of a word), or between two characters
#: of which one is a digit and the other a digit or letter, or after a stop before an ideograph. No special token or contraction lies across, and none of them composes with the one before.
RESET = re.compile(f"[{SPACE}]|(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[\u4e00-\u9fff])")
FAN_IN = 16  # maps joined to one at each level of the tree


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point; UNKNOWN where this Python's Unicode tables, which may be older than the tokenizer's, have none."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        if kind[0] in "LN":
            out[cp] = LETTER if kind[0] == "L" else NUMBER
        elif kind == "Cn":
            out[cp] = UNKNOWN
    out[[cp for cp in range(0x3001) if re.match(f"[{SPACE}]", chr(cp))]] = BLANK
    return out


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class CountingTransducer:
    """Bytes of a word to its number of byte-pair tokens.

    A state is what the next transitions need: the last symbols read and, for each boundary between them, the token that
    ends there (None at the start of the word) and the tokens up to there less the tokens up to now.
    """

    def __init__(self, merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
        letters = byte_letters()
        self.symbols = letters + [x + END for x in letters]
        self.tokens = {a + b for a, b in pairs} | set(self.symbols)
        self.longest = max(len(t.removesuffix(END)) for t in self.tokens)
        self.made = {a + b: (i, a, b) for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.edges = functools.cache(self.edge)
        self.beside: dict[tuple[str | None, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        first = ("", (None,), (0,))
        self.states, self.known, self.step = [first], {"": 0}, {}

    def merge(self, text: str) -> list[str]:
        """Byte-pair encoding as defined: the pair of lowest rank first, all its places from the left."""
        parts = list(text.removesuffix(END))
        if text.endswith(END):
            parts[-1] += END
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                both = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
                out.append("".join(best) if both else parts[i])
                i += 1 + both
            parts = out
        return parts

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The tokens that stand at one edge (0 left, 1 right) of a token while it is merged, the last first, each with the
        rank of the merge that ends it."""
        found, until = [], float("inf")
        while True:
            found.append((token, until))
            if token not in self.made:
                return found
            until = self.made[token][0]
            token = self.made[token][1 + side]

    def can_follow(self, left: str | None, token: str) -> bool:
        """Whether `token` is encoded as itself right after `left` (None: at the start of the word).

        It is, if no merge across the boundary comes before the merges that take its two sides away. Of equal pairs the left one
        goes first: so a merge inside `left` wins a tie, and one inside `token` loses it.
        """
        found = self.beside.get((left, token))
        if found is None:
            if left is None:
                found = self.merge(token) == [token]
            else:
                rank, rights = self.rank.get, self.edges(token, 0)
                found = self.can_follow(None, token)
                for x, x_end in self.edges(left, 1) if found else ():
                    for y, y_end in rights:
                        if (r := rank((x, y))) is not None and r < x_end and r <= y_end:
                            found = False
            self.beside[left, token] = found
        return found

    def compile(self, state: int, symbol: int) -> int:
        """The transition of a state on a symbol (byte, + 256 if it ends the word) as next state * 128 + change + 64."""
        read, last, more = self.states[state]
        now = self.symbols[symbol]
        for at in range(max(0, len(read) + 1 - self.longest), len(read) + 1):
            token = read[at:] + now
            if token in self.tokens and self.can_follow(last[at], token):
                break
        change = more[at] + 1
        out = change + 64
        if symbol < 256:
            w = self.longest
            grown = read + now
            # a whole prefix tells all else; when its start has left the window, the rest of the state counts too
            key = grown if len(grown) < w - 1 else (grown[1 - w :], (*last, token)[-w:], (*(m - change for m in more), 0)[-w:])
            n = self.known.setdefault(key, len(self.states))
            if n == len(self.states):
                self.states.append((grown, (*last, token), (*(m - change for m in more), 0)) if isinstance(key, str) else key)
            out += n * 128
        self.step[state << 9 | symbol] = out
        return out

    def count(self, word: bytes) -> int:
        step, state, n = self.step, 0, 0
        for b in word[:-1]:
            x = step.get(state << 9 | b)
            if x is None:
                x = self.compile(state, b)
            state, n = x >> 7, n + (x & 127) - 64
        x = step.get(state << 9 | word[-1] | 256)
        n += ((self.compile(state, word[-1] | 256) if x is None else x) & 127) - 64
        if len(self.states) > MAX_STATES:
            self.reset()
        if len(self.beside) > 2 * MAX_STATES:
            self.beside.clear()
        return n


class Counter:
    """Texts to token counts, for one tokenizer file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.machine = CountingTransducer(spec["model"]["merges"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"] if t["special"]))
        self.words: dict[str, int] = {}

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)  # no rule for a sigma at the end of a word

    def count(self, texts: list[str]) -> np.ndarray:
        """A text with a code point of no known class is counted by the library itself."""
        out = np.zeros(len(texts), np.int64)
        parts, owner, size = [], [], 0
        for i, t in enumerate(texts):
            if "<|" in t and (found := self.special.findall(t)):
                out[i] += len(found)
                t = " ".join(self.special.split(t))  # a special token ends a word, as a space does
            parts.append(self.normal(t))
            owner.append(i)
            size += len(t)
            if size > 1 << 20 or i == len(texts) - 1:
                n, known = self._count(parts)
                out[owner] += n
                for j in np.flatnonzero(~known):
                    out[owner[j]] = len(library(self.path).encode(texts[owner[j]], add_special_tokens=False).ids)
                parts, owner, size = [], [], 0
        return out

    def _count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of normalised texts without special tokens, and whether all their code points are known."""
        text = " ".join(texts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        strange = np.flatnonzero(classes()[points] == UNKNOWN)
        known = np.ones(len(texts), bool)
        known[np.searchsorted(bounds, strange, "right") - 1] = False
        starts, ends = words(points)
        memo, count = self.words, self.machine.count
        found = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        for w in dict.fromkeys(found):
            if w not in memo:
                memo[w] = count(w.encode("utf-8", "surrogatepass"))
        n = np.fromiter(map(memo.__getitem__, found), np.int64, len(found))
        if len(memo) > MAX_WORDS:
            memo.clear()
        return np.diff(np.r_[0, np.cumsum(n)][np.searchsorted(starts, bounds)]), known

    def state_map(self, text: str) -> tuple[str, int, str, bool]:
        """head, tokens of the middle, tail, whole: a chunk without a place of reset is whole, and its text the head."""
        first = RESET.search(text)
        if first is None:
            return text, 0, "", True
        for back in (1 << k for k in (6, 12, 18, 40)):
            last = deque(RESET.finditer(text, max(first.start(), len(text) - back)), maxlen=1)
            if last:
                break
        return text[: first.start()], int(self.count([text[first.end() : last[0].start()]])[0]) if last[0].start() > first.end() else 0, text[last[0].end() :], False

    def join(self, maps: list[tuple[str, int, str, bool]]) -> tuple[str, int, str, bool]:
        """Neighbouring state maps as one."""
        open_parts, head, n = [], None, 0
        across = []
        for h, m, t, whole in maps:
            open_parts.append(h)
            if not whole:
                if head is None:
                    head = "".join(open_parts)
                else:
                    across.append("".join(open_parts))
                n, open_parts = n + m, [t]
        if head is None:
            return "".join(open_parts), 0, "", True
        return head, n + int(self.count(across).sum()), "".join(open_parts), False


def words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in code points: runs of letters, single numbers, runs of others, contractions."""
    kind = classes()[points]
    new = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(points)]
    # an apostrophe that is a run of its own, with letters after it
    lone = np.flatnonzero((points[starts] == ord("'")) & (ends - starts == 1))
    lone = lone[lone + 1 < len(starts)]
    lone = lone[kind[starts[lone + 1]] == LETTER]
    if len(lone):
        a, n = starts[lone], ends[lone + 1] - starts[lone + 1]
        padded = np.r_[points, np.zeros(2, points.dtype)]
        take = np.zeros(len(lone), np.int64)
        for c in CONTRACTIONS:
            fits = (n >= len(c)) & (take == 0)
            for j, x in enumerate(c):
                fits &= padded[a + 1 + j] == ord(x)
            take[fits] = len(c)
        lone, n, take = lone[take > 0], n[take > 0], take[take > 0]
        ends[lone] += take
        starts[lone + 1] += take
    keep = (kind[np.minimum(starts, len(points) - 1)] != BLANK) & (ends > starts) if len(points) else np.zeros(0, bool)
    return starts[keep], ends[keep]


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048, chunk: int = 1 << 15) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows and ids are counted row by row; a null id is kept. Empty input: no rows.
    Texts of more than `chunk` code points are cut into chunks that are dealt out to all tasks and joined by their state maps. Only a run without
    any place of reset (see RESET) is gathered in one row, as it is in the table, and read at once.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                n = counter(path).count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    short = rows.where(F.length("text") <= chunk).select("id", "n_bytes", "text").mapInArrow(run, "id long, n_bytes long, n_tokens long")
    long = rows.where(F.length("text") > chunk).withColumn("doc", F.struct("id", "n_bytes", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row")))
    chunks = long.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("place", "text"))
    whole = joined_maps(table(state_maps(chunks.repartition("doc", "place"), path)), path)

    def closed(batches):
        for batch in batches:
            head, tail = batch.column("head").to_pylist(), batch.column("tail").to_pylist()
            n = batch.column("n").to_numpy() + counter(path).count(head) + counter(path).count(tail)
            yield pa.RecordBatch.from_arrays([batch.column("doc").field("id"), batch.column("doc").field("n_bytes"), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    counted = short.unionByName(whole.mapInArrow(closed, "id long, n_bytes long, n_tokens long"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


MAP = "doc struct<id: long, n_bytes: long, h: long, row: long>, place int, head string, n long, tail string, whole boolean"
_MAPS = pa.schema([("head", pa.string()), ("n", pa.int64()), ("tail", pa.string()), ("whole", pa.bool_())])


def state_maps(chunks: DataFrame, path: str) -> DataFrame:
    """The state map of each chunk (doc, place, text)."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                maps = pa.Table.from_pylist([dict(zip(_MAPS.names, counter(path).state_map(t))) for t in part.column("text").to_pylist()], _MAPS).combine_chunks()
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("place"), *(c.combine_chunks() for c in maps.columns)], ["doc", "place", *_MAPS.names])

    return chunks.mapInArrow(run, MAP)


def joined_maps(maps: DataFrame, path: str) -> DataFrame:
    """One map for each document: FAN_IN neighbours become one, level by level, in as many rounds as the longest text needs."""

    def join(given: pa.Table) -> pa.Table:
        given = given.sort_by("place")
        one = counter(path).join([tuple(r.values()) for r in given.select(_MAPS.names).to_pylist()])
        return pa.table([given.column("doc").slice(0, 1), pa.array([given.column("place")[0].as_py() // FAN_IN], pa.int32()), *(pa.array([x], f.type) for x, f in zip(one, _MAPS))], names=["doc", "place", *_MAPS.names])

    most = maps.agg(F.max("place")).first()[0] or 0
    while most > 0:
        maps = maps.groupBy("doc", F.floor(F.col("place") / FAN_IN).alias("up")).applyInArrow(join, MAP)
        most //= FAN_IN
    return maps

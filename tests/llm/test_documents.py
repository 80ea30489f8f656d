"""Operators on documents against plain Python, on small tables with odd rows."""

import hashlib
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, hilbert_shards, language_id, near_dup, packing, repeats, secret_scan, token_counts
from sparkloom.llm.tokens import byte_bpe_ids, library, tokenizer_path

from .conftest import EDGE, prose

EMPTY: list = []


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# 1 language identification

SAMPLES = {
    "en": "the people who walked along the road were talking about the weather and their work ",
    "de": "die leute die auf der strasse gingen sprachen über das wetter und ihre arbeit ",
    "fr": "les gens qui marchaient le long de la route parlaient du temps et de leur travail ",
}


def test_language_id_learns_and_marks(make):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(SAMPLES[k].split()) for _ in range(30)), k) for i, k in enumerate(r.choice(list(SAMPLES)) for _ in range(120))]
    odd = [(200, None, "en"), (201, "", "en"), (202, "123 !?", "en"), (203, "the road", None), (None, "les gens", "fr"), (204, "x" * 500, "en"), (204, "die leute", "de")]
    got = language_id.identify(make(rows + odd)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 204}
    assert len(got) == len(rows) + len(odd)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in by)
    assert sum(by[i].lang_pred == k for i, _, k in rows) >= 0.97 * len(rows)
    assert {by[i].lang_pred for i in (200, 201, 202)} == {"und"} and by[203].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_forward_sums_all_segmentations():
    index = {p: i for i, p in enumerate(["a", "b", "ab", "▁", "▁a"])}
    prob = np.array([[0.1], [0.2], [0.3], [0.4], [0.5], [1e-7]])
    model = language_id.Model(["l"], list(index), prob)
    model.learn(["ab", "b"])
    # ▁·a·b, ▁·ab, ▁a·b and ▁·b
    assert np.allclose(np.exp(model.logs[:, 0]), [0.4 * 0.1 * 0.2 + 0.4 * 0.3 + 0.5 * 0.2, 0.4 * 0.2])


def segmentations(word, index, longest):
    """All ways to cut a marked word into pieces."""
    if not word:
        yield ()
    for b in range(1, min(len(word), longest) + 1):
        k = index.get(word[:b], len(index) if b == 1 else None)
        if k is not None:
            for rest in segmentations(word[b:], index, longest):
                yield (k, *rest)


@pytest.mark.parametrize("word", ["ab", "abba", "baxab", "aaaab"])
def test_sums_and_expectations_match_all_segmentations(word):
    index = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aa", language_id.START, language_id.START + "a"])}
    prob = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.05], [0.1, 0.1], [0.15, 0.05], [0.4, 0.3], [0.5, 0.2], [1e-3, 1e-3]])
    ways = list(segmentations(language_id.START + word, index, 2))
    each = np.array([[np.prod([prob[k, j] for k in way]) for j in range(2)] for way in ways])
    model = language_id.Model(["l", "m"], list(index), prob)
    model.learn([word])
    assert np.allclose(model.logs[0], np.log(each.sum(axis=0)))
    assert np.allclose(language_id.long_log_probability(word, index, 2, prob), model.logs[0])
    want = Counter()
    for way, p in zip(ways, each[:, 0] / each[:, 0].sum()):
        for k in way:
            want[k] += p
    lattice = language_id.Lattice([word], index, 2)
    uses = lattice.expected(model.scaled(lattice, [0]), np.array([1.0]))
    got = np.bincount(lattice.p, uses, len(prob))
    assert np.allclose(got, [want[k] for k in range(len(prob))])
    slow = language_id.long_expected(word, index, 2, np.log(prob[:, 0]).tolist())
    assert np.allclose([slow[k] for k in range(len(prob))], got)


def test_long_words_are_read_whole(make):
    rows = [(i, SAMPLES[k] * 3, k) for i, k in enumerate(["en", "de", "fr"] * 20)]
    long = {k: "".join(SAMPLES[k].split()) * 400 for k in SAMPLES}
    rows += [(100 + i, long[k], k) for i, k in enumerate(SAMPLES)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(make(rows)).collect()}
    assert all(got[i] == k for i, _, k in rows)


def test_copies_of_one_text_dont_crowd_out_a_language(make):
    rows = [(i, SAMPLES["en"], "en") for i in range(300)] + [(1000 + i, SAMPLES["de"] + str(i), "de") for i in range(30)]
    model = language_id.fit(make(rows).select("text", "lang"), rows_per_language=10)
    names, _ = model.predict(["the people were talking", "die leute sprachen"])
    assert names == ["en", "de"]


def test_language_id_without_rows(make):
    assert language_id.identify(make(EMPTY)).count() == 0
    assert language_id.drop_unidentified(make(EMPTY)).columns == make(EMPTY).columns


def test_filter_keeps_identified(make):
    docs = make([(i, SAMPLES[k] * 3, k) for i, k in enumerate(["en", "de", "fr"] * 10)] + [(50, "...", "en"), (51, None, "en")])
    assert {r.doc_id for r in language_id.drop_unidentified(docs).collect()} == set(range(30))


IDLE = """
import random
import time

import psutil
from pyspark.sql import SparkSession

from sparkloom.llm import language_id
from sparkloom.session import ship

spark = ship(SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())


def held(docs):
    language_id.drop_unidentified(docs).write.format("noop").mode("overwrite").save()
    time.sleep(0.5)
    memory = [p.memory_info() for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline())]
    return max(m.rss - m.shared for m in memory) / 1e6


def docs(n):
    text = lambda r: " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(4, 9))) for _ in range(300))
    return spark.createDataFrame([(i, text(random.Random(i)), "en" if i % 2 else "fr") for i in range(n)], "doc_id long, text string, lang string").repartition(2)


print(held(docs(8)), held(docs(4000)))
"""


def test_idle_workers_give_memory_back():
    found = subprocess.run([sys.executable, "-c", IDLE], capture_output=True, text=True, timeout=300)
    few, many = map(float, found.stdout.split()[-2:])
    assert many < few + 25, (few, many)


# 2 decontamination


def test_decontamination_finds_copies_only(spark, make):
    items = [(i, prose(1000 + i, 25 + i)) for i in range(12)]
    r = random.Random(5)
    docs, want = [], set()
    for d in range(60):
        text = prose(d, 120).split()
        if d % 3 == 0:
            i = d % 12
            copy = items[i][1].upper().split() if d % 2 else items[i][1].split()
            if d % 4 == 0:
                copy = [w if r.random() > 0.1 else "edited" for w in copy]  # an edited copy
            text[40:40] = [w + r.choice(["", ",", "."]) for w in copy]
            want.add((d, i))
        docs.append((d, " ".join(text)))
    docs += EDGE + [(0, docs[0][1]), (9979, "Two, words!"), (9978, "here are two words of a phrase")]
    bench = spark.createDataFrame([*items, (20, None), (21, ""), (22, "two words"), (None, prose(3, 30)), (23, items[0][1])], "item_id long, text string").withColumn("id", F.lit(1)).withColumn("words", F.lit(1))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.decontaminate(make(docs), bench).collect()}
    assert set(got) == want | {(d, 23) for d, i in want if i == 0} | {(9979, 22)}
    assert all(s == 1 for (d, i), s in got.items() if d % 4)
    kept = decontaminate.drop_contaminated(make(docs), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} - {9979}
    assert decontaminate.decontaminate(make(EMPTY), bench).count() == 0
    assert decontaminate.decontaminate(make(docs), bench.limit(0)).count() == 0


def test_leak_in_every_document_is_found(spark, make):
    item = prose(77, 30)
    docs = [(d, prose(d, 20) + " " + item + " " + prose(d + 500, 20)) for d in range(80)] + [(d, prose(d, 60)) for d in range(100, 140)]
    got = decontaminate.decontaminate(make(docs), spark.createDataFrame([(1, item), (2, prose(7800, 30))], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, 1) for d in range(80)}


def test_edited_or_partial_copy_in_many_documents_is_found(spark, make):
    items = [(1, prose(9081, 33)), (2, prose(9082, 40)), (3, prose(9083, 30))]
    edited = " ".join("edited" if k % 11 == 5 else w for k, w in enumerate(items[0][1].split()))
    part = " ".join(items[1][1].split()[:24])
    phrase = " ".join(items[2][1].split()[:3])
    docs = [(d, prose(d, 20) + f" {(edited, part)[d % 2]} " + prose(d + 500, 20)) for d in range(200)] + [(d, prose(d, 60) + " " + phrase) for d in range(1000, 1040)]
    got = decontaminate.decontaminate(make(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, 1 + d % 2) for d in range(200)}


def smith_waterman(a, b):
    """The best local score of all of a with all of b."""
    last, best = np.zeros(len(b) + 1, int), 0
    for x in a:
        now = np.zeros(len(b) + 1, int)
        for j, y in enumerate(b):
            now[j + 1] = max(0, last[j] + (1 if x == y else -1), last[j + 1] - 1, now[j] - 1)
        best, last = max(best, now.max()), now
    return best


def test_recall_against_full_alignment(spark, make):
    """Items in copies with 0 to 35 % of the words replaced, dropped or added; what full alignment scores 0.5 or more is the truth."""
    r = random.Random(21)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [text(r.randint(18, 40)) for _ in range(15)]
    docs = []
    for d in range(90):
        body, share = text(60), r.random() * 0.35
        for i in r.sample(range(15), r.randint(0, 2)):
            copy = [x for w in items[i] for x in ([w] if r.random() > share else r.choice([[], [r.choice(vocabulary)], [w, r.choice(vocabulary)]]))]
            at = r.randrange(len(body))
            body[at:at] = copy
        docs.append((d, " ".join(body)))
    docs.append((500, " ".join(" ".join(items[k % 2]) + " " + " ".join(text(30)) for k in range(60))))  # many places of two items in one text
    want = {(d, i) for d, t in docs[:-1] for i, item in enumerate(items) if smith_waterman(t.split(), item) >= 0.5 * len(item)} | {(500, 0), (500, 1)}
    got = {(x.doc_id, x.item_id) for x in decontaminate.decontaminate(make(docs, extra=False), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 60


def test_alignment_is_smith_waterman():
    r = random.Random(2)
    for _ in range(30):
        a, b = ([r.randint(1, 4) for _ in range(r.randint(1, 12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        pad = [9] * 3
        best, _ = decontaminate.align([np.array(a, np.uint32), np.array(pad, np.uint32)], [np.array(b, np.uint32), np.array(pad, np.uint32)])
        assert best.tolist() == [h.max(), 3]
        many, _ = decontaminate.aligned([np.array(a, np.uint32)] * 5 + [np.array(pad, np.uint32)], [np.array(b, np.uint32)] * 5 + [np.array(pad, np.uint32)], cells=20)
        assert many.tolist() == [h.max()] * 5 + [3]


# 4 near-duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed=3, n=160):
    """A family whose members are copies of one text with more or fewer edits: many pairs just under the threshold."""
    r = random.Random(seed)
    base = prose(seed, 90).split()
    docs = []
    for d in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        docs.append((d, " ".join(w)))
    return docs


def test_near_duplicates_match_all_pairs(make):
    docs = near_copies() + [(d, prose(d, 60)) for d in range(200, 230)] + [(300 + d, prose(200 + d, 60) + " tail") for d in range(10)]
    docs += [(400, "Few Words"), (401, "few  words"), (402, "few word"), (500, docs[0][1]), (501, docs[0][1])] + EDGE
    got = near_dup.near_duplicates(make(docs)).collect()
    want = components(docs)
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r
    kept = near_dup.drop_near_duplicates(make(docs))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([i for i, (_, c) in want.items() if i == c] + [None])


def test_texts_that_polynomials_mistake_are_no_copies(make):
    docs = [(i, thue_morse(1024, *x)) for i, x in enumerate(["ab", "ba", "ae", "ea"])] + [(9, "x " + thue_morse(2048, "t", "h")), (10, "x " + thue_morse(2048, "h", "t"))]
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(make(docs)).collect()} == {i: i for i, _ in docs}


def test_families_of_a_template_match_all_pairs(make):
    """Members share a template; paragraphs that many of them have too make clusters away from the centre of all their bands."""
    r = random.Random(4)
    fresh = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    template, paragraphs = fresh(100), [fresh(40), fresh(45), fresh(20)]
    docs = []
    for d in range(90):
        k = r.randrange(4)
        docs.append((d, " ".join([template, *([paragraphs[k]] if k < 3 else []), fresh(r.choice([2, 6, 12, 20, 30, 40]))])))
    got = near_dup.near_duplicates(make(docs, extra=False)).collect()
    want = components(docs)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert len({c for _, c in want.values()}) >= 3


def test_near_duplicates_of_nothing(make):
    assert near_dup.near_duplicates(make(EMPTY)).count() == 0
    assert sorted(tuple(r) for r in near_dup.near_duplicates(make([(1, None), (2, "")])).select("component_id").collect()) == [(1,), (2,)]


@pytest.mark.parametrize("n,m,common", [(300, 300, 240), (50, 400, 20), (1000, 1000, 0)])
def test_estimates_are_near(n, m, common):
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, n + m, dtype=np.uint64)
    a, b = pool[:n], np.r_[pool[:common], pool[n : n + m - common]]
    got = near_dup.estimate(near_dup.registers(a)[None], near_dup.registers(b)[None], np.array([n]), np.array([m]))[0]
    assert abs(got - common / (n + m - common)) < 0.15


def test_registers_are_monotone_codes_of_minima():
    a = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both, half = near_dup.registers(a), near_dup.registers(a[:250])
    assert (both >> near_dup.MANTISSA >= half >> near_dup.MANTISSA).all()  # more elements, no fewer zeros


# 5 sharding


def test_hilbert_curve_is_a_path():
    rank, following = hilbert_shards.curve_tables(3)
    for bits in (1, 2, 3):
        cells = {}
        for x in range(1 << bits):
            for y in range(1 << bits):
                for z in range(1 << bits):
                    state = index = 0
                    for b in range(bits - 1, -1, -1):
                        cell = (x >> b & 1) | (y >> b & 1) << 1 | (z >> b & 1) << 2
                        index = index * 8 + rank[state * 8 + cell]
                        state = following[state * 8 + cell]
                    cells[index] = np.array([x, y, z])
        assert len(cells) == 8**bits
        assert all(abs(cells[i] - cells[i + 1]).sum() == 1 for i in range(8**bits - 1))


def test_shards_have_equal_counts_and_follow_the_curve(make):
    docs = [(i, prose(i, i % 50 + 1), "en") for i in range(203)] + [(i, "same text", "en") for i in range(300, 400)] + [(*e, None) for e in EDGE] + [(1, "again", "de")]
    got = hilbert_shards.hilbert_shards(make(docs)).collect()
    n = Counter(r.shard for r in got)
    assert len(got) == len(docs) and set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    place = sorted((r.shard, r.slot, r.curve) for r in got)
    assert [c for _, _, c in place] == sorted(c for _, _, c in place)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert hilbert_shards.hilbert_shards(make(EMPTY)).count() == 0
    assert [r.slot for r in hilbert_shards.hilbert_shards(make([(1, "a")])).collect()] == [0]


# 6 packing


def test_packing_round_trip(make):
    docs = [(i, prose(i, (i * 37) % 900 + 1)) for i in range(60)] + [(100 + i, "short one") for i in range(30)] + EDGE + [(97, "<|endoftext|> inside")]
    lib = library(tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack(make(docs)).collect()
    want = Counter()
    for i, t in docs:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        start, k, piece = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            want[i, piece, start, k, zlib.crc32(ids[start : start + k].tobytes())] += 1
            start, k, piece = start + k, 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(make(EMPTY)).count() == 0


def test_fast_ids_are_those_of_the_library():
    r = random.Random(31)
    alphabet = ["abc XYZ 019", "\t\n\r  .,!?'\"-", "éßÀøñ¿«»\xa0", "\u2010\u2018\u2019\u2026\u20ac", "<|endoftext|>", "it's we'll I'VE", "中文\U0001f600\u0301\x00"]
    texts = ["".join(r.choice(r.choice(alphabet)) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|> a<|endoftext|>", "   x", "x   ", "\n\n", "a\u2028b"]
    path = tokenizer_path("byte_bpe_50k.json")
    got = byte_bpe_ids(texts, path, tokenizer_path("byte_bpe_50k.tiktoken"))
    assert all(g.tolist() == library(path).encode(t, add_special_tokens=False).ids for g, t in zip(got, texts))


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_every_item_once(seed):
    r = random.Random(seed)
    counts = Counter(r.choice([r.randint(1, 100), r.randint(30, 60), r.randint(1, 5)]) for _ in range(r.choice([1, 30, 3000])))
    patterns = packing.plan(counts, 100)
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 100 and n > 0
        assert sum(3 * x > 100 for x in pattern) <= 2
        for x in pattern:
            used[x] += n
    assert used == counts
    best = max(-(-sum(k * n for k, n in counts.items()) // 100), sum(n for k, n in counts.items() if k > 50))
    assert sum(n for _, n in patterns) <= 11 / 9 * best + 1


# 7 repeats


def brute_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeats_match_all_windows(make):
    passage, other = prose(1, 150), prose(2, 90)
    docs = [(i, prose(10 + i, 40) + passage[i : i + 500] + prose(50 + i, 40)) for i in range(25)]
    docs += [(30, passage), (31, passage), (32, passage[:400]), (33, passage[:399]), (34, "ab" * 500), (35, other + "|" + other), (36, "z" * 401), (37, "q" * 400)]
    docs += [(40 + i, " ".join(w if random.Random(i * 1000 + k).random() > 0.01 else "edit" for k, w in enumerate(passage.split()))) for i in range(12)] + EDGE + [(30, passage)]
    got = repeats.remove_repeats(make(docs))
    want = Counter((i, *w) for (i, _), w in zip(docs, brute_repeats([t for _, t in docs])))
    assert Counter(tuple(r) for r in got.drop("kept").collect()) == want
    assert repeats.remove_repeats(make(EMPTY)).count() == 0


def test_long_texts_are_read_in_blocks(make, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    text = prose(4, 900)
    data = np.frombuffer((text + prose(5, 100) + text).encode(), np.uint8)
    firsts = [(at, repeats.anchored(b)) for at, b in repeats.blocks(data)]
    n = sum(int((last - first + 1).sum()) for _, (_, first, last, _) in firsts)
    assert n == len(data) - 399  # every suffix is in one segment of one block


def test_identifiers_come_from_later_offsets():
    data = np.frombuffer(b"abc" * 400, np.uint8)
    ids = repeats.identifiers(data, 4)[400]
    assert ids[0] == ids[3] and ids[0] != ids[1]


def thue_morse(n: int, a: str, b: str) -> str:
    """Texts that polynomial hashes modulo a power of two don't tell apart."""
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_repeats_are_told_apart_by_their_bytes(make):
    docs = [(i, prose(i, 5) + thue_morse(1024, *x) + prose(20 + i, 5)) for i, x in enumerate(["ab", "ba", "ae", "ea"])] + [(9, "é" * 300 + "x"), (10, "é" * 300 + "y")]
    got = repeats.remove_repeats(make(docs))
    want = Counter((i, *w) for (i, _), w in zip(docs, brute_repeats([t for _, t in docs])))
    assert Counter(tuple(r) for r in got.drop("kept").collect()) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


# 8 token counts


def test_token_counts_match_the_library(make):
    r = random.Random(4)
    alphabet = "abcdefghij klmnop'stremvld  \t\nABCÉÀß1234!?.,<|endoftext|>́Σ中\x1f\x85"
    docs = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 120)))) for i in range(150)]
    docs += [(200, prose(1, 3000)), (201, "long" * 5000), (202, prose(2, 400) + " " + "x" * 2000 + " end"), (203, "<|startoftext|>a<|endoftext|>it's I'll'll''s")] + EDGE + [(200, "twice")]
    lib = library(tokenizer_path("word_bpe_49k.json"))
    got = token_counts.token_counts(make(docs), chunk=1000)
    want = Counter()
    for i, t in docs:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(tuple(x) for x in got.collect()) == want
    assert token_counts.token_counts(make(EMPTY)).count() == 0


def test_words_are_told_apart_by_their_bytes():
    path = tokenizer_path("word_bpe_49k.json")
    texts = [thue_morse(n, *x) for n in (1024, 2048) for x in ("es", "se", "th", "ht")]
    want = [len(library(path).encode(x, add_special_tokens=False).ids) for x in texts]
    assert token_counts.counter(path).count(texts).tolist() == want
    assert token_counts.counter(path).count(texts[::-1]).tolist() == want[::-1]


def test_every_code_point_counts_as_in_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    unknown = token_counts.classes() == token_counts.UNKNOWN  # these go to the library: a sample of them will do
    texts = [f"a{c}b 1{c}2 {c}{c}" for c in map(chr, [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF and (not unknown[i] or i % 64 == 0 or i in (0xA7CB, 0xA7DC, 0x13808, 0x1385C, 0x13988))])]
    lib, own = library(path), token_counts.counter(path)
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        want = [len(e.ids) for e in lib.encode_batch(part, add_special_tokens=False)]
        assert own.count(part).tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_state_maps_join_in_any_order(seed):
    r = random.Random(seed)
    alphabet = ["abcdefgh", "aB1 9z'sll", "\u3002\u4e2d\uff0c\u6587a1", "ab'<|endoftext|>", "\u0301e\u0301 x2"][r.randrange(5)]
    text = "".join(r.choice(alphabet) for _ in range(600)) + "<|endoftext|>a1it'll" * 3
    own, lib = token_counts.counter(tokenizer_path("word_bpe_49k.json")), library(tokenizer_path("word_bpe_49k.json"))
    cuts = sorted({0, len(text), *(r.randrange(len(text)) for _ in range(12))})
    maps = [own.state_map(text[a:b]) for a, b in zip(cuts, cuts[1:])]
    while len(maps) > 1:
        k = r.randrange(len(maps) - 1)
        maps[k : k + 2] = [own.join(maps[k : k + 2])]
    head, n, tail, _ = maps[0]
    assert n + own.count([head, tail]).sum() == len(lib.encode(text, add_special_tokens=False).ids)


def test_long_text_without_white_space_is_split(make):
    r = random.Random(9)
    text = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300_000))
    docs = [(1, text), (2, "x" * 30_000), (3, text[:70_000] + " " + text[:10])]
    got = {x.doc_id: x.n_tokens for x in token_counts.token_counts(make(docs), chunk=4096).collect()}
    lib = library(tokenizer_path("word_bpe_49k.json"))
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in docs}
    own = token_counts.counter(tokenizer_path("word_bpe_49k.json"))
    assert not any(own.state_map(text[a : a + 4096])[3] for a in range(0, len(text), 4096))  # no chunk is gathered whole


def test_transducer_agrees_on_every_token_of_the_vocabulary():
    path = tokenizer_path("word_bpe_49k.json")
    lib, own = library(path), token_counts.counter(path)
    words = [w.removesuffix("</w>") for w in list(lib.get_vocab())[::23]]
    words = ["".join(a) for a in zip(words, words[1:])]
    assert own.count(words).tolist() == [len(lib.encode(w, add_special_tokens=False).ids) for w in words]


# 10 secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(make):
    r = random.Random(6)
    bits = ["password = ", "Token:", "API_KEY='", "apikey=", "secret\"  :  \"", "token=short", "AKIA" + "Z9" * 9, "AKIASHORT", "AKIAAKIA" + "B" * 16, "0123456789abcdef" * 2, "deadbeef" * 2, "é\U0001f600", "hunter2hunter2", " ", "\n", "secret=token:abcdefghi", "f" * 23, "gJ8sK2vQ9xZ1bN4mC7tR0wE5", "x=y "]
    docs = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(200)] + EDGE
    got = secret_scan.secret_digest(make(docs)).collect()
    by = {}
    for row in got:
        by.setdefault(row.doc_id, []).append(row)
    for i, t in docs:
        s = base_spans(t or "")
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in s)
        row = next(x for x in by[i])
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, t, joined, row.spans)
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == z for _, k, _ in s) for z in range(3))
        assert set(joined.split(",")) - {""} <= set(row.spans.split(","))
    assert secret_scan.secret_digest(make(EMPTY)).count() == 0


def entropy(s, window=20):
    best = 0.0
    for i in range(len(s) - window + 1):
        n = Counter(s[i : i + window])
        best = max(best, -sum(c / window * np.log2(c / window) for c in n.values()))
    return best


def test_window_entropy_counts_incrementally(spark):
    r = random.Random(8)
    runs = ["".join(r.choice("0123456789abcdef" if k % 2 else "aab") for _ in range(r.randint(1, 60))) for k in range(40)]
    runs = [x for x in runs if set(x) <= set("0123456789abcdef")]
    df = spark.createDataFrame([(x,) for x in runs], "run string")
    for row in df.select("run", secret_scan.window_entropy(F.col("run"), "0123456789abcdef").alias("h")).collect():
        assert abs(row.h - entropy(row.run)) < 1e-9


def test_entropy_adds_and_allow_list_suppresses(make):
    key = "gJ8sK2vQ9xZ1bN4mC7tR0wE5pL3"
    docs = [(1, f"see {key} there"), (2, f"see EXAMPLE{key} there"), (3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (4, f"token={key}"), (5, "unquestionablyunremarkableword")]
    got = {r.doc_id: r.spans for r in secret_scan.secret_digest(make(docs)).collect()}
    assert got[1] == f"entropy:4:{4 + len(key)}" and got[2] == "" and got[5] == ""
    assert got[4] == f"assign:0:{6 + len(key)}"


def test_keys_of_small_alphabets_are_found(make):
    keys = ["9F3A07C5D18BE264F0A7", "k3v9x0q7m2t8z5w1b6r4n8j2", "K3VNX7QZM2T5ZGWLB6R4YHJ2"]
    docs = [(i, f"see {k} there") for i, k in enumerate(keys)] + [(7, "unquestionablyunremarkableword INTERNATIONALISATIONUNDERWAY")]
    got = {r.doc_id: r.spans for r in secret_scan.secret_digest(make(docs)).collect()}
    assert got == {i: f"entropy:4:{4 + len(k)}" for i, k in enumerate(keys)} | {7: ""}
    assert {r.text for r in secret_scan.redact(make(docs[:3])).collect()} == {"see [REDACTED] there"}


def test_redaction(make):
    docs = [(1, "é token = abcdef123456 end"), (2, "clean text"), (3, None), (4, "AKIA" + "A" * 16 + "0123456789abcdef" * 2)]
    got = {r.doc_id: r.text for r in secret_scan.redact(make(docs)).collect()}
    assert got == {1: "é [REDACTED] end", 2: "clean text", 3: None, 4: "[REDACTED]" + got[4][10:]}
    assert "0123456789abcdef" not in got[4]
    assert secret_scan.redact(make(docs)).columns == make(docs).columns


def test_long_runs_and_many_matches(make):
    r = random.Random(12)
    b64 = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))
    many = "".join(f"token={'abcdef' if k % 3 else 'short'} é " for k in range(50_000))
    keys = " ".join("gJ8sK2vQ9xZ1bN4mC7tR0wE5pL3" + "abcdefXY"[k % 8] for k in range(20_000)) + " password=topsecret"
    docs = [(1, f"see {b64} there"), (2, many), (3, keys), (4, "q" * 200_000)]
    began = time.monotonic()
    got = {x.doc_id: x for x in secret_scan.secret_digest(make(docs)).collect()}
    assert time.monotonic() - began < 60
    assert got[1].spans.split(",")[0] == f"entropy:4:{4 + len(b64)}" and got[4].spans == ""  # runs of other classes may lie inside
    want = ",".join(f"assign:{a}:{b}" for a, _, b in base_spans(many))
    assert got[2].spans == want and got[2].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[3].spans.count("entropy") == 20_000 and got[3].spans.endswith(f"assign:{len(keys) - 18}:{len(keys)}")
    clean = {x.doc_id: x.text for x in secret_scan.redact(make(docs)).collect()}
    assert clean[1] == "see [REDACTED] there" and clean[3] == " ".join(["[REDACTED]"] * 20_001) and clean[4] == docs[3][1]
    assert clean[2] == re.sub("token=abcdef", "[REDACTED]", many)


def test_added_spans_keep_clear_of_base_ones(spark):
    r = random.Random(13)
    rows = []
    for k in range(60):
        mine = lambda n, kind: sorted({(a, kind() if callable(kind) else kind, a + r.randint(1, 9)) for a in (r.randrange(60) for _ in range(r.randint(0, n)))})
        rows.append((k, mine(6, lambda: r.randrange(3)), (more := mine(8, 3)) + more[:2]))
    df = spark.createDataFrame(rows, f"k int, base array<{secret_scan.SPAN}>, more array<{secret_scan.SPAN}>")
    for row in df.select("k", "base", "more", secret_scan.add_clear(F.col("base"), F.col("more")).alias("out")).collect():
        clear = {tuple(e) for e in row.more if not any(b.start < e.end and e.start < b.end for b in row.base)}
        assert [tuple(x) for x in row.out] == sorted([tuple(b) for b in row.base] + list(clear))

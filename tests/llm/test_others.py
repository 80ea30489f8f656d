"""Vectors, archives, components and the pipeline."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import block_knn, merkle_audit
from sparkloom.llm.common import id_filter, id_hash, passes
from sparkloom.llm.graph import connected_components

from .conftest import EDGE, prose


def brute_knn(vecs, k=5):
    ok = {}
    for i, v in vecs:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        found = [(-(ok[q] @ ok[j]) / (np.sqrt(ok[q] @ ok[q]) * np.sqrt(ok[j] @ ok[j])), j) for j in ok if j != q and len(ok[j]) == len(ok[q])]
        out[q] = sorted((round(s, 9), j) for s, j in found)[:k]
    return out


def test_knn_is_exact(spark):
    r = np.random.default_rng(3)
    vecs = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(260)]
    vecs += [(300, vecs[0][1]), (301, vecs[0][1]), (350, None), (400, [0.0] * 8), (450, [float("nan")] + [1.0] * 7), (500, [None] + [1.0] * 7), (550, [1.0, 2.0]), (551, [2.0, 1.0]), (None, [1.0] * 8), (600, []), (650, [float("inf")] * 8)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("vec", F.lit(1)).withColumn("across", F.lit(1))
    got = {}
    for row in block_knn.knn(df, F.pmod("vec_id", F.lit(50)) == 0, query_tile=3, candidate_tile=40).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((round(-row.score, 9), row.vec_id))
    assert got == {q: x for q, x in brute_knn(vecs).items() if x}
    assert block_knn.knn(df.limit(0), F.lit(True)).count() == 0


def test_quantisation_bound_holds():
    r = np.random.default_rng(1)
    u = r.normal(size=(200, 16))
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    codes, scale, err = block_knn.quantise(u)
    near = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(near - u @ u.T) <= err[:, None] + (1 + err[:, None]) * err[None, :] + 1e-9).all()


def test_audit_finds_what_differs(spark):
    pages = [(i, f"http://h/{i % 7}", "<p>" + "x" * (i * 13 % 900) + "</p>") for i in range(3000)] + [(None, "http://n", "x"), (5000, None, None), (7, "http://h/0", "again"), (7, "http://h/0", "again")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("offset", F.lit(1)).repartition(4)
    ours = merkle_audit.archive_records(df, pages_per_file=256).persist()
    assert merkle_audit.audit(ours, ours).count() == 0
    bad = {17: "corrupt", 900: "corrupt", 901: "missing", 2999: "missing", 5000: "corrupt", 9999: "extra"}
    damaged = df.where("page_id IS NULL OR page_id NOT IN (901, 2999)").withColumn("html", F.when(F.col("page_id").isin([17, 900, 5000]), "0").otherwise(F.col("html")))
    damaged = damaged.unionByName(df.where("page_id = 5").withColumn("page_id", F.lit(9999).cast("long")))
    theirs = merkle_audit.archive_records(damaged, pages_per_file=256)
    got = merkle_audit.audit(ours, theirs).collect()
    assert {r.record_id: r.status for r in got} == bad and len(got) == len(bad)
    lone = merkle_audit.archive_records(df.where("page_id IS NOT NULL"), pages_per_file=256)
    assert [(r.record_id, r.status) for r in merkle_audit.audit(ours, lone).collect()] == [(None, "missing")]
    assert merkle_audit.audit(ours.limit(0), ours.limit(0)).count() == 0
    assert merkle_audit.audit(ours.limit(0), ours).count() == ours.count()


def test_warc_files_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i % 5 else None, "é" * i + "\r\n\r\nWARC/1.0\r\n" if i % 7 == 0 else "x" * i) for i in range(40)] + [(40, "a\r\nb", None)], "page_id long, url string, html string")
    ours = merkle_audit.archive_records(pages, pages_per_file=16)
    text = merkle_audit.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    for row in pages.select(F.floor(F.col("page_id") / 16).alias("file"), "page_id", text.alias("t")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page_id", "t"))).alias("r")).collect():
        (tmp_path / f"{row.file}.warc").write_bytes(b"".join(x.t.encode() for x in row.r))
    key = lambda df: sorted(tuple(r) for r in df.select("file", "record_id", "offset", "length", "digest").collect())
    assert key(merkle_audit.read_warc(spark, str(tmp_path))) == key(ours)
    data = bytearray((tmp_path / "1.warc").read_bytes())
    data[len(data) // 2] ^= 1  # one bit
    (tmp_path / "1.warc").write_bytes(bytes(data))
    got = merkle_audit.audit(ours, merkle_audit.read_warc(spark, str(tmp_path))).collect()
    assert {(r.file, r.status) for r in got} <= {(1, "corrupt"), (1, "missing"), (1, "extra")} and 1 <= len(got) <= 3


def test_tree_changes_with_any_record(spark):
    df = spark.createDataFrame([(i, "u", f"h{i}") for i in range(100)], "page_id long, url string, html string")
    roots = set()
    for k in (None, 3, 99):
        r = merkle_audit.archive_records(df.withColumn("html", F.when(F.col("page_id") == k, "changed").otherwise(F.col("html"))), 16)
        roots.add(tuple(x.hash for x in merkle_audit.tree(r, 1, 2)[-1].collect()))
    assert len(roots) == 3


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (3, 2), (200, 199)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), 199: 199, 200: 199}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_filter_has_no_false_negatives(spark):
    ids = spark.range(0, 3000, 3)
    bits = id_filter(ids, "id", 1 << 16)
    rows = spark.range(3000).select("id", id_hash("id", 1 << 16).alias("h")).toPandas()
    ok = passes(bits, rows.h.to_numpy())
    assert ok[rows.id % 3 == 0].all() and ok.mean() < 0.5


def test_pipeline_stages(spark, make, tmp_path):
    import corpus_pipeline

    key = "abcdef1234567890abcdef12"
    item = prose(900, 40)
    rows = [(i, prose(i, 80), "en") for i in range(30)] + [(i, "le chat noir dort sur la grande table de la cuisine " * 4 + str(i), "fr") for i in (40,)]
    rows += [(50, prose(0, 80), "en"), (51, prose(60, 20) + " " + item + " " + prose(61, 20), "en"), (52, prose(62, 50) + f" token = {key}", "en"), (53, "... 12 34", "en")] + [(*e, "en") for e in EDGE[:3]]
    make(rows, extra=False).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
    clean = set(range(30)) | {40, 50, 51, 52}
    assert kept["language_id"] == clean
    assert kept["minhash_near_dedup"] == clean - {50}
    assert kept["decontamination"] == kept["secret_scan"] == kept["best_fit_packing"] == clean - {50, 51}
    text = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/secret_scan").collect()}
    assert key not in text[52].text and text[52].n_chars == len(text[52].text) and text[0].text == prose(0, 80)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))

"""Retrieval, graph, relations, files and streams on small inputs."""

import datetime as dt
import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from canonry.operators import graph as G
from canonry.operators import retrieval as R
from canonry.operators.relations import case_insensitive_names, extract_relations, passive_chains
from canonry.operators.sessions import history_window
from canonry.sources import files
from canonry.streaming.windows import live_uploads, rolling_history, tumbling, upsert_batches, upserted


def test_knn_is_exact(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 8)).astype("float32")
    data[7] = data[3]
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900, [0.0] * 8), (901, None), (902, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.where("vec_id in (3, 50, 900)").withColumnRenamed("vec_id", "query_id")
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    for bytes_ in (64, 1 << 20):
        got = R.dense_knn(df, queries, 4, block_bytes=bytes_).collect()
        for q in (3, 50):
            want = sorted(range(200), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:4]
            assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert R.dense_knn(df, queries.limit(0), 4).count() == 0


def test_fusion_and_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in R.fuse_ranks([a, b], 3, "doc_id").orderBy("rank").collect()] == [11, 10, 12]
    positions = spark.range(1, 8).select(R.interleaved(F.col("id"), F.lit(7))).collect()
    assert sorted(p[0] for p in positions) == list(range(1, 8)) and [p[0] for p in positions][:3] == [1, 7, 2]


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "missing"), (3, "")], "query_id long, query string")
    got = R.bm25_topk(R.bm25_index(docs), asked, 5).collect()
    assert [(r.query_id, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (1, 1)]


def brute_chains(edges):
    one = {(a, b) for a, b in edges if a != b}
    out = []
    for e in one:
        two = [f for f in one if f[0] == e[1]]
        three = [g for f in two for g in one if g[0] == f[1] and g != e]
        out += [(*e, len(two), len(three), min(f[1] for f in two))] if two else []
    return sorted(out)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "R", "a"), ("c", "S", "d"), ("x", "R", "y")], "src string, type string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert sorted((r.id, r.depth) for r in G.closure(seeds, edges, 5).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert [tuple(r) for r in G.shortest_path(edges, "a", "d").collect()] == [("d", 2)]
    assert G.shortest_path(edges, "a", "d", 1).count() == 0 and G.shortest_path(edges, "a", "y").count() == 0 and G.shortest_path(edges, None, "y").count() == 0
    assert [tuple(r) for r in G.shortest_path(edges, "a", "a").collect()] == [("a", 0)]
    assert sorted((r.first, r.second, r.two, r.three, r.onward) for r in G.chains(edges).collect()) == brute_chains([tuple(r) for r in edges.select("src", "dst").collect()])
    assert [r.id for r in G.ghosts(edges, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), ["S"]).collect()] == ["d"]
    use = spark.createDataFrame([("d1", "e"), ("d2", "e"), ("d1", "e"), ("d3", "hot"), ("d1", "hot"), ("d2", "hot")], "o string, i string")
    assert [tuple(r) for r in G.rare_siblings(use, "o", "i", 3).collect()] == [("d1", "d2", 1)]


def test_relations(spark):
    body = "CỘNG HÒA\nCăn cứ Luật Đất đai năm 2024 đã được sửa đổi, bổ sung theo 8/2015/NĐ-B; căn cứ 9/2011/TT-E, 9/2012/TT-F;\nĐiều 1. Phạm vi\nBãi bỏ 6/2011/TT-C; sửa đổi Khoản 3 của 7/2012/TT-D và 1/2020/QĐ-A; thay thế Bộ luật Dân sự.\nĐiều 2. Thi hành\nÁp dụng 12/QĐ-UBND và Luật Sông nước năm 2001; Bộ Tài chính"
    texts = spark.createDataFrame([("1/2020/QĐ-A", body, "x"), ("2/2020/QĐ-A", None, "x"), (None, "5/2010/NĐ-B", "x"), ("3/2020/QĐ-A", "", "x")], "number string, text string, target string")
    got = {r.target: (r.number, r.edge_label, r.target_article, r.target_clause, r.is_cross_doc) for r in extract_relations(texts, "number", "text").collect()}
    own = "1/2020/QĐ-A"
    assert got["6/2011/TT-C"] == (own, "REPEALS", "Điều 1", "Khoản 3", False) and got["7/2012/TT-D"] == (own, "AMENDS", "Điều 1", "Khoản 3", False)
    assert got["91/2015/QH13"] == (own, "REPLACES", "Điều 1", "Khoản 3", False)
    assert got["12/QĐ-UBND"][1:3] == ("APPLIES", "Điều 2") and got["Luật Sông Nước năm 2001"][1:3] == ("APPLIES", "Điều 2")
    assert got["9/2011/TT-E"][1] == "BASED_ON" and own not in got
    assert {(r.number, r.edge_label, r.is_cross_doc) for r in extract_relations(texts, "number", "text").where("target = '31/2024/QH15'").collect()} == {(own, "BASED_ON", False), ("8/2015/NĐ-B", "AMENDS", True)}
    chains = {(r.number, r.changed, r.by, r.edge_label) for r in passive_chains(texts, "number", "text").collect()}
    assert chains == {(own, "31/2024/QH15", "8/2015/NĐ-B", "AMENDS"), (own, "31/2024/QH15", None, "BASED_ON")}
    assert extract_relations(texts.limit(0), "number", "text").count() == 0


def test_history_window(spark):
    rows = [("s", i) for i in range(40)] + [("t", 1)]
    out = history_window(spark.createDataFrame(rows, "session string, id long"), "session", ["id"], 14, 2).where("session = 's'").orderBy("place").collect()
    assert [r.id for r in out] == list(range(24, 38)) and [r.place for r in out] == list(range(1, 15))


def test_files(spark, tmp_path):
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Điều 1</w:t></w:r></w:p><w:p><w:r><w:t>Hai</w:t></w:r></w:p></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", word)
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.txt").write_text("chữ", "utf-8")
    (tmp_path / "c.doc").write_bytes(b"\xd0\xcf" + "Quyết định về bến bãi và luồng lạch".encode("utf-16-le"))
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\nstream\nBT (Article 1) Tj ET\nendstream")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.png").write_bytes(b"x")
    got = {r.path.rsplit("/")[-1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Điều 1\nHai" and got["b.txt"].text == "chữ" and got["d.pdf"].text == "Article 1"
    assert "bến bãi" in got["c.doc"].text and got["e.docx"].text is None and got["e.docx"].error and "f.png" not in got
    assert files.read_ids(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "ids.csv").write_text("id,x\n 1,a\n1,b\n2,c\n")
    assert sorted(r.id for r in files.read_ids(spark, str(tmp_path / "ids.csv")).collect()) == ["1", "2"]
    df = spark.createDataFrame([(1, 2019, True, 1), (1, 2020, True, 2), (2, 2020, None, 1)], "id long, year int, active boolean, v long")
    assert [r.v for r in files.upsert(df.limit(0), df, ["id"], [F.col("v")]).orderBy("id").collect()] == [2, 1]
    assert files.deactivate(df, "active", F.col("id") == 1).where("active").count() == 0
    assert files.pending(df, df.where("id = 1"), ["id"]).count() == 1 and files.duplicate_keys(df, ["id"]).count() == 1
    files.write_partitioned_csv(df, str(tmp_path / "out"), ["year"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_streams(spark, tmp_path):
    schema = "session_id string, id long, ts timestamp, content string"
    t = dt.datetime(2024, 1, 1)
    source = str(tmp_path / "in")
    spark.createDataFrame([("s", i, t + dt.timedelta(seconds=i), f"m{i}") for i in range(20)], schema).coalesce(1).write.parquet(source)
    stream = rolling_history(spark.readStream.schema(schema).parquet(source), 14)
    query = stream.writeStream.outputMode("update").format("memory").queryName("rolling").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    ended = query.awaitTermination(60)
    query.stop()
    assert ended
    assert [r.id for r in spark.table("rolling").orderBy("place").collect()] == list(range(6, 20))

    target = str(tmp_path / "state")
    write = upsert_batches(target, "session_id", "id", compact_every=2)
    state = lambda: sorted((r.session_id, r.content) for r in upserted(spark, target, "session_id", "id").collect())
    assert upserted(spark, target, "session_id", "id") is None
    one = spark.createDataFrame([("s", 1, t, "old"), ("u", 1, t, "x")], schema)
    write(one, 0)
    write(spark.createDataFrame([("s", 2, t, "new")], schema), 1)
    assert state() == [("s", "new"), ("u", "x")]
    for n in range(2, 7):
        # a batch that is tried again replaces itself
        for _ in range(2):
            write(spark.createDataFrame([("s", 1 + n, t, f"v{n}"), (f"k{n}", 1, t, "y")], schema), n)
    assert state() == sorted([("s", "v6"), ("u", "x"), *((f"k{n}", "y") for n in range(2, 7))])
    assert {p.name for p in (tmp_path / "state").iterdir()} == {"base_3", "base_5", "batch_4", "batch_5", "batch_6"}
    events = spark.createDataFrame([(t, "a", 1.0), (t + dt.timedelta(minutes=59), "a", 2.0), (t + dt.timedelta(hours=1), "a", 4.0)], "ts timestamp, kind string, value double")
    assert [r.total for r in tumbling(events, "ts", "1 hour", ["kind"]).orderBy("w").collect()] == [3.0, 4.0]
    uploads = spark.createDataFrame([("s", "d1", t, 1), ("s", "d2", t + dt.timedelta(seconds=200), 1), ("u", "d3", t - dt.timedelta(days=1), 1)], "session_id string, document_id string, at timestamp, n int")
    assert [r.document_id for r in live_uploads(uploads, "at", t + dt.timedelta(seconds=250)).collect()] == ["d2"]


def test_shortest_path_against_brute_force(spark):
    import random

    rng = random.Random(2)
    pairs = sorted({(f"v{a}", f"v{b}") for a in range(14) for b in (a + 1, a + rng.randint(1, 3)) if a != 6} | {("v0", "v0"), ("z1", "z2")})
    edges = spark.createDataFrame([(a, "R", b) for a, b in pairs], "src string, type string, dst string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def steps(start, goal):
        level, seen, n = {start}, {start}, 0
        while level and goal not in level:
            level = {y for x in level for y in near.get(x, ())} - seen
            seen |= level
            n += 1
        return n if goal in level else None

    for start, goal in (("v0", "v6"), ("v0", "v14"), ("v7", "v13"), ("v0", "z2"), ("v3", "v4")):
        want = steps(start, goal)
        assert [r.steps for r in G.shortest_path(edges, start, goal).collect()] == ([] if want is None else [want])


def test_stored_tables_follow_their_sources(spark, tmp_path):
    from canonry.session import stored

    path, calls = f"{tmp_path}/t.parquet", []

    def build():
        calls.append(1)
        return spark.read.parquet(path).groupBy("k").count()

    read = lambda: sorted(map(tuple, stored(spark, "test", [path], build, "k").select("k", "count").collect()))
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(path)
    assert read() == read() == [("a", 1), ("b", 1)] and len(calls) == 1
    spark.createDataFrame([("a", 3)], "k string, v int").write.mode("append").parquet(path)
    assert read() == [("a", 2), ("b", 1)] and len(calls) == 2

"""Sources and sinks beyond plain files: large JSON arrays, listing streams, commits, state."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lakeseek.sources import json_array

ODD = ['{"a": "x\\"]}", "b": [1, {"c": "\\\\"}]}', '{"t": "[{\\\\\\""}', "{}", '{"bids": [1, 2]}', '{"é": "ü{[\\\\\\\\", "n": null}']


def test_json_array_by_ranges(spark, tmp_path):
    rng = random.Random(2)
    items = [rng.choice(ODD) for _ in range(40)] + ['{"long": "' + "y\\\\" * 300 + '"}']
    text = '{"count": 3, "other": {"bids": [{"no": 1}]}, "bids" : [\n ' + " ,\n".join(items) + "\n], \"later\": [{\"no\": 2}, {\"no\": 3}]}"
    path = tmp_path / "all.json"
    path.write_text(text)
    wanted = sorted(json.dumps(x, sort_keys=True) for x in json.loads(text)["bids"])
    for size in (1 << 20, len(text.encode()) // 8 + 1, 37, 11):
        found = json_array.read_array(spark, f"file://{path}", range_bytes=size).collect()
        assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in found) == wanted
    rows = json_array.read_array(spark, str(path), schema="a string, t string", range_bytes=100)
    assert rows.where("a is not null").count() == items.count(ODD[0])


@pytest.mark.parametrize("size", [1 << 20, 5])
def test_json_array_errors(spark, tmp_path, size):
    cases = {
        '{"other": [], "x": "bids"}': "no top-level array",
        '{"bids": [{"a": 1}, {"b": 2}': "not closed",
        '{"bids": [{"a": 1}, 7, {"b": 2}]}': "must be an object",
        '{"bids": ["a"]}': "must be an object",
        '{"bids": [[1]]}': "must be an object",
        '{"bids": [{"a": 1}, {"b" 2}]}': "malformed",
    }
    for i, (text, message) in enumerate(cases.items()):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match=message):
            json_array.read_array(spark, str(tmp_path / f"{i}.json"), range_bytes=size).collect()
    (tmp_path / "empty.json").write_text('{"bids": []}')
    assert json_array.read_array(spark, str(tmp_path / "empty.json"), range_bytes=size).count() == 0


def files_read(df) -> int:
    """Files that the scans of a query that has run have opened."""

    def leaves(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return leaves(plan.executedPlan())
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            return leaves(plan.plan())
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return [leaf for child in below for leaf in leaves(child)] if below else [plan]

    scans = leaves(df._jdf.queryExecution().executedPlan())
    return sum(scan.metrics().get("numFiles").get().value() for scan in scans if scan.metrics().contains("numFiles"))


def test_vector_index(spark, tmp_path):
    import numpy as np

    from lakeseek.operators import dense
    from lakeseek.operators.vector_index import VectorIndex, recall

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16)) * 4
    x = centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 16)) * 0.3
    x[100:140] = x[100]  # equal rows: ties go by id
    table = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "chunk_id long, embedding array<double>, label int")
    queries = table.where("chunk_id % 100 = 0").selectExpr("chunk_id as query_id", "embedding as query")
    for metric in ("l2", "l2sq", "cosine"):
        path = str(tmp_path / metric)
        VectorIndex.save(table, path, 24, metric)
        index = VectorIndex.load(spark, path)
        assert index.rows.count() == 3000 and sum(index.counts) == 3000
        for q, condition in ((x[5], None), (x[100] * 1.01, F.col("label") == 3), (rng.standard_normal(16), F.col("chunk_id") == 17)):
            want = dense.knn(table, q.tolist(), 12, condition, metric).select("chunk_id", F.round("distance", 9), "dense_rank").collect()
            found = index.search(q.tolist(), 12, condition)
            assert sorted(found.select("chunk_id", F.round("distance", 9), "dense_rank").collect()) == sorted(want)
        # Few cells hold what can be near: the others aren't read.
        near = index.search(x[5].tolist(), 12)
        near.collect()
        assert 0 < files_read(near) < 0.3 * len(index.rows.inputFiles())
        many = index.search_many(queries, 5, probes=2)
        assert sorted(many.select("query_id", "chunk_id", "dense_rank").collect()) == sorted(dense.knn_batch(table, queries, 5, metric).select("query_id", "chunk_id", "dense_rank").collect())
    assert recall(index, queries, 5, 3) >= 0.9
    with pytest.raises(ValueError, match="ip"):
        VectorIndex.save(table, path, 4, "ip")


def test_many_queries_in_blocks(spark, tmp_path, monkeypatch):
    """Queries in several blocks and tiles find what brute force does, without a join of rows and queries."""
    import numpy as np

    from lakeseek.operators import dense, vector_index

    rng = np.random.default_rng(5)
    x = rng.standard_normal((1200, 6))
    x[:30] = x[0]
    table = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "chunk_id long, embedding array<double>, label int")
    queries = table.where("chunk_id % 10 = 0").selectExpr("concat('q', chunk_id) as query_id", "embedding as query")
    for name, value in (("QUERY_NUMBERS", 300), ("ROWS", 16)):
        monkeypatch.setattr(vector_index, name, value)
    monkeypatch.setattr(dense, "TILE", 7)
    vector_index.VectorIndex.save(table, str(tmp_path), 9)
    index = vector_index.VectorIndex.load(spark, str(tmp_path))
    for condition in (None, F.col("label") == 1, F.col("chunk_id") < 3):
        many = index.search_many(queries, 4, condition, probes=1)
        want = dense.knn_batch(table if condition is None else table.where(condition), queries, 4)
        rows = lambda df: sorted(df.select("query_id", "chunk_id", F.round("distance", 9), "dense_rank").collect())
        assert rows(many) == rows(want)
        assert "Join" not in many._jdf.queryExecution().toString()
    approximate = index.search_many(queries, 4, probes=2, exact=False)
    assert approximate.groupBy("query_id").count().where("count = 4").count() == 120


def test_blocks_are_skipped(spark, tmp_path):
    from lakeseek.operators import lexical
    from lakeseek.operators.blocks import BlockedIndex

    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, rng.choice(["", "w1 w2", "w3"]), " ".join(rng.choices(words, [30 / (k + 1) for k in range(30)], k=rng.choice([4, 30, 200])))) for i in range(1500)]
    index = lexical.LexicalIndex.build(spark.createDataFrame(rows, "chunk_id long, title string, text string"))
    BlockedIndex.save(index, str(tmp_path / "b"), 32)
    blocked = BlockedIndex.load(spark, str(tmp_path / "b"))
    for phrases in ([["w1"], ["w7"]], [["w20"], ["w20"], ["w2"]], [["none"]], [["w1", "w2"]]):
        found, counts = blocked.search(phrases, 10)
        want = lexical.bm25(index, phrases).orderBy("score", "chunk_id").limit(10)
        assert [(r.chunk_id, round(r.score, 12)) for r in found.collect()] == [(r.chunk_id, round(r.score, 12)) for r in want.collect()]
        if phrases[0] == ["w1"] and len(phrases) == 2:
            assert 0 < counts["scored"] < 0.8 * counts["blocks"]


def test_query_tables_handle_odd_queries(spark):
    from lakeseek.operators import lexical, lexical_batch
    from lakeseek.plans import hybrid

    rows = [(1, "Desk chair", "wood chair and oak-table", "GEM/2024/B/1"), (2, "", "table oak oak-table chair", "GEM/2024/B/2"), (3, "Oak table", "steel lamp", None), (4, "Lamp", "a b c", "GEM/2024/B/4")]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, text string, bid_id string").withColumn("embedding", F.array(F.col("chunk_id").cast("double"), F.lit(1.0)))
    index = lexical.LexicalIndex.build(chunks)
    asked = ["chair", "oak-table lamp", "chair chair table", "gem/2024/b/4", "", None, "the of", "zzz"]
    table = spark.createDataFrame([(i, q, [1.0, 1.0] if i % 2 else None) for i, q in enumerate(asked)], "query_id long, query string, embedding array<double>")
    from lakeseek.functions.text import query_phrases, query_terms

    found = {(r.query_id, r.chunk_id): r.score for r in lexical_batch.bm25(index, table).collect()}
    want = {(i, r.chunk_id): round(r.score, 9) for i, q in enumerate(asked) if q for r in lexical.bm25(index, query_phrases(q)).collect()}
    assert found == pytest.approx(want, abs=1e-9)
    for i in (0, 1, 3, 7):
        one = hybrid.search(chunks, index, asked[i], vectors=chunks.select("chunk_id", "embedding"), query_embedding=[1.0, 1.0] if i % 2 else [1e6, 1e6], limit=3, id_column="bid_id")
        many = hybrid.search_many(chunks, index, table.where(F.col("query_id") == i), vectors=chunks.select("chunk_id", "embedding"), limit=3, id_column="bid_id")
        assert sorted((r.chunk_id, round(r.score, 9)) for r in many.collect()) == sorted((r.chunk_id, round(r.score, 9)) for r in one.collect())
    assert {r.query_id for r in hybrid.search_many(chunks, index, table, vectors=chunks.select("chunk_id", "embedding")).collect()}.isdisjoint({4, 5})
    assert query_terms("the of") == []


def test_listing_as_a_stream(spark, tmp_path):
    """Three runs with one checkpoint give each candidate once; a run reads only until pages are known."""
    from lakeseek.sources import listing

    folder = tmp_path / "portal"
    folder.mkdir()

    def entry(i):
        auction = i % 5 == 0
        return {"b_id": [i], "b_bid_number": [f"GEM/2024/{'R' if auction else 'B'}/{i}"], **({"b_id_parent": [i - 1], "b_bid_number_parent": [f"GEM/2024/B/{i - 1}"]} if auction else {})}

    def fetch(page: int) -> list[dict]:
        newest = int((folder / "newest").read_text())
        with (folder / "asked").open("a") as f:
            f.write(f"{page}\n")
        first = newest - 4 * page
        return [entry(i) for i in range(first, max(first - 4, 0), -1)]

    spark.dataSource.register(listing.listing_source(fetch, "portal_stream"))
    asked = []
    for newest in (40, 43, 43):
        (folder / "newest").write_text(str(newest))
        (folder / "asked").write_text("")
        found = listing.candidates(spark.readStream.format("portal_stream").load()).dropDuplicates(["bid_id"])
        run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
        asked.append(max([int(x) for x in (folder / "asked").read_text().split()], default=-1))
    rows = [r.bid_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == [i for i in range(1, 44) if i % 5]
    assert asked[0] == 10 and asked[1] <= 5 and asked[2] <= 3


def test_listing_options(spark, tmp_path):
    from lakeseek.sources import listing

    log = tmp_path / "log"
    log.write_text("")

    def fetch(page: int) -> list[dict]:
        with log.open("a") as f:
            f.write("page\n")
        return [{"b_id": [page], "b_bid_number": [f"GEM/2024/B/{page}"]}] if page < 6 else []

    def lookup(number: str) -> list[dict]:
        with log.open("a") as f:
            f.write("lookup\n")
        return [{"b_id": [int(number[-1])], "b_bid_number": [number]}, {"b_id": [99], "b_bid_number": ["other"]}]

    spark.dataSource.register(listing.listing_source(fetch, "options_listing", lookup))
    one = spark.read.format("options_listing").option("bidNumbers", "GEM/2024/B/4,none1").load()
    assert sorted(r.b_id for r in one.collect()) == [1, 4] and log.read_text().split() == ["lookup"] * 2
    assert spark.read.format("options_listing").load().count() == 6
    found = listing.candidates(spark.read.format("options_listing").load())
    known = spark.createDataFrame([(i,) for i in range(6)], "bid_id long")
    assert listing.until_known(found, known).count() == 3 and listing.until_known(found, known, full_sync=True).count() == 6


def test_files_are_committed(spark, tmp_path):
    """A task that fails once leaves no half and no double file; a job that fails leaves nothing."""
    from lakeseek.sources import sinks

    spark.dataSource.register(sinks.FileSink)
    rows = spark.range(30).selectExpr("concat('d/', id, '.pdf') as name", "cast(repeat(cast(id as string), 3) as binary) as content")
    rows.repartition(4).write.format("files").mode("append").save(f"file://{tmp_path}/out")
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(f"d/{i}.pdf" for i in range(30))
    assert (tmp_path / "out" / "d" / "7.pdf").read_bytes() == b"777"
    bad = rows.selectExpr("name", "if(name = 'd/9.pdf', cast(raise_error('no') as binary), content) as content")
    with pytest.raises(Exception, match="no"):
        bad.repartition(1).write.format("files").mode("append").save(f"file://{tmp_path}/bad")
    assert [p for p in (tmp_path / "bad").rglob("*") if p.is_file()] == []


def test_manifest_in_parts(spark, tmp_path):
    from lakeseek.sources import sinks

    rows = spark.range(1000).selectExpr("id as bid_id", "concat('n\"', id) as bid_number", "cast(null as string) as pdf_path", "'2024-01-01' as download_date", "'t' as downloaded_at")
    path = f"file://{tmp_path}/manifest.json"
    for n in (1000, 0, 400):
        sinks.write_manifest(rows.where(F.col("bid_id") < n).repartition(7), path, "2024-01-02")
        whole = json.loads((tmp_path / "manifest.json").read_text())
        assert whole["downloaded_bid_ids"] == list(range(n)) and list(whole["bid_records"]) == [str(i) for i in range(n)]
        assert sorted(map(str, sinks.read_manifest(spark, path).collect())) == sorted(map(str, rows.where(F.col("bid_id") < n).collect()))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["manifest.json"]


def test_newness_keeps_its_state(spark, tmp_path):
    """Each id counts once, also over restarts; what is no longer new is told once; late rows are counted."""
    from lakeseek.streaming import ingest

    out, late = [], []
    for rows in [[(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"), (1, "2024-01-01 05:00:00")], [(1, "2024-01-03 00:00:00"), (3, "2024-01-20 00:00:00")], [(4, "2024-01-21 00:00:00"), (5, "2024-01-02 00:00:00")]]:
        spark.createDataFrame(rows, "bid_id long, at string").selectExpr("bid_id", "cast(at as timestamp) as at").write.mode("append").json(str(tmp_path / "in"))
        events = spark.readStream.schema("bid_id long, at timestamp").json(str(tmp_path / "in"))
        changes = ingest.newness_changes(events, "bid_id", "at", days=7)
        run = changes.writeStream.foreachBatch(lambda batch, _: out.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
        late.append(sum(int(s["numRowsDroppedByWatermark"]) for p in run.recentProgress for s in p["stateOperators"]))
    assert sorted((k, what) for k, what, _ in out) == [(1, "new"), (1, "old"), (2, "new"), (2, "old"), (3, "new"), (4, "new")]
    assert late[:2] == [0, 0] and late[2] >= 1


def parse_pdf(content: bytes) -> str:
    return content.decode()


def embed_texts(texts: list[str]) -> list[list[float]]:
    return [[float("Desk" in t or "desk" in t), float("Lamp" in t or "lamp" in t)] for t in texts]


def test_extract_embed_and_search_commands(spark, tmp_path):
    from lakeseek.__main__ import main

    folder = tmp_path / "pdf"
    folder.mkdir()
    for i, what in enumerate(["Desk", "Lamp", "Lamp"], 1):
        (folder / f"bid_{i}.pdf").write_text(f"Bid Number: GEM/2024/B/{i}\nItem Category\n{what}\nGeMARPTS\n")
    base = ["--store", f"file://{tmp_path}/s"]
    extract = ["extract", *base, "--folder", f"file://{folder}", "--parser", "tests.test_sources:parse_pdf"]
    assert json.loads(main(extract)[0])["parsed"] == 3 and json.loads(main(extract)[0])["parsed"] == 0
    embed = ["embed", *base, "--embedder", "tests.test_sources:embed_texts"]
    assert json.loads(main([*embed, "--limit", "4"])[0])["upsert"] == 4 and json.loads(main(embed)[0])["upsert"] == 2
    found = [json.loads(x) for x in main(["search", *base, "lamp", "--where", '{"bid_id": {"$ne": "GEM/2024/B/2"}}'])]
    assert {r["bid_id"] for r in found} == {"GEM/2024/B/3"}
    both = [json.loads(x) for x in main(["search", *base, "desk", "--embedder", "tests.test_sources:embed_texts", "--limit", "2"])]
    assert {r["bid_id"] for r in both} == {"GEM/2024/B/1"}

"""Rules on edge-case strings, the filter compiler, sources, stores and the maintenance run."""

import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakeseek.functions import dates, fields, text
from lakeseek.operators import lexical
from lakeseek.operators.where import where
from lakeseek.plans import maintenance
from lakeseek.sources import files, listing, store


def values(spark, rows, kind, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(column).collect()]


def test_dates(spark):
    x = F.col("x")
    assert values(spark, ["10-07-2026", "10-07-26", "1-2-99", "2026/07/30", "", None, "45-13-2026"], "string", dates.parse_date(x)) == ["2026-07-10", "2026-07-10", "1999-02-01", "2026/07/30", None, None, "45-13-2026"]
    stored = values(spark, ["30-07-2026 21:00:00", "2026-07-30", " N/A ", "", "45-13-2026", None], "string", dates.stored_end(x))
    assert stored == [datetime(2026, 7, 30, 21), datetime(2026, 7, 30), None, None, None, None]
    now = F.lit("2026-01-08 00:00:00").cast("timestamp")
    assert values(spark, ["2026-01-01T00:00:00Z", "2026-01-01T00:00:01Z", "2026-01-08T00:00:00", "2026-01-08T00:00:01Z", "2026-01-07T23:00:00+05:30", "soon", None], "string", dates.is_new(x, now)) == [False, True, True, False, True, False, False]


def test_fields(spark):
    x = F.col("x")
    label = "Turnover"
    lines = [[label, v] for v in ("50 Lakh (s)", "20 lakh", "Rs. 1,200.50 crore", "N/A.", ",", "x 7 Crore")]
    found = values(spark, lines, "array<string>", fields.turnover(x, label))
    assert [(r["value"], r["unit"]) for r in found] == [(50.0, "Lakh"), (20.0, "lakh"), (None, "Lakh"), (None, "Lakh"), (None, "Lakh"), (7.0, "Crore")]
    assert values(spark, [["MII", "note", "yes"], ["MII", "Yes"], ["MII"], ["x"]], "array<string>", fields.preference(x, "MII")) == [False, True, False, False]
    assert values(spark, [["EMD Detail", "Required", "No", "EMD Amount", "5"], ["EMD Detail", "EMD Amount"], ["EMD Detail", "EMD Amount", "1,000 Rs"]], "array<string>", fields.emd(x)["amount"]) == [None, None, 1000.0]
    assert values(spark, [10000000.0, 0.5, 12.25], "double", text.plain_number(x)) == ["10000000.0", "0.5", "12.25"]


def test_conditions_are_searched_once(spark):
    """Fields that the chunk builders use several times aren't searched for again at each use."""
    from lakeseek.operators import extract

    docs = spark.createDataFrame([("a/1.pdf", "OEM Average Turnover\nRs 12 crore\nMinimum 20% and 50% Local Content")], "path string, text string")
    chunks = extract.chunks(extract.metadata(docs, "", F.lit("2024-01-01")))
    assert {r.text for r in chunks.collect()} == {"OEM average turnover required: 12.0 crore.", "Local content requirement: minimum 20% (Class I) / 50% (Class II)."}
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Local\\s*Content") == 2 and plan.count("OEM Average Turnover") <= 4


def test_bid_documents_are_dealt_before_texts(spark, sf):
    """What is shuffled are keys and names, not the texts made of them."""
    from lakeseek import fixtures

    plan = fixtures._bid_documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    exchange = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert any("Bid Number" in line for line in plan[:exchange]) and not any("Bid Number" in line for line in plan[exchange:])


def test_query_parsing():
    assert text.query_terms("5G routers for A4 items OR 5 of ab") == ["5g", "routers", "a4"]
    assert text.query_phrases("GEM/2024/B foo-bar 1.5 -- café x") == [["gem"], ["2024"], ["foo", "bar"], ["1", "5"], ["cafe"]]
    assert text.is_bid_id(" gem/2024/b/12 ") and not text.is_bid_id("GEM/24/B/1")


def test_bm25_against_sqlite(spark):
    rows = [(1, "Desk chair", "wood chair and oak-table"), (2, "", "table oak oak-table chair"), (3, "Oak table", "steel lamp"), (4, "Lamp", "a b c"), (5, "x", "y")]
    index = lexical.LexicalIndex.build(spark.createDataFrame(rows, "chunk_id long, title string, text string"))
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(id unindexed, title, text, tokenize='unicode61 remove_diacritics 2')")
    c.executemany("insert into t values (?, ?, ?)", rows)
    for q in ("chair", "oak-table lamp", "chair chair table"):
        phrases = text.query_phrases(q)
        match = " OR ".join('"' + " ".join(p) + '"' for p in phrases)
        wanted = {r[0]: r[1] for r in c.execute("select id, bm25(t, 0.0, 3.0, 1.0) from t where t match ?", (match,))}
        found = {r.chunk_id: r.score for r in lexical.bm25(index, phrases).collect()}
        assert found == pytest.approx(wanted, abs=1e-9)


def test_where(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, None, 5), (3, "b", None)], "i int, s string, n int")
    ids = lambda c, **k: {r.i for r in rows.where(where(c, **k)).collect()}
    assert ids({}) == ids(None) == ids({"$and": []}) == {1, 2, 3} and ids({"$or": []}) == set()
    assert ids({"s": {"$ne": "a"}}) == {2, 3} and ids({"s": {"$nin": ["a"]}}) == {2, 3} and ids({"s": {"$in": [None, "b"]}}) == {2, 3}
    assert ids({"n": {"$gt": 0}}) == {1, 2} and ids({"n": {"$lte": 1}}) == {1} and ids({"s": "zz", "$and": [{"i": 1}]}) == {1}
    with pytest.raises(ValueError):
        where({"s": {"$regex": "a"}})
    assert ids({"s": {"$regex": "a"}}, strict=False) == {1, 2, 3}


def pages(page: int) -> list[dict]:
    if page >= 3:
        return []
    return [{"b_id": [page * 2 + i], "b_bid_number": [f"GEM/2024/{'R' if i else 'B'}/{page}"], **({"b_id_parent": [99]} if i and page else {})} for i in range(2)]


def test_listing_source(spark):
    spark.dataSource.register(listing.listing_source(pages, "test_listing"))
    found = listing.candidates(spark.read.format("test_listing").option("pages", "5").option("pagesPerTask", "2").load())
    assert sorted((r.page, r.bid_id) for r in found.collect()) == [(0, 0), (1, 2), (1, 99), (2, 4), (2, 99)]
    waits = []

    def broken(_):
        raise OSError

    with pytest.raises(OSError):
        listing.with_retry(broken, 0, sleep=waits.append)
    assert waits == [3.0, 6.0]


def test_files_and_store(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "bid_12_x.PDF").write_bytes(b"text")
    (tmp_path / "d" / "bid_13.pdf").write_bytes(b"\xff")
    found = files.documents(spark, str(tmp_path))
    assert sorted(r.bid_id for r in files.downloaded_ids(found).collect()) == [12, 13]
    assert {r.text for r in files.to_text(found, bytes.decode).collect()} == {"text", None}
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.read("t") is None and s.state() == {}
    s.publish("t", spark.range(3))
    s.publish("t", spark.range(2))
    s.set_state(a=1)
    s.set_state(b=2)
    assert s.read("t").count() == 2 and s.state() == {"a": 1, "b": 2}
    with s.lock(), pytest.raises(RuntimeError), s.lock():
        pass
    store.write_csv(spark.createDataFrame([(2, "b,c"), (1, "a")], "p int, `Bid ID` string"), str(tmp_path / "csv"), "p")
    part = next((tmp_path / "csv").glob("part-*"))
    assert part.read_bytes() == b'\xef\xbb\xbfBid ID\na\n"b,c"\n'


def test_maintenance(spark, tmp_path):
    doc = "Bid Number: GEM/2024/B/{0}\nItem Category\nDesk {0}\nGeMARPTS\n"
    docs = lambda *k: spark.createDataFrame([(f"a/{i}.pdf", doc.format(i)) for i in k], "path string, text string")
    s = store.Store(spark, f"file://{tmp_path}/m")
    first = maintenance.run(s, docs(1, 2), datetime(2024, 1, 1))
    assert first["upserts"] == 4 and first["index_rebuilt"]
    second = maintenance.run(s, docs(2, 3), datetime(2024, 1, 2), active=spark.createDataFrame([("GEM/2024/B/3",)], "bid_id string"))
    assert (second["upserts"], second["deletes"], second["expired_chunks"]) == (2, 2, 2)
    assert {r.bid_id for r in s.read("chunks").collect()} == {"GEM/2024/B/3"}
    third = maintenance.run(s, docs(3), datetime(2024, 1, 3), active=spark.createDataFrame([], "bid_id string"), force_expiry=True)
    assert third["expired_chunks"] == 0 and not third["index_rebuilt"]
    assert maintenance.expiry_due(None, datetime(2024, 1, 1)) and not maintenance.expiry_due("2024-01-01T00:00:00", datetime(2024, 1, 7))


def test_stream(spark, tmp_path):
    from lakeseek.streaming import ingest

    s = store.Store(spark, f"file://{tmp_path}/s")
    folder = tmp_path / "in"
    for n in (1, 2):
        spark.createDataFrame([(f"a/{n}.pdf", f"GEM/2024/B/{n}\nItem Category\nDesk\n")], "path string, text string").write.mode("append").json(str(folder))
        ingest.ingest(spark, str(folder), s, str(tmp_path / "cp"))
    assert {r.bid_id for r in s.read("chunks").collect()} == {"GEM/2024/B/1", "GEM/2024/B/2"}


def test_maintenance_keeps_what_cannot_be_read(spark, tmp_path):
    doc = "Bid Number: GEM/2024/B/{0}\nItem Category\nDesk {0}\nGeMARPTS\n"
    docs = lambda **k: spark.createDataFrame([(f"a/{i[1:]}.pdf", doc.format(i[1:]) if good else None) for i, good in k.items()], "path string, text string")
    embed = lambda rows: rows.selectExpr("chunk_id", "array(1.0D) as embedding")
    s = store.Store(spark, f"file://{tmp_path}/k")
    assert maintenance.expire(s, spark.createDataFrame([], "bid_id string"))["expired_bids"] == 0
    first = maintenance.run(s, docs(b1=True, b2=True, b3=True), datetime(2024, 1, 1), embed=embed)
    assert (first["upserts"], first["unreadable"], s.read("vectors").count()) == (6, 0, 6)
    second = maintenance.run(s, docs(b1=True, b2=False), datetime(2024, 1, 2), embed=embed)
    assert (second["upserts"], second["deletes"], second["unreadable"]) == (0, 2, 1)
    assert {r.bid_id[-1] for r in s.read("chunks").collect()} == {"1", "2"}
    assert {r.chunk_id for r in s.read("vectors").collect()} == {r.chunk_id for r in s.read("chunks").collect()}
    assert {(r.chunk_id.split("::")[0][-1], r.op) for r in s.read("sync_delta").collect()} == {("3", "delete")}
    active = spark.createDataFrame([("GEM/2024/B/1",)], "bid_id string")
    dry = maintenance.expire(s, active)
    assert (dry["expired_bids"], dry["expired_chunks"], dry["applied"]) == (1, 2, False) and s.read("chunks").count() == 4
    assert [tuple(r) for r in s.read("expired_bids").collect()] == [("GEM/2024/B/2", 2)]
    assert maintenance.expire(s, active, apply=True)["applied"]
    assert s.read("chunks").count() == s.read("vectors").count() == 2


def test_command_lines(spark, tmp_path):
    import json

    from lakeseek.__main__ import main

    docs = [(f"a/{i}.pdf", f"Bid Number: GEM/2024/B/{i}\nItem Category\nDesk {i}\nGeMARPTS\n") for i in (1, 2)]
    spark.createDataFrame(docs, "path string, text string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([("GEM/2024/B/1",)], "bid_id string").write.parquet(str(tmp_path / "live"))
    base = ["--store", f"file://{tmp_path}/s"]
    with pytest.raises(SystemExit):
        main(["search", *base, "desk"])
    assert json.loads(main(["maintain", *base, "--documents", str(tmp_path / "docs")])[0])["upserts"] == 4
    found = [json.loads(x) for x in main(["search", *base, "GEM/2024/B/2"])]
    assert {r["bid_id"] for r in found[:2]} == {"GEM/2024/B/2"} and set(found[0]) >= {"chunk_id", "chunk_type", "score", "text"}
    assert json.loads(main(["expire", *base, "--active", str(tmp_path / "live")])[0])["applied"] is False
    assert json.loads(main(["expire", *base, "--active", str(tmp_path / "live"), "--apply"])[0])["expired_chunks"] == 2


def test_listing_to_the_end_and_by_number(spark):
    asked = []
    assert [listing.count_pages(lambda p, n=n: [{}] if p < n else []) for n in (0, 1, 2, 3, 17)] == [0, 1, 2, 3, 17]
    spark.dataSource.register(listing.listing_source(pages, "all_listing"))
    assert spark.read.format("all_listing").load().count() == 6
    numbers = spark.createDataFrame([("GEM/2024/B/77",), ("GEM/2024/B/77",), ("none",), (None,)], "bid_number string")
    entries = lambda n: [] if n == "none" else [{"b_id": [7], "b_bid_number": [n], "b_is_inactive": [0]}, {"b_id": [8], "b_bid_number": ["other"]}]
    assert [(r.b_id, r.b_is_inactive, r.b_id_parent) for r in listing.lookup_bids(numbers, entries).collect()] == [(7, 0, None)]
    fetch = listing.with_token(lambda: "x token='abc'", r"token='(\w+)'", lambda token, page: asked.append((token, page)) or [])
    assert fetch(3) == [] and asked == [("abc", 3)]
    with pytest.raises(ValueError):
        listing.with_token(lambda: "nothing", r"token='(\w+)'", lambda *_: [])(0)


def give(bid: int):
    if bid == 3:
        raise OSError("gone")
    return f'attachment; filename="doc {bid}.pdf"', "application/pdf", b"" if bid == 2 else b"%PDF"


def test_downloads_and_clean_up(spark, tmp_path):
    folder = tmp_path / "bids"
    got = files.download(spark.createDataFrame([(1,), (2,), (3,), (1,)], "bid_id long"), give, str(folder), "2024-01-01").cache()
    rows = {r.bid_id: r for r in got.collect()}
    assert rows[1].pdf_path == "2024-01-01/bid_1_doc 1.pdf" and rows[2].error == "empty" and "gone" in rows[3].error
    assert tuple(files.download_counts(got).first()) == (3, 1, 2, 4)
    assert [p.name for p in folder.rglob("*.pdf")] == ["bid_1_doc 1.pdf"]
    (folder / "empty.pdf").write_bytes(b"")
    (folder / "2024-01-01" / "empty.pdf").write_bytes(b"")
    assert files.remove_empty(spark, str(folder)) == ["empty.pdf"]
    names = ["2024-01-01/bid_1_doc 1.pdf", "../x.pdf", "missing.pdf", "2024-01-01/bid_1_doc 1.pdf"]
    assert len(files.archive_files(spark, str(folder), str(tmp_path / "old"), names, 9)) == 1
    (folder / "2024-01-01" / "bid_1_doc 1.pdf").write_bytes(b"again")
    assert files.archive_files(spark, str(folder), str(tmp_path / "old"), names, 9)[0].endswith("bid_1_doc 1_9.pdf")
    assert files.missing_paths(spark, str(folder), str(tmp_path / "nowhere")) == [str(tmp_path / "nowhere")]
    (tmp_path / "l.json").write_text('{"count": 1, "bids": [{"bid_id": "a", "chunks": [1]}, {"bid_id": "b", "chunks": []}]}')
    assert {r.bid_id for r in files.legacy_bids(spark, str(tmp_path / "l.json")).collect()} == {"a", "b"}
    (tmp_path / "m.json").write_text('{"bids": [1, 2]}')
    with pytest.raises(ValueError):
        files.legacy_bids(spark, str(tmp_path / "m.json"))


def test_store_reset(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/r")
    for n in range(4):
        s.publish("t", spark.range(n))
    assert s.read("t").count() == 3
    s.drop("t")
    assert s.read("t") is None
    s.publish("t", spark.range(7))
    assert s.read("t").count() == 7


def test_index_updates(spark):
    from lakeseek.operators.lexical import LexicalIndex

    rows = [(i, f"title {i % 3}", f"some text {i} word{i % 4}") for i in range(12)]
    table = lambda some: spark.createDataFrame(some, "chunk_id long, title string, text string")
    new = [(3, "other", "text of three"), (20, "title", "more")]
    whole = LexicalIndex.build(table([r for r in rows if r[0] != 3] + new))
    grown = LexicalIndex.build(table(rows)).add(table(new))
    assert sorted(map(str, grown.postings.collect())) == sorted(map(str, whole.postings.collect()))
    assert grown.stats.first() == whole.stats.first()
    less = grown.remove(table(new).select("chunk_id"))
    assert less.stats.first().n == 11 and less.postings.where("chunk_id = 20").isEmpty()


def test_exact_id_has_all_its_rows(spark, tmp_path):
    """More rows with the exact id than any limit of a result page."""
    from lakeseek.queries_records import exact_id_first

    n = 120_050
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("gem word").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(8).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = exact_id_first(spark, str(tmp_path)).collect()
    assert sorted(r.chunk_id for r in rows) == list(range(7, n, 100))


def test_postings_are_made_in_pieces(monkeypatch):
    """A batch with many tokens is numbered piece by piece, with the same postings."""
    import pyarrow as pa

    rows = [[f"w{(i * j) % 17}" for j in range(i % 40)] for i in range(300)]
    batch = pa.record_batch([pa.array(range(300)), pa.array([r[:2] for r in rows], pa.list_(pa.string())), pa.array(rows, pa.list_(pa.string()))], ["chunk_id", "a", "b"])
    listed = lambda batches: sorted((str(r) for b in batches for r in b.to_pylist()))
    whole = list(lexical._post(iter([batch])))
    monkeypatch.setattr(lexical, "PIECE", 500)
    parts = list(lexical._post(iter([batch])))
    assert listed(parts) == listed(whole) and len(whole) == 2 and len(parts) > 10
    assert max(sum(len(x or []) for c in ("title_at", "text_at") for x in b.column(c).to_pylist()) for b in parts) <= 500 + 42


def test_index_of_segments(spark, tmp_path):
    """N, mean length and df equal a rebuild after random adds and removes; so does every score."""
    import random

    from lakeseek.operators.lexical import LexicalIndex, SegmentedIndex

    rng, alive = random.Random(4), {}
    index = SegmentedIndex(store.Store(spark, f"file://{tmp_path}/i"))
    schema = "chunk_id long, title string, text string"
    for step in range(6):
        for _ in range(rng.randrange(1, 12)):
            i = rng.randrange(25)
            # Some chunks have no token at all.
            alive[i] = (rng.choice(["", "red desk", "blue lamp"]), "" if i % 5 == 0 else " ".join(rng.choice("oak ash elm fir red blue".split()) for _ in range(rng.randrange(8))))
        for i in rng.sample(sorted(alive), min(len(alive), 3)):
            del alive[i]
        rows = spark.createDataFrame([(i, *x) for i, x in alive.items()], schema)
        index.synchronise(rows)
        found, whole = index.load(), LexicalIndex.build(rows)
        assert tuple(found.stats.first()) == pytest.approx(tuple(whole.stats.first()))
        if step % 2:
            assert sorted(map(str, found.postings.collect())) == sorted(map(str, whole.postings.collect()))
    assert len(index.state()["segments"]) < 6 and index.synchronise(rows) == {"added": 0, "deleted": 0}
    scores = [{r.chunk_id: round(r.score, 9) for r in lexical.bm25(x, [["red"], ["oak"]]).collect()} for x in (found, whole)]
    assert scores[0] == scores[1]


def test_two_files_of_one_bid(spark, tmp_path):
    text_ = "Bid Number: GEM/2024/B/1\nItem Category\nDesk {0}\nGeMARPTS\nBuyer Added Bid Specific ATC\n1. Generic:\nterm {0} one\n2. Generic:\nmore {0}\n1. Generic:\nlast {0}\n"
    docs = lambda *k: spark.createDataFrame([(f"a/{i}.pdf", text_.format(i)) for i in k], "path string, text string")
    s = store.Store(spark, f"file://{tmp_path}/b")
    for now, there in enumerate([(1, 2), (1,), (1, 3)]):
        maintenance.run(s, docs(*there), datetime(2024, 1, 1 + now))
        last = max(there)
        assert {r.text for r in s.read("chunks").where("chunk_type = 'atc_clause'").collect()} == {f"Generic: last {last}", f"Generic: more {last}"}
        assert {r.pdf_path for r in s.read("chunks").collect()} == {f"a/{last}.pdf"}


def test_vectors_follow_chunks(spark, tmp_path):
    doc = "Bid Number: GEM/2024/B/{0}\nItem Category\nDesk {0}\nGeMARPTS\n"
    docs = lambda *k: spark.createDataFrame([(f"a/{i}.pdf", doc.format(i)) for i in k], "path string, text string")
    embed = lambda rows: rows.selectExpr("chunk_id", "array(1.0D) as embedding")
    s = store.Store(spark, f"file://{tmp_path}/v")
    for n in (1, 2, 3):
        maintenance.run(s, docs(*range(n)), datetime(2024, 1, n))
    assert s.read("vectors") is None
    assert maintenance.apply_vectors(s, embed, 2) == {"upsert": 2, "delete": 0}
    first = {r.chunk_id for r in s.read("vectors").collect()}
    assert maintenance.apply_vectors(s, embed, 2) == {"upsert": 2, "delete": 0}
    assert {r.chunk_id for r in s.read("vectors").collect()} > first
    assert maintenance.apply_vectors(s, embed) == {"upsert": 2, "delete": 0} and maintenance.apply_vectors(s, embed) == {"upsert": 0, "delete": 0}
    assert {r.chunk_id for r in s.read("vectors").collect()} == {r.chunk_id for r in s.read("chunks").collect()}
    kept = [len(list((tmp_path / "v" / t).iterdir())) for t in ("chunks", "staging", "files")]
    assert max(kept) <= store.KEEP


def test_unchanged_files_are_not_parsed(spark, tmp_path):
    import os

    folder = tmp_path / "pdf"
    (folder / "2024").mkdir(parents=True)
    put = lambda i, text_: (folder / "2024" / f"bid_{i}_x[1].pdf").write_text(f"Bid Number: GEM/2024/B/{i}\nItem Category\n{text_}\n")
    for i in (1, 2, 3):
        put(i, "Desk")
    parsed = spark.sparkContext.accumulator(0)

    def parse(content: bytes) -> str:
        parsed.add(1)
        return content.decode()

    s, day = store.Store(spark, f"file://{tmp_path}/f"), iter(range(1, 28))
    go = lambda **k: maintenance.run_files(s, f"file://{folder}", parse, datetime(2024, 1, next(day)), **k)
    first = go()
    assert (first["parsed"], first["documents"], parsed.value) == (3, 3, 3)
    assert {r.pdf_path for r in s.read("files").collect()} == {f"2024/bid_{i}_x[1].pdf" for i in (1, 2, 3)}
    assert go()["parsed"] == 0 and go(rehash=True)["parsed"] == 0 and parsed.value == 3
    put(2, "Chair of another kind")
    os.utime(folder / "2024" / "bid_3_x[1].pdf", (1, 1))  # touched, not changed
    (folder / "2024" / "bid_1_x[1].pdf").unlink()
    changed = go()
    assert (changed["parsed"], changed["removed_files"], changed["deletes"], parsed.value) == (1, 1, 2, 4)
    assert go()["parsed"] == 0 and parsed.value == 4
    active = spark.createDataFrame([("GEM/2024/B/3",)], "bid_id string")
    assert go(active=active, archive=f"file://{tmp_path}/old")["expired_chunks"] == 2
    assert [p.name for p in (tmp_path / "old").rglob("*.pdf")] == ["bid_2_x[1].pdf"]
    assert {r.bid_id for r in s.read("chunks").collect()} == {"GEM/2024/B/3"} and go()["documents"] == 1


def test_stream_and_maintenance_share_a_store(spark, tmp_path):
    from lakeseek.streaming import ingest

    s, folder = store.Store(spark, f"file://{tmp_path}/s"), tmp_path / "in"
    doc = lambda i, what="Desk": (f"a/{i}.pdf", f"Bid Number: GEM/2024/B/{i}\nItem Category\n{what}\n")
    spark.createDataFrame([doc(1), doc(2)], "path string, text string").write.mode("append").json(str(folder))
    ingest.ingest(spark, str(folder), s, str(tmp_path / "cp"))
    report = maintenance.run(s, spark.createDataFrame([doc(1), doc(2, "Chair"), doc(3)], "path string, text string"), datetime(2024, 1, 1))
    assert (report["parsed"], report["upserts"], report["deletes"], report["index_rebuilt"]) == (2, 4, 0, True)
    assert s.read("chunks").count() == 6


def test_export_sorts_hits_without_their_bids(spark, sf):
    """What names, titles and links bids have is joined with first hits only: no window holds it."""
    from lakeseek.queries_tables import QUERIES as tables

    for name in ("export_rows", "status_augmented_export"):
        plan = tables[name](spark, sf)._jdf.queryExecution().optimizedPlan()
        windows = [n for n in _nodes(plan) if n.nodeName() == "Window" and "_first" in n.simpleString(1000)]
        assert windows and all(n.output().size() <= 5 for n in windows)


def _nodes(plan):
    found = [plan]
    for i in range(plan.children().size()):
        found += _nodes(plan.children().apply(i))
    return found


def test_blocks_from_an_index_that_is_not_stored(spark, sf, tmp_path):
    """The same tables as from a stored one; what was written on the way is gone."""
    from lakeseek import fixtures
    from lakeseek.operators.blocks import BlockedIndex
    from lakeseek.operators.lexical import LexicalIndex

    built = LexicalIndex.build(fixtures.chunk_table(spark, sf))
    built.save(f"{tmp_path}/index")
    BlockedIndex.save(built, f"{tmp_path}/a")
    BlockedIndex.save(LexicalIndex.load(spark, f"{tmp_path}/index"), f"{tmp_path}/b")
    a, b = (BlockedIndex.load(spark, f"{tmp_path}/{x}") for x in "ab")
    for x, y in ((a.postings, b.postings), (a.maxima, b.maxima), (a.stats, b.stats)):
        assert x.count() == y.count() and x.exceptAll(y.select(*x.columns)).isEmpty()
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["maxima", "postings", "stats"]
    assert not list(a.postings.where("term = ''").take(1))


def test_scores_of_many_queries_are_dealt_by_what_they_make(spark, sf, monkeypatch):
    """Tasks grow in number with chunks times queries, not with the matches' bytes, and scores stay."""
    from lakeseek.operators import lexical_batch
    from lakeseek.queries_batch import _asked
    from lakeseek.queries_search import _index

    _, index = _index(spark, sf)
    wanted = {tuple(r) for r in lexical_batch.bm25(index, _asked(spark, sf)).collect()}
    monkeypatch.setattr(lexical_batch, "SCORED", 1000)
    scored = lexical_batch.bm25(index, _asked(spark, sf))
    assert {tuple(r) for r in scored.collect()} == wanted
    queries = lexical_batch.phrases(_asked(spark, sf)).select("query_id").distinct().count()
    assert scored.rdd.getNumPartitions() == -(-index.stats.first().n * queries // 1000)


def test_chunk_validity_with_blank_documents(spark, tmp_path):
    """The operator drops blank texts of any kind; the query's own blank ones are those its SQL names, whatever the documents hold."""
    from lakeseek import oracles_more, queries_tables
    from lakeseek.operators import changes

    docs = [(1, "a"), (2, ""), (3, None), (4, " \t\n"), (5, " \xa0"), (6, "b"), (7, "c"), (8, ""), (42, " "), (-5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = sorted(c.execute(oracles_more.ORACLES["chunk_validity"]).fetchall())
    assert sorted(map(tuple, queries_tables.QUERIES["chunk_validity"](spark, str(tmp_path)).collect())) == wanted
    chunks = spark.createDataFrame([(str(i), t) for i, t in docs] + [("", "a"), (None, "a")], "chunk_id string, text string")
    assert {r["chunk_id"] for r in changes.valid_chunks(chunks).collect()} == {"1", "6", "7"}


def test_index_is_stored_once(spark, sf, tmp_path):
    """As many files as tasks made postings, each in term order: nothing was dealt out by ranges; lengths are not postings."""
    from lakeseek import fixtures
    from lakeseek.operators.lexical import LexicalIndex

    built = LexicalIndex.build(fixtures.indexed_texts(spark, sf).repartition(3), "v")
    built.save(f"{tmp_path}/index")
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["lengths", "postings", "state", "stats"]
    stored = LexicalIndex.load(spark, f"{tmp_path}/index")
    assert stored.postings.where("term = ''").isEmpty() and stored.lengths.count() == 200
    assert stored.postings.exceptAll(built.postings).isEmpty() and stored.postings.count() == built.postings.count()
    files = list((tmp_path / "index/postings").glob("*.parquet"))
    assert len(files) == 3
    for f in files:
        terms = [r.term for r in spark.read.parquet(str(f)).select("term").collect()]
        assert terms == sorted(terms, key=str.encode)


@pytest.mark.parametrize("parts", [1 << 19, 500])
def test_best_of_many_queries_chunk_by_chunk(spark, sf, monkeypatch, parts):
    """What tasks keep is best() of all scores, equal ones by the smaller id; ids may be texts, and a task hands on k a query at most."""
    from lakeseek import fixtures
    from lakeseek.operators import lexical_batch
    from lakeseek.operators.lexical import LexicalIndex
    from lakeseek.queries_batch import _asked

    monkeypatch.setattr(lexical_batch, "PARTS", parts)
    rows = fixtures.indexed_texts(spark, sf)
    # Copies: equal scores.
    twice = rows.withColumn("chunk_id", F.format_string("c%05d", "chunk_id")).unionByName(rows.withColumn("chunk_id", F.format_string("a%05d", "chunk_id")))
    asked = _asked(spark, sf).unionByName(spark.createDataFrame([(-1, "of-the thing thing", None), (-2, "", None)], "query_id long, query string, embedding array<float>"))
    index = LexicalIndex.build(twice)
    for k in (3, 250):
        wanted = {tuple(r) for r in lexical_batch.best(lexical_batch.bm25(index, asked), k).collect()}
        assert {tuple(r) for r in lexical_batch.top(index, asked, k).collect()} == wanted and wanted
    monkeypatch.setattr(lexical_batch, "KEPT", 0)
    assert {tuple(r) for r in lexical_batch.top(index, asked, k).collect()} == wanted
    assert lexical_batch.top(index, asked.where("query_id = -2"), 3).isEmpty()


def test_few_hits_leave_chunks_where_they_lie(spark, sf):
    """Texts aren't shuffled to meet their labels or few hits, however small the bound on Spark's own broadcasts is."""
    from lakeseek import fixtures
    from lakeseek.operators import lexical_batch

    hits = spark.createDataFrame([(1, 5, 0.5), (2, 5, 0.25), (2, 7, 0.75), (2, -1, 0.0)], "query_id long, chunk_id long, score double")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = lexical_batch.with_texts(hits, fixtures.chunk_table(spark, sf), queries, 3)
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_id, r.chunk_id, bool(r.text)) for r in rows.collect()) == [(1, 5, True), (2, 5, True), (2, 7, True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

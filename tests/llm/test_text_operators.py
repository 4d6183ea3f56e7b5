"""Operators 1, 2, 3, 7 and 9 against brute force on the odd corpus, and on a test table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeseek.llm import common, decontaminate, kernels, language_id, line_dedup, ngram_join, substring_dedup, token_counts

SPACES = " \t\n\x0b\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_repeats(rows, window):
    first = {}
    for i, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(i, first.get(k, i))
    out = Counter()
    for i, text in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out[i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))] += 1
    return out


@pytest.mark.parametrize(("window", "anchor"), [(50, 16), (12, 5)])
def test_substring(docs, window, anchor):
    found = substring_dedup.remove_repeats(docs, window, anchor).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected_repeats(plain(docs), window)
    assert all(sha(r.kept_text) == r.kept_sha256 for r in found)


def test_substring_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    found = substring_dedup.remove_repeats(table, texts_out=False).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected_repeats(plain(table), 50)


def test_factors_copy_from_smaller_documents(docs):
    text = dict(plain(docs))
    for f in substring_dedup.factors(docs, 12, 5).collect():
        assert f.ref_doc < f.doc_id
        n = f.windows + 11
        assert words(text[f.doc_id])[f.start : f.start + n] == words(text[f.ref_doc])[f.ref_start : f.ref_start + n]


def test_factors_are_joined(spark):
    passage = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(passage)), (2, " ".join(["x", *passage, "y"])), (3, " ".join([*passage[:100], "z", *passage[100:]]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(f.doc_id, f.start, f.windows, f.ref_doc, f.ref_start) for f in substring_dedup.factors(table, 12, 5).collect()}
    assert found == {(2, 1, 289, 1, 0), (3, 0, 89, 1, 0), (3, 101, 189, 1, 100)}


def test_token_counts(docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = [(1, "<|endoftext|> it's <|startoftext|>x 50% ÉTÉ é z"), (2, "x" * 3000), (3, None)]
    rows = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    found = Counter(tuple(r) for r in token_counts.count_tokens(rows, path).collect())
    wanted = Counter()
    for i, t in plain(rows):
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        wanted[i, len((t or "").encode()), n, n > 2048] += 1
    assert found == wanted


def test_language_accuracy(spark, sf):
    table = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    found = {r.doc_id: r for r in language_id.identify(table).collect()}
    truth = {r.doc_id: r.lang for r in table.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r.held_out} == set(held)
    assert sum(found[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_odd_rows(docs, empty):
    found = language_id.identify(docs).collect()
    text = dict(plain(docs))
    assert len(found) == docs.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in found)
    kept = language_id.keep_identified(docs.withColumnRenamed("size", "score"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "component"]
    unlabelled = language_id.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert language_id.codewords(12).shape[0] == 12


def test_lines(docs, empty):
    rows = plain(docs)
    keys = [[k for k in (line.strip(SPACES).translate(FOLD) for line in (t or "").split("\n"))] for _, t in rows]
    for least in (3, 10):
        count = Counter(k for _, k in {(i, k) for (i, _), ks in zip(rows, keys, strict=True) for k in ks if k})
        wanted = Counter()
        for (i, t), ks in zip(rows, keys, strict=True):
            lines = (t or "").split("\n")
            kept = [x for x, k in zip(lines, ks, strict=True) if not k or count[k] < least]
            wanted[i, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
        assert Counter(tuple(r) for r in line_dedup.digest(docs, least).collect()) == wanted
    out = line_dedup.drop_lines(docs, 3)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == 1


def components(sets, percent=80):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def shingles(text):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("region", [1024, 3])
def test_ngram_join(docs, region):
    sets = {i: shingles(t) for i, t in plain(docs)}
    roots = components(sets)
    found = ngram_join.near_duplicates(docs, region=region).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(i, len(s), roots[i]) for i, s in sets.items()}
    assert len(found) == docs.count()
    assert any(r.doc_id != r.component_id for r in found)


def test_ngram_join_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {i: shingles(t) for i, t in plain(table)}
    roots = components(sets)
    assert {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(table).collect()} == set(roots.items())


def test_empty_tables(empty):
    public = pytest.importorskip("public_tokenizers")
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert token_counts.count_tokens(empty, public.path("word_bpe_49k.json")).count() == 0
    assert language_id.identify(empty).count() == 0
    assert line_dedup.digest(empty).count() == 0
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.keep_first(empty).count() == 0


def test_missing_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (1, "a b c d e f g")], "doc_id long, text string")
    assert substring_dedup.remove_repeats(rows, 5, 2).where("n_removed > 0").count() == 0
    assert line_dedup.digest(rows, 3).where("n_dropped = 1").count() == 3
    assert ngram_join.near_duplicates(rows).where("component_id = 1").count() == 1
    assert ngram_join.keep_first(rows).count() == 3


def test_shared_ids_with_different_texts(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e x y z"), (2, "q r s t u v w x")], "doc_id long, text string")
    found = {(r.doc_id, r.kept_text) for r in substring_dedup.remove_repeats(rows, 5, 2).collect()}
    assert found == {(1, "a b c d e f g h"), (2, "x y z"), (2, "q r s t u v w x")}


def test_hub_of_many_links(spark):
    """A cell of many near copies and one of documents that only share a passage."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:i], f"e{i}", *base[i + 1 :]])) for i in range(90)]
    rows += [(1000 + i, " ".join([*base[:60], *(f"u{i}_{j}" for j in range(200))])) for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    roots = components({i: shingles(t) for i, t in rows})
    counts = defaultdict(int)
    for r in ngram_join.near_duplicates(table, region=40).collect():
        assert r.component_id == roots[r.doc_id]
        counts[r.component_id] += 1
    assert max(counts.values()) == 90


def test_anchors_of_a_long_text():
    """Beyond 2**24 values places have no bits left beside the hash."""
    n, width = (1 << 24) + 5000, 35
    values = kernels.mix(np.arange(n, dtype=np.uint64))
    found = kernels.sliding_argmin(values, width)
    assert len(found) == n - width + 1
    for a in (0, (1 << 24) - 200, n - 400):
        short = kernels.sliding_argmin(values[a : a + 400], width)
        assert (found[a : a + len(short)] == short + a).all()


def test_ngram_cell_with_cut_candidates():
    """Two groups that fill each other's proposals: their region stays active though no proposal fails."""
    n, half = 300, ngram_join.SKETCH // 2
    sketch = [bytes([0x11] * half) if i < 150 else bytes([0x22] + [0x11] * (half - 1)) for i in range(n)]
    for comp, more in ((np.arange(n), [7]), (np.zeros(n, np.int64), [])):
        columns = [np.full(n, 7), np.zeros(n, np.int64), np.arange(n), np.full(n, 100), comp]
        cell = pa.record_batch([*map(pa.array, columns), pa.array(sketch), pa.nulls(n, pa.list_(pa.int64()))], ["region", "cell", "doc_id", "size", "comp", "sketch", "failed"])
        (found,) = [b.to_pylist() for b in ngram_join._join_cells(80, 1)(iter([cell]))]
        assert not [x for x in found if x["a"] is not None and (x["a"] < 150) != (x["b"] < 150)]
        assert [x["region"] for x in found if x["a"] is None] == more


def linked(rows):
    """Smallest doc_id reachable by links, where rows with words that share a doc_id are linked too."""
    sets = {n: shingles(t) for n, (_, t) in enumerate(rows)}
    root = components(sets)
    low = {}
    while True:
        by_id = {}
        for n, (i, _) in enumerate(rows):
            if sets[n]:
                by_id[i] = min(by_id.get(i, root[n]), root[n])
        new = {n: by_id[i] if sets[n] else root[n] for n, (i, _) in enumerate(rows)}
        merge = {}
        for n, r in root.items():
            merge[r] = min(merge.get(r, new[n]), new[n])
        new = {n: merge[root[n]] for n in root}
        if new == root:
            break
        root = new
    for n, (i, _) in enumerate(rows):
        low[root[n]] = min(low.get(root[n], i), i)
    return Counter((i, len(sets[n]), low[root[n]]) for n, (i, _) in enumerate(rows))


def near_copies(rng, name, size, copies, edits):
    base = [f"{name}{i}" for i in range(size)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(size)] = f"e{rng.randrange(10**9)}"
        yield " ".join(copy)


@pytest.mark.parametrize(("seed", "region"), [(1, 1024), (2, 16)])
def test_ngram_join_of_repeated_ids(spark, seed, region):
    """Rows that share ids, some with texts of different groups, and groups larger than a region's cells."""
    rng = random.Random(seed)
    texts = [t for g in range(3) for t in near_copies(rng, f"g{g}_", 120, 90, 4)]
    texts += [" ".join([*(f"p{i}" for i in range(40)), *(f"u{n}_{i}" for i in range(rng.randrange(5, 60)))]) for n in range(60)]
    rng.shuffle(texts)
    rows = [(n if rng.random() < 0.97 else rng.randrange(len(texts)), t) for n, t in enumerate(texts)] + [(7, texts[7]), (9, "")]
    base, other = " ".join(f"a{i}" for i in range(105)), " ".join(f"b{i}" for i in range(105))
    rows += [(5000, other), (5001, base), (5001, other), (5005, base.replace("a50 ", "x ")), (6001, base), (6003, other.replace("b50 ", "x "))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(tuple(r) for r in ngram_join.near_duplicates(table, region=region).collect())
    assert found == linked(rows)


def test_ngram_distances_never_exceed_those_of_sets():
    rng = random.Random(3)
    sets = [{rng.randrange(10**6) for _ in range(rng.randrange(1, 9000))} for _ in range(6)]
    sets += [set(list(s)[: max(1, len(s) * 9 // 10)]) for s in sets]
    counts = [np.bincount([x % ngram_join.SKETCH for x in s], minlength=ngram_join.SKETCH).clip(max=15).astype(np.uint8) for s in sets]
    rows = pa.record_batch([pa.array([((c[0::2] << 4) | c[1::2]).tobytes() for c in counts]), pa.array([len(s) for s in sets])], ["sketch", "size"])
    x = ngram_join._outlines(rows)
    assert x.sum(1).tolist() == [len(s) for s in sets]
    found = ngram_join._distances(x, x)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert found[i, j] <= 1 - len(a & b) / len(a | b) + 1e-12


def test_lines_of_repeated_rows(spark):
    """Ten rows of one document are one document; rows without an id are documents of their own."""
    rows = [(1, "a b\nc"), *[(2, "x y\nz")] * 10, *[(3, f"q {i}\ncommon") for i in range(10)], *[(i, "C \n other") for i in range(10, 19)], *[(None, "none")] * 10]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.n_dropped) for r in line_dedup.digest(table, 10).collect())
    wanted = Counter((i, sum(k.strip().lower() == "c" for k in t.split("\n")) if i else 1) for i, t in rows)
    assert found == wanted


def test_hot_line_beyond_broadcast(spark, monkeypatch):
    """A line in a third of all rows, with nothing allowed to be broadcast by count."""
    for module in (line_dedup, common):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    rows = [(i, f"hot\nown {i}" if i % 3 == 0 else f"own {i}\npair {i // 20}") for i in range(6000)]
    found = {(r.doc_id, r.n_dropped) for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()}
    assert found == {(i, 1) for i in range(6000)}


def test_clashing_columns(spark):
    """Columns named like those the operators make inside come back as they were."""
    names = ["row", "id", "none", "text_key", "drop", "kept", "gone", "later", "found", "_text", "_drop", "_id", "_later", "_found", "lang_pred", "letters"]
    rows = [(i, f"a b c d e f {i}\nshared", "en", *[f"{n}{i}" for n in names]) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    lines = line_dedup.drop_lines(table)
    assert lines.columns == table.columns
    assert {tuple(r) for r in lines.collect()} == {(i, t.split("\n")[0], *x) for i, t, *x in rows}
    items = spark.createDataFrame([(1, "a b c d e f 3")], "item_id long, text string")
    for out in (ngram_join.keep_first(table), decontaminate.drop_contaminated(table, items), language_id.keep_identified(table)):
        assert out.columns == table.columns
        assert {tuple(r) for r in out.collect()} <= set(rows)


def test_ngram_join_hands_out_small_batches(spark, docs, monkeypatch):
    """Batches of 64 MB, several of them in each task, were more than an executor had; afterwards the session is as before."""
    before, seen = spark.conf.get(common.BATCH_CONF), set()
    stash = ngram_join.stash
    monkeypatch.setattr(ngram_join, "stash", lambda df, name: seen.add(spark.conf.get(common.BATCH_CONF)) or stash(df, name))
    ngram_join.near_duplicates(docs)
    assert seen == {str(common.BATCH_BYTES)} and spark.conf.get(common.BATCH_CONF) == before
    long = spark.range(64).select(F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1)
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
    with common.small_batches(spark):
        found = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 64 << 20 and max(found) <= common.BATCH_BYTES + (2 << 20)

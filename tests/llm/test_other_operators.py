"""Operators 4, 5, 6, 8 and 10, and the pipeline."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lakeseek.llm import chat_format, decontaminate, embedding_neardup, mixing, warc
from tests.llm.test_text_operators import FOLD, components, plain, shingles, words


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows, centre = [], rng.standard_normal(16)
    for i in range(60):
        rows.append((i, [float(x) for x in centre + 0.05 * rng.standard_normal(16)], 1))
    for i in range(60, 120):
        rows.append((i, [float(x) for x in rng.standard_normal(16)], i % 3))
    rows += [(120, rows[3][1], 1), (121, rows[3][1], 2), (122, None, 1), (123, [0.0] * 16, 1), (124, [float("nan")] * 16, 1), (125, [], 1), (126, rows[3][1], None), (127, [1.0, 0.0], 1), (128, [2.0, 0.0], 1)]
    good = {i: (np.array(v), lab) for i, v, lab in rows if lab is not None and v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = {i: set() for i, *_ in rows}
    for a, (x, p) in good.items():
        for b, (y, q) in good.items():
            if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a].add(b)
    roots = {i: i for i in links}
    for i in sorted(links):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        roots[i] = min(seen)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for tile in (512, 7):
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_neardup.near_duplicates(table, tile=tile).collect()}
        assert found == {i: (len(links[i]), roots[i], roots[i] == i) for i in links}
    assert embedding_neardup.near_duplicates(table.limit(0)).count() == 0


def exact_links(x, near=0.93):
    """(links, smallest index reachable) of each row of x, by brute force."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= near
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(link, root[None, :], len(x)).min(1))
        if (low == root).all():
            return link.sum(1).tolist(), root.tolist()
        root = low


def test_vectors_of_bridged_groups(spark):
    """Two groups that fill each other's lists: their vectors link across, but never among the 32 nearest."""
    rng = np.random.default_rng(11)
    a, side = rng.standard_normal((2, 64))
    a /= np.linalg.norm(a)
    side -= side @ a * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side / np.linalg.norm(side)
    x = np.concatenate([c + 0.005 * rng.standard_normal((60, 64)) for c in (a, b)])
    near = np.argsort(-(x @ x.T), axis=1, kind="stable")[:, :33]
    assert ((near < 60) == (np.arange(120) < 60)[:, None]).all()
    links, roots = exact_links(x)
    assert set(roots) == {0} and min(links) > 60
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for tile in (512, 7, 2):
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_neardup.near_duplicates(table, tile=tile).collect()}
        assert found == {i: (links[i], 0, i == 0) for i in range(120)}


def test_vectors_of_sparse_pairs(spark):
    """A large label of unlike vectors with a few pairs: each is found, also without any round of search."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 120, 2):
        side = x[i + 1] - x[i + 1] @ x[i] * x[i]
        x[i + 1] = 0.94 * x[i] + np.sqrt(1 - 0.94**2) * side / np.linalg.norm(side)
    links, roots = exact_links(x)
    assert sum(links) == 120
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for rounds in (embedding_neardup.ROUNDS, 0):
        found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_neardup.near_duplicates(table, rounds=rounds).collect()}
        assert found == {i: (links[i], roots[i]) for i in range(4000)}


def grouped_vectors(rng):
    """6,000 unlike vectors, 200 pairs, a chain, 40 groups of 5, and two groups of 300 that link only with each other's outer half."""
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    beside = lambda v, cos: cos * v + np.sqrt(1 - cos**2) * unit((w := rng.standard_normal(v.shape)) - (w * v).sum(-1, keepdims=True) * v)
    base = unit(rng.standard_normal((6000, 64)))
    chain = [base[500]]
    for _ in range(60):
        chain.append(beside(chain[-1], 0.935))
    centre = unit(rng.standard_normal(64))
    large = [unit(c + 0.012 * rng.standard_normal((300, 64))) for c in (centre, beside(centre, 0.94))]
    fives = unit(np.repeat(base[1000:1040], 5, axis=0) + 0.02 * rng.standard_normal((200, 64)))
    return np.concatenate([base, beside(base[:200], 0.932), np.array(chain[1:]), *large, fives])


def test_search_carries_the_result(spark):
    """No label is compared as a whole, and the links and components are those of brute force; without rounds and with too few orders the audit says so."""
    x = grouped_vectors(np.random.default_rng(21))
    links, roots = exact_links(x)
    nodes = spark.createDataFrame([("1/64", i, v.tobytes(), 1) for i, v in enumerate(x)], "grp string, id long, vec binary, copies int")
    labels, whole = embedding_neardup._audited(nodes, 0.93, embedding_neardup.ROUNDS)
    assert whole.count() == 0
    found = {r.id: r.component for r in labels.collect()}
    assert sum(found.get(i, i) != roots[i] for i in range(len(x))) <= 2
    counts, joined = embedding_neardup._complete(nodes, labels, whole, 0.93, 512)
    counted = {r.id: r.links for r in counts.collect()}
    assert set(counted) == set(found) and sum(counted[i] != links[i] for i in counted) <= 4
    none = spark.createDataFrame([], "id long, component long")
    recall, bridges = embedding_neardup.audit(nodes, none)
    assert recall.first().recall == 0 and bridges.count() > 0
    true = spark.createDataFrame([(i, int(r)) for i, r in enumerate(roots) if links[i]], "id long, component long")
    recall, bridges = embedding_neardup.audit(nodes, true)
    assert recall.first().recall == 1 and bridges.count() == 0


def test_a_label_without_recall_is_compared_whole(spark, monkeypatch):
    """No order, no round: the audit fails the label in each try, and the sweep finds every link."""
    x = grouped_vectors(np.random.default_rng(22))[5000:]
    links, roots = exact_links(x)
    monkeypatch.setattr(embedding_neardup, "_search", lambda nodes, sizes, *_: [nodes.where("id < 0").selectExpr("id as a", "id as b")])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_neardup.near_duplicates(table).collect()}
    assert found == {i: (links[i], roots[i]) for i in range(len(x))}
    monkeypatch.undo()
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_neardup.near_duplicates(table, exact=True).collect()}
    assert found == {i: (links[i], roots[i]) for i in range(len(x))}


def test_vectors_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert embedding_neardup.near_duplicates(table).count() == table.count()


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b \\0 \\1<|end|> <<SYS>>x<</SYS>> <s>", "", None, "<|user|>\n|> ä", "\\"]
    roles = ["user", "assistant", None, "assistant", "a|>b<|end|>", "assistant"]
    rows = [(c, t, roles[t], texts[(t + c) % 6]) for c in range(6) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(chat_format.canonical(table))
    back = {r.conv_id: r for r in chat_format.read_back(chats).collect()}
    made = {r.conv_id: r for r in chats.collect()}
    for c in range(6):
        assert [(t.role, t.text) for t in back[c].turns] == [(roles[t] or "", texts[(t + c) % 6] or "") for t in range(6)]
        assert back[c].loss_text == "".join(texts[(t + c) % 6] or "" for t in range(6) if roles[t] == "assistant")
        inside = re.sub(r"<\|(.*?)\|>", "", made[c].formatted)
        assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>", inside)
    assert chat_format.digest(table.limit(0)).count() == 0


def test_chat_layouts(spark):
    messages = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")], "extra")], "id long, messages array<struct<role:string,content:string>>, size string")
    shared = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "id long, conversations array<struct<from:string,value:string>>")
    task = spark.createDataFrame([(1, "hi", "", "yo")], "id long, instruction string, input string, output string")
    pair = spark.createDataFrame([(1, "hi", "yo")], "id long, prompt string, response string")
    for layout in (messages, shared, task, pair):
        found = sorted((r.turn, r.role, r.text) for r in chat_format.canonical(layout).collect())
        assert found == [(0, "user", "hi"), (1, "assistant", "yo")]
    none = spark.createDataFrame([(1, []), (2, None), (3, [("user", "x" * 2_000_000)])], "id long, messages array<struct<role:string,content:string>>")
    assert [(r.conv_id, r.n_turns, r.formatted_chars) for r in chat_format.digest(none).collect()] == [(3, 1, 2_000_000 + 15)]
    with pytest.raises(ValueError):
        chat_format.canonical(spark.createDataFrame([(1,)], "other long"))


def test_warc(spark):
    rows = [(1, "http://A.example.org:80/x?y#z", "same"), (2, "https://a.example.org/x", "same"), (3, None, None), (4, "http://b.example/", ""), (5, "u\r\nv", "é" * 70_000 + "\r\n\r\nWARC/1.1\r\n"), (6, "http://b.example/2", "same"), (6, "http://b.example/2", "same"), (None, "http://b.example/3", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, index = warc.archive(pages, block=2)
    found = warc.read_all(index, folder).collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    wanted = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        response = i is None or first[html or ""] == i
        wanted[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else first[html or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == wanted
    bodies = {r.page_id: bytes(r.payload).decode() for r in found if r.payload is not None}
    assert bodies[5] == rows[4][2]
    hits = warc.lookup(index, ["http://a.example.org/x", "http://nowhere.example/"])
    assert [r.page_id for r in hits.collect()] == [2]
    assert [bytes(r.payload or b"") for r in warc.read_captures(warc.lookup(index, ["http://a.example.org/x?y"]), folder).collect()] == [b"same"]
    none, blocks = warc.archive(pages.limit(0))
    assert warc.read_all(blocks, none).count() == 0


def expected_leaks(docs, items):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t))
    out = set()
    for j, t in items:
        s = shingles(t)
        for i, all_ in sets.items():
            best = max(len(s & d) for d in all_)
            if s and i is not None and 100 * best >= 80 * len(s):
                out.add((i, j, len(s), best))
    return out


def test_decontamination(docs, spark):
    text = dict(plain(docs))
    item = text[max(i for i, t in text.items() if t and t.startswith("q"))]
    w = words(item)
    items = [(1, item), (2, item.upper()), (3, " ".join(w[:10] + ["zz"] + w[11:])), (4, "one two three"), (5, None), (6, " "), (7, " ".join(w[:15] + ["zz"] + w[16:20])), (1, item)]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r) for r in decontaminate.contained_items(docs, table).collect()}
    assert found == expected_leaks(plain(docs), items)
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs, table).collect()}
    assert left == set(text) - {x[0] for x in found}
    assert decontaminate.contained_items(docs, table.limit(0)).count() == 0
    assert decontaminate.contained_items(docs.limit(0), table).count() == 0


def wanted_targets(size):
    names = sorted(k for k in size if k is not None) + [None] * (None in size)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        open_ = [n for n in names if n not in full]
        rest = total - sum(2 * size[n] for n in full)
        got = {n: 2.0 * size[n] if n in full else rest * weight[n] / sum(weight[m] for m in open_) for n in names}
        new = {n for n in open_ if got[n] > 2 * size[n]}
        if not new:
            return got
        full |= new


@pytest.mark.parametrize("group", [64, 4])
def test_mixing(docs, group):
    rows = [(r.doc_id, r.source, len(words(r.text))) for r in docs.collect()]
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    wanted = wanted_targets(size)
    found = mixing.mix(docs, group=group).collect()
    assert Counter((r.doc_id, r.source, r.size, r.source_size) for r in found) == Counter((i, s, n, size[s]) for i, s, n in rows)
    taken, small = Counter(), Counter()
    for r in found:
        assert r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        small[r.source] = max(small[r.source], r.size)
    assert all(abs(taken[s] - wanted[s]) <= small[s] for s in size)
    again = mixing.mix(docs.repartition(2), group=group).collect()
    assert Counter((r.doc_id, r.copies) for r in again) == Counter((r.doc_id, r.copies) for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline
    from lakeseek.llm import language_id

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r for r in language_id.keep_identified(docs).collect()}
    lines = {i: [k.strip(" \t\n\x0b\f\r").translate(FOLD) for k in r.text.split("\n")] for i, r in kept.items()}
    count = Counter(k for ks in lines.values() for k in set(ks) if k)
    text = {i: "\n".join(x for x, k in zip(kept[i].text.split("\n"), ks, strict=True) if not k or count[k] < 10) for i, ks in lines.items()}
    roots = components({i: shingles(t) for i, t in text.items()})
    text = {i: t for i, t in text.items() if roots[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {x[0] for x in expected_leaks(list(text.items()), items)}
    text = {i: t for i, t in text.items() if i not in gone}
    size = Counter()
    for i, t in text.items():
        size[kept[i].source] += len(words(t))
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} <= set(text)
    taken = Counter()
    for r in found:
        assert r.size == len(words(text[r.doc_id])) and r.copies in (1, 2)
        taken[r.source] += r.taken
    for s, n in wanted_targets(size).items():
        assert abs(taken[s] - n) <= max(len(words(t)) for i, t in text.items() if kept[i].source == s)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "mixing"]


def test_mixing_of_repeated_rows(spark):
    """Half of a source is one row again and again, and so are the rows without an id."""
    rows = [(1, "a", "one two three")] * 25_000 + [(None, "a", "x y")] * 3000 + [(i, "a", "w " * (i % 7)) for i in range(2, 3000)] + [(i, "b", "v " * 40) for i in range(5000, 5100)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = Counter()
    for _, s, t in rows:
        size[s] += len(t.split())
    wanted = wanted_targets(size)
    found = mixing.mix(table).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((i, s, len(t.split())) for i, s, t in rows)
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
    assert abs(taken["a"] - wanted["a"]) <= 6 and abs(taken["b"] - wanted["b"]) <= 40


def test_many_items_in_blocks(docs, spark):
    """More sketch rows and item bytes than may be broadcast at once give the same pairs."""
    text = [(i, t) for i, t in plain(docs) if t and len(t) < 3000]
    table = spark.createDataFrame([(i, " ".join(words(t)[:40])) for i, t in text], "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.contained_items(docs, table).collect()}
    assert whole == expected_leaks(plain(docs), [(r.item_id, r.text) for r in table.collect()])
    assert {tuple(r) for r in decontaminate.contained_items(docs, table, probe_rows=300, item_bytes=0).collect()} == whole


def test_warc_point_lookup_reads_little(spark):
    """One URL of 3,000 opens one block and reads one record; extra columns change nothing."""
    rows = [(i, f"http://host{i % 50}.example/p{i}", f"<p>{i}</p>" * 300, "x") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(3)
    folder, index = warc.archive(pages, block=64)
    assert index.count() >= 3000 // 64 and index.agg({"n": "sum"}).first()[0] == 3000
    url = "http://host7.example/p1207"
    blocks, _ = warc.blocks_of(index, [url])
    (block,) = blocks.collect()
    in_index, in_archive = (spark.sparkContext.accumulator(0) for _ in range(2))
    hits = warc.lookup(index, [url], spent=in_index)
    (found,) = warc.read_captures(hits, folder, spent=in_archive).collect()
    assert found.page_id == 1207 and bytes(found.payload).decode() == rows[1207][2]
    # the directory is sampled for the range partitioning too, so each range may be read twice
    assert block.length <= in_index.value <= 2 * block.length
    assert len(rows[1207][2]) < in_archive.value < 2 * len(rows[1207][2])
    everything = [r.page_id for r in warc.lookup(index, [u for _, u, _, _ in rows[::100]] + ["http://nowhere.example/"]).collect()]
    assert sorted(everything) == list(range(0, 3000, 100))
    assert warc.lookup(index, []).count() == 0

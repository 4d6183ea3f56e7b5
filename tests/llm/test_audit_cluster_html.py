"""Operators 11 to 13 against brute force, with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lakeseek.llm import centroids, common, divergence, html_text
from tests.llm.conftest import SCHEMA

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_audit(rows, min_docs, top=10):
    """rows: (doc_id, text, lang, source)."""
    held, totals, counts, groups = defaultdict(set), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for at, (i, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        totals[lang].update(terms)
        for t in terms:
            held[lang, t].add(("row", at) if i is None else i)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (owner, t), ids in held.items() if owner == lang and len(ids) >= min_docs)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        q = shares(totals[lang])
        of = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(apart(of[s][t], of[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((-apart(of[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and of[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, at) for at, (v, item) in enumerate(found, 1)}
    return out


def audited(df, min_docs):
    found = divergence.audit(df, min_docs).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def plain(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


@pytest.mark.parametrize("min_docs", [2, 5, 10])
def test_divergence(docs, empty, min_docs):
    assert audited(docs, min_docs) == expected_audit(plain(docs), min_docs)
    assert divergence.audit(empty, min_docs).count() == 0


def test_divergence_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    stem = ["Äpfel", "apple", "ÉTÉ", "été", "x", "the", "语言", "a1b2"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(stem) + rng.choice(["", "-", "zz", "'s"]) for _ in range(rng.randrange(12)))
        # A third of the rows share one id, others repeat or have none; one source has most rows.
        key = 7 if i % 3 == 0 else None if i % 10 == 1 else i // 2
        rows.append((key, text, ["en", "de", None, ""][i % 4], ["s0", "s0", "s0", f"s{i % 5}", None][i % 5]))
    rows += [(500, None, "fr", "only"), (501, "", "it", "a"), (502, "  12 ", "it", "b"), (503, "x " * 5000, "en", "s0")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnsRenamed({}).selectExpr("*", "1 as term", "2 as zero", "3 as n")
    for least in (1, 3, 6):
        assert audited(table, least) == expected_audit(rows, least)
    # Forms beyond the broadcast bounds, in small parts.
    for name, value in (("GROUP_BYTES", 0), ("HELD", 3), ("ROWS", 2), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    assert audited(table, 3) == expected_audit(rows, 3)


def test_divergence_terms_in_tasks():
    batch = pa.record_batch([pa.array(["en"] * 3), pa.array(["s"] * 3), pa.array([True, True, False]), pa.array(["A b-a", "É1b", "b"])], ["lang", "source", "alone", "text"])
    rows = [r for out in divergence._count(iter([batch])) for r in out.to_pylist()]
    assert {(r["term"], r["n"], r["docs"]) for r in rows} == {("a", 2, 1), ("b", 3, 2), ("É", 1, 1)}


def expected_clusters(rows, clusters, rounds, dimensions):
    kept = [(i, [int(np.floor(1024 * float(e))) for e in x]) for i, x in rows if x is not None and len(x) == dimensions and all(e is not None and np.isfinite(e) for e in x)]
    lot = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centres = [x for _, x in sorted(kept, key=lot)[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        near = assign()
        for k in range(len(centres)):
            own = [x for (_, x), (_, c) in zip(kept, near, strict=True) if c == k]
            if own:
                centres[k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    near = assign()
    inertia = Counter()
    for d, k in near:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for (i, _), (d, k) in zip(kept, near, strict=True))


@pytest.mark.parametrize(("n", "rounds"), [(3, 4), (60, 0), (200, 10)])
def test_centroids(spark, n, rounds):
    rng = np.random.default_rng(n)
    rows = [(i, [float(v) for v in rng.standard_normal(64) * 0.1 + (i % 5)]) for i in range(n)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[0][1])]
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [None] * 64), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster", "'x' as x").repartition(3)
    single = [(i, None if x is None else [None if e is None else float(np.float32(e)) for e in x]) for i, x in rows + odd]
    found = Counter(tuple(r) for r in centroids.cluster(table, rounds=rounds).collect())
    assert found == expected_clusters(single, 8, rounds, 64)


def test_centroids_ties_and_bounds(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(12)] + [(20, [0.5, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = Counter(tuple(r) for r in centroids.cluster(table, clusters=4, rounds=3, dimensions=2).collect())
    assert found == expected_clusters(rows, 4, 3, 2)
    assert centroids.cluster(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], table.schema), dimensions=2).count()


def test_partial_distances_are_exact():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (8, 64))
    c[5] = c[2]
    near, best = centroids.nearest(x, c)
    whole = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (near == whole.argmin(1)).all() and (best == whole.min(1)).all()


ARTICLE = "<article><h1>A &amp; B</h1><p>First <b>para</b>graph,\n with a <a href='/x'>link</a> in it and more words.<br>second line</p><ul><li>one thing</li><li>two</li></ul><p>Last words &lt;here&gt; &eacute;&nbsp;x</article>"
TEXT = "A & B\nFirst paragraph, with a link in it and more words. second line\none thing\ntwo\nLast words <here> é x"
PAGES = {
    "plain": f"<html><head><title>T</title><script>var a='</p><article>';</script></head><body><nav><ul><li><a>Home</a></li></ul></nav>{ARTICLE}<footer>&copy; us</footer></body></html>",
    "furniture": f"<body class='no-sidebar'><header><h1>Site name here</h1></header><div class='cookie-notice'>We use many cookies on this site</div><div id='main-menu'><a>one</a><a>two</a></div>"
    f"<main>{ARTICLE}<div class='comments'><article><p>A reader says a lot of long words about all of this and that.</p></article></div></main>"
    "<aside><p>Other things that are well worth to be read by you today</p></aside><form>Your name <input> <button>Send it</button></form>",
    "inside": ARTICLE.replace("</h1>", "</h1><!-- <p>no</p> --><div class=\"ad\">Buy this now</div><style>p{}</style><nav><a>up</a></nav>"),
    "unclosed": f"<div class=ad>Buy more of it<div id=c>{ARTICLE}</div>",
}
#: Weights as a table with pages laid out as the first one gives them.
def weights():
    batch = pa.record_batch([pa.array([PAGES["plain"].replace("<ul><li>one thing</li><li>two</li></ul>", "")] * 50)], ["html"])
    return batch


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name, spark):
    training = spark.createDataFrame([(1, "u", page) for page in weights().column("html").to_pylist()], "page_id long, url string, html string")
    assert html_text.main_text(PAGES[name], html_text.fit(training)) == TEXT


def test_pages_without_an_article_element(spark):
    training = spark.createDataFrame([(1, "u", page) for page in weights().column("html").to_pylist()], "page_id long, url string, html string")
    w = html_text.fit(training)
    body = "".join(f"<p>Paragraph {i} of the text, with a few words in it.</p>" for i in range(4))
    links = "".join(f"<li><a href='/{i}'>Word {i}</a></li>" for i in range(9))
    page = f"<body><div id=x1><ul>{links}</ul></div><div id=x2><h1>Title</h1>{body}</div><div id=x3><ul>{links}</ul></div>"
    assert html_text.main_text(page, w) == "\n".join(["Title", *(f"Paragraph {i} of the text, with a few words in it." for i in range(4))])
    assert html_text.fit(training.limit(0)) == {}
    assert html_text.main_text("<p>Only words", {}) == "Only words"


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>"), (3, "w", "a < b &amp;lt; c"), (3, "w", "a < b &amp;lt; c"), (4, "x", "<p " + "a='" * 3000), (5, "y", "<p>" + "long words " * 200_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    found = html_text.extract(table)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    out = Counter((r.page_id, r.url, hashlib.md5(r.text.encode()).hexdigest(), r.n_chars) for r in found.collect())
    wanted = [(1, "u", ""), (2, None, ""), (None, "v", ""), (3, "w", "a < b &lt; c"), (3, "w", "a < b &lt; c"), (5, "y", ("long words " * 200_000).strip())]
    text = next(r.text for r in found.where("page_id = 4").collect())
    assert out == Counter((i, u, hashlib.md5(t.encode()).hexdigest(), len(t)) for i, u, t in [*wanted, (4, "x", text)])
    assert html_text.extract(table.limit(0)).count() == 0


def test_html_table(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    assert "text" in SCHEMA
    for r in html_text.extract(table).collect():
        assert r.n_chars == len(r.text) and r.text.split("\n")[0]


def test_vectors_that_share_an_id(spark):
    """Each row has its own vector's links and component, whatever its vec_id; finite vectors of any size count."""
    from lakeseek.llm import embedding_neardup

    x, y = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    near = lambda v: [e + 0.05 for e in v]
    rows = [(5, x, 1), (5, y, 1), (3, near(x), 1), (9, near(y), 1), (20, [1e200 * e for e in x], 2), (21, [1e-200 * e for e in near(x)], 2), (20, x, 3), (None, x, 1), (30, None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "'x' as grp", "2 as print")
    found = Counter(tuple(r) for r in embedding_neardup.near_duplicates(table).collect())
    wanted = [(5, 1, 3, False), (5, 1, 5, True), (3, 1, 3, True), (9, 1, 5, False), (20, 1, 20, True), (21, 1, 20, False), (20, 0, 20, True), (None, 0, None, True), (30, 0, 30, True)]
    assert found == Counter(wanted)


def test_language_sample_is_bounded(spark, sf, monkeypatch):
    from lakeseek.llm import language_id

    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    one = spark.range(4000).selectExpr("1L as doc_id", "if(id % 2 = 0, 'the same text of one document', concat('text of one document ', id)) as text", "'en' as lang")
    seen = []
    slice_ = language_id._slice
    monkeypatch.setattr(language_id, "_slice", lambda texts: seen.append(len(texts)) or slice_(texts))
    model = language_id.fit(table.unionByName(one), 50)
    assert sum(n for n in seen if n == 1) <= 50 * len(model.languages) and seen.count(1) > 100


def test_language_decoding(spark, sf):
    """A plain restatement of trigrams, sums, loss and decoding gives the same for a fitted model."""
    from math import exp, log

    from lakeseek.llm import language_id

    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(table)
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
    for r in language_id.predict(table.select("doc_id", "text"), model).collect():
        data = [fold(b) for b in (r.text or "").encode()]
        sums, n = np.zeros(model.code.shape[1]), 0
        for a, b, c in zip(data, data[1:], data[2:]):  # noqa: B905
            if b != 32:
                n += 1
                key = a | b << 8 | c << 16
                sums += model.weights[(key * 2654435761 % 2**32) >> (32 - language_id.BUCKET_BITS)]
        z = sums / max(n, 1) * model.slopes
        loss = [sum(t * log(1 + exp(-v * bit)) for v, bit, t in zip(z, word, model.trust, strict=True)) for word in model.code]
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0, False)
            continue
        order = sorted(range(len(loss)), key=lambda i: (loss[i], i))
        assert r.lang_pred == model.languages[order[0]]
        assert r.score == pytest.approx(1 / sum(exp(loss[order[0]] - x) for x in loss), abs=1e-6)
        gap = (loss[order[1]] - loss[order[0]]) / model.trust.sum()
        assert abs(gap - language_id.MARGIN) < 1e-6 or r.ambiguous == (gap < language_id.MARGIN)

"""Operators of oxbow.llm against brute force, public tokenizers and held-out labels, with odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from oxbow.llm import bpe, caps, forest, groups, html, language, ngrams, packing, quality, queries, repeats, urls, vocabulary

DATA = "/root/testdata/sf0.001"
ODD = [(900, ""), (901, None), (902, " \n\t"), (903, "a b c"), (904, "A B\tc"), (905, "é" * 3000), (None, "text without an id")]


def frame(spark, rows):
    """With an extra column whose name clashes with what operators use inside."""
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(3)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs = {}
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(3, 150))]
        for _ in range(r.randint(1, 6)):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) // 25))):
                x[r.randrange(len(x))] = r.choice(words)
            docs[len(docs)] = " ".join(x)
    return docs


def brute_ngrams(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("split", "hot"), [(1024, 12), (4, 0)])
def test_ngram_join(spark, texts, split, hot, monkeypatch):
    monkeypatch.setattr(ngrams, "SPLIT", split)
    monkeypatch.setattr(ngrams, "HOT", hot)
    docs = texts | {i: t for i, t in ODD if i is not None}
    found = {r[0]: (r[1], r[2]) for r in ngrams.near_documents(frame(spark, [*docs.items(), (None, "x y z")])).collect()}
    assert found.pop(None) == (1, None)
    assert found == brute_ngrams(docs)
    assert ngrams.near_documents(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in ngrams.near_documents(frame(spark, [(1, "a"), (1, "a")])).collect()] == [(1, 1, 1)] * 2


def test_split_across(spark):
    r = random.Random(5)
    rows = [(0, k, 0 if k < 200 else r.randrange(1, 9), r.randrange(1, 40)) for k in range(240)] + [(1, 1, 1, 5), (1, 2, 2, 6), (2, 3, 3, 7)]
    met: dict[tuple, list] = {}
    dealt = groups.split_across(spark.createDataFrame(rows, "g long, m long, c long, n long"), "g", "m", "c", "n", 4 / 3, 4).collect()
    for x in dealt:
        met.setdefault((x.g, x.one, x.two), []).append(x)
    times: dict[tuple, int] = {}
    for place in met.values():
        assert len(place) <= 40  # hashes deal about 4 rows a side
        for x in place:
            for y in place:
                if x.m < y.m and (x.side != y.side or x.side == 0):
                    times[x.g, x.m, y.m] = times.get((x.g, x.m, y.m), 0) + 1
    assert set(times.values()) == {1}
    for g, m, c, n in rows:
        for h, o, d, k in rows:
            if g == h and m < o and c != d and max(n, k) * 3 <= min(n, k) * 4:
                assert (g, m, o) in times
    prevailing = [x for x in dealt if x.m < 200 and x.g == 0]
    assert len(prevailing) < 200 * 40 / 2
    alone = groups.split_alone(spark.createDataFrame(rows, "g long, m long, c long, n long"), "g", "m", 16, 0)
    assert sorted((x.g, x.m) for x in alone.collect()) == sorted((g, m) for g, m, _, _ in rows if g < 2)


def test_repeats(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(50, 500))) for _ in range(6)]
    docs = {i: "".join(r.choice(base)[r.randint(0, 200) :][: r.randint(20, 400)] for _ in range(r.randint(0, 4))) for i in range(40)}
    docs |= {200: "a" * 1000, 201: "ab" * 400 + "a" * 300, 203: docs[5]} | {i: t for i, t in ODD if i is not None}
    seen, want = set(), {}
    for i in sorted(docs):
        data = (docs[i] or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    found = {x[0]: tuple(x)[1:] for x in repeats.remove_repeats(frame(spark, docs.items())).collect()}
    assert found == want
    assert repeats.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_repeats_of_rows_and_null_ids(spark):
    """Equal rows stay whole, and texts without an id are documents of their own, later than all others."""
    r = random.Random(6)
    a, b, c, d, e = ("".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(5))
    rows = [(1, a), (1, a), (None, b + c), (None, c + d), (None, b + c), (None, e + a), (2, "x" + a[:150]), (3, c[:120]), (3, c[:120] + e), (None, e[200:] + d[:50])]
    found = [(x["doc_id"], x["n_bytes"], x["kept_text"]) for x in repeats.remove_repeats(frame(spark, rows), with_text=True).collect()]
    assert sorted(t for i, _, t in found if i == 1) == [a, a]
    assert [t for i, _, t in found if i == 2] == ["x"]
    assert sorted(t for i, _, t in found if i == 3) == sorted([c[:120], c[:120] + e])
    nameless = sorted(t for i, n, t in found if i is None and n == 600)
    # of c its first 120 bytes are met in 3, the rest (180 bytes) in the earlier of the two texts without an id
    rest = c[120:]
    assert nameless in (sorted([b + c[120:], b + c[120:], d, ""]), sorted([b, b, rest + d, ""]))
    assert [t for i, n, t in found if i is None and n == 150] == [d[:50]]


def removed_locally(texts, span=100):
    """Which bytes go from `texts` (ids by place), all steps in this process; and the bytes of contexts that shared a group, most."""
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts, pa.string())], ["doc", "row", "data"])
    parts = pa.Table.from_batches(repeats.list_records(iter([batch]), span, 1))
    spans = repeats.meet_records(parts, span).to_pylist()
    wanted = [[x for x in spans if x["doc"] == i and x["gram"] is not None] for i in range(n)]
    fetched = pa.RecordBatch.from_pylist([{"doc": i, "row": i, "data": texts[i], "wanted": wanted[i]} for i in range(n)])
    contexts = pa.Table.from_batches(repeats.cut_contexts(iter([fetched]), span, 1))
    marks = [x for x in spans if x["gram"] is None] + (repeats.merge_contexts(contexts, span).to_pylist() if len(contexts) else [])
    gone = [np.zeros(len(t.encode()), bool) for t in texts]
    for m in marks:
        gone[m["doc"]][m["first"] : m["last"] + span] = True
    sizes = collections.Counter()
    for r in contexts.to_pylist():
        for g, c in zip(r["grams"], r["contexts"], strict=True):
            sizes[g] += len(c)
    return gone, max(sizes.values(), default=0)


def hot_line(n):
    r = random.Random(12)
    word = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    line = word(60)
    texts = [word(200) + line + word(200) for _ in range(n)]
    return texts + [t[r.randint(0, 100) :][:300] for t in texts[:20]]


def brute_gone(texts):
    seen, out = set(), []
    for t in texts:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        out.append(gone)
    return out


def test_hot_gram_with_like_hashes(monkeypatch):
    """Contexts whose hashes agree in their upper 32 bits are not taken as equal."""
    texts, own = hot_line(40), repeats.anchors

    def alike(*args):
        *others, context = own(*args)
        return *others, context & np.uint64(0xFFFFFFFF)

    monkeypatch.setattr(repeats, "anchors", alike)
    gone, _ = removed_locally(texts)
    assert all((a == b).all() for a, b in zip(gone, brute_gone(texts), strict=True))


def test_hot_gram_is_split(monkeypatch):
    texts = hot_line(200)
    gone, whole = removed_locally(texts)
    monkeypatch.setattr(repeats, "MERGE", 2000)
    split, most = removed_locally(texts)
    assert whole > 10_000 and most < 2000
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(gone, split, brute_gone(texts), strict=True))


def test_bpe_and_packing(spark, texts):
    docs = dict(enumerate([*list(texts.values())[:20], "Ünïcødé 漢字 🙂 it's 1²3  x\n\n y", "=" * 500, "ab" * 999, "<|endoftext|>"])) | {i: t for i, t in ODD if i is not None}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary.default("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = frame(spark, docs.items())
    for r in bpe.encode_documents(df).collect():
        text = docs[r["doc_id"]] or ""
        ids = lib.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    rows = packing.pack_documents(df, window=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by.keys() == docs.keys() and len({r["sequence_id"] for r in rows}) == len(rows)
    for i, parts in by.items():
        ids = np.array([*lib.encode_ordinary(docs[i] or ""), 1], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] & (p["length"] - 1) == 0 and p["length"] <= 64 and p["doc_tokens"] == len(ids) and p["offset"] == 0
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def vectors(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((400, 16))
    v[100:160] = v[0] + 0.05 * r.standard_normal((60, 16))
    v[160:170] = v[1]
    rows = [(i, [float(np.float32(x)) for x in row], 0) for i, row in enumerate(v)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1100, [1.0] * 3, 0)]
    return v.astype(np.float32).astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, filter int")


def test_caps(spark):
    v, df = vectors(spark)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    found = {r["vec_id"]: r for r in caps.near_vectors(df).collect()}
    assert len(found) == 404
    assert all(found[i]["n_links"] <= near[i].sum() - 1 for i in range(400))
    assert sum(found[i]["n_links"] for i in range(400)) >= 0.99 * (near.sum() - 400)
    assert all((found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True) for i in (1000, 1001, 1002, 1100))
    assert found[165]["component_id"] == 1 and not found[165]["kept"]
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_caps_at_threshold(spark):
    """Pairs just above the threshold, of vectors that fill all components or only half of them."""
    r = np.random.default_rng(8)
    x, y = r.standard_normal((2, 2000, 64))
    x[1000:, 32:] = y[1000:, 32:] = 0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    t = r.uniform(0.901, 0.92, (2000, 1))
    v = np.concatenate([x, t * x + np.sqrt(1 - t * t) * y])
    rows = [(i, [float(np.float32(z)) for z in row]) for i, row in enumerate(v)]
    found = {r["vec_id"]: r["n_links"] for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    linked = np.array([found[i] > 0 for i in range(2000)])
    assert linked[:1000].mean() >= 0.985 and linked[1000:].mean() >= 0.985


def test_forest(spark):
    v, df = vectors(spark)
    found = collections.defaultdict(list)
    for r in forest.nearest(df, F.col("vec_id") % 100 == 0, block_rows=150).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in (0, 100, 200, 300):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort([np.arange(400), d])[:10]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == [*range(1, 11)] and all(m[2] == pytest.approx(d[m[1]]) for m in mine)
        hits += len({*best} & {m[1] for m in mine})
    assert hits >= 36 and 1000 not in found
    assert forest.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_html():
    page = "<head><title>no</title></head><nav><a href=x>menu</a></nav><article><h1>T &amp; x</h1><p>One&nbsp;two, <b>three\n four.<br><p>Five &#233;.</article><div class='comments'><p>A comment, quite long and friendly, on it all.</div><footer>f</footer>"
    assert html.main_text(page) == "T & x\n\nOne two, three four.\n\nFive é."
    assert [html.main_text(x) for x in (None, "", "<", "<a " * 5000 + ">")][:2] == ["", ""]
    r = random.Random(5)
    for _ in range(200):  # the cut is minimal
        n = r.randint(1, 7)
        costs = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.random()) for i in range(n) for j in range(i + 1, n) if r.random() < 0.6]
        price = lambda side: sum(max(0, -c) if s else max(0, c) for c, s in zip(costs, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        assert price(html.cut(costs, edges)) == pytest.approx(min(price([k >> i & 1 for i in range(n)]) for k in range(1 << n)))


def test_urls(spark):
    rows = [(1, "http://A.b.COM/en/x?q"), (2, "https://example.com/en/77"), (3, "x://net/de/1#f"), (4, None), (5, "no scheme"), (6, "http://www.example.net/de/8"), (7, "http://xcom/en/1"), (8, "http://a.org/fr/1")]
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert found == {
        1: ("a.b.com", "/en/x", "com/en/", "block"), 2: ("example.com", "/en/77", "example.com/en/7", "allow"), 3: ("net", "/de/1", "net/de/", "block"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("www.example.net", "/de/8", "example.net/de/8", "block"), 7: ("xcom", "/en/1", None, "allow"), 8: ("a.org", "/fr/1", None, "allow"),
    }


def test_classifiers(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = queries.op8_subword_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").toPandas()
    assert (scored.predicted == scored.quality).mean() >= 0.9
    told = queries.op10_byte_language(spark, "/root/testdata/sf0.01").where("held_out").join(documents, "doc_id").toPandas()
    assert (told.lang_pred == told.lang).mean() >= 0.95
    odd = frame(spark, ODD)
    model = language.train([("the cat and the dog", "en"), ("le chat et les chiens", "fr")] * 20)
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify_documents(odd, model).collect()}[901] == "und"
    assert all(0 <= r["score"] <= 1 for r in quality.score_documents(odd, quality.train([("good text", 1), ("bad!!", 0)])).collect())


def test_many_languages(spark):
    """More languages than 64: rows of each are learned from, and the rarest are told too."""
    r = random.Random(2)
    letters = [chr(c) for k in range(70) for c in range(0x4E00 + 64 * k, 0x4E00 + 64 * k + 4)]
    rows = []
    for k in range(70):
        for _ in range(20 if k < 64 else 8):
            rows.append((len(rows), " ".join("".join(r.choice(letters[4 * k : 4 * k + 4]) for _ in range(5)) for _ in range(12)), f"l{k:02d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_on(df)
    assert len(model.labels) == 70
    told = {r["doc_id"]: r["lang_pred"] for r in language.identify_documents(df, model).collect()}
    rare = [told[i] == lang for i, _, lang in rows if lang >= "l64"]
    assert np.mean(rare) >= 0.8


def test_language_gradient():
    model, rng = language.start(["a", "b"], 1), np.random.default_rng(0)
    steps, which = rng.integers(0, 256, (5, 3)).astype(np.uint8), np.array([0, 1, 1])
    for x in model.parts():
        x[...] = x.astype(np.float64)
    _, slopes = language.gradient(model, steps, which)
    for x, g in zip(model.parts(), slopes, strict=True):
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, change = x[place], 1e-2
        losses = []
        for d in (change, -change):
            x[place] = before + d
            losses.append(language.gradient(model, steps, which)[0])
        x[place] = before
        assert (losses[0] - losses[1]) / (2 * change) == pytest.approx(g[place], rel=0.05)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {r["length"] & (r["length"] - 1) for r in rows} == {0}

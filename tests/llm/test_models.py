"""Learned operators: held-out quality, odd rows, and that labels of held-out rows are not used."""

import functools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.llm import cotrain, langid, toxicity
from corvine.llm.textkit import crc_mod, flat, range_hashes, rolling_hashes

SF = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int, score string"


def held(i, m):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % m


def auc(score, label):
    order = np.argsort(score, kind="stable")
    y = np.asarray(label)[order]
    n1, n0 = y.sum(), len(y) - y.sum()
    return (np.arange(1, len(y) + 1)[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def test_language(spark, tables):
    docs, _ = tables
    found = langid.identify_held_out(docs).join(docs, "doc_id").where("held_out").select("doc_id", "lang", "lang_pred", "score").toPandas()
    assert all(held(i, 3) == 1 for i in found["doc_id"])
    assert (found["lang"] == found["lang_pred"]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_language_ignores_held_out_labels(tables):
    docs, _ = tables
    wrong = docs.withColumn("lang", F.when(crc_mod("doc_id", 3) == 1, "xx").otherwise(F.col("lang")))
    a, b = (langid.identify_held_out(d).orderBy("doc_id").collect() for d in (docs, wrong))
    assert a == b


def test_language_odd_rows(documents, odd, tables):
    scorer = langid.train(tables[0])
    rows = langid.identify(documents(odd), scorer)
    assert rows.count() == len(odd) and "source" in rows.columns
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows.collect()}
    for i in (1, 2, 3, 10):
        assert pred[i] == ("und", 0.0)
    assert pred[7][0] != "und" and pred[8][0] in scorer.labels
    assert langid.identify(documents([]), scorer).count() == 0
    untrained = langid.identify_held_out(documents([(1, "text", None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in untrained] == [("und", 0.0)]


def test_network_gradient():
    """The gradient against finite differences."""
    rng = np.random.default_rng(0)
    net = langid.ByteNet(["a", "b"], seed=1)
    x, y, w = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1]), np.ones(2, np.float32)

    def loss():
        padded = np.pad(x, ((0, 0), (0, 3)))
        best = []
        for k, table in zip(langid.WIDTHS, net.tables, strict=True):
            best.append(sum(table[o][padded[:, o : o + langid.WINDOW]].astype(float) for o in range(k)).max(1))
        z = np.maximum(np.concatenate(best, 1), 0) @ net.out + net.bias
        return -np.mean((z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(3), y])

    grads = net._gradients(x, y, w)
    for p, g in zip(net._params(), grads, strict=True):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[k]
        p[k] = old + 1e-3
        up = loss()
        p[k] = old - 1e-3
        down = loss()
        p[k] = old
        assert abs((up - down) / 2e-3 - g[k]) < 1e-2


def slow_language(net, text: bytes):
    """Probabilities of one text: every window, position and filter in turn, in double precision."""
    found = []
    for a in range(0, len(text), langid.WINDOW):
        window = text[a : a + langid.WINDOW].ljust(langid.WINDOW, b"\0") + b"\0" * 3
        hidden = []
        for width, table in zip(langid.WIDTHS, net.tables, strict=True):
            sums = [sum(table[o][window[i + o]].astype(float) for o in range(width)) for i in range(langid.WINDOW)]
            hidden += [max(0.0, max(s[f] for s in sums)) for f in range(langid.FILTERS)]
        z = [sum(h * net.out[k][c] for k, h in enumerate(hidden)) + net.bias[c] for c in range(len(net.labels))]
        e = [math.exp(v - max(z)) for v in z]
        found.append([v / sum(e) for v in e])
    return [sum(p[c] for p in found) / len(found) for c in range(len(net.labels))]


def test_language_scores_by_brute_force():
    import pyarrow as pa

    net = langid.ByteNet(["a", "b", "c"], seed=5)
    rng = np.random.default_rng(8)
    net.out = rng.normal(0, 1, net.out.shape).astype(np.float32)
    texts = ["été", "x" * 300, "".join(rng.choice(list("abc é日"), 700)), "12 34", "", None]
    pred, score = net.frozen().texts(*flat(pa.array(texts)))
    for i, t in enumerate(texts[:3]):
        p = slow_language(net, t.encode())
        assert pred[i] == int(np.argmax(p)) and abs(score[i] - max(p)) < 1e-4
    assert pred[3:].tolist() == [-1] * 3 and score[3:].tolist() == [0] * 3


def test_windows_cover_the_whole_text():
    """A long text whose last part is in another language is not judged by its beginning."""
    rng = np.random.default_rng(5)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    net = langid.ByteNet(["a", "b"])
    cut = lambda s: np.frombuffer(s.encode(), np.uint8)[: langid.WINDOW]
    x = np.stack([cut(make("abcd ", 256)) for _ in range(64)] + [cut(make("wxyz ", 256)) for _ in range(64)])
    net.fit(x, np.repeat([0, 1], 64))
    import pyarrow as pa

    texts = pa.array([make("abcd ", 500) + make("wxyz ", 5000), make("abcd ", 40)])
    pred, _ = net.frozen().texts(*flat(texts))
    assert pred.tolist() == [1, 0]


def test_toxicity(tables):
    docs, labels = tables
    found = toxicity.score_held_out(docs, labels).join(labels, "doc_id").toPandas()
    assert (found["held_out"] == [held(i, 5) == 0 for i in found["doc_id"]]).all()
    assert ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()


def test_toxicity_held_out_quality(spark):
    """On the larger table, whose labels are enough to learn from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_held_out(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    assert auc(found["score"], found["toxic"]) > 0.951
    assert found.loc[found["toxic"] == 1, "predicted"].mean() > 0.9
    assert found.loc[found["toxic"] == 0, "predicted"].mean() < 0.01
    assert (found["toxic_log"] < 0).all() and (found["plain_log"] < 0).all()


def slow_models(texts, discount):
    """P_c(w | v) of both classes by the formulas, over dictionaries; v None: nothing before, w None: an unknown word."""
    cut, extra = toxicity.SHARED_DISCOUNT, toxicity.DEVIATIONS
    bigrams = lambda t: set(zip(t, t[1:], strict=False))
    n = [{w: sum(w in t for t in c) for w in {w for t in c for w in t}} for c in texts]
    m = [{p: sum(p in bigrams(t) for t in c) for p in {p for t in c for p in bigrams(t)}} for c in texts]
    words, pairs = sorted({w for c in n for w in c}), {p for c in m for p in c}
    add = lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}
    n_all, m_all = add(*n), add(*m)
    before = {w: sum(p[1] == w for p in pairs) for w in words}
    floor = cut * sum(b > 0 for b in before.values()) / len(pairs) / (len(words) + 1)
    shared = {w: max(b - cut, 0) / len(pairs) + floor for w, b in before.items()} | {None: floor}
    total = sum(n_all.values())
    back = sum(min(x, cut) for x in n_all.values()) / total
    base = {w: max(n_all.get(w, 0) - cut, 0) / total + back * shared[w] for w in shared}

    def s(w, v):
        held = [x for p, x in m_all.items() if p[0] == v]
        if not held:
            return shared[w]
        return max(m_all.get((v, w), 0) - cut, 0) / sum(held) + sum(min(x, cut) for x in held) / sum(held) * shared[w]

    def model(c):
        size, size2 = sum(n[c].values()), sum(m[c].values())
        d = discount * size / min(sum(x.values()) for x in n)
        d2 = discount * size2 / min(sum(x.values()) for x in m)
        x = {w: max(n[c].get(w, 0) - size * base[w] - d - extra * (size * base[w]) ** 0.5, 0) if w else 0 for w in shared}
        left = 1 - sum(x.values()) / size
        r = {w: x[w] / size / base[w] + left for w in shared}

        @functools.cache
        def given(v):
            q = {w: s(w, v) * r[w] for w in shared}
            z = sum(q.values())
            q = {w: y / z for w, y in q.items()}
            seen = sum(y for p, y in m[c].items() if p[0] == v)
            if not seen:
                return q
            over = {w: max(m[c].get((v, w), 0) - seen * q[w] - d2 - extra * (seen * q[w]) ** 0.5, 0) / seen if (v, w) in pairs else 0 for w in q}
            rest = 1 - sum(over.values())
            return {w: over[w] + rest * q[w] for w in q}

        return given

    return set(words), [model(0), model(1)]


@pytest.mark.parametrize("discount", [0.1, 0.5, 2.0, 9.0])
def test_kneser_ney_against_dictionaries(discount):
    """The log-likelihoods are those of the formulas, and the probabilities sum to one after any word."""
    rng = np.random.default_rng(3)
    draw = lambda words, k: [list(rng.choice(words, rng.integers(1, 30))) for _ in range(k)]
    plain, bad = list("abcdefgh"), list("abcdexyz")
    texts = [[*draw(plain, 60), ["a", "b"]], [*draw(bad, 40), ["q"], *[["x", "y"]] * 20]]
    code = {w: toxicity.mix(np.array([ord(w)], np.uint64))[0] for w in "abcdefghxyzqw"}
    hashed = lambda t: np.array([code[w] for w in t], np.uint64)
    model = toxicity.KneserNey.learn(toxicity.Counts.of([[hashed(t) for t in c] for c in texts]), discount)
    known, slow = slow_models(texts, discount)
    asked = [*draw(list("abcdefghxyzqw"), 20), [], ["w"], ["w", "a"]]
    first = np.concatenate(([0], np.cumsum([len(t) for t in asked])))
    mean = model.likelihoods(np.concatenate([hashed(t) for t in asked]), first)
    for i, t in enumerate(asked):
        t = [w if w in known else None for w in t]
        for c in (0, 1):
            logs = [np.log(slow[c](t[k - 1] if k else None)[w]) for k, w in enumerate(t)]
            assert abs(mean[c, i] - (np.mean(logs) if logs else 0)) < 1e-4
    for v in [*sorted(known), "w"]:  # w is unknown
        two = np.concatenate([hashed([v, w]) for w in [*sorted(known), "w"]])
        after = np.exp(model.places(two, np.arange(0, len(two) + 1, 2))[:, 1::2].astype(float))
        assert np.allclose(after.sum(1), 1, atol=1e-4)


def test_toxicity_sample_is_bounded(spark, documents, monkeypatch):
    """Sizes decide which texts are read, whole ones only, and rows that repeat a doc_id count together."""
    assert toxicity.within([(1, 0, 0.1, 60), (2, 0, 0.2, 50), (3, 0, 0.3, 40), (4, 1, 0.0, 101)], 100) == [(1, 0), (3, 0)]
    rows, labels = toxic_corpus(100)
    monkeypatch.setattr(toxicity, "BYTES_PER_CLASS", 2000)
    sample, counts = toxicity.labelled_sample(documents([*rows, *rows[:5]]), spark.createDataFrame(labels, LABELS), "toxic")
    assert counts == {0: 75, 1: 25} and 0 < len(sample) < 100


def toxic_corpus(n=600):
    rng = np.random.default_rng(7)
    plain = ["the", "of", "river", "stone", "walks", "green", "over", "under", "house", "sea"]
    bad = ["vile", "fool"]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, rng.integers(5, 60)))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w[rng.integers(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "src1"))
        labels.append((i, 1, int(toxic), "x"))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, documents):
    rows, labels = toxic_corpus()
    marks = spark.createDataFrame(labels, LABELS)
    found = toxicity.score_held_out(documents(rows), marks).where("held_out").toPandas()
    toxic = np.array([i % 4 == 0 for i in found["doc_id"]])
    assert auc(found["score"], toxic) > 0.99
    assert ((found["predicted"] == 1) == toxic).mean() > 0.97
    flipped = marks.withColumn("toxic", F.when(crc_mod("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score_held_out(documents(rows), flipped).where("held_out").toPandas()
    assert (found.sort_values("doc_id")["score"].values == again.sort_values("doc_id")["score"].values).all()


def test_toxicity_odd_rows(spark, documents, odd):
    rows, labels = toxic_corpus(200)
    model = toxicity.train(documents(rows), spark.createDataFrame(labels, LABELS))
    got = {r["doc_id"]: r for r in toxicity.score(documents(odd), model).collect()}
    assert len(got) == len({i for i, *_ in odd}) and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1]["score"] == got[2]["score"] == got[10]["score"]
    assert toxicity.score(documents([]), model).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in toxicity.score_held_out(documents(rows[:3]), none).collect()] == [0.0] * 3
    half = spark.createDataFrame([(1, None, None, None), (2, None, 0, None)], LABELS)
    assert {r["score"] for r in toxicity.score_held_out(documents(rows[:3]), half).collect()} == {0.0}


def test_quality(tables):
    docs, labels = tables
    found = cotrain.score_held_out(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(found["score"], found["quality"]) > 0.9
    assert (found.loc[found["quality"] == 1, "kept"]).mean() > 0.9
    assert found["text_score"].between(0, 1).all() and found["page_score"].between(0, 1).all()


def test_co_training_uses_the_other_view():
    """With few labels, a view that is good on its own teaches the other through pseudo-labels."""
    rng = np.random.default_rng(4)
    n, pool = 60, 2000
    y, hidden = rng.integers(0, 2, n).astype(float), rng.integers(0, 2, pool).astype(float)
    view = lambda label, gain, dims: (rng.normal(size=(len(label), dims)) + gain * (2 * label[:, None] - 1) * (np.arange(dims) < 8)).astype(np.float32)
    views, free = zip(*[(view(y, g, d), view(hidden, g, d)) for g, d in ((0.5, 200), (2.0, 10))], strict=True)
    held_rows = np.arange(n) % 4 == 0
    model = cotrain.co_train(list(views), y, held_rows, cotrain.from_arrays(list(free)))
    alone = cotrain.fit_logistic(views[0][~held_rows], y[~held_rows], 1e-4)
    taught = auc(free[0] @ model.text[0], hidden)
    assert taught > auc(free[0] @ alone[0], hidden)
    both, text, meta = model.score(*free)
    assert auc(both, hidden) > 0.97 and both.shape == text.shape == meta.shape


def test_pseudo_labels_are_of_the_whole_table(spark, documents, odd, monkeypatch):
    """Tasks and a window hand over what one pass over all features in memory does."""
    monkeypatch.setattr(cotrain, "CONFIDENT", 0.6)
    rng = np.random.default_rng(6)
    rows = [*odd, *[(100 + i, " ".join(rng.choice(["good", "bad", "word", "x1"], 30)), "en", f"s{i % 3}") for i in range(300)]]
    docs = documents(rows).repartition(5)
    table = docs.select(F.col("doc_id").cast("bigint"), *cotrain.meta_columns(), F.coalesce("text", F.lit("")).alias("text"))
    models = [(rng.normal(size=d).astype(np.float32) * 3, 0.1) for d in (cotrain.TEXT_DIMS, cotrain.META_DIMS)]
    curves = [(np.array([1.5]), -0.2), (np.array([0.3]), 0.1)]
    held = sorted(table.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    data = [r["text"].encode() for r in held]
    text = cotrain.trigram_vectors(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    meta = cotrain.meta_vectors(np.array([[r["ms"], r["ml"], r["mn"]] for r in held]))
    for most in (3, 40):
        got, want = cotrain.from_table(table)(models, curves, most), cotrain.from_arrays([text, meta])(models, curves, most)
        for v in (0, 1):
            assert got[v][1].tolist() == want[v][1].tolist() and 0 < len(got[v][1]) <= 2 * most
            assert v == 0 or np.allclose(got[v][0], want[v][0], atol=1e-3)


def slow_quality(model, text: bytes, meta: list[int]):
    """Both views and their combination for one document, trigram by trigram."""
    counts = {}
    for k in range(len(text) - 2):
        code = (((text[k] << 16 | text[k + 1] << 8 | text[k + 2]) * 2654435761) % 2**32) >> (32 - cotrain.TEXT_DIMS.bit_length() + 1)
        counts[code] = counts.get(code, 0) + 1
    pieces = max(len(text) - 2, 0)
    scale = pieces / (pieces + cotrain.SHORT)
    norm = math.sqrt(sum(counts.values())) or 1.0  # entries are roots of counts
    x = {c: math.sqrt(n) * scale / norm for c, n in counts.items()} | {0: scale}
    logistic = lambda z: 1 / (1 + math.exp(-z))
    zt = (sum(v * float(model.text[0][c]) for c, v in x.items()) + model.text[1]) * model.text_curve[0][0] + model.text_curve[1]
    zm = (sum(float(model.meta[0][m]) for m in meta) + model.meta[1]) * model.meta_curve[0][0] + model.meta_curve[1]
    return logistic(zt * model.both[0][0] + zm * model.both[0][1] + model.both[1]), logistic(zt), logistic(zm)


def test_quality_scores_by_brute_force(spark, documents, odd):
    model = cotrain.train(*[spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")])
    docs = documents([(k, *row[1:]) for k, row in enumerate(odd)])
    got = {r["doc_id"]: r for r in cotrain.score(docs, model).collect()}
    meta = {r["doc_id"]: list(r[1:]) for r in docs.select("doc_id", *cotrain.meta_columns()).collect()}
    for k, (_, text, *_) in enumerate(odd):
        want = slow_quality(model, (text or "").encode(), meta[k])
        assert np.allclose([got[k][c] for c in ("score", "text_score", "page_score")], want, atol=1e-4)


def test_quality_odd_rows(spark, documents, odd):
    model = cotrain.train(*[spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")])
    rows = cotrain.score(documents(odd), model)
    assert rows.count() == len(odd) and rows.where("score IS NULL OR isnan(score)").count() == 0
    assert cotrain.score(documents([]), model).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in cotrain.score_held_out(documents(odd), none).collect()} == {0.5}


def test_hashes():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 2**63, 300, dtype=np.uint64)
    at = np.arange(300 - 20 + 1)
    assert (rolling_hashes(v, 20) == range_hashes(v, at, at + 20)).all()
    twice = np.concatenate([v[:50], v[:50]])
    assert range_hashes(twice, np.array([10]), np.array([40]))[0] == range_hashes(twice, np.array([60]), np.array([90]))[0]


def test_flat_reads_nulls_and_slices():
    import pyarrow as pa

    column = pa.array(["ab", None, "", "cd", None]).slice(1)
    data, off = flat(column)
    assert data.tobytes() == b"cd" and off.tolist() == [0, 0, 0, 2, 2]
    data, off = flat(pa.array([], pa.string()))
    assert len(data) == 0 and off.tolist() == [0]

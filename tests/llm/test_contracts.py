"""Each operator against a brute-force version, on small tables and on odd rows."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SPACE = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def corpus(seed=1, n=60):
    """Prose with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, out = prose(40), []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            text = rng.choice(out)[1]
        elif kind < 0.4 and out:
            w = rng.choice(out)[1].split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        elif kind < 0.6:
            text = prose(rng.randint(5, 60)) + "\n" + passage + " " + prose(rng.randint(1, 60))
        else:
            text = prose(rng.randint(1, 150))
        out.append((i * 3 + 1, text, rng.choice(["en", "fr", None]), rng.choice(["src1", "src2", None])))
    rng.shuffle(out)
    return out


def pattern(n, letters="ab"):
    """A Thue-Morse word of n bytes and its complement: their differences cancel in polynomials modulo 2**64."""
    a, b = letters
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def long_words():
    """Different words of one pattern, where a window, a shingle or a whole short text hangs on them."""
    out, front = [], " ".join(f"w{k}" for k in range(12))
    for k, n in enumerate((16, 64, 128, 256, 512, 1024, 2048, 4096)):
        a, b = pattern(n, ("ab", "xY")[k % 2])
        out += [(10 * k + 1, f"{front} {a}"), (10 * k + 2, f"{front} {b}"), (10 * k + 3, a), (10 * k + 4, b), (10 * k + 5, f"u{k} v {a} {b} {a} w " * 6)]
    return [(i, t, "en", "src1") for i, t in out]


def above_a_chunk():
    """Texts longer than one numpy pass handles, which share passages with each other and with short ones."""
    w = [f"w{k * 7919 % 100_003}" for k in range(190_000)]
    long = " ".join(w)
    assert len(long) > 1 << 20
    near = list(w)
    near[1000] = near[100_000] = "other"
    return [
        (4, " ".join(w[150_000:150_060]), "en", "src1"),
        (5, long, "en", "src1"),
        (6, "before " + " ".join(w[99_950:100_050]) + " after", "en", "src2"),
        (7, " ".join(near), None, "src1"),
        (8, "short and alone", "fr", None),
    ]


@pytest.fixture(params=["corpus", "odd", "empty", "repeated ids", "long words", "above a chunk"])
def rows(request, odd):
    """The last has ids that repeat with the same and with other texts."""
    twice = [(i // 3, *rest) for i, *rest in corpus(5, 40)] + [(i // 6, *rest) for i, *rest in corpus(5, 12)]
    return {"corpus": corpus(), "odd": odd, "empty": [], "repeated ids": twice, "long words": long_words(), "above a chunk": above_a_chunk()}[request.param]


def texts(rows):
    return [(i, t or "") for i, t, *_ in rows]


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact(documents, rows):
    from corvine.llm.exact import drop_copies, mark_copies

    groups = defaultdict(list)
    for i, t in texts(rows):
        groups[t].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(
        ((i, best[t], len(groups[t]), i == best[t], sha(t)) for i, t in texts(rows)), key=repr
    )
    docs = documents(rows)
    assert collect(mark_copies(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert collect(kept.na.fill("", ["text"]), "doc_id", "text") == sorted(((best[t], t) for t in groups), key=repr)


def test_exact_keeps_one_row_of_each_text(documents):
    """Also where no row has an id, and where rows repeat as a whole."""
    from corvine.llm.exact import drop_copies

    rows = [(None, "a", "en", "x"), (None, "a", "fr", "x"), (None, "b", None, None), (1, "c", "en", None), (1, "c", "en", None), (2, "c", None, "y"), (2, "c", None, "z")]
    kept = collect(drop_copies(documents(rows)), "doc_id", "text", "lang", "source")
    assert kept == sorted([(None, "a", "fr", "x"), (None, "b", None, None), (2, "c", None, "z")], key=repr)


def test_exact_with_columns_that_have_no_order(spark):
    from corvine.llm.exact import drop_copies

    shape = "doc_id bigint, text string, tags map<string,int>, more array<struct<m:map<string,int>>>, n int"
    rows = [(1, "a", {"x": 1}, [], 5), (1, "a", {"x": 2}, [], 5), (2, "a", {"x": 0}, [({"k": 1},)], 1), (2, "a", {"x": 0}, [({"k": 2},)], 1), (3, "b", None, None, None)]
    kept = sorted((r["doc_id"], r["text"], r["tags"], r["n"]) for r in drop_copies(spark.createDataFrame(rows, shape)).collect())
    assert kept == [(2, "a", {"x": 0}, 1), (3, "b", None, None)]


def test_bpe(documents, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corvine.llm.bpe import token_digests, tokenise

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want, back = [], []
    for i, text in texts(rows):
        ids = t.encode(text, add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(decoded)))
        back.append((i, ids, decoded))
    got = token_digests(documents(rows), path)
    assert collect(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert collect(tokenise(documents(rows), path), "doc_id", "ids", "decoded") == sorted(back, key=repr)


def test_segment_tree():
    import public_tokenizers

    from corvine.llm.bpe import NO_PAIR, SegmentTree, load

    rng = random.Random(2)
    for n in (1, 2, 3, 7, 40):
        keys = [rng.randint(0, 99) for _ in range(n)]
        tree = SegmentTree(keys)
        for _ in range(60):
            k, v = rng.randrange(n), rng.choice([NO_PAIR, rng.randint(0, 99)])
            keys[k] = v
            tree.put(k, v)
            assert tree.root() == min(keys)
    bpe = load(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a" * 3000, "", "<|endoftext|>", "\x85 \x1c\x1d", "".join(map(chr, range(0x250)))):
        assert bpe.decode(bpe.encode(text)) == text


def test_fingerprint(documents, rows):
    from corvine.llm import fingerprint as f

    def phrases(text):
        known, start = set(), 0
        for end in range(1, len(text) + 1):
            if text[start:end] not in known:
                known.add(text[start:end])
                start = end
        return known | ({text[start:]} if start < len(text) else set())

    docs = sorted(texts(rows), key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].encode())))
    want = []
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        own, other = f.one_signature(text), f.one_signature(edited)
        near = f.likeness(own, other), f.likeness(own, f.one_signature(after))
        want.append((i, n, sha(edited), f.to_text(own), f.to_text(other), *near))
        if n and n < 3000:
            parse = f.Parse()
            rest = parse.feed(text)
            assert parse.dictionary | ({text[rest:]} if text[rest:] else set()) == phrases(text)
    columns = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    assert collect(f.followed(documents(rows)), *columns) == sorted(want, key=repr)


def test_fingerprint_ranges_grow_with_the_text(documents, monkeypatch):
    from corvine.llm import fingerprint as f

    docs = documents(corpus(3, 50))
    whole, ranges, found = sorted(map(tuple, f.followed(docs).collect())), [], f.id_ranges
    monkeypatch.setattr(f, "id_ranges", lambda docs, n: ranges.append(n) or found(docs, n))
    for size in (f.RANGE_BYTES, 500):
        monkeypatch.setattr(f, "RANGE_BYTES", size)
        assert sorted(map(tuple, f.followed(docs).collect())) == whole
    assert ranges[0] == 8 and ranges[1] > 20


def test_fingerprint_estimates_jaccard():
    from corvine.llm import fingerprint as f

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    error = []
    for share in (0.2, 0.5, 0.9):
        cut = int(2000 * share)
        a, b = pool[:2000], np.concatenate([pool[:cut], pool[2000 : 4000 - cut]])
        error.append(f.likeness(f.signature(a), f.signature(b)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert np.abs(error).max() < 0.15
    assert f.likeness(f.one_signature(""), f.one_signature("")) == 1 and f.likeness(f.one_signature(""), f.one_signature("a")) == 0


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("num", [85, 80, 40])
def test_near_copies(documents, rows, num):
    from corvine.llm.bottomk import group_near_copies

    sets = {}
    for i, t in texts(rows):
        w = words(t.translate({c: c + 32 for c in range(65, 91)}))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = [i for i in sets if i is not None]
    links = []
    for a in ids:
        for b in ids:
            if a < b:
                for x in sets[a]:
                    for y in sets[b]:
                        if x and y and 100 * len(x & y) >= num * len(x | y):
                            links.append((a, b))
    component = components_of(ids, links)
    want = [
        (i, len(s), component.get(i), True if i is None else component[i] == i) for i, many in sets.items() for s in many
    ]
    got = collect(group_near_copies(documents(rows), num), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(want, key=repr)


def test_least_overlap_holds_for_random_pairs():
    """Sketches of alike sets, of all sizes around the sketch's, share what the prefixes count on."""
    from corvine.llm.bottomk import SKETCH, least_overlap

    rng = np.random.default_rng(6)
    for num in (85, 80, 40):
        for _ in range(400):
            n = int(rng.integers(1, 200))
            both = rng.choice(2**40, 2 * n + 2, replace=False)
            a = both[:n]
            grow, drop = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
            b = np.concatenate([a[: n - drop], both[n : n + grow]])
            shared = len(np.intersect1d(a, b))
            if not len(b) or 100 * shared < num * (len(a) + len(b) - shared):
                continue
            kept = len(np.intersect1d(np.sort(a)[:SKETCH], np.sort(b)[:SKETCH]))
            assert kept >= max(least_overlap(np.array([len(a), len(b)]), num, 100))


def test_near_copies_in_parts(documents, monkeypatch):
    """A group above the size of one task is dealt as pairs of parts and gives the same."""
    from corvine.llm import bottomk

    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    many = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        many.append((i, " ".join(w), "en", "src1"))
    # and sets that share most of their values with these but are not alike
    for i in range(70, 110):
        many.append((i, " ".join(base[:70] + [f"y{rng.randrange(10**6)}" for _ in range(30)]), "en", "src1"))
    whole = collect(bottomk.group_near_copies(documents(many)), "doc_id", "component_id")
    for group, pool in ((16, 1 << 20), (8, 200)):
        monkeypatch.setattr(bottomk, "GROUP", group)
        monkeypatch.setattr(bottomk, "LEADERS", 3)
        monkeypatch.setattr(bottomk, "POOL", pool)
        assert collect(bottomk.group_near_copies(documents(many)), "doc_id", "component_id") == whole


def test_a_family_of_ten_thousand(documents):
    """Near copies of one text, a chain of drifting ones and unrelated texts, against links by brute force."""
    from corvine.llm.bottomk import group_near_copies

    rng = random.Random(14)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    many = []
    for i in range(10_000):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        many.append((i, " ".join(w), "en", "src1"))
    drift = list(base)
    for i in range(10_000, 10_030):
        for _ in range(2):
            drift[rng.randrange(200)] = f"z{rng.randrange(10**9)}"
        many.append((i, " ".join(drift), "en", "src1"))
    lone = [(20_000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50)), "en", "src1") for i in range(300)]
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)}
    chain = [shingles(t) for i, t, *_ in many[10_000:]]
    alike = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    # a drifting text is in the family if a chain of links leads to a copy; copies are linked with each other
    near = [any(alike(s, shingles(many[k][1])) for k in range(0, 10_000, 10)) for s in chain]
    component = components_of(range(31), [(0, k + 1) for k, n in enumerate(near) if n] + [(a + 1, b + 1) for a in range(30) for b in range(a) if alike(chain[a], chain[b])])
    want = {i: 0 for i in range(10_000)} | {10_000 + k: 0 if c == 0 else 9_999 + c for k, c in ((k - 1, c) for k, c in component.items() if k)} | {i: i for i, *_ in lone}
    got = {r["doc_id"]: r["component_id"] for r in group_near_copies(documents(many + lone)).collect()}
    assert got == want


def earlier_words(rows, length=13):
    first = {}
    for i, t in texts(rows):
        w = words(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            own = -(2**63) if i is None else i
            first[key] = min(first.get(key, own), own)
    for i, t in texts(rows):
        w = words(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (-(2**63) if i is None else i):
                gone |= set(range(k, k + length))
        yield i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_passages(documents, rows):
    from corvine.llm.coveranchors import remove_passages

    want = sorted(earlier_words(rows), key=repr)
    assert collect(remove_passages(documents(rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_exchange_rows_grow_with_tasks_not_with_blocks(spark, documents):
    """Rows that cross the shuffle: one for each task and bucket, and none is lost or changed by it."""
    from corvine.llm import blocks as B

    sent = spark.range(0, 4000, 1, 4).selectExpr("id % 7 AS bucket", "id AS block", "cast(cast(id AS string) AS binary) AS keys", "cast(NULL AS binary) AS more0")
    plan = B.pooled(sent, "bucket")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("collect_list") < text.index("Exchange hashpartitioning(bucket") < text.index("partial_collect_list")
    assert plan.count() == 7
    back = B.by_bucket(sent, lambda t: t.select(["bucket", "block", "keys", "more0"]), "bucket bigint, block bigint, keys binary, more0 binary")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sent.collect()))
    docs = documents(corpus(2, 40))
    for size in (400, 100):  # more blocks, the same rows
        found = B.Blocks(docs, block_bytes=size)
        keys = found.map(lambda b: B.deal_keys(b.number, np.arange(48, dtype=np.uint64) << np.uint64(16), 48), "bucket bigint, block bigint, keys binary")
        assert keys.count() >= 48 * 10 and B.pooled(keys, "bucket").count() == 48


def test_the_cover_covers():
    from corvine.llm.coveranchors import COVER, PERIOD

    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER for d in range(PERIOD))


def earlier_bytes(rows, length=100):
    seen = {}
    for i, t in sorted(texts(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = t.encode()
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], (-(2**63) if i is None else i, k))
    for i, t in texts(rows):
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < (-(2**63) if i is None else i, k):
                gone[k : k + length] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        yield i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))


def test_byte_repeats(documents, rows):
    from corvine.llm.runindex import remove_repeats

    got = collect(remove_repeats(documents(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(earlier_bytes(rows), key=repr)


def test_run_index_on_repetitive_strings():
    from corvine.llm.runindex import RunIndex, earlier_places

    rng = random.Random(3)
    for trial in range(120):
        length = rng.choice([2, 3, 5, 8, 20])
        docs = [(k, bytes(rng.choice(b"ab" if trial % 2 else b"abcd\0") for _ in range(rng.randint(length, 60)))) for k in range(rng.randint(1, 5))]
        data = np.frombuffer(b"".join(b for _, b in docs), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(b) for _, b in docs])))
        flags = earlier_places(data, off, np.arange(len(docs)), np.zeros(len(docs), np.int64), length)
        seen, want = set(), np.zeros(len(data), bool)
        for k, b in docs:
            for s in range(len(b) - length + 1):
                want[off[k] + s] = b[s : s + length] in seen
                seen.add(b[s : s + length])
        assert (flags == want).all()
        index = RunIndex(data, off, length)
        # LF on the runs goes through every string from its separator to its start
        text, rows = data.tobytes(), np.arange(len(docs))
        order = sorted((text[p : off[k + 1]], k, p) for k in range(len(docs)) for p in range(off[k], off[k + 1] + 1))
        for done in range(1, max(len(b) for _, b in docs) + 1):
            rows = index.step(rows)
            for k, (_, b) in enumerate(docs):
                if done <= len(b):
                    assert order[rows[k]][1:] == (k, off[k + 1] - done)
                else:
                    rows[k] = k
        # the chains hold every string that occurs twice, once each
        places = [(b[s : s + length]) for _, b in docs for s in range(len(b) - length + 1)]
        assert int((index.steps + 1).sum()) == sum(v > 1 for v in Counter(places).values())


def test_run_index_is_as_small_as_its_runs():
    """A passage costs one chain whether two strings hold it or 300, and runs instead of suffixes."""
    from corvine.llm.runindex import RunIndex

    rng = np.random.default_rng(2)
    passage = rng.integers(97, 123, 130).astype(np.uint8)
    for many in (2, 300):
        strings = [np.concatenate((rng.integers(97, 123, 10).astype(np.uint8), passage, rng.integers(97, 123, 10).astype(np.uint8))) for _ in range(many)]
        index = RunIndex(np.concatenate(strings), np.arange(many + 1) * 150, 100)
        assert (index.rows == many).sum() == 1 and int(index.steps[index.rows == many][0]) >= 29
    assert len(index.starts) < 300 * 30 < 300 * 150


@pytest.mark.parametrize("block_bytes, heavy", [(3000, 4096), (3000, 2), (1 << 20, 2)])
def test_byte_repeats_in_many_blocks(documents, rows, monkeypatch, block_bytes, heavy):
    """Many small blocks, and choices that are cut into strings."""
    from corvine.llm import runindex

    monkeypatch.setattr(runindex, "HEAVY", heavy)
    monkeypatch.setattr(runindex, "PART_BYTES", 2000)
    got = collect(runindex.remove_repeats(documents(rows), block_bytes=block_bytes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(earlier_bytes(rows), key=repr)


def test_passages_in_many_blocks(documents, rows):
    from corvine.llm.coveranchors import remove_passages

    got = collect(remove_passages(documents(rows), block_bytes=3000), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(earlier_words(rows), key=repr)


def test_one_passage_in_a_third_of_many_documents(documents):
    """Its borders make heavy choices; every document but the first loses it whole."""
    from corvine.llm.coveranchors import remove_passages
    from corvine.llm.runindex import remove_repeats

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(40))
    many = []
    for i in range(10_000):
        own = [word() for _ in range(30)]
        text = " ".join(own[:15]) + (" " + passage + " " if i % 3 == 0 else " ") + " ".join(own[15:])
        many.append((i, text, "en", "src1"))
    hit = [r["n_removed"] for r in remove_repeats(documents(many), block_bytes=50_000).orderBy("doc_id").collect()]
    size = len(passage) + 2
    assert hit[0] == 0 and all(size <= hit[i] <= size + 12 if i % 3 == 0 else hit[i] == 0 for i in range(1, 10_000))
    got = collect(remove_passages(documents(many), block_bytes=50_000), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(earlier_words(many), key=repr)


def fill(children, budget):
    """Weighted water-filling, one saturated child at a time."""
    out, left, open_ = {}, budget, dict(children)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (cap, w) in open_.items() if cap / w <= left / total]
        if not full:
            return out | {k: int(w * (left / total) // 1) for k, (_, w) in open_.items()}
        k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k))
        out[k] = open_.pop(k)[0]
        left -= out[k]
    return out


@pytest.mark.parametrize("share, epochs", [(0.5, 1), (1.3, 2), (9.0, 3), (0.0, 2)])
def test_mixing(documents, rows, share, epochs):
    from corvine.llm.mixing import domain_of, plan_copies

    weights = {"domain": {"d1": 3, "none": 0.5}, "lang": {"en": 2, "fr": 0}}
    docs = documents(rows).withColumn("domain", domain_of())
    got = plan_copies(docs, weights, share, max_epochs=epochs)
    assert got.count() == len(rows)
    leaf_of = lambda r: (f"d{int(r[3][3:]) % 4}" if r[3] else "none", r[2] or "none", r[3] or "none")
    leaves, tokens = defaultdict(list), {}
    for r in rows:
        leaves[leaf_of(r)].append((r[0], len(words(r[1] or ""))))
    weigh = lambda level, k: weights.get(("domain", "lang", "source")[level], {}).get(k, 1)
    live = {k: v for k, v in leaves.items() if all(weigh(n, x) > 0 for n, x in enumerate(k))}
    caps = Counter()
    for k, v in live.items():
        tokens[k] = sum(n for _, n in v)
        for d in (1, 2, 3):
            caps[k[:d]] += tokens[k] * epochs
    budget = {(): int(sum(n for v in leaves.values() for _, n in v) * share)}
    for d in range(3):
        for parent in [b for b in budget if len(b) == d]:
            children = {c: (caps[c], weigh(d, c[-1])) for c in caps if len(c) == d + 1 and c[:d] == parent}
            budget |= fill(children, budget[parent])
    want = []
    for k, v in leaves.items():
        whole, rest = divmod(budget.get(k, 0), tokens[k]) if tokens.get(k) else (0, 0)
        place = lambda i: hashlib.md5(f"17:{whole}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
        reach = 0
        for i, n in sorted(v, key=lambda x: (place(x[0]), x[0] is not None, x[0] or 0, x[1])):
            reach += n
            want.append((i, *k, n, whole + (k in live and reach <= rest)))
    assert collect(got, "doc_id", "domain", "lang", "source", "n_tokens", "copies") == sorted(want, key=repr)


def test_mixing_in_many_buckets(documents, monkeypatch):
    from corvine.llm import mixing

    docs = documents(corpus(4, 80)).withColumn("domain", mixing.domain_of())
    plain = collect(mixing.plan_copies(docs, {}, 0.6), "doc_id", "copies")
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 1)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert collect(mixing.plan_copies(docs, {}, 0.6), "doc_id", "copies") == plain


def test_components(spark):
    from corvine.llm.components import components

    rng = random.Random(8)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(k, k + 1) for k in range(200, 260)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components_of(nodes, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_byte_repeats_of_a_document_that_is_there_twice(documents):
    """Both rows lose the passage, up to its borders with their own text, to an earlier holder."""
    from corvine.llm.runindex import remove_repeats

    rng = random.Random(11)
    prose = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = prose(400)
    inside = prose(300) + passage + prose(300)
    rows = [(1, passage, None, None), (5, inside, None, None), (5, inside, None, None), (7, passage[:120] + prose(200), None, None)]
    got = collect(remove_repeats(documents(rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(earlier_bytes(rows), key=repr)
    assert [r[2] for r in got][:3] == [0, 400, 400]


def test_earlier_places_of_repeated_rows():
    from corvine.llm.runindex import earlier_places

    rng = random.Random(4)
    for trial in range(200):
        length = rng.choice([2, 3, 5, 8])
        docs = [(k, bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randint(length, 40)))) for k in range(rng.randint(1, 4))]
        docs = sorted(docs + [rng.choice(docs) for _ in range(3)])
        off = np.concatenate(([0], np.cumsum([len(b) for _, b in docs])))
        ids = np.array([k for k, _ in docs])
        flags = earlier_places(np.frombuffer(b"".join(b for _, b in docs), np.uint8), off, ids, np.zeros(len(docs), np.int64), length)
        first = {}
        for k, b in docs:
            for s in range(len(b) - length + 1):
                first.setdefault(b[s : s + length], (k, s))
                first[b[s : s + length]] = min(first[b[s : s + length]], (k, s))
        for (k, b), at in zip(docs, off[:-1], strict=True):
            assert [first[b[s : s + length]] < (k, s) for s in range(len(b) - length + 1)] == flags[at : at + len(b) - length + 1].tolist()

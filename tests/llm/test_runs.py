"""Periodic runs against a direct search, and the pieces of the method against their definitions."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from corvine.llm import runs as M

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def slow_runs(w, least=24, exponent=3):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, exponent * q):
                out.append((s, i + q - s, q))
    # a stretch with a smaller period is the run of that one
    return sorted(
        ((s, n, q) for s, n, q in out if not any(q % p == 0 and p < q and a <= s and s + n <= a + m for a, m, p in out)), key=lambda r: (r[0], r[2])
    )


def planted(i, w):
    h = 1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def slow_row(i, text):
    w = planted(i, words(text or ""))
    found = slow_runs(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        i,
        len(found),
        *best,
        None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        sha(" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


def texts(seed=3, n=120):
    """Prose of few words, with repeated stretches, whole and broken, at both ends and inside."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        vocabulary = [f"w{k}" for k in range(rng.choice([1, 2, 3, 40]))]
        prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]  # noqa: E731, B023
        w = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            root = prose(rng.randint(1, 30))
            w += (root * 9)[: rng.randint(len(root), 5 * len(root))]
            if rng.random() < 0.3 and w:
                w[rng.randrange(len(w))] = "x"
            w += prose(rng.randint(0, 10))
        out.append((i * 7 - 50, rng.choice([" ", "\n", " \t"]).join(w), "en", "src1"))
    return out


@pytest.mark.parametrize("case", ["texts", "odd", "empty", "repeated"])
def test_runs(documents, odd, case):
    rows = {"texts": texts(), "odd": odd, "empty": [], "repeated": texts(4, 8) * 2}[case]
    got = sorted((tuple(r) for r in M.run_digests(documents(rows)).collect()), key=repr)
    if case == "odd":  # the direct search is quadratic
        short = {i for i, t, *_ in rows if t is None or len(t) < 20_000}
        got, rows = [r for r in got if r[0] in short], [r for r in rows if r[0] in short]
    assert got == sorted((slow_row(i, t) for i, t, *_ in rows), key=repr)


def test_other_thresholds(documents):
    docs = documents(texts(9, 60))
    for least, exponent in ((1, 2), (5, 2), (7, 4)):
        got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in M.find_runs(docs, least, exponent).collect()}
        assert got == {i: slow_runs(words(t), least, exponent) for i, t, *_ in texts(9, 60)}
    with pytest.raises(ValueError):
        M.find_runs(docs, exponent=1)


def test_a_text_above_a_megabyte(documents):
    root = [f"word{k * 7919 % 10007}" for k in range(9000)]
    w = [f"p{k}" for k in range(50_000)] + root * 9 + ["end"]
    r = M.find_runs(documents([(1, " ".join(w), None, None), (2, "a " * 30, None, None)])).orderBy("doc_id").collect()
    assert [tuple(x) for x in r[0]["runs"]] == [(50_000, 81_000, 9000)]
    assert r[0]["collapsed"] == " ".join([*w[:50_000], *root, "end"])
    assert [tuple(x) for x in r[1]["runs"]] == [(0, 30, 1)] and r[1]["collapsed"] == "a"


def test_long_words_that_differ(documents):
    a, b = "ab" * 600, "ba" * 600
    for k in range(11):  # Thue-Morse strings
        a, b = ("a", "b") if not k else (a + b, b + a)
    w = ([a] * 11 + [b]) * 5
    found = M.find_runs(documents([(1, " ".join(w), None, None)])).first()["runs"]
    assert [tuple(r) for r in found] == slow_runs(w)


def test_pieces():
    rng = np.random.default_rng(5)
    for size in (2, 5, 100, 700):
        codes = np.append(rng.integers(1, 4, size), 0)
        rank = M.suffix_ranks(codes)
        n, t = len(codes), codes.tolist()
        assert np.argsort(rank).tolist() == sorted(range(n), key=lambda i: t[i:])
        smaller = M.next_smaller(rank)
        assert all(smaller[i] == next((j for j in range(i + 1, n) if t[j:] < t[i:]), n) for i in range(n))
        values = rng.integers(0, 99, size).astype(np.int32)
        a = rng.integers(0, size, 400)
        b = np.minimum(a + rng.integers(0, size, 400), size - 1)
        assert M.Minima(values).least(a, b).tolist() == [int(values[x : y + 1].min()) for x, y in zip(a, b)]
        i, j = rng.integers(0, n, 300), rng.integers(0, n, 300)
        i, j = i[i != j], j[i != j]
        common = lambda x, y: next(k for k in range(n) if max(x, y) + k >= n or t[x + k] != t[y + k])
        assert M.Extensions(codes)(i, j).tolist() == [common(x, y) for x, y in zip(i.tolist(), j.tolist())]

import hashlib

import numpy as np
import pytest

from corpuskit.llm import periodic_runs as R
from corpuskit.llm.queries import op13_multiscale_minimizers


def plain_runs(words, min_words=24):
    """Every stretch at every lag; the smallest lag of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def samples(seed):
    """Random words with runs of many periods, also overlapping, nested and at the edges."""
    rng = np.random.default_rng(seed)
    for size in (2, 3, 50, 4000):
        for n in (0, 1, 23, 24, 30, 200, 900):
            x = rng.integers(0, size, n)
            for _ in range(int(rng.integers(0, 4))):
                if n > 40:
                    q = int(rng.integers(1, n // 4))
                    a = int(rng.integers(0, n - 3 * q))
                    length = int(rng.integers(3 * q - 1, min(n - a, 6 * q) + 1))
                    x[a : a + length] = np.resize(x[a : a + q], length)
            yield x
    yield np.resize(rng.integers(0, 3, 7), 400)
    yield np.concatenate([np.resize(np.resize([1, 2], 30).tolist() + [5], 31 * 12), rng.integers(0, 9, 50)])
    yield np.zeros(300, int)
    for q in range(1, 60):  # exactly three periods, and one word less
        root = np.arange(q)
        yield np.concatenate([[900], np.resize(root, max(24, 3 * q)), [901]])
        yield np.concatenate([[900], np.resize(root, max(24, 3 * q) - 1), [901]])


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_brute_force(seed):
    texts = list(samples(seed))
    got = R.find_runs(texts)
    for t, runs in zip(texts, got):
        assert runs == plain_runs(t.tolist())
    assert sum(map(len, got)) > 50


def test_equal_hashes_are_compared(monkeypatch):
    """With hashes of few bits the seeds are wrong often; the runs found are still right ones."""
    texts = list(samples(9))
    real = R.Hashes.equal
    monkeypatch.setattr(R.Hashes, "equal", lambda self, a, lag, size: real(self, a, lag, size) | (size % 13 == 5))
    for t, runs in zip(texts, R.find_runs(texts)):
        assert set(runs) <= set(plain_runs(t.tolist()))


def test_long_text_at_many_scales():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 60_000, 200_000)
    want = []
    for q, a in ((5, 100), (700, 1000), (9000, 20_000), (40_000, 60_000)):
        x[a : a + 3 * q + 24] = np.resize(x[a : a + q], 3 * q + 24)
        x[a - 1], x[a + 3 * q + 24] = 70_000, 70_001
        want.append((a, 3 * q + 24, q))
    assert R.find_runs([x]) == [want]


def plain_row(doc_id, text, edit=None):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    words = edit(words, doc_id) if edit else words
    runs = plain_runs(words) if len(words) < 4000 else None
    if runs is None:
        return None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *(top or (None,) * 3), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_by_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    checked = hit = 0
    for r in op13_multiscale_minimizers(spark, sf).collect():
        want = plain_row(r.doc_id, docs[r.doc_id], R.repeat_tail)
        if want:
            assert (r.n_runs, r.start, r.length, r.period, r.runs_sha256, r.collapsed_sha256) == want
            assert r.exponent_milli == (1000 * r.length // r.period if r.n_runs else None)
            checked, hit = checked + 1, hit + (r.n_runs > 0)
    assert checked > 150 and hit >= 10


def test_repeat_tail():
    import zlib

    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 10 == 0]
    for i in ids:
        h, words = zlib.crc32(str(i).encode()), [str(w) for w in range(3 + i)]
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert R.repeat_tail(words, i) == [words[w] if w < a else words[a + (w - a) % p] for w in range(n)]
    assert R.repeat_tail([], ids[0]) == [] and R.repeat_tail(["a"], None) == ["a"]


def test_odd_documents(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 5)
    rows = R.find(odd_docs, with_text=True).collect()
    assert len(rows) == 9
    for r in rows:
        if r.doc_id == 5:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) == (1, 0, 30_000, 1, 30_000_000, "wort")
        else:
            assert r.n_runs == 0 and r.start is None and r.runs == []
    by = {r.doc_id: r for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(by[i].collapsed_sha256 == by[i].runs_sha256 == empty for i in (2, 3, 4))
    assert by[6].collapsed == "A▁b c École \U0001F600"
    assert R.find(no_docs).count() == 0

import hashlib
import random
import re

import numpy as np
import pytest

from corvane.llm import exact_dedup, near_dedup, substring_dedup

ODD = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a b"), (5, "a b"), (6, " \n\t"), (None, "a b"), (None, None), (7, "é" * 9000), (8, "é" * 9000)]


def test_exact_odd_rows(table):
    rows = exact_dedup.exact_groups(table(ODD)).collect()
    assert len(rows) == len(ODD)
    by = {}
    for i, t in ODD:
        by.setdefault(t or "", []).append(i)
    for r in rows:
        text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = by[text]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    for t, ids in by.items():
        assert sum(r["kept"] for r in rows if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()) == 1, t
    assert exact_dedup.exact_groups(table([])).count() == 0


def test_exact_long_texts_differ_in_one_byte(table):
    base = "lorem ipsum " * 5000
    texts = [base, base, base[:-1] + "x", "x" + base[1:], base + " ", base[:30000] + "x" + base[30001:]]
    rows = exact_dedup.exact_groups(table(list(enumerate(texts))), block=64).collect()
    assert sorted(r["group_size"] for r in rows) == [1, 1, 1, 1, 2, 2]


def jaccard_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}, sets


def families(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        base = r.choices(words, k=r.choice([3, 6, 30, 80, 150]))
        for _ in range(r.choice([1, 1, 3, 12])):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 8))):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy).capitalize())
    r.shuffle(out)
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_like_brute_force(table, k):
    texts = families(k, 40) + ["", None, "One", "one", "a b", "A  b"]
    want, sets = jaccard_groups(texts, k, 80)
    rows = near_dedup.near_duplicates(table(list(enumerate(texts))), shingle_words=k).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["component_id"] == r["doc_id"]) for r in rows)


def test_large_family_of_near_copies(table, monkeypatch):
    """A crowd around one text, whose outer members are linked by chains or not at all."""
    monkeypatch.setattr(near_dedup, "LARGE_BUCKET", 4)
    r = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    base = r.choices(words, k=120)
    texts = []
    for _ in range(160):
        copy = list(base)
        for _ in range(r.randrange(1, 14)):
            copy[r.randrange(120)] = r.choice(words)
        texts.append(" ".join(copy))
    want, _ = jaccard_groups(texts, 2, 80)
    rows = near_dedup.near_duplicates(table(list(enumerate(texts))), shingle_words=2).collect()
    assert {x["doc_id"]: x["component_id"] for x in rows} == want


def test_colliding_row_keys_get_another_salt(table, monkeypatch):
    plain = near_dedup._row_key
    monkeypatch.setattr(near_dedup, "_row_key", lambda i, t, salt: plain(i, t, salt) if salt > 1 else plain(i, t, salt) % 8)
    texts = families(3, 25)
    want, _ = jaccard_groups(texts, 2, 80)
    docs = table(list(enumerate(texts)))
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, shingle_words=2).collect()} == want
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs, shingle_words=2).collect()) == sorted(set(want.values()))


def test_near_odd_rows(table):
    rows = near_dedup.near_duplicates(table(ODD), shingle_words=2).collect()
    assert len(rows) == len(ODD)
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert near_dedup.near_duplicates(table([])).count() == 0


def test_sketch_agrees_with_similarity():
    s = near_dedup.Sketcher(512)
    r = np.random.default_rng(0)
    for n, shared in ((3, 2), (40, 30), (700, 600)):
        pool = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s(a) == s(b)).mean() - true) < 0.09
        assert (s(a) < np.uint64(2**64 - 1)).all() and (s(a) == s(a[::-1])).all()


def windows_removed(texts, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for w in docs:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def passages(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    shared = [r.choices(words, k=n) for n in (20, 35, 36, 60, 200)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts += r.choice(shared) if r.random() < 0.5 else r.choices(words, k=r.randrange(0, 70))
        texts.append(" \n".join(parts))
    return texts + ["ab " * 90, "ab " * 34, "x y " * 50, "", None, " ".join(words[:35]), " ".join(words[:35]), "long " * 3 + " ".join(r.choices(words, k=6000))]


@pytest.mark.parametrize("crowded", [64, 2])
def test_windows_like_brute_force(table, monkeypatch, crowded):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    texts = passages(crowded)
    rows = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removal_rows(table(list(enumerate(texts))), 35).collect()}
    assert rows == dict(enumerate(windows_removed(texts, 35)))


def test_substring_odd_rows(table):
    long = " ".join(f"q{i}" for i in range(60))
    rows = substring_dedup.removal_rows(table([*ODD, (20, long), (20, long), (None, None)]), 50).collect()
    assert sum(r["n_removed"] for r in rows) == 120
    assert substring_dedup.removal_rows(table([]), 50).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.removal_rows(table([]), 64)


def test_cut_texts_keep_the_rest(table):
    shared = " ".join(f"s{i}" for i in range(55))
    docs = table([(1, f"Head  one\n{shared}\nTail one."), (2, f"{shared} tail"), (3, "alone"), (4, None)])
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs, 50).collect()}
    assert got == {1: "Head  one\nTail one.", 2: "tail", 3: "alone", 4: None}
    assert substring_dedup.remove_repeats(docs, 50).columns == docs.columns


def test_fm_index_counts():
    r = np.random.default_rng(3)
    lengths = np.array([40, 7, 90])
    words = r.integers(1, 5, lengths.sum())
    f = substring_dedup.FMIndex(words, lengths, np.array([1, 1, 1]))
    segments = np.split(words, np.cumsum(lengths)[:-1])
    for n in (1, 2, 5):
        for s in segments:
            p = s[:n]
            left, right = np.array([0]), np.array([f.n])
            for c in p[::-1]:
                left, right = f.extend(np.array([c]), left, right)
            want = sum((x[i : i + n] == p).all() for x in segments for i in range(len(x) - n + 1))
            assert int(right[0] - left[0]) == want

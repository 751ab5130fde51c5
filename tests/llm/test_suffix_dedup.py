"""Repeats against a table of all strings; periodic texts, copies, nulls, repeated rows, empty tables, extra columns."""

import hashlib
import random

import numpy as np
import pytest

from linkforge.llm import suffix_dedup


def brute(rows, length):
    met = {}
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - length + 1):
            met[t[i : i + length]] = met.get(t[i : i + length], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if met[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        cover = np.cumsum(gone)[:-1] > 0 if len(t) else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(int), [0]))))
        kept = bytes(b for b, c in zip(t, cover) if not c)
        out.append((d, len(t), int(cover.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), tuple(zip(edge[::2].tolist(), edge[1::2].tolist()))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], tuple((s["begin"], s["end"]) for s in r[5])) for r in df.collect()), key=str)


def sample(seed, length):
    r = random.Random(seed)
    words = ["ab", "cde", "fgäh", "ij", "kl mn", "日本", "x", "yz."]

    def prose(n):
        return "".join(r.choice(words) + r.choice([" ", "", str(r.randrange(99))]) for _ in range(n))

    shared = [prose(r.randrange(20, 200)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = prose(r.randrange(0, 120))
        for _ in range(r.randrange(0, 4)):
            s = r.choice(shared)
            a = r.randrange(0, len(s) // 2)
            t += s[a : a + r.randrange(1, len(s))] + prose(r.randrange(0, 60))
        texts.append(t)
    texts += ["-" * (3 * length), "-" * (length + 1), "." * length, ":" * (length - 1), "ab" * length, "xyz" * length + "q", "ababa" + "ba" * length]
    texts += [texts[0], texts[3] + "!", "?" + texts[4], texts[5][7:], texts[6] + texts[6], None, "", "short"]
    texts += [f"{prose(9)}{'=' * (length // 2)}{shared[0][: length // 3]}{'=' * (length // 2)}{prose(7)}" for _ in range(5)]
    texts += [shared[1][:length], f"a{shared[1][: length + 1]}", f"b{shared[1][: length - 1]}c"]
    return [(i if i % 9 else 0, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "length"), [(1, 64), (2, 100), (3, 400)])
def test_equals_brute_force(spark, seed, length):
    rows = sample(seed, length) + [(None, "null id " * 40)]
    df = spark.createDataFrame([(d, t, 1, 2, "k", 3) for d, t in rows], "doc_id long, text string, tid int, k int, digest string, n int").repartition(3)
    out = suffix_dedup.repeats(df, length)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    assert got(out) == brute(rows, length)


def test_every_string_has_one_owner_of_its_own_bytes():
    """The anchor that a string belongs to, and whether it has one, doesn't depend on what is around it."""
    r = np.random.default_rng(4)
    for length in (64, 90, 400):
        cut = suffix_dedup.Cut(length)
        core = bytes(r.integers(97, 97 + (2 if length == 90 else 26), length).astype(np.uint8))
        if length == 64:
            core = b"ab" * 32
        found = set()
        for _ in range(30):
            left, right = (bytes(r.integers(97, 100, int(r.integers(0, 300))).astype(np.uint8)) for _ in range(2))
            text = left + core + right
            off = np.array([0, len(text)])
            x = cut.phrases(np.frombuffer(text, np.uint8), off)
            mine = [(int(a) - len(left), int(n), int(c)) for a, n, lo, hi, c in zip(x["a"], x["n"], x["lo"], x["hi"], x["c"]) if lo <= len(left) <= hi]
            found.add(tuple(mine))
            owned = [i for lo, hi in zip(x["lo"], x["hi"]) for i in range(lo, hi + 1)] + [i for _, b, e in zip(*cut.bare(x, off)) for i in range(b, e + 1)]
            assert sorted(owned) == list(range(len(text) - length + 1))
        assert len(found) == 1 and all(len(f) <= 1 for f in found)


def test_ranks_sort_suffixes(spark):
    r = random.Random(6)
    strings = {t: [r.randrange(1, 4) for _ in range(r.randrange(1, 70))] for t in range(25)}
    strings[99] = [2] * 60
    rows = [(t, 0, j, c, j + 1 < len(s), 1) for t, s in strings.items() for j, c in enumerate(s)]
    symbols = spark.createDataFrame(rows, "tid long, q long, j int, c long, more boolean, span int")
    ranks = suffix_dedup.suffix_ranks(symbols, 1000)
    order = [strings[x["tid"]][x["j"] :] for x in ranks.orderBy("rank").collect()]
    assert order == sorted(order) and len(order) == len(rows)


def test_strings_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "q" * 500), ("b", "q" * 500)], "doc_id string, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.repeats(df).collect()} == {("a", 500), ("b", 500)}
    assert suffix_dedup.repeats(df.where("false")).count() == 0
    assert [r["n_removed"] for r in suffix_dedup.repeats(df.limit(1)).collect()] == [500]


def test_hashes_of_strings():
    buf = np.frombuffer(bytes(range(200)) * 5, np.uint8)
    for length in (64, 100, 400):
        h = suffix_dedup.window_hashes(buf, length, 2)
        assert len(h) == 1000 - length + 1 and (h[:-200] == h[200:]).all() and len(set(h[:200].tolist())) == 200
    assert len(suffix_dedup.window_hashes(buf[:10], 64, 2)) == 0


def test_strings_without_phrases_are_taken_in_runs(spark):
    """Where one short period meets another, hundreds of strings hold no phrase: a row for some sixteen of them, and none is lost."""
    r = random.Random(8)
    prose = ["".join(r.choices("abcdefghij ", k=900)) for _ in range(8)]
    meet = [f"{'Pf ' * 300}{'The ' * 300}", f"{'Was. ' * 200}{'Erly ' * 200}{'A ' * 350}"]
    rows = [(i, f"{prose[i]}{meet[i % 2]}{prose[-1 - i]}") for i in range(4)] + [(4, meet[0][400:1300]), (5, f"{prose[6]}{meet[1][700:1500]}?"), (6, f"{'Of ' * 300}{'The ' * 300}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bare = suffix_dedup.parsed(df, "text", suffix_dedup.Cut(400)).where(f"k = {suffix_dedup.BARE}").count()
    assert 0 < bare < 800
    assert got(suffix_dedup.repeats(df, 400)) == brute(rows, 400)

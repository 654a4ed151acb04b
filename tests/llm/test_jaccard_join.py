"""The Jaccard join and near duplicates of short slices against brute force."""

import random

import numpy as np
import pytest

from lexigrid.llm import jaccard_join, lm_scores, near_dedup, substring_dedup, words

EXTRA = "doc_id long, text string, node int, n string, token long, level int, a int, known string, rep long"


def table(spark, rows):
    """Documents with other columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, 1, "n", 2, 3, 4, "k", 5) for i, t in rows], EXTRA)


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def joined(docs, percent, size=3):
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if a and b and i is not None and j is not None:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(s), None if i is None else least[find(x)]) for x, (i, s) in enumerate(sets)), key=repr)


EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One"), (905, "two words"), (906, "a b c"), (907, "A  b\nc"), (None, "no id at all here"), (None, None), (908, "x" * 100_000)]


def corpus(seed, groups=8, copies=14, length=90):
    """Near copies that drift, documents of common lines, and single ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(900)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(5)]
    docs = []
    for g in range(groups):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 30, length, 3 * length]))]
        for _ in range(copies):
            docs.append((len(docs), " ".join(text)))
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.1:
                text.append("more")
    for _ in range(60):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 25])))
        docs.append((len(docs), f"{rng.choice(lines)} {own} {rng.choice(lines)}"))
    docs += [(500 + k, docs[k * 7][1].upper() if k % 2 else docs[k * 7][1]) for k in range(12)]
    docs += [(3, docs[20][1]), docs[5], docs[5]]  # rows that share an id
    return docs + EDGES


SMALL = jaccard_join.Sizes(hot=3, few=2, block=4, pivots=1, stars=1)


@pytest.mark.parametrize("percent,sizes", [(90, jaccard_join.Sizes()), (90, SMALL), (80, SMALL._replace(hot=9)), (60, SMALL._replace(few=5, pivots=2))])
def test_join(spark, percent, sizes):
    docs = corpus(percent + sizes.hot)
    got = jaccard_join.join(table(spark, docs), percent, sizes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == joined(docs, percent)


STARRED = SMALL._replace(few=1, starred=2)


@pytest.mark.parametrize("percent,sizes", [(90, STARRED), (80, STARRED._replace(block=2, pivots=2)), (90, SMALL._replace(hot=1, block=100))])
def test_join_of_starred_groups(spark, percent, sizes):
    docs = corpus(percent + sizes.block)
    got = jaccard_join.join(table(spark, docs), percent, sizes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == joined(docs, percent)


def alike(groups, copies, length=120, changed=4):
    """Groups of texts with a few words of their own each, nearly similar, of which the
    first two are."""
    rng = random.Random(6)
    docs = []
    for g in range(groups):
        text = [f"g{g}w{k}" for k in range(length)]
        for c in range(copies):
            own = list(text)
            for k in range(changed if c > 1 else 1):
                own[1 + (rng.randrange(length // changed - 3) + k * (length // changed))] = f"own{c}x{k}"
            docs.append((len(docs), " ".join(own)))
    return docs


def test_what_is_nearly_similar_is_not_verified(spark, monkeypatch):
    """Its texts are not read, and pairs of a group do not grow with its square."""
    rows = {}

    def counted(df, tag, keep=jaccard_join.materialize):
        held = keep(df, tag)
        rows[tag] = rows.get(tag, 0) + held.count()
        return held

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    docs = alike(groups=3, copies=50)
    got = jaccard_join.join(table(spark, docs), 90)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == joined(docs, 90)
    assert 0 < rows["candidates"] <= 10 * len(docs)
    assert rows["sets"] <= len(docs) // 4


def test_windows_that_hold_what_few_ask_for(spark):
    """Rows of windows are those asked for, not all that any window holds."""
    windows = [(k, 9, [100 * k + j for j in range(20)]) for k in range(30)]
    classes = spark.createDataFrame(windows, "node long, n long, first_tokens array<long>")
    wanted = spark.createDataFrame([(-5,), (7,), (1203,), (2919,)], "token long")
    met = jaccard_join._met(classes, wanted)
    assert sorted(tuple(r) for r in met.select("node", "n", "width", "pos", "token").collect()) == [(0, 9, 20, 7, 7), (12, 9, 20, 3, 1203), (29, 9, 20, 19, 2919)]


def test_join_of_an_empty_table(spark):
    assert jaccard_join.join(table(spark, EDGES).where("false")).count() == 0
    assert {tuple(r) for r in jaccard_join.join(table(spark, [(1, None), (2, " ")])).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_join_of_very_long_texts(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(5000)}" for _ in range(400_000)]
    other = list(long)
    for _ in range(5000):
        other[rng.randrange(len(other))] = "z"
    far = list(long)
    for _ in range(40_000):
        far[rng.randrange(len(far))] = "y"
    got = jaccard_join.join(table(spark, [(4, " ".join(long)), (5, " ".join(other)), (6, " ".join(far)), (7, "short one")])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {4: 4, 5: 4, 6: 6, 7: 7}


def test_choice_of_prefixes():
    """Rare tokens next in line lengthen a prefix, frequent ones do not."""
    n, window = np.array([100, 100]), np.array([22, 22])
    owner = np.repeat([0, 1], 22)
    pos = np.tile(np.arange(22), 2)
    df = np.where(owner == 0, np.where(pos < 11, 20, 1), np.where(pos < 11, 2, 60))
    need, level = jaccard_join.choose(n, window, owner, pos, df, 90, 64)
    assert need.tolist() == [4, 1] and level[:11].tolist() == [1] * 11 and level[11:14].tolist() == [2, 3, 4]


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    for size in (3, 300, 1000, 1025, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate((a[: int(0.96 * len(a))], rng.integers(0, 1 << 63, size // 50 + 1).astype(np.uint64))))
        x, y = (np.frombuffer(jaccard_join.bitmap(s), np.uint64)[None, :] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        apart = np.bitwise_count(jaccard_join._folded(x, width) ^ jaccard_join._folded(y, width)).sum()
        assert apart <= len(np.setxor1d(a, b))


# -- slices of few words, and words whose sums of powers are equal


@pytest.mark.parametrize("counts", [[k] for k in range(7)] + [[0, 1], [1, 1], [1, 2], [2, 0, 1], [3, 0], [0, 3, 3], [4, 1], [2, 2, 2]])
def test_slices_of_few_words(counts):
    values = [" ".join("abcdefg"[:n]) for n in counts]
    for size in (3, 5):
        assert [len(s) for s in near_dedup.shingle_sets(values, size)] == [len(shingles(v, size)) for v in values]
    word, bounds = words.word_hashes(values)
    for order in range(1, 8):
        hashes, known = lm_scores._grams(word, bounds, order)
        assert len(hashes) == len(known) == order * len(word)
        assert known.sum() == sum(max(0, n - k) for n in counts for k in range(order))


@pytest.mark.parametrize("texts", [[""], ["a"], ["a b"], ["a b c"], ["a b", "c"], ["a b c d"], ["a b c", "a b c"], ["a b c d e"], ["a b c d e f", "", "A b c"]])
def test_near_duplicates_of_few_words(spark, texts):
    docs = list(enumerate(texts))
    got = near_dedup.near_duplicates(table(spark, docs).coalesce(1)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == joined(docs, 80, 5)


def alternating(n):
    """The first ``n`` letters of the Thue-Morse sequence, and the opposite ones."""
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n)), "".join("ba"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_powers_confuse(spark):
    docs = []
    for n in (64, 1024, 4096):
        for word in alternating(n):
            docs.append((len(docs), " ".join([word] * 8 + ["end"])))
            docs.append((len(docs), word))
    for run in (near_dedup.near_duplicates, jaccard_join.join):
        assert {r["component_id"] for r in run(table(spark, docs)).collect()} == set(range(len(docs)))
    scores = {r["doc_id"]: r for r in lm_scores.score(table(spark, docs + [(99, docs[-1][1])])).collect()}
    assert scores[docs[-1][0]]["mean_log_score"] == scores[99]["mean_log_score"] != scores[docs[-3][0]]["mean_log_score"]


@pytest.mark.parametrize("batch", [4 << 20, 3000])
def test_passages_that_powers_confuse(spark, monkeypatch, batch):
    """Equal but for one passage each, which alone decides, inside a bucket and across batches."""
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch)
    a, b = alternating(2048)
    docs = [(0, a), (1, b), (2, "x" + a), (3, "q" * 3000)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(table(spark, docs), least=2048).collect()}
    assert got == {0: 2048, 1: 0, 2: 2048, 3: 3000}

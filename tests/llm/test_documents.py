"""Document operators against brute force, and their edge cases."""

import collections
import hashlib
import html
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import bwt, decontamination, html_text, lm_scores, near_dedup, quality, substring_dedup, toxicity

EXTRA = "doc_id long, text string, kept int, text_key string, lows int, component_id string, h double"
WORDS = "ab cd ef gh ij kl mn op qr st".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def table(spark, rows):
    """Documents with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "k", 2, "c", 0.5) for i, t in rows], EXTRA)


EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One"), (None, "no id at all here"), (905, "x" * 100_000)]


# -- near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(docs, percent):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("percent,block", [(85, 4096), (80, 5)])
def test_near_duplicates(spark, monkeypatch, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(percent)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for g in range(6):
        text = prose(rng, 120, vocabulary).split()
        for _ in range(8):  # copies of copies drift away from the first
            docs.append((len(docs), " ".join(text)))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"z{rng.randrange(999)}"
    docs += [(500 + k, docs[0][1].upper() if k % 2 else docs[0][1]) for k in range(6)] + EDGES
    got = near_dedup.near_duplicates(table(spark, docs), percent).collect()
    expected = classes(docs, percent)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] is not None} == {i: len(shingles(t)) for i, t in docs if i is not None}
    assert near_dedup.near_duplicates(table(spark, docs).where("false"), percent).count() == 0


@pytest.mark.parametrize("step", [1, 7, 1 << 22])
def test_words_are_hashed_in_groups(monkeypatch, step):
    from lexigrid.llm import words

    rng = random.Random(step)
    values = [prose(rng, rng.randint(0, 30), [*WORDS, "é" * 9, "\t", "A.b"]) for _ in range(50)] + ["", "x" * 500]
    expected = [words.word_hashes(values, signs) for signs in (False, True)]
    monkeypatch.setattr(words, "STEP", step)
    for signs in (False, True):
        for a, b in zip(words.word_hashes(values, signs), expected[signs]):
            assert (a == b).all()


def test_very_long_text(spark):
    """A text of many megabytes beside a near copy and short ones."""
    rng = random.Random(31)
    long = " ".join(prose(rng, 2000, [f"w{k}" for k in range(5000)]) for _ in range(400))
    docs = table(spark, [(1, long), (2, long + " more of it"), (3, "short"), (4, None)])
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert got[2]["component_id"] == 1 and got[1]["n_shingles"] > 790_000 and got[3]["kept"] and got[4]["kept"]
    assert {r["doc_id"]: r["n_words"] for r in lm_scores.score(docs).collect()} == {1: 800_000, 2: 800_003, 3: 1, 4: 0}
    rest = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert rest == {1: 0, 2: len(" more of it"), 3: 5, 4: 0}


def test_large_bucket_of_unlike_copies(spark, monkeypatch):
    """Copies of copies that no few members reach, some alike and some not, in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    rng = random.Random(12)
    text = prose(rng, 150, [f"w{k}" for k in range(400)]).split()
    docs = []
    for k in range(60):
        docs.append((k, " ".join(text)))
        for _ in range(4):
            text[rng.randrange(len(text))] = f"z{rng.randrange(999)}"
        if k % 15 == 14:
            text[:70] = prose(rng, 70, [f"y{k}{j}" for j in range(300)]).split()
    got = near_dedup.near_duplicates(table(spark, docs), 80, row=F.col("doc_id") + 1000).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == classes(docs, 80)
    assert all(r["row_key"] == r["doc_id"] + 1000 for r in got) and len({r["component_id"] for r in got}) > 1


def test_repeated_ids(spark):
    docs = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (2, "q r s t u v")]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, docs)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (2, 1)]


def test_estimate_is_near_the_similarity():
    a = near_dedup.shingle_sets([" ".join(f"a{k}" for k in range(500))])[0]
    for share in (0.2, 0.5, 0.8, 0.95):
        b = np.concatenate((a[: int(len(a) * share)], near_dedup.shingle_sets([" ".join(f"b{k}" for k in range(40))])[0]))
        u, v = near_dedup.registers([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        one = near_dedup.estimate(*(np.array([x]) for x in ((u > v).sum(), (u < v).sum(), (u == v).sum(), float(len(a)), float(len(b)))))
        assert abs(one[0] - true) < near_dedup.MARGIN
        assert (np.maximum(u, v) == near_dedup.registers([np.union1d(a, b)])[0]).all()


# -- quality


def measured(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(4)
    signs = ["a", "b c", "#x", "|", "<*>", "é", "\n", "\n\n", "\t", "日本", "\x0b", "A"]
    docs = [(k, " ".join(rng.choice(signs[: rng.randint(1, 12)]) for _ in range(rng.randint(0, 60)))) for k in range(200)]
    docs += [(300 + k, prose(rng, 60, [f"word{j}" for j in range(400)])) for k in range(100)] + [(400 + k, prose(rng, 9) * 8) for k in range(9)] + EDGES
    rows = quality.judge(table(spark, docs)).collect()
    assert len(rows) == len(docs)
    by_id = dict(docs)
    for r in rows:
        want = measured(by_id[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        base = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == base and not (base and r["kept"])
    assert all(r["kept"] for r in rows if r["doc_id"] and 300 <= r["doc_id"] < 400)
    assert quality.judge(table(spark, docs).where("false")).count() == 0


def test_quality_against_a_plain_em(spark):
    """Votes and expectation-maximisation again, in arrays over documents."""
    rng = random.Random(14)
    good = [f"word{j}" for j in range(900)]
    docs = [(k, prose(rng, rng.randint(5, 300), good)) for k in range(150)]
    docs += [(200 + k, " ".join(w + rng.choice(["$$$", "###", ""]) for w in prose(rng, 60, good).split())) for k in range(30)]
    docs += [(300 + k, prose(rng, rng.choice([40, 25_000]), good[:3]).upper()) for k in range(12)]
    docs += [(400 + k, (prose(rng, 12, good) + "!\n") * 6) for k in range(12)] + EDGES
    rows = quality.judge(table(spark, docs)).collect()
    names = [c for c in rows[0].asDict() if c.startswith("vote_")]
    v = np.array([[r[c] for c in names] for r in rows]) + 1
    first = np.array([quality.FIRST_VOTES[x] for x in (-1, 0, 1)])  # vote, bad or good
    bad, p = quality.FIRST_BAD, np.repeat(first[None], len(names), 0)
    for _ in range(quality.ROUNDS):
        logs = np.log([bad, 1 - bad]) + sum(np.log(p[k][v[:, k]]) for k in range(len(names)))
        post = np.exp(logs - logs.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        counts = np.stack([[post[v[:, k] == x].sum(0) for x in range(3)] for k in range(len(names))]) + quality.SMOOTH * first[None]
        p = counts / counts.sum(1, keepdims=True)
        bad = (post[:, 0].sum() + quality.SMOOTH * quality.FIRST_BAD) / (len(rows) + quality.SMOOTH)
    logs = np.log([bad, 1 - bad]) + sum(np.log(p[k][v[:, k]]) for k in range(len(names)))
    assert [r["p_good"] for r in rows] == pytest.approx((1 / (1 + np.exp(logs[:, 0] - logs[:, 1]))).tolist(), abs=1e-6)
    assert all(r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5) for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[300 + k]["vote_vocabulary"] == -1 and not by_id[300 + k]["kept"] for k in range(12))
    assert sum(by_id[k]["kept"] for k in range(150)) >= 130


def test_long_texts_are_measured_like_short_ones(spark):
    rng = random.Random(15)
    words = [f"v{k}" for k in range(3000)]
    rows = {r["doc_id"]: r for r in quality.measures(table(spark, [(1, prose(rng, 200, words)), (2, prose(rng, 60_000, words))])).collect()}
    assert abs(rows[1]["n_distinct"] / 200 - rows[2]["n_distinct"] / 60_000) < 0.05


def test_em_finds_the_rules_worth():
    rng = random.Random(1)
    counts = collections.Counter()
    for _ in range(4000):
        bad = rng.random() < 0.2
        counts[tuple((-1 if bad else 1) if rng.random() < a else (1 if bad else -1) for a in (0.95, 0.9, 0.55))] += 1
    prior, w = quality.estimate(sorted(counts.items()))
    assert w[0][-1] < w[1][-1] < -1 and abs(w[2][-1]) < 1 and prior > 0
    assert quality.estimate([]) [1] == []


def test_quality_runs_in_the_jvm(spark):
    plan = quality.judge(table(spark, EDGES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- decontamination


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for k, y in enumerate(b):
                row[k + 1] = old[k] + 1 if x == y else max(row[k], old[k + 1])
        return row[-1]

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert decontamination.lcs(decontamination.places(a), len(a), b) == slow(a, b)


def test_leaks(spark):
    rng = random.Random(7)
    vocabulary = [f"t{k}" for k in range(600)]
    items = [(k, prose(rng, 20 + 3 * k, vocabulary)) for k in range(12)] + [(50, None), (51, " "), (None, "x y z")]
    docs = [(k, prose(rng, rng.randint(1, 300), vocabulary)) for k in range(150)]
    planted = set()
    for k in range(24):
        words = items[k % 12][1].split()
        if k >= 12:  # reworded: one word in eight is another
            words = [w if j % 8 else "new" for j, w in enumerate(words)]
        text = prose(rng, rng.randint(0, 90), vocabulary) + " " + ", ".join(words).title() + ". " + prose(rng, rng.randint(0, 90), vocabulary)
        docs.append((200 + k, text))
        planted.add((200 + k, k % 12))
    docs += EDGES
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_leaks(table(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted and not any(r["kept"] for r in got)
    assert decontamination.find_leaks(table(spark, docs).where("false"), bench).count() == 0
    assert decontamination.find_leaks(table(spark, docs), bench.where("false")).count() == 0


def test_leaks_of_hot_items(spark):
    """Items whose words are in a third of the documents, and in all of them."""
    rng = random.Random(8)
    vocabulary, common = [f"t{k}" for k in range(600)], [f"c{k}" for k in range(30)]
    items = [(k, prose(rng, 24, vocabulary)) for k in range(4)] + [(9, " ".join(rng.sample(common, 24)))]
    docs, planted = [], set()
    for k in range(120):
        held = [0] * (k % 3 == 0) + [9] * (k % 40 == 0)
        parts = [prose(rng, 60, vocabulary), " ".join(rng.sample(common, 30))]
        for i in held:
            parts.insert(1, dict(items)[i])
            planted.add((k, i))
        docs.append((k, " ".join(parts)))
    got = decontamination.find_leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= planted and all(r["cosine"] > 0 for r in got)


def test_leaks_of_a_widely_leaked_item(spark):
    rng = random.Random(2)
    items = [(k, prose(rng, 24, [f"t{k}x{j}" for j in range(40)])) for k in (1, 2)]
    docs = [(k, prose(rng, 50, [f"u{j}" for j in range(90)])) for k in range(10)]
    docs = [(k, t + " " + dict(items)[1] if k < 3 else t + " " + dict(items)[2] if k == 9 else t) for k, t in docs]
    got = decontamination.find_leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 1), (1, 1), (2, 1), (9, 2)]


def test_recall_of_the_search(spark, sf):
    """Cosine candidates against every item everywhere, on the test data with items
    put into it whole and with up to two in five words exchanged."""
    rng = random.Random(6)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]
    vocabulary = [w for _, t in docs for w in t.split()]
    planted = []
    for k in range(300):
        words = items[k % len(items)][1].split()
        for j in rng.sample(range(len(words) - max(3, len(words) // 5)), int(0.1 * (k % 5) * len(words))):
            words[j] = rng.choice(vocabulary)
        side = rng.choice(docs)[1].split()
        at = rng.randrange(len(side) + 1)
        planted.append((10_000 + k, " ".join(side[:at] + words + side[at:])))
    frame, bench = table(spark, docs + planted), spark.createDataFrame(items, "item_id long, text string")
    every, found = ({(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame, bench, near).collect()} for near in (-2.0, decontamination.NEAR))
    assert len(every) >= 240 and found <= every and len(found) >= 0.98 * len(every)


@pytest.mark.parametrize("where", ["operator", "pipeline"])
def test_latent_space_is_of_all_documents(spark, tmp_path, monkeypatch, where):
    """The matrix that is decomposed has the cells of every document, in 4.5 million words."""
    rng = random.Random(31)
    words = [f"b{k}" for k in range(30)]
    docs = []
    for k in range(300):
        text = ["x"] * 15_000
        for at in rng.sample(range(15_000), 200):
            text[at] = rng.choice(words)
        docs.append((k, " ".join(text)))
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    seen, added = [], decontamination._added

    def spied(rows, kind):
        out = added(rows, kind)
        if kind == "<f4":
            seen.extend(out.collect())
        return out

    monkeypatch.setattr(decontamination, "_added", spied)
    if where == "operator":
        decontamination.find_leaks(table(spark, docs), bench)
    else:
        import corpus_pipeline as pipeline

        bench.write.parquet(f"{tmp_path}/benchmark.parquet")
        pipeline.drop_leaks(spark, table(spark, docs), str(tmp_path))
    got = np.concatenate([np.frombuffer(r["part"]) for r in sorted(seen, key=lambda r: r["block"])]).reshape(len(words) + 1, -1)
    number = decontamination.Items([(0, " ".join(words))]).sequences[0]
    of = dict(zip(words, number))
    df = np.bincount([n for _, t in docs for n in {of.get(w, 0) for w in t.split()}], minlength=len(words) + 1)
    weight = np.maximum(1e-3, np.log((len(docs) + 1) / np.maximum(1, df)))
    test = np.random.default_rng(11).standard_normal(got.shape) * weight[:, None]
    expected = np.zeros(got.shape)
    for _, t in docs:
        t = [of.get(w, 0) for w in t.split()]
        for at in range(0, len(t), 12):
            cell = sorted(set(t[at : at + 12]) - {0})
            if cell:
                expected[cell] += test[cell].sum(0) / (weight[cell] ** 2).sum()
    expected *= weight[:, None]
    assert np.abs(got - expected).max() <= 1e-3 * np.abs(expected).max()


@pytest.mark.parametrize("room", [1 << 22, 700])
def test_leaks_against_brute_force(spark, monkeypatch, room):
    """Items with two in five of their words exchanged, and whole ones beside runs
    of a repeated word, against the subsequences of all windows."""
    monkeypatch.setattr(decontamination, "BLOCK_CELLS", room)
    rng = random.Random(9)
    vocabulary = [f"t{k}" for k in range(400)]
    items = {k: prose(rng, rng.randint(10, 70), vocabulary).split() for k in range(20)}
    docs, planted = [], set()
    for k in range(80):
        item = items[k % 20]
        held = list(item)
        if k % 2:
            inner = len(item) - max(3, round(0.2 * len(item)))
            for j in rng.sample(range(inner), min(inner, int(0.4 * len(item)))):
                held[j] = "new"
            side = [prose(rng, rng.randint(0, 400), vocabulary).split() for _ in range(2)]
        else:
            side = [[rng.choice(vocabulary)] * rng.randint(0, 60) for _ in range(2)]
        docs.append((k, " ".join(side[0] + held + side[1])))
        planted.add((k, k % 20))
    docs += EDGES
    expected = set()
    for width, low, high in ((2, 0, 30), (4, 30, 999)):
        chosen = {k: w for k, w in items.items() if low < len(w) <= high}
        reach = max(map(len, chosen.values()))
        for i, text in docs:
            words = (text or "").split()
            for at in range(0, len(words), 12):
                window = words[max(0, at - reach) : at + 12 * width + reach]
                for k, w in chosen.items():
                    end = w[-max(3, round(0.2 * len(w))) :]
                    share, answer = (decontamination.lcs(decontamination.places(x), len(x), window) / len(x) for x in (w, end))
                    if share >= 0.9 or share >= 0.6 and answer >= 0.5:
                        expected.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = decontamination.find_leaks(table(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected >= planted


# -- toxicity


def test_toxicity(spark):
    rng = random.Random(3)
    clean = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(500):
        toxic = k % 6 == 0
        words = prose(rng, rng.randint(20, 120), clean).split()
        if toxic:
            for w in rng.sample(["idiot", "moron", "schlimmaber", "schlimmoder", "schlimmund"], 2):
                words.insert(rng.randrange(len(words)), w)
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    held_out = {k for k in range(500) if k % 5 == 0}
    known = spark.createDataFrame([(k, t) for k, t in labels if k not in held_out] + [(None, 1), (3, None), (7777, 1)], "doc_id long, toxic int")
    frame = table(spark, docs + EDGES)
    chain = toxicity.fit(frame, known)
    rows = {r["doc_id"]: r for r in toxicity.score(frame, chain).collect()}
    right = sum(rows[k]["toxic"] == bool(t) for k, t in labels if k in held_out)
    assert right / len(held_out) > 0.97
    assert all(rows[i]["kept"] for i, _ in EDGES)
    assert all(0 <= rows[k][f"p_{c}"] <= 1 for k in rows for c in toxicity.CATEGORIES)
    left = toxicity.without_toxic(frame, chain)
    assert left.columns == frame.columns and left.count() == sum(r["kept"] for r in rows.values())
    assert toxicity.score(frame.where("false"), chain).count() == 0
    nothing = toxicity.fit(frame, known.where("false"))
    assert toxicity.score(frame, nothing).where("toxic").count() == 0


def test_training_shares_words():
    """What the driver holds to train follows the vocabulary, not all rows' words."""
    rng = random.Random(7)
    vocabulary = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}" for k in range(1000)]
    values = [" ".join(rng.sample(vocabulary, 300)) + (" idiot moron" if k % 5 == 0 else "") for k in range(500)]
    y = np.array([int(k % 5 == 0) for k in range(500)])
    tracemalloc.start()
    toxicity.train(values, [y])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8e6


def test_no_held_out_row_touches_selection():
    """Other labels and texts in one fold change no table, weight or probability that
    is to be out of that fold."""
    rng = random.Random(5)
    values = [prose(rng, 30, [f"w{k}" for k in range(200)]) + (" idiotic moron" if k % 4 == 0 else "") for k in range(400)]
    y, fold = np.array([int(k % 4 == 0) for k in range(400)]), toxicity.folds(values)
    rows = [toxicity.read(v) for v in values]
    other_rows, other_y = list(rows), y.copy()
    for r in np.flatnonzero(fold == 1):
        other_rows[r] = (rows[r][0] | {"madeup", "w1"}, rows[r][1])
        other_y[r] = 1 - y[r]
    one, two = toxicity.Training(rows, fold, y), toxicity.Training(other_rows, fold, other_y)
    assert one.lifts(frozenset([1])) == two.lifts(frozenset([1])) and one.lifts() != two.lifts()
    earlier = np.zeros((400, 0))
    own = np.flatnonzero(fold == 1)
    assert len(own) > 50 and (fold == toxicity.folds(values)).all()
    # The fold's own rows are asked with their unchanged texts.
    two.words, two.signs, two.sizes = one.words, one.signs, one.sizes
    assert np.allclose(one.unseen(earlier)[own], two.unseen(earlier)[own], atol=1e-9)
    assert not np.allclose(one.unseen(earlier)[fold == 2], two.unseen(earlier)[fold == 2], atol=1e-9)


def test_junk_comes_before_toxic(spark):
    rng = random.Random(6)
    docs = [(k, prose(rng, 40, [f"w{j}" for j in range(90)]) + " $$$ ###" * 30 * (k % 5 == 0) + " idiot" * (k % 3 == 0)) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 5 > 0), int(k % 3 == 0)) for k in range(300)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(table(spark, docs), labels)
    rows = {r["doc_id"]: r for r in toxicity.score(table(spark, docs), chain).collect()}
    assert sum((rows[k]["p_junk"] >= 0.5) == (k % 5 == 0) for k in range(300)) >= 295
    assert sum(rows[k]["toxic"] == (k % 3 == 0) for k in range(300)) >= 295
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1


# -- repeated substrings


def test_transform_against_counting():
    rng = random.Random(1)
    for _ in range(150):
        least, letters = rng.choice([1, 2, 3, 5, 8, 9, 17]), rng.choice([1, 2, 4])
        parts = [bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 5))]
        data = b"\xff".join(parts + [parts[0][3:40]]) + b"\xff"
        seen = collections.Counter(data[i : i + least] for i in range(len(data) - least + 1))
        got = bwt.repeated(np.frombuffer(data, np.uint8), least)
        for i in range(len(data) - least + 1):
            w = data[i : i + least]
            if b"\xff" not in w:
                assert got[i] == (seen[w] > 1)


@pytest.mark.parametrize("batch", [1 << 22, 700])
def test_substrings(spark, monkeypatch, batch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", batch)
    monkeypatch.setattr(substring_dedup, "GRAM", 8)
    least = 40
    rng = random.Random(batch)
    shared = [prose(rng, 40) for _ in range(3)]
    docs = []
    for k in range(60):
        text = prose(rng, rng.randint(0, 40), [f"é{j}" for j in range(500)])
        if k % 3 == 0:
            text += shared[k % 2][rng.randint(0, 9) :] + prose(rng, 5)
        docs.append((k, text))
    docs += [(100, docs[0][1]), (101, docs[0][1]), (102, "ab" * 90), (103, shared[2] + "|" + shared[2]), *EDGES]
    frame = table(spark, docs)
    windows = collections.Counter()
    for _, t in docs:
        raw = (t or "").encode()
        windows.update(raw[i : i + least] for i in range(len(raw) - least + 1))
    rows = substring_dedup.digest(substring_dedup.remove_repeats(frame, least)).collect()
    expected = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - least + 1):
            if windows[raw[k : k + least]] > 1:
                gone[k : k + least] = True
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        expected.append((i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest(), 0))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    carried = substring_dedup.remove_repeats(frame, least, keep=("lows", "text_key"), as_text=True)
    assert carried.where("carried.lows = 2 AND carried.text_key = 'k'").count() == len(docs)
    assert substring_dedup.remove_repeats(frame.where("false"), least).count() == 0


def test_shared_anchors(spark):
    """Texts that share 51 words are told of, and those that share no 12 are not."""
    rng = random.Random(41)
    words = [f"w{k}" for k in range(30_000)]
    shared = [prose(rng, n, words) for n in (51, 51, 60, 80)]
    docs = [(k, prose(rng, rng.randint(0, 200), words)) for k in range(40)]
    docs += [(100 + k, f"{prose(rng, rng.randint(0, 90), words)} {shared[k % 4]}\n{prose(rng, rng.randint(0, 90), words)}") for k in range(12)]
    docs += [(200, prose(rng, 51, ["a"])), (201, prose(rng, 70, words)), (202, " ".join([prose(rng, 60, words)] * 2))]
    docs += [(300, docs[3][1]), (301, docs[3][1])] + EDGES
    rows = {r["doc_id"]: r["n_shared_anchors"] for r in substring_dedup.digest(substring_dedup.remove_repeats(table(spark, docs), 400, marks=51)).collect()}
    texts, seen, grams = dict(docs), collections.Counter(), collections.Counter()
    for t in (t for _, t in docs if t):
        w = t.split()
        seen.update(tuple(w[k : k + 51]) for k in range(len(w) - 50))
        grams.update(tuple(w[k : k + 12]) for k in range(len(w) - 11))
    for i, t in docs:
        w = (t or "").split()
        if any(seen[tuple(w[k : k + 51])] > 1 for k in range(len(w) - 50)):
            assert rows[i] > 0, i
        if not any(grams[tuple(w[k : k + 12])] > 1 for k in range(len(w) - 11)):
            assert rows[i] == 0, i
    assert all(rows[100 + k] for k in range(12)) and sum(rows[k] > 0 for k in range(40)) <= 1 + (len(texts[3].split()) > 50) and rows[201] == 0 and rows[202] > 0


def test_short_words_that_repeat(spark):
    """Passages of 51 words of few bytes, in the pipeline's stage."""
    import corpus_pipeline as pipeline

    rng = random.Random(5)
    letters = [chr(97 + k) for k in range(26)]
    short, fifty, inner = prose(rng, 51, letters), prose(rng, 50, letters), prose(rng, 55, letters)
    side = iter([prose(rng, 30, [f"w{j}" for j in range(9000)]) for _ in range(20)])
    texts = {}
    for k, passage in enumerate((short, short, fifty, fifty, inner, inner)):
        texts[k] = (next(side), passage, next(side))
    rows = [(k, " ".join(x)) for k, x in texts.items()] + [(10, f"{inner}\n{next(side)}"), *EDGES]
    got = {r["doc_id"]: r["text"] for r in pipeline.cut_repeats(spark, table(spark, rows), "").collect()}
    for k, (a, passage, b) in texts.items():
        assert got[k] == (f"{a} {passage} {b}" if passage == fifty else f"{a}  {b}")
    assert got[10] == rows[6][1][len(inner) :] and got[905] == ""


# -- language model


@pytest.mark.parametrize("order,chunk", [(3, 400), (2, 1 << 20), (1, 100)])
def test_scores(spark, order, chunk):
    rng = random.Random(order)
    docs = [(k, prose(rng, rng.randint(0, 50)).title()) for k in range(60)] + [(70, "ab"), (71, "ab")] + EDGES
    words = [((t or "").encode().lower().split()) for _, t in docs]
    counts = [collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in range(1, order + 1)]
    total, expected = sum(map(len, words)), []

    def scored(w, own, whole):
        s = 0.0
        for k in range(len(w)):
            factor = 1.0
            for n in range(min(order - 1, k), -1, -1):
                gram = tuple(w[k - n : k + 1])
                many = counts[n][gram] - own[n][gram]
                if n == 0:
                    s += math.log10(factor * max(many, lm_scores.UNSEEN) / whole)
                elif many > 0:
                    s += math.log10(factor * many / (counts[n - 1][gram[:-1]] - own[n - 1][gram[:-1]]))
                    break
                factor *= lm_scores.BACKOFF
        return s

    none = [collections.Counter()] * order
    for (i, _), w in zip(docs, words):
        own = [collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in range(1, order + 1)]
        held_out = scored(w, own, max(1, total - len(w))) / len(w) if w else 0
        expected.append((str(i), len(w), round(scored(w, none, total), 4), round(held_out, 4)))
    got = lm_scores.score(table(spark, docs), order, chunk_bytes=chunk, part_bytes=chunk).collect()
    found = sorted((str(r["doc_id"]), r["n_words"], r["log_score"], r["held_out_score"] or 0) for r in got)
    assert [x[:2] for x in found] == [x[:2] for x in sorted(expected)]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in sorted(expected)], abs=1e-4)
    assert [x[3] for x in found] == pytest.approx([x[3] for x in sorted(expected)], abs=2e-4)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)
    assert lm_scores.score(table(spark, docs).where("false"), order).count() == 0


def test_scores_of_the_query_hold_single_ngrams(spark, tmp_path):
    from lexigrid.llm import queries

    spark.createDataFrame([(1, "a b c"), (2, "a d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in queries.op9_lm_scores(spark, str(tmp_path)).collect()}
    # a: 2 of 5 words; a b: 1 of 2; a b c: 1 of 1; a d: 1 of 2.
    assert got == pytest.approx({1: math.log10(2 / 5 / 2), 2: math.log10(2 / 5 / 2)}, abs=1e-5)


# -- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>{0} &amp; more</h1><p><b>{1}<br>tail</b><p class="x > y">Sh&eacute;&nbsp;two</p><form><p>Your mail</p></form>
<div id="comments"><p>nice one, really a nice one</p></div><p>1 &lt; 2 &amp;am</p></article><footer>&copy; us</footer></body></html>"""


def test_pages(spark):
    body = "long text " * 30
    rows = [(k, f"u{k}", PAGE.format(f"Head {k}", body), "x") for k in range(5)] + [
        (10, None, None, "x"), (None, "u", "", "x"), (11, "u", "<p>", "x"), (11, "u", "<", "x"), (12, "u", "<article>" + "<p>a</p>" * 5000, "x"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] is not None and r["page_id"] < 5:
            want = [f"Head {r['page_id']} & more", " ".join((body + "tail").split()), "Shé two", "1 < 2 &am"]
            assert r["text"] == "\n".join(want)
    assert next(r["text"] for r in got if r["page_id"] == 12) == "\n".join(["a"] * 5000)
    assert html_text.extract(frame.where("false")).count() == 0


def test_pages_without_article():
    long = "real words of a story that goes on for quite a while, as stories do, until it ends. " * 3
    page = f"<body><div id=menu><a href=x>a</a></div><h2>A title</h2><p>{long}</p><p>{long}</p><p><a href=y>next page</a></p><div class='site-footer'>bye</div></body>"
    assert html_text.main_text(page) == "\n".join(["A title", " ".join(long.split()), " ".join(long.split())])


def test_test_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in rows:
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    "before,after",
    [
        ('<body class="no-sidebar"><article>', "</article></body>"),
        ('<html class="ads"><body class="single comments-open"><main id="search"><p></p>', "</main></body></html>"),
        ('<div class="page with-sidebar"><div id="widget"><article>', "</article></div></div>"),
        ('<main><div class="with-sidebar"><article class="has-related">', "</article></div></main>"),
        ('<body class="no-sidebar">', "</body>"),
    ],
)
def test_hints_of_wrappers(before, after):
    long = " ".join(["real words of a story that goes on for quite a while, as stories do, until it ends."] * 3)
    inner = f"<p>{long}</p><div class=ad>buy</div><p>{long}</p>"
    outer = '<div id="comments"><article><p>nice one</p></article></div><div class="sidebar">bye</div>'
    assert html_text.main_text(before + inner + after.replace("</article>", "</article>" + outer, 1)) == f"{long}\n{long}"


@pytest.mark.parametrize(
    "tag",
    [
        '<svg width="1" data-x="a>b"/>', "<math />", "<video-player src=x></video-player>", "<button-group></button-group>",
        "<SVG/><svg><text>no</text></svg >", "<button>", "<select><iframe src='x'>", "<Script>no</p></script x><STYLE>no</style>", "</video>",
    ],
)
def test_silent_elements(tag):
    texts = html_text.main_text(f"<article><p>one</p>{tag}<p>two</p><p>three {tag} four</p></article>").split("\n")
    assert texts == ["one", "two", "three four"]
    assert html_text.main_text("<article><p>one</p><script>two</article>") == "one"


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><p>Body words here.</p><p class="cookie-notice">We use cookies.</p><span class="ad">Buy now</span>', "Body words here."),
        ('<article><p>One.</p><div class="share-price"><p>Share prices rose.</p></div></article>', "One.\nShare prices rose."),
        ('<div class="social-sciences"><article><p>Body words</p></article></div>', "Body words"),
        ('<form id="aspnetForm"><nav><a href=x>a</a></nav><article><p>Body words</p></article></form>', "Body words"),
        ('<article><p>Hello <span class="ad">x <span>y</span> z</span> world</p></article>', "Hello world"),
        ('<article><p>One <b class="siteFooter">x<p>y</b></p><p>two</p></article>', "One\ntwo"),
        ('<div id="aspnetForm"><form><p>' + "many words of it " * 20 + "</p></form></div>", " ".join(["many words of it"] * 20)),
        ('<article><p>' + "a b c " * 9 + '</p></article><div id="comments"><article class="comment"><p>' + "d e f " * 12 + "</p></article></div>", " ".join(["a b c"] * 9)),
    ],
)
def test_marks_of_blocks(page, text):
    assert html_text.main_text(page) == text


def test_words_and_links_decide():
    """The tree is fitted to its labelled table; other word counts or link densities
    give other verdicts."""
    table_ = html_text.labelled()
    x, y = table_[:, :-1], table_[:, -1] > 0
    tree = html_text.default_tree()
    assert (html_text.classify(tree, x) == y).mean() >= 0.99
    for columns in ([0], [1], [0, 2, 4], [1, 3, 5]):
        changed = x.copy()
        changed[:, columns] = np.random.default_rng(3).permutation(x[:, columns])
        assert (html_text.classify(tree, changed) != y).sum() >= 3
    menu = "".join(f"<p><a href=x>{w}</a></p>" for w in ("one", "two", "three"))
    story = "<p>" + "words of a story " * 30 + "</p>"
    assert html_text.main_text(f"<body>{menu}{story}{story}{menu}</body>").count("\n") == 1
    assert html_text.main_text(f"<body>{menu}{menu}</body>") == ""


# -- pipeline


def test_stages_judge_rows(spark, sf, tmp_path):
    """Rows that share an id, or have none, with texts that do not share a fate."""
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    a, b, c = (prose(rng, 80, words) for _ in range(3))
    item = prose(rng, 30, [f"t{k}" for k in range(400)])
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (None, c), (4, None), (4, None), (5, ""), (None, None)]
    frame = table(spark, rows).withColumn("key", F.lit("own"))
    left = pipeline.drop_near_duplicates(spark, frame, "")
    assert left.columns == frame.columns
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(
        f"Row(doc_id={i}, text={t!r})" for i, t in [(1, a), (2, b), (3, c), (None, c), (4, None), (4, None), (5, ""), (None, None)]
    )
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, a), (1, b + " " + item), (None, item + " " + c), (None, b), (2, None), (3, item), (3, item)]
    left = pipeline.drop_leaks(spark, table(spark, rows), str(tmp_path))
    assert sorted(map(str, left.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(1, a), (None, b), (2, None)])
    for stage in (pipeline.drop_near_duplicates, pipeline.cut_repeats, pipeline.drop_leaks):
        assert stage(spark, table(spark, rows).where("false"), str(tmp_path)).count() == 0
    assert pipeline.pack(spark, table(spark, rows).where("false"), "").count() == 0
    # Each of a text of 200 kilobytes with two different ids: one document stays.
    long = prose(rng, 40_000, words)
    assert pipeline.drop_near_duplicates(spark, table(spark, [(8, long), (9, long + " more")]), "").count() == 1


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit("mine"))
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(10_001).cast("long")))
    docs = docs.unionByName(docs.where("doc_id = 2").withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10_002).cast("long")))
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    assert docs.where("doc_id = 10001").count() == 0 and docs.where("doc_id = 10002").count() == 1
    pieces = pipeline.pack(spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    rows = pipeline.run(spark, sf)
    assert rows.count() > 0


def test_sums_of_runs_of_passages():
    from lexigrid.llm.decontamination import RUN, run_sums

    rng = np.random.default_rng(5)
    sizes = np.array([1, RUN, RUN + 1, 3, RUN * RUN * 2 + 5, 2, RUN * 2])
    matrix, at = rng.integers(-9, 9, (50, 6)).astype(np.float32), rng.integers(0, 50, sizes.sum())
    want = [matrix[part].sum(0) for part in np.split(at, np.cumsum(sizes)[:-1])]
    assert run_sums(matrix, at, np.cumsum(sizes) - sizes).tolist() == np.array(want).tolist()
    assert run_sums(matrix, at[:0], np.zeros(0, np.int64)).shape == (0, 6)

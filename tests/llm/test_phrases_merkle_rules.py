"""Phrase mining, Merkle manifest and rule ensemble against brute force, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import merkle, phrases, rules
from wearline.session import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def ready(spark):
    ship_package(spark)
    return spark


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Ünder", "x y", "THE"]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words[: 6 + i % 28]) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randrange(1, 60)))
        if i % 3 == 0:
            text += "\tnew  york City hall\nnew york city hall;new york"
        rows.append((i, text, [None, "en", "de", "und"][i % 4], "s", len(text)))
    rows += [rows[3], rows[3], (900, None, "en", "s", None), (901, "", "xx", None, 0), (None, " .;\n", None, None, 4)]
    rows.append((902, "a b " * 200_000 + "\n" + "c " * 1000, "long", "s", 802_001))
    return rows


def counts(rows, longest=4):
    """{(lang, phrase): n} by slicing lists of words, and words per language."""
    found, total = Counter(), Counter()
    for _, text, lang, _, _ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                found.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return found, total


def best_phrases(rows, min_count, keep):
    found, total = counts(rows)
    candidates = {key: n for key, n in found.items() if n >= min_count and " " in key[1]}
    scored = {}
    for (lang, phrase), a in candidates.items():
        w = phrase.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = found[lang, " ".join(w[:k])], found[lang, " ".join(w[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        scored[lang, phrase] = (a, *min(cuts))
    for (lang, longer), n in candidates.items():
        w = longer.split(" ")
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inner = (lang, " ".join(w[i : i + size]))
                if inner in scored and 100 * n >= 80 * candidates[inner]:
                    del scored[inner]
    out = []
    for lang in {key[0] for key in scored}:
        own = sorted(((-s, -a, p.encode(), p, a, left, right, s) for (g, p), (a, s, _, left, right) in scored.items() if g == lang))
        out += [(lang, r + 1, p, a, left, right, total[lang], s) for r, (*_, p, a, left, right, s) in enumerate(own[:keep])]
    return sorted(out)


@pytest.mark.parametrize("sample, sample_count", [(2, 2), (4, 50), (1, 1)])
def test_phrases_equal_brute_force_whatever_the_sample_proposes(ready, sample, sample_count):
    rows = corpus()
    docs = ready.createDataFrame(rows, DOCS).withColumn("Phrase", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    got = phrases.collocations(docs, min_count=5, keep=40, sample=sample, sample_count=sample_count)
    assert sorted(tuple(r) for r in got.collect()) == best_phrases(rows, 5, 40)


def test_frequent_phrases_are_all_of_them(ready):
    rows = corpus()
    found, total = counts(rows)
    got = phrases.frequent_phrases(ready.createDataFrame(rows, DOCS), min_count=4, sample=4, sample_count=3).collect()
    assert {(r.lang, r.phrase): r.n for r in got if r.k} == {k: n for k, n in found.items() if n >= 4}
    assert {r.lang: r.n for r in got if not r.k} == {k: n for k, n in total.items() if n}


def test_long_documents_are_cut_only_behind_the_end_of_a_piece():
    text = b"one two three. " * 500
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 20, len(text)])
    parts = list(phrases._cut_long(data, offsets, most=1000))
    assert b"".join(bytes(p) for p, _, _ in parts) == text
    assert all(bytes(p).endswith(b".") for p, _, _ in parts[1:-1])


# Merkle manifest -------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + add, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    return [(level[at >> d ^ 1], (at >> d) & 1) if (at >> d ^ 1) < len(level) else None for d, level in enumerate(tree[:-1])]


def folded(digest, path):
    for step in path:
        digest = sha(digest) if step is None else sha(step[0], digest) if step[1] else sha(digest, step[0])
    return digest


def proofs(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees, sorted_rows = {}, {}
    for lang in order:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang], sorted_rows[lang] = levels([leaf(r) for r in own]), own
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for t, lang in enumerate(order):
        for i, row in enumerate(sorted_rows[lang]):
            path = siblings(trees[lang], i) + siblings(top, t)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            root = folded(leaf(row, 1 if hit else 0), path)
            out.append((row[0], leaf(row), trees[lang][-1][0], top[-1][0], sha(*[s[0] for s in path if s]), root, root == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(langs, n):
    rng = random.Random(n)
    rows = [(i, "täxt " * rng.randrange(4), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(n)]
    return rows + [rows[0], rows[0], (None, None, None, None, None), (None, "x" * 300_000, None, "", 3)]


@pytest.mark.parametrize("height", [2, 3, 12])
def test_proofs_equal_brute_force_over_tiers_of_blocks(ready, height):
    rows = manifest_rows([None, "", "en", "Z", "é", *[f"l{i}" for i in range(9)]], 150) + [(10_000 + i, "t", "en", "s", 1) for i in range(70)]
    docs = ready.createDataFrame(rows, DOCS).withColumn("tree", F.lit("clash")).withColumn("Pos", F.lit(0)).repartition(3)
    made = merkle.build(docs, height=height, also={"tampered": merkle.tampered_by_one(7)})
    assert sorted((tuple(r) for r in merkle.verify(made, "tampered").collect()), key=str) == proofs(rows)
    assert merkle.verify(made).where(~F.col("verified")).isEmpty()


def test_one_row_and_no_row(ready):
    rows = [(7, "only", "en", "s", 4)]
    made = merkle.build(ready.createDataFrame(rows, DOCS))
    (got,) = merkle.verify(made).collect()
    assert got.leaf == got.subroot == got.root == leaf(rows[0]) and got.proof_sha256 == sha()
    assert merkle.verify(merkle.build(ready.createDataFrame([], DOCS))).count() == 0


def test_layout_is_a_permutation_that_splits_at_half_height():
    for levels_ in range(1, 9):
        places = [int(merkle.address(levels_, d, i)) for d in range(levels_) for i in range(1 << d)]
        assert sorted(places) == list(range((1 << levels_) - 1))
    # four levels: the upper two, then each lower subtree in one run
    assert [int(merkle.address(4, d, 0)) for d in range(4)] == [0, 1, 3, 4]
    bottom = [sorted(int(merkle.address(4, 2 + d, (s << d) + i)) for d in range(2) for i in range(1 << d)) for s in range(4)]
    assert bottom == [[3, 4, 5], [6, 7, 8], [9, 10, 11], [12, 13, 14]]
    assert all(b - a == 3 for a, b in pairwise(x[0] for x in bottom))


# Rule ensemble ---------------------------------------------------------------

def labelled(spark, n=600):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) + str(rng.randrange(99)) for _ in range(rng.randrange(5, 80))]
        text = " ".join(w if good else w.upper() + "###" for w in words)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"), docs


def statistics_of(text):
    text = text or ""
    size = len(text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    ratio = lambda a, b: a / b if b else 0.0
    share = lambda chars: ratio(sum(c in chars for c in text), size)
    values = [
        np.log1p(size), share("#*$%&|<>{}[]\\^~=_+@"), share("!?"), share(".,;:"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"),
        share(" \t\r"), share("\n"), ratio(len(text.encode()) - size, size), float(len(words)), ratio(size, len(words)),
        ratio(len(set(words)), len(words)), ratio(len(set(lines)), len(lines)), ratio(size, len(lines))]
    return dict(zip(rules.NAMES, values, strict=True))


def probability(model, text):
    s = statistics_of(text)
    total = model.intercept + sum(w for rule, w in model.rules if all((s[n] > t) if above else (s[n] <= t) for n, above, t in rule))
    return 1 / (1 + np.exp(-total))


def test_rules_separate_held_out_texts_and_compile_to_what_they_say(ready):
    docs, labels, rows = labelled(ready)
    model = rules.train(docs, labels.where("doc_id % 5 <> 0"))
    assert 0 < len(model.rules) <= 60 and model.describe()
    odd = [(9000, None, None, None, None), (9001, "", "", "", 0), (9002, "ß " * 100_000, "de", "s", 1), (9003, "\n\n \n", "en", "s", 4), rows[0], rows[0]]
    every = docs.unionByName(ready.createDataFrame(odd, DOCS)).withColumn("Score", F.lit(5)).withColumn("label", F.lit("x")).withColumn("words", F.lit(1))
    got = rules.score(every, model).collect()
    assert len(got) == len(rows) + len(odd)
    texts = {r[0]: r[1] for r in [*rows, *odd]}
    assert max(abs(r.score - probability(model, texts[r.doc_id])) for r in got) < 1e-9
    held = [(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in got if r.doc_id < 600 and r.doc_id % 5 == 0]
    assert sum(held) >= 0.95 * len(held)


def test_labels_of_one_kind_or_none(ready):
    docs, labels, _ = labelled(ready, 30)
    assert rules.train(docs, labels.where("false")).rules == ()
    only = rules.train(docs, labels.where("quality = 1"))
    assert {r.score > 0.99 for r in rules.score(docs, only).collect()} == {True}
    missing = labels.withColumn("quality", F.lit(None).cast("int"))
    assert [r.score for r in rules.score(docs.limit(1), rules.train(docs, missing)).collect()] == [0.5]
    model = rules.train(docs.limit(0), labels)
    assert rules.score(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded_and_does_not_depend_on_partitions(ready):
    docs, labels, _ = labelled(ready, 300)
    one = rules.train(docs.coalesce(1), labels, most=150, trees=10)
    many = rules.train(docs.repartition(7), labels.repartition(5), most=150, trees=10)
    assert one == many

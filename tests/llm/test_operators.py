"""Operators against brute force, on small fixtures with edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import (
    decontaminate,
    langid,
    linedup,
    neardup,
    packing,
    quality,
    sharding,
    substring,
    toxicity,
    warc,
)
from wearline.llm.bwt import repeated_windows
from wearline.session import scratch_path, ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def ready(spark):
    ship_package(spark)
    return spark


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, texts, **columns):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


def edge_texts():
    rng = random.Random(5)
    base = " ".join(words(rng, 300))
    lines = "\n".join(" ".join(words(rng, 9)) for _ in range(12))
    return [
        None, "", " \n\t ", "one", "Größe übermäßig ñandú", base, base, base.upper(), " ".join(words(rng, 5000)),
        lines, lines + "\nnew last line", "first\n" + lines, "a\n\n\nb\n\n\nc", "x " * 400, lines,
    ]


def test_empty_table_gives_empty_results(ready):
    none = ready.createDataFrame([], DOCS)
    bench = ready.createDataFrame([], "item_id long, text string")
    pages = ready.createDataFrame([], "page_id long, url string, html string")
    import public_tokenizers as P

    assert warc.archive_round_trip(pages, ready).count() == 0
    model = toxicity.train(none, ready.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(none, model).count() == 0
    assert linedup.remove_repeated_lines(none).count() == 0
    assert packing.pack(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert langid.identify(none, langid.train(none)).count() == 0
    assert quality.assess(none).count() == 0 and quality.clean(none).count() == 0
    assert substring.remove_repeated(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert neardup.link_components(none).count() == 0 and neardup.keep_one(none).count() == 0
    assert sharding.shard(none).count() == 0


def test_warc_round_trip_and_selective_reads(ready):
    body = "<html>" + "é" * 100
    pages = ready.createDataFrame(
        [(1, "http://a/ b\r\n", body), (2, None, body), (3, "http://c", None), (4, "http://d", "short"), (5, "u", "short"), (None, "n", body), (1, "again", body)],
        "page_id long, url string, html string",
    ).withColumn("offset", F.lit(7)).repartition(3)
    folder = scratch_path(ready, "warc-test-" + hashlib.sha1(str(random.random()).encode()).hexdigest())
    index = warc.write_archives(pages, folder)
    rows = warc.read_records(index, folder).collect()
    assert len(rows) == 7
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert kinds == {(1, "response", None): 2, (2, "revisit", 1): 1, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (None, "response", None): 1}
    for r in rows:
        full = {1: body, 2: body, 3: "", 4: "short", 5: "short", None: body}[r.page_id].encode()
        assert r.payload_bytes == len(full) and r.payload_digest == hashlib.sha256(full).hexdigest()
        assert (bytes(r.payload) == full) if r.record_type == "response" else r.payload is None
    some = warc.read_records(index.where("page_id = 4"), folder).collect()
    assert [bytes(r.payload) for r in some] == [b"short"]
    assert {r.url for r in rows if r.page_id == 2} == {None}


def brute_line_dedup(texts):
    seen, out = set(), []
    for text in texts:
        lines = (text or "").split("\n") if text is not None else []
        at = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for k in range(len(at) - 2):
            window = tuple(lines[i].strip(" ") for i in at[k : k + 3])
            if window in seen:
                gone.update(at[k : k + 3])
            seen.add(window)
        out.append((len(gone), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup_matches_brute_force(ready):
    texts = edge_texts()
    got = {r.doc_id: (r.n_removed_lines, r.text) for r in linedup.remove_repeated_lines(documents(ready, texts).withColumn("_k1", F.lit("x"))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_line_dedup(texts)


def test_line_dedup_repeated_rows_and_null_id(ready):
    text = "a1\nb2\nc3"
    df = ready.createDataFrame([(None, text), (3, text), (3, text), (4, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in linedup.remove_repeated_lines(df).collect())
    assert got == [("3", text), ("3", text), ("4", ""), ("None", "")]


def test_packing_is_gapless_and_tokens_match(ready):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = [*edge_texts(), "double  space\t tab", "tail ", " head", "<|endoftext|> x", " nbsp em", "é" * 3000]
    df = documents(ready, texts)
    rows = packing.pack(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    for i, whole in ids.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum((np.frombuffer(r.ids, "<u4").tolist() for r in own), []) == whole
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in own) and all(r.length == 2048 for r in own[1:])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(len(x) for x in ids.values()) // 2048)


def test_local_search_empties_bins_that_best_fit_leaves():
    capacity, rng = 100, random.Random(1)
    for _ in range(20):
        histogram = Counter(rng.randrange(15, 60) for _ in range(60))
        first = packing.best_fit(histogram, capacity)
        second = packing.local_search(first, capacity)
        for bins in (first, second):
            assert sum((Counter({x: c.count(x) * n for x in set(c)}) for c, n in bins), Counter()) == histogram
            assert all(sum(c) <= capacity for c, _ in bins)
        assert sum(n for _, n in second) <= sum(n for _, n in first)
    # 6+4, 6+4, 5+5 in place of best fit's four bins
    assert sum(n for _, n in packing.local_search([((6,), 1), ((6, 4), 1), ((5, 4), 1), ((5,), 1)], 10)) == 3


def test_viterbi_matches_exhaustive_paths():
    rng = np.random.default_rng(0)
    s = rng.normal(size=(40, 3)).astype(np.float32) * 3
    count = np.array([5, 0, 7, 6, 1, 7, 7, 7])
    doc = np.repeat(np.arange(len(count)), count)
    got, at = langid.viterbi(s, doc, count, 2.0), 0
    import itertools

    for n in count.tolist():
        own = s[at : at + n].astype(float)
        value = lambda p, own=own: sum(own[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        if n:
            best = max(value(p) for p in itertools.product(range(3), repeat=n))
            assert value(got[at : at + n].tolist()) == pytest.approx(best)
        at += n


def test_language_spans_scripts_and_held_out_accuracy(ready):
    rng = random.Random(3)
    lexicon = {"en": "the of and to with house water".split(), "de": "der und nicht straße schön wasser haus".split(), "ru": "дом вода улица и не красивый".split()}
    text = lambda lang, n: " ".join(rng.choice(lexicon[lang]) for _ in range(n))
    train = ready.createDataFrame([(i, text(lang, 40), lang) for i, lang in enumerate(["en", "de", "ru"] * 20)], "doc_id long, text string, lang string")
    model = langid.train(train)
    tests = [text("en", 30), text("de", 30), text("ru", 30), text("en", 40) + " " + text("ru", 15), None, "123 !?", "日本語"]
    got = {r.doc_id: r for r in langid.identify(documents(ready, tests), model).collect()}
    assert [got[i].lang_pred for i in range(7)][:6] == ["en", "de", "ru", "en", "und", "und"]
    assert [(x.start, x.end, x.lang) for x in got[3].spans] == [(0, 40, "en"), (40, 55, "ru")]
    assert got[4].score == 0.0 and got[6].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())


def test_contamination_of_repeated_rows_hot_passages_and_items_without_id(ready):
    import duckdb

    from wearline.llm.sql import ORACLES

    rng = random.Random(16)
    hot, rare, short, unnamed = (" ".join(words(rng, n)) for n in (30, 13, 4, 14))
    bench = [(1, hot), (2, hot), (None, rare), (None, hot), (None, unnamed), (3, short), (4, f"{rare} {short}"), (5, None)]
    texts = [f"{' '.join(words(rng, 40))} {hot[rng.randrange(60):]}" for _ in range(200)]
    texts += [rare, rare.rsplit(" ", 1)[0], f"{short} and {short}", " ".join([short] * 3000), f"{rare} {rare}", hot + " x " + hot, unnamed]
    rows = list(enumerate(texts)) + [(7, texts[7])] * 300 + [(None, hot), (None, hot), (900, None)]
    df = ready.createDataFrame(rows, "doc_id long, text string")
    items = ready.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contamination(df, items)
    assert found.count() == len(rows)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.where("doc_id IS NOT NULL").collect()}
    assert got[200][1:] == (13, ["4"]) and got[201][1] == 0 and got[206] == (14, 14, [])
    con = duckdb.connect()
    con.register("documents", ready.createDataFrame(sorted({r for r in rows if r[0] is not None}), df.schema).toPandas())
    con.register("benchmark", items.toPandas().astype({"item_id": "Int64"}))
    want = con.sql(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256 FROM ({ORACLES['op8_decontaminate']})").fetchall()
    sha = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    assert {i: (w, h, len(n), sha(n)) for i, (w, h, n) in got.items()} == {r[0]: r[1:] for r in want}
    kept = decontaminate.remove_contaminated(df, items).collect()
    assert not any(r.text == hot or r.text == rare for r in kept) and sum(r.doc_id == 900 for r in kept) == 1


def test_quality_removes_boilerplate_and_rejects_depleted(ready):
    rng = random.Random(2)
    body = lambda: " ".join(words(rng, 60))
    texts = [f"{body()}\nShared  FOOTER line of this host {i % 2 * ' '}" for i in range(12)] + ["shared footer line of this host\nrest " + "q" * i for i in range(3)]
    df = ready.createDataFrame([(i, t, "h", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, extra string")
    limits = {"min_documents": 5, "min_share": 0.5}
    verdict = {r.doc_id: r for r in quality.assess(df, **limits).collect()}
    assert all(verdict[i].kept and verdict[i].n_lost_words == 6 for i in range(12))
    assert not any(verdict[i].kept for i in range(12, 15))
    cleaned = {r.doc_id: r.text for r in quality.clean(df, **limits).collect()}
    assert cleaned == {i: texts[i].split("\n")[0] for i in range(12)}


def test_quality_production_limits_fire_as_in_the_sql(ready):
    import duckdb

    from wearline.llm.sql import ORACLES

    rng = random.Random(5)
    body = lambda: " ".join(words(rng, 60))
    rows = [("hit", f"{body()}\nshared footer line of this host") for _ in range(55)] + [("hit", body()) for _ in range(5)]
    rows += [("hit", f"shared footer line of this host\nmore {k}") for k in range(3)]
    rows += [("small", f"{body()}\nshared footer line of this host") for _ in range(49)]
    rows += [("tiny", f"{body()}\nshared footer line of this host") for _ in range(9)]
    rows += [("large", f"own {k} shared{k % 3 * ' '} footer line of this host" if k >= 1010 else f"own {k}\nshared footer line of this host") for k in range(10500)]
    rows += [("copies", f"{rows[0][1]}\nown")] * 60 + [("copies", body()) for _ in range(20)]
    df = ready.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_lost_words, r.kept) for r in quality.assess(df).collect()}
    lost = Counter((rows[i][0], n) for i, (n, _) in got.items())
    assert lost == {("hit", 6): 58, ("hit", 0): 5, ("small", 6): 49, ("tiny", 0): 9, ("copies", 0): 80, ("large", 6): 1010, ("large", 0): 9490}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(f"SELECT doc_id, n_lost_words, kept FROM ({ORACLES['op6_quality']})").df()
    assert got == {r.doc_id: (r.n_lost_words, r.kept) for r in want.itertuples()}


def test_quality_statistics_of_edges(ready):
    got = {r.doc_id: r for r in quality.assess(documents(ready, edge_texts())).collect()}
    assert [got[i].n_words for i in range(4)] == [0, 0, 0, 1] and got[0].base_failed
    assert got[4].word_chars == len("Größeübermäßigñandú")
    assert got[13].n_repeat_words == 400 and got[13].base_failed


def brute_substrings(texts, length):
    raw = [(t or "").encode() for t in texts]
    starts = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def passages():
    rng = random.Random(9)
    shared = " ".join(words(rng, 90))
    texts = [" ".join(words(rng, rng.randrange(150))) + shared[rng.randrange(40) :] + " ".join(words(rng, 60)) for _ in range(25)]
    return [*texts, *edge_texts(), "ab" * 500, shared[:199], shared[:200]]


@pytest.mark.parametrize("split_over", [8192, 3])
def test_substring_dedup_matches_brute_force(ready, split_over):
    texts = passages()
    rows = substring.remove_repeated(documents(ready, texts), split_over=split_over, block_bytes=4000).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_substrings(texts, 200)


def test_transform_finds_repeated_windows():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(30)]
    for length in (1, 3, 9, 20):
        counts = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for s, mask in zip(strings, repeated_windows(strings, length), strict=True):
            assert mask.tolist() == [counts[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]


@pytest.mark.parametrize("size", [300_000, 2_300_000])  # packed words, and a block above them
def test_transform_of_large_blocks_matches_counting(size):
    rng = np.random.default_rng(5)
    shared = [rng.integers(97, 101, 700, np.uint8).tobytes() for _ in range(20)]
    strings, total = [], 0
    while total < size:
        own = rng.integers(97, 101, int(rng.integers(0, 900)), np.uint8).tobytes()
        part = shared[int(rng.integers(20))]
        cut = int(rng.integers(0, 300))
        strings.append(own + part[cut : cut + int(rng.integers(0, 700))])
        total += len(strings[-1])
    seen = Counter(hash(s[i : i + 200]) for s in strings for i in range(len(s) - 199))
    for s, mask in zip(strings, repeated_windows(strings, 200), strict=True):
        assert mask.tolist() == [seen[hash(s[i : i + 200])] > 1 for i in range(max(0, len(s) - 199))]


def test_contamination_in_blocks_equals_one_pass(ready):
    rng = random.Random(6)
    items = [" ".join(words(rng, n)) for n in (13, 14, 40, 5, 1, 200, 12)]
    bench = ready.createDataFrame([(i, t) for i, t in enumerate(items)] + [(2, items[0]), (None, "x y z"), (9, None), (8, "--")], "item_id long, text string")
    texts = [" ".join(words(rng, 80)) for _ in range(6)] + [items[2].upper().replace(" ", "-"), " ".join(words(rng, 30)) + " " + items[5][3:300], None, ""]
    df = documents(ready, texts)
    one = {r.doc_id: r for r in decontaminate.contamination(df, bench).collect()}
    many = {r.doc_id: r for r in decontaminate.contamination(df, bench, block_words=30).collect()}
    import re

    tokens = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in enumerate(texts):
        w, hit, names = tokens(t), set(), set()
        for name, item in [*enumerate(items), (2, items[0])]:
            b = tokens(item)
            m = min(13, len(b))
            grams = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)}
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in grams:
                    hit.update(range(k, k + m))
                    names.add(str(name))
        for got in (one[i], many[i]):
            assert (got.n_words, got.n_hit, got["items"]) == (len(w), len(hit), sorted(names))


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_texts():
    rng = random.Random(8)
    out = ["", None, "a b", "A b", "a b c", "x y z u v", "x y z u V"]
    for size in (6, 9, 15, 30, 31, 64, 127, 129, 300, 1100):
        base = words(rng, size, 5000)
        out.append(" ".join(base))
        for _ in range(6):  # copies of the base, mostly near it and less near each other
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 45) + 1)):
                copy[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(copy[rng.randrange(2) :]))
    rng.shuffle(out)
    return out


def test_near_duplicates_match_brute_force(ready):
    texts = near_texts()
    df = documents(ready, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link_components(df).collect()}
    expected = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == expected
    kept = {r.doc_id for r in neardup.keep_one(df).collect()}
    assert kept == {i for i, (_, c) in enumerate(expected) if c == i}


def test_linked_sets_share_a_key():
    rng = random.Random(12)
    for _ in range(300):
        n = rng.choice([1, 3, 4, 7, 8, 12, 15, 16, 31, 63, 200, 255])
        base = [rng.getrandbits(64) for _ in range(n)]
        other = list(base)
        while True:
            change = list(other)
            change[rng.randrange(len(change))] = rng.getrandbits(64)
            common = len(set(base) & set(change))
            if 100 * common < 80 * (len(base) + len(change) - common):
                break
            other = change
        s = neardup.Sets.__new__(neardup.Sets)
        sets = [np.unique(np.array(x, np.uint64)) for x in (base, other)]
        s.h = np.concatenate(sets)
        s.n = np.array([len(x) for x in sets])
        s.doc = np.repeat([0, 1], s.n)
        s.first = np.concatenate(([0], np.cumsum(s.n)))
        doc, key = s.keys()
        assert set(key[doc == 0]) & set(key[doc == 1])


def test_shards_are_even_and_keep_groups_together(ready):
    rng = random.Random(1)
    texts = [" ".join(words(rng, 20)) for _ in range(300)]
    texts += [texts[k % 20] for k in range(100)] + [None, None, ""] + ["hot text"] * 200
    rows = sharding.shard(documents(ready, texts), shards=40).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    groups = {}
    for r in rows:
        t = texts[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "rows"
        if t is not None:
            groups.setdefault(t, []).append(r.shard)
    split = [t for t, s in groups.items() if len(s) <= 10 and len(set(s)) > 1]
    assert len(split) <= 2
    assert len(set(groups["hot text"])) < 30  # 200 rows at 15 or 16 a shard; at random they would be on all 40


@pytest.mark.parametrize(("sizes", "most_split", "most_shards"), [([2, 3, 4, 5] * 715, 20, 2), ([400] * 25, 25, 3), ([9, 2, 3, 30, 3, 2, 140, 4, 5, 2] * 50, 30, 3)])
def test_shards_of_copies_only_keep_groups_together(ready, sizes, most_split, most_shards):
    """Every row has a copy: no shard has free room, 250 rows each."""
    groups = [k for k, n in enumerate(sizes) for _ in range(n)]
    docs = ready.createDataFrame([(i, f"text {k}") for i, k in enumerate(groups)], "doc_id long, text string").repartition(4)
    rows = sharding.shard(docs, shards=40).collect()
    load, held = Counter(r.shard for r in rows), {}
    for r in rows:
        held.setdefault(groups[r.doc_id], set()).add(r.shard)
    assert len(rows) == len({r.doc_id for r in rows}) == len(groups) and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert all(r.linked for r in rows) and max(load.values()) - min(load.values()) <= 1
    split = [s for s in held.values() if len(s) > 1]
    assert len(split) <= most_split and all(len(s) <= most_shards for s in held.values())


def test_toxicity_learns_severity(ready):
    rng = random.Random(0)
    bad = ["vileword", "nastyword", "grimword"]
    rows, labels = [], []
    for i in range(240):
        w = words(rng, 60, 300)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.choice([2, 6, 15])):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic) if i < 160 else None))
    docs = ready.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, ready.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs.unionByName(ready.createDataFrame([(900, None), (901, "")], "doc_id long, text string")), model).collect()}
    assert all(got[i].toxic == (i % 4 == 0) for i in range(160, 240))
    assert np.all(np.diff(model.thresholds) > 0) and got[900].expected_severity == got[901].expected_severity < 0.5
    counts = np.array([sum(rows[i][1].split().count(b) for b in bad) for i in range(0, 240, 4)])
    expected = np.array([got[i].expected_severity for i in range(0, 240, 4)])
    assert expected[counts >= 12].mean() > expected[counts <= 3].mean()


def test_substring_dedup_of_many_rows_equal_in_id_and_text(ready):
    import time

    rng = random.Random(2)
    text = " ".join(words(rng, 600))
    other = " ".join(words(rng, 300))
    rows = [(7, text)] * 3000 + [(8, other), (9, text[:1500] + other)]
    start = time.time()
    got = substring.remove_repeated(ready.createDataFrame(rows, "doc_id long, text string").repartition(6), with_kept=False).collect()
    assert time.time() - start < 120  # the square of the repeats took minutes
    assert len(got) == len(rows)
    assert {(r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id == 7} == {(len(text), 1, hashlib.sha256(b"").hexdigest())}
    assert [r.n_removed for r in got if r.doc_id == 8] == [len(other)]
    assert [r.n_removed for r in got if r.doc_id == 9] == [1500 + len(other)]


def test_revisits_refer_to_the_id_of_their_response_and_resolve(ready):
    body = "<html>" + "é" * 100
    pages = ready.createDataFrame([(1, "http://a/ b", body), (2, "http://x%20y", body), (3, "c", "other" * 40), (4, "d", body)], "page_id long, url string, html string")
    folder = scratch_path(ready, "warc-test-" + hashlib.sha1(str(random.random()).encode()).hexdigest())
    index = warc.write_archives(pages, folder)
    rows = warc.read_payloads(index.where("page_id in (2, 3, 4)"), index, folder).collect()
    assert {(r.page_id, r.record_type, bytes(r.payload).decode()) for r in rows} == {(2, "revisit", body), (3, "response", "other" * 40), (4, "revisit", body)}
    assert {r.page_id: r.url for r in warc.read_records(index, folder).collect()} == {1: "http://a/ b", 2: "http://x%20y", 3: "c", 4: "d"}
    digest = hashlib.sha256(body.encode()).hexdigest()
    one = {"page_id": 1, "url": "u", "payload": body.encode(), "payload_digest": digest, "payload_bytes": len(body.encode()), "refers_to": None, "record_type": "response"}
    two = one | {"page_id": 2, "record_type": "revisit", "refers_to": 1}
    own = next(x for x in warc.record(one).decode().split("\r\n") if x.startswith("WARC-Record-ID"))
    assert own.split(": ")[1] == next(x for x in warc.record(two).decode().split("\r\n") if x.startswith("WARC-Refers-To")).split(": ")[1]
    assert warc.record(one) == warc.record(one)


def test_columns_that_differ_in_case_or_repeat_names_pass_through(ready):
    rng = random.Random(4)
    text = "\n".join(" ".join(words(rng, 9)) for _ in range(6))
    rows = [(i, text if i < 2 else f"{i} " + " ".join(words(rng, 60)), "en", "s", i, f"T{i}", i * 2, f"k{i}") for i in range(5)]
    docs = ready.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Text string, DOC_ID long, _k1 string")
    bench = ready.createDataFrame([(1, "nothing of this is in there")], "item_id long, text string")
    for out in (quality.clean(docs), linedup.remove_repeated_lines(docs), neardup.keep_one(docs), decontaminate.remove_contaminated(docs, bench)):
        names = [c for c in out.columns if c not in ("n_lines", "n_removed_lines")]
        assert names == docs.columns
        place = {r[0]: r for r in out.collect()}
        assert all((r[5], r[6], r[7]) == (f"T{i}", i * 2, f"k{i}") for i, r in place.items()) and 0 in place


def test_one_of_near_copies_stays_whatever_their_ids(ready):
    rng = random.Random(9)
    base = words(rng, 200)
    near = [*base[:-1], "changed"]
    rows = [(None, " ".join(base)), (None, " ".join(base)), (None, " ".join(near)), (7, " ".join(near)), (7, " ".join(base)), (8, " ".join(words(rng, 50))), (None, ""), (9, "")]
    kept = neardup.keep_one(ready.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), len(r.text.split())) for r in kept) == sorted([("7", 200), ("8", 50), ("None", 0), ("9", 0)])
    nameless = neardup.keep_one(ready.createDataFrame([(None, " ".join(base)), (None, " ".join(near))], "doc_id long, text string")).collect()
    assert len(nameless) == 1

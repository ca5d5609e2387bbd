"""Line deduplication, SimHash and decontamination against brute force."""

import random
from collections import defaultdict
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from vellumflow.llm import op1_line_dedup as lines
from vellumflow.llm import op5_simhash as simhash
from vellumflow.llm import op7_decontaminate as clean
from vellumflow.llm.components import connected_components
from vellumflow.llm.words import hash_words

WORDS = [f"w{i}" for i in range(400)]


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_removed(rows):
    seen, removed = [], defaultdict(list)
    for d, t in sorted(rows):
        for i, x in enumerate(t.split("\n")):
            if s := frozenset(x.encode().split()):
                if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                    removed[d].append(i)
                seen.append(s)
    return removed


def test_line_dedup(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=k)) for k in (1, 2, 3, 4, 5, 8, 10, 20, 30, 200)]
    rows = []
    for d in range(120):
        text = []
        for b in rng.sample(base, 3):
            w = b.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            text.append(" ".join(w))
        rows.append((d, "\n".join([*text, "", " \t"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("c1", F.lit(2))
    want = brute_removed(rows)
    for steps in ((2, 64, 512), (1, 3)):
        got = lines.dedup_lines(df, steps=steps).collect()
        assert {r.doc_id: list(r.removed) for r in got if r.removed} == {d: x for d, x in want.items() if x}
        for r in got:
            kept = [x for i, x in enumerate(dict(rows)[r.doc_id].split("\n")) if i not in want[r.doc_id]]
            assert r.text == "\n".join(kept) and r.n_lines == 5 and r.kept_lines == len(kept)


def test_line_dedup_shuffled_rows(spark):
    line, similar = "a b c d e f g h i j", "a b c d e f g h i k"
    rows = [(10, line), (3, line), (5, similar), (11, "z\n" + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: list(r.removed) for r in lines.dedup_lines(df).collect()}
    assert got == {3: [], 5: [0], 10: [0], 11: [1]}
    rng = random.Random(12)
    base = [rng.choices(WORDS, k=k) for k in (5, 8, 10, 20, 30)]
    rows = []
    for d in range(100):
        text = []
        for b in rng.sample(base, 3):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS[:5])
            text.append(" ".join(w))
        rows.append((d, "\n".join(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute_removed(rows)
    assert {r.doc_id: list(r.removed) for r in lines.dedup_lines(df).collect() if r.removed} == {d: x for d, x in want.items() if x}


def test_line_dedup_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(None, "a b c d e"), (1, None), (2, ""), (3, "a b c d e\n\n" + long), (4, long), (5, "q r"), (5, "q r"), (5, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, list(r.removed)) for r in lines.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(None, "a b c d e", []), (1, None, []), (2, "", []), (3, "\n" + long, [0]), (4, "", [0]), (5, "q r", []), (5, "", [0]), (5, "other", [])], key=repr)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def removed_of(df, **options):
    return {r.doc_id: list(r.removed) for r in lines.dedup_lines(df, **options).collect() if r.removed}


def test_line_dedup_parts_without_words(spark):
    """Parts that are empty, null or blank, among others and alone."""
    rows = [(1, "a b c d e"), (2, None), (3, " \t\n"), (4, ""), (5, "a b c d e"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert removed_of(df) == {5: [0]}
    blank = df.where("doc_id in (2, 3, 4)")
    assert sorted((r.doc_id, r.text, list(r.removed)) for r in lines.dedup_lines(blank).collect()) == [(2, None, []), (3, " \t\n", []), (4, "", [])]
    two = spark.createDataFrame(rows[:2], "doc_id long, text string").repartition(4, "doc_id")
    assert lines.dedup_lines(two).count() == 2


def test_line_dedup_keeps_extra_columns(spark):
    rows = [(1, "a b c d e\nf", "x", 1, 2, 3), (1, "a b c d e\nf", "y", 4, 5, 6), (2, "f", "z", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _lines int, n_lines int, `key` int")
    got = sorted(tuple(r) for r in lines.dedup_lines(df).select("doc_id", "_key", "_lines", "key", "n_lines", "kept_lines").collect())
    assert [g[:5] for g in got] == [(1, "x", 1, 3, 2), (1, "y", 4, 6, 2), (2, "z", 7, 9, 1)] and sorted(g[5] for g in got) == [0, 0, 2]


def test_line_dedup_hot_words_and_clashing_sums(spark):
    """Words dealt to many tasks, steps that leave most lines unsettled, and class sums of ten bits: the same lines go."""
    rng = random.Random(21)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for d in range(150):
        text = [" ".join(rng.sample(common, 9) + [rng.choice(common)]) for _ in range(2)] + [" ".join(rng.choices(WORDS, k=6))]
        rows.append((d, "\n".join(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: x for d, x in brute_removed(rows).items() if x}
    assert 50 < len(want) < 150
    assert removed_of(df, hot=4, steps=(1, 2)) == want
    assert removed_of(df, class_bits=10) == want
    assert removed_of(df, hot=64, wide=2, steps=(1, 2)) == want


def test_line_dedup_common_words_only(spark):
    """Twenty thousand lines of thirty words: every word's lines are dealt to many tasks; against a comparison of all pairs."""
    rng = np.random.default_rng(4)
    sets = np.array([sum(1 << int(w) for w in rng.choice(30, int(n), replace=False)) for n in rng.integers(9, 12, 20_000)], np.uint64)
    text = [" ".join(f"w{k}" for k in range(30) if int(s) >> k & 1) for s in sets]
    sizes, gone = np.bitwise_count(sets).astype(int), []
    for i in range(1, len(sets)):
        both = np.bitwise_count(sets[:i] & sets[i]).astype(int)
        if (both >= 0.8 * (sizes[:i] + sizes[i] - both) - 1e-9).any():
            gone.append(i)
    df = spark.createDataFrame([*enumerate(text)], "doc_id long, text string").repartition(6)
    assert 100 < len(gone) < 19_000
    assert sorted(removed_of(df, hot=1 << 10)) == gone == sorted(removed_of(df, wide=600))


def test_line_dedup_reads_sets_of_wanted_lines_only(monkeypatch):
    """Of the lines of all texts only those at a wanted place are cut into words again."""
    texts = [None, "a b c\nd e f\n", "\n\ng h i", "d e f"]
    read, wanted = [], np.zeros(1 << lines.FILTER_BITS, bool)
    for d, n in ((0, 1), (7, 2)):
        wanted[int(lines._places(np.array([d]), np.array([n]))[0]) >> 64 - lines.FILTER_BITS] = True
    made = lines.Lines
    monkeypatch.setattr(lines, "Lines", lambda t, *a: read.extend(t) or made(t, *a))
    rows = pa.RecordBatch.from_arrays([pa.array([1, None, 7, 9]), pa.array(texts).cast(pa.binary())], ["doc_id", "text"])
    rows = rows.filter(rows["text"].is_valid())
    sent = SimpleNamespace(value=np.packbits(wanted, bitorder="little"))
    got = [r for b in lines._sets(sent, np.empty(0, np.uint64), 64)(iter([rows])) for r in b.to_pylist()]
    assert sorted(read) == [b"d e f", b"g h i"]
    want = [made([t]) for t in sorted(read)]
    assert {r["c1"]: r["words"] for r in got} == {int(w.classes[0].view(np.int64)[0]): np.sort(w.hashes).tobytes() for w in want}


def test_line_dedup_orders_rows_of_a_bucket():
    """By one number where identifiers allow it, else by all columns; the first row of each class of a run stays."""
    rng = np.random.default_rng(8)
    for low, high, repeats in ((0, 50, 1), (-(1 << 63), (1 << 63) - 1, 1), (0, 5, 3)):
        rows = {"run": np.sort(rng.integers(0, 9, 400).astype(np.uint64)), "known": rng.integers(0, 2, 400).astype(np.uint8), "doc_id": rng.integers(low, high, 400)}
        rows |= {"line": rng.integers(0, 4, 400).astype(np.int32), "c1": rng.integers(-20, 20, 400)}
        want = sorted(zip(*(rows[c].tolist() for c in ("run", "known", "doc_id", "line", "c1")), strict=True))
        order = lines._by_place(rows)
        assert [*zip(*(rows[c][order].tolist() for c in ("run", "known", "doc_id", "line", "c1")), strict=True)] == want
        run, c1 = (rows[c][order] for c in ("run", "c1"))
        seen, first = set(), []
        for i, k in enumerate(zip(run.tolist(), c1.tolist(), strict=True)):
            if k not in seen:
                first.append(i)
            seen.add(k)
        assert lines._first_of_classes(run.astype(np.int64), c1).tolist() == first


def test_line_dedup_adds_counters_up():
    places, counts, want = np.empty(0, np.uint64), np.empty(0, np.int64), defaultdict(int)
    rng = np.random.default_rng(9)
    for n in (0, 5, 3000):
        more = rng.integers((1 << lines.RARITY_BITS) - 40, 1 << lines.RARITY_BITS, n).astype(np.uint32)
        for m in more.tolist():
            want[m] += 1
        places, counts = lines._add_counts(places, counts, [more])
    assert dict(zip(places.tolist(), counts.tolist(), strict=True)) == want and (np.diff(places.astype(np.int64)) > 0).all()


def test_hash_words_differ_by_any_byte():
    """Words of one byte to more than are hashed together; zeros at the end count."""
    words = {bytes(n) for n in (1, 7, 8, 9, 16, 17, 1023, 1024, 1025, 3000)} | {b"", b"x"}
    for n in (1, 5, 8, 9, 24, 1024, 1030):
        for i in {0, n // 2, n - 1}:
            words.add(b"a" * i + b"b" + b"a" * (n - 1 - i))
    words = sorted(words - {b""})
    hashes, which, starts, data = hash_words(words)
    assert len(set(hashes.tolist())) == len(words) and which.tolist() == [*range(len(words))] and data.tobytes() == b"\n".join(words)
    again = hash_words([b" y ".join(reversed(words))])[0]
    assert again[::2].tolist() == hashes[::-1].tolist() and hash_words([])[3].tobytes() == b""


def test_hash_words_cuts_like_split():
    texts = [b"", b" a  b\x0bc ", "é\xa0é".encode(), b"a", b"\x1ca \x85", b"x" * 600_000 + b" y " + b"z" * 300_000, b"ab " * 200_000]
    hashes, which, _, _ = hash_words(texts)
    assert [int((which == i).sum()) for i in range(len(texts))] == [len(t.split()) for t in texts]
    assert hashes[0] == hashes[4] != hashes[1]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(1)
    texts = ["", None, "  \n", "One", "one", "a b", "A b c", "É é", "x " * 50_000]
    for _ in range(25):
        w = rng.choices(WORDS, k=400)
        texts += [" ".join(w), " ".join(w), " ".join(w[:-1]), " ".join([*w, "end"])]
    rows = [(i * 3 % 211, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x")).withColumn("component_id", F.lit(0))
    marks = [brute_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(marks[i] ^ marks[j]).count("1") <= 2]
    group = roots(range(len(rows)), links)
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(rows):
        least[group[i]] = min(least[group[i]], d)
    want = sorted((d, f"{marks[i]:016x}", least[group[i]]) for i, (d, _) in enumerate(rows))
    for limit in (1024, 2):
        assert sorted(tuple(r) for r in simhash.near_duplicates(df, run_limit=limit).collect()) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_runs_lose_no_link(spark):
    rng = np.random.default_rng(1)
    marks = set()
    for b in rng.integers(0, 2**63, 8).tolist():
        for _ in range(60):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << bit
            marks.add(x)
    signed = np.array(sorted(marks), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "mark long")
    want = roots(signed, [(a, b) for a in signed for b in signed if bin((a ^ b) & (2**64 - 1)).count("1") <= 2])
    for limit in (1024, 2):
        assert roots(signed, [tuple(r) for r in simhash.near_links(df, run_limit=limit).collect()]) == want


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots({x for e in links for x in e}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


def test_similar_documents(spark):
    rng = random.Random(2)
    rows, pairs = [], []
    for i in range(40):
        w = rng.choices(WORDS, k=300)
        rows.append((i, " ".join(w)))
        for k, edits in enumerate((0, 1, 3)):
            v = list(w)
            for at in rng.sample(range(300), edits):
                v[at] = "edit"
            rows.append((100 * (k + 1) + i, " ".join(v)))
            pairs.append((i, 100 * (k + 1) + i))
    rows += [(1000, ""), (1001, None), (1002, "one two"), (1003, "one two"), (1004, "two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert all(got[a] == got[b] == a for a, b in pairs) and len(set(got[i] for i in range(40))) == 40
    assert got[1001] == 1000 and got[1003] == 1002 and got[1004] == 1004
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(40), 1000, 1002, 1004]
    twice = df.union(df).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert simhash.drop_near_duplicates(twice).count() == 44


def brute_components(rows, words=5, similarity=0.8):
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9 and sets[a] & sets[b]]
    return roots(ids, links)


def families(rng, count, versions, length, most):
    """Versions of a text with up to ``most`` edits each, about half of the pairs of a family below 0.8."""
    rows = []
    for _ in range(count):
        base = rng.choices(WORDS, k=length)
        for _ in range(versions):
            w = list(base)
            for at in rng.sample(range(length), rng.randint(0, most)):
                w[at] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_similar_families(spark):
    rng = random.Random(7)
    rows = families(rng, 12, 30, 300, 12) + [(1000 + d, t) for d, t in families(rng, 40, 2, 300, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == brute_components(rows)


def test_similar_finds_every_pair(spark):
    """Pairs just above 0.8, each a family of its own: all are found, and none just below."""
    rng = random.Random(10)
    rows = []
    for i in range(150):
        w = rng.choices(WORDS, k=300)
        v = list(w)
        for at in range(5 + i % 7, 300, 300 // (5 + i % 3)):
            v[at] = "edit"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert 20 < sum(want[2 * i + 1] == 2 * i for i in range(150)) < 150
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == want


def test_similar_repeated_passages(spark):
    """Repeats do not change the set of shingles, so a text is linked to one that repeats a passage of it."""
    rng = random.Random(9)
    rows = []
    for i, k in enumerate([1, 2, 5, 10] * 10):
        w = rng.choices(WORDS, k=300)
        rows += [(i, " ".join(w)), (100 + i, " ".join(w + w[:30] * k))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert got == brute_components(rows) and all(got[100 + i] == i for i in range(40))


def test_similar_long_runs_lose_no_link(spark):
    """Pairs of near copies in runs far beyond the limit: all texts share a passage."""
    rng = random.Random(8)
    shared = rng.choices(WORDS, k=40)
    rows = [(i, " ".join([*shared, *(f"x{rng.randrange(10**9)}" for _ in range(4))])) for i in range(60)]
    other = [(100 + i, " ".join([*shared, *(f"y{i}z{k}" for k in range(20))])) for i in range(60)]
    rows += other + [(200 + i, t + " end") for i, t in other]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for limit in (2048, 8):
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(df, run_limit=limit).collect()} == want


def test_block_pairs_meet_once_or_within(spark):
    rows = [(k, n, 10, 0, n, b"\0" * 64) for k, m in ((1, 30), (2, 4)) for n in range(m)]
    df = spark.createDataFrame([(*r, 30 if r[0] == 1 else 4) for r in rows], "key long, node long, size int, place int, root long, bits binary, rows long")
    left = simhash._block_pairs(df, 8).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    got = {tuple(r) for r in left.mapInArrow(simhash._other_links(0.8, None), "u long, v long, key long").select("u", "v").collect()}
    assert got == {(a, b) for b in range(30) for a in range(b)}


def test_similar_hot_shingles_dealt_to_tasks(spark):
    """Runs dealt to many tasks, cut into blocks, and nodes that clash: still all links and no others."""
    rng = random.Random(12)
    rows = families(rng, 3, 60, 120, 8) + [(1000, ""), (1001, None), (1002, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components([(d, t or "") for d, t in rows])
    assert 3 < len({want[d] for d, _ in rows if d < 1000}) < 170
    got = simhash.similar_documents(df, hot_rows=2, run_limit=16, node=lambda t: F.pmod(F.xxhash64(t), F.lit(20)))
    got = {r.doc_id: r.component_id for r in got.collect()}
    assert got.pop(1001) == 1000 and {**want, 1001: 1000} == {**got, 1001: 1000}


def test_parity_bits_bound_the_difference():
    """Folded or not, texts never differ in more parity bits than their sets do in shingles."""
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (100, 90), (3000, 2900), (3000, 200), (0, 4)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[: min(n, m) // 2], rng.integers(0, 1 << 63, m - min(n, m) // 2, dtype=np.uint64)))
        x, y = simhash.parity_bits(a), simhash.parity_bits(b)
        for size in {min(len(x), len(y)), 64}:
            apart = int(np.bitwise_count(simhash.fold(x, size) ^ simhash.fold(y, size)).sum())
            assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_rows_that_repeat_an_identifier(spark):
    """One of them stays, the same in whatever order and parts they come, and whatever their columns are named."""
    rows = [(1, "alpha beta gamma delta epsilon", None, 1.0), (1, "another text with that same number", None, 2.0), (1, "alpha beta gamma delta epsilon", "x", 1.0), (2, "alone", "y", None), (None, "alone", "y", None)]
    kept = []
    for parts in (1, 5):
        for order in (rows, rows[::-1]):
            docs = spark.createDataFrame(order, "doc_id int, text string, _again string, _key double").repartition(parts)
            out = simhash.drop_near_duplicates(docs)
            assert out.dtypes == docs.dtypes
            kept.append(sorted(map(tuple, out.collect()), key=repr))
    assert all(k == kept[0] for k in kept) and [r[0] for r in kept[0]] == [1, 2, None]


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORDS, k=20 + i))) for i in range(30)] + [(50, "short item of six words here"), (51, "too short"), (52, None), (0, "again the same number but other words in it here")]
    docs, want = [], {}
    for i in range(30):
        w = items[i][1].split()
        for k in range(0, len(w), 7):
            w[k] = "changed"
        docs.append((i, " ".join([*rng.choices(WORDS, k=40), *w, *rng.choices(WORDS, k=40)])))
        want[i] = [i]
    docs += [(100 + i, " ".join(rng.choices(WORDS, k=3000))) for i in range(20)]
    docs += [(200, "x SHORT item, of six-words HERE! y"), (201, "short item of"), (202, None), (203, ""), (204, items[3][1]), (205, " ".join(items[4][1].split()[5:19])), (206, " ".join(items[4][1].split()[5:15]))]
    docs += [(207, items[5][1]), (207, "clean twin")]
    want |= {200: [50], 204: [3], 205: [4]}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("key", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = clean.contamination(df, bench).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.item_ids for r in got if r.contaminated and r.doc_id != 207} == want
    assert sorted(r.contaminated for r in got if r.doc_id == 207) == [False, True]
    kept = clean.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - len(want) - 1
    assert clean.drop_contaminated(df, bench.limit(0)).count() == len(docs)
    assert clean.contamination(df.limit(0), bench).count() == 0


def accepted(size):
    """Places of a passage of ``size`` tokens that may be substituted together, by the rule of ``overlap``."""
    item = np.arange(size, dtype=np.uint64)
    for k in range(size):
        some = False
        for out in combinations(range(size), k):
            doc = item.copy()
            doc[list(out)] = 999
            if clean.overlap(doc, item, 0):
                some = True
                yield out
        if not some:
            return


def test_masks_hit_every_accepted_pattern():
    for size in range(1, clean.WINDOW + 4):
        masks = clean.MASKS if size >= clean.WINDOW else clean.short_masks(size)
        for out in accepted(size):
            shifts = lambda m: range(size - m[-1]) if size >= clean.WINDOW else (0,)
            assert any(not {i + s for i in m} & set(out) for m in masks for s in shifts(m)), (size, out)


def test_short_and_sparse_overlaps(spark):
    rng = random.Random(11)
    rows, items = [], []
    for size, outs in ((5, (2,)), (7, (3,)), (8, (4,)), (9, (4,)), (10, (0, 5)), (12, (3, 8)), (13, (4, 8)), (13, (5, 10)), (15, (0, 6, 10))):
        w = [f"i{len(items)}n{k}" for k in range(size)]
        v = ["changed" if k in outs else x for k, x in enumerate(w)]
        items.append((len(items), " ".join(w)))
        rows.append((len(rows), " ".join([*rng.choices(WORDS, k=20), *v, *rng.choices(WORDS, k=20)])))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in clean.contamination(df, bench).collect()} == {i: [i] for i in range(len(items))}


def test_similar_documents_go_by_deletion_variants(spark, monkeypatch):
    """Candidates of the fingerprints' variants connect what a fingerprint links, and are verified with the others."""
    base = [f"w{i}" for i in range(400)]
    texts = [*(" ".join([*base[:n], "new", *base[n + 1 :]]) for n in range(0, 390, 13)), " ".join(base).upper(), "a b c", "A b c", "", " ", *(" ".join(f"v{k}-{i}" for i in range(40)) for k in range(5))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text"))
    found = simhash.connected_components(simhash.variant_pairs(rows)).collect()
    roots = {r.node: r.root for r in found}
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(set(want.values())) < len(want) and {n: roots.get(n, n) for n in want} == want
    marks, seen = simhash.near_links, []
    monkeypatch.setattr(simhash, "near_links", lambda m, **options: seen.append(m.count()) or marks(m, **options))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert seen == [len({simhash.fingerprint(t.encode()) for t in texts})] and {0, 31, 33, 34} <= kept and len(kept) == 9

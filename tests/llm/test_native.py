"""Chat formatting, exact deduplication and mixing against brute force."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellumflow.llm import op2_mix_sources as mixing
from vellumflow.llm import op4_exact_dedup as exact
from vellumflow.llm import op10_chat_format as chat

ODD = ["", None, "\\", "<|", "<\\|", "\\<|end|>\n", "<|turn|>x<|text|>", "\\\\<|", "<|end|>\n<|turn|>", "é\n\n", "\\### Assistant: </turn> ok"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in ODD if x is not None], "x string")
    rows = df.select("x", chat.escape(F.col("x")).alias("e"), chat.unescape(chat.escape(F.col("x"))).alias("u")).collect()
    assert all(r.u == r.x and "<|" not in r.e for r in rows)


def test_chats(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(ODD)]
    rows += [(2, 0, "user", "a"), (3, 5, "assistant", "b"), (3, 5, "assistant", "b"), (3, None, "user", "c"), (None, 0, None, None), (4, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.summarise(examples).collect()}
    turns = defaultdict(list)
    for c, n, role, text in rows:
        turns[c].append(((n is not None, n or 0, role or "", text or ""), role or "", text or ""))
    for c, found in turns.items():
        found = [(r, t) for _, r, t in sorted(found)]
        loss = "".join(t for r, t in found if r == "assistant")
        assert got[c].n_turns == len(found)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in found).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    per = {(r.conv_id, r.example): r for r in examples.collect()}
    assert len([k for k in per if k[0] == 1]) == 6 and per[1, 5].loss_length == 0  # five replies and the turn after them
    assert got[1].formatted_chars == sum(len(r.formatted) for k, r in per.items() if k[0] == 1)
    assert per[4, 0].formatted[per[4, 0].loss_start :][: per[4, 0].loss_length] == "x" * 100_000
    assert chat.summarise(chat.format_chats(df.limit(0))).count() == 0


def _write(spark, path, rows, n):
    spark.createDataFrame(rows, "doc_id long, text string, keep_id string, digest string").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_dedup_in_batches(spark, tmp_path, digest):
    path, root = str(tmp_path / "docs"), str(tmp_path / "state")
    texts = ["a", "a ", "A", None, "", "b" * 200_000, "é", "é", *map(str, range(40))]
    rows = [(i if i % 11 else None, texts[i * 7 % len(texts)], "x", "y") for i in range(150)]
    _write(spark, path, rows[:60], 1)
    exact.exact_dedup(spark, path, root=root, digest=digest, files_per_batch=1).count()
    _write(spark, path, rows[60:], 2)
    got = exact.exact_dedup(spark, path, root=root, digest=digest, files_per_batch=1).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        seen[r.text_sha256].append(r)
    for found in seen.values():
        assert [r.doc_id == r.keep_id for r in found if r.kept] == [True]


def test_exact_dedup_of_odd_columns(spark, tmp_path):
    """Columns named like those that the reader adds, and a path that ends in a slash."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "y"), (3, None, 3, "z")], "doc_id long, text string, _metadata int, digest string").write.parquet(path)
    got = exact.exact_dedup(spark, path + "/", root=str(tmp_path / "state")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


def test_exact_dedup_of_nothing(spark, tmp_path):
    path = str(tmp_path / "docs")
    _write(spark, path, [], 0)
    assert exact.exact_dedup(spark, path, root=str(tmp_path / "s")).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, left = budget * sum(sizes.values()), {}, set(names)
    while left:
        share = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * share >= most * sizes[s]]
        if not over:
            return target | {s: weight[s] * share for s in left}, total
        for s in over:
            target[s] = most * sizes[s]
            left.discard(s)
    return target, total


def test_mix(spark):
    rows = [(i, "w " * (i * 37 % 90), ["hot", "b", None, "ä", "z", "tiny"][0 if i % 3 == 0 else i % 6]) for i in range(600)]
    rows += [(9000, None, "null text"), (9001, "one\x0btwo\xa0two", "tiny"), (5, rows[5][1], rows[5][2]), (None, "a b c", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(0)).withColumn("size", F.lit("x"))
    got = mixing.mix_plan(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len([w for w in (t or "").replace("\x0b", " ").split(" ") if w])
    target, total = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * 90 for s in sizes)
    assert total - 90 <= sum(taken.values()) <= total
    again = {(r.doc_id, r.source, r.size): r.taken for r in mixing.mix_plan(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.source, r.size): r.taken for r in got}
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    want = {(r.doc_id, r.source, r.size): r.copies for r in got if r.doc_id != 5}
    counted = mixed.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")).where("doc_id <> 5 or doc_id is null").groupBy("doc_id", "source", "n").count()
    assert {(r.doc_id, r.source, r.n): r["count"] for r in counted.collect()} == {k: n for k, n in want.items() if n}


def brute_mix(rows, places):
    """Copies of each row by a queue of finish times: (source, place in the source's order) to copies."""
    sizes, queue = defaultdict(int), []
    size = [len((t or "").split(" ")) if t else 0 for _, t, _ in rows]
    for (_, _, s), n in zip(rows, size, strict=True):
        sizes[s] += n
    target, total = brute_targets(dict(sizes))
    rank = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    for s in sizes:
        own, upto = sorted((places[i], i) for i in range(len(rows)) if rows[i][2] == s), 0
        for at, (_, i) in enumerate(own):
            upto += size[i]
            runs = min(2, max(1, math.ceil(target[s] / sizes[s]))) if sizes[s] else 1
            queue += [((upto + e * sizes[s]) / target[s] if target[s] else 0.0, rank[s], e, at, i) for e in range(runs)]
    copies, spent = [0] * len(rows), 0
    for *_, i in sorted(queue):
        spent += size[i]
        if spent > total:
            break
        copies[i] += 1
    return copies


def test_mix_takes_what_a_queue_takes(spark):
    """Against a plain queue: ties, empty texts, one very long text, and many equal rows of which some are taken."""
    rows = [(i, " ".join(["w"] * (i * 31 % 40)) or None, "ab"[i % 2] if i % 7 else "hot") for i in range(300)]
    rows += [(1000, " ".join(["w"] * 3000), "b")] + [(2000, "five words are in this", "hot")] * 150 + [(2001, "w w", None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.monotonically_increasing_id()).withColumn("doc", F.lit(1)).withColumn("at", F.lit(2))
    df = df.cache()
    found = df.select("doc_id", "text", "source", F.struct(*mixing.shuffled_place()).alias("p")).collect()
    rows = [(r.doc_id, r.text, r.source) for r in found]
    want = brute_mix(rows, [tuple(r.p) for r in found])
    taken = defaultdict(int)
    for r, n in zip(rows, want, strict=True):
        taken[r] += n
    got = defaultdict(int)
    for r in mixing.mix_plan(df).collect():
        got[r.doc_id, r.source] += r.copies
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns
    counted = {(r.doc_id, r.text, r.source): r["count"] for r in mixed.groupBy("doc_id", "text", "source").count().collect()}
    assert counted == {k: n for k, n in taken.items() if n}
    assert {k: n for k, n in got.items() if n} == {(d, s): n for (d, _, s), n in taken.items() if n}
    assert mixed.groupBy("n").count().agg(F.max("count")).first()[0] <= 2


def test_mix_shares_equal_rows(spark):
    """Half as much again of equal rows: each is taken, and half of them twice."""
    df = spark.range(150).select(F.lit(7).alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), F.col("id").alias("of")).repartition(6)
    counts = [r["count"] for r in mixing.mix_sources(df).groupBy("of").count().collect()]
    assert len(counts) == 150 and sorted(set(counts)) == [1, 2] and sum(counts) == 225


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(empty).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_plan(silent).collect()] == [(0, 0.0, 0)] * 2

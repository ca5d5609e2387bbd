"""Phrases, archives and prefix tries: against plain versions, SQL, and odd tables."""

import collections
import gzip
import hashlib
import io
import json
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellumflow.llm import op11_phrases as P
from vellumflow.llm import op12_warc as W
from vellumflow.llm import op13_prefix_trie as T
from vellumflow.sources.staged import Staging, Written, list_files

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_phrases", "op12_warc", "op13_prefix_trie"])
def test_same_rows_as_sql(spark, name):
    if not os.path.isdir(D):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = entry.queries()[name](spark, D)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


# --- phrases -------------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, top):
    """Phrases of (lang, text) by dictionaries of all contiguous words."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for j in range(i + 1, min(i + 4, len(words)) + 1):
                    counts[lang][tuple(words[i:j])] += 1
    out = set()
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def texts_of_phrases():
    rng = random.Random(5)
    words = ["a", "A", "b", "c", "d", "é", "日", "x\x01", "x", "\x00"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", "!?"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    return [*rows, ("en", None), ("en", ""), (None, " . \t"), ("en", "a b c d " * 400), ("de", "lone")] + [("fr", "always the same words. here")] * 20


def test_phrases_against_dictionaries(spark, monkeypatch):
    rows = texts_of_phrases()
    docs = spark.createDataFrame([(lang, text, "y", 1, 2.0) for lang, text in rows], "lang string, text string, w1 string, depth int, f double").repartition(5)
    for size, least, top in ((1 << 24, 5, 2000), (300, 8, 7)):  # one shard a task, and many
        monkeypatch.setattr(P, "SHARD_BYTES", size)
        got = {tuple(r) for r in P.mine_phrases(docs, least=least, top=top).collect()}
        assert got == plain_phrases(rows, least, top)
    assert P.mine_phrases(docs.limit(0)).count() == 0


def test_phrases_with_large_counts(spark):
    row = spark.createDataFrame([(2**62, [2**62, 2**62 + 3], [2**62 + 1, 2**62])], "a long, l array<long>, r array<long>")
    best = row.select(P.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s
    a = 2**62
    assert (best.score, best.k) == min((2_000_000 * a // (a + a + 1), 1), (2_000_000 * a // (a + 3 + a), 2))


def test_a_long_text_is_cut_between_pieces():
    text = b"one two, three four. " * 50 + b"x" * 400 + b" y"
    parts = list(P.cut_pieces(text, 100))
    assert b"".join(parts) == text and all(p.endswith((b",", b".")) for p in parts[:-2]) and len(parts) > 10
    assert list(P.cut_pieces(b"", 10)) == [b""]


# --- archives ------------------------------------------------------------------------------------------------------------------


def member(kind="response", body=b"hello", **more):
    row = {"record_type": kind, "record_id": "urn:page:1", "date": W.DATE, "uri": "http://x/", "refers_to": "urn:page:0", "payload_digest": hashlib.sha256(body).hexdigest(), "payload_bytes": len(body), "payload": None if kind == "revisit" else body}
    return gzip.compress(W.encode_record(row | more), mtime=0)


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_ranges_own_the_records_that_start_in_them(size):
    rng = random.Random(3)
    bodies = [rng.randbytes(rng.choice([0, 5, 300, 5000])) for _ in range(40)]
    data = b"".join(member(body=b, record_id=f"urn:page:{i}") for i, b in enumerate(bodies))
    file, found = io.BytesIO(data), []
    for begin in range(0, len(data), size) if size > 1 else [*range(0, 3000), 3000]:
        end = min(begin + size, len(data)) if size > 1 and begin < len(data) else (begin + 1 if begin < 3000 else len(data))
        found += [(at, r["record_id"], r["payload"], r["error"]) for at, _, r in W.scan_range(file, begin, end)]
    assert [f[1:] for f in found] == [(f"urn:page:{i}", b, None) for i, b in enumerate(bodies)]


def test_damage_and_false_beginnings(monkeypatch):
    good = [member(body=bytes([65 + i]) * 500, record_id=f"urn:page:{i}") for i in range(4)]
    junk = b"\x1f\x8b\x08 no member" + gzip.compress(b"not a record") + W.MAGIC
    torn = member(body=random.Random(1).randbytes(5000), record_id="urn:page:9")[:-2500]
    data = good[0] + junk + good[1] + torn + good[2] + good[3][:-30]
    for chunk in (16, 1 << 20):
        monkeypatch.setattr(W, "CHUNK", chunk)
        got = [(r["record_id"], r["error"]) for _, _, r in W.scan_range(io.BytesIO(data), 0, len(data))]
        assert [g for g in got if g[1] is None] == [(f"urn:page:{i}", None) for i in range(3)]
        assert all(e in (None, "truncated") for _, e in got) and ("urn:page:9", "truncated") in got


def test_several_records_in_a_member_and_a_nested_archive(spark, tmp_path):
    two = gzip.compress(gzip.decompress(member(record_id="urn:page:1")) + gzip.decompress(member(record_id="urn:page:2", body=b"x")))
    assert [r["record_id"] for _, _, r in W.scan_range(io.BytesIO(two), 0, len(two))] == ["urn:page:1", "urn:page:2"]
    inner = b"".join(member(record_id=f"urn:page:{i}", body=b"in" * 40) for i in range(50, 80))
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = stored.compress(W.encode_record({"record_type": "response", "record_id": "urn:page:3", "date": W.DATE, "uri": None, "refers_to": None, "payload_digest": "", "payload_bytes": len(inner), "payload": inner})) + stored.flush()
    (tmp_path / "a.warc.gz").write_bytes(two + outer + member(record_id="urn:page:4"))
    (tmp_path / "_aside.warc.gz").write_bytes(two)
    read = W.read_warc(spark, str(tmp_path), split_bytes=700)
    assert read.count() > 4  # ranges that begin in the nested archive see its members
    assert sorted(r.record_id for r in W.outermost(read).collect()) == [f"urn:page:{i}" for i in range(1, 5)]


def test_archives_of_odd_pages(spark, tmp_path):
    long, text = "é" * 300_000, "word " * 30
    rows = [(5, "u", text), (3, None, text), (9, "v\r\nWARC-Type: x", text), (None, "u", text), (3, "again", text), (7, "a b", "short"), (8, "a", "short"), (1, "u", None), (2, "u", ""), (4, "u", long), (6, "u", long), (None, "u", long + "x")]
    pages = spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id long, url string, html string, record_id int, word string").repartition(4)
    W.write_warc(pages, str(tmp_path / "w"), file_bytes=300)
    assert len(list_files(str(tmp_path / "w"), ".warc.gz")) > 4 and (tmp_path / "w" / "_SUCCESS").exists() and not list((tmp_path / "w").glob("_staged*"))
    records = W.read_warc(spark, str(tmp_path / "w"), split_bytes=100)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in W.digests(records).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if h == html and j is not None), default=None) if len(data) >= 100 else i
        again = first is not None and first != i
        want.append((f"urn:page:{'' if i is None else i}", "revisit" if again else "response", f"urn:page:{first}" if again else None, len(data), hashlib.sha256(data).hexdigest()))
    assert got == sorted(want, key=repr)
    assert {r.uri for r in records.where("record_id = 'urn:page:9'").collect()} == {"v%0D%0AWARC-Type:%20x"}
    assert [r.payload.decode() for r in records.where("record_id = 'urn:page:4'").collect()] == [long]
    assert records.where("record_id = 'urn:page:3' and uri is null").count() == 1
    W.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert W.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    broken = F.udf(lambda x: 1 // (x - 3) and str(x))
    rows = spark.range(6).repartition(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), broken("id").alias("html"))
    planned = rows.select(F.lit("r").alias("record_id"), F.col("url").alias("uri"), F.lit("").alias("date"), F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), F.lit("").alias("payload_digest"), F.lit(1).cast("long").alias("payload_bytes"), F.col("html").cast("binary").alias("payload"))
    W.register(spark)
    with pytest.raises(Exception, match="ZeroDivision|Writing job|Job aborted"):
        planned.write.format("warc").mode("append").option("path", str(tmp_path)).save()
    assert not list(tmp_path.iterdir())


def test_only_committed_attempts_are_moved(tmp_path):
    job, kept, lost = Staging(str(tmp_path)), Written(), Written()
    for done, data in ((lost, b"half"), (kept, b"whole")):
        with job.create("part-0", done) as out:
            out.write(data)
    assert list_files(str(tmp_path)) == []
    job.commit([kept, None])
    assert (tmp_path / "part-0").read_bytes() == b"whole" and sorted(p.name for p in tmp_path.iterdir()) == ["_SUCCESS", "part-0"]


# --- prefix trie -----------------------------------------------------------------------------------------------------------------


def plain_trie(convs):
    """Nodes of {conv: [(role, text), ...]} by dictionaries of prefixes."""
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    leaves, saved, children = collections.Counter(), collections.Counter(), collections.Counter()
    for p, m in members.items():
        has_child = any(len(convs[c]) > len(p) for c in m)
        for d in range(len(p) + 1):
            leaves[p[:d]] += not has_child
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            children[p[:-1]] += 1
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


FIGURES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_rows():
    rng = random.Random(11)
    rows = []
    for c in [*range(-6, 30), 1000, 1003, 1004]:
        if c in (10, 20):  # absent firsts of five
            continue
        for t in range(rng.choice([1, 2, 3, 12])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["x", "y", "é", "", None, "long " * 20])))
    rows += [(40 + i, t, "user", "same") for i in range(12) for t in range(6)]
    rows += [(60, 1, "a", "bc"), (61, 1, "ab", "c"), (62, 1, "user", "w" * 100_000), (63, 1, "user", "w" * 100_000)]
    rows += [(64, 2, "user", "again")] * 3 + [(None, 1, "user", "nobody's")]
    return rows


def plain_turns(rows):
    def key(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()

    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, key(role or "", text or ""), role or "", text or ""))
    return {c: [r[3:] for r in sorted(turns)] for c, turns in convs.items()}


def test_trie_against_dictionaries(spark):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, pos int, key string").repartition(4)
    convs = plain_turns(rows)
    numbered = T.number_turns(T.digest_turns(table))
    got = {tuple(r) for r in T.build_trie(*T.as_they_are(numbered)).select(*FIGURES).collect()}
    assert got == plain_trie(convs)
    again = {}
    for c, own in convs.items():
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = convs.get(first, [])[:h] + own[h:]
    assert [] in again.values()  # a conversation without turns
    found = T.build_trie(*T.rebuilt(numbered)).select(*FIGURES).collect()
    assert len(found) == len({tuple(r) for r in found}) and {tuple(r) for r in found} == plain_trie(again)


def test_trie_of_none_and_of_one(spark, monkeypatch):
    table = spark.createDataFrame([(7, i, "user", "t") for i in range(25)], "conv_id long, turn int, role string, text string")
    monkeypatch.setattr(T, "STEP", 4)
    one = {tuple(r) for r in T.build_trie(*T.as_they_are(T.number_turns(T.digest_turns(table)))).select(*FIGURES).collect()}
    assert one == plain_trie({7: [("user", "t")] * 25})
    assert T.build_trie(*T.as_they_are(T.number_turns(T.digest_turns(table.limit(0))))).count() == 0


def test_a_long_conversation_is_numbered_by_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    numbered = T.number_turns(T.digest_turns(rows)).where("conv = 1").orderBy("pos").collect()
    want = [hashlib.sha256(f"1:u{i}".encode()).digest() for i in range(3000) if i % 3]
    assert [r.pos for r in numbered] == list(range(1, 2001)) and [bytes(r.key) for r in numbered] == want


def test_ends_that_span_batches(spark):
    import pyarrow as pa

    convs = list(range(1, 40))
    whole = pa.RecordBatch.from_pydict({"depth": [2] * 39, "node": [1] * 30 + [31] * 9, "conv": convs})
    got = [b.to_pylist()[0] for b in T._hash_ends(whole.slice(i, 7) for i in range(0, 39, 7))]
    want = [hashlib.sha256(",".join(map(str, part)).encode()).hexdigest() for part in (convs[:30], convs[30:])]
    assert [g["ends_sha256"] for g in got] == want and json.dumps(got[0]["node"]) == "1"

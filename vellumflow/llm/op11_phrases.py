"""Phrases whose words stand together more often than apart, by count tries.

A shard of texts is counted into a trie of at most ``DEPTH`` words: each level holds the nodes of the next word, sorted by path. Its
nodes are cut by ranges of their prefix, the hash of the language and the first two words, and serialised in order; the runs of a range
from all shards are merged in one task, which adds up equal paths. Levels are counted one after the other and a path enters its
shard's trie only if all its neighbouring pairs, or for pairs both words, may be frequent: a table of bits says so, sized by the
number of frequent ones and let through what it cannot tell, so pruning loses nothing. Every figure that counts is of a path at
least as frequent as a candidate.

In the trie of frequent paths a walk in order gives each node its left parts, which are its ancestors, and its suffix link, the
node of the path without its first word, gives the right parts: that node's own count and, by its links, those of shorter rests.

Defined cases
- null text: empty. Null language: ``und``, counted with a language of that name. Extra columns are ignored, whatever their names.
- words are cut at blanks and tabs, pieces at ``.,;:!?`` and line ends; only A-Z are lower-cased. A text of any length is counted
  whole; one longer than a shard is cut between pieces.
- ties in score and count: by the bytes of the phrase. Repeated rows count each time. An empty table has no phrases.
- counts are 64-bit numbers, scores are worked out in decimals of 38 digits and floored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..sources.tables import read_table
from .bits import bitmap
from .words import column_blocks, hash_words, mix, numbered

#: Words of a phrase at most; occurrences of a candidate at least; share of a longer candidate in a dropped one; phrases of a language.
DEPTH, LEAST, SHARE, TOP = 4, 30, (80, 100), 2000
#: Fixed value: what the ratio of a phrase to its parts is multiplied by.
SCALE = 2_000_000
#: Bytes of text counted into one trie, and of all texts for each range of prefixes.
SHARD_BYTES, RANGE_BYTES = 16 << 20, 16 << 20
#: Bits for each frequent path, and at most: 16 MB as sent to tasks. Beyond that more paths are let through, and none is lost.
BITS_EACH, MOST_BITS = 16, 27
#: Tasks among which a language's phrases are ranked before the first of each are ranked together.
RANKS = 256

WORDS = [f"w{i + 1}" for i in range(DEPTH)]
RUN = "part long, lang string, depth int, run binary"
NODE = f"lang string, depth int, {', '.join(f'{w} string' for w in WORDS)}, f long, code long"

ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]], _KIND[list(ENDS)] = 1, 2
_PAIR, _LANG = np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15


# --- tries of shards -------------------------------------------------------------------------------------------------------


def cut_pieces(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes that begin and end between pieces."""
    while len(text) > size:
        at = max(text.rfind(bytes([c]), 0, size) for c in ENDS)
        if at <= 0:
            at = min((x for c in ENDS if (x := text.find(bytes([c]), size)) >= 0), default=len(text) - 1)
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words in order, word number at each place, whether the next place is in the same piece)."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = _KIND[data]
    inside = np.concatenate(([False], kind == 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return pa.array([], pa.large_binary()), np.empty(0, np.int64), np.empty(0, bool)
    piece = numbered(edges[::2], np.flatnonzero(kind == 2))
    spans = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])  # words and what is between
    coded = spans.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()], np.append(piece[1:] == piece[:-1], False)


def word_codes(words: pa.Array, lang: str) -> np.ndarray:
    """64 bits for each word of a language."""
    if not len(words):
        return np.empty(0, np.uint64)
    own = np.uint64(zlib.crc32(lang.encode()) * _LANG & 0xFFFFFFFFFFFFFFFF)
    return mix(hash_words([b"\n".join(words.to_pylist())])[0] + own)


def pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _PAIR + second)


def may_be_frequent(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the bits of ``codes`` are set in a table made by ``bits.bitmap``."""
    at = codes >> np.uint64(64 - int(math.log2(len(table) * 8)))
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def count_trie(ids: np.ndarray, follows: np.ndarray, n_words: int, depth: int, allowed: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels 1 to ``depth`` of a trie: (parent's number, word, count) of the nodes in order of their paths.

    ``allowed`` says at which places a path may take one more step; None for wherever a word follows in the piece.
    """
    step = follows if allowed is None else follows & allowed
    counts = np.bincount(ids, minlength=n_words)
    levels = [(np.zeros(n_words, np.int64), np.arange(n_words), counts)]
    at = np.arange(len(ids))
    node = ids
    for level in range(1, depth):
        on = step[at + level - 1]  # places whose path goes on
        at = at[on]
        keys, node, counts = np.unique(node[on] * n_words + ids[at + level], return_inverse=True, return_counts=True)
        levels.append((keys // n_words, keys % n_words, counts))
    return levels


def paths(levels: list, level: int) -> list[np.ndarray]:
    """Word numbers of the nodes of ``level`` (from 0), a column for each place."""
    node, columns = np.arange(len(levels[level][1])), []
    for parents, words, _ in reversed(levels[: level + 1]):
        columns.append(words[node])
        node = parents[node]
    return columns[::-1]


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def shard_runs(texts: list[bytes], lang: str, low: int, high: int, table: np.ndarray | None, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``RUN``: nodes of depth ``low`` to ``high`` of the texts' trie, sorted by path in each range of prefixes."""
    words, ids, follows = tokens(texts)
    if not len(ids):
        return
    codes, allowed = word_codes(words, lang), None
    if high == 2:
        frequent = may_be_frequent(codes, table)[ids]
        allowed = np.append(frequent[:-1] & frequent[1:], False)
    elif high > 2:
        allowed = np.append(may_be_frequent(pair_codes(codes[ids[:-1]], codes[ids[1:]]), table), False)
    levels = count_trie(ids, follows, len(words), high, allowed)
    words = words.cast(pa.binary())
    for level in range(low - 1, high):
        columns, counts = paths(levels, level), levels[level][2]
        prefix = codes[columns[0]] if level == 0 else pair_codes(codes[columns[0]], codes[columns[1]])
        part = ((prefix >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            here = order[cuts[k] : cuts[k + 1]]
            run = pa.table({w: words.take(pa.array(c[here])) for w, c in zip(WORDS, columns, strict=False)} | {"f": pa.array(counts[here], pa.int64())})
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64()), "lang": [lang], "depth": pa.array([level + 1], pa.int32()), "run": [_pack(run)]})


def _by_shard(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of about ``size`` bytes at most."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        kinds = coded.indices.to_numpy()
        for k, lang in enumerate(coded.dictionary.to_pylist()):
            for _, texts in column_blocks(batch.column(1), at=np.flatnonzero(kinds == k)):
                for text in texts:
                    for part in cut_pieces(text, size):
                        held.setdefault(lang, []).append(part)
                        total += len(part) + 1
                        if total >= size:
                            yield from held.items()
                            held, total = {}, 0
    yield from held.items()


def shard_tries(texts: DataFrame, low: int, high: int, parts: int, table: Broadcast | None = None) -> DataFrame:
    """Rows of ``RUN`` for (lang, text as bytes)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _by_shard(batches, SHARD_BYTES):
            yield from shard_runs(held, lang, low, high, None if table is None else table.value, parts)

    return texts.mapInArrow(count, RUN)


# --- merging -----------------------------------------------------------------------------------------------------------------


def merge_runs(runs: list[bytes], depth: int) -> tuple[list[pa.Array], np.ndarray]:
    """(words by place, counts) of the distinct paths of sorted runs, in order; equal paths are added up."""
    table = pa.concat_tables(pa.ipc.open_stream(r).read_all() for r in runs)
    coded = pa.chunked_array([c for w in WORDS[:depth] for c in table[w].chunks]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    columns = rank[coded.indices.to_numpy()].reshape(depth, len(table))
    key = columns[0]
    for c in columns[1:]:
        key = key * len(order) + c if len(order) * (int(key.max(initial=0)) + 1) < 1 << 62 else np.unique(key, return_inverse=True)[1] * len(order) + c
    at = np.argsort(key, kind="stable")  # runs are sorted, and a stable sort merges what is
    key = key[at]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.add.reduceat(table["f"].to_numpy()[at], first)
    words = coded.dictionary.take(pa.array(order))
    return [words.take(pa.array(c[at[first]])) for c in columns], counts


def merge_tries(runs: DataFrame, least: int) -> DataFrame:
    """Rows of ``NODE`` with ``least`` occurrences, and the root of each range: depth 0, with the sum of its words' counts.

    ``code`` is that of a word or pair for the table of bits, 0 for other nodes.
    """
    def merge(table: pa.Table) -> pa.Table:
        out = []
        groups = sorted(set(zip(table["lang"].to_pylist(), table["depth"].to_pylist(), strict=True)))
        for lang, depth in groups:
            mine = table.filter(pc.and_(pc.equal(table["lang"], lang), pc.equal(table["depth"], depth)))
            columns, counts = merge_runs(mine["run"].to_pylist(), depth)
            keep = np.flatnonzero(counts >= least)
            kept = [c.take(pa.array(keep)) for c in columns]
            codes = np.zeros(len(keep), np.uint64)
            if depth <= 2 and len(keep):
                each = [word_codes(c, lang) for c in kept]
                codes = each[0] if depth == 1 else pair_codes(*each)
            n = len(keep) + (depth == 1)
            full = [c.cast(pa.string()).to_pylist() for c in kept] + [[""] * len(keep)] * (DEPTH - depth)
            root = [""] if depth == 1 else []
            out.append(
                pa.table(
                    {"lang": pa.array([lang] * n, pa.string()), "depth": pa.array([depth] * len(keep) + [0] * len(root), pa.int32())}
                    | {w: pa.array(c + root, pa.string()) for w, c in zip(WORDS, full, strict=True)}
                    | {"f": pa.array([*counts[keep].tolist(), *([int(counts.sum())] if root else [])], pa.int64()), "code": pa.array([*codes.view(np.int64).tolist(), *([0] if root else [])], pa.int64())}
                )
            )
        return pa.concat_tables(out)

    return runs.groupBy("part").applyInArrow(merge, NODE)


def frequent_nodes(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals): rows of ``NODE`` with ``least`` occurrences, and (lang, n) with the occurrences of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    found, table, totals = [], None, None
    for low, high in ((1, 1), (2, 2), (3, DEPTH)):
        runs = shard_tries(texts, low, high, parts, table)
        nodes = materialize(merge_tries(runs, least), f"phrases-{high}")
        if low == 1:
            totals = nodes.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
            nodes = nodes.where("depth = 1")
        found.append(nodes)
        if high < DEPTH:
            bits = min(MOST_BITS, max(16, math.ceil(math.log2(BITS_EACH * (nodes.count() + 1)))))
            table = spark.sparkContext.broadcast(bitmap(nodes, "code", bits))
    return found[0].unionByName(found[1]).unionByName(found[2]), totals


# --- parts -------------------------------------------------------------------------------------------------------------------


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add left, the counts of a node's ancestors from depth 2 on, to nodes in order of their paths."""
    stack: list[tuple[tuple, int]] = []
    for batch in batches:
        names, out = batch.schema.names, []
        columns = [batch.column(names.index(c)).to_pylist() for c in ("lang", *WORDS)]
        for path, depth, f in zip(zip(*columns, strict=True), batch.column(names.index("depth")).to_pylist(), batch.column(names.index("f")).to_pylist(), strict=True):
            own = path[: depth + 1]
            while stack and stack[-1][0] != own[: len(stack[-1][0])]:
                stack.pop()
            out.append([count for _, count in stack])
            stack.append((own, f))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*names, "left"])


def with_parts(nodes: DataFrame) -> DataFrame:
    """lang, w1 to w4, depth, a, left, right: counts of a phrase's first k words and of the rest, for k = 1, 2, ..."""
    single = nodes.where("depth = 1").select("lang", F.col("w1").alias("word"), F.col("f").alias("count"))
    longer = nodes.where("depth > 1").select("lang", *WORDS, "depth", "f")
    # A subtree below two words is walked in one task; its root's parent, of which there may be a hot one, comes by a join.
    walked = longer.repartition("lang", "w1", "w2").sortWithinPartitions("lang", *WORDS)
    walked = walked.mapInArrow(_walk, f"lang string, {', '.join(f'{w} string' for w in WORDS)}, depth int, f long, left array<long>")
    walked = walked.join(single.withColumnRenamed("word", "w1"), ["lang", "w1"]).withColumn("left", F.concat(F.array("count"), "left")).drop("count")
    walked = materialize(walked, "phrases-left")
    # Suffix links, by depth: the node that a path without its first word leads to, and the right parts of that one.
    linked = single.select("lang", F.col("word").alias("w1"), *(F.lit("").alias(w) for w in WORDS[1:]), F.col("count").alias("f"), F.array().cast("array<long>").alias("right"))
    out = []
    for depth in range(2, DEPTH + 1):
        target = linked.select("lang", *(F.col(a).alias(b) for a, b in zip(WORDS[: depth - 1], WORDS[1:depth], strict=True)), F.concat(F.array("f"), "right").alias("right"))
        linked = materialize(walked.where(F.col("depth") == depth).join(target, ["lang", *WORDS[1:depth]]), f"phrases-right-{depth}")
        out.append(linked)
    whole = out[0]
    for level in out[1:]:
        whole = whole.unionByName(level)
    return whole.withColumnRenamed("f", "a")


def score(a: Column, left: Column, right: Column) -> Column:
    """Struct (score, k, l, r) of the cut with the lowest score, the first of them."""
    parts = F.arrays_zip(F.sequence(F.lit(1), F.size(left)).alias("k"), left.alias("l"), right.alias("r"))

    def cut(p: Column) -> Column:
        both = (p["l"].cast("decimal(20,0)") + p["r"].cast("decimal(20,0)")).cast("decimal(38,0)")
        value = F.call_function("div", (a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(18,0)")).cast("decimal(38,0)"), both)
        return F.struct(value.alias("score"), p["k"].alias("k"), p["l"].alias("l"), p["r"].alias("r"))

    return F.array_min(F.transform(parts, cut))


def outside_longer(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one holds in nearly as many places."""
    share, whole = SHARE
    shorter = []
    for depth in range(3, DEPTH + 1):
        for size in range(2, depth):
            for at in range(depth - size + 1):
                row = [F.col(WORDS[at + i]) if i < size else F.lit("") for i in range(DEPTH)]
                shorter.append(F.when(F.col("depth") == depth, F.struct(*(c.alias(w) for c, w in zip(row, WORDS, strict=True)))))
    inside = phrases.where("depth > 2").select("lang", "a", F.explode(F.array(*shorter)).alias("p")).where("p is not null")
    most = inside.groupBy("lang", *(F.col(f"p.{w}").alias(w) for w in WORDS)).agg(F.max("a").alias("most"))
    met = phrases.join(most, ["lang", *WORDS], "left")
    held = F.lit(whole).cast("decimal(18,0)") * F.col("most").cast("decimal(20,0)") >= F.lit(share).cast("decimal(18,0)") * F.col("a").cast("decimal(20,0)")
    return met.where(F.col("most").isNull() | ~held).drop("most")


def mine_phrases(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    nodes, totals = frequent_nodes(docs, lang=lang, text=text, least=least)
    phrases = outside_longer(with_parts(nodes))
    phrases = phrases.withColumn("best", score(F.col("a"), F.col("left"), F.col("right")))
    phrase = F.array_join(F.filter(F.array(*WORDS), lambda w: w != ""), " ")
    rows = phrases.select("lang", phrase.alias("phrase"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = F.row_number().over(Window.partitionBy("lang", "_task").orderBy(*order))
    rows = rows.withColumn("_task", F.pmod(F.xxhash64("phrase"), F.lit(RANKS))).withColumn("_near", near).where(F.col("_near") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(read_table(spark, sf_dir, "documents"))


SQL = rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT row_number() OVER () AS piece, lang, list_filter(string_split_regex(text, '[ \t]+'), lambda w: w <> '') AS words
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\f\r]')) AS text FROM texts)
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), places AS (
  SELECT lang, piece, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS place FROM pieces
), starts AS (
  SELECT lang, w, {", ".join(f"lead(w, {k}) OVER p AS w{k}" for k in range(1, DEPTH))} FROM places WINDOW p AS (PARTITION BY piece ORDER BY place)
), counted AS (
  {" UNION ALL ".join(f"SELECT lang, {' || chr(32) || '.join(['w', *(f'w{k}' for k in range(1, size))])} AS phrase, {size} AS size, count(*) AS f FROM starts GROUP BY ALL HAVING phrase IS NOT NULL AND f >= {LEAST}" for size in range(1, DEPTH + 1))}
), halves AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counted WHERE size > 1)
), scored AS (
  SELECT h.lang, h.phrase, a, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * a // (l.f + r.f))::BIGINT AS score
  FROM halves h JOIN counted l ON l.lang = h.lang AND l.phrase = h.head JOIN counted r ON r.lang = h.lang AND r.phrase = h.rest
  QUALIFY row_number() OVER (PARTITION BY h.lang, h.phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:j], ' ') AS phrase
  FROM (SELECT *, unnest(range(i + 1, size + 1)) AS j FROM (SELECT *, unnest(range(1, size)) AS i FROM counted WHERE size > 2)) WHERE j - i + 1 < size
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN (SELECT lang, phrase, max(f) AS most FROM parts GROUP BY ALL) m ON m.lang = s.lang AND m.phrase = s.phrase
  WHERE most IS NULL OR {SHARE[1]}::HUGEINT * most < {SHARE[0]}::HUGEINT * a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""

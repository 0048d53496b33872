"""Operator 13: a prefix trie over conversations, from padded matrices of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadveil.llm.common import staged

WORDS = r"[^\x20\x09-\x0D]+"
FAMILY = 20
#: cells (conversations x ids of the longest) of a block
CELLS = 1 << 20
NONE = hashlib.sha256(b"").hexdigest()
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
#: nodes of a block; those on its first or last conversation's path have a ``key``, as other blocks may hold them too, and their
#: ``ends`` as a text. The last row of a task holds the two paths' keys and the words so far along the first.
PARTS = "key binary, depth long, conv_id long, parent_key binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, block long, first array<binary>, words array<long>, last array<binary>"


def rebuilt(conversations: DataFrame, shared: Column | None = None) -> DataFrame:
    """``(conv_id, path array<long>, words array<int>)``: two ids of 64 bits a turn, and the words of its text.

    A conversation c begins with the first ``shared`` turns (0 to 3; crc32 of its number, modulo 4) of conversation c - c % 20
    and goes on with its own behind them. One shuffle: the twenty of a family meet, as compact turns without their texts. Of
    turns with the same number the one with the smaller id comes first. Rows without conv_id take no part.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(conversations["turn"].isNotNull().alias("known"), conversations["turn"].cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit("turn"), role).alias("b"), F.regexp_count(text, F.lit(WORDS)).alias("w"))
    turns = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), turn.alias("t")).filter("conv_id IS NOT NULL")
    turns = turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("family")
    own = turns.groupBy("family", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, 3))).over(Window.partitionBy("family"))
    count = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)).cast("int") if shared is None else shared
    whole = own.withColumns({"head": F.coalesce(head, F.array().cast(own.schema["own"].dataType)), "h": count})
    turns = whole.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own"))).alias("t"))
    return turns.select("conv_id", F.flatten(F.transform("t", lambda t: F.array(t["a"], t["b"]))).alias("path"), F.transform("t", lambda t: t["w"].cast("int")).alias("words"))


def keys_of(path: np.ndarray) -> list[bytes]:
    """For every depth, from 0, what the node is known by."""
    sink, keys = hashlib.blake2b(digest_size=16), []
    keys.append(sink.digest())
    for turn in np.ascontiguousarray(path, "<i8").reshape(-1, 2):
        sink.update(turn.tobytes())
        keys.append(sink.digest())
    return keys


def block_nodes(convs: np.ndarray, lengths: np.ndarray, paths: np.ndarray, words: np.ndarray, ahead: int, behind: int):
    """The nodes of a block of conversations.

    ``paths`` and ``words`` have the turns of all, one conversation after the other. Padded to matrices and sorted, a node of
    depth d is a run of rows; it begins where any of the columns before d changes, so the columns' masks are or-ed from left
    to right. Every figure is a sum over a run: a row brings a leaf if the next row does not go on from it, a child where one
    begins, and, for every turn that it shares with the row before it, the turn's words. ``ahead``, ``behind``: how many turns the
    first row shares with the one before the block, the last with the one behind it. Returns the columns of ``PARTS`` up to
    ``ends``, the first row's keys and words, the last row's keys.
    """
    n, deep = len(convs), int(lengths.max(initial=0))
    ids, own = np.zeros((n, 2 * deep), np.int64), np.zeros((n, deep + 1), np.int64)
    rows = np.repeat(np.arange(n), lengths)
    at = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ids[rows, 2 * at], ids[rows, 2 * at + 1] = paths[::2], paths[1::2]
    own[rows, at + 1] = words
    # shorter first: a padded column counts by whether the turn is there, then by its ids
    there = lengths[:, None] > np.arange(deep)
    order = np.lexsort((convs, *(key for d in range(deep - 1, -1, -1) for key in (ids[:, 2 * d + 1], ids[:, 2 * d], there[:, d]))))
    convs, lengths, ids, own, there = convs[order], lengths[order], ids[order], own[order], there[order]
    change = np.ones((n, deep), bool)
    change[1:] = (ids[1:, ::2] != ids[:-1, ::2]) | (ids[1:, 1::2] != ids[:-1, 1::2]) | (there[1:] != there[:-1])
    begins = np.logical_or.accumulate(change, axis=1) & there
    fresh = begins.copy()
    fresh[0, :ahead] = False
    alike = np.append((there[:-1] & there[1:] & ~np.logical_or.accumulate(change[1:], axis=1)).sum(1), behind)
    leaf = (alike < lengths).astype(np.int64)
    # words shared with the row before, of depth d and more
    saved = np.zeros((n, deep + 2), np.int64)
    saved[:, 1 : deep + 1] = own[:, 1:] * (there & ~fresh)
    saved = np.cumsum(saved[:, ::-1], axis=1)[:, ::-1]
    first, last = keys_of(ids[0, : 2 * lengths[0]]), keys_of(ids[-1, : 2 * lengths[-1]])
    out: list[list] = []
    parent_of = np.zeros(n, np.int64)
    for d in range(deep + 1):
        inside = lengths >= d
        starts = np.flatnonzero(begins[:, d - 1]) if d else np.zeros(1, np.int64)
        least = np.minimum.reduceat(np.where(inside, convs, np.iinfo(np.int64).max), starts)
        child = fresh[:, d].astype(np.int64) if d < deep else np.zeros(n, np.int64)
        figures = [np.add.reduceat(np.where(inside, x, 0), starts) for x in (np.ones(n, np.int64), child, leaf, saved[:, d])]
        ended = np.flatnonzero(lengths == d)
        node = np.searchsorted(starts, ended, "right") - 1
        ends = runs(convs[ended], node)
        opened = {}
        if lengths[0] >= d:
            opened[0] = first[d]
        if lengths[-1] >= d:
            opened[len(starts) - 1] = last[d]
        parents = parent_of[starts]
        for k in range(len(starts)):
            key, text = opened.get(k), ends.get(k, "")
            up = None if not d else first[d - 1] if parents[k] == 0 and lengths[0] >= d - 1 else last[d - 1] if parents[k] == parent_count - 1 and lengths[-1] >= d - 1 else None
            sha = None if key else (hashlib.sha256(text.encode()).hexdigest() if text else NONE)
            out.append([key, d, int(least[k]), up, int(parent_least[parents[k]]) if d and up is None else None, *(int(x[k]) for x in figures), sha, text if key else None])
        parent_of, parent_least, parent_count = np.searchsorted(starts, np.arange(n), "right") - 1, least, len(starts)
    return out, first, np.concatenate([[0], np.cumsum(own[0, 1 : lengths[0] + 1])]).tolist(), last


def runs(convs: np.ndarray, node: np.ndarray) -> dict[int, str]:
    cut = np.flatnonzero(np.diff(node)) + 1
    return {int(k): ",".join(map(str, part.tolist())) for k, part in zip(node[np.concatenate([[0], cut])], np.split(convs, cut), strict=True)} if len(node) else {}


def shared_turns(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b)) // 2
    same = (a[: 2 * n].reshape(-1, 2) == b[: 2 * n].reshape(-1, 2)).all(1)
    return int(n if same.all() else same.argmin())


def blocks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple]:
    """The sorted rows of a task in blocks of ``cells`` at most (one conversation at least)."""
    held: list[tuple] = []
    widest = 0
    for b in batches:
        if not b.num_rows:
            continue
        lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        convs, paths, words = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        begin = 0
        while begin < len(convs):
            n = sum(len(x[0]) for x in held)
            wide = np.maximum(np.maximum.accumulate(2 * lengths[begin:] + 1), widest)
            fits = int(np.count_nonzero(wide * (n + np.arange(1, len(wide) + 1)) <= cells))
            if not fits and not n:
                fits = 1
            if fits:
                end = begin + fits
                held.append((convs[begin:end], lengths[begin:end], paths[2 * ends[begin] : 2 * ends[end]], words[ends[begin] : ends[end]]))
                widest, begin = int(wide[fits - 1]), end
            if begin < len(convs):
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, widest = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def nodes_of(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    names = [p.split()[0] for p in PARTS.split(", ")]
    longs = {"depth", "conv_id", "parent_conv_id", "block", *SUMS}
    kinds = [pa.int64() if c in longs else pa.binary() if c.endswith("key") else pa.list_(pa.binary()) if c in ("first", "last") else pa.list_(pa.int64()) if c == "words" else pa.string() for c in names]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    first = words = last = held = None
    ahead = 0
    for block in blocks(batches, cells):
        if held is not None:
            behind = shared_turns(held[2][len(held[2]) - 2 * held[1][-1] :], block[2][: 2 * block[1][0]])
            rows, head, along, last = block_nodes(*held, ahead, behind)
            first, words, ahead = first or head, words or along, behind
            yield from tell(rows, number, batch)
            number += 1
        held = block
    if held is not None:
        rows, head, along, last = block_nodes(*held, ahead, 0)
        yield from tell(rows, number, batch)
        yield batch([[None] * 11 + [number, first or head, words or along, last]])


def tell(rows: list[list], number: int, batch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        yield batch([[*r, number, None, None, None] for r in rows[at : at + 10_000]])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of texts that come in pieces, sorted: a piece at a time, so a node's whole list is nowhere."""
    key = sink = None

    def told():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sink.hexdigest()])], names=["key", "ends_sha256"])

    for b in batches:
        for k, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != key:
                if sink:
                    yield told()
                key, sink = k, hashlib.sha256()
                sink.update(piece.encode())
            else:
                sink.update(b"," + piece.encode())
    if sink:
        yield told()


def trie(spark: SparkSession, paths: DataFrame, cells: int = CELLS) -> DataFrame:
    """``paths(conv_id, path, words)`` -> one row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Conversations are dealt by ranges of their whole path and number, so a group of copies of any size is spread over shards; each
    shard is worked off in blocks. Only nodes on a block's first or last path can lie in two, and their figures are summed by key.
    What a task cannot know, how much its first conversation shares with the last of the task before it, is added afterwards.
    """
    parts = staged(spark, paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(lambda b: nodes_of(b, cells), PARTS), "trie")
    # one row a task: what it shares with its neighbours
    edge = parts.filter("depth IS NULL").select("block", "first", "words", "last")
    order = Window.orderBy("block")
    met = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: s)) - 1
    joint = edge.withColumns({"prior": F.lag("last").over(order), "next": F.lead("first").over(order)})
    joint = joint.withColumns({"shared": met(F.col("prior"), F.col("first")), "ahead": met(F.col("last"), F.col("next"))})
    begun = joint.filter("prior IS NOT NULL").select("words", "shared", F.posexplode("first").alias("depth", "key")).filter("depth <= shared")
    begun = begun.select("key", F.when(F.col("depth") < F.col("shared"), -1).otherwise(0).cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), (F.col("words")[F.col("shared")] - F.col("words")[F.greatest(F.col("depth") - 1, F.lit(0))]).alias("saved_tokens"))
    ended = joint.filter("next IS NOT NULL AND size(last) > 1 AND ahead >= size(last) - 1").select(F.explode("last").alias("key"))
    ended = ended.select("key", F.lit(0).cast("long").alias("n_children"), F.lit(-1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    mended = begun.unionByName(ended).withColumns({c: F.lit(None).cast(t) for c, t in (("depth", "long"), ("conv_id", "long"), ("parent_key", "binary"))} | {"n_convs": F.lit(0).cast("long")})
    several = parts.filter("key IS NOT NULL")
    summed = several.select(*mended.columns).unionByName(mended).groupBy("key").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in SUMS])
    pieces = several.filter("ends <> ''").select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block")
    whole = summed.join(pieces.mapInArrow(hashed, "key binary, ends_sha256 string"), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
    whole = staged(spark, whole, "trie-joints")
    figures = ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    inner = parts.filter("key IS NULL AND depth IS NOT NULL")
    known = inner.filter("parent_key IS NULL").select("conv_id", *figures)
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    below = inner.filter("parent_key IS NOT NULL").drop("parent_conv_id").select("conv_id", "parent_key", *[c for c in figures if c != "parent_conv_id"])
    below = below.unionByName(whole.filter("depth > 0").select(*below.columns)).join(parents, "parent_key").select("conv_id", *figures)
    top = whole.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "n_leaves": F.greatest("n_leaves", F.lit(1).cast("long"))}).select("conv_id", *figures)
    return known.unionByName(below).unionByName(top)


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> a row a node of the trie of rebuilt conversations.

    Null role or text is empty, a null turn comes first, rows without conv_id take no part, repeated rows are repeated turns (of equal
    turn numbers the order is that of the turns' ids), an empty table has no node, a conversation left without turns ends at the root, further
    columns are ignored. Texts of any length enter as ids and counts; turns are the same if their ids of 128 bits are. One conversation's ids
    are a row, 16 bytes a turn. A node's list of ends has one order and one hash, so it is read by one task, a piece at a time.
    """
    return trie(spark, rebuilt(conversations))


def oracle_sql() -> str:
    """The same trie by lists of turns; crc32 bit by bit."""
    return """
      WITH turns AS MATERIALIZED (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        heads AS MATERIALIZED (SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
            lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, i: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))) AS crc FROM turns),
        whole AS MATERIALIZED (SELECT c.conv_id, coalesce(r.own, [])[1 : CAST(xor(crc, 4294967295::UBIGINT) % 4 AS BIGINT)] || c.own[CAST(xor(crc, 4294967295::UBIGINT) % 4 AS BIGINT) + 1 :] AS path
          FROM heads c LEFT JOIN turns r ON r.conv_id = c.conv_id - c.conv_id % 20),
        steps AS MATERIALIZED (SELECT conv_id, len(path) AS size, d AS depth, path[1 : d] AS node, CASE WHEN d > 0 THEN path[1 : d - 1] END AS up FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM whole)),
        nodes AS MATERIALIZED (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM steps GROUP BY depth, node),
        kids AS MATERIALIZED (SELECT up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
        known AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(node[-1].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved FROM nodes n LEFT JOIN kids k ON k.up = n.node),
        below AS (SELECT node[1 : a] AS top, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS a FROM known) GROUP BY 1)
      SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
      FROM known n JOIN below b ON b.top = n.node LEFT JOIN known p ON n.depth > 0 AND p.node = n.up"""

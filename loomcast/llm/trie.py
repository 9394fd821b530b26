"""Prefix trie of conversations by partition refinement.

All conversations start in one class, the root.  A turn splits each class by who says what there; a conversation alone in
its class is retired, as the rest of it is a chain of nodes without branches, which its own rows yield.  Only conversations
that still share a class are looked at again, over twice as many turns as the time before.  A class is named by the digest
of its parent's name and the turn, so the turns of a round split one after the other within a conversation, and classes of
any size are counted before a shuffle.  At the end the sums of subtrees are folded back: what a node adds is laid to its
smallest member, summed from the last turn to the first, and then over the members of each class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm.common import join_hot, scratch, stored, whole_key
from loomcast.operators.ranges import Ranges

WORD = r"[^\x20\x09-\x0D]+"
WIDEST = 64  # turns that a round splits by, at most
CHUNK = 1 << 16  # bytes of joined ids that travel as one row
NOTHING = hashlib.sha256(b"").hexdigest()


def sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ordered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, and words of the text; a conversation may hold any share of the rows."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.select(whole_key(df, conv).alias("conv_id"), F.col(turn).alias("turn"), sha(F.octet_length(who).cast("string").cast("binary"), F.lit(":").cast("binary"), who.cast("binary"), said.cast("binary")).alias("digest"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"))
    return Ranges(rows.where("conv_id IS NOT NULL"), ["conv_id"], ["turn", "digest"]).ranked("pos").drop("turn")


def led_by_bases(turns: DataFrame, put, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The conversations rebuilt: the first h turns of conversation c - c % every, then c's own turns after its first h,
    where h is the unsigned crc32 of c as decimal text, modulo `most`.  (conv_id, depth from 1, digest, words), and
    (conv_id, n_turns) for every conversation."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("lead"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    facts = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(heads, "base", "left")
    lead = F.slice(F.coalesce("lead", F.array().cast(heads.schema["lead"].dataType)), F.lit(1), F.col("h"))
    facts = put(facts.select("conv_id", "own", "h", lead.alias("lead")))
    led = facts.select("conv_id", F.posexplode("lead").alias("k", "t")).select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), "t.digest", "t.words")
    own = join_hot(turns, facts.select("conv_id", "own", "h", F.size("lead").alias("b")), ["conv_id"], "own").where("pos >= h")
    own = own.select("conv_id", (F.col("b") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "words")
    return put(led.unionByName(own)), facts.select("conv_id", (F.size("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))


def split(rest: DataFrame, active: DataFrame, upto: int) -> DataFrame:
    """conv_id, depth, label, parent, words: the classes of active conversations at each depth to upto."""
    listed = rest.where(F.col("depth") <= upto).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns")).join(active, "conv_id")
    names = F.aggregate("turns", F.array("label"), lambda done, t: F.concat(done, F.array(sha(F.element_at(done, -1), t["digest"]))))
    each = listed.select("conv_id", "turns", names.alias("names")).select("conv_id", "names", F.posexplode("turns").alias("k", "t"))
    return each.select("conv_id", "t.depth", F.col("names")[F.col("k") + 1].alias("label"), F.col("names")[F.col("k")].alias("parent"), "t.words")


def joined_ids(ids: DataFrame) -> DataFrame:
    """label, ends_sha256: the SHA-256 of the decimal conv_ids of each label, ascending, joined by commas.

    Sorted range partitions join their ids to chunks; the chunks of a label, far fewer than its ids, are then hashed one
    after the other, without being held together.
    """
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        label = first = None
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([label], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held).encode()], pa.binary())], ["label", "first", "ids"])

        for batch in batches:
            for mark, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (mark != label or size > CHUNK):
                    yield row()
                    held, size = [], 0
                if not held:
                    label, first = mark, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = state = None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for mark, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and mark == label:
                    state.update(b"," + part)
                    continue
                if state is not None:
                    done.append((label, state.hexdigest()))
                label, state = mark, hashlib.sha256(part)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["label", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["label", "ends_sha256"])

    parts = ids.select("label", "conv_id").repartitionByRange(n, "label", "conv_id").sortWithinPartitions("label", "conv_id").mapInArrow(chunks, "label binary, first long, ids binary")
    return parts.repartition("label").sortWithinPartitions("label", "first").mapInArrow(digest, "label binary, ends_sha256 string")


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuilt: bool = True) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text), from the root without any; its members are the conversations
    that begin with it, and conv_id is the smallest.  Turns come in the order of `turn`, null first; those with equal turns
    in an order that their content fixes.  A null role or text is an empty one.  Rows with a null conv_id are left out;
    repeated rows are turns of their own.  An empty table has no nodes.  n_leaves counts the nodes without children in the
    subtree; saved_tokens sums (n_convs - 1) times the words of the last text over it; ends_sha256 hashes the members that
    end there.  With `rebuilt` the conversations are first led by the turns of others (led_by_bases).
    """
    root, digests = F.lit(b""), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    with scratch(df.sparkSession) as put:
        turns = put(ordered_turns(df, conv, turn, role, text))
        if rebuilt:
            turns, convs = led_by_bases(turns, put)
        else:
            turns, convs = put(turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "words")), turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
        convs = put(convs)
        active = convs.select("conv_id", root.alias("label"))
        top = convs.groupBy().agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).where("n > 0")
        nodes = [top.select(root.alias("label"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n", "rep")]
        shared = [active.select("conv_id", F.lit(0).cast("long").alias("depth"), "label")]
        retired, rest, upto, width = [], turns, 0, 1
        while rest.first() is not None:
            upto += width
            rows = put(split(rest, active, upto))
            classes = put(rows.groupBy("label").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words")))
            marked = put(join_hot(rows.select("conv_id", "depth", "label", "parent"), classes.select("label", "n"), ["label"], "n"))
            nodes.append(classes.where("n > 1").select("label", "parent", "depth", "words", "n", "rep"))
            shared.append(marked.where("n > 1").select("conv_id", "depth", "label"))
            retired.append(marked.where("n = 1").groupBy("conv_id").agg(F.min("depth").alias("since"), F.min_by("parent", "depth").alias("label")))
            active = marked.where((F.col("n") > 1) & (F.col("depth") == upto)).select("conv_id", "label")
            rest = put(rest.where(F.col("depth") > upto).join(active.select("conv_id"), "conv_id", "left_semi"))
            width = min(2 * width, WIDEST)
        nodes, shared = put(reduce(DataFrame.unionByName, nodes)), put(reduce(DataFrame.unionByName, shared))
        alone = put(reduce(DataFrame.unionByName, retired) if retired else turns.select("conv_id", F.col("depth").alias("since"), F.col("digest").alias("label")).limit(0))
        children = nodes.where("depth > 0").groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("inner"), F.lit(0).cast("long").alias("outer"))
        children = children.unionByName(alone.groupBy("label").agg(F.lit(0).cast("long").alias("inner"), F.count("*").alias("outer")))
        children = put(nodes.select("label", "rep").join(children.groupBy("label").agg(F.sum("inner").alias("inner"), F.sum("outer").alias("outer")), "label", "left").fillna(0, ["inner", "outer"]))
        # What each node adds, at its smallest member; a retired conversation adds a leaf to every class that it was in.
        adds = nodes.join(children.select("label", (F.col("inner") + F.col("outer") == 0).cast("long").alias("leaf")), "label").select(F.col("rep").alias("conv_id"), "depth", "leaf", ((F.col("n") - 1) * F.col("words")).alias("saved"))
        block = F.floor(F.col("depth") / WIDEST).alias("block")
        each = put(shared.join(adds, ["conv_id", "depth"], "left").select("conv_id", "depth", "label", block, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("leaf", "saved"))))
        later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        blocks = each.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("leaf", "saved")))
        within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        folded = each.select("conv_id", "block", "label", *(F.sum(c).over(within).alias(c) for c in ("leaf", "saved"))).join(blocks, ["conv_id", "block"])
        folded = folded.join(alone.select("conv_id", F.lit(1).cast("long").alias("tail")), "conv_id", "left")
        sums = folded.groupBy("label").agg(F.sum(F.col("leaf") + F.col("leaf_later") + F.coalesce("tail", F.lit(0))).alias("n_leaves"), F.sum(F.col("saved") + F.col("saved_later")).alias("saved_tokens"))
        ends = joined_ids(shared.join(convs, "conv_id").where("depth = n_turns"))
        above = put(children.select(F.col("label").alias("parent"), F.col("rep").alias("parent_conv_id"), "inner", "outer"))
        below = join_hot(nodes.where("depth > 0"), above.where("inner > 0").select("parent", "parent_conv_id", "inner"), ["parent"], "inner").drop("inner")
        inner = below.select("label", "depth", "n", "rep", "parent_conv_id").unionByName(nodes.where("depth = 0").select("label", "depth", "n", "rep", F.lit(None).cast("long").alias("parent_conv_id")))
        inner = inner.join(children.select("label", (F.col("inner") + F.col("outer")).alias("n_children")), "label").join(sums, "label").join(ends, "label", "left")
        inner = inner.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
        begun = join_hot(alone, above.where("outer > 0").select(F.col("parent").alias("label"), "parent_conv_id", "outer"), ["label"], "outer")
        begun = put(begun.join(convs, "conv_id").select("conv_id", "since", "parent_conv_id", "n_turns"))
        chains = join_hot(turns.select("conv_id", "depth"), begun, ["conv_id"], "n_turns").where("depth >= since")
        first, last = F.col("depth") == F.col("since"), F.col("depth") == F.col("n_turns")
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        chains = chains.select("conv_id", "depth", F.when(first, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, digests).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
        return stored(inner.unionByName(chains))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""
ORACLE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS src, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY src, pos) AS depth FROM b),
p AS (SELECT conv_id, depth, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
l AS (SELECT conv_id, max(depth) AS n_turns FROM p GROUP BY 1),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n_turns) AS ends FROM p JOIN l USING (conv_id) GROUP BY key, depth),
k AS (SELECT key[1:depth - 1] AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key, depth)),
s AS (SELECT key[1:d] AS key, d AS depth, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s USING (key, depth) LEFT JOIN m q ON q.depth = m.depth - 1 AND q.key = m.key[1:m.depth - 1]"""

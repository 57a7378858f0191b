"""A prefix trie of conversations from mergeable partial tries.

Turns are put in order by a range partitioning on conversation and turn, so that one conversation may lie in several partitions: its parts'
lengths and digests are added up, and no task needs a whole conversation. The key of a node is a digest of the turns that lead to it
(each turn's SHA-256 with its depth, hashed to 128 bits and combined by exclusive or, which running sums over parts allow); taking a node's last turn out again gives
the key of its parent.

Each partition of such paths emits a partial trie: a row for each of its nodes with the number of members and the least one, and
packed runs of the conversations that end there. Partial tries are merged ``FAN`` at a time by the hash of the key, again and again, until one is left.
The rollup goes bottom-up in doubling steps: after step k a node has the sums over its subtree down to 2^k levels, and the next step adds those of its
descendants 2^k levels below, so its steps are as many as the depth has binary digits. The ids that end at a node are read in order and hashed run by run.

Defined cases: a null turn number stands first; equal ones are in the order of role and text; repeated rows are turns of their own; null roles and texts
are empty; rows without a conv_id belong to no conversation; conv_ids below 0 have the base c - c % 20 with the remainder's sign of SQL; a conversation without
turns after its rebuilding is a member of the root; an empty table gives an empty table. Other columns don't matter.
Rows that agree in conversation, turn, role and the first ``TIE`` characters of the text are sorted in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, discard, durable

#: Conversations that share a base, and the number of values of the length of a shared head, by CRC-32 of the id.
FAMILY, HEADS = 20, 4
#: Partial tries merged at a time; rows that a partial trie holds; binary digits of the ids in a packed run; characters of a text that order equal turns across partitions.
FAN, HELD, RUN, TIE = 16, 200_000, 10, 64
PARTIAL = "part long, k1 long, k2 long, p1 long, p2 long, depth long, words long, n long, least long, run long, ids array<long>"
NONE = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, part, at (place in the part), d1 and d2 (digest of role and text) and words of every turn, parts of a conversation in order."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")).where("conv IS NOT NULL")
    by = ["conv", F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = turns.repartitionByRange(*by, F.substring("text", 1, TIE)).sortWithinPartitions(*by, "text")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    words = F.size(F.filter(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), lambda w: w != "")).cast("long")
    # The number of a row is its partition and its place there; it is written with the row.
    numbered = dealt.select("conv", digest.alias("digest"), words.alias("words"), F.monotonically_increasing_id().alias("number"))
    return numbered.select("conv", F.shiftright("number", 33).alias("part"), (F.col("number").bitwiseAND(2**33 - 1)).alias("at"), F.xxhash64(F.lit(1), "digest").alias("d1"), F.xxhash64(F.lit(2), "digest").alias("d2"), "words")


def before(column: str, combine, by: str = "conv"):
    """What ``combine`` makes of a column over the earlier parts of a conversation."""
    return combine(column).over(W.partitionBy(by).orderBy("part").rowsBetween(W.unboundedPreceding, -1))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, part, depth, d1, d2, words, length of every rebuilt turn; conv and length of every conversation).

    The first h turns are those of the base conversation (all if fewer, none if it isn't there), h being CRC-32 of the id modulo HEADS; then come the own turns after
    the first h. A conversation takes HEADS - 1 turns of its base at most, and FAMILY conversations share a base, so heads don't multiply.
    """
    parts = turns.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sizes = parts.groupBy("conv").agg(F.sum("n").alias("own"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("long")
    whole = sizes.select("conv", "own", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), h.alias("h"))
    base = sizes.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    whole = whole.join(base, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
    whole = durable(whole.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    placed = parts.withColumn("offset", F.coalesce(before("n", F.sum), F.lit(0)) - F.col("first")).join(whole, "conv")
    own = turns.join(placed.select("conv", "part", "offset", "h", "head", "length"), ["conv", "part"]).withColumn("place", F.col("offset") + F.col("at") + 1)
    tail = own.where("place > h").select("conv", "part", (F.col("head") + F.col("place") - F.col("h")).alias("depth"), "d1", "d2", "words", "length")
    heads = own.where((F.col("conv") % FAMILY == 0) & (F.col("place") < HEADS)).select(F.col("conv").alias("base"), "place", "d1", "d2", "words")
    heads = heads.join(whole.select("conv", "base", "h", "length"), "base").where("place <= h")
    heads = heads.select("conv", F.lit(-1).cast("long").alias("part"), F.col("place").alias("depth"), "d1", "d2", "words", "length")
    return tail.union(heads), whole.select("conv", "length")


def paths(turns: DataFrame) -> DataFrame:
    """conv, depth, k1 and k2 (the node that the turn leads to), p1 and p2 (the node before it), words and length of every turn."""
    element = {f"e{i}": F.xxhash64(F.lit(2 + i), "depth", "d1", "d2") for i in (1, 2)}
    upto = W.partitionBy("conv", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = turns.withColumns(element).withColumns({f"r{i}": F.bit_xor(f"e{i}").over(upto) for i in (1, 2)}).drop("d1", "d2")
    inside = durable(inside, "conversation-parts")  # read once more below
    parts = inside.groupBy("conv", "part").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    offsets = parts.select("conv", "part", *(F.coalesce(before(f"x{i}", F.bit_xor), F.lit(0)).alias(f"o{i}") for i in (1, 2)))
    key = {f"k{i}": F.col(f"r{i}").bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)}
    found = inside.join(offsets, ["conv", "part"]).withColumns(key)
    return found.select("conv", "depth", "k1", "k2", *(F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)), "words", "length")


def partial_tries(steps: DataFrame) -> DataFrame:
    """Rows (conv, depth, k1, k2, p1, p2, words, length) -> the partial trie of each partition (PARTIAL).

    A node's row has n and least and no run; a row with a run has the ids that end at the node, of one range of 2^RUN.
    """

    def work(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        nodes: dict[tuple, list] = {}
        ends: dict[tuple, list] = {}

        def table():
            rows = [(*k, *v, None, None) for k, v in nodes.items()] + [(*k[:2], None, None, None, None, None, None, k[2], v) for k, v in ends.items()]
            kinds = [pa.int64()] * 9 + [pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            nodes.clear()
            ends.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part)), *columns], names=[c.split()[0] for c in PARTIAL.split(", ")])

        for batch in batches:
            for conv, depth, k1, k2, p1, p2, words, length in zip(*(c.to_pylist() for c in batch.columns)):
                node = nodes.get((k1, k2))
                if node is None:
                    nodes[k1, k2] = [p1, p2, depth, words, 1, conv]
                else:
                    node[4] += 1
                    node[5] = min(node[5], conv)
                if depth == length:
                    ends.setdefault((k1, k2, conv >> RUN), []).append(conv)
            if len(nodes) + len(ends) > HELD:
                yield table()
        yield table()

    return steps.mapInArrow(work, PARTIAL)


def merged(tries: DataFrame, fan: int = FAN) -> DataFrame:
    """Partial tries become one: each step puts ``fan`` of them together, node by node and run by run."""
    least = (tries.agg(F.max("part")).first()[0] or 0) + 1
    keys = ("k1", "k2", "run")
    while True:
        one = least <= fan
        part = F.lit(0).cast("long") if one else F.floor(F.col("part") / fan).cast("long")
        step = tries.withColumn("part", part).groupBy("part", *keys).agg(
            *(F.any_value(c).alias(c) for c in ("p1", "p2", "depth", "words")), F.sum("n").alias("n"), F.min("least").alias("least"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids")
        )  # a run has 2^RUN ids at most, and a step sees it fan times at most for each flush of a partial trie
        step = durable(step, "trie")
        discard(tries)
        if one:
            return step
        tries, least = step, -(-least // fan)


def end_digests(trie: DataFrame) -> DataFrame:
    """k1, k2 and ends_sha256 of the nodes at which conversations end: runs come in order and are hashed one by one."""

    def work(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                text = ",".join(map(str, ids)).encode()
                if (k1, k2) == key:
                    digest.update(b"," + text)
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256(text)
            yield out(done)
        yield out([(*key, digest.hexdigest())] if key is not None else [])

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])

    runs = trie.where("run IS NOT NULL").select("k1", "k2", "run", "ids").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "run")
    return runs.select("k1", "k2", "ids").mapInArrow(work, "k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """nodes with n_children, n_leaves and saved_tokens, sums over their subtrees.

    A node's ancestor 2^k levels up is looked up on the path of its least member, by conversation and depth: no key of that join is frequent.
    """
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = durable(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n") - 1) * F.col("words")}), "trie-sums")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    way = steps.select(F.col("conv").alias("least"), F.col("depth").alias("up"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    reach = 1
    while reach <= deepest:
        low = nodes.where(F.col("depth") >= reach)
        if reach == 1:
            low = low.select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), "n_leaves", "saved_tokens")
        else:
            roots = low.where(F.col("depth") == reach).select(F.lit(0).cast("long").alias("a1"), F.lit(0).cast("long").alias("a2"), "n_leaves", "saved_tokens")
            rest = low.where(F.col("depth") > reach).withColumn("up", F.col("depth") - reach).join(way, ["least", "up"])
            low = rest.select("a1", "a2", "n_leaves", "saved_tokens").union(roots)
        more = low.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        step = nodes.join(more, ["k1", "k2"], "left")
        step = step.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))}).drop("more_leaves", "more_saved")
        step = durable(step, "trie-sums")
        discard(nodes)
        nodes, reach = step, 2 * reach
    return nodes


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", fan: int = FAN) -> DataFrame:
    """A row for each node: k1 and k2 (its key), conv_id (least member), depth, parent_conv_id, words (of its last text), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The turn that a node stands for is turn number ``depth`` of the rebuilt conversation ``conv_id``.
    """
    turns = durable(ordered_turns(conversations, conv_id, turn, role, text), "turns")
    rebuilt, whole = rebuilt_turns(turns)
    steps = durable(paths(rebuilt), "conversation-paths")
    discard(turns)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = whole.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("words"), "length")
    trie = merged(durable(partial_tries(steps.select(*roots.columns).union(roots)), "partial-tries"), fan)
    nodes = trie.where("run IS NULL").select("k1", "k2", "p1", "p2", "depth", "words", "n", "least")
    summed = rolled_up(nodes, steps)
    ends = end_digests(trie)
    parent = summed.where("depth > 0 AND n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent"))
    top = whole.agg(F.min("conv")).first()[0]  # the root's least member; its children, often the most of any node, need no join
    deep = summed.where("depth > 1").join(parent, ["p1", "p2"])
    shallow = summed.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(top).cast("long")))
    found = deep.select(*shallow.columns).union(shallow).join(ends, ["k1", "k2"], "left")
    return found.select(
        "k1", "k2", F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "words", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )


#: CRC-32 bit by bit over the digits of the id; nodes are lists of turns.
ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(x ORDER BY i) AS own, conv_id - conv_id % {FAMILY} AS base,
             xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
                 lambda a, s: list_reduce(range(8), lambda b, j: xor(b >> 1, (b & 1) * 3988292384), xor(a, s)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % {HEADS} AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS s FROM c LEFT JOIN c b ON c.base = b.conv_id),
p AS (SELECT conv_id, len(s) AS l, unnest(range(0, len(s) + 1)) AS d, s FROM r),
n AS (SELECT list_slice(s, 1, d) AS k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = l), '') AS ends FROM p GROUP BY 1, 2),
m AS (SELECT *, list_slice(k, 1, depth - 1) AS pk, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM n),
q AS (SELECT pk AS k, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY pk),
w AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN q USING (k)),
a AS (SELECT list_slice(k, 1, j) AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children, n_leaves, saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN a ON w.k = a.k LEFT JOIN w u ON w.depth > 0 AND u.k = w.pk
"""

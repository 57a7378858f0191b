"""The merged trie against one built in dictionaries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from quernstone.llm import conversations as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        s = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest(k)) for k, m in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got(spark, rows, fan=C.FAN):
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(5)
    return Counter(tuple(r[c] for c in COLUMNS) for r in C.prefix_trie(df, fan=fan).collect())


def made(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c * 3 % 97 + 40 * (c % 3), t, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "yes", "no \x1c no", None, "", "é  ü"])))
    return rows


def test_equals_a_plain_trie(spark):
    rows = made(1, 120)
    rows += [(500, None, "user", "first"), (500, None, "a", "first"), (500, 0, "user", "b"), (500, 0, "user", "b"), (500, 0, "user", "a"), (None, 1, "user", "lost"), (-7, 1, "u", "x"), (-7, 2, "u", "y"), (-7, 3, "u", "y z"), (-20, 0, "u", "x")]
    rows += [(c, t, "user", "the same text") for c in range(1000, 1060) for t in range(4)]
    assert got(spark, rows) == plain(rows)


def test_merging_in_several_steps(spark):
    rows = made(5, 200)
    assert got(spark, rows, fan=2) == plain(rows)


def test_one_conversation_over_many_partitions(spark):
    """Most rows are one long conversation, another one follows it for a while: the deep trie is rolled up in a few steps."""
    rows = [(40, t, "user", f"word {t}") for t in range(700)] + [(41, t, "user", f"word {t}") for t in range(300)] + [(60, t, "user", f"word {t}") for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = C.ordered_turns(df).where("conv = 40").select("part").distinct().count()
        assert parts > 1 and got(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_without_turns_and_empty_table(spark):
    rows = [(c, 0, "user", "only") for c in (101, 102, 103, 104, 105)]  # no base: what h takes off is gone
    want = plain(rows)
    assert got(spark, rows) == want and any(k[1] == 0 and k[3] == 5 for k in want)
    assert got(spark, []) == Counter()


def test_partial_tries_are_flushed(spark, monkeypatch):
    rows = made(8, 150)
    monkeypatch.setattr(C, "HELD", 3)
    assert got(spark, rows) == plain(rows)


def test_very_long_text(spark):
    rows = [(20, 0, "user", "w " * 500_000), (21, 0, "user", "w " * 500_000), (21, 1, "user", "x"), (20, 1, "user", "y"), (20, 2, "user", "y"), (20, 3, "user", "y"), (21, 2, "u", "y"), (21, 3, "u", "y")]
    assert got(spark, rows) == plain(rows)

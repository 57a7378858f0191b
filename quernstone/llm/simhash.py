"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint's 64 bits are cut into segments, and each segment's number of ones is a coordinate. Two
fingerprints are at least as many bits apart as their points are in Manhattan distance, so links of up to
two bits lie within distance two on this grid. Every point is filed under its own cell and the cells one
step away: two points within distance two share a cell (their own one, or one half-way). Pairs in a cell are
then verified exactly on the bits. Equal fingerprints are one point from the start.

No cell makes all its pairs: a cell of up to ``HEAVY`` points gives the edges of a spanning forest of its verified
links, and a fuller one files its points under the 65 bit patterns at most one bit away, where points two bits
apart meet again, and links each to the least one there. Components are the same as those of all links.

Defined cases: a null text or one without words has fingerprint zero, linked like any other; fewer than three
words are one shingle; repeated doc_ids keep a row each; null ids count as larger than any other;
an empty table gives an empty table.

``kept_documents`` takes other links too: a share of common shingles (Jaccard similarity of the sets of distinct
shingles). A set has a fingerprint of ``WORDS`` times 64 bits, each one where over half of its shingles' hashes have it.
Candidates are fingerprints whose first 64 bits link on the grid, and such of about a quarter of the bits apart (``near_bits``):
similarity 0.8 has an eighth to a fifth of the bits apart, too many for a grid, so these are compared where they meet in one
of ``BANDS`` bands of ``BAND`` least hashes. A pair of similarity 0.8 meets in no band with a probability of 5e-8, and is
further apart with one of 1e-7 at most (sets of four and five shingles; far less for larger ones); more similar ones with less.
Components of candidates take the place of buckets then, and pairs in them are verified on the whole sets of 64-bit
shingle hashes, which travel once for their component (twice where it has several blocks).
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, slices

#: Bits apart that link, words in a shingle, seed of XXH64; segments of the embedding; points in a cell that are paired.
APART, SHINGLE, SEED = 2, 3, 42
SEGMENTS, HEAVY = 32, 32
BITS = 64 // SEGMENTS
#: Bands of least hashes and hashes in a band; members of a bucket in a block; bits of the pattern of rows to read.
BANDS, BAND, BLOCK, FILTER = 32, 4, 256, 2**26
#: 64-bit words of a set's fingerprint.
WORDS = 16


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """A bit is one where over half the shingles' hashes have it; shingles count as often as they stand."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for k, t in enumerate(texts):
        words = t.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
        if not words:
            continue
        ones, total = np.zeros(64, np.int64), max(len(words) - SHINGLE + 1, 1)
        for at in range(0, total, 100_000):
            run = words[at : at + 100_000 + SHINGLE - 1]
            shingles = map(b" ".join, zip(*(run[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
            h = np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def work(batches):
        for batch in batches:
            for at, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(fingerprints_of(texts).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, cell) of each point's own cell and of the cells one step away; a cell's number has a digit for each segment."""
    base, mask = BITS + 1, np.uint64(2**BITS - 1)
    counts = [np.bitwise_count(fps >> np.uint64(BITS * s) & mask).astype(np.int64) for s in range(SEGMENTS)]
    own = sum(c * base**s for s, c in enumerate(counts))
    at, cell = [np.arange(len(fps))], [own]
    for s, c in enumerate(counts):
        for step, inside in ((1, c < BITS), (-1, c > 0)):
            i = np.flatnonzero(inside)
            at.append(i)
            cell.append(own[i] + step * base**s)
    return np.concatenate(at), np.concatenate(cell)


def forest(cells: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of spanning forests of the links inside each cell; rows sorted by cell, no cell over HEAVY rows."""
    found, i = [], np.arange(len(cells))
    for step in range(1, HEAVY):
        i = i[i + step < len(cells)]
        i = i[cells[i] == cells[i + step]]
        if not len(i):
            break
        near = i[np.bitwise_count(fps[i].view(np.uint64) ^ fps[i + step].view(np.uint64)) <= APART]
        found += zip(near.tolist(), (near + step).tolist())
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    edges = []
    for a, b in found:
        ra, rb = top(a), top(b)
        if ra != rb:
            root[rb] = ra
            edges.append((a, b))
    return edges


def cell_links(batches):
    """Rows (cell, fp) sorted by cell -> (a, b, met): verified edges, or (point, point, true) of a full cell. Holds HEAVY rows over."""
    held_c, held_f, heavy = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def out(a, b, met):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), met))], names=["a", "b", "met"])

    def whole(c, f):
        nonlocal heavy
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(c)])
        full = (sizes > HEAVY) | (c[starts] == heavy if heavy is not None else False)
        in_full = np.repeat(full, sizes)
        if in_full.any():
            yield out(f[in_full], f[in_full], True)
        c, f = c[~in_full], f[~in_full]
        if edges := forest(c, f):
            a, b = np.array(edges).T
            yield out(f[a], f[b], False)

    for batch in batches:
        c = np.concatenate([held_c, batch.column(0).to_numpy()])
        f = np.concatenate([held_f, batch.column(1).to_numpy()])
        last = int(np.searchsorted(c, c[-1], "left")) if len(c) else 0  # the last cell may go on in the next batch
        yield from whole(c[:last], f[:last])
        held_c, held_f = c[last:], f[last:]
        if len(held_c) > HEAVY or (len(held_c) and held_c[0] == heavy):
            heavy = int(held_c[0])
            yield out(held_f, held_f, True)
            held_c, held_f = held_c[:0], held_f[:0]
    yield from whole(held_c, held_f)


def patterns(batches):
    """Points -> (pattern, point) for the 65 bit patterns at most one bit away."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            f = batch.column(0).slice(at, 4096).to_numpy()
            near = np.concatenate([f, *(f ^ np.array(1 << k, np.uint64).view(np.int64) for k in range(64))])
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.tile(f, 65))], names=["pattern", "point"])


def links(points: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) with the components of all links of up to APART bits."""

    def file(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                f = batch.column(0).slice(at, 4096).to_numpy()
                i, cell = cells_of(f.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(f[i])], names=["cell", "fp"])

    cells = points.select("fp").mapInArrow(file, "cell long, fp long")
    found = durable(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(cell_links, "a long, b long, met boolean"), "simhash-links")
    edges = found.where("not met").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # A point of many full cells is spread once.
    met = found.where("met").select("a").distinct().mapInArrow(patterns, "pattern long, point long")
    least = met.groupBy("pattern").agg(F.min("point").alias("least"))
    return edges.union(met.join(least, "pattern").where("point <> least").select(F.col("least").alias("a"), F.col("point").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root the least node of its component, by alternating stars.

    A large star hangs a node's larger neighbours on its least one, a small star its smaller ones and itself; the
    edges stop changing after a logarithmic number of rounds. Each round is a written table, and the one before it goes.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v"), "cc-edges")
    before = None
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).union(edges.select("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select("v", F.least("m", "u").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(small.select("v", F.col("m").alias("u"))).distinct()
        done, edges = edges, durable(small, "cc-edges")
        discard(done)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row."""
    fps = durable(fingerprints(docs, text, doc_id), "fingerprints")
    points = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "points")
    roots = components(links(points)).withColumnRenamed("node", "fp")
    labelled = points.join(roots.union(roots.select(F.col("root").alias("fp"), "root")).distinct(), "fp")
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component"))
    grouped = labelled.join(least, "root").select("fp", "component")
    known = points.join(grouped, "fp", "left").select("fp", F.coalesce("component", "least_id").alias("component_id"))
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle has are one shingle."""
    from xxhash import xxh64_intdigest

    words, out = text.encode().lower().split(), np.zeros(0, np.uint64)
    for at in range(0, max(len(words) - shingle + 1, 1) if words else 0, 100_000):
        run = words[at : at + 100_000 + shingle - 1]
        shingles = map(b" ".join, zip(*(run[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        out = np.union1d(out, np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64))
    return out


def band_keys(members: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its number and its least hashes. Empty sets have no band."""
    if not len(members):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(SEED)
    flip, times = rng.integers(0, 2**64, BANDS * BAND, np.uint64), rng.integers(0, 2**63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(members), 2048):
        h = (members[at : at + 2048, None] ^ flip) * times
        least = np.minimum(least, ((h ^ (h >> np.uint64(32))) * times).min(axis=0))
    mixed = (least.reshape(BANDS, BAND) * rng.integers(0, 2**63, BAND, np.uint64)).sum(axis=1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * times[:BANDS] + flip[:BANDS]).view(np.int64)


def set_fingerprint(members: np.ndarray) -> np.ndarray:
    """The words of a set's fingerprint: a bit is one where over half of its members' hashes have it. Empty sets have zeros."""
    rng = np.random.default_rng(SEED + 1)
    flip, times = rng.integers(0, 2**64, WORDS, np.uint64), rng.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
    ones, lanes = np.zeros((8, WORDS * 8), np.int64), np.arange(8, dtype=np.uint64)[:, None]
    for at in range(0, len(members), 255):  # a byte counts so many
        h = (members[at : at + 255, None] ^ flip) * times
        h = (h ^ (h >> np.uint64(32))) * times
        h ^= h >> np.uint64(29)
        ones += (h[:, None] >> lanes & np.uint64(0x0101010101010101)).sum(axis=0, dtype=np.uint64).view(np.uint8)
    # Place 8 i + k of the bits is lane k of byte i.
    return np.packbits((2 * ones > len(members)).T.ravel(), bitorder="little").view(np.uint64)


def near_bits(share: Fraction) -> int:
    """How many bits apart fingerprints of sets of at least that similarity are, but for 1e-7 of them.

    A bit differs with arccos(cosine) / pi in large sets, and with at most sqrt(pi / 2) times that in sets of a few members.
    """
    p = 1.26 * np.arccos(float(2 * share / (1 + share))) / np.pi
    return int(np.ceil(64 * WORDS * p + 5.3 * np.sqrt(64 * WORDS * p * (1 - p))))


def near_links(most: int):
    """Rows (bucket, row, bits) sorted by bucket -> (a, b): spanning forests of each bucket's pairs of fingerprints at most so many bits apart."""

    def forest_of(held):
        rows, bits, edges = np.concatenate([r for r, _ in held]), np.concatenate([b for _, b in held]), []
        group = np.arange(len(rows))
        for i in range(1, len(rows)):
            near = np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most)
            joined, first = np.unique(group[near], return_index=True)
            edges += [(int(rows[j]), int(rows[i])) for j in near[first]]
            group[:i][np.isin(group[:i], joined)] = i
        return edges

    def out(edges):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

    def work(batches):
        place, held = None, []
        for batch in batches:
            edges, buckets, rows = [], batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WORDS)
            starts = np.r_[0, np.flatnonzero(np.diff(buckets)) + 1, len(buckets)].tolist() if len(buckets) else []
            for x, y in zip(starts, starts[1:]):
                if held and buckets[x] != place:
                    edges += forest_of(held)
                    held = []
                place = buckets[x]
                held.append((rows[x:y], bits[x:y]))
            yield out(edges)
        if held:
            yield out(forest_of(held))

    return work


def lists(arrays):
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in arrays])], pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def shingle_bands(rows: DataFrame, text: str, shingle: int) -> DataFrame:
    """row, digest of the set of shingles, its band keys, its fingerprint and that one's first word, of rows with __row."""

    def work(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at, texts in slices(batch, 1):
                sets = [shingle_set(t, shingle) for t in texts]
                digests = pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                prints = [set_fingerprint(s) for s in sets]
                bits, fp = pa.array([x.tobytes() for x in prints], pa.binary()), pa.array([int(x.view(np.int64)[0]) for x in prints], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), digests, lists([band_keys(s) for s in sets]), bits, fp], names=["row", "digest", "bands", "bits", "fp"])

    return rows.select("__row", F.col(text).cast("string").alias("text")).mapInArrow(work, "row long, digest binary, bands array<long>, bits binary, fp long")


def shingle_sets(rows: DataFrame, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """row and members (the set of shingles) of the rows in wanted.

    A bit pattern of FILTER bits at most tells which texts are read, so texts don't travel; the join takes out those that only share a bit.
    """
    bit = F.pmod(F.xxhash64("row"), F.lit(FILTER))
    words = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(row), {FILTER}) % 64 as int))")).alias("bits")).toArrow()
    pattern = np.zeros(FILTER // 64, np.int64)
    pattern[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(pattern.tobytes())

    def work(batches):
        bits = np.frombuffer(sent.value, np.uint64)
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for at, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists([shingle_set(t, shingle).view(np.int64) for t in texts])], names=["row", "members"])

    read = rows.select(F.col("__row").alias("row"), F.col(text).cast("string").alias("text")).withColumn("bit", bit)
    return read.mapInArrow(work, "row long, members array<long>").join(wanted, "row", "left_semi")


def similar(x: np.ndarray, y: np.ndarray, share: Fraction) -> bool:
    """Whether two sets have at least that share of their union in common."""
    if min(len(x), len(y)) * share.denominator < max(len(x), len(y)) * share.numerator:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * share.denominator >= (len(x) + len(y) - common) * share.numerator


def block_links(share: Fraction):
    """Rows (bucket, block, blocks, row, members) sorted by bucket and block -> (a, b) verified, and (bucket, common) for buckets of several blocks.

    In a block every pair is verified that isn't joined by its links so far. common: the members that two or more sets of a full bucket's first block
    have, which stands for the frequent ones of the bucket.
    """

    def work(batches):
        place, held, group, several = None, [], {}, False

        def common():
            if place is None or place[1] or not several:
                return []
            members, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for _, x in held)]), return_counts=True)
            return [(place[0], members[n > 1])]

        def out(a, b, found):
            n, m = len(a), len(found)
            both = lambda x, y: pa.array([*x, *y], pa.int64())
            return pa.RecordBatch.from_arrays(
                [both(a, [None] * m), both(b, [None] * m), both([None] * n, [c for c, _ in found]), pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), lists([x for _, x in found])])], names=["a", "b", "bucket", "common"]
            )

        for batch in batches:
            buckets, blocks, many, numbers = (batch.column(c).to_pylist() for c in range(4))
            offsets, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            a, b, found = [], [], []
            for i, (c, k, n, row) in enumerate(zip(buckets, blocks, many, numbers)):
                if (c, k) != place:
                    found += common()
                    place, held, group, several = (c, k), [], {}, n > 1
                x = values[offsets[i] : offsets[i + 1]]
                group[row] = {row}
                for other, y in held:
                    if other not in group[row] and similar(x, y, share):
                        a.append(other)
                        b.append(row)
                        joined = group[row] | group[other]
                        group.update(dict.fromkeys(joined, joined))
                held.append((row, x.copy()))
            yield out(a, b, found)
        yield out([], [], common())

    return work


#: Bits of a member that prefixes are made of: equal members have equal ones, and what meets by chance is verified like the rest.
SHORT = 2**31 - 1


def prefixes(share: Fraction):
    """Rows (bucket, block, row, label, members, common), the row of common first in its block -> (key, row, label, packed).

    A set is put in order, members in common last. Of two similar sets the larger one (of equal ones that of the larger row) has a member of the other
    among its first size - share * size + 1, and the smaller one a member of that among its first size - 2 share / (1 + share) * size + 1: these are filed.
    key stands for bucket and member, packed has the size of the set, the member's place and whether it is filed.
    """
    both = 2 * share / (1 + share)

    def first(n, of):
        return n - -(-n * of.numerator // of.denominator) + 1

    def work(batches):
        place, common = None, np.zeros(0, np.int32)
        for batch in batches:
            buckets, blocks, numbers, labels = (batch.column(c).to_pylist() for c in range(4))
            parts = []
            for i, (c, k, row, label) in enumerate(zip(buckets, blocks, numbers, labels)):
                if (c, k) != place:
                    place, common = (c, k), np.zeros(0, np.int32)
                if row is None:
                    common = np.array(batch.column(5)[i].values.to_numpy())
                    continue
                x = np.sort(batch.column(4)[i].values.to_numpy())
                frequent, n = np.isin(x, common), len(x)
                own = np.concatenate([x[~frequent], x[frequent]])[: first(n, share)].astype(np.uint64)
                at = np.arange(len(own))
                key = (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(c % 2**64)
                parts.append((key.view(np.int64), np.full(len(own), row), np.full(len(own), label), n << 32 | at << 1 | (at < first(n, both))))
                if len(parts) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*parts)], names=["key", "row", "label", "packed"])
                    parts = []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*parts)], names=["key", "row", "label", "packed"])

    return work


def links_across(asked: DataFrame, sets: DataFrame, common: DataFrame, edges: DataFrame, share: Fraction) -> DataFrame:
    """Verified (a, b) between the blocks of full buckets whose members aren't of one component by the edges so far.

    asked: bucket, block, blocks, row; only members of different components are paired.
    """
    roots = components(edges)
    roots = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct().toDF("row", "root")
    stored = durable(asked.where("blocks > 1").join(roots, "row", "left").withColumn("label", F.coalesce("root", "row")).select("bucket", "block", "row", "label"), "full-buckets")
    mixed = stored.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("bucket")
    # Tables of known size: small ones are sent to the sets, which move only where they are large.
    full = durable(stored.join(mixed, "bucket"), "mixed-buckets")
    none, short = F.lit(None), lambda c: F.transform(c, lambda x: x.bitwiseAND(SHORT).cast("int"))
    shared = full.select("bucket", "block").distinct().join(common, "bucket")  # a row for each block
    shared = shared.select("bucket", "block", none.cast("long").alias("row"), none.cast("long").alias("label"), none.cast("array<int>").alias("members"), short("common").alias("common"))
    members = full.join(sets.select("row", short("members").alias("members")), "row").select("bucket", "block", "row", "label", "members", none.cast("array<int>").alias("common"))
    sorted_ = members.union(shared).repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.col("row").asc_nulls_first())
    filed = durable(sorted_.mapInArrow(prefixes(share), "key long, row long, label long, packed long"), "prefixes")
    # Both sides are the same rows dealt by the same key, which Spark shuffles once.
    side = lambda c: filed.select("key", *(F.col(x).alias(f"{x}_{c}") for x in ("row", "label", "packed")))
    size, place = lambda c: F.shiftright(f"packed_{c}", 32), lambda c: F.shiftright(F.col(f"packed_{c}").bitwiseAND(2**32 - 1), 1)
    n, d = F.lit(share.numerator), F.lit(share.denominator)
    least = F.least(size("a") - place("a"), size("b") - place("b"))
    met = side("a").join(side("b"), "key").where(
        (F.col("packed_a").bitwiseAND(1) == 1) & (F.col("label_a") != F.col("label_b")) & ((size("a") < size("b")) | (size("a") == size("b")) & (F.col("row_a") < F.col("row_b")))
        & (size("a") * d >= size("b") * n) & (least * (n + d) >= n * (size("a") + size("b")))
    )
    pairs = durable(met.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct(), "pairs-across")
    ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ends-across")
    few = durable(sets.join(ends, "row", "left_semi"), "sets-across")
    x, y = few.select(F.col("row").alias("a"), F.col("members").alias("x")), few.select(F.col("row").alias("b"), F.col("members").alias("y"))
    enough = F.size(F.array_intersect("x", "y")) * (n + d) >= n * (F.size("x") + F.size("y"))
    found = durable(pairs.join(x, "a").join(y, "b").where(enough).select("a", "b"), "links-across")
    discard(stored, full, filed, pairs, ends, few)
    return found


def candidates(points: DataFrame, share: Fraction) -> DataFrame:
    """Edges (a, b) between rows: pairs of that similarity are in one component of these. points: row, bands, bits, fp."""
    # Fingerprints whose first words are at most APART bits apart, as in near_duplicates.
    heads = durable(points.groupBy("fp").agg(F.min("row").alias("head")), "heads")
    end = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    close = links(heads.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    equal = points.select("row", "fp").join(heads, "fp").where("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b"))
    filed = points.select("row", F.explode("bands").alias("bucket"))
    # Buckets with the same members are one.
    met = filed.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"))
    met = durable(met.where("n > 1").groupBy("n", "x").agg(F.min("bucket").alias("bucket")).select("bucket", (F.col("n") > BLOCK).alias("crowded")), "buckets")
    asked = durable(filed.join(met, "bucket").select("bucket", "crowded", "row"), "bucket-members")
    bits = asked.where("not crowded").select("bucket", "row").join(points.select("row", "bits"), "row").select("bucket", "row", "bits")
    near = bits.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(near_links(near_bits(share)), "a long, b long")
    # The members of a crowded bucket are candidates of each other.
    crowded = asked.where("crowded").select("bucket", "row")
    least = crowded.groupBy("bucket").agg(F.min("row").alias("a"))
    full = crowded.join(least, "bucket").where("row <> a").select("a", F.col("row").alias("b"))
    edges = durable(close.union(equal).union(near).union(full).distinct(), "candidates")
    discard(heads, met, asked)
    return edges


def similar_roots(rows: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """row and root of every row: rows of one root are linked by Jaccard similarities of at least that much. rows: __row, __late, __id."""
    share = Fraction(str(similarity))
    banded = durable(shingle_bands(rows, text, shingle), "shingle-bands")
    ranks = rows.select(F.col("__row").alias("row"), F.struct(F.col("__late").alias("late"), F.col("__id").alias("id"), F.col("__row").alias("row")).alias("rank"))
    # Equal sets are one point, known by its first row.
    points = banded.join(ranks, "row").groupBy("digest").agg(F.min("rank").alias("rank"), *(F.any_value(c).alias(c) for c in ("bands", "bits", "fp")))
    points = durable(points, "shingle-points").withColumn("row", F.col("rank.row"))
    maybe = candidates(points, share)
    roots = components(maybe)
    asked = durable(roots.union(roots.select(F.col("root").alias("node"), "root")).distinct().select(F.col("root").alias("bucket"), F.col("node").alias("row")), "asked")
    sizes = asked.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    many = durable(sizes.where("blocks > 1"), "crowded-components")
    block = lambda *salt: F.pmod(F.xxhash64("row", *salt), "blocks")
    sets = durable(shingle_sets(rows, text, shingle, asked.select("row")), "shingle-sets")
    # Members of crowded components are dealt twice, so that copies which the first dealing parts meet others' blocks in the second.
    dealt = asked.join(sets, "row").join(many, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    places = F.when(F.col("blocks") > 1, F.array(block(), F.col("blocks") + block(F.lit(SEED)))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = dealt.select("bucket", F.explode(places).alias("block"), "blocks", "row", "members")
    dealt = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "row").select("bucket", "block", "blocks", "row", "members")
    found = durable(dealt.mapInArrow(block_links(share), "a long, b long, bucket long, common array<long>"), "shingle-links")
    edges = found.where("a IS NOT NULL").select("a", "b")
    if not many.isEmpty():
        edges = edges.union(links_across(asked.join(many, "bucket").select("bucket", block().alias("block"), "blocks", "row"), sets, found.where("bucket IS NOT NULL").select("bucket", "common"), edges, share))
    roots = components(edges)
    discard(maybe, asked, many, sets, found)
    roots = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    point = points.select("digest", F.col("row").alias("node")).join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return banded.select("row", "digest").join(point, "digest").select("row", "root")


def fingerprint_roots(rows: DataFrame, text: str) -> DataFrame:
    """row and root of every row: rows of one root are linked by fingerprints at most APART bits apart."""
    fps = durable(fingerprints(rows, text, "__row"), "fingerprints").withColumnRenamed("doc_id", "row")
    roots = components(links(durable(fps.select("fp").distinct(), "points"))).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").select("row", F.coalesce("root", "fp").alias("root"))


def kept_documents(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: one of the least doc_id (nulls last), whatever ids other rows share with it.

    Links are fingerprints at most APART bits apart; with a similarity, Jaccard similarities of sets of shingles of so many words.
    """
    if similarity is None and shingle != SHINGLE:
        raise ValueError("fingerprints have shingles of a fixed length")
    number = F.col("doc_id").cast("long")
    # Numbers of rows that are computed anew may change with the splits of the files: they are written with the rows.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__whole"), F.monotonically_increasing_id().alias("__row"), number.isNull().alias("__late"), F.coalesce(number, F.lit(0).cast("long")).alias("__id"),
    )
    rows = durable(rows, "numbered")
    texts = rows.select("__row", "__late", "__id", F.col("__whole")[text].alias("__text"))
    roots = fingerprint_roots(texts, "__text") if similarity is None else similar_roots(texts, "__text", shingle, similarity)
    first = F.min(F.struct("__late", "__id", "__row")).alias("first")
    stay = rows.select("__row", "__late", "__id").join(roots, F.col("__row") == F.col("row")).groupBy("root").agg(first).select(F.col("first.__row").alias("__row"))
    gone = rows.select("__row").join(stay, "__row", "left_anti")
    # The rows that go are the smaller side: their numbers are broadcast where Spark's size check allows, and texts move once at most.
    kept = rows.join(durable(gone, "gone"), "__row", "left_anti")
    return kept.select(*(F.col("__whole")[c].alias(c) for c in docs.columns))

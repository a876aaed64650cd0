"""SimHash near-duplicate detection with pivot distance tables.

1. Fingerprints: each bit is the majority of that bit over the XXH64 hashes of the text's word shingles.
2. Candidate groups: the 64 bits are cut into `blocks` blocks. Two fingerprints at most `radius` bits apart differ in at
   most `radius` blocks, so they agree on some choice of `blocks - radius` of them, and each such choice is a key.
   There are more blocks, hence longer keys, the more fingerprints there are, so that groups stay small. Groups that
   nevertheless are large are cut into tiles, and each pair of tiles is a task's unit of work.
3. Pivot tables: the Hamming distances of every fingerprint of a group to PIVOTS reference fingerprints. By the
   triangle inequality a pair whose distances to any pivot differ by more than `radius` is discarded unseen.
4. Survivors are verified by their own Hamming distance. A group emits a spanning forest of its links, never all pairs.
5. Components: large-star and small-star rounds over the links, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.llm.shared import BROADCAST_BYTES, drop_ids, stash

RADIUS, SHINGLE, SEED, PIVOTS = 4, 4, 42, 16
#: Candidates for each fingerprint that random fingerprints may give before keys are made longer.
CANDIDATES = 8.0
#: Fingerprints of a tile.
TILE = 2048


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words: maximal runs of bytes other than space and 9 to 13."""
    return text.encode().lower().split() if text else []


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint; 0 without words; of the whole sequence where it is shorter than a shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    own = words(text)
    if not own:
        return 0
    n = max(1, len(own) - shingle + 1)
    hashes = np.fromiter((xxh64_intdigest(b" ".join(x), seed) for x in (zip(*(own[i:] for i in range(shingle)), strict=False) if len(own) >= shingle else [own])), dtype=np.uint64, count=n)
    octets = hashes.view(np.uint8).reshape(n, 8)
    votes = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _bits() for i in range(8)])
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _bits():
    """The 8 bits of each byte value, lowest first."""
    import numpy as np

    global _BITS
    if _BITS is None:
        _BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    return _BITS


_BITS = None


def fingerprints(df: DataFrame, shingle: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null and empty texts have fingerprint 0; one row for each row,
    null and repeated ids included; other columns aren't read."""
    import pyarrow as pa

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS):
    """Reference fingerprints: XXH64 of the numbers 0 to n - 1."""
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], dtype=np.uint64)


def key_blocks(n: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose keys bring n random fingerprints no more than CANDIDATES candidates each."""
    for blocks in range(radius + 1, 17):
        if n * comb(blocks, radius) / 2.0 ** (64 * (blocks - radius) // blocks) <= CANDIDATES:
            return blocks
    return 16


def masks(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks that agree, the mask of their bits."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    of = [((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1) for i in range(blocks)]
    return [sum(of[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(group, fps, radius: int = RADIUS, reference=None):
    """Indices (a, b) of links that span the components within groups. Rows of a group stand together.

    Pairs at growing distance in the group's order are taken for all groups at once; pivots discard, the fingerprints
    verify, and only pairs of two trees are linked.
    """
    import numpy as np

    reference = pivots() if reference is None else reference
    first = np.bitwise_count(fps ^ reference[0]).astype(np.int16)
    order = np.lexsort((fps, first, group))
    group, fps = group[order], fps[order]
    table = np.stack([np.bitwise_count(fps ^ p) for p in reference]).astype(np.int16)
    label = np.arange(len(fps))
    links: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    rows, step = np.arange(len(fps)), 1
    while len(rows := rows[rows + step < len(fps)]):
        # a row has no partner farther on once its group ends, or the first pivot's distances, which are sorted, part
        rows = rows[(group[rows] == group[rows + step]) & (table[0][rows + step] - table[0][rows] <= radius)]
        pairs = rows[label[rows] != label[rows + step]]
        for distances in table[1:]:
            pairs = pairs[np.abs(distances[pairs] - distances[pairs + step]) <= radius]
        pairs = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + step]) <= radius]
        for a in pairs.tolist():
            x, y = root(a), root(a + step)
            if x != y:
                label[max(x, y)] = min(x, y)
                links.append((a, a + step))
        if len(pairs):
            while (label != (after := label[label])).any():
                label = after
        step += 1
    found = order[np.array(links, dtype=np.int64).reshape(-1, 2)]
    return found[:, 0], found[:, 1]


def whole_groups(batches: Iterable, keys: int) -> Iterator:
    """(group numbers, columns) of batches of rows, cut only where the first `keys` columns change: rows that are equal in
    them stand together. What is held is a batch and the group that goes on."""
    import numpy as np

    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        rows = rows if left is None else [np.concatenate(x) for x in zip(left, rows, strict=True)]
        group = np.zeros(len(rows[0]), dtype=np.int64)
        for c in rows[:keys]:
            group[1:] |= c[1:] != c[:-1]
        group = np.cumsum(group)
        cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
        if cut:
            yield group[:cut], [c[:cut] for c in rows]
        left = [c[cut:] for c in rows]
    if left is not None:
        yield np.zeros(len(left[0]), dtype=np.int64), left


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span the components of all pairs within `radius`."""
    import pyarrow as pa

    nodes = nodes.select("fp")
    blocks = blocks or key_blocks(nodes.count(), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(blocks, radius))])
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.key")
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1").select("choice", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    # a row meets every tile of its group, itself included: pairs of tiles (i, j), i <= j, are the units of work
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    units = keyed.join(shared, ["choice", "key"]).select("fp", "choice", "key", own.alias("own"), other.alias("other")).select("fp", "choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    unit = ["choice", "key", "i", "j"]
    dealt = units.select(*unit, "fp").repartition(*unit).sortWithinPartitions(*unit)

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        reference = pivots()
        for group, (*_, fps) in whole_groups(batches, 4):
            a, b = forest(group, fps.view(np.uint64), radius, reference)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fps[a], fps[b])), pa.array(np.maximum(fps[a], fps[b]))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node of the links (a, b), the smallest node that it is connected to, unless it is that.

    Alternating large-star and small-star rounds until the links are stars; each round is written to the shared folder.
    """
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "simhash-links")
    summary = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    state = summary(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("hub"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a hub is linked to the hub's smallest neighbour
        large = both.join(least, both.a == least.hub).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of a hub, and itself, are linked to the smallest of them
        smallest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "hub")
        small = large.join(smallest, large.a == smallest.hub)
        after = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select(F.col("hub").alias("a"), F.col("m").alias("b"))).distinct()
        edges = stash(after, "simhash-stars")
        if (now := summary(edges)) == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Texts without words have fingerprint 0 and are linked like any other. Rows with a null doc_id get a component too;
    component_id is null only where no row of the component has an id. Repeated rows and ids are kept as they are.
    Other columns aren't read.
    """
    docs = stash(fingerprints(df, shingle, text_col, id_col), "simhash-fingerprints")
    nodes = stash(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes, radius))
    # only linked fingerprints need the components' smallest ids
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(firsts, "root").select(F.col("fp").alias("node"), "component_id")
    named = stash(named, "simhash-components")
    return docs.join(named, docs.fp == named.node).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similar texts. Two texts whose sets of shingles have a Jaccard coefficient of 0.8 differ in about ten of 64 bits, which
# no short list of equal blocks can promise, and further than pivots can tell from chance. So candidates share one of the
# rarest shingles of both: sets of s shingles that are similar share one of the first s - ceil(similarity * s) + 1 of each
# in any order common to all texts, and where they do first, enough shingles follow in both. A set's fingerprint is the
# parities of its hashes: pivot tables of the fingerprints discard, then their own distances do, which never loses a pair;
# what is left is verified by the texts' shingles. Members of a group are first compared with its first one; then all
# pairs are that these links leave in different components, in rounds: a few of each member at first, so that similar
# texts become one component by links that grow with their number.

#: 64-bit words of a set's parities.
WIDE = 32
#: Of one in SAMPLED texts shingles are counted; the LISTED most frequent of those that COMMON texts or more have come last
#: in the order. The order says how many candidates there are, never which pairs are found.
SAMPLED, LISTED, COMMON = 8, 1 << 20, 2
#: Words whose hashes, and sets whose names, a worker remembers.
REMEMBERED = 1 << 19
#: Texts compared with one other by a task at once.
COMPARED = 256
#: Of so many keys before a group's own each member knows which it has; so many words its folded fingerprint has.
EARLIER, FOLDED = 4, 8
#: So many pairs a member gives at first, and so many times as many in the next round where its group isn't one component.
PAIRED, MORE = 4, 16


class Shingles:
    """Sets of word shingles as 64-bit hashes. Words are hashed by XXH64 once; a shingle's hash is made of its words'."""

    def __init__(self, shingle: int):
        import numpy as np
        from xxhash import xxh64_intdigest

        self.shingle, self.known = shingle, {}
        self.factors = np.array([xxh64_intdigest(str(i).encode(), SEED) | 1 for i in range(shingle)], dtype=np.uint64)

    def __call__(self, text: str | None):
        """The sorted distinct hashes of a text's shingles; of the whole sequence where it is shorter; empty without words."""
        import numpy as np
        from xxhash import xxh64_intdigest

        own, known = words(text), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(own).difference(known):
            known[w] = xxh64_intdigest(w, SEED)
        if len(own) < self.shingle:
            return np.array([xxh64_intdigest(b" ".join(own), SEED)][: len(own)], dtype=np.uint64)
        each = np.fromiter(map(known.__getitem__, own), dtype=np.uint64, count=len(own))
        n = len(own) - self.shingle + 1
        mixed = np.zeros(n, dtype=np.uint64)
        for i, factor in enumerate(self.factors):
            mixed += each[i : i + n] * factor
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def set_name(hashes) -> int:
    """A number that names a set of sorted hashes."""
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(hashes.tobytes(), SEED))


def parities(hashes):
    """64 * WIDE bits: whether an odd number of the hashes falls on each. Those of two sets differ in no more bits than the
    sets do in elements."""
    import numpy as np

    odd = np.bincount((hashes & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def wide_pivots(n: int = PIVOTS):
    """Reference fingerprints of 64 * WIDE bits."""
    import numpy as np

    return pivots(n * WIDE).reshape(n, WIDE)


def prefix(hashes, listed, levels, similarity: float):
    """Of a set of sorted hashes, those one of which each similar set has in its own prefix, in their order: listed ones
    (sorted; with levels) last, by their levels."""
    from math import ceil

    import numpy as np

    if not len(hashes):
        return hashes
    n = len(hashes) - ceil(similarity * len(hashes) - 1e-9) + 1
    if not len(listed):
        return hashes[:n]
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    level = np.where(listed[at] == hashes, levels[at], 0)
    return hashes[np.argsort(level, kind="stable")[:n]]


def common_shingles(df: DataFrame, shingle: int, text_col: str, id_col: str, most: int = LISTED):
    """(sorted hashes, levels) of the most frequent shingles of the sampled texts, `most` at most; the level is the binary
    logarithm of the count."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterable) -> Iterator:
        shingles = Shingles(shingle)
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)).view(np.int64))], ["hash"])

    asked = df.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SAMPLED)) == 0).select(F.col(text_col).cast("string").alias("text"))
    counted = stash(asked.mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON), "simhash-common")
    # the least count whose shingles and all more frequent ones are no more than `most`
    step = F.floor(F.log2("n") * 8).cast("int")
    lowest, total = 1 << 30, 0
    for row in counted.groupBy(step.alias("step")).agg(F.count("*").alias("types")).orderBy(F.desc("step")).collect():  # 512 steps at most
        total += row.types
        if total > most:
            break
        lowest = row.step
    table = counted.where(step >= lowest).select("hash", F.floor(F.log2("n")).cast("int").alias("level")).toArrow()
    hashes, levels = table.column("hash").to_numpy().view(np.uint64), table.column("level").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], levels[order].astype(np.uint8)


def sketches(df: DataFrame, similarity: float, shingle: int, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, node, size, keys, bits, pivots): node names the set of shingles; keys are its prefix, bits its parities
    and pivots their distances to the reference fingerprints. A task gives the keys of a set once; rows without an id
    have none."""
    import pyarrow as pa

    common = df.sparkSession.sparkContext.broadcast(common_shingles(df, shingle, text_col, id_col))  # 9 bytes for each of LISTED

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        shingles, (listed, levels), reference, seen = Shingles(shingle), common.value, wide_pivots(), set()
        for batch in batches:
            nodes, sizes, keys, bits = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own = shingles(text.as_py())
                node = set_name(own)
                nodes.append(node)
                sizes.append(len(own))
                bits.append(parities(own))
                fresh = doc_id.is_valid and node not in seen
                keys.append(prefix(own, listed, levels, similarity).view(np.int64) if fresh else [])
                if fresh:
                    seen.add(node)
                    if len(seen) > REMEMBERED:
                        seen.clear()
            table = np.stack(bits) if bits else np.zeros((0, WIDE), dtype=np.uint64)
            distances = np.stack([np.bitwise_count(table ^ p).sum(axis=1, dtype=np.int16) for p in reference], axis=1)
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(list(table.view(np.int64)), pa.list_(pa.int64())), pa.array(list(distances), pa.list_(pa.int16()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "node", "size", "keys", "bits", "pivots"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, node long, size int, keys array<long>, bits array<long>, pivots array<short>")


def can_meet(x_size, x_at, y_size, y_at, similarity: float):
    """Whether sets of these sizes (columns or arrays) can be similar if they first meet at these places."""
    needed = (x_size + y_size) * (similarity / (1 + similarity)) - 1e-6
    return (x_size - x_at >= needed) & (y_size - y_at >= needed)


def near(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose fingerprints can be those of similar sets: no pivot's distances differ by more than the sets
    may, nor do the fingerprints themselves."""
    x, y = nodes.select("node", "size", "bits", "pivots").alias("x"), nodes.select("node", "size", "bits", "pivots").alias("y")
    most = (F.col("x.size") + F.col("y.size")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    coordinate = F.array_max(F.zip_with("x.pivots", "y.pivots", lambda p, q: F.abs(p - q)))
    apart = F.expr(" + ".join(f"bit_count(x.bits[{i}] ^ y.bits[{i}])" for i in range(WIDE)))
    met = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    return met.where((coordinate <= most) & (apart <= most)).select("a", "b")


def met(docs: DataFrame) -> DataFrame:
    """(key, node, size, at, first, first_size, first_at): for each key that several nodes of docs (node, size, keys) have,
    each of these once, with the key's place in its order, and the same of the key's smallest node. One shuffle by key;
    keys that no other node has end there. Groups are streamed, not held."""
    import pyarrow as pa

    names = ["key", "node", "size", "at", "first", "first_size", "first_at"]

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        last = None  # the last row, its group's first one, and whether that is another
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(4)]
            if last:
                rows = [np.concatenate(x) for x in zip(last[0], rows, strict=True)]
            again = np.r_[False, (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])]
            rows = [r[~again] for r in rows]
            like = rows[0][1:] == rows[0][:-1]
            begin = np.maximum.accumulate(np.where(np.r_[True, ~like], np.arange(len(rows[0])), 0))
            first = [r[begin] for r in rows[1:]]
            later = np.r_[False, like]
            if last and last[2]:
                later[0] = True
                for column, value in zip(first, last[1], strict=True):
                    column[begin == 0] = value
            member = (later | np.r_[like, False])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][member]) for c in (*rows, *first)], names)
            last = [r[-1:] for r in rows], [c[-1] for c in first], bool(later[-1])
        if last and last[2]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*last[0], *(np.array([v]) for v in last[1]))], names)

    keyed = docs.select("node", "size", F.posexplode("keys").alias("at", "key")).select("key", "node", "size", "at")
    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, size int, at int, first long, first_size int, first_at int")


def first_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of each group's first member and another that can be similar; a < b."""
    able = can_meet(F.col("size"), F.col("at"), F.col("first_size"), F.col("first_at"), similarity)
    return shared.where((F.col("first") < F.col("node")) & able).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()


def contested(member: DataFrame, tile: int) -> DataFrame:
    """(_key, tiles, major, outer): the groups of members (key, node, root) of several components, with the number of tiles
    of all members; where it is more than one, the component that most are in and the number of tiles of the others."""
    counted = member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    groups = stash(counted.where("low < high").select(F.col("key").alias("_key"), F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "simhash-open")
    by_root = member.join(groups.where("tiles > 1"), F.col("key") == F.col("_key")).groupBy("_key", "root").agg(F.count("*").alias("c"))
    major = by_root.groupBy(F.col("_key").alias("_of")).agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.ceil((F.sum("c") - F.max("c")) / tile).cast("int").alias("outer"))
    return groups.join(major, F.col("_key") == F.col("_of"), "left").drop("_of")


def meetings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(key, i, j, side, columns..): units of work are pairs of a tile i of the members outside the major component and a
    tile j of all members. A member is there as one of all (side 0) and, if it is outside, as such (1); in a group of one
    tile it is there once (2)."""
    place = "cast(pmod(xxhash64(node), {}) as int)"
    as_any = f"transform(sequence(0, outer - 1), i -> named_struct('i', i, 'j', {place.format('tiles')}, 'side', 0))"
    as_outer = f"if(root <> major, transform(sequence(0, tiles - 1), j -> named_struct('i', {place.format('outer')}, 'j', j, 'side', 1)), array())"
    placed = F.expr(f"if(tiles = 1, array(named_struct('i', 0, 'j', 0, 'side', 2)), concat({as_any}, {as_outer}))")
    return rows.select("key", *columns, F.explode(placed).alias("u")).select("key", "u.i", "u.j", "u.side", *columns)


def rooted_members(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, size, at, before.., root): the members of each group but its first, with the EARLIER keys before the
    group's own and their components so far."""
    before = Window.partitionBy("node").orderBy("at")
    earlier = [f"before{i}" for i in range(EARLIER)]
    member = shared.select("key", "node", "size", "at", "first", *[F.coalesce(F.lag("key", i + 1).over(before), F.lit(0)).alias(c) for i, c in enumerate(earlier)])
    member = member.where("node <> first").join(roots.select(F.col("node").alias("_of"), "root"), F.col("node") == F.col("_of"), "left")
    return stash(member.select("key", "node", "size", "at", *earlier, F.coalesce("root", "node").alias("root")), "simhash-rooted")


def other_pairs(member: DataFrame, nodes: DataFrame, similarity: float, most: int, tile: int = TILE) -> DataFrame:
    """(a, b, open): the other pairs of each group that can be similar and are in different components so far, a < b, of
    each member in a unit of work those with `most` others of its size or more; open is null. Where a member has more of
    them a row has the group's key in open, and neither a nor b. Fingerprints folded to FOLDED words, parities as well,
    discard most before they leave the group.

    A pair that also shares one of the EARLIER keys before a group's is left to that key's group: so is no first one, and
    copies that share all their keys are paired once and not once for each.

    In a group of more than `tile` members those of the component that most are in (the major one) are only compared with
    the others: with n members, m of them outside, n * ceil(m / tile) + m * ceil(n / tile) rows are sent. So a large group
    that is one component but for a few stays linear."""
    import pyarrow as pa

    earlier = [f"before{i}" for i in range(EARLIER)]
    parted = contested(member, tile)
    folded = [F.expr(" ^ ".join(f"bits[{k}]" for k in range(i, WIDE, FOLDED))).alias(f"bits{i}") for i in range(FOLDED)]
    bits = [f"bits{i}" for i in range(FOLDED)]
    rows = member.join(parted, F.col("key") == F.col("_key")).join(nodes.select(F.col("node").alias("_named"), *folded), F.col("node") == F.col("_named"))
    unit = ["key", "i", "j"]
    units = meetings(rows, ["node", "size", "at", "root", *earlier, *bits])
    dealt = units.repartition(*unit).sortWithinPartitions(*unit)

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        for group, (key, _, _, *columns) in whole_groups(batches, 3):
            order = np.lexsort((columns[2], group))
            group, key, side, node, size, at, root, *others = (c[order] for c in (group, key, *columns))
            keys, words_ = others[:EARLIER], others[EARLIER:]
            given, over = np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=bool)
            rows, step = np.arange(len(node)), 1
            while len(rows := rows[rows + step < len(node)]):
                # sizes are sorted: a row has no partner farther on once one is too large
                rows = rows[~over[rows] & (group[rows] == group[rows + step]) & (size[rows + step] * similarity <= size[rows] + 1e-6)]
                x, y = rows, rows + step
                on = (root[x] != root[y]) & ((side[x] == 2) | (side[x] != side[y])) & can_meet(size[x], at[x], size[y], at[y], similarity)
                x, y = x[on], y[on]
                for p in keys:
                    for q in keys:
                        on = (p[x] != q[y]) | (p[x] == 0)
                        x, y = x[on], y[on]
                apart = sum(np.bitwise_count((w[x] ^ w[y]).view(np.uint64)).astype(np.int64) for w in words_)
                on = apart <= (size[x] + size[y]) * (1 - similarity) / (1 + similarity) + 1e-6
                x, y = x[on], y[on]
                over[x] = given[x] >= most
                given[x] += 1
                x, y = x[~over[x]], y[~over[x]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y])), pa.nulls(len(x), pa.int64())], ["a", "b", "open"])
                step += 1
            if over.any():
                found = np.unique(key[over])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64()), pa.array(found)], ["a", "b", "open"])

    return dealt.mapInArrow(run, "a long, b long, open long").distinct()


def joined(links: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, root) of `components`, (node, root) of the components that become part of another): what links (a, b) make
    of components (node, root). Links between the same components are one."""
    of = lambda c: roots.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"_root_{c}"))
    ends = links.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    merged = components(ends.select(F.coalesce("_root_a", "a").alias("a"), F.coalesce("_root_b", "b").alias("b")))
    return stash(renewed(roots, merged).unionByName(merged), "simhash-roots"), merged


def renewed(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """The rows, all columns, with the component that their root is part of since."""
    now = merged.select(F.col("node").alias("_was"), F.col("root").alias("_now"))
    return rows.join(now, F.col("root") == F.col("_was"), "left").select(*[F.coalesce("_now", "root").alias(c) if c == "root" else c for c in rows.columns])


def verified(pairs: DataFrame, named: DataFrame, df: DataFrame, similarity: float, shingle: int, text_col: str, id_col: str) -> DataFrame:
    """The pairs whose texts' shingles are similar. named: (node, first) with the id of a text of each node.

    A text is sent once to each of its partners' groups: those of `a`, cut into parts of about COMPARED texts."""
    import pyarrow as pa

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / COMPARED).alias("parts")).withColumnRenamed("a", "_a")
    dealt = pairs.join(parts, F.col("a") == F.col("_a")).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    dealt = stash(dealt, "simhash-pairs")
    roles = dealt.select("a", "part", F.col("b").alias("is"), F.lit(1).alias("turn")).unionByName(dealt.select("a", "part", F.col("a").alias("is"), F.lit(0).alias("turn")).distinct())
    roles = stash(roles.join(named.where("first IS NOT NULL").select("node", F.col("first").alias("_id")), F.col("is") == F.col("node")).drop("node"), "simhash-roles")
    roles = F.broadcast(roles) if roles.count() * 80 <= BROADCAST_BYTES else roles
    texts = df.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("text")).join(roles, F.col("_doc") == F.col("_id"))
    sent = texts.select("a", "part", "turn", "is", "text").repartition("a", "part").sortWithinPartitions("a", "part", "turn")

    def run(batches: Iterable) -> Iterator:
        import numpy as np

        shingles, group, hub = Shingles(shingle), None, None
        for batch in batches:
            found = []
            for a, part, turn, name, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if (a, part) != group:
                    group, hub = (a, part), None
                own = shingles(text.as_py())
                if set_name(own) != name:  # another text of the same id
                    continue
                if not turn:
                    hub = own
                elif hub is not None:
                    shared = len(np.intersect1d(hub, own, assume_unique=True))
                    if shared >= similarity * (len(hub) + len(own) - shared):
                        found.append((a, name))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def similar(df: DataFrame, similarity: float = 0.8, shingle: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) for every row: texts whose sets of word shingles have a Jaccard coefficient of `similarity`
    or more are linked; texts of equal sets are one.

    Every such pair is linked, if not directly then by others, and no pair below is. Texts without words are linked to
    each other. Nulls and repeats as in `near_duplicates`; a text none of whose rows has an id is linked to its equals
    alone.
    """
    docs = stash(sketches(df, similarity, shingle, text_col, id_col), "simhash-sketches")
    nodes = stash(docs.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.any_value(c).alias(c) for c in ("size", "bits", "pivots")]), "simhash-nodes")
    shared = stash(met(docs), "simhash-met")
    check = lambda pairs, name: stash(verified(stash(near(pairs, nodes, similarity), f"simhash-{name}"), nodes.select("node", "first"), df, similarity, shingle, text_col, id_col), f"simhash-{name}-verified")
    roots = components(check(first_pairs(shared, similarity), "first"))
    # a group of n similar texts becomes one component by a few pairs of each member, and not by n * n / 2; only groups with
    # pairs left between components give more of them, until none holds any back
    member, most = rooted_members(shared, roots), PAIRED
    while True:
        found = stash(other_pairs(member, nodes, similarity, most), "simhash-found")
        roots, merged = joined(check(found.where("open IS NULL").select("a", "b"), "others"), roots)
        left = found.where("open IS NOT NULL").select(F.col("open").alias("key"))
        if left.isEmpty():
            break
        member, most = stash(renewed(member.join(left, "key", "left_semi"), merged), "simhash-rooted"), most * MORE
    rooted = nodes.select("node", "first").join(roots.withColumnRenamed("node", "_of"), F.col("node") == F.col("_of"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("node").alias("_node"), "component_id")
    return docs.select("doc_id", "node").join(stash(named, "simhash-components"), F.col("node") == F.col("_node")).select("doc_id", "component_id")


def drop_near_duplicates(df: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of `df`, all columns, of one document of each component of `similar`: that with the smallest doc_id.

    Rows that share a doc_id are one document. No decision can name a row without an id: such rows stay.
    """
    found = similar(df, similarity, shingle)
    return drop_ids(df, found.where("doc_id <> component_id").select("doc_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

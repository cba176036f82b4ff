"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.llm.shared import drop_path, fresh, numbered, written

#: Shingles hashed and counted at a time.
CHUNK = 1 << 16
#: Bits of its own half that a variant is dealt by besides the other half; variants that one task sorts.
SUB = 6
VARIANTS_A_TASK = 3_000_000


def fingerprint_of(text: bytes | None, shingle: int, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, CHUNK):
        h = np.array([xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, shingle: int = 5) -> Column:
    """SimHash of each whole text as a signed long: A-Z in lower case, words between ASCII white space, XXH64 (seed 42) of each shingle, repeats
    included; a bit is 1 if more than half of the hashes have it. Fewer words: the whole sequence is the only shingle. Null or no words: 0."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [fingerprint_of(v.as_py(), shingle) for v in batch.cast(pa.large_binary())]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return of(text)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def ball_masks(radius: int, bits: int = 64) -> tuple[list[int], list[int]]:
    """What a fingerprint is XORed with: the variants within half the radius, rounded down, and those further ones at half of an odd radius, rounded up.

    Of two fingerprints that differ in an odd radius r of bits, one has an odd number of ones; it alone goes (r + 1) / 2 steps, the
    other (r - 1) / 2. Of the r bits, (r + 1) / 2 are in the same half of the word, so steps within one half are enough.
    """
    ball = [sum(1 << i for i in c) for n in range(radius // 2 + 1) for c in combinations(range(bits), n)]
    half = bits // 2
    rim = [sum(1 << i for i in c) for a in (0, half) for c in combinations(range(a, a + half), (radius + 1) // 2)] if radius % 2 else []
    return ball, rim


def _routes(radius: int) -> list[tuple[int, int, list[int], list[int]]]:
    """(half, change, ball, rim): masks by what they change of the bits that a variant is dealt by.

    For variants at the rim in one half these are the bits of the other half, which stay, and SUB bits of their own: all masks of a group
    take a fingerprint to the same place, so it is sent there once and its variants are made there.
    """
    ball, rim = ball_masks(radius)
    out = []
    for half in (0, 1):
        own = ((1 << 32) - 1) << 32 * half
        key = ~(own >> SUB & own) & ((1 << 64) - 1)
        groups: dict[int, tuple[list[int], list[int]]] = {}
        for i, masks in enumerate((ball, [m for m in rim if not m & ~own])):
            for m in masks:
                groups.setdefault(m & key, ([], []))[i].append(m)
        out += [(half, change, *g) for change, g in groups.items()]
    return out


def ball_links(found: DataFrame, fp: str, radius: int = 3) -> DataFrame:
    """Links (u, v), u > v, between distinct fingerprints; two fingerprints are joined by links exactly if some chain of pairs within radius joins them.

    Every fingerprint emits its variants, and those that are equal meet. They are dealt by most of their bits, so that many variants of a
    fingerprint travel as one row. Fingerprints within half the radius of a variant are all within the radius of each other, and those
    at the rim of an odd radius within the radius of each of these, so the smallest inner one is linked with all others of the variant:
    no pairs inside a bucket, and no link of the closure lost. A bucket holds at most as many fingerprints as there are masks,
    since fingerprints are distinct. Links are deduplicated and verified.
    """
    routes = _routes(radius)
    longs = lambda masks: F.array(*(F.lit(_signed(m)) for m in masks)).cast("array<bigint>")
    one = found.select(F.col(fp).alias("u")).where(F.col("u").isNotNull()).distinct()
    odd = F.bit_count("u") % 2 == 1
    ways = [F.struct(F.lit(g).cast("short").alias("g"), F.lit(half).cast("byte").alias("half"), F.lit(_signed(change)).cast("long").alias("change")) for g, (half, change, _, _) in enumerate(routes)]
    key = [((1 << 32) - 1) << 32 * h for h in (0, 1)]
    kept = F.when(F.col("way.half") == 0, F.lit(_signed(~(key[0] >> SUB & key[0]) & ((1 << 64) - 1)))).otherwise(F.lit(_signed(~(key[1] >> SUB & key[1]) & ((1 << 64) - 1))))
    inner_only = F.array(*(w for w, r in zip(ways, routes, strict=True) if r[2]))
    sent = one.select("u", F.explode(F.when(odd, F.array(*ways)).otherwise(inner_only)).alias("way"))
    sent = sent.select("u", "way.g", "way.half", F.col("u").bitwiseAND(kept).bitwiseXOR(F.col("way.change")).alias("key"))
    made = sum(len(b) + len(r) / 2 for _, _, b, r in routes)
    parts = max(1, round(one.count() * made / VARIANTS_A_TASK))
    met = sent.repartition(parts, "half", "key")
    ball = F.get(F.array(*(longs(r[2]) for r in routes)), F.col("g").cast("int"))
    both = F.get(F.array(*(longs(r[2] + r[3]) for r in routes)), F.col("g").cast("int"))
    inner = F.get(F.array(*(F.lit(len(r[2])) for r in routes)), F.col("g").cast("int"))
    variants = met.select("u", "half", "key", "g", F.posexplode(F.when(odd, both).otherwise(ball)).alias("i", "m"))
    variants = variants.select("half", "key", "u", F.col("u").bitwiseXOR(F.col("m")).alias("at"), F.when(F.col("i") < inner, F.col("u")).alias("inner"))
    centre = variants.select("u", F.min("inner").over(Window.partitionBy("at", "half", "key")).alias("v")).where("u <> v")
    ends = centre.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return ends.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) for every node of links (u, v), u > v; root is the smallest node of its component.

    Alternating large-star and small-star steps; each round is written to the shared folder and the one before removed. Only a count and
    a checksum come to the driver. Hubs are met by joins that can be split, never gathered.
    """
    now, path = written(links, "links")
    was = None
    while True:
        n, check = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if was == (n, check):
            break
        was = (n, check)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("m", "u").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        hung = large.join(low, F.col("u") == F.col("x"))
        small = hung.select(F.col("u"), F.col("m").alias("v")).union(hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        then, new = written(small, "links")
        drop_path(links.sparkSession, path)
        now, path = then, new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")), path


def _roots(per_fp: DataFrame, radius: int) -> DataFrame:
    """per_fp (a row for each distinct fp) with root, the smallest fingerprint of its component."""
    kept, _ = written(per_fp, "distinct")
    roots, _ = components(ball_links(kept, "fp", radius))
    return kept.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3) -> DataFrame:
    """id, fingerprint (long) and component_id (smallest id of the texts that links reach, null ids aside) for every row.

    Texts whose fingerprints differ in at most radius bits are linked; equal texts have equal fingerprints and meet as one. Null, empty and
    blank texts have fingerprint 0 and are linked like others. Repeated rows give repeated results; an empty table gives none. Other
    columns are not looked at.
    """
    slim, _ = written(df.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle).alias("fp")), "fingerprints")
    rooted, _ = written(_roots(slim.groupBy("fp").agg(F.min("id").alias("least")), radius), "roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(names, "root").select("fp", "component_id")
    return slim.join(by_fp, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


#: Wide fingerprints: longs of bits by which similarity is told, from shingles of some words.
WIDE = LANES = 4
#: Blocks that the wide fingerprints are dealt to at least, beyond a few; rows of a block at most; rows and columns compared at a time.
FEW, BLOCKS, BLOCK_ROWS = 1 << 12, 8, 1 << 18
TILE = (8, 4096)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _majority(words: np.ndarray, k: int, lanes: Sequence[int]) -> np.ndarray:
    """For each lane the 64 bits that more than half of the shingles of k words (all words, if fewer) have in its hash of them."""
    k = min(k, len(words))
    n = len(words) - k + 1
    ones = np.zeros(64 * len(lanes), np.int64)
    salt = np.array([(lane + 1) * int(_ODD) % (1 << 64) for lane in lanes], np.uint64)
    for at in range(0, n, CHUNK // 16):
        m = min(CHUNK // 16, n - at)
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = _mixed(h * _ODD + words[at + j : at + j + m])
        bits = np.unpackbits(_mixed(h[:, None] + salt).view(np.uint8), axis=1, bitorder="little")
        for i in range(0, m, 255):  # sums of 255 bits fit a byte
            ones += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.int64)


def wide_of(text: bytes | None, shingle: int) -> np.ndarray:
    """WIDE longs of the bits that most shingles have; no words: zeros."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(LANES, np.int64)
    number = {w: xxh64_intdigest(w, 42) for w in set(words)}
    hashed = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        return _majority(hashed, shingle, range(WIDE))


def wide_fingerprints(text: Column, shingle: int = 5) -> Column:
    """array<bigint> of wide_of() for each whole text; words and lower case as for fingerprints()."""

    @F.arrow_udf("array<bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [wide_of(v.as_py(), shingle) for v in batch.cast(pa.large_binary())]
            yield pa.ListArray.from_arrays(pa.array(range(0, LANES * len(found) + 1, LANES), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    return of(text)


def _close(left: np.ndarray, right: np.ndarray, limit: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all columns of left and right that differ in limit bits or fewer; a row a lane. within: right is left, only i < j."""
    for i in range(0, left.shape[1], TILE[0]):
        for j in range(i if within else 0, right.shape[1], TILE[1]):
            a, b = left[:, i : i + TILE[0], None], right[:, None, j : j + TILE[1]]
            differ = np.bitwise_count(a[0] ^ b[0])
            for k in range(1, WIDE - 1):  # strangers differ in more by then; 192 bits at most, which fit a byte
                differ += np.bitwise_count(a[k] ^ b[k])
            near = differ <= limit
            if near.any():
                x, y = np.nonzero(near)
                on = differ[x, y] + np.bitwise_count(a[-1, x, 0] ^ b[-1, 0, y]).astype(np.int64) <= limit
                if within:
                    on &= i + x < j + y
                yield x[on] + i, y[on] + j


def _forest(pairs: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pairs (u, v) of 0 to n - 1 those that join what was apart: they reach what all reach, and are fewer than n."""
    root, waiting, held = np.arange(n), [], 0
    for pair in chain(pairs, [None]):
        if pair is not None:
            apart = root[pair[0]] != root[pair[1]]
            waiting.append((pair[0][apart], pair[1][apart]))
            held += len(waiting[-1][0])
        if not waiting or pair is not None and held < CHUNK:
            continue
        u, v = (np.concatenate(c) for c in zip(*waiting, strict=True))
        while len(u):
            high, low = np.maximum(root[u], root[v]), np.minimum(root[u], root[v])
            order = np.lexsort((low, high))
            taken = order[np.diff(high[order], prepend=-1) > 0]
            yield u[taken], v[taken]
            up = np.arange(n)
            up[high[taken]] = low[taken]  # every root hangs on a smaller one, so no rings
            while (up[up] != up).any():
                up = up[up]
            root = up[root]
            apart = root[u] != root[v]
            u, v = u[apart], v[apart]
        waiting, held = [], 0


def similar_links(wide: DataFrame, similarity: float, every: bool = True) -> DataFrame:
    """All links (u, v), u > v, between nodes whose fingerprints agree in that share of their bits or more; wide: node (long), fp (as wide_fingerprints() gives
    it), a row a node. Not every: of the links that a task finds, only so many as reach all that they reach; the groups are the same.

    Every pair is compared, so none is lost. Rows are dealt to blocks and each two blocks, or one with itself, meet in a task of their own. How many
    blocks changes no links of every, and no groups. Time grows with the square of the nodes; no pairs but links leave a task.
    """
    limit = int(64 * WIDE * (1 - similarity) + 1e-9)
    n = wide.count()
    blocks = 1 if n <= FEW else max(BLOCKS, -(-n // BLOCK_ROWS))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    task = F.shiftright(high * (high + 1), 1) + low
    lanes = [f"l{i}" for i in range(WIDE)]
    own = wide.select("node", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), *(F.get("fp", F.lit(i)).alias(c) for i, c in enumerate(lanes)))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(task.alias("task"), "block", "other", "node", *lanes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("task", "block", "other", "node", *lanes)] for b in batches if b.num_rows]
        if not held:
            return
        at, mine, theirs, node, *bits = (np.concatenate(c) for c in zip(*held, strict=True))
        bits = np.stack(bits).view(np.uint64)
        for t in np.unique(at):
            left, right = (np.flatnonzero((at == t) & side) for side in (mine <= theirs, mine >= theirs))
            pairs = ((left[i], right[j]) for i, j in _close(bits[:, left], bits[:, right], limit, bool((mine[left] == theirs[left]).all())))
            for i, j in pairs if every else _forest(pairs, len(at)):
                u, v = np.maximum(node[i], node[j]), np.minimum(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return sent.repartitionById(blocks * (blocks + 1) // 2, "task").mapInArrow(compare, "u long, v long")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df, all columns, but of each group of near-duplicates only that with the smallest id (null last; of rows with equal ids, one).

    Texts are linked if their fingerprints, 256 bits over shingles of that many words, agree in a share of `similarity` of their bits or more,
    and groups are what links reach. Such pairs differ in some 50 bits, far beyond any ball that could be listed, so all pairs of distinct fingerprints are
    compared (the README has measured figures). Null, empty and blank texts are alike. An empty table gives none.
    """
    (row,) = fresh(df, "row")
    marked = numbered(df, row)
    slim, _ = written(marked.select(F.col(id_col).alias("id"), wide_fingerprints(F.col(text_col), shingle).alias("fp"), F.col(row).alias("row")), "fingerprints")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    per_fp, _ = written(slim.groupBy("fp").agg(F.min(rank).alias("best")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    roots, _ = components(similar_links(per_fp.select("node", "fp"), similarity, every=False))
    rooted = per_fp.select("best", F.col("node").alias("own")).join(roots, F.col("own") == F.col("node"), "left")
    best = rooted.groupBy(F.coalesce("root", "own").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return marked.join(best, row, "left_semi").select(*df.columns)

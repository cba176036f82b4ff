"""Benchmark decontamination by winnowing. Column expressions and joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.llm.shared import all_of, ascii_lower, fresh, let, numbered, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the filter of test fingerprints: 32 for each, within these bounds (8 KB and 32 MB); beyond 8 million fingerprints it lets more through, to the exact join.
LEAST_BITS, MOST_BITS = 16, 28
#: Distinct test fingerprints up to which their table (some 150 bytes a row) is broadcast; more are joined by shuffling.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case: runs of letters, digits and anything beyond ASCII; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def _hash_at(h: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(h, i + j) for j in range(n)))


def _starts(h: Column, n: int) -> Column:
    """Where n words begin: 0 to size - n."""
    return F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))


def spots(h: Column, window: int, k: int, wanted) -> Column:
    """array<struct<at, fp, near>>: winnowed fingerprints of the word hashes h that wanted() lets pass.

    For every window of that many words the least hash of its k-grams (the first, if several) is kept: any shared span of window words has the same one at the same
    place in both texts. near: the word hashes that any such window can hold, from window - k words before at to window words after (null beyond the text).
    """
    grams = F.transform(_starts(h, k), lambda i: _hash_at(h, i, k))

    def of(g):
        least = F.transform(_starts(h, window), lambda i: F.least(*(F.get(g, i + j) for j in range(window - k + 1))))

        def places(m):
            chosen = F.filter(F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0))), lambda i: F.coalesce(wanted(F.get(m, i)), F.lit(False)))
            at = F.array_distinct(F.transform(chosen, lambda i: i + F.array_position(F.slice(g, i + 1, window - k + 1), F.get(m, i)).cast("int") - 1))
            return F.transform(at, lambda p: F.struct(p.alias("at"), F.get(g, p).alias("fp"), F.array(*(F.get(h, p + j) for j in range(k - window, window))).alias("near")))

        return let(least, places)

    return let(grams, of)


def extended(left: Column, right: Column, window: int, k: int) -> tuple[Column, Column]:
    """How many words before and after the shared k-gram are equal too, for two contexts as spots() gives them; both are null if the k-grams differ."""
    same = [F.coalesce(F.get(left, F.lit(j)) == F.get(right, F.lit(j)), F.lit(False)) for j in range(2 * window - k)]

    def run(places):
        out = F.lit(len(places))
        for n in range(len(places) - 1, -1, -1):
            out = F.when(~same[places[n]], F.lit(n)).otherwise(out)
        return out

    equal = all_of([same[j] for j in range(window - k, window)])
    return F.when(equal, run([*range(window - k - 1, -1, -1)])), F.when(equal, run([*range(window, 2 * window - k)]))


def _windows(words: Column, where: Column, n: int) -> Column:
    """struct<at, n, a, b> for the windows of n words that begin where; (a, b) is a hash of 128 bits of the words."""

    def one(i):
        text = F.array_join(F.slice(words, i + 1, n), " ")
        return F.struct(i.alias("at"), F.lit(n).alias("n"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(n), text).alias("b"))

    return F.transform(where, one)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _test_spots(benchmark: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """item, fp, near for every distinct fingerprint and context of every item of window words or more."""
    inside = benchmark.select(F.col(id_col).alias("item"), F.explode(let(_hashes(words_of(F.col(text_col))), lambda h: spots(h, window, k, lambda _: F.lit(True)))).alias("x"))
    return inside.select("item", "x.fp", "x.near").distinct()


def _short_items(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item, fp, n, a, b for every item of fewer words, but not none: it is one window, its own hash its fingerprint."""

    def whole(words):
        of = lambda n: F.struct(_hash_at(_hashes(words), F.lit(0), n).alias("fp"), F.get(_windows(words, F.array(F.lit(0)), n), F.lit(0)).alias("w"))
        return F.coalesce(*(F.when(F.size(words) == n, of(n)) for n in range(1, window)))

    found = benchmark.select(F.col(id_col).alias("item"), let(words_of(F.col(text_col)), whole).alias("x")).where("x IS NOT NULL")
    return found.select("item", "x.fp", F.col("x.w.n").alias("n"), F.col("x.w.a").alias("a"), F.col("x.w.b").alias("b")).distinct()


def _sets(tests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """keys, set (null if only null items have them), and (set, item) of every set: sets of items are told apart by hashes that merge."""
    named = tests.where(F.col("item").isNotNull())
    of_items = named.groupBy(*keys).agg(F.count("*").alias("m"), F.sum(F.xxhash64("item").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "item")).alias("x"))
    sets, _ = written(tests.select(*keys).distinct().join(of_items, keys, "left").select(*keys, F.when(F.col("m").isNotNull(), F.xxhash64("m", "s", "x")).alias("set")), "sets")
    return sets, named.join(sets, keys).select("set", F.col("item").cast("string").alias("item")).distinct()


def _bit_filter(fps: DataFrame) -> tuple[DataFrame, int]:
    """One row with an array of longs, a bit set for each fp at its low bits; and log2 of the number of bits. Its size is bounded by MOST_BITS."""
    n = fps.count()
    log = min(MOST_BITS, max(LEAST_BITS, (32 * max(1, n)).bit_length()))
    bit = F.pmod(F.col("fp"), F.lit(1 << log))
    words = fps.groupBy((bit / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("fp", F.lit(64)).cast("int"))).alias("w"))
    spark = fps.sparkSession
    every = spark.range(1 << (log - 6)).select(F.col("id").cast("int").alias("i")).join(words, "i", "left").select("i", F.coalesce("w", F.lit(0)).alias("w"))
    kept, _ = written(every.coalesce(1), "bits")
    return kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("bits")), log


def _found(documents: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: row, id, n_words of every document; row, at, n, set of every span that it shares with the benchmark; set, item."""
    tests, _ = written(_test_spots(benchmark, item_col, item_text, window, k), "tests")
    short, _ = written(_short_items(benchmark, item_col, item_text, window), "short")
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # window - 1 values at most
    bits, log = _bit_filter(tests.select("fp").union(short.select("fp")).distinct())
    mask = F.lit((1 << log) - 1)

    def seen(fp):
        i = fp.bitwiseAND(mask)
        word = F.get(F.col("bits"), F.shiftright(i, 6).cast("int"))
        return F.call_function("shiftright", word, i.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def passing(words):
        def of(h):
            known = lambda n: _windows(words, F.filter(_starts(h, n), lambda i: seen(_hash_at(h, i, n))), n)
            whole = F.concat(*(known(n) for n in lengths)) if lengths else F.array().cast("array<struct<at:int,n:int,a:bigint,b:bigint>>")
            return F.struct(F.size(words).cast("long").alias("n_words"), spots(h, window, k, seen).alias("spots"), whole.alias("short"))

        return let(_hashes(words), of)

    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), bits.scalar().alias("bits"))
    found = texts.select("id", let(words_of(F.col("text")), passing).alias("x"))
    slim, _ = written(found.select(F.monotonically_increasing_id().alias("row"), "id", "x.n_words", "x.spots", "x.short"), "passing")
    sets, items = _sets(tests, ["fp", "near"])
    side = sets.withColumnRenamed("near", "other")
    met = slim.select("row", F.inline("spots")).join(F.broadcast(side) if sets.count() <= BROADCAST_ROWS else side, "fp")
    before, after = extended(F.col("near"), F.col("other"), window, k)
    spans = met.select("row", "at", "set", before.alias("before"), after.alias("after")).where(F.col("before") + F.col("after") >= window - k)
    hits = spans.select("row", (F.col("at") - F.col("before")).alias("at"), (F.col("before") + F.col("after") + k).alias("n"), "set")
    if lengths:
        few, more = _sets(short, ["a", "b"])
        whole = slim.select("row", F.inline("short")).join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, ["a", "b"])
        hits, items = hits.union(whole.select("row", "at", "n", "set")), items.union(more).distinct()
    kept, _ = written(hits.distinct(), "hits")
    return slim.select("row", "id", "n_words"), kept, items


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 8, k: int = 4) -> DataFrame:
    """One row per document: row (its number), id, n_words, hits (array<struct<at, n>>: spans that it shares with the benchmark), items (sorted strings).

    A shared span is window words or more in a row that stand in an item too, or a whole item of fewer words. Texts are read once: of each window the least k-gram
    hash is kept, and fingerprints that a filter of bounded size may hold of the benchmark are joined with those of the benchmark, each with the words around
    it, by which the hit is extended to both sides: every shared window holds a joined fingerprint, so every one is found, and equal words prove it. Sets
    of items are told apart by hashes that merge, not gathered per window; a passage that many items share costs one row a document. Null
    items and documents have no words; an item with a null id marks words but is not counted among the items.
    """
    slim, kept, items = _found(documents, benchmark, id_col, text_col, item_col, item_text, window, k)
    where = kept.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("hits"))
    named = kept.where(F.col("set").isNotNull()).select("row", "set").distinct().join(items, "set").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<struct<at:int,n:int>>")
    joined = slim.join(where, "row", "left").join(named, "row", "left")
    return joined.select("row", "id", "n_words", F.coalesce(F.array_sort("hits"), none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def words_hit(hits: Column) -> Column:
    """Number of words inside any of the sorted windows."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))

    def step(acc, x):
        end = x["at"] + x["n"]
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], x["at"]))
        return F.struct((acc["sum"] + new).alias("sum"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, start, step, lambda acc: acc["sum"])


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 8, k: int = 4, least_items: int = 1, short_items: bool = False) -> DataFrame:
    """The documents (all columns) that share spans of window words or more with fewer than least_items items.

    short_items: a whole item of fewer words counts too; by default it does not, as a few words in a row may stand in any text. Items with null ids do not count.
    """
    mark, row = fresh(documents, "mark", "row")
    marked = numbered(documents, row)
    slim, kept, items = _found(marked.select(F.col(row).alias("id"), F.col(text_col).alias("text")), benchmark, "id", "text", item_col, item_text, window, k)
    counted = kept.where(F.col("set").isNotNull() & (F.lit(short_items) | (F.col("n") >= window))).select("row", "set").distinct()
    if least_items > 1:
        counted = counted.join(items, "set").groupBy("row").agg(F.count_distinct("item").alias("m")).where(F.col("m") >= least_items)
    bad = slim.join(counted.select("row").distinct(), "row").select(F.col("id").alias(mark))
    return marked.join(bad, F.col(row) == F.col(mark), "left_anti").select(*documents.columns)

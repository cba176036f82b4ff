"""The ten operators against brute force over the smallest tables, and on awkward tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftlake.llm import decontaminate, lines, mixing, queries, secrets, sharding, shared, simhash, tokens, topk, toxicity, warc

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank and long texts, ties, repeated rows, and names that operators use themselves."""
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, None), (4, LONG, "en", "a", 1), (5, "same text here", "en", "b", 1), (5, "same text here", "en", "b", 1), (None, "same text here", "en", "b", 1), (7, "größe 😀 tail", "de", "c", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("row", "id", "size", "shard", "fp", "turn", "target", "at", "score", "items")})


def same(rows, columns):
    flat = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else str(v)
    return sorted(tuple(str(flat(v)) for v in r) for r in pd.DataFrame([tuple(r) for r in rows], columns=columns).sort_index(axis=1).astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got.collect(), got.columns) == same(want.fetchall(), want.columns)


def test_empty_tables(spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_awkward_tables(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    for t in TABLES[1:]:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        nulls = df.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))
        df.unionByName(nulls).withColumn("id", F.lit(1)).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name, query in queries.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        if name not in ("op1_warc", "op4_exact_top_k"):
            assert len(rows) == 8, name


# 1 WARC


def test_warc_round_trip(spark):
    big, small = "x" * 1200, "y" * 10
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", small), (4, "http://d", small), (5, "http://é", None), (6, "u", big), (None, "n", "z" * 2000), (6, "u", big)]
    files, uri = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.read_archives(files, uri).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.page_id].append(r)
    assert len(got) == 8 and [r.record_type for r in by_id[6]] == ["response"] * 2
    assert {(r.record_type, r.refers_to) for i in (1, 2) for r in by_id[i]} == {("revisit", 6)}
    assert all(r.record_type == "response" and r.refers_to is None for i in (3, 4, 5, None) for r in by_id[i])
    assert by_id[5][0].payload == b"" and by_id[3][0].payload == small.encode() and by_id[1][0].payload is None
    assert by_id[1][0].payload_digest == hashlib.sha1(big.encode()).hexdigest() and by_id[1][0].payload_bytes == 1200
    with open(files.first().file, "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.MAGIC


# 2 secrets

TEXTS = st.lists(st.sampled_from(["password", "PASSWD", "api_key", "apikey", "Secret", "token", " ", "=", ":", '"', "'", "hunter2!", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "Zm9vYmFy", "é", "😀", "\n", "-", "xK9/dQ2+wE7", "example", "Zq8xK2mN5pR7tV9wY1aB3c"]), max_size=30).map("".join)
PATTERN = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}


def base_of(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, (p, g, least)) in enumerate(PATTERN.items()) for m in regex.finditer(p, text or "", regex.ASCII) if len(m.group(g)) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def entropy_of(text, classes=secrets.CLASSES):
    out = []
    for c in classes:
        for m in regex.finditer(f"[{c.chars}]{{{c.window},}}", text or ""):
            run = m.group()
            if any(regex.search(a, run) for a in secrets.ALLOWED):
                continue
            bits = lambda w: -sum(n / c.window * np.log2(n / c.window) for n in Counter(w).values())
            at = 0
            for word in [*regex.finditer(secrets.WORDS, run), None]:
                part = run[at : word.start() if word else len(run)]
                hot = [i for i in range(len(part) - c.window + 1) if bits(part[i : i + c.window]) >= c.threshold - 1e-9]
                if hot:
                    out.append((c.kind, m.start() + at + hot[0], m.start() + at + hot[-1] + c.window))
                at = word.end() if word else 0
    return out


def check_secrets(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.secret_spans(F.col("t")).alias("s"))
    for r in df.select("t", secrets.spans_text(F.col("s.base")).alias("base"), secrets.spans_text(F.col("s.all")).alias("all")).collect():
        base = base_of(r.t)
        assert r.base == ",".join(base), r.t
        told = [tuple(x.split(":")) for x in base]
        new = [f"{k}:{a}:{b}" for k, a, b in entropy_of(r.t) if not any(int(x) <= a and int(y) >= b for _, x, y in told)]
        assert sorted(r.all.split(",") if r.all else []) == sorted(base + new), r.t


def test_secrets_against_brute_force(spark, docs):
    check_secrets(spark, [None, "", *docs.text.tolist()])


@settings(max_examples=3, deadline=None)
@given(st.lists(TEXTS, min_size=30, max_size=60))
def test_secrets_of_made_up_texts(spark, texts):
    check_secrets(spark, texts)


def test_many_secrets_in_one_text(spark):
    """More matches than a block of running values, and spans that others cover; the time is linear in them."""
    check_secrets(spark, ["token=abcdef12 " * 700, "key=Zq8xK2mN5pR7tV9wY1aB3cD4eF6gH0jL token=Zq8xK2mN5pR7tV9wY1aB3cD4eF6gH0jL " * 150])
    df = spark.createDataFrame([("token=abcdef12 " * 100_000,)], "t string").select(secrets.secret_spans(F.col("t")).alias("s"))
    assert tuple(df.select(F.size("s.base"), F.size("s.all"), F.element_at("s.base", -1)["end"]).first()) == (100_000, 100_000, 1_499_999)


def test_allowed_words_hide_only_their_surroundings(spark):
    key = "Zq8xK2mN5pR7tV9wY1aB3cD4eF6gH0jL"
    df = spark.createDataFrame([(f"example_key={key}",), ("Zq8xK2mN5pexampletV9wY1aB3",), (f"/examples/{key}",)], "t string")
    found = [r.n for r in df.select(F.size(secrets.secret_spans(F.col("t"))["all"]).alias("n")).collect()]
    assert found == [1, 0, 1]


# 3 tokens


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = [None, "", "   ", "<unk> [CLS] </s>", "a" * 5000, LONG, *docs.text.tolist()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = dict(df.select("i", tokens.token_lengths(F.col("t"), queries.tokenizer_path()).alias("n")).collect())
    for i, t in enumerate(texts):
        assert got[i] == len(tokenizer.encode(t or "", add_special_tokens=False)), (t or "")[:50]


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(tokens, "CALL_BYTES", 10)
    text = b"ab cd efghijklmnopqrst uv " * 20
    assert b"".join(tokens._pieces(text)) == text
    path = queries.tokenizer_path()
    assert tokens.count_texts([text, None, b""], tokens.counter(path), True) == tokens.count_texts([text, None, b""], tokens.counter(path), False)


def test_words_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    known = tokens.counter(queries.tokenizer_path())
    texts = [" ".join(f"word{i * j}" for i in range(40)).encode() + b" " + b"x" * 5000 for j in range(30)]
    assert tokens.count_texts(texts, known, True) == tokens.count_texts(texts, known, False)
    known = tokens.counter(queries.tokenizer_path())
    for t in texts:
        tokens.count_texts([t], known, True)
        assert len(known.young) <= 50 + 41 and len(known.old) <= 50 + 41 and all(len(w) <= tokens.LONGEST for w in known.young | known.old)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Strip"}}, {"pattern": r" ?[^\s\p{L}]+|\p{L}+"}, {"post_processor": {"type": "Other"}}, {"lstrip": True}, {}])
def test_safe_boundaries_are_known_exactly(tmp_path, change):
    import json

    d = json.loads(open(queries.tokenizer_path(), encoding="utf-8").read())
    d["model"] = {}
    if "pattern" in change:
        d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = change["pattern"]
    elif "lstrip" in change:
        d["added_tokens"][0]["lstrip"] = True
    else:
        d |= change
    path = tmp_path / "t.json"
    path.write_text(json.dumps(d))
    assert tokens._drops_white_space(str(path)) == (change == {})


# 4 top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(700, 8)), np.zeros((20, 8)), np.ones((30, 8))])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    q = np.floor(x * 1024).astype(np.int64)
    got = defaultdict(list)
    for r in topk.exact_top_k(vectors, F.col("id") % 50 == 0, 7, data_block=200, query_block=6).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    scores = q @ q.T
    for i in range(0, 750, 50):
        assert got[i] == [(j, scores[i, j]) for j in sorted((j for j in range(750) if j != i), key=lambda j: (-scores[i, j], j))[:7]]
    again = topk.quantised(spark.createDataFrame(rows + [rows[3], rows[50], (7, [1.0] * 3), (100, [2.0] * 3)], "vec_id long, e array<double>"), "vec_id", "e")
    got = defaultdict(list)
    for r in topk.exact_top_k(again, F.col("id") % 50 == 0, 800, data_block=200, query_block=6).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for i in range(0, 750, 50):
        every = [(j, int(scores[i, j])) for j in [*range(750), 3, 50] if j != i] + ([(7, 3 * 2048 * 1024)] if i == 100 else [])
        assert got[i] == sorted(every, key=lambda x: (-x[1], x[0]))
    few = topk.quantised(spark.createDataFrame(rows[:4], "vec_id long, e array<double>"), "vec_id", "e")
    assert topk.exact_top_k(few, F.col("id") == 0, 10).count() == 3


# 5 simhash


def slow_fingerprint(text, k):
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def closure(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark, docs):
    d = docs.sort_values("doc_id").reset_index(drop=True)
    fps = [slow_fingerprint(t, 3) for t in d.text]
    want = {(int(i), f"{f:016x}", int(d.doc_id[r])) for i, f, r in zip(d.doc_id, fps, closure(fps, 3), strict=True)}
    assert {tuple(r) for r in queries.op5_simhash(spark, DATA).collect()} == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_ball_links_lose_nothing(spark, radius):
    rng = np.random.default_rng(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = int(rng.integers(0, 1 << 63)) * 2 + 1
        fps.add(base)
        for bits in (1, 2, 3, 3, 4, 5):
            fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots, _ = simhash.components(simhash.ball_links(df, "fp", radius))
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in roots.collect()}
    groups = lambda keys: {frozenset(f for f, k in zip(fps, keys, strict=True) if k == x) for x in set(keys)}
    assert groups([found.get(f, f) for f in fps]) == groups(closure(fps, radius))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 300)]
    roots, _ = simhash.components(spark.createDataFrame(links, "u long, v long"))
    assert {(r.node, r.root) for r in roots.collect() if r.node != r.root} == {(i, 0) for i in range(1, 301)} | {(1000 + i, 1000) for i in range(1, 300)}


def test_near_duplicates_of_similarity(spark):
    """All pairs of sf0.01 whose 256 bits agree in 0.8 or more: none but these are linked, and at least 0.95 of them are."""
    texts = list(dict.fromkeys((t or "").encode() for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text))
    wide = np.array([simhash.wide_of(t, 5) for t in texts])
    df = spark.createDataFrame([(i, [int(v) for v in w]) for i, w in enumerate(wide)], "node long, fp array<bigint>")
    found = {(r.v, r.u) for r in simhash.similar_links(df, 0.8).collect()}
    bits = np.unpackbits(wide[:, : simhash.WIDE].copy().view(np.uint8), axis=1).astype(int)
    differ = bits.sum(1)[:, None] + bits.sum(1)[None, :] - 2 * bits @ bits.T
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(differ <= 51), strict=True) if a < b}
    assert len(want) > 20 and found <= want and len(found) >= 0.95 * len(want)


def edited_texts():
    """600 texts, half of them copies of the others with 14 to 22 of 120 words in a row changed: similarities about 0.8."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(300):
        words = [f"w{v}" for v in rng.integers(0, 5000, 120)]
        texts.append(" ".join(words))
        at, n = int(rng.integers(0, 98)), 14 + i % 9
        words[at : at + n] = [f"v{v}" for v in rng.integers(0, 5000, n)]
        texts.append(" ".join(words))
    return texts


def test_no_similar_link_is_lost(spark, monkeypatch):
    """Links, however many blocks there are, and what keep_one() keeps, against all pairs."""
    texts = edited_texts()
    wide = np.array([simhash.wide_of(t, 5) for t in texts])
    df = spark.createDataFrame([(i, [int(v) for v in w]) for i, w in enumerate(wide)], "node long, fp array<bigint>")
    bits = np.unpackbits(wide[:, : simhash.WIDE].copy().view(np.uint8), axis=1).astype(int)
    differ = bits.sum(1)[:, None] + bits.sum(1)[None, :] - 2 * bits @ bits.T
    want = sorted((int(a), int(b)) for a, b in zip(*np.nonzero(differ <= 51), strict=True) if a < b)
    assert 150 < len(want) < 300
    assert sorted((r.v, r.u) for r in simhash.similar_links(df, 0.8).collect()) == want
    monkeypatch.setattr(simhash, "FEW", 100)
    assert sorted((r.v, r.u) for r in simhash.similar_links(df, 0.8).collect()) == want
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 50)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(600)) - {b for _, b in want})


def test_a_forest_of_links_reaches_what_all_links_reach(spark, monkeypatch):
    """Family of 300 with random edits of one fingerprint, dense and with chains, beside 300 strangers: the same groups by far fewer links."""
    rng = np.random.default_rng(6)
    wide = rng.integers(-(1 << 63), (1 << 63) - 1, (600, simhash.LANES))
    for i in range(1, 300):
        wide[i] = wide[rng.integers(0, i) if i % 2 else 0]
        for b in rng.choice(64 * simhash.WIDE, 5 + i % 45, replace=False):
            wide[i, b // 64] ^= np.int64(simhash._signed(1 << int(b) % 64))
    df = spark.createDataFrame([(i, [int(v) for v in w]) for i, w in enumerate(wide)], "node long, fp array<bigint>")
    monkeypatch.setattr(simhash, "FEW", 100)
    monkeypatch.setattr(simhash, "BLOCKS", 2)
    whole, slim = (simhash.similar_links(df, 0.8, every=e) for e in (True, False))
    every, few = ({(r.v, r.u) for r in links.collect()} for links in (whole, slim))
    roots = [sorted(map(tuple, simhash.components(links)[0].collect())) for links in (whole, slim)]
    assert few < every and 2 * len(few) < len(every) and roots[0] == roots[1]


def slow_wide(text, k, lanes):
    words = [xxh64_intdigest(w, 42) for w in text.split()]
    mask = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    grams = []
    for i in range(max(1, len(words) - k + 1)):
        h = 0
        for w in words[i : i + k]:
            h = mixed((h * 0x9E3779B97F4A7C15 + w) & mask)
        grams.append(h)
    return [sum(1 << b for b in range(64) if 2 * sum(mixed((h + (lane + 1) * 0x9E3779B97F4A7C15) & mask) >> b & 1 for h in grams) > len(grams)) for lane in lanes]


def test_wide_fingerprints_against_brute_force(spark):
    texts = ["", "one", "One TWO", "a b c d e f g", " ".join(f"w{i * i % 300}" for i in range(700))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", simhash.wide_fingerprints(F.col("t")).alias("fp")).collect()
    for r in rows:
        want = slow_wide(r.t.lower().encode(), 5, range(simhash.WIDE)) + slow_wide(r.t.lower().encode(), 2, range(simhash.WIDE, simhash.LANES)) if r.t else [0] * simhash.LANES
        assert [v % (1 << 64) for v in r.fp] == want


def test_a_large_group_of_near_copies_is_one(spark):
    """Equal and near texts by the hundred: one stays, and block pairs grow with the texts, not with their square."""
    base = [f"w{i * 7919 % 9973}" for i in range(300)]
    texts = [" ".join(base)] * 50 + [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(150)] + [" ".join(f"v{(i * 1000 + j) * 104729 % 99991}" for j in range(200)) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, *range(200, 240)]


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7]


# 6 toxicity


def test_toxicity(spark, docs):
    """sf0.1: the smaller tables have 6 toxic held-out texts at most."""
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").merge(pd.read_parquet("/root/testdata/sf0.1/documents.parquet"), on="doc_id").dropna(subset=["toxic", "text"])
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in labels.doc_id])
    model = toxicity.train([t.encode() for t in labels.text[~held]], labels.toxic[~held].astype(int).tolist())
    df = spark.createDataFrame([(t, int(y)) for t, y in zip(labels.text[held], labels.toxic[held], strict=True)], "t string, y int").select("y", toxicity.toxicity(F.col("t"), model).alias("s"))
    rows = df.collect()
    high, low = [r.s for r in rows if r.y], [r.s for r in rows if not r.y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low])
    assert auc > 0.9, auc
    assert np.mean([s >= 0.5 for s in high]) > 0.85 and np.mean([s >= 0.5 for s in low]) < 0.02
    assert all(0 <= r.s <= 1 for r in rows)


def slow_kernel(word):
    out = defaultdict(float)
    for i in range(len(word)):
        for j in range(i + 1, len(word)):
            for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                if max(word[i], word[j], word[k]) < toxicity.LETTERS:
                    out[(word[i] * toxicity.LETTERS + word[j]) * toxicity.LETTERS + word[k]] += toxicity.DECAY ** (k - i + 1)
    norm = np.sqrt(sum(v * v for v in out.values()))
    return {c: v / norm for c, v in out.items()}


def test_toxicity_query_against_brute_force(spark, docs):
    """Every document of the query, scored word by word with the kernel written out."""
    labels = pd.read_parquet(f"{DATA}/labels.parquet").dropna(subset=["toxic"]).groupby("doc_id").toxic.max()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = docs[docs.doc_id.isin(labels.index) & docs.text.notna() & ~docs.doc_id.map(held)]
    usable = labels[[not held(i) for i in labels.index]]
    model = queries.toxicity_model(spark, DATA)
    again = toxicity.train([t.encode() for t in known.text], [int(labels[i]) for i in known.doc_id], float(usable.mean()))
    assert np.allclose(model.weights, again.weights, atol=1e-6) and np.allclose(model[1:], again[1:], atol=1e-4)
    margin = {}
    for t in set().union(*(toxicity.tokens_of((x or "").encode()) for x in docs.text)):
        margin[t] = max(model.bias + sum(model.weights[c] * v for c, v in slow_kernel(p).items()) if len(p) >= 3 else model.bias for p in toxicity.pieces_of(t))
    rows = {r.doc_id: r for r in queries.op6_toxicity(spark, DATA).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        m = sorted({round(margin[t], 9) for t in toxicity.tokens_of((text or "").encode())}, reverse=True)[:2] + [model.bias] * 2
        best, second = min(max(m[0], -1), 1), min(max(m[1], 0), 1)
        assert abs(rows[i].score - 1 / (1 + np.exp(-(model.a * best + model.b * second + model.c)))) < 1e-6
        assert rows[i].held_out == held(i) and rows[i].predicted == int(rows[i].score >= 0.5)


def test_letters_beyond_a_to_z_differ():
    one, two = (toxicity.pieces_of(w.encode())[0] for w in ("дурак", "добро"))
    assert one != two and all(26 <= c < toxicity.LETTERS for c in one)


def test_toxicity_of_altered_insults():
    texts = [b"the calm river runs by a green hill", b"people walk along the shore", b"you are a stupid person", b"what a stupid idea"] * 10
    model = toxicity.train(texts, [0, 0, 1, 1] * 10)
    score = lambda t: model.score(*(sorted(set(model.margins_of(sorted(toxicity.tokens_of(t)))), reverse=True) + [model.bias] * 2)[:2])
    for bad in (b"stupid", b"st-up-id", b"s t u p i d", b"stuupid", b"St*u*p*id"):
        assert score(bad) > score(b"people by the river"), bad
    assert toxicity.train([b"a", b"b"], [0, 0]).score(0, 0) < 0.01 and toxicity.train([], []).score(0, 0) < 0.01


def test_subsequence_kernel():
    for word in (b"stupid", b"banana", b"abcabcabc"):
        codes = bytes(c - 97 for c in word)
        got = defaultdict(float)
        for _, code, value in toxicity.features([codes]):
            for c, v in zip(code[0].tolist(), value[0].tolist(), strict=True):
                got[c] += v
        want = slow_kernel(codes)
        assert set(want) == set(got) and all(abs(got[c] - want[c]) < 1e-12 for c in want)


# 7 lines


def test_lines_near_and_over_the_threshold(spark):
    rows = [(s, f"boilerplate\nown {s} {i}\n  on four sites  \n\nboilerplate") for s in range(6) for i in range(3)]
    rows = [(None if s == 5 and i else s, t if s < 4 else t.replace("on four sites", f"other {s}")) for i, (s, t) in enumerate(rows)]
    df = spark.createDataFrame([(str(s) if s is not None else None, t, "x") for s, t in rows] + [("1", None, "x"), ("1", "", "x")], "source string, text string, row string")
    left, n, removed = lines.without_spread_lines(df, least_sites=5)
    for r in left.collect():
        if r.text:
            assert "boilerplate" not in r.text and "own" in r.text and r[removed] == 2 and r[n] == 5
    assert sum("on four sites" in (r.text or "") for r in left.collect()) == 12


def test_lines_with_other_white_space_at_their_ends(spark):
    rows = [(str(i), ("boilerplate\r\nown {}\r\n" if i % 2 else "\tboilerplate \nown {}").format(i)) for i in range(6)]
    left, _, removed = lines.without_spread_lines(spark.createDataFrame(rows, "source string, text string"), least_sites=5)
    assert all(r[removed] == 1 and "boilerplate" not in r.text and f"own {r.source}" in r.text for r in left.collect())


# 8 decontamination is held against SQL; here words and windows alone


def test_contamination_of_short_items_and_nulls(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, "--"), (None, "a b c d e f g h i"), (4, "A B C D E F G H")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero ONE,two;three four one two three"), (2, "x a b c d e f g h i y"), (3, None), (4, "a b c d e f g"), (1, "zero ONE,two;three four one two three")], "doc_id long, text string")
    got = sorted((r.id, r.n, r.hit, r["items"]) for r in decontaminate.contamination(docs, bench).select("id", F.col("n_words").alias("n"), decontaminate.words_hit(F.col("hits")).alias("hit"), "items").collect())
    assert got == [(1, 8, 6, ["1"]), (1, 8, 6, ["1"]), (2, 11, 9, ["4"]), (3, 0, 0, []), (4, 7, 0, [])]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench, least_items=1, short_items=True).collect()) == [3, 4]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench, least_items=1).collect()) == [1, 1, 3, 4]
    both = spark.createDataFrame([(1, "q r s t u v w x A B C D E F G H"), (2, "zz q r s t u v w x zz")], "doc_id long, text string")
    two = bench.union(spark.createDataFrame([(5, "q r s t u v w x")], "item_id long, text string"))
    assert [r.doc_id for r in decontaminate.clean(both, two, least_items=2).collect()] == [2]


# 9 mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark, docs):
    sizes = Counter()
    for s, t in zip(docs.source, docs.text, strict=True):
        sizes[s] += len(regex.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, rows = slow_targets(sizes), queries.op9_mixing(spark, DATA).collect()
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = queries.op9_mixing(spark, DATA).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_curriculum_of_equal_ids_reruns_alike(spark, tmp_path):
    rows = [(1, f"text number {i} of some", "en", "s", 1) for i in range(50)] + [(2, None, "en", None, 0)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    run = lambda: [r.text for r in mixing.curriculum(spark.read.parquet(str(tmp_path / "d"))).collect()]
    assert run() == run()


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 0, "b": 0}, {"a": 100}, {f"s{i}": i * i for i in range(40)}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = slow_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_inverse_of_the_schedule(spark, knots):
    area = lambda t: sum((min(t, b) - a) * (wa + (wa + (wb - wa) * (min(t, b) - a) / (b - a))) / 2 for (a, wa), (b, wb) in zip(knots, knots[1:], strict=False) if t > a)
    rows = spark.range(21).select((F.col("id") / 20).alias("y")).select("y", mixing.inverse(F.col("y"), knots).alias("t")).collect()
    assert all(abs(area(r.t) / area(1) - r.y) < 1e-9 for r in rows)


# 10 sharding


def test_sharding(spark, docs):
    rows = queries.op10_sharding(spark, DATA).collect()
    by_id = dict(zip(docs.doc_id, docs.text, strict=True))
    assert len(rows) == len(docs)
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == len((by_id[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((by_id[r.doc_id] or "").encode())
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    largest, mean = max(r.size for r in rows), sum(loads.values()) / 16
    assert set(loads) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(v - mean) <= largest + 0.04 * mean for v in loads.values())


def test_sharding_of_equal_texts(spark):
    one = spark.createDataFrame([(7, "same")] * 160, "doc_id long, text string")
    counts = Counter(r.shard for r in sharding.shards(one, 16).collect())
    assert sorted(counts.values()) == [10] * 16
    assert sharding.with_shards(one.withColumn("shard", F.lit("x")), 4).columns == ["doc_id", "text", "shard", "shard_", "slot"]


# what they share


def test_prefix_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g) if g else None, int(o), int(v)) for g, o, v in zip(rng.integers(0, 3, 500), rng.permutation(500), rng.integers(0, 9, 500), strict=True)]
    df = spark.createDataFrame(rows, "g int, o int, v long")
    got = {r.o: r.s for r in shared.prefix_sums(df, ["o"], {"v": "s"}, "g")[0].collect()}
    for g, o, _ in rows:
        assert got[o] == sum(v for h, p, v in rows if h == g and p < o)


def test_fresh_names(spark):
    assert shared.fresh(["Row", "row_"], "row", "x") == ["row__", "x"]

"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from heatloom.llm import decontaminate, line_dedup, neighbours, pii, pretokens, quality, registry, shingle_sets, simhash, suffix_dedup, token_counts, token_store
from heatloom.llm.components import components
from heatloom.llm.piece_codec import encode_decode

SF = "/root/testdata/sf0.001"
RND = random.Random(4)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 8))) for _ in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


BASE = prose(120)
ODD = [
    None, "", "a", "   ", "\n\n", "é ß 漢字 🙂 ՘", "<|endoftext|> x <s>", "x" * 30_000, "ab " * 9_000, BASE, BASE, BASE.replace(BASE.split()[60], "other", 1),
    prose(80) + "\n" + BASE[:300] + "\n" + prose(30), "A@b.co, 1.2.3.4, +1 (555) 123-4567, 4111 1111 1111 1111", "\x00 nul",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids from 0; then a null id, and a row that is there twice. Other columns clash with results."""
    rows = [(i, t, "x", 1.0, -1, 0, "y", [1]) for i, t in enumerate(ODD)] + [(None, BASE, "x", 2.0, -1, 0, "y", [1]), (9, BASE, "x", 3.0, -1, 0, "y", [1])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans string, score double, n_tokens int, k1 int, row string, removed array<int>")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def rows_of(df, *order):
    pdf = df.toPandas()
    return pdf.sort_values(list(order or ["doc_id"]), na_position="first").reset_index(drop=True)


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_piece_codec(spark, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, real(spark)):
        got = encode_decode(df, path, with_ids=True).toPandas()
        want = df.toPandas()
        assert len(got) == len(want)
        for text, ids, back, n, digest in zip(want.text, got.ids, got.decoded, got.n_tokens, got.ids_sha256, strict=True):
            expected = library.encode(text or "", add_bos=True, add_eos=True)
            assert list(ids) == expected and n == len(expected)
            assert back == library.decode(expected)
            assert digest == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
    assert encode_decode(empty, path).count() == 0


def test_token_counts(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, real(spark)):
        got, want = token_counts.token_counts(df, path).toPandas(), df.toPandas()
        expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in want.text]
        assert got.n_tokens.tolist() == expected
        assert got.n_bytes.tolist() == [len((t or "").encode()) for t in want.text]
        assert got.over_limit.tolist() == [n > 512 for n in expected]
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_do_not_depend_on_caches(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    a = rows_of(token_counts.token_counts(real(spark), path))
    b = rows_of(token_counts.token_counts(real(spark), path, cached=3))
    pd.testing.assert_frame_equal(a, b)


def test_token_store(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, real(spark)):
        got = token_store.token_store(df, path).toPandas().sort_values("start").reset_index(drop=True)
        want = df.toPandas()
        want["key"] = want.doc_id.fillna(-1)
        want = want.assign(text=want.text.fillna("")).sort_values(["key", "text"]).reset_index(drop=True)
        ids = [library.encode(t, add_special_tokens=False).ids + [1] for t in want.text]
        assert got.doc_id.fillna(-1).tolist() == want.key.tolist()
        assert got.n_tokens.tolist() == [len(x) for x in ids]
        assert got.start.tolist() == np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
        assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert token_store.token_store(empty, path).count() == 0


def test_token_store_lookup(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    shards = token_store.write_store(real(spark), path, str(tmp_path), shard_ids=20_000)
    assert shards.count() > 4
    got = token_store.lookup(shards, spark.createDataFrame([(3,), (150,), (10**9,), (None,)], "key bigint")).toPandas()
    library = Tokenizer.from_file(path)
    texts = real(spark).where("doc_id in (3, 150)").toPandas().set_index("doc_id").text
    assert sorted(got.key) == [3, 150]
    for key, ids in zip(got.key, got.ids, strict=True):
        assert list(ids) == library.encode(texts[key], add_special_tokens=False).ids + [1]


def test_token_store_splits_repeated_ids(spark, tmp_path):
    """Records of one id, and null ids, in several shards and in small blocks; empty texts among them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(7 if i % 3 else None, prose(i % 40)) for i in range(300)] + [(8, None), (8, ""), (9, "x")]
    shards = token_store.write_store(spark.createDataFrame(rows, "doc_id bigint, text string"), path, str(tmp_path), shard_ids=500, shard_docs=20)
    assert shards.where("first_key = 7 and last_key = 7").count() > 4 and shards.agg({"n_docs": "max"}).first()[0] <= 20
    got = token_store.read_store(shards, block_ids=50).toPandas().sort_values("start")
    assert got.doc_id.fillna(-1).tolist() == sorted(-1 if i is None else i for i, _ in rows)
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [1]
    want = collections.Counter((i or -1, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows)
    assert collections.Counter(zip(got.doc_id.fillna(-1).astype(int), got.n_tokens, got.ids_crc32, strict=True)) == want
    found = token_store.lookup(shards, spark.createDataFrame([(7,), (8,)], "key bigint")).toPandas()
    assert collections.Counter((k, tuple(x)) for k, x in zip(found.key, found.ids, strict=True)) == collections.Counter((i, tuple(ids(t))) for i, t in rows if i in (7, 8))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys)))


def brute_repeats(texts):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        n_spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, empty):
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcde ") for _ in range(3000))
    texts = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 500, base[:1000], base[500:1500], base[2000:2199], base[1999:2199] + "q", "é" * 300 + base[:250], base[2500:] + base[2500:], ("k" * 37 + "m") * 40]
    texts += ["".join(rnd.choice("fghij") for _ in range(300)) + base[o : o + rnd.randint(150, 400)] + "".join(rnd.choice("fghij") for _ in range(100)) for o in range(0, 2500, 50)]
    for df in (spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), real(spark)):
        want = df.toPandas().sort_values("doc_id")
        got = rows_of(suffix_dedup.suffix_dedup(df).drop("kept"))
        assert [tuple(r) for r in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == brute_repeats(want.text)
    got = suffix_dedup.suffix_dedup(docs).toPandas()
    want = collections.Counter((None if pd.isna(i) else int(i), *b) for i, b in zip(docs.toPandas().doc_id, brute_repeats(docs.toPandas().text), strict=True))
    assert want == collections.Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples())
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_difference_cover():
    cover = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover} == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("hot", [3, 100_000])
def test_suffix_dedup_small_pieces(spark, hot):
    """Pieces, blocks and the bound of hot anchors change nothing, also for a long text and an anchor in thousands of contexts."""
    rnd = random.Random(6)
    noise = lambda n: "".join(rnd.choice("fghijklm") for _ in range(n))
    phrase, tails = noise(70), [noise(200) for _ in range(5)]
    texts = ["".join(noise(90) + phrase + rnd.choice(tails)[: rnd.randint(100, 200)] + noise(60) for _ in range(500)) for _ in range(6)]
    texts += ["", "a" * 150 + BASE * 3 + "b" * 4_000, BASE * 2, noise(1_200_000) + texts[0][5_000:5_400] + "é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = rows_of(suffix_dedup.suffix_dedup(df, piece=5_000, block=2_000, hot=hot).drop("kept"))
    assert [tuple(r) for r in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == brute_repeats(texts)


def test_suffix_dedup_hot_anchor(spark, monkeypatch):
    """An anchor with many different contexts doesn't meet in one task, and its repeats are those of all windows."""
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("fghijklm") for _ in range(n))
    phrase, tails = noise(60), [noise(170) for _ in range(4)]
    texts = [noise(300) + phrase + noise(300) for _ in range(60)] + [noise(250) + phrase + rnd.choice(tails)[: rnd.randint(120, 170)] + noise(150) for _ in range(40)]
    texts += [noise(90) + texts[3][200:500] + noise(90), texts[70], texts[70]]
    sort = suffix_dedup.sort_buckets

    def bounded(batches, block):
        held = collections.Counter()

        def watched():
            for batch in batches:
                held.update(batch.column("h").to_pylist())
                assert max(held.values(), default=0) <= 4
                yield batch

        yield from sort(watched(), block)

    monkeypatch.setattr(suffix_dedup, "sort_buckets", bounded)
    rows = [*enumerate(texts), (7, texts[7])]
    got = rows_of(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), hot=4).drop("kept"))
    want = brute_repeats([t for _, t in sorted(rows)])
    assert sum(w[1] > 0 for w in want) > 30
    assert [tuple(r) for r in got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == want


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(near):
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, docs, empty):
    for df in (docs, real(spark)):
        want = df.toPandas()
        f = np.array([brute_fingerprint(t) for t in want.text], np.uint64)
        label = reach(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
        ids = want.doc_id.to_numpy(float)
        component = [np.nanmin(ids[label == x]) for x in label]
        expected = collections.Counter((None if np.isnan(i) else int(i), f"{x:016x}", int(c)) for i, x, c in zip(ids, f.tolist(), component, strict=True))
        got = simhash.near_duplicates(df).toPandas()
        assert collections.Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.fingerprint, int(r.component_id)) for r in got.itertuples()) == expected
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("groups", [5, 8])
def test_fingerprint_links_in_blocks(spark, groups):
    """A dense cloud of fingerprints, far over a block: the same components as by all pairs."""
    rng = np.random.default_rng(3)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(24, 64, 4).astype(np.uint64)) for _ in range(400)], np.uint64)
    f = np.unique(flips ^ np.uint64(0x0F0F33335555AAAA))
    label = reach(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    nodes = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(nodes, groups=groups, block=16)).collect()}
    got = collections.defaultdict(set)
    for x in f.view(np.int64).tolist():
        got[roots.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, c in zip(f.view(np.int64).tolist(), label, strict=True):
        want[c].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_groups_grow():
    """More points, finer grids: the pairs of random points in a cell stay few."""
    chosen = [simhash.groups_for(10**k, 3) for k in range(1, 12)]
    assert chosen == sorted(chosen) and chosen[0] < chosen[-1] <= 16


def test_segment_counts_bound():
    rng = np.random.default_rng(4)
    for n in (3, 50, 700, 9_000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for cut in (0, 1, n // 9, n // 2):
            y = np.unique(np.concatenate([x[cut:], rng.integers(0, 2**63, cut).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
            a, b = shingle_sets.segment_counts(x), shingle_sets.segment_counts(y)
            m = min(len(a), len(b))
            assert np.abs(shingle_sets.folded(a, m) - shingle_sets.folded(b, m)).sum() <= len(np.setxor1d(x, y))
            similar = len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
            assert shingle_sets.may_be_similar(a.tobytes(), b.tobytes(), len(x), len(y), 0.8) or not similar
            assert shingle_sets.near_somebody([a.tobytes(), b.tobytes()], np.array([len(x), len(y)]), 0.8).all() or not similar
    y = np.unique(rng.integers(0, 2**63, 9_000).astype(np.uint64))
    assert not shingle_sets.may_be_similar(shingle_sets.segment_counts(x).tobytes(), shingle_sets.segment_counts(y).tobytes(), len(x), len(y), 0.8)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7), (3, 2), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in [*range(101, 140), 200]}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def word_list(text):
    import re

    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute_contamination(texts, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word_list(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = word_list(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark, docs, empty):
    pieces = BASE.split()
    items = [(1, " ".join(pieces[5:30])), (2, " ".join(pieces[5:30])), (10, " ".join(pieces[40:44])), (3, None), (4, "!!"), (None, " ".join(pieces[90:104])), (5, "x " * 12), (6, "漢字 🙂"), (7, pieces[3].upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for small, places in ((10**8, decontaminate.PLACE), (0, decontaminate.PLACE), (10**8, 15)):
        got = decontaminate.contamination(docs, bench, small=small, places=places).toPandas()
        want = docs.toPandas()
        expected = collections.Counter((None if pd.isna(i) else int(i), *r) for i, r in zip(want.doc_id, brute_contamination(want.text, items), strict=True))
        assert collections.Counter((None if pd.isna(i) else int(i), *r) for i, *r in got[["doc_id", *columns]].itertuples(index=False)) == expected
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(docs, bench.where("false"))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == docs.count()
    clean = decontaminate.uncontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r[4] for r in brute_contamination(docs.toPandas().text, items))


@pytest.mark.parametrize("places", [15, 31])
def test_contamination_of_long_texts(spark, places):
    """Places start again many times inside a text; repeated words tie."""
    rnd = random.Random(31)
    few = ["aa", "bb", "cc"]
    items = [(i, " ".join(rnd.choice(few) for _ in range(rnd.randint(1, 30)))) for i in range(12)] + [(20, "aa " * 14), (21, "zz yy xx " * 6)]
    texts = [" ".join(rnd.choice(few) for _ in range(600)), "aa " * 300, prose(2_000) + " zz yy xx zz yy xx zz yy xx zz " + prose(50), " ".join(["q"] * 500)]
    tables = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = rows_of(decontaminate.contamination(*tables, places=places))
    assert [tuple(r) for r in got.drop(columns="doc_id").itertuples(index=False)] == brute_contamination(texts, items)


def brute_lines(rows, min_words):
    """Removed line numbers by all pairs of places; rows in document order."""
    out = []
    lines = [[(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")] for t in rows]
    where = collections.defaultdict(list)
    for d, ls in enumerate(lines):
        gone = set()
        for k, (_, line) in enumerate(ls):
            longest = 0
            for d2, k2 in where[line]:
                n = 0
                while k + n < len(ls) and k2 + n < len(lines[d2]) and ls[k + n][1] == lines[d2][k2 + n][1]:
                    n += 1
                longest = max(longest, n)
            if sum(len([w for w in x.split(" ") if w]) for _, x in ls[k : k + longest]) >= min_words:
                gone |= {i for i, _ in ls[k : k + longest]}
            where[line].append((d, k))
        out.append(gone)
    return out


@pytest.mark.parametrize("min_words", [1, 10, 25])
def test_line_dedup(spark, min_words):
    rnd = random.Random(8)
    pool = [prose(rnd.randint(1, 14), rnd) for _ in range(20)] + [prose(2, rnd) for _ in range(6)] + ["", "  "]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(60)] + [None, "", pool[0] * 300]
    verse = [prose(rnd.randint(1, 4), rnd) for _ in range(70)]  # runs of short lines, in copies of many lengths
    for _ in range(40):
        a, n = rnd.randrange(60), rnd.randint(1, 40)
        texts.append("\n".join([prose(3, rnd), *verse[a : a + n], *([""] if rnd.random() < 0.5 else []), prose(3, rnd), *verse[a + 2 : a + 2 + rnd.randint(0, 9)]]))
    texts += ["\n".join([verse[0]] * 30), "\n".join([verse[0]] * 17)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_runs", line_dedup.F.lit("clash"))
    got = rows_of(line_dedup.line_dedup(df, min_words))
    for text, gone, kept, n in zip(texts, brute_lines(texts, min_words), got.text, got.n_removed, strict=True):
        want = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        assert kept == want and n == len(gone)


def test_line_dedup_odd_rows(docs, empty):
    got = line_dedup.line_dedup(docs)
    assert got.count() == docs.count() and got.columns[:8] == docs.columns
    # the null id is the first of the copies; the row that is there twice is one document
    assert [r.n_removed for r in got.where("doc_id is null").collect()] == [0]
    assert {r.n_removed for r in got.where("doc_id in (9, 10)").collect()} == {1}
    assert line_dedup.line_dedup(empty).count() == 0


def test_pii_base():
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(text):
        out = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                luhn = sum(int(x) if k % 2 == 0 else sum(map(int, str(2 * int(x)))) for k, x in enumerate(digits[::-1])) % 10 == 0
                good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
                if good:
                    out.append((m.start(), kind, m.end()))
        return sorted(out, key=lambda x: (x[0], list(patterns).index(x[1])))

    rnd = random.Random(3)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab1234567890.@+- ()-") for _ in range(rnd.randint(1, 60)))
        assert pii.base_spans(text) == brute(text)


def test_pii_tagger_learns():
    """On held-out windows, most spans of the patterns are found by the tagger alone; a phone number without plus is added."""
    rnd = random.Random(9)
    number = lambda: f"+1 ({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
    mail = lambda: f"{rnd.choice(WORDS)}.{rnd.randint(1, 99)}@{rnd.choice(WORDS)}.example.com"
    make = lambda: f"{prose(3, rnd)} {rnd.choice([number, mail, lambda: f'{rnd.randint(1, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}', lambda: str(rnd.randint(1, 3000))])()} {prose(3, rnd)}"
    spans = lambda t: ",".join(f"{k}:{a}:{b}" for a, k, b in pii.base_spans(t))
    train = [t[: pii.WINDOW] for t in (make() for _ in range(1500))]
    tagger = pii.fit([(t, spans(t)) for t in train])
    assert len(train) == 1500
    test = [make() for _ in range(200)]
    found = pii.added_spans(tagger, test, [[] for _ in test])
    want = [pii.base_spans(t) for t in test]
    assert sum(len(set(a) & set(b)) for a, b in zip(found, want, strict=True)) >= 0.85 * sum(map(len, want))
    assert pii.fit([("abc", "")]) is None


def test_pii_no_span_without_cue():
    """Windows without a digit or @ needn't be read: no span in them could be valid."""
    rnd = random.Random(14)
    for _ in range(20_000):
        text = "".join(rnd.choice("abXY._%+-() /\n") for _ in range(rnd.randint(1, 40)))
        assert not any(pii.valid(kind, text) for kind in pii.TAGGED) and not pii.base_spans(text)
    assert pii.windows("no cue here " * 100) == []
    for at in (0, 70, 500):  # every place near a digit is read
        text = "x" * at + "7" + "y" * 300
        read = {i for s in pii.windows(text) for i in range(s, s + pii.WINDOW)}
        assert set(range(max(0, at - pii.AROUND), at + pii.AROUND)) <= read


def test_pii_held_out():
    """Labelled windows that the tagger wasn't trained on, and with names that it wasn't trained on: precision and recall of its own spans."""
    texts = [t for t in pd.read_parquet("/root/testdata/sf0.1/documents.parquet").text if t and pii.CUE.search(t)]
    found = sorted({w for t in texts for w in pii.labelled_windows(t)}, key=lambda w: hashlib.md5(w[0].encode()).hexdigest())
    test, train = found[::4], [w for i, w in enumerate(found) if i % 4]
    kinds = collections.defaultdict(list)
    for w in train:
        kinds[",".join(sorted({x.split(":")[0] for x in w[1].split(",")}))].append(w)
    tagger = pii.fit([w for ws in kinds.values() for w in ws[: pii.FIT_WINDOWS // 6]])
    want, texts = [], []
    for text, spans in test:
        spans = [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
        if any(a < 0 or b > len(text) for a, _, b in spans):
            continue
        texts.append(text)
        want.append(spans)
        if [k for _, k, _ in spans] == ["secret"]:
            a, _, b = spans[0]
            texts.append(text[: max(0, a - 9)] + " cred " + text[a:b].upper() + " " + text[b + 1 :])
            want.append([(max(0, a - 9) + 6, "secret", max(0, a - 9) + 6 + b - a)])
    got = pii.added_spans(tagger, texts, [[] for _ in texts])
    for kind in pii.TAGGED:
        mine, theirs = ({(i, *x) for i, xs in enumerate(side) for x in xs if x[1] == kind} for side in (got, want))
        print(kind, len(theirs), len(mine & theirs) / max(1, len(mine)), len(mine & theirs) / max(1, len(theirs)))
        if kind == "secret":
            assert len(mine & theirs) >= 0.9 * max(len(theirs), 1) and len(mine & theirs) >= 0.95 * len(mine)


def test_pii_spans_of_any_length(spark):
    """Secrets of 20 to 2,000 characters, hexadecimal or of letters and digits, are found as a whole at every offset; the training sample doesn't depend on how rows are dealt."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    samples = [sorted(map(tuple, pii.training_windows(df.repartition(n), pii.FIT_WINDOWS).collect())) for n in (2, 40)]
    assert samples[0] == samples[1]
    tagger = pii.fit([(r.text, r.spans) for r in pii.training_windows(df, pii.FIT_WINDOWS).collect()])
    rnd = random.Random(31)
    letters = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    found, lengths = collections.Counter(), (20, 40, 64, 70, 90, 120, 140, 200, 400, 1_000, 2_000)
    for size in lengths:
        for offset in range(0, 128, 8):
            key = "".join(rnd.choice(letters[offset // 8 % 2]) for _ in range(size - 2)) + "a7"
            text = (prose(60, rnd) + " " * 128)[: 200 + offset] + f' token = "{key}" ' + prose(20, rnd)
            spans = pii.added_spans(tagger, [text], [pii.base_spans(text)])[0]
            found[size] += (text.index(key), "secret", text.index(key) + size) in spans
    assert all(found[size] >= 13 for size in lengths) and sum(found.values()) >= 0.93 * 16 * len(lengths), found
    clean = [prose(200, rnd) + " 17 " + prose(50, rnd) for _ in range(40)]
    assert not any(s for spans in pii.added_spans(tagger, clean, [[] for _ in clean]) for s in spans)


def test_pii_rows(spark, docs, empty):
    got = pii.find_private(docs).toPandas()
    assert len(got) == docs.count()
    row = got[got.doc_id == ODD.index("A@b.co, 1.2.3.4, +1 (555) 123-4567, 4111 1111 1111 1111")].iloc[0]
    assert (row.n_email, row.n_ip, row.n_phone) == (1, 1, 1)
    assert set(got[got.doc_id == 1].spans) == {""}
    assert pii.find_private(empty).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    x[100:400] = x[50]  # many equal vectors, queries among them
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [1.0] * 3, 0), (None, [1.0] * 16, 0), (1200, [None] * 16, 0), (1250, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = neighbours.nearest(df, recall=1.0, centroids=8, block=64).toPandas()
    d = x.astype(float)
    norm = np.sqrt(np.einsum("ij,ij->i", d, d))
    for q in range(0, 800, 50):
        score = np.einsum("ij,j->i", d, d[q]) / (norm * norm[q])
        score[q] = -9
        want = np.lexsort((np.arange(800), -np.round(score, 12)))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine.vec_id.tolist() == want.tolist() and mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, score[want], atol=1e-12)
    assert set(got.query_id) == set(range(0, 800, 50))
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)")).toPandas()
    assert sorted(few.vec_id) == [1, 2]
    assert neighbours.nearest(df.where("false")).count() == 0


def recall_of(got, ids, x, every, k=5):
    """Share of the true neighbours that were found, and the number of queries."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    hit = total = 0
    for i in np.nonzero(ids % every == 0)[0]:
        score = x @ x[i]
        score[i] = -9
        hit += len(set(ids[np.argsort(-score)[:k]]) & found[ids[i]])
        total += k
    return hit / total, total // k


def test_neighbours_recall(spark):
    """Vectors with little structure: at least 0.9 of the true neighbours, over more than 500 queries."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    e = table.toPandas()
    every = max(1, len(e) // 600)
    share, n = recall_of(neighbours.nearest(table, every=every).toPandas(), e.vec_id.to_numpy(), np.stack(e.embedding).astype(float), every)
    assert n >= 500 and share >= 0.9


def test_neighbours_of_clusters(spark):
    """Clustered vectors: as many found, in a small part of the cells."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 32))[rng.integers(0, 120, 6_000)] + 0.25 * rng.normal(size=(6_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").withColumn("c1", neighbours.F.lit("clash"))
    share, n = recall_of(neighbours.nearest(df, every=10).toPandas(), np.arange(6_000), x, 10)
    assert n == 600 and share >= 0.9
    index = neighbours.build_index(neighbours.usable(df))
    visited = neighbours.rows_to_visit(index, df.where("vec_id % 10 = 0").selectExpr("vec_id AS qid", "embedding"), 5, 0.95)
    assert visited < 0.2 * index.held.sum() and len(index.books[0]) == 19


def test_quality(spark, docs, empty):
    tables = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    got = quality.quality_scores(*tables).toPandas()
    known = got.merge(tables[1].toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    test = known[known.held_out]
    assert (test.predicted == test.quality).mean() > 0.97
    assert (test[test.quality == 1].predicted == 1).mean() > 0.98
    odd = quality.quality_scores(docs, tables[1]).toPandas()
    assert len(odd) == docs.count() and odd.score.between(0, 1).all() and (odd.predicted == (odd.score >= 0.5)).all()
    assert set(quality.quality_scores(docs, tables[1].where("false")).toPandas().score) == {0.5}
    assert quality.quality_scores(empty, tables[1]).count() == 0


def test_quality_sample(spark):
    """A long first text doesn't use up the sample; repeated, null and odd labels don't break it."""
    rnd = random.Random(17)
    rows = [(i, ("good words here " if i % 2 else "bad junk there ") * rnd.randint(5, 20) + prose(5, rnd)) for i in range(400)]
    order = spark.createDataFrame(rows, "doc_id bigint, text string").where(~quality.held_out(quality.F.col("doc_id"))).orderBy(quality.F.xxhash64("doc_id"))
    first = order.first().doc_id
    rows = [(i, t * 2_000 if i == first else t) for i, t in rows]
    labels = [(i, i % 2) for i in range(400)] + [(3, 1), (3, None), (None, 1), (5, 7)]
    tables = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = quality.fitted(*tables, rows=300, chars=60_000)
    scores = model.scores([t for _, t in rows])
    assert model.constant is None and np.mean((scores >= 0.5) == np.array([i % 2 == 1 for i, _ in rows])) > 0.98
    assert quality.fitted(*tables, rows=300, chars=10).constant == 0.5
    assert quality.shape("aB" * 250) == "xX" * 250 and quality.shape("a" * 500 + "9-9") == "x9-9"


def test_recent_values_stay():
    """Values that are asked for again outlive many that aren't; no more than about `most` are held; long keys are made anew."""
    made = []
    kept = pretokens.Recent(lambda key: made.append(key) or key.upper(), most=20)
    for i in range(200):
        assert kept["often"] == "OFTEN" and kept[f"once {i}"] == f"ONCE {i}" and len(kept) + len(kept.old) <= 21
    assert made.count("often") == 1 and len(made) == 201
    assert kept["x" * 65] == kept["x" * 65] == "X" * 65 and len(made) == 203


def test_near_copies(spark, docs, empty):
    kept = simhash.first_of_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # BASE's copies and its near copy are one group, whose first id is the null; null and empty texts are another
    assert None in ids and not {9, 10, 11} & set(ids) and 0 in ids and not {1, 3, 4} & set(ids)
    assert len(ids) == len(set(ids))
    assert simhash.first_of_near_copies(empty).count() == 0


@pytest.mark.parametrize(("few", "block"), [(12, 256), (1, 8)])
def test_near_copies_against_all_pairs(spark, monkeypatch, few, block):
    """Whether pairs are joined or cells are compared in blocks, the groups are those of all pairs."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(12)
    texts = []
    for _ in range(25):
        words = prose(rnd.randint(60, 200), rnd).split()
        for _ in range(4):
            copy = list(words)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            texts.append(" ".join(copy))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in grams] for a in grams])
    want = {int(x) for x in reach(near)}
    kept = {r.doc_id for r in simhash.first_of_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert kept == want


@pytest.mark.parametrize(("few", "sample"), [(12, 16), (1, 1)])
def test_near_copies_extended_and_truncated(spark, monkeypatch, few, sample):
    """Pairs of one text and a longer one that holds it, from 0.8 of similarity on, also with few distinct words, are never lost."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    rnd = random.Random(21)
    new = lambda n: ["".join(rnd.choice("klmnopqrst") for _ in range(9)) for _ in range(n)]
    pairs = []
    for i in range(60):
        grams = rnd.randint(20, 60) * 4
        base = prose(grams + 4, rnd).split() if i % 2 else new(grams + 4)
        pairs.append((base, base + new(grams // 4)))  # 0.8
        pairs.append((new(grams // 8) + base, base))
        pairs.append((base[: grams // 2 + 4] + new(5), new(7) + base[: grams // 2 + 4]))
    known = new(50)
    for _ in range(20):
        base = [rnd.choice(known) for _ in range(204)]
        pairs.append((base, base + new(50)))
    texts = [" ".join(w) for pair in pairs for w in pair]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in grams] for a in grams])
    want = {int(x) for x in reach(near)}
    assert len(want) < 0.7 * len(texts)
    kept = {r.doc_id for r in simhash.first_of_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert kept == want


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Without the way for what fingerprints can't tell, texts whose fingerprints are equal or near are still one group, but not those that agree by chance; with it, groups are those of all pairs."""
    rnd = random.Random(8)
    base = prose(900, rnd).split()
    texts = [" ".join([*base[:i], "another", *base[i + 1 :]]) for i in range(100, 900, 20)]
    texts += [" ".join(base[:450]), "three words stay " * 90 + prose(30, rnd), "three words stay " * 90 + prose(30, rnd), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    points = [int.from_bytes(simhash.fingerprint(t or ""), "big") for t in texts]
    near = np.array([[(a ^ b).bit_count() <= 3 for b in points] for a in points])
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x or "" for x in texts)]
    similar = np.array([[len(a & b) >= 0.8 * len(a | b) for b in grams] for a in grams])
    assert near[41, 42] and not similar[41, 42]  # repeated words rule their fingerprints
    assert {r.doc_id for r in simhash.first_of_near_copies(docs).collect()} == {int(x) for x in reach(similar)} == {0, 40, 41, 42, 43}
    nodes = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(points)], "node bigint, fp bigint")
    for block in (512, 2):
        pairs = simhash.fingerprint_pairs(nodes, 3, block).collect()
        linked = np.eye(len(texts), dtype=bool)
        for r in pairs:
            linked[r.a, r.b] = linked[r.b, r.a] = True
        assert list(reach(linked)) == list(reach(near))
    monkeypatch.setattr(simhash, "possible_pairs", lambda pairs, nodes, similarity: pairs.limit(0))
    monkeypatch.setattr(simhash, "near_somebody", lambda counts, sizes, similarity: np.zeros(len(counts), bool))
    assert {r.doc_id for r in simhash.first_of_near_copies(docs).collect()} == {int(x) for x in reach(near & similar)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        if name != "piece_codec":
            assert out.columns == docs.columns
            kept = spark.createDataFrame(out.toPandas(), docs.schema)
    assert 0 < kept.count() <= docs.count()
    assert corpus_pipeline.run(spark, SF).count() == kept.count()


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, SF)
        got = rows_of(df, df.columns[0])
        want = con.sql(sql).df().sort_values(df.columns[0]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)

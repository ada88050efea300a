import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumenforge.llm import blocks, chat, embedding_dedup, exact_dedup, html_text, language_model, packing, piece_encoding, quality, queries, simhash, toxicity
from lumenforge.llm.common import materialise, ship_package
from lumenforge.llm.components import connected_components
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
#: Nulls, empty texts, ties, repeats, white space of all kinds, long words, marks that tokenizers use themselves.
TEXTS = [
    None, "", " ", "\n", "A b C", "a b c", "a B c", "É b", "é b", "one two", "one  two", "x\t y\n\nz \n", "▁ a▁ b", "word " * 3000, "z" * 5000, "Don't STOP now. Yes! No?\nLine",
    "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven", "\x00 a", "😀 b 日本語。", "tab\tonly", "trailing ", "<|endoftext|> x",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "en", f"src{i % 3}", 0, "clash", i) for i, x in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, x string, id long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


PAIRS = list(enumerate(TEXTS))


def test_exact_dedup(docs, empty):
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(exact_dedup.exact_dedup(docs), *cols) == brute.exact(PAIRS)
    # tiny pages, keys that overflow them, keys of two bits that collide
    for page_bytes, level, key_bits in ((1, 2, 64), (200, 3, 64), (300, 12, 2), (1 << 20, 12, 2)):
        assert got(exact_dedup.exact_dedup(docs, page_bytes=page_bytes, level=level, key_bits=key_bits), *cols) == brute.exact(PAIRS)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "A"), (None, "a"), (None, "q"), (2, "b")]
    for page_bytes in (1, 1 << 20):
        out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), page_bytes=page_bytes).collect()
        assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in out) == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(1000).selectExpr("xxhash64(id) as h", "1L as n")
    close = spark.range(300).selectExpr("shiftleft(5L, 60) + id as h", "1L as n")  # these differ in their last bits only
    for table, level in ((keys, 12), (keys, 3), (keys.union(close), 12)):
        d = materialise(exact_dedup.directory(table, 100, level), "test-directory")
        out = exact_dedup._paged(table, d).groupBy("depth", "bucket").agg({"n": "sum"}).collect()
        assert sum(r[2] for r in out) == table.count() and max(r[2] for r in out) <= 100 and len(out) > 10
        assert max(r.depth for r in out) > (50 if table is not keys else 3)
        # a bucket has split only because it was overfull
        split = {(r.depth - 1, r.bucket >> 1) for r in out if r.depth}
        load = {(d, b): sum(r[2] for r in out if r.depth > d and r.bucket >> (r.depth - d) == b) for d, b in split}
        assert min(load.values()) > 100
    assert exact_dedup.directory(keys.where("false"), 100).count() == 0


def test_simhash(docs, empty):
    assert got(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == brute.near(PAIRS)
    assert simhash.simhash_groups(empty).count() == 0


def test_simhash_links_lose_no_pair(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for j, b in enumerate(signed[:i]) if (prints[i] ^ prints[j]).bit_count() <= 3}
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 100), (7, 7)]
    out = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(out[i] == 0 for i in range(41)) and {out[i] for i in (100, 101, 102)} == {100}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    vectors = [(i, (base[i % 12] + rng.normal(scale=0.25, size=16)).tolist()) for i in range(60)]
    vectors += [(60, None), (61, []), (62, [0.0] * 16), (63, [float("nan")] + [1.0] * 15), (64, [None] + [1.0] * 15), (65, [float("inf")] + [1.0] * 15), (66, vectors[0][1]), (67, [2 * x for x in vectors[0][1]]), (68, [1.0, 2.0]), (69, [1e200, 1e200]), (70, [1e200, 1e200])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in vectors], "vec_id long, embedding array<double>, label int, rep int")
    assert got(embedding_dedup.near_duplicate_embeddings(df), "vec_id", "n_links", "component_id", "kept") == brute.cosine_links(vectors)
    assert embedding_dedup.near_duplicate_embeddings(df.where("false")).count() == 0


def test_embeddings_join_tight_groups(spark):
    rng = np.random.default_rng(5)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    rows = [unit(rng.normal(size=(600, 64)))]
    for _ in range(8):  # groups of more vectors than a list holds, joined only by links between them
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        for centre in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * b):
            rows.append(unit(centre + rng.normal(scale=0.004, size=(20, 64))))
    vectors = list(enumerate(np.concatenate(rows).tolist()))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert got(embedding_dedup.near_duplicate_embeddings(df), "vec_id", "n_links", "component_id", "kept") == brute.cosine_links(vectors)


def test_embeddings_dense_groups(spark):
    """Thousands of vectors in dense groups whose pairs lie close to the threshold on both sides, over several blocks."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        centre = rng.normal(size=48)
        noise = rng.normal(size=(90 if g else 1300, 48))
        rows.append(centre / np.linalg.norm(centre) + noise / np.linalg.norm(noise, axis=1, keepdims=True) * (0.325 if g % 2 else 0.3))
    rows.append(rng.normal(size=(500, 48)))
    x = np.concatenate(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    vectors = list(enumerate(x.tolist()))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    out = embedding_dedup.near_duplicate_embeddings(df).toPandas().set_index("vec_id").sort_index()
    assert (out.n_links.to_numpy() == near.sum(axis=1) - 1).all()
    seen = np.arange(len(x))
    while (nxt := np.where(near, seen[None, :], len(x)).min(axis=1)).tolist() != seen.tolist():
        seen = nxt
    assert (out.component_id.to_numpy() == seen).all()


def test_embeddings_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.01]), (2, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embedding_dedup.near_duplicate_embeddings(df).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in out) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (2, 0, 2)]


def test_embeddings_audit_counts_vectors_with_links(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64))
    x[:100] = x[0] + rng.normal(scale=0.01, size=(100, 64))  # a large group, found
    x[101] = x[100] + rng.normal(scale=0.01, size=64)  # a lone pair, not found
    classes = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "rep long, vec array<double>")
    comp = spark.createDataFrame([(i, 0) for i in range(100)], "node long, component long")
    assert abs(embedding_dedup._audited(classes, comp, 0.9) - 100 / 102) < 1e-9
    assert embedding_dedup._audited(classes, comp.union(spark.createDataFrame([(100, 100), (101, 100)], comp.schema)), 0.9) == 1
    assert embedding_dedup.orders_for(20, 0.9) > embedding_dedup.orders_for(14, 0.9) > embedding_dedup.ORDERS


LM_COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def same_scores(out, want):
    assert [r[:5] for r in out] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in out], [r[5:] for r in want], rtol=1e-9)


def test_language_model(docs, empty):
    for tokens in (1 << 20, 7):
        same_scores(got(language_model.score_documents(docs, block_tokens=tokens), *LM_COLUMNS), brute.ngram(PAIRS, language_model.PRIORS))
    assert language_model.score_documents(empty).count() == 0


@pytest.mark.parametrize(("order", "priors", "least"), [(1, [1.0], 1), (2, [5.0], 1), (3, [0.5, 8.0], 3), (4, [2.0, 0.1, 7.0], 2), (5, [40.0, 3.0], 1)])
def test_language_model_orders(spark, order, priors, least):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "a b c d e f g", "z z z z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    out = language_model.score_documents(df, order=order, priors=priors, min_context=least, block_tokens=200, shard_tokens=50)
    same_scores(got(out, *LM_COLUMNS), brute.ngram(list(enumerate(texts)), priors, order, least))


def test_language_model_is_a_distribution(spark):
    """Over a closed vocabulary, what may follow a text's start sums to one."""
    train = [(i, x) for i, x in enumerate(["a b", "a", "b b a", "a b", "", "c a", "b"]) if brute.crc(i) % 7 != 2]
    held = [i for i in range(1000, 3000) if brute.crc(i) % 7 == 2]
    words = ["a", "b", "c", "unseen"]
    asked = [(held[0], "")] + [(held[k + 1], w) for k, w in enumerate(words)]
    df = spark.createDataFrame(train + asked, "doc_id long, text string")
    out = {r.doc_id: r for r in language_model.score_documents(df, order=2, priors=[2.0]).collect()}
    # P(w) = P(text w) / P(end after w); an unseen word is no state, so the end after it has its base probability
    grams = brute.ngram(train + asked, [2.0], 2)
    assert {r[0]: pytest.approx(r[6]) for r in grams} == {i: r.score for i, r in out.items()}
    n, v = out[held[0]].train_tokens, len({t for _, x in train for t in [*x.split(), None]})

    def end_after(w):
        lines = [["<s>", *x.split(), None] for _, x in train]
        base = (len(train) + 1) / (n + v + 1)
        c = sum(line.count(w) for line in lines)
        pair = sum(1 for line in lines for p in zip(line, line[1:]) if p == (w, None))
        return base if c < 2 else (pair + 2 * base) / (c + 2)

    total = 10 ** out[held[0]].score + sum(10 ** out[held[k + 1]].score / end_after(w) for k, w in enumerate(words))
    assert total == pytest.approx(1)


def test_blocks_pack_and_ask():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64))
    for a in ([blocks.steps(keys), b"x\x00y", np.zeros(0, np.uint8)], [np.arange(5, dtype=np.int64)]):
        back = blocks.unpack(blocks.pack(*a))
        assert len(back) == len(a) and all((x == y).all() if isinstance(y, np.ndarray) else x == y for x, y in zip(back, a, strict=True))
    assert (np.cumsum(blocks.steps(keys), dtype=np.uint64) == keys).all()
    parts = blocks.by_shard(keys, 7)
    assert sorted(np.concatenate([p for _, p in parts]).tolist()) == list(range(500)) and len(parts) == 7
    for c, w in (([5, 1, 5, 1], [2, 9, 2, 0]), ([1 << 50, 1, 1 << 50, 1], [1 << 20, 9, 1 << 20, 0])):
        first, last, where = language_model._distinct(np.array(c), np.array(w))
        assert list(zip(first, last, strict=True)) == sorted(set(zip(c, w, strict=True))) and (first[where] == c).all() and (last[where] == w).all()


def test_piece_encoding(docs, empty):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    assert piece_encoding.PieceModel(path).by_chunk
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, x in PAIRS:
        ids = sp.encode(x or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got(piece_encoding.piece_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    # small blocks, many owners
    assert got(piece_encoding.piece_digests(docs, path, block_chunks=9, shard_chunks=100), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = piece_encoding.decode_documents(piece_encoding.encode_documents(docs, path), path)
    assert got(back, "doc_id", "text") == [(i, sp.decode(sp.encode(x or ""))) for i, x in PAIRS]
    assert piece_encoding.piece_digests(empty, path).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    pieces = packing.pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"), window=64).toPandas().sort_values(["doc_id", "start"])
    for i, x in PAIRS:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        own = pieces[pieces.doc_id == i]
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert packing.pack_documents(empty, queries.tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_packing_query_gives_the_tokenizers_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> x", "a <|endoftext|>", "one\n<|endoftext|><|endoftext|>  two.", "<|endoftext|", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    for out in (queries.op4_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert got(out, "doc_id", "doc_tokens", "ids_crc32") == want


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, window = int(rng.integers(1, 40)), int(rng.integers(4, 12))
        cuts = np.cumsum(rng.integers(1, window + 1, n))
        costs = rng.integers(0, 9, n).astype(float)
        chosen = packing.choose_cuts(cuts, costs, window)
        cost = dict(zip(cuts.tolist(), costs.tolist(), strict=True))
        spent = sum(window - (b - a) + cost[b] for a, b in zip([0, *chosen], chosen[:-1], strict=False))
        assert chosen[-1] == cuts[-1] and all(b - a <= window for a, b in zip([0, *chosen], chosen, strict=False))
        assert abs(spent - brute.cheapest_cuts(cuts.tolist(), costs.tolist(), window)) < 1e-9


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, None, None), (5, 0, "", ""), (6, 0, "user", "hi"), (6, 1, "bot", "no"), (6, 1, "bot", "no")]
    turns += [(9, k, "user", f"t{k}") for k in range(20)] + [(8, k, "user", f"t{k}") for k in range(12)]
    df = spark.createDataFrame([(*r, 1, "c") for r in turns], "conv_id long, turn long, role string, text string, c int, k string")
    for chunk in (256, 5):
        out = chat.format_conversations(df, chunk_turns=chunk).toPandas()
        whole = out.sort_values("part").groupby("conv_id").agg(n=("n_turns", "first"), copies=("copies", "first"), text=("text", "".join), parts=("part", "nunique"), last=("part", "max")).reset_index()
        assert sorted(zip(whole.conv_id, whole.n, whole.copies, strict=True)) == brute.maximal(turns)
        assert (whole.parts == whole["last"] + 1).all()
        assert whole[whole.conv_id == 9].text.item().count("<|im_start|>") == 20
    assert chat.format_conversations(df.where("false")).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, DATA).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    key = sorted(a.columns)
    assert key == sorted(b.columns)
    assert sorted(map(str, a[key].itertuples(index=False, name=None))) == sorted(map(str, b[key].itertuples(index=False, name=None)))


@needs_data
def test_html(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(60)
    extra = spark.createDataFrame([(900001, "u", None), (900002, "u", ""), (900003, "u", "<nav><a>menu</a></nav><footer>f</footer>"), (900004, "u", '<body><div class="sidebar"><p>side</p></div><article><h1>T &amp; U</h1><p>one<br>two <b>three</p><form>f</form><div class="comments"><p>c</p></div><p>last one<script>"</p>"</script></article><!-- x --><aside>a</aside></body>')], "page_id long, url string, html string")
    out = {r.page_id: r for r in html_text.extract_main_text(pages.unionByName(extra)).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)</article>", r.html, re.S)
        want = [b for b in (" ".join(__import__("html").unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", m[1])) if b]
        assert out[r.page_id].text == "\n".join(want) and out[r.page_id].n_chars == len(out[r.page_id].text)
    assert [out[i].text for i in (900001, 900002, 900003)] == ["", "", ""]
    assert out[900004].text == "T & U\none two three\nlast one"


PARAGRAPH = "The quick brown fox jumps over the lazy dog and runs away. It was a good day for everyone involved in this small story."
#: Pages that no name labels, or that names mislabel, and the blocks of their articles.
ODD_PAGES = {
    f"<h1>Title here</h1><p>{PARAGRAPH}</p><p>Second one is short.</p>": ["Title here", PARAGRAPH, "Second one is short."],
    f"{PARAGRAPH}\n {PARAGRAPH}": [f"{PARAGRAPH} {PARAGRAPH}"],
    f"<html><body><div><div><a href=x>Home</a></div><div><a href=y>About us</a></div></div><div><div>{PARAGRAPH}</div><div>{PARAGRAPH} More.</div></div><div>Copyright 2020</div></body></html>": [PARAGRAPH, f"{PARAGRAPH} More."],
    f'<body class="has-sidebar"><nav><a href=x>Home</a></nav><div class="post-comments-enabled article"><h1>My title</h1><p>{PARAGRAPH}</p></div><footer>All rights reserved</footer></body>': ["My title", PARAGRAPH],
    f'<div class="ad">{PARAGRAPH}</div><article><h1>My title</h1><p>{PARAGRAPH}</p></article><div id="comments"><div class="comment"><p>{PARAGRAPH}</p></div></div>': ["My title", PARAGRAPH],
    f'<article><h1>My title</h1><p>{PARAGRAPH}</p></article><div id="comments"><div class="comment">{PARAGRAPH}</div><div class="comment"><p>{PARAGRAPH}</p></div></div>': ["My title", PARAGRAPH],
    f'<div class="cookie-notice"><p>{PARAGRAPH}</p></div><article><p>{PARAGRAPH}</p></article>': [PARAGRAPH],
    f'<div id="nav"><div>{PARAGRAPH}</div></div><article><p>{PARAGRAPH}</p><p>More of it.</p></article><div class="cookie-notice">{PARAGRAPH}</div>': [PARAGRAPH, "More of it."],
    "<nav><a>menu</a></nav><footer>f</footer>": [],
    "<p>Just one paragraph.</p>": ["Just one paragraph."],
    f"<ul><li><a>Home</a></li><li><a>News</a></li></ul><h1>Report</h1><p>{PARAGRAPH}</p><table><tr><td>alpha</td><td>12</td></tr></table><p>{PARAGRAPH}</p>": ["Report", PARAGRAPH, "alpha", "12", PARAGRAPH],
}


@pytest.fixture(scope="module")
def labeller(spark):
    ship_package(spark)
    return html_text.train_committee(spark, [])


def test_html_without_names(labeller):
    reader = html_text.Reader()
    for page, want in ODD_PAGES.items():
        blocks = html_text.leaf_blocks(page)
        kept = labeller.label([reader.features(blocks)])[0]
        assert [b.text for b, k in zip(blocks, kept, strict=True) if k] == want, page


def test_html_held_out_layouts(labeller):
    rng, reader = np.random.default_rng(77), html_text.Reader()
    told = [html_text.synthetic_page(rng) for _ in range(300)]
    kept = labeller.label([reader.features(b) for b, _ in told])
    right = np.concatenate([k == (y > 0) for k, (_, y) in zip(kept, told, strict=True)])
    assert right.mean() > 0.94


def test_html_reads_whole_blocks_and_open_heads():
    blocks = [html_text.Block(("p",), " ".join(["word"] * 60 + [x] + ["word"] * 60), 0) for x in ("cookies", "article")]
    reader = html_text.Reader()
    a, b = reader.features(blocks)
    words = slice(html_text.PATH_DIM + html_text.BOX_DIM, html_text.PATH_DIM + html_text.BOX_DIM + html_text.WORD_DIM)
    assert (a[words] != b[words]).any()
    reader.words.limit = 1  # a vocabulary started anew gives the same rows
    assert (reader.features(blocks) == np.stack([a, b])).all() and len(reader.features([])) == 0
    for page in ("<html><head><title>t</title><body><p>x</p></body>", "<head><meta charset=utf8><p>x</p>", "<head><style>s</style> x"):
        assert [z.text for z in html_text.leaf_blocks(page)] == ["x"]
    assert html_text.leaf_blocks("<html><head>\n<title>t</title> <link href=x><script>s</script></head><body></body></html>") == []


def test_html_labels_of_named_boxes():
    label = lambda page: (y if (y := html_text.article_labels(html_text.leaf_blocks(page))) is None else y.tolist())
    assert label('<article class="post-comments-on"><p>a</p><div class="comments"><p>c</p></div><form>f</form></article><p>z</p>') == [1, 0, 0, 0]
    assert label('<article><p>a</p><div class="user-comments">c</div></article>') is None  # may be either
    assert label('<main class="menu"><p>a</p></main><div class="user-comments">c</div>') == [1, 0]
    assert label("<p>a</p>") is None


def test_html_edge_pages(spark):
    long = "<article>" + "".join(f"<p>{PARAGRAPH} {i}</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", long, "clash", 5), (2, None, None, None, 5), (3, "v", "<p>Just one paragraph.</p>", "t", 5), (3, "v", "<p>Just one paragraph.</p>", "t", 5), (None, "w", "", "", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    out = html_text.extract_main_text(df).collect()
    assert sorted((r.page_id or 0, r.n_chars == len(r.text), r.text.count("\n")) for r in out) == [(0, True, 0), (1, True, 2999), (2, True, 0), (3, True, 0), (3, True, 0)]
    assert [r.text for r in out if r.page_id == 3] == ["Just one paragraph."] * 2
    assert html_text.extract_main_text(df.where("false")).count() == 0


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    m = html_text.BlockLabeller()
    x = rng.normal(size=(2, 5, html_text.INPUT)).astype(np.float32)
    y = rng.integers(0, 2, (2, 5)).astype(np.float32)
    mask = np.array([[1] * 5, [1] * 3 + [0] * 2], bool)

    def loss():
        z = m.logits(x, mask).astype(float)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    for name, g in m.gradients(x, y, mask).items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = m.p[name][i]
        m.p[name][i] = keep + 1e-2
        up = loss()
        m.p[name][i] = keep - 1e-2
        down = loss()
        m.p[name][i] = keep
        assert abs((up - down) / 2e-2 - g[i]) < 2e-2 * max(1e-2, abs(g[i])) + 1e-4, name


def labelled(spark, n=900):
    """Clean and odd texts with labels that depend on the text alone."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vileword", "vilewords", "nastyone", "Nastyone,"])
        if not good:
            w = [x + rng.choice(["$$$", "***", "###"]) for x in w]
        rows.append((i, " ".join(w), "en"))
        labels.append((i, good, toxic))
    rows += [(n, None, "en"), (n + 1, "", None), (n + 1, "", None)]
    labels += [(n, None, None), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, y string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, column):
    docs, labels = labelled(spark)
    out = module.classify(docs, labels).toPandas()
    assert len(out) == 903 and out.score.between(0, 1).all()
    assert (out.held_out == [brute.crc(i) % 3 == 1 for i in out.doc_id]).all()
    limit = 0.5 if column == "quality" else 0.7
    assert (out.predicted == (out.score >= limit)).all()
    truth = labels.toPandas().dropna().drop_duplicates("doc_id").set_index("doc_id")[column]
    held = out[out.held_out & out.doc_id.isin(truth.index)]
    assert (held.predicted.to_numpy() == truth.loc[held.doc_id].to_numpy()).mean() > 0.97
    # neither held-out labels nor ids, languages and sources matter
    flipped = labels.selectExpr("doc_id", *(f"if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - {c}, {c}) as {c}" for c in ("quality", "toxic")))
    again = module.classify(docs, flipped).toPandas()
    assert np.allclose(out.sort_values(["doc_id", "score"]).score, again.sort_values(["doc_id", "score"]).score)
    assert module.classify(docs.where("false"), labels).count() == 0
    assert len(module.classify(docs.limit(5), labels.where("false")).collect()) == 5


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_of_odd_tables(spark, module, column):
    """Very long texts, ties, repeated rows, null ids and columns with clashing names."""
    docs, labels = labelled(spark, 120)
    long = spark.createDataFrame([(5000, "word " * 200_000 + "vileword"), (5001, "word " * 200_000), (None, "a b"), (5003, None), (5003, None), (5004, "a b")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(long).selectExpr("*", "text as x", "1 as score", "2 as p", "doc_id as id", "'q' as toxic", "'q' as quality")
    out = module.classify(table, labels).toPandas()
    assert len(out) == 123 + 6 and out.score.between(0, 1).all() and out.doc_id.isna().sum() == 1
    same = out[out.doc_id.isin([5004]) | out.doc_id.isna()].score
    assert same.nunique() == 1 and out[out.doc_id == 5003].score.nunique() == 1
    if module is toxicity:
        assert out.set_index("doc_id").score[5000] > out.set_index("doc_id").score[5001]


def test_toxicity_segments_and_vocabulary_resets(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(80)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    model = toxicity.train(texts, [i % 3 == 0 for i in range(60)])
    whole = next(toxicity._raw(model, iter([texts])))[0]
    monkeypatch.setattr(toxicity, "SEGMENT", 7)
    monkeypatch.setattr(toxicity.Vocabulary.__init__, "__defaults__", (10,))
    parts = next(toxicity._raw(model, iter([texts])))[0]
    np.testing.assert_allclose(whole, parts, atol=1e-5)
    long = [" ".join(rng.choice(words) for _ in range(n)) for n in (100_000, 40_001, 40_002, 40_003, 7, 8, 9)]
    scores = []
    for segment in (1 << 40, 40_000, 9_999):
        monkeypatch.setattr(toxicity, "SEGMENT", segment)
        scores.append(next(toxicity._raw(model, iter([long]))))
    for p, language in scores[1:]:
        np.testing.assert_allclose(p, scores[0][0], atol=1e-5)
        assert (language == scores[0][1]).all()
    sizes = [np.zeros(n) for n in (5, 9, 200_000, 3, 3)]
    assert np.concatenate(list(toxicity._batches(np.arange(5), sizes))).tolist() == [0, 1, 2, 3, 4] and max(map(len, toxicity._batches(np.arange(5), sizes))) == 2


def test_samples_take_one_row_an_id(spark, monkeypatch):
    """One id repeated many times, with many texts, sends one of them to the driver."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[i % 3], f"text number {i}") for i in range(10_000)] + [(i, "bad words here" if i % 2 else "good words here") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(len(texts)) or train(texts[:20], y[:20]))
    assert toxicity.classify(docs, labels).count() == len(rows)
    assert seen[0] <= len(ids)
    pages = spark.createDataFrame([(1, "u", f"<p>page {i}</p>") for i in range(10_000)] + [(2, "u", "<p>x</p>")], "page_id long, url string, html string")
    monkeypatch.setattr(html_text, "train_committee", lambda spark, sample: seen.append(sample) or html_text.Committee([html_text.BlockLabeller().p]))
    assert html_text.extract_main_text(pages).count() == 10_001
    assert len(seen[1]) <= 2


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = np.arange(50.0)
    centres, means = quality.isotonic(x, rng.random(50) + x / 50, np.ones(50))
    assert (np.diff(centres) > 0).all() and (np.diff(means) > 0).all()


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now = docs
    seen = [now.toPandas()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, DATA)
        if i < 4:
            assert out.columns == docs.columns
            now = materialise(out, f"test-stage-{i}")
            seen.append(now.toPandas())
        else:
            packed = out.toPandas()
    ids = [set(p.doc_id) for p in seen]
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    assert ids[1] < ids[0] and len(set(labels[labels.quality == 1].doc_id) - ids[1]) <= 0.02 * len(labels)
    assert ids[2] <= ids[1]
    assert ids[3] == {r[0] for r in brute.exact(list(zip(seen[2].doc_id, seen[2].text, strict=True))) if r[3]}
    assert ids[4] == {r[0] for r in brute.near(list(zip(seen[3].doc_id, seen[3].text, strict=True))) if r[0] == r[2]}
    assert set(packed.doc_id) == ids[4] and packed.groupby("doc_id").length.sum().eq(packed.groupby("doc_id").doc_tokens.first()).all()
    again = seen[0].head(40)
    odd = spark.createDataFrame(
        [(int(r.doc_id), r.text) for r in again.itertuples()] + [(int(again.doc_id[0]), again.text[0]), (None, "a null id. It is kept."), (-7, None), (-8, ""), (-9, "Long words. " * 50_000)], "doc_id long, text string"
    ).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", "1 as score", "2 as id")
    for table in (odd, odd.where("false")):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, DATA)
            kept = out.collect()
            assert i == 4 or out.columns == odd.columns
            if i == 2:  # of rows that repeat a whole text under one id, one stays
                assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    assert len(corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()) == len(ids[4])

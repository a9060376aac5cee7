import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import alignment, lexical_search, sharding

PLACES = sharding.ShardOptions(bucket_rows=7, chunk=3)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def duck(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toPandas())
    return con.execute(sql)


# sharding


@pytest.mark.parametrize("options", [sharding.ShardOptions(), PLACES], ids=["wide", "narrow"])
def test_shards_hold_the_mixture(docs, corpus, options):
    found = rows_of(sharding.op11(docs, options))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sorted(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, *_ in corpus
    )
    shards = defaultdict(list)
    for r in found:
        shards[r["shard"]].append(r)
    counts = [len(shards[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    of_source = Counter(r["source"] for r in found)
    for rows in shards.values():
        for source, n in Counter(r["source"] for r in rows).items():
            assert abs(n - of_source[source] / 16) < 2.5


def test_buckets_do_not_change_shards(docs):
    wide, narrow = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows_of(sharding.op11(docs, o))) for o in (sharding.ShardOptions(), PLACES))
    again = sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows_of(sharding.op11(docs.repartition(11), PLACES)))
    assert wide == narrow == again


def test_shards_equal_sql(spark, odd_rows, corpus):
    df = spark.createDataFrame(odd_rows[1:7] + corpus[:60], "doc_id long, text string, lang string, source string, n_chars long")
    want = duck(f"SELECT doc_id, shard, slot, size, text_crc32 FROM ({sharding.SQL})", documents=df).fetchall()
    got = [(r["doc_id"], r["shard"], r["slot"], r["size"], r["text_crc32"]) for r in rows_of(sharding.op11(df, PLACES))]
    assert sorted(got) == sorted(want)


def test_a_repeated_row_fills_many_slots(spark, corpus):
    df = spark.createDataFrame([(1, "the same", "en", "a", 8)] * 200 + corpus[:40], "doc_id long, text string, lang string, source string, n_chars long")
    found = rows_of(sharding.op11(df, PLACES))
    assert len(found) == 240 and len({(r["shard"], r["slot"]) for r in found}) == 240
    assert set(Counter(r["shard"] for r in found if r["source"] == "a").values()) <= {12, 13}


def test_many_sources_of_one_row(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    found = rows_of(sharding.op11(df, PLACES))
    assert set(Counter(r["shard"] for r in found).values()) == {25}


def test_odd_rows_get_places(odd, none, odd_rows):
    found = rows_of(sharding.op11(odd))
    assert len(found) == len(odd_rows) and len({(r["shard"], r["slot"]) for r in found}) == len(found)
    assert {r["source"] for r in found} == {None, "a", "b", "é"}
    assert sharding.op11(none).count() == 0 and set(sharding.op11(none).columns) == set(sharding.op11(odd).columns)


def test_written_shards_hold_whole_rows(spark, odd, odd_rows, tmp_path):
    path = f"{tmp_path}/shards"
    sharding.write_shards(odd, path, sharding.ShardOptions(shards=3))
    back = spark.read.parquet(path)
    assert sorted(map(str, ((r["doc_id"], r["text"], r["source"]) for r in rows_of(back)))) == sorted(map(str, ((i, t, s) for i, t, _, s, _ in odd_rows)))
    places = sorted((r["shard"], r["slot"]) for r in rows_of(back))
    assert places == sorted((r["shard"], r["slot"]) for r in rows_of(sharding.assign(odd, sharding.ShardOptions(shards=3))))


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top=50):
    held = [(i, Counter(fold(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = set(fold(text))
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


ITEMS = [(1, "The house, the RIVER and the stone!"), (2, "haus fluss"), (3, "nowhere"), (4, None), (5, ""), (6, "é É 😀"), (2, "haus fluss"), (7, "w1-w2_w3 the"), (8, "ſtone Öl")]


@pytest.mark.parametrize(
    "options", [lexical_search.SearchOptions(), lexical_search.SearchOptions(top=3, block_items=2, batch=5), lexical_search.SearchOptions(top=2, block_bytes=10, cell=1)],
    ids=["one block", "blocks of items", "blocks of bytes"],
)
def test_search_equals_brute_force(spark, docs, corpus, options):
    extra = [(900, "Stone stone ſtone\x85stone ÖL Öl", None, None, 0), (901, "a.the.house\x00river stone", None, None, 0)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows_of(lexical_search.search(df, items, options))]
    assert sorted(found, key=str) == ranked([(r[0], r[1]) for r in corpus + extra], ITEMS, options.top)


def test_search_over_odd_rows(spark, odd, none, odd_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    found = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows_of(lexical_search.op12(odd, items))]
    assert sorted(found, key=str) == ranked([(r[0], r[1]) for r in odd_rows], ITEMS)
    assert lexical_search.op12(none, items).count() == 0
    assert lexical_search.op12(odd, items.limit(0)).count() == 0


def test_copies_rank_by_id(spark):
    df = spark.createDataFrame([(i, "same words here") for i in range(300)] + [(1000, "other")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    found = sorted((r["rank"], r["doc_id"]) for r in rows_of(lexical_search.op12(df, items)))
    assert found == [(k + 1, k) for k in range(50)]


def test_search_equals_sql(spark, docs):
    items = spark.createDataFrame([x for x in ITEMS[:4]] + [(9, "der die das the")], "item_id long, text string")
    want = duck(f"SELECT item_id, rank, doc_id, score, n_terms, n_matched FROM ({lexical_search.SQL})", documents=docs, benchmark=items).fetchall()
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"], r["n_terms"], r["n_matched"]) for r in rows_of(lexical_search.op12(docs, items))]
    assert sorted(got) == sorted(want)


def test_texts_of_finds(spark, docs, corpus):
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    texts = {i: t for i, t, *_ in corpus}
    found = rows_of(lexical_search.with_texts(lexical_search.op12(docs, items), docs, "text"))
    assert found and all(r["text"] == texts[r["doc_id"]] for r in found)


# alignment

OPTIONS = alignment.AlignOptions()


@pytest.fixture(scope="module")
def codecs():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(OPTIONS.byte_bpe)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=OPTIONS.piece_bpe)


def intervals(codecs, text):
    """Tokens of *text* by both tokenizers as (start, end, id), from the libraries alone; none where the bytes differ."""
    a, b = codecs
    if not text:
        return [], []
    byte = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    byte |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in byte.values())}
    out = []
    x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    for side in (x, y):
        if b"".join(t for _, t in side) != (" " + text).encode():
            return [], []
        at, rows = 0, []
        for i, t in side:
            rows.append((at, at + len(t), i))
            at += len(t)
        out.append(rows)
    return tuple(out)


def aligned(codecs, texts):
    """The contract's columns, one text after the other, every pair of tokens compared."""
    docs, total = [], Counter()
    for i, text in texts:
        x, y = intervals(codecs, text)
        links = [(p, q) for p, (s, e, _) in enumerate(x) for q, (s2, e2, _) in enumerate(y) if s < e2 and s2 < e]
        total.update((x[p][2], y[q][2]) for p, q in links)
        docs.append((i, x, y, links))
    best = defaultdict(int)
    for (_, j), n in total.items():
        best[j] = max(best[j], n)
    out = []
    for i, x, y, links in docs:
        cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for _, e, t in side if before < e <= cut) for side in (x, y)))
            before = cut
        ids = [(x[p][2], y[q][2]) for p, q in links]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((i, len(x), len(y), len(cuts), len(links), sum(total[p] == best[p[1]] for p in ids), sum(total[p] for p in ids), sha))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "Hello world's end", " leading", "two  spaces\n\tand   more  ", "<|endoftext|> <s> plain </s> <unk>", "▁ is not a space", "日本語のテキスト 😀👍🏽 é", "\x00nul\x1f", "1234567890 3.14",
    "don't we'll I'VE", "ﬁ ｗide Å", "a" * 700, "x", " ", "\n", "नमस्ते दुनिया", "﻿bom", "tab\tseparated\r\nlines\r\n",
]


@pytest.mark.parametrize("heavy", [1 << 20, 40, 0])
def test_alignment_equals_brute_force(spark, docs, corpus, codecs, heavy):
    texts = [(i, t) for i, t, *_ in corpus[:50]] + [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(2000, None), (2001, ""), (1000, TEXTS[0])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = rows_of(alignment.op13(df, alignment.AlignOptions(heavy=heavy, chunk_bytes=900)))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str) == aligned(codecs, texts)


def test_tokens_groups_and_links(spark, codecs):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in rows_of(alignment.align(df)):
        x, y = intervals(codecs, TEXTS[r["doc_id"]])
        assert (r["a_ids"], r["a_ends"]) == ([i for *_, i in x], [e for _, e, _ in x])
        assert (r["b_ids"], r["b_ends"]) == ([i for *_, i in y], [e for _, e, _ in y])
        links = [(p, q) for p, (s, e, _) in enumerate(x) for q, (s2, e2, _) in enumerate(y) if s < e2 and s2 < e]
        assert list(zip(r["link_a"], r["link_b"], strict=True)) == links
        cuts = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        for ends, groups in ((r["a_ends"], r["a_groups"]), (r["b_ends"], r["b_groups"])):
            assert groups == [sum(c < e for c in cuts) for e in ends]


def test_long_texts_keep_their_tokens(codecs):
    with open(OPTIONS.byte_bpe, "rb") as f, open(OPTIONS.piece_bpe, "rb") as g:
        own = alignment.ByteBpe(f.read()), alignment.PieceBpe(g.read())
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the", " ", "  ", "stone", "\n", " é", "1", "!", " "]) for _ in range(60_000)), " " * 150_000 + "x", "a" * 70_000, "\n " * 50_000]
    a, b = alignment._encode(own, [t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert a[k] == codecs[0].encode(" " + t, add_special_tokens=False).ids
        assert b[k] == codecs[1].encode(t)


def test_alignment_of_odd_rows(odd, none, odd_rows):
    found = rows_of(alignment.op13(odd))
    assert len(found) == len(odd_rows)
    assert [r["n_a"] for r in found if r["doc_id"] == 2] == [0] and [r["groups_sha256"] for r in found if r["doc_id"] is None] == [""]
    assert {r["n_groups"] > 20_000 for r in found if r["doc_id"] == 5} == {True}
    assert alignment.op13(none).count() == 0 and alignment.op13(none).columns == COLUMNS

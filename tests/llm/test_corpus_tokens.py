"""Tokens, token files, packing, toxicity and vectors against the library, plain versions and held-out rows."""

import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, token_files, toxicity, vectors
from tidemark.llm.tokens import Pieces, portions

DOCS = "doc_id long, text string"
BYTES, WORDS = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))

ODD = [
    None, "", " ", "  a  b ", "a\n ", "\n\n x", "tab\tx\x0b\r\n y", "<|endoftext|> x <|startoftext|>y<|endoftext|>", "a <|endoftext|>b",
    "It's don't I'LL 12345 ½² Ⅷ émile É ñandú ﬁ ǅ İ ẞ 日本語テキスト 🎉🎊 a b 　 c", "x" * 3000, "ab" * 900, "_ _a __ ", "!" * 500,
    "\0 a \0", "a\x1cb \x1d", "CAFÉ'S 'S 'LL", "ΑΣ Σ ſ K", "1 2 22 ２３", "word. Word, word;\nWord", "é ́x",
]


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema).withColumn("ids", F.lit(1)).withColumn("start", F.lit(2))


def library(path, texts):
    found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [x.ids for x in found]


def real_texts(spark, size="sf0.001"):
    return [r["text"] for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_equal_the_library(spark, path):
    texts = ODD + real_texts(spark)
    own = Pieces(path)
    own.words.limit = 50  # a cache that starts again all the time
    assert [own.ids(t or "").tolist() for t in texts] == library(path, texts)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_batches_equal_the_library(path):
    """Texts of random odd characters, together, in slices and as portions of any size."""
    rng = np.random.default_rng(7)
    parts = [*" \n\t\0\x1c\x85\u00a0\u2028'aZ0.é½日", "'s", "  ", " \n", "\n\n ", " a", "word", "Ünder", "<|endoftext|>", "x\x1cé"]
    texts = pa.array(["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)])
    own, expected = Pieces(path), library(path, texts.to_pylist())
    assert [x.tolist() for x in own.batch(texts)] == expected
    rows = pa.RecordBatch.from_arrays([texts.slice(1000)], names=["text"])
    assert [x.tolist() for part in portions(rows, 0, 500) for x in own.batch(part.column(0))] == expected[1000:]
    assert own.batch(texts.slice(0, 0)) == []


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_long_texts(path):
    """A text of over a megabyte is one value, and has the library's ids; occurrences are gathered in several parts."""
    text = "The  quick brown fox; émile 12 jumps.\nOver " * 4 + " ".join(f"word{i % 977} Abc{i}" for i in range(90_000))
    assert len(text) > 1 << 20
    assert [x.tolist() for x in Pieces(path).batch(pa.array(["a", text, "b"]))] == library(path, ["a", text, "b"])


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_trie_equals_the_library(spark, path):
    texts = ODD + real_texts(spark)[:60]
    codec = bpe.Codec(path)
    assert [x.tolist() for x in codec.encode(pa.array([t or "" for t in texts]))] == library(path, texts)


def test_trie_shares_prefixes():
    trie, walked = bpe.Trie(WORDS), []
    plain = trie.last_token
    trie.last_token = lambda path, depth, states, end: walked.append(("".join(path[:depth]), end)) or plain(path, depth, states, end)
    words = {"zqinformxq", "zqinformxqs", "zqinformxqzzz", "zqinf"}
    dict(trie.encode(words))
    # The state of a prefix is found once, for all words that share it.
    assert len(walked) == len(set(walked)) and {w for w, end in walked if end} == words


def test_encode_and_decode(spark):
    texts, tokenizer = ODD + real_texts(spark)[:40], Tokenizer.from_file(WORDS)
    rows = bpe.encode_and_decode(frame(spark, texts), WORDS).orderBy("doc_id").collect()
    expected = library(WORDS, texts)
    assert [r["ids"] for r in rows] == expected
    assert [r["decoded"] for r in rows] == [tokenizer.decode(x, skip_special_tokens=False) for x in expected]
    again = bpe.decode(bpe.encode(frame(spark, texts), WORDS), WORDS).orderBy("doc_id").collect()
    assert [r["text"] for r in again] == [r["decoded"] for r in rows]
    assert bpe.encode_and_decode(frame(spark, []), WORDS).count() == 0


# ---------------------------------------------------------------- files


def huffman_cost(counts):
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        merged = heapq.heappop(heap) + heapq.heappop(heap)
        cost += merged
        heapq.heappush(heap, merged)
    return cost


@pytest.mark.parametrize(("symbols", "limit"), [(0, 16), (1, 16), (2, 16), (5, 3), (300, 9), (300, 30), (5000, 16)])
def test_code(symbols, limit):
    rng = np.random.default_rng(symbols)
    counts = rng.integers(0, 10, 3) * 0 if not symbols else np.concatenate([[0], rng.zipf(1.7, symbols) % 10**6 + 1])
    lengths = token_files.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit and ((lengths > 0) == (counts > 0)).all()
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    if limit == 30:
        assert (counts * lengths).sum() == huffman_cost(counts)
    code, used = token_files.Code(lengths), np.flatnonzero(counts)
    for size in (0, 1, 127, 128, 129, 5000) if symbols else (0,):
        ids = rng.choice(used, size).astype(np.uint16) if size else np.zeros(0, np.uint16)
        payload, offsets = code.encode(ids)
        assert (code.decode(payload, offsets, size) == ids).all()
        # Every block can be decoded without the ones before it.
        if size > 300:
            part = code.decode(payload, offsets[2:3], token_files.BLOCK)
            assert (part == ids[2 * token_files.BLOCK : 3 * token_files.BLOCK]).all()


@pytest.mark.parametrize("segment", [64, 1 << 19])
def test_token_files(spark, segment, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    texts = ODD + real_texts(spark)[:50]
    docs = frame(spark, texts).repartition(5)
    files = token_files.write_token_files(docs, BYTES, end_id=0)
    rows = token_files.read_token_files(spark, files).orderBy("doc_id").collect()
    at = 0
    for row, ids in zip(rows, library(BYTES, texts), strict=True):
        whole = np.array([*ids, 0], dtype="<u4")
        assert (row["start"], row["n_tokens"], bytes(row["ids"])) == (at, len(whole), whole.tobytes())
        at += len(whole)


def test_token_files_of_nothing_and_of_repeated_rows(spark):
    empty = token_files.write_token_files(frame(spark, []), BYTES)
    assert token_files.read_token_files(spark, empty).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (0, "d")], DOCS)
    rows = token_files.read_token_files(spark, token_files.write_token_files(twice, BYTES)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == [(None, 0, 2), (0, 2, 2), (1, 4, 3), (1, 7, 3)]


# ---------------------------------------------------------------- packing


def check_sequences(sequences, lengths, top=2048):
    seen = [np.zeros(n, dtype=int) for n in lengths]
    for sequence in sequences:
        total = sum(size for _, _, size in sequence)
        assert total <= top and total & (total - 1) == 0 and all(size > 0 for _, _, size in sequence)
        for document, start, size in sequence:
            seen[document][start : start + size] += 1
    assert all((x == 1).all() for x in seen)


@pytest.mark.parametrize("seed", range(4))
def test_pools(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in np.concatenate([rng.integers(1, 9000, 40), rng.integers(1, 300, 60)])][: 1 + 33 * seed]
    check_sequences(packing.pack_pool(lengths), lengths)
    cuts = sum(map(len, packing.pack_pool(lengths)))
    assert cuts <= 2 * len(lengths) + sum(n // 2048 for n in lengths) + 12


def test_pool_edges():
    assert packing.pack_pool([]) == []
    check_sequences(packing.pack_pool([1]), [1])
    check_sequences(packing.pack_pool([2048, 4096, 2047, 1]), [2048, 4096, 2047, 1])
    check_sequences(packing.pack_pool([7] * 1000), [7] * 1000)


def test_step_groups_are_even():
    sizes = [2048] * 100 + [1024] * 37 + [256] * 55 + [1]
    loads = np.bincount(packing.step_groups(sizes), weights=sizes)
    assert loads.max() - loads.min() <= 2048


def test_pack(spark):
    texts = ODD + real_texts(spark)[:80]
    rows = packing.pack(frame(spark, texts).repartition(3), WORDS, pool=20_000).collect()
    expected = [np.array([*x, 1], dtype="<u4") for x in library(WORDS, texts)]
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["doc_tokens"] == len(expected[r["doc_id"]])
        assert bytes(r["ids"]) == expected[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()
        assert r["offset"] == sum(x["length"] for x in sequences.setdefault(r["sequence_id"], []))
        sequences[r["sequence_id"]].append(r)
    pieces = [[(r["doc_id"], r["start"], r["length"]) for r in s] for s in sequences.values()]
    check_sequences(pieces, [len(x) for x in expected])
    assert all({r["sequence_tokens"] for r in s} == {sum(r["length"] for r in s)} for s in sequences.values())
    assert packing.pack(frame(spark, []), WORDS).count() == 0


# ---------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    scored = toxicity.toxicity(docs.withColumn("p_toxic", F.lit(1)), labels.where(odd))
    unseen = labels.where(~odd).select("doc_id", F.col("toxic").alias("label"))
    rows = scored.join(unseen, "doc_id").select("toxic", "label").collect()
    caught = sum(r[0] for r in rows if r[1]) / sum(r[1] for r in rows)
    wrong = sum(r[0] for r in rows if not r[1]) / sum(1 - r[1] for r in rows)
    # A part of the labels is noise: documents without one abusive word that are called toxic.
    assert caught > 0.6 and wrong < 0.003


def test_chain_feeds_earlier_probabilities(spark):
    rows = [(i, "bad thing here" if i % 3 == 0 else "good thing here") for i in range(300)]
    labels = [(i, int(i % 3 == 0), 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    chain = toxicity.train(docs, marks, {"first": "toxic = 1", "second": "toxic = 1 and quality = 1"})
    assert "bad" in chain.words and [len(w) for w in chain.weights] == [len(chain.words) + 1, len(chain.words) + 2]
    assert chain.weights[1][-2] > 0.1
    assert (chain.probabilities(["a bad one", "", "a good one"])[:, 1] > 0.5).tolist() == [True, False, False]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "idiot"), (3, "x " * 50_000)], DOCS)
    schema = "doc_id long, toxic int, quality int"
    for labels in ([], [(1, None, 1), (None, 1, 1)], [(1, 0, 1), (1, 0, 1), (2, 1, 0)]):
        marks = spark.createDataFrame(labels, schema)
        assert toxicity.toxicity(docs, marks).where("not toxic").count() == 5
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    odd = docs.withColumn("_row", F.lit(1)).withColumn("_text", F.lit(2))
    assert toxicity.drop_toxic(odd, marks).columns == odd.columns


# ---------------------------------------------------------------- vectors

VECTORS = "vec_id long, embedding array<float>"


def brute_force(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("kind", ["noise", "clusters", "lengths", "copies"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 300)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 10)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24))
    if kind == "clusters":
        x = x * 0.3 + rng.standard_normal((12, 24))[rng.integers(0, 12, 3000)]
    if kind == "lengths":
        x *= rng.uniform(0.1, 5, (3000, 1))
    if kind == "copies":
        x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got, true = found(vectors.nearest(spark.createDataFrame(rows, VECTORS), "vec_id % 20 = 0")), brute_force(rows, 20)
    assert got.keys() == true.keys() and {len(v) for v in got.values()} == {20}
    hits = [len({s for _, s in got[q]} & {s for _, s in true[q]}) / len({s for _, s in true[q]}) for q in true]
    assert np.mean(hits) >= 0.9


def test_unusable_and_few_vectors(spark):
    good = [(i, [float(i % 7), 1.0, float(i)]) for i in range(12)]
    bad = [(20, None), (40, []), (60, [0.0, 0.0, 0.0]), (80, [1.0, None, 1.0]), (100, [float("nan"), 1.0, 1.0]), (120, [float("inf"), 1.0, 1.0]), (140, [1.0]), (None, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame([*good, *bad, good[3]], VECTORS).withColumn("list", F.lit(1)).withColumn("score", F.lit(1))
    assert found(vectors.nearest(rows, "vec_id % 20 = 0")) == brute_force(good, 20)
    assert vectors.nearest(rows.limit(0), "vec_id % 20 = 0").count() == 0


def test_abandoned_early():
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((2000, 64))
    query = rows[0] + 0.1 * rng.standard_normal(64)
    alive = vectors.scan_list(query, rows, 5)
    assert 0 in alive and len(alive) <= 6
    assert zlib.crc32(alive.tobytes()) == zlib.crc32(vectors.scan_list(query, rows, 5).tobytes())

"""Alignment of tokenizers, the filter audit and substring de-duplication against plain versions."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment, filter_audit, substring_dedup
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import byte_letters

DOCS = "doc_id long, text string"
BYTES, UNITS = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "  ", "x ", " x", "  a  b ", "a\n ", "\n\n x", "tab\tx\x0b\r\n y", "<|endoftext|> x <s> </s><unk><0x41>", "It's don't I'LL 12345 ½²",
    "日本語テキスト 🎉🎊 a b 　 c", "already ▁ there", "x" * 3000, "ab " * 900, "\0 a \0", "a\x1c b \x1d c", "é ́x ﬁ", "!" * 500,
]


def frame(spark, texts, schema=DOCS):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).withColumn("ids", F.lit(1)).withColumn("tag", F.lit(2)).withColumn("octets", F.lit(3))


def real_texts(spark, size="sf0.001"):
    return [r["text"] for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").orderBy("doc_id").collect()]


# ---------------------------------------------------------------- alignment


def plain_alignment(texts):
    """Per text: tokens by byte ranges, groups, links and shared-group links, all by loops over whole texts."""
    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=UNITS)
    a.encode_special_tokens = True
    octets = {letter: byte for byte, letter in byte_letters().items()}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        left = [(i, bytes(octets[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (left, right)):
            out.append(None)
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
        common = sorted(set(ends[0]) & set(ends[1]))
        links, groups = [], []
        j = 0
        for i, end in enumerate(ends[0]):
            start = end - len(left[i][1])
            while ends[1][j] <= start:
                j += 1
            k = j
            while k < len(right) and ends[1][k] - len(right[k][1]) < end:
                links.append((i, k, min(end, ends[1][k]) - max(start, ends[1][k] - len(right[k][1]))))
                k += 1
        done = [0, 0]
        for cut in common:
            until = [es.index(cut, at) + 1 for es, at in zip(ends, done)]
            groups.append(tuple([i for i, _ in side[at:to]] for side, at, to in zip((left, right), done, until)))
            done = until
        out.append(([i for i, _ in left], [i for i, _ in right], groups, links))
    return out


@pytest.mark.parametrize("max_pairs", [alignment.MAX_PAIRS, 3000])
def test_alignment_equals_loops_over_whole_texts(spark, max_pairs):
    texts = ODD + real_texts(spark)[:60] + ["ab " * 900]
    expected = plain_alignment(texts)
    pairs = Counter((x[0][i], x[1][j]) for x in expected if x for i, j, _ in x[3])
    highest = {}
    for (_, b), n in pairs.items():
        highest[b] = max(n, highest.get(b, 0))
    rows = alignment.align_tokens(frame(spark, texts), BYTES, UNITS, max_pairs).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for text, row, x in zip(texts, rows, expected):
        if x is None:
            assert tuple(row)[1:] == (0,) * 7 + ("",), text
            continue
        linked = [(x[0][i], x[1][j]) for i, j, _ in x[3]]
        assert row["groups"] == ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in x[2]), text
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (len(x[0]), len(x[1]), len(x[2]), len(x[3]))
        assert row["n_shared"] == sum(len(g) * len(h) for g, h in x[2])
        assert row["n_best"] == sum(pairs[p] == highest[p[1]] for p in linked)
        assert row["count_sum"] == sum(pairs[p] for p in linked)


def test_links_of_documents(spark):
    texts = ODD + real_texts(spark)[:5]
    expected = plain_alignment(texts)
    got = {}
    for row in alignment.token_links(frame(spark, texts), BYTES, UNITS).collect():
        got.setdefault(row["doc_id"], []).append((row["a"], row["b"], row["weight"]))
    assert got == {i: x[3] for i, x in enumerate(expected) if x}
    shared = Counter(r["doc_id"] for r in alignment.token_links(frame(spark, texts), BYTES, UNITS, shared=True).collect())
    assert shared == {i: sum(len(g) * len(h) for g, h in x[2]) for i, x in enumerate(expected) if x}


def test_products_of_sparse_matrices():
    rng = np.random.default_rng(3)
    for block in (1, 7, 1 << 20):
        a, b = (rng.integers(0, 3, s) * (rng.random(s) < 0.3) for s in ((9, 11), (11, 6)))

        def csr(x):
            row, column = np.nonzero(x)
            return alignment.Csr(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]), column, x[row, column], x.shape[1])

        made, dense = csr(a).product(csr(b), block), np.zeros((9, 6), int)
        dense[made.rows(), made.columns] = made.values
        assert (dense == a @ b).all()
        assert (csr(a).times(np.arange(11)) == a @ np.arange(11)).all()
    sizes = rng.integers(1, 9, 400)
    for block in (1, 50, 1 << 20):
        again = alignment.align(sizes, np.full(int(sizes.sum()), 1), block)
        assert again.overlap.columns.tolist() == list(range(sizes.sum())) and again.count == 400


def test_alignment_of_a_worker_cache_that_starts_again(spark, monkeypatch):
    texts = real_texts(spark)[:50]
    whole = alignment.align_tokens(frame(spark, texts), BYTES, UNITS).collect()
    own = alignment.Pieces(BYTES, UNITS)
    monkeypatch.setattr(alignment, "MAX_PIECES", 10)
    assert not own.full() and own.tokens(texts[:5]) and own.full()
    assert sorted(whole) == sorted(alignment.align_tokens(frame(spark, texts).repartition(3), BYTES, UNITS).collect())
    assert alignment.align_tokens(frame(spark, []), BYTES, UNITS).count() == 0
    assert alignment.token_links(frame(spark, []), BYTES, UNITS).count() == 0


def test_distinct_pieces_go_to_the_tokenizers_together():
    own, calls = alignment.Pieces(BYTES, UNITS), []
    for side in own.sides:

        def counted(texts, encode=side.tokens.encode):
            calls.append(texts)
            return encode(texts)

        side.tokens.encode = counted
    texts = [" ".join(f"line{i}\nnext{i}" for i in range(at, at + 50)) for at in range(0, 500, 25)]
    found = own.tokens(texts)
    assert len(own.index) > 500 and len(calls) <= 4  # before: a call for each tokenizer and piece that is no plain word
    for (a, b), x in zip(found, plain_alignment(texts)):
        assert (np.frombuffer(a, "<u2").tolist(), np.frombuffer(b, "<u2").tolist()) == (x[0], x[1])
    assert own.tokens(texts) == found and len(calls) <= 4


@pytest.mark.parametrize("words", [True, False])
def test_a_text_decides_where_its_pieces_do_not_come_back(words):
    own, texts = alignment.Pieces(BYTES, UNITS), ODD + ["x\x85 y", "\u2003 z ﬁ", "a b"]
    if not words:  # as for a vocabulary with another rule for words
        own.sides[0].tokens.words = None
    found = own.tokens(texts)
    for (a, b), x in zip(found, plain_alignment(texts)):
        ids = [np.frombuffer(y, "<u2").tolist() for y in (a, b)]
        assert ids == ([x[0], x[1]] if x else [[], []])
    own.good[:] = False
    assert own.tokens(texts) == found
    own.clear()
    assert [own.tokens([t])[0] for t in texts] == found


def test_groups_of_texts_without_tokens(spark):
    rows = alignment.align_tokens(frame(spark, [None, "", "ﬁ", None]).coalesce(1), BYTES, UNITS).collect()
    assert len(rows) == 4 and [tuple(r)[1:] for r in rows if r["doc_id"] != 2] == [(0,) * 7 + ("",)] * 3


# ---------------------------------------------------------------- filter audit


def plain_audit(rows, good, toxic):
    """Every order applied step by step to every document."""
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    out = Counter()
    for part in {p or "" for _, _, p in rows}:
        fails = []
        for doc_id, text, source in rows:
            if (source or "") != part:
                continue
            text = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            tests = (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                bool(re.search(r"[#$%&*|]", text)), doc_id is not None and doc_id > first[text],
            )
            fails.append((doc_id, {f for f, t in zip("ABCDE", tests) if t}))
        removed = Counter()
        table = {}
        for order in permutations("ABCDE"):
            left = list(fails)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                removed[letter] += len(gone)
                redundant = sum(letter in x[1] for x in fails) - len(gone)
                table[part, "".join(order), step] = (
                    len(left), len(gone), redundant, sum(x[1] == {letter} for x in fails), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), letter,
                )
        out.update({k: 0 for k in table})
        for k, v in table.items():
            out[k] = (*v[:-1], removed[v[-1]])
    return dict(out)


@pytest.mark.parametrize("options", [{}, {"broadcast_blocks": 0, "hot": 3}, {"block_rows": 2}])
def test_audit_equals_every_order_step_by_step(spark, monkeypatch, options):
    rng, plain = random.Random(5), filter_audit.repeats
    monkeypatch.setattr(filter_audit, "repeats", lambda docs: plain(docs, **options))
    words = ["alpha", "Beta", "GAMMA", "d#", "e|", "zeta", "　x", "é"]
    texts = [" ".join(rng.choices([f"w{i}" for i in range(rng.choice((30, 400)))] + words, k=rng.choice((3, 220, 260)))) for _ in range(40)]
    texts += [None, "", " ", "same"] * 4 + texts[:10] * 2
    rows = [(i if i % 17 else None, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)] + [(3, texts[3], "a"), (3, texts[4], "a")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit(1)).withColumn("own", F.lit(1))
    labels = [(i, int(rng.random() < 0.5), int(rng.random() < 0.2)) for i in range(0, 60, 2)] + [(4, None, 1), (None, 1, 1), (900, 1, 1)]
    found = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)))
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()} == plain_audit(rows, good, toxic)
    assert filter_audit.filter_audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_only_possible_repeats_are_compared(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 4990).alias("text"))
    marks = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.pmod(F.xxhash64("text"), F.lit(3)).alias("block"))
    left = filter_audit.possible_repeats(marks, filter_audit.sketch(marks, 3), True).count()
    assert 20 <= left < 1000  # 20 rows have a copy
    assert filter_audit.repeats(docs).count() == 10


# ---------------------------------------------------------------- substrings


def plain_removal(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    starts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if starts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def planted(seed, window):
    """Texts with shared passages around the window's length, copies, loops and words of every size."""
    rng = random.Random(seed)
    letters = ["a", "bb", "ccc", "word", "longerword", "é" * 9, "日本語", "x" * 40, "Ab", "ab"]

    def run(n):
        return [rng.choice(letters) + str(rng.randint(0, 30)) for _ in range(n)]

    shared = [run(window + d) for d in (-1, 0, 1, 20, 90)]
    texts = []
    for _ in range(40):
        words = run(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(shared) + run(rng.randint(0, 9))
        texts.append(rng.choice([" ", "\n", "\t ", "  "]).join(words))
    texts += [None, "", " \n ", "a", "la " * 200, "la " * window, "do re " * 100, texts[3], texts[3], " " + texts[4].upper(), texts[5] + "\x1c　" + "\xa0x"]
    return texts


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0}, {"max_bytes": 0, "shard_words": 300, "hot": 2}, {"shard_words": 300, "hot": 2}])
@pytest.mark.parametrize("window", [35, 12])
def test_removed_words_equal_all_windows_compared(spark, options, window):
    texts = planted(window, window)
    rows = substring_dedup.remove_repeats(frame(spark, texts), window, **options).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == plain_removal(texts, window)


@pytest.mark.parametrize("max_bytes", [0, 64 << 20])
def test_substring_dedup_of_real_texts_nulls_and_repeated_rows(spark, max_bytes):
    texts = real_texts(spark)
    rows = substring_dedup.remove_repeats(frame(spark, texts), 35, max_bytes).orderBy("doc_id").collect()
    expected = plain_removal(texts, 35)
    assert [tuple(r)[1:] for r in rows] == expected and sum(x[1] for x in expected) > 1000
    long = " ".join(f"w{i}" for i in range(60))
    same = spark.createDataFrame([(None, long), (None, long), (1, long), (1, long), (1, "short"), (2, None)], DOCS)
    got = sorted(tuple(r)[1:] for r in substring_dedup.remove_repeats(same, 35, max_bytes).collect())
    assert got == [(0, 0, ""), (1, 0, "short")] + [(60, 60, "")] * 4
    assert substring_dedup.remove_repeats(same.limit(0), 35, max_bytes).count() == 0


def test_a_text_of_megabytes(spark):
    body = " ".join(f"v{i % 70001}" for i in range(200_000))  # 1.3 MB; the last 60 thousand words stand there twice
    ((n_words, n_removed, text),) = [tuple(r)[1:] for r in substring_dedup.remove_repeats(frame(spark, [body]), 35, 0).collect()]
    assert (n_words, n_removed, text) == plain_removal([body], 35)[0] and n_removed > 190_000
    row = alignment.align_tokens(frame(spark, [body]), BYTES, UNITS).first()
    x = plain_alignment([body])[0]
    assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (len(x[0]), len(x[1]), len(x[2]), len(x[3]))


def test_queries_carry_digests(spark):
    path = "/root/testdata/sf0.001"
    texts = real_texts(spark)
    rows = QUERIES["op13_substring_dedup"](spark, path).orderBy("doc_id").collect()
    assert [r["kept_sha256"] for r in rows] == [hashlib.sha256(x[2].encode()).hexdigest() for x in plain_removal(texts, 35)]
    for row, x in zip(QUERIES["op11_token_alignment"](spark, path).orderBy("doc_id").limit(20).collect(), plain_alignment(texts[:20])):
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in x[2])
        assert row["groups_sha256"] == hashlib.sha256(said.encode()).hexdigest()

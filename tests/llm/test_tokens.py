"""Token operators against the tokenizer libraries and brute force, with awkward rows and strings made to collide."""

import bisect
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from structpeak.llm import alignment, boilerplate, byte_pairs, hyperminhash, pieces, resampling
from structpeak.llm.textbuf import span_keys, words

SF = "/root/testdata/sf0.001"
BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, keys string, block string, pair string, score string, _at string, rank string, _digit string"


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


ODD, EVEN = thue_morse(2048), thue_morse(2048, "b", "a")
LONG = " ".join(f"word{i % 997} item{i}, thing" for i in range(30000))
ROWS = [
    (1, None), (2, ""), (3, " "), (4, " \n\t  "), (5, "one"), (6, "one "), (7, "  one  two "), (8, "a▁b ▁ c"), (9, "it's <|endoftext|> <s> </s> <0x41> é漢字😀́ \x00 ﬁ Ａ"), (10, LONG), (11, "漢" * 3000),
    (12, f"{ODD} {EVEN}"), (13, f"{EVEN} {ODD}"), (14, "The end.\r\n\r\n　Next one "), (15, "x" * 5000), (15, "The same key"), (None, "no key here"), (None, None), (16, "The same key"), (17, "The cat sat on the mat and the cat sat. " * 30),
]



@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *"abcdefgh") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_strings_that_collide_modulo_a_power_of_two(spark):
    """Equal polynomial hashes modulo 2**64 don't make different strings equal."""
    tokenizer = Tokenizer.from_file(BPE)
    rows = [(1, ODD), (2, EVEN), (3, f"{ODD} {EVEN} {ODD}"), (4, f"{EVEN}\n{ODD}\n{ODD}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for r in byte_pairs.encode_documents(frame, BPE).collect():
        assert r["ids"] == tokenizer.encode(dict(rows)[r["doc_id"]]).ids and r["decoded"] == dict(rows)[r["doc_id"]]
    data = np.frombuffer(f"{ODD} {EVEN} {ODD}".encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]))
    assert len(set(span_keys(data, start, end).tolist())) == 2
    counts, *_ = boilerplate.analyse(np.frombuffer(f"{EVEN}\n{ODD}\n{ODD}".encode(), np.uint8), np.array([0, 3 * 2048 + 2]))
    assert counts["n_dup_lines"].tolist() == [1]
    text = " ".join([ODD, EVEN, *"abcdef"])
    hashed, cut = hyperminhash.shingle_sets(np.frombuffer((text + text.replace(ODD, EVEN)).encode(), np.uint8), np.array([0, len(text), 2 * len(text)]))
    assert set(hashed[:cut[1]]) != set(hashed[cut[1]:]) and cut[1] == 4


def test_pieces_equal_the_library(docs, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert pieces.piece_encoder(MODEL).cuts
    want = collections.Counter((i, tuple(model.encode(t or "")), model.decode(model.encode(t or ""))) for i, t in ROWS)
    coded = pieces.encode_documents(docs, MODEL)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in coded.collect()) == want
    again = pieces.decode_documents(coded, MODEL)
    assert collections.Counter((r["doc_id"], r["decoded"]) for r in again.collect()) == collections.Counter((i, d) for (i, _, d), n in want.items() for _ in range(n))
    assert pieces.encode_documents(empty, MODEL).count() == 0


def test_pieces_of_real_texts_and_a_small_table(spark, monkeypatch):
    """A table that starts anew and one that can't cut give the same ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    want = model.encode(texts)
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 50)
    for whole in (False, True):
        coder = pieces.PieceEncoder(MODEL)
        coder.cuts = not whole
        for t, ids in zip(texts, want, strict=True):
            slot, cut = coder.slots([t, "", t])
            got, own = coder.ids_of(slot, cut)
            assert got.tolist() == ids + ids and own.tolist() == [0, len(ids), len(ids), 2 * len(ids)]
            assert coder.texts_of(slot, cut) == [model.decode(ids), "", model.decode(ids)]


def brute_alignment(rows):
    a_coder, model = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_coder.encode_special_tokens = True
    letters = byte_pairs._byte_letters()
    docs, count = [], collections.Counter()
    for i, t in rows:
        a = a_coder.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        a_bytes = [bytes(letters[c] for c in a_coder.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(model.id_to_piece, b)]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            docs.append((i, [], [], [], ""))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links = []
        for k in range(len(a)):
            for j in range(bisect.bisect_right(b_end, a_end[k] - len(a_bytes[k])), len(b)):
                if b_end[j] - len(b_bytes[j]) >= a_end[k]:
                    break
                links.append((a[k], b[j]))
        common = sorted({*a_end} & {*b_end})
        text, x, y = [], 0, 0
        for e in common:
            u, v = a_end.index(e, x) + 1, b_end.index(e, y) + 1
            text.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
            x, y = u, v
        count.update(links)
        docs.append((i, a, b, links, ";".join(text)))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (i, len(a), len(b), text.count("|"), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "")
        for i, a, b, links, text in docs
    ]


def test_alignment_equals_brute_force(spark, empty):
    short = [(i, t) for i, t in ROWS if t != LONG] + [(30, " ".join(LONG.split(" ")[:2000]))]
    real = [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    frame = spark.createDataFrame([(i, t, *"abcdefgh") for i, t in short + real], SCHEMA).repartition(4)
    out = alignment.align(frame, BPE, MODEL)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(brute_alignment(short + real))
    assert alignment.align(empty, BPE, MODEL).count() == 0
    assert {r["n_a"] for r in alignment.align(frame.where("text is null or text = ''"), BPE, MODEL).collect()} == {0}


def test_token_groups_are_the_groups_of_the_digest(docs):
    rows = alignment.token_groups(docs, BPE, MODEL).collect()
    want = {(i, s) for i, *_, s in brute_alignment(ROWS)}
    got = set()
    for r in rows:
        cut_a, cut_b = [0, *r["group_a"]], [0, *r["group_b"]]
        assert cut_a[-1] == len(r["a_ids"]) and cut_b[-1] == len(r["b_ids"])
        text = ";".join(
            ",".join(map(str, r["a_ids"][a:b])) + "|" + ",".join(map(str, r["b_ids"][c:d])) for a, b, c, d in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], strict=False)
        )
        got.add((r["doc_id"], hashlib.sha256(text.encode()).hexdigest() if text else ""))
    assert got == want


def test_galloping_finds_every_rank():
    draw = np.random.default_rng(5)
    for _ in range(200):
        values = np.unique(draw.integers(0, 400, draw.integers(1, 200)))
        wanted = np.sort(draw.integers(0, values[-1] + 1, draw.integers(1, 90)))
        start = np.minimum(np.searchsorted(values, wanted), draw.integers(0, len(values), len(wanted)))
        assert (alignment.first_not_below(wanted, start, values, np.full(len(wanted), len(values))) == np.searchsorted(values, wanted)).all()


def brute_resample(docs, target, percent, longest=1, buckets=10000, seed=2024, least=20):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [" ".join(w[k:k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    rows = []
    for i, x in docs:
        n, own = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[:len(order) * percent // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize(("longest", "bits", "chunk"), [(1, 12, 18), (2, 5, 3)])
def test_resampling_equals_brute_force(spark, empty, longest, bits, chunk):
    """Also with several chunks and many passes; equal rows share a score and get neighbouring ranks."""
    real = [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    rows = ROWS + real + [(-5, LONG), (7777, "same " * 30), (7777, "same " * 30)]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    frame = spark.createDataFrame([(i, t, *"abcdefgh") for i, t in rows], SCHEMA).repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(frame, goal, 60, longest=longest, digit_bits=bits, chunk_bits=chunk)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, out.collect())) == brute_resample(rows, target, 60, longest)
    assert resampling.resample(empty, goal).count() == 0
    assert resampling.resample(frame, goal.where("text = 'none'"), 60, longest=longest).where("rank is not null").count() > 0


def test_radix_order_is_stable_and_unsigned(spark):
    rows = [(int(x), k) for k, x in enumerate(np.random.default_rng(3).integers(0, 50, 400) - 25)]
    frame = spark.createDataFrame(rows, "k long, n long").coalesce(1)
    got = [(r["k"], r["n"]) for r in resampling.radix_order(frame, ["k"], 4, 4).orderBy("_at").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] % (1 << 64), r[1]))
    same = resampling.radix_order(frame.select(F.lit(7).cast("long").alias("k"), "n"), ["k"], 4, 4)
    assert sorted(r["_at"] for r in same.collect()) == list(range(400))


def test_bucket_counts_cover_all_rows(docs):
    assert resampling.bucket_counts(docs, 16).sum() == sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for _, t in ROWS)


def test_blocks_with_one_long_document():
    """The block size doesn't change what is found."""
    both = alignment.aligner(BPE, MODEL)
    parts = [(t or "").encode() for _, t in ROWS if t != LONG] + [LONG[:20000].encode()]
    data = np.frombuffer(b"".join(parts), np.uint8)
    borders = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    whole = both.align(data, borders)
    for k in range(len(parts)):
        one = both.align(data[borders[k]:borders[k + 1]], np.array([0, len(parts[k])]))
        assert np.array_equal(one.a_ids, whole.a_ids[whole.a_cut[k]:whole.a_cut[k + 1]])
        assert len(one.link_a) == whole.link_cut[k + 1] - whole.link_cut[k] and len(one.group_a) == whole.group_cut[k + 1] - whole.group_cut[k]

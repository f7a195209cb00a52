"""Token operators against the tokenizers library itself."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from common import awkward_documents, empty_documents
from tokenizers import Tokenizer

from sourceloom.llm import packing, queries, token_codec, token_counts, token_files
from sourceloom.llm.tokens import default_path

FOLDER = "/root/testdata/sf0.001"
WORD, BYTE = (Tokenizer.from_file(default_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def le(ids):
    return np.array(ids, dtype="<u4").tobytes()


def encode(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def order(row):
    return (row["doc_id"] is not None, row["doc_id"] or 0)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_files_query(spark):
    rows = sorted(documents(spark).collect(), key=order)
    want, start = [], 0
    for r in rows:
        ids = encode(WORD, r["text"]) + [1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(le(ids))))
        start += len(ids)
    same(queries.op2_token_files(spark, FOLDER).collect(), want)


@pytest.mark.parametrize("segment_tokens", [1, 40, 10**6])
def test_files_awkward(spark, tmp_path, segment_tokens):
    docs = awkward_documents(spark)
    token_files.write(docs, str(tmp_path / "set"), segment_tokens=segment_tokens)
    got = sorted(token_files.read(spark, str(tmp_path / "set")).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    assert [order(r) for r in got] == sorted(order(r) for r in got)
    same([(r["doc_id"], bytes(r["ids"])) for r in got], [(r["doc_id"], le(encode(WORD, r["text"]) + [1])) for r in docs.collect()])


def test_files_empty(spark, tmp_path):
    token_files.write(empty_documents(spark), str(tmp_path / "set"))
    assert token_files.read(spark, str(tmp_path / "set")).count() == 0


def test_pack_wide_ranks():
    ids = np.random.default_rng(0).integers(0, 2**32, 70_000, dtype=np.uint32)
    ids[:50_000] = 7
    assert (token_files.unpack(len(ids), *token_files.pack(ids)) == ids).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec(spark, name):
    tokenizer = Tokenizer.from_file(default_path(name))
    for docs in (documents(spark), awkward_documents(spark)):
        want = [(r["doc_id"], le(encode(tokenizer, r["text"])), tokenizer.decode(encode(tokenizer, r["text"]), skip_special_tokens=False))
                for r in docs.collect()]
        got = token_codec.encode_decode(docs, path=default_path(name)).collect()
        same([(r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got], want)
    assert token_codec.encode_decode(empty_documents(spark)).count() == 0


def test_every_vocabulary_entry_is_its_own_encoding():
    codec = token_codec.PrefixCodec(default_path("word_bpe_49k.json"))
    wrong = 0
    for name, i in list(WORD.get_vocab().items())[::7]:
        if i in codec.special.values() or not name.endswith("</w>") or name == "</w>":
            continue
        units, body = codec._units(name), [t.id for t in WORD.model.tokenize(name[:-4])]
        raw = bytes(codec.bytes_of[c] for c in name[:-4])
        try:
            wrong += codec._part(raw.decode()) != le(body)
        except UnicodeDecodeError:
            continue
        assert units
    assert wrong == 0


def test_codec_query(spark):
    want = []
    for r in documents(spark).collect():
        ids = encode(WORD, r["text"])
        text = WORD.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(queries.op3_bpe_codec(spark, FOLDER).collect(), want)


def test_counts(spark):
    for docs in (documents(spark), awkward_documents(spark)):
        want = [(r["doc_id"], len((r["text"] or "").encode()), len(n := encode(BYTE, r["text"])), len(n) > 1024) for r in docs.collect()]
        same(token_counts.count_tokens(docs, keep=50).collect(), want)
    assert token_counts.count_tokens(empty_documents(spark)).count() == 0
    assert queries.op4_token_counts(spark, FOLDER).count() == 200


def check_packing(rows, docs, size=1024):
    """Every token once and in order, sequences gapless and within size."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    want = Counter()
    for doc_id, text in docs:
        ids, start = encode(BYTE, text) + [2], 0
        for piece, n in enumerate(packing.cut_lengths(len(ids), size)):
            want[doc_id, piece, start, n, zlib.crc32(le(ids[start:start + n]))] += 1
            start += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(by_sequence)


def best_fit_decreasing(lengths, size=1024):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(size - n)
    return len(gaps)


def test_packing_query(spark):
    rows = queries.op9_best_fit_packing(spark, FOLDER).collect()
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in documents(spark).collect()])
    assert n <= 1.01 * best_fit_decreasing([r["length"] for r in rows]) + 1


def test_packing_awkward(spark):
    docs = awkward_documents(spark)
    for size in (8, 1024):
        check_packing(packing.pack(docs, size=size).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], size)
    assert packing.pack(empty_documents(spark)).count() == 0


def test_packing_many_buckets(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "CAST(IF(id % 3 = 0, 500, id % 1024 + 1) AS long) AS length")
    rows = packing.place(pieces, bucket_rows=100).collect()
    seen = defaultdict(list)
    for r in rows:
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(rows) == 3000
    for places in seen.values():
        ends = [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert [o for o, _ in sorted(places)] == ends and sum(n for _, n in places) <= 1024


@pytest.mark.parametrize("lengths", [[1] * 5, [1024] * 3, [600] * 7, list(range(1, 1025)), [513, 511] * 20 + [3, 5, 7]])
def test_plans(lengths):
    plan = packing.best_plan(Counter(lengths))
    assert plan.sequences <= best_fit_decreasing(lengths) * 1.02 + 1
    assert sum(b - a for _, a, b, *_ in plan.rows) == len(lengths)

"""Token files and packing: exact round trips and bounds."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import packing, queries, token_files, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path, pieces", [(BYTE, tokens.BYTE_PIECES), (WORD, tokens.WORD_PIECES)])
def test_pieces_give_the_ids_of_whole_texts(path, pieces, real_docs, edge_docs, monkeypatch):
    rnd = random.Random(6)
    texts = [r["text"] or "" for r in real_docs.limit(60).union(edge_docs).collect()]
    texts += ["".join(rnd.choice(" \t\n\r\x0b\x1c\x85\xa0 ab1!'<é́日sS.,") for _ in range(rnd.randrange(40))) for _ in range(4000)]
    texts += ["<|endoftext|> a <|endoftext|>b", "don't  we'll 'tis", "a.. ,b, c.", "x\0y ", "İ ſ ΣΑΣ. Σας,", "3.14,15 ", " .5", "a ,b"]
    whole = Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "GENERATION", 500)
    monkeypatch.setattr(tokens, "BYTE_GENERATION", 500)
    encoder = tokens.Encoder(path, pieces)
    for text in texts:
        assert encoder.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.encode(None).tolist() == []


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packed_ids_come_back(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    raw = token_files.pack(ids, width)
    assert len(raw) == -(-1000 * width // 8)
    assert token_files.unpack(raw, 1000, width).tolist() == ids.tolist()


@pytest.mark.parametrize("width", [13, 16])
def test_files_give_random_access(width, tmp_path):
    rng = np.random.default_rng(1)
    docs = [(None if i == 0 else i, rng.integers(0, 1 << width, n).astype(np.uint32)) for i, n in enumerate([5, 0, 4096, 20000, 1, 0])]
    writer = token_files.FileWriter(width)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    path = tmp_path / "x.qtid"
    path.write_bytes(b"".join(writer.parts()))
    reader = token_files.open_file(str(path))
    flat = np.concatenate([ids for _, ids in docs])
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2))
        assert reader.read(int(a), int(b)).tolist() == flat[a:b].tolist()
    assert reader.no_id.tolist() == [d is None for d, _ in docs]
    with pytest.raises(ValueError):
        writer.add(9, np.array([1 << width], np.uint32))


def test_token_files_hold_every_document_in_order(spark, sf_dir, real_docs, edge_docs, no_docs):
    whole = Tokenizer.from_file(BYTE)
    start = 0
    made = {r["doc_id"]: r for r in queries.op8_token_files(spark, sf_dir).collect()}
    for r in sorted(real_docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        got = made[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    manifest = token_files.write_token_files(edge_docs, BYTE, file_ids=1000)
    rows = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in edge_docs.collect()), key=lambda i: -1 if i is None else i)
    assert len(manifest) > 1 and sum(m["ids"] for m in manifest) == sum(len(r["ids"]) // 4 for r in rows)
    assert token_files.write_token_files(no_docs, BYTE) == []
    assert token_files.read_digests(spark, []).count() == 0


def best_packing(lengths, capacity):
    """The least number of bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += lengths[i]
                go(i + 1, bins)
                bins[j] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def laid_out(plan, lengths):
    bins, seen = {}, set()
    for length, lo, hi, first, each, offset in plan.runs:
        for rank in range(lo, hi):
            assert (length, rank) not in seen
            seen.add((length, rank))
            bins.setdefault(first + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
    assert len(seen) == len(lengths) and sorted(bins) == list(range(plan.bins))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= plan.capacity
    return bins


def test_plans_are_gapless_and_reductions_keep_the_optimum():
    rnd = random.Random(7)
    for trial in range(300):
        capacity = rnd.choice([10, 20, 37])
        lengths = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 11))]
        histogram = {x: lengths.count(x) for x in lengths}
        plan = packing.Plan(histogram, capacity)
        bins = laid_out(plan, lengths)
        optimum = best_packing(lengths, capacity)
        assert plan.bins <= optimum + 1
        left = list(lengths)
        for b in range(plan.fixed_bins):
            for _, length in bins[b]:
                left.remove(length)
        assert plan.fixed_bins + (best_packing(left, capacity) if left else 0) == optimum, (capacity, lengths)


def test_plans_of_many_pieces_are_near_the_bound():
    rnd = random.Random(8)
    lengths = [min(4096, max(1, int(rnd.lognormvariate(6.2, 1)))) for _ in range(50000)]
    plan = packing.Plan({x: lengths.count(x) for x in set(lengths)}, 4096)
    laid_out(plan, lengths)
    assert plan.bins <= -(-sum(lengths) // 4096) * 1.002 + 1
    with pytest.raises(ValueError):
        packing.Plan({5: 1}, 4)


def test_packing_query_holds_every_piece(spark, sf_dir, real_docs):
    whole = Tokenizer.from_file(WORD)
    rows = queries.op9_packing(spark, sf_dir).collect()
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(got) == len(rows)
    n = total = 0
    for d in real_docs.collect():
        ids = np.array([*whole.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            r, part = got[d["doc_id"], piece], ids[start : start + 4096]
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, len(part), zlib.crc32(part.tobytes()))
            n, total = n + 1, total + len(part)
    assert n == len(rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and len(ends) <= -(-total // 4096) + 2


def test_packed_sequences_hold_the_ids(edge_docs, no_docs):
    packed = packing.pack_documents(edge_docs, WORD, with_ids=True)
    pieces = {(r["sequence_id"], r["offset"]): r["ids"] for r in packed.collect()}
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert sum(map(len, made.values())) == sum(map(len, pieces.values()))
    for (sequence, offset), ids in pieces.items():
        assert made[sequence][4 * offset : 4 * offset + len(ids)] == ids
    assert packed.groupBy("doc_id").count().count() == edge_docs.select("doc_id").distinct().count()
    assert packing.pack_documents(no_docs, WORD).count() == 0
    assert packed.where(F.col("doc_id").isNull()).count() >= 1

"""Token ids, packing and token files: against the tokenizer itself, and as exact round trips."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanweave.llm.catalog import byte_bpe

ODD = ["", "  ", "\n", "a b  c", "x “quoted” y", "tab\t\ttab \n\n end  ", "it's he'll '.,", "a<|endoftext|> b <|endoftext|>", "\x1c x \x1f",
       "日本語 テスト。 終わり", "emoji 😀 😀x", "word.. a, b! c?. é.", "  leading", "trailing  ", "\r\n mixed \x0b\x0c v", "1,000.5 3. x2. ²,",
       "no break\x85line para", "end.$$$ more&&& (x) [y] \"z\""]


def reference(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(byte_bpe())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def texts(n=300, seed=2):
    rng = random.Random(seed)
    al = list("ab A,.!?'’ \n\t é日1²-_<|>") + [" "] * 6
    out = ["".join(rng.choice(al) for _ in range(rng.randrange(60))) for _ in range(n)] + ODD + [None]
    return out + [" ".join(f"word{rng.randrange(500)}" for _ in range(3000))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    from tokenizers import Tokenizer

    from spanweave.llm._tokens import PieceEncoder
    enc = PieceEncoder(byte_bpe(name))
    assert enc.by_piece == (name == "byte_bpe_50k.json")
    rows = texts(4000 if enc.by_piece else 50)
    want = [e.ids for e in Tokenizer.from_file(byte_bpe(name)).encode_batch([x or "" for x in rows], add_special_tokens=False)]
    for part in (rows, rows[::-1]):
        ids, at = enc.encode(pa.array(part, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == (want if part is rows else want[::-1])


def test_table_starts_again_when_half_full(monkeypatch):
    from spanweave.llm import _tokens
    monkeypatch.setattr(_tokens, "TABLE_BITS", 12)
    enc = _tokens.PieceEncoder(byte_bpe())
    rng = random.Random(1)
    for _ in range(12):
        rows = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(10)]
        ids, at = enc.encode(pa.array(rows))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == reference(rows)


def check_packing(rows, docs, capacity, end):
    seqs, by_doc = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault((r["doc_id"],), []).append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    want = []
    for (d, _), ids in zip(docs, reference([t for _, t in docs])):
        ids = [*ids, end]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    return len(seqs)


def test_packing_keeps_every_piece_and_fills_well(spark):
    from spanweave.llm.packing import pack_documents
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts())] + [(3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, length int, _rank string")
    for capacity in (64, 2048):
        rows = pack_documents(df, byte_bpe(), capacity=capacity, end_id=0).collect()
        used = check_packing(rows, docs, capacity, 0)
        assert used <= 1.01 * sum(r["length"] for r in rows) / capacity + 1
    assert pack_documents(df.limit(0), byte_bpe()).count() == 0


def test_plan_places_every_piece_once_and_beats_greedy():
    from spanweave.llm.packing import plan_bins
    rng = random.Random(3)
    for trial in range(30):
        capacity = rng.choice([10, 64, 300])
        counts = {x: rng.choice([1, 2, 7, 1000]) for x in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity))}
        plan = plan_bins(counts, capacity)
        length = np.concatenate([np.full(n, x) for x, n in counts.items()])
        rank = np.concatenate([np.arange(n) for n in counts.values()])
        bins, offset = plan.place(length, rank)
        fill = np.bincount(bins, length, plan.bins)
        assert fill.max() <= capacity and (fill > 0).all()
        order = np.lexsort((offset, bins))
        new = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        run = np.cumsum(length[order]) - length[order]
        assert (offset[order] == run - np.maximum.accumulate(np.where(new, run, 0))).all()
        greedy = []  # first-fit decreasing
        for x in sorted(length.tolist(), reverse=True)[:4000]:
            i = next((i for i, g in enumerate(greedy) if g >= x), None)
            if i is None:
                greedy.append(capacity - x)
            else:
                greedy[i] -= x
        if len(length) <= 4000:
            assert plan.bins <= 1.02 * len(greedy) + 1
    assert plan_bins({}, 10).bins == 0


@pytest.mark.parametrize("block", [1, 7, 512])
def test_shards_round_trip(block):
    from spanweave.llm.pfor import Shard, encode_shard
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 2 ** rng.integers(1, 33), rng.integers(0, 900), dtype=np.uint64).astype("<u4") for _ in range(60)]
    docs += [np.full(2000, 7, "<u4"), np.array([0, 2**32 - 1] * 300, "<u4"), np.zeros(0, "<u4")]
    ids = [None, *range(len(docs) - 1)]
    shard = Shard(encode_shard(ids, [d.tobytes() for d in docs], block=block))
    flat = np.concatenate(docs)
    got = list(shard.documents())
    assert [g[0] for g in got] == ids and all((g[2] == d).all() and len(g[2]) == len(d) for g, d in zip(got, docs))
    some = shard.blocks // 2
    assert (shard.read(some, some + 1) == flat[some * block:(some + 1) * block]).all()
    assert list(Shard(encode_shard([], [])).documents()) == []


def test_token_files_round_trip(spark):
    from spanweave.llm.pfor import read_ids, write_ids
    docs = [(1000 - i, t) for i, t in enumerate(texts())] + [(None, "none"), (5, "b"), (5, "a")]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, start int")
    rows = read_ids(write_ids(df, byte_bpe(), shard_ids=2000), with_ids=True).collect()
    at = 0
    for (d, t), r in zip(sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), sorted(rows, key=lambda r: r["start"])):
        ids = np.array([*reference([t])[0], 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (d, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    assert len(rows) == len(docs)
    assert read_ids(write_ids(df.limit(0), byte_bpe())).count() == 0

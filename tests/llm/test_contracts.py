"""Digest columns of op1, op2 and op3 against plain Python over whole tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from mizan.llm import fingerprint, sharding, tokens
from mizan.llm.common import read
from tests.compare import SF_DIR

PATH = public_tokenizers.path("word_bpe_49k.json")


def differing(texts):
    ids, at = tokens.encoder(PATH).encode(pa.array(texts, pa.string()), 2)
    whole = Tokenizer.from_file(PATH).encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)
    return [t for i, (t, x) in enumerate(zip(texts, whole, strict=True)) if ids[at[i] : at[i + 1]].tolist() != [*x.ids, 2]]


def test_encoder_equals_whole_texts():
    assert differing(pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()) == []


def test_encoder_on_odd_texts():
    rng = random.Random(1)
    parts = [*"abAB'’.,!_-#9é×÷ÉßñÿŸİıΣσς日\x01̸́=  \n\t<|>s", "<|endoftext|>", "'re", " ", " ", "\u0085", "ﬁ", "Å"]
    assert differing(["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(20_000)] + [None, "", "x" * 30_000]) == []


def test_shards(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF_DIR, "documents").select("doc_id", "text").collect()}
    got = sharding.op2(spark, SF_DIR).collect()
    slots, load, home = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        home[r.virtual_slot].add(r.shard)
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(len(x) == 1 for x in home.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(load) == set(range(16))
    assert max(load.values()) - min(load.values()) <= max(len((t or "").encode()) + 1 for t in docs.values())


def test_rebalancing_moves_what_it_must(spark):
    docs = read(spark, SF_DIR, "documents").select("doc_id", "text")
    sizes = sharding.slot_bytes(sharding.with_slots(docs))
    first = sharding.rebalance(sharding.first_map(spark, 4), sizes, 4)
    again = sharding.rebalance(first, sizes, 5)
    a, b = ({r.virtual_slot: r.shard for r in t.collect()} for t in (first, again))
    n = {r.virtual_slot: r["bytes"] for r in sizes.collect()}
    load = defaultdict(int)
    for slot, shard in b.items():
        load[shard] += n.get(slot, 0)
    assert a.keys() == b.keys() and set(b.values()) == set(range(5)) and max(load.values()) - min(load.values()) <= max(n.values())


def test_fingerprints(spark):
    docs = sorted((r.doc_id, r.text or "") for r in read(spark, SF_DIR, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprint.op3(spark, SF_DIR).collect()}
    same = defaultdict(set)
    for k, (doc_id, text) in enumerate(docs):
        r, other = got[doc_id], docs[(k + 1) % len(docs)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + other[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same[text].add(r.fingerprint)
        if edited == text:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.95 * len(docs)

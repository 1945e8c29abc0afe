import zlib
from collections import defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tessella.llm.packing import Packer, encoder_of, pack, word_encoder
from tessella.llm.token_count import MergeCounter, count_tokens
from tests.llm.common import empty, frame, odd, sentence

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "a", " ", "  ", "\n\n  x\t y", "Hello, World! it's we'll I'D", sentence(3, 500), "naïve café ÀÉÎ é Σίσυφος ΟΔΟΣ", "日本語 テスト 한국어", "\U0001f600\U0001f468‍\U0001f469 x", "1234567 12.5e-3",
    "a\x1cb\x1fc\x85d\xa0e f", "x" * 3000, "<|endoftext|> and <|startoftext|>a<|endoftext|>", "tab\there\r\nline", "__init__(self): return 'x'", "ab" * 2000 + " " + "é" * 500, "don't DON'T ʼn",
]


def test_counts_against_library():
    library = tokenizers.Tokenizer.from_file(BYTES)
    import json

    with open(BYTES, encoding="utf-8") as f:
        counter = MergeCounter(json.load(f))
    for t in TEXTS:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t[:50]


def test_count_query(spark):
    out = {(r["doc_id"], r["n_bytes"]): r for r in count_tokens(odd(spark), BYTES).collect()}
    library = tokenizers.Tokenizer.from_file(BYTES)
    for r in odd(spark).select("doc_id", "text").collect():
        t = r["text"] or ""
        got, n = out[r["doc_id"], len(t.encode())], len(library.encode(t, add_special_tokens=False).ids)
        assert (got["n_tokens"], got["over_limit"]) == (n, n > 512)
    assert count_tokens(odd(spark), BYTES).count() == 12 and count_tokens(empty(spark), BYTES).collect() == []


def test_word_ids_against_library():
    library = tokenizers.Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        ids = encoder_of(f.read()).ids
    for t in TEXTS:
        assert ids(t) == b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids), t[:50]


def held(out: list, texts: dict[int, str]) -> int:
    """Checks pieces and sequences; the padding."""
    library = tokenizers.Tokenizer.from_file(WORDS)
    by, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert by.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(by[doc], key=lambda r: r["start"]):
            data = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]])
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(data)
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return 2048 * len(sequences) - sum(r["length"] for r in out)


def test_pack_round_trip(spark):
    texts = [*TEXTS, None, *(sentence(i, 1 + i * 37 % 900) for i in range(150)), sentence(7, 20_000)]
    out = pack(frame(spark, texts).repartition(5), word_encoder(WORDS, spark)).collect()
    assert held(out, {i: t or "" for i, t in enumerate(texts)}) < 2048


def test_packer_keeps_bounded_windows():
    p, full = Packer(16, 3), []
    for d in range(500):
        full += p.add(d, bytes(4 * (d * 7 % 13 + 1)))
        assert len(p.open) <= 3
    assert all(sum(len(x[2]) // 4 for x in w) == 16 for w in full)
    rest = list(p.merged())
    assert sum(not done for done, _ in rest) <= 1 and not p.open


def test_pack_odd_and_empty(spark):
    out = pack(odd(spark), word_encoder(WORDS, spark)).collect()
    assert sum(r["start"] == 0 for r in out) == 12 and pack(empty(spark), word_encoder(WORDS, spark)).collect() == []

import hashlib
import struct

import public_tokenizers as P
import tiktoken
from docquery.llm import byte_bpe as b

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_equals_tiktoken_and_round_trips(docs, corpus):
    tokens = b.read_ranks(PATH)
    coder = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = []
    for r in corpus:
        ids = coder.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    got = b.encode_documents(docs, PATH, P.PATTERN, keep_ids=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_odd_texts():
    tokens = b.read_ranks(PATH)
    mine = b.ByteBpe(tokens, b.serialise_model(tokens), P.PATTERN)
    theirs = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for text in ["a  ", "a  \nb", "a \nb", "\n\n b", " ", "a\u00a0 b", "a \u3000", "<unk> <s>", "▁▁ x", "\x00\x01", "日本語 عربى", "aaaa" * 900, "don't 12 3", "\U0001f600" * 9]:
        ids = mine.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()


def test_bytes_map_one_to_one():
    assert len(set(b.byte_characters())) == 256


def test_empty_table(no_docs):
    assert b.encode_documents(no_docs, PATH, P.PATTERN).collect() == []


def test_random_texts_and_another_pattern(monkeypatch):
    """White space of all kinds, small pieces and a small memory; other patterns are applied to whole texts."""
    import random

    rng = random.Random(1)
    tokens = b.read_ranks(PATH)
    model = b.serialise_model(tokens)
    texts = ["".join(rng.choice(" \n\tab1.,'s \x1cé日²‖") for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += ["ab" * 200 + "  " + "日" * 100 + " x", "word, word. word!! don't (word) word's"] * 3
    monkeypatch.setattr(b, "AT_ONCE", 50)
    monkeypatch.setattr(b, "REMEMBERED", 500)
    monkeypatch.setattr(b, "MERGED_AT_ONCE", 7)
    for pattern in (P.PATTERN, r"\p{N}{1,2}|\s?\p{L}+|\s+|[^\s\p{L}\p{N}]+", r"[^ ]+ ?| "):
        theirs = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        for text, ids in zip(texts, b.ByteBpe(tokens, model, pattern).encode_many(texts), strict=True):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == theirs.encode_ordinary(text), (pattern, text)

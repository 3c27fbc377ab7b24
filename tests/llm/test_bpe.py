import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from pathloom.llm.bpe import MergeReplay, encode_table
from tests.llm.rows import DOCS, documents

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def _library(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_encodes_as_the_library_does_and_decodes_back(name):
    mine, library, rnd = MergeReplay(open(P.path(name), "rb").read(), P.PATTERN), _library(name), random.Random(5)
    tokens = list(mine.vocab.values())
    texts = [b"".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 8))).decode("utf-8", "ignore") for _ in range(3000)]
    texts += ["".join(rnd.choice("aaab éñ☃😀\n\t 12'sll") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["", " ", "a" * 3000, "<|endoftext|>", "it's we'll I'M", *(t or "" for _, t in DOCS)]
    for t in texts:
        ids = mine.encode(t)
        assert ids == library.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()


def test_merges_of_several_splits_keep_the_order_of_ranks():
    # "bc" is merged before "ab", but the token "abc" (rank 261) also splits as "ab" + "c"
    ranks = {bytes([i]): i for i in range(256)} | {b"cd": 256, b"abc": 257, b"bc": 258, b"ab": 259, b"abab": 260}
    raw = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    mine, library, rnd = MergeReplay(raw, P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14)))
        assert mine.encode(t) == library.encode_ordinary(t), t


def test_table(spark, monkeypatch):
    library = _library(FILES[0])
    df = documents(spark)
    out = encode_table(df, P.path(FILES[0]), P.PATTERN, keep_ids=True)
    assert out.columns == [c for c in df.columns if c != "n_tokens"] + ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    rows = out.collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.token_ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert encode_table(df.limit(0), P.path(FILES[0]), P.PATTERN).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_many_pieces_at_once_under_odd_vocabularies(seed):
    rnd = random.Random(seed)
    tokens = {bytes([i]): i for i in range(256)}
    parts = [bytes([c]) for c in b"abcd"]
    more = []
    while len(more) < 40:  # parts of any age, so that many tokens have several splits and earlier ranks than their parts
        t = rnd.choice(parts) + rnd.choice(parts)
        if t not in tokens and t not in more and len(t) < 9:
            more.append(t)
            parts.append(t)
    rnd.shuffle(more)
    ranks = tokens | {t: 256 + k for k, t in enumerate(more)}
    raw = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    mine, library = MergeReplay(raw, P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    assert [list(x) for x in mine.replay([p.encode() for p in pieces])] == [library.encode_ordinary(p) for p in pieces]

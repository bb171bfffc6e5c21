import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

from millrace.llm.bpe import Encoder, encode_digests, stitch

from .fixtures import documents, no_documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_tiktoken(spark):
    docs = documents(spark, extra=["a <|endoftext|> b", "x" * 5000, " " * 3000, "\n \n" * 900 + "end", "tabs\t\x1c\x1f\x85  'll"])
    own = reference()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = own.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    for chunk, overlap in ((16_384, 512), (300, 40)):
        assert Counter(tuple(r) for r in encode_digests(docs, RANKS, chunk, overlap).collect()) == want
    assert encode_digests(no_documents(spark), RANKS).count() == 0


def test_stitching_random_texts():
    own, encoder, rnd = reference(), Encoder(RANKS), random.Random(1)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "bc", " ", "  ", "\n", "'", "'re", "'ll", "1", "23", ".", "é", "\t", "zz" * 30]) for _ in range(rnd.randint(1, 400)))
        step, overlap = rnd.choice([(20, 5), (50, 30), (7, 3), (100, 20)])
        chunks = []
        for s in range(0, len(text), step):
            part = text[s : s + step + overlap]
            chunks.append((s, part, *encoder.chunk(part)))
        assert stitch(chunks, encoder) == own.encode_ordinary(text)
        assert isinstance(chunks[0][2], np.ndarray)

"""What a worker remembers of texts without single spaces between short words, and that their ids are tiktoken's."""

import random
import sys

import public_tokenizers as P
import pytest
import tiktoken

from folioflow.llm import op01_bpe
from folioflow.llm.op01_bpe import Vocabulary, _lines, read_ranks


@pytest.fixture(scope="module")
def lines():
    return _lines(P.path("byte_bpe_50k.tiktoken"))


def remembered_bytes(v):
    return sum(sys.getsizeof(x) for d in (v.word, v.known, v.before) for x in d) + v.flat.nbytes + v.begins.nbytes


def test_spaces_of_all_kinds_equal_tiktoken(lines):
    rng, own = random.Random(6), Vocabulary(lines, P.PATTERN)
    right = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(lines), special_tokens={})
    texts = ["".join(rng.choice(["  ", " ", " ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "the", "B's", "7", "!?", "日本", "é", "'s"]) for _ in range(rng.randrange(60))) for _ in range(3_000)]
    for at in range(0, len(texts), 500):
        ids, ends = own.encode_texts(texts[at : at + 500])
        for k, text in enumerate(texts[at : at + 500]):
            assert ids[ends[k] : ends[k + 1]].tolist() == right.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("kind", ["double spaces", "no spaces", "long words"])
def test_remembered_bytes_do_not_grow_with_the_texts(lines, kind):
    rng, own = random.Random(7), Vocabulary(lines, P.PATTERN, remembered=20_000)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(2_000)]
    text = {
        "double spaces": lambda: "  ".join(rng.choice(vocabulary) for _ in range(1_000)),
        "no spaces": lambda: "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(2_000)),
        "long words": lambda: " ".join("".join(rng.choice("xyz.,") for _ in range(500)) for _ in range(10)),
    }[kind]
    # at most 20,000 words and, of pieces, a third of that now and before; short ones take some 100 bytes each
    for _ in range(25):
        own.encode_texts([text() for _ in range(20)])
        assert remembered_bytes(own) < 3_500_000
    assert not any(len(x) > op01_bpe.SHORT + 1 for d in (own.word, own.known, own.before) for x in d)

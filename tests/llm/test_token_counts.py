import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lavka.llm.caches import GenerationCache
from lavka.llm.token_counts import Counter, token_counts

SF = "/root/testdata/sf0.001"
LETTERS = [*"ab c\n\t ,.!?'\"-_éß²½٣日本😀<>0\x00​\x1c\x85 　ΣσςİIıÅÅﬁǅ", "  ", "the ", "ing", "<|endoftext|>", "<|startoftext|>",
           "   ", "'s", "'LL", "'Re"]


def spec(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_as_the_library(name):
    counter, library = Counter(spec(name), cache_size=500), Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(5)
    texts = ["", " ", "a" * 5000, "ab" * 300, "été" * 500, "\n" * 50] + [
        "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert counter.count(text) == len(expected.ids), text


def test_merges_one_by_one():
    """The count of a word against plain merging of the best pair of the whole list."""
    counter = Counter(spec("word_bpe_49k.json"))
    rng = random.Random(6)
    for _ in range(500):
        word = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 40)))
        parts = [*map(counter.inside.__getitem__, word[:-1].encode()), counter.last[ord(word[-1])]]
        while True:
            ranked = [(counter.ranks[a * counter.base + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                      if a * counter.base + b in counter.ranks]
            if not ranked:
                break
            rank, i = min(ranked)
            parts[i:i + 2] = [counter.merged[rank]]
        assert counter.count_word(word) == len(parts)


def test_cache_is_bounded_and_right():
    cache = GenerationCache(len, size=10, longest=5)
    for i in range(1000):
        assert cache[str(i % 37) * (1 + i % 3)] == len(str(i % 37) * (1 + i % 3))
        assert len(cache) <= 10 and len(cache.old) <= 10
    assert cache["x" * 100] == 100 and "x" * 100 not in cache


def test_on_a_table(awkward, empty):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = token_counts(awkward, spec("word_bpe_49k.json")).collect()
    expected = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 2048)
                for r in awkward.collect()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert token_counts(empty, spec("word_bpe_49k.json")).collect() == []


def test_query_against_the_library(spark, tables):
    from lavka.llm.queries import op10_token_counts
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op10_token_counts(spark, SF).collect()}
    for doc_id, text in tables.execute("select doc_id, text from documents").fetchall():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert found.pop(doc_id) == (len((text or "").encode()), n, n > 2048)
    assert not found

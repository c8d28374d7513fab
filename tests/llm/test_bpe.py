import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexirank.llm.bpe import Vocabulary, bpe_decode, bpe_encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    pool = "ab cdeé\n\t\r\x0b\x0c\x1c\x85\xa0　'st!?.,0123²½日本кирил😀́ß're​\x00"
    yield from ("", " ", "a" * 500, "<|endoftext|>", "x<|endoftext|> y", "  lead", "don't we'll", "=" * 99, "ab" * 200_0)
    for _ in range(1500):
        yield "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
    for _ in range(1500):
        yield "".join(rng.choice("aeiou thes nr") for _ in range(rng.randint(0, 60)))


def test_same_as_the_library(vocab, library):
    some = list(texts())
    tokens, counts = vocab.encode(some)
    at = 0
    for text, n in zip(some, counts, strict=True):
        assert tokens[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        at += n
    assert vocab.decode(tokens, counts).to_pylist() == [library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in some]


def test_tokens_encode_to_themselves(vocab):
    some = sorted(b for b in vocab.bytes[:50256])
    assert [vocab.bytes[i[0]] for i in vocab.encode_words(some)] == some


def test_operator(spark, library):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "é😀", "x"), (1, "hello world", "x"), (4, "long " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe_encode(docs, PATH, decode=True)
    got = out.collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["ids"] == library.encode(x["decoded"], add_special_tokens=False).ids
    assert sorted(x["decoded"] for x in got) == sorted(t or "" for _, t, _ in rows)
    back = bpe_decode(out.drop("decoded"), PATH).collect()
    assert sorted(x["decoded"] for x in back) == sorted(t or "" for _, t, _ in rows)
    assert bpe_encode(docs.limit(0), PATH).count() == 0


def test_bytes_that_are_no_text(spark):
    runs = spark.createDataFrame([(1, [163]), (2, None), (3, [None, 39])], "doc_id long, ids array<int>")
    got = {x["doc_id"]: x["decoded"] for x in bpe_decode(runs, PATH).collect()}
    assert got == {1: Tokenizer.from_file(PATH).decode([163]), 2: "", 3: "H"}


def test_special_tokens_that_begin_alike(tmp_path):
    """The longest one counts, as in the library; flags that are not supported are refused."""
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    plain = spec["added_tokens"][0]
    spec["added_tokens"] += [plain | {"content": c, "id": plain["id"] + i} for i, c in enumerate(("<|a", "<|a|>", "<|a|>b"), 1)]
    path = tmp_path / "more.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    vocab, library = Vocabulary(str(path)), Tokenizer.from_file(str(path))
    some = ["x<|a|>bc", "<|a|> <|a|b", "<|a<|a|><|endoftext|>", "<|<|a"]
    tokens, counts = vocab.encode(some)
    assert tokens.tolist() == [i for t in some for i in library.encode(t, add_special_tokens=False).ids] and len(counts) == len(some)
    spec["added_tokens"][1]["lstrip"] = True
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="not supported"):
        Vocabulary(str(path))

"""Word-level BPE against the public library."""

import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest

from fieldweave.llm import queries, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
PIECES = ["a", "b", "Σ", "ΑΣ ", "é", "é", "가", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "'S", "'ll", " ", "\n", "\t", "12", "İ", "ß", "漢", "😀", "--", "\x00", "\x1c", " ", "the", "ING", "́"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return word_bpe.WordCodec(Path(PATH).read_bytes())


def test_odd_texts(library, codec):
    rng = random.Random(1)
    texts = ["", " ", "don't DON'T we'll"] + ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(4000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want, text
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_character(library, codec):
    """All characters that Unicode 15 knows, alone and beside a letter."""
    import unicodedata

    for cp in range(0x30000):
        if unicodedata.category(chr(cp)) not in ("Cs", "Cn"):
            text = f"{chr(cp)} a{chr(cp)}B"
            assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(cp)


@pytest.mark.parametrize("text", ["ab" * 40_000, "!?-" * 30_000, "x" * 64, "x" * 65, "".join(random.Random(2).choices("abcdeéß漢", k=20_000))])
def test_long_words(library, codec, text):
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_scanning_equals_the_tree(codec):
    rng = random.Random(4)
    for _ in range(300):
        parts = [codec.inner[ord(c)] for c in rng.choices("abcdefinorst", k=rng.randint(1, 80))]
        parts[-1] = codec.last[ord("e")]
        assert word_bpe.merge_short(list(parts), codec.merges) == word_bpe.merge_long(list(parts), codec.merges)


def test_memory_may_be_emptied(codec, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 3)
    for text in ("some words here again", "other words there", "some words here again"):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello hello"), (3, "Hello hello"), (None, "x " * 50_000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, ids string")
    got = word_bpe.encode(df, PATH).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in got) == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("None", 50_000)]
    said = {r["doc_id"]: r["text"] for r in word_bpe.decode(word_bpe.encode(df, PATH), PATH).collect()}
    assert said[3] == "hello</w> hello</w>" and said[1] == said[2] == ""
    assert word_bpe.round_trip(df.limit(0), PATH).collect() == []


def test_other_files_are_refused():
    import json

    told = json.loads(Path(PATH).read_bytes())
    told["normalizer"]["normalizers"].pop()
    with pytest.raises(ValueError, match="other steps"):
        word_bpe.WordCodec(json.dumps(told).encode())


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_registered(spark, library):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op12_word_bpe(spark, SF).collect())

"""Word-level BPE encoding and decoding with a contiguous rank array.

A tokenizer file in JSON says what to do: special tokens are cut out of the text
as it stands; the rest is composed (NFC), lower-cased character by character and
cut into words by the file's pattern; a word's bytes become parts, the last of
which carries the end-of-word mark; and neighbouring parts merge. A short word is
one array of part ids beside one array of the ranks of neighbouring parts: the
least rank is looked for by scanning, the boundary behind it is deleted from both
arrays, and the ranks on its two sides are refreshed. Scanning grows with the
square of a word, so words of more than ``SHORT`` parts, such as thousands of
letters without a space, take a segment tree of ranks, with the same result. Words
of up to ``SHORT`` characters are remembered by a worker. Characters count as the
installed Unicode tables have them; those assigned after Unicode 15 may be cut otherwise
than by a library with other tables.

Null and empty texts give no ids and an empty decoded text, empty tables no
rows. Very long texts are encoded whole, in time about proportional to their
length. Rows are handled one by one, so repeated rows give repeated results, and
no other column is read, whatever its name. A file of another make (other steps,
a decoder, a post-processor) is refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from fieldweave.llm.bpe import PairTree
from fieldweave.llm.common import per_row

#: A worker remembers so many stretches and so many words; a word of more parts than ``SHORT`` is long.
REMEMBERED, SHORT = 500_000, 64
NEVER = 2**62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: itself if it is printable, else the next unused one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges(dict):
    """The rank of a pair of part ids, packed as one number, and the part that each rank makes."""

    def __init__(self, made: list[tuple[int, int, int]]) -> None:
        super().__init__(((left << 32 | right, rank) for rank, (left, right, _) in enumerate(made)))
        self.part = [new for _, _, new in made]


def merge_short(parts: list[int], merges: Merges) -> list[int]:
    """Merge the leftmost pair of least rank until none is left, by scanning an array of ranks."""
    find, part = merges.get, merges.part
    ranks = [find(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
    while ranks and (least := min(ranks)) != NEVER:
        at = ranks.index(least)
        new = parts[at] = part[least]
        del parts[at + 1], ranks[at]
        if at:
            ranks[at - 1] = find(parts[at - 1] << 32 | new, NEVER)
        if at < len(ranks):
            ranks[at] = find(new << 32 | parts[at + 1], NEVER)
    return parts


def merge_long(parts: list[int], merges: Merges) -> list[int]:
    """The same with a segment tree over the ranks, for words of any length."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def rank(i: int, j: int) -> int:
        return merges.get(parts[i] << 32 | parts[j], NEVER) if i >= 0 and j < n else NEVER

    tree = PairTree([rank(i, i + 1) for i in range(n)], NEVER)
    while (at := tree.leftmost()) >= 0:
        gone = after[at]
        beyond = after[gone]
        parts[at] = merges.part[rank(at, gone)]
        after[at] = beyond
        if beyond < n:
            before[beyond] = at
        tree.set(gone, NEVER)
        tree.set(at, rank(at, beyond))
        if before[at] >= 0:
            tree.set(before[at], rank(before[at], at))
    out, at = [], 0
    while at < n:
        out.append(parts[at])
        at = after[at]
    return out


class WordCodec(dict):
    """Stretch between spaces to ids; remembers short stretches, and short words inside them."""

    def __init__(self, content: bytes) -> None:
        super().__init__()
        self.known: dict[str, list[int]] = {}
        told = json.loads(content)
        model, steps = told["model"], [s["type"] for s in told["normalizer"]["normalizers"]]
        split, as_bytes = told["pre_tokenizer"]["pretokenizers"]
        known = (
            model["type"] == "BPE" and steps == ["NFC", "Replace", "Lowercase"] and told["normalizer"]["normalizers"][1]["content"] == " "
            and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True)
            and (as_bytes["type"], as_bytes["add_prefix_space"], as_bytes["use_regex"]) == ("ByteLevel", False, False)
            and not any([told["post_processor"], told["decoder"], model["dropout"], model["continuing_subword_prefix"], model["ignore_merges"]])
            and not any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not known:
            raise ValueError("the tokenizer file describes other steps than this encoder takes")
        vocab, letters, end = model["vocab"], byte_letters(), model["end_of_word_suffix"]
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + end] for x in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.token_of = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.digits_of = [str(i) for i in range(max(self.token_of) + 1)]
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        by_length = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")").split if by_length else None

    def _word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            raw = word.encode()
            parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            ids = merge_short(parts, self.merges) if len(parts) <= SHORT else merge_long(parts, self.merges)
            if len(word) <= SHORT:
                self.known[word] = ids
        return ids

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            # the capital sigma has a form of its own at word ends, but not character by character
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        words = self.words(text.lower())
        return self._word(words[0]) if len(words) == 1 else list(chain.from_iterable(map(self._word, words)))

    def __missing__(self, stretch: str) -> list[int]:
        if self.cut is None or not any(s in stretch for s in self.special):
            ids = self._plain(stretch)
        else:
            ids = [x for i, part in enumerate(self.cut(stretch)) for x in ([self.special[part]] if i % 2 else self._plain(part))]
        if len(stretch) <= SHORT:
            self[stretch] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        for memory in (self, self.known):
            if len(memory) > REMEMBERED:
                memory.clear()
        # nothing composes, matches or is special across a space or a line end
        return list(chain.from_iterable(map(self.__getitem__, text.replace("\n", " ").split(" "))))

    def decode(self, ids: list[int]) -> str:
        """Tokens with a space between; end-of-word marks and special tokens stay."""
        return " ".join(map(self.token_of.__getitem__, ids))


_CODECS: dict[str, WordCodec] = {}


def codecs(spark: SparkSession, path: str) -> Callable[[], WordCodec]:
    """Gives a worker its codec, kept from task to task; the file, as large as the vocabulary, is broadcast."""
    content = Path(path).read_bytes()
    key, held = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def codec() -> WordCodec:
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = WordCodec(held.value)
        return _CODECS[key]

    return codec


def encode(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text; null text: no ids."""
    codec = codecs(docs.sparkSession, path)

    def make():
        tool = codec()

        def work(batch: pa.RecordBatch) -> dict:
            return {doc_id: batch.column(0), "ids": [tool.encode(x or "") for x in batch.column(1).to_pylist()]}

        return work

    return per_row(docs, [doc_id, text], f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, ids array<int>", make)


def decode(encoded: DataFrame, path: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): the text that the ids stand for; null ids: empty."""
    codec = codecs(encoded.sparkSession, path)

    def make():
        tool = codec()

        def work(batch: pa.RecordBatch) -> dict:
            return {doc_id: batch.column(0), "text": [tool.decode(x or []) for x in batch.column(1).to_pylist()]}

        return work

    return per_row(encoded, [doc_id, ids], f"`{doc_id}` {encoded.schema[doc_id].dataType.simpleString()}, text string", make)


def round_trip(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded.

    The digests are lowercase hex, of the ids in decimal joined by one space and of
    the decoded text in UTF-8.
    """
    codec = codecs(docs.sparkSession, path)

    def make():
        tool = codec()

        def work(batch: pa.RecordBatch) -> dict:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for value in batch.column(1).to_pylist():
                ids = tool.encode(value or "")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(tool.digits_of.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            return {doc_id: batch.column(0), **out}

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    return per_row(docs, [doc_id, text], f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)

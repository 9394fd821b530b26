"""Byte-pair encoding and decoding with a contiguous rank array.

A word's parts lie in one list and the ranks of its adjacent pairs in another.  The smallest rank is looked for by a scan,
the boundary between its two parts is deleted, and the ranks beside it are refreshed; this goes on until no pair has a
rank.  Words of over SHORT parts keep their ranks in a heap instead, with the same result.  The words of a worker are
remembered, so a repeated word costs one look-up.

Which code points are letters depends on a library's Unicode tables.  Texts with code points that Python's own table
doesn't know are cut into words by the tokenizers library itself; the merges are the same.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from loomcast.llm.common import slices

SHORT = 256
REMEMBERED = 600_000
_NO_RANK = 1 << 60
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The split that byte-level files name by a flag alone.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return [chr(b) for _, b in sorted([(b, b) for b in plain] + [(b, 256 + k) for k, b in enumerate(rest)])]


_settled: set[str] = set()


def newer(text: str) -> bool:
    """Whether a text has code points that Python's Unicode table doesn't know.  Those that it knows are remembered."""
    if text.isascii() or not (seen := set(text) - _settled):
        return False
    odd = {c for c in seen if unicodedata.category(c) == "Cn"}
    _settled.update(seen - odd)
    return bool(odd)


class Codec:
    """Encoder and decoder of a tokenizers file of the BPE kind."""

    def __init__(self, path: str) -> None:
        self._path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lower, self.nfc, self.blanks = "Lowercase" in kinds, "NFC" in kinds, "Replace" in kinds
        steps = spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL_SPLIT)
        self._words = regex.compile(split.replace(r"\s", _BLANK[1:-1]) if "[^\\s" in split and r"\s+" not in split else split)
        self._blank = regex.compile(_BLANK + "+")
        self.merged_ends = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self._bytes = {c: b for b, c in enumerate(self.letters)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if (new := self.vocab.get(a + b)) is not None and a in self.vocab and b in self.vocab:
                self.pairs[self.vocab[a], self.vocab[b]] = (rank, new)
        self._known: dict[str, bytes] = {}

    def _library_words(self, segment: str) -> list[str]:
        if self._library is None:
            self._library = Tokenizer.from_file(self._path)
        if self._library.normalizer is not None:
            segment = self._library.normalizer.normalize_str(segment)
        return [segment[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(segment)]

    def words(self, segment: str) -> list[str]:
        if newer(segment):
            return self._library_words(segment)
        if self.nfc:
            segment = unicodedata.normalize("NFC", segment)
        if self.blanks:
            segment = self._blank.sub(" ", segment)
        if self.lower:
            segment = segment.replace("Σ", "σ").lower()  # a final sigma isn't told apart
        return self._words.findall(segment)

    def word_ids(self, word: str) -> bytes:
        """The word's ids as int32 bytes, so that a text's ids are one join."""
        known = self._known
        if (ids := known.get(word)) is None:
            if len(known) >= REMEMBERED:
                known.clear()
            ids = known[word] = array("i", self._merge(word)).tobytes()
        return ids

    def _merge(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode("utf-8", "replace")]
        letters[-1] += self.end
        parts = [self.vocab[c] for c in letters if c in self.vocab]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        pairs = self.pairs
        none = (_NO_RANK, 0)
        ranks = [pairs.get(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NO_RANK:
            at = ranks.index(least)
            parts[at] = pairs[parts[at], parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = pairs.get((parts[at - 1], parts[at]), none)[0]
            if at < len(ranks):
                ranks[at] = pairs.get((parts[at], parts[at + 1]), none)[0]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same order of merges (smallest rank, then leftmost) by a heap over linked parts."""
        pairs, n = self.pairs, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := pairs.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], parts[j] = pairs[a, b][1], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if r := pairs.get((parts[k], parts[after[k]])):
                    heapq.heappush(heap, (r[0], k, parts[k], parts[after[k]]))
            if (i := before[k]) >= 0 and (r := pairs.get((parts[i], parts[k]))):
                heapq.heappush(heap, (r[0], i, parts[i], parts[k]))
        return [p for p in parts if p >= 0]

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text's stretches, and the special tokens between them by their ids."""
        at = 0
        if self.special and "<|" in text or any("<|" not in s for s in self.special):
            for m in self._special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], None
                yield m[0], self.special[m[0]]
                at = m.end()
        if at < len(text):
            yield text[at:], None

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        get = self._known.get
        for segment, special in self.segments(text):
            if special is not None:
                out.append(array("i", [special]).tobytes())
                continue
            words = self.words(segment)
            found = list(map(get, words))
            if None in found:
                found = [self.word_ids(w) if ids is None else ids for w, ids in zip(words, found)]
            out.extend(found)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces where the file names no decoder; else the bytes that they stand for, as UTF-8."""
        try:
            named = list(map(self.tokens.__getitem__, ids))
        except KeyError:
            named = [self.tokens[i] for i in ids if i in self.tokens]
        if not self.merged_ends:
            return " ".join(named)
        special, out = self.special, bytearray()
        for t in named:
            out += t.encode() if t in special or any(c not in self._bytes for c in t) else bytes(self._bytes[c] for c in t)
        return out.decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker, whose remembered words outlive a task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """df's other columns with ids array<int> and decoded string; columns so named in df are replaced.

    The whole text is encoded; null and empty texts have no ids and decode to "".  vocabulary is a tokenizers JSON file
    that every executor can read.  Rows stay apart, so repeated rows and ties need no rule.
    """
    kept = [c for c in df.columns if c not in (text, "ids", "decoded")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in slices(batches, 0, 4 << 20):
            ids = [c.encode(t) if t else np.empty(0, np.int32) for t in batch.column(0).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            decoded = pa.array([c.decode(x.tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists, decoded], names=[f.name for f in schema])

    return df.select(text, *kept).mapInArrow(run, schema)

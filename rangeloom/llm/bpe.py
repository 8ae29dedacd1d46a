"""Byte-pair encoding by forced-boundary splitting, and decoding.

A pair of neighbouring bytes that stands inside no token of the vocabulary can
never be merged over, so a text may be cut there and the fragments encoded each
by itself; their ids, one after another, are the text's.  Such pairs are found
once from the vocabulary.  Any pair with a white-space byte is one, which cuts
whole texts without looking at them closely; within the words that the
pre-tokenizer makes, all other pairs are looked up.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm import _text as T

#: Words whose ids a worker process remembers, some 250 bytes each.
MEMO = 400_000
#: Fragments of more symbols than this are merged one by one over a heap, the others all at once.
SHORT = 64
#: Text bytes encoded at once.
ENCODE_BYTES = 1 << 22

#: Latin-1 words without white space or controls, which lower case and the pattern alone take apart.
_PLAIN = re.compile(r"[\x21-\x7E\xA1-\xFF]+")


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on, in order."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(other)}


class Codec:
    """Encodes and decodes whole texts with a byte-level BPE file whose pre-tokenizer drops white space."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        unlike = [k for k, v in {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}.items() if (model.get(k) or None) != (v or None)]
        if unlike or described["decoder"] or any(p.isspace() or "Ġ" in p for p, _ in self._library.pre_tokenizer.pre_tokenize_str("a b")):
            raise ValueError(f"not a byte-level BPE file that drops white space and has no decoder: {path} ({', '.join(unlike)})")
        self._vocab: dict[str, int] = model["vocab"]
        self._suffix: str = model.get("end_of_word_suffix") or ""
        self._merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._merges[self._vocab[a], self._vocab[b]] = rank, self._vocab[a.removesuffix(self._suffix) + b if self._suffix else a + b]
        characters = byte_characters()
        self._bytes = str.maketrans({c: chr(b) for b, c in characters.items()})
        self._inside = np.zeros((256, 256), bool)
        for token in self._vocab:
            raw = token.removesuffix(self._suffix) if self._suffix else token
            if len(raw) > 1:
                raw = np.frombuffer(raw.translate(self._bytes).encode("latin-1"), np.uint8)
                self._inside[raw[:-1], raw[1:]] = True
        spaces = np.frombuffer(T.SPACES.encode(), np.uint8)
        if self._inside[spaces].any() or self._inside[:, spaces].any():
            raise ValueError(f"tokens hold white space: {path}")
        #: ids of single bytes, and of those that end a word
        self._first = np.array([self._vocab[characters[b]] for b in range(256)])
        self._last = np.array([self._vocab[characters[b] + self._suffix] for b in range(256)])
        keys = np.array([(a << 32) | b for a, b in self._merges])
        self._order = np.argsort(keys)
        self._keys, self._made = keys[self._order], np.array([made for _, made in self._merges.values()])
        self._split = self._plain_pattern(described)
        self._special = {x["content"]: x["id"] for x in described["added_tokens"] if x["special"] and not x["normalized"]}
        if len(self._special) < len(described["added_tokens"]) or any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(map(str.isspace, x["content"])) for x in described["added_tokens"]):
            raise ValueError(f"added tokens of a kind that isn't supported: {path}")
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        size = max([*self._vocab.values(), *self._special.values()]) + 1
        names = [""] * size
        for name, i in (self._vocab | self._special).items():
            names[i] = name
        self._names = pa.array(names, pa.large_string())
        self._memo: dict[str, bytes] = {}
        self._limit = memo

    @staticmethod
    def _plain_pattern(described: dict):
        """The pre-tokenizer's pattern, where all that it needs before is lower case; only used on Latin-1 words."""
        steps = [x["type"] for x in (described["normalizer"] or {}).get("normalizers", [])]
        kinds = (described["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in kinds] != ["Split", "ByteLevel"] or not kinds[0]["invert"] or kinds[0]["behavior"] != "Removed" or kinds[1]["use_regex"] or kinds[1]["add_prefix_space"]:
            return None
        return regex.compile(kinds[0]["pattern"]["Regex"] + "|\n")

    def forced(self, a: int, b: int) -> bool:
        """Whether two neighbouring bytes of a word are a certain cut."""
        return not self._inside[a, b]

    def fragments(self, pieces: bytes, ends: np.ndarray) -> np.ndarray:
        """Ends of the fragments of pre-tokens, laid end to end: where a pre-token ends, and at forced boundaries."""
        data = np.frombuffer(pieces, np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self._inside[data[:-1], data[1:]]
        cut[ends] = True
        cut[0] = False
        return np.flatnonzero(cut)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; one past the last where there is no merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], len(self._keys))

    def _merged(self, ids: list[int]) -> list[int]:
        """Merges of one long fragment, by rank and leftmost first, over a linked list and a heap."""
        n, merges = len(ids), self._merges
        after, before, gone = [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
        heap = [(found[0], i, found[1]) for i, pair in enumerate(pairwise(ids)) if (found := merges.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or merges.get((ids[i], ids[j]), (0, -1))[1] != made:
                continue
            ids[i], gone[j], after[i] = made, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (found := merges.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (found[0], left, found[1]))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]

    def _merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments laid end to end, and how many each has: in every step each fragment makes its first merge of lowest rank."""
        place = np.arange(len(ids))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begins = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > SHORT):
            long = ids[begins[k] : begins[k] + sizes[k]]
            found = self._merged(long.tolist())
            long[:] = -1
            long[: len(found)] = found
        live = np.flatnonzero((sizes <= SHORT)[owner])
        out, none = ids, len(self._keys)
        ids, owner, place = ids[live], owner[live], place[live]
        last = np.append(owner[1:] != owner[:-1], True)[: len(ids)]
        rank = np.append(self._ranks(ids[:-1], ids[1:]), none)[: len(ids)]
        rank[last] = none
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            long = np.diff(np.append(starts, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, starts), long)
            at = np.flatnonzero((rank == least) & (least < none))
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])[: len(at)]]
            ids[at] = self._made[rank[at]]
            last[at] |= last[at + 1]
            out[place[at + 1]] = -1
            out[place[at]] = ids[at]
            stays = least < none
            stays[at + 1] = False
            rank[at] = none + 1
            ids, owner, place, last, rank = (x[stays] for x in (ids, owner, place, last, rank))
            at = np.flatnonzero(rank == none + 1)
            for i in (at, at[at > 0] - 1):
                i = i[~last[i]]
                rank[i] = self._ranks(ids[i], ids[i + 1])
            rank[last] = none
        kept = out >= 0
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return out[kept], np.bincount(owner[kept], minlength=len(sizes))

    def _pieces(self, words: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Pre-tokens of words as bytes end to end, where each ends, and which word each belongs to."""
        if self._split and all(map(_PLAIN.fullmatch, words)):
            joined = "\n".join(words).lower()
            found = self._split.findall(joined)
            gaps = np.fromiter((x == "\n" for x in found), bool, len(found))
            text = np.frombuffer(joined.encode("latin-1"), np.uint8)
            wide = 1 + (text >= 128)
            wide[text == 10] = 0
            ends = np.cumsum(wide)[np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) - 1]
            return joined.replace("\n", "").encode(), ends[~gaps], np.cumsum(gaps)[~gaps]
        made = [[x.translate(self._bytes).encode("latin-1") for x, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(w) if self._library.normalizer else w)] for w in words]
        sizes = np.fromiter((len(x) for pieces in made for x in pieces), np.int64)
        return b"".join(x for pieces in made for x in pieces), np.cumsum(sizes), np.repeat(np.arange(len(words)), [*map(len, made)])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without special tokens, end to end, and how many each has."""
        data, ends, owner = self._pieces(words)
        if not data:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        cuts = self.fragments(data, ends)
        raw = np.frombuffer(data, np.uint8)
        ids = self._first[raw]
        ids[ends - 1] = self._last[raw[ends - 1]]
        ids, counts = self._merge(ids, np.diff(cuts, prepend=0))
        word = owner[np.searchsorted(ends, cuts)]
        return ids, np.bincount(word, counts, len(words)).astype(np.int64)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of texts without ASCII white space, special tokens in them included, as little-endian 32-bit integers."""
        special = [x for x in words if self._specials and self._specials.search(x)]
        plain = [x for x in words if _PLAIN.fullmatch(x)]
        known: dict[str, bytes] = {}
        rest = {*words} - {*special} - {*plain}
        parts = {y for x in special for y in self._specials.split(x) if y and y not in self._special}
        for group in ([*dict.fromkeys(plain)], [*rest, *(parts - rest)]):
            ids, counts = self._encoded(group)
            cuts = np.concatenate(([0], np.cumsum(counts))) * 4
            packed = ids.astype("<i4").tobytes()
            known |= {x: packed[a:b] for x, (a, b) in zip(group, pairwise(cuts.tolist()), strict=True)}
        for x in special:
            known[x] = b"".join(np.array([self._special[y]], "<i4").tobytes() if y in self._special else known[y] for y in self._specials.split(x) if y)
        return [known[x] for x in words]

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words.  A full memory takes no more, until half of what is asked for is missing in it."""
        memo = self._memo
        found = [*map(memo.get, words)]
        fresh = [i for i, x in enumerate(found) if x is None]
        if fresh:
            made = self.words([words[i] for i in fresh])
            if 2 * len(fresh) > len(words) and len(memo) >= self._limit:
                memo.clear()
            for i, ids in zip(fresh, made, strict=True):
                found[i] = ids
            for i in fresh[: self._limit - len(memo)]:
                memo[words[i]] = found[i]
        return found

    def encode(self, column: pa.Array) -> Iterator[tuple[int, pa.LargeListArray]]:
        """For each bounded chunk of texts its first row and the texts' ids; null texts are empty.

        Texts are cut at ASCII white space into an Arrow dictionary, only whose
        entries are encoded; ids are gathered by index.
        """
        for row, _, data, offsets in T.chunks(column, ENCODE_BYTES):
            starts, ends, bounds = T.word_spans(data, offsets)
            edges = np.concatenate(([0], np.cumsum(ends - starts)))
            solid = np.ascontiguousarray(data[~((data == 32) | ((data >= 9) & (data <= 13)))])
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(solid)).dictionary_encode()
            known = self._known(words.dictionary.to_pylist())
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            values = np.frombuffer(b"".join(known), "<i4")
            at = words.indices.to_numpy()
            long = sizes[at]
            last = np.concatenate(([0], np.cumsum(long)))
            begins = (np.cumsum(sizes) - sizes)[at]
            ids = values[np.repeat(begins - last[:-1], long) + np.arange(last[-1])]
            yield row, pa.LargeListArray.from_arrays(pa.array(last[bounds]), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.LargeListArray) -> pa.Array:
        """Texts of lists of ids: with no decoder in the file, the tokens, with a space between each two; unknown ids are left out."""
        flat = ids.flatten()
        good = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self._names)))
        names = self._names.take(pc.if_else(good, flat, 0))
        offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        if not pc.all(good, min_count=0).as_py():
            kept = good.to_numpy(zero_copy_only=False)
            names, offsets = names.filter(good), np.concatenate(([0], np.cumsum(kept)))[offsets]
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), names), pa.scalar(" ", pa.large_string()))


_codecs: dict[str, Codec] = {}


def codec_for(path: str) -> Codec:
    """The worker process's codec, whose memory outlasts a task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, without added start or end tokens, and what they decode to.

    Returns ``doc_id``, ``ids`` (array of int) and ``decoded``, one row for each
    input row; ids and rows may repeat or be null.  Null text counts as empty,
    and empty or blank text has no ids and decodes to the empty string.  A
    special token's own string in a text gives that token, as in the tokenizers
    library.  An empty table gives an empty result; other columns are ignored.
    Rows are encoded where they lie, in chunks of bounded size; a text is never
    cut but at forced boundaries, so a very long one costs as much as many short.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path)
        for batch in batches:
            for row, ids in codec.encode(batch.column(1)):
                small = pa.ListArray.from_arrays(ids.offsets.cast(pa.int32()), ids.flatten())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(ids)), small, codec.decode(ids).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Number of ids, and SHA-256 of the ids in decimal with a space between each two, and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

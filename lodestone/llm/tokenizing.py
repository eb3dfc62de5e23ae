"""Token counts, encoding and decoding with public tokenizer files.

Every tokenizer here encodes a text as the concatenation of what it makes of the text's chunks, where a
chunk ends before white space. A worker therefore encodes each distinct chunk once and keeps the result;
whole texts are then sums or joins of cached values. Texts that hold a special token's marker are encoded
whole by the library.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import SLICE_BYTES, column, slices, working

#: White space as the tokenizers' patterns know it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: A word with the one blank before it, or white space: the boundaries that byte-level patterns respect.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Texts that split_chunks leaves to CHUNK: longer runs of white space, other white space, NUL.
PLAIN_NOT = r"[ \n]{3}|[ \n]{2}\z|[\x00\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What the patterns do within ASCII chunks, where letters and digits need no Unicode tables.
ASCII_BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: What every special token of the public files begins with.
MARK = "<|"
#: Distinct chunks that a worker keeps; beyond, it starts afresh.
CACHE = 300_000
#: Entries of the table of frequent chunks at most; documents that it is drawn from, about; and chunks that one of
#: those may name.
HOT = 200_000
HOT_DOCS, HOT_EACH = 2000, 1000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def byte_of() -> np.ndarray:
    """The byte alphabet in reverse: the byte that each stand-in character stands for, by code point."""
    letters = byte_alphabet()
    out = np.zeros(max(map(ord, letters)) + 1, np.uint8)
    for b, c in enumerate(letters):
        out[ord(c)] = b
    return out


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's own reading of a .json file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Cached:
    """chunk -> value for the chunks that a worker met lately, filled in batches on a miss.

    Two generations: when the younger is full it becomes the older, so frequent chunks stay.
    """

    def __init__(self, fill: Callable[[list[str]], list], hot: dict | None = None, limit: int = CACHE):
        self.fill, self.hot, self.limit = fill, hot or {}, limit
        self.young: dict = {}
        self.old: dict = {}

    def values(self, chunks: list[str]) -> list:
        """The values of distinct chunks, in their order."""
        out = list(map(self.young.get, chunks))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            names = [chunks[i] for i in missing]
            found = [None] * len(names)
            for tier in (self.hot, self.old):
                if tier:
                    found = [tier.get(c) if v is None else v for c, v in zip(names, found, strict=True)]
            fresh = [c for c, v in zip(names, found, strict=True) if v is None]
            made = iter(self.fill(fresh) if fresh else ())
            found = [next(made) if v is None else v for v in found]
            self.young.update(zip(names, found, strict=True))
            for i, v in zip(missing, found, strict=True):
                out[i] = v
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return out


def split_words(col: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: their dictionary-encoded run, each text's offsets in it, odd texts."""
    parts = pc.ascii_split_whitespace(col)
    odd = pc.find_substring(col, MARK).to_numpy(zero_copy_only=False) >= 0
    return parts.flatten().dictionary_encode(), _offsets(parts), odd


def split_chunks(col: pa.Array, marks: bool = True) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Chunks of texts whose white space is single or double blanks and line ends; other texts are odd."""
    odd = pc.match_substring_regex(col, PLAIN_NOT + (r"|<\|" if marks else "")).to_numpy(zero_copy_only=False)
    cut = pc.replace_substring(pc.replace_substring(col, " ", "\0 "), "\n", "\0\n\0")
    parts = pc.split_pattern(cut, "\0")
    return parts.flatten().dictionary_encode(), _offsets(parts), odd


def _offsets(parts: pa.ListArray) -> np.ndarray:
    o = parts.offsets.to_numpy()
    return o - o[0]


class Encoded:
    """The ids of a slice's texts, from the ids of its distinct chunks."""

    def __init__(self, coded: pa.DictionaryArray, offsets: np.ndarray, cache: Cached):
        values = cache.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.at = coded.indices.to_numpy(zero_copy_only=False)
        self.offsets = offsets
        self.size = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        self.flat = np.frombuffer(b"".join(values), "<u4")

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's offsets in them."""
        n = self.size[self.at]
        ends = np.cumsum(n)
        first = np.cumsum(self.size) - self.size
        ids = self.flat[np.repeat(first[self.at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[self.offsets]


# --- the library on misses ------------------------------------------------------------------------------


class Fill:
    """Ids of chunks by a tokenizers object, 4 bytes each: its model on the parts of ASCII chunks (each part
    once), the whole library on other chunks."""

    def __init__(self, tokenizer, ascii_parts: re.Pattern, lower: bool):
        self.t, self.parts, self.lower = tokenizer, ascii_parts, lower
        self.letter = byte_alphabet()
        self.known = Cached(self._model)

    def _model(self, parts: list[str]) -> list[bytes]:
        letter, run = self.letter, self.t.model.tokenize
        return [struct.pack(f"<{len(x)}I", *[k.id for k in x]) for x in (run("".join([letter[b] for b in p.encode()])) for p in parts)]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if c.isascii()]
        find = self.parts.findall
        found = [find(chunks[i].lower() if self.lower else chunks[i]) for i in plain]
        names = list(dict.fromkeys(p for f in found for p in f))
        get = dict(zip(names, self.known.values(names), strict=True)).__getitem__
        for i, f in zip(plain, found, strict=True):
            out[i] = b"".join(map(get, f))
        rest = [i for i, v in enumerate(out) if v is None]
        for i, e in zip(rest, self.t.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=4)
def byte_fill(path: str) -> Fill:
    return Fill(library(path), ASCII_BYTE, False)


def _whole(path: str) -> Callable[[list[str]], list[bytes]]:
    t = library(path)
    return lambda rows: [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(rows, add_special_tokens=False)]


def byte_chunks(path: str) -> bool:
    """Whether a file is of the byte-level kind whose texts split into CHUNKs."""
    return path.endswith(".json") and (library(path).pre_tokenizer is not None) and "ByteLevel" in repr(library(path).pre_tokenizer) and library(path).normalizer is None


# --- token counts ---------------------------------------------------------------------------------------


def _whole_counts(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of whole strings, by the library for the file's kind."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda strings: [len(x) for x in model.encode(strings, num_threads=1)]
    t = library(path)
    return lambda strings: [len(x) for x in t.encode_batch_fast(strings, add_special_tokens=False)]


def frequent_chunks(docs: DataFrame, path: str, entries: int = HOT, most: int = HOT_DOCS, each: int = HOT_EACH) -> dict[str, int]:
    """Chunks met twice or more in about `most` documents, the most frequent `entries` of them, with their token counts.

    The sample only fills a cache ahead of time: a chunk that it misses is encoded when met. Nothing is shuffled;
    the driver gets `most` times `each` counts at most, whatever the corpus.
    """
    share = min(1.0, most / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_000)) < int(share * 1e6) + 1

    def summarise(batches):
        for batch in slices(batches, limit=4 * SLICE_BYTES):
            coded, _, _ = split_chunks(column(batch, "text").fill_null(""))
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            top = np.argsort(-n, kind="stable")[: each * batch.num_rows]
            short = pc.less(pc.utf8_length(coded.dictionary.take(pa.array(top))), 64).to_numpy(zero_copy_only=False)
            top = top[short]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(top)), pa.array(n[top])], ["chunk", "n"])

    found = docs.select("text", drawn.alias("drawn")).where("drawn").select("text").mapInArrow(summarise, "chunk string, n long").toArrow()
    known = found.group_by("chunk").aggregate([("n", "sum")]).filter(pc.field("n_sum") > 1).sort_by([("n_sum", "descending"), ("chunk", "ascending")])
    names = known.column("chunk").to_pylist()[:entries]
    return dict(zip(names, (len(x) >> 2 for x in byte_fill(path)(names)), strict=True))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, hot_entries: int = HOT) -> DataFrame:
    """Tokens of each text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A map-side look-up in two tiers: a broadcast table of the frequent chunks of a sample (at most
    `hot_entries`, whatever the corpus), then the worker's cache, which the library fills on misses. No chunk is
    shuffled. `path` names a byte-level tokenizers .json file; other .json files and sentencepiece .model
    files count whole texts.

    A null text counts as empty (0 bytes, 0 tokens, within the limit); a null doc_id is carried along;
    repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    chunked = byte_chunks(path)
    hot = docs.sparkSession.sparkContext.broadcast(frequent_chunks(docs, path, hot_entries) if chunked else {})

    def count(batches):
        working("tokens", forget)
        whole = _whole_counts(path)
        if chunked:
            fill = byte_fill(path)
            cache = Cached(lambda c: [len(x) >> 2 for x in fill(c)], hot.value)
        for batch in slices(batches, limit=4 * SLICE_BYTES):
            col = column(batch, "text").fill_null("")
            size = pc.binary_length(col).cast(pa.int64())
            if chunked:
                coded, offsets, odd = split_chunks(col)
                each = np.array(cache.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64)
                total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])])
                n = np.diff(total[offsets])
            else:
                n, odd = np.zeros(len(col), np.int64), np.ones(len(col), bool)
            left = np.flatnonzero(odd)
            if len(left):
                n[left] = whole(col.take(pa.array(left)).to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


# --- encoding and decoding by rank files --------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(maxsize=2)
def rank_tokenizer(path: str, pattern: str):
    """A tokenizers BPE with the ranks' vocabulary, the stand-in characters of each id, and the ranks.

    Bytes map to their stand-in characters; each token's merge is the pair that the lower ranks leave of it.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    letter = byte_alphabet()
    spell = lambda b: "".join(letter[x] for x in b)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            pair = _last_pair(token, rank, ranks)
            if pair:
                merges.append((spell(pair[0]), spell(pair[1])))
    t = Tokenizer(models.BPE({spell(b): r for b, r in ranks.items()}, merges))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    table = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = spell(token)
    return t, table, ranks


def _last_pair(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by ranks below `rank` leaves of `token`; None if it leaves more."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best >= rank:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class RankCodec:
    """Encodes with the tokenizers library over a rank file, holds the result to the rank rule, and decodes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.t, self.table, self.ranks = rank_tokenizer(path, pattern)
        self.fill = Fill(self.t, ASCII_BYTE, False)
        self.mark = max(self.ranks.values()) + 1
        self.rule = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={MARK + "end|>": self.mark})
        self.cache = Cached(self._encode)
        self.chunked = pattern == public_tokenizers.PATTERN  # else where a chunk ends is not known here
        self.size = np.array([len(x) for x in self.table], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer("".join(self.table).encode("utf-32-le"), "<u4")
        self.byte_of = byte_of()

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. Tokens with several splits can meet in an order that the merge list lacks;
        where the rank rule's own ids differ, they stand."""
        out = self.fill(chunks)
        if any(MARK in c for c in chunks):
            return [np.array(self.rule.encode_ordinary(c), "<u4").tobytes() for c in chunks]
        mark = np.array([self.mark], "<u4").tobytes()
        rule = self.rule.encode_to_numpy((MARK + "end|>").join(chunks), allowed_special="all")
        if np.array_equal(np.frombuffer(mark.join(out), "<u4"), rule):
            return out
        ends = np.flatnonzero(rule == self.mark)
        return [rule[a:b].astype("<u4").tobytes() for a, b in zip([0, *(ends + 1)], [*ends, len(rule)], strict=True)]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts in a row, and each text's offsets in them."""
        if not self.chunked:
            parts = [np.array(self.rule.encode_ordinary(t), "<u4") for t in col.to_pylist()]
            return np.concatenate([*parts, np.zeros(0, "<u4")]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        coded, offsets, odd = split_chunks(col, marks=False)
        if not odd.any():
            return Encoded(coded, offsets, self.cache).ids()
        parts = [b""] * len(col)
        even = np.flatnonzero(~odd)
        if len(even):
            ids, at = self.encode(col.take(pa.array(even)))
            for i, a, b in zip(even.tolist(), at, at[1:], strict=False):
                parts[i] = ids[a:b].tobytes()
        for i in np.flatnonzero(odd).tolist():
            chunks = CHUNK.findall(col[i].as_py())
            names = list(dict.fromkeys(chunks))
            parts[i] = b"".join(map(dict(zip(names, self.cache.values(names), strict=True)).__getitem__, chunks))
        return np.frombuffer(b"".join(parts), "<u4"), np.concatenate([[0], np.cumsum([len(p) >> 2 for p in parts])])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and the offset at which each id's begin: their characters, put back through
        the reversed byte table. A character split over ids comes together again as its bytes do."""
        n = self.size[ids]
        ends = np.cumsum(n)
        letters = self.letters[np.repeat(self.first[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return self.byte_of[letters], np.concatenate([[0], ends])

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The character of the text in which each id's bytes begin, which may have begun in the id before."""
        data, starts = self.decode(ids)
        return (np.cumsum((data & 0xC0) != 0x80) - 1)[starts[:-1]]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> RankCodec:
    return RankCodec(path, pattern)


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids of each text: doc_id, ids array<int>, places array<int> (the character in which each id's bytes begin; two
    ids share one where a character is split). A null text is empty; other columns are ignored."""

    def run(batches):
        working("tokens", forget)
        c = codec(path, pattern)
        for batch in slices(batches):
            ids, at = c.encode(column(batch, "text").fill_null(""))
            places = [c.places(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.astype(np.int32)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), lists(ids), lists(np.concatenate([*places, np.zeros(0, np.int64)]))], ["doc_id", "ids", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, places array<int>")


def decode_ids(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary, text: what each id list stands for. Characters split over ids come together; where a list
    begins or ends inside one, text has U+FFFD there and decoded the bytes. Null ids give null."""

    def run(batches):
        working("tokens", forget)
        c = codec(path, pattern)
        for batch in batches:
            rows = column(batch, "ids").to_pylist()
            out = [None if r is None else c.decode(np.array(r, np.int64))[0].tobytes() for r in rows]
            texts = [None if x is None else x.decode("utf-8", "replace") for x in out]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "decoded", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, decoded binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    A null text is empty; a null doc_id is carried along; repeated rows each give a row.
    """

    def run(batches):
        working("tokens", forget)
        c = codec(path, pattern)
        for batch in slices(batches):
            ids, at = c.encode(column(batch, "text").fill_null(""))
            back, starts = c.decode(ids)
            raw, cuts = ids.astype("<u4").tobytes(), starts[at]
            text = back.tobytes()
            sha = lambda b: hashlib.sha256(b).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array([sha(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]),
                    pa.array([sha(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]),
                    pa.array(np.diff(cuts).astype(np.int64)),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


# --- ids for packing ------------------------------------------------------------------------------------------


class WordCodec:
    """Ids of texts by a .json file that drops white space, from the ids of their words."""

    def __init__(self, path: str):
        self.whole = _whole(path)
        self.cache = Cached(Fill(library(path), ASCII_WORD, True))

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts in a row, and each text's offsets in them."""
        coded, offsets, odd = split_words(col)
        ids, at = Encoded(coded, offsets, self.cache).ids()
        if odd.any():
            parts = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
            left = np.flatnonzero(odd)
            for i, x in zip(left.tolist(), self.whole(col.take(pa.array(left)).to_pylist()), strict=True):
                parts[i] = np.frombuffer(x, "<u4")
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, at


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def forget() -> None:
    """Drop the tokenizers and caches that a worker keeps."""
    for kept in (library, byte_fill, rank_tokenizer, codec, word_codec):
        kept.cache_clear()

"""Byte-level BPE: a sentencepiece model made from a rank file, and cached encoders for two libraries."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keeps, slices

#: Pre-tokens longer than this are encoded each time, not cached.
CACHED_CHARS = 48
#: How the tokenizers library's ByteLevel splits texts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are a letter, number or white space to one of the splitters (the regex module, the tokenizers library) and something else
#: to the other, or may become so: tables of Unicode differ in these only.
UNSETTLED = "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua000-\uabff\ud7a4-\U0010ffff]"


def byte_chars() -> str:
    """A printable character for every byte: visible Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number: int, payload: bytes) -> bytes:
    """A length-delimited field of a protocol buffer."""
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def flag(number: int, n: int) -> bytes:
    """A field that holds a whole number."""
    return _varint(number << 3) + _varint(n)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: <unk> as piece 0, then each token in rank order as piece rank + 1, its bytes
    mapped to characters and its score the negative rank; BPE; identity normalisation."""
    chars = byte_chars()

    def piece(text: str, score: float, kind: int) -> bytes:
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + flag(3, kind))

    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [rank for _, rank in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0 to n - 1")
    pieces = [piece("".join(chars[b] for b in token), -float(rank), 1) for token, rank in by_rank]
    trainer = field(2, flag(3, 2))  # model_type: BPE
    normaliser = field(3, field(1, b"identity") + flag(3, 0) + flag(4, 0) + flag(5, 0))  # no dummy prefix, no white-space rules
    return piece("<unk>", 0.0, 2) + b"".join(pieces) + trainer + normaliser


def latin_form(pattern: str) -> str | None:
    """The pattern for texts of U+0000 to U+00FF in terms of the standard library's engine, which is quicker on small
    classes: letters, numbers and white space of the regex engine spelt out. None if it has other classes."""
    every = list(map(chr, range(256)))
    members = {name: "".join(f"\\x{ord(c):02x}" for c in every if regex.fullmatch(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    for name, chars in members.items():
        pattern = regex.sub(r"(\[\^?[^\]]*?)" + regex.escape(name), lambda m: m[1] + chars, pattern).replace(name, f"[{chars}]")
    pattern = pattern.replace(r"\S", f"[^{members[r'\s']}]")
    return None if r"\p" in pattern else pattern


class Cached:
    """Encodes texts pre-token by pre-token; each distinct pre-token once, as long as the cache holds it."""

    def __init__(self, pattern: str, encode_many: Callable[[list[str]], list[bytes]], most: int = 250_000):
        self.split_any = regex.compile(pattern).findall
        self.split_latin = re.compile(latin_form(pattern)).findall if latin_form(pattern) else self.split_any
        self.encode_many, self.most, self.known = encode_many, most, {}

    def split(self, text: str) -> list[str]:
        latin = text.isascii() or len(text.encode("latin-1", "ignore")) == len(text)
        return self.split_latin(text) if latin else self.split_any(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes that encode_many gives."""
        parts = list(map(self.split, texts))
        if len(self.known) > self.most:  # the oldest half holds the common words
            self.known = dict(itertools.islice(self.known.items(), self.most // 2))
        new = list(set().union(*parts).difference(self.known))
        known = self.known
        known.update(zip(new, self.encode_many(new)))
        out = [b"".join(map(known.__getitem__, part)) for part in parts]
        for word in new:
            if len(word) > CACHED_CHARS:
                del known[word]
        return out


class Words(dict):
    """The ids of words, as bytes; a word that is not there is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes], known: Iterable[tuple[str, bytes]] = ()):
        super().__init__(known)
        self.encode, self.long = encode, []

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        if len(word) > CACHED_CHARS:
            self.long.append(word)
        return ids


class CachedSingly(Cached):
    """Cached for an encoder that is quickest word by word: words are looked up once, without a set of the new ones first."""

    def __init__(self, pattern: str, encode: Callable[[str], bytes], most: int = 250_000):
        super().__init__(pattern, lambda words: list(map(encode, words)), most)
        self.encode, self.known = encode, Words(encode)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known = Words(self.encode, itertools.islice(self.known.items(), self.most // 2))
        known = self.known
        out = [b"".join(map(known.__getitem__, self.split(text))) for text in texts]
        for word in known.long:
            del known[word]
        known.long.clear()
        return out


@functools.cache
def sentencepiece_coder(path: str, pattern: str) -> tuple[Cached, Callable[[bytes], bytes]]:
    """encode: texts to little-endian uint32 ids; decode: such ids to bytes."""
    import sentencepiece

    ranks = read_ranks(path)
    model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
    to_chars, to_bytes = dict(enumerate(byte_chars())), {ord(c): b for b, c in enumerate(byte_chars())}
    inverse = [model.id_to_piece(i + 1).translate(to_bytes).encode("latin-1") for i in range(len(ranks))]

    def encode_many(words: list[str]) -> list[bytes]:
        raw = [word.encode() for word in words]
        # a pre-token that is a token stays whole, even where merges would not reach it
        odd = [i for i, word in enumerate(raw) if word not in ranks]
        out = [struct.pack("<I", ranks[word]) if word in ranks else b"" for word in raw]
        found = model.encode([raw[i].decode("latin-1").translate(to_chars) for i in odd], out_type=int, num_threads=1)
        for i, ids in zip(odd, found):
            out[i] = (np.array(ids, "<u4") - np.uint32(1)).tobytes()
        return out

    return Cached(pattern, encode_many), lambda ids: b"".join(map(inverse.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class WithAdded:
    """Encodes texts as the tokenizers library does where its added tokens' strings have ids of their own: what stands between
    them is encoded by itself."""

    def __init__(self, coder: Cached, added: dict[str, bytes]):
        self.coder, self.added = coder, added
        self.split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))).split
        self.find = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))).findall

    def __call__(self, texts: list[str]) -> list[bytes]:
        found = [self.find(x) if any(map(x.__contains__, self.added)) else [] for x in texts]
        if not any(found):
            return self.coder(texts)
        parts = [self.split(x) if own else [x] for x, own in zip(texts, found)]
        ids = iter(self.coder([x for own in parts for x in own]))
        return [b"".join(next(ids) + (self.added[names[i]] if i < len(names) else b"") for i in range(len(own))) for own, names in zip(parts, found)]


@functools.cache
def library_coder(path: str, pattern: str, most: int = 400_000, plain: bool = False) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian uint16 or uint32 ids (by the vocabulary's size) as the tokenizers library encodes them without
    adding tokens; most: words that the cache holds. The strings of the vocabulary's added tokens get these tokens' ids, as the library
    gives them; with `plain` they are ordinary text, as with its encode_special_tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    keeps("coders", library_coder.cache_clear)
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True  # words are between added tokens, or added tokens are text
    kind = id_type(model.get_vocab_size())

    sizes = np.array([len(model.id_to_token(i)) for i in range(model.get_vocab_size())])  # a character for each byte

    def encode_many(words: list[str]) -> list[bytes]:
        """Words go as pre-tokens of one input, in parts, and are told apart by their bytes or, where ids stand for other bytes, by
        the library's slower count of words."""
        out: list[bytes] = []
        inputs = [words[a : a + 2000] for a in range(0, len(words), 2000)]
        for own, x in zip(inputs, model.encode_batch_fast(inputs, is_pretokenized=True, add_special_tokens=False)):
            ids, bounds = np.array(x.ids, np.int64), np.cumsum([0, *(len(w.encode()) for w in own)])
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])
            cuts = np.searchsorted(ends, bounds)
            if ends[-1] != bounds[-1] or (ends[cuts] != bounds).any():
                x = model.encode(own, is_pretokenized=True, add_special_tokens=False)
                ids, cuts = np.array(x.ids, np.int64), np.searchsorted(np.array(x.word_ids, np.int64), np.arange(len(own) + 1))
            raw, cuts = ids.astype(kind).tobytes(), (cuts * int(kind[2])).tolist()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    single = _model_coder(model, kind, lambda word: encode_many([word])[0]) if pattern == BYTE_LEVEL else None
    cached = CachedSingly(pattern, single, most) if single else Cached(pattern, encode_many, most)
    added = {} if plain else {x.content: np.array([i], kind).tobytes() for i, x in model.get_added_tokens_decoder().items()}
    return WithAdded(cached, added) if added else cached


def _model_coder(model, kind: str, odd: Callable[[str], bytes]) -> Callable[[str], bytes] | None:
    """A pre-token to its ids by the library's BPE model alone, which is what the library does with one after splitting; odd() for those
    that it may split otherwise. None where its tokenizer does more than to split by BYTE_LEVEL and to map bytes to characters."""
    from tokenizers import models, pre_tokenizers

    splitter, merger = model.pre_tokenizer, model.model
    if not isinstance(splitter, pre_tokenizers.ByteLevel) or not splitter.use_regex or splitter.add_prefix_space:
        return None
    if not isinstance(merger, models.BPE) or merger.dropout or any(x is not None for x in (model.normalizer, model.truncation, model.padding)):
        return None
    if not all(x.special for x in model.get_added_tokens_decoder().values()):
        return None
    chars, raw = dict(enumerate(byte_chars())), [i.to_bytes(int(kind[2]), "little") for i in range(model.get_vocab_size())]
    tokens, unsettled = merger.tokenize, re.compile(UNSETTLED).search

    def encode(word: str) -> bytes:
        if not word.isascii() and unsettled(word):
            return odd(word)
        return b"".join([raw[x.id] for x in tokens(word.encode().decode("latin-1").translate(chars))])

    return encode


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


@functools.cache
def library_type(path: str) -> str:
    from tokenizers import Tokenizer

    return id_type(Tokenizer.from_file(path).get_vocab_size())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids (array of int) for each whole text.

    Null and empty texts give an empty array. Rows are independent: no shuffle, repeated rows are encoded alike,
    other columns stay (one named as `ids` is replaced). A batch is cut by bytes, so one very long text is the
    most that a worker holds."""
    out = df.drop(ids).withColumn(ids, F.lit(None).cast("array<int>"))
    schema = out.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = sentencepiece_coder(path, pattern)
        for batch in slices(batches, text):
            found = [np.frombuffer(x, "<u4") for x in coder([x or "" for x in batch.column(text).to_pylist()])]
            ends = np.cumsum([0, *map(len, found)])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids])

    return df.drop(ids).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes (binary) that each array of ids stands for; a null array gives empty bytes."""
    kept = df.drop(out)
    schema = kept.withColumn(out, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = sentencepiece_coder(path, pattern)
        for batch in batches:
            column = pa.array([decoder(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids, and digests both: key, n_tokens, ids_sha256, decoded_sha256.

    Both ways run in one pass, so ids never leave the worker. Null texts count as empty; a null key stays null;
    repeated rows give repeated results; other columns are not read."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, decoder = sentencepiece_coder(path, pattern)
        for batch in slices(batches, "text"):
            found = coder([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(decoder(x)).hexdigest() for x in found]),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )

"""BPE encoding and decoding through a table of distinct words.

Method: documents are split into words (white space with the run of other characters after it; no
token of a byte-level BPE reaches across such a border). Each block of documents keeps its distinct
words and its documents as lists of places among them. The distinct words of all blocks are
shuffled by word, each is encoded once, and the ids go back to their block, where they are put
together by position. Decoding looks every id up in the table of pieces.

Words travel packed: those of one block that fall to the same share of the vocabulary are one row.
The number of shares grows with the input, so that a task holds a bounded part of the vocabulary; a
frequent word is one entry of each block, and a long document is only a long list of places.

The documents are read twice, once for the words and once for the lists of places, because writing
both down would take more disk than the text. ``docs`` must give its rows in the same order each time, as a
table in files does; if it does not, the blocks differ and the job fails.

Defined cases: null text is encoded as empty text. Repeated rows come out as often as they came in.
An empty table gives an empty table.
"""

import functools
import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstate.llm.common import releasing
from reelstate.llm.wordgrams import buffers

BLOCK_BYTES = 12 << 20
#: Bytes of text for which there is one share of the vocabulary.
SHARE_BYTES = 16 << 20
#: White space of Unicode, as the tokenizers' patterns know it.
BLANK = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    found = {i: token for token, i in content["model"]["vocab"].items()}
    found |= {token["id"]: token["content"] for token in content["added_tokens"]}
    tokens = [found.get(i, "") for i in range(max(found, default=-1) + 1)]
    return [bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
            for token in tokens]


def decode(ids: np.ndarray, path: str) -> str:
    """Text of ids; bytes that are no UTF-8 become U+FFFD, as the tokenizers library does it."""
    table = pieces(path)
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


_PACK = zstandard.ZstdCompressor(level=3)


def packed(values) -> bytes:
    """Numbers as planes of their bytes, compressed: the planes of small numbers are nearly empty."""
    planes = np.ascontiguousarray(np.asarray(values, dtype="<u4")).view(np.uint8).reshape(-1, 4).T
    return _PACK.compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def packed_words(words: list[str]) -> bytes:
    joined = "".join(words).encode("utf-8")
    lengths = packed([len(w) for w in words])
    return len(lengths).to_bytes(4, "little") + lengths + _PACK.compress(joined)


def unpacked_words(data: bytes) -> list[str]:
    size = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpacked(data[4 : 4 + size])).tolist()
    text = zstandard.ZstdDecompressor().decompress(data[4 + size :]).decode("utf-8")
    return [text[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


class _Block:
    """Documents of a block as lists of places among its distinct words."""

    def __init__(self):
        self.keys: list = []
        self.lengths, self.places = array("I"), array("I")
        self.words: dict[str, int] = {}
        self.digest = hashlib.blake2b(digest_size=8)
        self.size = 0

    def add(self, key, raw: bytes) -> None:
        self.digest.update(b"%r %d " % (repr(key).encode(), len(raw)))
        self.digest.update(raw)
        found = WORD.findall(raw.decode("utf-8"))
        number = self.words.setdefault
        self.keys.append(key)
        self.lengths.append(len(found))
        self.places.extend([number(w, len(self.words)) for w in found])
        self.size += len(raw) + 64

    def row(self, shares: int) -> pa.RecordBatch:
        places = np.frombuffer(self.places, dtype=np.uint32) if self.places else np.zeros(0, np.uint32)
        counts = np.bincount(places, minlength=len(self.words))
        order = np.argsort(-counts, kind="stable")  # frequent words first: small numbers pack well
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        listed = list(self.words)
        listed = [listed[i] for i in order.tolist()]
        share = np.array([zlib.crc32(w.encode()) % shares for w in listed], dtype=np.uint32)
        parts = [{"share": s, "words": packed_words([listed[i] for i in np.flatnonzero(share == s)])}
                 for s in np.unique(share).tolist()]
        kind = pa.list_(pa.struct([("share", pa.int64()), ("words", pa.binary())]))
        return pa.RecordBatch.from_arrays([
            pa.array([int.from_bytes(self.digest.digest(), "little", signed=True)], pa.int64()),
            pa.array([self.keys], pa.list_(pa.int64())),
            pa.array([packed(self.lengths)], pa.binary()),
            pa.array([packed(rank[places])], pa.binary()),
            pa.array([packed(share)], pa.binary()),
            pa.array([parts], kind),
        ], names=["block", "keys", "lengths", "codes", "shares", "parts"])


_BLOCKS = ("block long, keys array<long>, lengths binary, codes binary, shares binary, "
           "parts array<struct<share: long, words: binary>>")


def _blocks(key: str, text: str, size: int, shares: int):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            for i, doc in enumerate(batch.column(key).to_pylist()):
                block.add(doc, data[offsets[i] : offsets[i + 1]].tobytes())
                if block.size >= size:
                    yield block.row(shares)
                    block = _Block()
        if block.keys:
            yield block.row(shares)

    return run


def _encoded(path: str):
    """Ids of the words of each part; parts come sorted by share, whose words are encoded once."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, known = None, {}
        fast = getattr(tokenizer(path), "encode_batch_fast", tokenizer(path).encode_batch)
        for batch in batches:
            out = []
            for own, data in zip(batch.column("share").to_pylist(), batch.column("words").to_pylist(),
                                 strict=True):
                if own != share:
                    share, known = own, {}
                words = unpacked_words(data)
                fresh = [w for w in words if w not in known]
                for low in range(0, len(fresh), 10_000):
                    part = fresh[low : low + 10_000]
                    for w, e in zip(part, fast(part, add_special_tokens=False), strict=True):
                        known[w] = array("I", e.ids)
                ids = [known[w] for w in words]
                sizes = packed([len(x) for x in ids])
                flat = array("I")
                for x in ids:
                    flat.extend(x)
                out.append(len(sizes).to_bytes(4, "little") + sizes + packed(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("share"), pa.array(out, pa.binary())],
                names=["block", "share", "ids"])

    return run


def _word_ids(shares: np.ndarray, parts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a block's words one after the other, and the number and the place of each word's."""
    sizes = np.zeros(len(shares), dtype=np.int64)
    heads = np.zeros(len(shares), dtype=np.int64)
    flat, at = [], 0
    for share, data in parts.items():
        cut = 4 + int.from_bytes(data[:4], "little")
        own, ids = unpacked(data[4:cut]).astype(np.int64), unpacked(data[cut:])
        where = np.flatnonzero(shares == share)
        sizes[where] = own
        heads[where] = at + np.cumsum(own) - own
        flat.append(ids)
        at += len(ids)
    return np.concatenate(flat) if flat else np.zeros(0, dtype="<u4"), sizes, heads


def _joined(path: str, key: str, with_ids: bool, with_text: bool):
    """Documents of a block from its words' ids, by position."""

    @releasing
    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        out = {name: [] for name in (key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "text")}
        parts = dict(zip(words.column("share").to_pylist(), words.column("ids").to_pylist(), strict=True))
        names = ("keys", "lengths", "codes", "shares")
        for keys, lengths, codes, shares in zip(*(block.column(c).to_pylist() for c in names), strict=True):
            shares = unpacked(shares)
            if set(np.unique(shares).tolist()) - parts.keys():
                raise ValueError("the documents came in another order when they were read again")
            flat, sizes, heads = _word_ids(shares, parts)
            codes, at = unpacked(codes), 0
            for doc, length in zip(keys, unpacked(lengths).tolist(), strict=True):
                own = codes[at : at + length]
                at += length
                n = sizes[own]
                total = int(n.sum())
                inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                tokens = flat[np.repeat(heads[own], n) + inner]
                text = decode(tokens, path)
                out[key].append(doc)
                out["n_tokens"].append(total)
                out["ids_sha256"].append(hashlib.sha256(tokens.astype("<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                out["ids"].append(tokens.astype(np.int32) if with_ids else None)
                out["text"].append(text if with_text else None)
        kinds = {key: pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.table({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return run


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
            block_bytes: int = BLOCK_BYTES, share_bytes: int = SHARE_BYTES,
            with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """One row for each document: number of tokens, digests, and where wanted ids and text.

    ``text`` is decoded from the ids through the table of pieces.
    """
    path = path or vocabulary()
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shares = max(1, -(-total // share_bytes))
    blocks = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(
        _blocks(key, text, block_bytes, shares), _BLOCKS)
    words = blocks.select("block", F.explode("parts").alias("part")).select("block", "part.*")
    words = words.repartition("share").sortWithinPartitions("share")
    ids = words.mapInArrow(_encoded(path), "block long, share long, ids binary")
    lists = blocks.select("block", "keys", "lengths", "codes", "shares")
    out = lists.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(
        _joined(path, key, with_ids, with_text),
        f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string, "
        "ids array<int>, text string")
    unwanted = [name for name, wanted in (("ids", with_ids), ("text", with_text)) if not wanted]
    return out.drop(*unwanted)


def decoded(tokens: DataFrame, key: str = "doc_id", ids: str = "ids",
            path: str | None = None) -> DataFrame:
    """Texts of lists of ids; null counts as an empty list, an id beyond the table as an error."""
    path = path or vocabulary()

    @releasing
    def run(batches):
        for batch in batches:
            texts = [decode(np.asarray(x or [], dtype=np.int64), path)
                     for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())],
                                             names=[key, "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")

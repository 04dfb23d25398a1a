"""Token counts of sections: whole documents are encoded once, tokens are mapped to sections.

Method: a document is encoded as a whole, so that its sections count the tokens it really has. The
spans of its tokens are joined to the spans of its sections by binary search in the sorted section
starts. A token that reaches over a border belongs to the section that holds most of its bytes, the earlier one of
equals; a token that touches no section is counted outside.

Sections are lists of character spans, in order and apart from each other; by default the lines of the
text, each with its line break. Tokens may end within a character, so that spans are compared in bytes.

Defined cases: null text is empty text, which has one empty line. A document without sections has
only tokens outside. Repeated rows come out as often as they came in.
"""

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelstate.llm.bpe import BLANK
from reelstate.llm.wordgrams import buffers

LONG_BLANK = re.compile(f"[{BLANK}]{{10000,}}")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoding(path: str):
    """The encoding of a rank file, and the number of bytes of each id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for piece, i in ranks.items():
        sizes[i] = len(piece)
    made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})
    return made, sizes


def token_ends(text: str, path: str) -> np.ndarray:
    """The byte at which each token ends.

    The encoder's pattern overflows its stack on long runs of white space, so that a text that has some is
    encoded in parts. A part ends before the last blank of such a run: the pattern ends a token
    there too, as it leaves that blank to the word after it.
    """
    made, sizes = encoding(path)
    ids, at = [], 0
    for run in LONG_BLANK.finditer(text):
        ids += made.encode_ordinary(text[at : run.start()])
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += made._encode_single_piece(text[run.start() : end])
        at = end
    ids += made.encode_ordinary(text[at:])
    return np.cumsum(sizes[ids])


def attribute(ends: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none), and whether the token reaches over a border."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    owner = np.full(len(ends), -1, dtype=np.int64)
    crossing = np.zeros(len(ends), dtype=bool)
    if not len(lows) or not len(ends):
        return owner, crossing
    first = np.searchsorted(highs, starts, side="right")  # the first section that ends after the start
    last = np.searchsorted(lows, ends, side="left") - 1  # the last one that starts before the end
    touched = first <= last
    inside = touched & (first == last)
    inside[inside] = (lows[first[inside]] <= starts[inside]) & (ends[inside] <= highs[first[inside]])
    owner[inside] = first[inside]
    crossing = touched & ~inside
    for i in np.flatnonzero(crossing):
        span = slice(first[i], last[i] + 1)
        shared = np.minimum(highs[span], ends[i]) - np.maximum(lows[span], starts[i])
        if shared.max(initial=0) > 0:
            owner[i] = first[i] + int(shared.argmax())
        else:
            crossing[i] = False
    return owner, crossing


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of a text, each with its line break."""
    breaks = np.flatnonzero(raw == 0x0A) + 1
    return np.append(0, breaks), np.append(breaks, len(raw))


def _counted(key: str, text: str, sections: str | None, path: str):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            given = batch.column(sections).to_pylist() if sections else None
            ids, parts = [], [[] for _ in range(6)]
            for i, doc in enumerate(batch.column(key).to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                if given is None:
                    lows, highs = line_spans(raw)
                else:
                    spans = np.array([(s["start"], s["end"]) for s in given[i] or []],
                                     dtype=np.int64).reshape(-1, 2)
                    lows, highs = chars[np.minimum(spans, len(chars) - 1)].T
                ends = token_ends(raw.tobytes().decode(), path)
                owner, crossing = attribute(ends, lows, highs)
                n = len(lows)
                outside = int((owner < 0).sum())
                rows = n + (outside > 0)
                ids.extend([doc] * rows)
                counts = np.bincount(owner[owner >= 0], minlength=n)
                crossed = np.bincount(owner[crossing], minlength=n)
                borders = np.searchsorted(chars, [lows, highs])
                extra = [[-1], [0], [len(chars) - 1], [outside], [0], [len(ends)]] if outside else [[]] * 6
                for part, own, more in zip(parts, (np.arange(n), *borders, counts, crossed,
                                                   np.full(n, len(ends))), extra, strict=True):
                    part.append(own)
                    part.extend([np.array(more, dtype=np.int64)] if more else [])
            flat = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(p.astype(np.int64)) for p in flat)],
                names=[key, "section", "first_char", "end_char", "n_tokens", "n_crossing", "n_all"])

    return run


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", sections: str | None = None,
            path: str | None = None) -> DataFrame:
    """A row for each section: its character span, its tokens, how many of them reach over a border.

    ``sections`` names a column ``array<struct<start, end>>`` of character spans. Tokens outside all
    sections are a row with section -1. ``n_all`` are the tokens of the whole document.
    """
    columns = [F.col(key).cast("long").alias(key), text, *([sections] if sections else [])]
    return docs.select(*columns).mapInArrow(
        _counted(key, text, sections, path or vocabulary()),
        f"`{key}` long, section long, first_char long, end_char long, n_tokens long, "
        "n_crossing long, n_all long")

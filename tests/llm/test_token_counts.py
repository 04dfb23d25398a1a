import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelstate.llm import queries, token_counts

TEXTS = [
    "One line.", "First line.\nSecond  line.\n\n\nLast é line 日本.\n", "", None, "\n", "\n\n\n", " \n \n x",
    "🎉🎉\n🎉 z  \ny", "word " * 3000 + "\n" + "x" * 5000, "\r\n\r\n a\r\nb",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def by_hand(text, spans, tokenizer):
    """Sections by the tokenizer's own offsets, one character and token at a time."""
    text = text or ""
    tokens = [tokenizer.id_to_token(i) for i in tokenizer.encode(text, add_special_tokens=False).ids]
    at, out, outside = 0, [[0, 0] for _ in spans], 0
    byte = [0]
    for c in text:
        byte.append(byte[-1] + len(c.encode()))
    for token in tokens:
        own = set(range(at, at + len(token)))  # byte-level pieces have a character for each byte
        at += len(token)
        shared = [len(own & set(range(byte[a], byte[b]))) for a, b in spans]
        if not any(shared):
            outside += 1
            continue
        best = max(range(len(spans)), key=lambda i: (shared[i], -i))
        out[best][0] += 1
        out[best][1] += max(shared) < len(own)
    return out, outside


def line_spans(text):
    text, out, at = text or "", [], 0
    for line in text.split("\n"):
        out.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    return out


def test_lines(spark, tokenizer):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for r in token_counts.counted(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS):
        rows = sorted(got[i], key=lambda r: r.section)
        spans = line_spans(text)
        counts, _ = by_hand(text, spans, tokenizer)
        assert [(r.first_char, r.end_char) for r in rows] == spans
        assert [[r.n_tokens, r.n_crossing] for r in rows] == counts
        assert {r.n_all for r in rows} == {sum(n for n, _ in counts)}


def test_given_sections_with_gaps(spark, tokenizer):
    text = "Some words é in 日本語 text,\n\n\nwith sections anywhere."
    spans = [(2, 7), (9, 17), (17, 19), (26, 28), (28, 40)]
    df = spark.createDataFrame([(1, text, [{"start": a, "end": b} for a, b in spans], 5),
                                (2, text, [], 5), (3, text, None, 5)],
                               "doc_id long, text string, parts array<struct<start: long, end: long>>, "
                               "section int")
    rows = token_counts.counted(df, sections="parts").collect()
    counts, outside = by_hand(text, spans, tokenizer)
    own = sorted((r.section, r.n_tokens, r.n_crossing) for r in rows if r.doc_id == 1)
    assert own == [(-1, outside, 0), *((i, n, c) for i, (n, c) in enumerate(counts))]
    assert [(r.section, r.n_tokens) for r in rows if r.doc_id > 1] == [(-1, rows[0].n_all)] * 2


def test_ties_go_to_the_earlier_section():
    owner, crossing = token_counts.attribute(np.array([4]), np.array([0, 2]), np.array([2, 4]))
    assert owner.tolist() == [0] and crossing.tolist() == [True]


def test_query(spark, sf_dir, tokenizer):
    rows = queries.QUERIES["op6_token_counts"](spark, sf_dir).groupBy("doc_id").agg(
        {"n_tokens": "sum", "n_all": "max", "section": "count"}).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r["sum(n_tokens)"], r["max(n_all)"]) == (n, n)
        assert r["count(section)"] == texts[r.doc_id].count("\n") + 1


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a\nb")], "doc_id long, text string")
    assert token_counts.counted(df).count() == 4
    assert token_counts.counted(df.limit(0)).count() == 0

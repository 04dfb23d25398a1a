import hashlib
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from reelstate.llm import bpe
from reelstate.llm.common import saved, table

NAMES = [name for name, _ in corpus_pipeline.STAGES]


def by_hand(docs, items):
    """The rows ``(doc_id, text)`` after each stage but the last."""
    texts = []
    verdicts = brute.line_verdicts(docs, texts=texts)
    kept = [(v[0], t) for v, t in zip(verdicts, texts, strict=True) if v[-1]]
    yield dict(kept)
    classes = brute.classes(kept)
    kept = [(k, t) for k, t in kept if classes[k][0] == k]
    yield dict(kept)
    removed = brute.removals(kept)
    out = {}
    seen = set()
    for key, text in sorted(kept):
        spans = [m.span() for m in brute.SPACED.finditer(text)]
        words, gone = [text[a:b] for a, b in spans], set()
        for i in range(len(words) - 19):
            own = tuple(words[i : i + 20])
            if own in seen:
                gone |= set(range(i, i + 20))
            seen.add(own)
        assert len(gone) == removed[key][1]
        if not gone:
            out[key] = text
        elif len(gone) < len(words):
            ends = [a for a, _ in spans[1:]] + [len(text)]
            left = "".join(text[a:e] for i, ((a, _), e) in enumerate(zip(spans, ends, strict=True))
                           if i not in gone)
            out[key] = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", left)
    yield out
    hit = brute.contamination(out.items(), items)
    yield {k: t for k, t in out.items() if not hit[k][-1]}


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir), "test")
        out.append(docs)
    return out


def test_names_and_order():
    assert NAMES == ["quality rules", "n-gram Jaccard join", "substring dedup",
                     "benchmark decontamination", "BPE encoding and decoding"]


def test_stages_against_brute_force(spark, sf_dir, stages):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    for name, found, want in zip(NAMES, stages, by_hand(rows, items), strict=False):
        assert found.columns == docs.columns, name
        got = found.collect()
        assert {r.doc_id: r.text for r in got} == want, name
        assert all(r.n_chars == len(r.text) for r in got), name


def test_run_gives_the_ids_of_what_is_left(spark, sf_dir, stages):
    tokenizer = Tokenizer.from_file(bpe.vocabulary())
    texts = {r.doc_id: r.text for r in stages[-2].collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == brute.sha(texts[r.doc_id])


def test_odd_documents_go_through(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(None, None, None, None, None, None), (1, "", "en", "a", 0, "x"), (2, long, "en", None, 7, "x"),
            (2, long, "en", None, 7, "x"), (3, long + " more", None, "a", None, None),
            (None, " ".join(f"own{i}" for i in range(40)), "en", "a", 1, "x")]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = saved(stage(spark, docs, sf_dir), "test")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
        ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert sorted(str(r.doc_id) for r in ids) == (["2", "None"] if given else [])

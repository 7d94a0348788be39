import random

import numpy as np
import pytest

from vireo.llm import token_counts as T
from vireo.llm.common import fresh_path, open_store, put_file

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(T.VOCABULARY), reason="no vocabulary")


def brute(ids, separator):
    out, first = [], 0
    for i, x in enumerate(ids):
        if x == separator:
            out.append((len(out), first, i - first, True))
            first = i + 1
    return out + ([(len(out), first, len(ids) - first, False)] if first < len(ids) else [])


@pytest.mark.parametrize("block", [2, 6, 64, 4096])
def test_scan_against_loop(spark, block):
    rnd = random.Random(block)
    base = fresh_path(spark, "test-tokens")
    made = {}
    for k in range(6):
        ids = [9 if rnd.random() < (0.0, 0.02, 0.3, 1.0, 0.1, 0.5)[k] else rnd.randint(0, 8) for _ in range((300, 300, 200, 50, 0, 1)[k])]
        made[f"f{k}"] = ids
        put_file(base, f"f{k}", np.array(ids, dtype=np.uint16).tobytes())
    files = spark.createDataFrame([(f, 2 * len(ids), "x") for f, ids in made.items()], "file string, bytes long, block string")
    got = sorted(tuple(r) for r in T.scan_token_files(files, base, separator=9, block_bytes=block).collect())
    assert got == sorted((f, *r) for f, ids in made.items() for r in brute(ids, 9))


def test_round_trip_with_texts(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 128)
    texts = ["Hello world", None, "", "<|endoftext|> is text", "é" * 500, "a b " * 5000, "same", "same", "x" * 20000]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)] + [(None, "same", "f"), (6, "same", "f")], "doc_id long, text string, file string").repartition(3)
    rows = T.count_tokens(docs).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.n_tokens)
    assert len(rows) == len(texts) + 2
    assert got == {**{i: {len(T.encode(t))} for i, t in enumerate(texts)}, None: {len(T.encode("same"))}}


def test_long_runs_of_white_space():
    coder = T.tokenizer(T.VOCABULARY, T.PATTERN)
    for run in (" " * 9000, "\n" * 5000 + " ", " \t" * 4000, "\u3000" * 4500):
        for before, after in (("", ""), ("a", ""), ("", "b c"), ("it's  ", "12!"), ("x\n", "\n y")):
            text = before + run + after
            assert T.encode_text(coder, text) == coder.encode_ordinary(text)
    text = "a b" + " " * 6000 + "c" + "\n" * 7000 + "d" + " " * 5000
    assert T.encode_text(coder, text) == coder.encode_ordinary(text)
    for text in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b"):  # the pattern engine alone gives up here
        assert coder.decode(T.encode_text(coder, text)) == text


def test_files_hold_what_was_written(spark):
    docs = spark.createDataFrame([(1, "One two"), (2, "three")], "doc_id long, text string").coalesce(1)
    files, order, base = T.write_token_files(docs)
    store, root = open_store(base)
    (f,) = files.collect()
    with store.open_input_file(f"{root}/{f.file}") as x:
        ids = np.frombuffer(x.read(), dtype=np.uint16)
    assert ids.tolist() == [*T.encode("One two"), T.SEPARATOR, *T.encode("three"), T.SEPARATOR] and f.bytes == 2 * len(ids)


def test_torn_file_and_empty_table(spark):
    base = fresh_path(spark, "test-tokens")
    put_file(base, "torn", b"abc")
    with pytest.raises(Exception, match="not whole tokens"):
        T.scan_token_files(spark.createDataFrame([("torn", 3)], "file string, bytes long"), base).collect()
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0

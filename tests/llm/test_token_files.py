import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from candlemill.llm import token_files, units
from candlemill.llm.token_files import Encoder, fetch, file_index, read_dictionary, read_index, read_token_files, write_token_files
from candlemill.sources.shared import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, path string, part int, offset string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed):
    draw = random.Random(seed)
    bits = [" ", " ", " ", "  ", "\n", "\t ", " \n", " ", " ", "᠎", "\x1c", "'s", " 're", "a", "Bc", "d1", "42", "...", "é", "漢字", "🙂", "▁", "<|endoftext|>", "don't", "́", "<s>", "\x00"]
    return ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(n)]


def test_units_change_no_id(tokenizer, monkeypatch):
    monkeypatch.setattr(units, "SEGMENT", 20)
    texts = odd_texts(3000, 1) + ["", " ", "a", " a", "a ", "word " * 50, "x" * 500 + " y"]
    encode = Encoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(i, "<u4").tolist() for i in encode(pa.array(texts, pa.large_string()))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = odd_texts(200, 2)
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(i, "<u4").tolist() for i in Encoder(path)(pa.array(texts, pa.large_string()))] == [e.ids for e in want]


def test_segments():
    for text in odd_texts(300, 3):
        old, units.SEGMENT = units.SEGMENT, 7
        try:
            parts = list(units.segments(text))
        finally:
            units.SEGMENT = old
        assert " ".join(parts) == text and not any(re.search(r"^\s|\s$", p) for p in parts[1:-1])


def test_round_trip(spark, tokenizer):
    texts = odd_texts(300, 4) + ["lorem ipsum " * 30_000, None, "", "same", "same"]
    rows = [(i * 7 % 311, t) for i, t in enumerate(texts)] + [(None, "no id"), (-5, "first"), (2**60, "last")] + [(77, "again")] * 40
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "p", 1, "o") for i, t in rows], SCHEMA).repartition(5)
    folder = new_folder(spark, "token_files")
    write_token_files(docs, folder, PATH)
    found = read_token_files(spark, folder)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids"]
    found = sorted(found.collect(), key=lambda r: r.start)
    ids = {t: (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0) for _, t in rows}
    got = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found]
    assert sorted(got, key=str) == sorted(((i, ids[t]) for i, t in rows), key=str)
    keys = [-(2**70) if r.doc_id is None else r.doc_id for r in found]
    assert keys == sorted(keys)
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert all(r.n_tokens == len(r.ids) // 4 for r in found)
    assert [a.tolist() for a in fetch(spark, folder, 2**60)] == [list(ids["last"])] and fetch(spark, folder, 123456) == []
    assert len(fetch(spark, folder, 77)) == 40 + sum(i == 77 for i, _ in rows) - 40
    assert read_index(spark, folder).count() == len(rows) and len(read_dictionary(spark, folder)) > 0


def test_files_stand_alone(spark):
    docs = spark.createDataFrame([(i, f"some text {i} " * 5) for i in range(900)], "doc_id long, text string")
    folder = new_folder(spark, "token_files")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_token_files(docs, folder, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.format("binaryFile").load(f"{folder}/ids").where("length > 0").collect()
    assert len(files) > 1
    indexes = sorted((file_index(memoryview(bytes(f.content))) for f in files), key=lambda x: x[0])
    assert np.concatenate([i["doc_id"] for _, _, i in indexes]).tolist() == list(range(900))
    spark.createDataFrame([(b"another",)], "content binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(Exception, match="not the one"):
        read_token_files(spark, folder).collect()
    with pytest.raises(ValueError):
        file_index(memoryview(b"x" * 200))


def test_dictionary_helps_short_documents(spark):
    docs = spark.createDataFrame([(i, f"the quick brown fox number {i} jumps over the lazy dog") for i in range(2000)], "doc_id long, text string")
    folder = new_folder(spark, "token_files")
    write_token_files(docs, folder, PATH)
    length, n = read_index(spark, folder).groupBy().sum("length", "n_tokens").first()
    assert length < 0.6 * 4 * n


def test_nothing(spark):
    for docs in (spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, None)], "doc_id long, text string")):
        folder = new_folder(spark, "token_files")
        write_token_files(docs, folder, PATH)
        assert [tuple(r)[:3] for r in read_token_files(spark, folder).collect()] == ([(1, 0, 1)] if docs.count() else [])
    assert token_files.train_dictionary(docs, PATH) == b""

import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from slipscope.llm import byte_bpe as b


@pytest.fixture(scope="module")
def vocabulary():
    return b.Vocabulary.read(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def texts():
    r = random.Random(3)
    pieces = ["a", "B", "é", " ", "  ", "\n", "\n \n", "'ll", "'", "12", "!!", "日本", "the", " ", "🙂", "' s"]
    out = ["".join(r.choice(pieces) for _ in range(n)) for n in (0, 1, 5, 40, 41, 79, 80, 81, 200, 900)]
    return [*out, None, "x" * 500, " " * 500, "a b " * 100, "word" * 30 + " " + "z" * 300]


def test_chunks_give_the_ids_of_whole_texts_and_round_trip(spark, vocabulary):
    rows = [(i, t, i) for i, t in enumerate(texts())] + [(None, "a null id", 1), (1, "x", 2), (1, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    ids = b.encode(df, vocabulary, chunk=40, overlap=12)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in b.decode(ids, vocabulary).collect())
    encoder: tiktoken.Encoding = vocabulary.built()[0]
    want = []
    for i, t, _ in rows:
        e = encoder.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(e), struct.pack(f"<{len(e)}I", *e), (t or "").encode()))
    assert got == sorted(want)


def test_id_list_and_empty_table(spark, vocabulary):
    df = spark.createDataFrame([(1, "two words"), (2, "")], "doc_id long, text string")
    out = b.encode(df, vocabulary)
    got = {r.doc_id: r.x for r in out.select("doc_id", b.id_list("ids").alias("x")).collect()}
    assert got == {1: vocabulary.built()[0].encode_ordinary("two words"), 2: []}
    assert b.digests(spark, df.limit(0), vocabulary).count() == 0

import hashlib
import random

import pytest

import corpus_pipeline as p
from slipscope.llm import byte_bpe, decontaminate, quality
from test_jaccard_join import brute as components
from test_secret_scan import brute as base_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "A train leaves the station at 40 km per hour and passes Alice after 3 hours while Bob walks 40 km to the next town."


def row(i, t):
    return (i, t, "en", "s", len(t) if t is not None else None)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["ta", "no", "ri", "el", "osh"]) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(200):
        w = [word() for _ in range(r.randrange(30, 90))]
        if i % 5 == 0:
            w = [x.upper() + "!!" for x in w]
        if i % 7 == 0:
            w.insert(3, "token = 0123456789abcdef%032x" % r.getrandbits(128))
        if i % 11 == 0:
            w[10:10] = ITEM.split()
        rows.append(row(i, " ".join(w)))
    rows += [row(1000 + i, rows[i][1] + " end") for i in range(1, 40)] + [row(2000, ""), row(2001, None), row(None, rows[2][1]), rows[3]]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    tail = lambda t: model.scores([(t or "").encode()], 1.0)[1][0]
    first = p.keep_quality(spark, docs, sf)
    assert first.columns == docs.columns
    assert rows_of(first) == sorted([tuple(r) for r in docs.collect() if tail(r.text) >= quality.SELECT], key=str)
    assert not any("!!" in (r.text or "") for r in first.collect())

    kept = rows_of(first)
    groups = components([(r[0], r[1]) for r in kept])
    firsts = {i for i, _, c in groups if i is not None and i == c}
    second = p.keep_one_of_each_group(spark, first, sf)
    assert second.columns == docs.columns
    want = sorted({r for r in kept if r[0] in firsts} | {r for r in kept if r[0] is None}, key=str)
    assert rows_of(second) == want

    third = p.drop_leaks(spark, second, sf)
    assert third.columns == docs.columns
    leaked = {r[0] for r in want if ITEM in (r[1] or "")}
    assert leaked and rows_of(third) == [r for r in want if r[0] is None or r[0] not in leaked]

    fourth = {r.doc_id: r for r in p.redact_secrets(spark, third, sf).collect()}
    before = {r.doc_id: r.text for r in third.collect()}
    assert set(fourth) == set(before)
    for i, t in before.items():
        out, at = "", 0
        for start, _, end in base_spans(t or ""):
            if start >= at:
                out += (t or "")[at:start] + "[secret]"
            at = max(at, end)
        assert fourth[i].text == (None if t is None else out + t[at:])
        assert t is None or not base_spans(t) or fourth[i].n_chars == len(fourth[i].text)


def test_run_encodes_what_is_left(spark, sf):
    out = p.run(spark, sf).collect()
    assert 50 < len(out) < 200 and len(p.STAGES) == 5
    encoder, _ = byte_bpe.published_vocabulary().built()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in out:
        if r.doc_id is not None and "token" not in (texts[r.doc_id] or ""):
            assert r.n_tokens == len(encoder.encode_ordinary(texts[r.doc_id] or ""))
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_extra_columns_with_clashing_names(spark, sf):
    extra = ["spans", "selected", "tail_prob", "k1", "component_id", "_bpe_text", "_scan_row", "ids"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).selectExpr("*", *[f"doc_id as `{c}`" for c in extra])
    for _, stage in p.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(r[c] == r.doc_id for r in out.collect() for c in extra)
    assert p.encode(spark, docs, sf).count() == 60


def test_empty_documents(spark, sf, tmp_path):
    none = spark.createDataFrame([], DOCS)
    for _, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0
    assert decontaminate.leaks(none, none.selectExpr("doc_id as item_id", "text")).count() == 0


def test_rows_that_share_an_id_or_have_none(spark, sf):
    a, b, c = (" ".join(f"{m}{i}" for i in range(40)) for m in ("aa", "bb", "cc"))
    leak = f"{c} {ITEM} {c}"
    docs = spark.createDataFrame([row(*x) for x in [(1, a), (1, b), (1, b), (2, b + " more"), (3, ""), (3, None), (None, a), (None, leak), (5, leak), (5, c)]], DOCS)
    left = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)
    assert left(p.keep_one_of_each_group(spark, docs, sf)) == sorted([(1, a), (1, b), (3, ""), (3, None), (None, a), (None, leak), (5, leak), (5, c)], key=str)
    assert left(p.drop_leaks(spark, docs, sf)) == sorted([(1, a), (1, b), (1, b), (2, b + " more"), (3, ""), (3, None), (None, a), (5, c)], key=str)

"""The pipeline on the small tables, stage by stage against brute force."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from lodestone.llm import op4_packing as op4

DATA = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(sorted(s.columns) == sorted(stages[0].columns) for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = before.keys() - after.keys()
    assert sum(labels.get(k, 1) for k in gone) >= 0.9 * len(gone)


def test_near_copies_go(stages):
    from test_operators import near

    before = texts(stages[1])
    ids = sorted(before)
    want = {ids[k] for k, _, _, kept in near([before[i] for i in ids]) if kept}
    assert texts(stages[2]).keys() == want


def test_leaks_go(spark, stages):
    bench = [SPLIT.findall(r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    before, after = texts(stages[2]), texts(stages[3])
    for k, t in before.items():
        held = grams(SPLIT.findall(t.lower()))
        share = max(len(grams(b) & held) / max(1, len(grams(b))) for b in bench)
        assert (k in after) == (share < 0.5), (k, share)


def test_mixture_fits_and_packs(stages):
    n = lambda t: len(SPLIT.findall(t or ""))
    mixed = stages[4].collect()
    assert 0 < sum(n(r.text) for r in mixed) <= sum(map(n, texts(stages[3]).values())) * corpus_pipeline.MIX_PERCENT // 100
    packed = stages[5]
    first = Counter(d for r in packed.collect() for d, p in zip(r.doc_ids, r.piece_nos, strict=True) if p == 0)
    assert first == Counter(r.doc_id for r in mixed)
    back = Counter((r.doc_id, r.text) for r in op4.unpack(packed).collect())
    assert back == Counter((r.doc_id, r.text) for r in mixed) and max(first.values()) > 1


def awkward():
    """Documents with nulls in every column, empty and long texts, repeated rows, shared ids and copies."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    leak, copied = text(40), text(120)
    bad = " ".join([*copied.split()[:60], "changed", *copied.split()[61:]])
    texts_ = [(1, None), (2, ""), (3, "one"), (4, text(60)), (4, text(50)), (5, text(30)), (5, None), (6, "w" * 90_000), (7, text(30_000)), (8, copied), (9, copied), (10, bad), (8, copied), (None, text(40)), (None, f"{text(20)} {leak} {text(20)}"), (11, f"{text(20)} {leak} {text(20)}"), (None, None), (None, copied)]
    texts_ += [(20 + k, text(rng.randint(5, 200))) for k in range(60)]
    rows = [(k, t, [None, "en", "de"][i % 3], [None, "src0", "src1", "src2"][i % 4], None, 7, "clash", i) for i, (k, t) in enumerate(texts_)]
    return rows, leak


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int, text_sha256 string, row int"


def tables(spark, path, rows, bench):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string, doc_id int").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(None, None, None), (4, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_awkward_rows_go_through(spark, tmp_path):
    from test_operators import decontaminated, near

    rows, leak = awkward()
    sf = tables(spark, tmp_path, rows, [(0, leak, 1), (None, None, 1), (2, "", 1)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf))
    assert all(s.columns == docs.columns for s in out[:-1])
    assert plain(out[1]) == sorted(rows, key=repr)  # one label tells nothing
    named = [(k, t) for k, t in {(r[0], r[1]): None for r in rows if r[0] is not None}]
    whole = {k: [t for i, t in named if i == k] for k, _ in named}
    once = sorted(k for k, t in whole.items() if len(t) == 1)
    kept = {once[k] for k, _, _, ok in near([whole[i][0] for i in once]) if ok} | (whole.keys() - set(once))
    got = plain(out[2].select("doc_id", "text"))
    assert got == sorted([(k, t) for k, t in named if k in kept] + [(r[0], r[1]) for r in rows if r[0] is None], key=repr) and {9, 10}.isdisjoint(kept)
    clean = [(k, t) for k, t in got if not decontaminated([(k, t)], [(0, leak)])]
    assert plain(out[3].select("doc_id", "text")) == sorted(clean, key=repr) and len(clean) == len(got) - 2
    n = lambda t: len(SPLIT.findall(t or ""))
    mixed = [(r.doc_id, r.text) for r in out[4].collect()]
    assert set(mixed) <= set(clean) and 0 < sum(n(t) for _, t in mixed) <= sum(n(t) for _, t in clean) * corpus_pipeline.MIX_PERCENT // 100
    assert Counter((r.doc_id, r.text) for r in op4.unpack(out[5]).collect()) == Counter((k, t or "") for k, t in mixed)


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", k)[0] for k in names if re.match(r"op\d+_", k)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)

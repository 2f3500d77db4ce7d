"""The pipeline's stages against their operators' brute-force checks, on a small table."""

import collections

import corpus_pipeline
import pytest

from ledgerlight.llm import mixing, packing, pivot_simhash, secret_scan, toxicity
from ledgerlight.llm.queries import ORACLES, QUERIES
from ledgerlight.llm.staging import stage

from .conftest import SCHEMA, hard_rows, prose, rows_of
from .test_pairs import plain_simhash


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [r for r in hard_rows() if r[0] is not None]
    labels = []
    for n in range(400):
        bad = " gunkhead slimeball vilrotter gunkhead" if n % 8 == 0 else ""
        rows.append((10_000 + n, prose(9000 + n, 90) + bad, "en", "a" if n % 3 else "b", 0))
        labels.append((10_000 + n, 1, int(n % 8 == 0)))
    rows += [(20_000, prose(9001, 90), "en", "c", 0), (20_001, f"{prose(1, 30)} password = hunter2hunter2", "en", "c", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_act_in_turn(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    clean = stage(steps["toxicity"](spark, docs, tables), "clean")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    gone = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert len(gone & {10_000 + n for n in range(0, 400, 8)}) >= 45 and not gone - {10_000 + n for n in range(0, 400, 8)}
    assert rows_of(clean, "doc_id") == rows_of(docs.where(~docs["doc_id"].isin(gone)), "doc_id")
    single = stage(steps["near_duplicates"](spark, clean, tables), "single")
    ids = [r[0] for r in rows_of(single, "doc_id")]
    assert len(ids) == len(set(ids)) and 20_000 not in ids and 10_001 in ids
    marks = [plain_simhash(r["text"]) for r in single.collect()]
    assert len(set(marks)) == len(marks)
    masked = stage(steps["secrets"](spark, single, tables), "masked")
    assert rows_of(masked, "doc_id") == rows_of(single, "doc_id")
    assert "[SECRET]" in masked.where("doc_id = 20001").first()["text"]
    assert secret_scan.secret_spans(masked).where("spans != ''").count() == 0
    mixed = stage(steps["mixture"](spark, masked, tables), "mixed")
    assert rows_of(mixed) == rows_of(masked)
    assert all(d.columns == docs.columns for d in (clean, single, masked, mixed))
    packed = steps["packing"](spark, mixed, tables)
    assert {r[0] for r in packed.select("doc_id").collect()} == set(ids)


def test_run_gives_the_last_stage(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_packing_follows_the_mixture(spark, tmp_path):
    rows = [(n, prose(40_000 + n % 50, 300), "en", "hot" if n % 10 else "cold", 0) for n in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(7, "doc_id").write.parquet(f"{tmp_path}/docs")
    mixed = spark.read.parquet(f"{tmp_path}/docs")
    by_weight = mixing.schedule(mixed, cycle=8, block=8_192).select("doc_id", "slot", "place")
    order = {r["doc_id"]: (r["slot"], r["place"]) for r in by_weight.collect()}
    got = packing.pack_in_order(mixed, by_weight, group_pieces=200).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows} and len({(r["doc_id"], r["piece"]) for r in got}) == len(got)
    runs = collections.defaultdict(list)
    for r in got:
        runs[r["sequence_id"] >> 32].append((order[r["doc_id"]], r["doc_id"], r["piece"]))
    assert sorted(runs) == list(range(-(-len(got) // 200))) and max(map(len, runs.values())) == 200
    assert [x for k in sorted(runs) for x in sorted(runs[k])] == sorted(x for v in runs.values() for x in v)
    chars = collections.Counter()
    for d, text, _, source, _ in rows:
        chars[source] += len(text) + 1
    want = chars["cold"] ** 0.5 / (chars["cold"] ** 0.5 + chars["hot"] ** 0.5)
    tokens = collections.Counter()
    for r in sorted(got, key=lambda r: r["sequence_id"]):
        if tokens.total() < 0.2 * sum(x["length"] for x in got):
            tokens[r["doc_id"] % 10 == 0] += r["length"]
    assert abs(tokens[True] / tokens.total() - want) < 0.05


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and pivot_simhash.LIMIT == 2

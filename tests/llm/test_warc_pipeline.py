import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import warc as R
from tests.llm.common import empty, frame, sentence
from tests.llm.test_dedup_secrets import brute_groups
from tests.llm.test_simhash import grams_of
from tests.llm.test_tokens_packing import held

PAGES = [(3, "u3", "<p>same</p>"), (1, "u1", "<p>same</p>"), (2, None, "<p>other é</p>"), (4, "u4", None), (5, "u5", ""), (7, "u7", "x" * 300_000), (1, "u1", "<p>same</p>"), (None, "n", "<p>same</p>")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    R.write_archive(spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, n long"), path)
    return path


def test_index_against_brute_force(spark, archive):
    out = R.archive_index(spark, archive).collect()
    assert len(out) == len(PAGES)
    for r in out:
        payloads = {(p[2] or "").encode() for p in PAGES if p[0] == r["page_id"]}
        assert len(payloads) == 1
        data = payloads.pop()
        same = [p[0] for p in PAGES if (p[2] or "").encode() == data and p[0] is not None]
        first = min(same)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))


def test_round_trip(spark, archive):
    """Every payload comes back byte for byte and is stored once; records are well formed."""
    out = R.read_archive(spark, archive).collect()
    assert sorted((r["page_id"] or -1, bytes(r["payload"])) for r in out) == sorted((p[0] or -1, (p[2] or "").encode()) for p in PAGES)
    for r in out:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields[b"WARC-Type"].decode() == r["record_type"]
        assert len(block) == int(fields[b"Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
        if r["record_type"] == "response":
            assert block[:-4].partition(b"\r\n\r\n")[2] == bytes(r["payload"])
        else:
            assert fields[b"WARC-Refers-To"] == f"<urn:page:{1 if b'same' in r['payload'] else 4}>".encode()
    stored = spark.read.parquet(f"{archive}/payloads")
    assert stored.groupBy("sha256").count().where("count > 1").count() == 0 and stored.count() == 4


def test_damage_is_found(spark, archive, tmp_path):
    R.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), f"{tmp_path}/b")
    spark.read.parquet(f"{tmp_path}/b/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{tmp_path}/c/payloads")
    spark.read.parquet(f"{tmp_path}/b/headers").write.parquet(f"{tmp_path}/c/headers")
    with pytest.raises(Exception, match="does not have its digest"):
        R.archive_index(spark, f"{tmp_path}/c").collect()


def test_least_and_empty(spark, tmp_path):
    R.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), f"{tmp_path}/d", least=100)
    assert R.archive_index(spark, f"{tmp_path}/d").where("record_type = 'revisit'").count() == 0
    R.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert R.archive_index(spark, f"{tmp_path}/e").collect() == [] and R.read_archive(spark, f"{tmp_path}/e").collect() == []


def test_damaged_header_is_found(spark, archive, tmp_path):
    """What the query returns is parsed from the rebuilt record: a header that states another digest is an error."""
    spark.read.parquet(f"{archive}/payloads").write.parquet(f"{tmp_path}/f/payloads")
    spark.read.parquet(f"{archive}/headers").withColumn("header", F.expr("cast(regexp_replace(cast(header as string), 'sha1:..', 'sha1:77') as binary)")).write.parquet(f"{tmp_path}/f/headers")
    with pytest.raises(Exception, match="does not have its digest"):
        R.archive_index(spark, f"{tmp_path}/f").collect()


def test_hot_payload_is_dealt(spark, tmp_path):
    """A payload of 150 of 200 records is read in parts; every record comes back."""
    pages = [(i, f"u{i}", "<p>hot</p>" if i % 4 else f"<p>{i}</p>") for i in range(200)]
    R.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), f"{tmp_path}/h")
    out = R.read_archive(spark, f"{tmp_path}/h").collect()
    assert sorted((r["page_id"], r["url"], bytes(r["payload"]).decode(), r["refers_to"]) for r in out) == [(i, u, t, 1 if i % 4 and i != 1 else None) for i, u, t in pages]
    assert spark.read.parquet(f"{tmp_path}/h/payloads").count() == 51


def test_pipeline_stages(spark, tmp_path):
    """Planted cases: toxic documents, exact and near copies and benchmark leaks go, clean ones stay; the stages keep the columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_text_models import toxic_docs

    docs, labels = toxic_docs()
    clean = [(10_000 + i, sentence(500 + i, 60 + i), "en", "s", 1) for i in range(40)]
    base = sentence(999, 200)
    w = base.split()
    near = [(11_000 + i, " ".join([*w[: 20 * i], "changed", *w[20 * i + 1 :]]), "en", "s", 1) for i in range(5)]  # one word each
    exact = [(12_000, base, "en", "s", 1), (12_001, base + " \n", "en", "s", 1), (12_002, "  " + base, "en", "s", 1)]
    item = sentence(1234, 30)
    leak = [(13_000, sentence(77, 100) + " " + item + " " + sentence(78, 100), "en", "s", 1)]
    odd = [(14_000, None, None, None, None), (14_001, "", None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame([*((i, t, "en", "s", 1) for i, t, _, _ in docs), *clean, *near, *exact, *leak, *odd], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    df = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns
        out.write.parquet(f"{d}/out/{name}")
        df = spark.read.parquet(f"{d}/out/{name}")
        ids[name] = {r["doc_id"] for r in df.select("doc_id").collect()}
    assert len({i for i in ids["toxicity"] if i < 900 and i % 5 == 0}) < 12 and ids["toxicity"] >= {r[0] for r in [*clean, *near, *exact, *leak]}
    assert 12_001 in ids["exact_dedup"] and not ids["exact_dedup"] & {12_000, 12_002}
    assert len(ids["near_dedup"] & {r[0] for r in [*near, *exact]}) == 1 and ids["near_dedup"] >= {r[0] for r in [*clean, *leak]}
    assert ids["decontamination"] == ids["near_dedup"] - {13_000}
    texts = dict(r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    assert ids["exact_dedup"] == {i for i, (_, _, kept, _) in brute_groups({i: texts[i] for i in ids["toxicity"]}).items() if kept}
    assert ids["near_dedup"] == brute_near({i: texts[i] for i in ids["exact_dedup"]})
    packed = pipeline.run(spark, d).collect()
    assert held(packed, {i: texts[i] or "" for i in ids["decontamination"]}) < 2048
    assert pipeline.STAGES[0][1](spark, empty(spark), d).collect() == [] and frame(spark, []).count() == 0


def brute_near(texts: dict) -> set:
    """The smallest id of each group of texts connected by pairs of Jaccard similarity 0.8 or more, each pair compared."""
    grams, label = {i: grams_of(t or "") for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and label[i] != label[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) - 1e-9:
                a, b = sorted((label[i], label[j]))
                label = {k: a if x == b else x for k, x in label.items()}
    return set(label.values())


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)

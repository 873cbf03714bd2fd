"""The registered opN queries on the smallest tables, and the pipeline's stages."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from compare import assert_same, connection
from recollect.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connection(SF), ORACLE_SQL[name])


COLUMNS = {
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_licenses": {"doc_id": "bigint", "license": "string"},
    "op7_fingerprint": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_substrings": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op10_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.count() == n == df.select("doc_id").distinct().count()


def test_held_out_rows_are_those_of_the_checksum(spark):
    rows = QUERIES["op8_toxicity"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)


# --- The pipeline ---

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, a leak, toxic rows, nulls and repeats; labels and benchmark."""
    rnd = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    text = lambda n: " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        words = text(80).split()
        toxic = i % 6 == 0
        for _ in range(2 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["zorx", "blefth", "quun"]))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(toxic)))
    leak = text(30)
    copied = text(90)
    rows += [(1000, copied, "en", "s0", 1), (1001, copied, "en", "s1", 1), (1001, copied, "en", "s1", 1), (1002, f"{text(10)} {leak} {text(9)}", "en", "s2", 1), (1003, None, "en", "s0", None), (1004, "", None, None, 0), (None, text(50), "en", "s1", 1), (None, copied, "en", "s1", 1)]
    at = tmp_path_factory.mktemp("sf")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_in_order(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        assert docs.columns == columns or name == "tokens"
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    before, after = seen["toxicity"]
    gone = ids(before) - ids(after)
    assert {i for i in range(0, 300, 6)} - gone == set() and all(i is not None and i < 300 and i % 6 == 0 for i in gone)
    before, after = seen["near_duplicates"]
    assert ids(before) - ids(after) >= {1001} and 1000 in ids(after) and after.groupBy("text").count().filter("count > 1").count() == 0
    assert after.filter("doc_id is null").count() == 1 and {i for i in range(300) if i % 6} <= ids(after)
    before, after = seen["decontamination"]
    assert ids(before) - ids(after) == {1002}
    before, after = seen["mixing"]
    size = lambda d: {r.source: r.n for r in d.groupBy("source").agg(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))).alias("n")).collect()}
    a, b = size(before), size(after)
    assert abs(sum(b.values()) - 1.5 * sum(a.values())) < 0.05 * sum(a.values()) and all(b.get(s, 0) <= 2 * n for s, n in a.items())
    before, after = seen["tokens"]
    rows = sorted(after.collect(), key=lambda r: r.start)
    assert len(rows) == before.count() and all(x.start + x.n_tokens == y.start for x, y in zip(rows, rows[1:], strict=False))
    assert pipeline.run(spark, corpus).count() == len(rows)


def test_stages_take_no_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


CLASHES = ["score", "toxicity", "toxicity_key", "key", "text_hash", "hit", "row_key_of", "gone", "first", "near_key", "mix_hash", "take", "mix_text", "takes", "k0", "row", "size"]


@pytest.fixture(scope="module")
def clashing(spark, corpus):
    """The corpus with further columns whose names operators might use, and rows with one id and unlike texts."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    more = spark.createDataFrame([(8, f"another text under the id of the eighth row, number {i} of its kind " + "ab cd " * i, "en", "s1", 1) for i in range(3)], docs.schema)
    return docs.unionByName(more).select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])


def test_stages_keep_columns_of_any_name(spark, corpus, clashing):
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, clashing, corpus)
        assert out.columns == clashing.columns, name
        assert out.select(*CLASHES).distinct().collect() == [tuple(f"mine {c}" for c in CLASHES)], name
    assert pipeline.STAGES[-1][1](spark, clashing, corpus).count() == clashing.count()


def test_rows_with_one_id_are_judged_by_their_texts(spark, corpus, clashing):
    out = pipeline.drop_near_duplicates(spark, clashing, corpus)
    assert out.filter("doc_id = 8").count() == 4
    assert out.groupBy("doc_id", "text").count().filter("count > 1").count() == 0


def test_near_duplicates_stage_against_brute_force(spark, corpus):
    """Of pairs at 0.8 over five words at least nine of ten go, and no row goes that is like no other."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(6))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(200)]
        for _ in range(rnd.randint(1, 3)):
            copy = list(base)
            for _ in range(rnd.choice((0, 1, 2, 4))):
                copy[rnd.randrange(200)] = word()
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, corpus).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in (r[1].split() for r in rows)]
    like = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for b in range(len(rows)) for a in range(b)]
    pairs = [(a, b) for a, b, j in like if j >= 0.8]
    assert len(pairs) > 40 and sum(a in kept and b in kept for a, b in pairs) <= len(pairs) / 10
    assert all(i in kept for i in range(len(rows)) if not any(j > 0.5 and i in (a, b) for a, b, j in like))


def test_decontamination_stage_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    (leak,) = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    windows = {tuple(leak.split()[i : i + 10]) for i in range(len(leak.split()) - 9)}
    holds = lambda t: any(tuple((t or "").split()[i : i + 10]) in windows for i in range(len((t or "").split()) - 9))
    want = sorted(str((r.doc_id, r.text)) for r in docs.collect() if not holds(r.text))
    assert sorted(str((r.doc_id, r.text)) for r in pipeline.drop_contaminated(spark, docs, corpus).collect()) == want


def test_labels_of_one_class_drop_nothing(spark, corpus, tmp_path):
    spark.createDataFrame([(i, 1) for i in range(300)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_warc_query_takes_no_rows(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op1_warc"](spark, str(tmp_path)).count() == 0

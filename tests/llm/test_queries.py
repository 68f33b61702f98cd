import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import brute, data
from tests.llm.test_jaccard import brute as similar
from tests.oracle import agree
from tidemark.llm import queries
from tidemark.llm.language_id import SUFFIXES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    agree(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_native_operators_stay_in_the_jvm(spark):
    for name in ("op2_decontaminate", "op6_line_dedup", "op9_shard_ring"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name


def pipeline_by_brute_force(docs, bench):
    """docs (doc_id, text, lang, source) to how often each doc_id comes out, by versions that share no code with the stages."""
    model = brute.language_model([(r["text"], r["lang"]) for r in docs])
    judged = brute.identified(model, [(r["text"], r["lang"], r["source"], None) for r in docs], SUFFIXES)
    rows = [r for r, (_, _, ok) in zip(docs, judged, strict=True) if ok]
    stays = {i for i, _, c in similar([(r["doc_id"], r["text"]) for r in rows]) if i == c}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    held = set().union(*(runs(words(t)) for t in bench))
    rows = [r for r in rows if r["doc_id"] in stays and not runs(words(r["text"])) & held]
    out = Counter()
    for r, n in zip(rows, brute.mixed([(r["doc_id"], r["text"], r["source"]) for r in rows]), strict=True):
        out[r["doc_id"]] += n
    return +out


def test_pipeline_against_brute_force(spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = P.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == pipeline_by_brute_force(docs, bench)
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per[s] for s in range(24)) <= 1


def test_pipeline_over_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, long texts and columns with names of the operators; and no rows at all."""
    bench = spark.createDataFrame([(1, " ".join(data.texts()[12].split()[3:17])), (2, None)], "item_id long, text string")
    odd = ("rate", "copy", "copies", "target", "source_size", "shard", "slot", "key", "__row_key", "class", "component", "host", "declared")
    docs = data.docs(spark).drop("key", "__key", "class")
    for name, some in (("odd", docs.select("*", *[F.lit("own").alias(x) for x in odd])), ("none", data.nothing(spark))):
        some.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
    docs.write.parquet(f"file://{tmp_path}/plain/documents.parquet")
    bench.write.parquet(f"file://{tmp_path}/plain/benchmark.parquet")
    of = lambda name: Counter(map(repr, P.run(spark, f"file://{tmp_path}/{name}").collect()))
    assert of("odd") == of("plain") and of("odd")
    assert not of("none")
    now = spark.read.parquet(f"file://{tmp_path}/odd/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, f"file://{tmp_path}/odd")
        assert set(odd) < set(now.columns)


def test_pipeline_leaves_only_its_result(spark, tmp_path):
    from tidemark.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "tidemark"
    before = set(folder.iterdir()) if folder.exists() else set()
    P.run(spark, SF).count()
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["stage-sharding"]

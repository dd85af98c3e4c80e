"""Retrieved examples of distinct texts against a search of all rows; notebook documents in blocks."""
from pyspark.sql import functions as F

from spanweave.operators import retrieval as RT
from spanweave.plans import catalog
from spanweave.plans.pseudo_label import examples_per_feature
from tests.conftest import SF


def test_distinct_texts_give_the_examples_of_all_rows(spark):
    words = ["chest pain", "cough", "pain", "fever", "chest cough fever", "night sweats"]
    rows = [(f"{7 * i % 60:03d}", words[i % 5 if i % 3 else 0], words[i % 2], f"note {i}") for i in range(60)]
    corpus = spark.createDataFrame([(i, f, a, f"Feature: {f}  Annotation: {a}", n, None) for i, f, a, n in rows],
                                   "id string, feature_text string, annotation_str string, embed_text string, pn_history string, location string")
    features = spark.createDataFrame([*enumerate(words), (9, "cough"), (10, None), (11, "")], "feature_num int, feature_text string")
    got = {r["feature_num"]: [x["pn_history"] for x in r["examples"]] for r in examples_per_feature(features, corpus, 3).collect()}
    c = RT.hashing_embed(corpus, "embed_text").select(F.col("id").alias("cid"), "embedding", "pn_history")
    q = RT.hashing_embed(features.where("feature_num <> 10").withColumn("t", F.concat(F.lit("Feature: "), "feature_text", F.lit("  Annotation:"))), "t")
    want = {}
    top = RT.knn_topk(q.select(F.col("feature_num").alias("query_id"), "embedding"), c, 3, cid="cid", normalize=False)
    for r in top.join(c, "cid").orderBy("query_id", "rank").collect():
        want.setdefault(r["query_id"], []).append(r["pn_history"])
    assert got == want and len(want) == 8 and got[9] == got[1]
    assert examples_per_feature(features, corpus.limit(0), 3).count() == 0


def test_notebooks_in_blocks_of_cells(spark, monkeypatch):
    want = sorted(map(str, catalog.QUERIES["nested_doc_explode"](spark, SF).collect()))
    monkeypatch.setattr(catalog, "CELLS_A_DOCUMENT", 2)
    assert sorted(map(str, catalog.QUERIES["nested_doc_explode"](spark, SF).collect())) == want


def test_a_stored_table_that_was_cleaned_is_written_again(spark):
    from spanweave.sources import tables as T
    made = []

    def build():
        made.append(1)
        return spark.range(3)
    assert T._on_disk(spark, SF, "again", build).count() == T._on_disk(spark, SF, "again", build).count() == 3 and len(made) == 1
    at = next(k for k in T._WRITTEN if k[2] == "again")
    T._WRITTEN[at] += "-gone"
    assert T._on_disk(spark, SF, "again", build).count() == 3 and len(made) == 2

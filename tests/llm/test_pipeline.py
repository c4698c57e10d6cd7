import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from cityloom.llm import exact_dedup, mixing, ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in cp.STAGES][0] == "toxicity" and len(cp.STAGES) == 5
    one = cp.drop_toxic(spark, docs, SF).cache()
    assert one.columns == columns and 0.7 * docs.count() < one.count() <= docs.count()
    two = cp.drop_exact_copies(spark, one, SF).cache()
    assert {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in exact_dedup.exact_dedup(one).where("kept").collect()}
    three = cp.drop_near_copies(spark, two, SF).cache()
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in ngram_join.ngram_join(two).where("kept").collect()}
    four = cp.mix_sources(spark, three, SF).cache()
    assert four.columns == columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(three).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()} == copies
    five = cp.tokenize(spark, four, SF)
    assert five.count() == four.count() and five.where("NOT round_trip").count() == 0


def test_stages_take_empty_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema)
    for start in (docs.limit(0), odd):
        now = start
        for _, stage in cp.STAGES:
            now = stage(spark, now, SF)
            now.collect()


def test_stages_against_versions_of_their_own(spark):
    """Copies, near copies and repeated rows, rows that share an id or have none: decided by plain loops over the rows."""
    rng = random.Random(12)
    base = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=rng.choice([4, 30, 120]))) for _ in range(25)]
    rows = []
    for n, t in enumerate(base):
        for k in range(rng.choice([1, 2, 4])):
            w = t.split()
            if k and len(w) > 100:
                w[0] = f"x{k}"
            rows.append((n * 10 + k, " ".join(w).upper() if k == 3 else " ".join(w), "en", rng.choice(["a", "b"]), 7, k))
    rows += [rows[0], rows[0], (rows[0][0], "another text of the same id that is its own", "en", "a", 7, 0), (None, base[1], "en", "a", 1, 1), (None, "no id and no copy", "en", None, 1, 1), (5000, None, "en", "a", 0, 0), (5001, "", "de", "a", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_number int, score int")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    got = cp.drop_exact_copies(spark, docs, SF).cache()
    best = {}
    for r in rows:
        k = low(r[1])
        best[k] = max(best.get(k, (-1, None)), (-1 if r[0] is None else r[0], None), key=lambda x: x[0])
    assert got.columns == docs.columns
    assert sorted((low(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect()) == sorted((k, v[0]) for k, v in best.items())
    kept = [tuple(r) for r in got.collect()]
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r[1] or "").lower().split()) else set() for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if shingles[i] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    want = sorted(min(((r[0] is None, r[0] or 0, r[1] or "") for r, g in zip(kept, group) if g == c)) for c in set(group))
    near = cp.drop_near_copies(spark, got, SF)
    assert near.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in near.collect()) == want


def test_toxicity_stage_judges_every_row_by_itself(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("judged", F.lit(1)).withColumn("Score", F.lit(2))
    once = cp.drop_toxic(spark, docs, SF)
    model = cp.toxicity_model(spark, docs, SF)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    toxic = {d for (d, _), p in ((r, model.score(r[1])) for r in texts) if p >= 0.5}
    assert once.columns == docs.columns and sorted(r["doc_id"] for r in once.collect()) == sorted(d for d, _ in texts if d not in toxic)

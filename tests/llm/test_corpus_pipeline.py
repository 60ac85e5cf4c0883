import hashlib
import random
from collections import Counter

import corpus_pipeline
import __spark_entry__
from shelfspark.llm.common import table


def test_stages_on_a_small_corpus(spark, tmp_path, docs):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bcdfg") + rnd.choice("aeiou") for _ in range(3))
    texts = [". ".join(" ".join(word() for _ in range(12)) for _ in range(6)) for _ in range(90)]
    toxic = {i for i in range(0, 90, 3)}
    texts = [t + " zork blarg." if i in toxic else t for i, t in enumerate(texts)]
    pairs = list(enumerate(texts))
    pairs += [(200, texts[1].replace(" ", "  ")), (201, texts[2]), (202, texts[4] + " tail"), (203, None), (204, "")]
    docs(pairs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i in toxic)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    seen, df = {}, table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        if name != "bpe":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = Counter(r.doc_id for r in df.collect())
    clean = set(range(90)) - toxic
    assert set(seen["toxicity"]) == clean | {200, 201, 202, 203, 204}
    assert seen["exact_dedup"] == Counter(clean | {202, 203})
    assert seen["near_dedup"] == Counter(clean | {203})
    assert set(seen["mixing"]) == set(seen["near_dedup"])
    assert seen["bpe"] == seen["mixing"]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    by = dict(pairs)
    assert all(r.decoded_sha256 == hashlib.sha256((by[i] or "").encode()).hexdigest() for i, r in rows.items())


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in ("pipeline", *(f"op{k}_" for k in range(1, 11))) if not any(x.startswith(n) for x in names)] == []
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" not in __spark_entry__.oracle_sql()

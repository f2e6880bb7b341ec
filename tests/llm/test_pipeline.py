from pyspark.sql import functions as F

import corpus_pipeline
from stepwise.llm.decontaminate import Matcher, normalise
from stepwise.llm.queries import DOMAIN_WEIGHTS, LANG_WEIGHTS

from .test_native import mix_by_hand, shards_by_hand
from .test_ngram_join import brute

SF_DIR = "/root/testdata/sf0.001"


def domain(source):
    number = (source or "")[3:]
    return f"group{int(number) % 4}" if number.isdecimal() and number.isascii() else "none"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    words = "the words of the an and in to was be that with"
    odd = [(9001, None, "en", "src1", 0), (9002, "123 456", None, None, 7), (9003, "", "en", "src1", 0)]
    # no id: one of two that are alike, one that is like a document with an id; one id, two texts, one of them twice
    odd += [(None, f"{words} reand", "en", "src2", 5)] * 2 + [(None, f"{words} thing", "en", "web-crawl", 5), (9004, f"{words} thing", None, "src9", 5)]
    odd += [(9005, f"{words} ingth", "en", "src3", 5)] * 2 + [(9005, f"{words} edthe of re", "en", "src3", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("component_id", F.lit(1))
    at, names = docs, [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    rows = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, SF_DIR).write.parquet(str(tmp_path / str(number)))
        at = spark.read.parquet(str(tmp_path / str(number)))
        rows.append(at.collect())
        if number < 4:
            assert at.columns == corpus_pipeline.COLUMNS
    language, near, clean, mixed, sharded = rows
    of = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    # documents with words stay, others go
    assert of(language) == sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (9001, 9002, 9003)), key=str)
    # groups over numbers in the order of the ids, those without one last, of one id by any order: one row of each stays
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in language})
    groups = brute([(k, text) for k, (_, _, text) in enumerate(order)], 5, 80, 100)
    leads = [order[k] for k, (_, first) in groups.items() if k == first]
    assert of(near) == sorted(((None if none else d, t) for none, d, t in leads), key=str)
    matcher = Matcher([(r.item_id, normalise(r.text)) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()])
    assert of(clean) == of([r for r in near if not matcher.find(normalise(r.text))]) and len(clean) < len(near)
    tokens = [((r.doc_id, r.text), (domain(r.source), r.lang or "", r.source or ""), (len(r.text.encode()) + 3) // 4) for r in clean]
    weights = [lambda c: DOMAIN_WEIGHTS.get(c, 1), lambda c: LANG_WEIGHTS.get(c, 1), lambda c: 1]
    by_id = mix_by_hand([(i, p, n) for (i, _), p, n in tokens], weights, (3, 4), 1, 7)
    assert of(mixed) == sorted((key for key, _, _ in tokens if key[0] in by_id), key=str) and 50 < len(mixed) < len(clean)
    assert of(sharded) == of(mixed)
    by = lambda rows: sorted(rows, key=str)
    assert by((r.doc_id, r.size, r.text_crc32, r.shard) for r in sharded) == by(shards_by_hand([(r.doc_id, r.text) for r in mixed], 40))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 50

"""The pipeline's stages on a small corpus with planted junk, copies and benchmark passages."""

import random
import zlib

import corpus_pipeline
from ledgerlark.llm import packing

from .test_documents import near_copies, noisy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    r = random.Random(8)
    good = [(i, noisy(r, True) + "\n" + noisy(r, True)) for i in range(120)]
    junk = [(200 + i, noisy(r, False)) for i in range(60)]
    copies = [(300 + i, "\n".join(t[k : k + 200] for k in range(0, len(t), 200))) for i, t in enumerate(near_copies(5, 4, 120, 1))]
    passage = " ".join(good[0][1].split()[:30])
    dirty = [(400, "A start here.\n" + passage + "\nThen an end.")]
    docs = good + junk + copies + dirty
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 3:
            assert now.columns == COLUMNS
            now.write.parquet(f"{tmp_path}/stage{k}")
            now = spark.read.parquet(f"{tmp_path}/stage{k}")
            kept.append({x.doc_id for x in now.select("doc_id").collect()})
    clean = {i for i, _ in good}
    assert len(kept[0] & clean) >= 118 and len(kept[0] & {i for i, _ in junk}) <= 2
    assert kept[1] == kept[0] - {301, 302, 303, 304} or len(kept[1] & {300, 301, 302, 303, 304}) == 1
    assert kept[2] == kept[1] - {0, 400}
    rows = now.collect()
    assert {x.doc_id for x in rows} == kept[2]
    text = dict(docs)
    ids = {x.doc_id: packing.tokens.memory(packing.tokens.vocabulary("byte_bpe_50k.json"), True).whole(text[x.doc_id]) + b"\1\0\0\0" for x in rows}
    assert all(zlib.crc32(ids[x.doc_id][4 * x.start : 4 * (x.start + x.length)]) == x.ids_crc32 for x in rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)


def test_rows_of_one_id_go_by_their_own_text(spark):
    from ledgerlark.llm import decontaminate, neardup

    from .test_documents import table

    text = lambda a: " ".join(f"w{i}" for i in range(a, a + 60))
    rows = [(1, text(0)), (2, text(0)), (2, text(100)), (3, text(200)), (3, text(200)), (3, text(200) + " z"), (None, text(0)), (None, text(300)), (None, text(300) + " z"), (4, None), (4, None)]
    kept = [(r.doc_id, r.text) for r in neardup.deduplicated(table(spark, rows)).collect()]
    assert [k for k in kept if k[0] in (1, 2)] in ([rows[0], rows[2]], [rows[2], rows[0]])
    assert len([k for k in kept if k[0] == 3]) == 1 and len([k for k in kept if k[0] is None]) == 1 and len(kept) == 6
    bench = spark.createDataFrame([(1, text(0))], "item_id long, text string")
    for block_bytes in (8_000_000, 10):
        clean = [(r.doc_id, r.text) for r in decontaminate.clean(table(spark, rows), bench, block_bytes=block_bytes).collect()]
        assert sorted(clean, key=str) == sorted([r for r in rows if r[1] != text(0)], key=str)


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_awkward_tables(spark, tmp_path):
    from .test_documents import rows_with_edges

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, `start` long"
    rows = [(i, t, None, "s", None, None, "n", 1) for i, t in rows_with_edges(7, 12)]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "x y"), (2, "one word")], "item_id long, text string")
    for name, docs, labels in (("some", rows, lab), ("none", [], lab.limit(0))):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, at)
            if k < 3:
                assert now.columns == [f.strip("` ").split("`")[0].split()[0] for f in schema.split(", ")]
        assert (now.count() > 0) == bool(docs)

"""The pipeline's stages, each on what its predecessor kept, against what they should keep."""

import re

import pytest


def test_entry_has_them():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    item = " ".join(f"bench{i}" for i in range(20))
    text = lambda i: "\n".join(" ".join(f"w{i}x{k}y{j}" for j in range(15)) + "." for k in range(4))
    rows = [(i, text(i), "en", f"s{i % 2}", 0) for i in range(40)]
    rows += [(50 + i, rows[i][1].upper(), "en", "s0", 0) for i in range(5)]
    rows += [(60 + i, rows[i][1] + " more.", "en", "s0", 0) for i in range(5)]
    rows += [(70, rows[7][1].replace("w7", "v7") + "\n" + item, "en", "s1", 0)]
    rows += [(80 + i, "\n".join("%%% !!! BUY NOW!!! ###" for _ in range(5 + i)), "en", "s1", 0) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 80), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, tables):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    kept = []
    for _, stage in p.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), docs.schema)
        assert docs.columns == names
        kept.append(sorted({r["doc_id"] for r in docs.collect()}))
    assert kept[0] == [*range(40), *range(50, 55), *range(60, 65), 70]
    assert kept[1] == [*range(5, 40), *range(50, 55), *range(60, 65), 70]
    assert kept[2] == [*range(5, 40), *range(50, 55), 70]
    assert kept[3] == [*range(5, 40), *range(50, 55)]
    size = docs.count()
    assert set(kept[4]) <= set(kept[3]) and abs(size - 1.5 * len(kept[3])) <= 2


def test_run(spark, tables):
    import corpus_pipeline as p

    out = p.run(spark, tables)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 55 <= out.count() <= 62
    assert not [r for r in out.collect() if re.search("%%%|bench1", r["text"])]


def test_repeated_rows_leave_one(spark):
    """Rows are decided by their own text, though they share an id or have none."""
    import corpus_pipeline as p

    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    near = lambda t: t + " more"
    rows = [(1, x), (1, x), (1, x), (2, x), (1, y), (None, z), (None, z), (None, y.upper()), (0, near(z))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = p.distinct(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(2, x), (1, y), (None, z), (0, near(z))], key=str)
    both = spark.createDataFrame([*rows, (3, near(y))], docs.schema)
    assert sorted(map(tuple, p.apart(spark, both, "").collect())) == [(0, near(z)), (1, x), (1, y)]


def test_odd_documents(spark, tables, tmp_path):
    """Nulls, empty and long texts, rows without ids, clashing columns, and an empty table, through every stage."""
    import corpus_pipeline as p

    good = lambda i: " ".join(f"w{i}x{k}" for k in range(60)) + "."
    rows = [(None, good(1), "s", 1, 2, 3), (None, None, None, 1, 2, 3), (7, "", "s", 1, 2, 3), (7, good(2), "s", None, 2, 3), (8, " \n\t", "s", 1, 2, 3), (9, "long " * 300_000, "s", 1, 2, 3)]
    rows += [(20 + i, good(20 + i), f"s{i % 2}", i, i, i) for i in range(20)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, row_id long, mix_row long, kept long")
    for docs in (odd, odd.limit(0)):
        for _, stage in p.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, tables).collect(), odd.schema)
            assert docs.columns == odd.columns
        if docs.count():
            assert {r["text"] for r in docs.collect()} <= {r[1] for r in rows}
            assert sum(r["doc_id"] is None for r in docs.collect()) > 0

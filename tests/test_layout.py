"""Lines and layouts of many pages at a time: ties, repeated paint, grids, and what the queries make of whole tables."""

import numpy as np
import pyarrow as pa

from inkspark.operators import layout

GLYPHS = "doc_id long, page_index int, seq long, text string, x double, y double, size double, adv_x double, font string"


def test_glyphs_of_one_place_and_order_are_all_in_a_line(spark):
    """Ties come in another order each time that the table is read, as from a shuffle; no glyph may go for it."""

    def tied(batches):
        rng = np.random.default_rng()
        for batch in batches:
            doc = np.repeat(batch.column(0).to_numpy(), 8)
            n = len(doc)
            size = np.tile([8.0, 9.0, 10.0, 8.0, 9.0, 10.0, 8.0, 8.0], n // 8)
            x = np.tile([1.0] * 6 + [2.0, 2.0], n // 8)
            by = rng.permutation(n)
            columns = [doc, np.zeros(n, np.int32), np.ones(n, np.int64), ["x"] * n, x, np.full(n, 700.0), size, np.full(n, 5.0), ["F"] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c).take(pa.array(by)) for c in columns], names=[f.split()[0] for f in GLYPHS.split(", ")])

    got = layout.lines(spark.range(0, 2000, 1, 4).mapInArrow(tied, GLYPHS)).collect()
    assert len(got) == 2000 and {(r.n_chars, r.x, r.y, r.size, r.line_no) for r in got} == {(8, 1.0, 700.0, 9.0, 0)}


def texts_of(spark, tmp_path, name):
    """What a query makes of some documents, with the rows that their texts' lines should give."""
    from inkspark.plans.queries import QUERIES
    from inkspark.sources.writer import wrapped

    texts = ["one  two\n\n" + "long line " * 4000 + "\nend", "", None, "é中😀 x  " * 40 + "\n   \n b", "aaa bb" * 7]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, i * 400 + k, " ".join(raw.split())) for d, t in enumerate(texts) for i, line in enumerate((t or "").split("\n")) for k, raw in enumerate(wrapped(line)) if raw.strip()]
    return QUERIES[name](spark, str(tmp_path)), sorted(want)


def test_gaps_and_paint_are_laid_out_where_they_are_made(spark, tmp_path):
    for name in ("gap_spaces", "overprint_dedupe"):
        got, want = texts_of(spark, tmp_path / name, name)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == want


def test_layouts_are_made_where_the_file_is(spark, tmp_path):
    import hashlib

    from inkspark.plans.queries import QUERIES
    from inkspark.sources.writer import wrapped

    text = "one  two\n\n" + "long line " * 900 + "\n  end"
    spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["layout_grid"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = [r.rstrip() for r in wrapped(text)]
    assert sorted(map(tuple, got.collect())) == [(1, p, hashlib.md5("\n".join(rows[60 * p : 60 * p + 60]).encode()).hexdigest()) for p in range(2)]


def test_boxes_are_placed_where_the_file_is(spark, tmp_path):
    from inkspark.plans.queries import QUERIES

    text = "one  two\nx\n" + "long line " * 900 + "\n  end"
    spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for name in ("glyph_positions", "saved_state_positions", "quoted_line_positions", "spacing_scaling_kerning"):
        got = QUERIES[name](spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        found[name] = sorted((r.page_index, r.line_no, r.n_chars, r.y, r.x) for r in got.collect() if r.n_chars > 1)
    assert len(found["glyph_positions"]) == 102 and all(v == found["glyph_positions"] for v in found.values())

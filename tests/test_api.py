"""The API over files on disk, option checks."""

import pytest

from leafloom import api, options
from leafloom.sources import pdfparse
from tests.test_tables import CELLS, PAGE


def test_extract(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdfparse.write([PAGE, [("Second page", 10, 10, 9, "Times")]], {"Title": "T"}, ["https://a.b/c"], [(1, 1, b"\1\2\3")]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\nbroken")
    (tmp_path / "c.txt").write_text("no")
    x = api.extract(spark, str(tmp_path) + "/")
    assert x.text().first().text.startswith("--- PAGE 1 ---\n\nNameAgeCity\nAlice30New York")
    assert [r.page for r in x.geometric_text().orderBy("page").collect()] == [1, 2]
    assert x.tables_as("csv").first().csv == "\n".join(",".join(r) for r in CELLS)
    assert x.search("second").first().pages == "2" and x.errors().count() == 1 and x.metadata().count() == 2
    assert x.summary().first().total_images == 2 and [r.link for r in x.links().collect()] == ["https://a.b/c"]
    assert '"pageNumber":1' in x.structured().orderBy("page").first().json
    assert "[IMAGE:img_1]" in x.text_with_images().first().text
    only = api.extract(spark, str(tmp_path) + "/", options.ExtractOptions(pages=(2,), page_markers=False))
    assert only.text().first().text == "Second page"


def test_options():
    good = options.ExtractOptions()
    assert options.problems("/data/x.pdf", good) == []
    bad = options.ExtractOptions(batch_size=0, memory_limit="lots", image_quality=101, marker_format="x", image_ref_format="{no}", pages=(0,))
    assert {p.field for p in options.problems("x.doc", bad)} == {"path", "batch_size", "memory_limit", "image_quality", "marker_format", "image_ref_format", "pages"}
    with pytest.raises(ValueError, match="path"):
        api.extract(None, " ")

from __future__ import annotations

from quillmatch.llm import warc
from quillmatch.llm.common import Scratch


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    folder = tmp_path / "archives"
    pages = spark.createDataFrame([(1, "http://a/", "<p>one"), (2, "http://b/", "<p>two")], "page_id long, url string, html string")
    for ids in ("page_id = 1", "page_id = 2"):
        warc.write_pages(pages.where(ids), str(folder), Scratch(spark))
    good = next(folder.glob("part-*.warc.gz")).read_bytes()
    (folder / f"part-{'0' * 32}.warc.gz").write_bytes(good)
    (folder / f"part-{'1' * 32}.warc.gz").write_bytes(good[: len(good) // 2])
    assert sorted(r.page_id for r in warc.read_pages(spark, str(folder)).collect()) == [1, 2]

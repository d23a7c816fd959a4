from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from ringview.llm import common, lm, warc
from ringview.plans import common as plans_common


@pytest.mark.parametrize("shared_path", [common.shared_path, plans_common.shared_path])
def test_a_cluster_needs_a_shared_folder(shared_path) -> None:
    def spark(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))

    assert shared_path(spark("spark://x:7077", "hdfs://y/z/"), "n").startswith("hdfs://y/z/ringview/n-")
    for master in ("local", "local[8]", "local[*]"):
        assert shared_path(spark(master), "n").startswith("file:///")
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_path(spark(master), "n")


def test_tables_are_cut_and_dropped(spark, tmp_path) -> None:
    df = common.cut(spark.range(5).withColumn("x", F.lit(None).cast("string")), "numbers")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().toString().lower()
    common.drop(df)
    with pytest.raises(Exception, match="(?i)not.exist|no such|FILE_NOT_EXIST"):
        spark.read.parquet(df.cut_path).count()


def test_shards_of_another_store_are_mapped_from_copies(tmp_path) -> None:
    here = lm.Files(str(tmp_path))
    values = np.arange(1000, dtype=np.uint16)
    here.put("codes", values)
    there = lm.Files(str(tmp_path))
    there.fs = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    for _ in range(2):
        assert (there.get("codes") == values).all() and (here.get("codes") == values).all()
    assert len(lm.Files.copies) == 1


def test_archives_of_pages_with_clashing_columns(spark) -> None:
    html = "<p>" + "x" * 200
    rows = [(1, "u", html, "a", b"z", 7, "r"), (2, None, html, "b", None, None, None), (2, None, html, "b", None, None, None), (None, "v", None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, digest string, payload binary, first_id long, record_type string")
    got = warc.read_archive(spark, warc.write_archive(pages)).collect()
    assert sorted((r["record_id"], r["record_type"]) for r in got) == [("<urn:page:1>", "response"), ("<urn:page:2>", "revisit"), ("<urn:page:2>", "revisit"), ("<urn:page:null>", "response")]

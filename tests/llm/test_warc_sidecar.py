import gzip

import pyarrow.parquet as pq

from tidewake.llm import warc_normalise


def test_records_are_read_through_the_sidecar(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * i) for i in range(5000)], "page_id long, url string, html string")
    for d in ("in", "out"):
        (tmp_path / d).mkdir()
    packed = warc_normalise.pack_pages(pages.repartition(2), str(tmp_path / "in")).collect()
    (tmp_path / "in" / "empty.warc.gz").write_bytes(b"")
    paths = spark.createDataFrame([(r.path,) for r in packed] + [(str(tmp_path / "in" / "empty.warc.gz"),)], "path string")
    rows = {tuple(r) for r in warc_normalise.normalise(paths, str(tmp_path / "out")).collect()}
    read = set()
    for r in packed:
        out = str(tmp_path / "out" / r.path.rsplit("/", 1)[1])
        index = pq.read_table(warc_normalise.sidecar(out)).to_pylist()
        read |= {tuple(x.values()) for x in index}
        raw = gzip.open(r.path).read()
        assert b"".join(warc_normalise.read_record(out, x["offset"], x["length"]) for x in index) == raw
    assert read == rows and len(rows) == 5000
    assert pq.read_table(warc_normalise.sidecar(str(tmp_path / "out" / "empty.warc.gz"))).num_rows == 0
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.name.startswith(".") and not x.name.endswith(".crc")) == []

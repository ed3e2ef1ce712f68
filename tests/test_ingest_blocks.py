"""Chunk files are opened by name and read in blocks: no task holds a whole file."""
import pyarrow as pa
import pyarrow.parquet as pq

from scanledger.streaming import ingest as IN

SCHEMA = "volume_id string, chunk string, failed boolean, error string, cached boolean"


def rows(name, n):
    return pa.table({"volume_id": [f"{name}{i}" for i in range(n)], "chunk": [name] * n, "failed": [False] * n, "cached": [False] * n, "error": pa.nulls(n, pa.string())})


def test_read_files_in_blocks(spark, tmp_path):
    n = 2 * IN.BLOCK_ROWS + 5
    pq.write_table(rows("a", n).drop_columns(["error"]), tmp_path / "a %41.parquet")
    pq.write_table(pa.table({"other": [1, 2, 3]}), tmp_path / "b.parquet")
    pq.write_table(rows("c", 0), tmp_path / "c.parquet")
    paths = [f"file:{tmp_path}/{f}" for f in ("a %41.parquet", "b.parquet", "c.parquet", "gone.parquet")]
    read = IN.read_files(spark, paths, SCHEMA)
    assert "binaryfile" not in read._jdf.queryExecution().toString().lower()  # the content of a file is never one value
    got = read.collect()
    assert sorted(r._position for r in got if r.chunk == "a") == list(range(n))
    assert all(r.volume_id == f"a{r._position}" and r.error is None for r in got if r.chunk == "a")
    assert sorted(r._file.rsplit("/", 1)[1] for r in got if r._position is None) == ["a %41.parquet", "b.parquet", "c.parquet"]
    assert sorted(r._position for r in got if r._file.endswith("b.parquet") and r._position is not None) == [0, 1, 2]


def test_a_file_that_breaks_behind_its_first_block_has_an_error_and_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pq.write_table(rows("ok", 3), tmp_path / "in" / "ok.parquet")
    bad = tmp_path / "in" / "bad.parquet"
    pq.write_table(rows("bad", 4 * IN.BLOCK_ROWS), bad, row_group_size=IN.BLOCK_ROWS, compression="snappy")
    content, meta = bytearray(bad.read_bytes()), pq.ParquetFile(bad).metadata
    column = meta.row_group(2).column(0)
    start = min(x for x in (column.dictionary_page_offset, column.data_page_offset) if x)
    content[start:start + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    bad.write_bytes(bytes(content))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    assert IN.ingest(spark, str(tmp_path / "in"), SCHEMA, out, mark) == 2
    assert sorted(r.volume_id for r in IN.read_table(spark, out, "accepted").collect()) == ["ok0", "ok1", "ok2"]
    assert IN.read_table(spark, out, "outcomes").count() == 3
    assert [r.chunk.rsplit("/", 1)[1] for r in IN.attempts(spark, out).collect() if r.failed] == ["bad.parquet"]

"""How queries deal their work out."""

import pytest

from krunch.plans import catalog


@pytest.mark.parametrize("name", ["roundtrip_bzip2_strict", "truncated_brotli", "truncated_streams", "trailing_data", "meta_roundtrip", "bwt_names", "bwt_documents", "roundtrip_brotli", "chunking_cost", "corrupt_streams"])
def test_all_cores_work_on_one_file(spark, sf_dir, name):
    """The table is a file of one row group, which a scan leaves to one task."""
    frame = catalog.queries()[name](spark, sf_dir)
    rows = [x for x in frame.rdd.glom().map(len).collect() if x]
    assert len(rows) >= spark.sparkContext.defaultParallelism and max(rows) < sum(rows) / 2


def test_batches_are_taken_in_slices(spark):
    """A batch of 4000 rows of 2 KB is worked on and sent a megabyte at a time."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from krunch.operators.codecs import in_slices, slices

    rows = spark.range(4000).coalesce(1).select("id", F.encode(F.repeat(F.lit("x"), 2000), "UTF-8").alias("data"))
    size = in_slices(lambda c: pa.array([c.nbytes] * len(c), pa.int64()), "bigint")
    found = rows.select("id", size(F.col("data")).alias("n")).collect()
    assert len(found) == 4000 and max(r.n for r in found) < 1_100_000
    column = pa.array([b"a" * 3_000_000, None, b"", b"b" * 600_000, b"c" * 600_000, None])
    assert [len(x) for x in slices(column)] == [1, 3, 2] and pa.concat_arrays(list(slices(column))).equals(column)
    assert not list(slices(pa.array([], pa.binary())))


def _evaluated(frame) -> list[str]:
    """The Python functions of a plan, each with its argument."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return [line.split("ArrowEvalPython [")[1].split("], [pythonUDF")[0] for line in plan.splitlines() if "ArrowEvalPython" in line]


def test_containers_are_made_once(spark, sf_dir):
    """Each is read three ways; a join of two of them, or functions of functions, would put every container together again."""
    frame = catalog.queries()["container_roundtrip"](spark, sf_dir)
    assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
    found = _evaluated(frame)
    assert len(found) == 5 and sum("parts#" in x for x in found) == 1 and not any("run(run(" in x or "collect_list" in x for x in found)


def test_streams_are_encoded_once(spark, sf_dir):
    found = _evaluated(catalog.queries()["roundtrip_brotli"](spark, sf_dir))
    assert len(found) == 2 and sum("data#" in x for x in found) == 1 and not any("run(run(" in x for x in found)


def test_codes_of_streams_over_batches(spark):
    """Streams that begin in one batch and end in another get the codes that they get alone, also one without an id; no group is a task of Python's."""
    from krunch.functions import huffman
    from krunch.operators import stages

    rows = [(k or None, s, (k * 31 + s * s) % 97) for k in range(40) for s in range(1 + k % 7 * 40)]
    counts = spark.createDataFrame(rows[::-1], "stream_id long, sym int, cnt long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        codes = stages.code_lengths(counts)
        got = sorted((r.stream_id or 0, r.sym, r.cnt, r.len) for r in codes.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for k in range(40):
        own = sorted((s, n) for i, s, n in rows if (i or 0) == k)
        want += [(k, s, n, size) for (s, n), size in zip(own, huffman.code_lengths([n for _, n in own], 15), strict=True)]
    assert got == want
    assert "FlatMapGroups" not in codes._jdf.queryExecution().optimizedPlan().toString()

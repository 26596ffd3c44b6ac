import pytest

from lodestar import schemas
from lodestar.operators import chunking
from lodestar.streaming import chunks as stream

SPEC = {"name": "f", "type": "fixed", "chunk_size": 2, "chunk_overlap": 0}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    for i in range(2):
        spark.createDataFrame([(f"d{i}", "t", f"alpha beta gamma{i}", "x")], schemas.DOCUMENT).write.mode("append").parquet(docs)
        stream.write(stream.chunks(stream.documents(spark, docs), SPEC), out, mark).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).select(chunking.COLUMNS).collect()))
    assert got == sorted(map(tuple, chunking.build(spark.read.parquet(docs), SPEC).collect())) and len(got) == 4
    with pytest.raises(ValueError):
        stream.chunks(stream.documents(spark, docs), {"type": "semantic"})

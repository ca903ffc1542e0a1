"""Python gets batches of bounded size."""

import pyarrow as pa

from lakewright.llm import common
from lakewright.llm.common import staged


def test_texts_go_to_python_in_small_batches(spark):
    def sizes(frames):
        for batch in frames:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id as string), 8000) AS text").mapInArrow(sizes, "size bigint")
    assert max(r.size for r in staged(spark, rows, "sizes").collect()) < 2 * common.ARROW_BYTES

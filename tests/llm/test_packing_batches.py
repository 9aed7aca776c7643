"""How many rows reach a tokenising worker together."""

import pyarrow as pa
import public_tokenizers

from kinprofile.llm import packing
from kinprofile.llm.queries import TOKENIZER


def test_tokenising_takes_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(i, f"word{i % 90} again") for i in range(2000)], schema).coalesce(1)

    def batches(rows):
        for b in rows:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([str(b.num_rows)] * b.num_rows, pa.string())], ["doc_id", "text"])

    tokens = packing.tokenise(docs.mapInArrow(batches, schema), public_tokenizers.path(TOKENIZER), 2)
    alone = packing.tokenise(spark.createDataFrame([(1, "2000")], schema), public_tokenizers.path(TOKENIZER), 2)
    seen = {bytes(r["ids"]) for r in tokens.where("kind = 'doc'").select("ids").collect()}
    assert bytes(alone.where("kind = 'doc'").first()["ids"]) not in seen and len(seen) == 2
    assert tokens.where("kind = 'df'").first()["key"] == 2000 and spark.conf.get(name) == usual

"""Small builders for inline fixture tables."""

from __future__ import annotations

import datetime as dt

from driftgate.schemas import OBSERVATION, SOURCE_ORDER, SOURCE_URLS

SF001 = "/root/testdata/sf0.001"

MATERIAL = ["lifecycle_status", "retirement_date", "input_price", "output_price", "context_limit",
            "max_output_limit", "tool_calling", "structured_output", "vision", "identifier_kind"]


def obs_row(provider, model_id, source_id, fetched, seq=0, **facts):
    row = {f.name: None for f in OBSERVATION.fields}
    row.update(provider=provider, model_id=model_id, entity_key=f"{provider}:{model_id}", source_id=source_id,
               source_ord=SOURCE_ORDER.index(source_id), source_url=SOURCE_URLS[source_id],
               fetched_at=dt.datetime.fromisoformat(fetched), source_digest="d-" + source_id,
               parser_version="1.0.0")
    row.update(facts)
    row["obs_seq"] = seq
    return row


def obs_df(spark, rows):
    from pyspark.sql import types as T
    schema = T.StructType(OBSERVATION.fields + [T.StructField("obs_seq", T.LongType())])
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)

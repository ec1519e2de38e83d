"""Name-based UUIDs (version 5) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces of document and chunk ids.
DOCUMENT_NAMESPACE = "3d73b6b9-a8cb-4da8-b4b0-5ecdb09b3836"
CHUNK_NAMESPACE = "82f00626-72d1-4ee7-90a5-c281a4f3f4ec"


def uuid5(namespace: str, name: Column) -> Column:
    x = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(x, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.concat(F.lit("5"), F.substring(x, 14, 3)), F.concat(variant, F.substring(x, 19, 2)), F.substring(x, 21, 12))


def document_id(source_path: Column) -> Column:
    return F.when(source_path.isNotNull(), uuid5(DOCUMENT_NAMESPACE, source_path))


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return F.when(document_id.isNotNull() & chunk_index.isNotNull(), uuid5(CHUNK_NAMESPACE, F.concat(document_id, F.lit(":"), chunk_index.cast("string"))))

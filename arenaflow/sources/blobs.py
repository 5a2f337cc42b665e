"""Binary values nested in documents: taken out into rows of their own and put back.

A staged document holds bytes as an object of three text fields, wherever they
stand (``encoding`` base64, ``fieldPath``, ``valueBase64``).  Documents are
brought to their canonical JSON first (keys sorted, no blanks), so that such an
object is one pattern at any depth; inside a JSON string its quotes would be
escaped, so text never looks like one.  All of it is native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two forms of a binary value in a document.
_BYTES = r'\{"encoding":"base64","fieldPath":"((?:[^"\\]|\\.)*)","valueBase64":"([A-Za-z0-9+/=]*)"\}'
_REFERENCE = r'\{"blobId":"([0-9a-f]{64})"\}'


def canonical_json(text: Column) -> Column:
    """The document with sorted keys and without blanks; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _woven(text: str, pattern: str, between: str) -> Column:
    """``text`` with its matches of ``pattern`` replaced by the elements of the array ``between``, one by one."""
    parts = F.split(F.col(text), pattern, -1)
    return F.concat(F.element_at(parts, 1), F.array_join(
        F.zip_with(F.col(between), F.slice(parts, 2, F.size(between)), lambda own, after: F.concat(own, after)), ""))


def extract_blobs(records: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Records with references in place of nested bytes, and ``extraction_id, record_sequence, field_path, blob_id, value``.

    A blob's id is the SHA-256 of its bytes.  Documents without bytes come out in canonical form; a payload that is
    no JSON becomes null.
    """
    read = records.withColumn("__text", canonical_json(F.col(payload))).withColumns({
        "__paths": F.regexp_extract_all("__text", F.lit(_BYTES), 1), "__coded": F.regexp_extract_all("__text", F.lit(_BYTES), 2)})
    named = read.withColumn("__found", F.zip_with("__paths", "__coded", lambda path, coded: F.struct(
        path.alias("field_path"), F.sha2(F.unbase64(coded), 256).alias("blob_id"), F.unbase64(coded).alias("value"))))
    marked = named.withColumn("__ids", F.transform("__found", lambda blob: F.concat(
        F.lit('{"blobId":"'), blob["blob_id"], F.lit('"}'))))
    documents = marked.withColumn(payload, F.when(F.size("__ids") > 0, _woven("__text", _BYTES, "__ids")).otherwise(
        F.col("__text"))).select(*records.columns)
    blobs = named.select("extraction_id", F.col("sequence").alias("record_sequence"), F.inline("__found")).withColumn(
        "field_path", F.get_json_object(F.concat(F.lit('{"p":"'), "field_path", F.lit('"}')), "$.p"))
    return documents, blobs


def restore_blobs(documents: DataFrame, blobs: DataFrame, payload: str = "payload") -> DataFrame:
    """Documents with their bytes put back in canonical form: the inverse of ``extract_blobs``.

    References are looked up by extraction, record and their place in the document, so that a blob
    used by many records is joined where it is used.  A reference without its blob fails the restoration: the
    payload is null.
    """
    keys = ["extraction_id", "sequence"]
    found = documents.withColumn("__ids", F.regexp_extract_all(payload, F.lit(_REFERENCE), 1))
    asked = found.where(F.size("__ids") > 0).select(*keys, F.posexplode("__ids").alias("__at", "blob_id"))
    # Equal bytes at two places of a record differ in their path alone: the n-th use of an id takes its n-th row.
    turn = "row_number() OVER (PARTITION BY extraction_id, sequence, blob_id ORDER BY {}) AS __turn"
    known = blobs.select("extraction_id", F.col("record_sequence").alias("sequence"), "field_path", "blob_id", "value")
    placed = asked.selectExpr("*", turn.format("__at")).join(
        known.selectExpr("*", turn.format("field_path")), [*keys, "blob_id", "__turn"], "left")
    path = F.expr("substring(to_json(named_struct('p', field_path)), 6, length(to_json(named_struct('p', field_path))) - 6)")
    coded = F.concat(F.lit('{"encoding":"base64","fieldPath":'), path, F.lit(',"valueBase64":"'),
                     F.regexp_replace(F.base64("value"), r"\s", ""), F.lit('"}'))
    gathered = placed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", coded.alias("text")))),
                                                     lambda entry: entry["text"]).alias("__texts"))
    whole = found.join(gathered, keys, "left").withColumn("__texts", F.coalesce("__texts", F.array().cast("array<string>")))
    return whole.withColumn(payload, F.when(F.exists("__texts", F.isnull), F.lit(None)).when(F.size("__ids") > 0, _woven(payload, _REFERENCE, "__texts")).otherwise(
        F.col(payload))).select(*documents.columns)
